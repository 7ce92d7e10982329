"""Concourse: indoor-navigation analytics and data-pipeline jobs on PySpark."""
