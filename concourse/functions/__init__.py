"""See the package README for what lives in functions."""
