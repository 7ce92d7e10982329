"""Navigation documents as JSON: one document per building, read into tables and written back."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import shared_dir

SCHEMA = "schema string, levels array<struct<id: long, name: string, elevation_m: double>>, spaces array<struct<id: long, name: string, level_id: long, is_exit: boolean>>, transitions array<struct<from_id: long, to_id: long, bidirectional: boolean>>"
VERSION = "concourse.nav/1"


def to_documents(tables: dict[str, DataFrame]) -> DataFrame:
    """(building_id, document): each building's rows of every table, nested and sorted, as one JSON text."""
    parts = []
    for name, rows in tables.items():
        fields = [c for c in rows.columns if c != "building_id"]
        parts.append(rows.groupBy("building_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name)))
    joined = reduce(lambda a, b: a.join(b, "building_id", "full"), parts)
    return joined.select("building_id", F.to_json(F.struct(F.lit(VERSION).alias("schema"), *tables)).alias("document"))


def from_documents(documents: DataFrame) -> DataFrame:
    """Parsed documents: unknown fields are ignored, absent lists are empty, text that is no JSON gives nulls and stays countable."""
    d = documents.select("building_id", F.from_json("document", SCHEMA).alias("d"))
    return d.select("building_id", F.coalesce("d.schema", F.lit("concourse.nav/0")).alias("schema"), *[F.coalesce(f"d.{k}", F.array()).alias(k) for k in ("levels", "spaces", "transitions")])


def table_of(parsed: DataFrame, name: str) -> DataFrame:
    return parsed.select("building_id", F.inline(name))


def save_playback(frames: DataFrame) -> str:
    """Write frames (run_id, frame_no, agent_id, status, time_s) as JSON, one object a frame with its agents, to the shared folder; where it is."""
    path = f"{shared_dir(frames.sparkSession)}/playback-{uuid.uuid4().hex}"
    frames.groupBy("run_id", "frame_no").agg(F.array_sort(F.collect_list(F.struct("agent_id", "status", "time_s"))).alias("agents")).write.json(path)
    return path
