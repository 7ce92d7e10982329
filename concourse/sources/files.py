"""Files of the library: JSON documents, playbacks, requests and manifests, raw element tables, and catalogues of any files.

Everything is written beside its readers by Spark and read through a scan with an explicit schema. A record that does
not fit is kept as text in `broken`, so a damaged file is a row to report and never a lost one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import shared_dir
from .documents import SCHEMA

# The prefix of the schema names of playbacks, and the engines that a request may ask for.
PLAYBACK = "concourse.playback/"
BACKENDS = ("planner", "crowd", "hybrid")
FRAME = "schema string, frame_no long, agents array<struct<agent_id: long, status: string, time_s: double>>"
REQUEST = "id long, speed double, multiplier double, backend string, agents array<struct<count: long>>"
CASE = "id long, tiers array<string>, options map<string, int>"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _json(spark: SparkSession, path: str, schema: str, whole: bool = False) -> DataFrame:
    read = spark.read.schema(f"{schema}, broken string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "broken")
    return read.option("multiLine", whole).json(path)


def write_documents(documents: DataFrame) -> str:
    """Write (building_id, document) as one JSON file in a folder of each building; where they are. A row is a whole document, so buildings are spread by their own number only."""
    path = new_path(documents.sparkSession, "documents")
    documents.repartition("building_id").write.partitionBy("building_id").text(path)
    return path


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(building_id, file, broken, schema, levels, spaces, transitions): one row a file, which may span lines. Absent lists are empty; of a file that is no document broken holds the text, and its lists are empty."""
    d = _json(spark, path, SCHEMA, whole=True)
    lists = [F.coalesce(k, F.array()).alias(k) for k in ("levels", "spaces", "transitions")]
    return d.select("building_id", F.col("_metadata.file_name").alias("file"), "broken", F.coalesce("schema", F.lit("concourse.nav/0")).alias("schema"), *lists)


def write_playback(frames: DataFrame) -> str:
    """Write frames (run_id, frame_no, agent_id, status, time_s) as JSON, one object a frame with its agents, in a folder of each run; where they are."""
    path = new_path(frames.sparkSession, "playback")
    whole = frames.groupBy("run_id", "frame_no").agg(F.array_sort(F.collect_list(F.struct("agent_id", "status", "time_s"))).alias("agents"))
    whole.select("run_id", F.lit(f"{PLAYBACK}1").alias("schema"), "frame_no", "agents").write.partitionBy("run_id").json(path)
    return path


def read_playback(spark: SparkSession, path: str) -> DataFrame:
    """(run_id, frame_no, agent_id, status, time_s) of all frames of known playbacks; frames of another schema and broken ones are left out."""
    f = _json(spark, path, FRAME).where(F.col("schema").startswith(PLAYBACK) & F.col("broken").isNull())
    return f.select(F.col("run_id").cast("string").alias("run_id"), "frame_no", F.inline("agents"))


def read_requests(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Requests (id, speed, multiplier, backend, n_agents) that may run, with speeds of 0.05 and multipliers of 1 at least; and what is rejected, (id, reason): no agents, a group of fewer than 1 or more than 5,000, an unknown backend (that of null is the planner), a broken line."""
    r = _json(spark, path, REQUEST)
    counts = F.transform("agents", lambda a: a["count"])
    why = (
        F.when(F.col("broken").isNotNull(), "broken")
        .when(F.coalesce(F.size("agents"), F.lit(0)) <= 0, "no agents")
        .when(~F.forall(counts, lambda n: F.coalesce(n.between(1, 5000), F.lit(False))), "count")
        .when(~F.coalesce("backend", F.lit(BACKENDS[0])).isin(*BACKENDS), "backend")
    )
    r = r.withColumn("reason", why)
    good = r.where("reason is null").select("id", F.greatest(F.coalesce("speed", F.lit(0.05)), F.lit(0.05)).alias("speed"), F.greatest(F.coalesce("multiplier", F.lit(1.0)), F.lit(1.0)).alias("multiplier"), F.coalesce("backend", F.lit(BACKENDS[0])).alias("backend"), F.aggregate(counts, F.lit(0).cast("long"), lambda a, n: a + n).alias("n_agents"))
    return good, r.where("reason is not null").select("id", "reason")


def read_manifest(spark: SparkSession, path: str, defaults: dict[str, int], tiers: list[str], ids: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Cases (id, options) of any of the tiers, their own options over the defaults; with ids (id), only those cases, whatever their tier, and as second table the asked ids that the manifest doesn't have."""
    cases = _json(spark, path, CASE).where("broken is null")
    base = F.create_map(*[F.lit(v) for pair in defaults.items() for v in pair])
    own = F.coalesce("options", F.create_map().cast("map<string,int>"))
    merged = F.map_zip_with(base, own, lambda k, a, b: F.coalesce(b, a))
    if ids is None:
        chosen = cases.where(F.arrays_overlap("tiers", F.array(*[F.lit(t) for t in tiers])))
        missing = cases.select("id").limit(0)
    else:
        chosen = cases.join(ids.select("id").distinct(), "id", "left_semi")
        missing = ids.select("id").distinct().join(cases.select("id"), "id", "left_anti")
    return chosen.select("id", merged.alias("options")), missing


def catalogue(spark: SparkSession, path: str) -> DataFrame:
    """(path, size_bytes) of all files under a path, partition columns included; contents are not read."""
    found = spark.read.format("binaryFile").load(path)
    return found.drop("content", "modificationTime").withColumnRenamed("length", "size_bytes")


def write_elements(elements: DataFrame) -> str:
    """Write raw elements with a column `kind` as one table partitioned by it, so that a loader reads only the kinds it wants; where it is."""
    path = new_path(elements.sparkSession, "elements")
    elements.write.partitionBy("kind").parquet(path)
    return path


def read_elements(spark: SparkSession, path: str, *kinds: str) -> DataFrame:
    """Elements of some kinds (all, if none is named); the others' files are not opened."""
    found = spark.read.parquet(path)
    return found.where(F.col("kind").isin(*kinds)) if kinds else found


def write_report(issues: DataFrame) -> str:
    """Write a building's issues (building_id, kind, ...) as JSON, one object an issue, in a folder of each building; where they are."""
    path = new_path(issues.sparkSession, "report")
    issues.write.partitionBy("building_id").json(path)
    return path
