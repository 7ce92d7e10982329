"""Queries of sources, sinks and file checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import query
from ..sources import documents, files, views
from ..sources.views import with_views

NAV = with_views("v_levels", "v_spaces", "v_transitions")
FILES = with_views("v_files")


def written(spark: SparkSession, d: str) -> DataFrame:
    s = views.spaces(spark, d).select("building_id", "id", "name", F.col("level_id").cast("long").alias("level_id"), "is_exit")
    return documents.to_documents({"levels": views.levels(spark, d).select("building_id", F.col("id").cast("long").alias("id"), "name", "elevation_m"), "spaces": s, "transitions": views.transitions(spark, d)})


def stored(spark: SparkSession, d: str) -> DataFrame:
    """The documents as files, read back; with them a file that is no document."""
    broken = spark.range(1).select(F.lit(-1).cast("long").alias("building_id"), F.lit('{"schema": "concourse.nav/1", "spaces": [').alias("document"))
    docs = written(spark, d).select(F.col("building_id").cast("long").alias("building_id"), "document").unionByName(broken)
    return files.read_documents(spark, files.write_documents(docs)).withColumn("building_id", F.col("building_id").cast("long"))


@query("src1_broken", NAV + "SELECT building_id, false AS broken, count(*) AS n_spaces FROM v_spaces GROUP BY 1 UNION ALL SELECT -1, true, 0")
def src1_broken(spark: SparkSession, d: str) -> DataFrame:
    """A row for each file: the broken one is reported and takes nothing else along."""
    return stored(spark, d).select("building_id", F.col("broken").isNotNull().alias("broken"), F.size("spaces").cast("long").alias("n_spaces"))


@query("src1", NAV + "SELECT building_id, id, name, level_id::BIGINT AS level_id, is_exit FROM v_spaces")
def src1(spark: SparkSession, d: str) -> DataFrame:
    """Spaces of document files that were written from tables and are read by a scan."""
    return documents.table_of(stored(spark, d), "spaces")


@query("src2", NAV + "SELECT building_id, from_id, to_id FROM v_transitions UNION ALL SELECT building_id, to_id, from_id FROM v_transitions WHERE bidirectional")
def src2(spark: SparkSession, d: str) -> DataFrame:
    """Adjacency of documents, exploded in both directions where it holds in both."""
    t = documents.table_of(stored(spark, d), "transitions")
    ways = F.when(F.col("bidirectional"), F.array(F.struct(F.col("from_id").alias("a"), F.col("to_id").alias("b")), F.struct(F.col("to_id").alias("a"), F.col("from_id").alias("b")))).otherwise(F.array(F.struct(F.col("from_id").alias("a"), F.col("to_id").alias("b"))))
    return t.select("building_id", F.explode(ways).alias("w")).select("building_id", F.col("w.a").alias("from_id"), F.col("w.b").alias("to_id"))


@query("snk1", NAV + "SELECT b.building_id, (SELECT count(*) FROM v_levels x WHERE x.building_id = b.building_id) AS n_levels, (SELECT count(*) FROM v_spaces x WHERE x.building_id = b.building_id) AS n_spaces, (SELECT count(*) FROM v_transitions x WHERE x.building_id = b.building_id) AS n_transitions FROM (SELECT DISTINCT building_id FROM v_levels) b")
def snk1(spark: SparkSession, d: str) -> DataFrame:
    """Files of the documents and how long their lists are when they are read again."""
    p = stored(spark, d).where("broken is null")
    return p.select("building_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in ("levels", "spaces", "transitions")])


@query("src3", with_views("v_frames") + "SELECT run_id, frame_no, agent_id, time_s, status FROM v_frames")
def src3(spark: SparkSession, d: str) -> DataFrame:
    """Frames of playback files with their agents."""
    path = files.write_playback(views.frames(spark, d).select("run_id", "frame_no", "agent_id", "status", "time_s"))
    return files.read_playback(spark, path).select("run_id", "frame_no", "agent_id", "time_s", "status")


REQUESTS = "SELECT event_id AS id, value AS speed, user_id % 4 / 2 AS multiplier, CASE event_type WHEN 'view' THEN 'planner' WHEN 'click' THEN 'crowd' WHEN 'signup' THEN 'hybrid' WHEN 'error' THEN 'guess' END AS backend, user_id % 6 AS n FROM events"


@query("src4", f"SELECT id, greatest(speed, 0.05) AS speed, greatest(multiplier, 1.0) AS multiplier, coalesce(backend, 'planner') AS backend, CASE WHEN n = 0 THEN 'no agents' WHEN n = 5 THEN 'count' WHEN backend = 'guess' THEN 'backend' END AS reject FROM ({REQUESTS})")
def src4(spark: SparkSession, d: str) -> DataFrame:
    """Requests of JSON files with clamps, and why some are rejected."""
    e = views.table(spark, d, "events")
    n = F.col("user_id") % 6
    groups = F.when(n == 0, F.array().cast("array<struct<count:bigint>>")).otherwise(F.array(F.struct(F.when(n == 5, 5001).otherwise(n).cast("long").alias("count"))))
    backend = F.expr("case event_type when 'view' then 'planner' when 'click' then 'crowd' when 'signup' then 'hybrid' when 'error' then 'guess' end")
    path = files.new_path(spark, "requests")
    e.select(F.col("event_id").alias("id"), F.col("value").alias("speed"), (F.col("user_id") % 4 / 2).alias("multiplier"), backend.alias("backend"), groups.alias("agents")).write.json(path)
    good, bad = files.read_requests(spark, path)
    asked = e.select(F.col("event_id").alias("id"), F.greatest("value", F.lit(0.05)).alias("speed"), F.greatest(F.col("user_id") % 4 / 2, F.lit(1.0)).alias("multiplier"), F.coalesce(backend, F.lit("planner")).alias("backend"))
    kept = good.select("id", "speed", "multiplier", "backend", F.lit(None).cast("string").alias("reject"))
    return kept.unionByName(bad.withColumnRenamed("reason", "reject").join(asked, "id").select("id", "speed", "multiplier", "backend", "reject"))


def _manifest(spark: SparkSession, d: str) -> str:
    """Cases as a JSON file: toxic ones have an option of their own."""
    path = files.new_path(spark, "manifest")
    own = F.when(F.col("toxic") == 1, F.create_map(F.lit("timeout_s"), F.lit(600)))
    views.results(spark, d).select(F.col("case_id").alias("id"), F.array("tier").alias("tiers"), own.alias("options")).write.json(path)
    return path


@query("src5", with_views("v_results") + "SELECT case_id, CASE WHEN toxic = 1 THEN 600 ELSE 180 END AS timeout_s, 3 AS retries FROM v_results WHERE tier IN ('en', 'fr')")
def src5(spark: SparkSession, d: str) -> DataFrame:
    """Cases of two tiers of a manifest with defaults that their own options overlay."""
    cases, _ = files.read_manifest(spark, _manifest(spark, d), {"timeout_s": 180, "retries": 3}, ["en", "fr"])
    return cases.select(F.col("id").alias("case_id"), F.col("options")["timeout_s"].alias("timeout_s"), F.col("options")["retries"].alias("retries"))


@query("src5_ids", with_views("v_results") + ", asked AS (SELECT doc_id AS id FROM documents WHERE doc_id % 3 = 0) SELECT id, id NOT IN (SELECT case_id FROM v_results) AS missing FROM asked")
def src5_ids(spark: SparkSession, d: str) -> DataFrame:
    """Cases asked for by id, and the ids that the manifest doesn't have."""
    asked = views.table(spark, d, "documents").where("doc_id % 3 = 0").select(F.col("doc_id").alias("id"))
    cases, missing = files.read_manifest(spark, _manifest(spark, d), {"timeout_s": 180}, [], asked)
    return cases.select("id", F.lit(False).alias("missing")).unionByName(missing.select("id", F.lit(True).alias("missing")))


@query("src6", "SELECT source, CAST(sum(strlen(coalesce(text, '')) + 1) AS BIGINT) AS size_bytes FROM documents GROUP BY 1")
def src6(spark: SparkSession, d: str) -> DataFrame:
    """Bytes of the files of each source by their catalogue."""
    path = files.new_path(spark, "texts")
    views.table(spark, d, "documents").select("source", F.coalesce("text", F.lit("")).alias("value")).write.partitionBy("source").text(path)
    return files.catalogue(spark, path).groupBy("source").agg(F.sum("size_bytes").alias("size_bytes"))


@query("src7", "SELECT split_part(p_type, ' ', 1) AS kind, p_partkey AS id, p_name AS name FROM part WHERE split_part(p_type, ' ', 1) IN ('STANDARD', 'SMALL')")
def src7(spark: SparkSession, d: str) -> DataFrame:
    """Raw elements of two kinds, read from a table that is partitioned by kind."""
    raw = views.table(spark, d, "part").select(F.split_part("p_type", F.lit(" "), F.lit(1)).alias("kind"), F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    return files.read_elements(spark, files.write_elements(raw), "STANDARD", "SMALL").select("kind", "id", "name")


@query("snk3", NAV + "SELECT building_id, 'REPORT' AS kind, count(*) AS n_issues FROM v_transitions WHERE from_id % 13 = 0 OR to_id % 13 = 0 GROUP BY 1")
def snk3(spark: SparkSession, d: str) -> DataFrame:
    """Report files, one object an issue, and the counts that a gate reads from them."""
    bad = views.transitions(spark, d).where("from_id % 13 = 0 or to_id % 13 = 0")
    path = files.write_report(bad.select("building_id", F.lit("REPORT").alias("kind"), "from_id", "to_id"))
    report = spark.read.schema("kind string, from_id long, to_id long, building_id long").json(path)
    return report.groupBy("building_id", "kind").agg(F.count("*").alias("n_issues"))


@query("snk4", with_views("v_results") + "SELECT tier, count(*) AS total, count(*) FILTER (WHERE status = 'pass') AS passed, count(*) FILTER (WHERE status = 'fail') AS failed FROM v_results GROUP BY 1")
def snk4(spark: SparkSession, d: str) -> DataFrame:
    return views.results(spark, d).groupBy("tier").agg(F.count("*").alias("total"), F.count_if(F.col("status") == "pass").alias("passed"), F.count_if(F.col("status") == "fail").alias("failed"))


@query("chk1", FILES + "SELECT id, array_to_string(list_filter([CASE WHEN strlen(content) <> size_bytes THEN 'size' END, CASE WHEN sha256(content) <> sha256 THEN 'sha256' END], lambda x: x IS NOT NULL), ',') AS failures, sha1(encode('blob ' || strlen(content)) || '\\x00'::BLOB || encode(content)) AS git_sha1 FROM v_files")
def chk1(spark: SparkSession, d: str) -> DataFrame:
    """Size, SHA-256 and git's blob hash of the bytes of all contents against what is expected of them."""
    f = views.files(spark, d)
    c = F.col("content").cast("binary")
    failures = F.array_compact(F.array(F.when(F.octet_length("content") != F.col("size_bytes"), "size"), F.when(F.sha2(c, 256) != F.col("sha256"), "sha256")))
    blob = F.concat(F.concat(F.lit("blob "), F.octet_length("content").cast("string")).cast("binary"), F.expr("X'00'"), c)
    return f.select("id", F.array_join(failures, ",").alias("failures"), F.sha1(blob).alias("git_sha1"))


@query("chk2", "SELECT page_id AS id, nullif(regexp_extract(substr(html, 1, 524288), '(?i)<html\\s+lang\\s*=\\s*\"([^\"]+)\"', 1), '') AS lang FROM pages")
def chk2(spark: SparkSession, d: str) -> DataFrame:
    """What the head of a file declares; only its first half mebi characters are read."""
    head = F.substring("html", 1, 524288)
    return views.table(spark, d, "pages").select(F.col("page_id").alias("id"), F.nullif(F.regexp_extract(head, r'(?i)<html\s+lang\s*=\s*"([^"]+)"', 1), F.lit("")).alias("lang"))


@query("chk3", "SELECT p_partkey AS id, regexp_replace(upper(p_type), '[^A-Z0-9]', '', 'g') AS kind, regexp_replace(upper(p_type), '[^A-Z0-9]', '', 'g') = 'STANDARDBRASS' AS same FROM part")
def chk3(spark: SparkSession, d: str) -> DataFrame:
    kind = F.regexp_replace(F.upper("p_type"), "[^A-Z0-9]", "")
    return views.table(spark, d, "part").select(F.col("p_partkey").alias("id"), kind.alias("kind"), (kind == "STANDARDBRASS").alias("same"))


@query("chk4", "SELECT doc_id AS id, CASE WHEN strlen(text) = 0 THEN 'empty' WHEN strlen(text) > 20000 THEN 'large' WHEN NOT starts_with(ltrim(text, ' ' || chr(10) || chr(9)), 'T') THEN 'magic' ELSE 'ok' END AS verdict FROM documents")
def chk4(spark: SparkSession, d: str) -> DataFrame:
    """Admission of an upload: not empty, not too large, and the right first letter after white space."""
    n = F.octet_length("text")
    verdict = F.when(n == 0, "empty").when(n > 20000, "large").when(~F.startswith(F.ltrim("text", F.lit(" \n\t")), F.lit("T")), "magic").otherwise("ok")
    return views.table(spark, d, "documents").select(F.col("doc_id").alias("id"), verdict.alias("verdict"))


@query("elm1", with_views("v_levels") + "SELECT building_id, id, coalesce(nullif(name, ''), 'level:' || id) AS name, coalesce(elevation_m, 0) AS elevation_m FROM v_levels")
def elm1(spark: SparkSession, d: str) -> DataFrame:
    return views.levels(spark, d).select("building_id", "id", F.coalesce(F.nullif("name", F.lit("")), F.concat(F.lit("level:"), F.col("id").cast("string"))).alias("name"), F.coalesce("elevation_m", F.lit(0.0)).alias("elevation_m"))


@query("elm2", NAV + "SELECT s.building_id, s.id AS element_id, l.id AS level_id FROM v_spaces s JOIN v_levels l ON l.id = s.level_id AND l.building_id = s.building_id")
def elm2(spark: SparkSession, d: str) -> DataFrame:
    lv = views.levels(spark, d).select("building_id", F.col("id").alias("level_id"))
    return views.spaces(spark, d).select("building_id", F.col("id").alias("element_id"), "level_id").join(lv, ["building_id", "level_id"]).select("building_id", "element_id", "level_id")


@query("elm8", NAV + ", c AS (SELECT building_id, from_id AS id, count(DISTINCT to_id) AS n FROM v_transitions GROUP BY 1, 2) SELECT s.building_id, s.id, coalesce(CASE WHEN s.id % 10 = 0 THEN s.is_exit END, CASE WHEN s.id % 7 = 0 THEN true END, coalesce(n, 0) = 1) AS is_exit FROM v_spaces s LEFT JOIN c USING (building_id, id)")
def elm8(spark: SparkSession, d: str) -> DataFrame:
    """Exit by property, else by an external boundary, else by having exactly one space behind it."""
    n = views.transitions(spark, d).groupBy("building_id", F.col("from_id").alias("id")).agg(F.countDistinct("to_id").alias("n"))
    s = views.spaces(spark, d).join(n, ["building_id", "id"], "left")
    return s.select("building_id", "id", F.coalesce(F.when(F.col("id") % 10 == 0, F.col("is_exit")), F.when(F.col("id") % 7 == 0, True), F.coalesce("n", F.lit(0)) == 1).alias("is_exit"))


@query("elm15", with_views("v_cells") + "SELECT building_id, count(*) AS cells, count(*) FILTER (WHERE terrain = 'stair') AS stairs, count(DISTINCT space_id) AS spaces, min(id) AS first_id FROM v_cells GROUP BY 1")
def elm15(spark: SparkSession, d: str) -> DataFrame:
    return views.cells(spark, d).groupBy("building_id").agg(F.count("*").alias("cells"), F.count_if(F.col("terrain") == "stair").alias("stairs"), F.countDistinct("space_id").alias("spaces"), F.min("id").alias("first_id"))




@query("snk2", with_views("v_frames") + "SELECT run_id, CAST(floor(time_s / 600) AS BIGINT) AS frame_no, count(*) AS n_agents, min(agent_id) AS first_agent FROM v_frames GROUP BY 1, 2")
def snk2(spark: SparkSession, d: str) -> DataFrame:
    """Playback documents, written as JSON with one object a frame, and read back."""
    path = documents.save_playback(views.frames(spark, d).withColumn("frame_no", F.floor(F.col("time_s") / 600)))
    saved = spark.read.schema("run_id string, frame_no long, agents array<struct<agent_id:long,status:string,time_s:double>>").json(path)
    return saved.select("run_id", "frame_no", F.size("agents").cast("long").alias("n_agents"), F.array_min(F.transform("agents", lambda a: a["agent_id"])).alias("first_agent"))
