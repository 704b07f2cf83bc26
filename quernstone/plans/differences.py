"""Queries over the differences of replayed states, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.operators import diff
from quernstone.runtime import read


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.diff_states(read(spark, sf_dir, "replay_results"))


def p6_recorded_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The found differences against changed_paths of the older audit: paths it has in excess and paths it lacks."""
    found = p6_found(spark, sf_dir).select("replay_id", "path").withColumn("side", F.lit("found"))
    told = read(spark, sf_dir, "replay_results").select("replay_id", F.explode("changed_paths").alias("path")).where("path is not null").distinct()
    both = found.join(told.withColumn("told", F.lit(True)), ["replay_id", "path"], "full_outer")
    return both.groupBy("replay_id").agg(
        F.count_if(F.col("side").isNotNull() & F.col("told").isNotNull()).alias("agreed"),
        F.count_if(F.col("told").isNull()).alias("not_recorded"),
        F.count_if(F.col("side").isNull()).alias("not_found"),
    )


P6_FOUND = """WITH RECURSIVE
readable AS (SELECT DISTINCT ON (replay_id) replay_id, agent_state::JSON AS a, gold_state::JSON AS g FROM replay_results WHERE json_valid(agent_state) AND json_valid(gold_state) ORDER BY replay_id),
walk AS (
  SELECT replay_id, []::VARCHAR[] AS path, false AS listed, a, g FROM readable
  UNION ALL
  SELECT replay_id, CASE WHEN listed OR kind = 'ARRAY' THEN path ELSE list_append(path, key) END, listed OR kind = 'ARRAY',
    CASE WHEN kind = 'ARRAY' THEN json_extract(a, '$[' || key || ']') ELSE json_extract(a, '$."' || key || '"') END,
    CASE WHEN kind = 'ARRAY' THEN json_extract(g, '$[' || key || ']') ELSE json_extract(g, '$."' || key || '"') END
  FROM (
    SELECT *, json_type(a) AS kind, unnest(CASE json_type(a) WHEN 'OBJECT' THEN list_distinct(list_concat(json_keys(a), json_keys(g)))
      ELSE range(greatest(json_array_length(a), json_array_length(g))::BIGINT)::VARCHAR[] END) AS key
    FROM walk WHERE json_type(a) = json_type(g) AND json_type(a) IN ('OBJECT', 'ARRAY'))),
ends AS (SELECT *, json_type(a) IN ('BIGINT', 'UBIGINT', 'DOUBLE', 'HUGEINT') AND json_type(g) IN ('BIGINT', 'UBIGINT', 'DOUBLE', 'HUGEINT') AS numeric FROM walk)
SELECT DISTINCT replay_id, array_to_string(path, '.') AS path,
  CASE WHEN NOT listed AND a IS NULL THEN 'MISSING_IN_AGENT' WHEN NOT listed AND g IS NULL THEN 'MISSING_IN_GOLD' ELSE 'DIFFERENT' END AS diff_kind
FROM ends
WHERE a IS NULL OR g IS NULL OR (numeric AND a::DOUBLE <> g::DOUBLE)
  OR (NOT numeric AND (json_type(a) <> json_type(g) OR (json_type(a) NOT IN ('OBJECT', 'ARRAY') AND json_extract_string(a, '$') IS DISTINCT FROM json_extract_string(g, '$'))))"""
P6_RECORDED_PATHS = f"""WITH found AS ({P6_FOUND}), told AS (SELECT DISTINCT replay_id, path FROM (SELECT replay_id, unnest(changed_paths) AS path FROM replay_results) WHERE path IS NOT NULL),
f AS (SELECT DISTINCT replay_id, path FROM found)
SELECT replay_id, count(*) FILTER (f.path IS NOT NULL AND told.path IS NOT NULL) AS agreed, count(*) FILTER (told.path IS NULL) AS not_recorded, count(*) FILTER (f.path IS NULL) AS not_found
FROM f FULL JOIN told USING (replay_id, path) GROUP BY replay_id"""


QUERIES = {"p6_found": (p6_found, P6_FOUND), "p6_recorded_paths": (p6_recorded_paths, P6_RECORDED_PATHS)}
