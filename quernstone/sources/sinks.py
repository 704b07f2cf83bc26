"""Sinks: datasets with a manifest, reports and tables for reviewers."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.sources.readers import file_digests


def write_dataset(rows: DataFrame, path: str, key: str, split: str | None = None) -> dict:
    """Write rows as JSON lines to a new directory and give its manifest: rows, rows by split, digests of the files.

    Fails if the directory exists. The manifest is a few numbers per file, gathered on the driver and
    written beside the data.
    """
    spark = rows.sparkSession
    rows.write.mode("errorifexists").json(path)
    back = spark.read.json(path)
    manifest = {"rows": back.count(), "keys": back.select(key).distinct().count() if back.columns else 0}
    if split:
        manifest["splits"] = {r[split]: r["n"] for r in back.groupBy(split).agg(F.count("*").alias("n")).collect()}
    parts = file_digests(spark, f"{path}/part-*.json").orderBy("path").collect()  # a row per file
    manifest["files"] = {r["path"].rsplit("/", 1)[-1]: r["sha256"] for r in parts}
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.text(f"{path.rstrip('/')}-manifest")
    return manifest


def yes_no(c: str) -> Column:
    """YES, NO, or UNRESOLVED for null."""
    return F.when(F.col(c).isNull(), "UNRESOLVED").when(F.col(c), "YES").otherwise("NO")


def write_table(rows: DataFrame, path: str, columns: list[str], mark: bool = True) -> None:
    """The columns, in order, as CSV with a header; booleans as YES, NO and UNRESOLVED. With mark, files begin with a byte order mark, as spreadsheets want."""
    kinds = dict(rows.dtypes)
    named = lambda i, c: ("\ufeff" if mark and i == 0 else "") + c
    rows.select(*[(yes_no(c) if kinds[c] == "boolean" else F.col(c)).alias(named(i, c)) for i, c in enumerate(columns)]).write.mode("errorifexists").option("header", True).csv(path)


def report(row: DataFrame, title: str) -> str:
    """A one-row summary as a page of Markdown. More rows are refused."""
    found = row.limit(2).collect()
    if len(found) != 1:
        raise ValueError("a report takes one row")
    return "\n".join([f"# {title}", "", *[f"- {k}: {v}" for k, v in found[0].asDict().items()], ""])


def report_json(row: DataFrame, path: str) -> dict:
    """A one-row summary as one JSON object in a new directory, and the object. More rows are refused."""
    found = row.limit(2).collect()
    if len(found) != 1:
        raise ValueError("a report takes one row")
    row.limit(1).coalesce(1).write.mode("errorifexists").json(path)
    return found[0].asDict()


def write_trajectories(events: DataFrame, path: str, key: str = "candidate_id") -> dict:
    """Trajectories as JSON lines, one each with its messages in order; those without any usable message are left out and counted.

    A trajectory is one row; its messages are sorted in it, not on the driver.
    """
    message = F.struct("msg_index", "role", "content", "tool_calls", "tool_call_id", "tool_error")
    usable = F.col("role").isNotNull() & F.col("msg_index").isNotNull()
    per = events.where(F.col(key).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_list(F.when(usable, F.struct("msg_index", "event_id", message.alias("m"))))).alias("rows"))
    per = per.select(key, F.transform("rows", lambda r: r["m"]).alias("messages"))
    per.where(F.size("messages") > 0).write.mode("errorifexists").json(path)
    n = per.agg(F.count_if(F.size("messages") > 0).alias("written"), F.count_if(F.size("messages") == 0).alias("failed")).first()
    return n.asDict()


def check_dataset(spark: SparkSession, path: str) -> DataFrame:
    """(file, fault) of a written dataset against the manifest beside it: MISSING, UNLISTED or CHANGED files; no rows if all is as written."""
    manifest = json.loads(spark.read.text(f"{path.rstrip('/')}-manifest").first()["value"])  # a few numbers per file
    listed = spark.createDataFrame(list(manifest["files"].items()), "file string, listed string")
    found = file_digests(spark, f"{path}/part-*.json").select(F.regexp_extract("path", "([^/]+)$", 1).alias("file"), "sha256")
    fault = F.when(F.col("sha256").isNull(), "MISSING").when(F.col("listed").isNull(), "UNLISTED").when(F.col("sha256") != F.col("listed"), "CHANGED")
    return listed.join(found, "file", "full_outer").select("file", fault.alias("fault")).where("fault is not null")
