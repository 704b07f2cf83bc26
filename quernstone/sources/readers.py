"""Readers of trajectory artifacts: result files, JSON lines, logs, debug dumps and reviewers' sheets.

Files are read by Spark's sources with declared schemas; what a file's name tells is taken from the
metadata column. Faults are rows, not exceptions: a line that can't be read comes out with its place.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernstone import schema



def file_path() -> Column:
    """The file that a row was read from."""
    return F.col("_metadata.file_path")


def result_files(spark: SparkSession, root: str, pattern: str = "returned_results.json") -> DataFrame:
    """(path, task_dir, simulation): a row per simulation of every result file below root.

    task_dir is the number in a directory task_N of the path, null if there is none.
    """
    rows = spark.read.schema(schema.RESULT).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).json(root)
    number = F.regexp_extract(file_path(), r"/task_(\d+)/", 1)
    return rows.select(file_path().alias("path"), F.nullif(number, F.lit("")).cast("int").alias("task_dir"), F.posexplode("simulations").alias("position", "simulation"))


def duplicate_tasks(results: DataFrame) -> DataFrame:
    """(task_id, files): tasks that more than one result file holds."""
    return results.groupBy(F.col("simulation.task_id").alias("task_id")).agg(F.countDistinct("path").alias("files")).where("files > 1")


def result_events(results: DataFrame) -> DataFrame:
    """Messages of result files as events: (path, task_id, trial, msg_index, role, content, tool_calls, tool_call_id, tool_error)."""
    rows = results.select("path", F.col("simulation.task_id").alias("task_id"), F.coalesce("simulation.trial", "position").alias("trial"), F.posexplode("simulation.messages").alias("msg_index", "m"))
    call_id = F.when(F.col("m.role") == "tool", F.coalesce("m.tool_call_id", "m.id"))
    return rows.select("path", "task_id", "trial", "msg_index", "m.role", F.coalesce("m.content", F.lit("")).alias("content"), "m.tool_calls", call_id.alias("tool_call_id"), F.coalesce("m.error", F.lit(False)).alias("tool_error"))


def json_lines(spark: SparkSession, path: str, row_schema) -> tuple[DataFrame, DataFrame]:
    """Rows of JSON-lines files, and their faulty lines as (path, line_number, line). Blank lines are skipped, a byte order mark is tolerated.

    A line's number is its place in its block of the file and the lines of the blocks before, so no file
    is read as a whole.
    """
    lines = spark.read.text(path).select(file_path().alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.regexp_replace("value", "^﻿", "").alias("line"))
    marked = lines.where(F.length(F.trim("line")) > 0).withColumn("ok", F.try_parse_json("line").isNotNull())
    good = marked.where("ok").withColumn("row", F.from_json("line", row_schema, {"mode": "PERMISSIVE"})).select("path", "row.*")
    blocks = lines.groupBy("path", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select("path", "block", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    bad = marked.where("not ok").join(offsets, ["path", "block"]).select("path", (F.col("offset") + F.col("at") - F.col("first") + 1).alias("line_number"), "line")
    return good, bad


def predictions(spark: SparkSession, path: str, row_schema) -> DataFrame:
    """Rows of a JSON file that is a list or an object with the list under `results`."""
    v = spark.read.text(path, wholetext=True).select(F.try_parse_json(F.regexp_replace("value", "^﻿", "")).alias("v"))
    text = F.coalesce(F.to_json(F.try_variant_get("v", "$.results", "variant")), F.to_json("v"))
    from pyspark.sql import types as T

    return v.select(F.explode(F.from_json(text, T.ArrayType(row_schema))).alias("r")).select("r.*")


def reviewer_sheet(spark: SparkSession, path: str) -> DataFrame:
    """A reviewer's CSV sheet; evidence_files holds a JSON list, and is null where it doesn't."""
    rows = spark.read.schema(schema.REVIEW).option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).csv(path)
    return rows.withColumn("evidence_files", F.from_json("evidence_files", "array<string>", {"mode": "PERMISSIVE"}))


STEP = r"(?m)^Step (\d+)\.[ \t]*\r?$"


def step_logs(spark: SparkSession, path: str) -> DataFrame:
    """Messages of text logs: (path, step, role, content, tool_error), one per `Step N.` section.

    Roles are the last part of `From role: Role.X` in lower case, agent as assistant and env as tool.
    """
    logs = spark.read.text(path, wholetext=True).select(file_path().alias("path"), "value")
    parts = logs.select("path", F.explode(F.slice(F.split("value", r"(?m)^(?=Step \d+\.)"), 1, 2_000_000_000)).alias("part")).where(F.col("part").rlike(r"^Step \d+\."))
    role = F.lower(F.regexp_extract("part", r"From role: (?:Role\.)?(\w+)", 1))
    role = F.when(role == "agent", "assistant").when(role.isin("env", "environment"), "tool").otherwise(role)
    content = F.regexp_extract("part", r"(?s)content: ?(.*?)(?:\r?\n\r?\nToolCall \(from|\s*\z)", 1)
    return parts.select("path", F.regexp_extract("part", r"^Step (\d+)", 1).cast("int").alias("step"), role.alias("role"), F.trim(content).alias("content"), F.contains("part", F.lit("error=True")).alias("tool_error"))


def logged_calls(spark: SparkSession, path: str) -> DataFrame:
    """Tool calls of text logs: (path, step, position, call_id, name, arguments); arguments null if they aren't JSON."""
    logs = spark.read.text(path, wholetext=True).select(file_path().alias("path"), "value")
    parts = logs.select("path", F.explode(F.split("value", r"(?m)^(?=Step \d+\.)")).alias("part")).where(F.col("part").rlike(r"^Step \d+\."))
    found = F.regexp_extract_all("part", F.lit(r"(?m)^ToolCall \(from \w+\)\s*\nid: (.*)\nname: (.*)\narguments: (.*)$"), F.lit(0))
    rows = parts.select("path", F.regexp_extract("part", r"^Step (\d+)", 1).cast("int").alias("step"), F.posexplode(found).alias("position", "c"))
    one = lambda field: F.trim(F.regexp_extract("c", rf"(?m)^{field}: (.*)$", 1))
    arguments = one("arguments")
    return rows.select("path", "step", "position", one("id").alias("call_id"), one("name").alias("name"), F.when(F.try_parse_json(arguments).isNotNull(), arguments).alias("arguments"))


def debug_dumps(spark: SparkSession, path: str) -> DataFrame:
    """Messages of debug dumps (request.messages with the response as the last one): (path, msg_index, role, content)."""
    kind = "request struct<messages: array<struct<role: string, content: string>>>, response struct<role: string, content: string>"
    rows = spark.read.schema(kind).option("multiLine", True).json(path)
    answer = F.struct(F.coalesce("response.role", F.lit("assistant")).alias("role"), F.col("response.content").alias("content"))
    every = F.concat(F.coalesce("request.messages", F.array().cast("array<struct<role: string, content: string>>")), F.when(F.col("response").isNotNull(), F.array(answer)).otherwise(F.array().cast("array<struct<role: string, content: string>>")))
    return rows.select(file_path().alias("path"), F.posexplode(every).alias("msg_index", "m")).select("path", "msg_index", "m.role", "m.content")


def newest_source(spark: SparkSession, root: str) -> DataFrame:
    """(directory, path, kind): of each directory its newest debug dump, or else its first log."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "modificationTime")
    rows = files.withColumns({"directory": F.regexp_extract("path", r"^(.*)/[^/]*$", 1), "kind": F.when(F.col("path").rlike(r"agent_response[^/]*\.json$"), "debug").when(F.col("path").rlike(r"\.log$"), "log")}).where("kind is not null")
    # a debug dump wins over a log; of dumps the newest, then the greatest path, of logs the first path
    dump, log = F.col("kind") == "debug", F.col("kind") == "log"
    newest = F.max(F.when(dump, F.struct("modificationTime", "path")))["path"]
    return rows.groupBy("directory").agg(F.coalesce(newest, F.min(F.when(log, F.col("path")))).alias("path")).withColumn("kind", F.when(F.endswith("path", F.lit(".json")), "debug").otherwise("log"))


def file_digests(spark: SparkSession, path: str, line_ends: bool = False) -> DataFrame:
    """(path, sha256): upper-case digest of each file's bytes; with line_ends, CR LF count as LF, whatever the encoding."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")
    content = F.col("content")
    if line_ends:
        content = F.unhex(F.replace(F.regexp_replace(F.regexp_replace(F.hex("content"), "(..)", "$1 "), "0D 0A ", "0A "), F.lit(" "), F.lit("")))
    return rows.select("path", F.upper(F.sha2(content, 256)).alias("sha256"))


def directory_digest(spark: SparkSession, path: str) -> DataFrame:
    """(files, sha256): digest of the names and bytes of all files below a folder, in the order of their relative paths.

    The bytes of one folder go through one row: it is meant for checkpoints and evidence folders, not for lakes.
    """
    root = path.rstrip("/")
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")
    relative = F.regexp_replace("path", r"^.*" + re.escape(root.split("//")[-1].rstrip("/")) + "/", "")
    part = F.concat(F.hex(relative), F.lit("00"), F.hex("content"), F.lit("00"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(relative.alias("name"), part.alias("part")))), lambda r: r["part"])
    return rows.agg(F.count("*").alias("files"), F.upper(F.sha2(F.unhex(F.array_join(ordered, "")), 256)).alias("sha256"))
