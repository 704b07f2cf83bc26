"""Readers of audit logs: judge calls, prompt audits, and texts that were decoded wrongly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.sources.readers import json_lines

#: Characters of Windows-1252 where Latin-1 has control characters, and these.
WINDOWS = "".join(bytes([b]).decode("windows-1252", "ignore") for b in range(0x80, 0xA0))
CONTROLS = "".join(chr(b) for b in range(0x80, 0xA0) if bytes([b]).decode("windows-1252", "ignore"))

JUDGE = "task_id string, judge string, prompt_tokens bigint, completion_tokens bigint, cost double, verdict string"
PROMPT_AUDIT = "task_id string, seed bigint, model string, passed boolean, check string"


def judge_calls(spark: SparkSession, path: str) -> DataFrame:
    """A row per judge call of JSON-lines logs, with `error` for a line that can't be read: its place is kept, its numbers are null."""
    good, bad = json_lines(spark, path, JUDGE)
    return good.withColumn("error", F.lit(None).cast("string")).unionByName(bad.select("path", F.col("line").alias("error")), allowMissingColumns=True)


def judge_rollup(calls: DataFrame) -> DataFrame:
    """Of each judge: calls, unreadable ones by file, and sums over those that can be read; sums are null where none names a number."""
    return calls.groupBy("path", "judge").agg(
        F.count("*").alias("calls"), F.count("error").alias("errors"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"), F.sum("cost").alias("cost"))


def prompt_audit_index(spark: SparkSession, path: str) -> DataFrame:
    """(task_id, seed, checks, passed, models): of each task and seed whether all checks passed, and the different models in order."""
    rows, _ = json_lines(spark, path, PROMPT_AUDIT)
    return rows.groupBy("task_id", "seed").agg(
        F.count("*").alias("checks"), F.bool_and(F.coalesce("passed", F.lit(False))).alias("passed"), F.array_join(F.array_sort(F.collect_set("model")), ",").alias("models"))  # as many as there are models


def files_as_text(spark: SparkSession, path: str) -> DataFrame:
    """(path, text, encoding): files decoded as UTF-8 if they are, else as Windows-1252; a byte order mark is dropped."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    utf = F.try_validate_utf8(F.col("content").cast("string"))
    text = F.coalesce(utf, F.translate(F.decode("content", "iso-8859-1"), CONTROLS, WINDOWS))
    return raw.select("path", F.regexp_replace(text, "^﻿", "").alias("text"), F.when(utf.isNotNull(), "utf-8").otherwise("windows-1252").alias("encoding"))


def mended(c: str | Column) -> Column:
    """A text whose UTF-8 was read as Windows-1252, put right; texts that don't come from such a reading stay as they are."""
    col = F.col(c) if isinstance(c, str) else c
    latin = F.translate(col, WINDOWS, CONTROLS)
    suspect = F.rlike(latin, F.lit("^[\\x00-\\xff]*$")) & F.rlike(latin, F.lit("[\\xc2-\\xf4][\\x80-\\xbf]"))
    again = F.try_validate_utf8(F.encode(F.when(suspect, latin).otherwise(F.lit("")), "iso-8859-1").cast("string"))
    return F.when(suspect, F.coalesce(again, col)).otherwise(col)


def checked_predictions(rows: DataFrame, labels: list[str], key: str = "task_id", label: str = "label") -> tuple[DataFrame, DataFrame]:
    """Predictions that can be used, and faults (key, fault): labels outside the list, and keys that occur more than once (all of their rows)."""
    known = F.coalesce(F.col(label).isin(labels), F.lit(False))
    counted = rows.join(rows.groupBy(F.col(key).alias("__key")).agg(F.count("*").alias("__n")), F.col(key).eqNullSafe(F.col("__key")), "left")
    fault = F.when(F.col(key).isNull(), "NO_KEY").when(F.col("__n") > 1, "DUPLICATE").when(~known, "UNKNOWN_LABEL")
    marked = counted.withColumn("fault", fault).drop("__key", "__n")
    return marked.where("fault is null").drop("fault"), marked.where("fault is not null").select(key, "fault")


