"""Schemas of the artifacts that the readers take; nothing is inferred from data."""

from __future__ import annotations

from pyspark.sql import types as T

CALL = T.StructType([T.StructField("id", T.StringType()), T.StructField("name", T.StringType()), T.StructField("arguments", T.StringType())])
MESSAGE = T.StructType([
    T.StructField("role", T.StringType()), T.StructField("content", T.StringType()), T.StructField("id", T.StringType()), T.StructField("tool_call_id", T.StringType()), T.StructField("error", T.BooleanType()),
    T.StructField("tool_calls", T.ArrayType(CALL)),
])
SIMULATION = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("task_id", T.StringType()), T.StructField("trial", T.IntegerType()), T.StructField("seed", T.LongType()), T.StructField("duration", T.DoubleType()),
    T.StructField("termination_reason", T.StringType()), T.StructField("messages", T.ArrayType(MESSAGE)), T.StructField("reward_info", T.StructType([T.StructField("reward", T.DoubleType())])),
])
RESULT = T.StructType([T.StructField("simulations", T.ArrayType(SIMULATION))])
REVIEW = T.StructType([T.StructField(c, T.StringType()) for c in ("task_id", "label", "reviewer_id", "reviewed_at", "rationale", "evidence_files")])
EVENT = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("candidate_id", T.StringType()), T.StructField("run_id", T.StringType()), T.StructField("task_id", T.StringType()), T.StructField("trial", T.IntegerType()),
    T.StructField("msg_index", T.IntegerType()), T.StructField("role", T.StringType()), T.StructField("content", T.StringType()), T.StructField("tool_calls", T.ArrayType(CALL)), T.StructField("tool_call_id", T.StringType()),
    T.StructField("tool_error", T.BooleanType()), T.StructField("source", T.StringType()), T.StructField("recorded_at", T.TimestampNTZType()), T.StructField("ingested_at", T.TimestampNTZType()),
])
