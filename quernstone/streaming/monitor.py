"""Streams of conversation events: repeated calls and bursts of errors as they happen.

Events arrive out of order and more than once. Both queries run the same over a batch DataFrame, which
is how they are compared with their batch counterparts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone import schema
from quernstone.functions.canonical import signature


def event_stream(spark: SparkSession, path: str, files_a_trigger: int = 16) -> DataFrame:
    """Events from Parquet files as they are added to a directory."""
    return spark.readStream.schema(schema.EVENT).option("maxFilesPerTrigger", files_a_trigger).parquet(path)


def error_windows(events: DataFrame, late: str = "3 days", size: str = "1 hour") -> DataFrame:
    """(window_start, run_id, results, errors): tool results and errors by event time, each event once.

    Repeats are dropped within the watermark, so state ends with it; events later than `late` are left out
    of a stream's windows.
    """
    timed = events.where("role = 'tool'").withColumn("at", F.col("recorded_at").cast("timestamp"))
    if timed.isStreaming:
        timed = timed.withWatermark("at", late).dropDuplicatesWithinWatermark(["event_id"])
    else:
        timed = timed.dropDuplicates(["event_id"])
    counted = timed.groupBy(F.window("at", size).alias("w"), "run_id").agg(F.count("*").alias("results"), F.count_if(F.coalesce("tool_error", F.lit(False))).alias("errors"))
    return counted.select(F.col("w.start").alias("window_start"), "run_id", "results", "errors")


DAY_MS = 24 * 3_600_000
STATE = "signatures array<string>, times array<int>, events array<bigint>, places array<int>"
ALERT = "candidate_id string, event_id bigint, name string, times int"


def _repeats(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """Alert for every call that its conversation has made before with the same arguments."""
    signatures, times, events, places = (list(x) for x in state.get) if state.exists else ([], [], [], [])
    made = dict(zip(signatures, times))
    known = set(zip(events, places))
    rows = pd.concat(list(batches)).sort_values(["msg_index", "event_id", "pos"])
    alerts = []
    for event, at, name, signature in zip(rows["event_id"], rows["pos"], rows["name"], rows["signature"]):
        delivery = int(event), int(at)
        if delivery in known:
            continue
        known.add(delivery)
        made[signature] = made.get(signature, 0) + 1
        if made[signature] > 1:
            alerts.append((key[0], int(event), name, made[signature]))
    state.update((list(made), list(made.values()), [e for e, _ in known], [p for _, p in known]))
    state.setTimeoutTimestamp(state.getCurrentWatermarkMs() + DAY_MS)
    if alerts:
        yield pd.DataFrame(alerts, columns=["candidate_id", "event_id", "name", "times"])


def _guarded(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    yield from _repeats(key, batches, state)


def repeated_calls(events: DataFrame, late: str = "3 days") -> DataFrame:
    """Alerts (candidate_id, event_id, name, times) from a stream: calls repeated with the same arguments.

    The state of a conversation are the digests of the calls it made, with their number, and ends once event time is a day past the watermark
    at its last event; redelivered events are told by their id and don't count.
    """
    timed = events.withColumn("at", F.col("recorded_at").cast("timestamp")).withWatermark("at", late)
    made = timed.select("at", "candidate_id", "event_id", "msg_index", F.posexplode("tool_calls").alias("pos", "c")).select(
        "candidate_id", "event_id", "msg_index", "pos", "at", F.col("c.name").alias("name"), F.sha2(signature(F.col("c.name"), F.col("c.arguments")), 256).alias("signature"))
    return made.groupBy("candidate_id").applyInPandasWithState(_guarded, ALERT, STATE, "append", "EventTimeTimeout")
