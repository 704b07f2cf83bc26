"""Matching of expected and actual actions, paired runs and overlays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def one_to_one(expected: DataFrame, actual: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """expected with `matched`: each expected action takes the first unused equal actual one.

    For equality the greedy matching pairs the k-th occurrence with the k-th, so an equi-join on the keys
    and the number of the occurrence does it, without a loop.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    left = expected.withColumn("occurrence", F.row_number().over(w))
    right = actual.withColumn("occurrence", F.row_number().over(w)).select(*keys, "occurrence", F.lit(True).alias("matched"))
    return left.join(right, [*keys, "occurrence"], "left").withColumn("matched", F.coalesce("matched", F.lit(False)))


def match_summary(expected: DataFrame, actual: DataFrame, unit: str) -> DataFrame:
    """Per unit: expected, matched and unmatched actions, excess repeats over what was expected, recall (null if none expected)."""
    matched = one_to_one(expected, actual, [unit, "signature"], ["msg_index", "pos"])
    recall = matched.groupBy(unit).agg(F.count("*").alias("expected"), F.count_if("matched").alias("matched"))
    want = expected.groupBy(unit, "signature").agg(F.count("*").alias("want"))
    made = actual.groupBy(unit, "signature").agg(F.count("*").alias("made"))
    excess = made.join(want, [unit, "signature"], "left").groupBy(unit).agg(F.sum("made").alias("actual"), F.sum(F.greatest(F.lit(0), F.col("made") - F.greatest(F.lit(1), F.coalesce("want", F.lit(0))))).alias("excess"))
    both = recall.join(excess, unit, "full_outer")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("expected", "matched", "actual", "excess")}
    return both.withColumns(zero).withColumn("recall", F.round(F.try_divide("matched", "expected"), 6))


def match_counts(rows: DataFrame, unit: str, signature: str, expected: Column) -> DataFrame:
    """match_summary of expected and actual actions that stand in one table: counts per signature do, in one pass.

    Of equal actions as many match as both sides have.
    """
    per = rows.where(F.col(signature).isNotNull()).groupBy(unit, signature).agg(F.count_if(expected).alias("want"), F.count_if(~expected).alias("made"))
    excess = F.when(F.col("made") > 0, F.greatest(F.lit(0), F.col("made") - F.greatest(F.lit(1), F.col("want")))).otherwise(0)
    out = per.groupBy(unit).agg(F.sum("want").alias("expected"), F.sum(F.least("want", "made")).alias("matched"), F.sum("made").alias("actual"), F.sum(excess).alias("excess"))
    return out.withColumn("recall", F.round(F.try_divide("matched", "expected"), 6))


def transition(before: Column, after: Column) -> Column:
    """both_success, improved, regressed or both_failure."""
    return F.when(before & after, "both_success").when(~before & after, "improved").when(before & ~after, "regressed").otherwise("both_failure")


def overlay(base: DataFrame, replacement: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of base, those of the replacement instead where it has their key."""
    return base.join(replacement.select(*keys).distinct(), keys, "left_anti").unionByName(replacement)


def coverage(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(side, key): keys that only one side has. Null keys are left out."""
    a, b = (d.select(key).where(F.col(key).isNotNull()).distinct() for d in (left, right))
    return a.join(b, key, "left_anti").select(F.lit("missing").alias("side"), key).unionByName(b.join(a, key, "left_anti").select(F.lit("unknown").alias("side"), key))
