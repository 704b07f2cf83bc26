"""Attribution of failures: findings of rules, their layers and impacts, and verdicts put together from parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def attribute(units: DataFrame, findings: DataFrame, taxonomy: DataFrame, key: str, failed: Column, fallback: str = "UNEXPLAINED") -> DataFrame:
    """(key, codes, layers, impact, quarantined) of the failed units.

    findings (key, code) may repeat; taxonomy (code, layer, impact) is a small table. A failed unit without
    any finding, or with codes the taxonomy lacks, has the fallback layer and is quarantined. impact is the
    greatest of its codes.
    """
    once = findings.select(key, "code").distinct()
    layered = once.join(F.broadcast(taxonomy), "code", "left")  # a row per code of the rules
    per = layered.groupBy(key).agg(
        F.array_sort(F.collect_set("code")).alias("codes"), F.array_sort(F.collect_set(F.coalesce("layer", F.lit(fallback)))).alias("layers"), F.max("impact").alias("impact"), F.bool_or(F.col("layer").isNull()).alias("unknown"))
    out = units.where(failed).select(key).distinct().join(per, key, "left")
    return out.select(
        key, F.array_join(F.coalesce("codes", F.array().cast("array<string>")), ",").alias("codes"), F.array_join(F.coalesce("layers", F.array(F.lit(fallback))), ",").alias("layers"),
        F.coalesce("impact", F.lit(0)).alias("impact"), F.coalesce("unknown", F.lit(True)).alias("quarantined"))


def assertion_verdict(asked: Column, met: Column, share: Column) -> Column:
    """Whether the assertions of a task hold: true if none is asked; as recorded one by one (array of booleans); else a recorded share of 1; else null."""
    every = F.forall(met, lambda m: F.coalesce(m, F.lit(False)))
    return F.when(F.coalesce(asked, F.lit(0)) == 0, F.lit(True)).when(F.size(met) > 0, every).when(share.isNotNull(), share >= 1.0)


def reward(state_matches: Column, assertions_hold: Column) -> Column:
    """1 if the state matches and the assertions hold, else 0; null if it isn't known whether they hold."""
    return F.when(assertions_hold.isNotNull(), (F.coalesce(state_matches, F.lit(False)) & assertions_hold).cast("double"))


def consistent(recorded: Column, rebuilt: Column) -> Column:
    """True where nothing was recorded, or what was is what comes out."""
    return recorded.isNull() | F.coalesce(recorded == rebuilt, F.lit(False))


def changed_span(before: Column, after: Column) -> Column:
    """(start, length) of the part of `after` that `before` lacks: what is left between their common beginning and end. Arrays of tokens."""
    least = F.least(F.size(before), F.size(after))
    at = lambda a, b: F.array_position(F.transform(F.slice(a, 1, least), lambda x, i: x.eqNullSafe(F.get(b, i))), F.lit(False))
    shared = lambda a, b: F.when(least == 0, 0).when(at(a, b) == 0, least).otherwise(at(a, b) - 1)
    head = shared(after, before)
    tail = F.least(shared(F.reverse(after), F.reverse(before)), least - head)
    return F.struct(head.cast("int").alias("start"), (F.size(after) - head - tail).cast("int").alias("length"))
