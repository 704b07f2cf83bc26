"""Data governance: latest decisions, contracts, leakage of groups, splits and quotas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def clean_label(c: str | Column) -> Column:
    """Upper case without surrounding white space; null for blank."""
    return F.nullif(F.upper(F.regexp_replace(c, r"^\s+|\s+$", "")), F.lit(""))


def latest(rows: DataFrame, key: str, at: str = "decided_at", then: str = "ingested_at", values: list[str] | None = None) -> DataFrame:
    """Of each key the row with the greatest (at, then); partial maxima on the map side. Null keys are left out."""
    values = values or [c for c in rows.columns if c not in (key, at, then)]
    newest = F.max_by(F.struct(*values), F.struct(at, then)).alias("v")
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(newest, F.max(at).alias(at)).select(key, *[F.col(f"v.{v}").alias(v) for v in values], at)


def violations(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(key, reasons): rows that break rules, with the names of these in the order given. A rule that gives null is broken."""
    reasons = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    return rows.select(key, F.array_join(reasons, ",").alias("reasons")).where("reasons <> ''")


def gate(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """The rows if all of them pass, else none: fail closed."""
    bad = violations(rows, key, rules).agg(F.count("*").alias("bad"))
    return rows.join(F.broadcast(bad), F.col("bad") == 0).drop("bad")


def group_entries(rows: DataFrame, key: str, group_col: str) -> DataFrame:
    """Distinct (key, kind, entry) of `kind:value` entries."""
    e = F.regexp_replace("e", r"^\s+|\s+$", "")
    return rows.select(key, F.explode(group_col).alias("e")).select(key, e.alias("entry")).where("entry <> ''").distinct().withColumn("kind", F.split("entry", ":")[0])


def group_leakage(rows: DataFrame, key: str, group_col: str, split: str) -> DataFrame:
    """(entry, kind, splits, members) of the groups that occur in more than one split. A null split doesn't count."""
    entries = group_entries(rows.where(F.col(split).isNotNull()), key, group_col).join(rows.select(key, split), key)
    out = entries.groupBy("entry", "kind").agg(F.array_join(F.array_sort(F.collect_set(split)), ",").alias("splits"), F.count("*").alias("members"))  # as many as there are splits
    return out.where(F.contains("splits", F.lit(",")))


def hash_order(key: str | Column, seed: str) -> Column:
    """Seeded order of keys: the hex SHA-256 of `seed:key`."""
    return F.sha2(F.concat(F.lit(seed + ":"), key), 256)


#: Leading hex digits of the seeded digest that a stratum's rows are first counted by.
BUCKET_DIGITS = 3


def rank_in_stratum(rows: DataFrame, key: str, stratum: str, seed: str) -> DataFrame:
    """rows with `rank`, from 1, in seeded hash order within their stratum, and its `size`.

    Ranks are taken within buckets of the digest and moved by the counts of the buckets before, so that no
    stratum, however large, is sorted in one task.
    """
    hashed = rows.withColumn("hash", hash_order(key, seed)).withColumn("bucket", F.left("hash", F.lit(BUCKET_DIGITS)))
    counts = hashed.groupBy(stratum, "bucket").agg(F.count("*").alias("n"))  # at most 16**BUCKET_DIGITS rows a stratum
    before = Window.partitionBy(stratum).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col(stratum).alias("__s"), F.col("bucket").alias("__b"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"), F.sum("n").over(Window.partitionBy(stratum)).alias("size"))
    placed = hashed.withColumn("rank", F.row_number().over(Window.partitionBy(stratum, "bucket").orderBy("hash", key)))
    joined = placed.join(counts, F.col(stratum).eqNullSafe(F.col("__s")) & (F.col("bucket") == F.col("__b")))
    return joined.withColumn("rank", F.col("rank") + F.col("offset")).drop("hash", "bucket", "offset", "__s", "__b")


def stratified_quota(rows: DataFrame, key: str, stratum: str, take: float, seed: str) -> DataFrame:
    """rows with `picked`: of each stratum the first ceil(take * size) in seeded hash order.

    A larger share's picks hold a smaller one's, so the subsets are nested.
    """
    return rank_in_stratum(rows, key, stratum, seed).withColumn("picked", F.col("rank") <= F.ceil(F.col("size") * take)).drop("rank", "size")


def largest_deficit_quotas(sizes: DataFrame, stratum: str, total: int) -> DataFrame:
    """(stratum, quota) from (stratum, size): `total` places, first one each if they suffice, then always to the largest deficit.

    The deficit is the proportional share less the quota so far; ties go to the stratum with more rows left,
    then to the later name. Each further place lowers a stratum's deficit by one, so the places that are
    given are the greatest of all, and no loop is needed; a stratum's are listed up to its share and one more
    for each stratum.
    """
    summed = sizes.agg(F.sum("size").alias("all"), F.count("*").alias("strata"))  # one row
    wide = sizes.crossJoin(F.broadcast(summed)).withColumns({"ideal": F.lit(total) * F.col("size") / F.col("all"), "start": F.when(F.col("strata") <= total, 1).otherwise(0)})
    last = F.least(F.col("size"), F.ceil("ideal") + F.col("strata"))
    places = wide.where(last > F.col("start")).select(stratum, "size", "ideal", "start", "strata", F.explode(F.sequence(F.col("start"), (last - 1).cast("int"))).alias("given"))
    order = Window.orderBy(F.desc(F.col("ideal") - F.col("given")), F.desc(F.col("size") - F.col("given")), F.desc(stratum))  # over at most total + strata**2 rows
    won = places.withColumn("n", F.row_number().over(order)).where(F.col("n") <= F.lit(total) - F.col("start") * F.col("strata")).groupBy(stratum).agg(F.count("*").alias("more"))
    return wide.join(won, stratum, "left").select(stratum, (F.col("start") + F.coalesce("more", F.lit(0))).alias("quota"))


def largest_deficit_split(rows: DataFrame, key: str, stratum: str, total: int, seed: str) -> DataFrame:
    """rows with `picked`: `total` rows in all, by largest_deficit_quotas and seeded hash order within strata. Null strata are refused places."""
    ranked = rank_in_stratum(rows.where(F.col(stratum).isNotNull()), key, stratum, seed)
    quotas = largest_deficit_quotas(ranked.groupBy(stratum).agg(F.count("*").alias("size")), stratum, total)
    return ranked.join(F.broadcast(quotas), stratum).withColumn("picked", F.col("rank") <= F.col("quota")).drop("rank", "size", "quota")


def partition_report(assigned: DataFrame, everything: DataFrame, key: str, split: str) -> DataFrame:
    """One row: keys in several splits, keys without a split and keys that don't belong."""
    per = assigned.groupBy(key).agg(F.countDistinct(split).alias("splits"))
    both = everything.select(key).distinct().withColumn("known", F.lit(True)).join(per, key, "full_outer")
    return both.agg(
        F.count_if(F.col("splits") > 1).alias("in_several"), F.count_if(F.col("splits").isNull()).alias("without_split"), F.count_if(F.col("known").isNull()).alias("unknown"))


def review_queue(rows: DataFrame) -> DataFrame:
    """(task_id, priority, labels): tasks by disagreement first, then FAIL, REVIEW and PASS, from one label per reviewer."""
    per = rows.groupBy("task_id").agg(F.array_sort(F.collect_set("label")).alias("labels"))  # at most one entry a label
    has = lambda x: F.array_contains("labels", x)
    priority = F.when(F.size("labels") > 1, "P0").when(has("FAIL"), "P1").when(has("REVIEW"), "P2").otherwise("P3")
    return per.select("task_id", priority.alias("priority"), F.array_join("labels", ",").alias("labels"))
