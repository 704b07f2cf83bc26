"""Agreement metrics of verdicts, success rates and variances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(a, b)


def ratio_or_zero(a: Column | str, b: Column | str) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def binary_confusion(rows: DataFrame, gold: Column, predicted: Column) -> DataFrame:
    """One row: tp, fp, fn, tn and accuracy, precision, recall, specificity, f1, each 0 on an empty denominator."""
    counts = rows.agg(
        F.count_if(gold & predicted).alias("tp"), F.count_if(~gold & predicted).alias("fp"), F.count_if(gold & ~predicted).alias("fn"), F.count_if(~gold & ~predicted).alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.select(
        "tp", "fp", "fn", "tn", F.round(ratio_or_zero(tp + tn, tp + fp + fn + tn), 6).alias("accuracy"), F.round(ratio_or_zero(tp, tp + fp), 6).alias("precision"),
        F.round(ratio_or_zero(tp, tp + fn), 6).alias("recall"), F.round(ratio_or_zero(tn, tn + fp), 6).alias("specificity"), F.round(ratio_or_zero(2 * tp, 2 * tp + fp + fn), 6).alias("f1"))


def ternary_matrix(rows: DataFrame, gold: str, predicted: str) -> DataFrame:
    """(gold, PASS, REVIEW, FAIL): counts of predictions by gold label."""
    return rows.groupBy(gold).pivot(predicted, ["PASS", "REVIEW", "FAIL"]).agg(F.count(F.lit(1))).na.fill(0)


def selective(rows: DataFrame, gold: str, predicted: str) -> DataFrame:
    """Metrics of a verifier that may abstain by REVIEW; null on an empty denominator."""
    g, p = F.col(gold), F.col(predicted)
    c = rows.agg(
        F.count("*").alias("rows"), F.count_if((g == "FAIL") & (p == "FAIL")).alias("tp"), F.count_if((g != "FAIL") & (p == "FAIL")).alias("fp"), F.count_if(g == "FAIL").alias("fails"),
        F.count_if(p != "REVIEW").alias("acted"), F.count_if((p != "REVIEW") & (p == g)).alias("acted_right"), F.count_if(g == "REVIEW").alias("reviews"), F.count_if((g == "REVIEW") & (p == "REVIEW")).alias("reviews_found"),
        F.count_if(g == "PASS").alias("passes"), F.count_if((g == "PASS") & (p == "FAIL")).alias("false_fails"), F.count_if((g == "REVIEW") & (p == "PASS")).alias("auto_passed"))
    r = lambda a, b, name: F.round(ratio(a, b), 6).alias(name)
    return c.select(
        "rows", r("tp", F.col("tp") + F.col("fp"), "fail_precision"), r("tp", "fails", "fail_recall"), r(2 * F.col("tp"), F.col("tp") + F.col("fp") + F.col("fails"), "fail_f1"), r("acted", "rows", "coverage"),
        r("acted_right", "acted", "selective_accuracy"), r("reviews_found", "reviews", "review_recall"), r("false_fails", "passes", "false_fail_rate"), r("auto_passed", "reviews", "review_auto_pass"))


def multilabel_micro(gold: DataFrame, predicted: DataFrame, keys: list[str]) -> DataFrame:
    """Micro precision and recall over distinct (unit, label) pairs."""
    a, b = gold.select(*keys).distinct(), predicted.select(*keys).distinct()
    both = a.join(b, keys, "left_semi").agg(F.count("*").alias("common"))
    # three one-row counts side by side
    row = both.join(a.agg(F.count("*").alias("gold")), F.lit(True)).join(b.agg(F.count("*").alias("predicted")), F.lit(True))
    return row.select("common", "gold", "predicted", F.round(ratio("common", "predicted"), 6).alias("precision"), F.round(ratio("common", "gold"), 6).alias("recall"))


def rates_by(rows: DataFrame, group: str, flags: list[str]) -> DataFrame:
    """Means of boolean columns by group and over all rows (group null), in one pass of grouping sets."""
    sets = rows.groupingSets([[F.col(group)], []], F.col(group)).agg(
        F.grouping(group).alias("overall"), F.count("*").alias("n"), *[F.round(F.avg(F.col(f).cast("double")), 6).alias(f"{f}_rate") for f in flags])
    return sets.select(F.when(F.col("overall") == 1, "(all)").otherwise(F.coalesce(F.col(group), F.lit("(none)"))).alias(group), "n", *[f"{f}_rate" for f in flags])


def stability(trials: DataFrame, unit: str, success: str) -> DataFrame:
    """One row: units, those with success in every trial and in any, and the rate over trials; null successes don't count."""
    per = trials.where(F.col(success).isNotNull()).groupBy(unit).agg(F.bool_and(success).alias("every"), F.bool_or(success).alias("any"), F.count("*").alias("n"), F.count_if(success).alias("good"))
    return per.agg(F.count("*").alias("units"), F.count_if("every").alias("stable"), F.count_if("any").alias("any_success"), F.round(F.try_divide(F.sum("good"), F.sum("n")), 6).alias("trial_rate"))


def variance_within(rows: DataFrame, unit: str, value: str) -> DataFrame:
    """One row: population variance of all values, mean variance within units of several rows, and the number of units that vary."""
    overall = rows.agg(F.count("*").alias("rows"), F.round(F.var_pop(value), 6).alias("variance"))
    per = rows.groupBy(unit).agg(F.var_pop(value).alias("v"), F.count("*").alias("n"))
    inside = per.agg(F.count("*").alias("units"), F.count_if((F.col("n") > 1) & (F.col("v") > 0)).alias("varying_units"), F.round(F.avg(F.when(F.col("n") > 1, F.col("v"))), 6).alias("variance_within"))
    return overall.join(inside, F.lit(True))


def without_family(findings: DataFrame, cases: DataFrame, variants: DataFrame, unit: str) -> DataFrame:
    """Leave-one-family-out ablation: per variant, cases still blocked when its family's findings are dropped.

    findings: (unit, family); cases: (unit, risky); variants: (variant, dropped), a small table of
    configurations. A case counts as blocked if any finding of another family remains.
    """
    kept = findings.join(F.broadcast(variants), F.col("family") != F.col("dropped")).select("variant", unit).distinct()
    hits = kept.join(cases, unit).groupBy("variant").agg(F.count_if("risky").alias("tp"), F.count_if(~F.col("risky")).alias("fp"))
    totals = cases.agg(F.count_if("risky").alias("risky_cases"))
    return variants.select("variant").join(hits, "variant", "left").join(totals, F.lit(True)).select(
        "variant", F.coalesce("tp", F.lit(0)).alias("tp"), F.coalesce("fp", F.lit(0)).alias("fp"), (F.col("risky_cases") - F.coalesce("tp", F.lit(0))).alias("missed"))
