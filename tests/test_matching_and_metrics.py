from pyspark.sql import functions as F

from quernstone.operators import governance, matching, metrics


def calls(spark, rows):
    return spark.createDataFrame(rows, "unit string, signature string, msg_index int, pos int")


def test_each_expected_action_takes_one(spark):
    want = calls(spark, [("u", "x", 0, 0), ("u", "x", 1, 0), ("u", "y", 2, 0)])
    made = calls(spark, [("u", "x", 5, 0), ("u", "z", 6, 0), ("u", "z", 7, 0)])
    row = matching.match_summary(want, made, "unit").first()
    assert (row["expected"], row["matched"], row["actual"], row["excess"]) == (3, 1, 3, 1)
    assert abs(row["recall"] - 1 / 3) < 1e-5


def test_no_expected_action_has_no_recall(spark):
    row = matching.match_summary(calls(spark, []), calls(spark, [("u", "x", 0, 0)]), "unit").first()
    assert row["recall"] is None and row["expected"] == 0


def test_overlay_and_coverage(spark):
    a = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    b = spark.createDataFrame([(2, "c"), (3, "d"), (None, "e")], "k int, v string")
    assert sorted(r[1] for r in matching.overlay(a, b.where("k is not null"), ["k"]).collect()) == ["a", "c", "d"]
    assert sorted(map(tuple, matching.coverage(a, b, "k").collect())) == [("missing", 1), ("unknown", 3)]


def test_confusion_of_nothing_is_zero(spark):
    row = metrics.binary_confusion(spark.createDataFrame([], "g boolean, p boolean"), F.col("g"), F.col("p")).first()
    assert row["tp"] == 0 and row["precision"] == 0 and row["f1"] == 0


def test_selective_metrics_of_nothing_are_null(spark):
    row = metrics.selective(spark.createDataFrame([("PASS", "PASS")], "g string, p string"), "g", "p").first()
    assert row["fail_precision"] is None and row["coverage"] == 1 and row["false_fail_rate"] == 0


def test_stability_and_variance(spark):
    d = spark.createDataFrame([("a", True, 1), ("a", False, 3), ("b", True, 2), ("c", None, 2)], "u string, s boolean, v int")
    row = metrics.stability(d, "u", "s").first()
    assert (row["units"], row["stable"], row["any_success"]) == (2, 1, 2)
    v = metrics.variance_within(d, "u", "v").first()
    assert v["varying_units"] == 1 and v["variance_within"] == 1.0


def test_rates_hold_the_total(spark):
    d = spark.createDataFrame([("a", True), ("a", False), (None, True)], "g string, f boolean")
    assert {r["g"]: (r["n"], r["f_rate"]) for r in metrics.rates_by(d, "g", ["f"]).collect()} == {"a": (2, 0.5), "(none)": (1, 1.0), "(all)": (3, 0.666667)}


def test_ablation_counts_what_remains(spark):
    findings = spark.createDataFrame([("1", "a"), ("1", "b"), ("2", "a")], "u string, family string")
    cases = spark.createDataFrame([("1", True), ("2", True), ("3", False)], "u string, risky boolean")
    variants = spark.createDataFrame([("full", "-"), ("no_a", "a"), ("no_b", "b")], "variant string, dropped string")
    assert {r["variant"]: (r["tp"], r["missed"]) for r in metrics.without_family(findings, cases, variants, "u").collect()} == {"full": (2, 0), "no_a": (1, 1), "no_b": (2, 0)}


def test_quota_subsets_are_nested(spark):
    d = spark.range(50).select(F.col("id").cast("string").alias("k"), (F.col("id") % 3).cast("string").alias("s"))
    picked = lambda share: {r["k"] for r in governance.stratified_quota(d, "k", "s", share, "7").where("picked").collect()}
    assert picked(0.2) < picked(0.5) < picked(1.0) and len(picked(1.0)) == 50


def test_gate_fails_closed(spark):
    d = spark.createDataFrame([("a", 1), ("b", None)], "k string, v int")
    rules = {"positive": F.col("v") > 0}
    assert [tuple(r) for r in governance.violations(d, "k", rules).collect()] == [("b", "positive")]
    assert governance.gate(d, "k", rules).count() == 0
    assert governance.gate(d.where("v is not null"), "k", rules).count() == 1


def test_group_leakage_ignores_missing_splits(spark):
    d = spark.createDataFrame([("1", ["u:1 ", ""], "TRAIN"), ("2", ["u:1"], "VALIDATION"), ("3", ["u:1", "o:2"], None), ("4", None, "TRAIN")], "t string, g array<string>, s string")
    assert [tuple(r) for r in governance.group_leakage(d, "t", "g", "s").collect()] == [("u:1", "u", "TRAIN,VALIDATION", 2)]
