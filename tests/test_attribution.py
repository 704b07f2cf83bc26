from pyspark.sql import functions as F

from quernstone.operators import attribution as a


def test_attribution(spark):
    units = spark.createDataFrame([("1", True), ("2", True), ("3", False), ("4", True)], "k string, bad boolean")
    findings = spark.createDataFrame([("1", "X"), ("1", "X"), ("1", "Y"), ("3", "X"), ("4", "Q")], "k string, code string")
    taxonomy = spark.createDataFrame([("X", "L2", 1), ("Y", "L1", 3)], "code string, layer string, impact int")
    got = {r["k"]: tuple(r)[1:] for r in a.attribute(units, findings, taxonomy, "k", F.col("bad")).collect()}
    assert got == {"1": ("X,Y", "L1,L2", 3, False), "2": ("", "UNEXPLAINED", 0, True), "4": ("Q", "UNEXPLAINED", 0, True)}


def test_rewards(spark):
    d = spark.createDataFrame([(0, None, None, None), (2, [True, True], None, 1.0), (2, [True, None], None, 1.0), (1, None, 1.0, None), (1, [], 0.5, 0.0), (1, None, None, 1.0)], "asked int, met array<boolean>, share double, recorded double")
    holds = a.assertion_verdict(F.col("asked"), F.col("met"), F.col("share"))
    rows = d.select(holds, a.reward(F.lit(True), holds), a.consistent(F.col("recorded"), a.reward(F.lit(True), holds)), a.reward(F.lit(None).cast("boolean"), holds)).collect()
    assert [r[0] for r in rows] == [True, True, False, True, False, None]
    assert [r[1] for r in rows] == [1.0, 1.0, 0.0, 1.0, 0.0, None] and [r[2] for r in rows] == [True, True, False, True, True, False] and rows[0][3] == 0.0


def test_changed_span(spark):
    cases = [("a b c", "a x c", 1, 1), ("a b", "a b", 2, 0), ("", "a", 0, 1), ("a a", "a a a", 2, 1), ("a b c d", "a d", 1, 0), ("x", "y z", 0, 2), ("q a", "a", 0, 0)]
    d = spark.createDataFrame([(p.split(), q.split(), s, n) for p, q, s, n in cases], "p array<string>, q array<string>, s int, n int")
    assert all((r[0]["start"], r[0]["length"]) == (r[1], r[2]) for r in d.select(a.changed_span(F.col("p"), F.col("q")), "s", "n").collect())
