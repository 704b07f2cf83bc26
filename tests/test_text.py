from pyspark.sql import functions as F

from quernstone.functions import text


def test_scalars(spark):
    d = spark.createDataFrame([("  Hello\n WORLD  $1,234.50 #w1234567. Second one; third",), (None,), ("",)], "t string")
    rows = d.select(
        text.normalise_space("t"), text.alnum("t"), text.sentences("t"), text.amount("t"), text.occurrences(F.col("t"), "world"), text.excerpt(F.col("t"), 21), text.rule_code("t"),
    ).collect()
    first = rows[0]
    assert first[0] == "hello world $1,234.50 #w1234567. second one; third" and first[3] == 1234.5 and first[4] == 1
    assert first[2] == ["Hello", "WORLD  $1,234.50 #w1234567.", "Second one", "third"]
    assert first[5] == "  Hello" + text.CUT_MARK + "ond one; third" and rows[1][0] is None and rows[2][2] == []


def test_json_objects(spark):
    d = spark.createDataFrame([(' {"a": 1} ', True), ("[1]", False), ('{"a"', False), ("", False), (None, False)], "t string, want boolean")
    assert all(r[0] == r[1] for r in d.select(text.is_json_object("t"), "want").collect())


def test_masks(spark):
    d = spark.createDataFrame([("#W1234567 credit_card_12 usr_3 sk-abcdefghij api_key=xyz",)], "t string")
    row = d.select(text.mask_identifiers("t"), text.redact_secrets("t"), text.order_id(F.lit("w1"))).first()
    assert row[0].startswith("[ORDER] [PAYMENT] [USER]") and "abcdefghij" not in row[1] and "xyz" not in row[1] and row[2] == "#W1"


def test_excerpt_keeps_head_and_tail(spark):
    long = "h" * 5_000 + "t" * 5_000
    row = spark.createDataFrame([(long,)], "t string").select(text.excerpt(F.col("t")), text.excerpt(F.col("t"), 12_000), text.excerpt(F.col("t"), 900)).first()
    assert row[0] == "h" * 1_200 + text.CUT_MARK + "t" * 4_800 and row[1] == long and row[2] == "h" * 300 + text.CUT_MARK + "t" * 600


def test_secrets_end_at_delimiters(spark):
    d = spark.createDataFrame([('{"api_key=abc123,"x":1}',), ("API Key: abc123; next",), ("api-key =abc123}",), ("sk-short api keys are fine",), ("x" * 2_000,)], "t string")
    got = [r[0] for r in d.select(text.redact_secrets("t")).collect()]
    assert got[0] == '{"api_key=<redacted>,"x":1}' and got[1] == "API Key: <redacted>; next" and got[2] == "api-key =<redacted>}" and got[3] == "sk-short api keys are fine" and len(got[4]) == 1_000


def test_failures_by_status_and_words(spark):
    d = spark.createDataFrame([(401, "x"), (429, None), (503, "bad gateway"), (None, "Read timed out"), (None, "API returned no choices (429)"), (402, ""), (404, "gone")], "s int, m string")
    got = [tuple(r[0]) for r in d.select(text.failure_kind(F.col("s"), F.col("m"))).collect()]
    assert got == [("AUTHENTICATION_FAILED", False), ("RATE_LIMITED", True), ("UPSTREAM_SERVER_ERROR", True), ("UPSTREAM_NETWORK_ERROR", True), ("INVALID_RESPONSE", False), ("QUOTA_OR_BALANCE_EXHAUSTED", False), (text.OTHER_FAILURE, False)]


def test_small_scalars(spark):
    d = spark.createDataFrame([("see #W1234567 for $ 1,234.56 and W7654321 too", "2031-01-02T03:04:05Z", "a/../b", "12.5x"), ("none", "2031-01-02T03:04:05", "a/b..c", "7"), (None, None, None, None)], "t string, at string, p string, n string")
    got = d.select(text.segments("t"), text.is_zoned_timestamp("at"), text.escapes("p"), text.number_or("n", 0), text.amount("t"), text.remap("p", {"a/": "z/"}), text.fill(F.lit("{x}-{y}"), {"x": F.col("n")}), text.first_filled(F.lit(" "), F.col("t"))).collect()
    assert got[0][0] == ["#W1234567 for $ 1,234.56 and ", "W7654321 too"] and got[0][1] and got[0][2] and got[0][3] == 0 and got[0][4] == 1234.56 and got[0][5] == "z/../b" and got[0][6] == "12.5x-{y}"
    assert got[1][0] == [] and not got[1][1] and not got[1][2] and got[1][3] == 7 and got[1][4] is None and got[1][7] == "none"
    assert got[2][0] is None and got[2][1] is False and got[2][3] == 0 and got[2][7] is None


def test_literals_with_signs_are_counted(spark):
    row = spark.createDataFrame([(r"a\E b a\E", )], "t string").select(text.occurrences(F.col("t"), r"a\E")).first()
    assert row[0] == 2
