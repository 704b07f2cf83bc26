from pyspark.sql import functions as F

from quernstone.functions import canonical
from quernstone.operators import completions, governance, matching

ROWS = [
    ('{"b": 1, "a": "x\\"y", "z": {"q": [1, {"k": null}], "p": true}}', '{"a":"x\\"y","b":1,"z":{"p":true,"q":[1,{"k":null}]}}'),
    ("[ 1, 2 ]", "[1,2]"), ('"s"', '"s"'), ("not json", None), (None, None), ("", None), ("null", "null"),
]


def test_canonical_json(spark):
    d = spark.createDataFrame(ROWS, "t string, want string")
    assert all(r[0] == r[1] for r in d.select(canonical.canonical("t"), "want").collect())
    same = spark.createDataFrame([('{"a": 1,  "b": [2]}', '{"b":[2],"a":1}')], "x string, y string").select(canonical.digest("x"), canonical.digest("y")).first()
    assert same[0] == same[1] and len(same[0]) == 64


def test_content_and_arguments(spark):
    d = spark.createDataFrame([('["l1", "l2"]',), ('"str"',), ('{"b":1,"a":2}',), (None,), ("null",), ("plain words",)], "t string")
    assert [r[0] for r in d.select(canonical.content_text("t")).collect()] == ["l1\nl2", "str", '{"a":2,"b":1}', "", "", "plain words"]
    d = spark.createDataFrame([('{"b":1,"a":2}',), ('"{\\"k\\": 2, \\"a\\": 1}"',), ("[1]",), ("oops",), (None,), (" ",)], "t string")
    assert [r[0] for r in d.select(canonical.arguments_object("t")).collect()] == ['{"a":2,"b":1}', '{"a":1,"k":2}', '{"_value":[1]}', '{"_raw":"oops"}', "{}", "{}"]


def test_signatures(spark):
    d = spark.createDataFrame([
        ('{"order_id": "#W1", "item_ids": ["2", "1"], "new_item_ids": ["4", "3"]}', '{"new_item_ids":["3","4"],"item_ids":["1","2"],"order_id":"#W1"}', True),
        ('{"item_ids": ["2", "1"], "new_item_ids": ["4", "3"]}', '{"item_ids": ["1", "2"], "new_item_ids": ["4", "3"]}', False),
        ('{"item_ids": ["2", "1"]}', '{"item_ids": ["1", "2"]}', True), ('{"a": 1}', '{"a":1}', True), ("{}", None, True)], "x string, y string, same boolean")
    got = d.select(canonical.loose_signature(F.lit("f"), F.col("x")), canonical.loose_signature(F.lit("f"), F.col("y")), "same").collect()
    assert all((r[0] == r[1]) == r[2] for r in got)


def test_leaves(spark):
    d = spark.createDataFrame([('{"a": {"b": ["x", "y:z", 1.5, true, null]}, "c": "say \\"hi\\": {1}"}',), ("{}",), (None,)], "t string")
    assert [r[0] for r in d.select(canonical.leaves("t")).collect()] == [["x", "y:z", "1.5", "true", "null", 'say "hi": {1}'], [], None]


def test_completions(spark):
    want = '{"tool": "get", "arguments": {"b": 2, "a": 1}}'
    d = spark.createDataFrame([
        (1, '{"arguments":{"a":1,"b":2},"tool":"get"}'), (2, 'Sure: {"tool": "get", "arguments": {"a": 1, "b": 2}} done } {'), (3, '{"tool": "put", "arguments": {}}'),
        (4, '{"tool": "get", "arguments": {}, "more": 1}'), (5, "nothing {broken"), (6, None), (7, "")], "k int, t string")
    d = d.withColumn("x", completions.first_object("t"))
    m = completions.score(F.col("t"), F.col("x"), F.lit(want), ["get"])
    got = {r["k"]: r for r in d.select("k", *[c.alias(n) for n, c in m.items()]).collect()}
    assert got[1]["strict_exact"] and got[1]["well_formed"] and got[2]["exact"] and not got[2]["strict"] and got[2]["extractable"] and not got[2]["well_formed"]
    assert not got[3]["registered"] and not got[3]["tool_match"] and got[4]["tool_match"] and not got[4]["well_formed"]
    assert not any(any(got[k][n] for n in m) for k in (5, 6, 7))


def test_tagged_calls(spark):
    d = spark.createDataFrame([('a <tool_call> {"name": "f", "arguments": {}} </tool_call> b', True), ('<tool_call>{"name": 1, "arguments": {}}</tool_call>', False), ('<tool_call>{"name": "f", "arguments": []}</tool_call>', False), ("<tool_call>{</tool_call>", False), ("none", False), (None, False)], "t string, ok boolean")
    assert all((r[0] is not None) == r[1] for r in d.select(completions.tagged_call("t"), "ok").collect())


def test_largest_deficits_against_a_loop(spark):
    import random

    r = random.Random(4)
    for total in (3, 10, 37):
        sizes = {f"s{k}": r.randrange(1, 40) for k in range(7)}
        quota = {s: 1 if len(sizes) <= total else 0 for s in sizes}
        while sum(quota.values()) < total:
            best = max((s for s in sizes if quota[s] < sizes[s]), key=lambda s: (total * sizes[s] / sum(sizes.values()) - quota[s], sizes[s] - quota[s], s))
            quota[best] += 1
        d = spark.createDataFrame(list(sizes.items()), "s string, size bigint")
        assert {x["s"]: x["quota"] for x in governance.largest_deficit_quotas(d, "s", total).collect()} == quota


def test_ranks_in_strata_are_those_of_one_sort(spark):
    import hashlib

    keys = [(f"k{i}", "ab"[i % 5 == 0]) for i in range(300)] + [("lone", None)]
    got = {x["key"]: (x["rank"], x["size"]) for x in governance.rank_in_stratum(spark.createDataFrame(keys, "key string, s string"), "key", "s", "x").collect()}
    for s in ("a", "b", None):
        mine = sorted((k for k, v in keys if v == s), key=lambda k: hashlib.sha256(f"x:{k}".encode()).hexdigest())
        assert [got[k] for k in mine] == [(i + 1, len(mine)) for i in range(len(mine))]


def test_counts_match_as_numbered_joins_do(spark):
    rows = [("u", s, i, 0) for i, s in enumerate("aabcc")], [("u", s, i, 0) for i, s in enumerate("abbbd")] + [("v", "a", 0, 0)]
    kind = "unit string, signature string, msg_index int, pos int"
    expected, actual = (spark.createDataFrame(r, kind) for r in rows)
    both = expected.withColumn("want", F.lit(True)).unionByName(actual.withColumn("want", F.lit(False)))
    one = sorted(tuple(x[c] for c in ("unit", "expected", "matched", "actual", "excess", "recall")) for x in matching.match_counts(both, "unit", "signature", F.col("want")).collect())
    two = sorted(tuple(x[c] for c in ("unit", "expected", "matched", "actual", "excess", "recall")) for x in matching.match_summary(expected, actual, "unit").collect())
    assert one == two


def test_normalised_completions_and_prefixes(spark):
    d = spark.createDataFrame([('[{"role": "user", "content": "a"}, {"role": "assistant", "content": " b "}]', "b"), (" plain ", "plain"), ('{"tool": 1}', '{"tool": 1}'), ("[]", "[]"), ('[{"role": "x"}]', ""), (None, None)], "t string, want string")
    assert all(r[0] == r[1] for r in d.select(completions.normalised("t"), "want").collect())
    d = spark.createDataFrame([(' {"b": 1, "a": 2} and more\nnext', '{"a":2,"b":1}'), ("broken {\nnext", '{"_raw":"broken {"}'), ("{broken\nnext", '{"_raw":"{broken"}')], "t string, want string")
    assert all(r[0] == r[1] for r in d.select(completions.prefix_arguments("t", completions.first_object("t")), "want").collect())
    d = spark.createDataFrame([("1.0", "PASS"), ("2", "PASS"), ("0.99", "FAIL"), ("x", "NOT_EVALUATED"), (None, "NOT_EVALUATED"), ("NaN", "NOT_EVALUATED")], "t string, want string")
    assert all(r[0] == r[1] for r in d.select(completions.verdict("t"), "want").collect())
