import pytest

from quernstone.operators import diff


def states(spark, rows):
    return spark.createDataFrame(rows, "replay_id string, agent_state string, gold_state string, path string, diff_kind string")


def found(spark, rows):
    return sorted(tuple(r) for r in diff.diff_states(states(spark, [(*r, "clash", "clash") for r in rows])).collect())


@pytest.mark.parametrize("agent,gold,want", [
    ('{"a": 1.50}', '{"a":1.5}', []),
    ('{"a": 100}', '{"a": 1e2}', []),
    ('{"a": 0.0}', '{"a": -0}', []),
    ('{"a": 1}', '{"a": "1"}', [("a", "DIFFERENT")]),
    ('{"a": true}', '{"a": 1}', [("a", "DIFFERENT")]),
    ('{"a": null}', '{}', [("a", "MISSING_IN_GOLD")]),
    ('{}', '{"a": {"b": 1}}', [("a", "MISSING_IN_AGENT")]),
    ('{"a": {"b": 1, "c": 2}}', '{"a": {"c": 3}}', [("a.b", "MISSING_IN_GOLD"), ("a.c", "DIFFERENT")]),
    ('{"a": {"b": 1}}', '{"a": [1]}', [("a", "DIFFERENT")]),
    ('{"a": {}}', '{"a": {"b": null}}', [("a.b", "MISSING_IN_AGENT")]),
    ('{"a": [1, 2]}', '{"a": [2, 1]}', [("a", "DIFFERENT")]),
    ('{"a": [{"x": 1, "y": 2.0}]}', '{"a": [{"y": 2, "x": 1}]}', []),
    ('{"na\\u00efve": "\\u00e9"}', '{"naïve": "é"}', []),
    ('{"a": 12345678901234567890}', '{"a": 12345678901234567891}', [("a", "DIFFERENT")]),
    ('{"a": 1, "a": 2}', '{"a": 2}', []),
    ('{"a.b": 1}', '{"a": {"b": 1}}', [("a", "MISSING_IN_AGENT"), ("a.b", "MISSING_IN_GOLD")]),
    ('{"a": 1', '{"a": 2}', []),
    ('{"a": NaN}', '{"a": 2}', [("a", "DIFFERENT")]), ('{"a": NaN, "b": -Infinity}', '{"b": -Infinity, "a": NaN}', []),
    ('', '{"a": 2}', []),
    (None, '{"a": 2}', []),
    ('[1]', '[1]', []),
])
def test_states(spark, agent, gold, want):
    assert found(spark, [("r", agent, gold)]) == [("r", *w) for w in want]


def test_repeated_rows_and_null_ids(spark):
    row = ("r", '{"a": 1}', '{"a": 2}')
    assert found(spark, [row] * 300 + [(None, *row[1:])]) == [("r", "a", "DIFFERENT")]


def test_deep_and_long_states(spark):
    deep = '{"a": ' * 500 + "1" + "}" * 500
    assert found(spark, [("r", deep, deep.replace("1", "2")), ("s", '{"x": "%s"}' % ("y" * 200_000), '{"x": ""}')]) == [("r", ".".join("a" * 500), "DIFFERENT"), ("s", "x", "DIFFERENT")]


def test_empty(spark):
    assert found(spark, []) == []


def tables(spark, left, right, keys=("k",)):
    kind = "k string, v double, l array<int>"
    return [tuple(r) for r in diff.diff_tables(spark.createDataFrame(left, kind), spark.createDataFrame(right, kind), list(keys)).collect()]


def test_tables(spark):
    got = tables(spark, [("a", 1.0, [1]), ("b", None, None), ("c", 2.0, [2]), ("d", 1.0, [1])], [("a", 1.0, [1]), ("b", 3.0, None), ("d", 1.0, [1, 2]), ("e", 0.0, [])])
    assert sorted(got, key=str) == sorted([("b", "v", "DIFFERENT", None, "3.0"), ("c", None, "ONLY_LEFT", None, None), ("d", "l", "DIFFERENT", "[1]", "[1,2]"), ("e", None, "ONLY_RIGHT", None, None)], key=str)


def test_tables_with_repeats_and_null_keys(spark):
    got = tables(spark, [("a", 1.0, None)] * 3 + [(None, 1.0, None)], [("a", 1.0, None), ("a", 2.0, None), (None, 1.0, None)])
    assert sorted(got, key=str) == sorted([("a", "v", "DIFFERENT", "1.0", "2.0"), ("a", None, "ONLY_LEFT", None, None)], key=str)


def test_tables_of_nothing(spark):
    assert tables(spark, [], []) == []
    assert tables(spark, [("a", 1.0, None)], []) == [("a", None, "ONLY_LEFT", None, None)]


def test_canonical_numbers():
    from decimal import Decimal

    assert diff.canonical(Decimal("12.50")) == diff.canonical(Decimal("12.5")) == diff.canonical(Decimal("1.25e1"))
    assert diff.canonical(10**30) == diff.canonical(Decimal("1E+30")) != diff.canonical(10**30 + 1)
