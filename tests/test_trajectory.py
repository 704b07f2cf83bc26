from pyspark.sql import functions as F

from quernstone import schema
from quernstone.operators import trajectory as t


def event(i, candidate, index, role, content=None, calls=None, call_id=None, error=None):
    return (i, candidate, "r", "t", 1, index, role, content, calls, call_id, error, "s", None, None)


def frame(spark, rows):
    return spark.createDataFrame(rows, schema.EVENT)


def conversation(spark):
    call = lambda i, name, args="{}": (i, name, args)
    return frame(spark, [
        event(1, "a", 0, "user", "hello"),
        event(2, "a", 1, "assistant", None, [call("c1", "get_order_details", '{"order_id": "#W1"}')]),
        event(3, "a", 2, "tool", '{"order_id": "#W1", "status": "pending"}', None, "c1", False),
        event(4, "a", 3, "assistant", "", [call("c2", "cancel_pending_order", '{"order_id": "#W1"}')]),
        event(5, "a", 4, "tool", "error", None, "c2", True),
        event(6, "a", 5, "assistant", "x", [call("c3", "cancel_pending_order", '{"order_id": "#W1"}'), call("c4", "cancel_pending_order", '{"order_id": "#W2"}')]),
        event(7, "a", 6, "assistant", "  done "),
        event(7, "a", 6, "assistant", "  done "),
        event(8, "b", 0, "user", None),
    ])


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_events_count_once(spark):
    assert t.unique_events(conversation(spark)).count() == 8


def test_card(spark):
    got = {r["candidate_id"]: r.asDict() for r in t.card(t.unique_events(conversation(spark))).collect()}
    assert got["a"]["calls"] == 4 and got["a"]["duplicates"] == 1 and got["a"]["adjacent_repeats"] == 1
    assert got["a"]["longest_run"] == 3 and got["a"]["multi_call_turns"] == 1 and got["a"]["final_answer_index"] == 6
    assert got["b"]["calls"] == 0 and got["b"]["final_answer_index"] == -1


def test_results_last_wins_and_missing(spark):
    e = t.unique_events(conversation(spark)).unionByName(frame(spark, [event(9, "a", 9, "tool", "again", None, "c1", True)]))
    got = {r["call_id"]: r for r in t.call_results(e).collect()}
    assert got["c1"]["result_index"] == 9 and got["c1"]["is_error"]
    assert not got["c4"]["result_found"] and not got["c4"]["is_error"]


def test_changed_after_error(spark):
    got = rows(t.changed_after_error(t.call_results(t.unique_events(conversation(spark)))))
    assert got == [("a", 3, 0, "cancel_pending_order", True)]


def test_status_known_before_a_call(spark):
    got = {(r["msg_index"], r["pos"]): r["known_status"] for r in t.last_status_before(t.unique_events(conversation(spark))).collect()}
    assert got == {(1, 0): None, (3, 0): "pending", (5, 0): "pending", (5, 1): None}


def test_previous_user_and_decision_points(spark):
    e = t.unique_events(conversation(spark))
    assert rows(t.previous_user_turn(e)) == [("a", 1, 1, 0), ("a", 3, 1, 0), ("a", 5, 2, 0)]
    assert rows(t.decision_points(e)) == [("a", 1, 1, 0), ("a", 3, 3, 1), ("a", 5, 5, 2)]


def test_open_calls(spark):
    got = {r["candidate_id"]: r.asDict() for r in t.open_calls(t.unique_events(conversation(spark))).collect()}
    assert got["a"]["without_result"] == 2 and got["a"]["without_call"] == 0


def test_final_answer_is_trimmed(spark):
    assert rows(t.final_answer(t.unique_events(conversation(spark)))) == [("a", 6, "done")]


def test_empty_table(spark):
    empty = frame(spark, [])
    for f in (t.card, t.call_results, t.open_calls, t.final_answer, t.last_status_before, t.previous_user_turn):
        assert f(empty).count() == 0


def test_partitioning_does_not_matter(spark, sf):
    e = t.unique_events(spark.read.parquet(f"{sf}/message_events.parquet"))
    digest = lambda df: df.select(F.sum(F.xxhash64(*sorted(df.columns)).cast("decimal(38,0)"))).first()[0]
    assert digest(t.card(e)) == digest(t.card(e.repartition(7, "content")))
