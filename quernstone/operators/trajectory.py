"""Trajectories: messages, calls and their results as long tables, and per-trajectory measures.

The spine is one row per message (events) and one per tool call (calls). Order is always the explicit
msg_index, with the place of the call in its turn. Every operator here is a plan of joins, windows and
aggregations; windows are partitioned by trajectory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.functions.canonical import signature

# Prefixes of the tools that change state, and of those that only read.
WRITE_PREFIXES = ("cancel_", "modify_", "return_", "exchange_")
READ_PREFIXES = ("get_", "find_", "list_")


def is_write(name: Column) -> Column:
    """True for the name of a tool that changes state."""
    hit = F.lit(False)
    for p in WRITE_PREFIXES:
        hit = hit | name.startswith(p)
    return hit


def tool_type(name: Column) -> Column:
    """write, read or generic, by the name's prefix."""
    read = F.lit(False)
    for p in READ_PREFIXES:
        read = read | name.startswith(p)
    return F.when(is_write(name), "write").when(read, "read").otherwise("generic")


def unique_events(messages: DataFrame) -> DataFrame:
    """Each event_id of a trajectory once: events may be delivered twice with the same payload.

    Rows are brought together by trajectory, once: windows, aggregations and joins by trajectory follow
    without another exchange.
    """
    return messages.repartition("candidate_id").dropDuplicates(["candidate_id", "event_id"])


def calls(events: DataFrame) -> DataFrame:
    """(candidate_id, msg_index, pos, call_id, name, arguments, signature): a row per tool call; signature is the same for all ways of writing the same arguments."""
    return events.select("candidate_id", "msg_index", F.posexplode("tool_calls").alias("pos", "c")).select(
        "candidate_id", "msg_index", "pos", F.col("c.id").alias("call_id"), F.col("c.name").alias("name"), F.col("c.arguments").alias("arguments"),
        signature(F.col("c.name"), F.col("c.arguments")).alias("signature"))


def results(events: DataFrame) -> DataFrame:
    """(candidate_id, call_id, result_index, content, is_error): the last tool message of each call id."""
    rows = events.where("role = 'tool' and tool_call_id is not null and tool_call_id <> ''")
    last = F.max_by(F.struct("content", "tool_error"), "msg_index")
    return rows.groupBy("candidate_id", F.col("tool_call_id").alias("call_id")).agg(F.max("msg_index").alias("result_index"), last.alias("r")).select(
        "candidate_id", "call_id", "result_index", F.col("r.content").alias("content"), F.coalesce("r.tool_error", F.lit(False)).alias("is_error"))


def call_results(events: DataFrame) -> DataFrame:
    """calls with the outcome of each: result_found, result_index, is_error, result."""
    out = calls(events).join(results(events), ["candidate_id", "call_id"], "left")
    return out.select("candidate_id", "msg_index", "pos", "call_id", "name", "arguments", "signature", F.col("result_index").isNotNull().alias("result_found"), "result_index",
                      F.coalesce("is_error", F.lit(False)).alias("is_error"), F.col("content").alias("result"))


def in_order(*keys: str) -> Window:
    return Window.partitionBy(*keys).orderBy("msg_index", "pos")


def runs(call_rows: DataFrame) -> DataFrame:
    """Maximal runs of calls of the same tool: (candidate_id, run, name, n, first_index, last_index)."""
    w = in_order("candidate_id")
    change = F.when(F.col("name").eqNullSafe(F.lag("name").over(w)), 0).otherwise(1)
    marked = call_rows.withColumn("change", change).withColumn("run", F.sum("change").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy("candidate_id", "run", "name").agg(F.count("*").alias("n"), F.min("msg_index").alias("first_index"), F.max("msg_index").alias("last_index"))


def repetition(call_rows: DataFrame) -> DataFrame:
    """Per trajectory: calls, exact duplicates (n - distinct) and adjacent exact repeats."""
    w = in_order("candidate_id")
    repeated = call_rows.withColumn("repeat", F.when(F.col("signature") == F.lag("signature").over(w), 1).otherwise(0))
    return repeated.groupBy("candidate_id").agg(
        F.count("*").alias("calls"), (F.count("*") - F.countDistinct("signature")).alias("duplicates"), F.sum("repeat").alias("adjacent_repeats"))


def previous_user_turn(events: DataFrame) -> DataFrame:
    """Each turn with calls and the index of the nearest user turn before it."""
    w = Window.partitionBy("candidate_id").orderBy("msg_index").rowsBetween(Window.unboundedPreceding, -1)
    user = F.last(F.when(F.col("role") == "user", F.col("msg_index")), ignorenulls=True).over(w)
    return events.select("candidate_id", "msg_index", "role", F.size(F.coalesce("tool_calls", F.array())).alias("calls"), user.alias("user_index")).where("calls > 0").drop("role")


def changed_after_error(rows: DataFrame) -> DataFrame:
    """Failed calls and whether a later call of the trajectory differs from it."""
    later = in_order("candidate_id").rowsBetween(1, Window.unboundedFollowing)
    out = rows.withColumns({"least": F.min("signature").over(later), "most": F.max("signature").over(later)})
    differs = (F.col("least") != F.col("signature")) | (F.col("most") != F.col("signature"))
    return out.where("is_error").select("candidate_id", "msg_index", "pos", "name", F.coalesce(differs, F.lit(False)).alias("changed_later"))


def error_kind(name: Column, result: Column) -> Column:
    """AUTH_LOOKUP_MISS, WRITE_TOOL_ERROR or READ_TOOL_ERROR of a failed call."""
    miss = name.startswith("find_user") & F.lower(F.coalesce(result, F.lit(""))).contains("user not found")
    return F.when(miss, "AUTH_LOOKUP_MISS").when(is_write(name), "WRITE_TOOL_ERROR").otherwise("READ_TOOL_ERROR")


def final_answer(events: DataFrame) -> DataFrame:
    """The last assistant message with content that isn't blank."""
    said = events.where("role = 'assistant'").where(F.length(F.trim("content")) > 0)
    return said.groupBy("candidate_id").agg(F.max("msg_index").alias("msg_index"), F.trim(F.max_by("content", "msg_index")).alias("answer"))


def compact(events: DataFrame) -> DataFrame:
    """One short row per message: event label, role and what the role carries."""
    tools = F.array_join(F.transform(F.coalesce("tool_calls", F.array()), lambda c: c["name"]), ",")
    text = F.when(F.col("role") == "tool", F.coalesce("tool_call_id", F.lit(""))).when(F.size(F.coalesce("tool_calls", F.array())) > 0, tools).otherwise(F.coalesce("content", F.lit("")))
    return events.select("candidate_id", F.format_string("E%03d", "msg_index").alias("label"), "role", text.alias("body"))


def decision_points(events: DataFrame) -> DataFrame:
    """Turns with calls, with the number of messages and of tool results seen before them."""
    w = Window.partitionBy("candidate_id").orderBy("msg_index").rowsBetween(Window.unboundedPreceding, -1)
    out = events.withColumns({"seen": F.count("*").over(w), "seen_results": F.count_if(F.col("role") == "tool").over(w)})
    return out.where(F.size(F.coalesce("tool_calls", F.array())) > 0).select("candidate_id", "msg_index", "seen", "seen_results")


def conversation_window(events: DataFrame, last: int = 6) -> DataFrame:
    """The last `last` user and assistant turns with text of each trajectory."""
    said = events.where(F.col("role").isin("user", "assistant") & (F.length(F.trim("content")) > 0))
    w = Window.partitionBy("candidate_id").orderBy(F.col("msg_index").desc())
    return said.withColumn("back", F.row_number().over(w)).where(F.col("back") <= last).select("candidate_id", "back", "msg_index", "role", F.length("content").alias("chars"))


def open_calls(events: DataFrame) -> DataFrame:
    """Faults of the pairing of calls and results per trajectory: calls without result, results without call, results before their call."""
    made = calls(events).groupBy("candidate_id", "call_id").agg(F.min("msg_index").alias("called"))
    seen = events.where("role = 'tool'").groupBy("candidate_id", F.col("tool_call_id").alias("call_id")).agg(F.min("msg_index").alias("answered"), F.count("*").alias("answers"))
    both = made.join(seen, ["candidate_id", "call_id"], "full_outer")
    return both.groupBy("candidate_id").agg(
        F.count_if(F.col("answered").isNull()).alias("without_result"), F.count_if(F.col("called").isNull()).alias("without_call"),
        F.count_if(F.col("answered") < F.col("called")).alias("too_early"), F.count_if(F.coalesce("answers", F.lit(0)) > 1).alias("answered_twice"))


def adjacent_results(events: DataFrame) -> DataFrame:
    """Single-call turns and whether the next message is the result of their call."""
    w = Window.partitionBy("candidate_id").orderBy("msg_index")
    out = events.withColumns({"next_role": F.lead("role").over(w), "next_call": F.lead("tool_call_id").over(w)})
    one = out.where(F.size(F.coalesce("tool_calls", F.array())) == 1)
    return one.select("candidate_id", "msg_index", F.coalesce((F.col("next_role") == "tool") & (F.col("next_call") == F.col("tool_calls")[0]["id"]), F.lit(False)).alias("adjacent"))


def last_status_before(events: DataFrame) -> DataFrame:
    """As-of join: each call on an order with the status of that order observed last before it.

    A union of observations and calls under one window by order stands for the range join.
    """
    pattern = F.regexp_extract("arguments", r'"order_id": *"(#W[0-9]+)"', 1)
    asked = calls(events).select("candidate_id", "msg_index", "pos", "name", pattern.alias("order_id"), F.lit(None).cast("string").alias("status")).where("order_id <> ''")
    seen = events.where("role = 'tool' and not coalesce(tool_error, false)").select(
        "candidate_id", "msg_index", F.lit(None).cast("int").alias("pos"), F.lit(None).cast("string").alias("name"),
        F.regexp_extract("content", r'"order_id": *"(#W[0-9]+)"', 1).alias("order_id"), F.regexp_extract("content", r'"status": *"([^"]*)"', 1).alias("status")).where("order_id <> '' and status <> ''")
    w = Window.partitionBy("candidate_id", "order_id").orderBy("msg_index").rangeBetween(Window.unboundedPreceding, -1)
    both = asked.unionByName(seen).withColumn("known_status", F.last("status", ignorenulls=True).over(w))
    return both.where("name is not null").select("candidate_id", "msg_index", "pos", "name", "order_id", "known_status")


def card(events: DataFrame) -> DataFrame:
    """One row per trajectory: messages by role, calls by type, errors, repetitions, longest run, final answer.

    A row per call, or one for a message without calls, goes through windows and two aggregations that all
    lie on the trajectory.
    """
    n_calls = F.size(F.coalesce("tool_calls", F.array()))
    rows = events.select(
        "candidate_id", "msg_index", "role", F.coalesce("tool_error", F.lit(False)).alias("error"), n_calls.alias("n_calls"), (F.length(F.trim("content")) > 0).alias("has_text"), F.posexplode_outer("tool_calls").alias("pos", "c"))
    rows = rows.select("candidate_id", "msg_index", "role", "error", "n_calls", "has_text", "pos", (F.coalesce("pos", F.lit(0)) == 0).alias("first"), F.col("c.name").alias("name"),
                       F.when(F.col("pos").isNotNull(), signature(F.col("c.name"), F.col("c.arguments"))).alias("signature"))
    is_call = F.col("pos").isNotNull()
    order = [~is_call, "msg_index", "pos"]  # the calls first, in order
    w = Window.partitionBy("candidate_id").orderBy(*order)
    made = rows.withColumns({"before": F.lag("signature").over(w), "name_before": F.lag("name").over(w), "nth": F.row_number().over(w)})
    change = is_call & (F.col("nth") > 1) & F.col("name").eqNullSafe(F.col("name_before"))
    made = made.withColumn("run", F.sum(F.when(change, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    once = lambda c: F.row_number().over(Window.partitionBy("candidate_id", c).orderBy(*order)) == 1
    made = made.withColumns({"new_signature": is_call & once("signature"), "new_name": is_call & F.col("name").isNotNull() & once("name")})
    count = lambda x: F.count_if(x)
    final = F.max(F.when((F.col("role") == "assistant") & F.col("has_text"), F.col("msg_index")))
    first = F.col("first")
    runs_ = made.groupBy("candidate_id", "run").agg(
        count(first).alias("messages"), count(first & (F.col("role") == "user")).alias("user_turns"), count(first & (F.col("role") == "assistant")).alias("assistant_turns"), count(first & (F.col("role") == "tool")).alias("tool_results"),
        count(first & F.col("error")).alias("tool_errors"), count(first & (F.col("n_calls") > 1)).alias("multi_call_turns"), final.alias("final_answer_index"), count(is_call).alias("calls"), count("new_signature").alias("signatures"),
        count(is_call & (F.col("signature") == F.col("before"))).alias("adjacent_repeats"), count(is_call & is_write(F.col("name"))).alias("write_calls"), count("new_name").alias("distinct_tools"))
    sums = ["messages", "user_turns", "assistant_turns", "tool_results", "tool_errors", "multi_call_turns"]
    return runs_.groupBy("candidate_id").agg(
        *[F.sum(c).alias(c) for c in sums], F.coalesce(F.max("final_answer_index"), F.lit(-1)).alias("final_answer_index"), F.sum("calls").alias("calls"), (F.sum("calls") - F.sum("signatures")).alias("duplicates"),
        F.sum("adjacent_repeats").alias("adjacent_repeats"), F.sum("write_calls").alias("write_calls"), F.sum("distinct_tools").alias("distinct_tools"), F.max("calls").alias("longest_run"))
