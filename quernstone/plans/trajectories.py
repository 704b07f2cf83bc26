"""Queries over trajectories and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.functions import text
from quernstone.operators import matching, metrics
from quernstone.operators import trajectory as t
from quernstone.runtime import read

EVENTS = """ev as (select * from (select *, row_number() over (partition by event_id order by ingested_at) as rn from message_events) where rn = 1)"""
CALLS = EVENTS + """, calls as (select candidate_id, msg_index, i - 1 as pos, tool_calls[i].id as call_id, tool_calls[i].name as name, tool_calls[i].arguments as arguments,
  tool_calls[i].name || ':' || case when not json_valid(tool_calls[i].arguments) or json_type(tool_calls[i].arguments) <> 'OBJECT' then 'raw ' || tool_calls[i].arguments
   else array_to_string(['"' || k || '":' || json_extract(tool_calls[i].arguments, '$."' || k || '"') for k in list_sort(json_keys(tool_calls[i].arguments))], ',') end as signature from (select *, unnest(range(1, len(tool_calls) + 1)) as i from ev where len(tool_calls) > 0))"""
IS_WRITE = "(name like 'cancel\\_%' escape '\\' or name like 'modify\\_%' escape '\\' or name like 'return\\_%' escape '\\' or name like 'exchange\\_%' escape '\\')"
IS_READ = "(name like 'get\\_%' escape '\\' or name like 'find\\_%' escape '\\' or name like 'list\\_%' escape '\\')"
RESULTS = CALLS + """, results as (select candidate_id, tool_call_id as call_id, max(msg_index) as result_index, arg_max(struct_pack(content := content, tool_error := tool_error), msg_index) as r
  from ev where role = 'tool' and tool_call_id is not null and tool_call_id <> '' group by all),
 joined as (select c.*, r.result_index is not null as result_found, r.result_index, coalesce(r.r.tool_error, false) as is_error, r.r.content as result from calls c left join results r using (candidate_id, call_id))"""
RUNS = CALLS + """, marked as (select *, case when name is not distinct from lag(name) over (partition by candidate_id order by msg_index, pos) then 0 else 1 end as change from calls),
 numbered as (select *, sum(change) over (partition by candidate_id order by msg_index, pos rows unbounded preceding) as run from marked),
 runs as (select candidate_id, run, name, count(*) as n, min(msg_index) as first_index, max(msg_index) as last_index from numbered group by candidate_id, run, name)"""


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.unique_events(read(spark, sf_dir, "message_events"))


def trajectory_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.card(_events(spark, sf_dir))


TRAJECTORY_CARD = f"""with {RUNS},
 base as (select candidate_id, count(*) as messages, count(*) filter (role = 'user') as user_turns, count(*) filter (role = 'assistant') as assistant_turns, count(*) filter (role = 'tool') as tool_results,
   count(*) filter (coalesce(tool_error, false)) as tool_errors, count(*) filter (len(tool_calls) > 1) as multi_call_turns,
   coalesce(max(case when role = 'assistant' and length(trim(content)) > 0 then msg_index end), -1) as final_answer_index from ev group by candidate_id),
 rep as (select candidate_id, count(*) as calls, count(*) - count(distinct signature) as duplicates, sum(repeat) as adjacent_repeats from
   (select *, case when signature = lag(signature) over (partition by candidate_id order by msg_index, pos) then 1 else 0 end as repeat from calls) group by candidate_id),
 kinds as (select candidate_id, count(*) filter ({IS_WRITE}) as write_calls, count(distinct name) as distinct_tools from calls group by candidate_id),
 longest as (select candidate_id, max(n) as longest_run from runs group by candidate_id)
select candidate_id, messages, user_turns, assistant_turns, tool_results, tool_errors, multi_call_turns, final_answer_index, coalesce(calls, 0) as calls, coalesce(duplicates, 0) as duplicates,
 coalesce(adjacent_repeats, 0)::bigint as adjacent_repeats, coalesce(write_calls, 0) as write_calls, coalesce(distinct_tools, 0) as distinct_tools, coalesce(longest_run, 0) as longest_run
from base left join rep using (candidate_id) left join kinds using (candidate_id) left join longest using (candidate_id)"""


def trajectory_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = t.card(_events(spark, sf_dir))
    return c.agg(
        F.count("*").alias("trajectories"), F.count_if(F.col("tool_errors") == 0).alias("clean"), F.round(F.avg("messages"), 6).alias("avg_messages"), F.max("messages").alias("max_messages"), F.min("messages").alias("min_messages"),
        F.round(F.avg("calls"), 6).alias("avg_calls"), F.max("calls").alias("max_calls"), F.median("calls").alias("median_calls"), F.sum("duplicates").alias("duplicates"))


TRAJECTORY_SUMMARY = f"""select count(*) as trajectories, count(*) filter (tool_errors = 0) as clean, round(avg(messages), 6) as avg_messages, max(messages) as max_messages, min(messages) as min_messages,
 round(avg(calls), 6) as avg_calls, max(calls) as max_calls, median(calls) as median_calls, sum(duplicates)::bigint as duplicates from ({TRAJECTORY_CARD})"""


def tool_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t.call_results(_events(spark, sf_dir))
    return rows.groupBy("name").agg(
        F.first(t.tool_type(F.col("name"))).alias("tool_type"), F.count("*").alias("calls"), F.count_if("result_found").alias("with_result"), F.count_if("is_error").alias("errors"),
        F.round(F.count_if("is_error") / F.count("*"), 6).alias("error_rate"))


TOOL_FREQUENCY = f"""with {RESULTS} select name, case when {IS_WRITE} then 'write' when {IS_READ} then 'read' else 'generic' end as tool_type, count(*) as calls, count(*) filter (result_found) as with_result,
 count(*) filter (is_error) as errors, round(count(*) filter (is_error) / count(*), 6) as error_rate from joined group by name"""


def call_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.call_results(_events(spark, sf_dir)).select("candidate_id", "msg_index", "pos", "call_id", "name", "result_found", "result_index", "is_error", F.length("result").alias("result_chars"))


CALL_RESULTS = f"with {RESULTS} select candidate_id, msg_index, pos, call_id, name, result_found, result_index, is_error, length(result) as result_chars from joined"


def call_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.repetition(t.calls(_events(spark, sf_dir)))


CALL_REPETITION = f"""with {CALLS} select candidate_id, count(*) as calls, count(*) - count(distinct signature) as duplicates, sum(repeat)::bigint as adjacent_repeats from
 (select *, case when signature = lag(signature) over (partition by candidate_id order by msg_index, pos) then 1 else 0 end as repeat from calls) group by candidate_id"""


def consecutive_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.runs(t.calls(_events(spark, sf_dir)))


CONSECUTIVE_GROUPS = f"with {RUNS} select candidate_id, run::bigint as run, name, n, first_index, last_index from runs"


def max_run_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = t.runs(t.calls(_events(spark, sf_dir)))
    return r.groupBy("candidate_id").agg(F.max("n").alias("longest"), F.count("*").alias("runs"))


MAX_RUN_LENGTH = f"with {RUNS} select candidate_id, max(n) as longest, count(*) as runs from runs group by candidate_id"


def previous_user_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.previous_user_turn(_events(spark, sf_dir))


PREVIOUS_USER_TURN = f"""with {EVENTS}, w as (select candidate_id, msg_index, coalesce(len(tool_calls), 0) as calls,
 max(case when role = 'user' then msg_index end) over (partition by candidate_id order by msg_index rows between unbounded preceding and 1 preceding) as user_index from ev)
select candidate_id, msg_index, calls, user_index from w where calls > 0"""


def changed_after_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.changed_after_error(t.call_results(_events(spark, sf_dir)))


CHANGED_AFTER_ERROR = f"""with {RESULTS} select candidate_id, msg_index, pos, name, exists (select 1 from joined b where b.candidate_id = a.candidate_id and (b.msg_index, b.pos) > (a.msg_index, a.pos) and b.signature <> a.signature) as changed_later
from joined a where is_error"""


def error_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t.call_results(_events(spark, sf_dir)).where("is_error")
    return rows.groupBy(t.error_kind(F.col("name"), F.col("result")).alias("kind")).agg(F.count("*").alias("calls"), F.countDistinct("candidate_id").alias("trajectories"))


ERROR_TAXONOMY = f"""with {RESULTS} select case when name like 'find\\_user%' escape '\\' and lower(coalesce(result, '')) like '%user not found%' then 'AUTH_LOOKUP_MISS' when {IS_WRITE} then 'WRITE_TOOL_ERROR' else 'READ_TOOL_ERROR' end as kind,
 count(*) as calls, count(distinct candidate_id) as trajectories from joined where is_error group by 1"""


def final_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.final_answer(_events(spark, sf_dir))


FINAL_ANSWER = f"with {EVENTS} select candidate_id, max(msg_index) as msg_index, trim(arg_max(content, msg_index)) as answer from ev where role = 'assistant' and length(trim(content)) > 0 group by candidate_id"


def compact_trajectory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.compact(_events(spark, sf_dir))


COMPACT_TRAJECTORY = f"""with {EVENTS} select candidate_id, printf('E%03d', msg_index) as label, role, case when role = 'tool' then coalesce(tool_call_id, '') when len(tool_calls) > 0 then array_to_string([c.name for c in tool_calls], ',')
 else coalesce(content, '') end as body from ev"""


def decision_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.decision_points(_events(spark, sf_dir))


DECISION_POINTS = f"""with {EVENTS}, w as (select candidate_id, msg_index, tool_calls, count(*) over p as seen, count(*) filter (role = 'tool') over p as seen_results from ev
 window p as (partition by candidate_id order by msg_index rows between unbounded preceding and 1 preceding)) select candidate_id, msg_index, seen, seen_results from w where len(tool_calls) > 0"""


def conversation_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.conversation_window(_events(spark, sf_dir))


CONVERSATION_WINDOW = f"""with {EVENTS}, said as (select *, row_number() over (partition by candidate_id order by msg_index desc) as back from ev where role in ('user', 'assistant') and length(trim(content)) > 0)
select candidate_id, back, msg_index, role, length(content) as chars from said where back <= 6"""


def open_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.open_calls(_events(spark, sf_dir))


OPEN_CALLS = f"""with {CALLS}, made as (select candidate_id, call_id, min(msg_index) as called from calls group by all), seen as (select candidate_id, tool_call_id as call_id, min(msg_index) as answered, count(*) as answers from ev where role = 'tool' group by all)
select candidate_id, count(*) filter (answered is null) as without_result, count(*) filter (called is null) as without_call, count(*) filter (answered < called) as too_early, count(*) filter (coalesce(answers, 0) > 1) as answered_twice
from made full join seen using (candidate_id, call_id) group by candidate_id"""


def adjacent_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.adjacent_results(_events(spark, sf_dir))


ADJACENT_RESULTS = f"""with {EVENTS}, w as (select *, lead(role) over p as next_role, lead(tool_call_id) over p as next_call from ev window p as (partition by candidate_id order by msg_index))
select candidate_id, msg_index, coalesce(next_role = 'tool' and next_call = tool_calls[1].id, false) as adjacent from w where len(tool_calls) = 1"""


def last_status_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.last_status_before(_events(spark, sf_dir))


LAST_STATUS_BEFORE = f"""with {CALLS}, asked as (select candidate_id, msg_index, pos, name, regexp_extract(arguments, '"order_id": *"(#W[0-9]+)"', 1) as order_id from calls),
 seen as (select candidate_id, msg_index, regexp_extract(content, '"order_id": *"(#W[0-9]+)"', 1) as order_id, regexp_extract(content, '"status": *"([^"]*)"', 1) as status from ev where role = 'tool' and not coalesce(tool_error, false))
select a.candidate_id, a.msg_index, a.pos, a.name, a.order_id, (select arg_max(s.status, s.msg_index) from seen s where s.candidate_id = a.candidate_id and s.order_id = a.order_id and s.msg_index < a.msg_index and s.status <> '') as known_status
from asked a where a.order_id <> ''"""


def loss_mask_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).withColumn("mask", F.when(F.col("role") == "assistant", 1).otherwise(0))
    mixed = (F.size(F.coalesce("tool_calls", F.array())) > 0) & (F.length(F.trim("content")) > 0)
    return e.groupBy("candidate_id").agg(F.sum("mask").alias("trained_messages"), F.sum(F.when(F.col("mask") == 1, F.length(F.coalesce("content", F.lit("")))).otherwise(0)).alias("trained_chars"), F.count_if(mixed).alias("mixed_turns"))


LOSS_MASK_COUNTS = f"""with {EVENTS} select candidate_id, count(*) filter (role = 'assistant') as trained_messages, sum(case when role = 'assistant' then length(coalesce(content, '')) else 0 end)::bigint as trained_chars,
 count(*) filter (len(tool_calls) > 0 and length(trim(content)) > 0) as mixed_turns from ev group by candidate_id"""


def json_strictness(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).where("content is not null").withColumn("is_object", text.is_json_object("content"))
    return e.groupBy("role").agg(F.count("*").alias("texts"), F.count_if("is_object").alias("objects"))


JSON_STRICTNESS = f"""with {EVENTS} select role, count(*) as texts, count(*) filter (json_valid(trim(content)) and left(trim(content), 1) = '{{') as objects from ev where content is not null group by role"""


def observed_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.try_variant_get(F.try_parse_json("content"), "$.status", "string")
    e = _events(spark, sf_dir).where("role = 'tool'").select(v.alias("status"), text.is_json_object("content").alias("is_object"))
    return e.groupBy(F.coalesce("status", F.lit("(none)")).alias("status")).agg(F.count("*").alias("results"), F.count_if("is_object").alias("objects"))


OBSERVED_STATUSES = f"""with {EVENTS}, p as (select case when json_valid(content) then json_extract_string(content, '$.status') end as status, json_valid(trim(content)) and left(trim(content), 1) = '{{' as is_object from ev where role = 'tool')
select coalesce(status, '(none)') as status, count(*) as results, count(*) filter (is_object) as objects from p group by 1"""


def mask_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).where("role = 'assistant' and content is not null").withColumn("masked", text.mask_identifiers("content"))
    return e.where("masked <> content").select("event_id", "masked")


MASK_IDENTIFIERS = f"""with {EVENTS}, m as (select event_id, content, regexp_replace(regexp_replace(regexp_replace(content, '#W[0-9]{{7}}', '[ORDER]', 'g'), '(credit_card|gift_card|paypal)_[0-9]+', '[PAYMENT]', 'g'), 'usr_[0-9]+', '[USER]', 'g') as masked
 from ev where role = 'assistant' and content is not null) select event_id, masked from m where masked <> content"""


def known_identifier_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order ids that the user or a tool gave and the assistant's text repeats, by trajectory."""
    e = _events(spark, sf_dir)
    ids = lambda df: df.select("candidate_id", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit("#W[0-9]{7}"), F.lit(0)))).alias("identifier"))
    known = ids(e.where("role in ('user', 'tool') and content is not null")).distinct()
    said = ids(e.where("role = 'assistant' and content is not null")).groupBy("candidate_id", "identifier").agg(F.count("*").alias("messages"))
    return said.join(known.withColumn("known", F.lit(True)), ["candidate_id", "identifier"], "left").groupBy("candidate_id").agg(
        F.count_if("known").alias("known_ids"), F.count_if(F.col("known").isNull()).alias("other_ids"), F.sum("messages").alias("mentions"))


KNOWN_IDENTIFIER_HITS = f"""with {EVENTS}, known as (select distinct candidate_id, unnest(regexp_extract_all(content, '#W[0-9]{{7}}')) as identifier from ev where role in ('user', 'tool')),
 said as (select candidate_id, identifier, count(*) as messages from (select candidate_id, unnest(list_distinct(regexp_extract_all(content, '#W[0-9]{{7}}'))) as identifier from ev where role = 'assistant') group by all)
select s.candidate_id, count(*) filter (k.identifier is not null) as known_ids, count(*) filter (k.identifier is null) as other_ids, sum(messages)::bigint as mentions
from said s left join known k using (candidate_id, identifier) group by s.candidate_id"""


def delivery_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated and late events by run: deliveries, distinct events, those a day or more late."""
    m = read(spark, sf_dir, "message_events")
    late = F.unix_micros(F.col("ingested_at").cast("timestamp")) - F.unix_micros(F.col("recorded_at").cast("timestamp")) >= 86_400_000_000
    per = m.groupBy("run_id", "event_id").agg(F.count("*").alias("deliveries"), F.min(late).alias("late"))
    return per.groupBy("run_id").agg(F.sum("deliveries").alias("deliveries"), F.count("*").alias("events"), F.count_if("late").alias("late_events"))


DELIVERY_REPORT = """with per as (select run_id, event_id, count(*) as deliveries, bool_and(epoch_us(ingested_at) - epoch_us(recorded_at) >= 86400000000) as late from message_events group by all)
select run_id, sum(deliveries)::bigint as deliveries, count(*) as events, count(*) filter (late) as late_events from per group by run_id"""


def normalised_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").where("text is not null").select(F.sha2(text.alnum("text"), 256).alias("digest"))
    return d.groupBy("digest").agg(F.count("*").alias("copies")).where("copies > 1")


NORMALISED_TEXTS = "select sha256(regexp_replace(lower(text), '[^a-z0-9]+', '', 'g')) as digest, count(*) as copies from documents where text is not null group by 1 having count(*) > 1"


def text_excerpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").where("text is not null").select("doc_id", text.excerpt(F.col("text")).alias("excerpt"))


TEXT_EXCERPT = """select doc_id, case when length(text) <= 6000 then text else left(text, 1200) || chr(10) || '...[MIDDLE TRUNCATED; SOURCE HASH PRESERVED]...' || chr(10) || right(text, 4800) end as excerpt
from documents where text is not null"""


# --- trials of the same task -----------------------------------------------------------------

TRIALS = EVENTS + """, of_candidate as (select candidate_id, min(task_id) as task_id, count(*) filter (coalesce(tool_error, false)) as errors, count(*) filter (len(tool_calls) > 0) as turns, count(*) as messages from ev where task_id is not null group by candidate_id),
 trials as (select *, errors = 0 as success, row_number() over (partition by task_id order by candidate_id) as nth from of_candidate)"""


def _trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    e = _events(spark, sf_dir).where("task_id is not null")
    per = e.groupBy("candidate_id").agg(F.min("task_id").alias("task_id"), F.count_if(F.coalesce("tool_error", F.lit(False))).alias("errors"), F.count_if(F.size(F.coalesce("tool_calls", F.array())) > 0).alias("turns"), F.count("*").alias("messages"))
    return per.withColumns({"success": F.col("errors") == 0, "nth": F.row_number().over(Window.partitionBy("task_id").orderBy("candidate_id"))})


def paired_cohorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    tr = _trials(spark, sf_dir)
    a, b = (tr.where(F.col("nth") == i).select("task_id", F.col("success").alias(f"s{i}"), F.col("turns").alias(f"t{i}")) for i in (1, 2))
    both = a.join(b, "task_id").withColumn("cohort", matching.transition(F.col("s1"), F.col("s2")))
    return both.groupBy("cohort").agg(F.count("*").alias("tasks"), F.round(F.avg(F.col("t2") - F.col("t1")), 6).alias("avg_turn_delta"))


PAIRED_COHORTS = f"""with {TRIALS}, p as (select a.task_id, a.success as s1, b.success as s2, b.turns - a.turns as delta from trials a join trials b using (task_id) where a.nth = 1 and b.nth = 2)
select case when s1 and s2 then 'both_success' when s2 then 'improved' when s1 then 'regressed' else 'both_failure' end as cohort, count(*) as tasks, round(avg(delta), 6) as avg_turn_delta from p group by 1"""


def top_turn_increases(spark: SparkSession, sf_dir: str) -> DataFrame:
    tr = _trials(spark, sf_dir)
    a, b = (tr.where(F.col("nth") == i).select("task_id", F.col("turns").alias(f"t{i}")) for i in (1, 2))
    return a.join(b, "task_id").select("task_id", (F.col("t2") - F.col("t1")).alias("delta")).orderBy(F.desc("delta"), "task_id").limit(5)


TOP_TURN_INCREASES = f"with {TRIALS} select a.task_id, b.turns - a.turns as delta from trials a join trials b using (task_id) where a.nth = 1 and b.nth = 2 order by delta desc, task_id limit 5"


def stable_success(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.stability(_trials(spark, sf_dir), "task_id", "success")


STABLE_SUCCESS = f"""with {TRIALS}, per as (select task_id, bool_and(success) as every, bool_or(success) as any_s, count(*) as n, count(*) filter (success) as good from trials group by task_id)
select count(*) as units, count(*) filter (every) as stable, count(*) filter (any_s) as any_success, round(sum(good) / sum(n), 6) as trial_rate from per"""


def rollout_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.variance_within(_trials(spark, sf_dir), "task_id", "messages")


ROLLOUT_VARIANCE = f"""with {TRIALS}, per as (select task_id, var_pop(messages) as v, count(*) as n from trials group by task_id)
select (select count(*) from trials) as rows, (select round(var_pop(messages), 6) from trials) as variance, count(*) as units, count(*) filter (n > 1 and v > 0) as varying_units, round(avg(case when n > 1 then v end), 6) as variance_within from per"""


def _trial_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of the first two trials of each task; nth tells them apart, the signature is the tool."""
    chosen = _trials(spark, sf_dir).where("nth <= 2").select("candidate_id", "task_id", "nth")
    return t.calls(_events(spark, sf_dir)).join(chosen, "candidate_id").withColumn("signature", F.col("name"))


def action_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tools of a task's first trial as expected actions, those of its second as actual ones."""
    return matching.match_counts(_trial_calls(spark, sf_dir), "task_id", "signature", F.col("nth") == 1)


ACTION_MATCH = f"""with {TRIALS}, {CALLS.removeprefix(EVENTS + ', ')},
 e as (select task_id, name, row_number() over (partition by task_id, name order by msg_index, pos) as k from calls join trials using (candidate_id) where nth = 1),
 a as (select task_id, name, row_number() over (partition by task_id, name order by msg_index, pos) as k from calls join trials using (candidate_id) where nth = 2),
 m as (select e.task_id, count(*) as expected, count(a.k) as matched from e left join a using (task_id, name, k) group by e.task_id),
 x as (select task_id, sum(made)::bigint as actual, sum(greatest(0, made - greatest(1, coalesce(want, 0))))::bigint as excess from (select task_id, name, count(*) as made from a group by all) left join (select task_id, name, count(*) as want from e group by all) using (task_id, name) group by task_id)
select task_id, coalesce(expected, 0) as expected, coalesce(matched, 0) as matched, coalesce(actual, 0) as actual, coalesce(excess, 0) as excess, case when coalesce(expected, 0) > 0 then round(matched / expected, 6) end as recall
from m full join x using (task_id)"""


def replacement_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First trials, replaced by the task's second trial where the first failed."""
    tr = _trials(spark, sf_dir).select("task_id", "candidate_id", "success", "nth")
    first, second = tr.where("nth = 1"), tr.where("nth = 2")
    failed = first.where("not success").select("task_id")
    return matching.overlay(first, second.join(failed, "task_id", "left_semi"), ["task_id"])


REPLACEMENT_OVERLAY = f"""with {TRIALS} select a.task_id, case when not a.success and b.task_id is not null then b.candidate_id else a.candidate_id end as candidate_id, case when not a.success and b.task_id is not null then b.success else a.success end as success,
 case when not a.success and b.task_id is not null then 2 else 1 end as nth from (select * from trials where nth = 1) a left join (select * from trials where nth = 2) b using (task_id)"""


def multilabel_micro(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.multilabel_micro(*[_trial_calls(spark, sf_dir).where(F.col("nth") == n) for n in (1, 2)], ["task_id", "name"])


MULTILABEL_MICRO = f"""with {TRIALS}, {CALLS.removeprefix(EVENTS + ', ')}, g as (select distinct task_id, name from calls join trials using (candidate_id) where nth = 1), p as (select distinct task_id, name from calls join trials using (candidate_id) where nth = 2),
 c as (select (select count(*) from g join p using (task_id, name)) as common, (select count(*) from g) as gold, (select count(*) from p) as predicted) select *, round(common / predicted, 6) as precision, round(common / gold, 6) as recall from c"""


def success_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).groupBy("candidate_id").agg(F.min("source").alias("source"), (F.count_if(F.coalesce("tool_error", F.lit(False))) == 0).alias("clean"), (F.count_if(F.size(F.coalesce("tool_calls", F.array())) > 1) == 0).alias("single_calls"))
    return metrics.rates_by(e, "source", ["clean", "single_calls"])


SUCCESS_BY_SOURCE = f"""with {EVENTS}, per as (select candidate_id, min(source) as source, count(*) filter (coalesce(tool_error, false)) = 0 as clean, count(*) filter (len(tool_calls) > 1) = 0 as single_calls from ev group by candidate_id)
select case when grouping(source) = 1 then '(all)' else coalesce(source, '(none)') end as source, count(*) as n, round(avg(clean::int), 6) as clean_rate, round(avg(single_calls::int), 6) as single_calls_rate from per group by grouping sets ((source), ())"""


def error_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trajectories found by failed calls, with one family of tools left out at a time."""
    rows = t.call_results(_events(spark, sf_dir))
    family = F.split("name", "_")[0]
    findings = rows.where("is_error").select("candidate_id", family.alias("family")).distinct()
    cases = rows.groupBy("candidate_id").agg((F.count_if(F.col("is_error") & t.is_write(F.col("name"))) > 0).alias("risky"))
    variants = spark.createDataFrame([(f"without_{x}", x) for x in ("cancel", "exchange", "find", "get", "modify", "return")] + [("full", "-")], "variant string, dropped string")
    return metrics.without_family(findings, cases, variants, "candidate_id")


ERROR_ABLATION = f"""with {RESULTS}, f as (select distinct candidate_id, split_part(name, '_', 1) as family from joined where is_error), cases as (select candidate_id, count(*) filter (is_error and {IS_WRITE}) > 0 as risky from joined group by candidate_id),
 variants(variant, dropped) as (values ('without_cancel', 'cancel'), ('without_exchange', 'exchange'), ('without_find', 'find'), ('without_get', 'get'), ('without_modify', 'modify'), ('without_return', 'return'), ('full', '-')),
 kept as (select distinct variant, candidate_id from f, variants where family <> dropped), hits as (select variant, count(*) filter (risky) as tp, count(*) filter (not risky) as fp from kept join cases using (candidate_id) group by variant)
select v.variant, coalesce(tp, 0) as tp, coalesce(fp, 0) as fp, (select count(*) filter (risky) from cases) - coalesce(tp, 0) as missed from variants v left join hits h on v.variant = h.variant"""


QUERIES = {f.__name__: (f, globals()[f.__name__.upper()]) for f in (
    trajectory_card, trajectory_summary, tool_frequency, call_results, call_repetition, consecutive_groups, max_run_length, previous_user_turn, changed_after_error, error_taxonomy, final_answer, compact_trajectory,
    decision_points, conversation_window, open_calls, adjacent_results, last_status_before, loss_mask_counts, json_strictness, observed_statuses, mask_identifiers, known_identifier_hits, delivery_report,
    normalised_texts, text_excerpt, paired_cohorts, top_turn_increases, stable_success, rollout_variance, action_match, replacement_overlay, multilabel_micro, success_by_source, error_ablation)}
