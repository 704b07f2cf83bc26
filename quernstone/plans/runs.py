"""Queries over runs, actions and completions, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernstone.functions import canonical, text
from quernstone.operators import completions
from quernstone.operators import trajectory as t
from quernstone.plans.trajectories import CALLS, EVENTS, IS_READ, IS_WRITE, RESULTS, TRAJECTORY_CARD, TRIALS, _events, _trials
from quernstone.runtime import read

TRIAL_CALLS = f"{TRIALS}, {CALLS.removeprefix(EVENTS + ', ')}"


def run_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each run: trajectories by status, rates over those with an outcome, calls, mean duration."""
    e = _events(spark, sf_dir)
    seconds = (F.unix_micros(F.max("recorded_at").cast("timestamp")) - F.unix_micros(F.min("recorded_at").cast("timestamp"))) / 1e6
    per = e.groupBy("candidate_id").agg(
        F.min("run_id").alias("run_id"), F.count_if(F.col("role") == "tool").alias("results"), F.count_if(F.coalesce("tool_error", F.lit(False))).alias("errors"),
        F.sum(F.size(F.coalesce("tool_calls", F.array()))).alias("calls"), seconds.alias("seconds"))
    status = F.when(F.col("results") == 0, "NO_OUTCOME").when(F.col("errors") > 0, "FAILED").otherwise("COMPLETED")
    per = per.withColumn("status", status)
    valid = F.count_if(F.col("status") != "NO_OUTCOME")
    return per.groupBy("run_id").agg(
        F.count("*").alias("trajectories"), F.count_if(F.col("status") == "COMPLETED").alias("completed"), F.count_if(F.col("status") == "FAILED").alias("failed"), F.count_if(F.col("status") == "NO_OUTCOME").alias("no_outcome"),
        F.round(F.try_divide(F.count_if(F.col("status") == "COMPLETED"), valid), 6).alias("success_rate"), F.sum("calls").alias("calls"), F.sum("errors").alias("errors"), F.round(F.avg("seconds"), 3).alias("mean_seconds"))


RUN_AGGREGATE = f"""with {EVENTS}, per as (select candidate_id, min(run_id) as run_id, count(*) filter (role = 'tool') as results, count(*) filter (coalesce(tool_error, false)) as errors, sum(coalesce(len(tool_calls), 0)) as calls,
  (epoch_us(max(recorded_at)) - epoch_us(min(recorded_at))) / 1e6 as seconds from ev group by candidate_id),
 s as (select *, case when results = 0 then 'NO_OUTCOME' when errors > 0 then 'FAILED' else 'COMPLETED' end as status from per)
select run_id, count(*) as trajectories, count(*) filter (status = 'COMPLETED') as completed, count(*) filter (status = 'FAILED') as failed, count(*) filter (status = 'NO_OUTCOME') as no_outcome,
 round(count(*) filter (status = 'COMPLETED') / nullif(count(*) filter (status <> 'NO_OUTCOME'), 0), 6) as success_rate, sum(calls)::bigint as calls, sum(errors)::bigint as errors, round(avg(seconds), 3) as mean_seconds from s group by run_id"""


def action_pass_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls that were answered without an error, over all and by type of tool."""
    rows = t.call_results(_events(spark, sf_dir)).select(t.tool_type(F.col("name")).alias("tool_type"), (F.col("result_found") & ~F.col("is_error")).alias("passed"))
    sets = rows.cube("tool_type").agg(F.grouping("tool_type").alias("all"), F.count("*").alias("total"), F.count_if("passed").alias("passed"))
    return sets.select(F.when(F.col("all") == 1, "(all)").otherwise(F.col("tool_type")).alias("tool_type"), "total", "passed", F.round(F.col("passed") / F.col("total"), 6).alias("pass_rate"))


ACTION_PASS_STATS = f"""with {RESULTS}, k as (select case when {IS_WRITE} then 'write' when {IS_READ} then 'read' else 'generic' end as tool_type, result_found and not is_error as passed from joined)
select case when grouping(tool_type) = 1 then '(all)' else tool_type end as tool_type, count(*) as total, count(*) filter (passed) as passed, round(count(*) filter (passed) / count(*), 6) as pass_rate from k group by grouping sets ((tool_type), ())"""


def projected_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean messages, calls and errors of a trajectory by source, projected to twenty."""
    e = _events(spark, sf_dir).groupBy("candidate_id").agg(F.min("source").alias("source"), F.count("*").alias("messages"), F.sum(F.size(F.coalesce("tool_calls", F.array()))).alias("calls"))
    return e.groupBy(F.coalesce("source", F.lit("(none)")).alias("source")).agg(F.count("*").alias("n"), F.round(F.avg("messages") * 20, 4).alias("messages_of_20"), F.round(F.avg("calls") * 20, 4).alias("calls_of_20"))


PROJECTED_COST = f"""with {EVENTS}, per as (select candidate_id, min(source) as source, count(*) as messages, sum(coalesce(len(tool_calls), 0)) as calls from ev group by candidate_id)
select coalesce(source, '(none)') as source, count(*) as n, round(avg(messages) * 20, 4) as messages_of_20, round(avg(calls) * 20, 4) as calls_of_20 from per group by 1"""


def failure_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trajectories with a failed write (gold) against those whose kind of failure a verifier tells from the last result."""
    rows = t.call_results(_events(spark, sf_dir)).where("result_found")
    last = F.max_by(F.struct("is_error", "name", "result"), F.struct("result_index", "pos")).alias("l")
    per = rows.groupBy("candidate_id").agg(F.bool_or(F.col("is_error") & t.is_write(F.col("name"))).alias("gold"), last)
    kind = F.when(F.col("l.is_error"), t.error_kind(F.col("l.name"), F.col("l.result"))).otherwise("none")
    c = per.select("gold", (kind != "none").alias("found")).agg(
        F.count_if(F.expr("gold and found")).alias("tp"), F.count_if(F.expr("not gold and found")).alias("fp"), F.count_if(F.expr("gold and not found")).alias("fn"), F.count_if(F.expr("not gold and not found")).alias("tn"))
    return c.select("*", F.round(F.try_divide("tp", F.col("tp") + F.col("fp")), 6).alias("precision"), F.round(F.try_divide("tp", F.col("tp") + F.col("fn")), 6).alias("recall"))


FAILURE_DETECTION = f"""with {RESULTS}, l as (select candidate_id, bool_or(is_error and {IS_WRITE}) as gold, arg_max(is_error, (result_index, pos)) as found from joined where result_found group by candidate_id),
 c as (select count(*) filter (gold and found) as tp, count(*) filter (not gold and found) as fp, count(*) filter (gold and not found) as fn, count(*) filter (not gold and not found) as tn from l)
select *, round(tp / nullif(tp + fp, 0), 6) as precision, round(tp / nullif(tp + fn, 0), 6) as recall from c"""


def dominant_tool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each trajectory the tool called most, the first in the alphabet of equals, and its share of the calls."""
    per = t.calls(_events(spark, sf_dir)).groupBy("candidate_id", "name").agg(F.count("*").alias("n"))
    return per.groupBy("candidate_id").agg(F.min_by("name", F.struct(-F.col("n"), F.col("name"))).alias("tool"), F.max("n").alias("n"), F.round(F.max("n") / F.sum("n"), 6).alias("share"))


DOMINANT_TOOL = f"""with {CALLS}, per as (select candidate_id, name, count(*) as n from calls group by all)
select candidate_id, arg_min(name, (-n, name)) as tool, max(n) as n, round(max(n) / sum(n), 6) as share from per group by candidate_id"""


def tools_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The different tools of each trajectory in the order of their first calls; a list as long as there are tools."""
    first = t.calls(_events(spark, sf_dir)).groupBy("candidate_id", "name").agg(F.min(F.struct("msg_index", "pos")).alias("at"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("at", "name"))), lambda x: x["name"])
    return first.groupBy("candidate_id").agg(F.array_join(listed, ",").alias("tools"), F.count("*").alias("n"))


TOOLS_IN_ORDER = f"""with {CALLS}, f as (select candidate_id, name, min((msg_index, pos)) as first_at from calls group by all)
select candidate_id, string_agg(name, ',' order by first_at) as tools, count(*) as n from f group by candidate_id"""


def error_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings (trajectory, code, message) once each, however many calls of a message they concern."""
    rows = t.call_results(_events(spark, sf_dir)).where("is_error")
    return rows.select("candidate_id", t.error_kind(F.col("name"), F.col("result")).alias("code"), "msg_index").dropDuplicates().groupBy("candidate_id", "code").agg(F.count("*").alias("messages"), F.min("msg_index").alias("first_index"))


ERROR_FINDINGS = f"""with {RESULTS}, f as (select distinct candidate_id, case when name like 'find\\_user%' escape '\\' and lower(coalesce(result, '')) like '%user not found%' then 'AUTH_LOOKUP_MISS' when {IS_WRITE} then 'WRITE_TOOL_ERROR' else 'READ_TOOL_ERROR' end as code, msg_index
 from joined where is_error) select candidate_id, code, count(*) as messages, min(msg_index) as first_index from f group by all"""


# The roles that may stand before each role.
BEFORE = {"system": ["(start)"], "user": ["(start)", "system", "assistant", "tool"], "assistant": ["(start)", "system", "user", "tool"], "tool": ["assistant", "tool"]}


def role_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns that stand behind a role they can't follow, per pair of roles."""
    w = Window.partitionBy("candidate_id").orderBy("msg_index", "event_id")
    rows = _events(spark, sf_dir).select("candidate_id", "role", F.coalesce(F.lag("role").over(w), F.lit("(start)")).alias("before"))
    allowed = F.lit(False)
    for role, befores in BEFORE.items():
        allowed = allowed | ((F.col("role") == role) & F.col("before").isin(*befores))
    return rows.where(~allowed).groupBy("before", "role").agg(F.count("*").alias("turns"), F.countDistinct("candidate_id").alias("trajectories"))


ROLE_GRAMMAR = f"""with {EVENTS}, r as (select candidate_id, role, coalesce(lag(role) over (partition by candidate_id order by msg_index, event_id), '(start)') as before from ev),
 allowed(role, before) as (values {', '.join(f"('{r}', '{b}')" for r, bs in BEFORE.items() for b in bs)})
select before, role, count(*) as turns, count(distinct candidate_id) as trajectories from r anti join allowed using (role, before) group by all"""


def stop_position(spark: SparkSession, sf_dir: str, marker: str = "anything else") -> DataFrame:
    """Trajectories with a closing marker: its first message, and whether that is the last one."""
    e = _events(spark, sf_dir)
    hit = F.contains(F.lower("content"), F.lit(marker))
    per = e.groupBy("candidate_id").agg(F.min(F.when(hit, F.col("msg_index"))).alias("stop_index"), F.max("msg_index").alias("last_index"))
    return per.where("stop_index is not null").select("candidate_id", "stop_index", (F.col("stop_index") == F.col("last_index")).alias("is_last"))


STOP_POSITION = f"""with {EVENTS} select candidate_id, min(msg_index) filter (contains(lower(content), 'anything else')) as stop_index, min(msg_index) filter (contains(lower(content), 'anything else')) = max(msg_index) as is_last
 from ev group by candidate_id having stop_index is not null"""


def message_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages by kind, told from role and source by words in this order: user, agent, tool, others."""
    who = F.lower(F.concat_ws(" ", "role", "source"))
    kind = F.when(F.contains(who, F.lit("user")), "USER").when(F.contains(who, F.lit("assistant")) | F.contains(who, F.lit("agent")), "AGENT").when(F.contains(who, F.lit("tool")), "TOOL").otherwise("MESSAGE")
    body = text.first_filled(F.col("content"), F.col("tool_call_id"))
    return _events(spark, sf_dir).groupBy(kind.alias("kind")).agg(F.count("*").alias("messages"), F.count(body).alias("with_body"), F.count_if(F.coalesce("tool_error", F.lit(False))).alias("errors"))


MESSAGE_KINDS = f"""with {EVENTS}, k as (select *, lower(concat_ws(' ', role, source)) as who from ev)
select case when contains(who, 'user') then 'USER' when contains(who, 'assistant') or contains(who, 'agent') then 'AGENT' when contains(who, 'tool') then 'TOOL' else 'MESSAGE' end as kind, count(*) as messages,
 count(*) filter (length(trim(coalesce(content, ''))) > 0 or length(trim(coalesce(tool_call_id, ''))) > 0) as with_body, count(*) filter (coalesce(tool_error, false)) as errors from k group by 1"""


def positional_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results under the id of the last call before them, against the id they carry."""
    w = Window.partitionBy("candidate_id").orderBy("msg_index", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.size("tool_calls") > 0, F.element_at("tool_calls", -1)["id"]), ignorenulls=True).over(w)
    rows = _events(spark, sf_dir).withColumn("by_place", last).where("role = 'tool'")
    return rows.groupBy("candidate_id").agg(F.count("*").alias("results"), F.count_if(F.col("by_place") == F.col("tool_call_id")).alias("agree"), F.count_if(F.col("by_place").isNull()).alias("without_call"))


POSITIONAL_RESULTS = f"""with {EVENTS}, w as (select *, last_value(case when len(tool_calls) > 0 then tool_calls[-1].id end ignore nulls) over (partition by candidate_id order by msg_index, event_id rows between unbounded preceding and 1 preceding) as by_place from ev)
select candidate_id, count(*) as results, count(*) filter (by_place = tool_call_id) as agree, count(*) filter (by_place is null) as without_call from w where role = 'tool' group by candidate_id"""


def serial_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trajectories with one call a turn: each call and its result as messages of their own, numbered anew; narration beside calls is left out."""
    rows = t.call_results(_events(spark, sf_dir)).select("candidate_id", "msg_index", "pos", "call_id", "name", "result_found")
    steps = rows.select("candidate_id", "msg_index", "pos", "call_id", "name", F.explode(F.when(F.col("result_found"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("part"))
    w = Window.partitionBy("candidate_id").orderBy("msg_index", "pos", "part")
    return steps.select("candidate_id", (F.row_number().over(w) - 1).alias("step"), F.when(F.col("part") == 0, "assistant").otherwise("tool").alias("role"), "call_id", "name")


SERIAL_TURNS = f"""with {RESULTS}, s as (select candidate_id, msg_index, pos, call_id, name, unnest(case when result_found then [0, 1] else [0] end) as part from joined)
select candidate_id, row_number() over (partition by candidate_id order by msg_index, pos, part) - 1 as step, case when part = 0 then 'assistant' else 'tool' end as role, call_id, name from s"""


def call_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of calls with canonical arguments, and how often each is made in how many writings."""
    c = t.calls(_events(spark, sf_dir)).select("name", F.sha2(canonical.arguments_object("arguments"), 256).alias("digest"), "arguments")
    return c.groupBy("name", "digest").agg(F.count("*").alias("calls"), F.countDistinct("arguments").alias("writings"))


CALL_SIGNATURES = f"""with {CALLS}, s as (select name, arguments, '{{' || array_to_string(['"' || k || '":' || json_extract(arguments, '$."' || k || '"') for k in list_sort(json_keys(arguments))], ',') || '}}' as canon from calls where json_valid(arguments))
select name, sha256(canon) as digest, count(*) as calls, count(distinct arguments) as writings from s group by all"""


def item_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls with items that are the same but for the items' order, per tool."""
    c = t.calls(_events(spark, sf_dir)).withColumn("loose", canonical.loose_signature(F.col("name"), F.col("arguments")))
    c = c.where(F.try_variant_get(F.try_parse_json("arguments"), "$.item_ids", "array<string>").isNotNull())
    return c.groupBy("name").agg(F.count("*").alias("calls"), F.countDistinct("loose").alias("kinds"), F.countDistinct("signature").alias("signatures"))


ITEM_SIGNATURES = f"""with {CALLS}, i as (select name, signature, json_extract_string(arguments, '$.item_ids[*]') as old_ids, json_extract_string(arguments, '$.new_item_ids[*]') as new_ids, arguments from calls where json_type(arguments, '$.item_ids') = 'ARRAY'),
 l as (select name, signature, array_to_string(['"' || k || '":' || json_extract(arguments, '$."' || k || '"') for k in list_sort(json_keys(arguments)) if k not in ('item_ids', 'new_item_ids')], ',') || ':' ||
  case when len(new_ids) = len(old_ids) and len(new_ids) > 0 then array_to_string(list_sort([a || '>' || b for a, b in list_zip(old_ids, new_ids)]), ',') else array_to_string(list_sort(old_ids), ',') || '|' || coalesce(array_to_string(new_ids, ','), '') end as loose from i)
select name, count(*) as calls, count(distinct loose) as kinds, count(distinct signature) as signatures from l group by name"""


def referenced_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that a trajectory's calls and texts refer to: text values of arguments, and order ids anywhere."""
    e = _events(spark, sf_dir)
    values = t.calls(e).select("candidate_id", F.explode(canonical.leaves("arguments")).alias("value"))
    ids = e.where("content is not null").select("candidate_id", F.explode(F.regexp_extract_all("content", F.lit("#W[0-9]{7}"), F.lit(0))).alias("value"))
    return values.unionByName(ids).distinct().groupBy("candidate_id").agg(F.count("*").alias("n"), F.count_if(F.startswith("value", F.lit("#W"))).alias("orders"))


REFERENCED_VALUES = f"""with {CALLS}, v as (select candidate_id, unnest(case when json_type(arguments, '$."' || k || '"') = 'ARRAY' then json_extract(arguments, '$."' || k || '"')::varchar[] else [json_extract_string(arguments, '$."' || k || '"')] end) as value
  from (select candidate_id, arguments, unnest(json_keys(arguments)) as k from calls where json_valid(arguments))
  union select candidate_id, unnest(regexp_extract_all(content, '#W[0-9]{{7}}')) from ev)
select candidate_id, count(*) as n, count(*) filter (value like '#W%') as orders from v group by candidate_id"""


def transcript_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of what user and tools said, in order, per trajectory: equal where two transcripts observed the same."""
    e = _events(spark, sf_dir).where(F.col("role").isin("user", "tool"))
    line = F.concat_ws("|", "role", F.coalesce("content", F.lit("")), F.coalesce("tool_call_id", F.lit("")), F.coalesce("tool_error", F.lit(False)).cast("string"))
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("msg_index", "event_id", F.sha2(line, 256).alias("d")))), lambda x: x["d"]), "")
    return e.groupBy("candidate_id").agg(F.sha2(ordered, 256).alias("digest"), F.count("*").alias("messages"))


TRANSCRIPT_DIGEST = f"""with {EVENTS}, l as (select candidate_id, msg_index, event_id, sha256(concat_ws('|', role, coalesce(content, ''), coalesce(tool_call_id, ''), coalesce(tool_error, false)::varchar)) as d from ev where role in ('user', 'tool'))
select candidate_id, sha256(string_agg(d, '' order by msg_index, event_id)) as digest, count(*) as messages from l group by candidate_id"""


def result_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of the users' and assistants' texts from one order id to the next, and the amounts in them."""
    e = _events(spark, sf_dir).where("role in ('user', 'assistant') and content is not null")
    parts = e.select(F.explode(text.segments("content")).alias("part")).withColumn("amount", text.amount("part"))
    return parts.groupBy(F.regexp_extract("part", "^#?(W[0-9]{7})", 1).alias("order_id")).agg(F.count("*").alias("parts"), F.count("amount").alias("with_amount"), F.round(F.max("amount"), 2).alias("largest"))


RESULT_SEGMENTS = f"""with {EVENTS}, p as (select unnest(regexp_extract_all(content, '#?W[0-9]{{7}}(?:[^#W]|#[^W]|W[^0-9]|#?W[0-9]{{1,6}}[^0-9])*')) as part from ev where role in ('user', 'assistant') and content is not null),
 a as (select regexp_extract(part, '^#?(W[0-9]{{7}})', 1) as order_id, try_cast(replace(regexp_extract(part, '\\$\\s*([0-9][0-9,]*(?:\\.\\d{{2}})?)', 1), ',', '') as double) as amount from p)
select order_id, count(*) as parts, count(amount) as with_amount, round(max(amount), 2) as largest from a group by order_id"""


def secrets_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts whose redaction of keys changes them or cuts them, by role."""
    e = _events(spark, sf_dir).where("content is not null").withColumn("clean", text.redact_secrets("content"))
    return e.groupBy("role").agg(F.count("*").alias("texts"), F.count_if(F.col("clean") != F.col("content")).alias("changed"), F.max(F.length("clean")).alias("longest"))


SECRETS_REDACTED = f"""with {EVENTS}, c as (select role, content, left(regexp_replace(regexp_replace(content, 'sk-[A-Za-z0-9_-]{{8,}}', 'sk-<redacted>', 'g'), '(?i)(api[_ -]?key\\s*[:=]\\s*)[^\\s,;}}]+', '\\1<redacted>', 'g'), 1000) as clean from ev where content is not null)
select role, count(*) as texts, count(*) filter (clean <> content) as changed, max(length(clean)) as longest from c group by role"""


def error_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed results by the kind of failure their text tells."""
    e = _events(spark, sf_dir).where("role = 'tool' and coalesce(tool_error, false)").select(text.failure_kind(F.lit(None).cast("int"), F.col("content")).alias("k"))
    return e.groupBy("k.kind", "k.retryable").agg(F.count("*").alias("results"))


ERROR_CATEGORIES = f"""with {EVENTS}, k as (select lower(coalesce(content, '')) as m from ev where role = 'tool' and coalesce(tool_error, false))
select case when m like '%empty response%' or m like '%returned no choices%' then 'INVALID_RESPONSE' when m like '%authentication%' or m like '%unauthorized%' or m like '%invalid api key%' then 'AUTHENTICATION_FAILED'
 when m like '%insufficient balance%' or m like '%insufficient quota%' or m like '%payment required%' then 'QUOTA_OR_BALANCE_EXHAUSTED' when m like '%rate limit%' or m like '%ratelimit%' then 'RATE_LIMITED'
 when m like '%timeout%' or m like '%timed out%' or m like '%connection%' or m like '%temporarily unavailable%' then 'UPSTREAM_NETWORK_ERROR' else 'UPSTREAM_REQUEST_FAILED' end as kind, kind in ('RATE_LIMITED', 'UPSTREAM_NETWORK_ERROR') as retryable, count(*) as results from k group by all"""


TOOLS = ["cancel_pending_order", "exchange_delivered_order_items", "get_order_details", "get_user_details", "modify_pending_order_items", "return_delivered_order_items", "find_user_id_by_email", "list_all_product_types"]


def _completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The k-th call of a task's second trial as a completion, with what was said before it, and that of the first as what was expected."""
    rows = t.calls(_events(spark, sf_dir)).join(_trials(spark, sf_dir).where("nth <= 2").select("candidate_id", "task_id", "nth"), "candidate_id")
    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy("task_id", "nth").orderBy("msg_index", "pos")))
    action = F.concat(F.lit('{"tool": "'), "name", F.lit('", "arguments": '), F.coalesce("arguments", F.lit("{}")), F.lit("}"))
    said = F.when(F.col("k") % 3 == 0, F.concat(F.lit("I will do this: "), action, F.lit(" as asked."))).otherwise(action)
    both = rows.groupBy("task_id", "k").agg(F.max(F.when(F.col("nth") == 1, action)).alias("expected"), F.max(F.when(F.col("nth") == 2, said)).alias("completion"))
    return both.where("expected is not null and completion is not null")


def completion_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of completions, of the first call of a task and of later ones."""
    rows = _completions(spark, sf_dir).withColumn("extracted", completions.first_object("completion"))
    measures = completions.score(F.col("completion"), F.col("extracted"), F.col("expected"), TOOLS)
    return rows.select(F.when(F.col("k") == 1, "first").otherwise("later").alias("place"), *[m.alias(n) for n, m in measures.items()]).groupBy("place").agg(
        F.count("*").alias("n"), *[F.round(F.avg(F.col(n).cast("int")), 6).alias(n) for n in measures])


_COMPLETIONS = f"""with {TRIAL_CALLS}, r as (select task_id, nth, name, arguments, row_number() over (partition by task_id, nth order by msg_index, pos) as k from calls join trials using (candidate_id) where nth <= 2),
 p as (select a.task_id, a.k, a.name as want_tool, a.arguments as want, b.name as tool, b.arguments as args, b.k % 3 <> 0 as strict from r a join r b on a.task_id = b.task_id and a.k = b.k and a.nth = 1 and b.nth = 2),
 q as (select *, array_to_string(['"' || k || '":' || json_extract(args, '$."' || k || '"') for k in list_sort(json_keys(args))], ',') = array_to_string(['"' || k || '":' || json_extract(want, '$."' || k || '"') for k in list_sort(json_keys(want))], ',') as same,
  tool in ({', '.join(f"'{x}'" for x in TOOLS)}) as registered from p)"""
COMPLETION_SCORES = f"""{_COMPLETIONS} select case when k = 1 then 'first' else 'later' end as place, count(*) as n, 1.0::double as extractable, round(avg(strict::int), 6) as strict, round(avg((strict and registered)::int), 6) as well_formed, round(avg(registered::int), 6) as registered,
 round(avg((tool = want_tool)::int), 6) as tool_match, round(avg(same::int), 6) as arguments_match, round(avg((tool = want_tool and same)::int), 6) as exact, round(avg((strict and tool = want_tool and same)::int), 6) as strict_exact from q group by 1"""


def format_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completions from which an action can be taken but that are more than that action, per tool, and tagged calls that can be read."""
    rows = _completions(spark, sf_dir).withColumn("extracted", completions.first_object("completion"))
    tool = F.try_variant_get(F.try_parse_json("extracted"), "$.tool", "string")
    tagged = F.concat(F.lit("<tool_call>{\"name\": \""), tool, F.lit("\", \"arguments\": "), completions.part(F.col("extracted"), "arguments"), F.lit("}</tool_call>"))
    return rows.groupBy(tool.alias("tool")).agg(
        F.count("*").alias("completions"), F.count_if(~F.coalesce(canonical.kind(F.trim("completion")) == "OBJECT", F.lit(False))).alias("not_strict"), F.count(completions.tagged_call(tagged)).alias("tagged"))


FORMAT_AUDIT = f"{_COMPLETIONS} select tool, count(*) as completions, count(*) filter (not strict) as not_strict, count(*) as tagged from q group by tool"


def action_rewards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rewards of completions for a readable action, its tool and its arguments, in all."""
    rows = _completions(spark, sf_dir).withColumn("extracted", completions.first_object("completion"))
    m = completions.score(F.col("completion"), F.col("extracted"), F.col("expected"), TOOLS)
    return rows.select(*[m[n].cast("double").alias(n) for n in ("strict", "tool_match", "arguments_match")]).agg(
        F.count("*").alias("n"), F.sum("strict").alias("json_reward"), F.sum("tool_match").alias("tool_reward"), F.sum("arguments_match").alias("arguments_reward"))


ACTION_REWARDS = f"{_COMPLETIONS} select count(*) as n, sum(strict::int)::double as json_reward, sum((tool = want_tool)::int)::double as tool_reward, sum(same::int)::double as arguments_reward from q"


def argument_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls that lack an argument their tool needs, or have it empty, per tool."""
    needs = F.when(F.col("name").rlike("order"), F.array(F.lit("order_id"))).when(F.col("name").rlike("user_details"), F.array(F.lit("user_id"))).otherwise(F.array().cast("array<string>"))
    has = F.coalesce(F.json_object_keys("arguments"), F.array().cast("array<string>"))
    filled = F.forall(needs, lambda k: F.coalesce(F.try_variant_get(F.try_parse_json("arguments"), "$.order_id", "string"), F.try_variant_get(F.try_parse_json("arguments"), "$.user_id", "string"), F.lit("")) != "")
    c = t.calls(_events(spark, sf_dir))
    return c.groupBy("name").agg(F.count("*").alias("calls"), F.count_if((F.size(F.array_except(needs, has)) == 0) & filled).alias("complete"))


ARGUMENT_SCHEMA = f"""with {CALLS} select name, count(*) as calls, count(*) filter (case when name like '%order%' then coalesce(json_extract_string(arguments, '$.order_id'), '') <> '' when name like '%user_details%' then list_contains(json_keys(arguments), 'user_id')
 and coalesce(json_extract_string(arguments, '$.order_id'), json_extract_string(arguments, '$.user_id'), '') <> '' else true end) as complete from calls group by name"""


def task_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trajectories by the families of the writes they made: one family, mixed ones, a handoff, or a query."""
    hit = lambda *prefixes: F.bool_or(F.rlike("name", F.lit("^(?:" + "|".join(prefixes) + ")_")))
    per = t.calls(_events(spark, sf_dir)).groupBy("candidate_id").agg(*[hit(f).alias(f) for f in ("cancel", "exchange", "modify", "return", "transfer")])
    families = F.array_compact(F.array(*[F.when(F.col(f), F.lit(f)) for f in ("cancel", "exchange", "modify", "return")]))
    stratum = F.when(F.size(families) > 1, F.concat(F.lit("mixed_"), F.array_join(families, "_"))).when(F.size(families) == 1, F.array_join(families, "")).when(F.col("transfer"), "handoff").otherwise("query")
    return per.groupBy(stratum.alias("stratum")).agg(F.count("*").alias("trajectories"))


TASK_STRATA = f"""with {CALLS}, f as (select candidate_id, list_sort(list(distinct split_part(name, '_', 1)) filter (split_part(name, '_', 1) in ('cancel', 'exchange', 'modify', 'return'))) as fam, bool_or(name like 'transfer\\_%' escape '\\') as handoff from calls group by candidate_id)
select case when len(fam) > 1 then 'mixed_' || array_to_string(fam, '_') when len(fam) = 1 then fam[1] when handoff then 'handoff' else 'query' end as stratum, count(*) as trajectories from f group by 1"""


def stability_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks with two trials: outcomes, share of successes and a label."""
    tr = _trials(spark, sf_dir).where("nth <= 2").groupBy("task_id").agg(F.count("*").alias("trials"), F.count_if("success").alias("good"), F.bool_or(F.when(F.col("nth") == 1, F.col("success"))).alias("first"), F.bool_or(F.when(F.col("nth") == 2, F.col("success"))).alias("second"))
    label = F.when(F.expr("first and second"), "STABLE_SUCCESS").when(F.expr("not first and not second"), "STABLE_FAILURE").otherwise("UNSTABLE")
    return tr.where("trials = 2").select("task_id", "first", "second", (F.col("good") / 2).alias("share"), label.alias("label"))


STABILITY_ROWS = f"""with {TRIALS} select a.task_id, a.success as first, b.success as second, (a.success::int + b.success::int) / 2 as share, case when a.success and b.success then 'STABLE_SUCCESS' when not a.success and not b.success then 'STABLE_FAILURE' else 'UNSTABLE' end as label
from trials a join trials b using (task_id) where a.nth = 1 and b.nth = 2"""


def active_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of the flags that are true for a trajectory, and how many trajectories have each set of them."""
    c = t.card(_events(spark, sf_dir))
    flags = {"duplicates": F.col("duplicates") > 0, "errors": F.col("tool_errors") > 0, "long_run": F.col("longest_run") > 2, "multi_call": F.col("multi_call_turns") > 0, "no_answer": F.col("final_answer_index") < 0}
    names = F.array_join(F.array_sort(F.map_keys(F.map_filter(F.create_map(*[x for n, f in flags.items() for x in (F.lit(n), f)]), lambda _, v: v))), ",")
    return c.groupBy(names.alias("flags")).agg(F.count("*").alias("trajectories"))


def text_tails(spark: SparkSession, sf_dir: str, budget: int = 64) -> DataFrame:
    """The last words of each document, within a budget, and whether any were cut."""
    words = F.split(F.trim("text"), r"\s+")
    d = read(spark, sf_dir, "documents").where("text is not null and length(trim(text)) > 0")
    return d.select("doc_id", F.sha2(F.array_join(F.when(F.size(words) > budget, F.slice(words, -budget, budget)).otherwise(words), " "), 256).alias("tail"), (F.size(words) > budget).alias("cut"))


def marker_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages that show a marker of hidden answers, by role and marker."""
    markers = ("gold", "expected action", "reference answer", "ground truth", "policy")
    e = _events(spark, sf_dir).where("content is not null")
    found = F.filter(F.array(*[F.lit(m) for m in markers]), lambda m: F.contains(F.lower("content"), m))
    return e.select("role", F.explode(found).alias("marker")).groupBy("role", "marker").agg(F.count("*").alias("messages"))


MARKER_SCAN = f"""with {EVENTS}, m(marker) as (values ('gold'), ('expected action'), ('reference answer'), ('ground truth'), ('policy')) select role, marker, count(*) as messages from ev, m where contains(lower(content), marker) group by all"""


def tool_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed calls by kind, and how many of their trajectories call the same tool later without an error."""
    rows = t.call_results(_events(spark, sf_dir))
    later = Window.partitionBy("candidate_id", "name").orderBy("msg_index", "pos").rowsBetween(1, Window.unboundedFollowing)
    rows = rows.withColumn("recovered", F.coalesce(F.max((F.col("result_found") & ~F.col("is_error")).cast("int")).over(later), F.lit(0)) == 1)
    return rows.where("is_error").groupBy(t.error_kind(F.col("name"), F.col("result")).alias("kind")).agg(F.count("*").alias("failed"), F.count_if("recovered").alias("recovered"))


TOOL_RECOVERY = f"""with {RESULTS} select case when name like 'find\\_user%' escape '\\' and lower(coalesce(result, '')) like '%user not found%' then 'AUTH_LOOKUP_MISS' when {IS_WRITE} then 'WRITE_TOOL_ERROR' else 'READ_TOOL_ERROR' end as kind, count(*) as failed,
 count(*) filter (exists (select 1 from joined b where b.candidate_id = a.candidate_id and b.name = a.name and (b.msg_index, b.pos) > (a.msg_index, a.pos) and b.result_found and not b.is_error)) as recovered from joined a where is_error group by 1"""


ACTIVE_FLAGS = f"""select array_to_string([f for f in [case when duplicates > 0 then 'duplicates' end, case when tool_errors > 0 then 'errors' end, case when longest_run > 2 then 'long_run' end, case when multi_call_turns > 0 then 'multi_call' end,
 case when final_answer_index < 0 then 'no_answer' end] if f is not null], ',') as flags, count(*) as trajectories from ({TRAJECTORY_CARD}) group by 1"""
TEXT_TAILS = r"""with w as (select doc_id, regexp_split_to_array(regexp_replace(text, '^ +| +$', '', 'g'), '[ \t\n\x0b\f\r]+') as words from documents where text is not null and length(trim(text)) > 0)
select doc_id, sha256(array_to_string(case when len(words) > 64 then words[-64:] else words end, ' ')) as tail, len(words) > 64 as cut from w"""

QUERIES = {f.__name__: (f, globals()[f.__name__.upper()]) for f in (
    run_aggregate, action_pass_stats, projected_cost, failure_detection, dominant_tool, tools_in_order, error_findings, role_grammar, stop_position, message_kinds, positional_results, serial_turns, call_signatures, item_signatures,
    referenced_values, transcript_digest, result_segments, secrets_redacted, error_categories, completion_scores, format_audit, action_rewards, argument_schema, task_strata, stability_rows, active_flags, text_tails, marker_scan, tool_recovery)}
