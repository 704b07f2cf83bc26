"""Queries over failures, their causes and what was seen of them, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernstone.operators import attribution
from quernstone.operators import trajectory as t
from quernstone.plans.runs import TRANSCRIPT_DIGEST, transcript_digest
from quernstone.plans.trajectories import EVENTS, IS_WRITE, RESULTS, TRIALS, _events, _trials
from quernstone.runtime import read

KIND = f"case when name like 'find\\_user%' escape '\\' and lower(coalesce(result, '')) like '%user not found%' then 'AUTH_LOOKUP_MISS' when {IS_WRITE} then 'WRITE_TOOL_ERROR' else 'READ_TOOL_ERROR' end"
# Layer and impact of each code.
TAXONOMY = [("AUTH_LOOKUP_MISS", "IDENTITY", 1), ("WRITE_TOOL_ERROR", "ACTION", 3), ("READ_TOOL_ERROR", "OBSERVATION", 1), ("NO_ANSWER", "COMMUNICATION", 2)]


def root_causes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed trajectories by the layers of their causes, with the greatest impact; unexplained ones are quarantined."""
    e = _events(spark, sf_dir)
    rows = t.call_results(e).where("is_error").select("candidate_id", t.error_kind(F.col("name"), F.col("result")).alias("code"))
    answered = t.final_answer(e).select("candidate_id")
    silent = e.select("candidate_id").distinct().join(answered, "candidate_id", "left_anti").select("candidate_id", F.lit("NO_ANSWER").alias("code"))
    units = e.groupBy("candidate_id").agg(F.bool_or(F.coalesce("tool_error", F.lit(False))).alias("erred"), F.max(F.when(F.col("role") == "assistant", F.length(F.trim("content")))).alias("said"))
    failed = F.col("erred") | (F.coalesce("said", F.lit(0)) == 0)
    found = attribution.attribute(units, rows.unionByName(silent), spark.createDataFrame(TAXONOMY, "code string, layer string, impact int"), "candidate_id", failed)
    return found.groupBy("layers", "impact", "quarantined").agg(F.count("*").alias("trajectories"))


ROOT_CAUSES = f"""with {RESULTS}, x(code, layer, impact) as (values {', '.join(f"('{c}', '{l}', {i})" for c, l, i in TAXONOMY)}),
 u as (select candidate_id, bool_or(coalesce(tool_error, false)) as erred, coalesce(max(length(trim(content))) filter (role = 'assistant'), 0) = 0 as silent from ev group by candidate_id),
 f as (select distinct candidate_id, {KIND} as code from joined where is_error union select candidate_id, 'NO_ANSWER' from u where silent),
 p as (select candidate_id, array_to_string(list_sort(list(distinct coalesce(layer, 'UNEXPLAINED'))), ',') as layers, max(impact) as impact, bool_or(layer is null) as unknown from f left join x using (code) group by candidate_id)
select coalesce(layers, 'UNEXPLAINED') as layers, coalesce(impact, 0) as impact, coalesce(unknown, true) as quarantined, count(*) as trajectories from u left join p using (candidate_id) where erred or silent group by 1, 2, 3"""


def failure_dossiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each trajectory with a failed call: its first failure, the user's last words before it, and the answer's digest."""
    e = _events(spark, sf_dir)
    first = t.call_results(e).where("is_error").groupBy("candidate_id").agg(F.min_by(F.struct("msg_index", "name"), F.struct("msg_index", "pos")).alias("f"), F.count("*").alias("errors"))
    said = e.where("role = 'user' and length(trim(content)) > 0").select("candidate_id", F.col("msg_index").alias("user_index"), "content")
    before = first.join(said, "candidate_id", "left").where("user_index is null or user_index < f.msg_index").groupBy("candidate_id").agg(F.max("user_index").alias("user_index"), F.sha2(F.max_by("content", "user_index"), 256).alias("user_digest"))
    answer = t.final_answer(e).select("candidate_id", F.sha2("answer", 256).alias("answer_digest"))
    return first.join(before, "candidate_id", "left").join(answer, "candidate_id", "left").select("candidate_id", F.col("f.msg_index").alias("msg_index"), F.col("f.name").alias("name"), "errors", "user_index", "user_digest", "answer_digest")


FAILURE_DOSSIERS = f"""with {RESULTS}, f as (select candidate_id, arg_min(msg_index, (msg_index, pos)) as msg_index, arg_min(name, (msg_index, pos)) as name, count(*) as errors from joined where is_error group by candidate_id),
 s as (select candidate_id, msg_index as user_index, content from ev where role = 'user' and length(trim(content)) > 0), b as (select f.candidate_id, max(user_index) as user_index, sha256(arg_max(content, user_index)) as user_digest from f join s on s.candidate_id = f.candidate_id and user_index < f.msg_index group by 1),
 a as (select candidate_id, sha256(trim(arg_max(content, msg_index))) as answer_digest from ev where role = 'assistant' and length(trim(content)) > 0 group by candidate_id)
select f.candidate_id, f.msg_index, f.name, f.errors, user_index, user_digest, answer_digest from f left join b using (candidate_id) left join a using (candidate_id)"""


def observation_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the first two trials of a task observed the same, told by the digests of their transcripts."""
    d = transcript_digest(spark, sf_dir).select("candidate_id", "digest")
    tr = _trials(spark, sf_dir).where("nth <= 2").select("candidate_id", "task_id").join(d, "candidate_id", "left")
    per = tr.groupBy("task_id").agg(F.count("*").alias("n"), F.countDistinct("digest").alias("different"))
    return per.where("n = 2").groupBy((F.col("different") == 1).alias("same")).agg(F.count("*").alias("tasks"))


OBSERVATION_MATCH = f"""with {TRIALS}, d as (select candidate_id, digest from ({TRANSCRIPT_DIGEST})), p as (select task_id, count(*) as n, count(distinct digest) as different from trials left join d using (candidate_id) where nth <= 2 group by task_id)
select different = 1 as same, count(*) as tasks from p where n = 2 group by 1"""


def plan_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns by how many steps they stand for: a text or call each should be one."""
    e = _events(spark, sf_dir).where("role = 'assistant'")
    steps = F.size(F.coalesce("tool_calls", F.array())) + F.when((F.length(F.trim("content")) > 0) & (F.size(F.coalesce("tool_calls", F.array())) == 0), 1).otherwise(0)
    return e.groupBy(steps.alias("steps")).agg(F.count("*").alias("turns"), F.countDistinct("candidate_id").alias("trajectories"))


PLAN_COVERAGE = f"""with {EVENTS} select coalesce(len(tool_calls), 0) + case when length(trim(content)) > 0 and coalesce(len(tool_calls), 0) = 0 then 1 else 0 end as steps, count(*) as turns, count(distinct candidate_id) as trajectories from ev where role = 'assistant' group by 1"""


def changed_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Between consecutive assistant texts of a trajectory: words that the later one adds between what both begin and end with."""
    said = _events(spark, sf_dir).where("role = 'assistant' and length(trim(content)) > 0").select("candidate_id", "msg_index", "event_id", F.split("content", " ").alias("words"))
    w = Window.partitionBy("candidate_id").orderBy("msg_index", "event_id")
    rows = said.withColumn("before", F.lag("words").over(w)).where("before is not null").withColumn("span", attribution.changed_span(F.col("before"), F.col("words")))
    return rows.groupBy("candidate_id").agg(F.count("*").alias("steps"), F.sum("span.start").alias("kept_head"), F.sum("span.length").alias("changed"))


CHANGED_SPANS = f"""with {EVENTS}, s as (select candidate_id, msg_index, event_id, string_split(content, ' ') as w from ev where role = 'assistant' and length(trim(content)) > 0), b as (select *, lag(w) over (partition by candidate_id order by msg_index, event_id) as v from s),
 h as (select *, least(len(v), len(w)) as m, coalesce(list_position([v[i] = w[i] for i in range(1, least(len(v), len(w)) + 1)], false) - 1, least(len(v), len(w))) as head, coalesce(list_position([list_reverse(v)[i] = list_reverse(w)[i] for i in range(1, least(len(v), len(w)) + 1)], false) - 1, least(len(v), len(w))) as tail from b where v is not null)
select candidate_id, count(*) as steps, sum(head)::bigint as kept_head, sum(len(w) - head - least(tail, m - head))::bigint as changed from h group by candidate_id"""


def natural_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first twenty-five tasks by number: shorter ids first, then by their digits."""
    known = read(spark, sf_dir, "task_definitions").where("task_id is not null").select("task_id").distinct()
    return known.orderBy(F.length("task_id"), "task_id").limit(25)


NATURAL_ORDER = "select task_id from (select distinct task_id from task_definitions where task_id is not null) order by length(task_id), task_id limit 25"


def state_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of the two states of a replay: on both sides, and on one only; with the union of all."""
    keys = lambda c: F.json_object_keys(F.to_json(F.try_variant_get(F.try_parse_json(c), "$.agent.orders", "variant")))
    r = read(spark, sf_dir, "replay_results").where("replay_id is not null").dropDuplicates(["replay_id", "agent_state", "gold_state"]).select("replay_id", keys("agent_state").alias("a"), keys("gold_state").alias("g")).where("a is not null and g is not null")
    return r.groupBy("replay_id").agg(F.max(F.size(F.array_intersect("a", "g"))).alias("both"), F.max(F.size(F.array_except("a", "g"))).alias("agent_only"), F.max(F.size(F.array_except("g", "a"))).alias("gold_only"), F.max(F.size(F.array_union("a", "g"))).alias("orders"))


STATE_KEYS = """with k as (select replay_id, json_keys(json_extract(agent_state, '$.agent.orders')) as a, json_keys(json_extract(gold_state, '$.agent.orders')) as g from replay_results where replay_id is not null and json_valid(agent_state) and json_valid(gold_state)
  and json_type(agent_state, '$.agent.orders') = 'OBJECT' and json_type(gold_state, '$.agent.orders') = 'OBJECT')
select replay_id, max(len(list_intersect(a, g))) as both, max(len([x for x in a if not list_contains(g, x)])) as agent_only, max(len([x for x in g if not list_contains(a, x)])) as gold_only, max(len(list_distinct(list_concat(a, g)))) as orders from k group by replay_id"""

QUERIES = {f.__name__: (f, globals()[f.__name__.upper()]) for f in (root_causes, failure_dossiers, observation_match, plan_coverage, changed_spans, natural_order, state_keys)}
