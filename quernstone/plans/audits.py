"""Queries that audit trajectories, trials and inputs, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernstone.functions import canonical
from quernstone.operators import completions, governance, matching
from quernstone.operators import trajectory as t
from quernstone.plans.governing import DECIDED, VOTES, _decided, _votes
from quernstone.plans.releases import CANDIDATES, _held
from quernstone.plans.trajectories import CALLS, EVENTS, IS_WRITE, RESULTS, TRAJECTORY_CARD, TRIALS, _events, _trials
from quernstone.runtime import read


def located_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The amount a result names, by the first of several places that holds a number, and where it was."""
    v = F.try_parse_json("content")
    places = ["$.total", "$.balance", "$.items[0].price", "$.amount"]
    numbers = [F.when(canonical.kind(F.to_json(F.try_variant_get(v, p, "variant"))).isin("BIGINT", "DECIMAL", "DOUBLE"), F.try_variant_get(v, p, "double")) for p in places]
    place = F.coalesce(*[F.when(n.isNotNull(), F.lit(p)) for n, p in zip(numbers, places)], F.lit("(none)"))
    e = _events(spark, sf_dir).where("role = 'tool'").select(place.alias("place"), F.coalesce(*numbers).alias("amount"))
    return e.groupBy("place").agg(F.count("*").alias("results"), F.round(F.max("amount"), 2).alias("largest"), F.round(F.avg("amount"), 4).alias("mean"))


_PLACE = ", ".join(f"case when json_type(j, '{p}') in ('BIGINT', 'UBIGINT', 'DOUBLE') then json_extract(j, '{p}')::double end" for p in ("$.total", "$.balance", "$.items[0].price", "$.amount"))
LOCATED_AMOUNTS = f"""with {EVENTS}, j as (select case when json_valid(content) then content::json end as j from ev where role = 'tool'), a as (select coalesce({_PLACE}) as amount,
  coalesce({', '.join(f"case when json_type(j, '{p}') in ('BIGINT', 'UBIGINT', 'DOUBLE') then '{p}' end" for p in ("$.total", "$.balance", "$.items[0].price", "$.amount"))}, '(none)') as place from j)
select place, count(*) as results, round(max(amount), 2) as largest, round(avg(amount), 4) as mean from a group by place"""


def entity_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks whose decisions name entities, and how many of these stand in the task's definition."""
    d = _decided(spark, sf_dir)
    entries = governance.group_entries(d, "task_id", "group_ids").select("task_id", F.regexp_replace("entry", "^[^:]*:", "").alias("value")).where("value <> ''").distinct()
    texts = read(spark, sf_dir, "task_definitions").where("task_id is not null").groupBy("task_id").agg(F.max(F.to_json(F.struct("domain", "known_info", "reason_for_call", "task_instructions"))).alias("dump"))
    return entries.join(texts, "task_id").groupBy("task_id").agg(F.count("*").alias("entities"), F.count_if(F.contains("dump", F.col("value"))).alias("named"))


ENTITY_OVERLAP = f"""with {DECIDED}, e as (select distinct task_id, regexp_replace(regexp_replace(g, '^\\s+|\\s+$', '', 'g'), '^[^:]*:', '') as value from (select task_id, unnest(group_ids) as g from decided)),
 d as (select task_id, max(to_json({{'domain': domain, 'known_info': known_info, 'reason_for_call': reason_for_call, 'task_instructions': task_instructions}})::varchar) as dump from task_definitions where task_id is not null group by task_id)
select task_id, count(*) as entities, count(*) filter (contains(dump, value)) as named from e join d using (task_id) where value <> '' group by task_id"""


def run_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of calls of the same tool, three or longer, with their errors and the first and last arguments' digests."""
    w = t.in_order("candidate_id")
    rows = t.call_results(_events(spark, sf_dir))
    change = F.when(F.col("name").eqNullSafe(F.lag("name").over(w)), 0).otherwise(1)
    rows = rows.withColumn("change", change).withColumn("run", F.sum("change").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    place = F.struct("msg_index", "pos")
    out = rows.groupBy("candidate_id", "run", "name").agg(F.count("*").alias("n"), F.count_if("is_error").alias("errors"), F.min_by("signature", place).alias("a"), F.max_by("signature", place).alias("b"))
    return out.where("n > 2").select("candidate_id", "run", "name", "n", "errors", (F.col("a") == F.col("b")).alias("ends_as_it_began"))


RUN_DETAILS = f"""with {RESULTS}, m as (select *, case when name is not distinct from lag(name) over (partition by candidate_id order by msg_index, pos) then 0 else 1 end as change from joined),
 r as (select *, sum(change) over (partition by candidate_id order by msg_index, pos rows unbounded preceding)::bigint as run from m)
select candidate_id, run, name, count(*) as n, count(*) filter (is_error) as errors, arg_min(signature, (msg_index, pos)) = arg_max(signature, (msg_index, pos)) as ends_as_it_began from r group by candidate_id, run, name having count(*) > 2"""


def card_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medians and sums of the cards, in one row."""
    c = t.card(_events(spark, sf_dir))
    return c.agg(*[F.median(x).alias(f"median_{x}") for x in ("calls", "messages", "tool_errors")], *[F.sum(x).alias(f"sum_{x}") for x in ("calls", "write_calls", "adjacent_repeats")], F.round(F.avg((F.col("final_answer_index") >= 0).cast("int")), 6).alias("answered"))


CARD_SUMMARY = f"""select median(calls) as median_calls, median(messages) as median_messages, median(tool_errors) as median_tool_errors, sum(calls)::bigint as sum_calls, sum(write_calls)::bigint as sum_write_calls, sum(adjacent_repeats)::bigint as sum_adjacent_repeats,
 round(avg((final_answer_index >= 0)::int), 6) as answered from ({TRAJECTORY_CARD})"""


def variance_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether trials vary enough to learn from: tasks with mixed outcomes, their share, and the gates on both."""
    per = _trials(spark, sf_dir).groupBy("task_id").agg(F.count("*").alias("n"), F.bool_or("success").alias("some"), F.bool_and("success").alias("every")).where("n > 1")
    c = per.agg(F.count("*").alias("tasks"), F.count_if(F.expr("some and not every")).alias("mixed"))
    return c.select("tasks", "mixed", F.round(F.try_divide("mixed", "tasks"), 6).alias("share"), (F.col("mixed") >= 20).alias("enough"), F.coalesce(F.try_divide("mixed", "tasks") >= 0.1, F.lit(False)).alias("varied")).withColumn("passed", F.expr("enough and varied"))


VARIANCE_GATES = f"""with {TRIALS}, p as (select task_id, bool_or(success) as any_good, bool_and(success) as every from trials group by task_id having count(*) > 1), c as (select count(*) as tasks, count(*) filter (any_good and not every) as mixed from p),
 g as (select tasks, mixed, round(mixed / nullif(tasks, 0), 6) as share, mixed >= 20 as enough, coalesce(mixed / nullif(tasks, 0) >= 0.1, false) as varied from c) select *, enough and varied as passed from g"""


def label_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How votes on a task move from one reviewer to the next, ranked FAIL, REVIEW, PASS."""
    rank = F.when(F.col("label") == "FAIL", 0).when(F.col("label") == "REVIEW", 1).when(F.col("label") == "PASS", 2)
    w = Window.partitionBy("task_id").orderBy("reviewed_at", "reviewer")
    rows = _votes(spark, sf_dir).withColumn("rank", rank).withColumn("step", F.col("rank") - F.lag("rank").over(w))
    return rows.where("step is not null").groupBy("step").agg(F.count("*").alias("votes"))


def preflight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks of the inputs before two arms are run: each with its count, whether it blocks, and whether all blocking ones hold."""
    e, d = _events(spark, sf_dir), read(spark, sf_dir, "task_definitions")
    known = d.where("task_id is not null").select("task_id").distinct()
    checks = [
        (d.agg(F.count_if(F.col("task_id").isNull()).alias("n")), "definition_without_task", True),
        (e.where("task_id is not null").select("task_id").distinct().join(known, "task_id", "left_anti").agg(F.count("*").alias("n")), "trial_without_definition", True),
        (e.where("task_id is null").select("candidate_id").distinct().agg(F.count("*").alias("n")), "trial_without_task", False),
        (t.calls(e).groupBy("candidate_id", "call_id").agg(F.count("*").alias("k")).where("k > 1").agg(F.count("*").alias("n")), "call_id_twice", True),
    ]
    out = None
    for rows, name, blocks in checks:
        one = rows.select(F.lit(name).alias("check"), "n", F.lit(blocks).alias("blocks"), (F.col("n") == 0).alias("holds"))
        out = one if out is None else out.unionByName(one)
    return out


PREFLIGHT = f"""with {CALLS}, c("check", n, blocks) as (select 'definition_without_task', count(*) filter (task_id is null), true from task_definitions
 union all select 'trial_without_definition', count(*), true from (select distinct task_id from ev where task_id is not null and task_id not in (select task_id from task_definitions where task_id is not null))
 union all select 'trial_without_task', count(distinct candidate_id), false from ev where task_id is null
 union all select 'call_id_twice', count(*), true from (select candidate_id, call_id from calls group by all having count(*) > 1)) select *, n = 0 as holds from c"""


def holdout_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation candidates against training ones: rows, tasks, and ids and digests they share, in one row."""
    h = _held(spark, sf_dir)
    train, held = h.where("split = 'TRAIN'"), h.where("split = 'VALIDATION'")
    shared = lambda c: held.where(F.col(c).isNotNull()).select(c).distinct().join(train.select(c), c, "left_semi").agg(F.count("*").alias(f"shared_{c}"))
    base = held.agg(F.count("*").alias("rows"), F.countDistinct("task_id").alias("tasks"), F.count_if(F.col("task_id").isNull()).alias("without_task"))
    return base.crossJoin(shared("task_id")).crossJoin(shared("source_sha256")).crossJoin(shared("candidate_id"))  # a row each


HOLDOUT_INPUTS = f"""with {CANDIDATES}, t as (select * from held where split = 'TRAIN'), v as (select * from held where split = 'VALIDATION')
select count(*) as rows, count(distinct task_id) as tasks, count(*) filter (task_id is null) as without_task, (select count(distinct task_id) from v where task_id in (select task_id from t where task_id is not null)) as shared_task_id,
 (select count(distinct source_sha256) from v where source_sha256 in (select source_sha256 from t where source_sha256 is not null)) as shared_source_sha256, (select count(distinct candidate_id) from v where candidate_id in (select candidate_id from t)) as shared_candidate_id from v"""


def dataset_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks of trajectories as training rows: those whose calls all have an adjacent result, end in an answer and hold no failed write."""
    e = _events(spark, sf_dir)
    paired = t.open_calls(e).select("candidate_id", (F.expr("without_result = 0 and without_call = 0 and too_early = 0 and answered_twice = 0")).alias("paired"))
    c = t.card(e).select("candidate_id", (F.col("final_answer_index") >= 0).alias("answered"), F.col("tool_errors"))
    j = c.join(paired, "candidate_id", "left").withColumn("paired", F.coalesce("paired", F.lit(True)))
    reasons = F.array_join(F.array_compact(F.array(F.when(~F.col("paired"), F.lit("pairing")), F.when(~F.col("answered"), F.lit("answer")), F.when(F.col("tool_errors") > 0, F.lit("errors")))), ",")
    return j.groupBy(reasons.alias("reasons")).agg(F.count("*").alias("trajectories"))


def task_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks of all definitions by the state of their trials: done, failed, without outcome, or never tried."""
    tr = _trials(spark, sf_dir).groupBy("task_id").agg(F.count("*").alias("trials"), F.count_if("success").alias("good"), F.sum("turns").alias("turns"))
    known = read(spark, sf_dir, "task_definitions").where("task_id is not null").select("task_id").distinct().join(tr, "task_id", "left")
    status = F.when(F.col("trials").isNull(), "NOT_TRIED").when(F.col("good") == F.col("trials"), "COMPLETED").when(F.col("good") == 0, "FAILED").otherwise("MIXED")
    return known.groupBy(status.alias("status")).agg(F.count("*").alias("tasks"), F.coalesce(F.sum("trials"), F.lit(0)).alias("trials"), F.coalesce(F.sum("turns"), F.lit(0)).alias("turns"))


TASK_SUMMARIES = f"""with {TRIALS}, p as (select task_id, count(*) as trials, count(*) filter (success) as good, sum(turns) as turns from trials group by task_id), k as (select distinct task_id from task_definitions where task_id is not null)
select case when trials is null then 'NOT_TRIED' when good = trials then 'COMPLETED' when good = 0 then 'FAILED' else 'MIXED' end as status, count(*) as tasks, coalesce(sum(trials), 0)::bigint as trials, coalesce(sum(turns), 0)::bigint as turns from k left join p using (task_id) group by 1"""


def located_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes by whether their call id finds exactly one call of the trajectory."""
    c = t.calls(_events(spark, sf_dir))
    n = c.groupBy("candidate_id", "call_id").agg(F.count("*").alias("n"), F.bool_or(t.is_write(F.col("name"))).alias("write")).where("write")
    return n.groupBy(F.when(F.col("n") == 1, "ONE").otherwise("SEVERAL").alias("found")).agg(F.count("*").alias("writes"))


LOCATED_WRITES = f"""with {CALLS}, n as (select candidate_id, call_id, count(*) as n, bool_or({IS_WRITE}) as w from calls group by all) select case when n = 1 then 'ONE' else 'SEVERAL' end as found, count(*) as writes from n where w group by 1"""


def merged_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of a task's decisions over time: those of the first row, and later ones appended where they are new."""
    d = read(spark, sf_dir, "quality_decisions").where("task_id is not null and group_ids is not null")
    clean = lambda c: F.filter(F.transform(c, lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    rows = d.select("task_id", F.posexplode(clean("group_ids")).alias("place", "entry"), "decided_at", "ingested_at")
    first = rows.groupBy("task_id", "entry").agg(F.min(F.struct("decided_at", "ingested_at", "place")).alias("at"))
    per = first.groupBy("task_id").agg(F.count("*").alias("entries"), F.min_by("entry", "at").alias("first_entry"), F.max_by("entry", F.struct("at", "entry")).alias("last_entry"))
    return per


MERGED_ALIASES = """with r as (select task_id, regexp_replace(group_ids[i], '^\\s+|\\s+$', '', 'g') as entry, decided_at, ingested_at, i from (select *, unnest(range(1, len(group_ids) + 1)) as i from quality_decisions where task_id is not null)),
 n as (select task_id, entry, min((decided_at, ingested_at, i)) as at_place from r where entry <> '' group by all)
select task_id, count(*) as entries, arg_min(entry, at_place) as first_entry, arg_max(entry, (at_place, entry)) as last_entry from n group by task_id"""


def call_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of each turn's calls in canonical form, in order; how many turns share it within a trajectory."""
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.sha2("signature", 256).alias("s")))), lambda x: x["s"]), "")  # the calls of a turn
    turns = t.calls(_events(spark, sf_dir)).groupBy("candidate_id", "msg_index").agg(F.sha2(ordered, 256).alias("turn"), F.count("*").alias("calls"))
    return turns.groupBy("candidate_id").agg(F.count("*").alias("turns"), F.countDistinct("turn").alias("different"), F.max("calls").alias("most_calls"))


CALL_ARRAYS = f"""with {CALLS}, n as (select candidate_id, msg_index, string_agg(signature, chr(10) order by pos) as turn, count(*) as calls from calls group by all) select candidate_id, count(*) as turns, count(distinct turn) as different, max(calls) as most_calls from n group by candidate_id"""


def arm_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two trials of a task as arms: outcome, turns and the change between them; nulls where an arm is missing."""
    tr = _trials(spark, sf_dir).where("nth <= 2").groupBy("task_id").agg(
        *[F.max(F.when(F.col("nth") == n, F.col(c).cast("int"))).alias(f"{c}_{n}") for n in (1, 2) for c in ("success", "turns")])
    label = F.when(F.col("success_2").isNull(), "one_arm").otherwise(matching.transition(F.col("success_1") == 1, F.col("success_2") == 1))
    return tr.groupBy(label.alias("transition")).agg(F.count("*").alias("tasks"), F.coalesce(F.sum(F.col("turns_2") - F.col("turns_1")), F.lit(0)).alias("turn_change"))


ARM_ROWS = f"""with {TRIALS}, p as (select task_id, max(success::int) filter (nth = 1) as s1, max(success::int) filter (nth = 2) as s2, max(turns) filter (nth = 1) as t1, max(turns) filter (nth = 2) as t2 from trials where nth <= 2 group by task_id)
select case when s2 is null then 'one_arm' when s1 = 1 and s2 = 1 then 'both_success' when s2 = 1 then 'improved' when s1 = 1 then 'regressed' else 'both_failure' end as transition, count(*) as tasks, coalesce(sum(t2 - t1), 0)::bigint as turn_change from p group by 1"""


def project_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row over all reports: trajectories, decisions, released positives and replays."""
    a = t.card(_events(spark, sf_dir)).agg(F.count("*").alias("trajectories"), F.sum("calls").alias("calls"))
    b = _decided(spark, sf_dir).agg(F.count("*").alias("decisions"), F.count_if(F.col("disposition") != "HOLDOUT").alias("positives"))
    c = read(spark, sf_dir, "replay_results").agg(F.countDistinct("replay_id").alias("replays"))
    return a.crossJoin(b).crossJoin(c)  # a row each


PROJECT_SUMMARY = f"""with {DECIDED}, {TRIALS}, {CALLS.removeprefix(EVENTS + ', ')} select (select count(distinct candidate_id) from ev) as trajectories, (select count(*) from calls) as calls, count(*) as decisions, count(*) filter (disposition <> 'HOLDOUT') as positives,
 (select count(distinct replay_id) from replay_results) as replays from decided"""

def benchmark_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defined tasks by the verdict of their mean reward over all trials; untried ones are not evaluated."""
    known = read(spark, sf_dir, "task_definitions").where("task_id is not null").select("task_id").distinct()
    rewards = _trials(spark, sf_dir).groupBy("task_id").agg(F.avg(F.col("success").cast("int")).alias("reward"))
    return known.join(rewards, "task_id", "left").groupBy(completions.verdict("reward").alias("verdict")).agg(F.count("*").alias("tasks"))


BENCHMARK_VERDICTS = f"""with {TRIALS}, k as (select distinct task_id from task_definitions where task_id is not null), r as (select task_id, avg(success::int) as reward from trials group by task_id)
select case when reward is null then 'NOT_EVALUATED' when reward >= 1 then 'PASS' else 'FAIL' end as verdict, count(*) as tasks from k left join r using (task_id) group by 1"""
LABEL_STEPS = f"""with {VOTES}, r as (select task_id, case label when 'FAIL' then 0 when 'REVIEW' then 1 else 2 end as rank, reviewed_at, reviewer from votes), s as (select rank - lag(rank) over (partition by task_id order by reviewed_at, reviewer) as step from r)
select step, count(*) as votes from s where step is not null group by step"""
DATASET_ROWS = f"""with {CALLS}, made as (select candidate_id, call_id, min(msg_index) as called from calls group by all), seen as (select candidate_id, tool_call_id as call_id, min(msg_index) as answered, count(*) as answers from ev where role = 'tool' group by all),
 o as (select candidate_id, bool_and(answered is not null and called is not null and answered >= called and answers = 1) as paired from made full join seen using (candidate_id, call_id) group by candidate_id),
 c as (select candidate_id, max(case when role = 'assistant' and length(trim(content)) > 0 then msg_index end) is not null as answered, count(*) filter (coalesce(tool_error, false)) as errors from ev group by candidate_id)
select concat_ws(',', case when not coalesce(paired, true) then 'pairing' end, case when not answered then 'answer' end, case when errors > 0 then 'errors' end) as reasons, count(*) as trajectories from c left join o using (candidate_id) group by 1"""

QUERIES = {f.__name__: (f, globals()[f.__name__.upper()]) for f in (
    located_amounts, entity_overlap, run_details, card_summary, variance_gates, label_steps, preflight, holdout_inputs, dataset_rows, task_summaries, located_writes, merged_aliases, call_arrays, arm_rows, project_summary, benchmark_verdicts)}
