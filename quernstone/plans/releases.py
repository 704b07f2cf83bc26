"""Queries over contracts, releases, splits and replayed states, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.functions import text
from quernstone.operators import diff, governance, matching
from quernstone.operators import trajectory as t
from quernstone.plans.differences import P6_FOUND
from quernstone.plans.governing import CLEAN, DECIDED, PAIRED, VOTES, _decided, _paired, _votes
from quernstone.plans.trajectories import IS_WRITE, RESULTS, TRIALS, _events, _trials
from quernstone.runtime import read

# Labels, splits and dispositions of the contracts.
SPLITS = ("TRAIN", "VALIDATION", "TEST")
QUALITY_LABELS = ("RAW_GOLD", "CORRECTION_REQUIRED", "HOLDOUT", "SEGMENT_REQUIRED")
RELEASED = ("RAW_POSITIVE", "CORRECTED_POSITIVE")
SHA = "^[0-9A-F]{64}$"

CANDIDATES = f"""held as (select candidate_id, task_id, status, quality_label, disposition, {CLEAN.format(c='split')} as split, {CLEAN.format(c='source_split')} as source_split, source_path, source_sha256, group_ids, rationale from
  (select *, row_number() over (partition by candidate_id order by decided_at desc, ingested_at desc) as rn from candidate_decisions where candidate_id is not null) where rn = 1)"""


def _held(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = ["task_id", "status", "quality_label", "disposition", "split", "source_split", "source_path", "source_sha256", "group_ids", "rationale"]
    d = governance.latest(read(spark, sf_dir, "candidate_decisions"), "candidate_id", values=values)
    return d.withColumns({"split": governance.clean_label("split"), "source_split": governance.clean_label("source_split")})


def deficit_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thirty tasks by disposition: a place each, then always to the largest deficit, by seeded hash order within."""
    d = _decided(spark, sf_dir).select("task_id", F.coalesce("disposition", F.lit("(none)")).alias("disposition"))
    return governance.largest_deficit_split(d, "task_id", "disposition", 30, "7").where("picked").select("task_id", "disposition")


DEFICIT_SPLIT = f"""with {DECIDED}, d as (select task_id, coalesce(disposition, '(none)') as s from decided), z as (select s, count(*) as size, 30 * count(*) / sum(count(*)) over () as ideal, count(*) over () as strata from d group by s),
 p as (select s, size, ideal, strata, unnest(range(case when strata <= 30 then 1 else 0 end, size)) as given from z),
 w as (select s, row_number() over (order by ideal - given desc, size - given desc, s desc) as n, strata from p), q as (select z.s, (z.strata <= 30)::int + count(w.n) filter (w.n <= 30 - (z.strata <= 30)::int * z.strata) as quota from z left join w on w.s = z.s group by z.s, z.strata),
 r as (select task_id, s, row_number() over (partition by s order by sha256('7:' || task_id), task_id) as rank from d) select task_id, s as disposition from r join q using (s) where rank <= quota"""


def nested_subsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested shares of the training tasks in hash order, with steps in proportion to their rows."""
    d = _decided(spark, sf_dir).where("split = 'TRAIN'").select("task_id", F.lit("all").alias("stratum"))
    ranked = governance.rank_in_stratum(d, "task_id", "stratum", "11")
    share = F.explode(F.array(*[F.lit(x) for x in (0.25, 0.5, 0.75, 1.0)])).alias("share")
    rows = ranked.select("task_id", "rank", "size", share).where(F.col("rank") <= F.ceil(F.col("size") * F.col("share")))
    return rows.groupBy("share").agg(F.count("*").alias("tasks"), F.bround(F.first(F.lit(120)) * F.count("*") / F.max("size")).cast("bigint").alias("steps"), F.sha2(F.min("task_id"), 256).alias("first_digest"))


NESTED_SUBSETS = f"""with {DECIDED}, r as (select task_id, row_number() over (order by sha256('11:' || task_id), task_id) as rank, count(*) over () as size from decided where split = 'TRAIN'), s(share) as (values (0.25::double), (0.5), (0.75), (1.0))
select share, count(*) as tasks, round_even(120 * count(*) / max(size), 0)::bigint as steps, sha256(min(task_id)) as first_digest from r, s where rank <= ceil(size * share) group by share"""


def split_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each two splits the tasks and the sources that stand in both."""
    held = _held(spark, sf_dir).where("split is not null")
    keys = held.select("split", F.explode(F.array(F.struct(F.lit("task").alias("kind"), F.col("task_id").alias("value")), F.struct(F.lit("source").alias("kind"), F.col("source_sha256").alias("value")))).alias("k"))
    keys = keys.select("split", "k.kind", "k.value").where("value is not null").groupBy("kind", "value").agg(F.array_sort(F.collect_set("split")).alias("splits"))  # at most one entry a split
    pairs = F.flatten(F.transform("splits", lambda a: F.transform(F.filter("splits", lambda b: b > a), lambda b: F.concat_ws("+", a, b))))
    return keys.select("kind", F.explode(pairs).alias("splits")).groupBy("kind", "splits").agg(F.count("*").alias("shared"))


SPLIT_OVERLAPS = f"""with {CANDIDATES}, k as (select distinct split, 'task' as kind, task_id as value from held where split is not null and task_id is not null union select distinct split, 'source', source_sha256 from held where split is not null and source_sha256 is not null)
select a.kind, a.split || '+' || b.split as splits, count(*) as shared from k a join k b on a.kind = b.kind and a.value = b.value and a.split < b.split group by all"""


def prompt_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation tasks whose id, or whose normalised prompt, is one of training, in one row."""
    held = _held(spark, sf_dir).where("task_id is not null")
    prompts = read(spark, sf_dir, "task_definitions").where("task_id is not null").groupBy("task_id").agg(F.max(text.alnum(F.concat_ws(" ", "reason_for_call", "task_instructions"))).alias("prompt"))
    sides = held.groupBy("task_id").agg((F.count_if(F.col("split") == "TRAIN") > 0).alias("train"), (F.count_if(F.col("split") == "VALIDATION") > 0).alias("evaluation")).join(prompts, "task_id", "left")
    seen = sides.where("train and prompt is not null").select("prompt").distinct().withColumn("known", F.lit(True))
    e = sides.where("evaluation").join(seen, "prompt", "left")
    return e.agg(F.count("*").alias("evaluation_tasks"), F.count_if("train").alias("same_id"), F.count_if(F.coalesce("known", F.lit(False))).alias("same_prompt"))


PROMPT_LEAKAGE = f"""with {CANDIDATES}, p as (select task_id, max(regexp_replace(lower(concat_ws(' ', reason_for_call, task_instructions)), '[^a-z0-9]+', '', 'g')) as prompt from task_definitions where task_id is not null group by task_id),
 s as (select task_id, bool_or(coalesce(split = 'TRAIN', false)) as train, bool_or(coalesce(split = 'VALIDATION', false)) as evaluation from held where task_id is not null group by task_id), j as (select * from s left join p using (task_id))
select count(*) as evaluation_tasks, count(*) filter (train) as same_id, count(*) filter (prompt in (select prompt from j where train and prompt is not null)) as same_prompt from j where evaluation"""


def shard_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of the union of all deliveries as shards, by day: candidates in several days, sources of several candidates."""
    d = read(spark, sf_dir, "candidate_decisions").where("candidate_id is not null").select("candidate_id", "source_sha256", F.to_date("decided_at").alias("shard"))
    several = d.groupBy("candidate_id").agg(F.countDistinct("shard").alias("n")).where("n > 1").agg(F.lit("candidate_in_shards").alias("fault"), F.count("*").alias("n"))
    sources = d.where("source_sha256 is not null").groupBy("source_sha256").agg(F.countDistinct("candidate_id").alias("n")).where("n > 1").agg(F.lit("source_of_candidates").alias("fault"), F.count("*").alias("n"))
    return several.unionByName(sources)


SHARD_CONFLICTS = """with d as (select candidate_id, source_sha256, decided_at::date as shard from candidate_decisions where candidate_id is not null)
select 'candidate_in_shards' as fault, count(*) as n from (select candidate_id from d group by 1 having count(distinct shard) > 1) union all select 'source_of_candidates', count(*) from (select source_sha256 from d where source_sha256 is not null group by 1 having count(distinct candidate_id) > 1)"""


def run_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs of the same tasks must cover each other: tasks that only one of the first two trials has, and the verdict."""
    tr = _trials(spark, sf_dir).where("nth <= 2")
    sides = tr.groupBy("task_id").agg(F.count_if(F.col("nth") == 1).alias("a"), F.count_if(F.col("nth") == 2).alias("b"))
    out = sides.agg(F.count_if(F.expr("a > 0 and b > 0")).alias("paired"), F.count_if(F.expr("b = 0")).alias("only_first"), F.count_if(F.expr("a = 0")).alias("only_second"))
    return out.withColumn("covered", F.expr("only_first = 0 and only_second = 0"))


RUN_COVER = f"with {TRIALS}, s as (select task_id, count(*) filter (nth = 1) as a, count(*) filter (nth = 2) as b from trials group by 1) select count(*) filter (a > 0 and b > 0) as paired, count(*) filter (b = 0) as only_first, count(*) filter (a = 0) as only_second, count(*) filter (b = 0 or a = 0) = 0 as covered from s"


def gold_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broken rules of the votes that hold, counted by reason: evidence there and inside its packet."""
    v = _votes(spark, sf_dir)
    files = F.coalesce("evidence_files", F.array().cast("array<string>"))
    rules = {"evidence": F.size(files) > 0, "inside": F.forall(files, lambda f: ~F.coalesce(text.escapes(f), F.lit(True))), "reviewed": F.col("reviewed_at").isNotNull()}
    bad = governance.violations(v.withColumn("key", F.concat_ws("/", "task_id", "reviewer")), "key", rules)
    return bad.groupBy("reasons").agg(F.count("*").alias("votes"))


GOLD_CONTRACT = f"""with {VOTES}, r as (select concat_ws(',', case when len(coalesce(evidence_files, [])) = 0 then 'evidence' end,
  case when len([f for f in coalesce(evidence_files, []) if f is null or regexp_matches(f, '^([/\\\\]|[A-Za-z]:)|(^|[/\\\\])\\.\\.([/\\\\]|$)')]) > 0 then 'inside' end, case when reviewed_at is null then 'reviewed' end) as reasons from votes)
select reasons, count(*) as votes from r where reasons <> '' group by reasons"""


def quality_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broken rules of quality reviews, counted by reason; RAW_GOLD needs a last vote of PASS on its task."""
    gold = _paired(spark, sf_dir).select("task_id", "gold")
    q = read(spark, sf_dir, "quality_reviews").withColumns({"label": governance.clean_label("quality_label"), "reviewer": F.lower(F.regexp_replace("reviewer_id", r"^\s+|\s+$", ""))}).join(gold, "task_id", "left")
    rules = {"task": F.col("task_id").isNotNull(), "label": F.col("label").isin(*QUALITY_LABELS), "reviewer": F.col("reviewer") != "", "gold": (F.coalesce("label", F.lit("")) != "RAW_GOLD") | F.coalesce(F.col("gold") == "PASS", F.lit(False))}
    return governance.violations(q, "task_id", rules).groupBy("reasons").agg(F.count("*").alias("reviews"))


QUALITY_CONTRACT = f"""with {PAIRED}, q as (select r.task_id, {CLEAN.format(c='quality_label')} as label, lower(regexp_replace(reviewer_id, '^\\s+|\\s+$', '', 'g')) as reviewer, gold from quality_reviews r left join paired using (task_id)),
 b as (select concat_ws(',', case when task_id is null then 'task' end, case when not coalesce(label in ('RAW_GOLD', 'CORRECTION_REQUIRED', 'HOLDOUT', 'SEGMENT_REQUIRED'), false) then 'label' end, case when not coalesce(reviewer <> '', false) then 'reviewer' end,
  case when label = 'RAW_GOLD' and not coalesce(gold = 'PASS', false) then 'gold' end) as reasons from q) select reasons, count(*) as reviews from b where reasons <> '' group by reasons"""


def candidate_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broken rules of the candidate decisions that hold, counted by reason."""
    h = _held(spark, sf_dir)
    entries = F.filter(F.coalesce("group_ids", F.array().cast("array<string>")), lambda g: F.trim(g) != "")
    rules = {"task": F.col("task_id").isNotNull(), "digest": F.rlike("source_sha256", F.lit(SHA)), "path": F.contains("source_path", F.col("candidate_id")) & ~text.escapes("source_path"), "groups": F.size(entries) > 0,
             "split": F.col("split").isNull() | F.col("split").isin(*SPLITS), "rationale": F.length(F.trim("rationale")) > 0, "held": (F.coalesce("disposition", F.lit("")) != "HOLDOUT") | F.col("split").isNull()}
    return governance.violations(h, "candidate_id", rules).groupBy("reasons").agg(F.count("*").alias("candidates"))


CANDIDATE_CONTRACT = f"""with {CANDIDATES}, b as (select concat_ws(',', case when task_id is null then 'task' end, case when not coalesce(regexp_matches(source_sha256, '{SHA}'), false) then 'digest' end, case when not coalesce(contains(source_path, candidate_id), false) then 'path' end,
  case when len([g for g in coalesce(group_ids, []) if trim(g) <> '']) = 0 then 'groups' end, case when split is not null and split not in ('TRAIN', 'VALIDATION', 'TEST') then 'split' end, case when not coalesce(length(trim(rationale)) > 0, false) then 'rationale' end,
  case when disposition = 'HOLDOUT' and split is not null then 'held' end) as reasons from held) select reasons, count(*) as candidates from b where reasons <> '' group by reasons"""


def independent_approvals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks by the number of reviewers, and of those that pass them: approved by two or more and failed by none."""
    per = _votes(spark, sf_dir).groupBy("task_id").agg(F.count("*").alias("reviewers"), F.count_if(F.col("label") == "PASS").alias("passes"), F.count_if(F.col("label") == "FAIL").alias("fails"))
    verdict = F.when(F.col("reviewers") == 1, "SINGLE_REVIEWER").when(F.expr("passes >= 2 and fails = 0"), "APPROVED").otherwise("OPEN")
    return per.groupBy(verdict.alias("verdict")).agg(F.count("*").alias("tasks"), F.sum("reviewers").alias("reviews"))


INDEPENDENT_APPROVALS = f"""with {VOTES}, p as (select task_id, count(*) as reviewers, count(*) filter (label = 'PASS') as passes, count(*) filter (label = 'FAIL') as fails from votes group by task_id)
select case when reviewers = 1 then 'SINGLE_REVIEWER' when passes >= 2 and fails = 0 then 'APPROVED' else 'OPEN' end as verdict, count(*) as tasks, sum(reviewers)::bigint as reviews from p group by 1"""


def decision_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions put together from reviews, quality reviews and splits, with what each task lacks or has in excess."""
    d = _decided(spark, sf_dir).select("task_id", "disposition", "split").withColumn("decided", F.lit(True))
    v = _votes(spark, sf_dir).select("task_id").distinct().withColumn("reviewed", F.lit(True))
    q = _paired(spark, sf_dir).select("task_id", "predicted")
    known = read(spark, sf_dir, "task_definitions").where("task_id is not null").select("task_id").distinct().withColumn("known", F.lit(True))
    both = known.join(d, "task_id", "full_outer").join(v, "task_id", "full_outer").join(q, "task_id", "full_outer")
    lacks = {"definition": F.col("known").isNull(), "decision": F.col("decided").isNull(), "review": F.col("reviewed").isNull(), "quality": F.col("predicted").isNull(), "split": F.col("decided").isNotNull() & F.col("disposition").isin(*RELEASED) & F.col("split").isNull()}
    reasons = F.array_join(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in lacks.items()])), ",")
    return both.groupBy(reasons.alias("lacks")).agg(F.count("*").alias("tasks"))


DECISION_ASSEMBLY = f"""with {DECIDED}, {PAIRED}, k as (select distinct task_id, true as known from task_definitions where task_id is not null), v as (select distinct task_id, true as reviewed from votes), d as (select task_id, disposition, split, true as decided from decided),
 b as (select * from k full join d using (task_id) full join v using (task_id) full join (select task_id, predicted from paired) using (task_id))
select concat_ws(',', case when known is null then 'definition' end, case when decided is null then 'decision' end, case when reviewed is null then 'review' end, case when predicted is null then 'quality' end,
 case when decided and disposition in ('RAW_POSITIVE', 'CORRECTED_POSITIVE') and split is null then 'split' end) as lacks, count(*) as tasks from b group by 1"""


def evidence_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests that candidates name for a task's source against the decisions' manifest, by outcome."""
    m = _decided(spark, sf_dir).select("task_id", F.col("source_sha256").alias("manifest"))
    j = _held(spark, sf_dir).where("task_id is not null").join(m, "task_id", "left")
    outcome = F.when(F.col("manifest").isNull(), "NOT_LISTED").when(F.upper("source_sha256") == F.upper("manifest"), "EQUAL").otherwise("DIFFERENT")
    return j.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("candidates"), F.countDistinct("task_id").alias("tasks"))


EVIDENCE_HASHES = f"""with {DECIDED}, {CANDIDATES}, j as (select held.task_id, held.source_sha256, d.source_sha256 as manifest from held left join decided d using (task_id) where held.task_id is not null)
select case when manifest is null then 'NOT_LISTED' when upper(source_sha256) = upper(manifest) then 'EQUAL' else 'DIFFERENT' end as outcome, count(*) as candidates, count(distinct task_id) as tasks from j group by 1"""


def proposal_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources by path: those bound to one digest, and those bound to several."""
    d = read(spark, sf_dir, "candidate_decisions").where("source_path is not null").groupBy("source_path").agg(F.countDistinct("source_sha256").alias("digests"), F.count("*").alias("rows"))
    return d.groupBy(F.when(F.col("digests") == 1, "BOUND").when(F.col("digests") == 0, "UNBOUND").otherwise("CONFLICT").alias("state")).agg(F.count("*").alias("paths"), F.sum("rows").alias("rows"))


PROPOSAL_INDEX = """with d as (select source_path, count(distinct source_sha256) as digests, count(*) as rows from candidate_decisions where source_path is not null group by 1)
select case when digests = 1 then 'BOUND' when digests = 0 then 'UNBOUND' else 'CONFLICT' end as state, count(*) as paths, sum(rows)::bigint as rows from d group by 1"""


def _release_rules() -> dict:
    return {"digest": F.rlike("source_sha256", F.lit(SHA)), "split": F.col("split").isin("TRAIN", "VALIDATION"), "groups": F.size(F.filter(F.coalesce("group_ids", F.array().cast("array<string>")), lambda g: F.trim(g) != "")) > 0}


def sft_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a release would hold: all positives if each keeps the rules, else none; and the positives that block it."""
    d = _decided(spark, sf_dir).where(F.col("disposition").isin(*RELEASED))
    blocked = governance.violations(d, "task_id", _release_rules()).agg(F.count("*").alias("blocking"))
    released = governance.gate(d, "task_id", _release_rules()).agg(F.count("*").alias("released"), F.count_if(F.col("split") == "TRAIN").alias("train"))
    return d.agg(F.count("*").alias("positives")).crossJoin(blocked).crossJoin(released)  # a row each


SFT_RELEASE = f"""with {DECIDED}, d as (select *, coalesce(regexp_matches(source_sha256, '{SHA}'), false) and coalesce(split in ('TRAIN', 'VALIDATION'), false) and len([g for g in coalesce(group_ids, []) if trim(g) <> '']) > 0 as ok from decided where disposition in ('RAW_POSITIVE', 'CORRECTED_POSITIVE')),
 b as (select count(*) filter (not ok) as blocking from d) select count(*) as positives, (select blocking from b) as blocking, case when (select blocking from b) = 0 then count(*) else 0 end as released, case when (select blocking from b) = 0 then count(*) filter (split = 'TRAIN') else 0 end as train from d"""


def candidate_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Releasable candidates by split: those that keep the rules and whose group entries stay within their split."""
    h = _held(spark, sf_dir).where(F.col("disposition").isin(*RELEASED) & F.col("task_id").isNotNull())
    bad = governance.violations(h, "candidate_id", _release_rules()).select("candidate_id")
    leaking = governance.group_leakage(h.where("split is not null"), "candidate_id", "group_ids", "split").select("entry")
    torn = governance.group_entries(h, "candidate_id", "group_ids").join(leaking, "entry", "left_semi").select("candidate_id").distinct()
    out = h.join(bad.withColumn("bad", F.lit(True)), "candidate_id", "left").join(torn.withColumn("torn", F.lit(True)), "candidate_id", "left")
    return out.groupBy(F.coalesce("split", F.lit("(none)")).alias("split")).agg(F.count("*").alias("candidates"), F.count("bad").alias("broken"), F.count("torn").alias("torn"), F.count_if(F.col("bad").isNull() & F.col("torn").isNull()).alias("releasable"))


CANDIDATE_RELEASE = f"""with {CANDIDATES}, h as (select *, not (coalesce(regexp_matches(source_sha256, '{SHA}'), false) and coalesce(split in ('TRAIN', 'VALIDATION'), false) and len([g for g in coalesce(group_ids, []) if trim(g) <> '']) > 0) as bad
  from held where disposition in ('RAW_POSITIVE', 'CORRECTED_POSITIVE') and task_id is not null),
 e as (select distinct candidate_id, split, regexp_replace(g, '^\\s+|\\s+$', '', 'g') as entry from (select candidate_id, split, unnest(group_ids) as g from h)), l as (select entry from e where entry <> '' and split is not null group by entry having count(distinct split) > 1),
 torn as (select distinct candidate_id, true as torn from e semi join l using (entry)), j as (select * from h left join torn using (candidate_id))
select coalesce(split, '(none)') as split, count(*) as candidates, count(*) filter (bad) as broken, count(torn) as torn, count(*) filter (not bad and torn is null) as releasable from j group by 1"""


def stage_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stages of training, each ready if its own condition and those of all stages before it hold, with the reasons so far."""
    d = _decided(spark, sf_dir)
    tr = _trials(spark, sf_dir).groupBy("task_id").agg(F.bool_or("success").alias("some"), F.bool_and("success").alias("every"))
    n = d.agg(F.count_if(F.expr("split = 'TRAIN' and disposition <> 'HOLDOUT'")).alias("train"), F.count_if(F.expr("split = 'VALIDATION'")).alias("validation"), F.count_if(F.expr("disposition = 'HOLDOUT'")).alias("holdout")).crossJoin(tr.agg(F.count_if(F.expr("some and not every")).alias("contrast")))
    checks = [("1_sft", "no_training_rows", F.col("train") > 0), ("2_eval", "few_validation_rows", F.col("validation") >= 100), ("3_dpo", "few_contrasts", F.col("contrast") >= 10), ("4_rl", "small_holdout", F.col("holdout") >= 1_000)]
    reasons, stages = [], []
    for stage, reason, ok in checks:
        reasons.append(F.when(~ok, F.lit(reason)))
        listed = F.array_compact(F.array(*reasons))
        stages.append(F.struct(F.lit(stage).alias("stage"), (F.size(listed) == 0).alias("ready"), F.array_join(listed, ",").alias("reasons")))
    return n.select(F.explode(F.array(*stages)).alias("s")).select("s.*")


STAGE_READINESS = f"""with {DECIDED}, {TRIALS}, c as (select task_id, bool_or(success) as any_good, bool_and(success) as every from trials group by task_id),
 n as (select count(*) filter (split = 'TRAIN' and disposition <> 'HOLDOUT') as train, count(*) filter (split = 'VALIDATION') as validation, count(*) filter (disposition = 'HOLDOUT') as holdout, (select count(*) filter (any_good and not every) from c) as contrast from decided),
 r as (select case when train = 0 then 'no_training_rows' end as a, case when validation < 100 then 'few_validation_rows' end as b, case when contrast < 10 then 'few_contrasts' end as c, case when holdout < 1000 then 'small_holdout' end as d from n),
 s as (select '1_sft' as stage, concat_ws(',', a) as reasons from r union all select '2_eval', concat_ws(',', a, b) from r union all select '3_dpo', concat_ws(',', a, b, c) from r union all select '4_rl', concat_ws(',', a, b, c, d) from r)
select stage, reasons = '' as ready, reasons from s"""


def completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defined tasks that each table of decisions and reviews lacks, and whether any lacks none."""
    known = read(spark, sf_dir, "task_definitions")
    out = None
    for table in ("quality_decisions", "review_decisions", "quality_reviews", "replay_results", "candidate_decisions"):
        missing = matching.coverage(known, read(spark, sf_dir, table), "task_id").where("side = 'missing'").agg(F.lit(table).alias("table_name"), F.count("*").alias("missing"))
        out = missing if out is None else out.unionByName(missing)
    return out.withColumn("complete", F.col("missing") == 0)


COMPLETENESS = " union all ".join(f"select '{x}' as table_name, count(*) as missing, count(*) = 0 as complete from (select distinct task_id from task_definitions where task_id is not null except select task_id from {x})" for x in ("quality_decisions", "review_decisions", "quality_reviews", "replay_results", "candidate_decisions"))


def blind_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes without their labels and reviewers, for a second review: what was looked at, and its digest."""
    v = _votes(spark, sf_dir)
    files = F.array_join(F.array_sort(F.coalesce("evidence_files", F.array().cast("array<string>"))), "|")
    return v.select("task_id", F.sha2(F.concat_ws("/", "task_id", "reviewer"), 256).alias("packet"), F.upper(F.sha2(files, 256)).alias("evidence_sha256"))


BLIND_PACKETS = f"with {VOTES} select task_id, sha256(task_id || '/' || reviewer) as packet, upper(sha256(array_to_string(list_sort(coalesce(evidence_files, [])), '|'))) as evidence_sha256 from votes"


def state_field_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of orders and users that differ between the two states: replays, entities and differences per field."""
    d = diff.diff_states(read(spark, sf_dir, "replay_results"))
    parts = F.split("path", r"\.")
    rows = d.where(F.size(parts) >= 3).select("replay_id", parts[1].alias("entity"), parts[2].alias("entity_id"), F.coalesce(F.get(parts, F.lit(3)), F.lit("(itself)")).alias("field"))
    return rows.groupBy("entity", "field").agg(F.countDistinct("replay_id").alias("replays"), F.countDistinct("replay_id", "entity_id").alias("entities"), F.count("*").alias("differences"))


def replay_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replays by the recorded match, the recorded hashes and the states as they are: a reward is kept where all agree."""
    r = read(spark, sf_dir, "replay_results").where("replay_id is not null")
    last = governance.latest(r, "replay_id", at="replayed_at", values=["db_match", "gold_hash", "agent_hash", "agent_state", "gold_state"])
    found = diff.diff_states(r).select("replay_id").distinct().withColumn("differs", F.lit(True))
    j = last.join(found, "replay_id", "left")
    hashes = F.when(F.col("gold_hash").isNull() | F.col("agent_hash").isNull(), "UNKNOWN").when(F.col("gold_hash") == F.col("agent_hash"), "EQUAL").otherwise("DIFFERENT")
    return j.groupBy(F.coalesce(F.col("db_match").cast("string"), F.lit("unknown")).alias("recorded"), hashes.alias("hashes"), F.coalesce("differs", F.lit(False)).alias("differs")).agg(F.count("*").alias("replays"))


def review_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defined tasks by verdict: FAIL by any failing vote, REVIEW by any other doubt, PASS without any finding, those without votes kept."""
    known = read(spark, sf_dir, "task_definitions").where("task_id is not null").select("task_id").distinct()
    per = _votes(spark, sf_dir).groupBy("task_id").agg(F.bool_or(F.col("label") == "FAIL").alias("major"), F.bool_or(F.col("label") == "REVIEW").alias("minor"))
    verdict = F.when(F.col("major"), "FAIL").when(F.col("minor"), "REVIEW").otherwise("PASS")
    return known.join(per, "task_id", "left").groupBy(verdict.alias("verdict")).agg(F.count("*").alias("tasks"), F.count_if(F.col("major").isNull()).alias("without_votes"))


REVIEW_VERDICTS = f"""with {VOTES}, k as (select distinct task_id from task_definitions where task_id is not null), p as (select task_id, bool_or(label = 'FAIL') as major, bool_or(label = 'REVIEW') as minor from votes group by task_id)
select case when major then 'FAIL' when minor then 'REVIEW' else 'PASS' end as verdict, count(*) as tasks, count(*) filter (major is null) as without_votes from k left join p using (task_id) group by 1"""


def verifier_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts against gold labels: correct and wrong ones by verdict, and their share of all."""
    p = _paired(spark, sf_dir)
    return p.groupBy("predicted").agg(F.count("*").alias("n"), F.count_if(F.col("predicted") == F.col("gold")).alias("correct"), F.round(F.avg((F.col("predicted") == F.col("gold")).cast("int")), 3).alias("accuracy"))


VERIFIER_ACCURACY = f"with {PAIRED} select predicted, count(*) as n, count(*) filter (predicted = gold) as correct, round(avg((predicted = gold)::int), 3) as accuracy from paired group by 1"


def dataset_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trajectories labelled for a verifier: 1 without a failed call, else the kind of their first failure."""
    rows = t.call_results(_events(spark, sf_dir))
    first = F.min_by(F.when(F.col("is_error"), t.error_kind(F.col("name"), F.col("result"))), F.when(F.col("is_error"), F.struct("msg_index", "pos")))
    per = rows.groupBy("candidate_id").agg(first.alias("kind"))
    return per.groupBy(F.coalesce("kind", F.lit("none")).alias("failure_type"), F.col("kind").isNull().cast("int").alias("label")).agg(F.count("*").alias("trajectories"))


def holdout_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gates of a holdout: whether precision, recall and abstention keep their thresholds, and all of them."""
    p = _paired(spark, sf_dir)
    c = p.agg(F.count_if(F.expr("predicted = 'FAIL' and gold = 'FAIL'")).alias("tp"), F.count_if(F.expr("predicted = 'FAIL'")).alias("found"), F.count_if(F.expr("gold = 'FAIL'")).alias("real"), F.count_if(F.expr("predicted = 'REVIEW'")).alias("open"), F.count("*").alias("n"))
    g = c.select(F.coalesce(F.try_divide("tp", "found") >= 0.95, F.lit(False)).alias("precise"), F.coalesce(F.try_divide("tp", "real") >= 0.9, F.lit(False)).alias("complete"), F.coalesce(F.try_divide("open", "n") <= 0.2, F.lit(False)).alias("decided"))
    return g.withColumn("passed", F.expr("precise and complete and decided"))


HOLDOUT_GATES = f"""with {PAIRED}, c as (select count(*) filter (predicted = 'FAIL' and gold = 'FAIL') as tp, count(*) filter (predicted = 'FAIL') as found, count(*) filter (gold = 'FAIL') as real, count(*) filter (predicted = 'REVIEW') as open, count(*) as n from paired),
 g as (select coalesce(tp / nullif(found, 0) >= 0.95, false) as precise, coalesce(tp / nullif(real, 0) >= 0.9, false) as complete, coalesce(open / nullif(n, 0) <= 0.2, false) as decided from c) select *, precise and complete and decided as passed from g"""


def scenario_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated rows: each disposition's case in each wording, and modes that take turns, with digests as ids."""
    cases = _decided(spark, sf_dir).where("disposition is not null").select("disposition").distinct()
    wordings = spark.createDataFrame([(i, w) for i, w in enumerate(("Please explain {case}.", "What becomes of {case}?", "Keep {case} as it is."))], "wording int, template string")  # a few rows
    rows = cases.crossJoin(F.broadcast(wordings)).select("disposition", "wording", text.fill("template", {"case": F.lower("disposition")}).alias("prompt"))
    return rows.withColumns({"mode": F.element_at(F.array(F.lit("single"), F.lit("multi")), F.col("wording") % 2 + 1), "row_id": F.left(F.sha2("prompt", 256), F.lit(12))})


SCENARIO_ROWS = f"""with {DECIDED}, c as (select distinct disposition from decided where disposition is not null), w(wording, template) as (values (0, 'Please explain {{case}}.'), (1, 'What becomes of {{case}}?'), (2, 'Keep {{case}} as it is.')),
 r as (select disposition, wording, replace(template, '{{case}}', lower(disposition)) as prompt from c, w) select *, case when wording % 2 = 0 then 'single' else 'multi' end as mode, left(sha256(prompt), 12) as row_id from r"""


def hit_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scanner hits by category as spelled in upper case: how many stand on tool turns, on average."""
    h = read(spark, sf_dir, "pii_hits").dropDuplicates(["hit_id"])
    return h.groupBy(F.coalesce(governance.clean_label("category"), F.lit("(none)")).alias("category")).agg(F.count("*").alias("hits"), F.round(F.sum(F.col("on_tool_turn").cast("int")) / F.count("*"), 3).alias("on_tool_turns"))


HIT_SCORES = f"""with h as (select * from (select *, row_number() over (partition by hit_id order by scanned_at) as rn from pii_hits) where rn = 1) select coalesce({CLEAN.format(c='category')}, '(none)') as category, count(*) as hits, round(sum(on_tool_turn::int) / count(*), 3) as on_tool_turns from h group by 1"""


def weighted_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token-weighted mean of recorded losses and its perplexity by kind of document; the loss recorded here is a function of the text's length."""
    d = read(spark, sf_dir, "documents").where("n_chars > 0").withColumn("nll", F.log1p("n_chars") * F.col("n_chars"))
    return d.groupBy("doc_kind").agg(F.round(F.try_divide(F.sum("nll"), F.sum("n_chars")), 6).alias("loss"), F.round(F.exp(F.try_divide(F.sum("nll"), F.sum("n_chars"))), 3).alias("perplexity"))


WEIGHTED_LOSS = "select doc_kind, round(sum(ln(1 + n_chars) * n_chars) / sum(n_chars), 6) as loss, round(exp(sum(ln(1 + n_chars) * n_chars) / sum(n_chars)), 3) as perplexity from documents where n_chars > 0 group by 1"


STATE_FIELD_CHANGES = f"""with d as ({P6_FOUND}), p as (select replay_id, string_split(path, '.') as x from d) select x[2] as entity, coalesce(x[4], '(itself)') as field, count(distinct replay_id) as replays, count(distinct (replay_id, x[3])) as entities, count(*) as differences from p where len(x) >= 3 group by 1, 2"""
REPLAY_CONSISTENCY = f"""with d as (select distinct replay_id from ({P6_FOUND})), l as (select * from (select *, row_number() over (partition by replay_id order by replayed_at desc, ingested_at desc) as rn from replay_results where replay_id is not null) where rn = 1)
select coalesce(db_match::varchar, 'unknown') as recorded, case when gold_hash is null or agent_hash is null then 'UNKNOWN' when gold_hash = agent_hash then 'EQUAL' else 'DIFFERENT' end as hashes, replay_id in (select replay_id from d) as differs, count(*) as replays from l group by all"""
ERROR_KIND = f"case when name like 'find\\_user%' escape '\\' and lower(coalesce(result, '')) like '%user not found%' then 'AUTH_LOOKUP_MISS' when {IS_WRITE} then 'WRITE_TOOL_ERROR' else 'READ_TOOL_ERROR' end"
DATASET_LABELS = f"with {RESULTS}, p as (select candidate_id, arg_min({ERROR_KIND}, (msg_index, pos)) filter (is_error) as kind from joined group by candidate_id) select coalesce(kind, 'none') as failure_type, (kind is null)::int as label, count(*) as trajectories from p group by all"

QUERIES = {f.__name__: (f, globals()[f.__name__.upper()]) for f in (
    deficit_split, nested_subsets, split_overlaps, prompt_leakage, shard_conflicts, run_cover, gold_contract, quality_contract, candidate_contract, independent_approvals, decision_assembly, evidence_hashes, proposal_index, sft_release,
    candidate_release, stage_readiness, completeness, blind_packets, state_field_changes, replay_consistency, review_verdicts, verifier_accuracy, dataset_labels, holdout_gates, scenario_rows, hit_scores, weighted_loss)}
