"""Queries over reviews, decisions, splits and replays, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernstone.operators import diff, governance, matching, metrics
from quernstone.runtime import read

# The valid labels of reviews.
LABELS = ["PASS", "FAIL", "REVIEW"]

CLEAN = "nullif(upper(regexp_replace({c}, '^\\s+|\\s+$', '', 'g')), '')"
VOTES = f"""votes as (select task_id, reviewer, label, reviewed_at, evidence_files from (select task_id, lower(regexp_replace(reviewer_id, '^\\s+|\\s+$', '', 'g')) as reviewer, {CLEAN.format(c='label')} as label, reviewed_at, evidence_files,
  row_number() over (partition by task_id, lower(regexp_replace(reviewer_id, '^\\s+|\\s+$', '', 'g')) order by reviewed_at desc, ingested_at desc) as rn from review_decisions
  where task_id is not null and regexp_replace(reviewer_id, '^\\s+|\\s+$', '', 'g') <> '' and {CLEAN.format(c='label')} in ('PASS', 'FAIL', 'REVIEW')) where rn = 1)"""
QUALITY = f"""quality as (select task_id, label as quality_label from (select task_id, {CLEAN.format(c='quality_label')} as label, row_number() over (partition by task_id order by reviewed_at desc, ingested_at desc) as rn from quality_reviews
  where task_id is not null and {CLEAN.format(c='quality_label')} in ('RAW_GOLD', 'CORRECTION_REQUIRED', 'HOLDOUT', 'SEGMENT_REQUIRED')) where rn = 1)"""
PAIRED = f"""{VOTES}, {QUALITY}, gold as (select task_id, label as gold from (select *, row_number() over (partition by task_id order by reviewed_at desc, reviewer desc) as rn from votes) where rn = 1),
 paired as (select task_id, gold, case quality_label when 'RAW_GOLD' then 'PASS' when 'CORRECTION_REQUIRED' then 'FAIL' else 'REVIEW' end as predicted from gold join quality using (task_id))"""
DECIDED = f"""decided as (select task_id, status, disposition, {CLEAN.format(c='split')} as split, {CLEAN.format(c='source_split')} as source_split, source_path, source_sha256, group_ids, decided_at from
  (select *, row_number() over (partition by task_id order by decided_at desc, ingested_at desc) as rn from quality_decisions where task_id is not null) where rn = 1)"""


def _votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = read(spark, sf_dir, "review_decisions").withColumns({"reviewer": F.lower(F.regexp_replace("reviewer_id", r"^\s+|\s+$", "")), "label": governance.clean_label("label")})
    r = r.where(F.col("task_id").isNotNull() & (F.col("reviewer") != "") & F.col("label").isin(LABELS))
    newest = F.max_by(F.struct("label", "evidence_files"), F.struct("reviewed_at", "ingested_at")).alias("v")
    return r.groupBy("task_id", "reviewer").agg(newest, F.max("reviewed_at").alias("reviewed_at")).select("task_id", "reviewer", F.col("v.label").alias("label"), F.col("v.evidence_files").alias("evidence_files"), "reviewed_at")


def _paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each task the last vote as gold label, and a verdict read off the last quality label."""
    gold = _votes(spark, sf_dir).groupBy("task_id").agg(F.max_by("label", F.struct("reviewed_at", "reviewer")).alias("gold"))
    q = read(spark, sf_dir, "quality_reviews").withColumn("quality_label", governance.clean_label("quality_label"))
    q = q.where(F.col("task_id").isNotNull() & F.col("quality_label").isin("RAW_GOLD", "CORRECTION_REQUIRED", "HOLDOUT", "SEGMENT_REQUIRED"))
    q = governance.latest(q, "task_id", "reviewed_at", "ingested_at", ["quality_label"])
    verdict = F.when(F.col("quality_label") == "RAW_GOLD", "PASS").when(F.col("quality_label") == "CORRECTION_REQUIRED", "FAIL").otherwise("REVIEW")
    return gold.join(q, "task_id").select("task_id", "gold", verdict.alias("predicted"))


def _decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = governance.latest(read(spark, sf_dir, "quality_decisions"), "task_id", values=["status", "disposition", "split", "source_split", "source_path", "source_sha256", "group_ids"])
    return d.withColumns({"split": governance.clean_label("split"), "source_split": governance.clean_label("source_split")})


def confusion_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.binary_confusion(_paired(spark, sf_dir), F.col("gold") == "FAIL", F.col("predicted") == "FAIL")


CONFUSION_BINARY = f"""with {PAIRED}, c as (select count(*) filter (gold = 'FAIL' and predicted = 'FAIL') as tp, count(*) filter (gold <> 'FAIL' and predicted = 'FAIL') as fp, count(*) filter (gold = 'FAIL' and predicted <> 'FAIL') as fn, count(*) filter (gold <> 'FAIL' and predicted <> 'FAIL') as tn from paired)
select tp, fp, fn, tn, coalesce(round((tp + tn) / nullif(tp + fp + fn + tn, 0), 6), 0) as accuracy, coalesce(round(tp / nullif(tp + fp, 0), 6), 0) as precision, coalesce(round(tp / nullif(tp + fn, 0), 6), 0) as recall,
 coalesce(round(tn / nullif(tn + fp, 0), 6), 0) as specificity, coalesce(round(2 * tp / nullif(2 * tp + fp + fn, 0), 6), 0) as f1 from c"""


def confusion_ternary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.ternary_matrix(_paired(spark, sf_dir), "gold", "predicted")


CONFUSION_TERNARY = f"""with {PAIRED} select gold, count(*) filter (predicted = 'PASS') as "PASS", count(*) filter (predicted = 'REVIEW') as "REVIEW", count(*) filter (predicted = 'FAIL') as "FAIL" from paired group by gold"""


def selective_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.selective(_paired(spark, sf_dir), "gold", "predicted")


SELECTIVE_METRICS = f"""with {PAIRED}, c as (select count(*) as rows, count(*) filter (gold = 'FAIL' and predicted = 'FAIL') as tp, count(*) filter (gold <> 'FAIL' and predicted = 'FAIL') as fp, count(*) filter (gold = 'FAIL') as fails, count(*) filter (predicted <> 'REVIEW') as acted,
 count(*) filter (predicted <> 'REVIEW' and predicted = gold) as acted_right, count(*) filter (gold = 'REVIEW') as reviews, count(*) filter (gold = 'REVIEW' and predicted = 'REVIEW') as reviews_found, count(*) filter (gold = 'PASS') as passes, count(*) filter (gold = 'PASS' and predicted = 'FAIL') as false_fails,
 count(*) filter (gold = 'REVIEW' and predicted = 'PASS') as auto_passed from paired)
select rows, round(tp / nullif(tp + fp, 0), 6) as fail_precision, round(tp / nullif(fails, 0), 6) as fail_recall, round(2 * tp / nullif(tp + fp + fails, 0), 6) as fail_f1, round(acted / nullif(rows, 0), 6) as coverage, round(acted_right / nullif(acted, 0), 6) as selective_accuracy,
 round(reviews_found / nullif(reviews, 0), 6) as review_recall, round(false_fails / nullif(passes, 0), 6) as false_fail_rate, round(auto_passed / nullif(reviews, 0), 6) as review_auto_pass from c"""


def two_reviewers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two reviewers of each task, whether they agree, and the resolver's label where they don't."""
    v = _votes(spark, sf_dir).withColumn("nth", F.row_number().over(Window.partitionBy("task_id").orderBy("reviewer")))
    a, b, c = (v.where(F.col("nth") == i).select("task_id", F.col("label").alias(n)) for i, n in ((1, "a"), (2, "b"), (3, "c")))
    both = a.join(b, "task_id").join(c, "task_id", "left")
    final = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.col("c"))
    return both.select("task_id", F.col("a").alias("first_label"), F.col("b").alias("second_label"), (F.col("a") != F.col("b")).alias("conflict"), final.alias("label"))


TWO_REVIEWERS = f"""with {VOTES}, n as (select *, row_number() over (partition by task_id order by reviewer) as nth from votes)
select a.task_id, a.label as first_label, b.label as second_label, a.label <> b.label as conflict, case when a.label = b.label then a.label else c.label end as label
from (select * from n where nth = 1) a join (select * from n where nth = 2) b using (task_id) left join (select * from n where nth = 3) c using (task_id)"""


def review_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governance.review_queue(_votes(spark, sf_dir))


REVIEW_PRIORITY = f"""with {VOTES}, p as (select task_id, list_sort(list(distinct label)) as labels from votes group by task_id)
select task_id, case when len(labels) > 1 then 'P0' when list_contains(labels, 'FAIL') then 'P1' when list_contains(labels, 'REVIEW') then 'P2' else 'P3' end as priority, array_to_string(labels, ',') as labels from p"""


def merged_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence of all reviewers of a task as one distinct list, and who reviewed."""
    v = _votes(spark, sf_dir)
    files = v.select("task_id", F.explode("evidence_files").alias("file")).where("file is not null").distinct().groupBy("task_id").agg(F.array_join(F.array_sort(F.collect_list("file")), ",").alias("files"))
    who = v.groupBy("task_id").agg(F.array_join(F.array_sort(F.collect_set("reviewer")), "|").alias("reviewers"))
    return who.join(files, "task_id", "left").select("task_id", "reviewers", F.coalesce("files", F.lit("")).alias("files"))


MERGED_REVIEWS = f"""with {VOTES}, f as (select task_id, array_to_string(list_sort(list(file)), ',') as files from (select distinct task_id, unnest(evidence_files) as file from votes) where file is not null group by task_id)
select task_id, array_to_string(list_sort(list(distinct reviewer)), '|') as reviewers, coalesce(any_value(files), '') as files from votes left join f using (task_id) group by task_id"""


def review_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broken rules of raw reviews, counted by reason."""
    r = read(spark, sf_dir, "review_decisions")
    rules = {"task": F.col("task_id").isNotNull(), "label": governance.clean_label("label").isin(LABELS), "reviewer": F.length(F.trim("reviewer_id")) > 0, "evidence": F.size("evidence_files") > 0, "rationale": F.length(F.trim("rationale")) > 0}
    return governance.violations(r, "task_id", rules).groupBy("reasons").agg(F.count("*").alias("rows"))


REVIEW_CONTRACT = f"""with r as (select concat_ws(',', case when not coalesce(task_id is not null, false) then 'task' end, case when not coalesce({CLEAN.format(c='label')} in ('PASS', 'FAIL', 'REVIEW'), false) then 'label' end,
 case when not coalesce(length(trim(reviewer_id)) > 0, false) then 'reviewer' end, case when not coalesce(len(evidence_files) > 0, false) then 'evidence' end, case when not coalesce(length(trim(rationale)) > 0, false) then 'rationale' end) as reasons from review_decisions)
select reasons, count(*) as rows from r where reasons <> '' group by reasons"""


def decision_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broken rules of the decisions that hold, by task."""
    rules = {"sha256": F.col("source_sha256").rlike("^[0-9A-F]{64}$"), "path": F.length(F.trim("source_path")) > 0, "split": F.col("split").isNull() | F.col("split").isin("TRAIN", "VALIDATION"), "groups": F.size("group_ids") > 0, "entries": F.forall("group_ids", lambda e: e.isNotNull() & (e == F.regexp_replace(e, r"^\s+|\s+$", "")) & (e != ""))}
    return governance.violations(_decided(spark, sf_dir), "task_id", rules)


DECISION_CONTRACT = f"""with {DECIDED}, r as (select task_id, concat_ws(',', case when not coalesce(regexp_full_match(source_sha256, '[0-9A-F]{{64}}'), false) then 'sha256' end, case when not coalesce(length(trim(source_path)) > 0, false) then 'path' end,
 case when not coalesce(split is null or split in ('TRAIN', 'VALIDATION'), false) then 'split' end, case when not coalesce(len(group_ids) > 0, false) then 'groups' end,
 case when not coalesce(len(list_filter(group_ids, lambda e: e is null or e <> regexp_replace(e, '^\\s+|\\s+$', '', 'g') or e = '')) = 0, false) then 'entries' end) as reasons from decided) select task_id, reasons from r where reasons <> ''"""


def group_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governance.group_leakage(_decided(spark, sf_dir), "task_id", "group_ids", "split")


GROUP_LEAKAGE = f"""with {DECIDED}, e as (select distinct task_id, split, regexp_replace(e, '^\\s+|\\s+$', '', 'g') as entry from (select task_id, split, unnest(group_ids) as e from decided where split is not null) where regexp_replace(e, '^\\s+|\\s+$', '', 'g') <> '')
select entry, split_part(entry, ':', 1) as kind, array_to_string(list_sort(list(distinct split)), ',') as splits, count(*) as members from e group by entry having count(distinct split) > 1"""


def entity_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = governance.group_entries(_decided(spark, sf_dir), "task_id", "group_ids")
    return g.groupBy("kind").agg(F.count("*").alias("links"), F.countDistinct("entry").alias("entries"), F.countDistinct("task_id").alias("tasks"))


ENTITY_GROUPS = f"""with {DECIDED}, e as (select distinct task_id, regexp_replace(e, '^\\s+|\\s+$', '', 'g') as entry from (select task_id, unnest(group_ids) as e from decided) where regexp_replace(e, '^\\s+|\\s+$', '', 'g') <> '')
select split_part(entry, ':', 1) as kind, count(*) as links, count(distinct entry) as entries, count(distinct task_id) as tasks from e group by 1"""


def split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _decided(spark, sf_dir)
    return d.groupBy(F.coalesce("split", F.lit("(none)")).alias("split"), F.coalesce("source_split", F.lit("(none)")).alias("source_split"), "disposition").agg(F.count("*").alias("tasks"))


SPLIT_COUNTS = f"with {DECIDED} select coalesce(split, '(none)') as split, coalesce(source_split, '(none)') as source_split, disposition, count(*) as tasks from decided group by all"


def hash_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nested half of the tasks of each disposition, in seeded hash order."""
    d = _decided(spark, sf_dir).select("task_id", F.coalesce("disposition", F.lit("(none)")).alias("disposition"))
    return governance.stratified_quota(d, "task_id", "disposition", 0.5, "20310101")


HASH_SPLIT = f"""with {DECIDED}, d as (select task_id, coalesce(disposition, '(none)') as disposition from decided)
select task_id, disposition, row_number() over (partition by disposition order by sha256('20310101:' || task_id), task_id) <= ceil(count(*) over (partition by disposition) * 0.5) as picked from d"""


def partition_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks of all candidates against the tasks that have a definition: in several splits, without split, unknown."""
    c = governance.latest(read(spark, sf_dir, "candidate_decisions"), "candidate_id", values=["task_id", "split"]).withColumn("split", governance.clean_label("split")).where("split is not null and task_id is not null")
    return governance.partition_report(c, read(spark, sf_dir, "task_definitions").where("task_id is not null"), "task_id", "split")


PARTITION_REPORT = f"""with c as (select task_id, split from (select task_id, {CLEAN.format(c='split')} as split, row_number() over (partition by candidate_id order by decided_at desc, ingested_at desc) as rn from candidate_decisions where candidate_id is not null) where rn = 1 and split is not null and task_id is not null),
 p as (select task_id, count(distinct split) as splits from c group by task_id), k as (select distinct task_id, true as known from task_definitions where task_id is not null)
select count(*) filter (splits > 1) as in_several, count(*) filter (splits is null) as without_split, count(*) filter (known is null) as unknown from k full join p using (task_id)"""


def coverage_both_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.coverage(read(spark, sf_dir, "task_definitions"), read(spark, sf_dir, "quality_decisions"), "task_id")


COVERAGE_BOTH_WAYS = """select 'missing' as side, task_id from (select task_id from task_definitions where task_id is not null except select task_id from quality_decisions)
union all select 'unknown', task_id from (select task_id from quality_decisions where task_id is not null except select task_id from task_definitions)"""


def candidate_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions that hold by status and label, with the number of overruled rows behind them."""
    c = read(spark, sf_dir, "candidate_decisions").where("candidate_id is not null")
    n = c.groupBy("candidate_id").agg(F.count("*").alias("n"))
    held = governance.latest(c, "candidate_id", values=["status", "quality_label"]).join(n, "candidate_id")
    return held.groupBy("status", "quality_label").agg(F.count("*").alias("candidates"), F.sum(F.col("n") - 1).alias("other_rows"))


CANDIDATE_SUMMARY = """with h as (select candidate_id, status, quality_label, count(*) over (partition by candidate_id) as n, row_number() over (partition by candidate_id order by decided_at desc, ingested_at desc) as rn from candidate_decisions where candidate_id is not null)
select status, quality_label, count(*) as candidates, sum(n - 1)::bigint as other_rows from h where rn = 1 group by all"""


def undecided_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.coverage(read(spark, sf_dir, "message_events"), read(spark, sf_dir, "candidate_decisions"), "candidate_id")


UNDECIDED_CANDIDATES = """select 'missing' as side, candidate_id from (select candidate_id from message_events where candidate_id is not null except select candidate_id from candidate_decisions)
union all select 'unknown', candidate_id from (select candidate_id from candidate_decisions where candidate_id is not null except select candidate_id from message_events)"""


def task_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks whose instructions are the same but for case, punctuation and spacing."""
    d = read(spark, sf_dir, "task_definitions").where("task_id is not null").select("task_id", F.regexp_replace(F.lower(F.concat_ws(" ", "reason_for_call", "known_info", "task_instructions")), "[^a-z0-9]+", "").alias("key")).distinct()
    return d.groupBy(F.sha2("key", 256).alias("digest")).agg(F.countDistinct("task_id").alias("tasks")).where("tasks > 1")


TASK_DUPLICATES = """select sha256(regexp_replace(lower(concat_ws(' ', reason_for_call, known_info, task_instructions)), '[^a-z0-9]+', '', 'g')) as digest, count(distinct task_id) as tasks from task_definitions where task_id is not null group by 1 having count(distinct task_id) > 1"""


def replay_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replays by recorded outcome and by whether they have errors and both states."""
    r = read(spark, sf_dir, "replay_results").dropDuplicates(["replay_id"])
    return r.groupBy("domain", "db_match").agg(
        F.count("*").alias("replays"), F.count_if(F.size(F.coalesce("replay_errors", F.array())) > 0).alias("with_errors"), F.count_if(F.col("agent_state").isNull() | F.col("gold_state").isNull()).alias("state_missing"), F.count_if(F.col("gold_hash") == F.col("agent_hash")).alias("hashes_equal"))


REPLAY_FLAGS = """with r as (select * from (select *, row_number() over (partition by replay_id order by ingested_at) as rn from replay_results) where rn = 1)
select domain, db_match, count(*) as replays, count(*) filter (len(replay_errors) > 0) as with_errors, count(*) filter (agent_state is null or gold_state is null) as state_missing, count(*) filter (gold_hash = agent_hash) as hashes_equal from r group by domain, db_match"""


def table_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Field by field, the decisions that hold against the first decisions of each candidate."""
    rows = read(spark, sf_dir, "candidate_decisions").where("candidate_id is not null")
    fields = ["status", "quality_label", "disposition", "split", "group_ids"]
    first = rows.groupBy("candidate_id").agg(F.min_by(F.struct(*fields), F.struct("decided_at", "ingested_at")).alias("v")).select("candidate_id", *[f"v.{f}" for f in fields])
    held = governance.latest(rows, "candidate_id", values=fields).select("candidate_id", *fields)
    return diff.diff_tables(first, held, ["candidate_id"], fields)


TABLE_DIFF = """with r as (select *, row_number() over (partition by candidate_id order by decided_at, ingested_at) as f, row_number() over (partition by candidate_id order by decided_at desc, ingested_at desc) as l from candidate_decisions where candidate_id is not null),
 a as (select * from r where f = 1), b as (select * from r where l = 1), u as (
""" + " union all ".join(f"select candidate_id, '{f}' as field, {v.format(t='a', f=f)} as left_value, {v.format(t='b', f=f)} as right_value from a join b using (candidate_id)"
                         for f, v in (("status", "{t}.{f}"), ("quality_label", "{t}.{f}"), ("disposition", "{t}.{f}"), ("split", "{t}.{f}"), ("group_ids", "to_json({t}.{f})::varchar"))) + """)
select candidate_id, field, 'DIFFERENT' as diff_kind, left_value, right_value from u where left_value is distinct from right_value"""


QUERIES = {f.__name__: (f, globals()[f.__name__.upper()]) for f in (
    confusion_binary, confusion_ternary, selective_metrics, two_reviewers, review_priority, merged_reviews, review_contract, decision_contract, group_leakage, entity_groups, split_counts, hash_split, partition_report,
    coverage_both_ways, candidate_summary, undecided_candidates, task_duplicates, replay_flags, table_diff)}
