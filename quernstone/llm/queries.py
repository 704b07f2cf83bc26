"""The queries of the training-data problems, by name: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm import bpe, consensus, grouped_split, leakage, near_duplicates, packing, pii, stuffing
from quernstone.runtime import materialize, read


def p1_redacted(spark: SparkSession, sf_dir: str, with_text: bool = True) -> DataFrame:
    """Records with personal information: the kinds found and the text with placeholders; each record once."""
    messages = read(spark, sf_dir, "message_events").select(F.lit("message").alias("record_kind"), F.col("event_id").alias("record_id"), F.col("content").alias("text"))
    hits = read(spark, sf_dir, "pii_hits").select(F.lit("hit").alias("record_kind"), F.col("hit_id").alias("record_id"), F.col("context").alias("text"))
    found = pii.find_personal_information(messages.unionByName(hits), "record_id", "text", ["record_kind"], with_text=with_text)
    return found.dropDuplicates(["record_kind", "record_id", "kinds", "redacted"])


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = p1_redacted(spark, sf_dir, with_text=False)
    return found.select("record_kind", "record_id", F.explode("kinds").alias("category")).distinct()


def _votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    decisions = consensus.valid_votes(read(spark, sf_dir, "review_decisions"), "review_decisions", "label")
    quality = consensus.valid_votes(read(spark, sf_dir, "quality_reviews"), "quality_reviews", "quality_label")
    return materialize(decisions.unionByName(quality), "valid-votes")


def p2_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    votes = _votes(spark, sf_dir)
    return consensus.consensus(votes, consensus.reliabilities(votes))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_consensus(spark, sf_dir).select("review_kind", "task_id", "label")


def p2_reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = consensus.reliabilities(_votes(spark, sf_dir))
    return r.select("review_kind", "reviewer", "votes", F.round("reliability", 4).alias("reliability"))


def p3_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation with its group, named after the group's smallest candidate_id, its links and copies."""
    groups = materialize(near_duplicates.conversation_groups(read(spark, sf_dir, "message_events")), "groups")
    names = groups.groupBy("group_id").agg(F.min("candidate_id").alias("name"))
    return groups.join(names, "group_id").select("candidate_id", F.col("name").alias("group_id"), "links", "copies")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.group_pairs(near_duplicates.conversation_groups(read(spark, sf_dir, "message_events")))


def p4_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaking pairs with their splits, similarity and coverage."""
    rows = materialize(leakage.decided(read(spark, sf_dir, "candidate_decisions")), "decided")
    return leakage.leaking_pairs(rows, leakage.task_links(rows, read(spark, sf_dir, "task_definitions")))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4_pairs(spark, sf_dir).select(F.least("train", "evaluation").alias("candidate_id_a"), F.greatest("train", "evaluation").alias("candidate_id_b"))


def p4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leakage_report(p4_pairs(spark, sf_dir))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped_split.torn_records(read(spark, sf_dir, "quality_decisions")).select("task_id")


def p5_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped_split.split_decisions(read(spark, sf_dir, "quality_decisions"))


def p5_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the new split: tasks, entries whose tasks are in several splits, tasks without one, and whether the shares hold to 3 %."""
    decisions = read(spark, sf_dir, "quality_decisions")
    split = materialize(grouped_split.split_decisions(decisions), "split")
    rows = grouped_split.latest_rows(decisions, "task_id", ["group_ids"])
    torn = grouped_split.entries_of(rows, "task_id").join(split, "task_id").groupBy("entry").agg((F.min("split") != F.max("split")).alias("torn"))
    shares = F.lit(True)
    for name, share in grouped_split.TARGETS.items():
        shares = shares & (F.abs(F.count_if(F.col("split") == name) / F.count("*") - share) <= 0.03)
    known = rows.join(split, "task_id", "left").agg(F.count("*").alias("tasks"), F.count_if(F.col("split").isNull()).alias("unplaced"), shares.alias("in_proportion"))
    return known.crossJoin(torn.agg(F.count_if("torn").alias("torn_entries"))).select("tasks", "torn_entries", "unplaced", "in_proportion")  # a row each


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_corpus(read(spark, sf_dir, "documents"))


def p8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "pack_profiles"))


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packing_report(p8_packing(spark, sf_dir))


def p8_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packing_checks(p8_packing(spark, sf_dir))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stuffing.junk_pages(read(spark, sf_dir, "documents")).select("doc_id")


def queries() -> dict:
    return {f.__name__: f for f in (p1_found, p1_redacted, p2_found, p2_consensus, p2_reliability, p3_found, p3_groups, p4_found, p4_report, p5_found, p5_split, p5_checks, p7_ids, p8_packing, p8_report, p8_checks, p9_found)}
