"""Problem 2: consensus of several annotators' labels.

Method: spectral reliability. A vote is centred by chance: its indicator less the label's share of all
votes. The products of two annotators' centred votes over the items both labelled, divided by the most
that chance-centring leaves, add up to C_ab, which is n_ab r_a r_b on average for n_ab items in common.
The reliability r is the leading eigenvector of that matrix, each entry corrected for its overlap count,
with the eigenvalue as its scale: the power iteration

    y_a = sum_b C_ab x_b / sum_b n_ab x_b^2,    x <- y / sqrt(sum_a x_a (C x)_a / sum_a x_a^2 (n x^2)_a)

has r as its fixed point whatever the scale of x, and runs until no annotator moves by more than RESIDUAL.
Annotators with few items in common are drawn to the mean of all by PRIOR_WEIGHT such items. Contrary
annotators keep their negative place in the matrix.

No pair is ever formed: both sums go through per-item totals, an aggregation by item and one by annotator
over sparse votes. An annotator with reliability r gives the true label with probability
r + (1 - r) p(label) and any other with (1 - r) p(other), so that a vote for m weighs
log(1 + r / ((1 - r) p(m))), nothing if r is not above chance; the consensus is the label with the largest sum.

Hot annotators and items: all sums are partial on the map side; the table of reliabilities has a row
per annotator and is joined as Spark's size check decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.runtime import discard, materialize

# The valid labels of each kind of review.
LABELS = {
    "review_decisions": ["PASS", "FAIL", "REVIEW"],
    "quality_reviews": ["RAW_GOLD", "CORRECTION_REQUIRED", "HOLDOUT", "SEGMENT_REQUIRED"],
}
WHITE_SPACE = r"^[\s\x{0085}\x{00a0}\x{2000}-\x{200b}\x{2028}\x{2029}\x{3000}\x{feff}]+|[\s\x{0085}\x{00a0}\x{2000}-\x{200b}\x{2028}\x{2029}\x{3000}\x{feff}]+$"
#: Change of a reliability that ends the iteration, and rounds that it may take.
RESIDUAL, ROUNDS = 1e-5, 200
#: Common items by which annotators are drawn to the mean, and the start, kept by all where none have items in common.
PRIOR_WEIGHT, PRIOR = 4.0, 0.5
MOST = 0.97


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, WHITE_SPACE, "")


def valid_votes(reviews: DataFrame, kind: str, label_col: str) -> DataFrame:
    """(review_kind, task_id, reviewer, label): of each reviewer's votes on a task the one reviewed last.

    A vote counts if its label, trimmed and in upper case, is in the list and its reviewer, trimmed and
    in lower case, is not blank; rows without task_id don't count. Of votes reviewed at the same time
    the one ingested last holds, then the later in the alphabet.
    """
    clean = reviews.select(
        F.lit(kind).alias("review_kind"), "task_id", F.lower(stripped("reviewer_id")).alias("reviewer"),
        F.upper(stripped(label_col)).alias("label"), "reviewed_at", "ingested_at",
    ).where(F.col("task_id").isNotNull() & (F.col("reviewer") != "") & F.col("label").isin(LABELS[kind]))
    last = F.max_by("label", F.struct("reviewed_at", "ingested_at", "label")).alias("label")
    return clean.groupBy("review_kind", "task_id", "reviewer").agg(last)


def label_shares(votes: DataFrame) -> DataFrame:
    """(review_kind, label, share) of all votes; a few rows."""
    counts = votes.groupBy("review_kind", "label").agg(F.count("*").alias("n"))
    total = counts.groupBy("review_kind").agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(total), "review_kind").select("review_kind", "label", (F.col("n") / F.col("total")).alias("share"))


def reliabilities(votes: DataFrame, residual: float = RESIDUAL) -> DataFrame:
    """(review_kind, reviewer, reliability, votes) from (review_kind, task_id, reviewer, label).

    0 is chance, 1 certain, below 0 contrary. Without any item in common there is no agreement to tell by, and all
    have the start value; where agreement is no better than chance, all are 0.
    """
    shares = label_shares(votes)  # at most one row per listed label
    square = shares.groupBy("review_kind").agg(F.sum(F.col("share") ** 2).alias("square"))
    place = F.row_number().over(Window.partitionBy("review_kind").orderBy("label")).alias("place")
    known = shares.select("review_kind", "label", "share", place).join(square, "review_kind")
    labels = max([r["n"] for r in shares.groupBy("review_kind").agg(F.count("*").alias("n")).collect()], default=0)  # a row per kind
    prepared = materialize(votes.join(F.broadcast(known), ["review_kind", "label"]).select("review_kind", "task_id", "reviewer", "share", "square", "place"), "votes")
    counts = prepared.groupBy("review_kind", "reviewer").agg(F.count("*").alias("votes"))
    x = materialize(counts.withColumn("x", F.lit(PRIOR)), "reliability")
    item, own, p, sq = ["review_kind", "task_id"], F.col("x"), F.col("share"), F.col("square")
    moved, step, before = 1.0, 1.0, 1.0
    for _ in range(ROUNDS if labels else 0):
        weighed = prepared.join(x.select("review_kind", "reviewer", "x"), ["review_kind", "reviewer"])
        sums = [F.sum(F.when(F.col("place") == k, own).otherwise(0.0)).alias(f"x{k}") for k in range(1, labels + 1)]
        parts = [F.sum(F.when(F.col("place") == k, p * own).otherwise(0.0)).alias(f"px{k}") for k in range(1, labels + 1)]
        by_item = weighed.groupBy(*item).agg(*sums, *parts, F.sum(own**2).alias("q2"), F.count("*").alias("n_item"))
        q = sum((F.col(f"x{k}") for k in range(1, labels + 1)), F.lit(0.0))
        pq = sum((F.col(f"px{k}") for k in range(1, labels + 1)), F.lit(0.0))
        alike = F.element_at(F.array(*[F.col(f"x{k}") for k in range(1, labels + 1)]), F.col("place"))
        # sum over the item's other votes of <e_a - p, e_b - p> x_b
        product = alike - p * q - pq + sq * q - own * (1 - 2 * p + sq)
        stats = weighed.join(by_item, item).groupBy("review_kind", "reviewer").agg(
            F.sum(F.when(sq < 1, product / (1 - sq)).otherwise(0.0)).alias("num"), F.sum(F.col("q2") - own**2).alias("den"),
            F.sum(F.col("n_item") - 1).alias("common"), F.first("x").alias("x"), F.count("*").alias("votes"))
        stats = materialize(stats, "agreement")
        totals = stats.groupBy("review_kind").agg(
            F.sum(own * F.col("num")).alias("xcx"), F.sum(own**2 * F.col("den")).alias("xnx"), F.sum("num").alias("num"), F.sum("den").alias("den"), F.sum("common").alias("common"))
        new: Column = F.lit(PRIOR)
        for t in totals.collect():  # a row per kind
            if not t["common"]:
                continue
            if t["xcx"] <= 0 or t["xnx"] <= 0 or t["den"] <= 0:
                value = F.lit(0.0)
            else:
                weight = PRIOR_WEIGHT * t["den"] / t["common"]
                value = (F.col("num") + weight * t["num"] / t["den"]) / (F.col("den") + weight) / (t["xcx"] / t["xnx"]) ** 0.5
            new = F.when(F.col("review_kind") == t["review_kind"], value).otherwise(new)
        old, x = x, materialize(stats.select("review_kind", "reviewer", "votes", (own + step * (new - own)).alias("x"), F.abs(new - own).alias("moved")), "reliability")
        moved = x.agg(F.max("moved")).first()[0] or 0.0
        discard(old)
        discard(stats)
        if moved <= residual:
            break
        if moved > before:  # swings between two sides: go half the way
            step = 0.5
        before = moved
    return x.select("review_kind", "reviewer", "votes", F.greatest(F.lit(-MOST), F.least(F.lit(MOST), F.col("x"))).alias("reliability"))


def consensus(votes: DataFrame, r: DataFrame) -> DataFrame:
    """(review_kind, task_id, label, support, agreement, votes) per task with a vote.

    support is the label's share of all weight (its share of the votes where all weights are 0),
    agreement the share of vote pairs on the task that agree (null for a single vote). Ties go to the
    label with more votes, then to the earlier one in the alphabet.
    """
    shares = F.broadcast(label_shares(votes))
    q = F.greatest(F.col("reliability"), F.lit(0.0))
    weight = F.log(1 + q / ((1 - q) * F.col("share")))
    by_label = (
        votes.join(r.select("review_kind", "reviewer", "reliability"), ["review_kind", "reviewer"])
        .join(shares, ["review_kind", "label"])
        .groupBy("review_kind", "task_id", "label")
        .agg(F.sum(weight).alias("weight"), F.count("*").alias("n"))
    )
    # round: sums of the same weights in another order must tie; ~label order by negated code points
    order = F.struct(F.round("weight", 9), F.col("n"), F.transform(F.split("label", ""), lambda c: -F.ascii(c)))
    n, pairs = F.sum("n"), F.sum(F.col("n") * (F.col("n") - 1))
    best, total = F.max_by("weight", order), F.sum("weight")
    return by_label.groupBy("review_kind", "task_id").agg(
        F.max_by("label", order).alias("label"),
        F.round(F.when(total > 0, best / total).otherwise(F.max_by("n", order) / n), 6).alias("support"),
        F.when(n > 1, F.round(pairs / (n * (n - 1)), 6)).alias("agreement"),
        n.alias("votes"),
    )
