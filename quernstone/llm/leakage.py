"""Problem 4: the same or nearly the same records in training and in evaluation.

Method: winnowing fingerprints.

1. Of every few consecutive shingles of a text the one of lowest rank is selected, the rightmost of
   equals. A rank is a shingle's level of frequency, then its rolling hash (frequency), so that windows
   select what is rare and phrases from templates are only selected where nothing else is near.
2. Selected minima are joined across the splits; each is a seed. A pair of texts met by a seed is kept if
   the parities of their shingles in a few hundred bits differ in no more places than two sets with the
   similarity asked for can differ in, a bound that loses nothing.
3. Seeds that keep their order in both texts are chained, the chain is extended word by word on both
   sides, and the covered words are reported per record and source. A pair is linked if its shingle sets
   have `threshold` of their union in common, which is checked exactly.

Equal texts are collapsed before, and expanded in the result alone.

What the windows miss: two texts select the same minimum where they share a window. Each place where the
run of common shingles breaks costs at least four shingles that only one text has (an exchange of two
parts; other edits cost more), so sets with the similarity hold a run long enough for a window, and a
number of shared minima that grows with the text. As many of a text's commonest minima, less one, needn't
be joined (see `guarantee`). This holds where word pairs don't recur within a text; where they do, breaks
can be cheaper, and the tests compare the pairs with brute force.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm.consensus import stripped
from quernstone.llm.frequency import Ranks, value_ranks
from quernstone.llm.shingles import shingle_hashes, word_hashes
from quernstone.runtime import materialize, spread

WIDTH, WINDOW = 3, 4
#: Shingles that only one text has for each break of a run of common ones, at least.
BREAK = 4
#: Texts of a block of a fingerprint's list, and bits that hold the parities of a text's shingles.
BLOCK, PARITIES = 20_000, 256
#: Bits of the sides that a text is on.
TRAIN, EVALUATION = 1, 2
#: Pairs of candidates of one task that a partition makes, at most.
PAIRS_A_TASK = 2_000_000


def guarantee(threshold: float, most: int = 4_096) -> tuple[np.ndarray, np.ndarray]:
    """For texts of n shingles, up to `most`: the window, and minima that texts with the similarity share at least.

    s shared shingles, threshold * n at least, have b <= s * (1 / threshold - 1) / BREAK breaks, so a run
    of s / (b + 1) and s - (b + 1) * (window - 1) whole windows, a minimum for each `window` of them.
    """
    s = np.arange(1, most + 1)
    runs = np.floor(s * (1 / threshold - 1) / BREAK + 1e-9).astype(np.int64) + 1
    longest = np.minimum(WINDOW, -(-s // runs))
    shared = np.maximum(1, -(-(s - runs * (WINDOW - 1)) // WINDOW))
    # the least over all s that n shingles allow: from the back, as more can be shared
    longest, shared = (np.minimum.accumulate(x[::-1])[::-1] for x in (longest, shared))
    first = np.maximum(1, np.ceil(threshold * np.arange(most + 1) - 1e-9).astype(np.int64))
    return longest[first - 1], shared[first - 1]


def winnow(ranks: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Positions of the selected minima: of each window the smallest rank, the rightmost of equals."""
    n = len(ranks)
    if n == 0:
        return np.zeros(0, np.int64)
    if n <= window:
        return np.array([n - 1 - int(np.argmin(ranks[::-1]))])
    views = np.lib.stride_tricks.sliding_window_view(ranks[::-1], window)
    best = np.arange(len(views)) + views.argmin(axis=1)
    return np.unique(n - 1 - best)


def ranked(of: Ranks, hashes: np.ndarray) -> np.ndarray:
    """One number for each shingle that orders by level of frequency, then by hash."""
    return (of.of(hashes).astype(np.uint64) << np.uint64(56)) | (hashes >> np.uint64(8))


def decided(candidates: DataFrame) -> DataFrame:
    """(candidate_id, task_id, split, source_split, side): of each candidate the row decided last.

    side is TRAIN or EVALUATION, or null. Ties of decided_at go to the row ingested last, then to the
    greatest values. Rows without candidate_id are no cases.
    """
    values = ["task_id", "split", "source_split"]
    last = candidates.where("candidate_id is not null").groupBy("candidate_id").agg(
        F.max_by(F.struct(*values), F.struct("decided_at", "ingested_at", *values)).alias("v"))
    clean = lambda c: F.nullif(F.upper(stripped(F.col(f"v.{c}"))), F.lit(""))
    rows = last.select("candidate_id", F.col("v.task_id").alias("task_id"), clean("split").alias("split"), clean("source_split").alias("source_split"))
    side = F.when(F.col("split") == "TRAIN", "TRAIN").when((F.col("split") == "VALIDATION") | (F.col("split").isNull() & (F.col("source_split") == "TEST")), "EVALUATION")
    return rows.withColumn("side", side)


def scenarios(tasks: DataFrame) -> DataFrame:
    """(task_id, text): of each task the scenario created last; nulls are left out of the text."""
    text = F.concat_ws(" ", "reason_for_call", "known_info", "task_instructions")
    return tasks.where("task_id is not null").select("task_id", text.alias("text"), "created_at", "ingested_at").groupBy("task_id").agg(
        F.max_by("text", F.struct("created_at", "ingested_at", "text")).alias("text"))


def words_of(texts: DataFrame) -> DataFrame:
    """(text_id, sides, words) of (text_id, sides, text): the hashes of the words in order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = pa.array([word_hashes(text).view(np.int64) for text in batch.column(2).to_pylist()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), words], names=["text_id", "sides", "words"])

    return spread(texts.select("text_id", "sides", "text")).mapInArrow(run, "text_id bigint, sides int, words array<bigint>")


def _all_shingles(words: pa.ListArray) -> np.ndarray:
    """The shingles of all texts of a column, none across two texts."""
    flat = words.flatten().to_numpy().view(np.uint64)
    text = np.repeat(np.arange(len(words)), words.value_lengths().to_numpy(zero_copy_only=False))
    hashes = shingle_hashes(flat, WIDTH)
    return hashes[text[: len(hashes)] == text[WIDTH - 1 :]].view(np.int64) if len(hashes) else np.zeros(0, np.int64)


def fingerprints(prints: DataFrame, ranks: Broadcast, threshold: float) -> DataFrame:
    """(value, blocks, text_id, sides, n, p0, p1, ...): the selected minima that are joined, n distinct shingles and their parities."""
    windows, shared = guarantee(threshold)
    block, bits, longs = BLOCK, PARITIES, PARITIES // 64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = ranks.value
        for batch in batches:
            flat = batch["words"].flatten().to_numpy().view(np.uint64)
            ends = np.concatenate([[0], np.cumsum(batch["words"].value_lengths().to_numpy(zero_copy_only=False))])
            taken, counts, sizes, parities = [], [], [], []
            for i in range(batch.num_rows):
                hashes = shingle_hashes(flat[ends[i] : ends[i + 1]], WIDTH)
                distinct = np.unique(hashes)
                n = len(distinct)
                at = min(n, len(windows) - 1)
                minima = np.unique(ranked(of, hashes)[winnow(ranked(of, hashes), int(windows[at]))]) if n else np.zeros(0, np.uint64)
                minima = minima[: max(1, len(minima) - int(shared[at]) + 1)]
                taken.append(minima)
                counts.append(len(minima))
                sizes.append(n)
                odd = np.bincount((distinct & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
                parities.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
            if not sum(counts):
                continue
            minima = np.concatenate(taken)
            blocks = Ranks.blocks((minima >> np.uint64(56)).astype(np.uint8), block)
            rows = np.repeat(np.arange(batch.num_rows), counts)
            parity = np.stack(parities)[rows]
            columns = [pa.array(minima.astype(np.uint32).view(np.int32)), pa.array(blocks), batch["text_id"].take(pa.array(rows)), batch["sides"].take(pa.array(rows)), pa.array(np.array(sizes, np.int32)[rows])]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(parity[:, k]) for k in range(longs)], names=["value", "blocks", "text_id", "sides", "n", *[f"p{k}" for k in range(longs)]])

    return prints.select("text_id", "sides", "words").mapInArrow(run, "value int, blocks int, text_id bigint, sides int, n int, " + ", ".join(f"p{k} bigint" for k in range(longs)))


def text_pairs(prints: DataFrame, ranks: Broadcast, threshold: float) -> DataFrame:
    """(train, evaluation) pairs of different texts that a seed meets: all that have the similarity, and few others.

    The list of a common minimum is cut into blocks of its training texts, each met by all of the other side.
    """
    seeds = materialize(fingerprints(prints, ranks, threshold), "seeds")
    of_train = seeds.where(F.col("sides").bitwiseAND(TRAIN) > 0).withColumn("block", F.pmod(F.xxhash64("text_id"), "blocks"))
    of_eval = seeds.where(F.col("sides").bitwiseAND(EVALUATION) > 0).withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks").cast("bigint") - 1)))
    t, e = of_train.alias("t"), of_eval.alias("e").hint("merge")
    apart = sum((F.bit_count(F.col(f"t.p{k}").bitwiseXOR(F.col(f"e.p{k}"))) for k in range(PARITIES // 64)), F.lit(0))
    both = F.col("t.n") + F.col("e.n")
    near = (F.least("t.n", "e.n") >= threshold * F.greatest("t.n", "e.n") - 1e-9) & (apart <= (1 - threshold) / (1 + threshold) * both + 1e-9)
    met = t.join(e, (F.col("t.value") == F.col("e.value")) & (F.col("t.block") == F.col("e.block")) & (F.col("t.text_id") != F.col("e.text_id")) & near)
    return met.select(F.col("t.text_id").alias("train"), F.col("e.text_id").alias("evaluation")).distinct()


def chain(a: np.ndarray, b: np.ndarray, of: Ranks) -> tuple[np.ndarray, np.ndarray]:
    """Masks of the words of two texts that a chain of collinear seeds covers, extended word by word."""
    ha, hb = shingle_hashes(a, WIDTH), shingle_hashes(b, WIDTH)
    pa_, pb = winnow(ranked(of, ha)), winnow(ranked(of, hb))
    at: dict[int, list[int]] = {}
    for p in pb.tolist():
        at.setdefault(int(hb[p]), []).append(p)
    seeds = [(p, q) for p in pa_.tolist() for q in reversed(at.get(int(ha[p]), ()))]
    # longest increasing subsequence by the second place; equal first places come in falling order
    tails: list[int] = []
    ends: list[int] = []
    before: list[int] = []
    for i, (_, q) in enumerate(seeds):
        k = int(np.searchsorted(tails, q))
        if k == len(tails):
            tails.append(q)
            ends.append(i)
        else:
            tails[k], ends[k] = q, i
        before.append(ends[k - 1] if k else -1)
    picked, i = [], ends[-1] if ends else -1
    while i >= 0:
        picked.append(seeds[i])
        i = before[i]
    in_a, in_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
    floor_a = floor_b = 0
    for p, q in reversed(picked):
        if p < floor_a - WIDTH or q < floor_b - WIDTH:
            continue
        lo = 0
        while p - lo > floor_a and q - lo > floor_b and a[p - lo - 1] == b[q - lo - 1]:
            lo += 1
        hi = WIDTH
        while p + hi < len(a) and q + hi < len(b) and a[p + hi] == b[q + hi]:
            hi += 1
        in_a[p - lo : p + hi] = True
        in_b[q - lo : q + hi] = True
        floor_a, floor_b = p + hi, q + hi
    return in_a, in_b


def _jaccard(a: np.ndarray, b: np.ndarray) -> float:
    x, y = np.unique(shingle_hashes(a, WIDTH)), np.unique(shingle_hashes(b, WIDTH))
    if not len(x) or not len(y):
        return 0.0
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both)


def compare(pairs: DataFrame, prints: DataFrame, ranks: Broadcast, threshold: float) -> DataFrame:
    """(train, evaluation, similarity, covered_train, covered_evaluation) of the linked pairs of texts."""
    words = prints.select("text_id", "words")
    joined = pairs
    for side in ("train", "evaluation"):
        joined = joined.join(words.select(F.col("text_id").alias(side), F.col("words").alias(f"words_{side}")), side)
    # sets can't overlap enough if one text has too few words for the other
    n_t, n_e = (F.size(f"words_{s}") - WIDTH + 1 for s in ("train", "evaluation"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            arrays = [batch["words_train"], batch["words_evaluation"]]
            flat = [x.values.to_numpy().view(np.uint64) for x in arrays]
            offsets = [x.offsets.to_numpy() for x in arrays]
            for i, (t, e) in enumerate(zip(batch["train"].to_pylist(), batch["evaluation"].to_pylist())):
                a, b = (f[o[i] : o[i + 1]] for f, o in zip(flat, offsets))
                similarity = _jaccard(a, b)
                if similarity >= threshold:
                    in_a, in_b = chain(a, b, ranks.value)
                    rows.append((t, e, similarity, float(in_a.mean()), float(in_b.mean())))
            if rows:
                t, e, s, x, y = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(t, pa.int64()), pa.array(e, pa.int64()), pa.array(s), pa.array(x), pa.array(y)], names=["train", "evaluation", "similarity", "covered_train", "covered_evaluation"])

    columns = ["train", "evaluation", "words_train", "words_evaluation"]
    return joined.where((n_t > 0) & (n_e > 0)).select(*columns).mapInArrow(run, "train bigint, evaluation bigint, similarity double, covered_train double, covered_evaluation double")


def task_links(rows: DataFrame, tasks: DataFrame, threshold: float = 0.6) -> DataFrame:
    """(train_task, evaluation_task, similarity, covered_train, covered_evaluation): tasks of the two sides that are the same or linked.

    A task on both sides is linked to itself with similarity 1, whether it has a definition or not.
    """
    sided = materialize(rows.where("task_id is not null and side is not null").groupBy("task_id").agg(
        (F.count_if(F.col("side") == "TRAIN") > 0).alias("in_train"), (F.count_if(F.col("side") == "EVALUATION") > 0).alias("in_eval")), "sided")
    texts = materialize(scenarios(tasks).join(sided, "task_id"), "texts")
    sides = F.when(F.max("in_train"), TRAIN).otherwise(0) + F.when(F.max("in_eval"), EVALUATION).otherwise(0)
    # numbered once, as the table is written
    kinds = materialize(texts.groupBy("text").agg(sides.cast("int").alias("sides")).withColumn("text_id", F.monotonically_increasing_id()), "kinds")
    prints = materialize(words_of(kinds), "prints")
    ranks = value_ranks(prints, "words", _all_shingles)
    pairs = materialize(text_pairs(prints, ranks, threshold), "pairs")
    linked = compare(pairs, prints, ranks, threshold)
    copies = prints.where(F.col("sides") == TRAIN + EVALUATION).where(F.size("words") >= WIDTH).select(
        F.col("text_id").alias("train"), F.col("text_id").alias("evaluation"), *[F.lit(1.0).alias(c) for c in ("similarity", "covered_train", "covered_evaluation")])
    of = texts.join(kinds.select("text", "text_id"), "text").select("task_id", "text_id", "in_train", "in_eval")
    both = linked.unionByName(copies)
    both = both.join(of.where("in_train").select(F.col("text_id").alias("train"), F.col("task_id").alias("train_task")), "train")
    both = both.join(of.where("in_eval").select(F.col("text_id").alias("evaluation"), F.col("task_id").alias("evaluation_task")), "evaluation")
    values = ["similarity", "covered_train", "covered_evaluation"]
    itself = sided.where("in_train and in_eval").select(F.col("task_id").alias("train_task"), F.col("task_id").alias("evaluation_task"), *[F.lit(1.0).alias(v) for v in values])
    return materialize(both.where("train_task <> evaluation_task").select("train_task", "evaluation_task", *values).unionByName(itself), "task-links")


def leaking_pairs(rows: DataFrame, links: DataFrame) -> DataFrame:
    """(train, evaluation, evaluation_split, train_source, evaluation_source, similarity, covered_...): pairs of candidates of linked tasks.

    The candidates of a hot task are cut into salted parts, each met by all of the other side, so that a
    task makes at most PAIRS_A_TASK pairs.
    """
    cases = rows.where("task_id is not null and side is not null")
    train = cases.where("side = 'TRAIN'").select(F.col("candidate_id").alias("train"), F.col("task_id").alias("train_task"), F.col("source_split").alias("train_source"))
    evaluation = cases.where("side = 'EVALUATION'").select(F.col("candidate_id").alias("evaluation"), F.col("task_id").alias("evaluation_task"), F.col("split").alias("evaluation_split"), F.col("source_split").alias("evaluation_source"))
    n_t = train.groupBy("train_task").agg(F.count("*").alias("n_t"))
    n_e = evaluation.groupBy("evaluation_task").agg(F.count("*").alias("n_e"))
    parts = F.ceil(F.col("n_t") * F.col("n_e") / PAIRS_A_TASK)
    sized = links.join(n_t, "train_task").join(n_e, "evaluation_task").withColumn("parts", parts.cast("int"))
    most = sized.groupBy("train_task").agg(F.max("parts").alias("parts"))
    salted = train.join(most, "train_task").withColumn("part", F.pmod(F.xxhash64("train"), F.col("parts")))
    meeting = sized.drop("parts", "n_t", "n_e").join(most, "train_task").withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts").cast("bigint") - 1))).drop("parts")
    return meeting.join(evaluation, "evaluation_task").join(salted.drop("parts"), ["train_task", "part"]).drop("part")


def leakage_report(pairs: DataFrame) -> DataFrame:
    """Pairs, distinct candidates and mean coverage by the evaluation record's split and both source_splits."""
    return pairs.groupBy("evaluation_split", "evaluation_source", "train_source").agg(
        F.count("*").alias("pairs"), F.countDistinct("train").alias("train_candidates"), F.countDistinct("evaluation").alias("evaluation_candidates"),
        F.round(F.avg("covered_train"), 4).alias("covered_train"), F.round(F.avg("covered_evaluation"), 4).alias("covered_evaluation"))
