"""Problem 3: groups of records that share most of their content.

Method: keys of several minima.

1. Each record's shingles are hashed once. Records with equal sets are copies and are represented by one
   of them from here on.
2. Inverted lists of the keys, hashes of a few minima each, generate pairs, and bits of the sketches
   estimate their similarity (sketch_join). The number of minima in a key follows the number of records, so
   that the pairs met in vain don't grow with its square; estimates are only used by their upper ends.
3. The exact Jaccard similarity of the whole sets, of 64 bits, decides. Linked records are grouped by
   hooking and pointer jumping, and their links are counted.

No list is cut off and no record dropped; a pair just at the threshold is missed by its keys once in ten
million, and by its bits as often.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm.components import connected
from quernstone.llm.shingles import mix, shingle_hashes, word_hashes
from quernstone.llm.sketch_join import SKETCH, candidates, key_width, sketch
from quernstone.runtime import materialize

#: Members of a block of a group; each two blocks make their pairs in a task of their own.
PAIR_BLOCK = 2_000

def _per_conversation(messages: DataFrame, width: int, kind: str, columns: Callable[[np.ndarray], tuple]) -> DataFrame:
    """(candidate_id, doc, columns) of every conversation, from the distinct shingles of its text.

    A conversation's text are the contents of its user and assistant messages by msg_index, each event_id
    once, joined by a space; shingles never depend on where messages end. Rows come sorted by
    conversation and are read as a stream, so a conversation is held as its hashes only.
    """
    rows = (
        messages.where(F.col("role").isin("user", "assistant") & F.col("candidate_id").isNotNull() & (F.length("content") > 0))
        .select("candidate_id", "msg_index", "event_id", "content")
    )
    ordered = rows.repartition("candidate_id").sortWithinPartitions("candidate_id", "msg_index", "event_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc = TaskContext.get().partitionId() << 33
        name, seen, parts = None, set(), []
        made: list[tuple] = []

        def close() -> None:
            nonlocal doc
            made.append((name, doc, *columns(np.unique(shingle_hashes(word_hashes(" ".join(parts)), width)))))
            doc += 1

        def flush() -> pa.RecordBatch:
            arrays = [_column([r[i] for r in made]) for i in range(len(made[0]))]
            made.clear()
            return pa.RecordBatch.from_arrays(arrays, names=names)

        for batch in batches:
            for candidate, event, content in zip(batch["candidate_id"].to_pylist(), batch["event_id"].to_pylist(), batch["content"].to_pylist()):
                if candidate != name:
                    if name is not None:
                        close()
                    name, seen, parts = candidate, set(), []
                if event is None or event not in seen:
                    seen.add(event)
                    parts.append(content)
            if len(made) >= 500:
                yield flush()
        if name is not None:
            close()
        if made:
            yield flush()

    schema = f"candidate_id string, doc bigint, {kind}"
    names = [c.split()[0] for c in schema.split(", ")]
    return ordered.mapInArrow(run, schema)


def _column(values: list) -> pa.Array:
    if not isinstance(values[0], np.ndarray):
        return pa.array(values)
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in values])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(values)))


def minima_of_keys(messages: DataFrame, threshold: float) -> int:
    """Minima in a key, by about how many conversations there are."""
    return key_width(messages.agg(F.approx_count_distinct("candidate_id")).first()[0], threshold)


def conversation_sketches(messages: DataFrame, threshold: float, width: int = 3, minima: int = 3) -> DataFrame:
    """(candidate_id, doc, n, digest, check, SKETCH): the sketches of all conversations, with so many minima in a key, and numbers that tell equal sets.

    Defined cases: null contents are left out; messages of the same index are ordered by event_id; rows
    with a null candidate_id belong to no conversation; a conversation of fewer than `width` words has
    an empty set and no links.
    """

    def columns(values: np.ndarray) -> tuple:
        digest, check = np.bitwise_xor.reduce(mix(values)), np.sum(mix(values ^ np.uint64(0x9E3779B97F4A7C15)))
        keys, bits = sketch(values, threshold, minima)
        return pa.scalar(len(values), pa.int32()), int(digest.astype(np.uint64).view(np.int64)), int(check.astype(np.uint64).view(np.int64)), keys, np.zeros(0, np.int32), *map(int, bits)

    return _per_conversation(messages, width, f"n int, digest bigint, check bigint, {SKETCH}", columns)


def similar_sets(sketches: DataFrame, messages: DataFrame, threshold: float, width: int, minima: int = 3) -> DataFrame:
    """(a, b, similarity): all linked pairs, with a < b, among the conversations (candidate_id, doc, n, SKETCH) with different sets.

    The sets of 64 bits that verify are built anew, of the candidates' conversations alone.
    """
    close = materialize(candidates(sketches, threshold, minima), "close")
    involved = close.select(F.explode(F.array("a", "b")).alias("doc")).distinct()
    named = materialize(sketches.select("doc", "candidate_id").join(involved, "doc", "left_semi"), "named")
    again = _per_conversation(messages.join(named, "candidate_id", "left_semi"), width, "shingles array<bigint>", lambda values: (values.view(np.int64),))
    sides = materialize(again.select("candidate_id", "shingles").join(named, "candidate_id").select("doc", "shingles"), "sides")
    pairs = close
    for side in "ab":
        pairs = pairs.join(sides.select(F.col("doc").alias(side), F.col("shingles").alias(f"shingles_{side}")), side)
    both = F.size(F.array_intersect("shingles_a", "shingles_b"))
    exact = pairs.select("a", "b", (both / (F.size("shingles_a") + F.size("shingles_b") - both)).alias("similarity"))
    return exact.where(F.col("similarity") >= threshold)


def conversation_groups(messages: DataFrame, threshold: float = 0.6, width: int = 3) -> DataFrame:
    """(candidate_id, group_id, links, copies) of every conversation with words enough for a shingle.

    group_id is the number of the group's first record; links counts all different texts its own is
    linked to directly, copies the other conversations with the same set.
    """
    minima = minima_of_keys(messages, threshold)
    full = materialize(conversation_sketches(messages, threshold, width, minima), "sketches").where("n > 0")
    same = ["digest", "check", "n"]
    kinds = full.groupBy(*same).agg(F.min("doc").alias("rep"), F.count("*").alias("same"))
    of = materialize(full.select("candidate_id", "doc", *same).join(kinds, same).select("candidate_id", "doc", "rep", "same"), "members")
    # a table of their own, so that its size decides how the sketches are filtered
    copies = materialize(of.where("same > 1 and doc <> rep").select("doc"), "copies")
    distinct = full.join(copies, "doc", "left_anti")
    links = materialize(similar_sets(distinct, messages, threshold, width, minima), "links")
    groups = connected(links).select(F.col("node").alias("rep"), "component")
    degree = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("links"))
    return (
        of.join(groups, "rep", "left").join(degree, "rep", "left")
        .select("candidate_id", F.coalesce("component", "rep").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"), (F.col("same") - 1).alias("copies"))
    )


def group_pairs(groups: DataFrame) -> DataFrame:
    """(candidate_id_a, candidate_id_b), a < b: all pairs within a group; a large group is cut into blocks that all meet."""
    several = groups.groupBy("group_id").agg(F.count("*").alias("size")).where("size > 1")
    blocks = F.ceil(F.col("size") / PAIR_BLOCK).cast("bigint")
    of = groups.select("candidate_id", "group_id").join(several, "group_id").withColumn("blocks", blocks)
    of = materialize(of.select("candidate_id", "group_id", "blocks", F.pmod(F.xxhash64("candidate_id"), "blocks").alias("own")), "grouped")
    a = of.select("group_id", "own", F.col("candidate_id").alias("candidate_id_a"))
    b = of.select("group_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("own"), F.col("candidate_id").alias("candidate_id_b"))
    return a.join(b, ["group_id", "own"]).where("candidate_id_a < candidate_id_b").select("candidate_id_a", "candidate_id_b")
