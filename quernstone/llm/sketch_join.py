"""Pairs of sets with a least Jaccard similarity, by keys of several minima each.

1. A permutation scrambles a set's values and splits them by their upper bits into BINS parts; two sets have
   the same minimum in a part with a chance of their similarity, at least. A key is a hash of `width` minima,
   so that sets of similarity t share a key with a chance of t ** width, and there are so many keys
   that sets at the threshold share none but once in LOST. Keys whose parts are all empty are left out.
2. Inverted lists: a list for each key. Members of a list are pairs. Sets that have little in common share a
   key of one more minimum so much more rarely that the width follows the number of sets (key_width):
   the pairs met in vain, which grow with its square, stay few beside the keys themselves.
3. A sketch also holds the set's size and BITS bits, one of each of as many minima. Two sets of similarity t
   agree in (1 + t) / 2 of the bits on average; members that agree in fewer than a pair at the threshold does but
   once in LOST are no pair, nor are sets of which one is too small to have the similarity with the other.

The exact similarity is for the caller to check. No list is cut off: a long one is cut into blocks, each two
of which meet in a group of its own.
"""

from __future__ import annotations

from functools import cache
from math import ceil, comb, log, log1p

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm.shingles import mix
from quernstone.runtime import collect_garbage, materialize

#: Parts of a permutation.
BINS = 16
#: Widths of a key that are weighed, the similarity that sets have without being alike, and the cost of a pair beside that of a key.
WIDTHS, BACKGROUND, PAIR_COST = range(3, BINS // 2 + 1), 0.05, 0.05
#: Keys of a set whose lists are written at once.
ROUND = 70
#: Sets in a block of a key's list.
BLOCK = 4_000
#: Of so many sets one is looked at for long lists.
SAMPLE = 16
#: Bits of a set.
BITS = 192
#: Chance of a pair at the threshold to be lost by its keys, and by its bits, at most.
LOST = 1e-7
#: Kept off a ceiling, so that rounding never asks for one value too many.
TINY = 1e-9
#: The minimum of an empty part, and a factor that scrambles.
EMPTY, GOLDEN = np.uint64(2**64 - 1), np.uint64(0x9E3779B97F4A7C15)


def keys_needed(threshold: float, width: int) -> int:
    """Keys of so many minima of which sets at the threshold share one but for a chance of LOST."""
    return ceil(log(LOST) / log1p(-(threshold**width)))


def key_width(sets: int, threshold: float) -> int:
    """Minima in a key, so that keys and pairs met in vain cost the least for so many sets; no width loses more than another."""
    return min(WIDTHS, key=lambda w: keys_needed(threshold, w) * (1 + PAIR_COST * sets / 2 * BACKGROUND**w))


def permutations(threshold: float, width: int) -> int:
    """Permutations that have all keys and bits."""
    return max(BITS // BINS, ceil(keys_needed(threshold, width) / (BINS // width)))


def least_agreement(threshold: float) -> int:
    """Bits that sets at the threshold agree in but for a chance of LOST."""
    p, chance = (1 + threshold) / 2, 0.0
    for x in range(BITS):
        chance += comb(BITS, x) * p**x * (1 - p) ** (BITS - x)
        if chance > LOST:
            return x
    return BITS


@cache
def _scramblers(count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each permutation a seed, an odd factor and its first part."""
    seeds = mix(np.arange(1, count + 1, dtype=np.uint64))[:, None]
    return seeds, mix(seeds) | np.uint64(1), np.arange(0, count * BINS, BINS)[:, None]


def minima(values: np.ndarray, count: int) -> np.ndarray:
    """The least scrambled value in each part of each of `count` permutations, EMPTY in empty ones: (count, BINS)."""
    out = np.full(count * BINS, EMPTY)
    step = max(1, (1 << 16) // max(1, len(values)))  # a long set takes no more memory
    for i in range(0, count, step):
        seeds, odd, first = (x[i : i + step] for x in _scramblers(count))
        h = (values ^ seeds) * odd
        h ^= h >> np.uint64(32)
        h *= GOLDEN
        np.minimum.at(out, ((h >> np.uint64(65 - BINS.bit_length())).astype(np.intp) + first).ravel(), h.ravel())
    return out.reshape(count, BINS)


def _bits(least: np.ndarray) -> np.ndarray:
    return np.packbits((least[: BITS // BINS].ravel() >> np.uint64(31) & np.uint64(1)).astype(np.uint8)).view(np.int64)


def bits_of(values: np.ndarray) -> np.ndarray:
    """BITS / 64 numbers: a bit of each of the first minima, 1 in empty parts."""
    return _bits(minima(values.astype(np.uint64), BITS // BINS))


def sketch(values: np.ndarray, threshold: float, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys of a set, as hashes of 32 bits, and its bits: equal keys of different minima are met in vain and hide nothing."""
    least = minima(values, permutations(threshold, width))
    parts = least[:, : BINS // width * width].reshape(-1, width)[: keys_needed(threshold, width)]
    keys = np.arange(len(parts), dtype=np.uint64)
    for i in range(width):
        keys = keys * GOLDEN + parts[:, i]
    return (mix(keys)[(parts != EMPTY).any(axis=1)] >> np.uint64(32)).astype(np.uint32).view(np.int32), _bits(least)


#: Columns of a sketch, besides the record's number `doc` and its size `n`. blocks: of each value's list, one if there is no number.
SKETCH = "values array<int>, blocks array<int>, " + ", ".join(f"s{k} bigint" for k in range(BITS // 64))


def long_lists(sketches: DataFrame) -> DataFrame:
    """(value, cut): values whose lists are long by a sample of the sets, and the blocks to cut them into. A list missed costs time only."""
    some = sketches.where(F.pmod(F.xxhash64("doc"), F.lit(SAMPLE)) == 0).select(F.explode("values").alias("value"))
    return some.groupBy("value").count().where(F.col("count") >= max(2, BLOCK // SAMPLE)).select("value", F.ceil(F.col("count") * SAMPLE / BLOCK).cast("int").alias("cut"))


def inverted_lists(sketches: DataFrame, long: DataFrame | None = None) -> DataFrame:
    """(value, group, home, doc, n, s0, ...): the members of the lists, by value and group of blocks.

    Each two blocks of a list, and each with itself, are a group; home tells the latter from the others.
    """
    bits = [f"s{k}" for k in range(BITS // 64)]
    members = sketches.select("doc", "n", *bits, "blocks", F.posexplode("values").alias("place", "value"))
    members = members.withColumn("of", F.coalesce(F.get("blocks", F.col("place")), F.lit(1))).drop("blocks", "place")
    if long is not None:
        members = members.join(F.broadcast(long), "value", "left").withColumn("of", F.coalesce("cut", "of"))
    members = members.select("*", F.pmod(F.xxhash64("doc"), "of").cast("int").alias("own"), F.explode(F.sequence(F.lit(0), F.col("of") - 1)).alias("other"))
    group = F.least("own", "other") * F.col("of") + F.greatest("own", "other")
    return members.select("value", group.alias("group"), F.when(F.col("own") == F.col("other"), -1 - F.col("own")).otherwise(F.col("own")).alias("home"), "doc", "n", *bits)


def _met(sketches: DataFrame, threshold: float, long: DataFrame | None) -> DataFrame:
    """(a, b), a < b: the pairs of the lists that their sizes and bits allow, each once."""
    bits = [f"s{k}" for k in range(BITS // 64)]
    lists = inverted_lists(sketches, long) if long is not None else sketches.select(F.explode("values").alias("value"), "doc", "n", *bits)
    a, b = lists.alias("a"), lists.alias("b").hint("merge")
    same = F.col("a.value") == F.col("b.value")
    if long is not None:  # members of one block count in its own group
        same = same & (F.col("a.group") == F.col("b.group")) & ((F.col("a.home") != F.col("b.home")) | (F.col("a.home") < 0))
    sized = F.least("a.n", "b.n") >= threshold * F.greatest("a.n", "b.n") - TINY
    apart = sum((F.bit_count(F.col(f"a.s{k}").bitwiseXOR(F.col(f"b.s{k}"))) for k in range(BITS // 64)), F.lit(0))
    alike = apart <= BITS - least_agreement(threshold)
    return a.join(b, same & (F.col("a.doc") < F.col("b.doc")) & sized & alike).select(F.col("a.doc").alias("a"), F.col("b.doc").alias("b")).distinct()


def candidates(sketches: DataFrame, threshold: float, width: int) -> DataFrame:
    """(a, b), a < b: of the sketches (doc, n, SKETCH) all pairs that have the similarity, and few others.

    The lists are met in rounds, so that no more than a share of them is on disk at once.
    """
    long = materialize(long_lists(sketches), "long")
    long = long if long.limit(1).count() else None
    rounds = ceil(keys_needed(threshold, width) / ROUND)
    if rounds == 1:
        return _met(sketches, threshold, long)
    made = None
    for i in range(rounds):
        own = F.filter("values", lambda v: F.pmod(v, F.lit(rounds)) == i)
        met = materialize(_met(sketches.withColumn("values", own), threshold, long), "met")
        collect_garbage(sketches.sparkSession)
        made = met if made is None else made.union(met)
    return made.distinct()
