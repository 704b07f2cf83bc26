"""An order of hash values that puts rare ones first, from counts over all sets.

The sets are counted in chunks; of each chunk the values that fill at least one in 2**SHARE_BITS of its
places are passed on and summed up. A value that has this share of all places has it in some chunk, so
none of them is missed, and there are at most 2**SHARE_BITS of them, whatever the size of the table. All
other values count as rare. An order that is the same for all sets never loses a pair in the joins that
use it; how well it tells rare values apart only decides how many pairs are met in vain.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.runtime import materialize

SHARE_BITS = 19
#: Values that are counted together.
CHUNK = 1 << 22
#: Levels of a doubling of the count.
LEVELS = 4


class Ranks:
    """Levels of the frequent values (as signed integers): 0 for rare ones, then LEVELS for each doubling of the count."""

    def __init__(self, values: np.ndarray, counts: np.ndarray):
        order = np.argsort(values)
        self.values = values[order]
        self.levels = np.minimum(np.floor(np.log2(np.maximum(counts[order], 1)) * LEVELS) + 1, 255).astype(np.uint8)

    def of(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.values):
            return np.zeros(len(hashes), np.uint8)
        hashes = hashes.view(np.int64) if hashes.dtype == np.uint64 else hashes
        at = np.minimum(np.searchsorted(self.values, hashes), len(self.values) - 1)
        return np.where(self.values[at] == hashes, self.levels[at], 0).astype(np.uint8)

    @staticmethod
    def blocks(levels: np.ndarray, size: int) -> np.ndarray:
        """Blocks of at most about `size` members that the list of a value is cut into, by its level's upper end."""
        count = np.where(levels > 0, 2.0 ** (levels.astype(np.float64) / LEVELS), 1)
        return np.maximum(1, np.ceil(count / size)).astype(np.int32)


def value_ranks(sets: DataFrame, column: str, values_of: Callable[[pa.ListArray], np.ndarray] | None = None) -> Broadcast:
    """Ranks of the values in the arrays of `column`, sent to the executors: at most 2**SHARE_BITS entries.

    values_of gives the values of a batch of the column, if they are not those of its arrays.
    """
    spark = sets.sparkSession
    bits, chunk = SHARE_BITS, CHUNK  # by value, so that workers use this process's

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def counted() -> pa.RecordBatch:
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            keep = counts >= max(2, -(-size >> bits))
            values, counts = [None, *values[keep].tolist()], [size, *counts[keep].tolist()]
            return pa.RecordBatch.from_arrays([pa.array(values, pa.int64()), pa.array(counts, pa.int64())], names=["value", "n"])

        for batch in batches:
            values = values_of(batch.column(0)) if values_of else batch.column(0).flatten().to_numpy()
            held.append(values)
            size += len(values)
            if size >= chunk:
                yield counted()
                held, size = [], 0
        if size:
            yield counted()

    heavy = sets.select(column).mapInArrow(run, "value bigint, n bigint").groupBy("value").agg(F.sum("n").alias("n"))
    # the rows without a value tell how many there are in all
    heavy = materialize(heavy, "frequent")
    total = heavy.where("value is null").agg(F.sum("n")).first()[0] or 0
    table = heavy.where(F.col("value").isNotNull() & (F.col("n") >= max(2, -(-total >> SHARE_BITS)))).toArrow()
    return spark.sparkContext.broadcast(Ranks(table["value"].to_numpy(), table["n"].to_numpy()))
