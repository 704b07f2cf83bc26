"""Problem 8: fill fixed-capacity containers with documents.

Method: space-filling-curve order. Each document's hashed token vector is projected to three
dimensions, its cell's place on a Hilbert curve is its key, and documents are packed in order of their
keys: a window of WINDOW neighbours moves along the curve, a container takes its oldest pieces in order,
and its last room goes to the one or two pieces of the window that leave the least. The oldest piece opens
the next container, so that what is passed over is carried along the curve no further than that.

Ranges of the curve are packed side by side. They come from a histogram of the key's upper bits, of a
fixed size: cells are cut by the tokens before them, and the documents of a cell that holds more than a
range (copies of one page, say) are spread over its ranges by hash. Only a range's last container can stay
far from full.

Defined cases: documents with a null or empty text have no row, blank ones are packed; a document
larger than the capacity is cut into full containers and a rest, a piece each; repeated rows are
packed as often as they occur; a profile with a null or non-positive capacity gives no rows; an empty
table gives none. Extra columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as SqlWindow
from pyspark.sql import functions as F

from quernstone.llm.bpe import encoder, vocabulary_path
from quernstone.runtime import materialize, shuffle_partitions, slots, spread

DIMENSIONS, BITS = 3, 16
#: Tokens of a range: with capacities in the thousands its open ends are under 1 in 500.
RANGE_TOKENS = 8_000_000
#: Upper bits of the key in the histogram that ranges are cut by, and how many of them are summed up first.
CELL_BITS, COARSE_BITS = 18, 9
#: Neighbours on the curve that a container is filled from.
WINDOW = 64
#: Profiles are read to the driver; a larger table is refused.
MAX_PROFILES = 1_000


def projection(rows: int, seed: int = 20_310_101) -> np.ndarray:
    """A random direction for each token id: the hashed document vector's projection to few dimensions."""
    return np.random.default_rng(seed).standard_normal((rows, DIMENSIONS)).astype(np.float32)


def hilbert_key(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of integer cells (n, d), each coordinate in [0, 2**bits).

    The coordinates are turned into the curve's transposed index from the top bit down: a set bit
    mirrors the lower bits of the first axis, a clear one swaps them with the axis's own. The bits of
    the Gray-decoded result are then interleaved.
    """
    x = cells.astype(np.uint64).T.copy()
    d = len(x)
    one = np.uint64(1)
    for b in range(bits - 1, 0, -1):
        q = one << np.uint64(b)
        low = q - one
        for i in range(d):
            is_set = (x[i] & q) != 0
            swap = np.where(is_set, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] ^= np.where(is_set, low, swap)
            x[i] ^= swap
    for i in range(1, d):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        q = one << np.uint64(b)
        flip ^= np.where((x[d - 1] & q) != 0, q - one, np.uint64(0))
    x ^= flip
    key = np.zeros(len(cells), np.uint64)
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << one) | ((x[i] >> np.uint64(b)) & one)
    return key.astype(np.int64)


def place_on_curve(documents: DataFrame, id_col: str, text_col: str, path: str) -> DataFrame:
    """(id_col, n_tokens, curve) of each document with a text."""
    rows = documents.select(F.col(id_col), F.col(text_col).cast("string").alias("__text")).where(F.length("__text") > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        directions = projection(len(bpe.strings))
        for batch in batches:
            sizes = np.zeros(batch.num_rows, np.int64)
            sums = np.zeros((batch.num_rows, DIMENSIONS), np.float64)
            for i, text in enumerate(batch.column(1).to_pylist()):
                ids = bpe.encode(text)
                sizes[i] = len(ids)
                sums[i] = directions[ids].sum(axis=0)
            # a sum of n unit normals has the deviation sqrt(n): the logistic curve spreads it over the cells
            z = sums / np.sqrt(np.maximum(sizes, 1))[:, None]
            cells = np.minimum((1 / (1 + np.exp(-z / 4)) * 2**BITS).astype(np.int64), 2**BITS - 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), pa.array(hilbert_key(cells))], names=[id_col, "n_tokens", "curve"])

    kind = rows.schema[id_col].dataType.simpleString()
    return spread(rows).mapInArrow(run, f"`{id_col}` {kind}, n_tokens bigint, curve bigint")


class Window:
    """Packs pieces that come in order of the curve into containers of one capacity, from a window of neighbours."""

    def __init__(self, capacity: int, size: int = WINDOW):
        self.capacity, self.size = capacity, size
        self.queue: deque[tuple[int, int]] = deque()  # (length, number) by arrival; some are taken already
        self.sizes: list[tuple[int, int]] = []  # the same, by length, without the taken ones
        self.taken: set[int] = set()

    def add(self, number: int, length: int) -> list[tuple[int, int]] | None:
        """A container as [(number, offset)], if one could be filled."""
        if length == self.capacity:
            return [(number, 0)]
        self.queue.append((length, number))
        insort(self.sizes, (length, number))
        return self.fill() if len(self.sizes) >= self.size else None

    def fill(self) -> list[tuple[int, int]]:
        """The next container: the oldest pieces in order, then what leaves the least room."""
        out, room = [], self.capacity

        def take(length: int, number: int) -> None:
            nonlocal room
            out.append((number, self.capacity - room))
            room -= length
            del self.sizes[bisect_left(self.sizes, (length, number))]
            self.taken.add(number)

        while self.queue:
            length, number = self.queue[0]
            if number in self.taken:
                self.taken.discard(number)
            elif not out or room - length >= 2 * self.sizes[-1][0]:
                take(length, number)
                self.taken.discard(number)
            else:
                break
            self.queue.popleft()
        while self.sizes and self.sizes[0][0] <= room:
            for piece in self.best(room):
                take(*piece)
        return out

    def best(self, room: int) -> list[tuple[int, int]]:
        """The piece, or the two pieces, that fill most of the room."""
        sizes, hi = self.sizes, bisect_left(self.sizes, (room + 1, -1)) - 1
        found, used, lo = [sizes[hi]], sizes[hi][0], 0
        while lo < hi and used < room:
            both = sizes[lo][0] + sizes[hi][0]
            if both > room:
                hi -= 1
            else:
                if both > used:
                    found, used = [sizes[hi], sizes[lo]], both
                lo += 1
        return found


def pack_ranges(pieces: Iterator[pd.DataFrame], id_col: str, first: int) -> Iterator[pd.DataFrame]:
    """Containers for pieces that come sorted by (range, profile, curve); first is the first container's number."""
    key, window, made = None, None, first
    held: dict[int, tuple] = {}
    rows: list[tuple] = []

    def close(container: list[tuple[int, int]]) -> None:
        nonlocal made
        for number, offset in container:
            profile, record, piece, start, length, capacity = held.pop(number)
            rows.append((profile, made, record, piece, start, length, offset, capacity, number))
        made += 1

    def table() -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["profile", "container", id_col, "piece", "piece_start", "length", "container_offset", "capacity", "place"])
        rows.clear()
        return out

    number = 0
    for batch in pieces:
        columns = [batch[c].tolist() for c in ("range", "profile", id_col, "piece", "piece_start", "length", "capacity")]
        for of, profile, record, piece, start, length, capacity in zip(*columns):
            if (of, profile) != key:
                while window is not None and window.sizes:
                    close(window.fill())
                key, window, number = (of, profile), Window(capacity), 0
            held[number] = (profile, record, piece, start, length, capacity)
            container = window.add(number, length)
            number += 1
            if container:
                close(container)
        if rows:
            yield table()
    while window is not None and window.sizes:
        close(window.fill())
    if rows:
        yield table()


def ranges_of(placed: DataFrame, id_col: str) -> DataFrame:
    """placed with the column range: consecutive parts of the curve of about RANGE_TOKENS tokens."""
    cell = F.shiftright("curve", DIMENSIONS * BITS - CELL_BITS)
    cells = placed.groupBy(cell.alias("cell")).agg(F.sum("n_tokens").alias("tokens")).withColumn("coarse", F.shiftright("cell", CELL_BITS - COARSE_BITS))
    cells = materialize(cells, "cells")  # at most 2**CELL_BITS rows
    before = SqlWindow.orderBy("coarse").rowsBetween(SqlWindow.unboundedPreceding, -1)  # over at most 2**COARSE_BITS rows
    coarse = cells.groupBy("coarse").agg(F.sum("tokens").alias("all")).withColumn("offset", F.coalesce(F.sum("all").over(before), F.lit(0))).drop("all")
    within = SqlWindow.partitionBy("coarse").orderBy("cell").rowsBetween(SqlWindow.unboundedPreceding, -1)
    starts = cells.withColumn("start", F.coalesce(F.sum("tokens").over(within), F.lit(0))).join(coarse, "coarse").select("cell", "tokens", (F.col("start") + F.col("offset")).alias("start"))
    inside = F.when(F.col("tokens") > RANGE_TOKENS, F.pmod(F.xxhash64(id_col), "tokens")).otherwise(F.expr("tokens div 2"))
    joined = placed.withColumn("cell", cell).join(F.broadcast(starts), "cell")  # bounded as above
    return joined.withColumn("range", F.floor((F.col("start") + inside) / RANGE_TOKENS)).drop("cell", "start", "tokens")


def pack_documents(documents: DataFrame, profiles: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(profile, container, id_col, piece, piece_start, length, container_offset, capacity, place) of every piece of every document.

    container_offset is where the piece starts in its container, in tokens, piece_start where it starts in
    the document; place is its rank on its range of the curve.
    """
    spark = documents.sparkSession
    kinds = [(r["profile"], r["capacity_tokens"]) for r in profiles.select("profile", "capacity_tokens").dropDuplicates().limit(MAX_PROFILES + 1).collect()]
    if len(kinds) > MAX_PROFILES:
        raise ValueError(f"more than {MAX_PROFILES} profiles")
    kinds = [(p, int(c)) for p, c in kinds if p is not None and c is not None and c > 0]
    placed = materialize(place_on_curve(documents, id_col, text_col, path or vocabulary_path()), "curve")
    kind = placed.schema[id_col].dataType.simpleString()
    out = f"profile string, container bigint, `{id_col}` {kind}, piece int, piece_start bigint, length bigint, container_offset bigint, capacity bigint, place bigint"
    if not kinds:
        return spark.createDataFrame([], out)
    each = F.explode(F.array(*[F.struct(F.lit(p).alias("profile"), F.lit(c).cast("bigint").alias("capacity")) for p, c in kinds])).alias("k")
    pieces = (
        ranges_of(placed, id_col).select(id_col, "n_tokens", "curve", "range", each)
        .select(
            "range", "k.profile", "k.capacity", id_col, "curve", "n_tokens",
            F.posexplode(F.sequence(F.lit(0).cast("bigint"), F.expr("(n_tokens - 1) div k.capacity"))).alias("piece", "at"),
        )
        .select(
            "range", "profile", "capacity", id_col, "curve", "piece", (F.col("at") * F.col("capacity")).alias("piece_start"),
            F.least("capacity", F.col("n_tokens") - F.col("at") * F.col("capacity")).alias("length"),
        )
    )
    order = ["range", "profile", "curve", id_col, "piece"]
    ranged = pieces.repartition(max(slots(spark), shuffle_partitions(spark)), "range", "profile").sortWithinPartitions(*order)
    return ranged.mapInPandas(lambda it: pack_ranges(it, id_col, TaskContext.get().partitionId() << 32), out)


def packing_report(packed: DataFrame) -> DataFrame:
    """Of each profile: containers, pieces, tokens, unused tokens, the share of the room that is used, and how many
    places of the curve a container spans on average, beyond its own pieces."""
    per = packed.groupBy("profile", "container").agg(
        F.sum("length").alias("used"), F.first("capacity").alias("capacity"), F.count("*").alias("pieces"), (F.max("place") - F.min("place") + 1).alias("span"))
    return per.groupBy("profile").agg(
        F.count("*").alias("containers"), F.sum("pieces").alias("pieces"), F.sum("used").alias("tokens"),
        F.sum(F.col("capacity") - F.col("used")).alias("unused"),
        F.round(F.sum("used") / F.sum("capacity"), 6).alias("fill"), F.round(F.avg(F.col("span") - F.col("pieces")), 2).alias("apart"),
    )


def packing_checks(packed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Of each profile: documents, pieces that don't follow on one another in document or container, containers over
    capacity, and whether the room is used to 98 % but for a container of each range, near the order of the curve."""
    piece = SqlWindow.partitionBy("profile", id_col).orderBy("piece")
    spot = SqlWindow.partitionBy("profile", "container").orderBy("container_offset")
    follows = lambda at, w: F.col(at) == F.coalesce(F.lag(F.col(at) + F.col("length")).over(w), F.lit(0))
    rows = packed.withColumns({"torn": ~follows("piece_start", piece), "holes": ~follows("container_offset", spot)})
    per = rows.groupBy("profile", "container").agg(
        F.sum("length").alias("used"), F.first("capacity").alias("capacity"), F.count_if(F.expr("piece = 0")).alias("documents"), F.count("*").alias("pieces"),
        F.count_if("torn").alias("torn"), F.count_if("holes").alias("holes"), (F.max("place") - F.min("place") + 1).alias("span"))
    ranges = F.ceil(F.sum("used") / RANGE_TOKENS) + 1
    return per.groupBy("profile").agg(
        F.sum("documents").alias("documents"), F.sum("torn").alias("torn"), F.sum("holes").alias("holes"),
        F.count_if(F.expr("used > capacity")).alias("overfull"),
        (F.sum("used") >= 0.98 * F.sum("capacity") - ranges * F.max("capacity")).alias("filled"), (F.avg(F.col("span") - F.col("pieces")) <= 3 * WINDOW).alias("near"))
