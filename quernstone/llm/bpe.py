"""Problem 7: encode a corpus with a public byte-level BPE vocabulary.

Method: a priority queue of merge ranks over a doubly linked list of symbols. Entries whose symbols
have changed since they were pushed are stale and skipped when popped. Decoding concatenates the
vocabulary's byte strings. One pretoken is merged once per worker and then found in a bounded memo.

Defined cases: a null or empty text gives the empty list; a blank text is encoded as it is; strings
that look like special tokens are ordinary text; every input row gives one output row, also repeated
ones; columns other than the two named are not read, whatever their names.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.runtime import spread

# Fixed value: the pretokenizer's pattern of the vocabulary, and the same over ASCII alone.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
ASCII_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+"

#: Pretokens remembered per worker; the memo is emptied when full, which changes no result.
MEMO_ENTRIES = 400_000
#: Pretokens longer than this aren't remembered (base64 blobs and the like).
MEMO_LENGTH = 64


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Place of a vocabulary file of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name)


class BytePairEncoder:
    """Byte-level BPE by merge ranks."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.strings: list[bytes] = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.strings[rank] = token
        self.split = regex.compile(PATTERN).findall
        # Python's own \s holds the separators 0x1c-0x1f, the vocabulary's doesn't: such texts take the general pattern.
        self.plain = re.compile(r"[\t-\r -~\x00-\x08\x0e-\x1b\x7f]*").fullmatch
        self.split_plain = re.compile(ASCII_PATTERN).findall
        self.memo: dict[str, list[int]] = {}

    def merge(self, word: bytes) -> list[int]:
        """Ids of one pretoken: always the lowest-ranked adjacent pair, the leftmost of equals, is merged next."""
        ranks = self.ranks
        whole = ranks.get(word)
        if whole is not None:
            return [whole]
        n = len(word)
        symbol: list[bytes | None] = [word[i : i + 1] for i in range(n)]
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        queue = []
        for i in range(n - 1):
            rank = ranks.get(word[i : i + 2])
            if rank is not None:
                queue.append((rank, i))
        heapq.heapify(queue)
        while queue:
            rank, i = heapq.heappop(queue)
            left = symbol[i]
            if left is None:
                continue
            j = after[i]
            if j >= n or ranks.get(left + symbol[j]) != rank:
                continue  # stale: one of the two has been merged since
            joined = left + symbol[j]
            symbol[i], symbol[j] = joined, None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                rank = ranks.get(joined + symbol[k])
                if rank is not None:
                    heapq.heappush(queue, (rank, i))
            p = before[i]
            if p >= 0:
                rank = ranks.get(symbol[p] + joined)
                if rank is not None:
                    heapq.heappush(queue, (rank, p))
        return [ranks[s] for s in symbol if s is not None]

    def _look_up(self, word: str) -> list[int]:
        ids = self.merge(word.encode("utf-8", "replace"))
        if len(word) <= MEMO_LENGTH:
            if len(self.memo) >= MEMO_ENTRIES:
                self.memo.clear()
            self.memo[word] = ids
        return ids

    def pretokens(self, text: str) -> list[str]:
        return self.split_plain(text) if text.isascii() and self.plain(text) else self.split(text)

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        out: list[int] = []
        extend, known = out.extend, self.memo.get
        for word in self.pretokens(text):
            extend(known(word) or self._look_up(word))
        return out

    def count(self, text: str | None) -> int:
        """Length of encode(text), without building it."""
        if not text:
            return 0
        known = self.memo.get
        return sum([len(known(word) or self._look_up(word)) for word in self.pretokens(text)])

    def decode(self, ids: list[int]) -> bytes:
        strings = self.strings
        return b"".join([strings[i] for i in ids])


@lru_cache(maxsize=4)
def encoder(path: str) -> BytePairEncoder:
    """One encoder per Python worker and vocabulary."""
    return BytePairEncoder(path)


def encode_corpus(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(id_col, ids array<int>) of every row; see the module for nulls and blanks."""
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        for batch in batches:
            offsets, values = [0], []
            for text in batch.column(1).to_pylist():
                values.extend(encode(text))
                offsets.append(len(values))
            ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=[id_col, "ids"])

    rows = documents.select(F.col(id_col), F.col(text_col).cast("string"))
    kind = rows.schema[id_col].dataType.simpleString()
    return spread(rows).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def count_tokens(documents: DataFrame, keep: list[str], text_col: str = "text", path: str | None = None) -> DataFrame:
    """The columns `keep` and n_tokens, the length of the encoding, of every row."""
    path = path or vocabulary_path()
    rows = documents.select(*keep, F.col(text_col).cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = encoder(path).count
        for batch in batches:
            n = pa.array([count(t) for t in batch.column(batch.num_columns - 1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], n], names=[*keep, "n_tokens"])

    fields = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return spread(rows).mapInArrow(run, f"{fields}, n_tokens bigint")
