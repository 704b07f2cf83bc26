"""Problem 1: personal information inside free text.

Method: a linear-chain conditional random field over words, word shapes and their neighbours, trained
from the small labelled table of pii_examples by gradient steps on the log-likelihood, and decoded by
Viterbi over numpy batches. Training takes some seconds, happens once per driver process with fixed
seeds and doesn't see the data; the weights are sent to the executors.

Every text is tagged as a whole. In a batch all tokens are scored together. A stretch of text is only
run through Viterbi if some token in it could leave the outside label: a path that does so gains at
most the token's best margin over the outside label plus its transitions' gains, and where no token's
bound is above zero the all-outside path is the best one, so skipping it changes no result.

A decoded span must pass a check of its form, by shape alone: an e-mail address needs an at sign (or its
spelling) and a dot, a telephone number 7 digits or number words, an identity number 5 digits, an address a
number and a word, a name two words or a title and a word, all in capitals but for particles, or none.

Defined cases: null and empty texts have no entities and stay as they are; repeated rows are tagged
alike; placeholders already in a text are left alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm.pii_examples import KINDS, labelled_table
from quernstone.runtime import spread

LABELS = ("O", *KINDS)
#: A token carries the blanks before it, so that the tokens of a text join to the text.
TOKEN = re.compile(r"[ \t]*(?:[^\W\d_]+|\d+|_|[^\w \t]|[ \t]+$)|[ \t]+", re.S)
OFFSETS = (-4, -3, -2, -1, 0, 1, 2, 3, 4)
#: Labelled texts to train from (a tenth more is held out for tests), passes over them and texts of a step.
TABLE_SIZE, PASSES, STEP = 12_000, 8, 250
#: Share of the words that training hides in the second copy of each text.
UNSEEN = 0.3
#: Words of the table that occur at least so often have weights of their own.
WORD_COUNT = 3
MEMO_TOKENS = 500_000

#: Words whose spelling is an ending of streets in German.
WAY = re.compile(r"\w{3,}(?:weg|straße|strasse|str|allee|platz|gasse|ring|ufer)$")


def shape(token: str) -> str:
    """Class of a token by its characters: letters by case, digits by number, other characters themselves."""
    t = token.strip(" \t")
    if not t:
        return " "
    if t.isdigit():
        return "d" + str(min(len(t), 11)) + ("z" if t[0] == "0" and len(t) == 5 else "")
    if t.isalpha():
        if len(t) == 1:
            return "X" if t.isupper() else "x"
        if t.islower():
            return "way" if WAY.match(t) else "xx"
        if t.isupper():
            return "XX" if len(t) > 2 else "XX2"
        if t[0].isupper():
            return "Way" if WAY.match(t.lower()) else "Xx" if t[1:].islower() else "XxX"
        return "xX"
    return t if t in "@.,:;-_/()[]<>{}\"'#$+&=*%\n" else "~"


#: Coarser classes, for the shapes of three neighbours together.
COARSE = ("", "x", "xx", "Xx", "X", "XX", "d1", "d3", "d4", "d5", "d7", "@", ".", ",", "-", "'", ":", "_", "#", "\"", "(", "/", "+", "$", "\n")


def coarse(kind: str) -> int:
    """Place of a shape's class in COARSE."""
    kind = kind.rstrip("_?") or kind[:1]
    if kind[0] == "d" and kind[1:2].isdigit():
        n = int(kind[1:].rstrip("z"))
        kind = "d1" if n < 3 else "d3" if n == 3 else "d4" if n == 4 else "d5" if n < 7 else "d7"
    kind = {"way": "xx", "xX": "xx", "Way": "Xx", "XxX": "Xx", "XX2": "XX", "[": "(", "<": "(", ")": "(", "]": "(", ">": "(", ";": ",", "{": "\"", "}": "\""}.get(kind, kind)
    return COARSE.index(kind) if kind in COARSE else 0


def tokens_of(text: str) -> list[str]:
    return TOKEN.findall(text)


class Crf:
    """Weights by feature: word and shape at each offset, the shapes of three neighbours, label transitions."""

    def __init__(self, words: dict[str, int], shapes: dict[str, int]):
        self.words, self.shapes = words, shapes
        self.plain: dict[str, int] = {}  # words of the table that are in no name
        n_l, n_o = len(LABELS), len(OFFSETS)
        self.W = np.zeros((n_o, len(words) + 1, n_l), np.float32)
        self.S = np.zeros((n_o, len(shapes) + 1, n_l), np.float32)
        self.T3 = np.zeros((len(COARSE) ** 3, n_l), np.float32)
        self.coarse = np.array([0, *(coarse(k) for k in shapes)])  # shapes are numbered in their order
        self.A = np.zeros((n_l, n_l), np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [self.W, self.S, self.T3, self.A]

    def codes(self, token: str, unseen: bool = False) -> tuple[int, int]:
        """(word, shape); unknown words, and letters if unseen, share code 0 and are told apart by their shape."""
        word = 0 if unseen and token.strip(" \t").isalpha() else self.words.get(token.strip(" \t").lower(), 0)
        kind = shape(token)
        if not word and kind in ("xx", "XX", "Xx"):
            kind += "?"
        if token[:1] in " \t" and kind + "_" in self.shapes:
            kind += "_"
        return word, self.shapes.get(kind, 0)

    def triples(self, s: np.ndarray) -> np.ndarray:
        """Codes of (previous, own, next) classes of shapes along the last axis."""
        n, s = len(COARSE), self.coarse[s]
        before, after = np.zeros_like(s), np.zeros_like(s)
        before[..., 1:], after[..., :-1] = s[..., :-1], s[..., 1:]
        return (before * n + s) * n + after

    def emissions(self, w: np.ndarray, s: np.ndarray) -> np.ndarray:
        """Scores (..., tokens, labels) of word and shape codes; code -1 stands before and after a text."""
        out = self.T3[self.triples(s)]
        size = w.shape[-1]
        for k, o in enumerate(OFFSETS):
            lo, hi = max(0, -o), min(size, size - o)
            if lo < hi:
                at = slice(lo, hi)
                of = slice(lo + o, hi + o)
                out[..., at, :] += self.W[k][w[..., of]] + self.S[k][s[..., of]]
        return out


def _encode(table: list[list[tuple[str, str | None]]]) -> list[tuple[list[str], list[int]]]:
    """Tokens and labels; a token belongs to the piece that holds its first character that is no blank."""
    out = []
    for pieces in table:
        kinds = [LABELS.index(k) if k else 0 for t, k in pieces for _ in t]
        tokens, labels, at = tokens_of("".join(t for t, _ in pieces)), [], 0
        for token in tokens:
            first = at + len(token) - len(token.lstrip(" \t"))
            labels.append(kinds[min(first, len(kinds) - 1)])
            at += len(token)
        out.append((tokens, labels))
    return out


def train(size: int = TABLE_SIZE, seed: int = 7) -> Crf:
    """A CRF from the first `size` texts of the labelled table, by Adam on batches of texts of like length."""
    data = _encode(labelled_table(size, seed))
    counts: dict[str, int] = {}
    shapes: dict[str, int] = {}
    for tokens, labels in data:
        for token, label in zip(tokens, labels):
            word = token.strip(" \t").lower()
            if label == 0 or not word.isalpha():
                counts[word] = counts.get(word, 0) + 1
            kind = shape(token)
            for k in (kind, kind + "_") if token[:1] in " \t" else (kind,):
                shapes.setdefault(k, len(shapes) + 1)
    for k in ("xx?", "XX?", "Xx?"):
        shapes.setdefault(k, len(shapes) + 1)
        shapes.setdefault(k + "_", len(shapes) + 1)
    # words inside entities too, if they are part of the form (street kinds, titles, Box)
    for tokens, labels in data:
        for token, label in zip(tokens, labels):
            word = token.strip(" \t").lower()
            if label and word.isalpha():
                counts[word] = counts.get(word, 0) + 0.2
    inside = {t.strip(" \t").lower() for tokens, labels in data for t, x in zip(tokens, labels) if LABELS[x] == "NAME"}
    words = {w: i + 1 for i, w in enumerate(sorted(w for w, n in counts.items() if n >= WORD_COUNT and not w.isdigit()))}
    crf = Crf(words, shapes)
    crf.plain = {w: i for w, i in words.items() if w not in inside}
    coded = []
    rng = np.random.default_rng(seed)
    for tokens, labels in [*data, *data]:
        # the second time without a part of the words, so that other words around an entity are met in training
        unseen = rng.random(len(tokens)) < (UNSEEN if len(coded) >= len(data) else 0)
        pairs = [crf.codes(t, u) for t, u in zip(tokens, unseen)]
        coded.append((np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs]), np.array(labels)))
    coded.sort(key=lambda x: len(x[0]))
    batches = [coded[i : i + STEP] for i in range(0, len(coded), STEP)]
    params = crf.parameters()
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step = 0
    for p in range(PASSES):
        rate = 0.08 * (1 - p / PASSES) + 0.005
        for b in rng.permutation(len(batches)):
            grads = _gradient(crf, batches[b])
            step += 1
            for x, g, m, v in zip(params, grads, first, second):
                g += 1e-6 * len(coded) / len(batches) * x
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                x -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    return crf


def _gradient(crf: Crf, batch: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """Gradient of the mean negative log-likelihood, by forward and backward sums over padded texts."""
    n, size, n_l = len(batch), max(len(x[0]) for x in batch), len(LABELS)
    w, s, y = np.zeros((n, size), np.int64), np.zeros((n, size), np.int64), np.zeros((n, size), np.int64)
    mask = np.zeros((n, size), bool)
    for i, (a, b, c) in enumerate(batch):
        w[i, : len(a)], s[i, : len(a)], y[i, : len(a)], mask[i, : len(a)] = a, b, c, True
    e = crf.emissions(w, s).astype(np.float64)
    e[~mask] = [0] + [-30] * (n_l - 1)  # padding stays outside
    ex = np.exp(crf.A.astype(np.float64))
    ee = np.exp(e - e.max(2, keepdims=True))
    alpha, beta = np.empty_like(e), np.empty_like(e)
    alpha[:, 0] = ee[:, 0] / ee[:, 0].sum(1, keepdims=True)
    for t in range(1, size):
        a = (alpha[:, t - 1] @ ex) * ee[:, t]
        alpha[:, t] = a / a.sum(1, keepdims=True)
    beta[:, -1] = 1
    for t in range(size - 2, -1, -1):
        b = (beta[:, t + 1] * ee[:, t + 1]) @ ex.T
        beta[:, t] = b / b.sum(1, keepdims=True)
    p = alpha * beta
    p /= p.sum(2, keepdims=True)
    pair = np.einsum("ntl,ntk->ntlk", alpha[:, :-1], beta[:, 1:] * ee[:, 1:]) * ex
    pair /= pair.sum((2, 3), keepdims=True)
    both = mask[:, 1:]
    d_a = pair[both].sum(0)
    np.add.at(d_a, (y[:, :-1][both], y[:, 1:][both]), -1)
    np.put_along_axis(p, y[..., None], np.take_along_axis(p, y[..., None], 2) - 1, 2)
    p[~mask] = 0

    def scatter(index: np.ndarray, values: np.ndarray, rows: int) -> np.ndarray:
        flat = (index[..., None] * n_l + np.arange(n_l)).ravel()
        return np.bincount(flat, values.ravel(), rows * n_l).reshape(rows, n_l)

    d_w, d_s = np.zeros(crf.W.shape), np.zeros(crf.S.shape)
    for k, o in enumerate(OFFSETS):
        lo, hi = max(0, -o), min(size, size - o)
        if lo < hi:
            g = p[:, lo:hi]
            d_w[k] = scatter(w[:, lo + o : hi + o], g * mask[:, lo + o : hi + o, None], len(d_w[k]))
            d_s[k] = scatter(s[:, lo + o : hi + o], g * mask[:, lo + o : hi + o, None], len(d_s[k]))
    d_t = scatter(crf.triples(s), p, len(crf.T3))
    return [(d / n).astype(np.float32) for d in (d_w, d_s, d_t, d_a)]


@lru_cache(maxsize=2)
def trained(size: int = TABLE_SIZE) -> Crf:
    return train(size)


# --- tagging ---------------------------------------------------------------------------------


class Tagger(dict):
    """A trained field prepared for batches: weights of word and shape are added up per known token.

    As a dictionary it holds the code of each token met so far.
    """

    def __init__(self, crf: Crf):
        super().__init__()
        self.crf = crf
        self.pairs: list[tuple[int, int]] = []
        self.known: dict[tuple[int, int], int] = {}
        self.gain = float(np.max(crf.A[0, 1:] - crf.A[0, 0]))  # leaving the outside label
        self.back = float(np.max(crf.A[1:, 0] - crf.A[0, 0]))  # returning to it
        self.stay = float(np.max(crf.A[1:, 1:] - crf.A[0, 0]))  # within entities
        self.tables: np.ndarray | None = None

    def __missing__(self, token: str) -> int:
        pair = self.crf.codes(token)
        code = self.known.get(pair)
        if code is None:
            code = self.known[pair] = len(self.pairs)
            self.pairs.append(pair)
        if len(self) >= MEMO_TOKENS:
            self.clear()
        self[token] = code
        return code

    def _prepare(self) -> None:
        if self.tables is None or len(self.tables[0]) < len(self.pairs):
            w, s = np.array([p[0] for p in self.pairs]), np.array([p[1] for p in self.pairs])
            self.tables = self.crf.W[:, w] + self.crf.S[:, s]
            self.shape_of = s

    def tag(self, texts: list[str]) -> list[tuple[int, list[tuple[int, int, int]]]]:
        """(text's index, [(label, first token, token after)]) of the texts with entities; see tokens()."""
        self.lists = [TOKEN.findall(t) for t in texts]
        lengths = np.fromiter(map(len, self.lists), np.int64, len(texts))
        if not lengths.sum():
            return []
        pad = len(OFFSETS) // 2 + 1  # between texts, so that no text sees its neighbours
        starts = np.cumsum(lengths + pad) - lengths
        total = int(starts[-1] + lengths[-1] + pad)
        flat = np.fromiter(map(self.__getitem__, chain.from_iterable(self.lists)), np.int64, int(lengths.sum()))
        self._prepare()
        inside = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(len(flat))
        codes = np.full(total, -1)
        codes[inside] = flat
        real = codes >= 0
        shapes = np.where(real, self.shape_of[codes], 0)
        e = self.crf.T3[self.crf.triples(shapes)]
        n_l = len(LABELS)
        tables = np.concatenate([self.tables, np.zeros((len(OFFSETS), 1, n_l), np.float32)], axis=1)  # the last row, code -1, is empty
        for k, o in enumerate(OFFSETS):
            lo, hi = max(0, -o), min(total, total - o)
            e[lo:hi] += tables[k].take(codes[lo + o : hi + o], axis=0, mode="wrap")
        margin = e[:, 1:].max(axis=1) - e[:, 0]
        # a token can only be inside an entity if margins around it can pay for it
        bound = margin + max(self.stay, self.gain) + max(self.back, 0)
        hot = np.flatnonzero((bound > 0) & real)
        if not len(hot):
            return []
        which = np.searchsorted(starts, hot, side="right") - 1
        found = np.unique(which)
        out = []
        order = found[np.argsort(lengths[found], kind="stable")]
        for at in range(0, len(order), 256):
            group = order[at : at + 256]
            size = int(lengths[group].max())
            block = np.zeros((len(group), size, n_l), np.float32)
            block[:, :, 1:] = -1e4
            for i, t in enumerate(group):
                block[i, : lengths[t]] = e[starts[t] : starts[t] + lengths[t]]
            for t, path in zip(group.tolist(), viterbi(block, self.crf.A)):
                path = path[: lengths[t]]
                if path.any():
                    cuts = np.flatnonzero(np.diff(path, prepend=0, append=0))
                    spans = [(int(path[a]), int(a), int(b)) for a, b in zip(cuts[:-1], cuts[1:]) if path[a]]
                    out.append((t, spans))
        return out


def viterbi(e: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """Best label paths (texts, tokens) for scores (texts, tokens, labels)."""
    n, size, n_l = e.shape
    back = np.empty((n, size, n_l), np.int8)
    score = e[:, 0].copy()
    for t in range(1, size):
        through = score[:, :, None] + transitions
        best = through.argmax(axis=1)
        back[:, t] = best
        score = np.take_along_axis(through, best[:, None, :], 1)[:, 0] + e[:, t]
    path = np.empty((n, size), np.int64)
    path[:, -1] = score.argmax(axis=1)
    rows = np.arange(n)
    for t in range(size - 1, 0, -1):
        path[:, t - 1] = back[rows, t, path[:, t]]
    return path


# Words and signs of the forms that are checked.
NUMBER_WORDS = re.compile(r"\b(?:zero|oh|one|two|three|four|five|six|seven|eight|nine|double)\b", re.I)
SPELLED_AT = re.compile(r"[\[(<{ ]\s*(?:at|@)\s*[\])>} ]", re.I)
SPELLED_DOT = re.compile(r"\bdot\b|\.", re.I)
TITLES = re.compile(r"^(?:mrs?|ms|dr|prof|herr|frau|se[ñn]ora?|madame|sir|miss)\b", re.I)
SENTENCE_END = re.compile(r"[^\W\d_]{5,}[.!?]\s")
#: Words in lower case within a name in capitals.
PARTICLES = frozenset("de da del della den der di do dos du el la le van von zu y bin al".split())


def name_within(text: str, start: int, end: int) -> tuple[int, int]:
    """The longest part of a span whose words are all in capitals, but for particles within; the span if none is or all are."""
    words = [m.span() for m in re.finditer(r"[^\W\d_](?:[^\W_]|['’.-](?=\w))*\.?", text[start:end])]
    capital = [text[start + a].isupper() for a, _ in words]
    if not any(capital) or all(capital):
        return start, end
    best, run = (0, 0), 0
    while run < len(words):
        stop = run
        while stop < len(words) and (capital[stop] or text[start + words[stop][0] : start + words[stop][1]] in PARTICLES):
            stop += 1
        last = stop
        while last > run and not capital[last - 1]:
            last -= 1
        if capital[run] and last - run > best[1] - best[0]:
            best = run, last
        run = max(stop, run + 1)
    if best == (0, 0):
        return start, end
    return start + words[best[0]][0], start + words[best[1] - 1][1]


def well_formed(kind: str, text: str, known: dict[str, int] | None = None) -> bool:
    """The check of a span's form. known: words of the table that are part of no name."""
    digits = sum(map(str.isdigit, text))
    words = re.findall(r"[^\W\d_]+", text)
    if kind == "EMAIL":
        if "@" in text and SPELLED_DOT.search(text):
            return len(words) >= 2
        at = SPELLED_AT.search(text)
        return bool(at and SPELLED_DOT.search(text, at.end()) and (" dot " in text.lower() or at.group().strip() not in ("at", "AT", "At")))
    if kind == "PHONE":
        return digits >= 7 or len(NUMBER_WORDS.findall(text)) >= 7
    if kind == "ID_NUMBER":
        return digits >= 5
    if kind == "ADDRESS":
        return digits >= 1 and ";" not in text and any(len(w) > 1 for w in words)
    if SENTENCE_END.search(text):
        return False
    if digits or not (sum(len(w) > 1 for w in words) >= 2 or (TITLES.match(text.strip()) and len(words) >= 2)):
        return False
    # without capitals only words that the table doesn't know as ordinary ones can be a name
    return not text.islower() or not any(w in (known or {}) for w in words)


def entities(tagger: Tagger, texts: list[str]) -> list[tuple[int, list[tuple[str, int, int]]]]:
    """(text's index, [(kind, start, end)]) by characters, of the texts with entities."""
    out = []
    for t, spans in tagger.tag(texts):
        ends = np.cumsum([len(x) for x in tagger.lists[t]])
        text, kept, parts = texts[t], [], []
        for label, a, b in spans:
            start, end = int(ends[a - 1]) if a else 0, int(ends[b - 1])
            piece = text[start:end]
            start += len(piece) - len(piece.lstrip())
            end -= len(piece) - len(piece.rstrip())
            kind = LABELS[label]
            if kind == "NAME":
                stop = SENTENCE_END.search(text, start, end)
                if stop:  # a name doesn't go on behind a sentence: the part that has the form of one
                    first = start, stop.end() - 2
                    start, end = first if well_formed(kind, text[slice(*first)], tagger.crf.plain) else (stop.end(), end)
                start, end = name_within(text, start, end)
            if kind in ("ID_NUMBER", "PHONE") and LONGER.search(text[max(0, start - 2) : start] + "\0" + text[end : end + 2]):
                continue  # a part of a longer code
            if well_formed(kind, text[start:end], tagger.crf.plain):
                kept.append((kind, start, end))
            elif kind == "NAME":
                parts.append((kind, start, end))
        # a record gives the parts of a name in fields of their own
        if len(parts) >= 2 and FIELDS.search(text):
            kept = sorted(kept + parts, key=lambda k: k[1])
        if kept:
            out.append((t, kept))
    return out


LONGER = re.compile(r"\w-?\0|\0-?\w")
FIELDS = re.compile(r'"(?:first|given)_?name":\s*"', re.I)


def redacted(text: str, found: list[tuple[str, int, int]]) -> str:
    """The text with a typed placeholder for each entity."""
    out, at = [], 0
    for kind, start, end in found:
        out += [text[at:start], f"[{kind}]"]
        at = end
    return "".join([*out, text[at:]])


def find_personal_information(records: DataFrame, id_col: str, text_col: str, keep: list[str] | None = None, crf: Crf | None = None, with_text: bool = True) -> DataFrame:
    """(keep, id_col, kinds array<string>, redacted) of the rows whose text holds personal information.

    kinds are the distinct kinds found, in order of the alphabet; redacted is the text with typed
    placeholders, null if with_text is false. Rows without any have no row: their text stays as it is.
    """
    keep = keep or []
    spark = records.sparkSession
    weights = spark.sparkContext.broadcast(crf or trained())  # a few MB, of fixed size
    rows = records.select(*keep, F.col(id_col), F.col(text_col).cast("string").alias("__text")).where(F.length("__text") > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = _tagger(weights)
        for batch in batches:
            for at in range(0, batch.num_rows, 2_000):
                part = batch.slice(at, 2_000)
                texts = part.column(part.num_columns - 1).to_pylist()
                found = sorted(entities(tagger, texts))
                if found:
                    take = pa.array([i for i, _ in found])
                    kinds = pa.array([sorted({k for k, _, _ in spans}) for _, spans in found], pa.list_(pa.string()))
                    text = pa.array([redacted(texts[i], spans) if with_text else None for i, spans in found], pa.string())
                    yield pa.RecordBatch.from_arrays([*[c.take(take) for c in part.columns[:-1]], kinds, text], names=[*keep, id_col, "kinds", "redacted"])

    fields = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in [*keep, id_col])
    return spread(rows).mapInArrow(run, f"{fields}, kinds array<string>, redacted string")


_prepared: dict[int, Tagger] = {}


def _tagger(weights: Broadcast) -> Tagger:
    """One prepared tagger per worker and broadcast."""
    key = id(weights.value)
    if key not in _prepared:
        _prepared.clear()
        _prepared[key] = Tagger(weights.value)
    return _prepared[key]
