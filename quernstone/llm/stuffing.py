"""Problem 9: pages of repeated keywords, link lists and product tags.

Method: each page's suffix automaton gives for every position the longest substring ending there that
occurs again in the page; the union of these maximal repeats are the covered characters. It is built twice:
over the page's words (single characters in scripts written without spaces) and markup, and over its form,
where a word or number is one symbol and only markup is told apart; repeats of the form count if they hold
list markup (hash signs, slashes, bullets, bars) at least twice, as links, menus and tags repeat their
markup and hosts even where no two entries are alike.

A page is cut into units (lines, and sentences within lines). A unit's want of clause structure falls from 1
to 0 around one in WORDS_A_CLAUSE_WORD of the words that sentences can't do without (articles, auxiliaries,
pronouns, conjunctions); a remark in brackets belongs to the sentence before it in its line, and a key with a
value, as in logs and records, has a structure of its own. A unit adds its covered characters, or all if they are REPEATED of it, weighed by
that want; a page is junk if the sum is more than half of its text.

The automata are only built where the want of all units, were they covered as a whole, could reach half of
the text: elsewhere they can't change the result.

Defined cases: null, empty and blank texts and those under MIN_CHARS are no junk; every other row is
judged by itself, so copies of a junk page are junk too; extra columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.runtime import spread

MIN_CHARS = 120
#: Share of the text that must be junk.
SHARE = 0.5
#: Share of a unit that repeats must cover for the whole unit, with its separators, to be part of a list.
REPEATED = 0.3
#: Words of a unit for each of which one clause word is asked.
WORDS_A_CLAUSE_WORD = 10

# Words that sentences need and keyword lists lack, by language; none that lists use as filler (of, in, or, with, and, for, near, me, our, every, de).
CLAUSE_WORDS = frozenset(
    "the a an is are was were be been being has have had do does did will would shall should can could may might must "
    "not no that this these those it its he she they we you your i my his her their which who whom when while because "
    "although unless if after before until to from by as at on than then there has been into both each two "
    "der die das den dem des ein eine einen einem einer ist sind war wird werden wurde hat haben nicht kein keine zu "
    "auf bei nach vor laut dass weil wenn sie ich wir es sich im am bitte noch nur mit "
    "el la los las un una es son está están se su sus que no por al del lo le ha han fue sin para cuando porque si como mi "
    "le les une est sont dans pour que qui pas du au avec il elle nous vous ce cette".split()
)
CLAUSE_CHARS = frozenset("的了在是不为将从到被把与和已需应请吧也都就并而但所对会能要后再每由个一只次该此因")
SEPARATORS = str.maketrans({c: " " for c in ".,;:!?()[]{}\"'|/<>*·»–—-=。，；：！？（）“”"})
CJK = re.compile(r"[぀-ヿ㐀-鿿가-힯]")
UNIT_ENDS = re.compile(r"[.!?;](?=[ \t])|[\r\n\u2028\u2029]+|[。！？；]")
LINE_END = re.compile(r"[\r\n\u2028\u2029]")
BRACKETS = re.compile(r"[ \t]*[(\[][^()\[\]]*[)\]]\s*$")
#: Keys with a short value or a structured one.
RECORD = re.compile(r"\s*(?:[-*>] )?[\w. ()\"'-]{1,40}(?::(?=\s)|[=\t])\s*(?:[{\[].*|(?:\S+[ \t]+){0,7}\S+\s*$)|\s*[{\[]\s*[\"{\[].*")
TOKENS = re.compile(r"[぀-ヿ㐀-鿿가-힯]|[^\W_぀-ヿ㐀-鿿가-힯]+|[#/|>*•·\n]")
MARKUP = frozenset("#/|>*•·")
#: Symbols of a repeat of the form, and list markup in it, at least.
FORM_SYMBOLS, FORM_MARKUP = 4, 2


class SuffixAutomaton:
    """Suffix automaton over a list of symbols, with the number of occurrences of each state's strings."""

    def __init__(self, symbols: list):
        self.next: list[dict] = [{}]
        self.link, self.length, self.count = [-1], [0], [0]
        self.at: list[int] = []  # the state of each prefix
        last = 0
        for symbol in symbols:
            last = self._extend(last, symbol)
            self.at.append(last)
        order = sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True)
        for v in order:
            self.count[self.link[v]] += self.count[v]

    def _extend(self, last: int, symbol) -> int:
        edges, link, length, count = self.next, self.link, self.length, self.count
        new = len(length)
        edges.append({})
        length.append(length[last] + 1)
        link.append(0)
        count.append(1)
        p = last
        while p >= 0 and symbol not in edges[p]:
            edges[p][symbol] = new
            p = link[p]
        if p >= 0:
            q = edges[p][symbol]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                clone = len(length)
                edges.append(edges[q].copy())
                length.append(length[p] + 1)
                link.append(link[q])
                count.append(0)
                while p >= 0 and edges[p].get(symbol) == q:
                    edges[p][symbol] = clone
                    p = link[p]
                link[q] = link[new] = clone
        return new

    def repeats(self) -> list[int]:
        """For each position, the length of the longest substring ending there that occurs at least twice."""
        link, length, count = self.link, self.length, self.count
        return [length[v] if count[v] > 1 else length[link[v]] for v in self.at]


def want_of_clause(words: str) -> float:
    """From 1, for a unit (in lower case, without punctuation) with few or no clause words, to 0 for one with enough."""
    listed = words.split()
    found, size = sum(map(CLAUSE_WORDS.__contains__, listed)), len(listed)
    if not words.isascii():
        glyphs = CJK.findall(words)
        found += sum(map(CLAUSE_CHARS.__contains__, glyphs))
        size += len(glyphs) // 2
    return 1.0 if not found else min(1.0, max(0.0, 1.5 - found * WORDS_A_CLAUSE_WORD / size))


def loose_units(text: str) -> tuple[list[tuple[int, int, float]], float]:
    """Units that want clause structure as (start, end, want), and the sum of their characters by want."""
    words = text.lower()
    if len(words) != len(text):
        words = text
    words = words.translate(SEPARATORS)
    units, chars, start, before = [], 0.0, 0, None
    ends = [m.end() for m in UNIT_ENDS.finditer(text)]
    ends.append(len(text))
    for end in ends:
        want = want_of_clause(words[start:end])
        if before is not None and BRACKETS.match(text[start:end]):
            want = min(want, before)
        before = None if LINE_END.search(text, start, end) else want
        if want > 0 and not text[start:end].isspace() and not RECORD.match(text[start:end]):
            units.append((start, end, want))
            chars += want * (end - start)
        start = end
    return units, chars


def covered_by_repeats(text: str) -> bytearray:
    """A 1 for each character in a maximal substring, of words and markup or of the form, that occurs again."""
    covered = bytearray(len(text))
    lower = text.lower() if len(text.lower()) == len(text) else text
    spans = [m.span() for m in TOKENS.finditer(text)]
    symbols = [lower[a:b] for a, b in spans]
    form = [t if t in MARKUP or t == "\n" else "w" for t in symbols]
    marks = [0]
    for t in form:
        marks.append(marks[-1] + (t in MARKUP))
    for of in (symbols, form):
        for i, n in enumerate(SuffixAutomaton(of).repeats()):
            if n and (of is symbols or (n >= FORM_SYMBOLS and marks[i + 1] - marks[i - n + 1] >= FORM_MARKUP)):
                a, b = spans[i - n + 1][0], spans[i][1]
                covered[a:b] = b"\1" * (b - a)
    return covered


def junk_share(text: str | None) -> float:
    """Share of the text that is repeated keywords, links or tags without clause structure."""
    if not text or len(text) < MIN_CHARS or text.isspace():
        return 0.0
    units, chars = loose_units(text)
    if chars <= SHARE * len(text):
        return 0.0  # an upper bound of the junk
    covered = covered_by_repeats(text)
    junk = 0.0
    for start, end, want in units:
        inside = covered[start:end].count(1)
        # what stands between covered words is part of the list
        junk += want * (end - start if inside >= REPEATED * (end - start) else inside)
    return junk / len(text)


def junk_pages(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, share) of the rows whose text is junk for more than half."""
    rows = documents.select(F.col(id_col), F.col(text_col).cast("string").alias("__text")).where(F.length("__text") >= MIN_CHARS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shares = pa.array([junk_share(t) for t in batch.column(1).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), shares], names=[id_col, "share"])

    kind = rows.schema[id_col].dataType.simpleString()
    return spread(rows).mapInArrow(run, f"`{id_col}` {kind}, share double").where(F.col("share") > SHARE)
