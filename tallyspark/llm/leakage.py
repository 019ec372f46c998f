"""Held-out passages inside a corpus: one Aho-Corasick scan for seeds, then exact alignment around them.

The texts of the held-out items become sequences of normalised words. A passage of at least ``min_words`` words with at
most one error (replaced, dropped or added word) in ``per`` words always contains a run of exact words of a length that
follows from these two numbers (7 words for 28 and 10). All runs of that length of all items form one automaton over
word numbers; every document is scanned once. Where seeds of an item hit, a dynamic programme over the diagonals around
them decides exactly whether passages within the error rate stand there, and word positions are mapped back to offsets
of the original text.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.operators.joins import spread
from tallyspark.session import cut_lineage, ship_package

#: Characters that do not show and so do not end a word: format and control characters (line ends and tabs apart),
#: variation selectors, combining joiners and fillers.
_UNSEEN = r"\p{Cf}\u034F\u115F\u1160\u17B4\u17B5\u180B-\u180F\uFE00-\uFE0F\u3164\uFFA0\u2800\x00-\x08\x0E-\x1B\x7F"
_WORD = regex.compile(rf"[\p{{L}}\p{{N}}](?:[{_UNSEEN}\p{{M}}]*[\p{{L}}\p{{N}}\p{{M}}])*")
_DROP = regex.compile(rf"[{_UNSEEN}]")
_PLAIN = re.compile(r"[a-z0-9]+")
#: Markup between words: line ends and tabs written as escapes, tags and character references of any length. They are
#: blanked at equal length, so offsets stay.
_MARKUP = re.compile(
    r"\\[nrt](?=\w)|&(?:#\d+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);"
    r"|</?(?:br|p|b|i|u|s|em|strong|code|pre|tt|kbd|span|div|font|small|mark|sub|sup|del|ins|a|li|ul|ol|dl|dt|dd|td|tr|th|table|thead|tbody|h[1-6]|hr|blockquote|details|summary)\b[^<>]*>",
    re.I,
)


def words_of(text: str | None) -> list[str]:
    """Normalised words: runs of letters and digits in lower case, without invisible characters inside them."""
    if not text:
        return []
    text = _plain(text)
    if text.isascii() and text.isprintable() or text.isascii() and not regex.search(r"[\x00-\x08\x0E-\x1B\x7F]", text):
        return _PLAIN.findall(text.lower())
    return [m.lower() if m.isascii() and m.isalnum() else _fold(m) for m in _WORD.findall(text)]


def _plain(text: str) -> str:
    return _MARKUP.sub(lambda m: " " * len(m[0]), text) if "\\" in text or "<" in text or "&" in text else text


def _fold(word: str) -> str:
    return unicodedata.normalize("NFKC", _DROP.sub("", word)).lower()


def word_spans(text: str) -> list[tuple[int, int]]:
    """Start and end offsets in ``text`` of the words of :func:`words_of`."""
    return [m.span() for m in _WORD.finditer(_plain(text))]


def seed_length(min_words: int, per: int) -> int:
    """Longest run of exact words that every passage must contain: at least (L - E) words in at most E + 1 runs."""
    return min(-(((e := length // per) - length) // (e + 1)) for length in range(min_words, 40 * per))


def least_cover(min_words: int, per: int) -> int:
    """Least number of item words that seeds cover in any passage: all but the errors and runs shorter than a seed."""
    seed = seed_length(min_words, per)
    return min(max(seed, length - (e := length // per) - e * (seed - 1)) for length in range(min_words, 40 * per))


class Matcher:
    """Finds passages of items in documents. ``items``: (item id, text) of one block of held-out texts."""

    def __init__(self, items: list[tuple[int, str]], min_words: int = 28, per: int = 10):
        self.min_words, self.per = min_words, per
        self.seed, self.cover = seed_length(min_words, per), least_cover(min_words, per)
        self.numbers: dict[str, int] = {}
        self.items: list[tuple[int, np.ndarray]] = []
        places: dict[tuple[int, ...], list[tuple[int, int]]] = defaultdict(list)
        for item_id, text in items:
            seq = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in words_of(text)]
            if len(seq) < min_words:
                continue
            for at in range(len(seq) - self.seed + 1):
                places[tuple(seq[at : at + self.seed])].append((len(self.items), at))
            self.items.append((item_id, np.array(seq, np.int32)))
        self.places = list(places.values())
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        for k, key in enumerate(places):
            self.automaton.add_word(key, k)
        if places:
            self.automaton.make_automaton()

    def find(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """``(item id, first word, last word, matched item words)`` of every passage of every item in ``text``.

        Passages of one item do not overlap; the one with the fewest errors comes first, and it is as long as every
        further error gains it ``per`` words.
        """
        if not self.places:
            return []
        get = self.numbers.get
        seq = np.array([get(w, 0) for w in words_of(text)], np.int32)
        # a seed lies in a run of words that the items know: only such runs are worth the automaton's while
        edge = np.flatnonzero(np.concatenate([[True], seq == 0, [True]]))
        hits: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for run in np.flatnonzero(np.diff(edge) > self.seed).tolist():
            begin = int(edge[run])
            for end, k in self.automaton.iter(tuple(seq[begin : int(edge[run + 1]) - 1].tolist())):
                first = begin + end - self.seed + 1
                for item, at in self.places[k]:
                    hits[item].append((first - at, at))
        found = []
        for item, seeds in hits.items():
            item_id, words = self.items[item]
            doc = None
            for low, high, own in self._bands(seeds, len(words)):
                while self._covered(own) >= self.cover:
                    doc = seq.copy() if doc is None else doc
                    got = self._align(words, doc, low, high)
                    if got is None:
                        break
                    first, last, length = got
                    found.append((item_id, first, last, length))
                    doc[first : last + 1] = 0  # the next passage is another one
                    own = [(k, at) for k, at in own if not first - self.seed < k + at <= last]
        return found

    def _bands(self, seeds: list[tuple[int, int]], n: int) -> Iterator[tuple[int, int, list]]:
        """Stretches of diagonals (document place less item place) with their seeds ``(diagonal, item place)``.

        An alignment with e errors keeps within e diagonals and every passage holds a seed. Diagonals further apart
        than the most errors of the item are therefore looked at on their own; a long run of neighbouring ones, as a
        repetitive document has, comes in parts of bounded width, which overlap by that many diagonals.
        """
        seeds.sort()
        most = n // self.per + 1
        width = 8 * most
        at = 0
        while at < len(seeds):
            begin, end = at, at + 1
            while end < len(seeds) and seeds[end][0] - seeds[end - 1][0] <= most and seeds[end][0] - seeds[begin][0] < width:
                end += 1
            yield seeds[begin][0] - most, seeds[end - 1][0] + most, seeds[begin:end]
            if end < len(seeds) and seeds[end][0] - seeds[end - 1][0] <= most:
                while seeds[end][0] - seeds[at][0] > most:  # the next part takes up the last ones again
                    at += 1
            else:
                at = end

    def _covered(self, own: list[tuple[int, int]]) -> int:
        """Number of item words in seeds."""
        if not own:
            return 0
        at = sorted({a for _, a in own})
        return self.seed + sum(min(b - a, self.seed) for a, b in zip(at, at[1:]))

    def _align(self, words: np.ndarray, doc: np.ndarray, low: int, high: int) -> tuple[int, int, int] | None:
        """First and last document word of a passage on the diagonals ``low`` to ``high`` and its item words, or None.

        A cell (item word i, document word j) holds the most item words of an alignment that ends there with at most e
        errors; it opens and closes with an equal word. e grows until the rate admits an alignment, and on while each
        further error gains ``per`` words. Cells are laid out by diagonals, so equal words continue straight down, and
        one running maximum per column, restarted at every unequal pair, fills all cells of an e at once. A cell's
        number is its length times ``b`` plus the document word at which the alignment opens.
        """
        n, w = len(words), len(doc)
        start = max(0, low)
        low, high, doc = low - start, high - start, doc[start : min(w, n + high)]
        w = len(doc)
        b = w + 2
        i = np.arange(n + 1)[:, None]
        j = np.arange(low, high + 1)[None, :] + i
        inside = (j >= 0) & (j <= w)
        equal = np.zeros(j.shape, bool)
        equal[1:] = inside[1:] & (j[1:] > 0)
        equal[1:] &= words[:, None] == doc[np.clip(j[1:] - 1, 0, w - 1)]
        closed = np.where(inside, j, 0)  # length 0: an alignment may open behind this word
        shift = 4 * (n + 2) * b * np.cumsum(~equal, axis=0) - b * i
        cell, best = None, None
        for e in range(n // self.per + 1):
            base = closed.copy()
            if cell is not None:
                open_ = np.where(cell >= b, cell, -b)
                np.maximum(base[1:], open_[:-1] + b, out=base[1:])  # replaced
                np.maximum(base[1:, :-1], open_[:-1, 1:] + b, out=base[1:, :-1])  # dropped
                np.maximum(base[:, 1:], open_[:, :-1], out=base[:, 1:])  # added
                base[~inside] = 0
            cell = np.maximum.accumulate(base + shift, axis=0) - shift
            ends = np.where(equal, cell, 0)
            top = int(ends.argmax())
            length, first = divmod(int(ends.flat[top]), b)
            if best is not None and length < best[2] + self.per:
                break
            if length >= max(self.min_words, self.per * e):
                best = (start + first, start + int(j.flat[top]) - 1, length)
                if length == n:
                    break
        return best


_BUILT: dict = {}


def _matcher(key: str, shared: Broadcast, min_words: int, per: int) -> Matcher:
    """The matcher over broadcast items, built once per worker process; the next block of items takes its place."""
    if _BUILT.get("key") != key:
        _BUILT.clear()
        _BUILT.update(key=key, value=Matcher(shared.value, min_words, per))
    return _BUILT["value"]


SCHEMA = "doc_id bigint, item_id bigint, start_char int, end_char int, item_words int"
_OUT = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("start_char", pa.int32()), ("end_char", pa.int32()), ("item_words", pa.int32())])


def find_leaks(docs: DataFrame, items: DataFrame, min_words: int = 28, per: int = 10, max_chars: int = 2_000_000) -> DataFrame:
    """``doc_id, item_id, start_char, end_char, item_words``: every passage of every item in each document.

    A passage counts from ``min_words`` item words with at most one error in ``per`` of them; every item it stands in
    is reported. Documents are read in a narrow pass over whole texts. Null, empty and short texts hold nothing; items
    shorter than ``min_words`` cannot leak; repeated rows give one result row; further columns are ignored.

    The items are one automaton, built in every worker process from a broadcast of their texts, whose size is measured
    first. Items of more than ``max_chars`` characters in all are taken as that many blocks, one after the other: each
    block is one scan, its result is checkpointed and its broadcast released before the next, so that neither driver
    nor worker ever holds more than one block (an automaton of a few hundred MB at most).
    """
    spark = docs.sparkSession
    ship_package(spark)
    keyed = items.where("text is not null and item_id is not null").select(F.col("item_id").cast("bigint").alias("item_id"), "text")
    total = keyed.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = int(total // max_chars) + 1
    part = spread(docs.where(F.length("text") >= 2 * (min_words - min_words // per) - 1).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"))
    found = None
    for k in range(blocks):
        block = keyed if blocks == 1 else keyed.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        shared = spark.sparkContext.broadcast([(r.item_id, r.text) for r in block.collect()])
        hits = part.mapInArrow(_scan(shared, min_words, per), SCHEMA)
        if blocks > 1:
            hits = cut_lineage(hits)
            shared.unpersist()
        found = hits if found is None else found.unionByName(hits)
    return found.distinct()


def _scan(shared: Broadcast, min_words: int, per: int):
    key = uuid.uuid4().hex

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _matcher(key, shared, min_words, per)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if got := matcher.find(text):
                    spans = word_spans(text)
                    rows += [(doc_id, item, spans[a][0], spans[b][1], n) for item, a, b, n in got]
            if rows:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), _OUT.types)], schema=_OUT)

    return scan
