"""Token ids of whole texts by a public byte-level BPE vocabulary.

A text is cut into words by the vocabulary's pattern; the distinct words that a worker has not met yet are encoded
together. Words of similar length share one padded matrix of byte ids; in every round each row finds the lowest rank
among its neighbouring pairs, by lookup in an open-addressing hash table of all merges, merges it, and is compacted.
Rows without a mergeable pair leave the matrix.

A row merges all occurrences of its lowest-ranked pair at once, leftmost first. That equals merging only the leftmost
one per round as long as a merge creates only pairs of higher rank, so that the other occurrences stay lowest and come
next; the number of rounds is then bounded by the distinct pairs of a word, not by its length. The vocabulary is tested
for that property when it is read, and one without it merges the leftmost occurrence alone.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tallyspark.operators.joins import spread
from tallyspark.session import ship_package

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: Fixed value: the pattern by which the vocabulary's byte-level pre-tokenizer cuts words. White space is the Unicode
#: property; the shorthand class of the regular-expression library would add the four separators U+001C to U+001F.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
_NONE = np.int32(2**31 - 1)
_CELLS = 1 << 21  # cells of one padded matrix
_KEPT_WORDS = 400_000  # words a worker remembers; a memory bound that changes no result
_KEPT_IDS = 4_000_000  # and of its ids


def _printable_bytes() -> dict[str, int]:
    """Character that stands for each byte in vocabulary files: itself where printable, else the next one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names = {chr(b): b for b in plain}
    names |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))}
    return names


def load_merges(path: str) -> dict[str, np.ndarray]:
    """Byte ids and merges of a vocabulary file as arrays (about 1 MB for 50,000 merges): what is broadcast."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocab = model["vocab"]
    single = np.zeros(256, np.int32)
    for char, byte in _printable_bytes().items():
        single[byte] = vocab[char]
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    table = np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs], np.int64).reshape(-1, 3)
    return {"single": single, "left": table[:, 0], "right": table[:, 1], "merged": table[:, 2].astype(np.int32)}


def merges_ascend(merges: dict[str, np.ndarray]) -> bool:
    """Whether every merge ranks above all merges that make one of its parts, so that a merge creates only higher pairs."""
    left, right, merged = (merges[k].astype(np.int64) for k in ("left", "right", "merged"))
    if not len(merged):
        return True
    last = np.full(int(max(left.max(), right.max(), merged.max())) + 1, -1)
    np.maximum.at(last, merged, np.arange(len(merged)))
    return bool((np.maximum(last[left], last[right]) < np.arange(len(merged))).all())


class PairTable:
    """Open-addressing hash table from a pair of ids to the rank of its merge."""

    def __init__(self, left: np.ndarray, right: np.ndarray):
        bits = max(4, int(np.ceil(np.log2(max(1, len(left)) * 4))))
        self.mask = (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, np.int64)
        self.ranks = np.full(1 << bits, _NONE, np.int32)
        key = (left << 32) | right
        todo, step = np.arange(len(left)), 0
        while len(todo):
            slot = (self._slot(left[todo], right[todo]) + step) & self.mask
            free = self.keys[slot] == -1
            _, first = np.unique(slot[free], return_index=True)
            won = todo[free][first]
            at = slot[free][first]
            self.keys[at], self.ranks[at] = key[won], won
            todo = np.setdiff1d(todo, won, assume_unique=True)
            step += 1
        self.probes = step

    def _slot(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        mixed = left * 0x9E3779B1 + right * 0x85EBCA77
        return (mixed ^ (mixed >> 17)) & self.mask

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs (flat arrays); ``_NONE`` where a pair does not merge."""
        left, right = left.astype(np.int64), right.astype(np.int64)
        key, slot = (left << 32) | right, self._slot(left, right)
        out = np.full(len(key), _NONE, np.int32)
        todo = np.arange(len(key))
        for step in range(self.probes):
            at = (slot[todo] + step) & self.mask
            found = self.keys[at]
            hit = found == key[todo]
            out[todo[hit]] = self.ranks[at[hit]]
            todo = todo[~hit & (found != -1)]
            if not len(todo):
                break
        return out


class ByteBpe:
    """Encoder over the arrays of :func:`load_merges`."""

    def __init__(self, merges: dict[str, np.ndarray], pattern: str = WORD_PATTERN):
        self.single, self.merged = merges["single"], merges["merged"]
        self.table = PairTable(merges["left"], merges["right"])
        self.ascending = merges_ascend(merges)
        self.cut = regex.compile(pattern)
        self._forget()

    def _forget(self) -> None:
        """Words met so far: their numbers, and for each number where its ids stand in the pool."""
        self.known: dict[str, int] = {}
        self.start, self.size, self.pool = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32)

    def _pair_ranks(self, m: np.ndarray) -> np.ndarray:
        ranks = np.full((m.shape[0], max(0, m.shape[1] - 1)), _NONE, np.int32)
        pair = m[:, 1:] >= 0
        ranks[pair] = self.table.rank(m[:, :-1][pair], m[:, 1:][pair])
        return ranks

    def _merge_matrix(self, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge every row of a matrix of ids, padded with -1 at the right, to its end: row sizes and all ids in order."""
        sizes, rows = np.zeros(len(m), np.int64), np.arange(len(m))
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(rows):
            ranks = self._pair_ranks(m)
            low = ranks.min(axis=1) if ranks.shape[1] else np.full(len(m), _NONE, np.int32)
            over = low == _NONE
            if over.any():
                ready = m[over]
                real = ready >= 0
                sizes[rows[over]] = real.sum(axis=1)
                done.append((rows[over], ready[real]))
            m, rows, ranks, low = m[~over], rows[~over], ranks[~over], low[~over]
            if not len(rows):
                break
            at = ranks == low[:, None]
            col = np.arange(at.shape[1])
            if self.ascending:
                # a run of equal tokens holds overlapping pairs: every second one, from the left, merges
                opens = at.copy()
                opens[:, 1:] &= ~at[:, :-1]
                first = np.maximum.accumulate(np.where(opens, col, -1), axis=1)
                at &= (col - first) % 2 == 0
            else:
                at &= col == at.argmax(axis=1)[:, None]
            r, c = np.nonzero(at)
            m[r, c] = self.merged[low[r]]
            m[r, c + 1] = -1
            keep = m >= 0
            packed = np.full((len(m), int(keep.sum(axis=1).max())), -1, np.int32)
            kr, kc = np.nonzero(keep)
            packed[kr, (np.cumsum(keep, axis=1) - 1)[kr, kc]] = m[kr, kc]
            m = packed
        out = np.empty(int(sizes.sum()), np.int32)
        begin = np.cumsum(sizes) - sizes
        for own, ids in done:
            out[_spread(begin[own], sizes[own])] = ids
        return sizes, out

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and ids of words, in order; words are grouped by length, so that padding at most doubles a matrix."""
        length = np.array([len(w) for w in words], np.int64)
        order = np.argsort(length, kind="stable")
        order = order[length[order] > 0]
        sizes, parts, i = np.zeros(len(words), np.int64), [], 0
        while i < len(order):
            small = length[order[i]]
            limit = np.searchsorted(length[order], 2 * small, "right")
            j = i + max(1, int(np.searchsorted(np.arange(1, limit - i + 1) * length[order[i:limit]], _CELLS, "right")))
            part = order[i:j]
            m = np.full((len(part), int(length[part[-1]])), -1, np.int32)
            m[np.arange(m.shape[1]) < length[part][:, None]] = self.single[np.frombuffer(b"".join([words[k] for k in part.tolist()]), np.uint8)]
            sizes[part], ids = self._merge_matrix(m)
            parts.append((part, ids))
            i = j
        out = np.empty(int(sizes.sum()), np.int32)
        begin = np.cumsum(sizes) - sizes
        for part, ids in parts:
            out[_spread(begin[part], sizes[part])] = ids
        return sizes, out

    def encode(self, texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ends of each text's ids, after a leading 0, and all ids; an empty and a null text have none.

        Strings of special tokens are plain text.
        """
        if len(self.known) > _KEPT_WORDS or len(self.pool) > _KEPT_IDS:
            self._forget()
        cuts = [self.cut.findall(t) if t else [] for t in texts]
        words = [w for c in cuts for w in c]
        fresh = list(set(words).difference(self.known))
        if fresh:
            sizes, ids = self.encode_words([w.encode("utf-8", "replace") for w in fresh])
            self.known.update(zip(fresh, range(len(self.size), len(self.size) + len(fresh))))
            self.start = np.append(self.start, len(self.pool) + np.cumsum(sizes) - sizes)
            self.size, self.pool = np.append(self.size, sizes), np.append(self.pool, ids)
        at = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        ids = self.pool[_spread(self.start[at], self.size[at])]
        ends = np.concatenate([[0], np.cumsum(self.size[at])])[np.concatenate([[0], np.cumsum([len(c) for c in cuts], dtype=np.int64)])]
        return ends, ids

    def encode_batch(self, texts: Iterable[str | None]) -> list[list[int]]:
        """Ids of each text as lists."""
        ends, ids = self.encode(texts)
        return [ids[a:b].tolist() for a, b in zip(ends, ends[1:])]


def _spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places ``start .. start + size - 1`` of every entry, one after the other."""
    total = int(size.sum())
    return np.arange(total) + np.repeat(start - (np.cumsum(size) - size), size)


_BUILT: dict = {}


def encode_column(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = VOCABULARY) -> DataFrame:
    """``id_col`` and ``ids`` (list of integers): the token ids of every text, whole, in one narrow pass.

    The driver reads the vocabulary file and broadcasts its arrays; their size is bounded by that file. Null and empty
    texts give an empty list; repeated rows give repeated rows; an empty table gives none; further columns are ignored.
    """
    ship_package(df.sparkSession)
    merges, key = df.sparkSession.sparkContext.broadcast(load_merges(path)), uuid.uuid4().hex
    out_type = pa.schema([pa.field(id_col, pa.int64()), pa.field("ids", pa.list_(pa.int32()))])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if _BUILT.get("key") != key:  # one encoder, with the words it met, per worker process
            _BUILT.clear()
            _BUILT.update(key=key, value=ByteBpe(merges.value))
        for batch in batches:
            for at in range(0, batch.num_rows, 2_000):
                part = batch.slice(at, 2_000)
                ends, ids = _BUILT["value"].encode(part.column(1).to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), lists], schema=out_type)

    return spread(df.select(id_col, text_col)).mapInArrow(encode, f"`{id_col}` bigint, ids array<int>")
