"""Statistics of whole texts, computed for a batch of texts at once over one array of code points.

The texts of a batch are laid end to end. One table look-up gives every character its classes; all counts per text and
per line are differences of running sums over those arrays. Words are met once each: what is known of a word (function
word, number, no vowels, ...) is remembered as bits, so that a repeated word costs one dictionary look-up.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tallyspark.operators.joins import spread
from tallyspark.session import ship_package

FEATURES = (
    "mean_word_len common_share symbol_share digit_share letter_share upper_share space_share hiragana_share distinct_words distinct_lines distinct_chars long_share odd_share percent_share "
    "mixed_share hex_share vowelless number_words comma_rate stop_rate repeated_sign punct_end bullets flow_chars item_chars named_chars row_chars frame_chars other_chars even_rows "
    "short_lines mean_line lines_log words_log phrase_chars comma_chars wrapped_lines segment_words"
).split()
COUNTS = ("n_words", "n_lines", "n_chars")

_LETTER, _UPPER, _NUMBER, _SPACE, _HIRAGANA, _BLANK, _MARK = (1 << k for k in range(7))
#: Further classes: sentence stops, commas of any script, ASCII commas, cell delimiters, base 64, hexadecimal, percent, line breaks.
_STOP, _ANY_COMMA, _COMMA, _DELIMITER, _BASE64, _HEXA, _PERCENT, _BREAK = (1 << k for k in range(8))
_SIGNS = {
    _STOP: ".!?。！？", _ANY_COMMA: ",;、", _COMMA: ",;", _DELIMITER: ",;\t|", _BASE64: "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=",
    _HEXA: "0123456789abcdefABCDEF", _PERCENT: "%", _BREAK: "\n\x0b\f\r\x85\u2028\u2029",
}
_COMMON, _VOWELLESS, _DIGITS, _MIXED, _HEX = (1 << k for k in range(5))
_KEPT_WORDS = 300_000  # words a worker remembers; a memory bound that changes no result
_BATCH_CHARS = 1 << 17  # texts are taken together up to this length; a longer text comes alone and whole
#: Line patterns. A list item is short and marked, or a short "name: what to do"; cells of a table row are short.
_BULLET = re.compile(r"\s*(?:[-*+•‣◦▪·–—]\s|\(?\d{1,3}[.)]\s|\[[ xX]\]\s|[a-zA-Z][.)]\s)\s*\S")
_NAMED = re.compile(r"\s*(?:[\w./-]+\s+){0,4}[\w./-]+:\s")
_FRAME = re.compile(r"\s*\|.*\|\s*$|\s*\+[-=+]+\+\s*$|\s*</?(?:table|tr|td|th|thead|tbody)\b", re.I)
_ROW = re.compile(r"\s*\|?(?:[^|]{0,60}\|){2,}[^|]{0,60}$|[^,;\t]{0,60}([,;\t])(?! )(?:[^,;\t]{0,60}\1(?! ))+[^,;\t]{0,60}$|(?:\S{1,60}(?: \S{1,30}){0,3}(?: {2,}|\t)){2,}\S|\S{1,60} {2,}[0-9.]+\s*$")
_CLOSERS = "\"'»”’)]`*_"
_ENDS = frozenset(".!?…:。！？：")
_ITEM_CHARS = 100  # a longer line is no short item
_LEAST_WIDTH = 40  # no text is wrapped to narrower lines
_NO_VOWELS = re.compile(r"[bcdfghjklmnpqrstvwxz]{4,}")
_TWO_OR_EIGHT_HEX = re.compile(r"[0-9a-f]{2}|[0-9a-f]{8}")


@lru_cache(maxsize=1)
def _classes() -> tuple[np.ndarray, np.ndarray]:
    """The two sets of class bits of every code point, 1 MB each."""
    kinds = [unicodedata.category(chr(c)) for c in range(0x110000)]
    bits = {"Lu": _LETTER | _UPPER}
    for k in set(kinds):
        bits.setdefault(k, {"L": _LETTER, "N": _NUMBER, "Z": _BLANK, "C": _BLANK, "M": _MARK}.get(k[0], 0))
    table = np.array([bits[k] for k in kinds], np.uint8)
    table[[9, 10, 11, 12, 13, 32]] |= _SPACE | _BLANK
    table[0x3041:0x30A0] |= _HIRAGANA
    signs = np.zeros(len(table), np.uint8)
    for bit, chars in _SIGNS.items():
        signs[[ord(c) for c in chars]] |= bit
    return table, signs


def _is_kana(word: str) -> bool:
    return all("぀" <= c <= "ヿ" or "一" <= c <= "鿿" for c in word)


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of set cells."""
    padded = np.zeros(len(mask) + 2, bool)
    padded[1:-1] = mask
    edge = np.flatnonzero(padded[1:] != padded[:-1])
    return edge[::2], edge[1::2]


def _distinct_chars(doc: np.ndarray, code: np.ndarray, docs: int) -> np.ndarray:
    """Distinct characters per text: a bitmap for the first 256, sorted pairs for the others."""
    low = code < 256
    found = (np.bincount(doc[low] * 256 + code[low], minlength=docs * 256).reshape(docs, 256) > 0).sum(axis=1)
    rare = np.unique((doc[~low].astype(np.int64) << 21) | code[~low])
    return found + np.bincount(rare >> 21, minlength=docs)


class TextStatistics:
    """Computes :data:`FEATURES` and :data:`COUNTS` of texts. ``common``: function words of all languages, any case.

    Null and empty texts have zero everywhere; a blank text has no words and no lines, but its characters count. Words
    are runs of letters and digits.
    """

    def __init__(self, common: Sequence[str]):
        kana = sorted({w for w in common if w and _is_kana(w)}, key=lambda w: (-len(w), w))
        self.common = frozenset(w.lower() for w in common if w and not _is_kana(w))
        self.known: dict[str, int] = {}
        self.tables = _classes()
        self.kana = re.compile("|".join(map(re.escape, kana))) if kana else None

    def table(self, texts: Sequence[str | None]) -> np.ndarray:
        """One row per text: the features, then the counts."""
        out, part, size = [], [], 0
        for t in texts:
            t = t or ""
            if part and size + len(t) > _BATCH_CHARS:
                out.append(self._batch(part))
                part, size = [], 0
            part.append(t)
            size += len(t) + 1
        if part:
            out.append(self._batch(part))
        return np.vstack(out) if out else np.empty((0, len(FEATURES) + len(COUNTS)))

    def _bits(self, w: str) -> int:
        bits = _COMMON * (w in self.common) + _VOWELLESS * bool(_NO_VOWELS.fullmatch(w))
        if not w.isascii():
            return bits + _DIGITS * all(unicodedata.category(c)[0] == "N" for c in w)
        digits = w.isdigit()
        return bits + _DIGITS * digits + _MIXED * (len(w) >= 6 and not digits and not w.isalpha()) + _HEX * bool(_TWO_OR_EIGHT_HEX.fullmatch(w))

    def _batch(self, texts: list[str]) -> np.ndarray:
        if len(self.known) > _KEPT_WORDS:
            self.known.clear()
        docs = len(texts)
        whole = "\n".join(texts) + "\n"
        n_chars = np.array([len(t) for t in texts], np.int64)
        start = np.concatenate([[0], np.cumsum(n_chars + 1)[:-1]])
        end = start + n_chars
        code = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        flag, sign = (table[code] for table in self.tables)
        doc = np.repeat(np.arange(docs), n_chars + 1)
        own = np.ones(len(code), bool)
        own[end] = False

        def per_doc(at: np.ndarray) -> np.ndarray:
            """Number of the ascending positions ``at`` in each text."""
            return np.searchsorted(at, end) - np.searchsorted(at, start)

        def in_runs(mask: np.ndarray, least: int) -> np.ndarray:
            """Per text the characters of runs of at least ``least`` set cells; no run crosses the end of a text."""
            a, b = _runs(mask)
            far = b - a >= least
            return np.bincount(doc[a[far]], (b - a)[far], docs)

        # one histogram of class bits per text answers every plain count
        seen = np.bincount(doc * 128 + flag, minlength=docs * 128).reshape(docs, 128)
        seen[:, _SPACE | _BLANK] -= 1  # the break behind each text
        of_class = lambda bit: seen[:, np.arange(128) & bit != 0].sum(axis=1)
        share = lambda part, of: np.divide(part, of, out=np.zeros(docs), where=np.asarray(of) > 0)
        letters, digits, spaces, hira = (of_class(bit) for bit in (_LETTER, _NUMBER, _SPACE, _HIRAGANA))

        # lines: runs between breaks that show anything
        la, lb = _runs(sign & _BREAK == 0)
        blank = np.concatenate([[0], np.cumsum(flag & _BLANK == 0, dtype=np.int32)])
        shown = blank[lb] > blank[la]
        la, lb = la[shown], lb[shown]
        line_doc = doc[la]
        n_lines = np.bincount(line_doc, minlength=docs)

        # words
        wa, wb = _runs(flag & (_LETTER | _NUMBER) != 0)
        words = np.where(flag & (_LETTER | _NUMBER), code, 32).astype("<u4").tobytes().decode("utf-32-le").lower().split()
        for w in set(words).difference(self.known):
            self.known[w] = self._bits(w)
        bits = np.fromiter(map(self.known.__getitem__, words), np.uint8, len(words))
        w0, w1 = np.searchsorted(wa, start), np.searchsorted(wa, end)
        n_words = w1 - w0

        met = np.bincount(doc[wa] * 32 + bits, minlength=docs * 32).reshape(docs, 32)
        words_with = lambda bit: met[:, np.arange(32) & bit != 0].sum(axis=1)
        distinct_words = np.array([len(set(words[a:b])) for a, b in zip(w0.tolist(), w1.tolist())])
        kana = np.zeros(docs, np.int64)
        if self.kana:
            for k in np.flatnonzero(hira):
                kana[k] = len(self.kana.findall(texts[k]))

        # sentence ends: a stop before white space, the end of the text or a character outside ASCII
        stop = np.flatnonzero((sign & _STOP) != 0)
        stop = stop[(flag[stop + 1] & _SPACE != 0) | (code[stop + 1] > 127)]
        odd = np.flatnonzero((code > 127) & (flag & (_LETTER | _MARK) == 0))
        line = self._lines(whole, la, lb, line_doc, docs, n_lines, wa, wb, blank, odd, bits, stop, *(np.flatnonzero((sign & bit) != 0) for bit in (_COMMA, _DELIMITER)), np.flatnonzero((flag & _HIRAGANA) != 0))
        chars_of = lambda mask: share(np.bincount(line_doc, line["len"] * mask, docs), line_chars)
        lines_with = lambda mask: share(np.bincount(line_doc, mask, docs), n_lines)
        line_chars = np.bincount(line_doc, line["len"], docs)
        kind = line["kind"]

        percent = np.flatnonzero((sign & _PERCENT) != 0)
        percent = percent[percent + 2 < len(code)]
        percent = percent[(sign[percent + 1] & sign[percent + 2] & _HEXA) != 0]
        edge = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
        run = np.diff(np.append(edge, len(code)))
        far = (run >= 4) & (flag[edge] & (_LETTER | _NUMBER | _SPACE) == 0)
        repeated = np.bincount(doc[edge[far]], run[far], docs)
        first_line = np.concatenate([[0], np.cumsum(n_lines)[:-1]])
        middle = np.where(n_lines > 0, line["delims"][np.minimum(first_line + n_lines // 2, max(0, len(la) - 1))] if len(la) else 0, 0)
        even = np.bincount(line_doc, line["delims"] == middle[line_doc], docs)
        common, n_commas, n_stops = words_with(_COMMON), per_doc(np.flatnonzero((sign & _ANY_COMMA) != 0)), per_doc(stop)
        out = {
            "mean_word_len": share(letters + digits, n_words), "common_share": share(common + kana, np.maximum(n_words, kana)),
            "symbol_share": share(n_chars - letters - digits - spaces, n_chars), "digit_share": share(digits, n_chars), "letter_share": share(letters, n_chars),
            "upper_share": share(of_class(_UPPER), letters), "space_share": share(spaces, n_chars), "hiragana_share": share(hira, letters),
            "distinct_words": share(distinct_words, n_words), "distinct_lines": share(self._distinct_lines(whole, la, lb, n_lines), n_lines),
            "distinct_chars": np.log1p(_distinct_chars(doc[own], code[own], docs)), "long_share": share(in_runs(sign & _BASE64 != 0, 40), n_chars),
            "odd_share": share(per_doc(odd), n_chars), "percent_share": share(3 * per_doc(percent), n_chars),
            "mixed_share": share(words_with(_MIXED), n_words), "hex_share": share(words_with(_HEX), n_words), "vowelless": share(words_with(_VOWELLESS), n_words), "number_words": share(words_with(_DIGITS), n_words),
            "comma_rate": share(n_commas, n_words), "stop_rate": share(10 * n_stops, n_words), "repeated_sign": share(repeated, n_chars),
            "punct_end": lines_with(line["ended"]), "bullets": lines_with(line["bullet"]), "flow_chars": chars_of(kind == 4), "item_chars": chars_of((kind == 2) | (kind == 3)), "named_chars": chars_of(kind == 3),
            "row_chars": chars_of((kind == 1) | (kind == 5)), "frame_chars": chars_of(kind == 1), "other_chars": chars_of(kind == 0), "even_rows": np.where((n_lines > 2) & (middle > 1), share(even, n_lines), 0.0),
            "short_lines": lines_with(line["len"] <= 60), "mean_line": np.log1p(share(n_chars, n_lines)), "lines_log": np.log1p(n_lines), "words_log": np.log1p(n_words),
            "phrase_chars": chars_of(line["phrase"]), "comma_chars": chars_of(line["commas"]), "wrapped_lines": lines_with(line["wrapped"]),
            "segment_words": np.log1p(share(n_words, n_lines + n_commas + n_stops)),
        }
        return np.column_stack([out[f] for f in FEATURES] + [n_words, n_lines, n_chars]).astype(float)

    @staticmethod
    def _distinct_lines(whole: str, la: np.ndarray, lb: np.ndarray, n_lines: np.ndarray) -> np.ndarray:
        lines = [whole[a:b] for a, b in zip(la.tolist(), lb.tolist())]
        ends = np.cumsum(n_lines).tolist()
        return np.array([n if n < 2 else len(set(lines[e - n : e])) for n, e in zip(n_lines.tolist(), ends)])

    @staticmethod
    def _lines(whole, la, lb, line_doc, docs, n_lines, wa, wb, blank, odd, bits, stop, comma, delimiter, hiragana) -> dict[str, np.ndarray]:
        """Per line: length, delimiters, kind (0 other, 1 frame, 2 item, 3 named item, 4 running text, 5 row) and marks.

        A line is wrapped if the next one's first word would not have fitted behind it, within the text's longest line.
        A phrase is a short line without sentence end that is not wrapped; a comma line holds short pieces only.
        """
        n = len(la)
        length = lb - la
        stops, commas, delims, hira = (np.searchsorted(at, lb) - np.searchsorted(at, la) for at in (stop, comma, delimiter, hiragana))
        v0, v1 = np.searchsorted(wa, la), np.searchsorted(wa, lb)
        common = np.flatnonzero((bits & _COMMON) != 0)
        # rows of cells are words and numbers for a third at least and odd signs for a quarter at most, whatever their gaps
        inside, seen = np.concatenate([[0], np.cumsum(wb - wa)]), blank[lb] - blank[la]
        worded = (3 * (inside[v1] - inside[v0]) >= seen) & (4 * (np.searchsorted(odd, lb) - np.searchsorted(odd, la)) <= seen)
        n_words, n_common = v1 - v0, np.searchsorted(common, v1) - np.searchsorted(common, v0)
        flow = (n_words >= 4) & (n_common * 10 >= n_words) | (hira * 5 >= length)
        short = length <= _ITEM_CHARS
        width = np.zeros(docs, np.int64)
        np.maximum.at(width, line_doc, length)
        kind, ended, bullet, lead = np.zeros(n, np.int8), np.zeros(n, bool), np.zeros(n, bool), np.zeros(n, np.int64)
        for i, (a, b, is_short, is_flow, has_delims, has_words) in enumerate(zip(la.tolist(), lb.tolist(), short.tolist(), flow.tolist(), (delims > 1).tolist(), worded.tolist())):
            x = whole[a:b]
            body = x.strip()
            ended[i] = body[-1:] in _ENDS or body.rstrip(_CLOSERS)[-1:] in _ENDS
            lead[i] = len(body.split(None, 1)[0]) if body else 0
            # a mark starts with a sign or a digit, or is one letter before "." or ")"
            bullet[i] = marked = (not body[:1].isalpha() or body[1:2] in ".)") and _BULLET.match(x) is not None
            if body[:1] in "|+<" and _FRAME.match(x):
                kind[i] = 1
            elif is_short and marked:
                kind[i] = 2
            elif is_short and ":" in body and _NAMED.match(x):
                kind[i] = 3
            elif is_flow:
                kind[i] = 4
            elif has_words and (has_delims or "  " in body or "\t" in body) and _ROW.match(x):
                kind[i] = 5
        wrapped = np.zeros(n, bool)
        if n > 1:
            wrapped[:-1] = (line_doc[1:] == line_doc[:-1]) & (length[:-1] + 1 + lead[1:] > np.maximum(width[line_doc[:-1]], _LEAST_WIDTH))
        last = np.append(line_doc[1:] != line_doc[:-1], True) if n else np.zeros(0, bool)
        wrapped |= last & np.concatenate([[False], wrapped[:-1]])  # the last line goes with the one before
        phrase = short & ~ended & (stops == 0) & ~wrapped & (n_lines[line_doc] > 2) & (n_words > 0)
        pieces = (commas >= 3) & (stops * 5 <= commas) & (n_words <= 9 * (commas + 1))
        return {"len": length, "kind": kind, "ended": ended, "bullet": bullet, "delims": delims, "wrapped": wrapped, "phrase": phrase, "commas": pieces}


def document_statistics(docs: DataFrame, common_words: Sequence[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, the features as doubles and the counts as integers of every text, whole, in one narrow pass.

    Repeated rows give repeated rows; an empty table gives none; further columns are ignored. The class tables (2 MB)
    and the function words are broadcast; a worker process keeps them, and the words it met, from task to task.
    """
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(TextStatistics(common_words))
    schema = f"`{id_col}` bigint, " + ", ".join([f"{f} double" for f in FEATURES] + [f"{c} int" for c in COUNTS])
    out_type = pa.schema([(id_col, pa.int64()), *[(f, pa.float64()) for f in FEATURES], *[(c, pa.int32()) for c in COUNTS]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = shared.value.table(batch.column(1).to_pylist())
            columns = [pa.array(rows[:, k]) if k < len(FEATURES) else pa.array(rows[:, k].astype(np.int32)) for k in range(rows.shape[1])]
            yield pa.record_batch([batch.column(0).cast(pa.int64()), *columns], schema=out_type)

    return spread(docs.select(id_col, text_col)).mapInArrow(run, schema)
