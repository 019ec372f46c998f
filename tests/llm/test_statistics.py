"""The statistics without SQL, against plain Python over every document of a fixture and of the smallest data."""

import os
import re
import unicodedata
from pathlib import Path

import pytest

from tallyspark.llm import statistics
from tallyspark.llm.queries import QUERIES

DATA = Path(os.environ.get("TALLYSPARK_TEST_DATA", "/root/testdata/sf0.001"))
TEXTS = ["The cat, it is.\nNo dot\r\n- item one", None, "", " \u200b\n ", "日本語です。これは", "*** a|b|c ***\u2028Is it? Yes!\n(the end.)", "x=1; y=2\n\n\nof the the"]
WORDS = ["the", "It", "is", "of", "the", "です", "は", None]
_END = re.compile(r"[.!?…:。！？：][\"'»”’)\]`*_]*\s*$", re.ASCII)


def letter(c):
    return unicodedata.category(c)[0] == "L"


def number(c):
    return unicodedata.category(c)[0] == "N"


def by_hand(text, words):
    """``n_lines, symbol_share, punct_end, common_share`` of one text."""
    t = text or ""
    lines = [x for x in re.split(r"\r\n|[\n\r\x0b\f\x85\u2028\u2029]", t) if any(c not in " \t" and unicodedata.category(c)[0] not in "ZC" for c in x)]
    symbols = sum(not letter(c) and not number(c) and c not in " \t\n\r\x0b\f" for c in t)
    kana = sorted({w for w in words if w and statistics._is_kana(w)}, key=lambda w: (-len(w), w))
    known = {w.lower() for w in words if w and not statistics._is_kana(w)}
    split = ["".join(c if letter(c) or number(c) else " " for c in x.lower()).split() for x in lines]
    n_words, n_kana = sum(map(len, split)), len(re.findall("|".join(kana), t)) if kana else 0
    common = sum(w in known for x in split for w in x) + n_kana
    share = lambda a, b: round(a / b, 6) if b else 0.0
    return len(lines), share(symbols, len(t)), share(sum(bool(_END.search(x)) for x in lines), len(lines)), share(common, max(n_words, n_kana))


def check(spark, d, texts, words):
    got = {r.doc_id: r for r in QUERIES["p8_all_statistics"](spark, d).collect()}
    assert set(got) == set(texts) and set(statistics.FEATURES) | {"doc_id", "n_chars", "n_words", "n_lines"} == set(next(iter(got.values())).asDict())
    for i, t in texts.items():
        r = got[i]
        assert (r.n_lines, r.symbol_share, r.punct_end, r.common_share) == pytest.approx(by_hand(t, words), abs=2e-6), (i, t)


def test_fixture(spark, frame, tmp_path):
    frame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    frame([("x", w) for w in WORDS], "lang string, word string").write.parquet(str(tmp_path / "common_words.parquet"))
    check(spark, str(tmp_path), dict(enumerate(TEXTS)), WORDS)


@pytest.mark.skipif(not DATA.exists(), reason="no test data")
def test_given_documents(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(str(DATA / "documents.parquet")).collect()}
    words = [r.word for r in spark.read.parquet(str(DATA / "common_words.parquet")).collect()]
    check(spark, str(DATA), texts, words)


def test_batches_change_nothing(monkeypatch):
    texts = [*TEXTS, "a, b, c\n" * 50, "\U0001f600 x\u0301 İI", "%41%zz% %4" + "=" * 5, "A1b2C3 deadbeef 7f"] * 3
    whole = statistics.TextStatistics(WORDS).table(texts)
    monkeypatch.setattr(statistics, "_BATCH_CHARS", 1)
    assert (statistics.TextStatistics(WORDS).table(texts) == whole).all() and whole.shape == (len(texts), len(statistics.FEATURES) + 3)
    assert statistics.TextStatistics([]).table([]).shape[0] == 0


def test_counts_of_runs_and_codes():
    row = dict(zip((*statistics.FEATURES, *statistics.COUNTS), statistics.TextStatistics([]).table(["%41%zz ====  " + "Q" * 40 + " x3y4z5 7f 12 bcdf"])[0]))
    n = row["n_chars"]
    assert (row["percent_share"] * n, row["repeated_sign"] * n, row["long_share"] * n) == pytest.approx((3, 4, 40))
    words = row["n_words"]
    assert (row["mixed_share"] * words, row["number_words"] * words, row["vowelless"] * words) == pytest.approx((1, 2, 2))
