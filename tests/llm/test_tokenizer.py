import random

import numpy as np
import pytest

tokenizers = pytest.importorskip("tokenizers")

from tallyspark.llm import tokenizer  # noqa: E402
from tallyspark.llm.tokenizer import VOCABULARY, ByteBpe, PairTable, encode_column, load_merges, merges_ascend  # noqa: E402


@pytest.fixture(scope="module")
def bpe():
    return ByteBpe(load_merges(VOCABULARY))


@pytest.fixture(scope="module")
def reference():
    t = tokenizers.Tokenizer.from_file(VOCABULARY)
    t.encode_special_tokens = True
    return lambda texts: [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_equals_the_library(bpe, reference):
    rng = random.Random(5)
    parts = ["the", " lock", "'s", "'ll", " don't", "  ", "\n\n", "\t", "aaaa", "....", "=====", "12345", " ١٢", "é", "日本語", "です", "😀", "​", "<|endoftext|>", "ﬁ", "foo_bar", "getValueOf", "=>", "\r\n", " ", "\x1f"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(80))) for _ in range(400)]
    texts += ["a" * 5000, "ab" * 3000 + "a", "-" * 3001, " " * 2000, "é" * 1501, "".join(rng.choice("abc") for _ in range(8000))]
    assert bpe.encode_batch(texts) == reference(texts)


def test_pair_table_finds_every_pair_and_no_other():
    rng = np.random.default_rng(1)
    pairs = np.unique(rng.integers(0, 300, (4000, 2)), axis=0)
    table = PairTable(pairs[:, 0].copy(), pairs[:, 1].copy())
    assert (table.rank(pairs[:, 0], pairs[:, 1]) == np.arange(len(pairs))).all()
    known = set(map(tuple, pairs.tolist()))
    other = np.array([(a, b) for a in range(300) for b in range(300) if (a, b) not in known])
    assert (table.rank(other[:, 0], other[:, 1]) == 2**31 - 1).all()


def test_table_of_texts(frame, reference):
    df = frame([(1, None, 1), (2, "", 2), (3, "one two", 3), (3, "one two", 3), (4, " " * 3 + "x" * 30_000, 4)], "doc_id long, text string, ids int")
    got = sorted((r.doc_id, r.ids) for r in encode_column(df).collect())
    one, long = reference(["one two", " " * 3 + "x" * 30_000])
    assert got == [(1, []), (2, []), (3, one), (3, one), (4, long)]
    assert encode_column(df.limit(0)).collect() == []


def test_merges_that_make_lower_pairs_go_one_by_one(bpe):
    assert bpe.ascending
    single = np.arange(256, dtype=np.int32)
    odd = {"single": single, "left": np.array([300, 97]), "right": np.array([97, 98]), "merged": np.array([301, 300], np.int32)}  # "ab" + "a" ranks before "a" + "b"
    assert not merges_ascend(odd)
    assert ByteBpe(odd, r"\S+").encode_batch(["abab", "ab", "", None]) == [[301, 98], [300], [], []]
    even = {**odd, "left": odd["left"][::-1].copy(), "right": odd["right"][::-1].copy(), "merged": odd["merged"][::-1].copy()}
    assert merges_ascend(even) and ByteBpe(even, r"\S+").encode_batch(["abab"]) == [[300, 300]]


def test_forgetting_words_changes_nothing(bpe, reference, monkeypatch):
    monkeypatch.setattr(tokenizer, "_KEPT_WORDS", 1)
    texts = ["one two three", None, "two one", "x" * 500, ""]
    assert [bpe.encode_batch([t])[0] for t in texts] == [r if t else [] for t, r in zip(texts, reference([t or "" for t in texts]))]
