import numpy as np
import pytest

from tallyspark.llm import quality
from tallyspark.llm.boosting import Boosted, Platt
from tallyspark.llm.quality_samples import INVENTED, generated
from tallyspark.llm.statistics import document_statistics

COMMON = "the a and of to in it is we not that this for on with was be if when i der die und ist nicht wir das le la et est les de el que y en se の は を が に です ます".split()


def test_boosting_learns_and_calibrates():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 6))
    y = (x[:, 0] * x[:, 1] > 0) & (x[:, 2] > -1)
    model = Boosted().fit(x[:2000], y[:2000])
    m = model.margin(x[2000:])
    assert ((m > 0) == y[2000:]).mean() > 0.93
    p = Platt().fit(m[:500], y[2000:2500]).chance(m[500:])
    assert abs(p.mean() - y[2500:].mean()) < 0.05
    flat = Boosted(trees=3).fit(np.zeros((5, 2)), np.ones(5))
    assert (flat.margin(np.zeros((2, 2))) > 0).all()


def test_statistics(frame):
    rows = [(1, "The cat, it is.\nNo dot\r\n- item one", "x"), (2, None, "x"), (3, "", "x"), (4, " ​\n ", "x"), (5, "日本語です。", "x"), (6, "w " * 30_000, "x")]
    got = {r.doc_id: r for r in document_statistics(frame(rows, "doc_id int, text string, n_words string"), COMMON).collect()}
    one = got[1]
    assert (one.n_words, one.n_lines) == (8, 3) and abs(one.mean_word_len - 22 / 8) < 1e-9 and abs(one.punct_end - 1 / 3) < 1e-9 and abs(one.bullets - 1 / 3) < 1e-9
    for i in (2, 3):
        assert got[i].n_chars == got[i].n_words == got[i].n_lines == 0 and got[i].symbol_share == got[i].flow_chars == 0.0
    assert got[4].n_lines == 0 and got[5].hiragana_share > 0.3 and got[6].n_words == 30_000 and got[6].distinct_words < 1e-4


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(i, t, k) for i, (t, k) in enumerate(generated(40, seed=77))]
    return spark.createDataFrame(rows, "doc_id long, text string, truth string")


def test_found_kinds_on_generated_texts(spark, corpus):
    common = spark.createDataFrame([(w,) for w in COMMON] + [(None,)], "word string")
    extra = spark.createDataFrame([(9001, None, None), (9002, "", None), (9003, " \n​", None)], "doc_id long, text string, truth string")
    got = {r.doc_id: r.kind for r in quality.structural_documents(corpus.unionByName(extra), common).collect()}
    rows = corpus.collect()
    right = sum(got.get(r.doc_id, "prose") == r.truth for r in rows)
    assert right / len(rows) > 0.93 and not {9001, 9002, 9003} & set(got)


def test_invented_texts_and_empty_corpus(spark):
    held = spark.createDataFrame([(i, t, k) for i, (t, k) in enumerate(INVENTED)], "doc_id long, text string, truth string")
    common = spark.createDataFrame([(w,) for w in COMMON], "word string")
    got = {r.doc_id: r.kind for r in quality.structural_documents(held, common).collect()}
    right = [got.get(i, "prose") == k for i, (_, k) in enumerate(INVENTED)]
    assert np.mean(right) > 0.9
    assert quality.structural_documents(held.limit(0), common).collect() == []


def test_lists_without_marks_and_wrapped_prose(spark):
    items = ["drop the old flag", "write a test for the parser", "move it to the end", "keep one copy of the key", "log the id and return"]
    lines, commas = "\n".join(items * 3), ", ".join(items * 2)
    wrapped = "we had this before and it was reverted so i do not\nthink that it is worth the time to try it again now\nbut if you want to then please go on and write the\ntest for it first so that we can see what it does to\nthe old rows and to the new ones when it is on"
    spoken = wrapped.replace("\n", " ")
    texts = {1: lines, 2: commas, 3: "To do:\n" + lines, 4: wrapped, 5: spoken, 6: "It is here. " * 3 + wrapped}
    common = spark.createDataFrame([(w,) for w in COMMON], "word string")
    got = {r.doc_id: r.kind for r in quality.structural_documents(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), common).collect()}
    assert got == {1: "list", 2: "list", 3: "list"}
