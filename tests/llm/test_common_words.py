"""No common word is lost, however many there are."""

import pytest

from tallyspark.llm import quality


def test_all_common_words_reach_the_fit(spark, frame, monkeypatch):
    class Stop(Exception):
        pass

    def stop(docs, words):
        raise Stop(len(words))

    monkeypatch.setattr(quality, "fit_model", stop)
    common = spark.range(10_050).selectExpr("concat('w', id) AS word")
    with pytest.raises(Stop) as caught:
        quality.structural_documents(frame([(1, "a")], "doc_id long, text string"), common)
    assert caught.value.args == (10_050,)
