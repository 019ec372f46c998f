"""The fit is not reduced for the sake of run time."""

import os
from pathlib import Path

import pytest

from tallyspark.llm import quality
from tallyspark.llm.boosting import Boosted
from tallyspark.llm.quality_checked import checked


def test_size_of_the_fit():
    model = Boosted()
    assert (model.n_trees, model.rate, quality.SAMPLE_ROWS) == (60, 0.2, 6_000)


DATA = Path(os.environ.get("TALLYSPARK_TEST_DATA", "/root/testdata/sf0.001")).parent / "sf0.1"


@pytest.mark.skipif(not DATA.exists(), reason="no test data")
def test_calibration_on_hand_checked_documents(spark):
    """Fitted without them: every class is found, and stated chances are off by 5 % at most; the scales in use are these."""
    docs, common = (spark.read.parquet(str(DATA / f"{t}.parquet")) for t in ("documents", "common_words"))
    got = quality.calibration(docs, quality.common_words(common), checked())
    assert got["n"] >= 400 and min(got["recall"].values()) >= 0.97 and min(got["precision"].values()) >= 0.97 and max(got["error"].values()) <= 0.05
    assert [w for scale in got["scales"] for w in scale] == pytest.approx([w for scale in quality.SCALES for w in scale], abs=0.15)
