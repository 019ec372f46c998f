"""A classifier on document statistics that tells running prose from lists, tables and junk.

Four gradient-boosted tree ensembles (prose, list, table and junk, each against the rest) are trained on statistics of
weakly labelled texts: a bounded, hash-ordered sample of the corpus labelled by rules that only speak where they are
sure, plus generated examples of every kind. Their margins become chances by Platt scales fitted on documents that were
read and labelled by hand. Every document is then measured and scored whole, in one narrow pass.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.boosting import Boosted, Platt
from tallyspark.llm.quality_samples import INVENTED, generated
from tallyspark.llm.statistics import FEATURES, TextStatistics, document_statistics
from tallyspark.operators.joins import spread
from tallyspark.session import ship_package

KINDS = ("list", "table", "junk")
SAMPLE_ROWS = 6_000  # bound of the corpus sample used for fitting
#: Platt scales (slope, offset) of prose, list, table and junk: :func:`calibration` on the hand-checked documents.
SCALES = ((0.664, 0.925), (0.712, -0.451), (0.588, 0.820), (0.590, 0.032))


def common_words(common: DataFrame) -> list[str]:
    """The distinct function words of a word list: a fixed, small table (160 rows here)."""
    return sorted(r.word for r in common.where("word is not null").select("word").distinct().collect())


def weak_labels(f: pd.DataFrame) -> np.ndarray:
    """Labels by rules that speak only where they are sure: 0 prose, 1 list, 2 table, 3 junk, -1 silent."""
    y = np.full(len(f), -1)
    lines, words = np.expm1(f.lines_log), np.expm1(f.words_log)
    tabular = (f.row_chars > 0.6) | ((f.even_rows > 0.7) & (f.flow_chars < 0.1))
    plain = (f.letter_share > 0.6) & (f.digit_share < 0.25) & (f.vowelless < 0.1) & (f.hex_share < 0.1) & (f.long_share < 0.1) & (f.percent_share < 0.1)
    phrases = ((f.phrase_chars > 0.7) & (lines > 3.5) & (f.wrapped_lines < 0.5) & (f.stop_rate < 0.05)) | ((f.comma_chars > 0.8) & (f.stop_rate < 0.5) & (words > 11))
    y[((f.flow_chars > 0.75) & ((f.common_share > 0.1) | (f.hiragana_share > 0.2)) & ~phrases & (f.phrase_chars < 0.4)).to_numpy()] = 0
    y[(phrases & (f.flow_chars > 0.5) & plain).to_numpy()] = 1
    y[((f.item_chars > 0.7) & (lines > 3.5) & (f.distinct_lines > 0.5)).to_numpy()] = 1
    y[((f.short_lines > 0.9) & (lines > 4.5) & (f.flow_chars < 0.1) & ~tabular & plain & (f.distinct_lines > 0.8) & (f.common_share < 0.1)).to_numpy()] = 1
    y[((f.comma_rate > 0.12) & (f.common_share < 0.04) & (f.distinct_words > 0.2) & (lines < 3.5) & plain & (f.flow_chars < 0.2) & (words > 11)).to_numpy()] = 1
    y[(tabular & (lines > 2.5) & (f.flow_chars < 0.3) & ((f.symbol_share < 0.5) | (f.frame_chars > 0.3))).to_numpy()] = 2
    junk = (f.vowelless > 0.3) | ((f.number_words > 0.9) & ~tabular & (f.item_chars < 0.1)) | (f.long_share > 0.6) | (f.percent_share > 0.2) | ((f.hex_share > 0.5) & ~tabular) | ((f.repeated_sign > 0.5) & ~tabular)
    junk |= (f.distinct_words < 0.06) & (words > 11) & (f.hiragana_share < 0.2)
    junk |= (f.letter_share + f.digit_share < 0.15) & ~tabular
    junk |= (f.symbol_share > 0.55) & (f.letter_share + f.digit_share < 0.25) & (f.frame_chars < 0.3)
    junk |= (f.odd_share > 0.25) & (f.common_share < 0.05) & (f.hiragana_share < 0.1)
    junk |= (f.symbol_share > 0.4) & ~tabular & (f.item_chars < 0.1) & (f.common_share < 0.02)
    y[(junk & (f.flow_chars < 0.3)).to_numpy()] = 3
    return y


class QualityModel:
    """One calibrated ensemble per class; ``kinds`` gives the most likely one, None for prose."""

    def __init__(self, x: np.ndarray, y: np.ndarray, scales: Sequence[tuple[float, float]] = SCALES):
        self.parts = [(Boosted().fit(x, y == k), Platt(scale)) for k, scale in enumerate(scales)]

    def margins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([trees.margin(x) for trees, _ in self.parts])

    def chances(self, x: np.ndarray) -> np.ndarray:
        """Calibrated chances of prose, list, table and junk, each against the rest."""
        return np.column_stack([scale.chance(trees.margin(x)) for trees, scale in self.parts])

    def kinds(self, x: np.ndarray) -> np.ndarray:
        return np.array([None, *KINDS], object)[self.chances(x).argmax(axis=1)] if len(x) else np.empty(0, object)


def _code(kind: str) -> int:
    return KINDS.index(kind) + 1 if kind in KINDS else 0


def _columns(texts: Sequence[str], stats: TextStatistics) -> np.ndarray:
    return stats.table(texts)[:, : len(FEATURES)]


def fit_model(docs: DataFrame, common: Sequence[str], sample_rows: int = SAMPLE_ROWS) -> QualityModel:
    """Fit on at most ``sample_rows`` corpus rows (those of the smallest hash of ``doc_id``) and generated examples."""
    sample = docs.where(F.trim("text") != "").select("doc_id", "text").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    corpus = document_statistics(sample, common).select(*FEATURES).toPandas()
    made, weak = generated() + INVENTED, weak_labels(corpus)
    x = np.vstack([corpus[FEATURES].to_numpy(float)[weak >= 0], _columns([t for t, _ in made], TextStatistics(common))])
    return QualityModel(x, np.concatenate([weak[weak >= 0], [_code(k) for _, k in made]]))


def calibration(docs: DataFrame, common: Sequence[str], checked: dict[int, str], bins: int = 10) -> dict:
    """Scales and quality of a model fitted without the ``checked`` documents (kind by ``doc_id``).

    The documents with an even rank by id fit the Platt ``scales``, the others measure: recall and precision per class
    and the expected calibration error per class, with the scales found.
    """
    ids = sorted(checked)
    known = docs.sparkSession.createDataFrame([(i,) for i in ids], "doc_id bigint")
    model = fit_model(docs.join(F.broadcast(known), "doc_id", "left_anti"), common)
    texts = {r.doc_id: r.text for r in docs.join(F.broadcast(known), "doc_id", "left_semi").select("doc_id", "text").collect()}
    margins, y = model.margins(_columns([texts[i] for i in ids], TextStatistics(common))), np.array([_code(checked[i]) for i in ids])
    odd = np.arange(len(ids)) % 2 == 1
    scales = [Platt().fit(margins[~odd, k], y[~odd] == k) for k in range(len(KINDS) + 1)]
    chance = np.column_stack([s.chance(margins[odd, k]) for k, s in enumerate(scales)])
    found, true = chance.argmax(axis=1), y[odd]
    out = {"scales": [tuple(s.weights) for s in scales], "n": len(ids), "recall": {}, "precision": {}, "error": {}}
    for k, kind in enumerate(("prose", *KINDS)):
        part = np.minimum((chance[:, k] * bins).astype(int), bins - 1)
        gaps = [abs(chance[part == b, k].mean() - (true[part == b] == k).mean()) * (part == b).mean() for b in range(bins) if (part == b).any()]
        out["error"][kind] = float(sum(gaps))
        out["recall"][kind], out["precision"][kind] = float((found[true == k] == k).mean()), float((true[found == k] == k).mean())
    return out


def structural_documents(docs: DataFrame, common: DataFrame) -> DataFrame:
    """``doc_id, kind`` of every document that is for the greater part a list, a table or junk.

    Null, empty and blank texts are no cases. Every document is scored over its whole text; the sample bound concerns
    fitting alone. Repeated rows give repeated results only if ``doc_id`` repeats; an empty corpus gives none.
    """
    ship_package(docs.sparkSession)
    words = common_words(common)
    shared = docs.sparkSession.sparkContext.broadcast((TextStatistics(words), fit_model(docs, words)))
    out_type = pa.schema([("doc_id", pa.int64()), ("kind", pa.string())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stats, model = shared.value
        for batch in batches:
            rows = stats.table(batch.column(1).to_pylist())
            kinds = model.kinds(rows[:, : len(FEATURES)])
            kinds[rows[:, len(FEATURES) + 1] == 0] = None  # no line shows anything
            found = np.flatnonzero(kinds != None)  # noqa: E711
            if len(found):
                yield pa.record_batch([batch.column(0).cast(pa.int64()).take(pa.array(found)), pa.array(kinds[found], pa.string())], schema=out_type)

    real = docs.where("text is not null").select("doc_id", "text")
    return spread(real).mapInArrow(score, "doc_id bigint, kind string")
