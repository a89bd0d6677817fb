"""Quality by compression: is a text cheaper to write with the words of good texts or with those of bad ones?

Two zstandard dictionaries are trained, one on good and one on bad labelled texts.  A text is compressed with each in blocks of
``BLOCK`` bytes, so that the dictionaries and not the text's own repeats decide; the difference of the two sizes over the larger one is
its mark in -1 to 1.  A logistic curve, fitted to labelled texts that weren't used for the dictionaries, turns
the mark into a score: the chance that the label is 1.

The sample of labelled texts is bounded (``docs_per_class``, default 3,000 of each label: two thirds train the dictionaries, one third
fits the curve; a dictionary is trained on ``parts_per_class``, default 6,000, random pieces of ``SAMPLE_BYTES`` of them), so are dictionaries (110 KB each) and curve.  Whole texts are scored.  Empty and null texts have mark 0.
If a class has no labelled text the score is the share of label 1 (0.5 without any label).  Of several labels of one id the least counts.
"""

from __future__ import annotations

import math
import random
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dexlake.llm.common import bounded_batches, by_rows, texts_of

DOCS_PER_CLASS = 3000
DICTIONARY_BYTES, SAMPLE_BYTES, PARTS_PER_CLASS, LEVEL, BLOCK = 112_640, 1024, 6000, 3, 2048
THRESHOLD = 0.7


@dataclass
class QualityModel:
    good: bytes | None
    bad: bytes | None
    slope: float
    offset: float


def _train(texts: Sequence[str], parts_per_class: int = PARTS_PER_CLASS) -> bytes:
    """A dictionary from pieces of texts; of very few texts (the trainer refuses them), the texts themselves."""
    import zstandard

    parts = [b[i : i + SAMPLE_BYTES] for b in (t.encode("utf-8", "surrogatepass") for t in texts) for i in range(0, len(b), SAMPLE_BYTES)]
    random.Random(len(parts)).shuffle(parts)
    parts = parts[:parts_per_class]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, parts).as_bytes()
    except zstandard.ZstdError:
        return b"".join(parts)[:DICTIONARY_BYTES] or b"\0" * 8


class QualityScorer:
    def __init__(self, model: QualityModel):
        import zstandard

        self.model = model
        self.by = []
        if model.good is not None:
            for raw in (model.good, model.bad):
                trained = raw[:4] == b"\x37\xa4\x30\xec"
                words = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT)
                words.precompute_compress(level=LEVEL)
                self.by.append(zstandard.ZstdCompressor(dict_data=words, level=LEVEL, write_content_size=False))

    def mark(self, text: str | None) -> float:
        raw = (text or "").encode("utf-8", "surrogatepass")
        if not raw or not self.by:
            return 0.0
        good, bad = (sum(len(c.compress(raw[i : i + BLOCK])) for i in range(0, len(raw), BLOCK)) for c in self.by)
        return (bad - good) / max(good, bad)

    def __call__(self, text: str | None) -> float:
        x = self.model.slope * self.mark(text) + self.model.offset
        return 1.0 / (1.0 + math.exp(-max(-700.0, min(700.0, x))))


def _logistic(marks: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton's method, with a weak pull of the slope towards 0."""
    w = np.zeros(2)
    x = np.stack([marks, np.ones(len(marks))])
    pull = np.array([1e-3, 1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(w @ x, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))) @ x.T + np.diag(pull), x @ (p - labels) + pull * w)
        w -= np.clip(step, -20, 20)
        if abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def learn(labelled: Sequence[tuple[str, int]], share_good: float | None = None, parts_per_class: int = PARTS_PER_CLASS) -> QualityModel:
    """labelled: (text, 0 or 1).  share_good: the share of label 1 among all labelled texts, where the sample doesn't keep it."""
    rows = sorted(labelled, key=lambda r: (r[1], r[0]))
    random.Random(8).shuffle(rows)
    classes = [[t for t, q in rows if q == k] for k in (0, 1)]
    if not classes[0] or not classes[1]:
        known = share_good if share_good is not None else (0.5 if not rows else float(bool(classes[1])))
        known = min(1 - 1e-6, max(1e-6, known))
        return QualityModel(None, None, 0.0, math.log(known / (1 - known)))
    fitted, rest = [], []
    for k, texts in enumerate(classes):
        cut = max(1, len(texts) * 2 // 3)
        fitted.append(_train(texts[:cut], parts_per_class))
        rest += [(t, k) for t in texts[cut:] or texts]
    model = QualityModel(fitted[1], fitted[0], 1.0, 0.0)
    scorer = QualityScorer(model)
    marks, labels = np.array([scorer.mark(t) for t, _ in rest]), np.array([k for _, k in rest], float)
    model.slope, model.offset = _logistic(marks, labels)
    if share_good is not None and 0 < share_good < 1:  # the sample's shares aren't those of all labels
        own = labels.mean()
        model.offset += math.log(share_good / (1 - share_good)) - math.log(own / (1 - own))
    return model


def learn_quality(docs: DataFrame, labels: DataFrame, learn_from: Column, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", docs_per_class: int = DOCS_PER_CLASS, parts_per_class: int = PARTS_PER_CLASS) -> QualityModel:
    """Learn from rows where ``learn_from`` (over the id) holds, on a sample of ``docs_per_class`` ids of each label on average."""
    known = labels.where(learn_from & F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min(label_col).cast("int").alias("_label"))
    counts = {r[0]: r[1] for r in known.groupBy("_label").count().collect()}
    if not counts:
        return learn([])
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, docs_per_class / n))])
    drawn = known.where(F.pmod(F.xxhash64(F.lit("quality sample"), F.col(id_col)), F.lit(1 << 30)) < share[F.col("_label")] * (1 << 30))
    # some thousand ids whatever the corpus holds: the sample's bound is the broadcast's
    rows = docs.select(id_col, text_col).where(F.col(text_col).isNotNull()).join(F.broadcast(drawn), id_col).select(text_col, "_label")
    return learn([(r[0], r[1]) for r in rows.toLocalIterator(prefetchPartitions=False)], counts.get(1, 0) / sum(counts.values()), parts_per_class)


_SCORERS: dict[str, QualityScorer] = {}


def _scorer(name: str, shipped) -> QualityScorer:
    found = _SCORERS.get(name)
    if found is None:
        _SCORERS.clear()
        found = _SCORERS[name] = QualityScorer(shipped.value)
    return found


def score_quality(df: DataFrame, model: QualityModel, *, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """All columns of ``df`` and ``score_col``.  A narrow pass; only the text goes through Python."""
    bounded_batches(df.sparkSession)
    shipped = df.sparkSession.sparkContext.broadcast(model)
    name = f"{df.sparkSession.sparkContext.applicationId}-{shipped._jbroadcast.id()}"

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        scorer = _scorer(name, shipped)
        return pd.Series([scorer(t if isinstance(t, str) else None) for t in texts], dtype="float64")

    return df.withColumn(score_col, score(F.col(text_col)))


def quality_scores(df: DataFrame, model: QualityModel, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: ``id_col``, score, predicted (1 if score >= threshold)."""
    shipped = df.sparkSession.sparkContext.broadcast(model)
    name = f"{df.sparkSession.sparkContext.applicationId}-{shipped._jbroadcast.id()}"
    id_type = df.schema[id_col].dataType.simpleString()

    def scored(batch: pa.RecordBatch) -> dict:
        scorer = _scorer(name, shipped)
        made = [scorer(t) for t in texts_of(batch.column(1))]
        return {id_col: batch.column(0), "score": made, "predicted": [int(s >= threshold) for s in made]}

    return by_rows(df.select(id_col, text_col), scored, f"`{id_col}` {id_type}, score double, predicted int")
