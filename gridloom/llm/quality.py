"""Quality scores by Bradley-Terry ranking: a linear score of text features, fitted to preference pairs of labelled documents."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm.common import add_columns, unit_hash
from gridloom.llm.langid import remainder

#: Bound of the labelled sample: about so many documents of each label.
SAMPLE_DOCS = 3000
CUT_SCORE = 0.3


def text_features(text: bytes | None) -> np.ndarray:
    """Byte frequencies (square roots) and shares that show repetition and shape, over the whole text."""
    out = np.zeros(256 + 8, np.float32)
    if not text:
        out[256] = 1
        return out
    out[:256] = np.sqrt(np.bincount(np.frombuffer(text, np.uint8), minlength=256) / len(text))
    words, lines = text.split(), text.split(b"\n")
    n = max(1, len(words))
    again = np.mean([a == b for a, b in zip(words, words[1:])]) if len(words) > 1 else 0.0
    packed = zlib.compressobj(1)
    size = sum(len(packed.compress(text[i : i + (1 << 20)])) for i in range(0, len(text), 1 << 20)) + len(packed.flush())
    out[257:] = (np.sqrt(again), len(set(words)) / n, len(set(lines)) / len(lines), min(2.0, size / len(text)), np.log1p(len(text)) / 10, min(10.0, len(text) / n / 10), n / len(lines) / 100)
    return out


@dataclass
class Ranking:
    weights: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    shift: float = 0.0

    def raw(self, features: np.ndarray) -> np.ndarray:
        return np.clip((features - self.mean) / self.scale, -8, 8) @ self.weights

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        raw = self.raw(np.stack([text_features(t) for t in texts]).astype(np.float64))
        return 1 / (1 + np.exp(-np.clip(raw + self.shift, -30, 30)))


def fit_ranking(good: np.ndarray, bad: np.ndarray, bad_share: float, steps: int = 400, pairs: int = 2000, rate: float = 0.03, decay: float = 1e-3, seed: int = 11) -> Ranking:
    """Bradley-Terry: P(good beats bad) = sigmoid(score difference), logistic loss on drawn pairs, Adam.

    The threshold is a quantile of the scores: below it lies the share of label 0 among the labelled documents, each label
    weighing as much as it does there. Scores are moved so that the threshold falls on CUT_SCORE. With one label only there
    is no pair: all scores are equal, above the threshold unless the only label is 0.
    """
    both = np.concatenate([good, bad])
    model = Ranking(np.zeros(good.shape[1]), both.mean(axis=0) if len(both) else np.zeros(good.shape[1]), np.ones(good.shape[1]))
    if not len(good) or not len(bad):
        model.shift = -1.0 - np.log(1 / CUT_SCORE - 1) if len(bad) else 0.0
        return model
    model.scale = both.std(axis=0) + 0.01
    a, b = (np.clip((x - model.mean) / model.scale, -8, 8) for x in (good, bad))
    rng, w = np.random.default_rng(seed), model.weights
    first, second = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        gap = a[rng.integers(0, len(a), pairs)] - b[rng.integers(0, len(b), pairs)]
        lost = 1 / (1 + np.exp(np.clip(gap @ w, -30, 30)))
        grad = decay * w - lost @ gap / pairs
        first += 0.1 * (grad - first)
        second += 0.01 * (grad * grad - second)
        w -= rate * (1 - step / (steps + 1)) * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    raw = np.concatenate([a @ w, b @ w])
    mass = np.concatenate([np.full(len(a), (1 - bad_share) / len(a)), np.full(len(b), bad_share / len(b))])
    order = np.argsort(raw)
    cut = min(np.searchsorted(np.cumsum(mass[order]), bad_share), len(raw) - 1)
    threshold = (raw[order][cut] + raw[order][max(0, cut - 1)]) / 2
    model.shift = -threshold - np.log(1 / CUT_SCORE - 1)
    return model


def fit_quality(docs: DataFrame, labels: DataFrame, docs_each: int = SAMPLE_DOCS) -> Ranking:
    """Fit on a bounded sample of (doc_id, quality); a document with both labels teaches both, other values and nulls nothing."""
    known = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col("quality").cast("int").alias("quality")).distinct()
    counts = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    rate = F.when(F.col("quality") == 1, docs_each / max(1, counts.get(1, 0))).otherwise(docs_each / max(1, counts.get(0, 0)))
    drawn = known.filter(unit_hash(F.lit(3), F.col("doc_id")) < rate)
    taught = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id")
    field = [T.StructField("features", T.ArrayType(T.FloatType()))]
    rows = add_columns(taught, "text", field, lambda texts: [[text_features(t) for t in texts]]).select("doc_id", "quality", "features").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["quality"], r["features"]))
    blank = np.zeros((0, len(text_features(None))))
    good, bad = (np.array([r["features"] for r in rows if r["quality"] == q], np.float64) if any(r["quality"] == q for r in rows) else blank for q in (1, 0))
    return fit_ranking(good, bad, counts.get(0, 0) / max(1, sum(counts.values())))


def score_quality(docs: DataFrame, model: Ranking) -> DataFrame:
    """``docs`` with score (0 to 1) of whole texts, empty and null ones too; all other columns pass through, a column of that
    name is replaced. Repeated rows and ties get equal scores."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return add_columns(docs, "text", [T.StructField("score", T.DoubleType())], lambda texts: [shared.value.scores(texts)])


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Query rows: labels teach only where crc32(doc_id) mod 5 is not 0; documents where it is are held_out."""
    model = fit_quality(docs, labels.filter(remainder(F.col("doc_id"), 5) != 0))
    held_out = F.coalesce(remainder(F.col("doc_id"), 5) == 0, F.lit(False))
    return score_quality(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= CUT_SCORE).cast("int").alias("predicted"))
