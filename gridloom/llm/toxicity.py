"""Toxicity scores by FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm.common import add_columns, unit_hash
from gridloom.llm.langid import remainder
from gridloom.session import settle

#: Bounds of the labelled sample: about so many documents of each label, and about so many bytes of text in all.
SAMPLE_DOCS, SAMPLE_BYTES = 4000, 64 << 20
CUT_SCORE = 0.3
BITS = 20
STEMS = (4, 5)
WORD = re.compile(r"[^\W_]+")
#: Odd factors that tell the kinds of features apart.
FACTORS = [int(x) | 1 for x in np.random.default_rng(11).integers(1, 1 << 63, 2 + len(STEMS) + 3, dtype=np.uint64)]


def word_hashes(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """For every text the number of its words, and one row of hashes a word: the whole word, then its stems."""
    known: dict[str, int] = {}
    counts, places = np.zeros(len(texts), np.int64), []
    for i, text in enumerate(texts):
        words = WORD.findall(text.decode("utf-8", "replace").lower()) if text else []
        counts[i] = len(words)
        places.append(np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words)))
    table = np.zeros((len(known), 1 + len(STEMS)), np.uint64)
    for w, at in known.items():
        table[at] = [_text_hash(w), *(_text_hash(w[:n]) if len(w) > n else 0 for n in STEMS)]
    return counts, table[np.concatenate(places) if places else np.zeros(0, np.int64)]


def _text_hash(word: str) -> int:
    """A 64-bit hash that is the same in every process."""
    h = 0xCBF29CE484222325
    data = word.encode("utf-8", "surrogatepass")
    for i in range(0, len(data), 7):
        h = (h ^ int.from_bytes(data[i : i + 7], "little")) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF
        h ^= h >> 29
    return h | 1


def hashed_features(texts: list[bytes | None], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(place of the text, feature) of every word, word stem, pair of neighbouring words and pair with one word between.

    Features are numbers below 2^bits, repeats included; no pair reaches into another text.
    """
    counts, h = word_hashes(texts)
    who = np.repeat(np.arange(len(texts)), counts)
    parts = [(who, h[:, 0] * np.uint64(FACTORS[0]))]
    for k in range(len(STEMS)):
        has = h[:, 1 + k] != 0
        parts.append((who[has], h[has, 1 + k] * np.uint64(FACTORS[1 + k])))
    for gap in (1, 2):
        same = who[gap:] == who[:-gap]
        a, b = h[:-gap, 0][same], h[gap:, 0][same]
        mixed = a * np.uint64(FACTORS[-gap]) + (b ^ (b >> np.uint64(31))) * np.uint64(FACTORS[-3])
        parts.append((who[gap:][same], (mixed ^ (mixed >> np.uint64(32))) * np.uint64(FACTORS[0])))
    return np.concatenate([w for w, _ in parts]), (np.concatenate([x for _, x in parts]) >> np.uint64(64 - bits)).astype(np.int64)


@dataclass
class Ftrl:
    """The learner's state: for each coordinate the shifted gradient sum and the sum of squared gradients; the last is the bias."""

    z: np.ndarray
    n: np.ndarray
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 4.0
    l2: float = 1.0

    @classmethod
    def empty(cls, bits: int = BITS, **how: float) -> Ftrl:
        return cls(np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1), **how)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z = self.z[at]
        free = np.where(at == len(self.z) - 1, 0.0, self.l1)
        return np.where(np.abs(z) <= free, 0.0, -(z - np.sign(z) * free) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2))

    def learn(self, features: np.ndarray, label: float) -> None:
        at = np.append(features, len(self.z) - 1)
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - label
        step = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - step * w
        self.n[at] += g * g


@dataclass
class SparseWeights:
    """What is broadcast: the coordinates that L1 left above zero, the bias and the shift of the threshold."""

    at: np.ndarray
    weight: np.ndarray
    bits: int
    bias: float = 0.0

    def raw(self, texts: list[bytes | None]) -> np.ndarray:
        """Bias plus the weights of the distinct features of every text."""
        dense = np.zeros(1 << self.bits, np.float32)
        dense[self.at] = self.weight
        who, features = hashed_features(texts, self.bits)
        live = dense[features] != 0
        pairs = np.unique((who[live] << self.bits) | features[live])
        return self.bias + np.bincount(pairs >> self.bits, dense[pairs & ((1 << self.bits) - 1)], len(texts))

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(texts), -30, 30))) if texts else np.zeros(0)


def fit_ftrl(rows: list[tuple[np.ndarray, int]], share: float, bits: int = BITS, epochs: int = 4, seed: int = 7, **how: float) -> SparseWeights:
    """FTRL-proximal over (distinct features, label) in a seeded order, several epochs.

    The threshold is set on a fifth of the rows by a learner that hasn't seen them: the cut between two neighbouring scores
    with the best F1, where the labels weigh as in the corpus (``share`` of label 1). Scores move so that it falls on
    CUT_SCORE. With one label or none there is nothing to tell apart: all scores are 0, or 1 where the only label is 1.
    """
    labels = np.array([y for _, y in rows], np.int64)
    if len(set(labels.tolist())) < 2:
        return SparseWeights(np.zeros(0, np.int64), np.zeros(0, np.float32), bits, 30.0 if labels.any() else -30.0)

    def taught(some: list[int]) -> Ftrl:
        learner, rng = Ftrl.empty(bits, **how), np.random.default_rng(seed)
        for _ in range(epochs):
            for i in rng.permutation(some):
                learner.learn(*rows[i])
        return learner

    unseen = np.zeros(len(rows), bool)
    for y in (0, 1):
        unseen[np.flatnonzero(labels == y)[::5]] = True
    part = taught(np.flatnonzero(~unseen).tolist()) if (np.bincount(labels[~unseen], minlength=2) > 0).all() else taught(list(range(len(rows))))
    raw = np.array([part.weights(np.append(rows[i][0], 1 << bits)).sum() for i in np.flatnonzero(unseen)])
    truth = labels[unseen]
    mass = np.where(truth == 1, share / max(1, (truth == 1).sum()), (1 - share) / max(1, (truth == 0).sum()))
    order = np.argsort(-raw, kind="stable")
    hits, taken = np.cumsum((mass * truth)[order]), np.cumsum(mass[order])
    f1 = 2 * hits / (taken + share)
    ends = np.append(raw[order][1:] != raw[order][:-1], True)  # equal scores stay together
    best = int(np.argmax(np.where(ends, f1, -1)))
    below = raw[order][best + 1] if best + 1 < len(raw) else raw[order][best] - 1.0
    plain = float(part.weights(np.array([1 << bits]))[0])
    below = max(below, plain) if raw[order][best] > plain else below  # a text without a known feature stays below
    threshold = (raw[order][best] + below) / 2
    learner = taught(list(range(len(rows))))
    at = np.flatnonzero(np.abs(learner.z[:-1]) > learner.l1)
    bias = float(learner.weights(np.array([1 << bits]))[0]) - threshold - np.log(1 / CUT_SCORE - 1)
    return SparseWeights(at, learner.weights(at).astype(np.float32), bits, bias)


def fit_toxicity(docs: DataFrame, labels: DataFrame, docs_each: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES) -> SparseWeights:
    """Fit on a bounded sample of (doc_id, toxic), drawn by a hash of id and text so that one id with many texts is cut too.

    A document with both labels teaches both; other values, nulls and ids without a document teach nothing; repeated rows of
    one id and text count once. Only the distinct hashed features of the sample come to the driver.
    """
    marks = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col("toxic").cast("int").alias("toxic")).distinct()
    texts = docs.select("doc_id", F.xxhash64("text").alias("code"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes")).distinct()
    known = settle(texts.join(marks, "doc_id"))
    facts = {r["toxic"]: (r["n"], r["bytes"]) for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes")).collect()}

    def rate(y: int) -> float:
        n, size = facts.get(y, (0, 0))
        return min(docs_each / max(1, n), sample_bytes / 2 / max(1, size))

    drawn = known.filter(unit_hash(F.lit(5), F.col("doc_id"), F.col("code")) < F.when(F.col("toxic") == 1, rate(1)).otherwise(rate(0)))
    drawn = drawn.select(F.col("doc_id").alias("id"), F.col("code").alias("mark"), "toxic")
    taught = docs.select("doc_id", "text").join(F.broadcast(drawn), (F.col("doc_id") == F.col("id")) & (F.xxhash64("text") == F.col("mark")))

    def distinct_features(some: list[bytes | None]) -> list[list[bytes]]:
        who, features = hashed_features(some)
        pairs = np.unique((who << BITS) | features)
        cuts = np.searchsorted(pairs >> BITS, np.arange(1, len(some)))
        return [[x.astype(np.int32).tobytes() for x in np.split(pairs & ((1 << BITS) - 1), cuts)]]

    made = add_columns(taught.select("id", "mark", "toxic", "text"), "text", [T.StructField("features", T.BinaryType())], distinct_features)
    rows = made.drop("text").dropDuplicates(["id", "mark", "toxic"]).toArrow().to_pylist()
    rows.sort(key=lambda r: (r["id"], r["mark"], r["toxic"]))
    total = sum(n for n, _ in facts.values())
    return fit_ftrl([(np.frombuffer(r["features"], np.int32).astype(np.int64), r["toxic"]) for r in rows], facts.get(1, (0, 0))[0] / max(1, total))


def score_toxicity(docs: DataFrame, model: SparseWeights) -> DataFrame:
    """``docs`` with score (0 to 1) of whole texts; null and empty texts get the bias alone. All other columns pass through, a
    column named score is replaced. Repeated rows and ties get equal scores; an empty table stays empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return add_columns(docs, "text", [T.StructField("score", T.DoubleType())], lambda texts: [shared.value.scores(texts)])


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Query rows: labels teach only where crc32(doc_id) mod 4 is not 2; documents where it is are held_out (a null id is not)."""
    model = fit_toxicity(docs, labels.filter(remainder(F.col("doc_id"), 4) != 2))
    held_out = F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False))
    return score_toxicity(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= CUT_SCORE).cast("int").alias("predicted"))
