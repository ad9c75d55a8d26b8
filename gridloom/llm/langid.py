"""Language identification: a bidirectional gated recurrent network over bytes, trained in numpy, labels every byte of a text."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm.common import add_columns, unit_hash

UNKNOWN = "und"
#: Bounds of the labelled sample the network is fitted on: about so many documents of each language, a piece of each.
SAMPLE_DOCS, SAMPLE_CHARS, MOST_LANGUAGES = 400, 600, 256
#: The network starts anew every so many bytes, in training and in use, so texts of any length run side by side.
SEGMENT = 96
PAD = 256


def softsign(a: np.ndarray) -> np.ndarray:
    return a / (1 + np.abs(a))


@dataclass
class Direction:
    """Gated recurrence without a reset gate (light GRU): z = gate, c = candidate, h <- h + z (c - h), softsign as squashing."""

    embed: np.ndarray  # (2, 257, H): what a byte adds to gate and candidate
    turn: np.ndarray  # (2, H, H)
    out: np.ndarray  # (H, L)

    def run(self, x: np.ndarray, logits: np.ndarray, keep: bool = False) -> list:
        """Add this direction's share to the logits (T, B, L) of symbols x (T, B); with ``keep`` returns what training needs."""
        h = np.zeros((x.shape[1], self.turn.shape[1]), np.float32)
        a, b, trail = np.empty((2, *h.shape), np.float32), np.empty((2, *h.shape), np.float32), []
        for t in range(len(x)):
            if keep:
                a, b = np.empty_like(a), np.empty_like(b)
            for g in (0, 1):
                self.embed[g].take(x[t], axis=0, out=a[g], mode="clip")
            a += np.matmul(h, self.turn, out=b)
            np.abs(a, out=b)
            b += 1
            a /= b
            z = (a[0] + 1) * np.float32(0.5)
            if keep:
                trail.append((h, a, z))
            h = h + z * (a[1] - h)
            logits[t] += h @ self.out
        return [*trail, h] if keep else []

    def gradients(self, x: np.ndarray, trail: list, d_logits: np.ndarray) -> list[np.ndarray]:
        """Backpropagation through time."""
        d_turn, d_out = np.zeros_like(self.turn), np.zeros_like(self.out)
        d_a, d_h, after = np.empty((len(x), *trail[0][1].shape), np.float32), 0.0, trail[-1]
        for t in range(len(x) - 1, -1, -1):
            h, s, z = trail[t]
            d_out += after.T @ d_logits[t]
            d_h = d_h + d_logits[t] @ self.out.T
            slope = (1 - np.abs(s)) ** 2
            d_a[t, 0] = d_h * (s[1] - h) * np.float32(0.5) * slope[0]
            d_a[t, 1] = d_h * z * slope[1]
            d_turn += h.T @ d_a[t]
            d_h = d_h * (1 - z) + d_a[t, 0] @ self.turn[0].T + d_a[t, 1] @ self.turn[1].T
            after = h
        flat, columns = x.ravel(), d_a.transpose(1, 3, 0, 2).reshape(2, -1, x.size)
        d_embed = np.stack([np.stack([np.bincount(flat, weights=c, minlength=PAD + 1) for c in g], axis=1) for g in columns])
        return [d_embed.astype(np.float32), d_turn, d_out]


class ByteNetwork:
    def __init__(self, languages: list[str], hidden: int = 8, seed: int = 3):
        rng, self.languages = np.random.default_rng(seed), languages
        draw = lambda scale, *shape: (rng.standard_normal(shape) * scale).astype(np.float32)
        self.ways = [Direction(draw(0.5, 2, PAD + 1, hidden), draw(0.3, 2, hidden, hidden), draw(0.1, hidden, len(languages))) for _ in range(2)]
        self.bias = np.zeros(len(languages), np.float32)

    def probabilities(self, x: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
        """For symbols (T, B): probabilities (T, B, L). States lie within -1 and 1, so no logit can overflow."""
        logits = np.tile(self.bias, (*x.shape, 1))
        trails = [self.ways[0].run(x, logits, keep), self.ways[1].run(x[::-1], logits[::-1], keep)]
        np.exp(logits, out=logits)
        flat = logits.reshape(-1, logits.shape[2])
        flat /= (flat @ np.ones(flat.shape[1], np.float32))[:, None]
        return logits, trails

    def fit(self, examples: list[tuple[str, bytes]], steps: int = 400, batch: int = 256, rate: float = 0.02, seed: int = 5) -> ByteNetwork:
        """Cross-entropy at every byte, Adam; languages and their segments are drawn evenly."""
        rng, of = np.random.default_rng(seed), {name: i for i, name in enumerate(self.languages)}
        pools = [np.concatenate([segments([t])[0] for name, t in examples if of[name] == k]) for k in range(len(self.languages))]
        weights = [w for d in self.ways for w in (d.embed, d.turn, d.out)] + [self.bias]
        first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
        for step in range(1, steps + 1):
            who = rng.integers(0, len(pools), batch)
            x = np.ascontiguousarray(np.stack([pools[k][rng.integers(0, len(pools[k]))] for k in who]).T)
            p, trails = self.probabilities(x, keep=True)
            p[:, np.arange(batch), who] -= 1
            p *= (x != PAD)[:, :, None] / np.float32(max(1, (x != PAD).sum()))
            grads = self.ways[0].gradients(x, trails[0], p) + self.ways[1].gradients(x[::-1], trails[1], p[::-1]) + [p.sum(axis=(0, 1))]
            for w, g, m, v in zip(weights, grads, first, second):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                w -= np.float32(rate * (1 - step / (steps + 1))) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + np.float32(1e-6))
        return self

    def predict(self, texts: list[bytes | None]) -> tuple[list[str], list[float]]:
        """Language and pooled probability of whole texts: the mean over all bytes."""
        known = [i for i, t in enumerate(texts) if t and self.languages and has_letter(t)]
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if not known:
            return names, scores
        table, starts = segments([texts[i] for i in known])
        sums = np.empty((len(table), len(self.languages)))
        wide = max(1, min(2048, (1 << 22) // (SEGMENT * len(self.languages))))
        for a in range(0, len(table), wide):
            x = np.ascontiguousarray(table[a : a + wide].T)
            p = self.probabilities(x)[0]
            p *= (x != PAD)[:, :, None]
            sums[a : a + wide] = p.sum(axis=0)
        pooled = np.add.reduceat(sums, starts, axis=0)
        pooled /= pooled.sum(axis=1, keepdims=True)
        for i, k, p in zip(known, pooled.argmax(axis=1), pooled.max(axis=1)):
            names[i], scores[i] = self.languages[k], float(min(p, 1.0))
        return names, scores


def segments(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of SEGMENT symbols (bytes, A-Z as small ones), the last of each text padded, and the first row of each (not empty) text."""
    counts = np.array([-(-len(t) // SEGMENT) for t in texts])
    starts = np.concatenate([[0], np.cumsum(counts)])
    table = np.full(starts[-1] * SEGMENT, PAD, np.int64)
    for t, a in zip(texts, starts):
        table[a * SEGMENT : a * SEGMENT + len(t)] = np.frombuffer(t.lower(), np.uint8)
    return table.reshape(-1, SEGMENT), starts[:-1]


def has_letter(text: bytes) -> bool:
    return re.search(rb"[A-Za-z]", text) is not None or any(c.isalpha() for c in text.decode("utf-8", "replace"))


def labelled_sample(docs: DataFrame, docs_each: int = SAMPLE_DOCS, chars: int = SAMPLE_CHARS) -> list[tuple[str, bytes]]:
    """About ``docs_each`` documents of every language, chosen by a hash of doc_id, a piece of each at a place chosen likewise."""
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGUAGES).collect()
    if not counts:
        return []
    rates = F.create_map(*[F.lit(v) for r in counts for v in (r["lang"], min(1.0, docs_each / r["count"]))])
    place = (unit_hash(F.lit(2), F.col("doc_id")) * F.greatest(F.length("text") - chars, F.lit(0))).cast("int") + 1
    drawn = labelled.filter(unit_hash(F.lit(1), F.col("doc_id"), F.col("text")) < F.try_element_at(rates, F.col("lang")))
    rows = drawn.select("lang", F.encode(F.substring("text", place, F.lit(chars)), "UTF-8").alias("piece")).collect()
    return sorted((r["lang"], bytes(r["piece"])) for r in rows if has_letter(bytes(r["piece"])))


def fit_languages(docs: DataFrame, **bounds) -> ByteNetwork:
    """Learn from the columns text and lang of ``docs``. Without any usable row the network knows no language."""
    examples = labelled_sample(docs, **bounds)
    languages = sorted({name for name, _ in examples})
    network = ByteNetwork(languages)
    return network.fit(examples) if examples else network


def identify(docs: DataFrame, network: ByteNetwork) -> DataFrame:
    """``docs`` with lang_pred and score (0 to 1) for whole texts.

    A text that is null, empty or without a letter has ``und`` and 0, and so have all texts for a network without languages.
    All other columns pass through; columns of the two names are replaced. Repeated rows get equal results; of tied languages
    the first by name is taken. A very long text is one of many rows of segments and never held more than once.
    """
    shared = docs.sparkSession.sparkContext.broadcast(network)
    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    return add_columns(docs, "text", fields, lambda texts: list(shared.value.predict(texts)))


def remainder(key: Column, n: int) -> Column:
    return F.crc32(key.cast("string").cast("binary")) % n


def language_report(docs: DataFrame) -> DataFrame:
    """Query rows: learned from documents whose crc32(doc_id) mod 3 is not 1; those are held_out (a null doc_id is not, and teaches nothing)."""
    held_out = remainder(F.col("doc_id"), 3) == 1
    network = fit_languages(docs.filter(~held_out).select("doc_id", "text", "lang"))
    return identify(docs.select("doc_id", "text"), network).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")


#: A text is identified if its best language has this many times the probability of a blind guess.
OVER_CHANCE = 1.2


def keep_identified(docs: DataFrame, over_chance: float = OVER_CHANCE) -> DataFrame:
    """``docs`` without those that are rejected: no letter, or a best pooled probability under ``over_chance`` / languages.

    The bar follows the number of learned languages, so that texts hardly better than a guess go whether there are two or
    hundreds (0.3 for four). Where fewer than two languages can be learned nothing tells texts apart: with one only texts
    without a letter go, with none every document stays. Null and empty texts have no letter. Repeated rows share their
    fate; columns pass through, also ones named lang_pred or score; an empty table stays empty.
    """
    held_out = remainder(F.col("doc_id"), 3) == 1
    network = fit_languages(docs.filter(~held_out).select("doc_id", "text", "lang"))
    if not network.languages:
        return docs
    at_least = over_chance / len(network.languages) if len(network.languages) > 1 else 0.0
    aside = docs.withColumnsRenamed({c: f"__kept_{c}" for c in docs.columns if c in ("lang_pred", "score")})
    found = identify(aside, network).filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= at_least)).drop("lang_pred", "score")
    return found.withColumnsRenamed({f"__kept_{c}": c for c in ("lang_pred", "score")}).select(*docs.columns)
