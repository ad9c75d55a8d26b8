"""Spelling variants beside brute force: one-edit pairs, very long words, chains of forms, awkward inputs."""

import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gridloom.llm import spelling


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) < len(b):
        a, b = b, a
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def brute_words(rows):
    out = Counter()
    for doc_id, text in rows:
        run = ""
        for c in (text or "") + " ":
            if c.isascii() and c.isalpha() or "À" <= c <= "ÿ":
                run += c.lower() if c.isascii() else c
                continue
            if run:
                h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
                out[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
            run = ""
    return {w: n for w, n in out.items() if len(w) >= 6 and n >= 5}


def brute(rows):
    words = brute_words(rows)
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    best = {w: min(vs, key=lambda v: (-words[v], v)) if vs else None for w, vs in near.items()}
    form = {w: b if b and words[b] >= 5 * words[w] else None for w, b in best.items()}
    out = Counter()
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out[(w, form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None)] += 1
    return out


def told(df):
    return Counter(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_like_brute_force(spark, seed):
    rng, words = random.Random(seed), set()
    while len(words) < 250:
        w = "".join(rng.choice("abéà") for _ in range(rng.randint(6, 9)))
        words |= {w, w[:3] + rng.choice("abéàz") + w[4:], w + rng.choice("ab"), w[1:] + "b"}
    text = [w for w in sorted(words) for _ in range(rng.choice([4, 5, 6, 30, 200]))]
    rng.shuffle(text)
    rows = [(i, " ".join(text[i::37])) for i in range(37)]
    got = told(spelling.spelling_report(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)))
    assert got == brute(rows) and any(r[1] for r in got)


def test_chains_hot_words_and_very_long_ones(spark):
    rng = random.Random(3)
    giant = "".join(rng.choice("abcdefgh") for _ in range(4000))
    edge = "".join(rng.choice("abcdefgh") for _ in range(spelling.TRIE_LENGTH))
    text = []
    for n, w in [(5, "abcdef"), (25, "abcdeff"), (125, "abcdefff"), (625, "abcdeffff"), (3200, "abcdefffff"), (9000, "hotword"), (6, "hotwore"), (6, "hotworf"), (5, "otword"), (50, edge), (5, edge + "x"), (7, edge[:20] + "z" + edge[21:])]:
        text += [w] * n
    text += [giant] * 30 + [giant[:1999] + "z" + giant[2000:]] * 5 + [giant[:-1]] * 5 + ["z" + giant] * 6 + [giant[:100] + giant[102:]] * 5
    rng.shuffle(text)
    rows = [(i, " ".join(text[i::20])) for i in range(20)] + [(None, None)]
    got = told(spelling.spelling_report(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got == brute(rows)
    assert sum(r[0] == "abcdef" and r[2] == "abcdefffff" for r in got) == 1


def test_awkward_tables(spark):
    rows = [(1, "Straße STRASSE straße×÷ÿÀ 中文中文中文中文 abc1defghi"), (None, "Niveaux niveaux"), (None, "Niveaux niveaux"), (1, ""), (2, None), (1, "Niveaux")] * 3
    df = spark.createDataFrame([(*r, "x", 5) for r in rows], "doc_id long, text string, word string, n long")
    assert told(spelling.spelling_report(df)) == brute(rows)
    assert spelling.spelling_report(df.limit(0)).count() == 0
    assert spelling.spelling_report(df.withColumn("text", F.lit(None).cast("string"))).count() == 0


def test_a_task_that_sends_its_counts_early(spark):
    rows = [(i, "variant variants varient " * 6) for i in range(5)]
    assert sum(sum(spelling.text_words(*r).values()) for r in [(1, b"Abcdef abcdef xyz")]) == 2
    held, spelling.HELD_WORDS = spelling.HELD_WORDS, 1
    try:
        assert told(spelling.spelling_report(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)
    finally:
        spelling.HELD_WORDS = held
