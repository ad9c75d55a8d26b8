"""Trained operators: accuracy on held-out rows, gradients, and probabilities that sum to one."""

import itertools
import os
import subprocess
import sys
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridloom.llm import langid, quality, scoring
from gridloom.llm.queries import op6_masked_likelihood, op7_byte_language_id, op8_pairwise_quality
from gridloom.session import settle

DIR = "/root/testdata/sf0.01"


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "lang")
    rows = op7_byte_language_id(spark, DIR).join(docs, "doc_id").collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.97


def test_language_gradients_are_right():
    network = langid.ByteNetwork(["a", "b", "c"], hidden=4)
    for way in network.ways:
        way.embed, way.turn, way.out = (w.astype(np.float64) for w in (way.embed, way.turn, way.out))
    rng = np.random.default_rng(1)
    x, who = rng.integers(97, 100, (7, 5)), rng.integers(0, 3, 5)

    def loss():
        return -np.log(network.probabilities(x)[0][:, np.arange(5), who]).sum()

    p, trails = network.probabilities(x, keep=True)
    p[:, np.arange(5), who] -= 1
    for way, xs, trail, d in ((network.ways[0], x, trails[0], p), (network.ways[1], x[::-1], trails[1], p[::-1])):
        for w, g in zip((way.embed, way.turn, way.out), way.gradients(xs, trail, d)):
            for at in zip(*np.nonzero(np.abs(g) > 0.05)):
                old, eps = w[at], 1e-2
                w[at] = old + eps
                up = loss()
                w[at] = old - eps
                down = loss()
                w[at] = old
                assert (up - down) / (2 * eps) == pytest.approx(g[at], rel=0.05, abs=0.02)


def test_language_of_awkward_texts(spark):
    rows = [(i, "the house and the tree " * 3, "en", "x") for i in range(40)] + [(50 + i, "der baum und das haus " * 3, "de", "x") for i in range(40)]
    rows += [(100, None, "en", "x"), (101, "", "en", "x"), (102, "12 34 !?", "en", "x"), (103, "é", None, "x"), (104, "the house and " * 20000, None, "x"), (None, "der baum und das haus", "de", "x"), (1, rows[1][1], "en", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    got = {r["doc_id"]: r for r in langid.language_report(df).collect()}
    assert langid.language_report(df).count() == len(rows)
    assert [got[k]["lang_pred"] for k in (100, 101, 102)] == ["und"] * 3 and got[104]["lang_pred"] == "en" and got[None]["lang_pred"] == "de"
    kept = langid.keep_identified(df)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == set(got) - {100, 101, 102}
    empty = langid.language_report(df.limit(0))
    assert empty.count() == 0 and {r["lang_pred"] for r in langid.language_report(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_documents_stay_where_no_language_can_be_learned(spark):
    rows = [(i, "the house and the tree", None if i % 2 else "") for i in range(6)] + [(7, None, None), (8, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert langid.keep_identified(df.withColumn("lang", F.lit(None).cast("string"))).count() == len(rows)
    one = langid.keep_identified(df.withColumn("lang", F.lit("en")))
    assert {r["doc_id"] for r in one.collect()} == set(range(6))
    assert langid.keep_identified(df.limit(0)).count() == 0


def test_quality_held_out(spark):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = op8_pairwise_quality(spark, "/root/testdata/sf0.1").join(labels, "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["quality"] == r["predicted"] for r in held]) > 0.97 and all(0 <= r["score"] <= 1 for r in rows)


def test_quality_of_awkward_rows(spark):
    docs = [(i, f"a fine text number {i} with words", 1) for i in range(40)] + [(100 + i, "spam spam spam spam spam", 2) for i in range(40)] + [(200, None, 3), (201, "", 3), (None, "x", 3), (1, "a fine text number 1 with words", 3), (203, "spam " * 50000, 4)]
    labels = [(i, 1) for i in range(40)] + [(100 + i, 0) for i in range(40)] + [(None, 1), (3, None), (4, 7), (5, 0), (6, 1)]
    d, l = spark.createDataFrame(docs, "doc_id long, text string, score int"), spark.createDataFrame(labels, "doc_id long, quality int")
    got = quality.quality_report(d, l).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(docs) and by[20]["predicted"] == 1 and by[120]["predicted"] == 0 and by[203]["predicted"] == 0
    assert quality.quality_report(d.limit(0), l).count() == 0
    assert {r["predicted"] for r in quality.quality_report(d, l.filter("quality = 1")).collect()} == {1}
    assert {r["predicted"] for r in quality.quality_report(d, l.filter("quality = 0")).collect()} == {0}
    assert quality.quality_report(d, l.limit(0)).count() == len(docs)


def small_network():
    words = scoring.Words.of([(f"w{i}".encode(), 50 - i) for i in range(9)], rare=4, rare_count=11)
    network = scoring.WindowNetwork(words)
    network.inner = np.random.default_rng(3).standard_normal(network.inner.shape).astype(np.float32)
    return network


def test_conditional_probabilities_sum_to_one():
    network = small_network()
    base = network.words.coded(b"w1 w2 w3 w4 w5")
    around = network.windows([base])[:, 2:3]
    ids = np.array([scoring.RARE, *range(2, 11)])
    place, _, _, _, score = network.turns(ids, network.states(np.repeat(around, len(ids), axis=1)))
    p = np.exp(np.bincount(place, weights=-np.log1p(np.exp(-score))))
    assert p.sum() == pytest.approx(1, abs=1e-5)


def test_windows_do_not_cross_texts():
    network = small_network()
    alone, with_others = network.windows([np.array([3, 4, 5])]), network.windows([np.array([9]), np.array([3, 4, 5]), np.array([8, 8])])
    assert alone.tolist() == with_others[:, 1:4].tolist() == [[1, 1, 3], [1, 3, 4], [4, 5, 1], [5, 1, 1]]


def test_likelihood_prefers_real_order_and_handles_awkward_texts(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text")
    network = scoring.train(docs)
    real = [t for (t,) in docs.filter("length(text) > 800").limit(60).select("text").collect()]
    rng = np.random.default_rng(2)
    mixed = [" ".join(rng.permutation(t.split())) for t in real]
    coded = lambda texts: [network.words.coded(t.encode()) for t in texts]
    assert np.mean(network.log_likelihood(coded(real)) > network.log_likelihood(coded(mixed))) > 0.6
    odd = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, " \n", 1), (None, "the the", 1), (4, "the " * 60000, 1), (4, "the " * 60000, 1), (5, "nie-gesehen", 1)], "doc_id long, text string, n_tokens int")
    got = scoring.score_documents(odd, network).collect()
    assert len(got) == 7 and sorted(r["n_tokens"] for r in got) == [0, 0, 0, 1, 2, 60000, 60000]
    assert all((r["log_likelihood"] == 0) == (r["n_tokens"] == 0) and r["log_likelihood"] <= 0 for r in got)
    assert scoring.likelihood_report(odd.select("doc_id", "text")).count() == 7 and scoring.likelihood_report(docs.limit(0)).count() == 0


def test_corpus_counts_are_whole(spark):
    df = spark.createDataFrame([("A b a",), (None,), ("b\tc",)], "text string")
    assert {bytes(r["word"]): r["n"] for r in scoring.word_counts(df).collect()} == {b"a": 2, b"b": 2, b"c": 1}


@pytest.mark.parametrize("k", [0, 1, 5, 6, 40, 300, 2000])
def test_the_most_frequent_words_are_those_of_a_sort(spark, k):
    rows = [(f"w{i * 7919 % 1009:04d}é".encode(), 9 if i < 5 else 3 if i < 8 else 1) for i in range(1009)]
    got = scoring.most_frequent(spark.createDataFrame(rows, "word binary, n long").repartition(7), k)
    assert got == sorted(rows, key=lambda r: (-r[1], r[0]))[:k]


def test_the_word_table_does_not_come_to_the_driver(tmp_path):
    code = """
import numpy as np
from pyspark.sql import SparkSession
from gridloom.llm import scoring
spark = SparkSession.builder.master("local[4]").config(map={"spark.driver.maxResultSize": "8m", "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.checkpoint.dir": CKPT}).getOrCreate()
docs = spark.range(2000).selectExpr("array_join(transform(sequence(0, 149), i -> concat('word', id * 150 + i)), ' ') AS text")
print("learned", len(scoring.train(docs).words.ids))
"""
    env = os.environ | {"PYTHONPATH": os.path.dirname(os.path.dirname(scoring.__file__)).rpartition("/")[0]}
    run = subprocess.run([sys.executable, "-c", code.replace("CKPT", repr(str(tmp_path)))], env=env, capture_output=True, text=True, timeout=300)
    assert "learned 4382" in run.stdout, run.stderr[-2000:]


def test_training_lifts_the_likelihood(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").select("text")
    trained = scoring.train(docs)
    blank = scoring.WindowNetwork(trained.words)
    coded = [trained.words.coded(t.encode()) for (t,) in docs.limit(100).collect()]
    assert trained.log_likelihood(coded).sum() > blank.log_likelihood(coded).sum() * 0.95
    assert op6_masked_likelihood(spark, DIR).columns == ["doc_id", "n_tokens", "log_likelihood", "mean_log_likelihood"]


def test_every_word_has_its_own_share():
    counts = {b"w%d" % i: 1 + i % 7 for i in range(300)}
    hashed = np.zeros(20, np.int64)
    for w, n in counts.items():
        hashed[scoring.crc32(w) % 20] += n
    network = scoring.WindowNetwork(scoring.Words.of([(b"the", 900), (b"a", 700)], 0, 0, hashed))
    network.inner = np.random.default_rng(3).standard_normal(network.inner.shape).astype(np.float32)
    leaf = network.words.coded(b" ".join(counts))
    assert network.words.is_hashed(leaf).all() and len(set(leaf)) == 20 and not network.words.is_hashed(network.words.coded(b"The a")).any()
    ids = np.array([scoring.RARE, *range(2, network.words.size)])
    place, _, _, _, score = network.turns(ids, network.states(np.full((4, len(ids)), 2)))
    p = np.bincount(place, weights=-np.log1p(np.exp(-score))) - network.words.shared[ids]
    of = dict(zip(ids.tolist(), p))
    seen = sum(n * np.exp(of[i]) for i, n in zip(leaf.tolist(), counts.values()))
    unseen = sum(np.exp(of[i]) for i in set(leaf.tolist()))
    assert seen + unseen + sum(np.exp(of[i]) for i in (scoring.RARE, 2, 3)) == pytest.approx(1, abs=1e-5)


def test_words_outside_the_head_are_scored_by_their_counts(spark):
    often = " ".join(f"often{i % 40}" for i in range(400))
    docs = spark.createDataFrame([(i, f"{often} mid mid mid rare{i}") for i in range(30)] + [(30, None), (31, ""), (5, f"{often} mid mid mid rare5")], "doc_id long, text string")
    network = scoring.train(docs, vocabulary=10)
    assert 10 < network.words.size and network.words.hashed.sum() > 0
    table = {bytes(r["word"]): r["n"] for r in scoring.word_counts(docs).collect()}
    got = scoring.score_documents(docs, network).collect()
    assert len(got) == 33
    for r in got:
        coded = network.words.coded((r["text"] or "").encode())
        own = sum(np.log(table[w]) for w in scoring.fold((r["text"] or "").encode()) if w not in network.words.ids)
        assert r["log_likelihood"] == pytest.approx(network.log_likelihood([coded])[0] + own, abs=1e-4)


def test_the_score_of_a_whole_text_is_that_of_a_plain_loop(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").limit(200)
    network = scoring.train(docs, vocabulary=50)
    table = {bytes(r["word"]): r["n"] for r in scoring.word_counts(docs).collect()}
    words, side = network.words, network.side
    for r in scoring.score_documents(docs, network).limit(12).collect():
        text = scoring.fold((r["text"] or "").encode())
        ids = [words.ids.get(w) or len(words.ids) + 2 + scoring.crc32(w) % len(words.hashed) for w in text]
        total = 0.0
        for i, word in enumerate(text):
            state = 0.0
            for k, shift in enumerate(s for s in range(-side, side + 1) if s):
                state = state + network.contexts[k][ids[i + shift] if 0 <= i + shift < len(ids) else scoring.EDGE].astype(float)
            state = state / (1 + np.abs(state))
            for at in range(words.at[ids[i]], words.at[ids[i] + 1]):
                node = network.inner[words.nodes[at]].astype(float)
                total -= np.log1p(np.exp(-words.turns[at] * (node[:-1] @ state + node[-1])))
            if word not in words.ids:
                total += np.log(table[word]) - np.log1p(words.hashed[ids[i] - len(words.ids) - 2])
        assert r["n_tokens"] == len(text) and r["log_likelihood"] == pytest.approx(total, rel=1e-4, abs=1e-3)


def test_every_text_is_taught_once_in_slices_of_equal_shares(spark, monkeypatch):
    assert scoring.slices(1) == [(0, 1)] and scoring.slices(40) == [(0, 3), (3, 8), (8, 18), (18, 40)]
    docs = spark.createDataFrame([(f"word{i % 50} and word{i % 7} here",) for i in range(900)] + [("a b c d",)] * 600 + [(None,), ("",)], "text string")
    words = scoring.Words.of([(b"and", 900)], 0, 0, np.full(4, 9))
    dealt = scoring.dealt_texts(docs, words, 13)
    rows = dealt.groupBy("share").agg({"copies": "sum"}).collect()
    assert dealt.rdd.getNumPartitions() == 13 and sum(r[1] for r in rows) == 1500
    hot = [r[1] for r in dealt.filter("copies > 40").groupBy("share").agg({"copies": "sum"}).collect()]
    assert len(hot) == 13 and max(hot) - min(hot) <= 1
    parts = dealt.selectExpr("spark_partition_id() AS p", "share").distinct().collect()
    assert len(parts) == len({r["p"] for r in parts}) == len({r["share"] for r in parts})
    monkeypatch.setattr(scoring, "SHARE_WORDS", 700)
    network = scoring.train(docs)
    blank = scoring.WindowNetwork(network.words)
    coded = [network.words.coded(b"a b c d"), network.words.coded(b"word3 and word3 here")]
    assert (network.log_likelihood(coded) > blank.log_likelihood(coded)).all()


def test_the_fit_does_not_depend_on_partitions(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").limit(300)
    docs = settle(docs.union(docs.limit(20)).union(docs.filter("doc_id = 3")))
    runs = [{(r["doc_id"], r["n_tokens"], r["log_likelihood"]) for r in scoring.likelihood_report(d).collect()} for d in (docs.coalesce(1), docs.repartition(7, "text"))]
    assert {x[:2] for x in runs[0]} == {x[:2] for x in runs[1]}
    a, b = ({x[0]: x[2] for x in r} for r in runs)
    assert all(a[i] == pytest.approx(b[i], rel=1e-9) for i in a)


def test_words_of_many_texts_are_those_of_each_text():
    texts = [b"  A\x0bb\x0c c\x1cd e  ", b"", b" ", None, b"x y", " Q r Z İÄ \u0085".encode(), b"\x1f a\x00b\t", b"\n\n", b"\xff\xfe A\xc3", b"b"]
    for kind, some in itertools.product((pa.string(), pa.large_string()), (texts, texts[3:5], [None], [b" "], [])):
        array = pa.array([b"cut", *some], pa.binary() if kind == pa.string() else pa.large_binary()).view(kind)[1:]
        words, sizes = scoring.split_words(array)
        assert scoring.byte_words(words) == [w for t in some for w in scoring.fold(t)] and sizes.tolist() == [len(scoring.fold(t)) for t in some]
        for hashed in (np.full(5, 3), np.zeros(0, np.int64)):
            ids = scoring.Words.of([(b"a", 9), (b"b", 8), (b"x", 2)], 0, 0, hashed)
            assert [c.tolist() for c in ids.coded_all(array)] == [ids.coded(t).tolist() for t in some]
    none = scoring.Words.of([], 0, 0)
    assert none.coded_all(pa.array(["a b"]))[0].tolist() == [scoring.RARE] * 2 and scoring.WindowNetwork(none).log_likelihood([none.coded(b"a b")]).tolist() == [0]


def plain_step(network, squares, target, around, rate=0.3):
    """One step with all turns of all places at once."""
    h = network.states(around)
    place, node, turn, vector, score = network.turns(target, h)
    pull = turn / (1 + np.exp(np.clip(score, -30, 30)))
    d_vector = np.concatenate([h.take(place, axis=0) * pull[:, None], pull[:, None]], axis=1)
    d_h = np.zeros_like(h)
    firsts = np.flatnonzero(np.diff(place, prepend=-1))
    d_h[place[firsts]] = np.add.reduceat(vector[:, :-1] * pull[:, None], firsts, axis=0)
    d_h *= (1 - np.abs(h)) ** 2
    for k, (table, ids, grads) in enumerate([(network.inner, node, d_vector), *((t, i, d_h) for t, i in zip(network.contexts, around))]):
        rows, at = np.flatnonzero(np.bincount(ids, minlength=len(table))), np.empty(len(table), np.int64)
        at[rows] = np.arange(len(rows))
        sums = np.stack([np.bincount(at.take(ids), weights=g, minlength=len(rows)) for g in grads.T], axis=1)
        squares[k][rows] += sums**2
        table[rows] += rate * sums / np.sqrt(squares[k][rows])


def test_a_step_by_levels_is_the_plain_step_in_less_room():
    rng = np.random.default_rng(5)
    kept = [(b"w%d" % i, 1 + 400_000 // (i + 2)) for i in range(12_000)]
    words = scoring.Words.of(kept, 0, 0, rng.integers(1, 40, 12_000))
    coded = [2 + np.minimum(rng.zipf(1.15, n) - 1, words.size - 3) for n in rng.integers(1, 600, 200)]
    target, plain, network = np.concatenate(coded), scoring.WindowNetwork(words), scoring.WindowNetwork(words)
    trainer, around = scoring.Trainer(network), network.windows(coded)
    squares = [np.full(t.shape, 1e-2) for t in (plain.inner, *plain.contexts)]
    room = []
    for a in range(0, len(target), scoring.STEP_WORDS):
        some, near = target[a : a + scoring.STEP_WORDS], around[:, a : a + scoring.STEP_WORDS]
        plain_step(plain, squares, some, near)
        tracemalloc.start()
        trainer.step(some, near)
        room.append(tracemalloc.get_traced_memory()[1] / words.lengths.take(some).sum(dtype=int))
        tracemalloc.stop()
    assert len(room) > 5 and np.abs(trainer.tables[-1] - plain.inner).max() < 1e-3
    assert all(np.abs(a - b).max() < 1e-3 for a, b in zip(trainer.tables, plain.contexts))
    assert [s.sum() for s in trainer.seen] == [len(target)] * 4 + [words.lengths.take(target).sum(dtype=int)]
    assert max(room) < 130  # bytes a turn
