"""Token groups and links beside a plain loop over whole texts, and awkward inputs."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridloom.llm import alignment
from gridloom.llm.queries import op13_pointer_alignment

DIR = "/root/testdata/sf0.001"
PAIR = alignment.TokenizerFiles().pair()


def plain(text):
    """Groups, links and digest of one text, whole, byte by byte; None without tokens."""
    if not text:
        return None
    raw = (" " + text).encode()
    a, b = PAIR.a.encode(" " + text, add_special_tokens=False).ids, PAIR.b.encode(text)
    if b"".join(PAIR.a_bytes[i] for i in a) != raw or b"".join(PAIR.b_bytes[i] for i in b) != raw:
        return None
    owners = []
    for ids, own in ((a, PAIR.a_bytes), (b, PAIR.b_bytes)):
        owners.append([k for k, i in enumerate(ids) for _ in own[i]])
    links = list(dict.fromkeys(zip(*owners)))
    groups, left, right = [], [], []
    for p in range(len(raw)):
        ends = [p + 1 == len(raw) or o[p + 1] != o[p] for o in owners]
        if ends[0]:
            left.append(a[owners[0][p]])
        if ends[1]:
            right.append(b[owners[1][p]])
        if all(ends):
            groups.append((left, right))
            left, right = [], []
    said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
    return len(a), len(b), len(groups), [(a[i], b[j]) for i, j in links], hashlib.sha256(said.encode()).hexdigest(), groups


def plain_report(rows):
    found = [(d, plain(t)) for d, t in rows]
    held = Counter(p for _, x in found if x for p in set(x[3]))
    top = defaultdict(int)
    for (i, _), n in held.items():
        top[i] = max(top[i], n)
    return Counter((d, 0, 0, 0, 0, 0, 0, "") if x is None else (d, x[0], x[1], x[2], len(x[3]), sum(held[p] == top[p[0]] for p in x[3]), sum(held[p] for p in x[3]), x[4]) for d, x in found)


def told(df):
    return Counter(tuple(r) for r in df.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect())


def test_query_like_plain_loop(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    assert told(op13_pointer_alignment(spark, DIR)) == plain_report([tuple(r) for r in docs.select("doc_id", "text").collect()])


AWKWARD = [None, "", " ", "  ", "a  b", " x ", "a\n b\t c", "<|endoftext|> <s> </s> <unk>", "▁ ▁a", "café 你好 \U0001f600 é", "  　x", "don't we'll  I'm", "x" * 3000, "one two " * 2000, "\x00\x1f \x85", "it's\r\n ok", "﻿a b", "᠎ a", "a ᠎ b"]


def test_awkward_texts(spark):
    rows = [(i, t) for i, t in enumerate(AWKWARD)] + [(None, "a b"), (3, "two texts"), (3, "two texts")]
    df = spark.createDataFrame([(*r, "n", 1) for r in rows], "doc_id long, text string, pair string, n_a int").repartition(3)
    assert told(alignment.alignment_report(df)) == plain_report(rows)
    assert alignment.alignment_report(df.limit(0)).count() == 0 and alignment.aligned_groups(df.limit(0)).count() == 0
    nothing = df.withColumn("text", F.lit(None).cast("string"))
    assert told(alignment.alignment_report(nothing)) == plain_report([(d, None) for d, _ in rows])
    groups = alignment.aligned_groups(df.where("doc_id = 9")).orderBy("group").collect()
    assert [(r["a_ids"], r["b_ids"]) for r in groups] == plain(AWKWARD[9])[5]
    assert groups[0]["first"] == 0 and groups[-1]["last"] == len((" " + AWKWARD[9]).encode()) and all(x["last"] == y["first"] for x, y in zip(groups, groups[1:]))


def test_same_result_for_any_chunks(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").where("doc_id < 60")
    assert told(alignment.alignment_report(docs.repartition(1))) == told(alignment.alignment_report(docs.repartition(17)))


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" \n\t'ab.1é▁ "), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_cut_texts_like_whole_ones(text):
    want = plain(text)
    got = alignment.align_batch(PAIR, alignment.Spelling(50300), [text.encode()])[0]
    if want is None:
        assert got.n_a == got.n_links == 0 and got.digest == ""
    else:
        assert (got.n_a, got.n_b, got.n_groups, got.n_links, got.digest) == (*want[:3], len(want[3]), want[4])


def test_pointers_reach_the_terminal_token():
    rng = np.random.default_rng(0)
    for _ in range(50):
        n = int(rng.integers(1, 200))
        ends = [np.append(np.flatnonzero(rng.random(n) < p) + 1, n + 1) for p in (0.1, 0.5)]
        last = alignment.terminal_tokens(*ends)
        common = np.intersect1d(*ends)
        at = np.searchsorted(common, np.concatenate(ends))
        assert (np.concatenate(ends)[last] == common[at]).all()


@pytest.mark.parametrize("n", [0, 1, 5])
def test_packed_numbers(n):
    x, y = np.arange(n) * 70000, np.arange(n) + 1
    a, b = alignment._unpacked(alignment._packed(x, y), n)
    assert (a == x).all() and (b == y).all()
