"""Chat formatting, sharding and mixing against plain Python."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import pytest

from gridloom.llm import chat, mixing, sharding

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, shard int, n_words double"
AWKWARD = [
    (1, "a b c", "en", "s1", 5, "x", 0, 0.5),
    (1, "a b c", "en", "s1", 5, "x", 0, 0.5),
    (1, "other text", "en", "s1", 10, None, None, None),
    (2, None, None, None, None, "y", 1, 1.0),
    (3, "", "fr", "s2", 0, "z", 2, 2.0),
    (None, "no id here", "de", "s2", 10, "w", 3, 3.0),
    (None, None, None, None, None, None, None, None),
    (4, "lang " * 30000, "en", "s1", 150000, "v", 4, 4.0),
    (-5, "\t \n", "es", None, 3, "u", 5, 5.0),
    *[(10 + i, f"word{i} tail é", "fr", "s3", 8, "t", 6, 6.0) for i in range(40)],
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(AWKWARD, DOCS).repartition(3)


def jump(key, n):
    """The published loop."""
    key, b, j = key % 2**64, -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = math.floor((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_is_the_published_function(spark):
    keys = [0, 1, 2, 3, 7, 255, 10**12, -1, -(2**63), 2**63 - 1, *range(1000, 3000)]
    for shards in (1, 2, 16, 100):
        df = spark.createDataFrame([(k,) for k in keys], "k long").select("k", sharding.jump(sharding.F.col("k"), shards).alias("j"))
        for r in df.collect():
            assert (r["j"]["shard"], r["j"]["grown"]) == (jump(r["k"], shards), jump(r["k"], shards + 1))


def test_shards_of_awkward_rows(docs):
    rows = sharding.assign_shards(docs, 16).collect()
    assert len(rows) == len(AWKWARD)
    want = Counter((d, (0 if t is None else len(t.encode())) + 1, None if t is None else zlib.crc32(t.encode()), jump(d or 0, 16), jump(d or 0, 17)) for d, t, *_ in AWKWARD)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["grown_shard"]) for r in rows) == want
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        assert r["law"] == "key" and r["grown_shard"] in (r["shard"], 16)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.assign_shards(docs.limit(0), 16).count() == 0


def test_shards_of_text_keys_and_of_one_key_with_many_texts(spark):
    named = spark.createDataFrame([(f"k{i % 40}" if i % 9 else None, f"text {i}") for i in range(400)], "doc_id string, text string")
    rows = sharding.assign_shards(named, 16).collect()
    by_shard, by_key = {}, {}
    for r in rows:
        by_shard.setdefault(r["shard"], []).append(r["slot"])
        by_key.setdefault(r["doc_id"], set()).add((r["shard"], r["grown_shard"]))
    assert len(rows) == 400 and all(sorted(x) == list(range(len(x))) for x in by_shard.values()) and len(by_shard) > 8
    assert all(len(x) == 1 and all(g in (s, 16) for s, g in x) for x in by_key.values())
    one = spark.range(3000).selectExpr("CAST(7 AS LONG) AS doc_id", "concat('t', id) AS text")
    assert sorted(r["slot"] for r in sharding.assign_shards(one, 16).collect()) == list(range(3000))


def targets(sizes, cap=3.0):
    """Share by weight, stop at the cap, share the excess again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        level = (total - sum(fixed.values())) / sum(weight[s] for s in free) if free else 0
        over = [s for s in free if weight[s] * level > cap * sizes[s]]
        if not over:
            return fixed | {s: weight[s] * level for s in free}
        fixed |= {s: cap * sizes[s] for s in over}


def test_mix_takes_the_exact_budgets(docs):
    rows = mixing.mix_report(docs).collect()
    assert len(rows) == len(AWKWARD)
    sizes, taken = Counter(), Counter()
    for d, t, _, s, *_ in AWKWARD:
        sizes[s] += len((t or "").split())
    want = targets(sizes)
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    assert {s: taken[s] for s in sizes} == {s: math.floor(want[s] + 0.5) for s in sizes}
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix_report(docs.repartition(5)).collect()))
    assert mixing.mix_report(docs.limit(0)).count() == 0


def test_mixed_documents_hold_the_taken_words(docs):
    out = mixing.mix_documents(docs)
    assert out.columns == docs.columns
    words = Counter()
    for r in out.collect():
        words[r["source"]] += len((r["text"] or "").split())
    sizes = Counter()
    for _, t, _, s, *_ in AWKWARD:
        sizes[s] += len((t or "").split())
    assert {s: words[s] for s in sizes} == {s: math.floor(v + 0.5) for s, v in targets(sizes).items()}
    assert mixing.mix_documents(docs.limit(0)).count() == 0


def test_one_source_with_all_rows_is_taken_once(spark):
    df = spark.createDataFrame([(i % 7, "x y z", "only") for i in range(50)], "doc_id long, text string, source string")
    assert [r["taken"] for r in mixing.mix_report(df).collect()] == [3] * 50


def rendered(turns):
    return "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in turns)


def plain(chosen, rejected):
    fill = lambda x: [((t or (None, None))[0] or "unknown", (t or (None, None))[1] or "") for t in x or []]
    a, b = fill(chosen), fill(rejected)
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n, rendered(a[:n]), rendered(a[n:]), rendered(b[n:])


def test_preferences_share_their_prefix_once(spark):
    u, v, w, e = ("user", "hi"), ("assistant", "yes é"), ("assistant", "no"), ("system", "")
    cases = [([u, v], [u, w]), ([e, u, v, u, w], [e, u, v, u, v]), ([u], [u, v]), ([u, v], [u, v]), ([], [v]), (None, None), ([u, (None, None)], [u, (None, "x")]), ([v], [w]), ([u] * 500 + [v], [u] * 500 + [w])]
    kind = "array<struct<role:string,text:string>>"
    df = spark.createDataFrame([(i, a, b, "old", 9) for i, (a, b) in enumerate(cases)], f"id int, chosen {kind}, rejected {kind}, prompt string, extra int")
    out = {r["id"]: r for r in chat.format_preferences(df).collect()}
    for i, (a, b) in enumerate(cases):
        r = out[i]
        assert (r["n_prompt_turns"], r["prompt"], r["chosen"], r["rejected"]) == plain(a, b) and r["extra"] == 9
        for side, text in (("chosen", r["chosen"]), ("rejected", r["rejected"])):
            for s in r[f"{side}_spans"]:
                assert text[: s["start"]].endswith("assistant\n") and text[s["start"] : s["stop"]].endswith("<|im_end|>")
            assert len(r[f"{side}_spans"]) == text.count("<|im_start|>assistant")
    assert chat.format_preferences(df.limit(0)).count() == 0


def test_swapped_replies_of_awkward_conversations(spark):
    rows = [(0, 0, "user", "q"), (0, 1, "assistant", "a0"), (1, 1, "assistant", "a1"), (1, 0, "user", "p"), (2, 0, "user", "only"), (4, None, None, None), (4, 0, "assistant", None), (None, 0, "user", "n"), (6, 0, "assistant", "x"), (6, 0, "assistant", "x")]
    out = {r["conv_id"]: r for r in chat.swapped_replies(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert [t["text"] for t in out[0]["chosen"]] == ["q", "a0"] and [t["text"] for t in out[0]["rejected"]] == ["q", "a1"]
    assert out[2]["chosen"] == out[2]["rejected"] and len(out[4]["rejected"]) == 1 and len(out[6]["chosen"]) == 2 and None in out


def test_random_keys_are_md5(spark):
    got = spark.range(1).select(mixing.random_key(mixing.F.lit(12), 42)).first()[0]
    assert got == int(hashlib.md5(b"42:12").hexdigest()[:15], 16)
