"""Golay keys, SimHash groups, cap filters, line windows and components against brute force."""

import random
from collections import Counter, defaultdict

import numpy as np
import xxhash

from gridloom.llm import capfilters, golay, linededup, simhash
from gridloom.llm.graph import components


def groups(nodes, links):
    """Smallest member of each node's component."""
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, x) for x in range(5001, 5200)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = groups({x for e in edges for x in e}, edges)
    assert got == {n: r for n, r in want.items() if any(n in e and e[0] != e[1] for e in edges)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_golay_code_is_perfect_and_keys_meet():
    patterns = golay.error_patterns()
    assert (patterns[:, 0] != 0).sum() == 2047 and sum(bin(x).count("1") == 3 for x in patterns[:, 0]) == 1771
    assert all(((r[1:] != 0).sum() == golay.FARTHER) == (bin(r[0]).count("1") == 3) for r in patterns)
    base = np.random.default_rng(1).integers(0, 1 << 23, 3000)
    flips = [1 << i for i in range(23)] + [1 << i | 1 << j for i in range(23) for j in range(i)]
    mine, counts = golay.near_codewords(base)
    for flip in flips:
        other, also = golay.near_codewords(base ^ flip)
        both = (mine[:, :, None] == other[:, None, :]) & counts[:, :, None] & also[:, None, :]
        assert both.any(axis=(1, 2)).all()


def slow_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near(fp, rng, bits):
    for b in rng.sample(range(64), bits):
        fp ^= 1 << b
    return fp


def test_fingerprints_and_groups(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(rng.choices(words, k=rng.randrange(1, 60))) for _ in range(150)]
    texts += [t + " Extra" for t in texts[:60]] + texts[:30] + [None, "", " \n", "ONE", "one", "One two", "é à b c", "\xa0nbsp in word", "x " * 40000]
    rows = [(i, t, "dup") for i, t in enumerate(texts)] + [(3, texts[3], "dup"), (None, texts[5], "dup"), (None, "alone without id", "dup"), (3, "same id other text", "dup")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string").repartition(4)
    fps = {(d, t): slow_fingerprint(t) for d, t, _ in rows}
    distinct = sorted(set(fps.values()))
    links = [(a, b) for i, a in enumerate(distinct) for b in distinct[:i] if bin(a ^ b).count("1") <= 2]
    roots = groups(distinct, links)
    least = {}
    for (d, t), f in fps.items():
        if d is not None:
            least[roots[f]] = min(d, least.get(roots[f], d))
    want = Counter((d, f"{fps[d, t]:016x}", least.get(roots[fps[d, t]])) for d, t, _ in rows)
    assert Counter(map(tuple, simhash.duplicates_report(df).collect())) == want
    kept = simhash.keep_one(df).collect()
    assert len(kept) == len(set(roots[fps[d, t]] for d, t, _ in rows)) and simhash.keep_one(df).columns == df.columns
    assert simhash.duplicates_report(df.limit(0)).count() == 0 and simhash.keep_one(df.limit(0)).count() == 0


def test_near_links_connect_what_all_pairs_do(spark):
    rng = random.Random(5)
    fps = {rng.getrandbits(64) for _ in range(300)}
    for centre in list(fps)[:25]:
        fps |= {near(centre, rng, rng.randrange(1, 4)) for _ in range(rng.choice([2, 5, 60]))}
    signed = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    links = [(a, b) for i, a in enumerate(signed) for b in signed[:i] if bin((a ^ b) & (2**64 - 1)).count("1") <= 2]
    want = groups(signed, links)
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    for size in (0, 16, 10**6):
        edges = [tuple(r) for r in simhash.near_links(df, size).collect()]
        assert all(bin((a ^ b) & (2**64 - 1)).count("1") <= 2 for a, b in edges)
        assert groups(signed, edges) == want


def brute_lines(rows):
    order = sorted({(d is not None, d or 0, t) for d, t in rows if t is not None})
    seen, gone = set(), defaultdict(set)
    for key in order:
        lines = key[2].split("\n")
        if not key[2]:
            continue
        spots = [(i, min(3, len(lines))) for i in range(max(1, len(lines) - 2))]
        spots += [(i, 1) for i, x in enumerate(lines) if len(x.split()) > 50 and len(lines) > 1]
        for i, n in spots:
            window = tuple(lines[i : i + n])
            if window in seen:
                gone[key] |= set(range(i, i + n))
            seen.add(window)
    out = []
    for d, t in rows:
        lines = [] if t is None else t.split("\n")
        cut = gone[(d is not None, d or 0, t)] if t is not None else set()
        out.append((d, len(lines), len(cut), None if t is None else "\n".join(x for i, x in enumerate(lines) if i not in cut)))
    return Counter(out)


def test_line_windows(spark):
    common = "license a\nlicense b\nlicense c\nlicense d"
    rows = [(i, f"own {i}\n{common}\nend {i}") for i in range(20)] + [(30, "x\ny"), (31, "x\ny"), (32, ""), (33, None), (34, "a\nb\nc\na\nb\nc\nq"), (35, "\n" * 50), (36, "a\nb\nc"), (37, "r\n" * 3000)]
    passage, short = " ".join(f"p{i}" for i in range(51)), " ".join(f"q{i}" for i in range(50))
    rows += [(50, f"{passage}\nz"), (51, f"k\nl\n{passage}\nm"), (52, passage), (53, passage), (54, f"n\n{short}\no\np"), (55, f"q\n{short}\ns\nt"), (56, ""), (57, f"{passage}\nz"), (58, "\n"), (59, "\n")]
    spread = sorted(brute_lines(rows).items(), key=str)
    df = spark.createDataFrame([(d, t, "old", 5) for d, t in rows], "doc_id long, text string, n_lines string, other int").repartition(3)
    got = Counter((r["doc_id"], r["n_lines"], r["n_removed"], r["text"]) for r in linededup.dedup_lines(df).collect())
    assert sorted(got.items(), key=str) == spread
    left = {r["doc_id"]: r["text"] for r in linededup.dedup_lines(df).filter("doc_id BETWEEN 50 AND 57").collect()}
    assert left[51] == "k\nl\nm" and left[52] == left[53] == left[57] == "" and short in left[55] and passage in left[50]
    twice = [(40, "a\nb\nc\nd"), (40, "a\nb\nc\nd"), (None, "a\nb\nc"), (None, None)]
    got = Counter(tuple(r) for r in linededup.dedup_lines(spark.createDataFrame(twice, "doc_id long, text string")).select("doc_id", "n_lines", "n_removed", "text").collect())
    assert got == Counter({(None, 3, 0, "a\nb\nc"): 1, (None, 0, 0, None): 1, (40, 4, 3, "d"): 2})
    assert linededup.dedup_lines(df.limit(0)).count() == 0


def test_cap_filters_on_awkward_vectors(spark):
    rng = np.random.default_rng(2)
    rows, vid = [], 0
    for label in (1, 2):
        for _ in range(60):
            centre = rng.standard_normal(16)
            for _ in range(rng.choice([1, 2, 30], p=[0.7, 0.25, 0.05])):
                rows.append((vid, [float(np.float32(x)) for x in centre + rng.standard_normal(16) * 0.06], label))
                vid += 1
    rows += [(900 + i, rows[0][1], 1) for i in range(9)] + [(950, rows[0][1], 2), (951, rows[0][1], None), (952, None, 1), (953, [0.0] * 16, 1), (954, [float("nan")] + [1.0] * 15, 1), (955, [None] + [1.0] * 15, 1), (None, rows[0][1], 1), (956, [float("inf")] + [1.0] * 15, 1), (957, [1.0, 2.0], 1), (958, [2.0, 4.0], 1), (959, [], 1), (0, rows[5][1], 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    ok = [i for i, (v, e, l) in enumerate(rows) if v is not None and l is not None and e and all(x is not None and np.isfinite(x) for x in e) and any(e)]
    unit = {i: np.array(rows[i][1], float) / np.linalg.norm(rows[i][1]) for i in ok}
    links = [(i, j) for i in ok for j in ok if j < i and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]) and unit[i] @ unit[j] >= 0.98]
    roots, n = groups(range(len(rows)), links), Counter(x for e in links for x in e)
    least = {}
    for i in ok:
        least[roots[i]] = min(rows[i][0], least.get(roots[i], rows[i][0]))
    want = Counter()
    for i, (v, _, _) in enumerate(rows):
        c = least[roots[i]] if i in unit else v
        want[(v, n[i], c, v is not None and v == c)] += 1
    code = capfilters.ProductCode(blocks=2, each=16, listed=12)
    for block in (512, 7):
        got = Counter(map(tuple, capfilters.link_vectors(df, code=code, block=block).collect()))
        assert sum((got & want).values()) >= 0.98 * len(rows) and sum(r[1] * k for r, k in got.items()) >= 0.95 * 2 * len(links)
    assert capfilters.link_vectors(df.limit(0)).count() == 0


def test_list_decoding_finds_all_filters_over_the_threshold():
    code = capfilters.ProductCode(blocks=3, each=8, listed=6, least=1)
    unit = capfilters.unit_rows(np.random.default_rng(1).standard_normal((50, 24)).tolist())
    rotation, codes, threshold = code.arrays(24)
    turned = unit @ rotation
    parts = [turned[:, 8 * k : 8 * k + 8] @ c.T for k, c in enumerate(codes)]
    full = (parts[0][:, :, None, None] + parts[1][:, None, :, None] + parts[2][:, None, None, :]).reshape(50, -1)
    got = set(zip(*(x.tolist() for x in code.decode(unit))))
    want = set(zip(*(x.tolist() for x in np.nonzero(full >= threshold))))
    alone = {i for i in range(50) if not (full[i] >= threshold).any()}
    assert want <= got and {r for r, _ in got - want} == alone


def test_recall_of_production_code_at_the_limit():
    rng = np.random.default_rng(9)
    a = capfilters.unit_rows(rng.standard_normal((4000, 64)).tolist())
    b = rng.standard_normal((4000, 64))
    b -= (b * a).sum(axis=1, keepdims=True) * a
    b = 0.98 * a + np.sqrt(1 - 0.98**2) * b / np.linalg.norm(b, axis=1, keepdims=True)
    lists = [defaultdict(set), defaultdict(set)]
    for held, x in zip(lists, (a, b)):
        for row, name in zip(*capfilters.ProductCode().decode(x)):
            held[row].add(name)
    assert np.mean([bool(lists[0][i] & lists[1][i]) for i in range(4000)]) > 0.995
