"""Contamination marks against a plain scan of all windows."""

import hashlib
import random
import re
from collections import Counter

from gridloom.llm import decontaminate


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(doc, bench):
    w, hit, names = words(doc), set(), set()
    for name, text in bench:
        b = words(text)
        n = min(13, len(b))
        for i in range(len(b) - n + 1) if n else ():
            for p in range(len(w) - n + 1):
                if w[p : p + n] == b[i : i + n]:
                    hit |= set(range(p, p + n))
                    if name is not None:
                        names.add(str(name))
    return len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


def cases():
    rng = random.Random(4)
    vocabulary = [f"W{i}é" if i % 5 == 0 else f"w{i}" for i in range(60)]
    line = lambda n: " ".join(rng.choices(vocabulary, k=n))
    bench = [(i, line(rng.choice([20, 40, 14]))) for i in range(12)] + [(20, "Short, item! here"), (21, ""), (22, None), (23, "..."), (None, line(15)), (2, "again another text for item two"), (10, "Short, item! here")]
    docs = []
    for i in range(60):
        text = line(rng.randrange(0, 80))
        if i % 3 == 0:
            text += " " + rng.choice([t for _, t in bench if t]).upper() + "; " + line(5)
        docs.append((i, text))
    docs += [(100, None), (101, ""), (102, "short ITEM-here"), (103, bench[0][1] + " pad" * 3000), (104, bench[0][1]), (104, bench[0][1]), (None, bench[1][1]), (105, "x\x00short\x7fitem\x80here")]
    return docs, bench


def test_marks_match_brute_force(spark):
    docs, bench = cases()
    d = spark.createDataFrame([(i, t, 1.5) for i, t in docs], "doc_id long, text string, n_hit double").repartition(3)
    b = spark.createDataFrame(bench, "item_id long, text string")
    want = Counter((i, *brute(t, bench)) for i, t in docs)
    assert Counter(map(tuple, decontaminate.contamination_report(d, b).collect())) == want
    blocks = decontaminate.mark_contamination(d.select("doc_id", "text"), b, block_bytes=300)
    got = Counter((r["doc_id"], r["n_words"], r["n_hit"], len(r["items"]), hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), r["contaminated"]) for r in blocks.collect())
    assert got == want
    clean = decontaminate.remove_contaminated(d, b)
    assert clean.columns == d.columns
    assert Counter((r["doc_id"], r["text"], r["n_hit"]) for r in clean.collect()) == Counter((i, t, 1.5) for i, t in docs if not brute(t, bench)[4])
    cut = {(r["doc_id"], r["text"]) for r in decontaminate.remove_spans(d, b).collect()}
    assert (104, "") in cut and (100, None) in cut and all(len(words(t)) <= 12 or brute(t, bench[:1])[1] == 0 for _, t in cut)
    assert decontaminate.contamination_report(d.limit(0), b).count() == 0
    assert all(not r["contaminated"] for r in decontaminate.contamination_report(d, b.limit(0)).collect())
