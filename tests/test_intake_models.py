"""Text layouts read from real files, the SQL guard, model training and scoring."""

import os
import re

import numpy as np
import pandas as pd
import pytest

from gridloom.operators import adhoc, automl, filters as flt, joins as jn
from gridloom.session import ensure_checkpoint_dir
from gridloom.sources import lines as ln, prepared as pr

FILES = {
    "flat.csv": 'id,name,value\n1,"Smith, J",10\n2,Lee,20\n', "pre.csv": "Quarterly figures\nSource: office\n\nregion;amount;year\nA;1;2020\nB;2;2021\nC;3;2022\n",
    "tab.csv": "date\tcount\n2024-01-01\t5\n2024-01-02\t6\nNotes: preliminary\n", "again.csv": "id|score\n1|5\nid|score\n2|6\n",
}


@pytest.fixture(scope="module")
def read(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("intake")
    for n, text in FILES.items():
        (root / n).write_text(text, encoding="utf-8")
    rows = ln.read_lines(spark, str(root))
    return rows, ln.intake_manifest(rows)


def test_manifest(read):
    m = {r["file"].rsplit("/", 1)[1]: r for r in read[1].collect()}
    assert [m[f]["delimiter"] for f in ("flat.csv", "pre.csv", "tab.csv", "again.csv")] == [",", ";", "\t", "|"]
    assert m["flat.csv"]["file_kind"] == "flat_table" and m["pre.csv"]["header_row"] == 3 and m["pre.csv"]["file_kind"] == "preamble_csv"
    assert m["tab.csv"]["footer_row"] == 3 and m["pre.csv"]["n_columns"] == 3


def test_tables(read):
    t = {k[1].split(k[0])[0] + k[0]: d for k, d in ln.load_tables(*read).items()}
    assert [r["name"] for r in t["id,"].orderBy("id").collect()] == ["Smith, J", "Lee"]
    assert t["region;"].count() == 3 and t["date\t"].count() == 2 and t["id|"].count() == 2


def test_encodings(spark):
    rows = [("a", "é".encode("utf-8")), ("b", "é".encode("latin-1")), ("c", b"\xef\xbb\xbfx")]
    got = {r["f"]: r["encoding"] for r in ln.encodings(spark.createDataFrame(rows, "f string, content binary")).collect()}
    assert got == {"a": "utf-8", "b": "latin-1", "c": "utf-8-sig"}


def test_content_hash_ignores_order(spark):
    df = spark.range(50)
    assert pr.content_hash(df) == pr.content_hash(df.orderBy("id", ascending=False)) != pr.content_hash(spark.range(51))


@pytest.mark.parametrize("sql", ["", "DROP TABLE data", "SELECT 1; SELECT 2", "-- x", "WITH a AS (SELECT 1) INSERT INTO t SELECT 1"])
def test_statements_refused(sql):
    with pytest.raises(ValueError):
        adhoc.check_statement(sql)


def test_sql_cap(spark):
    out = adhoc.fetch_sql(spark.range(600), "SELECT id FROM data ORDER BY id")
    assert len(out["rows"]) == 500 and out["truncated"]


def test_null_keys_match(spark):
    l = spark.createDataFrame([(1, "x"), (None, "y")], "k int, v string")
    r = spark.createDataFrame([(None, "p"), (2, "q")], "k int, v string")
    assert {(x["k"], x["v_left"], x["v_right"]) for x in jn.join_tables(l, r, "k", "k", "outer").collect()} == {(1, "x", None), (None, "y", "p"), (2, None, "q")}


def test_deep_page_equals_shallow(spark, monkeypatch):
    df = spark.createDataFrame([(i, float(i % 7)) for i in range(100)], "id int, v double")
    want = flt.page(df, "v", "id", 3, 20).toPandas()
    monkeypatch.setattr(flt, "DEEP_PAGE_ROWS", 10)
    got = flt.page(df, "v", "id", 3, 20).toPandas()
    assert sorted(got.id) == sorted(want.id)


def test_formula_names_are_checked(spark):
    with pytest.raises(ValueError):
        flt.derive(spark.range(3), "x", "reflect('java.lang.System', 'exit')")


def test_regression_models(spark, tmp_path):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 2))
    pdf = pd.DataFrame({"id": range(300), "x1": x[:, 0], "x2": x[:, 1], "kind": ["a", "b", "c"] * 100, "target_total": 3 * x[:, 0] - 2 * x[:, 1] + rng.normal(0, 0.1, 300)})
    df = spark.createDataFrame(pdf)
    m = automl.train_models(df, "id", "target_total", ["Linear Regression"], folds=1)
    assert m.problem == "regression" and m.leaderboard.first()["r2"] > 0.98
    automl.save_model(m.best, str(tmp_path / "m"))
    p = automl.prepare(df, "id", "target_total")
    assert automl.score_rows(automl.load_model(str(tmp_path / "m")), p.data).count() == 300
    imp = automl.permutation_importance(m, "id", repeats=1).collect()
    assert imp[0]["feature"] == "x1"


def test_classes_with_confidence(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=400)
    df = spark.createDataFrame(pd.DataFrame({"id": range(400), "x": x, "y": np.where(x > 0, "up", "down")}))
    m = automl.train_models(df, "id", "y", ["Logistic Regression"], folds=1)
    assert m.labels == ["down", "up"] and m.leaderboard.first()["accuracy"] > 0.95
    assert automl.confusion_matrix(m).groupBy().sum("n").first()[0] == m.test.count()
    assert automl.prediction_sample(m, "id").count() == 20


def test_time_limit(spark):
    with pytest.raises(Exception):
        adhoc.fetch_sql(spark.range(0, 20_000_000_000, 1, 64), "SELECT sum(sin(id) * cos(id)) AS n FROM data", seconds=2)


def test_quoted_line_breaks_and_encodings(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes('id,note\n1,"two\nlines, ""quoted"""\n2,5" pipe\n3,"a\n\nb"\n4,plain\n'.encode())
    (tmp_path / "b.csv").write_bytes("id,note\n1,café\n2,\"naïve\nword\"\n".encode("latin-1"))
    (tmp_path / "c.csv").write_bytes('id,note\n1,x\n2,"never closed\n3,y\n'.encode())
    rows = ln.read_lines(spark, str(tmp_path))
    got = {}
    for r in rows.collect():
        got.setdefault(r["file"][-5:], {})[r["line_no"]] = r["line"]
    assert got["a.csv"] == {0: "id,note", 1: '1,"two\nlines, ""quoted"""', 2: '2,5" pipe', 3: '3,"a\n\nb"', 4: "4,plain"}
    assert got["b.csv"] == {0: "id,note", 1: "1,café", 2: '2,"naïve\nword"'}
    assert got["c.csv"] == {0: "id,note", 1: "1,x", 2: '2,"never closed', 3: "3,y"}
    rows = rows.where("file NOT LIKE '%c.csv'")
    cells = {(r["file"][-5:], r["cells"]["id"]): r["cells"]["note"] for r in ln.table_records(rows, ln.intake_manifest(rows)).collect()}
    assert cells == {("a.csv", "1"): 'two\nlines, "quoted"', ("a.csv", "2"): '5" pipe', ("a.csv", "3"): "a\n\nb", ("a.csv", "4"): "plain",
                     ("b.csv", "1"): "café", ("b.csv", "2"): "naïve\nword"}


def test_long_quoted_cells_do_not_recurse(spark):
    line = '1,"' + 'word, ""x"" ' * 50_000 + '",end'
    d = spark.createDataFrame([(line, ",")], "line string, delimiter string")
    got = d.select(ln.cells().alias("c")).first()["c"]
    assert len(got) == 3 and got[2] == "end" and got[1].count('"x"') == 50_000


def _plain_records(lines):
    """Line by line: the state at the end of each, then the records; a quote open at the end of the file opens nothing."""
    quoted, start = r'"[^"]*+(?:""[^"]*+)*+"', r"(^|[,\t;|])\s*+"
    left_open = lambda t: bool(re.search(start + r'"[^"]*+(?:""[^"]*+)*+\Z', re.sub(start + quoted + r"(?=\s*+(?:[,\t;|]|\Z))", r"\1", t)))
    inside, records, opened = False, [], None
    for i, line in enumerate(lines):
        if not inside:
            records.append([line])
            opened = i
        else:
            records[-1].append(line)
        if inside:
            closes = re.match(r'[^"]*+(?:""[^"]*+)*+"', line)
            inside = left_open(line[closes.end() :]) if closes else True
        else:
            inside = left_open(line)
    if inside:
        records = records[:-1] + [[line] for line in lines[opened:]]
    return ["\n".join(r) for r in records]


@pytest.mark.parametrize("size", [7, 40, 300, 100_000])
def test_records_reach_over_blocks_of_any_size(spark, tmp_path, size):
    rng, files = np.random.default_rng(size), {}
    words = ['a', 'b,c', '"', '""', '"x', 'y"', '"q,r"', ',"', '",', ' ', 'é', '"long\nand', 'longer"', "\n"]
    for i in range(12):
        text = "".join(rng.choice(words, p=[0.2, 0.1, 0.03, 0.03, 0.03, 0.03, 0.1, 0.05, 0.05, 0.1, 0.05, 0.03, 0.03, 0.17]) for _ in range(int(rng.integers(1, 120)))) + "\n"
        files[f"f{i:02d}.csv"] = text
        (tmp_path / f"f{i:02d}.csv").write_text(text, encoding="utf-8")
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k, v in zip(before, (str(size), "1")):
            spark.conf.set(k, v)
        rows = ln.read_lines(spark, str(tmp_path))
        for k, v in before.items():  # the blocks stay as they are
            spark.conf.set(k, v)
        got = {}
        for r in rows.collect():
            assert got.setdefault(r["file"][-7:], {}).setdefault(r["line_no"], r["line"]) is r["line"]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == {n: dict(enumerate(_plain_records(t[:-1].split("\n")))) for n, t in files.items()}


def test_no_text_of_a_table_is_kept(spark, tmp_path):
    rows = [(i, f"two lines {i}\nof text, " + np.random.default_rng(i).bytes(10_000).hex()) for i in range(300)]
    pr.write_csv(spark.createDataFrame(rows, "id long, text string").repartition(4, "id"), str(tmp_path / "csv"))
    kept = lambda: sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(spark.sparkContext.getCheckpointDir().removeprefix("file:")) for f in names)
    ensure_checkpoint_dir(spark)
    before = kept()
    lines = ln.read_lines(spark, str(tmp_path / "csv"))
    got = ln.table_records(lines, ln.intake_manifest(lines)).select("cells").collect()
    assert sorted((int(r["cells"]["id"]), r["cells"]["text"]) for r in got) == rows and kept() - before < 2_000_000
