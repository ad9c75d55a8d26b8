"""Queries of the anomaly, similarity and model part. Those without SQL are tested against brute force on small tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from gridloom.catalog.base import query
from gridloom.operators import automl, isolation, similar
from gridloom.session import ensure_checkpoint_dir


@query("isolation_forest_events", "STA-30")
def _(t):
    d = t.events.select("event_id", "value", "user_id", F.hour("ts").alias("hour"))
    return isolation.isolation_forest(d, "event_id", ["value", "user_id", "hour"])


@query("isolation_forest_summary", "STA-30")
def _(t):
    return isolation.anomaly_summary(isolation.isolation_forest(t.customer, "c_custkey", ["c_acctbal", "c_nationkey"]))


_NEAR = """WITH s AS (SELECT avg(c_acctbal) AS m1, stddev_pop(c_acctbal) AS s1, avg(c_nationkey) AS m2, stddev_pop(c_nationkey) AS s2 FROM customer),
z AS (SELECT c_custkey AS id, (c_acctbal - m1) / s1 AS a, (c_nationkey - m2) / s2 AS b FROM customer, s),
p AS (SELECT x.id AS i, y.id AS j, sqrt(pow(x.a - y.a, 2) + pow(x.b - y.b, 2)) AS d FROM z x JOIN z y ON x.id <> y.id),
t AS (SELECT greatest(0.05, quantile_cont(d, 0.05)) AS thr FROM (SELECT min(d) AS d FROM p GROUP BY i))
SELECT i AS first_id, arg_min(j, (d, j)) AS second_id, round(min(d), 4) AS distance FROM p, t WHERE d <= thr AND j > i GROUP BY i"""


@query("near_duplicate_rows", "STA-31", _NEAR)
def _(t):
    return similar.near_duplicate_rows(t.customer, "c_custkey", ["c_acctbal", "c_nationkey"])


@query("near_duplicate_embeddings", "STA-31", """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings),
m AS (SELECT i, avg(v[i]) AS m, stddev_pop(v[i]) AS s FROM e GROUP BY i), z AS (SELECT vec_id AS id, list((v[e.i] - m) / CASE WHEN s = 0 THEN 1 ELSE s END ORDER BY e.i) AS x FROM e JOIN m ON e.i = m.i GROUP BY vec_id),
p AS (SELECT a.id AS i, b.id AS j, list_distance(a.x, b.x) AS d FROM z a JOIN z b ON a.id <> b.id),
t AS (SELECT greatest(0.05, quantile_cont(d, 0.05)) AS thr FROM (SELECT min(d) AS d FROM p GROUP BY i))
SELECT i AS first_id, arg_min(j, (d, j)) AS second_id, round(min(d), 4) AS distance FROM p, t WHERE d <= thr AND j > i GROUP BY i""")
def _(t):
    return similar.near_duplicate_vectors(t.embeddings, "vec_id", "embedding")


@query("near_duplicate_explanation", "STA-31", f"""WITH n AS ({_NEAR})
SELECT first_id, second_id, 'c_acctbal' AS "column", 'numeric' AS kind, round(abs(a.c_acctbal - b.c_acctbal) / (abs(a.c_acctbal) + 1e-10) * 100, 1) AS pct_diff
FROM n JOIN customer a ON a.c_custkey = first_id JOIN customer b ON b.c_custkey = second_id WHERE a.c_acctbal <> b.c_acctbal
UNION ALL SELECT first_id, second_id, 'c_nationkey', 'numeric', round(abs(a.c_nationkey - b.c_nationkey) / (abs(a.c_nationkey) + 1e-10) * 100, 1) FROM n JOIN customer a ON a.c_custkey = first_id JOIN customer b ON b.c_custkey = second_id WHERE a.c_nationkey <> b.c_nationkey
UNION ALL SELECT first_id, second_id, 'c_mktsegment', 'text', NULL FROM n JOIN customer a ON a.c_custkey = first_id JOIN customer b ON b.c_custkey = second_id WHERE a.c_mktsegment <> b.c_mktsegment""")
def _(t):
    pairs = similar.near_duplicate_rows(t.customer, "c_custkey", ["c_acctbal", "c_nationkey"])
    return similar.explain_pairs(t.customer.drop("c_name"), pairs, "c_custkey").drop("value_a", "value_b")


def _similar_sql(source: str) -> str:
    """All pairs of distinct values; the longest common subsequence by rows of its table, each a fold over the other text."""
    return f"""v AS (SELECT name AS value, min(id) AS vid FROM ({source}) WHERE name IS NOT NULL GROUP BY name),
w AS (SELECT *, array_to_string(list_sort([x FOR x IN string_split_regex(trim(value), '\\s+') IF x <> '']), ' ') AS text FROM v),
c AS (SELECT a.vid AS a, b.vid AS b, a.value AS value_a, b.value AS value_b, a.text AS x, b.text AS y FROM w a JOIN w b ON a.vid < b.vid AND length(a.text) > 0
  AND least(length(a.text), length(b.text)) >= 0.739 * greatest(length(a.text), length(b.text))),
l AS (SELECT *, list_reduce([[x[i:i]] FOR i IN range(1, length(x) + 1)], lambda row, ch: list_reduce(range(1, length(y) + 1),
  lambda made, j: list_append(made, CAST(CASE WHEN y[j:j] = ch[1] THEN CAST(row[j] AS BIGINT) + 1 ELSE greatest(CAST(row[j + 1] AS BIGINT), CAST(made[-1] AS BIGINT)) END AS VARCHAR)), ['0']),
  [CAST(0 AS VARCHAR) FOR i IN range(0, length(y) + 1)]) AS last FROM c),
pairs AS (SELECT a, b, value_a, value_b, 200.0 * CAST(last[-1] AS BIGINT) / (length(x) + length(y)) AS score FROM l WHERE 200.0 * CAST(last[-1] AS BIGINT) / (length(x) + length(y)) >= 85)"""


def _groups_sql(source: str) -> str:
    """Values in order of first occurrence; each is a member of the earliest centre it is similar to, or a centre."""
    return f"""WITH RECURSIVE {_similar_sql(source)},
o AS (SELECT row_number() OVER (ORDER BY vid) AS k, vid, (SELECT list(a) FROM pairs WHERE b = vid) AS earlier FROM v),
g AS (SELECT CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS centres UNION ALL
  SELECT g.k + 1, CASE WHEN list_has_any(coalesce(earlier, []), centres) THEN centres ELSE list_append(centres, vid) END FROM g JOIN o ON o.k = g.k + 1),
z AS (SELECT centres FROM g ORDER BY k DESC LIMIT 1)
SELECT arg_min(value_a, a) AS canonical, value_b AS value, round(arg_min(score, a), 1) AS score FROM pairs, z WHERE list_contains(centres, a) AND NOT list_contains(centres, b) GROUP BY value_b"""


_PART_NAMES = "SELECT p_name AS name, CAST(p_partkey AS BIGINT) AS id FROM part"


@query("fuzzy_values_part_names", "STA-32", _groups_sql(_PART_NAMES))
def _(t):
    return similar.fuzzy_groups(t.part, "p_name", "p_partkey")


@query("fuzzy_pairs_part_names", "STA-32", f"WITH {_similar_sql(_PART_NAMES)} SELECT a, b, value_a, value_b, round(score, 1) AS score FROM pairs")
def _(t):
    return similar.similar_texts(t.part, "p_name", "p_partkey")


@query("problem_types", "ML-01", """
SELECT 'l_quantity' AS "column", count(l_quantity) AS n, count(DISTINCT l_quantity) AS n_unique, 'regression' AS problem_type FROM lineitem
UNION ALL SELECT 'l_linenumber', count(l_linenumber), count(DISTINCT l_linenumber), CASE WHEN count(DISTINCT l_linenumber) <= 15 THEN 'classification' ELSE 'regression' END FROM lineitem
UNION ALL SELECT 'l_returnflag', count(l_returnflag), count(DISTINCT l_returnflag), 'classification' FROM lineitem
UNION ALL SELECT 'l_tax', count(l_tax), count(DISTINCT l_tax), CASE WHEN count(DISTINCT l_tax) / count(*) > 0.05 OR count(DISTINCT l_tax) > 20 THEN 'regression' ELSE 'classification' END FROM lineitem
UNION ALL SELECT 'l_discount', count(l_discount), count(DISTINCT l_discount), 'regression' FROM lineitem""")
def _(t):
    return automl.problem_types(t.lineitem, ["l_quantity", "l_linenumber", "l_returnflag", "l_tax", "l_discount"])


def _labelled(t):
    return t.documents.join(t.labels, "doc_id").select(
        "doc_id", "quality", "lang", "source", "n_chars", F.length(F.regexp_replace("text", "[^.]", "")).alias("dots"),
        F.length(F.regexp_replace("text", "[0-9]", "")).alias("no_digits"), F.size(F.split("text", "\n")).alias("lines"))


@query("model_features_prepared", "ML-02")
def _(t):
    from pyspark.ml import Pipeline
    from pyspark.ml.functions import vector_to_array
    p = automl.prepare(_labelled(t), "doc_id", "quality")
    out = Pipeline(stages=automl.feature_stages(p.numeric, p.categorical)).fit(p.data).transform(p.data)
    return out.select("doc_id", "quality", F.transform(vector_to_array("features"), lambda x: F.round(x, 4)).alias("features"))


@query("model_leaderboard_classes", "ML-03")
def _(t):
    return automl.train_models(_labelled(t), "doc_id", "quality").leaderboard


@query("model_leaderboard_numbers", "ML-03")
def _(t):
    d = t.customer.join(t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("orders"), F.sum("o_totalprice").alias("spend_total")), F.col("c_custkey") == F.col("o_custkey"))
    return automl.train_models(d.select("c_custkey", "c_mktsegment", "c_acctbal", "c_nationkey", "orders", "spend_total"), "c_custkey", "spend_total").leaderboard


@query("model_permutation_importance", "ML-04")
def _(t):
    m = automl.train_models(_labelled(t), "doc_id", "quality", ["Logistic Regression"], folds=1)
    return automl.permutation_importance(m, "doc_id")


@query("model_confusion_matrix", "ML-05")
def _(t):
    return automl.confusion_matrix(automl.train_models(_labelled(t), "doc_id", "quality", ["Logistic Regression"], folds=1))


@query("model_batch_scoring", "ML-06")
def _(t):
    d = _labelled(t)
    m = automl.train_models(d, "doc_id", "quality", ["Logistic Regression"], folds=1)
    p = automl.prepare(d, "doc_id", "quality")
    path = f"{ensure_checkpoint_dir(t.spark).rstrip('/')}/model-{uuid.uuid4().hex}"
    automl.save_model(m.best, path)
    return automl.score_rows(automl.load_model(path), p.data, m.labels).select("doc_id", "predicted", "class_confidence")
