"""Queries of the cleaning part. Messy inputs are derived from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.catalog.base import query
from gridloom.functions.patterns import FALSE_WORDS, PLACEHOLDERS, TRUE_WORDS
from gridloom.operators import cleaning as cl, impute
from gridloom.plans.clean import clean_dataset

_LIST = lambda xs: ", ".join("'" + x + "'" for x in xs)

# orders with a placeholder priority, money and percent texts, dates in two formats, mixed booleans, shouting status words
_MESSY = """messy AS (SELECT o_orderkey AS row_id, CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN ' N/A ' WHEN o_orderpriority = '5-LOW' THEN '?' ELSE o_orderpriority END AS priority,
  format('${:,.2f}', o_totalprice) AS price_text, (o_custkey % 100)::VARCHAR || '%' AS share_text, (o_custkey)::VARCHAR AS number_text,
  CASE WHEN o_orderstatus = 'F' THEN strftime(o_orderdate, '%Y-%m-%d') ELSE strftime(o_orderdate, '%d.%m.%Y') END AS day_text,
  CASE o_orderstatus WHEN 'F' THEN ' Yes' WHEN 'O' THEN 'no' ELSE 'TRUE' END AS flag, CASE o_orderstatus WHEN 'F' THEN 'DONE WELL' WHEN 'O' THEN 'OPEN' ELSE 'Part' END AS word FROM orders)"""


def _messy(t):
    s = F.col("o_orderstatus")
    return t.orders.select(
        F.col("o_orderkey").alias("row_id"),
        F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", " N/A ").when(F.col("o_orderpriority") == "5-LOW", "?").otherwise(F.col("o_orderpriority")).alias("priority"),
        F.concat(F.lit("$"), F.format_number("o_totalprice", 2)).alias("price_text"),
        F.concat((F.col("o_custkey") % 100).cast("string"), F.lit("%")).alias("share_text"), F.col("o_custkey").cast("string").alias("number_text"),
        F.when(s == "F", F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.date_format("o_orderdate", "dd.MM.yyyy")).alias("day_text"),
        F.when(s == "F", " Yes").when(s == "O", "no").otherwise("TRUE").alias("flag"),
        F.when(s == "F", "DONE WELL").when(s == "O", "OPEN").otherwise("Part").alias("word"))


@query("placeholders_to_null", "CLN-02", f"WITH {_MESSY} SELECT row_id, CASE WHEN lower(trim(priority)) NOT IN ({_LIST(PLACEHOLDERS)}) THEN priority END AS priority FROM messy")
def _(t):
    return cl.placeholders_to_null(_messy(t).select("row_id", "priority"))


@query("placeholder_counts", "CLN-02", f"""WITH {_MESSY} SELECT 'priority' AS "column", count(*) FILTER (lower(trim(priority)) IN ({_LIST(PLACEHOLDERS)})) AS replaced FROM messy
UNION ALL SELECT 'word', count(*) FILTER (lower(trim(word)) IN ({_LIST(PLACEHOLDERS)})) FROM messy""")
def _(t):
    return cl.placeholder_counts(_messy(t), ["priority", "word"])


@query("drop_empty_rows_columns", "CLN-03 SRC-10", """
SELECT doc_id AS row_id, quality, CASE WHEN toxic = 1 THEN 1 END AS toxic_only FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NOT NULL OR toxic = 1""")
def _(t):
    d = t.documents.join(t.labels, "doc_id", "left").select(
        F.col("doc_id").alias("row_id"), "quality", F.when(F.col("toxic") == 1, 1).alias("toxic_only"), F.when(F.col("toxic") > 5, "x").alias("never"))
    return cl.drop_empty(d, "row_id")


@query("drop_duplicate_rows_documents", "CLN-04", "SELECT min(doc_id) AS doc_id, md5(text) AS h, lang, source FROM documents GROUP BY text, lang, source")
def _(t):
    d = cl.drop_duplicate_rows(t.documents.drop("n_chars"), "doc_id")
    return d.select("doc_id", F.md5("text").alias("h"), "lang", "source")


@query("drop_duplicate_columns", "CLN-05", "SELECT l_orderkey, l_quantity, l_discount FROM lineitem")
def _(t):
    d = t.lineitem.select("l_orderkey", "l_quantity", "l_discount", (F.col("l_quantity") * 1.0).alias("qty_again"), F.col("l_discount").alias("disc_copy"))
    return cl.drop_duplicate_columns(d, "l_orderkey")


@query("snake_case_names", "CLN-06", "SELECT p_partkey AS part_key, p_name AS part_name_full, p_size AS size, p_size + 1 AS size_1 FROM part")
def _(t):
    d = t.part.select(F.col("p_partkey").alias(" Part Key "), F.col("p_name").alias("Part-Name (Full)"), F.col("p_size").alias("Size"), (F.col("p_size") + 1).alias("SIZE!"))
    return cl.rename_columns(d)


@query("type_repair_decisions", "CLN-07 CLN-08 CLN-09 CLN-10", f"""WITH {_MESSY}, r AS (
 SELECT count(*) FILTER (regexp_matches(price_text, '[€$£¥₹,]')) / count(*) AS sym FROM messy)
SELECT c AS "column", CASE c WHEN 'price_text' THEN CASE WHEN sym > 0 THEN 'currency' ELSE 'number' END WHEN 'share_text' THEN 'percent' WHEN 'number_text' THEN 'number'
 WHEN 'day_text' THEN (SELECT CASE WHEN (count(*) FILTER (regexp_matches(day_text, '^\\d{{4}}-')) / count(*) > 0.5)::INT + (count(*) FILTER (regexp_matches(day_text, '^\\d\\d\\.')) / count(*) > 0.5)::INT
   + (count(*) FILTER (regexp_matches(day_text, '^\\d\\d\\.\\d\\d\\.') AND day_text[1:2]::INT <= 12) / count(*) > 0.5)::INT >= 2 THEN 'mixed_dates' ELSE 'date' END
   FROM (SELECT day_text FROM messy)) ELSE 'text' END AS target
FROM (SELECT unnest(['priority', 'price_text', 'share_text', 'number_text', 'day_text', 'flag', 'word']) AS c), r""")
def _(t):
    d = _messy(t)
    return cl.type_decisions(cl.type_rates(d)).drop("filled")


@query("type_repair_values", "CLN-07 CLN-08 CLN-09 CLN-10", f"""WITH {_MESSY}
SELECT row_id, replace(price_text[2:], ',', '')::DOUBLE AS price_text, replace(share_text, '%', '')::DOUBLE AS share_text, number_text::DOUBLE AS number_text,
  coalesce(try_strptime(day_text, '%Y-%m-%d'), try_strptime(day_text, '%d.%m.%Y')) AS day_text FROM messy""")
def _(t):
    d = _messy(t).select("row_id", "price_text", "share_text", "number_text", "day_text")
    targets = {r["column"]: r["target"] for r in cl.type_decisions(cl.type_rates(d)).collect()}
    return cl.retype(d, targets)


@query("boolean_words_unified", "CLN-11", f"WITH {_MESSY} SELECT row_id, CASE WHEN lower(trim(flag)) IN ({_LIST(TRUE_WORDS)}) THEN 'yes' WHEN lower(trim(flag)) IN ({_LIST(FALSE_WORDS)}) THEN 'no' END AS flag, word FROM messy")
def _(t):
    d = _messy(t).select("row_id", "flag", "word")
    return cl.unify_booleans(d, cl.boolean_columns(d))


@query("semantic_columns", "CLN-12", """
SELECT 'c_acctbal' AS "column", NULL AS semantic WHERE false UNION ALL SELECT 'order_id', 'id' FROM (SELECT count(DISTINCT o_orderkey) / count(*) AS u FROM orders) WHERE u > 0.85
UNION ALL SELECT 'total_price', 'revenue' UNION ALL SELECT 'contact', 'phone' UNION ALL SELECT 'address', 'email' FROM (SELECT avg((o_custkey >= 0)::INT) AS r FROM orders) WHERE r >= 0.7""")
def _(t):
    d = t.orders.select(F.col("o_orderkey").alias("order_id"), F.col("o_totalprice").alias("total_price"), F.col("o_orderpriority").alias("contact"),
                        F.concat(F.lit("c"), "o_custkey", F.lit("@shop.example")).alias("address"), F.col("o_orderstatus").alias("state_word"))
    found = cl.semantic_columns(d)
    kinds = F.create_map(*[x for c, k in found.items() for x in (F.lit(c), F.lit(k))])
    names = cl.null_shares(d).select("column")
    return names.withColumn("semantic", F.try_element_at(kinds, F.col("column"))).where("semantic IS NOT NULL")


@query("drop_sparse_columns", "CLN-13", """
WITH d AS (SELECT doc_id, lang, quality, CASE WHEN toxic = 1 THEN 1 END AS rare FROM documents LEFT JOIN labels USING (doc_id)) SELECT doc_id, lang FROM d""")
def _(t):
    d = t.documents.join(t.labels, "doc_id", "left").select("doc_id", "lang", "quality", F.when(F.col("toxic") == 1, 1).alias("rare"))
    return cl.drop_sparse(d, 50.0)


_GAPS = """g AS (SELECT o_orderkey AS row_id, o_totalprice AS price, CASE WHEN o_totalprice < 350000 THEN o_custkey END AS cust,
  CASE WHEN o_orderpriority <> '1-URGENT' THEN o_totalprice / 2 END AS half, o_orderpriority AS prio FROM orders)"""


def _gaps(t):
    return t.orders.select(
        F.col("o_orderkey").alias("row_id"), F.col("o_totalprice").alias("price"), F.when(F.col("o_totalprice") < 350000, F.col("o_custkey")).alias("cust"),
        F.when(F.col("o_orderpriority") != "1-URGENT", F.col("o_totalprice") / 2).alias("half"), F.col("o_orderpriority").alias("prio"))


@query("missingness_mechanism", "CLN-14", f"""WITH {_GAPS}, p AS (SELECT *, lag(cust) OVER (ORDER BY row_id) AS pc, lag(half) OVER (ORDER BY row_id) AS ph FROM g),
m AS (SELECT median(price) AS mp, median(cust) AS mc, median(half) AS mh FROM g),
r AS (SELECT 'cust' AS c, greatest(abs(corr((cust IS NULL)::INT::DOUBLE, price)), abs(corr((cust IS NULL)::INT::DOUBLE, coalesce(half, mh)))) AS r,
   abs(corr((cust IS NULL)::INT::DOUBLE, pc) FILTER (pc IS NOT NULL)) AS s FROM p, m
 UNION ALL SELECT 'half', greatest(abs(corr((half IS NULL)::INT::DOUBLE, price)), abs(corr((half IS NULL)::INT::DOUBLE, coalesce(cust, mc)))),
   abs(corr((half IS NULL)::INT::DOUBLE, ph) FILTER (ph IS NOT NULL)) FROM p, m)
SELECT c AS "column", CASE WHEN s > 0.4 THEN 'mnar' WHEN r > 0.25 THEN 'mar' ELSE 'mcar' END AS mechanism, round(CASE WHEN s > 0.4 THEN s ELSE r END, 4) AS strength FROM r""")
def _(t):
    return cl.missingness_mechanism(_gaps(t), "row_id")


@query("fill_values", "CLN-15", f"""WITH {_GAPS}
SELECT 'cust' AS "column", CASE WHEN abs(skewness(cust)) > 1 THEN 'median' ELSE 'mean' END AS method, round(CASE WHEN abs(skewness(cust)) > 1 THEN median(cust) ELSE avg(cust) END, 6) AS number, NULL::VARCHAR AS text FROM g
UNION ALL SELECT 'half', CASE WHEN abs(skewness(half)) > 1 THEN 'median' ELSE 'mean' END, round(CASE WHEN abs(skewness(half)) > 1 THEN median(half) ELSE avg(half) END, 6), NULL FROM g
UNION ALL SELECT 'prio', 'mode', NULL, (SELECT prio FROM g GROUP BY prio ORDER BY count(*) DESC, prio LIMIT 1)""")
def _(t):
    return cl.fill_values(_gaps(t), ["cust", "half", "prio"]).withColumn("number", F.round("number", 6))


@query("impute_with_flag", "CLN-15 CLN-16", f"""WITH {_GAPS}, m AS (SELECT avg(cust) AS c, avg(half) AS h FROM g)
SELECT row_id, round(coalesce(cust, c), 4) AS cust, (cust IS NULL)::BIGINT AS cust_was_missing, round(coalesce(half, h), 4) AS half FROM g, m""")
def _(t):
    d = cl.impute_simple(_gaps(t).select("row_id", "cust", "half"), ["cust", "half"], flag=["cust"])
    return d.select("row_id", F.round("cust", 4).alias("cust"), F.col("cust_was_missing").cast("bigint").alias("cust_was_missing"), F.round("half", 4).alias("half"))


@query("impute_chained_regression", "CLN-17")
def _(t):
    return impute.impute_chained(_gaps(t).drop("prio"), "row_id", "half", ["price", "cust"])


_LINE = """SELECT o_orderkey AS row_id, CASE WHEN o_orderpriority <> '1-URGENT' THEN o_totalprice END AS price, o_custkey AS cust, date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS day FROM orders"""
_LINE_FIT = f"""g AS ({_LINE}), s AS (SELECT avg(price) AS mp, stddev_pop(price) AS sp, avg(cust) AS mc, stddev_pop(cust) AS sc, avg(day) AS md, stddev_pop(day) AS sd FROM g),
z AS (SELECT row_id, price, (price - mp) / sp AS y, (cust - mc) / sc AS a, (day - md) / sd AS b FROM g, s),
m AS (SELECT avg(a) AS ma, avg(b) AS mb, avg(y) AS my, covar_pop(a, a) + 1e-6 AS aa, covar_pop(b, b) + 1e-6 AS bb, covar_pop(a, b) AS ab, covar_pop(a, y) AS ay, covar_pop(b, y) AS bt FROM z WHERE y IS NOT NULL),
w AS (SELECT *, (ay * bb - bt * ab) / (aa * bb - ab * ab) AS wa, (bt * aa - ay * ab) / (aa * bb - ab * ab) AS wb FROM m)"""


def _line(t):
    return t.orders.select(
        F.col("o_orderkey").alias("row_id"), F.when(F.col("o_orderpriority") != "1-URGENT", F.col("o_totalprice")).alias("price"), F.col("o_custkey").alias("cust"),
        F.datediff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date")).alias("day"))


@query("impute_regression_normal_equations", "CLN-17", f"WITH {_LINE_FIT} SELECT row_id, round(coalesce(price, mp + sp * (my + wa * (a - ma) + wb * (b - mb))), 2) AS price FROM z, s, w")
def _(t):
    return impute.impute_chained(_line(t), "row_id", "price", ["cust", "day"]).select("row_id", F.round("price", 2).alias("price"))


@query("impute_regression_lines", "CLN-17", f"""WITH {_LINE_FIT}, l AS (SELECT wa * sp / sc AS a, wb * sp / sd AS b, mp + sp * (my - wa * ma - wb * mb) AS c, mc, md FROM w, s)
SELECT 'price' AS "column", NULL::VARCHAR AS predictor, round(c - a * mc - b * md, 4) AS weight, 1 AS rounds, true AS converged FROM l
UNION ALL SELECT 'price', 'cust', round(a, 8), 1, true FROM l UNION ALL SELECT 'price', 'day', round(b, 8), 1, true FROM l""")
def _(t):
    d = _line(t)
    lines = impute.fitted_lines(d, impute.fit_chained(d, "price", ["cust", "day"]))
    return lines.withColumn("weight", F.when(F.col("predictor").isNull(), F.round("weight", 4)).otherwise(F.round("weight", 8)))


def _donors_sql(source: str, target: str, cols: list[str]) -> str:
    """All seekers against all donors, over the coordinates that both have."""
    facts = ", ".join(f"avg({c}) AS m_{c}, CASE WHEN stddev_pop({c}) = 0 THEN 1 ELSE stddev_pop({c}) END AS s_{c}" for c in cols)
    standard = ", ".join(f"({c} - m_{c}) / s_{c} AS {c}" for c in cols)
    shared = " + ".join(f"(a.{c} IS NOT NULL AND b.{c} IS NOT NULL)::INT" for c in cols)
    gap = " + ".join(f"coalesce(pow(a.{c} - b.{c}, 2), 0)" for c in cols)
    return f"""WITH g AS ({source}), f AS (SELECT avg({target}) AS mean, {facts} FROM g), z AS (SELECT row_id, {target} AS v, {standard} FROM g, f),
p AS (SELECT a.row_id, b.v, {shared} AS shared, {gap} AS q FROM z a JOIN z b ON a.v IS NULL AND b.v IS NOT NULL),
l AS (SELECT row_id, round(sqrt(q * {len(cols)} / shared), 9) AS d, count(*) AS w, avg(v) AS v FROM p WHERE shared > 0 GROUP BY ALL),
c AS (SELECT *, coalesce(sum(w) OVER (PARTITION BY row_id ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM l),
u AS (SELECT row_id, CASE WHEN min(d) = 0 THEN max(CASE WHEN d = 0 THEN v END) ELSE sum(least(w, 5 - before) / d * v) / sum(least(w, 5 - before) / d) END AS fill FROM c WHERE before < 5 GROUP BY row_id)
SELECT row_id, round(coalesce({target}, fill, mean), 8) AS {target} FROM g LEFT JOIN u USING (row_id), f"""


@query("impute_nearest_rows", "CLN-18", _donors_sql("SELECT c_custkey AS row_id, CASE WHEN c_mktsegment <> 'MACHINERY' THEN c_acctbal END AS balance, c_nationkey AS nation FROM customer", "balance", ["nation"]))
def _(t):
    d = t.customer.select(F.col("c_custkey").alias("row_id"), F.when(F.col("c_mktsegment") != "MACHINERY", F.col("c_acctbal")).alias("balance"), F.col("c_nationkey").alias("nation"))
    return impute.impute_nearest(d, "row_id", "balance", ["nation"]).select("row_id", F.round("balance", 8).alias("balance"))


@query("impute_nearest_observed", "CLN-18", _donors_sql("""SELECT o_orderkey AS row_id, CASE WHEN o_orderpriority <> '1-URGENT' OR o_orderkey % 5 <> 0 THEN o_totalprice END AS price,
  CASE WHEN o_orderkey % 7 <> 0 THEN o_custkey END AS cust, CASE WHEN o_custkey % 4 <> 0 THEN date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) END AS day,
  CASE WHEN o_orderstatus <> 'P' THEN o_orderkey % 100 END AS slot FROM orders""", "price", ["cust", "day", "slot"]))
def _(t):
    k = F.col("o_orderkey")
    d = t.orders.select(
        k.alias("row_id"), F.when((F.col("o_orderpriority") != "1-URGENT") | (k % 5 != 0), F.col("o_totalprice")).alias("price"), F.when(k % 7 != 0, F.col("o_custkey")).alias("cust"),
        F.when(F.col("o_custkey") % 4 != 0, F.datediff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date"))).alias("day"), F.when(F.col("o_orderstatus") != "P", k % 100).alias("slot"))
    return impute.impute_nearest(d, "row_id", "price", ["cust", "day", "slot"]).select("row_id", F.round("price", 8).alias("price"))


def _ob(c, table):
    return f"""SELECT '{c}' AS "column", any_value(n) AS n, any_value(method) AS method, round(any_value(lo), 4) AS lower, round(any_value(hi), 4) AS upper, count(*) FILTER (v < lo OR v > hi) AS outside
 FROM (SELECT {c} AS v FROM {table}), (SELECT n, CASE WHEN f THEN 'iqr' ELSE 'sigma' END AS method, CASE WHEN f THEN q1 - 3 * (q3 - q1) ELSE m - 4 * s END AS lo, CASE WHEN f THEN q3 + 3 * (q3 - q1) ELSE m + 4 * s END AS hi FROM
  (SELECT count({c}) AS n, avg({c}) AS m, stddev_samp({c}) AS s, abs(skewness({c})) > 1 AND quantile_cont({c}, 0.75) > quantile_cont({c}, 0.25) AS f, quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM {table}))"""


@query("outlier_bounds", "CLN-19", _ob("value", "events") + " UNION ALL " + _ob("user_id", "events"))
def _(t):
    b = cl.outlier_bounds(t.events, ["value", "user_id"])
    return b.withColumn("lower", F.round("lower", 4)).withColumn("upper", F.round("upper", 4))


_BND = "b AS (SELECT quantile_cont(value, 0.25) - 3 * (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) AS lo, quantile_cont(value, 0.75) + 3 * (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) AS hi FROM events)"
for _strategy, _expr in [("winsorize", "round(greatest(least(value, hi), lo), 4) AS value"), ("isolate", "CASE WHEN value BETWEEN lo AND hi THEN round(value, 4) END AS value"),
                         ("flag_only", "round(value, 4) AS value, value < lo OR value > hi AS value_is_outlier"), ("preserve", "round(value, 4) AS value")]:
    def _run(t, s=_strategy):
        b = {r["column"]: (r["lower"], r["upper"]) for r in cl.outlier_bounds(t.events, ["value"]).collect()}
        return cl.treat_outliers(t.events.select("event_id", "value"), b, s).withColumn("value", F.round("value", 4))
    query(f"outliers_{_strategy}", "CLN-20", f"WITH {_BND} SELECT event_id, {_expr} FROM events, b")(_run)


@query("suspicious_zeros", "CLN-21", """
WITH d AS (SELECT l_tax AS tax, CASE WHEN l_discount >= 0.03 THEN l_discount ELSE 0 END AS disc, l_quantity AS qty FROM lineitem)
SELECT 'tax' AS "column", count(*) FILTER (tax = 0) AS zero_count, round(count(*) FILTER (tax = 0) / count(*) * 100, 1) AS zero_pct FROM d HAVING count(*) FILTER (tax = 0) / count(*) >= 0.1
UNION ALL SELECT 'disc', count(*) FILTER (disc = 0), round(count(*) FILTER (disc = 0) / count(*) * 100, 1) FROM d HAVING count(*) FILTER (disc = 0) / count(*) >= 0.1""")
def _(t):
    d = t.lineitem.select(F.col("l_tax").alias("tax"), F.when(F.col("l_discount") >= 0.03, F.col("l_discount")).otherwise(0.0).alias("disc"), F.col("l_quantity").alias("qty"))
    return cl.suspicious_zeros(d)


@query("trim_and_title_case", "CLN-22", f"""WITH {_MESSY}, s AS (SELECT avg((word = upper(word))::INT) AS w, avg((mkt = upper(mkt))::INT) AS m FROM messy, (SELECT c_mktsegment AS mkt FROM customer LIMIT 1))
SELECT row_id, trim(flag) AS flag, CASE WHEN (SELECT avg((word = upper(word))::INT) FROM messy) > 0.7 THEN CASE word WHEN 'DONE WELL' THEN 'Done Well' WHEN 'OPEN' THEN 'Open' ELSE 'Part' END ELSE word END AS word FROM messy""")
def _(t):
    return cl.title_case(cl.trim_text(_messy(t).select("row_id", "flag", "word")))


@query("title_case_segments", "CLN-22", "SELECT c_custkey, upper(c_mktsegment[1:1]) || lower(c_mktsegment[2:]) AS c_mktsegment FROM customer")
def _(t):
    return cl.title_case(t.customer.select("c_custkey", "c_mktsegment"))


@query("cleaning_confidence_by_source", "CLN-23", """
WITH d AS (SELECT source, count(*) AS rows, 4 AS cols, round((count(*) - count(quality)) / (count(*) * 4) * 100, 1) AS missing_pct, count(*) FILTER (lower(trim(text)) IN ('n/a', 'none', '-')) AS placeholders,
  count(*) FILTER (n_chars > 3000) AS winsorized FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1),
s AS (SELECT source, round_even(100 - least(30, missing_pct * 0.5) - least(20, placeholders / (rows * cols) * 100 * 0.4) - 5.0::DOUBLE - least(15, winsorized / (rows * cols) * 100 * 0.3) - 2, 0)::BIGINT AS score FROM d)
SELECT source, score, CASE WHEN score >= 90 THEN 'A+' WHEN score >= 80 THEN 'A' WHEN score >= 65 THEN 'B' WHEN score >= 50 THEN 'C' ELSE 'D' END AS grade,
  CASE WHEN score >= 90 THEN 'Analyst Ready' WHEN score >= 80 THEN 'High Quality' WHEN score >= 65 THEN 'Good' WHEN score >= 50 THEN 'Needs Review' ELSE 'Significant Issues' END AS label FROM s""")
def _(t):
    d = t.documents.join(t.labels, "doc_id", "left").groupBy("source").agg(
        F.count(F.lit(1)).alias("rows"), F.round(F.count_if(F.col("quality").isNull()) / (F.count(F.lit(1)) * 4) * 100, 1).alias("missing_pct"),
        F.count_if(F.lower(F.trim("text")).isin("n/a", "none", "-")).alias("placeholders"), F.count_if(F.col("n_chars") > 3000).alias("winsorized"))
    d = d.withColumns({"cols": F.lit(4), "suspicious": F.lit(1), "duplicate_cols": F.lit(1)})
    return cl.confidence_score(d).select("source", "score", "grade", "label")


def _dirty(t):
    m = _messy(t)
    return m.unionByName(m.withColumn("row_id", F.col("row_id") + 10_000_000_000))


@query("clean_dataset_aggressive", "CLN-01", f"""WITH {_MESSY}, d AS (SELECT *, CASE WHEN lower(trim(priority)) NOT IN ({_LIST(PLACEHOLDERS)}) THEN priority END AS prio FROM messy),
mode AS (SELECT prio FROM d WHERE prio IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
SELECT row_id, CASE coalesce(d.prio, mode.prio) WHEN '1-URGENT' THEN '1-Urgent' WHEN '2-HIGH' THEN '2-High' WHEN '3-MEDIUM' THEN '3-Medium' END AS priority, replace(price_text[2:], ',', '')::DOUBLE AS price_text, replace(share_text, '%', '')::DOUBLE AS share_text, number_text::DOUBLE AS number_text,
  CASE WHEN lower(trim(flag)) IN ({_LIST(TRUE_WORDS)}) THEN 'yes' ELSE 'no' END AS flag FROM d, mode""")
def _(t):
    return clean_dataset(_dirty(t), "row_id").data.select("row_id", "priority", "price_text", "share_text", "number_text", "flag")


@query("clean_dataset_audit", "CLN-24 CLN-01", f"""WITH {_MESSY}
SELECT 'placeholder' AS kind, 1::BIGINT AS steps, (2 * count(*) FILTER (lower(trim(priority)) IN ({_LIST(PLACEHOLDERS)})))::BIGINT AS affected FROM messy
UNION ALL SELECT 'drop_rows', 1, count(*) FROM messy""")
def _(t):
    audit = clean_dataset(_dirty(t), "row_id").audit
    return cl.ranked_audit(audit).where(F.col("kind").isin("placeholder", "drop_rows"))


@query("clean_dataset_safe_report", "CLN-01 CLN-24", f"""WITH {_MESSY}
SELECT 'placeholder' AS kind, 'priority' AS "column", (2 * count(*) FILTER (lower(trim(priority)) IN ({_LIST(PLACEHOLDERS)})))::BIGINT AS affected, 'warning' AS impact FROM messy
UNION ALL SELECT 'drop_rows', NULL, count(*), 'warning' FROM messy""")
def _(t):
    return clean_dataset(_dirty(t), "row_id", "safe").audit.where(F.col("kind").isin("placeholder", "drop_rows")).select("kind", "column", "affected", "impact")
