"""The operators over the given tables, with the SQL of those that SQL can state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import alignment, capfilters, chat, decontaminate, langid, linededup, mixing, quality, scoring, sharding, simhash, spelling, toxicity
from gridloom.tables import load


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation as a preference pair: its own last reply against its neighbour's."""
    pairs = chat.format_preferences(chat.swapped_replies(load(spark, sf_dir, "conversations")))

    def spans(c: str):
        return F.array_join(F.transform(c, lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["stop"].cast("string"))), ",")

    return pairs.withColumns({"chosen_spans": spans("chosen_spans"), "rejected_spans": spans("rejected_spans")})


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination_report(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op3_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(load(spark, sf_dir, "documents"), 16)


def op4_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.duplicates_report(load(spark, sf_dir, "documents"))


def op5_line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(load(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_lines", "n_removed", "text")


def op6_masked_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.likelihood_report(load(spark, sf_dir, "documents"))


def op7_byte_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_report(load(spark, sf_dir, "documents"))


def op8_pairwise_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(load(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_cap_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capfilters.link_vectors(load(spark, sf_dir, "embeddings"))


def op11_ftrl_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_report(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op12_trie_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_report(load(spark, sf_dir, "documents"))


def op13_pointer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignment_report(load(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_chat_formatting, op2_benchmark_decontamination, op3_jump_sharding, op4_simhash_golay, op5_line_windows, op6_masked_likelihood, op7_byte_language_id, op8_pairwise_quality, op9_source_mixing, op10_cap_filters, op11_ftrl_toxicity, op12_trie_spelling, op13_pointer_alignment]
    return {f.__name__: f for f in found}


OP1 = r"""
WITH convs AS (
  SELECT conv_id, list({'role': coalesce(role, 'unknown'), 'text': coalesce(text, ''), 'reply': role = 'assistant'}
    ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS turns FROM conversations GROUP BY conv_id),
ends AS (SELECT conv_id, turns, list_max([i FOR i IN range(1, len(turns) + 1) IF turns[i].reply]) AS last FROM convs),
sides AS (
  SELECT a.conv_id, CASE WHEN a.last IS NULL THEN a.turns ELSE a.turns[1:a.last - 1] END AS head,
    CASE WHEN a.last IS NOT NULL THEN a.turns[a.last].text END AS mine, b.turns[b.last].text AS other
  FROM ends a LEFT JOIN ends b ON b.conv_id = xor(a.conv_id, 1) AND b.last IS NOT NULL),
parts AS (SELECT *, coalesce(mine = other, false) AS same FROM sides)
SELECT conv_id, CAST(len(head) + CASE WHEN same THEN 1 ELSE 0 END AS INTEGER) AS n_prompt_turns,
  array_to_string(['<|im_start|>' || t.role || chr(10) || t.text || '<|im_end|>' || chr(10) FOR t IN head], '')
    || CASE WHEN same THEN '<|im_start|>assistant' || chr(10) || mine || '<|im_end|>' || chr(10) ELSE '' END AS prompt,
  CASE WHEN mine IS NULL OR same THEN '' ELSE '<|im_start|>assistant' || chr(10) || mine || '<|im_end|>' || chr(10) END AS chosen,
  CASE WHEN mine IS NULL OR other IS NULL OR same THEN '' ELSE '<|im_start|>assistant' || chr(10) || other || '<|im_end|>' || chr(10) END AS rejected,
  CASE WHEN mine IS NULL OR same THEN '' ELSE '22-' || (32 + length(mine)) END AS chosen_spans,
  CASE WHEN mine IS NULL OR other IS NULL OR same THEN '' ELSE '22-' || (32 + length(other)) END AS rejected_spans
FROM parts
"""

OP2 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
wins AS (SELECT DISTINCT item, least(13, len(w)) AS n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS win
  FROM (SELECT item, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM wins),
spots AS (SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)),
hits AS (SELECT r, i, s.n, item FROM spots s JOIN wins USING (n, win)),
covered AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, i, n FROM hits)) GROUP BY r),
named AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hits GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN named USING (r)
"""

OP5 = r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines, row_number() OVER (ORDER BY doc_id NULLS FIRST, text) AS r FROM documents),
three AS (SELECT r, i, least(len(lines), 3) AS n, lines FROM (SELECT r, lines, unnest(range(1, greatest(len(lines) - 1, 2))) AS i FROM d WHERE text <> '')),
passages AS (SELECT r, i, 1 AS n, lines FROM (SELECT r, lines, unnest(range(1, len(lines) + 1)) AS i FROM d) WHERE len(regexp_extract_all(lines[i], '[^\x20\x09-\x0D]+')) > 50),
wins AS (SELECT r, i, n, lines[i:i + n - 1] AS win FROM (SELECT * FROM three UNION ALL SELECT * FROM passages WHERE len(lines) > 1)),
later AS (SELECT r, i, n FROM (SELECT r, i, n, row_number() OVER (PARTITION BY n, win ORDER BY r, i) AS k FROM wins) WHERE k > 1),
gone AS (SELECT DISTINCT r, unnest(range(i, i + n)) AS i FROM later),
cut AS (SELECT r, list(i) AS places FROM gone GROUP BY r)
SELECT doc_id, CAST(coalesce(len(lines), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(places), 0) AS BIGINT) AS n_removed,
  CASE WHEN text IS NULL THEN NULL WHEN places IS NULL THEN text ELSE array_to_string([lines[i] FOR i IN range(1, len(lines) + 1) IF NOT list_contains(places, i)], chr(10)) END AS text
FROM d LEFT JOIN cut USING (r)
"""

OP9 = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
  CAST('0x' || substr(md5('42:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS k FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS w, 3.0::DOUBLE * source_size AS most FROM s),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(most) OVER before, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER before, 0)) AS level FROM w
  WINDOW before AS (ORDER BY most / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, CASE WHEN most / w <= level THEN most ELSE w * max(CASE WHEN most / w > level THEN level END) OVER () END AS target FROM l),
p AS (SELECT d.*, source_size, target, CAST(floor(target + 0.5) AS BIGINT) AS budget,
  coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM p)
SELECT doc_id, size, source_size, target, CAST(epochs * size + greatest(0, least(size, budget - epochs * source_size - start)) AS BIGINT) AS taken FROM e
"""

OP10 = r"""
WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE vec_id IS NOT NULL AND label IS NOT NULL AND e IS NOT NULL AND len([x FOR x IN e IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN e IF x <> 0]) > 0),
links AS (SELECT a.r AS a, b.r AS b, b.vec_id AS far FROM ok a JOIN ok b ON a.label = b.label AND a.r <> b.r AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT r AS a, r AS b FROM ok UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
comp AS (SELECT reach.a AS r, min(ok.vec_id) AS component FROM reach JOIN ok ON ok.r = reach.b GROUP BY reach.a),
n AS (SELECT a AS r, count(*) AS n_links FROM links GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, coalesce(component, vec_id) AS component_id, coalesce(vec_id = coalesce(component, vec_id), false) AS kept
FROM v LEFT JOIN comp USING (r) LEFT JOIN n USING (r)
"""


OP12 = r"""
WITH RECURSIVE steps AS (SELECT i, 0 AS k, i AS c FROM range(256) t(i)
  UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM steps WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM steps WHERE k = 8),
tokens AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run FROM documents),
runs AS (SELECT doc_id, run, count(*) AS n FROM tokens WHERE length(run) >= 6 GROUP BY doc_id, run),
bytes AS (SELECT run, n, hex(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run) AS x FROM runs),
hashed AS (SELECT run, n, xor(list_reduce([CAST('0x' || x[2 * i + 1:2 * i + 2] AS BIGINT) FOR i IN range(length(x) // 2)],
  lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) AS h FROM bytes, crc),
cut AS (SELECT CASE WHEN h % 199 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM cut WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
holes AS (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (SELECT a.word, b.word AS near, b.n AS near_n FROM holes a JOIN holes b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM holes a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM holes a JOIN words b ON a.rest = b.word),
ranked AS (SELECT word, count(*) AS n_near, min((-near_n, near)) AS best FROM near GROUP BY word),
formed AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -best[1] >= 5 * n THEN best[2] END AS form,
  CASE WHEN -best[1] >= 5 * n THEN -best[1] END AS form_n FROM words LEFT JOIN ranked USING (word)),
chain AS (SELECT word, word AS root, 0 AS k FROM formed UNION ALL SELECT chain.word, form, k + 1 FROM chain JOIN formed ON formed.word = root WHERE form IS NOT NULL)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN (SELECT word, arg_max(root, k) AS root FROM chain GROUP BY word) USING (word)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_formatting": OP1, "op2_benchmark_decontamination": OP2, "op5_line_windows": OP5, "op9_source_mixing": OP9, "op10_cap_filters": OP10, "op12_trie_spelling": OP12}
