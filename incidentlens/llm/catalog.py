"""Registered corpus queries: each applies one operator to its whole table; check SQL where there is any."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F

from ..session import ROWS_BROADCAST, prepare
from . import (attention_lm, chunk_recipes, collocations, decontaminate, language_mixture, line_frequency,
               packing, prefix_trie, projection_forest, quality_rules, sharding, simhash_trees, substring_dedup)

QUERIES = {}
CHECKS = {}
#: Arrow batches of the corpus queries, so that long texts do not pile up in one batch.
BATCH_ROWS = "1000"


class Tables:
    """Reads the given tables by name."""

    def __init__(self, spark, folder):
        self.spark, self.folder = spark, folder

    def __call__(self, table):
        return self.spark.read.parquet(f"{self.folder}/{table}.parquet")


def query(name: str, check: str | None = None):
    def add(function):
        @functools.wraps(function)
        def prepared(spark, folder):
            prepare(spark, ROWS_BROADCAST)
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
            return function(spark, Tables(spark, folder))

        QUERIES[name] = prepared
        if check is not None:
            CHECKS[name] = check
        return function
    return add


def queries():
    return dict(QUERIES)


def checks():
    return dict(CHECKS)


OP1_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (
  SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS gram
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
f AS (SELECT gram, min(doc_id) AS m FROM g GROUP BY gram),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM g JOIN f USING (gram) WHERE m < doc_id),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t
  FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d) ANTI JOIN gone USING (doc_id, i)
  GROUP BY doc_id),
lost AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN lost USING (doc_id)"""


@query("op1_substring_dedup", OP1_SQL)
def op1(spark, read):
    return substring_dedup.remove_repeats(read("documents"), with_text=False).drop("kept")


@query("op2_best_fit_packing")
def op2(spark, read):
    return packing.pack_documents(read("documents"))


@query("op3_language_mixture")
def op3(spark, read):
    docs = read("documents")
    remainder = language_mixture.remainder("doc_id", 4)
    model = language_mixture.learn(docs.filter(remainder != 2))
    return language_mixture.predict(docs, model).select(
        "doc_id", F.coalesce(remainder == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "languages")


@query("op4_projection_forest")
def op4(spark, read):
    vectors = read("embeddings")
    return projection_forest.nearest(vectors, vectors.filter("vec_id % 50 = 0"), 5)


def _unescaped(sql: str) -> str:
    for written, meant in line_frequency.REFERENCES:
        sql = "replace({}, '{}', '{}')".format(sql, written, meant.replace("'", "''"))
    return sql


OP5_SQL = rf"""
WITH p AS (
  SELECT page_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS host,
    string_split({_unescaped(f"""regexp_replace(regexp_replace(regexp_replace(html,
      '{line_frequency.NO_TEXT}', chr(10), 'g'), '{line_frequency.BLOCK_TAGS}', chr(10), 'g'),
      '{line_frequency.ANY_TAG}', '', 'g')""")}, chr(10)) AS lines
  FROM pages),
totals AS (SELECT host, count(*) AS host_pages FROM p GROUP BY host),
counts AS (
  SELECT host, line, count(*) AS n FROM (
    SELECT host, unnest(list_distinct(list_filter(list_transform(lines, lambda s: trim(s, ' ')), lambda s: s <> ''))) AS line
    FROM p) GROUP BY host, line),
bad AS (
  SELECT c.host, list(c.line) AS bad FROM counts c JOIN totals t USING (host)
  WHERE c.n >= {line_frequency.LEAST_COUNT} AND c.n > {line_frequency.RATIO}::DOUBLE * t.host_pages
  GROUP BY c.host),
k AS (
  SELECT page_id, host, lines,
    list_filter(lines, lambda s: NOT list_contains(coalesce(b.bad, []::VARCHAR[]), trim(s, ' '))) AS kept
  FROM p LEFT JOIN bad b USING (host))
SELECT page_id, host, len(list_filter(lines, lambda s: trim(s, ' ') <> '')) AS n_lines,
  len(lines) - len(kept) AS n_removed, array_to_string(kept, chr(10)) AS text
FROM k"""


@query("op5_site_line_frequency", OP5_SQL)
def op5(spark, read):
    pages = read("pages").select("page_id", "url", "html")
    out = line_frequency.drop_frequent_lines(
        pages, line_frequency.url_host(F.col("url")), line_frequency.html_text(F.col("html")), extra=True)
    return out.select("page_id", "host", "n_lines", "n_removed", "text")


@query("op6_attention_lm")
def op6(spark, read):
    remainder = language_mixture.remainder("doc_id", 7)
    out = attention_lm.score_documents(read("documents"), remainder != 2)
    return out.select("doc_id", F.coalesce(remainder == 2, F.lit(False)).alias("held_out"), "n_tokens", "n_known",
                      "train_tokens", "base_score", "score")


LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP7_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS gram
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS gram
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT DISTINCT doc_id, i, n FROM dw SEMI JOIN bw USING (n, gram)),
covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM dw JOIN bw USING (n, gram)) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)"""


@query("op7_benchmark_decontamination", OP7_SQL)
def op7(spark, read):
    return decontaminate.digest(decontaminate.report(read("documents"), read("benchmark"))).drop("longest")


@query("op8_best_fit_sharding")
def op8(spark, read):
    out = sharding.shard_documents(read("documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))


@query("op9_simhash_components")
def op9(spark, read):
    out = simhash_trees.components(read("documents"))
    return out.select("doc_id", simhash_trees.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


@query("op10_quality_rules")
def op10(spark, read):
    remainder = language_mixture.remainder("doc_id", 5)
    out = quality_rules.score_documents(read("documents"), read("labels"), remainder != 0)
    return out.select("doc_id", F.coalesce(remainder == 0, F.lit(False)).alias("held_out"), "score", "predicted")


OP11_SQL = """
WITH bits AS (
  SELECT list_transform(range(256), lambda n: list_reduce(range(8),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, n)) AS crc_table),
t AS (
  SELECT conv_id, turn, struct_pack(r := coalesce(role, ''), x := coalesce(text, '')) AS it
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list(it ORDER BY turn NULLS FIRST, it.r, it.x) AS own FROM t GROUP BY conv_id),
h AS (
  SELECT conv_id, own, xor(4294967295, list_reduce(
    list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda s: CAST(ord(s) AS BIGINT)),
    lambda c, b: xor(c >> 8, crc_table[(xor(c, b) & 255) + 1]), 4294967295)) % 9 AS h FROM own, bits),
c AS (
  SELECT h.conv_id, coalesce(f.own[1:h.h], []) || h.own[h.h + 1:] AS path
  FROM h LEFT JOIN own f ON f.conv_id = h.conv_id - h.conv_id % 5),
prefixes AS (SELECT conv_id, path, unnest(range(0, len(path) + 1)) AS depth FROM c),
nodes AS (
  SELECT depth, path[1:depth] AS p, min(conv_id) AS conv_id, count(*) AS n_convs,
    string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (len(path) = depth) AS ends,
    CASE WHEN depth = 0 THEN 0 ELSE (count(*) - 1) * strlen(any_value(path[depth].x)) END AS saved
  FROM prefixes GROUP BY depth, path[1:depth]),
children AS (SELECT depth - 1 AS depth, p[1:depth - 1] AS p, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
counted AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN children USING (depth, p)),
above AS (SELECT *, unnest(range(0, depth + 1)) AS upto FROM counted),
sums AS (
  SELECT upto AS depth, p[1:upto] AS p, count(*) FILTER (n_children = 0) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens
  FROM above GROUP BY upto, p[1:upto])
SELECT n.conv_id, n.depth, u.conv_id AS parent_conv_id, n.n_convs, n.n_children, s.n_leaves, s.saved_tokens,
  sha256(coalesce(n.ends, '')) AS ends_sha256
FROM counted n JOIN sums s USING (depth, p) LEFT JOIN nodes u ON u.depth = n.depth - 1 AND u.p = n.p[1:n.depth - 1]"""


@query("op11_prefix_trie", OP11_SQL)
def op11(spark, read):
    return prefix_trie.conversation_trie(read("conversations"))


OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
    regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t FROM documents),
g AS (
  SELECT t, count(*) AS group_size, arg_min(doc_id, (-points, doc_id)) AS keep_id FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)"""


@query("op12_chunk_recipes", OP12_SQL)
def op12(spark, read):
    return chunk_recipes.duplicates(read("documents"))


OP13_SQL = rf"""
WITH w AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({LOWERED}, '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents)),
g AS (
  SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase, count(*) AS f FROM (
    SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i
    FROM w, (VALUES (1), (2), (3)) sizes(k) WHERE len(ws) >= k) GROUP BY ALL),
totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM g WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM g WHERE k > 1 AND f >= 10),
cuts AS (SELECT *, unnest(range(1, k)) AS cut FROM c),
s AS (
  SELECT cuts.*, x.f AS l, y.f AS r,
    (1000000::HUGEINT * a::HUGEINT * a::HUGEINT) // (x.f::HUGEINT * y.f::HUGEINT) AS score
  FROM cuts JOIN g x ON x.lang = cuts.lang AND x.phrase = array_to_string(ws[1:cut], ' ')
    JOIN g y ON y.lang = cuts.lang AND y.phrase = array_to_string(ws[cut + 1:], ' ')),
best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
longer AS (
  SELECT lang, phrase, max(a) AS most FROM (
    SELECT lang, a, array_to_string(ws[i:i + 1], ' ') AS phrase
    FROM (SELECT *, unnest(range(1, k)) AS i FROM c WHERE k = 3)) GROUP BY ALL)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n,
  CAST(score AS BIGINT) AS score
FROM best JOIN totals USING (lang) LEFT JOIN longer USING (lang, phrase)
WHERE most IS NULL OR 100 * most < 50 * a QUALIFY rank <= 2000"""


@query("op13_phrase_collocations", OP13_SQL)
def op13(spark, read):
    return collocations.collocations(read("documents"))


@query("pipeline")
def pipeline(spark, read):
    import corpus_pipeline

    return corpus_pipeline.run(spark, read.folder)
