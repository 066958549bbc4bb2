"""One query for each corpus operator, over the whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabspark.llm import alignment, decontaminate, html_text, langid, line_dedup, near_dedup, nearest, packing, pieces, pii, ranked, suffix_dedup, url_filter
from tabspark.llm.common import LOWER, UPPER, ship

QUERIES, SQL = {}, {}
#: URL rules: verdict, host, path (fixed values).
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
QUERY_STEP, NEIGHBOURS, FOUND = 20, 20, 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def model_path() -> str:
    return public_tokenizers.path("piece_bpe_32k.model")


def byte_model_path() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


def op1_pii(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return pii.find_pii(docs, pii.fit(docs)).select("doc_id", "pii.*")


def op2_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, folder, "documents"))


def op3_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op4_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    ruled = url_filter.with_rules(pages.select("page_id", "url"), RULES)
    model = url_filter.train(ruled.withColumn("verdict", F.col("rule_verdict")), url_filter.title_words(pages))
    return url_filter.judge(ruled, model).select("page_id", "host", "path", "rule", "verdict", "block_log_odds")


def op5_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_dedup.groups(table(spark, folder, "documents"), size=4, percent=80).drop("text_hash")


def op6_html_text(spark: SparkSession, folder: str) -> DataFrame:
    out = html_text.extract_text(table(spark, folder, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op7_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, folder, "documents").select("doc_id", "text"))
    kept = F.sha2(F.coalesce("lines.kept", F.lit("")).cast("binary"), 256)
    return out.select("doc_id", "lines.n_lines", "lines.n_removed", kept.alias("kept_sha256"))


def op8_nearest(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    return nearest.nearest(vectors, vectors.where(F.col("vec_id") % QUERY_STEP == 0), NEIGHBOURS)


def op9_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.round_trip(table(spark, folder, "documents").select("doc_id", "text"), model_path()).select("doc_id", "pieces.*")


def op10_langid(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang", langid.held_out().alias("held_out"))
    model = langid.train(docs.where(~F.col("held_out")))
    return langid.identify(docs, model).select("doc_id", "held_out", "language.lang_pred", "language.score")


def op11_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return alignment.align(table(spark, folder, "documents"), byte_model_path(), model_path())


def op12_ranked(spark: SparkSession, folder: str) -> DataFrame:
    return ranked.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"), FOUND)


def op13_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), byte_model_path())


for _query in (
    op1_pii, op2_suffix_dedup, op3_decontaminate, op4_url_filter, op5_near_dedup,
    op6_html_text, op7_line_dedup, op8_nearest, op9_pieces, op10_langid,
    op11_alignment, op12_ranked, op13_packing,
):
    QUERIES[_query.__name__] = _query


_LOWER = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"


def _words(between: str) -> str:
    return f"list_filter(regexp_split_to_array({_LOWER}, '{between}'), lambda x: x <> '')"


SQL["op2_suffix_dedup"] = f"""WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
n AS (SELECT doc_id, h, length(h) // 2 AS n FROM d),
w AS (SELECT doc_id, p, md5(substr(h, 2 * p + 1, {2 * suffix_dedup.LENGTH})) AS m
  FROM (SELECT doc_id, h, unnest(generate_series(0, n - {suffix_dedup.LENGTH})) AS p FROM n) q),
r AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY m) AS c FROM w) q WHERE c > 1),
g AS (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS g FROM (
  SELECT doc_id, p, CASE WHEN p > lag(p, 1, -1000000) OVER (PARTITION BY doc_id ORDER BY p) + {suffix_dedup.LENGTH} THEN 1 ELSE 0 END AS new FROM r) q),
s AS (SELECT doc_id, min(p) AS a, max(p) + {suffix_dedup.LENGTH} AS b FROM g GROUP BY doc_id, g),
edges AS (SELECT doc_id, a, b FROM s UNION ALL SELECT doc_id, n, n FROM n),
kept AS (SELECT e.doc_id, string_agg(substr(h, 2 * last + 1, 2 * (a - last)), '' ORDER BY a) AS k
  FROM (SELECT doc_id, a, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a, b) AS last FROM edges) e JOIN n ON e.doc_id = n.doc_id GROUP BY 1)
SELECT n.doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(k)) AS kept_sha256
FROM n JOIN kept ON n.doc_id = kept.doc_id
  LEFT JOIN (SELECT doc_id, sum(b - a) AS removed, count(*) AS spans FROM s GROUP BY 1) t ON n.doc_id = t.doc_id"""

SQL["op3_decontaminate"] = rf"""WITH d AS (SELECT doc_id, {_words(decontaminate.BETWEEN)} AS words FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_words(decontaminate.BETWEEN)} AS words FROM benchmark),
grams AS (SELECT DISTINCT item, l, list_slice(words, i, i + l - 1) AS g FROM (
  SELECT item, words, l, unnest(generate_series(1, len(words) - l + 1)) AS i
  FROM (SELECT *, least(len(words), {decontaminate.SIZE}) AS l FROM b WHERE len(words) > 0) q) q),
dg AS (SELECT doc_id, i, l, list_slice(words, i, i + l - 1) AS g FROM (
  SELECT doc_id, words, l, unnest(generate_series(1, len(words) - l + 1)) AS i FROM d, (SELECT DISTINCT l FROM grams) q) q),
hit AS (SELECT doc_id, i, dg.l, item FROM dg JOIN grams ON dg.g = grams.g AND dg.l = grams.l),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + l - 1)) AS p FROM hit) q GROUP BY 1),
items AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS s FROM hit GROUP BY 1)
SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered ON d.doc_id = covered.doc_id LEFT JOIN items ON d.doc_id = items.doc_id"""

SQL["op5_near_dedup"] = rf"""WITH RECURSIVE d AS (SELECT doc_id, {_words(line_dedup.SPACE)} AS words FROM documents),
g AS (SELECT DISTINCT doc_id, list_slice(words, i, i + 3) AS g FROM (
  SELECT doc_id, words, unnest(generate_series(1, greatest(1, len(words) - 3))) AS i FROM d WHERE len(words) > 0) q),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
reach(doc_id, met) AS (SELECT doc_id, doc_id FROM d UNION SELECT reach.doc_id, b FROM reach JOIN links ON met = a),
least_id AS (SELECT doc_id, min(met) AS component_id FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d JOIN least_id ON d.doc_id = least_id.doc_id LEFT JOIN n ON d.doc_id = n.doc_id"""

SQL["op7_line_dedup"] = rf"""WITH l AS (SELECT doc_id, x, i, trim(regexp_replace(x, '{line_dedup.SPACE}', ' ', 'g')) AS p FROM (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) q),
t AS (SELECT *, length(p) - length(replace(p, ' ', '')) + 1 AS n, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM l WHERE p <> ''),
c AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY k) AS c FROM t),
w AS (SELECT a.doc_id, a.k, b.k AS e FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.k BETWEEN a.k AND a.k + {line_dedup.MIN_WORDS - 1}
  AND b.c - a.c + a.n >= {line_dedup.MIN_WORDS} AND (b.c - a.c < {line_dedup.MIN_WORDS} OR b.c - b.n - a.c + a.n < {line_dedup.MIN_WORDS})),
content AS (SELECT w.doc_id, w.k, w.e, string_agg(p, chr(10) ORDER BY t.k) AS s FROM w JOIN t ON w.doc_id = t.doc_id AND t.k BETWEEN w.k AND w.e GROUP BY ALL),
later AS (SELECT doc_id, k, e FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY doc_id, k) AS place FROM content) q WHERE place > 1),
gone AS (SELECT DISTINCT t.doc_id, t.i FROM later JOIN t ON later.doc_id = t.doc_id AND t.k BETWEEN later.k AND later.e),
left_over AS (SELECT l.doc_id, count(*) AS n_lines, count(gone.i) AS n_removed, string_agg(x, chr(10) ORDER BY l.i) FILTER (WHERE gone.i IS NULL) AS kept
  FROM l LEFT JOIN gone ON l.doc_id = gone.doc_id AND l.i = gone.i GROUP BY 1)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN left_over o ON d.doc_id = o.doc_id"""

SQL["op8_nearest"] = f"""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_reduce(list_transform(generate_series(1, len(c.e)), lambda i: q.e[i] * c.e[i]), lambda a, b: a + b) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % {QUERY_STEP} = 0)
SELECT query_id, CAST(place AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM s) q WHERE place <= {NEIGHBOURS}"""

SQL["op12_ranked"] = f"""WITH d AS (SELECT doc_id, {_words(ranked.BETWEEN)} AS words FROM documents),
docs AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n FROM d WHERE len(words) > 0),
total AS (SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(n) AS BIGINT) AS l FROM docs),
q AS (SELECT item_id, t, count(*) AS times FROM (SELECT item_id, unnest({_words(ranked.BETWEEN)}) AS t FROM benchmark) x GROUP BY ALL),
p AS (SELECT doc_id, t, count(*) AS tf FROM (SELECT doc_id, unnest(words) AS t FROM d) x WHERE t IN (SELECT t FROM q) GROUP BY ALL),
w AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * total.n + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM p, total GROUP BY t, total.n),
m AS (SELECT doc_id, {ranked.BASE} + ({ranked.SLOPE} * docs.n * total.n) // l AS m FROM docs, total),
s AS (SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + {ranked.SATURATION} * m))) AS BIGINT) AS score
  FROM q JOIN p ON q.t = p.t JOIN w ON q.t = w.t JOIN m USING (doc_id) GROUP BY ALL)
SELECT item_id, CAST(place AS INTEGER) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS place FROM s WHERE score > 0) x WHERE place <= {FOUND}"""
