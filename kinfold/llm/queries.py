"""The registered queries of the dealt operators. Each applies its operator to its whole table with production
parameters and derives the agreed columns from the operator's result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.llm import (
    collocations, decontaminate, language_model, licenses, mixing, ngram_join, pii, repeats, sharding, spelling, topk, toxicity, urls,
)
from kinfold.sources.shared import settle

MIX_SHARDS = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = language_model.score_texts(docs, language_model.in_training(F.col("doc_id")))
    return scored.select("row.doc_id", (~F.col("training")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op2_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = settle(mixing.sized(table(spark, sf_dir, "documents").select("doc_id", "source", "text")))
    mixed = mixing.mix(rows, MIX_SHARDS)
    return mixed.select(
        "row.doc_id", "size", "source_size", "target", mixing.taken().alias("taken"), F.size("draws").alias("n_pieces"),
        mixing.shard_words(MIX_SHARDS).alias("shard_words"),
    )


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.judged(decontaminate.find_contamination(docs, table(spark, sf_dir, "benchmark")))
    return found.select(
        "row.doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


def op5_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    sharded = sharding.shard_by_bytes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return sharded.select(
        "row.doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    labels = F.array_sort(F.array_distinct(F.concat("place_labels", F.transform("spans", lambda s: s["label"]))))
    return found.select(
        "row.doc_id", "n_words", F.col("n_places").alias("n_base"), F.col("first_place").alias("first_word"), F.col("last_place").alias("last_word"),
        F.array_join("place_labels", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), F.col("best").alias("score"),
    )


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").where(topk.usable(F.col("embedding")))
    vectors = rows.select("vec_id", topk.scaled(F.col("embedding")).alias("v"))
    return topk.top_products(vectors, F.col("vec_id") % 50 == 0)


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages").select("page_id", "url")).select("row.page_id", "host", "path", "rule", "verdict", "blocked")


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.find_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n_removed = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])
    return found.select("row.doc_id", "n_bytes", n_removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("row.doc_id", toxicity.held_out(F.col("row.doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = ngram_join.similar_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return grouped.select("row.doc_id", "n_shingles", "component_id")


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [pii.count_of("base", k).alias(f"n_{name}") for k, name in enumerate(pii.KINDS)]
    spans = pii.listed(F.array_sort(F.concat("base", "added"))).alias("spans")
    return found.select("row.doc_id", *counts, F.sha2(pii.listed(F.col("base")), 256).alias("base_sha256"), spans)


def op12_spelling_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variant_groups(spelling.damaged_words(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents").select("lang", "text"))


QUERIES = {
    "op1_lm_score": op1_lm_score,
    "op2_mix": op2_mix,
    "op3_topk": op3_topk,
    "op4_decontaminate": op4_decontaminate,
    "op5_shard": op5_shard,
    "op6_licenses": op6_licenses,
    "op7_urls": op7_urls,
    "op8_repeats": op8_repeats,
    "op9_toxicity": op9_toxicity,
    "op10_ngram_join": op10_ngram_join,
    "op11_pii": op11_pii,
    "op12_spelling_groups": op12_spelling_groups,
    "op13_collocations": op13_collocations,
}

_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_LETTER_WORDS = f"regexp_extract_all({_LOWERED}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP4_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {_LETTER_WORDS} AS w FROM documents),
items AS (SELECT item_id, {_LETTER_WORDS} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS m,
         unnest(list_transform(range(0, greatest(len(w) - 12, 1)), lambda i: array_to_string(w[i + 1:i + 13], ' '))) AS win
  FROM items WHERE len(w) > 0),
lengths AS (SELECT DISTINCT m FROM windows),
places AS (
  SELECT r, m, i, array_to_string(w[i + 1:i + m], ' ') AS win
  FROM (SELECT r, w, m, unnest(range(0, len(w) - m + 1)) AS i FROM docs, lengths WHERE len(w) >= m)),
found AS (SELECT r, item_id, p.m, i FROM places p JOIN windows USING (m, win)),
hits AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + m)) AS k FROM found) GROUP BY r),
named AS (
  SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS id FROM found WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN hits USING (r) LEFT JOIN named USING (r)
"""

OP3_SQL = """
WITH vectors AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
queries AS (SELECT min(r) AS r FROM vectors WHERE vec_id % 50 = 0 GROUP BY vec_id, v),
parts AS (SELECT r, vec_id, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM vectors),
products AS (
  SELECT q.r AS q, p.r AS p, q.vec_id AS query_id, p.vec_id, CAST(sum(q.x * p.x) AS BIGINT) AS score
  FROM parts q JOIN queries USING (r) JOIN parts p ON q.i = p.i AND q.vec_id <> p.vec_id GROUP BY ALL)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM products
QUALIFY rank <= 5
"""

OP10_SQL = f"""
WITH RECURSIVE docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWERED}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT r, unnest(CASE WHEN len(w) = 0 THEN []
    ELSE list_transform(range(0, greatest(len(w) - 3, 1)), lambda i: array_to_string(w[i + 1:i + 4], ' ')) END) AS s FROM docs),
sizes AS (SELECT r, count(*) AS n FROM shingles GROUP BY r),
links AS (
  SELECT a.r AS x, b.r AS y FROM shingles a JOIN shingles b ON a.s = b.s AND a.r <> b.r
  JOIN sizes na ON na.r = a.r JOIN sizes nb ON nb.r = b.r AND 100 * least(na.n, nb.n) >= 85 * greatest(na.n, nb.n)
  GROUP BY a.r, b.r, na.n, nb.n HAVING 100 * count(*) >= 85 * (na.n + nb.n - count(*))),
reached AS (SELECT r AS x, r AS y FROM docs UNION SELECT reached.x, links.y FROM reached JOIN links ON links.x = reached.y)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, min(o.doc_id) AS component_id
FROM docs d LEFT JOIN sizes USING (r) JOIN reached ON reached.x = d.r JOIN docs o ON o.r = reached.y
GROUP BY d.r, d.doc_id, n
"""

OP13_SQL = f"""
WITH pieces AS (
  SELECT row_number() OVER () AS r, coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWERED}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
numbered AS (SELECT row_number() OVER () AS p, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
sizes AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM numbered GROUP BY lang),
spans AS (SELECT lang, m, unnest(list_transform(range(0, len(w) - m + 1), lambda i: array_to_string(w[i + 1:i + m], ' '))) AS phrase
          FROM numbered, (VALUES (1), (2), (3)) AS t(m) WHERE len(w) >= m),
f AS (SELECT lang, m, phrase, count(*) AS n FROM spans GROUP BY ALL HAVING count(*) >= 10),
cuts AS (SELECT lang, m, phrase, n AS a, string_split(phrase, ' ') AS w, unnest(range(1, m)) AS k FROM f WHERE m > 1),
scored AS (
  SELECT c.lang, c.m, c.phrase, c.a, c.k, l.n AS l, r.n AS r, CAST((1000000::HUGEINT * c.a * c.a) // (l.n::HUGEINT * r.n) AS BIGINT) AS score
  FROM cuts c JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:c.k], ' ')
  JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[c.k + 1:c.m], ' ')
  QUALIFY row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY score, c.k) = 1),
longer AS (
  SELECT lang, phrase, max(a) AS a FROM (
    SELECT lang, n AS a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase
    FROM (SELECT lang, n, string_split(phrase, ' ') AS w FROM f WHERE m = 3)) GROUP BY ALL)
SELECT s.lang, row_number() OVER (PARTITION BY s.lang ORDER BY s.score DESC, s.a DESC, s.phrase) AS rank, s.phrase, s.a, s.l, s.r, z.n, s.score
FROM scored s JOIN sizes z ON z.lang = s.lang LEFT JOIN longer g ON g.lang = s.lang AND g.phrase = s.phrase
WHERE NOT coalesce(100 * g.a >= 50 * s.a, false)
QUALIFY rank <= 2000
"""

ORACLE_SQL: dict[str, str] = {"op3_topk": OP3_SQL, "op4_decontaminate": OP4_SQL, "op10_ngram_join": OP10_SQL, "op13_collocations": OP13_SQL}
