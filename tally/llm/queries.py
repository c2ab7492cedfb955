"""The dealt operators bound to the given tables.

``QUERIES`` maps a query name to a callable (spark, sf_dir) -> DataFrame;
``ORACLES`` holds DuckDB SQL for those that SQL can express on whole tables.
"""

from __future__ import annotations

import os
from fractions import Fraction

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import (
    decontaminate,
    embedding_dedup,
    filter_audit,
    hard_negatives,
    language_id,
    license_scan,
    line_dedup,
    ngram_jaccard,
    sentencepiece_codec,
    sharding,
    substring_dedup,
    toxicity,
    warc,
)

#: Vocabulary file of the encoding query; a parameter of the operator.
PIECE_MODEL = os.environ.get("TALLY_PIECE_MODEL") or public_tokenizers.path("piece_bpe_32k.model")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return sentencepiece_codec.round_trip(docs, "doc_id", "text", PIECE_MODEL)


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = license_scan.scan(docs, "doc_id", "text")
    base = F.filter("finds", lambda x: x["kind"] == "base")
    first = F.transform("_base", lambda x: x["first_word"])
    return found.withColumn("_base", base).select(
        "doc_id", "n_words", F.size("_base").cast("long").alias("n_base"),
        F.array_min(first).alias("first_word"), F.array_max(first).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("_base", lambda x: x["label"]))), ",")
        .alias("base_labels"),
        F.array_join("labels", ",").alias("labels"), "score")


#: A line on more than this share of a site's pages is boilerplate.
LINE_RATIO = 0.1


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    text = pages.select("page_id", line_dedup.url_host(F.col("url")).alias("host"),
                        line_dedup.visible_text(F.col("html")).alias("text"))
    text = cut_lineage(text)  # read twice: the HTML is parsed once
    return line_dedup.drop_boilerplate(text, "host", "text", LINE_RATIO)


def _html_sql(column: str) -> str:
    for pattern, new in line_dedup.VISIBLE_TEXT:
        column = f"regexp_replace({column}, '{pattern}', '{new}', 'g')"
    for name, char in line_dedup.REFERENCES:
        column = "replace({}, '{}', '{}')".format(column, name, char.replace("'", "''"))
    return column


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    models = language_id.learn(docs, "doc_id", "lang", "text")
    out = language_id.identify(docs, "doc_id", "text", models)
    held_out = F.coalesce(language_id.fold("doc_id") == 0, F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return ngram_jaccard.jaccard_components(docs, "doc_id", "text", n=4, similarity=Fraction(85, 100))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return embedding_dedup.near_duplicates(vectors, "vec_id", "embedding", threshold=0.95)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")
    return decontaminate.contaminated(docs, "doc_id", "text", items, "item_id", "text")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return substring_dedup.remove_repeated(docs, "doc_id", "text", width=20)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels, "doc_id", "text", "toxic")
    out = toxicity.score(docs, "doc_id", "text", model)
    held_out = F.coalesce(toxicity.fold("doc_id") == 0, F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    out = sharding.assign(docs, "doc_id", "text", shards=8)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"), "home")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(vectors.withColumn("label", label), "vec_id", "embedding", "label",
                               F.col("vec_id") % 50 == 0)


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = warc.write_archives(_table(spark, sf_dir, "pages"), "page_id", "url", "html", min_revisit_bytes=0)
    return warc.read_archives(spark, folder, with_payload=False).select(
        F.col("record_key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to", "error")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    marks = labels.select("doc_id", (F.col("quality") == 1).alias("_good"), (F.col("toxic") == 1).alias("_toxic"))
    return filter_audit.audit_documents(docs, "doc_id", "text", "source", marks,
                                        {"_good": "good_lost", "_toxic": "toxic_lost"})


QUERIES = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_ngram_jaccard": op2_ngram_jaccard,
    "op3_embedding_dedup": op3_embedding_dedup,
    "op4_decontaminate": op4_decontaminate,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_toxicity": op6_toxicity,
    "op7_sharding": op7_sharding,
    "op8_license_scan": op8_license_scan,
    "op9_line_dedup": op9_line_dedup,
    "op10_language_id": op10_language_id,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_warc": op12_warc,
    "op13_filter_audit": op13_filter_audit,
}

ORACLES: dict[str, str] = {
    "op9_line_dedup": f"""
WITH page AS (
  SELECT page_id, {_html_sql("html")} AS body,
         nullif(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1), '') AS host
  FROM pages),
line AS (
  SELECT page_id, host, unnest(string_split(body, chr(10))) AS line,
         unnest(range(len(string_split(body, chr(10))))) AS pos
  FROM page),
keyed AS (SELECT *, trim(line, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') AS bare FROM line),
common AS (
  SELECT host, bare FROM keyed JOIN (SELECT host, count(*) AS pages FROM page GROUP BY host) USING (host)
  WHERE bare <> '' GROUP BY host, bare, pages
  HAVING count(DISTINCT page_id) >= 3 AND count(DISTINCT page_id) > CAST({LINE_RATIO} AS DOUBLE) * pages),
judged AS (
  SELECT k.*, c.bare IS NOT NULL AS dropped FROM keyed k LEFT JOIN common c ON k.host = c.host AND k.bare = c.bare)
SELECT page_id, host, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '') AS "text",
       count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped
FROM judged GROUP BY page_id, host""",
    # Every anchor against all rows; ranks by window functions.
    "op11_hard_negatives": """
WITH whole AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM whole a JOIN whole b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)),
positive AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
fitting AS (
  SELECT p.anchor_id, p.positive_id, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score,
         CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS INT) AS "rank"
  FROM positive p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
   AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score)
SELECT anchor_id, positive_id, "rank", negative_id, positive_score, negative_score FROM fitting WHERE "rank" <= 3""",
    # A SHA-1's 40 hex digits are four groups of 40 bits, eight letters each.
    "op12_warc": """
WITH body AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex,
         octet_length(encode(coalesce(html, ''))) AS n FROM pages),
named AS (
  SELECT *, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         CAST((CAST('0x' || substr(hex, CAST(10 * (i // 8) + 1 AS INT), 10) AS BIGINT) >> CAST(35 - 5 * (i % 8) AS INT))
              & 31 AS INT) + 1, 1)), '') AS payload_digest,
         min(page_id) OVER (PARTITION BY html) AS oldest FROM body)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN page_id = oldest THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> oldest THEN oldest END AS refers_to, CAST(NULL AS VARCHAR) AS error
FROM named""",
    # Verdicts per document and five letters joined to all orders: no recursion.
    "op13_filter_audit": r"""
WITH body AS (
  SELECT d.doc_id, coalesce(d.source, '') AS part, coalesce(d.text, '') AS t,
         regexp_extract_all(coalesce(d.text, ''), '[^\x20\x09-\x0D]+') AS w,
         coalesce(l.quality = 1, false) AS good, coalesce(l.toxic = 1, false) AS bad
  FROM documents d LEFT JOIN labels l USING (doc_id)),
judged AS (
  SELECT part, good, bad, len(w) < 50 AS a, 100 * len(list_distinct(w)) < 65 * len(w) AS b,
         100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * len(t) AS c, regexp_matches(t, '[#$%&*|]') AS d,
         doc_id > min(doc_id) OVER (PARTITION BY t) AS e
  FROM body),
named AS (
  SELECT part, good, bad, (CASE WHEN a THEN 'A' ELSE '' END) || (CASE WHEN b THEN 'B' ELSE '' END)
         || (CASE WHEN c THEN 'C' ELSE '' END) || (CASE WHEN d THEN 'D' ELSE '' END)
         || (CASE WHEN e THEN 'E' ELSE '' END) AS fails
  FROM judged),
kind AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS n_good, count(*) FILTER (WHERE bad) AS n_bad
  FROM named GROUP BY part, fails),
letter AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT p.x || q.x || r.x || s.x || t.x AS filter_order FROM letter p, letter q, letter r, letter s, letter t
  WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5),
steps AS (
  SELECT filter_order, CAST(i AS INT) AS step, substr(filter_order, i, 1) AS letter, substr(filter_order, 1, i - 1) AS earlier
  FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS i)),
counted AS (
  SELECT part, filter_order, step, letter,
         CAST(sum(n) FILTER (WHERE translate(fails, earlier || letter, '') = fails) AS BIGINT) AS kept,
         CAST(sum(n) FILTER (WHERE contains(fails, letter) AND translate(fails, earlier, '') = fails) AS BIGINT) AS removed,
         CAST(sum(n) FILTER (WHERE contains(fails, letter) AND translate(fails, earlier, '') <> fails) AS BIGINT) AS redundant,
         CAST(sum(n) FILTER (WHERE fails = letter) AS BIGINT) AS unique_fails,
         CAST(sum(n_good) FILTER (WHERE contains(fails, letter) AND translate(fails, earlier, '') = fails) AS BIGINT) AS good_lost,
         CAST(sum(n_bad) FILTER (WHERE contains(fails, letter) AND translate(fails, earlier, '') = fails) AS BIGINT) AS toxic_lost
  FROM kind, steps GROUP BY ALL)
SELECT part, filter_order, step, coalesce(kept, 0) AS kept, coalesce(removed, 0) AS removed,
       coalesce(redundant, 0) AS redundant, coalesce(unique_fails, 0) AS unique_fails,
       coalesce(good_lost, 0) AS good_lost, coalesce(toxic_lost, 0) AS toxic_lost,
       CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
FROM counted""",
}
