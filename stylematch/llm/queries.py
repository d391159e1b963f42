"""The registered queries of this subpackage: each operator over its whole table, with its digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stylematch.llm import chat, collocations, decontaminate, fingerprints, html_text, line_dedup, mixing, near_dedup, quality, repair, secret_scan, vectors, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _register(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_register
def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the size of its shingle set and its group of near-duplicates."""
    found = near_dedup.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.withColumn("kept", F.col("doc_id") == F.col("component_id"))


@_register
def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its secrets: counts and digest of the fixed patterns, and all spans."""
    found = secret_scan.find_secrets(_table(spark, sf_dir, "documents"))
    told = "s -> concat_ws(':', s.kind, s.start, s.end)"
    counts = [F.expr(f"CAST(size(filter(spans, s -> s.kind = '{k}')) AS BIGINT)").alias(f"n_{k}") for k in secret_scan.KINDS]
    base = F.expr(f"sha2(array_join(transform(filter(spans, s -> s.kind <> 'novel'), {told}), ','), 256)").alias("base_sha256")
    return found.select("doc_id", *counts[:3], base, F.expr(f"array_join(transform(spans, {told}), ',')").alias("spans"), counts[3])


@_register
def op5_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint, that of its edited text, and the likeness to that and to the next document."""
    return fingerprints.fingerprint_edits(_table(spark, sf_dir, "documents"))


@_register
def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality score, learnt from the labels that are not held out."""
    docs = _table(spark, sf_dir, "documents")
    return quality.score_documents(docs, quality.train(docs, _table(spark, sf_dir, "labels")))


@_register
def op4_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The article of every page."""
    return html_text.extract_pages(_table(spark, sf_dir, "pages"))


@_register
def op8_warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as it is read back from normalised archives."""
    return warc.archive_pages(_table(spark, sf_dir, "pages")).drop("url")


@_register
def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its source's target and the words that the mix takes from it."""
    mixed = mixing.taken_words(*mixing.mix_sources(_table(spark, sf_dir, "documents")))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source")


@_register
def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that match an earlier line."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.drop_similar_lines(docs, count="n_removed").withColumn("n_lines", F.size(F.split("text", "\n")).cast("long"))


@_register
def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs of a document and a benchmark item that it holds."""
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@_register
def op9_chat_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The maximal conversations, rendered."""
    return chat.collapse_and_render(_table(spark, sf_dir, "conversations"))


@_register
def op11_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector with the number of its links and its component."""
    found = vectors.link_vectors(_table(spark, sf_dir, "embeddings"))
    return found.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


@_register
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, damaged by a checksum rule: its faults and the cheapest repair."""
    return repair.repair_report(repair.damage(_table(spark, sf_dir, "conversations")))


@_register
def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best phrases of every language."""
    return collocations.collocations(_table(spark, sf_dir, "documents"))


ORACLES["op9_chat_snapshots"] = """
WITH turns AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS place,
    count(*) OVER (PARTITION BY conv_id) AS n_turns,
    string_agg(md5(role || chr(1) || text), '') OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS prefix
  FROM turns
), kept AS (
  SELECT min(conv_id) AS conv_id, n_turns, count(*) AS copies FROM placed
  WHERE place = n_turns AND prefix NOT IN (SELECT prefix FROM placed WHERE place < n_turns)
  GROUP BY prefix, n_turns
)
SELECT conv_id, turn // 256 AS part, n_turns, copies,
  string_agg('<|' || role || '|>' || chr(10) || text || chr(10) || '<|end|>' || chr(10), '' ORDER BY turn, role, text) AS text
FROM kept JOIN turns USING (conv_id) GROUP BY conv_id, turn // 256, n_turns, copies
"""

ORACLES["op11_embedding_near_dedup"] = """
WITH RECURSIVE vectors AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
), sound AS (
  SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS length FROM vectors
  WHERE v IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM sound a JOIN sound b
  ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_dot_product(a.v, b.v) / (a.length * b.length) >= 0.9
), reach(vec_id, other) AS (
  SELECT vec_id, vec_id FROM vectors UNION SELECT r.vec_id, l.b FROM reach r JOIN links l ON r.other = l.a
), least AS (
  SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id
)
SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM least
"""

ORACLES["op13_phrase_collocations"] = """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, doc_id, row_number() OVER () AS piece, words FROM (
    SELECT lang, doc_id, list_filter(regexp_split_to_array(p, '[ \t]+'), lambda w: w <> '') AS words FROM (
      SELECT lang, doc_id, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\x0B\f\r]')) AS p FROM documents))
), counts AS (
  SELECT lang, k, phrase, count(*) AS f FROM (
    SELECT lang, k, unnest(list_transform(range(1, len(words) - k + 2), lambda i: array_to_string(words[i:i + k - 1], ' '))) AS phrase
    FROM pieces, (SELECT unnest([1, 2, 3]) AS k) WHERE len(words) >= k)
  GROUP BY lang, k, phrase
), totals AS (
  SELECT lang, sum(f) AS n FROM counts WHERE k = 1 GROUP BY lang
), candidates AS (
  SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM counts WHERE k > 1 AND f >= 10
), cuts AS (
  SELECT c.lang, c.k, c.phrase, c.a, cut, l.f AS l, r.f AS r, (1000000::HUGEINT * c.a * c.a) // (l.f::HUGEINT * r.f) AS score
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM candidates) c
  JOIN counts l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:cut], ' ')
  JOIN counts r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[cut + 1:], ' ')
), scored AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), inner_ AS (
  SELECT lang, phrase, max(a) AS longer FROM (
    SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase FROM candidates WHERE k = 3) GROUP BY lang, phrase
), kept AS (
  SELECT s.* FROM scored s LEFT JOIN inner_ i USING (lang, phrase) WHERE i.longer IS NULL OR 100 * i.longer < 50 * s.a
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM kept JOIN totals USING (lang) QUALIFY rank <= 2000
"""
