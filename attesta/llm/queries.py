"""The operators over their whole tables (``opN_<name>``) and the corpus pipeline, with SQL twins where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

import corpus_pipeline
from attesta.llm import decontaminate, fm_index, html_text, kd_search, language, license_scan, mixing, multi_index, near_dedup, periodic_runs, pseudo_likelihood, suffix_sort, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def put(fn):
        QUERIES[fn.__name__] = fn
        if oracle:
            ORACLES[fn.__name__] = oracle
        return fn
    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h, strlen(coalesce(html, ''))::BIGINT AS n FROM pages),
d AS (SELECT h, max(page_id) AS r, list_reduce(list_transform(range(1, 41), lambda i: lpad(
        bin(instr('0123456789abcdef', h[i:i]) - 1), 4, '0')), lambda a, b: a || b) AS bits FROM p GROUP BY h)
SELECT page_id, n AS payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         list_sum(list_transform(range(0, 5), lambda j: CASE WHEN bits[5 * i + j + 1:5 * i + j + 1] = '1' THEN 1 << (4 - j) ELSE 0 END))::BIGINT + 1,
         1)), '') AS payload_digest,
       CASE WHEN page_id = r THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> r THEN r END AS refers_to
FROM p JOIN d USING (h)
""")
def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A WARC record per page, written, read back and identified by its payload."""
    return warc.archive_round_trip(table(spark, sf_dir, "pages"))


@query()
def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of every document that bring each source to its target."""
    return mixing.copies(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "copies", "rate")


@query(r"""
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS words FROM documents),
win AS (
  SELECT doc_id, i, md5(array_to_string(words[i:i + 34], ' ')) AS h
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 33)) AS i FROM d WHERE len(words) >= 35)),
rep AS (SELECT doc_id, i FROM win WHERE h IN (SELECT h FROM win GROUP BY h HAVING count(*) > 1)),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS j FROM rep),
g AS (SELECT doc_id, count(*) AS n, list(j) AS js FROM gone GROUP BY doc_id),
w AS (SELECT d.doc_id, j, words[j] AS word FROM (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS j FROM d) d
      ANTI JOIN gone USING (doc_id, j)),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY j) AS kept FROM w GROUP BY doc_id)
SELECT d.doc_id, len(words)::BIGINT AS n_words, coalesce(g.n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id) LEFT JOIN k USING (doc_id)
""")
def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words kept of every document once repeated 35-word windows are removed."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return fm_index.remove_repeated_words(docs, window=35).select("doc_id", "n_words", "n_removed", "kept_sha256")


@query()
def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes kept of every document once repeated 400-byte strings are removed."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_sort.remove_repeated_bytes(docs, window=400).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query(r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
             ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS g FROM d),
e AS MATERIALIZED (SELECT doc_id, md5(unnest(g)) AS h FROM s),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM e x JOIN e y ON x.h = y.h AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS MATERIALIZED (SELECT a, b FROM pairs JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b
                       WHERE 100 * n >= 80 * (len(x.g) + len(y.g) - n)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT s.doc_id, len(g)::BIGINT AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept
FROM s JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) c USING (doc_id)
""")
def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 4-word shingle sets are at least 80 % alike."""
    found = near_dedup.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, threshold_pct=80)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


@query("""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS q FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score
      FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
FROM s QUALIFY rank <= 20
""")
def op8_exact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 vectors of highest integer inner product with each query vector."""
    return kd_search.exact_top_k(table(spark, sf_dir, "embeddings"))


@query()
def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a passage within a fifth of word edits of a benchmark item, with the item."""
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query()
def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masked pseudo-likelihood of every document."""
    return pseudo_likelihood.score(table(spark, sf_dir, "documents"))


@query()
def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The visible text of every page."""
    return html_text.extract_text(table(spark, sf_dir, "pages")).select("page_id", "text", F.length("text").alias("n_chars"))


@query()
def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from four fifths of the labelled ones."""
    return language.identify(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")


def _license_labels() -> str:
    """SQL: a list with the label of each template whose regular expression matches ``joined`` (null for the others)."""
    return ", ".join(f"CASE WHEN regexp_matches(joined, '{license_scan.template_regex(wording)}') THEN '{label}' END"
                     for label, wordings in license_scan.TEMPLATES.items() for wording in wordings)


def _phrase_places(phrase: str) -> str:
    """SQL: the list of the places in ``words`` where the phrase stands, from 0."""
    here = " AND ".join(f"words[i + {k}] = '{w}'" for k, w in enumerate(phrase.split(), 1))
    return f"CASE WHEN contains(joined, ' {phrase} ') THEN list_filter(range(0, len(words)), lambda i: {here}) ELSE [] END"


_NAMED = ", ".join(f"CASE WHEN len({label}) > 0 THEN '{label}' END" for label in license_scan.PHRASES)


@query(rf"""
WITH w AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS words FROM documents),
j AS (SELECT *, ' ' || array_to_string(words, ' ') || ' ' AS joined FROM w),
p AS (SELECT doc_id, words, {', '.join(f'{_phrase_places(phrase)} AS {label}' for label, phrase in license_scan.PHRASES.items())},
             list_filter([{_license_labels()}], lambda x: x IS NOT NULL) AS found FROM j),
a AS (SELECT doc_id, len(words)::BIGINT AS n_words, {' || '.join(license_scan.PHRASES)} AS places, found,
             list_filter([{_NAMED}], lambda x: x IS NOT NULL) AS named FROM p)
SELECT doc_id, n_words, len(places)::BIGINT AS n_base, list_min(places) AS first_word, list_max(places) AS last_word,
       array_to_string(list_sort(named), ',') AS base_labels, array_to_string(list_sort(list_distinct(named || found)), ',') AS labels,
       CASE WHEN len(found) > 0 THEN 1.0::DOUBLE WHEN len(named) > 0 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS score
FROM a
""")
def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences named or quoted in every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return license_scan.scan_licenses(docs).drop("text", "places")


@query()
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words in every document, and the document without their repeats."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return periodic_runs.collapse_runs(docs, alter=True, with_text=False).drop("text")


@query("""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS alike, list_inner_product(a.q, b.q)::BIGINT AS score
                   FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE alike
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT alike AND 80 * positive_score <= 100 * score AND score <= positive_score QUALIFY rank <= 5
""")
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every anchor vector and each of its positives."""
    vectors = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label"))
    return multi_index.hard_negatives(vectors.withColumn("label", moved))


@query(corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus pipeline over all documents."""
    return corpus_pipeline.run(spark, sf_dir)
