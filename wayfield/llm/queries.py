"""The operators over their whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bloom_lm, bpe, exact, licenses, mixing, near, quality_model, repetition, toxicity, trie
from .shared import table


def op1_suffix_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that pass the repetition rule, with what it measured."""
    docs = repetition.passing(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", F.round("__repeats.covered_fraction", 6).alias("covered_fraction"), "__repeats.longest_repeat", "__repeats.n_repeats")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pre-tokens, unigram tokens and cost of each document."""
    return trie.counts(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "__counts.*")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that the machine finds toxic."""
    docs = table(spark, sf_dir, "documents")
    found = toxicity.toxic(docs.select("doc_id", "text"), toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", F.round("__toxic", 6).alias("p_toxic"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of one to eight lines that hold a licence template."""
    return licenses.scan(table(spark, sf_dir, "documents"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and log2 probability of each document under the corpus's own bigram model."""
    docs = bloom_lm.score(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)
    per_word = F.when(F.col("__lm.n_words") > 0, F.round(F.col("__lm.log2p") / F.col("__lm.n_words"), 6))
    return docs.select("doc_id", "__lm.n_words", per_word.alias("log2p_per_word"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of each document, and whether they decode to its bytes."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode(docs, check=True).select("doc_id", F.size("tokens").alias("n_tokens"), "tokens", "round_trip")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that stay, and how many have their text."""
    return exact.kept_with_copies(table(spark, sf_dir, "documents"))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The schedule: slots with their source, block, and the pieces of documents in it."""
    return mixing.schedule(table(spark, sf_dir, "documents"))


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of links of each document that has word-bigram Jaccard 0.6 or more with another one."""
    return near.linked(table(spark, sf_dir, "documents"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that the classifier selects, with expected grade and tail probability."""
    docs = table(spark, sf_dir, "documents")
    kept = quality_model.selected(docs.select("doc_id", "text"), quality_model.fit(docs, table(spark, sf_dir, "labels")))
    return kept.select("doc_id", F.round("__rating.expected_grade", 6).alias("expected_grade"), F.round("__rating.p_good", 6).alias("p_good"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_repetition": op1_suffix_repetition,
    "op2_bpe": op2_bpe,
    "op3_token_counts": op3_token_counts,
    "op4_toxicity": op4_toxicity,
    "op5_license_scan": op5_license_scan,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_source_mixing": op7_source_mixing,
    "op8_lm_scoring": op8_lm_scoring,
    "op9_ngram_jaccard_join": op9_ngram_jaccard_join,
    "op10_quality_classifier": op10_quality_classifier,
}

SQL: dict[str, str] = {
    "op5_license_scan": licenses.sql(),
    "op6_exact_dedup": """
SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY text
UNION ALL SELECT doc_id, 1 FROM documents WHERE text IS NULL""",
    "op7_source_mixing": r"""
WITH counted AS (
  SELECT doc_id, coalesce(source, '') AS source, md5('7|' || coalesce(doc_id::VARCHAR, '~')) AS h,
    CASE WHEN coalesce(length(text), 0) = 0 THEN 0 ELSE length(text) - length(regexp_replace(text, '[ \n\t\r]', '', 'g')) + 1 END AS n
  FROM documents),
placed AS (
  SELECT *, coalesce(sum(n) OVER (PARTITION BY source ORDER BY h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM counted),
totals AS (SELECT source, sum(n)::BIGINT AS tokens, power(sum(n)::DOUBLE, 0.8) AS w FROM counted GROUP BY source HAVING sum(n) > 0),
shares AS (
  SELECT source, tokens, ((tokens + 4095) // 4096)::BIGINT AS blocks, row_number() OVER (ORDER BY source DESC) AS back,
    sum(w) OVER (ORDER BY source ROWS UNBOUNDED PRECEDING) / sum(w) OVER () AS up_to FROM totals),
cuts AS (SELECT source, tokens, blocks, CASE WHEN back = 1 THEN 4294967296 ELSE floor(up_to * 4294967296)::BIGINT END AS high FROM shares),
bands AS (SELECT *, coalesce(lag(high) OVER (ORDER BY source), 0) AS low FROM cuts),
points AS (SELECT s AS slot, ((s + 1) * 2654435769) % 4294967296 AS point
  FROM (SELECT unnest(range((SELECT (max(blocks * 4294967296.0 / greatest(high - low, 1)) * 1.02)::BIGINT + 64 * count(*) + 65 FROM bands))) AS s)),
drawn AS (SELECT slot, source, blocks, row_number() OVER (PARTITION BY source ORDER BY slot) - 1 AS k FROM points JOIN bands ON point >= low AND point < high),
ends AS (SELECT max(slot) AS last FROM drawn WHERE k = blocks - 1),
slots AS (SELECT slot, source, k % blocks AS block, k // blocks AS epoch FROM drawn, ends WHERE slot <= last),
laps AS (
  SELECT p.source, doc_id, n, blocks * 4096 AS size, start + lap * tokens AS first
  FROM (SELECT *, unnest(range((blocks * 4096 - 1) // tokens + 1)) AS lap FROM bands) b JOIN placed p ON p.source = b.source AND n > 0),
pieces AS (
  SELECT source, doc_id, n, first, unnest(range(first // 4096, (least(first + n, size) - 1) // 4096 + 1)) AS block FROM laps WHERE first < size)
SELECT slot, s.source, s.block, epoch, doc_id, (greatest(s.block * 4096, first) - first)::BIGINT AS from_token, (least((s.block + 1) * 4096, first + n) - first)::BIGINT AS to_token
FROM slots s JOIN pieces p ON s.source = p.source AND s.block = p.block""",
    "op9_ngram_jaccard_join": r"""
WITH RECURSIVE words AS (
  SELECT DISTINCT doc_id, regexp_extract_all(lower(text), '[^\x00-/:-@\[-`{-\x7f]+') AS w FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
texts AS (
  SELECT DISTINCT doc_id, list_sort(list_distinct(CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END)) AS grams FROM words WHERE len(w) > 0),
entries AS (SELECT doc_id, dense_rank() OVER (ORDER BY grams) AS s, grams FROM texts),
sets AS (SELECT DISTINCT s, grams FROM entries),
grams AS (SELECT s, unnest(grams) AS g FROM sets),
common AS (SELECT l.s AS a, r.s AS b, count(*) AS n FROM grams l JOIN grams r ON l.g = r.g AND l.s < r.s GROUP BY ALL),
similar_sets AS (SELECT c.a, c.b FROM common c JOIN sets x ON x.s = c.a JOIN sets y ON y.s = c.b WHERE c.n / (len(x.grams) + len(y.grams) - c.n) >= 0.6),
near AS (SELECT a, b FROM similar_sets UNION ALL SELECT b, a FROM similar_sets UNION ALL SELECT s, s FROM sets),
reach(s, other) AS (SELECT a, b FROM near UNION SELECT r.s, n.b FROM reach r JOIN near n ON n.a = r.other),
classes AS (SELECT r.s, min(e.doc_id) AS class_id FROM reach r JOIN entries e ON e.s = r.other GROUP BY r.s)
SELECT e.doc_id, class_id, count(*) AS n_links
FROM entries e JOIN near n ON n.a = e.s JOIN entries o ON o.s = n.b AND o.doc_id <> e.doc_id JOIN classes c ON c.s = e.s
GROUP BY ALL""",
}
