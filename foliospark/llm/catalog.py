"""The queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm import exact_dedup, flac, html_text, line_dedup, mixing, quality, sentencepiece, simhash, substring_dedup, toxicity
from foliospark.llm.common import table
from foliospark.sources.tables import text_table


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(text_table(spark, sf_dir, "documents"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(text_table(spark, sf_dir, "documents")).drop("kept_text")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = text_table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", "held_out", "score", "predicted", F.size("spans").alias("n_spans"), F.to_json("spans").alias("spans"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = text_table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.decisions(table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(text_table(spark, sf_dir, "documents"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece.encode_decode(text_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op8_flac_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flac.features(flac.pcm_blocks(flac.store(text_table(spark, sf_dir, "documents"))))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(text_table(spark, sf_dir, "pages"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(text_table(spark, sf_dir, "documents")).drop("kept_text")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_simhash_near_dedup, op2_substring_dedup, op3_toxicity, op4_quality, op5_exact_dedup, op6_mixing, op7_sentencepiece, op8_flac_media, op9_html_extraction, op10_line_dedup)}


OP5_SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER w = 1 AS kept,
       sha256(norm) AS text_sha256
FROM n
WINDOW w AS (PARTITION BY norm ORDER BY n DESC, doc_id NULLS LAST)
"""


OP2_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), starts AS (
  SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS i FROM w WHERE len(words) >= 50
), windows AS (
  SELECT doc_id, i, array_to_string(words[i:i + 49], ' ') AS s FROM starts
), first AS (
  SELECT s, min(doc_id) AS low FROM windows GROUP BY s HAVING min(doc_id) < max(doc_id)
), gone AS (
  SELECT doc_id, unnest(range(i, i + 50)) AS place FROM windows JOIN first USING (s) WHERE low < doc_id
), cover AS (
  SELECT doc_id, list(DISTINCT place) AS places FROM gone GROUP BY doc_id
), kept AS (
  SELECT w.doc_id, len(words) AS n_words, coalesce(len(places), 0) AS n_removed,
         CASE WHEN places IS NULL THEN words ELSE list_filter(words, lambda x, k: NOT list_contains(places, k)) END AS kept
  FROM w LEFT JOIN cover USING (doc_id)
)
SELECT doc_id, n_words, n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM kept
"""


OP10_SQL = r"""
WITH every AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS place
  FROM documents WHERE text <> ''
), solid AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY place) AS pos FROM every WHERE regexp_matches(line, '\S')
), pairs AS (
  SELECT doc_id, pos, line AS a, lead(line) OVER (PARTITION BY doc_id ORDER BY pos) AS b FROM solid
), later AS (
  SELECT doc_id, pos FROM (
    SELECT doc_id, pos, row_number() OVER (PARTITION BY a, b ORDER BY doc_id, pos) AS nth FROM pairs WHERE b IS NOT NULL
  ) WHERE nth > 1
), gone AS (
  SELECT doc_id, pos FROM later UNION SELECT doc_id, pos + 1 FROM later
), runs AS (
  SELECT doc_id, count(*) AS k FROM (
    SELECT doc_id, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM gone
  ) GROUP BY doc_id, run
), runs_by_doc AS (
  SELECT doc_id, sum(k) AS n_removed, count(*) AS n_runs, max(k) AS longest_run FROM runs GROUP BY doc_id
), kept AS (
  SELECT e.doc_id, string_agg(e.line, chr(10) ORDER BY e.place) AS text
  FROM every e LEFT JOIN solid s USING (doc_id, place) LEFT JOIN gone g ON g.doc_id = s.doc_id AND g.pos = s.pos
  WHERE g.pos IS NULL GROUP BY e.doc_id
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_lines, CAST(coalesce(r.n_removed, 0) AS BIGINT) AS n_removed,
       coalesce(r.n_runs, 0) AS n_runs, coalesce(r.longest_run, 0) AS longest_run, sha256(coalesce(k.text, '')) AS kept_sha256
FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n FROM solid GROUP BY doc_id) n USING (doc_id)
LEFT JOIN runs_by_doc r USING (doc_id) LEFT JOIN kept k USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op10_line_dedup": OP10_SQL, "op2_substring_dedup": OP2_SQL, "op5_exact_dedup": OP5_SQL}
