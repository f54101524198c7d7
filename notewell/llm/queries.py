"""The queries that apply each corpus operator to its whole table."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from notewell.llm.frames import shipped

TOKENIZERS = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")
"""The folder of the public tokenizers' files."""
PII_KEY = os.environ.get("PII_KEY", "a key for test tables")
"""The secret of the pseudonyms; set PII_KEY for real data."""


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return shipped(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from notewell.llm.media_chunks import media_columns

    return media_columns(_table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from notewell.llm.line_dedup import without_repeats

    return without_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"), least=1)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from notewell.llm.packing import packed

    return packed(_table(spark, sf_dir, "documents"), f"{TOKENIZERS}/byte_bpe_50k.json")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from notewell.llm.bpe import round_trips

    return round_trips(_table(spark, sf_dir, "documents"), f"{TOKENIZERS}/byte_bpe_multi_50k.tiktoken")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from notewell.llm.toxicity import scored, trained

    docs = _table(spark, sf_dir, "documents")
    return scored(docs, trained(docs, _table(spark, sf_dir, "labels")))


def op6_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    from notewell.llm.pii import found

    return found(_table(spark, sf_dir, "documents"), PII_KEY)


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from notewell.llm.minhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), words=4, percent=80)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from notewell.llm.quality_cnn import scored, trained

    docs = _table(spark, sf_dir, "documents")
    return scored(docs, trained(docs, _table(spark, sf_dir, "labels")))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from notewell.llm.html_extract import main_texts

    return main_texts(_table(spark, sf_dir, "pages"))


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from notewell.llm.ann import nearest

    return nearest(_table(spark, sf_dir, "embeddings"), every=50, k=5)


QUERIES = {
    f.__name__: f
    for f in (
        op1_media_chunks,
        op2_line_dedup,
        op3_best_fit_packing,
        op4_byte_bpe,
        op5_toxicity,
        op6_pii_pseudonyms,
        op7_near_duplicates,
        op8_quality,
        op9_html_extraction,
        op10_nearest_neighbours,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op2_line_dedup": r"""
WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS nr FROM documents WHERE text IS NOT NULL),
 sets AS (SELECT *, list_distinct(list_filter(regexp_split_to_array(lower(line), '[ \t\x0B\f\r]+'), lambda w: w <> '')) AS w FROM lines),
 filled AS (SELECT *, len(w) AS n, row_number() OVER (ORDER BY doc_id, nr) AS k FROM sets WHERE len(w) > 0),
 classes AS (SELECT list_sort(w) AS w, any_value(n) AS n, min(k) AS first FROM filled GROUP BY list_sort(w)),
 words AS (SELECT first, n, unnest(w) AS word FROM classes),
 rare AS (SELECT word, count(*) AS df FROM words GROUP BY word),
 prefix AS (SELECT first, n, word FROM words JOIN rare USING (word) QUALIFY row_number() OVER (PARTITION BY first ORDER BY df, word) <= n - (n * 80 + 99) // 100 + 1),
 met AS (SELECT DISTINCT y.first AS later, x.first AS earlier FROM prefix x JOIN prefix y ON x.word = y.word AND x.first < y.first AND 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n)),
 similar_ AS (SELECT DISTINCT later FROM met JOIN classes y ON y.first = later JOIN classes x ON x.first = earlier WHERE 180 * len(list_intersect(x.w, y.w)) >= 80 * (x.n + y.n)),
 gone AS (SELECT later AS k FROM similar_ UNION SELECT k FROM filled LEFT JOIN classes ON k = first WHERE first IS NULL),
 removed AS (SELECT doc_id, nr FROM filled JOIN gone USING (k)),
 kept AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY nr) AS text FROM lines ANTI JOIN removed USING (doc_id, nr) GROUP BY doc_id),
 counts AS (SELECT doc_id, count(*) AS n FROM removed GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text, coalesce(c.n, 0)::INT AS n_removed
FROM documents d LEFT JOIN kept k USING (doc_id) LEFT JOIN counts c USING (doc_id)""",
    "op7_near_duplicates": r"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
 sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
   ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(list_slice(w, i::INT, i::INT + 3), ' '))) END AS s FROM words),
 each AS (SELECT doc_id, unnest(s) AS x FROM sets),
 met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM each a JOIN each b USING (x) WHERE a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
 links AS (SELECT a, b FROM met JOIN sets p ON p.doc_id = a JOIN sets q ON q.doc_id = b WHERE 100 * n >= 80 * (len(p.s) + len(q.s) - n)),
 sides AS (SELECT a AS x, b AS y FROM links UNION ALL SELECT b, a FROM links),
 reach(node, low) AS (SELECT doc_id, doc_id FROM sets UNION SELECT y, low FROM reach JOIN sides ON x = node)
SELECT doc_id, len(any_value(s)) AS n_shingles, min(low) AS component_id, doc_id = min(low) AS kept FROM sets JOIN reach ON node = doc_id GROUP BY doc_id""",
}
