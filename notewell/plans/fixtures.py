"""The test tables as notes, aliases, vectors and probes; each as a DataFrame and as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notewell.functions.text import normalized
from notewell.schema import TYPES

EPOCH = 1704067200
NOW = EPOCH + 1_000_000
DAY = "2026-06-26"

# Phrases that the invented prose lacks, dealt to notes by their number.
DATED = [
    "yesterday", "since today", "by tomorrow", "last week", "next week", "last month", "next month", "3 days ago", "in 2 months",
    "nothing", "12 weeks ago and in 10 days", "today, today", "007 days ago", "1 month ago", "in 1 week (in 1 week = 2026-07-03)", "someday",
]
CUED = [
    "Fixed the crash, root cause was a broken lock", "we decided to adopt jwt over session cookies", "always use tabs for indentation",
    "issue #42 blocks the release", "reviewers prefer small changes", "login token handling", "no longer deploy from /srv/api/auth_v2/main",
    "update vite.config.ts and README.md", "plain words only", "never remove the database migration", "style guide: use enums for states", "code review of the graphql schema",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    number = F.col("doc_id")
    kinds = F.array(*[F.lit(t) for t in TYPES])
    return docs.select(
        (number + 1).alias("row_id"),
        F.concat(F.lit("m-"), number.cast("string")).alias("id"),
        F.concat(F.lit("corpus/"), "lang").alias("repo"),
        F.element_at(kinds, (F.col("n_chars") % 6 + 1).cast("int")).alias("type"),
        F.col("text").alias("note"),
        F.concat(F.lit('["'), "lang", F.lit('","'), "source", F.lit('"]')).alias("tags"),
        (EPOCH + number).alias("created_at"),
        (EPOCH + number * 7919 % 100003).alias("updated_at"),
        F.when(number % 97 == 0, 1).otherwise(0).alias("pinned"),
        F.lit("{}").alias("metadata_json"),
        normalized(F.col("text")).alias("note_normalized"),
    )


def norm_sql(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(lower({x}), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g'))"


MEMORIES_SQL = f"""memories AS (SELECT doc_id + 1 AS row_id, concat('m-', doc_id) AS id, concat('corpus/', lang) AS repo,
 [{", ".join(f"'{t}'" for t in TYPES)}][n_chars % 6 + 1] AS type, text AS note, concat('["', lang, '","', source, '"]') AS tags,
 {EPOCH} + doc_id AS created_at, {EPOCH} + (doc_id * 7919) % 100003 AS updated_at, CASE WHEN doc_id % 97 = 0 THEN 1 ELSE 0 END AS pinned,
 '{{}}' AS metadata_json, {norm_sql("text")} AS note_normalized FROM documents)"""


def aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    langs = table(spark, sf_dir, "documents").select("lang").distinct()
    key = F.concat(F.lit("corpus/"), "lang")
    at = F.lit(EPOCH).cast("long").alias("created_at")
    return langs.select(F.col("lang").alias("alias"), key.alias("canonical"), at).unionByName(langs.select(key.alias("alias"), key.alias("canonical"), at))


ALIASES_SQL = f"""aliases AS (SELECT DISTINCT lang AS alias, concat('corpus/', lang) AS canonical, {EPOCH} AS created_at FROM documents
 UNION ALL SELECT DISTINCT concat('corpus/', lang), concat('corpus/', lang), {EPOCH} FROM documents)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select((F.col("vec_id") + 1).alias("memory_rowid"), F.lit(64).alias("dim"), F.lit(1000).alias("version"), F.col("embedding").alias("vector"), F.lit(EPOCH).cast("long").alias("updated_at"))


VECTORS_SQL = f"vectors AS (SELECT vec_id + 1 AS memory_rowid, 64 AS dim, 1000 AS version, embedding AS vector, {EPOCH} AS updated_at FROM embeddings)"


def query_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, vector): every vector whose number is divisible by 100."""
    return table(spark, sf_dir, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark text as an incoming note, once for each repo."""
    repos = F.explode(F.array(*[F.lit(f"corpus/{x}") for x in ("de", "en", "es", "fr")])).alias("repo")
    rows = table(spark, sf_dir, "benchmark").select("item_id", "text", repos)
    return rows.select(F.concat_ws(":", F.col("item_id").cast("string"), "repo").alias("probe_id"), "repo", F.col("text").alias("note"))


PROBES_SQL = """probes AS (SELECT concat(item_id, ':', r.repo) AS probe_id, r.repo, text AS note
 FROM benchmark, (SELECT unnest(['corpus/de', 'corpus/en', 'corpus/es', 'corpus/fr']) AS repo) r)"""


def own_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every note with a word more, as an incoming note of its own repo."""
    return memories(spark, sf_dir).select(F.col("id").alias("probe_id"), "repo", F.concat("note", F.lit(" indeed")).alias("note"))


def phrased(spark: SparkSession, sf_dir: str, phrases: list[str]) -> DataFrame:
    """(row_id, note): each text, whole, and one of the phrases."""
    dealt = F.element_at(F.array(*[F.lit(p) for p in phrases]), (F.col("doc_id") % len(phrases) + 1).cast("int"))
    return table(spark, sf_dir, "documents").select((F.col("doc_id") + 1).alias("row_id"), F.concat("text", F.lit(" "), dealt).alias("note"))


def phrased_sql(phrases: list[str]) -> str:
    quoted = ", ".join("'" + p.replace("'", "''") + "'" for p in phrases)
    return f"phrased AS (SELECT doc_id + 1 AS row_id, concat(text, ' ', [{quoted}][doc_id % {len(phrases)} + 1]) AS note FROM documents)"


def incoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What users say in conversations, as notes to remember, and every note that is there already, but for its case."""
    said = table(spark, sf_dir, "conversations").where("role = 'user'")
    repo = F.element_at(F.array(*[F.lit(f"corpus/{x}") for x in ("de", "en", "es", "fr")]), (F.col("conv_id") % 4 + 1).cast("int"))
    new = said.select((F.col("conv_id") * 1000 + F.col("turn")).alias("seq"), F.lit(None).cast("string").alias("id"), repo.alias("repo"), F.lit(None).cast("string").alias("type"), F.col("text").alias("note"), F.array(F.lit("Chat")).alias("tags"))
    old = memories(spark, sf_dir).select((-F.col("row_id")).alias("seq"), F.lit(None).cast("string").alias("id"), "repo", F.lit(None).cast("string").alias("type"), F.upper("note").alias("note"), F.array(F.lit("Again")).alias("tags"))
    return new.unionByName(old)
