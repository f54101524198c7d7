"""A corpus pipeline: each stage's rows are written as Parquet and read again by the next.

Toxic documents go, then repeated lines, then all but one of each group of near
copies; personal data gets pseudonyms; what is left is packed into sequences.

Defined results: a null text is no toxic one and stays, through packing as one
end id; texts without words are in no group of copies; rows that share a
doc_id go or stay together in the near-duplicate stage, and each is packed;
rows without doc_id stay; extra columns are kept until packing; an empty table
gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notewell.llm import line_dedup, minhash, packing, pii, queries, toxicity
from notewell.llm.frames import shipped, written


def _sized(docs: DataFrame, like: DataFrame) -> DataFrame:
    """docs in like's columns, with n_chars, if there is one, brought in line with text."""
    if "n_chars" in like.columns:
        docs = docs.withColumn("n_chars", F.length("text").cast(like.schema["n_chars"].dataType))
    return docs.select(*like.columns)


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = shipped(spark).read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.clean(docs, toxicity.trained(docs, labels))


def remove_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _sized(line_dedup.without_repeats(docs, least=1), docs)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    shipped(spark)
    found = minhash.near_duplicates(docs.select("doc_id", "text"), words=5, percent=80)
    gone = written(found.where("NOT kept").select("doc_id").distinct())
    return docs.join(line_dedup.sent(gone), "doc_id", "left_anti").select(*docs.columns)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _sized(pii.pseudonymised(docs, queries.PII_KEY), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    shipped(spark)
    return packing.packed(docs.select("doc_id", "text"), f"{queries.TOKENIZERS}/byte_bpe_50k.json")


STAGES = [
    ("toxicity", remove_toxic),
    ("line dedup", remove_repeated_lines),
    ("minhash near-dedup", remove_near_duplicates),
    ("pii", replace_personal_data),
    ("best-fit packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, from documents."""
    docs = shipped(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
