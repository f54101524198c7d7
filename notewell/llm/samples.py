"""Bounded samples of labelled documents, on which classifiers are fitted."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from notewell.llm.arrays import blocks
from notewell.llm.minhash import shingle_sets, signatures_of


def fold(modulus: int):
    """Remainder of the checksum of a doc_id's digits."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus


SAMPLE_CHARACTERS = 40_000_000
"""Of the texts with either label in a sample: 80 MB at most, or one longer text."""


def labelled(docs: DataFrame, labels: DataFrame, label: str, training, most: int, characters: int = SAMPLE_CHARACTERS) -> pd.DataFrame:
    """text and label of up to `most` training rows with either label, in the order of a hash of doc_id.

    Ids are chosen first, so the texts that travel are those of the sample; its
    last rows go, whole, if it has more than `characters`. Rows without label or
    doc_id, ids that have both labels, and repeated texts are left out.
    """
    rows = labels.select("doc_id", F.col(label).alias("label")).where("doc_id IS NOT NULL AND label IN (0, 1)").where(training)
    rows = rows.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other").drop("other")
    order = F.xxhash64(F.col("doc_id"), F.lit(label))
    ids = rows.where("label = 0").orderBy(order, "doc_id").limit(most).unionByName(rows.where("label = 1").orderBy(order, "doc_id").limit(most))
    found = docs.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(ids), "doc_id").withColumn("order", order)
    once = found.groupBy("doc_id", "label", "order", F.xxhash64("text").alias("version")).agg(F.count(F.lit(1)).alias("many"), F.max(F.length("text")).alias("size"))
    sofar = F.sum("size").over(Window.partitionBy("label").orderBy("order", "doc_id", "version").rowsBetween(Window.unboundedPreceding, -1))
    kept = once.withColumn("before", F.coalesce(sofar, F.lit(0))).where((F.col("before") == 0) | (F.col("before") + F.col("size") <= characters)).select("doc_id", "version")
    texts = found.withColumn("version", F.xxhash64("text")).join(F.broadcast(kept), ["doc_id", "version"], "left_semi").select("doc_id", "text", "label").dropDuplicates(["text"]).toPandas()
    return texts.sort_values(["doc_id", "text"]).reset_index(drop=True)


def unlike(texts: list[str], words: int = 3) -> np.ndarray:
    """Places of texts that are no near copy of an earlier one, by two MinHash symbols, so that copies don't count as evidence."""
    seen, out = set(), []
    for begin, end in blocks(texts):
        sets = shingle_sets(texts[begin:end], words)
        some = [i for i, s in enumerate(sets) if len(s)]
        symbols = signatures_of([sets[i] for i in some])[:, :4].copy().view(np.uint32).tolist() if some else []
        for i, (a, b) in zip(some, symbols, strict=True):
            if not seen & {(0, a), (1, b)}:
                out.append(begin + i)
            seen |= {(0, a), (1, b)}
    return np.array(out, np.int64)
