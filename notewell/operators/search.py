"""Search with fallbacks: all words, any word, similar vectors, then the repo's context."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from notewell.operators import fts
from notewell.operators.context import assembled
from notewell.schema import in_range

ALL_WORDS, ANY_WORD, VECTORS, CONTEXT = 1, 2, 3, 4


def keyword_levels(queries: DataFrame, memories: DataFrame, limit: int) -> DataFrame:
    """(query_id, row_id, level, rank, place): rows with all words, and rows with any word, of queries(query_id, query, repo).

    A null repo searches all. Any-word matches need a query of several words.
    """
    found = fts.matches(queries, fts.query_words(F.col("query")), memories)
    scoped = found.join(queries.select("query_id", F.col("repo").alias("wanted")), "query_id").join(memories.select("row_id", "repo"), "row_id").where("wanted IS NULL OR wanted = repo")
    levels = scoped.where("matched = asked").withColumn("level", F.lit(ALL_WORDS)).unionByName(scoped.where("asked > 1").withColumn("level", F.lit(ANY_WORD)))
    order = Window.partitionBy("query_id", "level").orderBy("rank", "row_id")
    return levels.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit).select("query_id", "row_id", "level", "rank", "place")


def cascade(queries: DataFrame, memories: DataFrame, limit: int = 5, vectors: DataFrame | None = None) -> DataFrame:
    """(query_id, row_id, level, rank, place): each query's first level that has rows.

    vectors(query_id, repo, row_id, score, place) are nearest neighbours; they
    and the context count only for queries with a repo. All levels are one
    plan, so no query waits for another's.
    """
    in_range("limit", limit, 1, 50)
    levels = keyword_levels(queries, memories, limit)
    scoped = queries.where("repo IS NOT NULL").select("query_id", "repo")
    if vectors is not None:
        near = vectors.join(scoped, ["query_id", "repo"]).where(F.col("place") <= limit)
        levels = levels.unionByName(near.select("query_id", "row_id", F.lit(VECTORS).alias("level"), F.col("score").alias("rank"), "place"))
    context = assembled(memories.join(scoped.select("repo").distinct(), "repo", "left_semi"), limit)
    levels = levels.unionByName(scoped.join(context.select("repo", "row_id", "place"), "repo").select("query_id", "row_id", F.lit(CONTEXT).alias("level"), F.lit(0.0).alias("rank"), "place"))
    best = levels.groupBy("query_id").agg(F.min("level").alias("level"))
    return levels.join(best, ["query_id", "level"]).select("query_id", "row_id", "level", "rank", "place")
