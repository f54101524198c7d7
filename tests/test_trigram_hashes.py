"""Short hashes and maps of words: no two trigrams fall together, and edges equal brute force."""

import itertools

from pyspark.sql import functions as F

from notewell.functions.text import normalized, short_hashes, similarity_of, trigrams
from notewell.operators import dedupe


def test_every_trigram_has_a_short_hash_of_its_own(spark):
    signs = "abcdefghijklmnopqrstuvwxyz0123456789 "
    every = spark.createDataFrame([("".join(t),) for t in itertools.product(signs, repeat=3)], "t string")
    assert every.select(F.explode(short_hashes(F.array("t"))).alias("h")).distinct().count() == len(signs) ** 3


def test_edges_equal_brute_force(spark):
    texts = [" ".join(f"word{(i // 6 * 50 + k) * (1 if k % 23 or i % 6 < 3 else 7 + i)}" for k in range(20 + i // 6 * 9)) for i in range(48)] + ["a b", "b a", "", "a", "x1 y1", "y1 x1"]
    rows = [(i + 1, f"r{i % 2}", "general", t, 1000 + i) for i, t in enumerate(texts)]
    notes = spark.createDataFrame(rows, "row_id long, repo string, type string, note string, updated_at long").withColumn("note_normalized", normalized(F.col("note")))
    a, b = notes.alias("a"), notes.alias("b")
    pairs = a.join(b, (F.col("a.repo") == F.col("b.repo")) & (F.col("a.row_id") > F.col("b.row_id")))
    want = {(r[0], r[1], round(r[2], 9)) for r in pairs.select("a.row_id", "b.row_id", similarity_of(F.col("a.note_normalized"), F.col("b.note_normalized")).alias("s")).where("s >= 0.85").collect()}
    found = dedupe.edges(notes)
    assert want and {(r.newer, r.older, round(r.similarity, 9)) for r in found.collect()} == want


def test_maps_sort_out_pairs_before_words_are_sent(spark):
    rows = spark.createDataFrame([(1, list(range(0, 6400, 7))), (2, list(range(3, 6400, 7))), (3, list(range(0, 6393, 7)))], "row_id long, w array<long>").withColumn("w", F.transform("w", lambda x: F.xxhash64(x))).withColumn("n", F.size("w"))
    met = spark.createDataFrame([(1, 2), (1, 3), (2, 3)], "x long, y long")
    assert [tuple(r) for r in dedupe._likely(met, rows, 0.72).collect()] == [(1, 3)]
