"""Probes and notes that meet by their rarest words: the same rows as by comparing all, and no text is shuffled."""

import re

import pytest
from pyspark.sql import functions as F

from notewell.functions.text import normalized, similarity_of
from notewell.operators import dedupe


def _notes(spark):
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda".split()
    texts = [" ".join(words[i % 5 : 5 + i % 7]) + (f" w{i % 4}" if i % 3 else "") for i in range(40)] + ["a b", "b a", "", "a b", "alpha", "Alpha!"]
    rows = [(i + 1, f"r{i % 2}", "general", t, 1000 + i * 7 % 31) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "row_id long, repo string, type string, note string, updated_at long").withColumn("note_normalized", normalized(F.col("note")))


def _probes(spark):
    rows = _notes(spark)
    return rows.select(F.concat(F.lit("p"), F.col("row_id")).alias("probe_id"), "repo", F.concat("note", F.lit(" w1")).alias("note")).unionByName(rows.select(F.concat(F.lit("q"), F.col("row_id")).alias("probe_id"), "repo", F.upper("note").alias("note")))


@pytest.mark.parametrize("sent", [10**6, 0])
def test_duplicates_equal_brute_force(spark, monkeypatch, sent):
    monkeypatch.setattr(dedupe, "SENT_CHARACTERS", sent)
    rows = _notes(spark)
    both = _probes(spark).withColumn("norm", normalized(F.col("note"))).where("norm <> ''").alias("p").join(rows.alias("m"), "repo")
    best = {}
    for r in both.select("probe_id", "m.row_id", "m.updated_at", (F.col("norm") == F.col("note_normalized")).alias("same"), similarity_of(F.col("norm"), F.col("note_normalized")).alias("s")).where("s >= 0.82").collect():
        key = (not r.same, -r.s, -r.updated_at, r.row_id)
        best[r.probe_id] = min(best.get(r.probe_id, key), key)
    got = {r.probe_id: (r.row_id, round(r.similarity, 9)) for r in dedupe.duplicates(_probes(spark), rows).collect()}
    assert got == {p: (k[3], round(-k[1], 9)) for p, k in best.items()}


def test_exact_repeats_meet_without_their_texts(spark):
    plan = dedupe.duplicates(_probes(spark), _notes(spark))._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"Join .*note_normalized", plan)


def test_texts_are_normalised_once(spark):
    """In one pass, and as in two: what is no letter or digit, then white space."""
    texts = spark.createDataFrame([(t,) for t in (" A-b\t\n c ", "É1 ß x", "---", "", "a\U0001f4ccb", "x  y\r\n", None)], "t string")
    two = F.trim(F.regexp_replace(F.regexp_replace(F.lower("t"), r"[^a-z0-9\s]", " "), r"\s+", " "))
    assert all(r.a == r.b for r in texts.select(normalized(F.col("t")).alias("a"), two.alias("b")).collect())
    assert normalized(F.col("t"))._jc.toString().count("regexp_replace") == 1
