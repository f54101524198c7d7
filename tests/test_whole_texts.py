import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from notewell.functions import inference, rules
from notewell.plans import catalog

FILLER = "plain words go here and there " * 40


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents whose finds all come after a long beginning."""
    path = str(tmp_path_factory.mktemp("whole"))
    rows = [(i, FILLER + "hotfix regression for graphql in deep/late_place.py since yesterday " + "zebra " * 90) for i in range(24)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    return path


def test_finds_behind_the_first_words(spark, folder):
    got = {name: catalog.QUERIES[name](spark, folder).orderBy("row_id").collect() for name in ("infer_type", "keyword_tags", "identifier_tags", "salient_words", "infer_tags", "resolve_dates", "ground_dates")}
    assert all(len(rows) == 24 for rows in got.values())
    assert all(r.type == "bug_fix" for r in got["infer_type"][8:9])  # dealt "plain words only"
    assert all("graphql" in r.tags.split("|") for r in got["keyword_tags"])
    assert all("late_place" in r.tags.split("|") for r in got["identifier_tags"])
    assert all(r.words.split("|")[0] == "zebra" for r in got["salient_words"])
    assert all("graphql" in r.tags.split("|") for r in got["infer_tags"])
    assert all("yesterday = 2026-06-25" in r.dates for r in got["resolve_dates"])
    assert all(FILLER in r.note and "yesterday = 2026-03-30" in r.note for r in got["ground_dates"])


def test_salient_words_against_brute_force(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice("ab_-/1") for _ in range(rng.randint(2, 6))) for _ in range(60)] + ["this", "with"]
    texts = [" ".join(rng.choice(words) for _ in range(n)) for n in (0, 1, 5, 400, 20_000)] + ["", None]
    place = str.maketrans("_-/", "\x01\x02\x03")

    def brute(text):
        if text is None:
            return None
        counts = Counter(w for w in text.split() if len(w) >= 4 and w not in rules.STOP_WORDS)
        return sorted(counts, key=lambda w: (-counts[w], w.translate(place)))[:8]

    rows = spark.createDataFrame(list(enumerate(texts)), "n int, text string").select("n", inference.salient_words(F.col("text")).alias("w")).collect()
    assert {r.n: r.w for r in rows} == {i: brute(t) for i, t in enumerate(texts)}
