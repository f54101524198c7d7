import zlib

import numpy as np

from notewell.llm import quality_cnn, samples, toxicity
from notewell.llm.samples import fold, labelled


def held(d, modulus, value):
    return zlib.crc32(str(d).encode()) % modulus == value


def test_only_training_rows_with_one_label(spark):
    docs = spark.createDataFrame([(d, f"text {d}") for d in range(200)] + [(7, "text 7"), (8, "another of 8"), (None, "none"), (300, None), (301, "text 1")], "doc_id long, text string")
    labels = spark.createDataFrame([(d, d % 2) for d in range(200)] + [(3, 0), (5, 1), (None, 1), (300, 0), (301, 1), (9, None), (10, 7)], "doc_id long, toxic int")
    got = labelled(docs, labels, "toxic", fold(5) != 0, 1000)
    wanted = {(f"text {d}", d % 2) for d in range(200) if not held(d, 5, 0) and d != 3}
    wanted |= {("another of 8", 0)} if not held(8, 5, 0) else set()
    assert {(r.text, r.label) for r in got.itertuples()} - {("text 1", 1)} == wanted - {("text 1", 1)}
    assert got["text"].is_unique


def test_the_sample_is_bounded(spark):
    docs = spark.createDataFrame([(d, "x" * 50 + str(d)) for d in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(d, d % 2) for d in range(400)], "doc_id long, toxic int")
    assert len(labelled(docs, labels, "toxic", fold(5) != 0, 20)) == 40
    few = labelled(docs, labels, "toxic", fold(5) != 0, 400, characters=520)
    assert few.groupby("label").size().tolist() == [10, 10] or few["text"].str.len().groupby(few["label"]).sum().max() <= 520
    assert labelled(docs.limit(0), labels, "toxic", fold(5) != 0, 20).empty and labelled(docs, labels.limit(0), "toxic", fold(5) != 0, 20).empty


def test_fits_learn_from_training_rows_alone(spark):
    """Labels of held-out rows are turned round: a fit that reads them gets the others wrong."""
    rng = np.random.default_rng(1)
    words = [f"word{k}" for k in range(80)]

    def text(toxic):
        return " ".join([*rng.choice(words, 12), *(["horrible", "nastiness"] if toxic else ["pleasant", "kindness"])])

    rows = [(d, text(d % 2)) for d in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(d, d % 2 if not held(d, 5, 0) else 1 - d % 2, d % 2 if not held(d, 3, 1) else 1 - d % 2) for d, _ in rows], "doc_id long, toxic int, quality int")
    for module, modulus, value in ((toxicity, 5, 0), (quality_cnn, 3, 1)):
        got = module.scored(docs, module.trained(docs, labels)).collect()
        assert all(r.held_out == held(r.doc_id, modulus, value) for r in got)
        assert np.mean([r.predicted == r.doc_id % 2 for r in got]) > 0.95


def test_one_label_or_none(spark):
    docs = spark.createDataFrame([(1, "some text"), (2, None), (None, "")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    assert [r.score for r in toxicity.scored(docs, toxicity.trained(docs, none)).collect()] == [0.0, 0.0, 0.0] or all(r.score < 1e-6 for r in toxicity.scored(docs, toxicity.trained(docs, none)).collect())
    assert all(0 <= r.score <= 1 for r in quality_cnn.scored(docs, quality_cnn.trained(docs, none)).collect())
    assert len(samples.unlike([])) == 0
