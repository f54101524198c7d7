import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from notewell.operators import context, vectors
from notewell.plans import catalog
from notewell.plans import fixtures as fx


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("vectors"))
    rng = random.Random(3)
    docs = [(i, " ".join(rng.choice(["of", "the", "and", "zebra", "lion"]) for _ in range(6)), rng.choice(["en", "fr"]), "web", i) for i in range(250)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    made = np.random.default_rng(3).normal(size=(250, 64)).astype(np.float32)
    made /= np.linalg.norm(made, axis=1, keepdims=True)
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(made)], "vec_id long, embedding array<float>").write.parquet(f"{path}/embeddings.parquet")
    return path


def test_every_hundredth_vector_is_asked(spark, folder):
    held = {r.vec_id: np.array(r.embedding) for r in fx.table(spark, folder, "embeddings").collect()}
    repo = {r.row_id: r.repo for r in fx.memories(spark, folder).collect()}
    wanted = {}
    for q in (0, 100, 200):
        for name in ("corpus/en", "corpus/fr"):
            near = sorted(((-float(v @ held[q]), i + 1) for i, v in held.items() if repo[i + 1] == name and v @ held[q] > 0))[:10]
            wanted |= {(q, name, k): i for k, (_, i) in enumerate(near, 1)}
    got = catalog.QUERIES["vector_knn"](spark, folder).collect()
    assert {(r.query_id, r.repo, r.place): r.row_id for r in got} == wanted


def test_each_query_has_its_own_context(spark, folder):
    rows = fx.memories(spark, folder)
    got = catalog.QUERIES["context_hybrid_rrf"](spark, folder).collect()
    assert {r.query_id for r in got} == {0, 100, 200}
    for q in (0, 100, 200):
        near = vectors.neighbours(fx.query_vector(spark, folder).where(F.col("query_id") == q), rows, fx.vectors(spark, folder), 64, 1000, 8)
        alone = context.assembled(rows, 8, context.fused(context.keyword_list(rows, f"{catalog.PHRASE} and", 8), near, 8)).collect()
        assert {(r.repo, r.place, r.row_id, r.source) for r in got if r.query_id == q} == {(r.repo, r.place, r.row_id, r.source) for r in alone}
    assert len({frozenset(r.row_id for r in got if r.query_id == q) for q in (0, 100, 200)}) == 3
