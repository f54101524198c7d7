import random

import pytest
from pyspark.sql import functions as F

from notewell.plans import catalog
from notewell.plans import fixtures as fx


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("probes"))
    rng = random.Random(2)
    texts = [" ".join(rng.choice("abcdefgh") * rng.randint(2, 6) for _ in range(rng.randint(8, 20))) for _ in range(24)]
    docs = [(i, t, "en", "web", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    said = [(i, 0, "user", t) for i, t in enumerate(["ship it yesterday", "Today we ship", "tomorrow then", "no day at all"])]
    spark.createDataFrame(said, "conv_id long, turn int, role string, text string").write.parquet(f"{path}/conversations.parquet")
    return path


def grams(norm):
    return {f" {norm} "[i : i + 3] for i in range(len(norm))} if norm else set()


def rating(a, b):
    over = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
    words = lambda t: {w for w in t.split() if len(w) >= 2}
    return 1.0 if a == b else 0.55 * over(words(a), words(b)) + 0.45 * over(grams(a), grams(b))


def test_every_note_is_looked_up(spark, folder):
    notes = {r.row_id: r for r in fx.memories(spark, folder).collect()}
    newest = sorted(notes.values(), key=lambda r: (-r.updated_at, r.row_id))
    wanted = {}
    for r in notes.values():
        for probe, norm in ((r.id, r.note_normalized + " indeed"), (f"{r.id}:upper", r.note_normalized)):
            rated = [(round(rating(norm, m.note_normalized), 6), m.row_id) for m in newest]
            best = max(rated, key=lambda x: x[0])
            if best[0] >= 0.82:
                wanted[probe] = best[::-1]
    got = catalog.QUERIES["find_duplicate"](spark, folder).collect()
    assert len(got) == len(wanted) > 40 and {r.probe_id: (r.row_id, r.similarity) for r in got} == wanted


def test_every_note_is_remembered_again(spark, folder):
    assert fx.incoming(spark, folder).where("seq < 0").count() == 24
    after = catalog.QUERIES["remember_batch"](spark, folder).collect()
    assert len(after) == 28 and sum(r.n_changes > 0 and '"again"' in r.tags for r in after) == 24


def test_messages_with_days_are_stored(spark, folder):
    after = catalog.QUERIES["insert_memory"](spark, folder).where(F.col("updated_at") == fx.NOW).collect()
    assert {r.note for r in after} == {
        "ship it yesterday today (yesterday = 2026-06-25; today = 2026-06-26)", "Today we ship today (today = 2026-06-26)",
        "tomorrow then today (today = 2026-06-26; tomorrow = 2026-06-27)", "no day at all today (today = 2026-06-26)",
    }
