"""Of a large group of near copies, few pairs are verified."""

from __future__ import annotations

import random

from notewell.llm import line_dedup

COPIES = 120


def _group():
    """One line of 40 words and copies of it in which two words are others."""
    rng = random.Random(7)
    base = [f"w{i}" for i in range(40)]
    rows = []
    for k in range(COPIES):
        words = list(base)
        for i in rng.sample(range(40), 2):
            words[i] = f"own{k}x{i}"
        rows.append((k, " ".join(words)))
    return rows


def test_pairs_of_a_group_do_not_all_meet(spark, monkeypatch):
    rows, seen, likely = _group(), [], line_dedup._likely

    def counted(pairs, *rest):
        seen.append(pairs.distinct().count())
        return likely(pairs, *rest)

    monkeypatch.setattr(line_dedup, "_likely", counted)
    found = {r["d"] for r in line_dedup.repeated_lines(spark.createDataFrame(rows, "doc_id long, text string"), 1).collect()}
    sets = [set(text.split()) for _, text in rows]
    similar = lambda a, b: 100 * len(a & b) >= line_dedup.PERCENT * len(a | b)
    assert found == {k for k in range(COPIES) if any(similar(sets[k], x) for x in sets[:k])}
    assert sum(seen) <= COPIES
