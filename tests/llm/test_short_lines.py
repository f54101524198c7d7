import random
import re

import corpus_pipeline
from notewell.llm import line_dedup, queries


def brute(rows):
    """rows (doc_id, text) without the lines that resemble any line before them, however short."""
    seen, out = [], []
    for d, text in rows:
        if text is None:
            out.append((d, None))
            continue
        kept = []
        for line in text.split("\n"):
            words = frozenset(w for w in re.split(r"[ \t\x0b\f\r]", line.lower()) if w)
            if not (words and any(100 * len(words & o) >= 80 * len(words | o) for o in seen)):
                kept.append(line)
            seen.append(words)
        out.append((d, "\n".join(kept)))
    return out


def test_short_lines_go_too(spark, tmp_path):
    rng = random.Random(9)
    vocabulary = ["les", "all", "rights", "reserved.", "見出し本文全体", "a", "b", "c", "d"]
    rows = [(d, "\n".join(" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 8))) for _ in range(rng.randint(0, 4)))) for d in range(80)]
    rows += [(80, "Les."), (81, "one two three four"), (82, "one two three four five\nLES.\n\n"), (83, None), (84, "one two three\none two\n\n"), (85, "three two one\ntwo one four")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    wanted = brute(rows)
    assert dict(wanted)[82] == "\n" and dict(wanted)[85] == "two one four"
    assert sorted((r.doc_id, r.text) for r in queries.op2_line_dedup(spark, str(tmp_path)).collect() if r.text is not None) == [x for x in wanted if x[1] is not None]
    stage = corpus_pipeline.remove_repeated_lines(spark, docs, "")
    assert {r.doc_id: r.text for r in stage.collect()} == dict(wanted)


def test_names_of_other_columns_do_not_clash(spark):
    rows = [(1, "a b c d e f\nx", "p", 1.5, 7, True, 3), (2, "a b c d e f\ny", "q", 2.5, 8, False, 4), (2, "a b c d e f\ny", "q", 2.5, 8, False, 4), (None, None, "r", None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, d string, gone double, n_removed long, `at` boolean, version int")
    out = line_dedup.without_repeats(docs, least=1)
    assert out.columns == ["doc_id", "d", "gone", "at", "version", "text", "n_removed"]
    got = sorted(((r.doc_id or 0, r.d, r.gone, r.version, r.text, r.n_removed) for r in out.collect()), key=str)
    assert got == sorted([(0, "r", None, None, None, 0), (1, "p", 1.5, 3, "a b c d e f\nx", 0), (2, "q", 2.5, 4, "y", 1), (2, "q", 2.5, 4, "y", 1)], key=str)


def test_rows_of_one_number_with_other_texts(spark):
    rows = [(5, "first of all lines here\nsame words in both"), (5, "another begin of lines\nsame words in both"), (4, "Same\twords in  both"), (6, "")]
    out = line_dedup.without_repeats(spark.createDataFrame(rows, "doc_id long, text string"), least=1)
    assert sorted(r.text for r in out.collect()) == ["", "Same\twords in  both", "another begin of lines", "first of all lines here"]


def test_a_document_of_very_many_lines(spark):
    lines = [f"line number {k} of the long one {k % 500}" for k in range(20_000)]
    rows = [(1, "\n".join(lines)), (2, "\n".join(lines[::2] + ["its own last line, unlike them"]))]
    out = {r.doc_id: r for r in line_dedup.without_repeats(spark.createDataFrame(rows, "doc_id long, text string"), least=1).collect()}
    assert out[2].text == "its own last line, unlike them" and out[2].n_removed == 10_000 and out[1].n_removed == brute_count(lines)


def brute_count(lines):
    """Removed lines of one text, whose sets all have eight or nine words."""
    held, gone = {}, 0
    for line in lines:
        own = frozenset(line.split())
        near = set().union(*(held.get(own - {w}, set()) for w in own), held.get(own, set()))
        near |= {o for w in own for o in held.get(("without", own - {w}), set())}
        gone += any(100 * len(own & o) >= 80 * len(own | o) for o in near)
        held.setdefault(own, set()).add(own)
        for w in own:
            held.setdefault(("without", own - {w}), set()).add(own)
            held.setdefault(own - {w}, set()).add(own)
    return gone
