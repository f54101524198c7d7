"""The pipeline against plain forms of its stages, each on the stage's own input."""

import random
import re

import tokenizers

import corpus_pipeline
from notewell.llm import pii, queries, toxicity
from notewell.llm.frames import written


def made(seed=3):
    """Documents with toxic ones, repeated lines, copies, near copies and personal data."""
    rng = random.Random(seed)
    vocabulary = [f"word{k}" for k in range(400)]
    rows, labels = [], []
    for d in range(160):
        lines = [" ".join(rng.choices(vocabulary, k=rng.randint(6, 25))) for _ in range(rng.randint(1, 5))]
        toxic = d % 4 == 0
        if toxic:
            lines[0] += " horrible nastiness vilely"
        if d % 5 == 1:
            lines.append("All rights are reserved by the makers of this page")
        if d % 7 == 2:
            lines.append("write to ann.smith@mail.example.com soon")
        rows.append([d, "\n".join(lines)])
        labels.append((d, int(toxic)))
    for d in range(160, 190):
        words = rows[rng.randrange(1, 160)][1].split(" ")
        for _ in range(d % 3):
            words[rng.randrange(len(words))] = "changed"
        rows.append([d, " ".join(words)])
    rows += [[190, None], [191, ""], [192, "word1 " * 5000], [193, rows[5][1]]]
    return [(d, t, "en", f"s{d % 3}", len(t) if t is not None else None) for d, t in rows], labels


def kept_lines(rows):
    seen, out = [], {}
    for d, text in sorted(rows):
        left = []
        for line in text.split("\n") if text is not None else []:
            words = frozenset(w for w in re.split(r"[ \t\x0b\f\r]", line.lower()) if w)
            if not (words and any(100 * len(words & o) >= 80 * len(words | o) for o in seen)):
                left.append(line)
            seen.append(words)
        out[d] = "\n".join(left) if text is not None else None
    return out


def first_of_groups(rows):
    sets = {}
    for d, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
        sets[d] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    group = {d: d for d in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if a < b and group[a] != group[b] and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    group[a] = group[b] = min(group[a], group[b])
                    changed = True
    return {d for d in sets if group[d] == d}


def test_every_stage(spark, tmp_path):
    rows, labels = made()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    marked = spark.createDataFrame(labels, "doc_id long, toxic int")
    marked.write.parquet(f"{tmp_path}/labels.parquet")
    names, at, found = [n for n, _ in corpus_pipeline.STAGES], docs, []
    assert names == ["toxicity", "line dedup", "minhash near-dedup", "pii", "best-fit packing"]
    for name, stage in corpus_pipeline.STAGES:
        at = written(stage(spark, at, str(tmp_path)))
        found.append(at.collect())
        if name != names[-1]:
            assert at.columns == docs.columns and all(r.n_chars == (len(r.text) if r.text is not None else r.n_chars) for r in found[-1])
    clean, lines, apart, hidden, packed = found
    texts = [(r.doc_id, r.text) for r in clean]
    scores = {r.doc_id: r.predicted for r in toxicity.scored(docs, toxicity.trained(docs, marked)).collect()}
    assert sorted(d for d, _ in texts) == sorted(d for d, p in scores.items() if p == 0)
    assert {d for d, _ in texts} >= {d for d, t in labels if not t} and not {d for d, _ in texts} & {d for d, t in labels if t}
    assert {r.doc_id: r.text for r in lines} == kept_lines(texts)
    assert {r.doc_id for r in apart} == first_of_groups([(r.doc_id, r.text) for r in lines])
    assert all(r.text == dict((x.doc_id, x.text) for x in lines)[r.doc_id] for r in apart)
    mail = {re.search(r"to (\S+)", r.text)[1] for r in hidden if r.text and "write to" in r.text}
    assert len(mail) == 1 and "ann.smith" not in str(hidden) and pii.EMAIL
    library = tokenizers.Tokenizer.from_file(f"{queries.TOKENIZERS}/byte_bpe_50k.json")
    library.encode_special_tokens = True
    lengths = {r.doc_id: len(library.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in hidden}
    held, rooms = {}, {}
    for r in packed:
        held[r.doc_id] = held.get(r.doc_id, 0) + r.length
        rooms.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert held == lengths
    for parts in rooms.values():
        ends = 0
        for offset, length in sorted(parts):
            assert offset == ends
            ends += length
        assert ends <= 2048
    assert len(rooms) == -(-sum(lengths.values()) // 2048)
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in whole) == sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in packed)


def test_an_empty_table(spark, tmp_path):
    rows, labels = made()
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels[:0] or [], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
