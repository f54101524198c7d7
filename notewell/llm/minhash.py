"""Near-duplicate documents by a multi-index Hamming join of MinHash signatures.

A signature has 48 symbols of 16 bits. Pairs that differ in at most 23 of them
are all found: of twelve chunks of four symbols, one then has at most one
error, so each chunk is indexed with each of its symbols left out. Candidates
within that distance are confirmed on the full shingle sets. At the similarity
0.8 a symbol differs with probability 0.2, and more than 23 of 48 do with
probability under 1e-5.

Documents with the same set form a class and take part once. In each index
bucket all are compared with the bucket's first; then, of buckets whose
documents are still in several components, those of different components are
compared that share one of their rarest shingles, as linked ones must. So a
large group of near copies costs about its own size, and no link between
components is lost.

Defined results: a null text is the empty text; a document without words links
with nothing; rows that share a doc_id are one document, which has the links of
all its texts; rows without doc_id are in no component and are kept; an empty
table gives no rows; columns beside doc_id and text are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notewell.llm.arrays import blocks, in_parts, lowered_bytes, mix64, span_hashes, word_spans
from notewell.llm.frames import dropped, empty_text, written
from notewell.llm.graph import components

CHUNKS, WIDTH = 12, 4
SYMBOLS = CHUNKS * WIDTH
DISTANCE = 23
"""Most differing symbols; a chunk may then have DISTANCE // CHUNKS = 1 error."""
SENT_WHOLE = 500_000
"""Ids up to this number, 4 MB, are broadcast; more are joined by a shuffle."""

_U = np.uint64
_XOR = mix64(np.arange(1, SYMBOLS + 1, dtype=np.uint64))
_MULTIPLY = mix64(np.arange(1001, 1001 + SYMBOLS, dtype=np.uint64)) | _U(1)


def shingle_sets(texts: list[str], words: int) -> list[np.ndarray]:
    """The distinct hashes, sorted, of each text's runs of `words` words; of fewer words, one hash of all."""
    data, offsets = lowered_bytes(texts)
    starts, ends = word_spans(data, offsets)
    tokens = span_hashes(data, starts, ends)
    first = np.searchsorted(starts, offsets)
    runs = np.full(max(0, len(tokens) - words + 1), words, np.uint64)
    for k in range(words):
        runs = mix64(runs * _U(0x9E3779B97F4A7C15) + tokens[k : k + len(runs)])
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= words:
            out.append(np.unique(runs[a : b - words + 1]))
        elif b > a:
            whole = np.full(1, b - a, np.uint64)
            for k in range(a, b):
                whole = mix64(whole * _U(0x9E3779B97F4A7C15) + tokens[k : k + 1])
            out.append(whole)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signatures_of(sets: list[np.ndarray]) -> np.ndarray:
    """16-bit symbols, a row for each set; none may be empty."""
    joined = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), SYMBOLS), np.uint16)
    for k in range(SYMBOLS):
        out[:, k] = mix64(np.minimum.reduceat((joined ^ _XOR[k]) * _MULTIPLY[k], starts)) & _U(0xFFFF)
    return out


_SIGNED = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("key_a", pa.int64()), ("key_b", pa.int64()), ("signature", pa.binary())])


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, n_shingles, key_a, key_b, signature); the keys tell sets apart."""

    def run(batches):
        for batch in in_parts(batches):
            texts = batch.column(1).to_pylist()
            for i, j in blocks(texts):
                sets = shingle_sets(texts[i:j], words)
                some = [s for s in sets if len(s)]
                symbols = iter(signatures_of(some) if some else ())
                keys = [[int(mix64(s ^ _U(c)).sum(dtype=np.uint64).astype(np.int64)) for s in sets] for c in (0x5851F42D4C957F2D, 0x14057B7EF767814F)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array([len(s) for s in sets], pa.int64()), *(pa.array(k, pa.int64()) for k in keys), pa.array([next(symbols).tobytes() if len(s) else None for s in sets], pa.binary())],
                    schema=_SIGNED,
                )

    return docs.select("doc_id", empty_text().alias("text")).mapInArrow(run, "doc_id long, n_shingles long, key_a long, key_b long, signature binary")


def _keys(batches):
    """Every chunk of a signature with each of its symbols left out, as one number."""
    for batch in batches:
        n = batch.num_rows
        symbols = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(n, CHUNKS, WIDTH).astype(np.int64)
        out = np.empty((n, CHUNKS, WIDTH), np.int64)
        for left_out in range(WIDTH):
            key = np.broadcast_to(np.arange(CHUNKS) * WIDTH + left_out, (n, CHUNKS))
            for k in range(WIDTH):
                if k != left_out:
                    key = key << 16 | symbols[:, :, k]
            out[:, :, left_out] = key
        yield pa.RecordBatch.from_arrays([pa.array(out.ravel()), pa.array(np.repeat(np.asarray(batch.column(0)), SYMBOLS))], ["key", "node"])


def _near(batches):
    for batch in batches:
        a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint16).reshape(-1, SYMBOLS) for k in (2, 3))
        yield batch.filter(pa.array((a != b).sum(axis=1) <= DISTANCE)).select(["a", "b"])


def _within(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs(a, b) whose set sizes allow the similarity and whose signatures are near."""
    side = classes.select("node", "n_shingles", "signature")
    both = pairs.join(side.toDF("a", "n_a", "s_a"), "a").join(side.toDF("b", "n_b", "s_b"), "b")
    sized = both.where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    return sized.select("a", "b", "s_a", "s_b").mapInArrow(_near, "a long, b long")


def _sets(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """(node, shingles) of the documents in ids(doc_id)."""

    def run(batches):
        for batch in in_parts(batches):
            texts = batch.column(1).to_pylist()
            for i, j in blocks(texts):
                sets = [s.view(np.int64) for s in shingle_sets(texts[i:j], words)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(sets, pa.list_(pa.int64()))], ["node", "shingles"])

    few = F.broadcast(ids) if ids.count() <= SENT_WHOLE else ids
    return docs.select("doc_id", empty_text().alias("text")).join(few, "doc_id", "left_semi").mapInArrow(run, "node long, shingles array<long>")


def confirmed(pairs: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs(a, b) of doc_ids whose shingle sets are as similar as asked for."""
    pairs = written(pairs)
    ids = written(pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct())
    sets = written(_sets(docs, ids, words))
    both = pairs.join(sets.toDF("a", "s_a"), "a").join(sets.toDF("b", "s_b"), "b")
    shared = F.size(F.array_intersect("s_a", "s_b"))
    links = written(both.where(100 * shared >= percent * (F.size("s_a") + F.size("s_b") - shared)).select("a", "b"))
    for table in (pairs, ids, sets):
        dropped(table)
    return links


def _mixed(placed: DataFrame) -> DataFrame:
    """The rows of placed(key, component, ...) whose buckets have several components."""
    mixed = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("key")
    return placed.join(written(mixed), "key", "left_semi")


def _crowded(docs: DataFrame, nodes: DataFrame, words: int, percent: int) -> DataFrame:
    """(a, b): the pairs of nodes(node, component) in different components whose shingle sets allow the similarity.

    Each document's shingles are ordered, first those that no other component
    has, which no pair can share, then by rarity. Similar sets share one of the
    first ones, at a place that leaves enough behind it. So a document with
    many changes of its own meets no other, and a large group of such copies
    isn't compared pair by pair.
    """
    sets = written(_sets(docs, nodes.select(F.col("node").alias("doc_id")), words))
    each = sets.join(nodes, "node").select("node", "component", F.explode("shingles").alias("shingle"))
    spread = each.groupBy("shingle").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("many"))
    shared = written(spread.where("low <> high").select("shingle", "many"))
    ordered = each.join(shared, "shingle").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("many", "shingle"))).alias("shared"))
    sized = sets.select("node", F.size("shingles").cast("long").alias("n")).join(nodes, "node").join(ordered, "node")
    own = F.col("n") - F.size("shared")
    reach = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    first = sized.where(own < reach).select("node", "component", "n", own.alias("own"), F.posexplode(F.slice("shared", F.lit(1), (reach - own).cast("int"))).alias("at", "found"))
    postings = written(first.select(F.col("found.shingle").alias("shingle"), "node", "component", "n", (F.col("own") + F.col("at")).alias("place")))
    x, y = postings.alias("x"), postings.alias("y")
    n, m = F.col("x.n"), F.col("y.n")
    room = F.least(n - F.col("x.place"), m - F.col("y.place"))
    possible = (F.col("x.node") < F.col("y.node")) & (F.col("x.component") != F.col("y.component")) & (100 * F.least(n, m) >= percent * F.greatest(n, m)) & ((100 + percent) * room >= percent * (n + m))
    return x.join(y, (F.col("x.shingle") == F.col("y.shingle")) & possible).select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs(doc_id, text)."""
    signed = written(signatures(docs, words))
    grouped = signed.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("n_shingles", "key_a", "key_b")
    classes = written(grouped.agg(F.min("doc_id").alias("node"), F.first("signature").alias("signature")))
    keys = classes.select("node", "signature").mapInArrow(_keys, "key long, node long")
    buckets = written(keys.groupBy("key").agg(F.count(F.lit(1)).alias("many"), F.min("node").alias("a")).where("many > 1"))
    members = written(keys.join(buckets, "key"))
    spokes = members.where("node <> a").select("a", F.col("node").alias("b")).distinct()
    links = confirmed(_within(spokes, classes, percent), docs, words, percent)
    found = written(components(links))
    # Buckets of three and more whose documents are not all in one component.
    placed = members.where("many > 2").join(found, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
    nodes = written(_mixed(placed).select("node", "component").distinct())
    more = confirmed(_within(_crowded(docs, nodes, words, percent), classes, percent), docs, words, percent)
    found = components(links.unionByName(more))
    # Copies follow their class.
    of_class = classes.drop("signature").join(found, "node", "left").select("n_shingles", "key_a", "key_b", F.coalesce("component", "node").alias("component"))
    of_row = written(signed.drop("signature")).join(written(of_class), ["n_shingles", "key_a", "key_b"], "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
    return of_row.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
