"""Text quality by a byte-level convolutional network in numpy.

Each byte has a learned vector and a mark that tells whether its word repeats
the one before. Learned filters run over them in steps of STEP bytes; a chunk's
features are the means of their outputs, mixed once, and the largest of each
feature over all overlapping chunks of the whole document make one probability.

Defined results: a null text is the empty text, which is one chunk of filling;
repeated rows give a row each; without labels of both kinds every score is 0.5;
an empty table gives no rows; columns beside doc_id and text are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notewell.llm.arrays import in_parts, offsets_of, span_hashes, word_spans
from notewell.llm.frames import empty_text
from notewell.llm.samples import fold, labelled

LEAST_STEPS = 300
"""Batches that a fit takes at least, so a small sample is gone over more often."""
SAMPLE = 700
"""Most training rows with either label."""
FOLDS = 3
CHUNK, OVERLAP, STEP, WIDTH = 512, 256, 4, 12
VECTOR, FILTERS, MIXED = 4, 16, 8
BLOCK = 1 << 18
FILLING = 256
_POSITIONS = (CHUNK - WIDTH) // STEP + 1


def inputs(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes with filling and marks of repeated words, of texts end to end, and the first chunk of each text (and the end)."""
    raw = [np.frombuffer(t.encode("utf-8", "surrogatepass"), np.uint8) for t in texts]
    chunks = [1 + max(0, -(-(len(r) - CHUNK) // OVERLAP)) for r in raw]
    at = offsets_of([(c + 1) * OVERLAP for c in chunks])
    data = np.full(int(at[-1]), FILLING, np.int16)
    for r, a in zip(raw, at[:-1].tolist(), strict=True):
        data[a : a + len(r)] = r
    solid = np.where(data == FILLING, 0x20, data).astype(np.uint8)
    starts, ends = word_spans(solid, at)
    words = span_hashes(solid, starts, ends)
    same = np.zeros(len(words), bool)
    same[1:] = words[1:] == words[:-1]
    text_of = np.searchsorted(at, starts, "right")
    same[1:] &= text_of[1:] == text_of[:-1]
    step = np.zeros(len(data) + 1, np.int8)
    step[starts[same]] = 1
    step[ends[same]] -= 1
    return data, np.cumsum(step[:-1], dtype=np.int8).astype(np.float32), offsets_of(chunks)


class Network:
    def __init__(self, seed: int = 0) -> None:
        rng = np.random.default_rng(seed)
        self.p = {
            "bytes": rng.normal(0, 0.5, (257, VECTOR)), "filters": rng.normal(0, 0.2, (WIDTH * (VECTOR + 1), FILTERS)), "filters_b": np.zeros(FILTERS),
            "mix": rng.normal(0, 0.4, (FILTERS, MIXED)), "mix_b": np.full(MIXED, 0.1), "out": rng.normal(0, 0.4, MIXED), "out_b": np.zeros(1),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def patches(self, data: np.ndarray, mark: np.ndarray) -> np.ndarray:
        """The network's input under each position of the filters."""
        x = np.empty((len(data), VECTOR + 1), np.float32)
        x[:, :VECTOR] = self.p["bytes"][data]
        x[:, VECTOR] = mark
        flat = np.concatenate([x.ravel(), np.zeros(WIDTH * (VECTOR + 1), np.float32)])
        view = np.lib.stride_tricks.as_strided(flat, (len(data) // STEP, WIDTH * (VECTOR + 1)), (4 * STEP * (VECTOR + 1), 4))
        return np.ascontiguousarray(view)

    def means(self, data: np.ndarray, mark: np.ndarray, first_chunk: np.ndarray) -> np.ndarray:
        """Mean output of each filter over each chunk."""
        out = np.maximum(self.patches(data, mark) @ self.p["filters"] + self.p["filters_b"], 0)
        # A text of c chunks has c + 1 halves; a chunk's positions lie in its two, but for the last that reach beyond it.
        per = OVERLAP // STEP
        halves = out.reshape(-1, per, FILTERS)
        whole = halves.sum(1)
        cut = halves[:, : _POSITIONS - per].sum(1)
        half = np.delete(np.arange(len(halves)), first_chunk[1:] + np.arange(1, len(first_chunk)) - 1)
        return (whole[half] + cut[half + 1]) / _POSITIONS

    def logits(self, texts: list[str]) -> np.ndarray:
        data, mark, first = inputs(texts)
        mixed = np.maximum(self.means(data, mark, first) @ self.p["mix"] + self.p["mix_b"], 0)
        return np.maximum.reduceat(mixed, first[:-1], axis=0) @ self.p["out"] + self.p["out_b"]

    def gradients(self, texts: list[str], label: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean log loss; it flows through the chunk that is largest in each feature."""
        data, mark, first = inputs(texts)
        means = self.means(data, mark, first)
        mixed = np.maximum(means @ self.p["mix"] + self.p["mix_b"], 0)
        top = np.maximum.reduceat(mixed, first[:-1], axis=0)
        z = top @ self.p["out"] + self.p["out_b"]
        slope = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - label) / len(texts)).astype(np.float32)
        g = {"out": top.T @ slope, "out_b": slope.sum(keepdims=True)}
        at_top = np.zeros_like(mixed)
        own = np.repeat(np.arange(len(texts)), np.diff(first))
        hit = mixed == top[own]
        for k in range(MIXED):
            chunk = np.flatnonzero(hit[:, k])
            chunk = chunk[np.searchsorted(own[chunk], np.arange(len(texts)))]
            at_top[chunk, k] = slope * self.p["out"][k]
        at_top *= mixed > 0
        g["mix"], g["mix_b"] = means.T @ at_top, at_top.sum(0)
        d_means = at_top @ self.p["mix"].T / _POSITIONS
        used = np.flatnonzero(np.abs(at_top).sum(1) > 0)
        begin = (used + own[used]) * OVERLAP
        index = begin[:, None] + np.arange(_POSITIONS) * STEP
        index = (index[:, :, None] + np.arange(WIDTH)).reshape(-1, WIDTH)
        x = np.concatenate([self.p["bytes"][data[index]], mark[index][:, :, None]], axis=2).reshape(len(index), -1)
        open_ = (x @ self.p["filters"] + self.p["filters_b"] > 0) * np.repeat(d_means[used], _POSITIONS, axis=0)
        g["filters"], g["filters_b"] = x.T @ open_, open_.sum(0)
        d_x = (open_ @ self.p["filters"].T).reshape(len(index), WIDTH, VECTOR + 1)
        flat = data[index].ravel()
        g["bytes"] = np.stack([np.bincount(flat, weights=d_x[:, :, k].ravel(), minlength=257) for k in range(VECTOR)], 1)
        return g


def fit(texts: list[str], label: np.ndarray, rounds: int = 5, batch: int = 32, seed: int = 0) -> Network:
    """Adam over batches; without labels of both kinds the network stays undecided."""
    net = Network(seed)
    if not len(label) or label.min() == label.max():
        net.p["out"] *= 0
        return net
    rng = np.random.default_rng(seed)
    m, v, t = {k: 0.0 for k in net.p}, {k: 0.0 for k in net.p}, 0
    parts = max(1, len(texts) // batch)
    rounds = max(rounds, LEAST_STEPS // parts)
    for r in range(rounds):
        for part in np.array_split(rng.permutation(len(texts)), parts):
            t += 1
            for k, g in net.gradients([texts[i] for i in part], label[part]).items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                rate = 0.01 * (0.5 if r >= rounds // 2 else 1) / (1 - 0.9**t) * np.sqrt(1 - 0.999**t)
                net.p[k] = (net.p[k] - rate * m[k] / (np.sqrt(v[k]) + 1e-8)).astype(np.float32)
    return net


def trained(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Network:
    """The network fitted to a bounded sample of the rows outside the held-out fold."""
    rows = labelled(docs, labels, "quality", fold(FOLDS) != 1, sample)
    return fit(rows["text"].tolist(), rows["label"].to_numpy(np.float32))


def scored(docs: DataFrame, net: Network) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs(doc_id, text)."""
    from notewell.llm.arrays import blocks

    def run(batches):
        for batch in in_parts(batches):
            texts = batch.column(1).to_pylist()
            logits = [net.logits(texts[i:j]) for i, j in blocks(texts, BLOCK)]
            score = 1 / (1 + np.exp(-np.clip(np.concatenate(logits).astype(float) if logits else np.zeros(0), -700, 700)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], ["doc_id", "score"])

    rows = docs.select("doc_id", empty_text().alias("text")).mapInArrow(run, "doc_id long, score double")
    return rows.select("doc_id", F.coalesce(fold(FOLDS) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
