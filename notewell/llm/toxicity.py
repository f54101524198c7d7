"""Toxicity by a factorization machine over hashed terms.

Terms are a window's words and their first letters, hashed to 64 bits. A term
has a weight and a vector, and every pair of terms in a window adds the product
of their vectors, so an insult beside a group's name can weigh more than both
alone. A document is as toxic as its worst window of two runs of RUN words, so
its length neither hides nor makes toxicity.

Defined results: a null or wordless text has the score of an empty window;
repeated rows give a row each; without labels of both kinds every score is 0;
an empty table gives no rows; columns beside doc_id and text are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notewell.llm.arrays import LETTER, blocks, classes, code_points, in_parts, mix64, offsets_of, span_hashes
from notewell.llm.frames import empty_text
from notewell.llm.samples import fold, labelled, unlike

SAMPLE = 3000
"""Most training rows with either label."""
TERMS, FACTORS, RUN = 8192, 4, 24
FIRST_LETTERS = (4, 5)
LEAST_STEPS = 300
"""Batches that a fit takes at least, so a small sample is gone over more often."""
FOLDS = 5
SURPRISE = 4.5
"""Standard deviations by which a term's toxic texts must differ from chance: of a million rare terms, hardly one does."""
PAIRED = 512
"""The most frequent terms, of which each pair is tested too: a term that says nothing alone may do so beside another."""

_U = np.uint64


def terms_of(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Hashes of words and of their beginnings, the run of each word, and the first run of each text (and the end)."""
    lowered = [t.lower() for t in texts]
    points = code_points("".join(lowered))
    offsets = offsets_of([len(t) for t in lowered])
    letter = np.zeros(len(points) + 2, bool)
    letter[1:-1] = classes(points) == LETTER
    first = np.zeros(len(points) + 1, bool)
    first[offsets] = True
    starts = np.flatnonzero(letter[1:-1] & (~letter[:-2] | first[:-1]))
    ends = np.flatnonzero(letter[1:-1] & (~letter[2:] | first[1:])) + 1
    terms = [span_hashes(points, starts, ends)]
    terms += [span_hashes(points, starts, np.minimum(ends, starts + k)) ^ _U(0x5BD1E995 + k) for k in FIRST_LETTERS]
    bounds = np.searchsorted(starts, offsets)
    runs = np.maximum(1, -(-np.diff(bounds) // RUN))
    first_run = offsets_of(runs)
    text_of = np.repeat(np.arange(len(texts)), np.diff(bounds))
    run = first_run[text_of] + (np.arange(len(starts)) - bounds[text_of]) // RUN
    return terms, run, first_run


@dataclass
class Machine:
    """hashes: the known terms, sorted. weights and vectors: a row for each."""

    hashes: np.ndarray
    weights: np.ndarray
    vectors: np.ndarray
    bias: float

    def __post_init__(self) -> None:
        self.known = np.zeros(1 << 20, bool)
        self.known[(self.hashes & _U((1 << 20) - 1)).astype(np.int64)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in `hashes` of known terms, and their rows."""
        maybe = np.flatnonzero(self.known[(hashes & _U((1 << 20) - 1)).astype(np.int64)])
        if not len(maybe) or not len(self.hashes):
            return maybe[:0], maybe[:0]
        row = np.minimum(np.searchsorted(self.hashes, hashes[maybe]), len(self.hashes) - 1)
        hit = self.hashes[row] == hashes[maybe]
        return maybe[hit], row[hit]

    def events(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Run and row of every known term, once a run, and the first run of each text (and the end)."""
        terms, run, first_run = terms_of(texts)
        size = max(1, len(self.hashes))
        once = np.unique(np.concatenate([run[place] * size + row for place, row in map(self.find, terms)]))
        return once // size, once % size, first_run

    def window_logits(self, run: np.ndarray, row: np.ndarray, first_run: np.ndarray) -> np.ndarray:
        """The machine's value of each window: a run and the text's next."""
        n = int(first_run[-1])

        def over(values):
            sums = np.bincount(run, weights=values, minlength=n + 1)
            sums[:-1] += np.where(last, 0, sums[1:])
            return sums[:-1]

        last = np.zeros(n, bool)
        last[first_run[1:] - 1] = True

        out = self.bias + over(self.weights[row])
        for k in range(self.vectors.shape[1]):
            v = self.vectors[row, k]
            out += 0.5 * (over(v) ** 2 - over(v * v))
        return out

    def logits(self, texts: list[str]) -> np.ndarray:
        run, row, first_run = self.events(texts)
        return _worst(self.window_logits(run, row, first_run), first_run)[0]


def _worst(values: np.ndarray, first_run: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The largest value of each text's windows, and where."""
    best = np.maximum.reduceat(values, first_run[:-1])
    at = np.flatnonzero(values == np.repeat(best, np.diff(first_run)))
    return best, at[np.searchsorted(at, first_run[:-1])]


def _in_pairs(texts: list[str], label: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """The frequent hashes that, beside some other in a window, differ from chance by more than either does alone.

    Windows count by the share of their text, so long texts weigh no more than short ones.
    """
    rate = float(label.mean())
    both = np.zeros((2, len(frequent), len(frequent)))
    own = Machine(frequent, np.zeros(len(frequent)), np.zeros((len(frequent), 0)), 0.0)
    for i, j in blocks(texts, 1 << 18):
        run, row, first_run = own.events(texts[i:j])
        many = np.diff(first_run)
        window = np.zeros((int(first_run[-1]), len(frequent)), np.float32)
        window[run, row] = 1
        inner = np.ones(len(window), bool)
        inner[first_run[1:] - 1] = False
        window[:-1][inner[:-1]] = np.maximum(window[:-1], window[1:])[inner[:-1]]
        share = np.repeat(1 / many, many).astype(np.float32)[:, None]
        both[0] += window.T @ (window * share)
        both[1] += window.T @ (window * share * np.repeat(label[i:j], many).astype(np.float32)[:, None])
    surprise = np.abs(both[1] - rate * both[0]) / np.sqrt(rate * (1 - rate) * np.maximum(both[0], 1e-9))
    alone = np.diag(surprise)
    beyond = (surprise - np.maximum(alone[:, None], alone)) * (surprise >= SURPRISE + 1)
    return frequent[(beyond >= 1).any(axis=1)]


def fit(texts: list[str], label: np.ndarray, rounds: int = 30, seed: int = 0) -> Machine:
    """Terms whose texts' labels differ from chance, alone or in pairs, are kept; then each text's worst window is fitted by AdaGrad."""
    none = Machine(np.zeros(0, np.uint64), np.zeros(0), np.zeros((0, FACTORS)), -100.0)
    positives = int(label.sum())
    if not positives or positives == len(label):
        return none
    hashes, with_it, toxic = np.zeros(0, np.uint64), np.zeros(0), np.zeros(0)
    for i, j in blocks(texts):
        each, run, first_run = terms_of(texts[i:j])
        text_of = np.tile(np.repeat(np.arange(i, j), np.diff(first_run))[run], len(each))
        term = np.concatenate(each)
        once = np.unique(mix64(term ^ mix64(text_of.astype(np.uint64))), return_index=True)[1]
        # Counts so far and the block's own, by term.
        hashes, index = np.unique(np.concatenate([hashes, term[once]]), return_inverse=True)
        with_it = np.bincount(index, weights=np.concatenate([with_it, np.ones(len(once))]), minlength=len(hashes))
        toxic = np.bincount(index, weights=np.concatenate([toxic, label[text_of[once]]]), minlength=len(hashes))
    rate = positives / len(label)
    odds = np.log((toxic + 4 * rate) / (with_it - toxic + 4 * (1 - rate))) - np.log(rate / (1 - rate))
    surprise = np.abs(toxic - rate * with_it) / np.sqrt(rate * (1 - rate) * with_it)
    keep = np.sort(np.argsort(-surprise, kind="stable")[:TERMS])
    keep = keep[surprise[keep] >= SURPRISE]  # however weak: a term may weigh in a pair
    frequent = np.sort(hashes[np.argsort(-with_it, kind="stable")[:PAIRED]])
    keep = np.union1d(keep, np.searchsorted(hashes, _in_pairs(texts, label, frequent)))
    rng = np.random.default_rng(seed)
    machine = Machine(hashes[keep], np.clip(odds[keep], -1, 4), rng.normal(0, 0.1, (len(keep), FACTORS)), -2.0)
    found = [machine.events(texts[i:j]) for i, j in blocks(texts)]
    first_run = offsets_of(np.concatenate([np.diff(f) for _, _, f in found]))
    begin = np.cumsum([0, *(int(f[-1]) for _, _, f in found[:-1])])
    run, row = np.concatenate([r + b for (r, _, _), b in zip(found, begin, strict=True)]), np.concatenate([r for _, r, _ in found])
    n = int(first_run[-1])
    begins = np.searchsorted(run, np.arange(n + 2))
    ends_of = np.repeat(first_run[1:], np.diff(first_run))
    g_w, g_v, g_b = np.full(len(keep), 1e-3), np.full((len(keep), FACTORS), 1e-6), 1.0
    parts = max(1, len(texts) // 512)
    for _ in range(max(rounds, LEAST_STEPS // parts)):
        _, at = _worst(machine.window_logits(run, row, first_run), first_run)
        for part in np.array_split(rng.permutation(len(texts)), parts):
            a = begins[at[part]]
            b = begins[np.minimum(at[part] + 2, ends_of[at[part]])]
            own = np.repeat(np.arange(len(part)), b - a)
            rows = row[np.arange(len(own)) + np.repeat(a - (np.cumsum(b - a) - (b - a)), b - a)]
            v = machine.vectors[rows]
            total = np.zeros((len(part), FACTORS))
            np.add.at(total, own, v)
            square = np.bincount(own, weights=(v * v).sum(1), minlength=len(part))
            z = machine.bias + np.bincount(own, weights=machine.weights[rows], minlength=len(part)) + 0.5 * ((total**2).sum(1) - square)
            slope = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - label[part]) / len(part)
            d_w = np.bincount(rows, weights=slope[own], minlength=len(keep)) + 1e-5 * machine.weights
            d_v = np.zeros_like(machine.vectors)
            np.add.at(d_v, rows, slope[own, None] * (total[own] - v))
            d_v += 1e-4 * machine.vectors
            g_w += d_w**2
            g_v += d_v**2
            machine.weights = machine.weights - 0.1 * d_w / np.sqrt(g_w)
            machine.vectors = machine.vectors - 0.05 * d_v / np.sqrt(g_v)
            g_b += slope.sum() ** 2
            machine.bias -= 0.1 * slope.sum() / np.sqrt(g_b)
    return machine


def trained(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine:
    """The machine fitted to a bounded sample of the rows outside the held-out fold."""
    rows = labelled(docs, labels, "toxic", fold(FOLDS) != 0, sample)
    rows = rows.iloc[unlike(rows["text"].tolist())] if len(rows) else rows
    return fit(rows["text"].tolist(), rows["label"].to_numpy(float))


def scored(docs: DataFrame, machine: Machine) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs(doc_id, text)."""

    def run(batches):
        for batch in in_parts(batches):
            texts = batch.column(1).to_pylist()
            logits = [machine.logits(texts[i:j]) for i, j in blocks(texts)]
            score = 1 / (1 + np.exp(-np.clip(np.concatenate(logits) if logits else np.zeros(0), -700, 700)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], ["doc_id", "score"])

    rows = docs.select("doc_id", empty_text().alias("text")).mapInArrow(run, "doc_id long, score double")
    return rows.select("doc_id", F.coalesce(fold(FOLDS) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def clean(docs: DataFrame, machine: Machine) -> DataFrame:
    """The rows of docs, with all their columns, that the machine doesn't call toxic."""
    names = docs.columns
    place = names.index("text")

    def run(batches):
        for batch in in_parts(batches):
            texts = [t or "" for t in batch.column(place).to_pylist()]
            keep = np.concatenate([machine.logits(texts[i:j]) < 0 for i, j in blocks(texts)]) if texts else np.zeros(0, bool)
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
