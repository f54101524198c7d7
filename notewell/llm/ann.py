"""Approximate nearest neighbours by a hierarchical k-means tree.

The tree is fitted on a bounded sample and every vector is put into one of its
leaves. A query walks the tree best bin first, by a priority queue over the
distances to the nodes' centres. How many leaves it visits is calibrated: true
neighbours of sampled queries are looked up in the order of the walk, and the
walk is widened until it meets the target share of them; it goes on while the
leaves met hold too few vectors. Within the leaves the nearness is exact.

Neighbouring leaves share a shelf of bounded size, a crowded leaf is dealt into
several blocks, and a shelf's visitors into parties, so equal or crowded vectors
don't meet in one task. A shelf is copied for its own parties alone.

Defined results: vectors that are null, empty or zero, have null or non-finite
components, or another dimension than most, take no part; rows without vec_id
take none either; a vec_id's repeated rows are one candidate, by its nearest
row, and one query, by the nearest of its rows; an empty table gives no rows;
columns beside vec_id and embedding are ignored.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from notewell.llm.frames import written

SAMPLE = 20_000
"""Most vectors that the tree is fitted on."""
BRANCHES, LEAF_ROWS, MOST_LEAVES = 8, 128, 2048
"""Of the tree: children of a node, rows that a leaf is meant to hold, and leaves at most, by the size of the sample."""
PROBES, TARGET = 500, 0.98
"""Sampled queries for the calibration, and the share of their neighbours to be met."""
MEMBERS_A_BLOCK, QUERIES_A_BLOCK = 16_384, 1024
SPARE = 4
"""A walk goes on until it has met this many times the neighbours asked for."""


def unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def _k_means(points: np.ndarray, k: int, rng, rounds: int = 12) -> np.ndarray:
    centres = points[rng.choice(len(points), k, replace=False)]
    for _ in range(rounds):
        nearest = (points @ centres.T - 0.5 * (centres**2).sum(1)).argmax(1)
        for c in range(k):
            if (nearest == c).any():
                centres[c] = points[nearest == c].mean(0)
    return centres


@dataclass
class Tree:
    """centres and children: those of each inner node. A child under 0 is the leaf -1 - child."""

    centres: list[np.ndarray] = field(default_factory=list)
    children: list[list[int]] = field(default_factory=list)
    leaves: int = 0
    visits: int = 1

    def grow(self, points: np.ndarray, most: int, rng) -> int:
        """Adds a node for these points and returns its number."""
        centres = _k_means(points, min(BRANCHES, len(points)), rng) if len(points) > most else points[:0]
        nearest = (points @ centres.T - 0.5 * (centres**2).sum(1)).argmax(1) if len(centres) else None
        if nearest is None or len(np.unique(nearest)) < 2:
            self.leaves += 1
            return -self.leaves
        place = len(self.centres)
        used = np.unique(nearest)
        self.centres.append(centres[used])
        self.children.append([])
        self.children[place] = [self.grow(points[nearest == c], most, rng) for c in used]
        return place

    def leaf_of(self, points: np.ndarray) -> np.ndarray:
        """The leaf of each point: the nearest centre at every node."""
        out = np.zeros(len(points), np.int64)
        todo = [(0, np.arange(len(points)))] if self.centres else []
        while todo:
            node, rows = todo.pop()
            centres = self.centres[node]
            nearest = (points[rows] @ centres.T - 0.5 * (centres**2).sum(1)).argmax(1)
            for c, child in enumerate(self.children[node]):
                part = rows[nearest == c]
                if child < 0:
                    out[part] = -1 - child
                elif len(part):
                    todo.append((child, part))
        return out

    def walk(self, point: np.ndarray):
        """Leaves, best bin first."""
        queue = [(0.0, 0 if self.centres else -1)]
        while queue:
            _, node = heapq.heappop(queue)
            if node < 0:
                yield -1 - node
                continue
            away = ((self.centres[node] - point) ** 2).sum(1)
            for distance, child in zip(away.tolist(), self.children[node], strict=True):
                heapq.heappush(queue, (distance, child))


def fit(vectors: np.ndarray, rows: int, k: int, seed: int = 0, leaf_rows: int = LEAF_ROWS) -> Tree:
    """A tree for a table of that many rows, and the leaves to visit, from sampled vectors."""
    rng = np.random.default_rng(seed)
    tree = Tree()
    if not len(vectors):
        tree.leaves = 1
        return tree
    points = unit(vectors)
    leaves = min(MOST_LEAVES, max(1, rows // leaf_rows))
    tree.grow(points, max(1, len(points) // leaves), rng)
    leaf = tree.leaf_of(points)
    probes = rng.choice(len(points), min(PROBES, len(points)), replace=False)
    near = points[probes] @ points.T
    near[np.arange(len(probes)), probes] = -np.inf
    places = []
    for row, probe in zip(near, probes.tolist(), strict=True):
        place = {x: i for i, x in enumerate(tree.walk(points[probe]))}
        top = np.argpartition(-row, min(k, len(row) - 1))[:k]
        places += [place[x] + 1 for x in leaf[top].tolist()]
    places.sort()
    tree.visits = places[min(len(places) - 1, math.ceil(TARGET * len(places)) - 1)]
    return tree


def valid(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding as doubles) of the rows that take part."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.where("vec_id IS NOT NULL AND size(embedding) > 0").where(~bad & F.exists("embedding", lambda x: x != 0))
    common = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("embedding") == (common["n"] if common else 0))


def _matrix(column: pa.ListArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _shelves(held_by: list[int], most: int) -> tuple[list[int], list[int]]:
    """The shelf of each leaf, and the blocks of each shelf: runs of leaves with `most` members at most, or one leaf in several blocks."""
    shelf, blocks, room = [], [], 0
    for n in held_by:
        if n > room:
            blocks.append(max(1, math.ceil(n / most)))
            room = most if n <= most else 0
        shelf.append(max(0, len(blocks) - 1))
        room -= min(n, room)
    return shelf, blocks or [1]


_FOUND = {"query_id": "int64", "vec_id": "int64", "score": "float64"}


def _top(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best different ids of each query, best first; of equal scores those with smaller ids."""
    order = np.lexsort((ids, -score, query))
    pairs = np.rec.fromarrays([query[order], ids[order]])
    order = order[np.sort(np.unique(pairs, return_index=True)[1])]
    starts = np.flatnonzero(np.append(True, query[order][1:] != query[order][:-1])) if len(order) else order
    rank = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
    return order[rank < k]


def _best(queries: pd.DataFrame, members: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k nearest members of each query in the leaves that it visits, from exact cosines."""
    out = []
    if len(queries) and len(members):
        q = unit(np.frombuffer(b"".join(queries["vector"]), np.float64).reshape(len(queries), -1))
        query_ids = queries["query_id"].to_numpy()
        visits = np.concatenate([np.asarray(x) for x in queries["leaves"]])
        visitor = np.repeat(np.arange(len(queries)), queries["leaves"].map(len).to_numpy())
        for leaf, own in members.groupby("leaf"):
            visiting, ids = visitor[visits == leaf], own["vec_id"].to_numpy()
            if not len(visiting):
                continue
            m = unit(np.frombuffer(b"".join(own["vector"]), np.float64).reshape(len(own), -1))
            for begin in range(0, len(visiting), 64):
                who = visiting[begin : begin + 64]
                near = q[who] @ m.T
                near[query_ids[who][:, None] == ids] = -np.inf
                least = np.partition(near, len(ids) - k, axis=1)[:, len(ids) - k] if len(ids) > k else np.full(len(who), -np.inf)
                i, j = np.nonzero((near >= least[:, None] - 1e-12) & (near > -np.inf))
                # One sum per pair, in the same order for all, so equal vectors have equal scores.
                score = (m[j] * q[who[i]]).sum(axis=1)
                best = _top(who[i], ids[j], score, k)
                out.append((who[i][best], ids[j][best], score[best]))
    if not out:
        return pd.DataFrame({c: pd.Series(dtype=t) for c, t in _FOUND.items()})
    who, ids, score = (np.concatenate(x) for x in zip(*out, strict=True))
    best = _top(who, ids, score, k)
    return pd.DataFrame({"query_id": query_ids[who[best]], "vec_id": ids[best], "score": score[best]})


def nearest(vectors: DataFrame, every: int, k: int = 5, sample: int = SAMPLE, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of every row whose vec_id is divisible by `every`."""
    rows = valid(vectors)
    total = rows.count()
    held = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toArrow()
    tree = fit(_matrix(held.column("embedding")), total, k, leaf_rows=leaf_rows)

    def place(batches):
        for batch in batches:
            m = _matrix(batch.column(1))
            leaf = tree.leaf_of(unit(m)) if len(m) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(leaf), pa.array([v.tobytes() for v in m], pa.binary())], ["vec_id", "leaf", "vector"])

    placed = written(rows.mapInArrow(place, "vec_id long, leaf long, vector binary"))
    count = {r["leaf"]: r["count"] for r in placed.groupBy("leaf").count().collect()}  # a row for each leaf
    held_by = [count.get(x, 0) for x in range(tree.leaves)]
    shelf_of, blocks = _shelves(held_by, MEMBERS_A_BLOCK)

    def route(batches):
        for batch in batches:
            out = []
            raw = batch.column(1).to_pylist()
            points = unit(np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)) if raw else []
            for query, vector, point in zip(batch.column(0).to_pylist(), raw, points, strict=True):
                met, visited = 0, {}
                for n, leaf in enumerate(tree.walk(point)):
                    if n >= tree.visits and met > SPARE * k:
                        break
                    met += held_by[leaf]
                    if held_by[leaf]:
                        visited.setdefault(shelf_of[leaf], []).append(leaf)
                out += [(query, vector, shelf, leaves) for shelf, leaves in visited.items()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 4, (pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.int64())), strict=True)], ["query_id", "vector", "shelf", "leaves"])

    queries = written(placed.where(F.col("vec_id") % every == 0).select("vec_id", "vector").mapInArrow(route, "query_id long, vector binary, shelf long, leaves array<long>"))
    visitors = {r["shelf"]: r["count"] for r in queries.groupBy("shelf").count().collect()}  # a row for each shelf

    def by(numbers: list[int], place: str):
        return F.element_at(F.array(*[F.lit(n) for n in numbers]), (F.col(place) + 1).cast("int"))

    parties = [math.ceil(visitors.get(x, 0) / QUERIES_A_BLOCK) for x in range(len(blocks))]
    asked = queries.withColumn("party", F.pmod(F.xxhash64("query_id"), F.greatest(by(parties, "shelf"), F.lit(1))).cast("long")).withColumn("block", F.explode(F.sequence(F.lit(0), by(blocks, "shelf") - 1))).withColumn("block", F.col("block").cast("long"))
    members = placed.withColumn("shelf", by(shelf_of, "leaf").cast("long")).withColumn("block", F.pmod(F.xxhash64("vec_id", "vector"), by(blocks, "shelf")).cast("long"))
    members = members.where(by(parties, "shelf") > 0).withColumn("party", F.explode(F.sequence(F.lit(0), by(parties, "shelf") - 1))).withColumn("party", F.col("party").cast("long"))
    keys = ["shelf", "block", "party"]
    found = asked.groupBy(*keys).cogroup(members.groupBy(*keys)).applyInPandas(lambda q, m: _best(q, m, k), "query_id long, vec_id long, score double")
    each = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = each.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
