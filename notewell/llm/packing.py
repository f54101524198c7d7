"""Best-fit packing of tokenised documents, certified by lower bounds.

Pieces are dealt to partitions by their key's hash and each partition is packed
best fit, in decreasing order of length. Dual feasible functions give a lower
bound on the bins of a partition's pieces; where the bins exceed it, or a bin
is loose, those bins' pieces are exchanged with other partitions and packed
again, in fewer and fewer partitions. A round's pieces are a small share of the
round before, so the last one fits in one task.

Names of special tokens in a text are ordinary text, as the library has it with
encode_special_tokens set.

Defined results: a null text is the empty text, of one end id; repeated rows
are packed one by one; an empty table gives no rows; columns beside doc_id and
text are ignored.
"""

from __future__ import annotations

import json
import math
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notewell.llm.arrays import Memo, blocks, encode_block, in_parts
from notewell.llm.frames import empty_text, written

CAPACITY = 2048
END_ID = 0
PIECES_A_PARTITION = 20_000
FAN_IN = 16
"""Partitions whose loose bins are packed again together."""
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def _memo(path: str) -> Memo:
    """Ids of a byte-level BPE tokenizer file, by pretoken; one per Python worker.

    The file's merges are in the order of their ids, so the ids serve as ranks.
    """
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]  # bytes that stand for themselves
    byte_of = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in vocab.items() if all(c in byte_of for c in token) and not (token.startswith("<|") and token.endswith("|>"))}
    return Memo(tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary)


_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids and the end id, cut if longer than capacity."""

    def run(batches):
        memo = _memo(path)
        for batch in in_parts(batches):
            texts, doc_ids = batch.column(1).to_pylist(), batch.column(0).to_pylist()
            for i, j in blocks(texts):
                ids, bounds = encode_block(texts[i:j], memo)
                rows = []
                for doc_id, a, b in zip(doc_ids[i:j], bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    own = np.append(ids[a:b], END_ID).astype("<u4")
                    cuts = [0, *range(len(own) % capacity or capacity, len(own) + 1, capacity)]
                    for k, (s, e) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                        rows.append((doc_id, k, s, e - s, zlib.crc32(own[s:e].tobytes())))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _PIECES, strict=True)], schema=_PIECES)

    return docs.select("doc_id", empty_text().alias("text")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """The bin of each length, packed best fit in decreasing order."""
    bins = np.empty(len(lengths), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = made = 0  # bit r of rooms: a bin has room r
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        if fit := rooms >> need:
            room = need + (fit & -fit).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room, b, made = capacity, made, made + 1
        bins[i] = b
        by_room[room - need].append(b)
        rooms |= 1 << (room - need)
    return bins


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """The most that dual feasible functions demand: no packing has fewer bins.

    u_k maps a length x to floor((k + 1) x / c) / k, or to x / c where that is
    whole; f_e maps lengths over c - e to 1, those under e to 0, others to x / c.
    """
    if not len(lengths):
        return 0
    size, many = np.unique(lengths, return_counts=True)
    best = -(-int((size * many).sum()) // capacity)
    for k in range(1, 21):
        scaled = (k + 1) * size
        whole = scaled % capacity == 0
        value = np.where(whole, k * size, (scaled // capacity) * capacity)  # times k * capacity
        best = max(best, -(-int((value * many).sum()) // (k * capacity)))
    below = np.concatenate([[0], np.cumsum(size * many)])
    count = np.concatenate([[0], np.cumsum(many)])
    for e in size[size <= capacity // 2].tolist():
        large = int(count[-1] - count[np.searchsorted(size, capacity - e, "right")])
        lo, hi = np.searchsorted(size, e, "left"), np.searchsorted(size, capacity - e, "right")
        best = max(best, large + -(-int(below[hi] - below[lo]) // capacity))
    return best


_STATE = "doc_id long, piece int, start long, length long, ids_crc32 long, part long, bin long, at long, loose boolean, bins long, bound long"


def _packer(capacity: int, last: bool):
    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        lengths = frame["length"].to_numpy()
        bins = best_fit(lengths, capacity)
        order = np.lexsort((frame["piece"], frame["doc_id"].fillna(-1), bins))
        frame, bins, lengths = frame.iloc[order].reset_index(drop=True), bins[order], lengths[order]
        before = np.cumsum(lengths) - lengths
        starts = np.flatnonzero(np.append(True, bins[1:] != bins[:-1]))
        frame["bin"], frame["at"] = bins, before - np.repeat(before[starts], np.diff(np.append(starts, len(bins))))
        fill = np.bincount(bins, weights=lengths).astype(np.int64)
        bound = lower_bound(lengths, capacity)
        # Certified: only the loosest bin is passed on, whose room others may use. With a gap: bins whose room adds up to the gap.
        gap = len(fill) - bound
        loosest = np.argsort(fill, kind="stable")
        room = np.cumsum(capacity - fill[loosest])
        give = 0 if last else min(len(fill), 1 + int(np.searchsorted(room, capacity * (gap + 1))))
        loose = np.zeros(len(fill), bool)
        loose[loosest[:give]] = True
        loose &= fill < capacity
        frame["loose"], frame["bins"], frame["bound"] = loose[bins], len(fill), bound
        return frame

    return pack


def packed(docs: DataFrame, path: str, capacity: int = CAPACITY, a_partition: int = PIECES_A_PARTITION) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset, bins, bound): a place for every piece.

    bins and bound are those of the partition that placed the piece: its bin
    count, and the count that no packing of the same pieces can go below.
    """
    cut = written(pieces(docs, path, capacity))
    whole = cut.where(F.col("length") == capacity).select("*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.lit(1).cast("long").alias("bins"), F.lit(1).cast("long").alias("bound"))
    short = cut.where(F.col("length") < capacity)
    parts = max(1, math.ceil(short.count() / a_partition))
    done, level = [whole], 0
    rest = short.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", F.lit(17)), F.lit(parts)))
    while True:
        last = parts == 1
        state = written(rest.select(*[F.col(c) for c in short.columns], "part").groupBy("part").applyInPandas(_packer(capacity, last), _STATE))
        number = (F.lit(level).cast("long") * F.lit(1 << 58) + F.col("part") * F.lit(1 << 32) + F.col("bin")).alias("sequence_id")
        done.append(state.where(~F.col("loose")).select(*short.columns, number, F.col("at").alias("offset"), "bins", "bound"))
        if last:
            break
        level += 1
        parts = math.ceil(parts / FAN_IN)
        rest = state.where("loose").withColumn("part", F.floor(F.col("part") / FAN_IN))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out
