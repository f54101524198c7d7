"""Media columns kept as content-defined chunks.

A text's payload is cut where a rolling gear hash of the last 32 bytes falls in
a given residue, each chunk is stored once under its digest, and an ordered
chunk list per payload rebuilds the media, which is verified against the
payload's own digest. A chunk's stored form is a bzip2 stream of its 8-bit
samples, and a payload's is the sequence of its chunks' streams.

Defined results: a null text is the empty text; the empty payload is padded to
one unit; repeated rows give a row each; an empty table gives no rows; columns
beside doc_id and text are ignored.
"""

from __future__ import annotations

import bz2
import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notewell.llm.arrays import BLOCK_CHARS, blocks, mix64, offsets_of
from notewell.llm.frames import empty_text

UNIT = 576
SHORTEST, AVERAGE_BITS, LONGEST = 4096, 13, 65536
NAME_BYTES = 16
"""Of the digests that name payloads and chunks."""
DEALT_ANEW = 32
"""A chunk with a block of more uses than this is dealt out again before it is copied for them."""
BLOCKS = 256

_GEAR = (mix64(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


def payload_of(text: str) -> tuple[bytes, int]:
    """The UTF-8 bytes of a text, filled with bytes 255 to a positive multiple of UNIT, and their number before that."""
    raw = text.encode("utf-8", "surrogatepass")
    size = max(UNIT, -(-len(raw) // UNIT) * UNIT)
    return raw + b"\xff" * (size - len(raw)), len(raw)


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """Sum of the gear values of the last 32 bytes, each shifted by its distance, for every position."""
    h = _GEAR[data]
    for step in (1, 2, 4, 8, 16):
        more = h.copy()
        more[step:] += h[:-step] << np.uint32(step)
        h = more
    return h


def cut_points(payloads: list[bytes]) -> list[list[int]]:
    """Ends of the chunks of each payload."""
    data = np.frombuffer(b"".join(payloads), np.uint8)
    offsets = offsets_of([len(p) for p in payloads])
    marks = np.flatnonzero(gear_hashes(data) >> np.uint32(32 - AVERAGE_BITS) == 0) + 1
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        ends, begin = [], a
        while b - begin > SHORTEST:
            i = np.searchsorted(marks, begin + SHORTEST)
            end = min(int(marks[i]) if i < len(marks) else b, begin + LONGEST, b)
            ends.append(end - a)
            begin = end
        if begin < b or not ends:
            ends.append(b - a)
        out.append(ends)
    return out


def _chunked(texts: list[str]):
    """Payload, its bytes before padding, and its chunks, for each text."""
    for i, j in blocks(texts, BLOCK_CHARS):
        made = [payload_of(t) for t in texts[i:j]]
        for (payload, n), ends in zip(made, cut_points([p for p, _ in made]), strict=True):
            yield payload, n, [payload[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def _digest(data: bytes) -> bytes:
    return hashlib.sha256(data).digest()[:NAME_BYTES]


def _lists(batches):
    """One row for each payload that a batch holds: its key, size and the digests of its chunks."""
    for batch in batches:
        seen = {}
        for payload, n, chunks in _chunked(batch.column(0).to_pylist()):
            key = _digest(payload[:n])
            if key not in seen:
                seen[key] = (n, [_digest(c) for c in chunks])
        yield pa.RecordBatch.from_arrays(
            [pa.array(seen, pa.binary()), pa.array([n for n, _ in seen.values()], pa.int64()), pa.array([d for _, d in seen.values()], pa.list_(pa.binary()))],
            ["key", "n_bytes", "digests"],
        )


def _frames(batches):
    """One row for each chunk that a batch holds: its digest and its stored form."""
    for batch in batches:
        seen, size = {}, 0
        for _, _, chunks in _chunked(batch.column(0).to_pylist()):
            for c in chunks:
                if (d := _digest(c)) not in seen:
                    seen[d] = bz2.compress(c, 1)
                    size += len(seen[d])
            if size > 1 << 23:
                yield _pairs(seen)
                seen, size = {}, 0
        yield _pairs(seen)


def _pairs(seen: dict[bytes, bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.binary()), pa.array(seen.values(), pa.binary())], ["digest", "frame"])


def chunk_store(docs: DataFrame) -> DataFrame:
    """(digest, frame): every chunk of the corpus once."""
    frames = docs.select(empty_text().alias("text")).mapInArrow(_frames, "digest binary, frame binary")
    return frames.groupBy("digest").agg(F.first("frame").alias("frame"))


def chunk_lists(docs: DataFrame) -> DataFrame:
    """(key, n_bytes, digests): the ordered chunk list of every distinct payload."""
    lists = docs.select(empty_text().alias("text")).mapInArrow(_lists, "key binary, n_bytes long, digests array<binary>")
    return lists.dropDuplicates(["key"])


def _rebuilt(batches):
    for batch in batches:
        rows = []
        for key, n, frames in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            payload = b"".join(bz2.decompress(f["frame"]) for f in frames)
            if _digest(payload[:n]) != key:
                raise ValueError(f"the chunks of payload {key.hex()} do not rebuild it")
            stored = hashlib.sha256()
            for f in frames:
                stored.update(f["frame"])
            counts = np.bincount(np.frombuffer(payload, np.uint8) >> 4, minlength=16)
            rows.append({
                "key": key, "n_bytes": n, "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).digest(),
                "tail_crc32": zlib.crc32(payload[-32:]), "media_bytes": sum(len(f["frame"]) for f in frames), "media_sha256": stored.digest(),
                "feature": (counts * 255 // len(payload)).astype(np.uint8).tobytes(),
            })
        yield pa.RecordBatch.from_pylist(rows, schema=_MEDIA)


_MEDIA = pa.schema([("key", pa.binary()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.binary()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.binary()), ("feature", pa.binary())])
_MEDIA_SQL = "key binary, n_bytes long, payload_bytes long, payload_sha256 binary, tail_crc32 long, media_bytes long, media_sha256 binary, feature binary"


def rebuild(lists: DataFrame, store: DataFrame) -> DataFrame:
    """Reads the stored chunks back in order and describes each verified payload.

    The feature has the share of each sixteenth of the byte values, in 255ths.

    Uses of a chunk are gathered into blocks first, so a chunk that a third of
    the payloads share joins as a few rows; its blocks are dealt out anew before
    they are expanded.
    """
    uses = lists.select("key", "n_bytes", F.posexplode("digests").alias("seq", "digest"))
    uses = uses.groupBy("digest", F.pmod(F.xxhash64("key"), F.lit(BLOCKS)).alias("block")).agg(F.collect_list(F.struct("key", "n_bytes", "seq")).alias("uses"))
    found = uses.join(store, "digest").select("uses", "frame")
    hot = found.where(F.size("uses") > DEALT_ANEW).hint("rebalance")
    each = [x.select(F.inline("uses"), "frame") for x in (found.where(F.size("uses") <= DEALT_ANEW), hot)]
    gathered = each[0].unionByName(each[1]).groupBy("key").agg(F.first("n_bytes").alias("n_bytes"), F.sort_array(F.collect_list(F.struct("seq", "frame"))).alias("frames"))
    return gathered.mapInArrow(_rebuilt, _MEDIA_SQL)


def media_columns(docs: DataFrame) -> DataFrame:
    """doc_id and the description of its media, for every row of docs(doc_id, text)."""
    keyed = docs.select("doc_id", F.unhex(F.substring(F.sha2(empty_text(), 256), 1, 2 * NAME_BYTES)).alias("key"))
    media = keyed.join(rebuild(chunk_lists(docs), chunk_store(docs)), "key").drop("key")
    return media.withColumns({c: F.lower(F.hex(c)) for c in ("payload_sha256", "media_sha256", "feature")})
