"""Chunks and packing against plain forms."""

import bz2
import hashlib
import itertools
import random
import zlib

import numpy as np
import tokenizers

from notewell.llm import media_chunks, packing
from notewell.llm.queries import TOKENIZERS

UNIT = 576


def payload(text):
    raw = (text or "").encode()
    size = max(1, -(-len(raw) // UNIT)) * UNIT
    return raw.ljust(size, b"\xff"), len(raw)


def cuts(data):
    """Ends of chunks, by a hash that rolls over one byte at a time."""
    ends, begin, h = [], 0, 0
    state = []
    for b in data:
        h = (h * 2 + int(media_chunks._GEAR[b])) & 0xFFFFFFFF
        state.append(h)
    for i in range(len(data)):
        if i + 1 - begin >= media_chunks.LONGEST or i + 1 - begin >= media_chunks.SHORTEST and state[i] >> (32 - media_chunks.AVERAGE_BITS) == 0:
            if i + 1 < len(data):
                ends.append(i + 1)
                begin = i + 1
    return [*ends, len(data)]


def test_chunks_of_whole_texts(spark):
    rng = random.Random(4)
    words = ["alpha", "beta", "gamma", "délta", "😀"]
    passage = " ".join(rng.choice(words) + str(rng.randrange(1000)) for _ in range(6000))
    texts = [None, "", "x", "a" * 575, "a" * 576, "a" * 577, passage, "begin " + passage, passage + " end", passage, "z" * 200_000]
    docs = spark.createDataFrame([(d, t, "key", b"frame") for d, t in enumerate(texts)] + [(None, "x", "", b""), (3, "a" * 575, "", b"")], "doc_id long, text string, key string, frame binary")
    got = media_chunks.media_columns(docs).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        text = "x" if r.doc_id is None else texts[r.doc_id]
        data, n = payload(text)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (n, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]))
        ends = media_chunks.cut_points([data])[0]
        assert len(data) < 30_000 or ends == cuts(data)
        frames = [bz2.compress(data[a:b], 1) for a, b in itertools.pairwise([0, *ends])]
        assert (r.media_bytes, r.media_sha256) == (sum(map(len, frames)), hashlib.sha256(b"".join(frames)).hexdigest())
        counts = [sum(b >> 4 == k for b in data) for k in range(16)]
        assert r.feature == bytes(c * 255 // len(data) for c in counts).hex()


def test_shared_passages_are_stored_once(spark):
    rng = random.Random(5)
    passage = " ".join(str(rng.randrange(10**9)) for _ in range(9000))
    docs = spark.createDataFrame([(d, "x" * d + passage) for d in range(6)], "doc_id long, text string")
    store = media_chunks.chunk_store(docs).collect()
    lists = media_chunks.chunk_lists(docs).collect()
    assert len(lists) == 6 and len(store) < sum(len(r.digests) for r in lists) / 2
    held = {bytes(r.digest): bz2.decompress(r.frame) for r in store}
    for r in lists:
        whole = b"".join(held[bytes(d)] for d in r.digests)
        assert hashlib.sha256(whole[: r.n_bytes]).digest()[: media_chunks.NAME_BYTES] == bytes(r.key)


def least_bins(lengths, capacity):
    """The exact optimum, by trying every bin for every piece."""
    best = len(lengths)

    def go(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(lengths):
            best = len(rooms)
            return
        for room in set(rooms):
            if room >= lengths[i]:
                left = list(rooms)
                left.remove(room)
                go(i + 1, [*left, room - lengths[i]])
        go(i + 1, [*rooms, capacity - lengths[i]])

    lengths = sorted(lengths, reverse=True)
    go(0, [])
    return best


def test_bounds_hold_and_bins_are_near_the_optimum():
    rng = np.random.default_rng(6)
    met = 0
    for _ in range(60):
        lengths = rng.integers(1, 21, rng.integers(1, 10))
        exact = least_bins(lengths.tolist(), 20)
        bins = packing.best_fit(lengths, 20)
        used = len(np.unique(bins))
        assert packing.lower_bound(lengths, 20) <= exact <= used <= exact + 1
        assert max(np.bincount(bins, weights=lengths)) <= 20
        met += used == exact
    assert met >= 50


def test_pieces_have_the_library_s_ids(spark):
    rng = random.Random(7)
    library = tokenizers.Tokenizer.from_file(f"{TOKENIZERS}/byte_bpe_50k.json")
    library.encode_special_tokens = True
    texts = [None, "", "a <|endoftext|> b", "Ünïcode 😀  \n\t x", "word " * 5000] + [" ".join(rng.choice(["the", "they'll", "x1", "¿qué?"]) for _ in range(rng.randint(1, 900))) for _ in range(60)]
    docs = spark.createDataFrame([(d, t, 5, 6) for d, t in enumerate(texts)] + [(4, texts[4], 0, 0), (None, "x", 0, 0)], "doc_id long, text string, part int, bin int").repartition(5)
    for a_partition, spare in ((20, 4), (packing.PIECES_A_PARTITION, 1)):  # small partitions may each leave a bin of room
        check(packing.packed(docs, f"{TOKENIZERS}/byte_bpe_50k.json", a_partition=a_partition).collect(), texts, library, spare)


def check(rows, texts, library, spare):
    found, rooms = {}, {}
    for r in rows:
        found.setdefault(r.doc_id, []).append((r.piece, r.start, r.length, r.ids_crc32))
        rooms.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for d, text in enumerate(texts):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        first = len(ids) % 2048 or 2048
        bounds = [0, *range(first, len(ids) + 1, 2048)]
        wanted = [(k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(itertools.pairwise(bounds))]
        assert sorted(found[d]) == sorted(wanted * (2 if d == 4 else 1))
    assert len(found[None]) == 1
    for parts in rooms.values():
        assert [sum(n for _, n in sorted(parts)[:k]) for k in range(len(parts))] == [o for o, _ in sorted(parts)]
    lengths = np.array([n for parts in rooms.values() for _, n in parts])
    assert len(rooms) <= (lengths == 2048).sum() + packing.lower_bound(lengths[lengths < 2048]) + spare
