"""Vectorised text primitives shared by the corpus operators.

Texts arrive in Arrow batches. Each helper works on one block of whole texts
laid end to end, so the cost per character is a handful of numpy passes and no
Python loop touches a character.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import tiktoken

BLOCK_CHARS = 1 << 19
_MULT = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD6E8FEB86659FD93)
_U = np.uint64

SPACE, LETTER, NUMBER, OTHER = 1, 2, 3, 4
# The characters that Unicode calls White_Space.
WHITE_SPACE = [
    *range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
]
_CLASS = np.zeros(0x110000, np.uint8)
_CLASS[WHITE_SPACE] = SPACE


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of unsigned 64-bit values."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class _Powers:
    """Powers of an odd base modulo 2**64 and of its inverse, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n + 1:
            size = max(n + 1, BLOCK_CHARS + 1)
            inverse = _U(pow(int(_BASE), -1, 1 << 64))
            for name, base in (("up", _BASE), ("down", inverse)):
                powers = np.full(size, base, np.uint64)
                powers[0] = 1
                setattr(self, name, np.multiply.accumulate(powers))
        return self.up, self.down


_POWERS = _Powers()


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each values[start:end]; equal spans get equal hashes wherever they stand."""
    up, down = _POWERS.get(len(values))
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(mix64(values.astype(np.uint64) + _MULT) * up[: len(values)], out=sums[1:])
    lengths = (ends - starts).astype(np.uint64)
    return mix64((sums[ends] - sums[starts]) * down[starts] + lengths * _MULT)


def blocks(texts: list[str], most: int = BLOCK_CHARS):
    """Slices of texts that hold about `most` characters; a longer text makes a block of its own."""
    begin = held = 0
    for i, text in enumerate(texts):
        if held and held + len(text) > most:
            yield begin, i
            begin, held = i, 0
        held += len(text)
    if begin < len(texts):
        yield begin, len(texts)


def in_parts(batches, rows: int = 512):
    """Arrow batches of few rows, so that a worker holds few texts as Python strings at a time."""
    for batch in batches:
        for begin in range(0, batch.num_rows, rows):
            yield batch.slice(begin, rows)


def offsets_of(lengths) -> np.ndarray:
    out = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(np.asarray(lengths, np.int64), out=out[1:])
    return out


def code_points(joined: str) -> np.ndarray:
    return np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)


@lru_cache(maxsize=2)
def _only(pattern: str) -> tiktoken.Encoding:
    """Keeps the characters of a text that match, byte by byte: what tiktoken's own tables say of them."""
    return tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})


def classes(points: np.ndarray) -> np.ndarray:
    """White space, letter, number or other, for each code point."""
    out = _CLASS[points]
    if not out.all():
        new = np.unique(points[out == 0])
        _CLASS[new] = OTHER
        joined = "".join(chr(p) for p in new.tolist() if not 0xD800 <= p < 0xE000)
        for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}")):
            _CLASS[code_points(bytes(_only(pattern).encode_ordinary(joined)).decode())] = kind
        out = _CLASS[points]
    return out


def pretokens(points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Start of each match of the byte-level BPE pattern, over texts laid end to end.

    The pattern takes contractions, then an optional space before letters,
    numbers or other marks, then white space, which leaves its last character
    to what follows. offsets are the bounds of the texts.
    """
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = classes(points)
    first = np.zeros(n + 1, bool)  # of a text
    first[offsets] = True
    start = np.empty(n, bool)
    start[0] = True
    np.not_equal(kind[1:], kind[:-1], out=start[1:])
    start |= first[:n]
    # A run of white space before something else gives up its last character.
    after = np.flatnonzero((kind[1:] != SPACE) & (kind[:-1] == SPACE) & ~first[1:n]) + 1
    start[after - 1] = True
    start[after[points[after - 1] == 0x20]] = False
    mark = np.flatnonzero((points == 0x27) & start)
    if len(mark):
        padded = np.concatenate([points, np.zeros(3, np.uint32)])
        bound = np.concatenate([first, np.ones(3, bool)])
        a, b = padded[mark + 1], padded[mark + 2]
        one = ~bound[mark + 1] & np.isin(a, [ord(c) for c in "stmd"])
        two = ~bound[mark + 1] & ~bound[mark + 2]
        two &= ((a == 114) & (b == 101)) | ((a == 118) & (b == 101)) | ((a == 108) & (b == 108))
        for which, length in ((one, 2), (two, 3)):
            at = mark[which]
            start[at + 1] = False
            at = at + length
            start[at[at < n]] = True
    return np.flatnonzero(start)


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of each range, one range after another."""
    total = int(counts.sum())
    ends = np.cumsum(counts)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - counts), counts)


class Memo:
    """Maps span hashes to lists of ids, in open addressing with a bound on its entries.

    When it is full it is emptied, so memory stays bounded however large the
    vocabulary of a corpus grows.
    """

    def __init__(self, encode, entries: int = 1 << 20) -> None:
        self.encode, self.entries = encode, entries
        self._clear(2 * entries)

    def _clear(self, slots: int) -> None:
        self.keys = np.zeros(slots, np.uint64)
        self.at = np.zeros(slots, np.int64)
        self.count = np.zeros(slots, np.int32)
        self.ids = np.zeros(1 << 16, np.uint32)
        self.held = self.used = 0

    def _find(self, h: np.ndarray) -> np.ndarray:
        mask = len(self.keys) - 1
        at = (h & _U(mask)).astype(np.int64)
        live = np.arange(len(h))
        while len(live):
            k = self.keys[at[live]]
            live, k = live[k != h[live]], k[k != h[live]]
            at[live[k == 0]] = -1
            live = live[k != 0]
            at[live] = (at[live] + 1) & mask
        return at

    def _insert(self, h: np.ndarray) -> np.ndarray:
        """Slots for hashes that differ from each other and from those held."""
        mask = len(self.keys) - 1
        at = (h & _U(mask)).astype(np.int64)
        live = np.arange(len(h))
        while len(live):
            free = live[self.keys[at[live]] == 0]
            self.keys[at[free]] = h[free]
            live = live[self.keys[at[live]] != h[live]]
            at[live] = (at[live] + 1) & mask
        return at

    def look_up(self, h: np.ndarray, joined: str, starts: np.ndarray, ends: np.ndarray):
        """Place and count in self.ids of what encode(span) gives, for each span."""
        h = np.where(h == 0, _U(1), h)
        slot = self._find(h)
        miss = np.flatnonzero(slot < 0)
        if len(miss):
            new, index = np.unique(h[miss], return_index=True)
            if self.held + len(new) > self.entries:
                self._clear(max(2 * self.entries, 1 << (4 * len(h)).bit_length()))
                miss = np.arange(len(h))
                new, index = np.unique(h, return_index=True)
            index = miss[index]
            found = [self.encode(joined[s:e]) for s, e in zip(starts[index].tolist(), ends[index].tolist(), strict=True)]
            counts = np.fromiter(map(len, found), np.int64, len(found))
            total = int(counts.sum())
            while self.used + total > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
            self.ids[self.used : self.used + total] = np.fromiter((x for y in found for x in y), np.uint32, total)
            at = self._insert(new)
            self.at[at] = self.used + np.cumsum(counts) - counts
            self.count[at] = counts
            self.used += total
            self.held += len(new)
            slot = self._find(h)
        return self.at[slot], self.count[slot].astype(np.int64)


def encode_block(texts: list[str], memo: Memo) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, end to end, and the bounds of each text's ids."""
    joined = "".join(texts)
    points = code_points(joined)
    offsets = offsets_of([len(t) for t in texts])
    starts = pretokens(points, offsets)
    ends = np.append(starts[1:], len(points))
    at, count = memo.look_up(span_hashes(points, starts, ends), joined, starts, ends)
    ids = memo.ids[ragged(at, count)]
    before = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(count, out=before[1:])
    return ids, before[np.searchsorted(starts, offsets)]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that are not ASCII white space, in texts laid end to end."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = ~((data == 0x20) | ((data >= 0x09) & (data <= 0x0D)))
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    before = np.empty(len(data), bool)
    before[0] = False
    before[1:] = word[:-1]
    starts = np.flatnonzero(word & (~before | first[:-1]))
    after = np.empty(len(data), bool)
    after[-1] = False
    after[:-1] = word[1:]
    ends = np.flatnonzero(word & (~after | first[1:])) + 1
    return starts, ends


def lowered_bytes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of texts end to end, A-Z lower-cased, and the bounds of the texts."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    return np.frombuffer(b"".join(raw).lower(), np.uint8), offsets_of([len(r) for r in raw])
