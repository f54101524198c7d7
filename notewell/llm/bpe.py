"""Byte-level BPE as a lazily determinised transducer, and a streaming decoder.

A sequence of tokens is the BPE encoding of its bytes exactly if each token
encodes to itself and each adjacent pair does. So encoding is a walk through an
automaton whose hypotheses are (tokens so far, place in the token trie); its
deterministic states are sets of hypotheses, made when first reached. A token
is emitted once all hypotheses share it, at the latest after as many bytes as
the longest token has.

Defined results: a null text is the empty text, which has no ids; repeated rows
give a row each; an empty table gives no rows; columns beside doc_id and text
are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from notewell.llm.arrays import Memo, blocks, encode_block, in_parts, ragged
from notewell.llm.frames import empty_text


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Transducer:
    """Encodes one pretoken at a time. States and transitions are made lazily and dropped beyond `most`."""

    def __init__(self, ranks: dict[bytes, int], most: int = 1 << 17) -> None:
        self.ranks, self.most = ranks, most
        self.bytes_of = {r: t for t, r in ranks.items()}
        self.children: dict[int, int] = {}
        self.token_at = [-1]
        for token, rank in ranks.items():
            node = 0
            for b in token:
                step = node << 8 | b
                if step not in self.children:
                    self.children[step] = len(self.token_at)
                    self.token_at.append(-1)
                node = self.children[step]
            self.token_at[node] = rank
        self.pairs: dict[tuple[int | None, int], bool] = {}
        self.edges: dict[int, tuple[list, list]] = {}
        self._reset()

    def _reset(self) -> None:
        start = (((None,), 0),)
        self.sets, self.numbers = [start], {start: 0}
        self.steps: dict[int, tuple[int, tuple[int, ...]]] = {}
        self.ends: dict[int, tuple[int, ...]] = {}

    def merged(self, data: bytes) -> list[int]:
        """The encoding by repeated merging; it defines which pairs stand."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.ranks.get(parts[i] + parts[i + 1], 1 << 40))
            if parts[best] + parts[best + 1] not in self.ranks:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return [self.ranks[p] for p in parts]

    def _edges(self, token: int) -> tuple[list, list]:
        """The token's last, and first, part after each merge that makes it, with the rank of the merge that ends the part."""
        found = self.edges.get(token)
        if found is None:
            data = self.bytes_of[token]
            parts, first, last = [data[i : i + 1] for i in range(len(data))], [], []
            while len(parts) > 1:
                best = min(range(len(parts) - 1), key=lambda i: self.ranks.get(parts[i] + parts[i + 1], 1 << 40))
                rank = self.ranks[parts[best] + parts[best + 1]]
                if best == 0:
                    first.append((parts[0], rank))
                if best == len(parts) - 2:
                    last.append((parts[-1], rank))
                parts[best : best + 2] = [parts[best] + parts[best + 1]]
            found = self.edges[token] = ([*last, (data, 1 << 40)], [*first, (data, 1 << 40)])
        return found

    def stands(self, before: int | None, token: int) -> bool:
        """Whether token stays whole, alone or after the token before.

        Merges on either side of the border run in the order of their ranks. The
        pair falls if the parts at the border may merge before either of them
        grows; of equal ranks the left one goes first.
        """
        found = self.pairs.get((before, token))
        if found is None:
            if before is None:
                found = self.merged(self.bytes_of[token]) == [token]
            else:
                found = self.stands(None, token)
                left, right = (self._edges(before)[0], self._edges(token)[1]) if found else ((), ())
                i = j = 0
                while found and i < len(left) and j < len(right):
                    (a, grows_a), (b, grows_b) = left[i], right[j]
                    rank = self.ranks.get(a + b, 1 << 41)
                    found = not (rank < grows_a and rank <= grows_b)
                    i, j = (i + 1, j) if grows_a <= grows_b and i + 1 < len(left) else (i, j + 1)
            if len(self.pairs) > 1 << 20:
                self.pairs.clear()
            self.pairs[before, token] = found
        return found

    def _step(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        live, ended = [], None
        for history, node in self.sets[state]:
            child = self.children.get(node << 8 | byte)
            if child is None:
                continue
            live.append((history, child))
            token = self.token_at[child]
            if ended is None and token >= 0 and self.stands(history[-1], token):
                ended = (*history, token)
        live.append((ended, 0))
        shared, shortest = 1, min(len(h) for h, _ in live)
        while shared < shortest and all(h[shared] == ended[shared] for h, _ in live):
            shared += 1
        out = ended[1:shared]
        # What stands before the kept tokens matters only where a hypothesis has no other.
        before = ended[shared - 1] if any(len(h) == shared for h, _ in live) else None
        kept = tuple(((before, *h[shared:]), node) for h, node in live)
        number = self.numbers.get(kept)
        if number is None:
            number = self.numbers[kept] = len(self.sets)
            self.sets.append(kept)
        return number, out

    def encode(self, piece: bytes) -> list[int]:
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        if len(self.steps) > 4 * self.most or len(self.sets) > self.most:
            self._reset()
        out, state, steps = [], 0, self.steps
        for byte in piece:
            step = state << 8 | byte
            if step not in steps:
                steps[step] = self._step(state, byte)
            state, emitted = steps[step]
            if emitted:
                out += emitted
        if state not in self.ends:
            self.ends[state] = self.sets[state][-1][0][1:]
        out += self.ends[state]
        return out


# States of the UTF-8 machine: between characters, continuation bytes still due,
# and the lead bytes E0, ED, F0 and F4, whose next byte has a narrower range.
DONE, ONE, TWO, THREE, E0, ED, F0, F4, BAD = range(9)


def _utf8_table() -> np.ndarray:
    to = np.full((9, 256), BAD, np.uint8)
    to[DONE, :0x80] = DONE
    to[DONE, 0xC2:0xE0] = ONE
    to[DONE, 0xE0:0xF0] = TWO
    to[DONE, 0xF0:0xF5] = THREE
    for lead, state in ((0xE0, E0), (0xED, ED), (0xF0, F0), (0xF4, F4)):
        to[DONE, lead] = state
    to[ONE, 0x80:0xC0] = DONE
    to[TWO, 0x80:0xC0] = to[E0, 0xA0:0xC0] = to[ED, 0x80:0xA0] = ONE
    to[THREE, 0x80:0xC0] = to[F0, 0x90:0xC0] = to[F4, 0x80:0x90] = TWO
    return to


UTF8 = _utf8_table()


class Decoder:
    """Turns ids into bytes, a run of ids at a time, and keeps the UTF-8 state between runs."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        size = max(ranks.values(), default=0) + 1
        by_id = [b""] * size
        for token, rank in ranks.items():
            by_id[rank] = token
        self.flat = np.frombuffer(b"".join(by_id), np.uint8)
        self.length = np.array([len(t) for t in by_id], np.int64)
        self.start = np.cumsum(self.length) - self.length
        # Where each token leads from each state; most lead from DONE to DONE.
        self.leads = np.empty((9, size), np.uint8)
        for state in range(9):
            at = np.full(size, state, np.uint8)
            for k in range(int(self.length.max(initial=0))):
                longer = np.flatnonzero(self.length > k)
                at[longer] = UTF8[at[longer], self.flat[self.start[longer] + k]]
            self.leads[state] = at
        self.state = DONE

    def feed(self, ids: np.ndarray) -> bytes:
        state, rows = self.state, self.leads
        odd = np.flatnonzero(rows[DONE][ids] != DONE)
        i, n, k = 0, len(ids), 0
        while i < n and state != BAD:
            if state == DONE:  # whole characters up to the next odd token
                while k < len(odd) and odd[k] < i:
                    k += 1
                if k == len(odd):
                    break
                i = int(odd[k])
            state = int(rows[state, ids[i]])
            i += 1
        self.state = state
        return self.flat[ragged(self.start[ids], self.length[ids])].tobytes()

    def finish(self) -> bool:
        """Whether all bytes since the last call are whole characters."""
        whole, self.state = self.state == DONE, DONE
        return whole


@lru_cache(maxsize=2)
def _machines(path: str) -> tuple[Memo, Decoder]:
    """One per Python worker: it is reused by the worker's later tasks."""
    ranks = read_ranks(path)
    transducer = Transducer(ranks)
    return Memo(lambda word: transducer.encode(word.encode("utf-8", "surrogatepass"))), Decoder(ranks)


RUN = 1 << 14
_SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, valid_utf8 boolean"


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids): every text of docs(doc_id, text) by the ranks at path, without special tokens."""

    def run(batches):
        memo, _ = _machines(path)
        for batch in in_parts(batches):
            texts = batch.column(1).to_pylist()
            for i, j in blocks(texts):
                ids, bounds = encode_block(texts[i:j], memo)
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), lists], ["doc_id", "ids"])

    return docs.select("doc_id", empty_text().alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def round_trips(docs: DataFrame, path: str) -> DataFrame:
    """Digests of the ids of every text, and of the bytes that streaming decoding makes of them."""

    def run(batches):
        memo, decoder = _machines(path)
        for batch in in_parts(batches):
            texts = batch.column(1).to_pylist()
            for i, j in blocks(texts):
                ids, bounds = encode_block(texts[i:j], memo)
                rows = []
                for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    own, text = ids[a:b], hashlib.sha256()
                    for k in range(0, b - a, RUN):
                        text.update(decoder.feed(own[k : k + RUN]))
                    rows.append((b - a, hashlib.sha256(own.astype("<u4").tobytes()).hexdigest(), text.hexdigest(), decoder.finish()))
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.string(), pa.bool_()), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *columns], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "valid_utf8"])

    return docs.select("doc_id", empty_text().alias("text")).mapInArrow(run, _SCHEMA)
