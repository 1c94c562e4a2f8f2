"""Byte-level BPE encoding and decoding with a rank file.

Tier 1: a minimal perfect hash over the vocabulary resolves every pre-token that is a token itself, for all distinct pre-tokens
of a block in a few array operations; the slot's own bytes are compared, so a stranger is never taken for a member.
Tier 2: a miss is merged byte by byte, with a heap of ranked pairs over a doubly linked list of its parts, in
O(n log n) for n bytes; the first pairs of all misses of a block are looked up at once.  What the misses gave is kept for later
blocks of the same worker: ``CACHE`` pre-tokens and, when these are full, as many that were used before them.
"""

from __future__ import annotations

import base64
import heapq
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandem.llm import kernels as K
from tandem.llm.common import arrow_map, held, int_lists, list_values
from tandem.llm.pretokens import distinct_pieces, piece_starts

#: Pre-tokens whose ids a worker keeps in each of two dictionaries, and texts (bytes) that it takes at once.
CACHE, TAKE = 200_000, 1 << 20


class PerfectHash:
    """A minimal perfect hash of distinct 64-bit keys: a bucket's displacement sends its keys to free slots."""

    def __init__(self, keys: np.ndarray):
        n = self.n = len(keys)
        self.buckets = max(1, n // 4)
        self.shift = np.zeros(self.buckets, dtype=np.int64)
        self.slot_key = np.zeros(max(n, 1), dtype=K.U64)
        self.slot_item = np.full(max(n, 1), -1, dtype=np.int64)
        bucket = (keys % K.U64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        size = np.bincount(bucket, minlength=self.buckets)
        first = np.concatenate([[0], np.cumsum(size)])
        free = np.ones(n, dtype=bool)
        tries = np.arange(1, 129)
        for b in np.argsort(-size, kind="stable"):
            if size[b] < 2:
                break
            own = order[first[b] : first[b + 1]]
            at = 0
            while True:
                slots = self._slots(keys[own][None, :], (at + tries)[:, None])
                ok = free[slots].all(1)
                for t in np.flatnonzero(ok):
                    if len(set(slots[t].tolist())) == len(own):
                        break
                else:
                    at += len(tries)
                    if at > 1 << 22:
                        raise ValueError("keys repeat")
                    continue
                self.shift[b] = at + tries[t]
                free[slots[t]] = False
                self.slot_key[slots[t]], self.slot_item[slots[t]] = keys[own], own
                break
        left = iter(np.flatnonzero(free).tolist())
        for b in np.flatnonzero(size == 1):
            slot, own = next(left), order[first[b]]
            self.shift[b] = -1 - slot
            self.slot_key[slot], self.slot_item[slot] = keys[own], own

    def _slots(self, keys: np.ndarray, shift: np.ndarray) -> np.ndarray:
        return (K.mix(keys + shift.astype(np.int64).view(K.U64) * K._C1) % K.U64(max(self.n, 1))).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key among those of the table, -1 for strangers."""
        if not self.n:
            return np.full(len(keys), -1, dtype=np.int64)
        shift = self.shift[(keys % K.U64(self.buckets)).astype(np.int64)]
        slot = np.where(shift < 0, -1 - shift, self._slots(keys, np.maximum(shift, 0)))
        return np.where(self.slot_key[slot] == keys, self.slot_item[slot], -1)


class Tokens:
    """The tokens of a rank file by their ids: all that decoding takes."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        tokens = [t for t, _ in sorted(self.ranks.items(), key=lambda x: x[1])]
        self.ids = np.array(sorted(self.ranks.values()), dtype=np.int64)
        self.texts = K.Texts.of(tokens)
        self.row = np.full(int(self.ids.max()) + 1 if len(self.ids) else 1, -1, dtype=np.int64)
        self.row[self.ids] = np.arange(len(self.ids))

    def decode(self, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the ids and each text's first byte."""
        bad = (ids < 0) | (ids >= len(self.row))
        if bad.any() or (self.row[ids] < 0).any():
            raise ValueError("an id is not in the vocabulary")
        at, cut = K.ragged(self.texts.offsets, self.row[ids])
        return self.texts.data[at], cut[first]


class Vocabulary(Tokens):
    """What encoding takes as well: the perfect hash, the pairs that merge, the pre-tokens it has merged."""

    def __init__(self, path: str):
        super().__init__(path)
        self.perfect = PerfectHash(K.hash_spans(self.texts.data, self.texts.offsets[:-1], self.texts.offsets[1:]))
        self.byte = np.array([self.ranks[bytes([i])] for i in range(256)], dtype=np.int64)
        #: the rank of each two bytes, -1 if they don't merge
        self.two = np.array([[self.ranks.get(bytes([i, j]), -1) for j in range(256)] for i in range(256)], dtype=np.int64)
        #: left id << 32 | right id to the id of both together, which is the pair's rank
        self.pairs = {
            left << 32 | right: rank
            for token, rank in self.ranks.items()
            for i in range(1, len(token))
            if (left := self.ranks.get(token[:i])) is not None and (right := self.ranks.get(token[i:])) is not None
        }
        self.cache: dict[bytes, bytes] = {}  # ids as 32-bit integers
        self.older: dict[bytes, bytes] = {}  # what the cache held when it was last full

    def merge(self, part: list[int], rank: list[int], heap: list[int]) -> list[int]:
        """Ids of a piece from those of its bytes: always the pair of least rank merges, the leftmost of equal ones.

        ``rank`` has the rank of the pair that begins at each place, -1 for none.  A heap entry is ``rank << 32 | place``; one whose
        place has another pair by now is stale and passed over.  All three lists are used up.
        """
        get, push, pop = self.pairs.get, heapq.heappush, heapq.heappop
        n = len(part)
        rank.append(-1)  # of the last place
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heapq.heapify(heap)
        while heap:
            top = pop(heap)
            r, i = top >> 32, top & 0xFFFFFFFF
            if rank[i] != r:
                continue
            j = after[i]
            k = after[i] = after[j]
            part[i], part[j], rank[j] = r, -1, -1
            q = -1
            if k < n:
                before[k] = i
                if (q := get(r << 32 | part[k], -1)) >= 0:
                    push(heap, q << 32 | i)
            rank[i] = q
            h = before[i]
            if h >= 0:
                q = rank[h] = get(part[h] << 32 | r, -1)
                if q >= 0:
                    push(heap, q << 32 | h)
        return [x for x in part if x >= 0]

    def merged(self, data: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[bytes]:
        """:meth:`merge` of the pieces of ``data`` from a to b; their bytes' pairs are looked up for all of them at once."""
        cut = np.concatenate([[0], np.cumsum(b - a)])
        at = np.arange(cut[-1]) + np.repeat(a - cut[:-1], b - a)
        part = self.byte[data[at]]
        rank = np.full(len(at), -1, dtype=np.int64)
        rank[:-1] = self.two[data[at[:-1]], data[at[1:]]]
        rank[cut[1:] - 1] = -1  # the last byte of a piece begins no pair
        some = np.flatnonzero(rank >= 0)
        heap = (rank[some] << 32 | (some - np.repeat(cut[:-1], b - a)[some])).tolist()
        first = np.searchsorted(some, cut).tolist()
        part, rank, cut = part.tolist(), rank.tolist(), cut.tolist()
        out = []
        for i in range(len(a)):
            x, y, u, v = cut[i], cut[i + 1], first[i], first[i + 1]
            out.append(array("I", self.merge(part[x:y], rank[x : y - 1], heap[u:v]) if u < v else part[x:y]).tobytes())
        return out

    def of_pieces(self, texts: K.Texts, starts: np.ndarray, rep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the distinct pieces, one after another, and each one's first."""
        ends = np.append(starts[1:], len(texts.data))
        a, b = starts[rep], ends[rep]
        row = self.perfect.find(K.hash_spans(texts.data, a, b))
        raw, own = texts.data, self.texts
        size = b - a
        known = np.flatnonzero(row >= 0)
        same = size[known] == (own.offsets[row[known] + 1] - own.offsets[row[known]])
        for width in range(int(size[known].max()) if len(known) else 0):
            has = np.flatnonzero(same & (size[known] > width))
            same[has] = raw[a[known[has]] + width] == own.data[own.offsets[row[known[has]]] + width]
        row[known[~same]] = -1
        count = np.ones(len(rep), dtype=np.int64)
        missed = np.flatnonzero(row < 0)
        text = raw.tobytes()
        pieces = [text[x:y] for x, y in zip(a[missed].tolist(), b[missed].tolist(), strict=True)]
        got = [self.cache.get(piece) for piece in pieces]
        left = [i for i, ids in enumerate(got) if ids is None]
        for i in left:
            got[i] = self.older.get(pieces[i])
        new = np.array([i for i in left if got[i] is None], dtype=np.int64)
        for i, ids in zip(new.tolist(), self.merged(raw, a[missed[new]], b[missed[new]]) if len(new) else (), strict=True):
            got[i] = ids
        for i in left:
            if len(pieces[i]) <= 64:
                if len(self.cache) >= CACHE:
                    self.cache, self.older = {}, self.cache
                self.cache[pieces[i]] = got[i]
        count[missed] = [len(ids) // 4 for ids in got]
        first = np.concatenate([[0], np.cumsum(count)])
        flat = np.empty(first[-1], dtype=np.int64)
        hit = np.flatnonzero(row >= 0)
        flat[first[hit]] = self.ids[row[hit]]
        if got:
            at, _ = K.ragged(first, missed)
            flat[at] = np.frombuffer(b"".join(got), dtype=np.uint32)
        return flat, first

    def encode(self, texts: K.Texts) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts and each text's first."""
        starts, first = piece_starts(texts, "tiktoken")
        code, rep = distinct_pieces(texts, starts)
        flat, of = self.of_pieces(texts, starts, rep)
        at, cut = K.ragged(of, code)
        return flat[at], cut[first]


def vocabulary(path: str) -> Vocabulary:
    return held(__name__, ("encode", path), lambda: Vocabulary(path))


def tokens(path: str) -> Tokens:
    return held(__name__, ("decode", path), lambda: Tokens(path))


def _encode(path: str):
    def encode(batch: pa.RecordBatch) -> Iterator[dict]:
        for rows, texts in K.blocks(batch, limit=TAKE):
            ids, first = vocabulary(path).encode(texts)
            yield {"doc_id": rows.column("doc_id"), "ids": int_lists(ids, first, pa.int32())}

    return encode


def _decode(path: str):
    def decode(batch: pa.RecordBatch) -> Iterator[dict]:
        for at in range(0, len(batch), 1024):
            rows = batch.slice(at, 1024)
            ids, first = list_values(rows.column("ids"))
            data, cut = tokens(path).decode(ids, first)
            out = pa.Array.from_buffers(pa.large_binary(), len(rows), [None, pa.py_buffer(cut.astype(np.int64)), pa.py_buffer(data)])
            yield {"doc_id": rows.column("doc_id"), "ids": rows.column("ids"), "decoded": out}

    return decode


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids): the ids of each row's whole text by the rank file at ``path``, without special tokens.

    A null or empty text has no ids.  Rows are encoded one by one: ids of rows may be null or repeat, equal texts get equal
    ids, an empty table gives an empty table, other columns are not looked at.  ``path`` must be readable on the executors.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return arrow_map(own, _encode(path), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, decoded): the bytes that the ids stand for; a null list counts as empty, an unknown id is an error."""
    return arrow_map(encoded.select("doc_id", "ids"), _decode(path), "doc_id long, ids array<int>, decoded binary")
