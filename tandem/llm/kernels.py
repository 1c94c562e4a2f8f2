"""Vectorised text kernels over Arrow string buffers.

Everything works on the concatenated UTF-8 bytes of a column and on arrays of offsets, so no Python
string is made for a word.  A batch is cut into blocks of a few megabytes (:func:`blocks`), which bounds
the memory of a task whatever the size of a batch; one text longer than a block is a block of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
BLOCK_BYTES = 4 << 20

_C1, _C2, _C3 = U64(0x9E3779B97F4A7C15), U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
_MASK = np.array([(1 << (8 * i)) - 1 for i in range(9)], dtype=U64)
# U+0020 and U+0009 to U+000D, the separators of words
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
# A-Z to a-z
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


class Texts:
    """UTF-8 bytes of some texts end to end, with len + 1 offsets; a null counts as an empty text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets

    def __len__(self) -> int:
        return len(self.offsets) - 1

    @classmethod
    def of(cls, texts: list[bytes]) -> Texts:
        offsets = np.zeros(len(texts) + 1, dtype=np.int64)
        np.cumsum([len(t) for t in texts], out=offsets[1:])
        return cls(np.frombuffer(b"".join(texts), dtype=np.uint8), offsets)

    def bytes(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


def column_texts(column: pa.Array) -> Texts:
    """The texts of an Arrow string or binary column, without copying its bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:  # a null's slot may hold bytes
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    _, offsets, data = column.buffers()
    if not len(column):
        return Texts(np.zeros(0, np.uint8), np.zeros(1, np.int64))
    off = np.frombuffer(offsets, dtype=np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return Texts(raw[off[0] : off[-1]], off - off[0])


def blocks(batch: pa.RecordBatch, column: str = "text", limit: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, Texts]]:
    """Runs of rows whose texts fit in ``limit`` bytes (or one row), with their texts."""
    texts = column_texts(batch.column(column))
    at, n = 0, len(texts)
    while at < n:
        end = int(np.searchsorted(texts.offsets, texts.offsets[at] + limit, side="right")) - 1
        end = min(n, max(end, at + 1))
        off = texts.offsets[at : end + 1]
        yield batch.slice(at, end - at), Texts(texts.data[off[0] : off[-1]], off - off[0])
        at = end


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit words."""
    h = (h ^ (h >> U64(30))) * _C2
    h = (h ^ (h >> U64(27))) * _C3
    return h ^ (h >> U64(31))


def lower(texts: Texts) -> Texts:
    return Texts(_LOWER[texts.data], texts.offsets)


def word_spans(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (in bytes) of the words ``[^\\x20\\x09-\\x0D]+``, and per text the index of its first word."""
    n = len(texts.data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
    ink = ~_SPACE[texts.data]
    first = ink.copy()
    first[1:] &= ~ink[:-1]
    last = ink.copy()
    last[:-1] &= ~ink[1:]
    cuts = texts.offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    first[cuts] = ink[cuts]
    last[cuts - 1] = ink[cuts - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, texts.offsets)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span, eight bytes a step."""
    padded = np.zeros(len(data) + 8, dtype=np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    size = ends - starts
    h = mix((eight[starts] & _MASK[np.minimum(size, 8)]) + size.astype(U64) * _C1)
    todo = np.flatnonzero(size > 8)
    at = 8
    while len(todo):
        left = size[todo] - at
        h[todo] = mix((h[todo] ^ (eight[starts[todo] + at] & _MASK[np.minimum(left, 8)])) * _C1 + U64(at))
        todo = todo[left > 8]
        at += 8
    return h


def heads(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The first eight bytes of each span as a number."""
    padded = np.zeros(len(data) + 8, dtype=np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))[starts] & _MASK[np.minimum(ends - starts, 8)]


def double(h: np.ndarray, length: int) -> np.ndarray:
    """From hashes of all windows of ``length`` words to those of twice the length (shorter by ``length``)."""
    return mix(h[:-length] * _C1 + (h[length:] ^ _C3)) if len(h) > length else h[:0]


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of the words i to i + k - 1, for each i; runs over ends of texts too."""
    if len(words) < k:
        return words[:0]
    h = words[: len(words) - k + 1].copy()
    for j in range(1, k):
        h = h * _C1 + words[j : len(words) - k + 1 + j]
    return mix(h)


def row_of(first: np.ndarray) -> np.ndarray:
    """For each item its row, when ``first`` has each row's first item and the end."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def shingles(texts: Texts, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each text's ``k``-word shingles, ascending, and the index of each text's first.

    A text with fewer words has one shingle, of all its words; one without words has none.
    """
    starts, ends, first = word_spans(texts)
    words = hash_spans(texts.data, starts, ends)
    n_words = np.diff(first)
    full = window_hashes(words, k)
    row = row_of(first)[: len(full)]
    ok = np.arange(len(full)) + k <= first[1:][row]
    h, size = full[ok], np.maximum(n_words - k + 1, 0)
    short = np.flatnonzero((n_words > 0) & (n_words < k))
    if len(short):
        hs = np.zeros(len(short), dtype=U64)
        for j in range(k - 1):
            has = n_words[short] > j
            hs[has] = hs[has] * _C1 + words[first[short[has]] + j]
        h = np.insert(h, (np.cumsum(size) - size)[short], mix(hs + n_words[short].astype(U64)))
        size[short] = 1
    return distinct_in_rows(h, np.concatenate([[0], np.cumsum(size)]))


def distinct_in_rows(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorts the values of each row and leaves out repeated ones."""
    h = h.copy()
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        h[a:b].sort()
    new = np.ones(len(h), dtype=bool)
    new[1:] = h[1:] != h[:-1]
    new[first[:-1][first[:-1] < len(h)]] = True
    return h[new], np.concatenate([[0], np.cumsum(new)])[first]


def ragged(first: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the items of the given rows, one row after another, and each row's first in that list."""
    size = first[rows + 1] - first[rows]
    out = np.zeros(len(rows) + 1, dtype=np.int64)
    np.cumsum(size, out=out[1:])
    return np.arange(out[-1]) + np.repeat(first[rows] - out[:-1], size), out


def signed(h: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(h).view(np.int64)


def unsigned(h) -> np.ndarray:
    return np.ascontiguousarray(np.asarray(h, dtype=np.int64)).view(U64)
