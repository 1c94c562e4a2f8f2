"""K-mers that no other read of their locus has: packed sets of tasks' k-mers, merged bucket by bucket.

A task names each distinct k-mer of a locus once, however many reads and places have it, with its only read (or that there are
several) and its number of places.  Names are sorted and kept as differences in planes of bytes, so that compression takes most of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Places that a task looks at together, names that a bucket holds before they are merged.
PLACES, MERGE = 1 << 23, 1 << 20
#: Buckets in which k-mers meet, and how many neighbouring names stay together (as a power of two).
BUCKETS, RUN = 4096, 13
PACKED = pa.schema([("bucket", pa.int32()), *((c, pa.binary()) for c in ("loci", "sizes", "names", "who", "times", "reads"))])
PACKED_DDL = "bucket int, loci binary, sizes binary, names binary, who binary, times binary, reads binary"
_CODE = np.full(256, 4, np.uint8)
for _i, _b in enumerate(b"ACGT"):
    _CODE[_b] = _i


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose bits all depend on all bits."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def names(text: np.ndarray, k: int) -> np.ndarray:
    """For each window of ``k`` bytes a number: of four letters themselves as digits, of others a hash from the upper half."""
    n = len(text) - k + 1
    code = _CODE[text]
    strange = np.concatenate([[0], np.cumsum(code > 3)])
    out = np.zeros(n, U64)
    if k <= 31:
        for i in range(k):
            out <<= U64(2)
            out |= code[i : i + n] & 3
    at = np.flatnonzero((strange[k:] > strange[:-k]) | (k > 31))
    if len(at):
        h = np.zeros(len(at), U64)
        for i in range(k):
            h = mix(h * U64(0x9E3779B97F4A7C15) + text[at + i].astype(U64) + U64(1))
        out[at] = h | U64(1 << 63)
    return out


def _planes(x: np.ndarray) -> bytes:
    return x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def _values(b: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(size, -1).T).view(kind).ravel()


def _pack(k: int, locus: np.ndarray, read: np.ndarray, text: list[bytes]) -> Iterator[pa.RecordBatch]:
    """The k-mers of a block of reads, a row a bucket."""
    by_locus = np.argsort(locus, kind="stable")
    size = np.array([len(text[i]) for i in by_locus])
    whole = np.frombuffer(b"".join([text[i] for i in by_locus]), np.uint8)
    own, who = locus[by_locus], read[by_locus]
    reads, number = np.unique(who, return_inverse=True)
    row = np.repeat(np.arange(len(size), dtype=np.int32), size)
    n = len(whole) - k + 1
    name = names(whole, k)
    inside = row[:n] == row[k - 1 :]
    name, row = name[inside], row[:n][inside]
    parts = []
    first_rows = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
    cuts = np.searchsorted(row, np.append(first_rows, len(own)))
    for r, a, b in zip(first_rows.tolist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        if a == b:
            continue
        order = np.argsort(name[a:b], kind="stable")
        x, w = name[a:b][order], number[row[a:b][order]]
        at = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
        low, high = np.minimum.reduceat(w, at), np.maximum.reduceat(w, at)
        one, x = low == high, x[at]
        times = np.where(one, np.diff(np.append(at, b - a)), 0).astype(np.uint32)
        bucket = (mix(U64(own[r]) ^ mix(x >> U64(RUN))) % U64(BUCKETS)).astype(np.int32)
        parts.append((bucket, np.full(len(x), own[r]), x, np.where(one, low + 1, 0).astype(np.uint32), times))
    if not parts:
        return
    bucket, loc, name, who, times = (np.concatenate(c) for c in zip(*parts, strict=True))
    order = np.argsort(bucket, kind="stable")  # locus by locus and by name within a bucket
    bucket, loc, name, who, times = (c[order] for c in (bucket, loc, name, who, times))
    at = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]).tolist()
    rows = []
    for a, b in zip(at, [*at[1:], len(bucket)], strict=True):
        first = np.flatnonzero(np.r_[True, loc[a + 1 : b] != loc[a : b - 1]])
        used, index = np.unique(who[a:b], return_inverse=True)
        if used[0]:  # index 0 is for several reads
            used, index = np.r_[np.uint32(0), used], index + 1
        rows.append((
            int(bucket[a]), loc[a:b][first].tobytes(), np.diff(np.append(first, b - a)).tobytes(), _planes(np.diff(name[a:b], prepend=U64(0))),
            _planes(index.astype(np.uint32)), _planes(times[a:b]), reads[used[1:] - 1].tobytes(),
        ))
    for i in range(0, len(rows), 512):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[i : i + 512], strict=True), PACKED, strict=True)], schema=PACKED)


def packed(k: int):
    """(locus, read, text) to rows of ``PACKED``."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def block():
            locus, read = (np.concatenate([b.column(i).to_numpy() for b in held]).view(U64) for i in (0, 1))
            return _pack(k, locus, read, [x for b in held for x in b.column(2).to_pylist()])

        for batch in batches:
            if not len(batch):
                continue
            held.append(batch)
            size += batch.column(2).nbytes
            if size >= PLACES:
                yield from block()
                held, size = [], 0
        if held:
            yield from block()

    return task


def _merged(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """(key, read, several, times) with each key once."""
    key, read, several, times = (np.concatenate(c) for c in zip(*parts, strict=True))
    order = np.argsort(key, kind="stable")
    key, read, several, times = key[order], read[order], several[order], times[order]
    at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    other = np.minimum.reduceat(read, at) != np.maximum.reduceat(read, at)
    return key[at], read[at], np.logical_or.reduceat(several, at) | other, np.add.reduceat(times, at)


def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``PACKED`` sorted by bucket to (read, wrong): how many places a read has of k-mers that are its own in this bucket."""
    to = pa.schema([("read", pa.int64()), ("wrong", pa.int64())])
    bucket, parts, size = None, [], 0

    def done():
        _, read, several, times = _merged(parts)
        own, at = np.unique(read[~several], return_inverse=True)
        wrong = np.zeros(len(own), np.int64)
        np.add.at(wrong, at, times[~several])
        return pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(wrong)], schema=to)

    for batch in batches:
        for b, loci, sizes, name, who, times, reads in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if b != bucket and parts:
                yield done()
                parts, size = [], 0
            bucket = b
            name, who = np.cumsum(_values(name, U64), dtype=U64), _values(who, np.uint32)
            key = mix(np.repeat(np.frombuffer(loci, U64), np.frombuffer(sizes, np.int64)) ^ mix(name))
            parts.append((key, np.r_[U64(0), np.frombuffer(reads, U64)][who], who == 0, _values(times, np.uint32).astype(np.int64)))
            size += len(key)
            if size > MERGE and len(parts) > 1:
                parts = [_merged(parts)]
                size = len(parts[0][0]) // 2  # what is merged already may grow to twice before it is again
    if parts:
        yield done()
