"""Token ids in sorted-string-table shards, looked up by document id.

A shard file holds documents in ascending id order:

    block*            zstd frames, each of about ``BLOCK`` bytes of entries
    index             zstd frame: last key (8 bytes), offset (8), length (4) and documents (4) of each block, little-endian
    bloom filter      bits; two 32-bit halves of a key's hash give ``HASHES`` places
    footer            fixed size: offsets, counts, width of an id, end id, checksum, magic

    entry             shared u8, own u8, value length varint, the own bytes of the key, value
    key               the id's sign bit flipped, 8 bytes big-endian, without the ``shared`` bytes it begins with like the key before
    value             ids, little-endian, 2 bytes each if the vocabulary fits, else 4

The first entry of a block shares nothing, so a block can be read alone.  A lookup asks the Bloom filter, searches the sparse
index by halving and reads one block.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandem.llm import kernels as K
from tandem.llm.common import alone, held, int_lists, one_per_id, record, shared_dir, written
from tandem.llm.pretokens import distinct_pieces, piece_starts
from tandem.llm.ranges import bounds, part_of, parts_for
from tandem.shipping import ship

MAGIC = b"TDMSST01"
BLOCK = 128 << 10
HASHES = 7
BITS = 10
FOOTER = struct.Struct("<QIQIQQBIQ8s")
#: Distinct pre-tokens whose ids a worker keeps (some 40 bytes each), those it asks the library for in one text, and the texts (bytes) it
#: takes at once.
CACHE, ASK, TAKE = 1 << 20, 256, 2 << 20


def key_of(doc_id: int) -> bytes:
    return ((doc_id & 0xFFFFFFFFFFFFFFFF) ^ (1 << 63)).to_bytes(8, "big")


def id_of(key: bytes) -> int:
    x = int.from_bytes(key, "big") ^ (1 << 63)
    return x - (1 << 64) if x >> 63 else x


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _bloom_places(ids: np.ndarray, bits: int) -> np.ndarray:
    h = K.mix(K.unsigned(ids) + K._C1)
    a, b = h & K.U64(0xFFFFFFFF), h >> K.U64(32) | K.U64(1)
    return ((a[:, None] + np.arange(HASHES, dtype=K.U64)[None, :] * b[:, None]) % K.U64(bits)).astype(np.int64)


class Writer:
    """Writes one shard; ids of documents must ascend."""

    def __init__(self, file, width: int, end_id: int):
        self.file, self.width, self.end_id = file, width, end_id
        self.entries, self.size, self.in_block, self.last = [], 0, 0, b""
        self.index, self.offset, self.documents, self.tokens, self.keys = [], 0, 0, 0, []
        self.first_id = self.last_id = None
        self.zstd = pa.Codec("zstd", compression_level=1)

    def add(self, doc_id: int, ids: np.ndarray) -> None:
        key, value = key_of(doc_id), ids.astype("<u2" if self.width == 2 else "<u4").tobytes()
        if self.documents and key <= (self.last or self.index[-1][0]):
            raise ValueError("ids must ascend")
        shared = 0
        if self.last:
            while shared < 7 and key[shared] == self.last[shared]:
                shared += 1
        entry = bytes([shared, 8 - shared]) + _varint(len(value)) + key[shared:] + value
        self.entries.append(entry)
        self.size += len(entry)
        self.in_block += 1
        self.last = key
        self.first_id, self.last_id = self.first_id if self.documents else doc_id, doc_id
        self.documents += 1
        self.tokens += len(ids)
        self.keys.append(doc_id)
        if self.size >= BLOCK:
            self._end_block()

    def _frame(self, raw: bytes) -> bytes:
        return struct.pack("<I", len(raw)) + self.zstd.compress(raw, asbytes=True)

    def _put(self, raw: bytes) -> tuple[int, int]:
        at = self.offset
        self.file.write(raw)
        self.offset += len(raw)
        return at, len(raw)

    def _end_block(self) -> None:
        if self.entries:
            at, size = self._put(self._frame(b"".join(self.entries)))
            self.index.append((self.last, at, size, self.in_block))
            self.entries, self.size, self.in_block, self.last = [], 0, 0, b""

    def close(self) -> None:
        self._end_block()
        raw = b"".join(k + struct.pack("<QII", at, size, n) for k, at, size, n in self.index)
        index = self._put(self._frame(raw))
        bits = max(64, len(self.keys) * BITS)
        bloom = np.zeros(bits, dtype=bool)
        if self.keys:
            bloom[_bloom_places(np.array(self.keys, dtype=np.int64), bits).ravel()] = True
        filt = self._put(np.packbits(bloom, bitorder="little").tobytes())
        self.file.write(FOOTER.pack(index[0], index[1], filt[0], bits, self.documents, self.tokens, self.width, self.end_id, zlib.crc32(raw), MAGIC))


class Reader:
    def __init__(self, file):
        self.file = file
        file.seek(0, os.SEEK_END)
        file.seek(file.tell() - FOOTER.size)
        at, size, self._filter_at, self._bits, self.documents, self.tokens, self.width, self.end_id, crc, magic = FOOTER.unpack(file.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard file")
        raw = self._frame(at, size)
        if zlib.crc32(raw) != crc:
            raise ValueError("the index is damaged")
        self.index = [(raw[i : i + 8], *struct.unpack_from("<QII", raw, i + 8)) for i in range(0, len(raw), 24)]
        self._last = [k for k, *_ in self.index]

    def _frame(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        raw = self.file.read(size)
        return pa.Codec("zstd").decompress(raw[4:], decompressed_size=struct.unpack_from("<I", raw)[0], asbytes=True)

    def block(self, i: int) -> Iterator[tuple[int, np.ndarray]]:
        raw, at, key = self._frame(self.index[i][1], self.index[i][2]), 0, b""
        while at < len(raw):
            shared, own = raw[at], raw[at + 1]
            at += 2
            size = shift = 0
            while True:
                c = raw[at]
                at += 1
                size |= (c & 127) << shift
                shift += 7
                if c < 128:
                    break
            key = key[:shared] + raw[at : at + own]
            at += own
            yield id_of(key), np.frombuffer(raw, dtype="<u2" if self.width == 2 else "<u4", count=size // self.width, offset=at)
            at += size

    def get(self, doc_id: int) -> np.ndarray | None:
        """The ids of a document, or None."""
        places = _bloom_places(np.array([doc_id], dtype=np.int64), self._bits)[0]
        for p in places.tolist():
            self.file.seek(self._filter_at + p // 8)
            if not self.file.read(1)[0] >> p % 8 & 1:
                return None
        i = bisect_left(self._last, key_of(doc_id))
        return next((ids for own, ids in self.block(i) if own == doc_id), None) if i < len(self.index) else None

    def __iter__(self) -> Iterator[tuple[int, np.ndarray]]:
        for i in range(len(self.index)):
            yield from self.block(i)


class Known:
    """Ids of pre-tokens by their hash, in sorted arrays: a large one and a small one that is merged into it as it grows.

    A pre-token counts as known if hash, length and first eight bytes agree.
    """

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.flat, self.used = np.zeros(1 << 16, dtype=np.uint32), 0
        self.tiers = [np.zeros((0, 4), dtype=np.uint64), np.zeros((0, 4), dtype=np.uint64)]  # rows: hash, length and head, first id, ids

    def __len__(self) -> int:
        return sum(map(len, self.tiers))

    def find(self, h: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each one's first place in ``flat``, -1 if unknown, and number of ids."""
        first, n = np.full(len(h), -1, dtype=np.int64), np.zeros(len(h), dtype=np.int64)
        for t in self.tiers:
            if len(t):
                at = np.minimum(np.searchsorted(t[:, 0], h), len(t) - 1)
                ok = (t[at, 0] == h) & (t[at, 1] == check)
                first[ok], n[ok] = t[at[ok], 2], t[at[ok], 3]
        return first, n

    def add(self, h: np.ndarray, check: np.ndarray, ids: np.ndarray, n: np.ndarray) -> None:
        """Pre-tokens that aren't known yet, each hash once."""
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(len(self.flat), np.uint32)])
        self.flat[self.used : self.used + len(ids)] = ids
        first = self.used + np.cumsum(n) - n
        self.used += len(ids)
        rows = np.concatenate([self.tiers[1], np.stack([h, check, first.astype(np.uint64), n.astype(np.uint64)], axis=1)])
        self.tiers[1] = rows[np.argsort(rows[:, 0], kind="stable")]
        if 4 * len(self.tiers[1]) > len(self.tiers[0]):
            rows = np.concatenate(self.tiers)
            self.tiers = [rows[np.argsort(rows[:, 0], kind="stable")], rows[:0]]


class LibraryEncoder:
    """Ids by the tokenizers library, asked once for each distinct pre-token of a worker's recent texts.

    The library cuts a text into the same pre-tokens and encodes each alone, so ids of pre-tokens put together are the ids of the text.
    Before that it cuts out the strings of its added tokens, so texts that hold one are cut there first.  Some pre-tokens at a time go to
    the library as one text, with an added token's string between them, whose id shows where each one's ids end.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = {t.content.encode(): (i, t) for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.content}
        if any(t.lstrip or t.rstrip or t.single_word for _, t in added.values()):
            raise ValueError("added tokens that take more than their own string aren't supported")
        self.added = {c: i for c, (i, _) in added.items()}
        self.cut = re.compile(b"(" + b"|".join(re.escape(c) for c in sorted(added, key=len, reverse=True)) + b")") if added else None
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.known = Known()

    def ask(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pre-tokens, one after another, and how many each has."""
        ids, n = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        if not self.added:
            for i in range(0, len(pieces), 4096):
                got = [e.ids for e in self.tokenizer.encode_batch_fast(pieces[i : i + 4096], add_special_tokens=False)]
                ids += [np.array(x, dtype=np.uint32) for x in got]
                n.append(np.array([len(x) for x in got], dtype=np.int64))
            return np.concatenate(ids), np.concatenate(n)
        between, mark = next(iter(self.added.items()))
        join = between.decode().join
        for i in range(0, len(pieces), ASK):
            part = pieces[i : i + ASK]
            (e,) = self.tokenizer.encode_batch_fast([join(part)], add_special_tokens=False)
            got = np.array(e.ids, dtype=np.uint32)
            ends = np.append(np.flatnonzero(got == mark), len(got))
            if len(ends) != len(part):
                raise ValueError("a pre-token holds an added token")
            ids.append(np.delete(got, ends[:-1]))
            n.append(np.diff(ends, prepend=-1) - 1)
        return np.concatenate(ids), np.concatenate(n)

    def encode(self, texts: K.Texts) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts and each text's first."""
        raw = texts.data.tobytes()
        if not any(c in raw for c in self.added):
            return self._ordinary(texts, raw)
        parts = [self.cut.split(texts.bytes(i)) for i in range(len(texts))]  # every second part is an added token
        plain = K.Texts.of([x for p in parts for x in p[::2]])
        ids, first = self._ordinary(plain, plain.data.tobytes())
        out, size, at = [], [], 0
        for p in parts:
            n = 0
            for j, x in enumerate(p):
                own = np.array([self.added[x]], dtype=ids.dtype) if j % 2 else ids[first[at] : first[at + 1]]
                at += 1 - j % 2
                out.append(own)
                n += len(own)
            size.append(n)
        return np.concatenate(out), np.concatenate([[0], np.cumsum(size)])

    def _ordinary(self, texts: K.Texts, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        starts, first = piece_starts(texts, "tokenizers")
        code, rep = distinct_pieces(texts, starts)
        if not len(rep):
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        a, b = starts[rep], np.append(starts[1:], len(texts.data))[rep]
        h = K.hash_spans(texts.data, a, b)
        check = K.mix(K.heads(texts.data, a, b) + (b - a).astype(K.U64) * K._C2)
        if len(self.known) + len(rep) > CACHE:
            self.known.clear()
        at, n = self.known.find(h, check)
        new = np.flatnonzero(at < 0)
        flat = self.known.flat
        if len(new):
            ids, size = self.ask([raw[i:j].decode("utf-8", "replace") for i, j in zip(a[new].tolist(), b[new].tolist(), strict=True)])
            at[new], n[new] = self.known.used + np.cumsum(size) - size, size
            flat = np.concatenate([self.known.flat[: self.known.used], ids])
            self.known.add(h[new], check[new], ids, size)
        cut = np.concatenate([[0], np.cumsum(n[code])])
        return flat[np.arange(cut[-1]) + np.repeat(at[code] - cut[:-1], n[code])], cut[first]


def encoder(path: str) -> LibraryEncoder:
    return held(__name__, path, lambda: LibraryEncoder(path))


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_shards(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the shards into the folder ``path``, a URI that all executors reach; returns the manifest.

    Documents are dealt in ranges of their id, so shard after shard the ids ascend; a range is one file.  The manifest (shard,
    path, least and greatest id, documents, tokens before, tokens) has a row a shard; a file that isn't in it comes from a task that was lost and counts
    for nothing, because each attempt writes a file of its own.

    A null text counts as empty and has only the end id; rows without an id take no part, repeated ids as in
    :func:`tandem.llm.common.one_per_id`; an empty table gives an empty manifest.
    """
    own = one_per_id(docs, id_col, text_col)
    parts = parts_for(own, own.count(), 500)
    cuts = bounds(own, parts)
    dealt = own.withColumn("part", part_of(F.col("doc_id"), cuts)).repartitionById(len(cuts) + 1, F.col("part")).sortWithinPartitions("part", "doc_id")
    ship(docs.sparkSession)
    to = pa.schema([("shard", pa.int32()), ("path", pa.string()), ("first_id", pa.int64()), ("last_id", pa.int64()), ("documents", pa.int64()), ("tokens", pa.int64())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, writer, shard = None, None, None
        lib = encoder(tokenizer)
        fs, folder = _open(path)

        def ended():
            writer.close()
            out.close()
            return record({"shard": [shard], "path": [name], "first_id": [writer.first_id], "last_id": [writer.last_id], "documents": [writer.documents], "tokens": [writer.tokens]}, to)

        for batch in batches:
            for rows, texts in K.blocks(batch, limit=TAKE):
                ids, first = lib.encode(texts)
                part, doc = rows.column("part").to_pylist(), rows.column("doc_id").to_pylist()
                for i in range(len(rows)):
                    if part[i] != shard:
                        if writer:
                            yield ended()
                        shard = part[i]
                        name = f"{path.rstrip('/')}/shard-{shard:06d}-{uuid.uuid4().hex}.sst"
                        fs.create_dir(folder, recursive=True)
                        out = fs.open_output_stream(f"{folder.rstrip('/')}/{name.rsplit('/', 1)[1]}")
                        writer = Writer(out, lib.width, end_id)
                    writer.add(doc[i], np.append(ids[first[i] : first[i + 1]], end_id))
        if writer:
            yield ended()

    manifest = written(dealt.mapInArrow(task, "shard int, path string, first_id long, last_id long, documents long, tokens long"))
    before, rows = 0, []
    for r in manifest.orderBy("shard").collect():  # a row a shard
        rows.append((r.shard, r.path, r.first_id, r.last_id, r.documents, before, r.tokens))
        before += r.tokens
    return docs.sparkSession.createDataFrame(rows, "shard int, path string, first_id long, last_id long, documents long, start long, tokens long")


def read_shards(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, ids) of every document of the shards; ``start`` counts the ids of all documents before it."""
    ship(manifest.sparkSession)
    to = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone(__name__)
        for batch in batches:
            for r in batch.to_pylist():
                fs, name = _open(r["path"])
                with fs.open_input_file(name) as f:
                    reader, at = Reader(f), r["start"]
                    for i in range(len(reader.index)):
                        got = list(reader.block(i))
                        size = np.array([len(ids) for _, ids in got], dtype=np.int64)
                        first = np.concatenate([[0], np.cumsum(size)])
                        yield record({"doc_id": np.array([d for d, _ in got], dtype=np.int64), "start": at + first[:-1], "ids": int_lists(np.concatenate([ids for _, ids in got]).astype(np.int32), first, pa.int32())}, to)
                        at += int(first[-1])

    shards = max(1, manifest.count())
    return manifest.repartitionById(shards, F.col("shard") % shards).mapInArrow(task, "doc_id long, start long, ids array<int>")


def look_up(manifest: list[dict], doc_id: int) -> np.ndarray | None:
    """The ids of one document: halving over the shards' ranges of ids finds one file; its filter, index and one block do the rest.

    ``manifest`` has the rows of :func:`write_shards` in the order of ``shard``.
    """
    i = bisect_left(manifest, doc_id, key=lambda r: r["last_id"])
    if i == len(manifest) or doc_id < manifest[i]["first_id"]:
        return None
    fs, name = _open(manifest[i]["path"])
    with fs.open_input_file(name) as f:
        return Reader(f).get(doc_id)


def token_table(docs: DataFrame, tokenizer: str, end_id: int = 2, path: str | None = None) -> DataFrame:
    """Writes ``docs`` as shards (into the shared folder if no ``path`` is given) and reads them back: (doc_id, start, ids)."""
    return read_shards(write_shards(docs, path or shared_dir(docs.sparkSession) + "/sst", tokenizer, end_id))
