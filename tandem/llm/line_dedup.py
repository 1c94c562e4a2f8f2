"""Fuzzy line dedup by MinHash.

Lines are what newlines separate, compared without white space at both ends.  A line's shingles are the runs of ``CHARS`` characters
at *every* place (a shorter line is one shingle), hashed to 64 bits.  ``ROWS * BANDS`` minima of the hashes under exclusive-or with
fixed words (each word orders random hashes anew) give a band key for each ``ROWS`` of them; lines of Jaccard similarity 0.8 share a
band with probability 1 - (1 - 0.8 ** 3) ** 7 = 0.993, of 0.85 with 0.9987.

1. Equal lines are one node, named by a 64-bit hash, with its first place; a task signs a line once, and sums before the shuffle make hot
   lines harmless.
2. Each bucket of a band pairs its nodes with one of them: that which shares most buckets with others, so mostly the text that the
   others are edits of.  Pairs are verified by exact Jaccard similarity of all shingles, and links give components by distributed
   union-find.
3. Buckets of more than two nodes that are still in several components are cut in blocks of about ``MEET`` nodes, and each two blocks
   meet in a task.  There all pairs of different components are looked at through a longer signature of ``LONG`` minima, an array
   comparison; those that agree in less than ``AGREE`` of them (which lines of similarity 0.8 do with a probability under 0.001) are
   dropped, the others verified exactly, the likeliest first, unless a link has joined their components by then.  Only links
   leave the task, so no pair of a hot bucket becomes a row, and none is left out.  A pair is looked at in the first band it shares.
4. Of each component the line of the earliest place stays.  Places of lines that *stay* go back to their documents, one a
   component; every other line of a document that isn't blank goes.

Signing and verifying are Arrow tasks, everything else is DataFrame functions.  The form with DataFrame functions alone gave the same
rows, but not within the limits; README has its figures.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandem.llm import kernels as K
from tandem.llm.common import alone, arrow_map, list_values, record, written
from tandem.llm.components import connected_components
from tandem.llm.verify import verified
from tandem.shipping import ship

CHARS = 9
BANDS, ROWS = 7, 3
#: Minima of the longer signature (a byte each), how many of them a pair must share to be verified, nodes of a block.
LONG, AGREE, MEET = 128, 84, 256
#: Texts (bytes) that a task looks at together, and lines that it remembers having signed.
TAKE, SEEN = 1 << 20, 1 << 18
_BASE = [pow(0x9E3779B97F4A7C15, 1 << i, 1 << 64) for i in range(4)]
_BASE32 = [np.uint32(b & 0xFFFFFFFF) for b in _BASE]


def seeds(n: int, of: int = 0) -> np.ndarray:
    """Words for the exclusive-or: multiples of an odd constant."""
    return np.array([(i + 1 + of) * 0x9E3779B1 % (1 << 32) for i in range(n)], dtype=np.uint32)


def lines_of(texts: K.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each line that isn't blank its text, its number in it, and its first byte and end without white space at both ends."""
    data, n = texts.data, len(texts.data)
    new = np.flatnonzero(data == 0x0A)
    # a newline may be the last byte of its text: the empty line after it starts where the next text does
    own = np.concatenate([np.arange(len(texts)), np.searchsorted(texts.offsets, new, side="right") - 1])
    order = np.lexsort((np.concatenate([texts.offsets[:-1], new + 1]), own))
    start, row = np.concatenate([texts.offsets[:-1], new + 1])[order], own[order]
    last = np.ones(len(start), dtype=bool)
    last[:-1] = row[1:] != row[:-1]
    end = np.empty(len(start), dtype=np.int64)
    end[:-1] = start[1:] - 1
    end[last] = texts.offsets[1:][row[last]]
    at = np.arange(len(start)) - np.searchsorted(row, row)
    ink = np.flatnonzero(~K._SPACE[data])
    a, b = np.searchsorted(ink, start), np.searchsorted(ink, end) - 1
    some = np.flatnonzero(b >= a) if n else np.zeros(0, np.int64)
    return row[some], at[some], ink[a[some]], ink[b[some]] + 1


def line_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64 bits of each line's digest."""
    raw = data.tobytes()
    return np.frombuffer(b"".join([blake2b(raw[a:b], digest_size=8).digest() for a, b in zip(start.tolist(), end.tolist(), strict=True)]), dtype="<u8")


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    """The characters of UTF-8 bytes, and for each byte (and the end) how many characters begin before it; None if all are ASCII."""
    if not (data >= 0x80).any():
        return data.astype(np.uint32), None
    before = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=before[1:])
    code = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), dtype="<u4")
    if len(code) != before[-1]:  # not UTF-8 throughout: every byte that doesn't continue a character counts as one
        code = data[(data & 0xC0) != 0x80].astype(np.uint32)
    return code, before


def shingles(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles at every place of each line (its bytes from start to end), repeated ones too, and each line's first.

    A line of fewer than ``CHARS`` characters has one shingle, all of it; no line may be empty.
    """
    c, before = code_points(data)
    c = c.astype(K.U64)
    if before is not None:
        start, end = before[start], before[end]
    n = end - start
    # polynomials of 2, 4, 8 characters, each from two of half its length, then one more character
    h = c
    for i in range(3):
        w = 1 << i
        h = h[:-w] * K.U64(_BASE[i]) + h[w:] if len(h) > w else h[:0]
    h = K.mix(h[:-1] * K.U64(_BASE[0]) + c[8:]) if len(c) > 8 else c[:0]
    size = np.maximum(n - CHARS + 1, 1)
    first = np.concatenate([[0], np.cumsum(size)])
    at = np.arange(first[-1]) + np.repeat(start - first[:-1], size)
    short = np.flatnonzero(n < CHARS)
    if not len(short):
        return h[at], first
    out = h[np.minimum(at, max(len(h) - 1, 0))] if len(h) else np.zeros(len(at), K.U64)
    x = np.zeros(len(short), dtype=K.U64)
    for j in range(CHARS - 1):
        has = np.flatnonzero(n[short] > j)
        x[has] = x[has] * K.U64(_BASE[0]) + c[start[short[has]] + j]
    out[first[short]] = K.mix(x * K._C2 + n[short].astype(K.U64))
    return out, first


def signatures(data: np.ndarray, start: np.ndarray, end: np.ndarray, words: np.ndarray) -> np.ndarray:
    """For each word the least of each line's shingle hashes under exclusive-or with it; hashes of 32 bits do for signatures.

    Lines are taken in the order of their places, so each minimum is one pass over the characters and nothing is copied.
    """
    c, before = code_points(data)
    order = np.argsort(start, kind="stable")
    s, e = start[order], end[order]
    if before is not None:
        s, e = before[s], before[e]
    n = e - s
    h = c
    for i in range(3):
        w = 1 << i
        h = h[:-w] * _BASE32[i] + h[w:] if len(h) > w else h[:0]
    h = _mix32(h[:-1] * _BASE32[0] + c[8:]) if len(c) > 8 else c[:0]
    full = np.flatnonzero(n >= CHARS)
    short = np.flatnonzero(n < CHARS)
    x = np.zeros(len(short), dtype=np.uint32)
    for j in range(CHARS - 1):
        has = np.flatnonzero(n[short] > j)
        x[has] = x[has] * _BASE32[0] + c[s[short[has]] + j]
    x = _mix32(x * _BASE32[1] + n[short].astype(np.uint32))
    at = np.empty(2 * len(full), dtype=np.int64)
    at[0::2], at[1::2] = s[full], e[full] - CHARS + 1
    h = np.append(h, np.uint32(0))  # a line may end with the last shingle
    out = np.empty((len(words), len(start)), dtype=np.uint32)
    for i, w in enumerate(words):
        if len(full):
            out[i, order[full]] = np.minimum.reduceat(h ^ w, at)[::2]
        out[i, order[short]] = x ^ w
    return out


def _mix32(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint32(16))) * np.uint32(0x7FEB352D)
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x846CA68B)
    return h ^ (h >> np.uint32(16))


def shingle_sets(texts: K.Texts) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ascending shingle hashes of each text, a line without white space at its ends."""
    return K.distinct_in_rows(*shingles(texts.data, texts.offsets[:-1], texts.offsets[1:]))


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to (h, doc_id, at, b0...): the distinct lines of each document; band keys where the task signs the line."""
    alone(__name__)
    to = pa.schema([("h", pa.int64()), ("doc_id", pa.int64()), ("at", pa.int32()), *[(f"b{i}", pa.int64()) for i in range(BANDS)]])
    seen: set[int] = set()
    for batch in batches:
        for rows, texts in K.blocks(batch, limit=TAKE):
            row, at, start, end = lines_of(texts)
            if not len(row):
                continue
            h = line_hashes(texts.data, start, end)
            order = np.lexsort((at, row, h))
            new = np.ones(len(h), dtype=bool)
            new[1:] = (h[order][1:] != h[order][:-1]) | (row[order][1:] != row[order][:-1])
            pick = order[new]  # a line's first place in its document; equal lines stand together
            h, row, at, start, end = h[pick], row[pick], at[pick], start[pick], end[pick]
            head = np.ones(len(h), dtype=bool)
            head[1:] = h[1:] != h[:-1]
            if len(seen) > SEEN:
                seen.clear()
            fresh = np.array([i for i in np.flatnonzero(head).tolist() if (x := int(h[i])) not in seen and not seen.add(x)], dtype=np.int64)
            bands = np.zeros((BANDS, len(h)), dtype=np.int64)
            if len(fresh):
                m = signatures(texts.data, start[fresh], end[fresh], seeds(ROWS * BANDS)).astype(K.U64)
                for i in range(BANDS):
                    key = np.full(len(fresh), i + 1, dtype=K.U64)
                    for j in range(ROWS):
                        key = K.mix(key * K._C1 + m[ROWS * i + j])
                    bands[i, fresh] = K.signed(key)
            none = np.ones(len(h), dtype=bool)
            none[fresh] = False
            doc = np.asarray(rows.column("doc_id"))[row]
            yield record({"h": K.signed(h), "doc_id": doc, "at": at.astype(np.int32), **{f"b{i}": pa.array(bands[i], mask=none) for i in range(BANDS)}}, to)


def _pick(batch: pa.RecordBatch) -> Iterator[dict]:
    """(text, wanted) to the wanted lines (key, text); where rows repeat an id the place may hold another line, which doesn't count."""
    for rows, texts in K.blocks(batch, limit=TAKE):
        row, at, start, end = lines_of(texts)
        flat = rows.column("wanted").flatten()
        _, first = list_values(rows.column("wanted"))
        of, place, key = K.row_of(first), flat.field("at").to_numpy(), flat.field("h").to_numpy()
        code = row.astype(np.int64) << 31 | at
        i = np.searchsorted(code, of.astype(np.int64) << 31 | place)
        i = np.minimum(i, len(code) - 1) if len(code) else i[:0]
        if not len(i):
            continue
        ok = (code[i] == (of.astype(np.int64) << 31 | place)) & (K.signed(line_hashes(texts.data, start[i], end[i])) == key)
        a, b = start[i[ok]], end[i[ok]]
        cut = np.concatenate([[0], np.cumsum(b - a)])
        data = texts.data[np.arange(cut[-1]) + np.repeat(a - cut[:-1], b - a)]
        yield {"key": key[ok], "text": pa.Array.from_buffers(pa.large_utf8(), len(a), [None, pa.py_buffer(cut), pa.py_buffer(data)])}


def _long(batch: pa.RecordBatch) -> Iterator[dict]:
    """(key, text) to (key, text, long): the lowest bytes of ``LONG`` minima."""
    for rows, texts in K.blocks(batch, limit=TAKE):
        m = signatures(texts.data, texts.offsets[:-1], texts.offsets[1:], seeds(LONG, ROWS * BANDS)).astype(np.uint8)
        at = np.arange(len(rows) + 1, dtype=np.int32) * LONG
        long = pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(m.T))])
        yield {"key": rows.column("key"), "text": rows.column("text"), "long": long}


def _meet(percent: int):
    """Sorted (g, side, band, h, comp, b0..., text, long) to the links (u, v) between the blocks of each group g, or inside its one."""
    to = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def links(t: pa.Table) -> tuple[list[int], list[int]]:
        side, h, comp = (t.column(c).to_numpy() for c in ("side", "h", "comp"))
        band = t.column("band")[0].as_py()
        keys = np.array([t.column(f"b{i}").to_numpy() for i in range(BANDS)])
        long = np.frombuffer(b"".join(t.column("long").to_pylist()), dtype=np.uint8).reshape(-1, LONG)
        a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        alone_ = not len(b)
        if alone_:
            b = a
        agree = np.array([(long[i] == long[b]).sum(1) for i in a], dtype=np.int16)
        fit = (agree >= AGREE) & (comp[a][:, None] != comp[b][None, :])
        if alone_:
            fit &= a[:, None] < b[None, :]
        x, y = np.nonzero(fit)
        agree, x, y = agree[x, y], a[x], b[y]
        fresh = ~(keys[:band, x] == keys[:band, y]).any(0)
        order = np.argsort(-agree[fresh], kind="stable")
        x, y = x[fresh][order], y[fresh][order]
        if not len(x):
            return [], []
        sets, first = shingle_sets(K.column_texts(t.column("text")))
        up: dict[int, int] = {}

        def root(c: int) -> int:
            while c in up:
                c = up[c]
            return c

        u, v = [], []
        for i, j in zip(x.tolist(), y.tolist(), strict=True):
            p, q = root(int(comp[i])), root(int(comp[j]))
            if p == q:
                continue
            m, n = sets[first[i] : first[i + 1]], sets[first[j] : first[j + 1]]
            same = int((m[np.minimum(np.searchsorted(m, n), len(m) - 1)] == n).sum())
            if 100 * same >= percent * (len(m) + len(n) - same):
                up[max(p, q)] = min(p, q)
                u.append(int(h[i]))
                v.append(int(h[j]))
        return u, v

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone(__name__)
        held: list[pa.RecordBatch] = []
        last = None

        def ended():
            u, v = links(pa.Table.from_batches(held))
            return record({"u": np.array(u, np.int64), "v": np.array(v, np.int64)}, to)

        for batch in batches:
            g = batch.column("g").to_numpy()
            cuts = [0, *(np.flatnonzero(g[1:] != g[:-1]) + 1).tolist(), len(g)]
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                if i == j:
                    continue
                if held and g[i] != last:
                    yield ended()
                    held.clear()
                last = g[i]
                held.append(batch.slice(i, j - i))
        if held:
            yield ended()

    return meet


def _nodes(own: DataFrame) -> DataFrame:
    """(h, doc_id, at, b0...): distinct lines with their first place and band keys.

    The first place travels as one number that sorts like (doc_id, at), so that sums take no sort.
    """
    ship(own.sparkSession)
    signed = own.mapInArrow(_sign, "h long, doc_id long, at int, " + ", ".join(f"b{i} long" for i in range(BANDS)))
    wide = F.lit(1 << 31).cast("decimal(10,0)")
    signed = signed.withColumn("place", F.col("doc_id").cast("decimal(20,0)") * wide + F.col("at"))
    s = signed.groupBy("h").agg(F.min("place").alias("place"), *[F.min(f"b{i}").alias(f"b{i}") for i in range(BANDS)])
    at = F.pmod("place", wide)
    return s.select("h", ((F.col("place") - at) / wide).cast("long").alias("doc_id"), at.cast("int").alias("at"), *[f"b{i}" for i in range(BANDS)])


def _texts(own: DataFrame, nodes: DataFrame, h: DataFrame) -> DataFrame:
    """(key, text) of the given lines, read from the documents in which they stand first."""
    wanted = h.join(nodes.select("h", "doc_id", "at"), "h").groupBy("doc_id").agg(F.collect_list(F.struct("at", "h")).alias("wanted"))
    return arrow_map(own.join(wanted, "doc_id").select("text", "wanted"), _pick, "key long, text string").dropDuplicates(["key"])


def components(own: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """(h, component) of the lines that are linked with others."""
    bands = [F.struct(F.lit(i).alias("band"), F.col(f"b{i}").alias("bucket")) for i in range(BANDS)]
    banded = nodes.select("h", F.explode(F.array(*bands)).alias("b")).select("h", "b.band", "b.bucket")
    shared = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    members = written(banded.join(shared, "bucket"))
    score = members.groupBy("h").agg(F.sum("k").alias("score"))
    best = members.join(score, "h").groupBy("bucket").agg(F.max(F.struct("score", "h")).alias("best"))
    texts = written(_texts(own, nodes, members.select("h").distinct()))

    star = members.join(best, "bucket").select("h", F.col("best.h").alias("rep")).where("h <> rep")
    links = verified(written(star.select(F.least("h", "rep").alias("u"), F.greatest("h", "rep").alias("v")).distinct()), texts, shingle_sets, percent)
    label = written(connected_components(links).withColumnRenamed("node", "h"))
    placed = written(members.where("k > 2").join(label, "h", "left").select("h", "band", "bucket", "k", F.coalesce("component", "h").alias("comp")))
    mixed = placed.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("bucket")
    open_ = written(placed.join(mixed, "bucket", "left_semi"))

    wanted = open_.select(F.col("h").alias("key")).distinct()
    long = written(arrow_map(texts.join(wanted, "key"), _long, "key long, text string, long binary"))
    blocks = F.ceil(F.col("k") / MEET).cast("int")
    own_block = F.pmod(F.xxhash64("h", F.lit(BANDS)), blocks).cast("int")
    dealt = open_.withColumn("i", own_block).withColumn("j", F.explode(F.sequence(F.lit(0), blocks - 1)))
    side = F.when(F.col("i") > F.col("j"), 1).otherwise(0)
    dealt = dealt.select(F.xxhash64("bucket", F.least("i", "j"), F.greatest("i", "j")).alias("g"), side.alias("side"), "band", "h", "comp")
    whole = dealt.join(long.withColumnRenamed("key", "h"), "h").join(nodes.select("h", *[f"b{i}" for i in range(BANDS)]).join(wanted.withColumnRenamed("key", "h"), "h"), "h")
    rows = whole.select("g", "side", "band", "h", "comp", *[f"b{i}" for i in range(BANDS)], "text", "long").repartition("g").sortWithinPartitions("g")
    more = written(rows.mapInArrow(_meet(percent), "u long, v long"))
    if more.limit(1).count():
        label = written(connected_components(links.unionByName(more)).withColumnRenamed("node", "h"))
    return label


def line_dedup(docs: DataFrame, percent: int = 80) -> DataFrame:
    """``docs`` with, of all lines that are alike, only the earliest (smallest doc_id, then first line) left in the texts.

    Adds ``n_lines`` and ``n_removed``; use :func:`deduped` for the columns of ``docs`` alone.  Lines are alike when a chain of
    links joins them, and link when the Jaccard similarity of their shingle sets is ``percent`` / 100 or more (equal lines
    always).  Lines that stay keep their own white space; blank lines stay.

    A null text stays null with 0 lines; an empty one has one blank line.  A document all of whose lines go keeps an empty text.
    Rows without an id take no part and come back as they were, with null counts.  Rows that repeat an id are one document
    of several texts: a line that stays at some place stays at that place in each row in which it is there.  An empty table
    gives an empty table.  Other columns go through, whatever their names.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    nodes = written(_nodes(own))
    label = components(own, nodes, percent)
    grouped = label.join(nodes.select("h", F.struct("doc_id", "at").alias("first")), "h")
    keeper = grouped.groupBy("component").agg(F.min("first").alias("keep"))
    losers = grouped.join(keeper, "component").where("first <> keep").select("h")
    stay = nodes.join(losers, "h", "left_anti").groupBy(F.col("doc_id").alias("__id")).agg(F.collect_list("at").alias("__stay"))

    row = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("__row"), docs["doc_id"].cast("long").alias("__key"), docs["text"].cast("string").alias("__text"))
    cut = row.join(stay, F.col("__key") == F.col("__id"), "left")
    cut = cut.withColumn("__lines", F.when(F.col("__key").isNotNull() & F.col("__text").isNotNull(), F.split("__text", "\n", -1)))
    blank = F.filter(F.transform("__lines", lambda x, i: F.when(F.rlike(x, F.lit(r"^\s*$")), i)), lambda i: i.isNotNull())
    kept = F.array_sort(F.array_union(F.coalesce("__stay", F.array().cast("array<int>")), blank))
    cut = cut.withColumn("__kept", F.filter(kept, lambda i: i < F.size("__lines")))
    text = F.when(F.col("__lines").isNull(), F.col("__text")).otherwise(F.array_join(F.transform("__kept", lambda i: F.get("__lines", i)), "\n"))
    n = F.when(F.col("__key").isNotNull(), F.coalesce(F.when(F.col("__lines").isNotNull(), F.size("__lines")), F.lit(0))).cast("long")
    gone = n - F.when(F.col("__key").isNotNull(), F.coalesce(F.when(F.col("__lines").isNotNull(), F.size("__kept")), F.lit(0)))
    return cut.select(F.col("__row").withField("text", text).alias("__row"), n.alias("n_lines"), gone.alias("n_removed")).select("__row.*", "n_lines", "n_removed")


def deduped(docs: DataFrame, percent: int = 80) -> DataFrame:
    """:func:`line_dedup` with the columns of ``docs`` alone."""
    return line_dedup(docs, percent).select(*[f"`{c}`" for c in docs.columns])
