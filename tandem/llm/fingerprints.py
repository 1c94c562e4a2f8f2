"""Threshold-scaled fingerprints of documents.

A fingerprint keeps every 64-bit shingle hash under a fixed fraction of the hash space (``1 / SCALE``), or the least hash where
none is under it.  Its size follows the document's, so a short document's containment in a long one can be told.  Fingerprints
merge: the union of two, cut by the same rule, is the fingerprint of the union of the shingles.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandem.llm import kernels as K
from tandem.llm.common import arrow_map, int_lists, one_per_id, record
from tandem.llm.ranges import bounds, part_of, parts_for
from tandem.shipping import ship

SCALE = 2


def _under(scale: int) -> np.uint64:
    return K.U64((1 << 64) // scale - 1)


def sketches(texts: K.Texts, k: int = 5, scale: int = SCALE) -> tuple[np.ndarray, np.ndarray]:
    """The kept hashes of each text, ascending, and each text's first."""
    h, first = K.shingles(texts, k)
    keep = h <= _under(scale)
    some = np.flatnonzero(np.diff(first) > 0)
    keep[first[some]] = True  # the least hash stands anyway
    return h[keep], np.concatenate([[0], np.cumsum(keep)])[first]


def merge(a: np.ndarray, b: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """The fingerprint of two documents' shingles together, from their fingerprints."""
    h = np.union1d(a, b)
    under = h[h <= _under(scale)]
    return under if len(under) else h[:1]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated Jaccard similarity; two empty fingerprints are alike, an empty and another are not."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.concatenate([a, b])
    both.sort()
    same = int((both[1:] == both[:-1]).sum())
    return same / (len(both) - same)


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated part of a's shingles that b has; of an empty one everything is in b."""
    if not len(a):
        return 1.0
    both = np.concatenate([a, b])
    both.sort()
    return int((both[1:] == both[:-1]).sum()) / len(a)


def as_text(a: np.ndarray) -> str:
    """Sixteen hexadecimal digits a hash, ascending."""
    return a.astype(">u8").tobytes().hex()


def from_text(s: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(s), dtype=">u8").astype(K.U64)


def fingerprints(docs: DataFrame, k: int = 5, scale: int = SCALE) -> DataFrame:
    """(doc_id, fingerprint array<long>) of every row's whole text.

    A null text counts as empty, and an empty one or one without words has an empty fingerprint; fewer than ``k`` words are
    one shingle.  Rows are looked at one by one: ids may be null or repeat, equal texts have equal fingerprints, an empty
    table gives an empty table, other columns are not looked at.
    """

    def f(batch: pa.RecordBatch) -> Iterator[dict]:
        for rows, texts in K.blocks(batch):
            h, first = sketches(texts, k, scale)
            yield {"doc_id": rows.column("doc_id"), "fingerprint": int_lists(K.signed(h), first, pa.int64())}

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), f, "doc_id long, fingerprint array<long>")


def likeness_of(a: Column, b: Column) -> Column:
    """Jaccard estimate of two fingerprint columns."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), (F.size(a) == F.size(b)).cast("double")).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def containment_of(a: Column, b: Column) -> Column:
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def _edited(texts: K.Texts) -> tuple[list[bytes], np.ndarray]:
    """For all texts but the last: its second half replaced by the first as many code points of the next; and code points."""
    lead = np.flatnonzero((texts.data & 0xC0) != 0x80)
    first = np.searchsorted(lead, texts.offsets)
    n = np.diff(first)
    place = np.append(lead, len(texts.data))
    half = n[:-1] // 2
    stop = place[first[:-2] + n[:-1] - half] if len(n) > 1 else place[:0]
    until = np.where(half >= n[1:], texts.offsets[2:], place[np.minimum(first[1:-1] + half, first[2:])]) if len(n) > 1 else place[:0]
    raw = texts.data.tobytes()
    return [raw[a:b] + raw[c:d] for a, b, c, d in zip(texts.offsets[:-2].tolist(), stop.tolist(), texts.offsets[1:-1].tolist(), until.tolist(), strict=True)], n


def edits(docs: DataFrame, k: int = 5, scale: int = SCALE) -> DataFrame:
    """Fingerprints of each document, of its edited text and of the next document in id order, held against each other.

    The edited text has the last half of the code points replaced by as many from the start of the next document (after the last
    comes the first; a single document follows itself).  Documents are dealt in ranges of the id; the first document of each
    range goes along with the range before it, so neighbours meet in one task, and a task holds a document back until it
    sees the next.  One shuffle of the texts.

    Nulls: a null text counts as empty, rows without an id take no part, repeated ids as in
    :func:`tandem.llm.common.one_per_id`.  An empty table gives an empty table.
    """
    own = one_per_id(docs)
    parts = parts_for(own, own.count(), 500)
    cuts = bounds(own, parts)
    part = part_of(F.col("doc_id"), cuts)
    heads = [(r.part, r.head) for r in own.select(part.alias("part"), "doc_id").groupBy("part").agg(F.min("doc_id").alias("head")).orderBy("part").collect()]
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, in_edited double"
    before = {head: heads[i - 1][0] for i, (_, head) in enumerate(heads)}
    to_before = F.create_map(*[F.lit(x) for pair in before.items() for x in pair])[F.col("doc_id")] if before else F.lit(None).cast("int")
    places = F.array_compact(F.array(F.struct(part.alias("part"), F.lit(0).alias("tail")), F.when(to_before.isNotNull(), F.struct(to_before.alias("part"), F.lit(1).alias("tail")))))
    dealt = own.select("doc_id", "text", F.explode(places).alias("at")).select("doc_id", "text", "at.part", "at.tail")
    dealt = dealt.repartitionById(max(1, len(cuts) + 1), F.col("part")).sortWithinPartitions("part", "tail", "doc_id")
    ship(docs.sparkSession)
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    to = to_arrow_schema(StructType.fromDDL(schema))

    def compared(ids: np.ndarray, tail: np.ndarray, texts: K.Texts) -> pa.RecordBatch:
        new, n = _edited(texts)
        h, f = sketches(texts, k, scale)
        he, fe = sketches(K.Texts.of(new), k, scale)
        own_sketch = [h[a:b] for a, b in zip(f[:-1].tolist(), f[1:].tolist(), strict=True)]
        new_sketch = [he[a:b] for a, b in zip(fe[:-1].tolist(), fe[1:].tolist(), strict=True)]
        pick = np.flatnonzero(tail[:-1] == 0).tolist()
        return record({
            "doc_id": ids[pick], "n_chars": n[pick], "edited_sha256": [hashlib.sha256(new[i]).hexdigest() for i in pick],
            "fingerprint": [as_text(own_sketch[i]) for i in pick], "edited_fingerprint": [as_text(new_sketch[i]) for i in pick],
            "near_edited": np.array([likeness(own_sketch[i], new_sketch[i]) for i in pick], dtype=float),
            "near_next": np.array([likeness(own_sketch[i], own_sketch[i + 1]) for i in pick], dtype=float),
            "in_edited": np.array([containment(own_sketch[i], new_sketch[i]) for i in pick], dtype=float),
        }, to)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None
        for batch in batches:
            for rows, _ in K.blocks(batch):
                if held is not None:
                    rows = pa.Table.from_batches([held, rows]).combine_chunks().to_batches()[0]
                held = rows.slice(len(rows) - 1)
                if len(rows) > 1:
                    out = compared(np.asarray(rows.column("doc_id")), np.asarray(rows.column("tail")), K.column_texts(rows.column("text")))
                    if len(out):
                        yield out

    return dealt.mapInArrow(task, schema)
