"""Removal of repeated passages by level-wise doubling of repeated windows.

A window is a run of consecutive words ``[^\\x20\\x09-\\x0D]+``.  Level 0 takes windows of ``min_words / 2`` words and
keeps those that occur more than once in the corpus; a window of the next level, twice as long, is looked at only where
its part of the level below was repeated.  Doubling ends with ``min_words`` (every longer repeat is made of repeats of
that length, so it removes nothing more) or earlier, when no candidate survives.

* Level 0 is winnowed: of the windows inside each window of the next level only the one of least hash is posted, about one
  in ``min_words / 4``.  Equal windows choose the same part, so a repeated window's part is repeated too, and nothing is
  missed.
* No level sends lists of places of one window anywhere.  A level's answer is the *first* place of each window (or that
  it is the only one), which partial aggregation finds before the shuffle; a document whose window isn't the first place
  knows that it is a repeat.  A window that a third of the corpus shares costs one row a map task.
* Windows of the last level are told apart by 96 bits of two hashes, those of level 0, which only choose candidates, by 64.
* Only hashes and places are shuffled, and the texts once by ``doc_id``, which both levels' answers reuse.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandem.llm import kernels as K
from tandem.llm.common import arrow_map, list_values, one_per_id


def _level0(texts: K.Texts, min_words: int):
    """Word spans, hashes of half windows, and which half window each full window posts.

    Returns (starts, ends, first, words, half, full_at, anchor, row): ``full_at`` are the word indices at which a full
    window starts, ``anchor`` the word index of its least half window (the leftmost of equal ones).
    """
    starts, ends, first = K.word_spans(texts)
    words = K.hash_spans(texts.data, starts, ends)
    k = min_words // 2
    half = K.window_hashes(words, k)
    row = K.row_of(first)
    spread = min_words - k + 1  # half windows inside a full one
    n_full = max(0, len(words) - min_words + 1)
    full_at = np.flatnonzero(np.arange(n_full) + min_words <= first[1:][row[:n_full]])
    best, at = half[full_at], full_at.copy()
    for j in range(1, spread):
        h = half[full_at + j]
        less = h < best
        best = np.where(less, h, best)
        at[less] = full_at[less] + j
    return starts, ends, first, words, half, full_at, at, row


def _once(h: np.ndarray, row: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the first place of each hash in each row, and whether the row has it once."""
    order = np.lexsort((at, h, row))
    hs, rs = h[order], row[order]
    new = np.ones(len(hs), dtype=bool)
    new[1:] = (hs[1:] != hs[:-1]) | (rs[1:] != rs[:-1])
    heads = np.flatnonzero(new)
    return order[heads], np.diff(np.append(heads, len(hs))) == 1


def _post(min_words: int):
    def post(batch: pa.RecordBatch) -> Iterator[dict]:
        for rows, texts in K.blocks(batch):
            _, _, first, _, half, _, anchor, row = _level0(texts, min_words)
            places = np.unique(anchor)
            pick, once = _once(half[places], row[places], places)
            places = places[pick]
            doc = np.asarray(rows.column("doc_id"))[row[places]]
            at = places - first[row[places]]
            yield {"h": K.signed(half[places]), "doc_id": doc, "at": np.where(once, at, -1 - at)}

    return post


def _candidates(texts: K.Texts, only: pa.Array, min_words: int):
    """Full windows whose half window isn't the corpus's only one; ``only`` lists those places for each text."""
    starts, ends, first, words, half, full_at, anchor, row = _level0(texts, min_words)
    flat, lists = list_values(only)
    alone = np.zeros(len(words) + 1, dtype=bool)
    alone[flat.astype(np.int64) + np.repeat(first[:-1], np.diff(lists))] = True
    keep = ~alone[anchor]
    at = full_at[keep]
    k = min_words // 2
    one = K.double(half, k) if min_words == 2 * k else K.window_hashes(words, min_words)
    return starts, ends, first, words, one, at, row


def _windows(min_words: int):
    def windows(batch: pa.RecordBatch) -> Iterator[dict]:
        for rows, texts in K.blocks(batch):
            _, _, first, words, one, at, row = _candidates(texts, rows.column("only"), min_words)
            h1 = one[at]
            h2 = K.window_hashes(K.mix(words ^ K._C2), min_words)[at] if len(at) else h1
            pick, _ = _once(h1, row[at], at)
            at, h1, h2 = at[pick], h1[pick], h2[pick]
            yield {"h1": K.signed(h1), "h2": (h2 >> K.U64(32)).astype(np.uint32).view(np.int32), "doc_id": np.asarray(rows.column("doc_id"))[row[at]], "at": at - first[row[at]]}

    return windows


def _cut(min_words: int):
    def cut(batch: pa.RecordBatch) -> Iterator[dict]:
        for rows, texts in K.blocks(batch):
            starts, ends, first, words, _, at, row = _candidates(texts, rows.column("only"), min_words)
            flat, lists = list_values(rows.column("firsts"))
            is_first = np.zeros(len(words) + 1, dtype=bool)
            is_first[flat.astype(np.int64) + np.repeat(first[:-1], np.diff(lists))] = True
            again = at[~is_first[at]]
            depth = np.zeros(len(words) + 1, dtype=np.int64)
            np.add.at(depth, again, 1)
            np.add.at(depth, again + min_words, -1)
            gone = np.cumsum(depth)[:-1] > 0
            kept = _join(texts, starts[~gone], ends[~gone], row[~gone])
            edge = np.diff(np.concatenate([[0], gone.view(np.int8), [0]]))
            new_row = first[1:-1][(first[1:-1] > 0) & (first[1:-1] < len(words))] if len(words) else first[:0]
            both = new_row[gone[new_row] & gone[new_row - 1]]  # a span ends with its text
            begin, end = np.sort(np.concatenate([np.flatnonzero(edge == 1), both])), np.sort(np.concatenate([np.flatnonzero(edge == -1), both]))
            of = row[begin] if len(begin) else np.zeros(0, np.int64)
            lists_of = np.searchsorted(of, np.arange(len(texts) + 1)).astype(np.int32)
            spans = pa.ListArray.from_arrays(pa.array(lists_of), pa.StructArray.from_arrays([pa.array((begin - first[of]).astype(np.int32)), pa.array((end - first[of]).astype(np.int32))], names=["start", "stop"]))
            n_gone = np.concatenate([[0], np.cumsum(gone)])[first]
            yield {"doc_id": rows.column("doc_id"), "text": kept, "n_words": np.diff(first), "n_removed": np.diff(n_gone), "removed": spans}

    return cut


def _join(texts: K.Texts, starts: np.ndarray, ends: np.ndarray, row: np.ndarray) -> pa.Array:
    """The given words of each text, joined by one space."""
    depth = np.zeros(len(texts.data) + 2, dtype=np.int8)
    depth[starts] += 1
    stop = np.minimum(ends + 1, texts.offsets[1:][row])  # takes the separator along
    np.subtract.at(depth, stop, 1)
    take = np.cumsum(depth[: len(texts.data)], dtype=np.int8) > 0
    out = np.where(K._SPACE[texts.data], np.uint8(32), texts.data)[take]
    size = np.concatenate([[0], np.cumsum(take)])[texts.offsets]
    trailing = (size[1:] > size[:-1]) & (out[np.maximum(size[1:] - 1, 0)] == 32) if len(out) else np.zeros(len(texts), bool)
    if trailing.any():
        ok = np.ones(len(out), dtype=bool)
        ok[size[1:][trailing] - 1] = False
        out, size = out[ok], size - np.concatenate([[0], np.cumsum(trailing)])
    return pa.Array.from_buffers(pa.large_utf8(), len(texts), [None, pa.py_buffer(size.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(out))])


def substring_dedup(docs: DataFrame, min_words: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Removes each word covered by a window of ``min_words`` words that also starts earlier in the corpus.

    Earlier: in a document of smaller id, or before it in the same one.  All windows are judged on the input.  Returns
    ``doc_id, text`` (kept words joined by one space), ``n_words, n_removed, removed`` (array of word ranges start, stop).

    Nulls and empties: a null or empty text has no words and comes back as an empty text; rows without an id take no part;
    repeated ids as in :func:`tandem.llm.common.one_per_id`.  Texts shorter than ``min_words`` words only lose white
    space.  Ties can't happen, since a place is an id and an offset.  An empty table gives an empty table.  Other columns
    of ``docs`` are not looked at, whatever their names.
    """
    if min_words < 2:
        raise ValueError("min_words must be 2 or more")
    own = one_per_id(docs, id_col, text_col)
    dealt = own.repartition("doc_id")
    post = arrow_map(own, _post(min_words), "h long, doc_id long, at int")
    only = (
        post.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("doc_id"), F.min("at").alias("at"))
        .where("n = 1 and at >= 0").groupBy("doc_id").agg(F.collect_list("at").alias("only"))
    )
    level0 = dealt.join(only, "doc_id", "left").select("doc_id", "text", "only")
    windows = arrow_map(level0, _windows(min_words), "h1 long, h2 int, doc_id long, at int")
    firsts = (
        windows.groupBy("h1", "h2").agg(F.min("doc_id").alias("doc"), F.min_by("at", "doc_id").alias("at"))
        .groupBy(F.col("doc").alias("doc_id")).agg(F.collect_list("at").alias("firsts"))
    )
    return arrow_map(
        level0.join(firsts, "doc_id", "left").select("doc_id", "text", "only", "firsts"),
        _cut(min_words), "doc_id long, text string, n_words long, n_removed long, removed array<struct<start:int,stop:int>>",
    )
