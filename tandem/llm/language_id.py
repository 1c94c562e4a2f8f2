"""Language identification by averaged hashed subword embeddings and a linear softmax.

Subwords are the runs of 2, 3 and 4 bytes inside the words of a text, with one mark before and after a word; letters A-Z and the
two-byte Latin capitals count as small, everything that can't be part of a word as a mark.  They are hashed to ``BUCKETS`` rows
of an embedding table; a text is the average of its rows, and a linear layer with softmax gives the probabilities.

Training is stochastic gradient descent in numpy over a bounded sample: at most ``max_rows`` labelled texts, equally many of
each language, chosen by a hash of the id.  Tasks turn the sampled texts (whole) into bucket counts, so what the driver gets
is bounded by ``max_rows * BUCKETS``.  A fifth of the sample is left out of the descent and sets the temperature of the
softmax and the score under which a text is rejected: that which a thousandth of them miss, but never more than one half, so
that a text whose language is likely is not rejected for a small doubt.

Prediction is linear up to the softmax: embedding table times layer is one small table of ``BUCKETS`` rows and a column a
language, and a text's logits are averages over it, so whole texts go through a few array operations a block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandem.llm import kernels as K
from tandem.llm.common import alone, arrow_map, let_go, list_values

BUCKETS = 1 << 15
SIZES = (2, 3, 4)
MARK = 0x20
UNKNOWN = "und"
#: Texts (bytes) that a task looks at together: a subword takes some tens of bytes while it is counted.
TAKE = 1 << 20

_WORD = np.full(256, MARK, dtype=np.uint8)
_WORD[0x41:0x5B] = np.arange(0x61, 0x7B)
_WORD[0x61:0x7B] = np.arange(0x61, 0x7B)
_WORD[0x80:] = np.arange(0x80, 0x100)


def _marked(texts: K.Texts) -> tuple[np.ndarray, np.ndarray]:
    """Bytes with everything outside words as marks, a mark at each end of each text, and each text's first byte."""
    size = np.diff(texts.offsets) + 2
    first = np.concatenate([[0], np.cumsum(size)])
    out = np.full(first[-1], MARK, dtype=np.uint8)
    to = np.ones(first[-1], dtype=bool)
    to[first[:-1]] = to[first[1:] - 1] = False
    b = _WORD[texts.data]
    after = np.zeros(len(b), dtype=bool)
    if len(b):
        after[1:] = texts.data[:-1] == 0xC3
    b[after & (b >= 0x80) & (b < 0x9F) & (b != 0x97)] += 0x20
    out[to] = b
    return out, first


def _subwords(texts: K.Texts) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets of the subwords and the index of their first byte, for each size."""
    b, first = _marked(texts)
    mark = b == MARK
    end = np.zeros(len(b), dtype=bool)
    end[first[1:] - 1] = True
    wide = b.astype(np.uint32)
    for n in SIZES:
        if len(b) < n:
            continue
        h = wide[: len(b) - n + 1].copy()
        ok = ~end[: len(h)]  # a subword that starts at a text's last mark would reach into the next
        inner = np.zeros(len(h), dtype=bool)
        for j in range(1, n):
            h = h * np.uint32(0x01000193) + wide[j : j + len(h)]
            if j < n - 1:
                inner |= mark[j : j + len(h)]
        both = mark[: len(h)] & mark[n - 1 :] if n == 2 else np.zeros(len(h), dtype=bool)
        at = np.flatnonzero(ok & ~inner & ~both)
        h = (h[at] ^ np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
        yield (h >> np.uint32(17)).astype(np.int32), at


def _has_letter(texts: K.Texts) -> np.ndarray:
    ascii_letter = ((texts.data | 0x20) >= 0x61) & ((texts.data | 0x20) <= 0x7A)
    n = np.concatenate([[0], np.cumsum(ascii_letter)])[texts.offsets]
    has = n[1:] > n[:-1]
    for i in np.flatnonzero(~has & (np.diff(texts.offsets) > 0)):
        has[i] = any(c.isalpha() for c in texts.bytes(i).decode("utf-8", "replace"))
    return has


@dataclass(frozen=True)
class Model:
    languages: list[str]
    table: np.ndarray  # BUCKETS x languages: what a subword adds to the logits, before the average
    bias: np.ndarray
    temperature: float
    least: float  # texts that score less are rejected


def _counts(batch: pa.RecordBatch) -> Iterator[dict]:
    for rows, texts in K.blocks(batch, limit=TAKE):
        row_of, buckets = [], []
        _, first = _marked(texts)
        for bucket, at in _subwords(texts):
            row_of.append(np.searchsorted(first, at, side="right") - 1)
            buckets.append(bucket)
        key, n = np.unique(np.concatenate(row_of).astype(np.int64) * BUCKETS + np.concatenate(buckets), return_counts=True)
        at = np.searchsorted(key, np.arange(len(texts) + 1) * BUCKETS).astype(np.int32)
        lists = lambda v: pa.ListArray.from_arrays(pa.array(at), pa.array(v.astype(np.int32)))
        yield {"rank": rows.column("rank"), "lang": rows.column("lang"), "buckets": lists(key % BUCKETS), "counts": lists(n)}


def sample(docs: DataFrame, max_rows: int) -> DataFrame:
    """At most about ``max_rows`` labelled texts, equally many of each language, by a hash of the id.

    Of more languages than ``max_rows`` the most frequent ones are learnt (ties by name), one text each or so.
    """
    labelled = docs.where("lang is not null and text is not null").select(F.xxhash64("doc_id").alias("rank"), "lang", "text")
    have = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(max_rows).collect()}
    if not have:
        return labelled.limit(0)
    each = max(1, max_rows // len(have))
    part = F.create_map(*[F.lit(x) for lang, n in sorted(have.items()) for x in (lang, min(1.0, each / n))])
    return labelled.where(F.pmod("rank", F.lit(1 << 30)) < part[F.col("lang")] * (1 << 30))


def train(docs: DataFrame, max_rows: int = 3000, dim: int = 16, epochs: int = 6, rate: float = 0.5, reject: float = 0.001, seed: int = 7) -> Model | None:
    """A model learnt from (doc_id, text, lang); None if there is nothing to learn from.

    ``reject`` is the part of held-back labelled texts that calibration lets the model reject, if they score under one half.
    """
    got = arrow_map(sample(docs, max_rows), _counts, "rank long, lang string, buckets array<int>, counts array<int>").toArrow()
    got = got.take(pa.compute.sort_indices(got, sort_keys=[("rank", "ascending"), ("lang", "ascending")]))
    flat, first = list_values(got.column("buckets"))
    count, _ = list_values(got.column("counts"))
    full = np.flatnonzero(np.diff(first) > 0)
    if not len(full):
        return None
    names = got.column("lang").to_pylist()
    languages = sorted({names[i] for i in full})
    y = np.array([languages.index(names[i]) if i in set(full.tolist()) else -1 for i in range(len(names))])
    rng = np.random.default_rng(seed)
    full = rng.permutation(full)
    held, fit = full[: len(full) // 5], full[len(full) // 5 :]
    E = rng.normal(0, 1 / dim, (BUCKETS, dim)).astype(np.float32)
    W, b = np.zeros((dim, len(languages)), np.float32), np.zeros(len(languages), np.float32)

    def rows(i):
        at, cut = K.ragged(first, i)
        w = count[at].astype(np.float32)
        w /= np.repeat(np.add.reduceat(w, cut[:-1]), np.diff(cut))
        return flat[at], w, cut

    def softmax(z):
        p = np.exp(z - z.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)

    steps = [chunk for _ in range(epochs) for chunk in np.array_split(rng.permutation(fit), max(1, len(fit) // 16))]
    for step, i in enumerate(steps):
        lr = rate * (1 - step / len(steps))
        at, w, cut = rows(i)
        x = np.add.reduceat(E[at] * w[:, None], cut[:-1])
        g = softmax(x @ W + b)
        g[np.arange(len(i)), y[i]] -= 1
        back = g @ W.T
        W -= lr * (x.T @ g) / len(i) * dim
        b -= lr * g.mean(0)
        np.subtract.at(E, at, lr * np.repeat(back, np.diff(cut), axis=0) * w[:, None] * dim)
    table = E @ W

    def logits(i):
        at, w, cut = rows(i)
        return np.add.reduceat(table[at] * w[:, None], cut[:-1]).astype(np.float64) + b

    z = logits(held if len(held) else fit)
    of = y[held if len(held) else fit]
    loss = lambda t: -np.log(softmax(z / t)[np.arange(len(of)), of] + 1e-12).mean()
    temperature = float(min(np.geomspace(0.05, 20, 121), key=loss))
    least = min(0.5, float(np.quantile(softmax(z / temperature).max(1), reject)) * (1 - 1e-9)) if len(languages) > 1 else 0.0
    model = Model(languages, np.ascontiguousarray(table, np.float32), b.astype(np.float64), temperature, least)
    del got, flat, first, count, names, E, z
    let_go()  # the driver lives on
    return model


def _predict(model):
    def predict(batch: pa.RecordBatch) -> Iterator[dict]:
        m: Model | None = model.value
        for rows, texts in K.blocks(batch, limit=TAKE):
            ids = rows.column("doc_id")
            if m is None:
                yield {"doc_id": ids, "lang_pred": [UNKNOWN] * len(texts), "score": np.zeros(len(texts)), "accepted": np.zeros(len(texts), bool)}
                continue
            _, first = _marked(texts)
            z, n = np.zeros((len(texts), len(m.languages))), np.zeros(len(texts))
            for bucket, at in _subwords(texts):
                cut = np.searchsorted(at, first)
                some = np.flatnonzero(np.diff(cut) > 0)
                for j in range(len(m.languages)):
                    if len(some):
                        z[some, j] += np.add.reduceat(m.table[:, j][bucket].astype(np.float64), cut[some])
                n += np.diff(cut)
            letter = _has_letter(texts)
            z = (z / np.maximum(n, 1)[:, None] + m.bias) / m.temperature
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            best = p.argmax(1)
            score = np.where(letter, p[np.arange(len(p)), best], 0.0)
            yield {
                "doc_id": ids, "lang_pred": [m.languages[j] if ok else UNKNOWN for j, ok in zip(best.tolist(), letter.tolist())],
                "score": score, "accepted": letter & (score >= m.least),
            }

    return predict


def identify(docs: DataFrame, model: Model | None, *carry: str) -> DataFrame:
    """(doc_id, lang_pred, score, accepted) of every row, from its text alone.

    A null text, an empty one and one without any letter are ``und`` with score 0 and not accepted; so is everything if
    there is no model.  Equal texts get equal results.  Ids may be null or repeat: rows are looked at one by one.  An empty
    table gives an empty table; other columns are not looked at.
    """
    at = docs.sparkSession.sparkContext.broadcast(model)
    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), _predict(at), "doc_id long, lang_pred string, score double, accepted boolean")


def held_out(doc_id: Column) -> Column:
    """Whether the checksum of the id's digits puts a row in the fold that training never sees."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def accepted_only(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` without the rows that the model rejects, columns unchanged; the rest as in :func:`identify`.

    The decision is made beside the row, so no text is shuffled and rows without an id are judged too.  Without a model nothing
    is judged and all rows stay.
    """
    if model is None:
        return docs
    at = docs.sparkSession.sparkContext.broadcast(model)
    predict, names = _predict(at), docs.columns

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone(__name__)
        for batch in batches:
            at = 0
            for x in predict(batch):  # block by block, so that no second copy of a whole batch is made
                ok = x["accepted"]
                yield batch.slice(at, len(ok)).filter(pa.array(ok))
                at += len(ok)

    from tandem.shipping import ship

    ship(docs.sparkSession)
    return docs.mapInArrow(task, docs.schema).select(*names)
