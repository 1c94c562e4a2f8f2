"""Approximate nearest neighbours by a permutation index.

A vector is represented by the order of its ``prefix`` nearest pivots.  In each block of the index every pivot has an inverted
file: the vectors that have it among their nearest, with its rank.  A query adds up, over its own nearest pivots, what shared
ones take off the footrule distance of the two orders (a pivot outside a prefix counts as rank ``prefix``):

    footrule = prefix * (prefix + 1) - 2 * sum over shared pivots of (prefix - max(rank, rank'))

The block's nearest ``share`` of vectors by footrule are ranked again by inner product on the original vectors, then the next
``share``, and so on until a whole share brings none of the best ``k + 1``.

Pivots are a bounded sample (``pivots`` distinct vectors by hash order); every row is indexed.  Equal vectors are one entry with
their least ids, found before the shuffle, so a vector that a third of the rows share is one row.  Queries and index meet block by
block (:data:`BLOCK` vectors, :data:`QUERIES` queries), each pair of blocks a group of bounded size; a block pair gives its best
``k + 1`` a query, and a windowed limit that works before the shuffle keeps the best of all.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tandem.llm.common import arrow_map, list_values, record, written
from tandem.shipping import ship

BLOCK = 8192
QUERIES = 2048


def usable(vector: Column) -> Column:
    """Not null, not zero, all components finite numbers."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0)


def entries(vectors: DataFrame, keep: int, id_col: str, vector_col: str) -> tuple[DataFrame, DataFrame]:
    """(vec_id, vector) of usable rows of the usual length, and (rep, vector, ids): distinct vectors with their ``keep`` least ids."""
    own = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    own = own.where(F.col("vec_id").isNotNull()).where(usable(F.col("vector")))
    if own.groupBy("vec_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count():
        own = own.groupBy("vec_id").agg(F.min("vector").alias("vector"))
    usual = own.groupBy(F.size("vector").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    own = own.where(F.size("vector") == (usual["d"] if usual else 0))
    turn = Window.partitionBy("vector").orderBy("vec_id")
    few = own.withColumn("turn", F.row_number().over(turn)).where(F.col("turn") <= keep)
    return own, few.groupBy("vector").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).withColumn("rep", F.element_at("ids", 1))


def _orders(x: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """The nearest pivots of each vector, nearest first, ties to the smaller pivot."""
    near = x @ pivots.T
    return np.argsort(-near, axis=1, kind="stable")[:, :prefix].astype(np.int16)


def _matrix(column) -> np.ndarray:
    flat, first = list_values(column)
    return flat.astype(np.float64).reshape(len(first) - 1, -1)


def _block_search(k: int, share: float, n_pivots: int, prefix: int):
    to = pa.schema([("query", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def search(index: pa.Table, queries: pa.Table) -> pa.Table:
        if not len(index) or not len(queries):
            return pa.Table.from_batches([], schema=to)
        x, q = _matrix(index.column("vector")), _matrix(queries.column("vector"))
        x_order, q_order = _matrix(index.column("near")).astype(np.int64), _matrix(queries.column("near")).astype(np.int64)
        rep = queries.column("rep").to_numpy()
        ids, first = list_values(index.column("ids"))
        # inverted files: of each pivot the vectors that have it, and what each rank leaves of the prefix
        n, width = x_order.shape
        by = np.argsort(x_order.ravel(), kind="stable")
        post, left = (by // width).astype(np.int32), (prefix - by % width).astype(np.int16)
        start = np.searchsorted(x_order.ravel()[by], np.arange(n_pivots + 1))
        take = min(n, max(math.ceil(share * n), 4 * (k + 1)))
        out_q, out_v, out_s = [], [], []
        for i in range(len(q)):
            score = np.zeros(n, dtype=np.int32)
            for r, p in enumerate(q_order[i].tolist()):
                a, b = start[p], start[p + 1]
                score[post[a:b]] += np.minimum(left[a:b], prefix - r)
            order = np.argsort(-score, kind="stable")
            near, s = order[:0], np.empty(0)
            for at in range(0, n, take):
                more = order[at : at + take]
                t = x[more] @ q[i]
                if at and t.max() < edge:
                    break
                near, s = np.concatenate([near, more]), np.concatenate([s, t])
                if len(s) > k + 1:
                    edge = np.partition(s, len(s) - k - 1)[len(s) - k - 1]
                    edge -= 1e-9 * (1 + abs(edge))
                    near, s = near[s >= edge], s[s >= edge]
                else:
                    edge = -np.inf
            best = []
            for v in near.tolist():
                exact = math.fsum((x[v] * q[i]).tolist())  # rounded once, whatever the order of the sum
                best += [(-exact, j) for j in ids[first[v] : first[v + 1]].tolist()]
            best.sort()
            best = best[: k + 1]
            out_q += [rep[i]] * len(best)
            out_v += [j for _, j in best]
            out_s += [-s for s, _ in best]
        return pa.Table.from_batches([record({"query": np.array(out_q, np.int64), "vec_id": np.array(out_v, np.int64), "score": np.array(out_s, float)}, to)])

    return search


def nearest(
    vectors: DataFrame, queries: Column, k: int = 20, pivots: int = 256, prefix: int = 64, share: float = 0.1, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows found nearest by inner product to each row that ``queries`` selects.

    ``queries`` is a condition on ``vec_id``.  A query's own row is no candidate; rows of an equal vector are.  Scores are
    inner products of the original vectors in double precision, each sum rounded once; ties go to the smaller id.

    Vectors that are null, zero, hold null or non-finite components, or differ in length from most take no part, as query or
    candidate; neither do rows without an id; of rows that repeat an id the least vector counts.  Fewer rows than ``k`` give
    all.  An empty table gives an empty table.  Other columns are not looked at.
    """
    spark = vectors.sparkSession
    ship(spark)
    own, distinct = entries(vectors, k + 1, id_col, vector_col)
    distinct = written(distinct)  # pivots, index and queries are made from it
    chosen = distinct.select("vector", "rep").orderBy(F.xxhash64("rep"), "rep").limit(pivots).collect()  # bounded: the pivots
    schema = "query_id long, rank int, vec_id long, score double"
    if not chosen:
        return spark.createDataFrame([], schema)
    n_pivots, width = len(chosen), min(prefix, len(chosen))
    held = spark.sparkContext.broadcast(np.array([r.vector for r in chosen], dtype=np.float64))

    def near(batch: pa.RecordBatch):
        for at in range(0, len(batch), 4096):
            rows = batch.slice(at, 4096)
            order = _orders(_matrix(rows.column("vector")), held.value, width)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * width), pa.array(order.ravel()))
            yield {"rep": rows.column("rep"), "vector": rows.column("vector"), "ids": rows.column("ids"), "near": lists}

    index = written(arrow_map(distinct.select("rep", "vector", "ids"), near, "rep long, vector array<double>, ids array<long>, near array<short>"))
    asked = own.where(queries).select(F.col("vec_id").alias("query_id"), "vector")
    asked = written(asked.join(distinct.select("rep", F.col("vector").alias("v")), F.col("vector") == F.col("v")).select("query_id", "rep"))
    n_index, n_asked = index.count(), asked.select("rep").distinct().count()
    blocks, asks = max(1, -(-n_index // BLOCK)), max(1, -(-n_asked // QUERIES))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = index.withColumn("block", F.pmod(F.xxhash64("rep"), F.lit(blocks)).cast("int")).withColumn("ask", every(asks))
    right = index.select(*[F.col(c).alias(c) for c in index.columns]).join(asked.select("rep").distinct(), "rep").select("rep", "vector", "near").withColumn("ask", F.pmod(F.xxhash64("rep"), F.lit(asks)).cast("int")).withColumn("block", every(blocks))
    found = left.groupBy("ask", "block").cogroup(right.groupBy("ask", "block")).applyInArrow(_block_search(k, share, n_pivots, width), "query long, vec_id long, score double")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("turn", F.row_number().over(best)).where(F.col("turn") <= k + 1)
    pairs = asked.join(found, F.col("rep") == F.col("query")).where("vec_id <> query_id")
    own_place = Window.partitionBy("query_id").orderBy("turn")
    return pairs.withColumn("rank", F.row_number().over(own_place).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
