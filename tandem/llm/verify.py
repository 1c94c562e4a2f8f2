"""Exact Jaccard similarity of candidate pairs, each text's set made where it is compared."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandem.llm import kernels as K
from tandem.llm.common import alone, record, written
from tandem.shipping import ship

#: Texts that are held against one representative in one go.
SPLIT = 512
#: Texts (bytes) that a task looks at together.
TAKE = 1 << 20


def _held_against(sets: Callable[[K.Texts], tuple[np.ndarray, np.ndarray]], percent: int):
    """Sorted (rep, salt, kind, key, text) to the pairs (u, v) that are similar; kind 0 is the representative's own row."""
    to = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone(__name__)
        own = np.zeros(0, K.U64)
        for batch in batches:
            for rows, texts in K.blocks(batch, limit=TAKE):
                h, first = sets(texts)
                ok = np.zeros(len(rows), dtype=bool)
                for i, kind in enumerate(rows.column("kind").to_pylist()):
                    x = h[first[i] : first[i + 1]]
                    if kind == 0:
                        own = x.copy()
                        continue
                    same = int((own[np.minimum(np.searchsorted(own, x), len(own) - 1)] == x).sum()) if len(own) else 0
                    ok[i] = 100 * same >= percent * (len(own) + len(x) - same)
                if ok.any():
                    m = pa.array(ok)
                    yield record({"u": rows.column("key").filter(m), "v": rows.column("rep").filter(m)}, to)

    return verify


def verified(pairs: DataFrame, texts: DataFrame, sets: Callable[[K.Texts], tuple[np.ndarray, np.ndarray]], percent: int) -> DataFrame:
    """The pairs (u, v) of keys whose sets have a Jaccard similarity of ``percent`` / 100 or more, as a written table.

    ``texts`` has (key, text) of all ends, ``sets`` gives the distinct ascending hashes of each text.  Of a pair the end that is in
    more pairs stands as representative.  Its text goes to a task once, followed by those it is held against, ``SPLIT`` or so a task:
    so neither a text in a million pairs nor its set is copied a million times, and no task gets them all.
    """
    ship(pairs.sparkSession)
    degree = pairs.select(F.col("u").alias("key")).unionByName(pairs.select(F.col("v").alias("key"))).groupBy("key").agg(F.count(F.lit(1)).alias("d"))
    both = pairs.join(degree.withColumnsRenamed({"key": "u", "d": "du"}), "u").join(degree.withColumnsRenamed({"key": "v", "d": "dv"}), "v")
    more = F.col("du") > F.col("dv")
    turned = both.select(F.when(more, F.col("v")).otherwise(F.col("u")).alias("key"), F.when(more, F.col("u")).otherwise(F.col("v")).alias("rep"), F.greatest("du", "dv").alias("size"))
    salted = turned.select("rep", F.pmod(F.xxhash64("key"), F.ceil(F.col("size") / SPLIT)).cast("int").alias("salt"), F.lit(1).alias("kind"), "key")
    rows = salted.unionByName(salted.select("rep", "salt", F.lit(0).alias("kind"), F.col("rep").alias("key")).distinct())
    dealt = rows.join(texts, "key").select("rep", "salt", "kind", "key", "text").repartition("rep", "salt").sortWithinPartitions("rep", "salt", "kind")
    return written(dealt.mapInArrow(_held_against(sets, percent), "u long, v long"))
