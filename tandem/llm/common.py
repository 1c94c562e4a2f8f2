"""What the operators share: written tables, ids, Arrow tasks."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandem.shipping import ship
from tandem.tables import shared_dir, written

__all__ = ["WORD", "alone", "arrow_map", "held", "int_lists", "let_go", "likely", "list_values", "one_per_id", "record", "shared_dir", "written"]

#: The separators of words, for Java's and DuckDB's regular expressions.
WORD = r"[^\x20\x09-\x0D]+"


def one_per_id(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text) with one row an id.

    Rows without an id can't be named in a result and take no part.  Where an id comes back, equal rows count once
    and of different texts the smallest stands (a null only if alone).  Ids are checked by a count over ids alone;
    only where one repeats are texts dealt out for the choice.
    """
    own = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where(F.col("doc_id").isNotNull())
    repeated = own.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count()
    return own.groupBy("doc_id").agg(F.min("text").alias("text")) if repeated else own


#: Bits by which rows are told apart before a join; 4 MB go to every task.
BITS = 1 << 25


def likely(rows: DataFrame, wanted: DataFrame, key: str = "doc_id") -> DataFrame:
    """``rows`` with a ``key`` that ``wanted`` has, and a few others: the bits of a hash, of a size that doesn't grow, go to every task.

    A join on ``key`` afterwards decides; it deals out the texts that may be wanted and not all.
    """
    slot = F.pmod(F.xxhash64(key), F.lit(BITS)) + 1
    bits = wanted.select(slot.alias("slot")).groupBy(F.bitmap_bucket_number("slot").alias("__part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("__bits"))
    at = F.bitmap_bit_position(slot)
    byte = F.conv(F.hex(F.substring("__bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    has = F.floor(byte / F.pow(F.lit(2), at % 8)) % 2 == 1
    return rows.join(F.broadcast(bits), (F.bitmap_bucket_number(slot) == F.col("__part")) & has, "left_semi")


_held: dict[Any, Any] = {}


def alone(owner: str) -> None:
    """Called by a task when it begins: what tasks of other operators have left in this worker goes.

    Spark uses a Python worker for stage after stage, so tables that one operator keeps (vocabularies, known pre-tokens) would
    else stay while the next one works.
    """
    if _held.get("owner") != owner:
        _held.clear()
        _held["owner"] = owner
        let_go()


def let_go() -> None:
    """Gives memory that this process has freed back to the system, which pools else keep."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not this C library: memory goes back later
        pass


def held(owner: str, key: Any, make: Callable[[], Any]) -> Any:
    """What ``make`` gives, kept in this worker as long as tasks of the same ``owner`` run."""
    alone(owner)
    if key not in _held:
        _held[key] = make()
    return _held[key]


def arrow_map(df: DataFrame, f: Callable[[pa.RecordBatch], Iterator[dict]], schema: str) -> DataFrame:
    """``mapInArrow`` of a function from a batch to dicts of columns, cast to ``schema``."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    ship(df.sparkSession)
    to = to_arrow_schema(StructType.fromDDL(schema))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone(f.__module__)
        for batch in batches:
            for columns in f(batch):
                yield record(columns, to)

    return df.mapInArrow(task, schema)


def record(columns: dict, to: pa.Schema) -> pa.RecordBatch:
    arrays = []
    for field in to:
        x = columns[field.name]
        if not isinstance(x, pa.Array):
            x = pa.array(x, type=field.type) if not isinstance(x, np.ndarray) else pa.array(x)
        arrays.append(x if x.type == field.type else x.cast(field.type))
    return pa.RecordBatch.from_arrays(arrays, schema=to)


def int_lists(values: np.ndarray, first: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column of consecutive pieces of ``values``."""
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(values).cast(kind))


def list_values(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat values of a list column and each row's first; a null is an empty list."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = np.asarray(column.value_lengths().fill_null(0)).astype(np.int64)
    first = np.zeros(len(column) + 1, dtype=np.int64)
    np.cumsum(size, out=first[1:])
    return np.asarray(column.flatten()), first
