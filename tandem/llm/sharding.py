"""Contiguous shards of near equal bytes by global prefix sums of sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tandem.llm.common import written
from tandem.llm.ranges import bounds, part_of, parts_for


def shards(docs: DataFrame, n_shards: int = 40, overhead: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): documents in ascending id order cut into shards of near equal bytes.

    ``size`` is the text's UTF-8 bytes plus ``overhead``.  Only (id, size, checksum) is moved: rows are dealt in ranges of the
    id, each range's total is summed, the prefix sums of these totals (one row a range) give each range its start, and a
    running sum inside a range gives each document its own.  A document belongs to the shard in which its middle byte
    falls, so shards are contiguous and differ from the target by less than a document's size.  ``slot`` counts from 0 in
    each shard without gaps.

    Nulls: a null text has no bytes and the checksum of nothing, 0; a null id comes first.  Rows with equal ids stand in order
    of size and checksum; equal rows are interchangeable.  With fewer documents than shards some shards are empty.  An empty
    table gives an empty table.  Other columns are not looked at.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + overhead).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    own = written(own)
    parts = parts_for(own, own.count())
    cuts = bounds(own, parts)
    dealt = own.withColumn("part", F.coalesce(part_of(F.col("doc_id"), cuts), F.lit(0)))
    start, total, number = [], 0, 0
    for r in dealt.groupBy("part").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).orderBy("part").collect():  # a row a range
        start.append((r.part, total, number))
        total, number = total + r["size"], number + r.n
    spark = docs.sparkSession
    offsets = spark.createDataFrame(start, "part int, bytes_before long, rows_before long")
    run = Window.partitionBy("part").orderBy("doc_id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, 0)
    placed = (
        dealt.withColumn("bytes", F.sum("size").over(run)).withColumn("rows", F.count(F.lit(1)).over(run))
        .join(F.broadcast(offsets), "part")  # one row a range
        .withColumn("before", F.col("bytes_before") + F.col("bytes") - F.col("size")).withColumn("index", F.col("rows_before") + F.col("rows") - 1)
        .withColumn("shard", F.floor((2 * F.col("before") + F.col("size")) * n_shards / F.lit(2 * max(total, 1))).cast("int"))
    )
    placed = written(placed.select("doc_id", "size", "text_crc32", F.least("shard", F.lit(n_shards - 1)).alias("shard"), "index"))
    first = placed.groupBy("shard").agg(F.min("index").alias("first"))
    return placed.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("index") - F.col("first")).cast("int").alias("slot"))  # a row a shard
