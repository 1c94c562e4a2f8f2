"""Read calls that arrive in files: running counts a locus, and genotypes brought up to date with each batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tandem.operators.genotype import genotype_counts

CALLS = "locus_id string, query_name string, alignment_type string, kmer_count array<int>"


def arriving(spark: SparkSession, path: str, schema: str = CALLS, files: int = 100) -> DataFrame:
    """Read calls of Parquet files as they come into a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def running_counts(calls: DataFrame) -> DataFrame:
    """Reads of each distinct (locus, kind, counts) so far; the state is a row each, whatever the depth."""
    return calls.groupBy("locus_id", "alignment_type", "kmer_count").agg(F.count(F.lit(1)).alias("n"))


def windowed_depth(calls: DataFrame, time: str, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Reads a locus and window of their time; a window is given out once nothing later than ``late`` can change it."""
    w = calls.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), "locus_id").agg(F.count(F.lit(1)).alias("n"))
    return w.select("locus_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def genotypes_on_arrival(calls: DataFrame, give: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """After each batch gives the genotypes of the loci whose counts it touched, fitted to all their counts so far.

    The counts that a batch changed are kept beside the checkpoint, a folder a batch, so a batch that is run again writes the same
    folder.  Counts only grow: the largest of a kind is the present one.
    """
    totals = f"{checkpoint.rstrip('/')}-totals"

    def batch(counts: DataFrame, number: int) -> None:
        counts.write.mode("overwrite").parquet(f"{totals}/batch={number}")
        kept = counts.sparkSession.read.option("basePath", totals).parquet(totals).where(F.col("batch") <= number)
        touched = kept.where(F.col("batch") == number).select("locus_id").distinct()
        seen = kept.join(touched, "locus_id", "left_semi").groupBy("locus_id", "alignment_type", "kmer_count").agg(F.max("n").alias("n"))
        give(genotype_counts(seen), number)

    return running_counts(calls).writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", checkpoint).start()
