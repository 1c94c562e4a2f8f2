"""Summaries of groups of read calls, and the frames that a report shows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tandem.functions import alignment
from tandem.functions import columns as C
from tandem.shipping import ship
from tandem.tables import written

TYPE_ORDER = ("left_flanking", "spanning", "right_flanking")


def group_summary(calls: DataFrame) -> DataFrame:
    """(locus_id, haplotype, idx, mean, sd, median, iqr, n): population deviation, interpolated quartiles."""
    long = calls.select("locus_id", "haplotype", F.posexplode("kmer_count").alias("idx", "x"))
    q = F.percentile("x", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    g = long.groupBy("locus_id", "haplotype", "idx").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("sd"), q.alias("q"), F.count(F.lit(1)).alias("n"))
    return g.select("locus_id", "haplotype", "idx", "mean", "sd", F.col("q")[1].alias("median"), (F.col("q")[2] - F.col("q")[0]).alias("iqr"), "n")


def with_units(results: DataFrame, satellites: DataFrame) -> DataFrame:
    """Results with the sequence of their unit, by locus and index; the catalogue side is small and joins by its size."""
    return results.join(satellites, ["locus_id", "idx"], "left")


def at_loci(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """``rows`` of the chosen loci, each once however often a locus is listed."""
    return rows.join(chosen.select("locus_id"), "locus_id", "left_semi")


def weighted_moments(rows: DataFrame, value: str, weight: str) -> DataFrame:
    """(locus_id, mean, var) of weighted values: one pass of sums."""
    x, w = F.col(value).cast("double"), F.col(weight).cast("double")
    g = rows.groupBy("locus_id").agg(F.sum(w).alias("w"), F.sum(w * x).alias("wx"), F.sum(w * x * x).alias("wxx"))
    mean = F.col("wx") / F.col("w")
    return g.select("locus_id", mean.alias("mean"), (F.col("wxx") / F.col("w") - mean * mean).alias("var"))


def both_kinds(good: DataFrame, removed: DataFrame) -> DataFrame:
    """Rows of both tables with their ``kind``, by column name."""
    return good.withColumn("kind", F.lit("good")).unionByName(removed.withColumn("kind", F.lit("removed")), allowMissingColumns=True)


def majority(items: DataFrame) -> DataFrame:
    """(locus_id, pos, symbol, votes) from (locus_id, pos, symbol, seq): the most frequent, of equally frequent the first seen."""
    votes = items.groupBy("locus_id", "pos", "symbol").agg(F.count(F.lit(1)).alias("votes"), F.min("seq").alias("first"))
    best = F.max_by(F.struct("symbol", "votes"), F.struct("votes", -F.col("first")))
    return votes.groupBy("locus_id", "pos").agg(best.alias("b")).select("locus_id", "pos", "b.symbol", "b.votes")


def kmer_frequency(kmers: DataFrame) -> DataFrame:
    """(kmer, n, n_reads) over (query_name, kmer)."""
    return kmers.groupBy("kmer").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("query_name").alias("n_reads"))


def top_kmers(frequency: DataFrame, k: int = 12) -> DataFrame:
    """The k-mers in most reads, then most frequent: a bounded report."""
    return frequency.orderBy(F.desc("n_reads"), F.desc("n"), "kmer").limit(k)


def bucket_others(kmers: DataFrame, top: DataFrame, column: str = "kmer") -> DataFrame:
    """``kmers`` with ``label``: the k-mer itself if it is in ``top``, else Other."""
    named = top.select(F.col(column).alias("__top"))
    out = kmers.join(named, F.col(column) == F.col("__top"), "left")
    return out.withColumn("label", F.coalesce("__top", F.lit("Other"))).drop("__top")


#: Tasks by the hash of a locus for each of the session's shuffle partitions.
PARTS = 8


def length_histogram(counts: DataFrame) -> DataFrame:
    """(locus_id, haplotype, bin, n) of (locus_id, haplotype, count): bins as wide as a hundredth of the locus's longest count.

    Equal counts are added up with partial sums, so a locus deals out its distinct counts, not its rows; the longest count is a window
    over these, so nothing is joined.  Windows are sorted, not held, in an explicit number of tasks that aren't merged by bytes.
    """
    n = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions")) * PARTS
    seen = counts.groupBy("locus_id", "haplotype", "count").agg(F.count(F.lit(1)).alias("n")).repartition(n, "locus_id")
    longest = F.max("count").over(Window.partitionBy("locus_id"))
    width = F.ceil(F.greatest(F.col("longest"), F.lit(1)) / F.least(F.lit(100), F.greatest(F.col("longest"), F.lit(1))))
    binned = seen.withColumn("longest", longest).withColumn("bin", (F.floor(F.col("count") / width) * width).cast("long"))
    return binned.groupBy("locus_id", "haplotype", "bin").agg(F.sum("n").alias("n"))


def normalised_density(density: DataFrame) -> DataFrame:
    """(locus_id, haplotype, x, density, n) with ``scaled``: the highest density of a haplotype at its ``n``."""
    top = F.max("density").over(Window.partitionBy("locus_id", "haplotype"))
    return density.withColumn("scaled", F.col("density") / top * F.col("n"))


def normal_density(x: Column, mean: Column, sd: Column) -> Column:
    return F.exp(-0.5 * F.pow((x - mean) / sd, F.lit(2.0))) / (sd * F.sqrt(2 * F.pi()))


def read_order(calls: DataFrame, *ties: str) -> DataFrame:
    """``calls`` with ``read_id``, their order in a plot: haplotype, kind, then length (falling for right flanks).

    The number runs over the rows of one locus.
    """
    kind = F.array_position(F.array(*[F.lit(t) for t in TYPE_ORDER]), F.col("alignment_type"))
    size = F.when(F.col("alignment_type") == "right_flanking", -F.col("length")).otherwise(F.col("length"))
    return calls.withColumn("read_id", F.row_number().over(Window.partitionBy("locus_id").orderBy("haplotype", kind, size, *ties)))


def plot_frame(kmers: DataFrame) -> DataFrame:
    """(locus_id, haplotype, query_name, alignment_type, idx, ...) with ``place``: right flanks stand at the right edge of their haplotype."""
    in_read = F.max("idx").over(Window.partitionBy("locus_id", "query_name"))
    in_group = F.max("idx").over(Window.partitionBy("locus_id", "haplotype"))
    return kmers.withColumn("place", F.when(F.col("alignment_type") == "right_flanking", F.col("idx") + in_group - in_read).otherwise(F.col("idx")))


def stripes(sizes: DataFrame, *order: str) -> DataFrame:
    """Every other group's range [start, stop) of a running sum of ``n``, in each locus."""
    w = Window.partitionBy("locus_id").orderBy(*order)
    s = sizes.withColumn("stop", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("row", F.row_number().over(w))
    return s.where("row % 2 = 1").withColumn("start", F.col("stop") - F.col("n"))


def significant_parameters(parameters: DataFrame, tests: DataFrame) -> DataFrame:
    """Parameters of the genotype that the test took, with ``wide``: an interval of more than two units."""
    p = parameters.join(tests.select("locus_id", "is_significant"), "locus_id")
    p = p.where((F.col("is_significant") & (F.col("haplotype") != "hom")) | (~F.col("is_significant") & (F.col("haplotype") == "hom")))
    return p.withColumn("wide", F.coalesce((F.col("mean_upper") - F.col("mean_lower")) > 2, F.lit(False)))


def distances(pairs: DataFrame, *key: str) -> DataFrame:
    """``pairs`` (key, first, second, ...) with ``distance`` in place of the two texts, null where one is.

    A pair costs the product of its lengths, so pairs are dealt by ``key`` to an explicit number of tasks, however few bytes they are.
    """
    ship(pairs.sparkSession)

    @F.pandas_udf("int")
    def distance(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else alignment.distance(x, y) for x, y in zip(a, b, strict=True)], dtype="Int32")

    dealt = pairs.repartition(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), *key)
    return dealt.withColumn("distance", distance("first", "second")).drop("first", "second")


def nearest(reads: DataFrame, centres: DataFrame, on: str = "locus_id") -> DataFrame:
    """Flanking reads (on, query_name, alignment_type, sequence) with the haplotype of the nearest consensus (on, haplotype, kind, consensus).

    Distance is the edit distance of the parts that both cover; two flanking sequences of different sides can't be compared.  Ties
    go to the first haplotype by name; ``none`` where nothing compares.  A locus has two haplotypes at most; the consensus sequences
    are written first, so that the plan knows whether they are few enough to go to every task.
    """
    both = reads.join(written(centres), on, "left")
    a, b = C.compare_pair(F.col("sequence"), F.col("alignment_type"), F.col("consensus"), F.col("kind"))
    comparable = (F.col("alignment_type") == "spanning") | (F.col("kind") == "spanning") | (F.col("alignment_type") == F.col("kind"))
    d = distances(both.select(on, "query_name", "haplotype", F.when(comparable, a).alias("first"), b.alias("second")), on, "query_name")
    least = F.min(F.when(F.col("distance").isNotNull(), F.struct("distance", "haplotype")))
    return d.groupBy(on, "query_name").agg(least.alias("m")).select(on, "query_name", F.coalesce("m.haplotype", F.lit("none")).alias("haplotype"), "m.distance")
