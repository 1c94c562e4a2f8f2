"""Reads: interval scans, primary and supplementary alignments, trimming, unique names, k-mer error rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tandem.config import Config
from tandem.functions import columns as C
from tandem.functions import kmers
from tandem.shipping import ship

SECONDARY, SUPPLEMENTARY = 0x100, 0x800
#: Width of the bins in which intervals meet; the least bin of a BAM index.
BIN = 16384


def bins(start: Column, end: Column, width: int = BIN) -> Column:
    """The bins that a half-open interval touches."""
    return F.sequence(F.floor(start / width), F.floor((F.greatest(end, start + 1) - 1) / width))


def overlaps(reads: DataFrame, loci: DataFrame, on: tuple[str, ...] = (), width: int = BIN) -> DataFrame:
    """Pairs of a read and a locus whose half-open [start, end) overlap: an equi-join on bins and a check, so no nested loop.

    A pair that meets in several bins is taken in the first bin of the overlap only, so none comes twice and nothing needs to be
    made distinct afterwards.  Column names of the two sides must differ except for ``start``, ``end`` and those in ``on``.
    """
    r = reads.withColumn("bin", F.explode(bins(F.col("start"), F.col("end"), width))).withColumnsRenamed({"start": "read_start", "end": "read_end"})
    s = loci.withColumn("bin", F.explode(bins(F.col("start"), F.col("end"), width))).withColumnsRenamed({"start": "locus_start", "end": "locus_end"})
    met = r.join(s, [*on, "bin"]).where("read_start < locus_end and locus_start < read_end")
    return met.where(F.col("bin") == F.floor(F.greatest("read_start", "locus_start") / width)).drop("bin")


def split_alignments(alignments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Primary alignments of each locus, and supplementary ones of reads whose primary alignment isn't at the locus; no secondary ones."""
    own = alignments.where(F.col("flag").bitwiseAND(SECONDARY) == 0)
    is_supplementary = F.col("flag").bitwiseAND(SUPPLEMENTARY) != 0
    primary = own.where(~is_supplementary)
    return primary, own.where(is_supplementary).join(primary.select("locus_id", "query_name").distinct(), ["locus_id", "query_name"], "left_anti")


def primary_alignments(alignments: DataFrame, candidates: DataFrame) -> DataFrame:
    """For each locus its primary alignments, and the primary of each supplementary one whose primary lies elsewhere.

    ``alignments`` are those that overlap a locus (locus_id, query_name, flag, sa, ...), ``candidates`` all alignments
    (query_name, flag, chrom, pos (0-based), ...).  Secondary ones never count.  The tag's place is 1-based.
    """
    primary, alone = split_alignments(alignments)
    at = alone.select("locus_id", "query_name", F.split("sa", ",")[0].alias("chrom"), (F.split("sa", ",")[1].cast("long") - 1).alias("pos")).distinct()
    real = candidates.where((F.col("flag").bitwiseAND(SECONDARY | SUPPLEMENTARY)) == 0)
    found = real.join(at, ["query_name", "chrom", "pos"])
    return primary.unionByName(found.select(*[c if c in found.columns else F.lit(None).alias(c) for c in primary.columns]))


def trim_reads(reads: DataFrame, c: Config = Config()) -> DataFrame:
    """Cuts soft-clipped bases (``max_trim`` at most a side), then bases of low quality at both ends."""
    left, right = F.least("n_soft_clipped_left", F.lit(c.max_trim)), F.least("n_soft_clipped_right", F.lit(c.max_trim))
    cut = C.let(F.struct(left.alias("l"), right.alias("r"), C.trim(F.col("qualities"), left, right).alias("q")), lambda s: C.let(
        C.low_quality_ends(s["q"], c.trim_window_size, c.min_end_qual, c.max_trim),
        lambda e: F.struct(s["l"].alias("l"), s["r"].alias("r"), (s["l"] + e["left"]).alias("a"), (s["r"] + e["right"]).alias("b"))))
    r = reads.withColumn("__cut", cut)
    a, b = F.col("__cut.a"), F.col("__cut.b")
    new = {
        "sequence": C.trim_text(F.col("sequence"), a, b), "qualities": C.trim(F.col("qualities"), a, b), "mod_5mc_probs": C.trim_text(F.col("mod_5mc_probs"), a, b),
        "n_soft_clipped_left": F.col("n_soft_clipped_left") - F.col("__cut.l"), "n_soft_clipped_right": F.col("n_soft_clipped_right") - F.col("__cut.r"),
    }
    return r.select(*[new[x].alias(x) if x in new else F.col(x) for x in reads.columns])


def unique_names(reads: DataFrame, *order: str) -> DataFrame:
    """Names made unique in each locus: the second of a name becomes ``name_1``, and so on, in the given order."""
    turn = F.row_number().over(Window.partitionBy("locus_id", "query_name").orderBy(*order)) - 1
    return reads.withColumn("query_name", F.when(turn == 0, F.col("query_name")).otherwise(F.concat("query_name", F.lit("_"), turn.cast("string"))))


def kmer_error_rate(reads: DataFrame, k: int = Config.error_kmer) -> DataFrame:
    """(locus_id, query_name, str_error_rate) from (locus_id, query_name, sequence).

    The share of a read's k-mers that no other read of its locus has, by k and its length.  A k-mer is another's if two reads have
    it, so one count of reads a k-mer does what comparing all pairs of reads would do.  0 for an empty read or the only one.
    Tasks name the distinct k-mers of many reads together (:mod:`tandem.functions.kmers`) and these sets, not the places, go through the
    one shuffle, packed.  A locus and a read are a 64-bit hash each, and so is a k-mer with its locus where they meet.
    """
    ship(reads.sparkSession)
    own = reads.select("locus_id", "query_name", "sequence", F.xxhash64("locus_id", "query_name").alias("__read"))
    n = own.select("locus_id", "query_name", "__read", F.length("sequence").alias("length"))
    others = own.groupBy("locus_id").agg(F.count(F.lit(1)).alias("reads"))
    whole = own.where(F.length("sequence") >= k).select(F.xxhash64("locus_id").alias("locus"), "__read", F.col("sequence").cast("binary").alias("text"))
    dealt = whole.mapInArrow(kmers.packed(k), kmers.PACKED_DDL).repartition(int(reads.sparkSession.conf.get("spark.sql.shuffle.partitions")), "bucket")
    parts = dealt.sortWithinPartitions("bucket").mapInArrow(kmers.alone, "__read long, wrong long")
    wrong = parts.groupBy("__read").agg(F.sum("wrong").alias("wrong"))
    out = n.join(others, "locus_id").join(wrong, "__read", "left")
    rate = F.when((F.col("length") == 0) | (F.col("reads") < 2), F.lit(0.0)).otherwise(F.coalesce("wrong", F.lit(0)) / k / F.col("length"))
    return out.select("locus_id", "query_name", rate.alias("str_error_rate"))
