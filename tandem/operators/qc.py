"""Quality control of read calls: hard limits, robust outliers, splits, ploidy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tandem.config import Config

#: metric, how a value is bad beyond its limit, name in ``outlier_reasons`` (fixed values)
METRICS = (("mean_str_quality", "min", "outlier_str_quality"), ("q10_str_quality", "min", "outlier_q10_str_quality"), ("str_error_rate", "max", "outlier_error_rate"))


def hard_reasons(c: Config = Config()) -> Column:
    """Reasons for which a read call fails outright, in the order of the checks; empty if none."""
    checks = (
        ("filtered_low_mean_str_quality", F.col("mean_str_quality") < c.min_str_qual),
        ("filtered_low_q10_str_quality", F.col("q10_str_quality") < c.min_q10_str_quality),
        ("filtered_high_str_error_rate", F.col("str_error_rate") > c.max_error_rate),
        ("filtered_high_str_ref_divergence", F.col("str_ref_divergence") > c.max_ref_divergence),
    )
    return F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in checks]))


def hard_filter(calls: DataFrame, c: Config = Config()) -> DataFrame:
    """``calls`` with their ``outlier_reasons``; a narrow projection, no shuffle."""
    return calls.withColumn("outlier_reasons", hard_reasons(c))


def _between(low: Column, high: Column, part: Column) -> Column:
    """``low * (1 - part) + high * part`` for a part of quarters, rounded as the fused multiply-add ``fma(low, 1 - part, high * part)``.

    Measured values sit exactly on limits, so the last bit decides, and DuckDB's quantiles are fused.  Halves are exact and with three
    quarters only ``high * part`` is rounded, so only one quarter takes the error of ``0.75 * low`` along.
    """
    p, q = 0.75 * low, 0.25 * high
    missed = (0.5 * low - p) + 0.25 * low  # 0.75 * low less p, exact
    s = p + q
    lost = (p - (s - (s - p))) + (q - (s - p))  # p + q less s, exact
    return F.when(part == 0, low).when(part == 0.25, s + (lost + missed)).otherwise((1 - part) * low + part * high)


def quartiles(rows: DataFrame, names: list[str]) -> DataFrame:
    """(locus_id, <name>) with the three interpolated quartiles of each column as an array.

    Equal values are counted first, with partial sums, so neither a locus's reads nor its values lie in one row.
    """
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("m"), F.col(c).cast("double").alias("x")) for i, c in enumerate(names)])).alias("e")
    seen = rows.select("locus_id", each).select("locus_id", "e.m", "e.x").where(F.col("x").isNotNull()).groupBy("locus_id", "m", "x").agg(F.count(F.lit(1)).alias("c"))
    own = Window.partitionBy("locus_id", "m")
    up_to = F.sum("c").over(own.orderBy("x").rowsBetween(Window.unboundedPreceding, 0))
    placed = seen.select("locus_id", "m", "x", up_to.alias("up_to"), F.sum("c").over(own).alias("n"))
    ends, found = [], []
    for i, q in enumerate((0.25, 0.5, 0.75)):
        at = (F.col("n") - 1) * q
        ends += [F.min(F.when(F.col("up_to") > F.floor(at), F.col("x"))).alias(f"low{i}"), F.min(F.when(F.col("up_to") > F.ceil(at), F.col("x"))).alias(f"high{i}")]
        found.append(_between(F.col(f"low{i}"), F.col(f"high{i}"), at - F.floor(at)))
    each = placed.groupBy("locus_id", "m").agg(F.max("n").alias("n"), *ends).select("locus_id", "m", F.array(*found).alias("q"))
    return each.groupBy("locus_id").agg(*[F.max(F.when(F.col("m") == i, F.col("q"))).alias(c) for i, c in enumerate(names)])


def thresholds(good: DataFrame) -> DataFrame:
    """(locus_id, n_good, <metric>_low, <metric>_high): median -/+ 1.5 times the interquartile range, of reads that passed."""
    names = [m for m, _, _ in METRICS]
    g = good.groupBy("locus_id").agg(F.count(F.lit(1)).alias("n_good")).join(quartiles(good, names), "locus_id", "left")
    limits = []
    for m, _, _ in METRICS:
        spread = 1.5 * (F.col(m)[2] - F.col(m)[0])
        limits += [(F.col(m)[1] - spread).alias(f"{m}_low"), (F.col(m)[1] + spread).alias(f"{m}_high")]
    return g.select("locus_id", "n_good", *limits)


def outliers(calls: DataFrame, c: Config = Config()) -> DataFrame:
    """Calls with all their ``outlier_reasons``, hard ones and robust ones, and haplotype ``outlier`` where there is any.

    Robust outliers are looked for among reads that passed the hard limits, in loci with enough of those; all metrics are held
    against the same reads.  One aggregation a locus, joined back; a locus with very many reads is split by the adaptive
    skew join, as limits are one row a locus.
    """
    checked = hard_filter(calls, c)
    limits = thresholds(checked.where(F.size("outlier_reasons") == 0)).where(F.col("n_good") >= c.min_n_outlier_detection)
    tolerance = {"mean_str_quality": c.tol_str_qual, "q10_str_quality": c.tol_q10_str_quality, "str_error_rate": c.tol_error_rate}
    found = []
    for m, side, reason in METRICS:
        low = (F.col(m) < F.col(f"{m}_low")) & (F.col(m) < tolerance[m])
        high = (F.col(m) > F.col(f"{m}_high")) & (F.col(m) > tolerance[m])
        found.append(F.when(low if side == "min" else high, F.lit(reason)))
    robust = F.when((F.size("outlier_reasons") == 0) & F.col("n_good").isNotNull(), F.array_compact(F.array(*found))).otherwise(F.array().cast("array<string>"))
    out = checked.join(limits, "locus_id", "left").withColumn("outlier_reasons", F.concat("outlier_reasons", robust))
    out = out.drop(*limits.columns[1:])
    return out.withColumn("haplotype", F.when(F.size("outlier_reasons") > 0, "outlier").otherwise(F.lit("none")))


def depth_ploidy(calls: DataFrame, sex: str = "XX", c: Config = Config()) -> DataFrame:
    """(locus_id, chrom, depth, ploidy) from (locus_id, chrom): sex chromosomes by ``sex``, one haplotype if there are few reads."""
    d = calls.groupBy("locus_id", "chrom").agg(F.count(F.lit(1)).alias("depth"))
    by_sex = F.when(F.col("chrom") == "chrY", sex.count("Y")).when(F.col("chrom") == "chrX", sex.count("X")).otherwise(2)
    return d.withColumn("ploidy", F.when(F.col("depth") < c.min_haplotyping_depth, 1).otherwise(by_sex).cast("int"))


def singletons(calls: DataFrame) -> DataFrame:
    """(locus_id, haplotype) groups of a single read."""
    return calls.groupBy("locus_id", "haplotype").agg(F.count(F.lit(1)).alias("n"), F.min("query_name").alias("query_name")).where("n = 1").drop("n")
