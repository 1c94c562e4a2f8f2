"""Genotyping: one row a locus from its read calls."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandem.config import Config
from tandem.functions.genotype import Fit, Observations, genotype
from tandem.shipping import ship

KINDS = {"spanning": 0, "left_flanking": 1, "right_flanking": 2}
_FIT = "struct<mean:array<double>,mean_lower:array<double>,mean_upper:array<double>>"
SCHEMA = f"""locus_id string, ploidy int, n_reads long,
labels array<struct<alignment_type:string,kmer_count:array<int>,haplotype:string,reasons:array<string>,removed:boolean>>,
h1 {_FIT}, h2 {_FIT}, het_unit_var array<double>, hom {_FIT}, hom_unit_var array<double>,
log_lik_hom double, log_lik_hetero double, n_par_hom int, n_par_hetero int, statistic double, df int, p_value double, is_significant boolean"""


def _fit(fit: Fit | None, i: int, units: int) -> dict:
    if fit is None:
        empty = [float("nan")] * units
        return {"mean": empty, "mean_lower": empty, "mean_upper": empty}
    low, high = fit.intervals[i]
    return {"mean": fit.means[i].astype(float).tolist(), "mean_lower": low.tolist(), "mean_upper": high.tolist()}


def _result(observed: list[dict], ploidy: int, config: Config) -> dict:
    """All that a locus's observations give; every column but its name."""
    names = list(KINDS)
    units = len(observed[0]["kmer_count"])
    o = Observations(np.array([list(x["kmer_count"]) for x in observed]), np.array([KINDS[x["alignment_type"]] for x in observed]), np.array([x["n"] for x in observed]), config)
    g = genotype(o, ploidy)
    labels = [
        {"alignment_type": names[int(k)], "kmer_count": [int(x) for x in c], "haplotype": h, "reasons": r, "removed": gone}
        for k, c, h, r, gone in zip(g.kind, g.counts, g.haplotype, g.reasons, g.removed, strict=True)
    ]
    return {
        "ploidy": ploidy, "n_reads": len(o), "labels": labels,
        "h1": _fit(g.het, 0, units), "h2": _fit(g.het, 1, units), "het_unit_var": (g.het.unit_var if g.het else np.full(units, np.nan)).tolist(),
        "hom": _fit(g.hom, 0, units), "hom_unit_var": g.hom.unit_var.tolist(),
        "log_lik_hom": g.log_lik_hom, "log_lik_hetero": g.log_lik_het, "n_par_hom": g.n_par_hom, "n_par_hetero": g.n_par_het,
        "statistic": g.statistic, "df": g.df, "p_value": g.p_value, "is_significant": g.is_significant,
    }


#: Loci of one table that a task gives out.
ROWS = 256


def _loci(config: Config):
    """(locus_id, ploidy, observed) to results; loci of equal observations, which come one after the other, are fitted once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, known = None, {}
        for batch in batches:
            out = []
            for name, ploidy, observed in zip(batch.locus_id, batch.ploidy, batch.observed, strict=True):
                key = (int(ploidy), tuple((x["alignment_type"], tuple(x["kmer_count"]), x["n"]) for x in observed))
                if key != last:
                    last, known = key, _result(list(observed), int(ploidy), config)
                out.append({"locus_id": name, **known})
                if len(out) == ROWS:
                    yield pd.DataFrame(out)
                    out = []
            if out:
                yield pd.DataFrame(out)

    return run


def genotype_loci(calls: DataFrame, ploidy: DataFrame | None = None, config: Config = Config()) -> DataFrame:
    """One row a locus: labels of its distinct observations, fits, intervals and the likelihood-ratio test.

    Equal reads of a locus are counted first, with partial sums before the shuffle, so a task holds a locus's distinct
    (type, counts), not its reads.  ``ploidy`` has (locus_id, ploidy); loci that it gives 0 copies have no result.
    """
    seen = calls.groupBy(F.col("locus_id").cast("string").alias("locus_id"), "alignment_type", F.col("kmer_count").cast("array<int>").alias("kmer_count")).agg(F.count(F.lit(1)).alias("n"))
    return genotype_counts(seen, ploidy, config)


def genotype_counts(seen: DataFrame, ploidy: DataFrame | None = None, config: Config = Config()) -> DataFrame:
    """:func:`genotype_loci` of reads that are counted already: (locus_id, alignment_type, kmer_count, n), a row each distinct one.

    A result depends on a locus's observations only, so loci are dealt by these and equal ones are fitted once.
    """
    ship(seen.sparkSession)
    seen = seen.select("locus_id", "alignment_type", "kmer_count", "n")
    if ploidy is None:
        seen = seen.withColumn("ploidy", F.lit(2))
    else:
        seen = seen.join(ploidy.select(F.col("locus_id").cast("string").alias("locus_id"), "ploidy"), "locus_id").where("ploidy > 0")
    each = F.sort_array(F.collect_list(F.struct("alignment_type", "kmer_count", "n"))).alias("observed")
    loci = seen.groupBy("locus_id", "ploidy").agg(each).withColumn("same", F.xxhash64("ploidy", "observed"))
    # the rows are few and each is much work: an explicit number of partitions isn't merged by their bytes
    dealt = loci.repartition(int(seen.sparkSession.conf.get("spark.sql.shuffle.partitions")), "same").sortWithinPartitions("same")
    return dealt.select("locus_id", "ploidy", "observed").mapInPandas(_loci(config), SCHEMA)


def label_reads(calls: DataFrame, loci: DataFrame) -> DataFrame:
    """``calls`` with ``haplotype`` and the reasons that genotyping adds, by their locus, type and counts."""
    labels = loci.select("locus_id", F.inline("labels")).withColumnRenamed("haplotype", "label")
    on = [c for c in ("locus_id", "alignment_type", "kmer_count")]
    own = calls.withColumn("locus_id", F.col("locus_id").cast("string")).withColumn("kmer_count", F.col("kmer_count").cast("array<int>"))
    out = own.join(labels, on, "left")
    have = F.coalesce("outlier_reasons", F.array().cast("array<string>")) if "outlier_reasons" in calls.columns else F.array().cast("array<string>")
    out = out.withColumn("outlier_reasons", F.concat(have, F.coalesce("reasons", F.array().cast("array<string>")))).withColumn("haplotype", F.coalesce("label", F.lit("none")))
    return out.drop("label", "reasons", "removed")


def test_summary(loci: DataFrame) -> DataFrame:
    return loci.select("log_lik_hom", "log_lik_hetero", "n_par_hom", "n_par_hetero", "statistic", "df", "p_value", "is_significant", "locus_id")


def parameter_summary(loci: DataFrame) -> DataFrame:
    """(locus_id, haplotype, idx, mean, mean_lower, mean_upper, unit_var): a row a haplotype and unit."""
    each = [F.struct(F.lit(h).alias("haplotype"), F.col(h).alias("fit"), F.col("hom_unit_var" if h == "hom" else "het_unit_var").alias("var")) for h in ("h1", "h2", "hom")]
    s = loci.select("locus_id", F.explode(F.array(*each)).alias("p"))
    s = s.select("locus_id", "p.haplotype", F.posexplode(F.arrays_zip("p.fit.mean", "p.fit.mean_lower", "p.fit.mean_upper", F.col("p.var").alias("unit_var"))).alias("idx", "x"))
    return s.select("locus_id", "haplotype", "idx", "x.mean", "x.mean_lower", "x.mean_upper", "x.unit_var")
