"""Genotyping from files: catalogue, reference and alignments to result tables, variants and a report."""

from __future__ import annotations

import logging
import os
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tandem.config import Config
from tandem.operators import calls as calls_
from tandem.operators import consensus as consensus_
from tandem.operators import genotype, qc, summary, vcf
from tandem.operators import reads as reads_
from tandem.sources import bam, files
from tandem.tables import written

log = logging.getLogger("tandem")


def load_loci(spark: SparkSession, catalogue: str, fasta: str, subset: Iterable[str] | None = None, c: Config = Config()) -> DataFrame:
    """The catalogue's loci with their anchors; of a ``subset`` none of whose ids exists nothing can be done."""
    loci = files.read_catalogue(spark, catalogue)
    if subset is not None:
        loci = loci.where(F.col("locus_id").isin(list(subset)))
        if loci.limit(1).count() == 0:
            raise ValueError("none of the loci is in the catalogue")
    if files.has(fasta + ".fai"):
        return files.anchors_by_index(loci, fasta, c)
    return files.with_anchors(loci, files.read_fasta(spark, fasta), c)


def region_text(rows: Iterable) -> str:
    """Regions (chrom, start, end) as the source of alignments takes them."""
    return ",".join(f"{chrom}:{max(start, 0)}-{max(end, start + 1)}" for chrom, start, end in rows)


def alignments_at(spark: SparkSession, path: str, loci: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Alignments that overlap the loci, and those at the places that the tags of supplementary ones among them name.

    The catalogue's regions and those places go to the source, which reads only there; both lists are as long as the catalogue and
    the supplementary alignments at its loci.
    """
    read = lambda rows: spark.read.format("bam").option("regions", region_text(rows)).load(path)
    near = written(read(loci.select("chrom", "start", "end").collect()))
    tag = F.split("sa", ",")
    other = near.where(F.col("flag").bitwiseAND(reads_.SUPPLEMENTARY) != 0).where("sa is not null").select(tag[0].alias("chrom"), (tag[1].cast("long") - 1).alias("pos")).distinct()
    places = [(r.chrom, r.pos, r.pos + 1) for r in other.collect()]
    return near, read(places) if places else near.limit(0)


def reads_at(alignments: DataFrame, loci: DataFrame, c: Config = Config(), others: DataFrame | None = None) -> DataFrame:
    """Primary alignments that overlap each locus, trimmed, with unique names.

    ``others`` has the primary alignments that lie elsewhere; all alignments, if they are read whole.
    """
    region = loci.select("locus_id", "chrom", "start", "end")
    near = reads_.overlaps(alignments.withColumn("start", F.col("pos")), region.withColumn("end", F.greatest("end", F.col("start") + 1)), on=("chrom",))
    near = near.withColumn("end", F.col("read_end")).select("locus_id", *alignments.columns)
    primary = reads_.primary_alignments(near, alignments if others is None else others)
    trimmed = reads_.trim_reads(primary, c)
    named = reads_.unique_names(trimmed, "chrom", "pos", "cigar", "sequence")
    return named.select("locus_id", "query_name", "strand", "sequence", "qualities", "mod_5mc_probs")


def genotype_reads(reads: DataFrame, loci: DataFrame, sex: str = "XX", c: Config = Config()) -> dict[str, DataFrame]:
    """The result tables of reads at their loci: reads, filtered_reads, consensus, haplotypes, summary, par_summary.

    Reads, aligned reads, checked and labelled calls, the genotype table and both consensus tables are each used several times: they
    end in tables of the shared folder, so plans stay small and a lost executor costs one step.
    """
    reads, loci = written(reads), written(loci)
    aligned = written(calls_.align(reads, loci))
    log.debug("reads are aligned")
    depth = reads.join(loci.select("locus_id", "chrom"), "locus_id").select("locus_id", "chrom")
    ploidy = qc.depth_ploidy(depth, sex, c)
    checked = written(qc.outliers(written(calls_.read_calls(aligned, loci, c)), c))
    good, bad = checked.where(F.size("outlier_reasons") == 0), checked.where(F.size("outlier_reasons") > 0)
    found = written(genotype.genotype_loci(good, ploidy, c))
    log.debug("%d loci are genotyped", found.count())
    labelled = written(genotype.label_reads(good, found))
    first = written(consensus_.consensus_calls(written(consensus_.consensus(labelled)), loci))
    labelled = written(consensus_.relabel_flanking(labelled, first))
    final = written(consensus_.consensus_calls(written(consensus_.consensus(labelled)), loci))
    all_reads = written(labelled.unionByName(bad.withColumn("locus_id", F.col("locus_id").cast("string"))))
    units = files.units_of(loci).select("locus_id", "idx", "satellite")
    return {
        "reads": all_reads,
        "filtered_reads": calls_.filtered_reads(aligned),
        "consensus": final,
        "haplotypes": summary.with_units(summary.group_summary(all_reads), units),
        "summary": genotype.test_summary(found),
        "par_summary": summary.with_units(genotype.parameter_summary(found), units),
        "loci": found,
    }


def unit_places(found: DataFrame, loci: DataFrame) -> DataFrame:
    """Consensus calls with ``unit_of``: of each k-mer the index of its unit, -1 for a break."""
    s = found.join(loci.select(F.col("locus_id").cast("string").alias("locus_id"), "breaks"), "locus_id")
    part = lambda i: F.concat(F.when(F.get("breaks", i) != "", F.array(F.lit(-1))).otherwise(F.array().cast("array<int>")), F.array_repeat(i, F.get("kmer_count", i)))
    n = F.size("kmer_count")
    last = F.when(F.get("breaks", n) != "", F.array(F.lit(-1))).otherwise(F.array().cast("array<int>"))
    return s.withColumn("unit_of", F.concat(F.flatten(F.transform(F.sequence(F.lit(0), n - 1), part)), last)).drop("breaks")


def run(spark: SparkSession, bam_path: str, fasta: str, catalogue: str, out: str, vcf_path: str | None = None, sample: str = "sample", sex: str = "XX", subset: Iterable[str] | None = None,
        with_consensus: bool = False, with_contracted: bool = False, c: Config = Config()) -> dict[str, DataFrame]:
    """Genotypes a file of alignments and writes the tables (CSV) and a report into ``out`` and the variants to ``vcf_path``."""
    from tandem.operators import report

    bam.register(spark)
    loci = written(load_loci(spark, catalogue, fasta, subset, c))
    log.debug("%d loci", loci.count())
    near, others = alignments_at(spark, bam_path, loci)
    result = genotype_reads(reads_at(near, loci, c, others), loci, sex, c)
    for name in ("reads", "filtered_reads", "consensus", "haplotypes", "summary", "par_summary"):
        files.write_table(result[name], f"{out}/{name}.csv")
    if vcf_path:
        order = files.read_fai(spark, fasta + ".fai")
        alleles = vcf.alleles(result["loci"], result["reads"])
        cons = vcf.unit_consensus(unit_places(result["consensus"], loci)) if with_consensus or with_contracted else None
        units = files.units_of(loci)
        shown = files.fetch(units.withColumn("end", F.greatest("end", F.col("start") + 1)), fasta, "ref").select("locus_id", "idx", "ref")
        lines = vcf.records(alleles, units.join(shown, ["locus_id", "idx"]), None, order, cons, with_contracted)
        vcf.write(lines, alleles, order, vcf_path, sample, fasta)
    os.makedirs(out, exist_ok=True)
    log.debug("tables and variants are written")
    report.write(result, f"{out}/report.html", sample, loci)
    log.debug("the report is written")
    return result
