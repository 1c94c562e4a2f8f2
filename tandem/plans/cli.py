"""Command line: ``python -m tandem.plans.cli --bam reads.bam --ref genome.fa --str-catalog loci.json --report out``."""

from __future__ import annotations

import argparse
import logging
import sys
from dataclasses import fields
from logging.handlers import TimedRotatingFileHandler

from tandem import __version__
from tandem.config import Config

_OPTIONS = (
    "min_str_qual", "tol_str_qual", "min_q10_str_quality", "tol_q10_str_quality", "max_error_rate", "tol_error_rate", "max_ref_divergence", "min_n_outlier_detection",
    "anchor_length", "min_anchor_overlap", "min_end_qual", "trim_window_size", "max_trim", "min_haplotyping_depth", "heterozygozity_alpha",
)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tandem", description="Genotypes tandem repeats from long reads.")
    p.add_argument("--version", action="version", version=__version__)
    p.add_argument("--bam", "-i", required=True, help="alignments, a file or a folder of files")
    p.add_argument("--ref", "-r", required=True, help="reference FASTA, with an index beside it for variants")
    p.add_argument("--str-catalog", "-s", required=True, help="loci, JSON")
    p.add_argument("--report", "-o", required=True, help="folder of the result tables and the report")
    p.add_argument("--vcf", "-v", help="variants")
    p.add_argument("--sample-id", "-n", default="sample")
    p.add_argument("--loci-subset", help="ids, separated by commas")
    p.add_argument("--sex", choices=("XX", "XY"), default="XX")
    p.add_argument("--log-file", "-l")
    p.add_argument("--keep-temp-files", action="store_true", help="accepted for compatibility; there are no such files")
    p.add_argument("--add-consensus-to-vcf", action="store_true")
    p.add_argument("--add-contracted-consensus-to-vcf", action="store_true")
    kinds = {f.name: type(f.default) for f in fields(Config)}
    for name in _OPTIONS:
        p.add_argument("--" + name.replace("_", "-"), type=kinds[name], default=getattr(Config, name))
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    log = logging.getLogger("tandem")
    log.setLevel(logging.DEBUG)
    console = logging.StreamHandler()
    console.setLevel(logging.INFO)
    log.addHandler(console)
    if a.log_file:
        log.addHandler(TimedRotatingFileHandler(a.log_file, when="W0", backupCount=8))
    from pyspark.sql import SparkSession

    from tandem.plans.pipeline import run

    spark = SparkSession.builder.appName("tandem").getOrCreate()
    subset = [x for x in a.loci_subset.split(",") if x] if a.loci_subset else None
    try:
        run(spark, a.bam, a.ref, a.str_catalog, a.report, a.vcf, a.sample_id, a.sex, subset, a.add_consensus_to_vcf, a.add_contracted_consensus_to_vcf, Config(**{n: getattr(a, n) for n in _OPTIONS}))
    except ValueError as e:
        log.error(e)
        return 1
    log.info("results are in %s", a.report)
    return 0


if __name__ == "__main__":
    sys.exit(main())
