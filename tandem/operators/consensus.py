"""Consensus sequences of haplotypes, and flanking reads given to the nearest."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandem.functions import columns as C
from tandem.functions.consensus import haplotype_consensus
from tandem.operators.calls import align
from tandem.operators.summary import nearest
from tandem.shipping import ship

_SCHEMA = "locus_id string, haplotype string, kind string, kmers array<string>, spanning_reads long, flanking_reads long"


def _group(rows: pd.DataFrame) -> pd.DataFrame:
    seqs = [(t, tuple(k), int(n)) for t, k, n in zip(rows.alignment_type, rows.obs_kmers, rows.n, strict=True)]
    spanning = sum(n for t, _, n in seqs if t == "spanning")
    flanking = sum(n for _, _, n in seqs) - spanning
    return pd.DataFrame(
        [(rows.locus_id.iloc[0], rows.haplotype.iloc[0], kind, list(k), spanning, flanking) for kind, k in haplotype_consensus(seqs)],
        columns=["locus_id", "haplotype", "kind", "kmers", "spanning_reads", "flanking_reads"],
    )


def consensus(calls: DataFrame) -> DataFrame:
    """A row for each haplotype's consensus, of reads labelled h1, h2 or hom.  Equal reads are counted before they are gathered."""
    ship(calls.sparkSession)
    seen = calls.where(F.col("haplotype").isin("h1", "h2", "hom")).groupBy("locus_id", "haplotype", "alignment_type", "obs_kmers").agg(F.count(F.lit(1)).alias("n"))
    return seen.groupBy("locus_id", "haplotype").applyInPandas(_group, _SCHEMA)


def consensus_calls(found: DataFrame, loci: DataFrame) -> DataFrame:
    """The consensus sequences aligned again between the anchors they have; one without any repeat has counts of 0."""
    text = F.array_join("kmers", "")
    s = found.join(loci.select(F.col("locus_id").cast("string").alias("locus_id"), "left_anchor", "right_anchor"), "locus_id")
    whole = F.concat(F.when(F.col("kind") != "right_flanking", F.col("left_anchor")).otherwise(""), text, F.when(F.col("kind") != "left_flanking", F.col("right_anchor")).otherwise(""))
    side = F.when(F.col("kind") == "left_flanking", "_left").when(F.col("kind") == "right_flanking", "_right").otherwise("")
    reads = s.select(
        "locus_id", F.concat(F.lit("consensus_"), "haplotype", side).alias("query_name"), F.lit("+").alias("strand"), whole.alias("sequence"),
        F.array_repeat(F.lit(60), F.length(whole)).alias("qualities"), F.repeat(F.lit("0"), F.length(whole)).alias("mod_5mc_probs"),
    )
    aligned = align(reads, loci).where(F.col("error_flags").isNull())
    names = found.withColumn("query_name", F.concat(F.lit("consensus_"), "haplotype", side))
    out = aligned.join(names.select("locus_id", "query_name", "haplotype", "kind", "spanning_reads", "flanking_reads"), ["locus_id", "query_name"])
    return out.withColumn("alignment_type", F.col("kind")).drop("kind", "error_flags").withColumn("contracted", C.contract_runs(F.col("obs_kmers")))


def relabel_flanking(calls: DataFrame, found: DataFrame) -> DataFrame:
    """Flanking reads get the haplotype of the consensus nearest to their sequence, ``none`` if there is none to compare."""
    centres = found.select("locus_id", "haplotype", F.col("alignment_type").alias("kind"), F.col("str_sequence").alias("consensus"))
    flank = calls.where("alignment_type <> 'spanning'").select("locus_id", "query_name", "alignment_type", F.col("str_sequence").alias("sequence"))
    new = nearest(flank, centres).select("locus_id", "query_name", F.col("haplotype").alias("new_haplotype"))
    return calls.join(new, ["locus_id", "query_name"], "left").withColumn("haplotype", F.coalesce("new_haplotype", "haplotype")).drop("new_haplotype")
