"""Read calls: reads aligned to their loci, with counts, k-mers and quality figures."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandem.config import Config
from tandem.functions import columns as C
from tandem.functions.alignment import Aligned, Locus, align_reads
from tandem.operators.reads import kmer_error_rate
from tandem.shipping import ship

_ALIGNED = """locus_id string, query_name string, strand string, error_flags string, alignment_type string, kmer_count array<int>, str_sequence string,
str_qualities array<int>, operations string, obs_kmers array<string>, ref_kmers array<string>, mod_5mc_kmers array<string>, qual_kmers array<string>"""


def _quality(q: list[int]) -> str:
    return "".join(chr(max(x, 0) + 33) for x in q)


#: Characters of reads whose calls a task keeps: a read that equals one of these isn't aligned again.
KEEP = 1 << 20
#: Loci at most that go to every task; with more, both sides are dealt out.
FEW = 10_000


def _call(locus_id: str, a: Aligned | str) -> tuple:
    """The columns of a call from ``error_flags`` on."""
    if isinstance(a, str):
        return (a, *[None] * 9)
    cut = lambda items: ["".join(items[i:j]) for _, i, j in a.pieces]
    return (
        None, a.alignment_type, a.counts, "".join(a.bases), [q for qs in a.qualities for q in qs], "".join(a.operations),
        cut(a.bases), cut(list(a.reference)), cut(a.mods), ["".join(map(_quality, a.qualities[i:j])) for _, i, j in a.pieces],
    )


def _align(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    known: dict[str, Locus] = {}
    calls: dict[tuple, tuple] = {}
    held = 0
    for batch in batches:
        out = []
        for locus_id, rows in batch.groupby("locus_id", sort=False):
            x = rows.iloc[0]
            locus = known.get(locus_id)
            if locus is None:
                if len(known) > 1000:
                    known.clear()
                locus = known[locus_id] = Locus(locus_id, x.left_anchor, x.right_anchor, list(x.units), [bool(s) for s in x.skippable], list(x.breaks))
            if held > KEEP:
                calls.clear()
                held = 0
            keys = [(locus_id, s, np.asarray(q, np.int32).tobytes(), m or "") for s, q, m in zip(rows.sequence, rows.qualities, rows.mod_5mc_probs, strict=True)]
            fresh = [k for k in dict.fromkeys(keys) if k not in calls]
            reads = [(s, np.frombuffer(q, np.int32).tolist(), m) for _, s, q, m in fresh]
            for k, a in zip(fresh, align_reads(locus, reads), strict=True):
                calls[k] = _call(locus_id, a)
                held += len(k[1])
            out += [(locus_id, name, strand, *calls[k]) for name, strand, k in zip(rows.query_name, rows.strand, keys, strict=True)]
        yield pd.DataFrame(out, columns=[c.split()[0] for c in _ALIGNED.replace("\n", " ").split(", ")])


def align(reads: DataFrame, loci: DataFrame) -> DataFrame:
    """A row a read: its call on its locus, or ``error_flags`` that say why it has none.

    ``reads`` has (locus_id, query_name, strand, sequence, qualities, mod_5mc_probs).  Loci join by their number, and reads, whose size
    the plan underrates, never go to the driver or to every task.  Rows needn't be sorted or dealt by locus, since a task keeps the
    loci it meets; reads that are equal in sequence, qualities and methylation are aligned once a task.
    """
    ship(reads.sparkSession)
    r = reads.select(F.col("locus_id").cast("string").alias("locus_id"), "query_name", "strand", "sequence", "qualities", "mod_5mc_probs")
    s = loci.select(F.col("locus_id").cast("string").alias("locus_id"), "left_anchor", "right_anchor", "units", "skippable", "breaks")
    few = s.limit(FEW + 1).count() <= FEW
    return r.join(F.broadcast(s) if few else s.hint("merge"), "locus_id").mapInPandas(_align, _ALIGNED)


def longest_unit(loci: DataFrame) -> DataFrame:
    return loci.select(F.col("locus_id").cast("string").alias("locus_id"), F.array_max(F.transform("units", lambda u: F.length(u))).alias("longest_unit"))


def read_calls(aligned: DataFrame, loci: DataFrame, c: Config = Config()) -> DataFrame:
    """Calls of aligned reads with mean and low quality, divergence from the reference and the k-mer error rate."""
    good = aligned.where(F.col("error_flags").isNull()).drop("error_flags")
    rates = kmer_error_rate(good.select("locus_id", "query_name", F.col("str_sequence").alias("sequence")), c.error_kmer)
    out = good.join(longest_unit(loci), "locus_id").join(rates, ["locus_id", "query_name"])
    q = F.col("str_qualities")
    return out.select(
        *good.columns, "str_error_rate", C.mean_quality(q).alias("mean_str_quality"), C.q10_quality(q).alias("q10_str_quality"),
        C.ref_divergence(F.col("operations"), F.col("longest_unit")).alias("str_ref_divergence"),
    )


def filtered_reads(aligned: DataFrame) -> DataFrame:
    return aligned.where(F.col("error_flags").isNotNull()).select("locus_id", "query_name", "strand", "error_flags")


def joined(kmers: Column) -> Column:
    """K-mers as the text that files show."""
    return F.array_join(kmers, "|")
