"""Variant records of repeat genotypes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandem.functions import columns as C

#: Descriptions that the header gives (fixed values of the format).
HEADER = (
    '##FILTER=<ID=PASS,Description="All filters passed">',
    '##INFO=<ID=END,Number=1,Type=Integer,Description="End position of the variant">',
    '##INFO=<ID=RU,Number=1,Type=String,Description="Repeat unit sequence">',
    '##INFO=<ID=LOCUSID,Number=1,Type=String,Description="Variant identifier">',
    '##INFO=<ID=REPID,Number=1,Type=String,Description="Repeat identifier">',
    '##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">',
    '##FORMAT=<ID=LC,Number=1,Type=Integer,Description="Locus coverage">',
    '##FORMAT=<ID=REPCN,Number=A,Type=Float,Description="Number of repeat units spanned by the consensus allele">',
    '##FORMAT=<ID=REPCI,Number=A,Type=String,Description="Confidence interval for REPCN">',
    '##FORMAT=<ID=AD,Number=A,Type=Integer,Description="Allelic depth">',
    '##FORMAT=<ID=ADSP,Number=A,Type=Integer,Description="Number of spanning reads consistent with the allele">',
    '##FORMAT=<ID=ADFL,Number=A,Type=Integer,Description="Number of flanking reads consistent with the allele">',
    '##FORMAT=<ID=CONS,Number=A,Type=String,Description="Consensus sequence">',
    '##FORMAT=<ID=CONTRCONS,Number=A,Type=String,Description="Contracted consensus sequence">',
)


def _number(c: Column) -> Column:
    return F.regexp_replace(F.round(c, 3).cast("string"), "Infinity", "inf")


def alleles(loci: DataFrame, calls: DataFrame) -> DataFrame:
    """(locus_id, idx, allele, haplotype, mean, low, high, spanning, flanking): a row an allele and unit, one or two a locus.

    ``loci`` is the genotype table, ``calls`` the labelled reads.  Depths are those of the allele's own reads, once each.
    """
    names = F.when(F.col("is_significant"), F.array(F.lit("h1"), F.lit("h2"))).otherwise(F.array(F.lit("hom")))
    a = loci.select("locus_id", "h1", "h2", "hom", F.posexplode(names).alias("allele", "haplotype"))
    fit = F.when(F.col("haplotype") == "h1", F.col("h1")).when(F.col("haplotype") == "h2", F.col("h2")).otherwise(F.col("hom"))
    a = a.select("locus_id", "allele", "haplotype", fit.alias("f"))
    a = a.select("locus_id", "allele", "haplotype", F.posexplode(F.arrays_zip("f.mean", "f.mean_lower", "f.mean_upper")).alias("idx", "x"))
    d = calls.groupBy(F.col("locus_id").cast("string").alias("locus_id"), "haplotype").agg(F.count_if(F.col("alignment_type") == "spanning").alias("spanning"), F.count_if(F.col("alignment_type") != "spanning").alias("flanking"))
    # a locus whose reads have haplotypes but that has no parameters is an error, not a gap
    lost = d.where(F.col("haplotype").isin("h1", "h2", "hom")).select("locus_id").distinct().join(loci.select("locus_id"), "locus_id", "left_anti")
    failed = lost.select(F.raise_error(F.concat(F.lit("missing parameters for locus "), "locus_id")).cast("string").alias("locus_id"))
    a = a.unionByName(failed, allowMissingColumns=True)
    out = a.join(d, ["locus_id", "haplotype"], "left")
    return out.select("locus_id", "idx", "allele", "haplotype", F.col("x.mean").alias("mean"), F.col("x.mean_lower").alias("low"), F.col("x.mean_upper").alias("high"), F.coalesce("spanning", F.lit(0)).alias("spanning"), F.coalesce("flanking", F.lit(0)).alias("flanking"))


def unit_consensus(found: DataFrame) -> DataFrame:
    """(locus_id, haplotype, idx, cons, contracted) from consensus calls: of several for a haplotype the longest."""
    size = F.size("obs_kmers")
    best = found.groupBy("locus_id", "haplotype").agg(F.max_by(F.struct("obs_kmers", "kmer_count", "unit_of"), F.struct(size, "query_name")).alias("b"))
    each = best.select("locus_id", "haplotype", F.posexplode("b.kmer_count").alias("idx", "n"), F.col("b.obs_kmers").alias("kmers"), F.col("b.unit_of").alias("unit_of"))
    own = F.transform(F.filter(F.arrays_zip("kmers", "unit_of"), lambda z: z["unit_of"] == F.col("idx")), lambda z: z["kmers"])
    return each.withColumn("own", own).select("locus_id", "haplotype", "idx", F.array_join("own", "").alias("cons"), C.contract_runs(F.col("own")).alias("contracted"))


def records(alleles: DataFrame, units: DataFrame, reference: DataFrame | None, order: DataFrame, consensus: DataFrame | None = None, contracted: bool = False, source: str = "Tandem") -> DataFrame:
    """(chrom, ord, pos, end, value): a line a unit of each locus, in the order of the index, unknown contigs last.

    ``reference`` has whole contigs; without it ``units`` has the bases of each region as ``ref``.  The position is the region's start as it stands in the catalogue.  An empty region shows the base at its start.
    """
    if consensus is not None:
        alleles = alleles.join(consensus, ["locus_id", "haplotype", "idx"], "left")
    else:
        alleles = alleles.withColumn("cons", F.lit("")).withColumn("contracted", F.lit(""))
    row = F.struct("allele", "mean", "low", "high", "spanning", "flanking", F.coalesce("cons", F.lit("")).alias("cons"), F.coalesce("contracted", F.lit("")).alias("contracted"))
    g = alleles.groupBy("locus_id", "idx").agg(F.array_sort(F.collect_list(row)).alias("a"))  # one or two alleles
    g = g.join(units, ["locus_id", "idx"]).join(order, "chrom", "left")
    g = g if reference is None else g.join(reference, "chrom")
    each = lambda f: F.array_join(F.transform("a", lambda x: f(x).cast("string")), ",")
    depth = lambda x: x["spanning"] + x["flanking"]
    ref = F.col("ref") if reference is None else F.substring(F.col("sequence"), (F.col("start") + 1).cast("int"), F.greatest(F.col("end") - F.col("start"), F.lit(1)).cast("int"))
    values = [
        ("GT", F.array_join(F.transform("a", lambda x: (x["allele"] + 1).cast("string")), "/")), ("LC", F.aggregate("a", F.lit(0).cast("long"), lambda s, x: s + depth(x)).cast("string")),
        ("AD", each(depth)), ("ADSP", each(lambda x: x["spanning"])), ("ADFL", each(lambda x: x["flanking"])), ("REPCN", each(lambda x: _number(x["mean"]))),
        ("REPCI", each(lambda x: F.concat(_number(x["low"]), F.lit("-"), _number(x["high"])))),
    ]
    if consensus is not None:
        values.append(("CONS", each(lambda x: x["cons"])))
        if contracted:
            values.append(("CONTRCONS", each(lambda x: x["contracted"])))
    info = F.concat(F.lit("END="), F.col("end").cast("string"), F.lit(";LOCUSID="), "locus_id", F.lit(";RU="), "satellite", F.lit(";REPID="), "satellite_id")
    line = F.concat_ws(
        "\t", "chrom", F.col("start").cast("string"), F.concat(F.lit(source + "."), "locus_id", F.lit("."), (F.col("idx") + 1).cast("string")), ref,
        each(lambda x: F.concat(F.lit("<STR"), F.floor(x["mean"]).cast("string"), F.lit(">"))), F.lit("."), F.lit("PASS"), info,
        F.lit(":".join(n for n, _ in values)), F.concat_ws(":", *[v for _, v in values]),
    )
    return g.select("chrom", "ord", "start", "end", line.alias("value")).orderBy(F.col("ord").asc_nulls_last(), "start", "end", "value")


def header(contigs: list[tuple[str, int]], alts: list[int], sample: str, reference: str, source: str = "Tandem") -> str:
    lines = ["##fileformat=VCFv4.2", f"##source={source}", f"##reference=file://{reference}"]
    lines += [f"##contig=<ID={name},length={length}>" for name, length in contigs]
    lines += HEADER
    lines += [f'##ALT=<ID=STR{n},Description="Short Tandem Repeat with {n} repeat units">' for n in alts]
    return "\n".join([*lines, "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", sample])])


def write(records: DataFrame, alleles: DataFrame, order: DataFrame, path: str, sample: str, reference: str) -> None:
    """Writes header and records in one file: lines come a partition at a time, so the driver holds one partition of them."""
    contigs = [(r.chrom, r.length) for r in order.orderBy("ord").collect()]  # a row a contig
    alts = sorted(r.n for r in alleles.where(~F.isnan("mean")).select(F.floor("mean").alias("n")).distinct().collect())
    with open(path, "w") as f:
        f.write(header(contigs, alts, sample, reference) + "\n")
        for r in records.select("value").toLocalIterator():
            f.write(r.value + "\n")
