"""The frames that a report shows, and the report itself as one HTML file."""

from __future__ import annotations

import html
from collections.abc import Iterable, Iterator
from datetime import datetime
from itertools import groupby

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from tandem.functions import columns as C
from tandem.operators import summary

#: Colours of k-mers, the last for all others (fixed values).
PALETTE = ("#4e79a7", "#f28e2b", "#e15759", "#76b7b2", "#59a14f", "#edc948", "#b07aa1", "#ff9da7", "#9c755f", "#bab0ac", "#86bcb6", "#d37295")
OTHER = "#dddddd"


def reads(calls: DataFrame) -> DataFrame:
    """Calls in plot order with the number of their k-mers."""
    own = calls.withColumn("n_kmers", F.size("obs_kmers")).withColumn("length", F.size("obs_kmers"))
    return summary.read_order(own.withColumn("__k", F.array_join("obs_kmers", "|")), "__k", "query_name").drop("__k", "length")


def kmers(calls: DataFrame) -> DataFrame:
    """A row a k-mer of each call: observed, reference, largest methylation, mean quality."""
    z = F.arrays_zip(F.col("obs_kmers").alias("obs"), F.col("ref_kmers").alias("ref"), F.col("mod_5mc_kmers").alias("mod"), F.col("qual_kmers").alias("qual"))
    k = calls.select("locus_id", "query_name", "haplotype", "alignment_type", F.posexplode(z).alias("idx", "z"))
    k = k.select("locus_id", "query_name", "haplotype", "alignment_type", "idx", F.col("z.obs").alias("kmer"), F.col("z.ref").alias("ref_kmer"), C.mod_percent(F.col("z.mod")).alias("mod_5mc"), C.mean_of_quality_text(F.col("z.qual")).alias("quality"))
    return summary.plot_frame(k)


def top_kmers(k: DataFrame, most: int = 12) -> DataFrame:
    """Reference k-mers by frequency, then observed ones by reads; a report's bounded list."""
    ref = k.where("ref_kmer is not null").groupBy(F.col("ref_kmer").alias("kmer")).agg(F.count(F.lit(1)).alias("n")).withColumn("n_reads", F.lit(1 << 40))
    seen = summary.kmer_frequency(k.where("kmer <> ''")).join(ref.select("kmer"), "kmer", "left_anti")
    return ref.select("kmer", "n", "n_reads").unionByName(seen.select("kmer", "n", "n_reads")).orderBy(F.desc("n_reads"), F.desc("n"), "kmer").limit(most)


def outlier_kmers(k: DataFrame, longest: int = 25, most: int = 12) -> DataFrame:
    """(kmer, n): the commonest k-mers of outlier reads; long ones only if the reference has them."""
    ref = k.select(F.col("ref_kmer").alias("kmer")).where("kmer is not null").distinct().withColumn("__ref", F.lit(True))
    own = k.where("haplotype = 'outlier' and kmer is not null").groupBy("kmer").agg(F.count(F.lit(1)).alias("n")).join(ref, "kmer", "left")
    return own.where((F.length("kmer") < longest) | F.col("__ref")).orderBy(F.desc("n"), "kmer").limit(most).select("kmer", "n")


def group_sizes(ordered: DataFrame) -> DataFrame:
    """(locus_id, haplotype, first, last, size) of reads with ``read_id``; small groups get half a row more at each end."""
    g = ordered.groupBy("locus_id", "haplotype").agg(F.min("read_id").alias("first"), F.max("read_id").alias("last"), F.count(F.lit(1)).alias("size"))
    edge = F.when(F.col("size") < 10, F.lit(0.5)).otherwise(F.lit(0.0))
    return g.select("locus_id", "haplotype", (F.col("first") - edge).alias("first"), (F.col("last") + edge).alias("last"), "size")


def region_link(chrom: Column, start: Column, end: Column) -> Column:
    """The address at which a genome browser on the reader's machine goes to a region."""
    return F.concat(F.lit("http://localhost:60151/goto?locus="), chrom, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"))


def regions(reads: DataFrame, filtered: DataFrame, loci: DataFrame) -> DataFrame:
    """(locus_id, chrom, start, end, structure, link, haplotyped, outliers, filtered): a row a locus that has reads."""
    lost = F.col("haplotype") == "outlier"
    n = reads.groupBy("locus_id").agg(F.count_if(~lost).alias("haplotyped"), F.count_if(lost).alias("outliers"))
    out = n.join(filtered.groupBy("locus_id").agg(F.count(F.lit(1)).alias("filtered")), "locus_id", "left")
    own = loci.select(F.col("locus_id").cast("string").alias("locus_id"), "chrom", "start", "end", "structure")
    out = own.join(out, "locus_id")
    return out.select("locus_id", "chrom", "start", "end", "structure", region_link(F.col("chrom"), F.col("start"), F.col("end")).alias("link"), "haplotyped", "outliers", F.coalesce("filtered", F.lit(0)).alias("filtered"))


def quality_points(reads: DataFrame) -> DataFrame:
    return reads.select("locus_id", "haplotype", "mean_str_quality", "str_error_rate")


def lengths(reads: DataFrame) -> DataFrame:
    """(locus_id, idx, kind, bin, n): histogram of each unit's counts, spanning and flanking reads apart."""
    each = reads.select("locus_id", F.when(F.col("alignment_type") == "spanning", "spanning").otherwise("flanking").alias("haplotype"), F.posexplode("kmer_count").alias("idx", "count"))
    named = each.withColumn("locus_id", F.concat_ws("\t", "locus_id", F.col("idx").cast("string")))  # a unit of a locus is a plot
    bins = summary.length_histogram(named)
    parts = F.split("locus_id", "\t")
    return bins.select(parts[0].alias("locus_id"), parts[1].cast("int").alias("idx"), F.col("haplotype").alias("kind"), "bin", "n")


def densities(parameters: DataFrame, bins: DataFrame, points: int = 120) -> DataFrame:
    """(locus_id, idx, haplotype, x, scaled): the model's density of each unit over the range of its histogram, as high as its highest bin."""
    top = bins.groupBy("locus_id", "idx", "bin").agg(F.sum("n").alias("n")).groupBy("locus_id", "idx").agg(F.max("n").alias("n"), F.max("bin").alias("longest"))
    p = parameters.join(top, ["locus_id", "idx"])
    sd = F.greatest(F.sqrt(F.col("mean") * F.col("unit_var")), F.lit(0.05))
    at = F.transform(F.sequence(F.lit(0), F.lit(points)), lambda i: i * (F.col("longest") * 1.1 + 1) / points)
    p = p.withColumn("x", F.explode(F.array_sort(F.array_union(at, F.array(F.col("mean").cast("double"))))))
    p = p.withColumn("density", summary.normal_density(F.col("x"), F.col("mean"), sd))
    unit = p.withColumn("locus_id", F.concat_ws("\t", "locus_id", F.col("idx").cast("string")))
    parts = F.split("locus_id", "\t")
    return summary.normalised_density(unit.select("locus_id", "haplotype", "x", "density", "n")).select(parts[0].alias("locus_id"), parts[1].cast("int").alias("idx"), "haplotype", "x", "scaled")


def colour_runs(contracted: str, colours: dict[str, str]) -> str:
    """A contracted consensus with each run in its k-mer's colour."""
    out = []
    for part in filter(None, contracted.split("-")):
        kmer = part[part.find("(") + 1 : part.rfind(")")]
        out.append(f'<span style="background:{colours.get(kmer, OTHER)}">{html.escape(part)}</span>')
    return "-".join(out)


def tables(result: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The report's tables, narrow and rounded, from a run's result tables."""
    parameters = summary.significant_parameters(result["par_summary"], result["summary"])
    passed = F.size("outlier_reasons") == 0
    shown = result["reads"]
    return {
        "Counts": parameters.select("locus_id", "satellite", "haplotype", F.round("mean", 2).alias("mean"), F.round("mean_lower", 2).alias("from"), F.round("mean_upper", 2).alias("to"), "wide").orderBy("locus_id", "satellite", "haplotype"),
        "Groups": result["haplotypes"].select("locus_id", "satellite", "haplotype", F.round("mean", 2).alias("mean"), F.round("sd", 2).alias("sd"), "median", "iqr", "n").orderBy("locus_id", "satellite", "haplotype"),
        "Reads that passed": shown.where(passed).groupBy("locus_id", "haplotype", "alignment_type").agg(F.count(F.lit(1)).alias("reads"), F.round(F.avg("mean_str_quality"), 1).alias("quality")).orderBy("locus_id", "haplotype", "alignment_type"),
        "Outliers": shown.where(~passed).select("locus_id", F.explode("outlier_reasons").alias("reason")).groupBy("locus_id", "reason").agg(F.count(F.lit(1)).alias("reads")).orderBy("locus_id", "reason"),
        "Filtered reads": result["filtered_reads"].groupBy("locus_id", "error_flags").agg(F.count(F.lit(1)).alias("reads")).orderBy("locus_id", "error_flags"),
        "Consensus": result["consensus"].select("locus_id", "haplotype", "contracted", "spanning_reads", "flanking_reads").orderBy("locus_id", "haplotype"),
        "Likelihood-ratio test": result["summary"].select("locus_id", F.round("log_lik_hom", 2).alias("hom"), F.round("log_lik_hetero", 2).alias("het"), F.round("statistic", 2).alias("statistic"), "df", F.round("p_value", 5).alias("p"), "is_significant").orderBy("locus_id"),
        "Variances": result["par_summary"].select("locus_id", "satellite", F.when(F.col("haplotype") == "hom", "hom").otherwise("het").alias("model"), F.round("unit_var", 5).alias("unit_var")).distinct().orderBy("locus_id", "satellite", "model"),
    }


HAPLOTYPES = {"h1": "#4e79a7", "h2": "#e15759", "hom": "#59a14f", "none": "#999999", "outlier": "#bbbbbb"}


def _svg(width: float, height: float, parts: Iterable[str]) -> str:
    return f"<svg viewBox='0 0 {width:g} {height:g}' width='{width:g}' height='{height:g}'>{''.join(parts)}</svg>"


def scatter(rows: list[Row], width: int = 420, height: int = 240) -> str:
    """Mean quality against error rate, a point a read."""
    some = [r for r in rows if r.mean_str_quality is not None and r.str_error_rate is not None]
    right, top = max((r.mean_str_quality for r in some), default=1) or 1, max((r.str_error_rate for r in some), default=1) or 1
    at = lambda r: (30 + (width - 40) * r.mean_str_quality / right, height - 20 - (height - 30) * r.str_error_rate / top)
    dots = [f"<circle cx='{x:.1f}' cy='{y:.1f}' r='3' opacity='.5' fill='{HAPLOTYPES.get(r.haplotype, OTHER)}'/>" for r in some for x, y in [at(r)]]
    return _svg(width, height, [f"<text x='30' y='{height - 4}'>mean quality, to {right:.1f}</text><text x='2' y='12'>error rate, to {top:.4f}</text>", *dots])


def histogram(bins: list[Row], curves: list[Row], width: int = 420, height: int = 220) -> str:
    """Reads by count, spanning under flanking, with the model's densities."""
    right, total = max([r.bin for r in bins] + [1]) * 1.1 + 1, {}
    for r in bins:
        total[r.bin] = total.get(r.bin, 0) + r.n
    top, wide = max(total.values(), default=1), max(2.0, width / 110)
    x, y = (lambda v: 10 + (width - 20) * v / right), (lambda v: height - 20 - (height - 30) * v / top)
    parts, under = [], {}
    for r in sorted(bins, key=lambda r: (r.bin, r.kind != "spanning")):
        low = under.get(r.bin, 0)
        under[r.bin] = low + r.n
        parts.append(f"<rect x='{x(r.bin) - wide / 2:.1f}' y='{y(low + r.n):.1f}' width='{wide:.1f}' height='{y(low) - y(low + r.n):.1f}' fill='{'#4d4d4d' if r.kind == 'spanning' else '#b3b3b3'}'/>")
    for name, own in groupby(sorted(curves, key=lambda r: (r.haplotype, r.x)), key=lambda r: r.haplotype):
        dash = " stroke-dasharray='4'" if name == "hom" else ""
        parts.append(f"<polyline fill='none' stroke='{HAPLOTYPES.get(name, OTHER)}'{dash} points='{' '.join(f'{x(r.x):.1f},{y(r.scaled):.1f}' for r in own)}'/>")
    return _svg(width, height, [*parts, f"<text x='10' y='{height - 4}'>0 to {right:.0f} units, {top} reads at most</text>"])


def tracks(rows: list[Row], colours: dict[str, str], cell: int = 6) -> str:
    """A line a read, a cell a k-mer."""
    last = max((r.read_id for r in rows), default=0)
    low, high = min((r.place for r in rows), default=0), max((r.place for r in rows), default=0)
    cells = [f"<rect x='{(r.place - low) * cell}' y='{(r.read_id - 1) * cell}' width='{cell}' height='{cell - 1}' fill='{colours.get(r.kmer, OTHER)}'/>" for r in rows]
    return _svg((high - low + 1) * cell, last * cell, cells)


def _by_locus(frame: DataFrame, *order: str) -> Iterator[tuple[str, list[Row]]]:
    """The rows of one locus after another; the driver holds one partition of the frame."""
    for locus, rows in groupby(frame.orderBy("locus_id", *order).toLocalIterator(), key=lambda r: r.locus_id):
        yield locus, list(rows)


def write(result: dict[str, DataFrame], path: str, sample: str, loci: DataFrame | None = None) -> None:
    """One HTML file: all rows of the tables, then each locus's histograms, scatter and k-mer tracks, a locus at a time."""
    colours: dict[str, str] = {}
    with open(path, "w") as f:
        f.write(
            f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{html.escape(sample)}</title><style>body{{font-family:sans-serif}}table{{border-collapse:collapse}}"
            f"td,th{{border:1px solid #ccc;padding:2px 6px;text-align:left}}text{{font-size:10px}}</style></head><body><h1>Tandem repeats of {html.escape(sample)}</h1><p>{datetime.now():%Y-%m-%d %H:%M}</p>"
        )
        shown = tables(result)
        if loci is not None:
            shown = {"Regions": regions(result["reads"], result["filtered_reads"], loci).orderBy("locus_id"), **shown}
        for title, table in shown.items():
            f.write(f"<h2>{html.escape(title)}</h2><table><tr>{''.join(f'<th>{html.escape(c)}</th>' for c in table.columns)}</tr>")
            for r in table.toLocalIterator():
                cells = []
                for name, value in r.asDict().items():
                    text = "" if value is None else str(value)
                    if name == "contracted":
                        for piece in filter(None, text.split("-")):
                            colours.setdefault(piece[piece.find("(") + 1 : piece.rfind(")")], PALETTE[len(colours)] if len(colours) < len(PALETTE) else OTHER)
                        cells.append(f"<td>{colour_runs(text, colours)}</td>")
                    elif name == "link":
                        cells.append(f"<td><a href='{html.escape(text)}'>Go to locus</a></td>")
                    else:
                        cells.append(f"<td>{html.escape(text)}</td>")
                f.write(f"<tr>{''.join(cells)}</tr>")
            f.write("</table>")
        own = result["reads"]
        bins = lengths(own.where(F.size("outlier_reasons") == 0))
        curves: dict[tuple[str, int], list[Row]] = {}
        for r in densities(summary.significant_parameters(result["par_summary"], result["summary"]), bins).toLocalIterator():  # a curve a unit
            curves.setdefault((r.locus_id, r.idx), []).append(r)
        f.write("<h2>Lengths</h2>")
        for locus, rows in _by_locus(bins, "idx", "bin"):
            for idx, unit in groupby(rows, key=lambda r: r.idx):
                f.write(f"<h3>{html.escape(locus)}, unit {idx + 1}</h3>{histogram(list(unit), curves.get((locus, idx), []))}")
        f.write("<h2>Quality</h2>")
        for locus, rows in _by_locus(quality_points(own)):
            f.write(f"<h3>{html.escape(locus)}</h3>{scatter(rows)}")
        f.write("<h2>K-mers</h2>")
        ordered = reads(own)
        k = kmers(own).join(ordered.select("locus_id", "query_name", "read_id"), ["locus_id", "query_name"])
        for named in (top_kmers(k), outlier_kmers(k)):
            for r in named.collect():  # twelve at most
                colours.setdefault(r.kmer, PALETTE[len(colours)] if len(colours) < len(PALETTE) else OTHER)
        for locus, rows in _by_locus(k.select("locus_id", "read_id", "place", "kmer"), "read_id", "place"):
            f.write(f"<h3>{html.escape(locus)}</h3>{tracks(rows, colours)}")
        sizes = {(r.locus_id, r.haplotype): r["size"] for r in group_sizes(ordered).toLocalIterator()}  # two or three a locus
        f.write(f"<h2>Groups of reads</h2><p>{html.escape('; '.join(f'{a} {b}: {n}' for (a, b), n in sorted(sizes.items())))}</p></body></html>")
