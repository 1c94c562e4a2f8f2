"""Text sources and sinks: FASTA, FASTA index, GAF, FASTQ, catalogues, delimited tables."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tandem.config import Config
from tandem.functions import columns as C
from tandem.shipping import ship


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, sequence): a row a contig; the name ends at the first white space."""
    records = spark.read.option("lineSep", ">").text(path).where("value <> ''")
    head = F.substring_index("value", "\n", 1)
    body = F.substring(F.col("value"), F.length(head) + 2, F.length("value"))
    return records.select(F.regexp_extract(head, r"^(\S+)", 1).alias("chrom"), F.regexp_replace(body, r"\s+", "").alias("sequence"))


def read_fai(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, length, ord) of a FASTA index; ``ord`` is the contig's place in the file, an index is one small file."""
    place = F.row_number().over(Window.orderBy("offset")) - 1
    return _index(spark, path).select("chrom", "length", place.alias("ord"))


def _index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("chrom string, length long, offset long, bases int, width int").option("sep", "\t").csv(path)


def has(path: str) -> bool:
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return system.get_file_info(name).type == fs.FileType.File


def fetch(regions: DataFrame, fasta: str, into: str = "sequence") -> DataFrame:
    """``regions`` (chrom, start, end, ...) with the reference between start and end, read by the index beside the FASTA file.

    A task seeks to each of its regions and reads just its lines; what lies outside a contig is cut off.  Regions of contigs that the
    index doesn't have are left out, as in a join with the contigs.
    """
    ship(regions.sparkSession)
    placed = regions.join(_index(regions.sparkSession, fasta + ".fai").withColumnsRenamed({"length": "__length", "offset": "__offset", "bases": "__bases", "width": "__width"}), "chrom")
    names = regions.columns

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        system, name = fs.FileSystem.from_uri(fasta) if "://" in fasta else (fs.LocalFileSystem(), fasta)
        with system.open_input_file(name) as f:
            for batch in batches:
                found = []
                for start, end, length, offset, bases, width in zip(batch["start"], batch["end"], batch["__length"], batch["__offset"], batch["__bases"], batch["__width"], strict=True):
                    a, b = max(int(start), 0), min(int(end), int(length))
                    if a >= b:
                        found.append("")
                        continue
                    first, last = (int(offset + x // bases * width + x % bases) for x in (a, b - 1))
                    f.seek(first)
                    found.append(f.read(last + 1 - first).translate(None, b"\r\n").decode())
                yield batch[names].assign(**{into: found})

    fields = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in regions.select(*names).schema)
    return placed.mapInPandas(task, f"{fields}, `{into}` string")


def anchors_by_index(loci: DataFrame, fasta: str, c: Config = Config()) -> DataFrame:
    """As :func:`with_anchors`, reading only the anchors' bases."""
    ends = loci.select("locus_id", "chrom", F.explode(F.array(
        F.struct(F.lit("left").alias("side"), F.greatest(F.col("start") - c.anchor_length, F.lit(0)).cast("long").alias("start"), F.col("start").cast("long").alias("end")),
        F.struct(F.lit("right").alias("side"), F.col("end").cast("long").alias("start"), (F.col("end") + c.anchor_length).cast("long").alias("end")))).alias("e"))
    bases = fetch(ends.select("locus_id", "chrom", "e.side", "e.start", "e.end"), fasta)
    side = lambda name: F.max(F.when(F.col("side") == name, F.col("sequence"))).alias(f"{name}_anchor")
    return loci.join(bases.groupBy("locus_id").agg(side("left"), side("right")), "locus_id").select(*loci.columns, "left_anchor", "right_anchor")


def read_gaf(spark: SparkSession, path: str) -> DataFrame:
    """The first alignment of each read: name, path as node names, ranges and the cigar tag.  Names match whole."""
    lines = spark.read.text(path).withColumn("place", F.monotonically_increasing_id()).withColumn("f", F.split("value", "\t"))
    lines = lines.where(F.size("f") >= 12).withColumn("query_name", F.col("f")[0])
    first = lines.withColumn("turn", F.row_number().over(Window.partitionBy("query_name").orderBy("place"))).where("turn = 1")
    number = lambda i: F.col("f")[i].cast("int")
    tag = F.element_at(F.filter("f", lambda x: x.startswith("cg:Z:")), 1)
    return first.select(
        "query_name", number(1).alias("query_length"), number(2).alias("query_start"), number(3).alias("query_end"), F.col("f")[4].alias("strand"),
        F.filter(F.split(F.col("f")[5], ">"), lambda x: x != "").alias("path"), number(6).alias("path_length"), number(7).alias("path_start"),
        number(8).alias("path_end"), F.substring(tag, F.lit(6), F.length(tag)).alias("cigar"),
    )


def path_counts(path, n_units: int):
    """How often a path visits each unit; ``satellite_1`` isn't taken for ``satellite_10``."""

    def visits(i: int):
        return F.size(F.filter(path, lambda node: F.rlike(node, F.lit(rf"^satellite_{i}(_|$)"))))

    return F.array(*[visits(i) for i in range(n_units)])


def fastq(reads: DataFrame) -> DataFrame:
    """(value): four lines a read, for ``write.text``."""
    q = C.quality_text(F.col("qualities"))
    return reads.select(F.concat(F.lit("@"), "query_name", F.lit("\n"), "sequence", F.lit("\n+\n"), q).alias("value"))


_CATALOGUE = "LocusId string, LocusStructure string, ReferenceRegion string, VariantId array<string>"


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """Loci of a JSON catalogue: (locus_id, structure, units, skippable, breaks, chrom, start, end, satellites).

    ``ReferenceRegion`` is a text or a list of texts.  A missing field, regions on several chromosomes and numbers of ids or
    regions that don't fit the units are errors; an entry without any unit is left out.
    """
    raw = spark.read.schema(_CATALOGUE).option("multiLine", True).json(path)
    for name in ("LocusId", "LocusStructure", "ReferenceRegion"):
        raw = raw.withColumn(name, F.coalesce(name, F.raise_error(F.concat(F.lit(f"a locus without {name}: "), F.coalesce("LocusId", F.lit("?")))).cast("string")))
    s = F.col("LocusStructure")
    regions = F.when(F.col("ReferenceRegion").startswith("["), F.from_json("ReferenceRegion", "array<string>")).otherwise(F.array("ReferenceRegion"))
    loci = raw.select(
        F.col("LocusId").alias("locus_id"), s.alias("structure"), C.structure_units(s).alias("units"), C.structure_skippable(s).alias("skippable"),
        C.structure_breaks(s).alias("breaks"), regions.alias("regions"), F.col("VariantId").alias("ids"),
    ).where(F.size("units") > 0)
    place = lambda r: F.struct(C.region_chrom(r).alias("chrom"), C.region_start(r).alias("start"), C.region_end(r).alias("end"))
    loci = loci.withColumn("places", F.transform("regions", place))
    n = F.size("units")
    default = F.when(n == 1, F.array("locus_id")).otherwise(F.transform(F.sequence(F.lit(1), n), lambda i: F.concat_ws(".", "locus_id", i.cast("string"))))
    loci = loci.withColumn("ids", F.coalesce("ids", default))
    wrong = (
        F.when(F.exists("places", lambda p: p["chrom"] == ""), "not a region").when(F.size(F.array_distinct(F.transform("places", lambda p: p["chrom"]))) != 1, "regions on several chromosomes")
        .when(F.size("ids") != n, "as many ids as units are needed").when((F.size("places") != n) & (F.size("places") != 1), "one region or one a unit is needed")
    )
    loci = loci.withColumn("locus_id", F.when(wrong.isNotNull(), F.raise_error(F.concat("locus_id", F.lit(": "), wrong)).cast("string")).otherwise(F.col("locus_id")))
    unit = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(
        F.get("ids", i).alias("id"), F.get("units", i).alias("sequence"), F.get("skippable", i).alias("skippable"),
        F.when(F.size("places") == 1, F.get("places", 0)).otherwise(F.get("places", i)).alias("location")))
    return loci.select(
        "locus_id", "structure", "units", "skippable", "breaks", F.get("places", 0)["chrom"].alias("chrom"),
        F.array_min(F.transform("places", lambda p: p["start"])).alias("start"), F.array_max(F.transform("places", lambda p: p["end"])).alias("end"), unit.alias("satellites"),
    )


def with_anchors(loci: DataFrame, fasta: DataFrame, c: Config = Config()) -> DataFrame:
    """Loci with the reference next to them; regions count from 0 and are half open."""
    seq = F.col("sequence")
    left = F.greatest(F.col("start") - c.anchor_length, F.lit(0))
    out = loci.join(fasta, "chrom")
    return out.select(
        *loci.columns, F.substring(seq, (left + 1).cast("int"), (F.col("start") - left).cast("int")).alias("left_anchor"),
        F.substring(seq, (F.col("end") + 1).cast("int"), F.lit(c.anchor_length)).alias("right_anchor"),
    )


def units_of(loci: DataFrame) -> DataFrame:
    """(locus_id, idx, satellite, ...): a row a unit."""
    return loci.select("locus_id", "chrom", F.posexplode("satellites").alias("idx", "s")).select(
        "locus_id", "idx", F.col("s.sequence").alias("satellite"), F.col("s.id").alias("satellite_id"), "chrom", F.col("s.location.start").alias("start"), F.col("s.location.end").alias("end"))


def delimited(table: DataFrame) -> DataFrame:
    """A table with arrays joined as files show them: counts by ``-``, reasons by ``;``, k-mers by a bar."""
    by = {"kmer_count": "-", "outlier_reasons": ";"}
    cells = [F.array_join(F.col(c).cast("array<string>"), by.get(c, "|")).alias(c) if t.startswith("array") else F.col(c) for c, t in table.dtypes]
    return table.select(*cells)


def write_table(table: DataFrame, path: str) -> None:
    """Writes a result table as CSV with a header, one file a partition."""
    delimited(table).write.mode("overwrite").option("header", True).csv(path)
