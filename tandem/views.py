"""The driver's tables seen as genotyping data: the same projections in DataFrame functions and in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as read calls: a part is a locus, the return flag the kind of read."""
    name = F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")])
    mean = 40 - 250 * F.col("l_discount")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("locus_id"), name.alias("query_name"),
        F.when(F.col("l_returnflag") == "N", "spanning").when(F.col("l_returnflag") == "A", "left_flanking").otherwise("right_flanking").alias("alignment_type"),
        F.array(F.col("l_quantity").cast("int"), F.col("l_linenumber").cast("int")).alias("kmer_count"),
        mean.alias("mean_str_quality"), F.floor(mean - 5).cast("int").alias("q10_str_quality"),
        (F.col("l_tax") / 6).alias("str_error_rate"), (4 * F.col("l_discount")).alias("str_ref_divergence"),
    )


V_READ_CALLS = """v_read_calls as (
    select l_partkey as locus_id, concat_ws('-', l_orderkey::varchar, l_linenumber::varchar, l_partkey::varchar, l_suppkey::varchar) as query_name,
        case l_returnflag when 'N' then 'spanning' when 'A' then 'left_flanking' else 'right_flanking' end as alignment_type,
        [l_quantity::int, l_linenumber::int] as kmer_count, 40 - 250 * l_discount as mean_str_quality,
        floor(40 - 250 * l_discount - 5)::int as q10_str_quality, l_tax / 6 as str_error_rate, 4 * l_discount as str_ref_divergence
    from lineitem)"""

_LETTERS, _BASES = "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC"


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as sequences: letters as bases, the source as locus."""
    s = F.translate(F.regexp_replace(F.lower("text"), "[^a-z]", ""), _LETTERS, _BASES)
    return table(spark, sf_dir, "documents").select(F.col("source").alias("locus_id"), F.col("doc_id").alias("query_name"), s.alias("sequence"))


V_SEQUENCES = f"""v_sequences as (
    select source as locus_id, doc_id as query_name, translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), '{_LETTERS}', '{_BASES}') as sequence
    from documents)"""


def symbol_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as k-mers: a user is a read, the type of each event in time order a k-mer."""
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))).alias("e"))
    return rows.select(F.col("user_id").alias("query_name"), F.col("e.event_type").alias("kmers"))


V_SYMBOL_RUNS = """v_symbol_runs as (
    select user_id as query_name, list(event_type order by ts, event_id) as kmers from events group by user_id)"""


def loci(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p_partkey").cast("long")
    return table(spark, sf_dir, "part").select(p.alias("locus_id"), (p * 100).alias("start"), (p * 100 + F.col("p_size")).alias("end"))


V_LOCI = """v_loci as (select p_partkey as locus_id, p_partkey * 100 as start, p_partkey * 100 + p_size as "end" from part)"""


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("l_partkey") * 100 + F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("query_name"), "l_linenumber", "l_suppkey", at.alias("start"), (at + F.col("l_quantity").cast("long")).alias("end"))


V_INTERVALS = """v_intervals as (select l_orderkey as query_name, l_linenumber, l_suppkey, l_partkey * 100 + l_linenumber as start,
    l_partkey * 100 + l_linenumber + l_quantity::bigint as "end" from lineitem)"""


def satellites(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return part.select(F.col("p_partkey").alias("locus_id"), F.posexplode(F.array("p_type", "p_brand")).alias("idx", "satellite"))


V_SATELLITES = """v_satellites as (select p_partkey as locus_id, 0 as idx, p_type as satellite from part
    union all select p_partkey, 1, p_brand from part)"""
