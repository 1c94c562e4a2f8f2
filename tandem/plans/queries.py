"""The queries that the driver runs, and the DuckDB SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tandem import views as V
from tandem.functions import columns as C
from tandem.operators import calls as calls_
from tandem.operators import consensus as consensus_
from tandem.functions import alignment
from tandem.operators import genotype, qc, reads, report, summary, vcf
from tandem.shipping import ship
from tandem.sources import files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def r6(c):
    return F.round(c, 6)


# --- quality control -------------------------------------------------------------------------------------------------

_HARD = """list_filter([case when mean_str_quality < 20 then 'filtered_low_mean_str_quality' end, case when q10_str_quality < 15 then 'filtered_low_q10_str_quality' end,
    case when str_error_rate > 0.01 then 'filtered_high_str_error_rate' end, case when str_ref_divergence > 0.34 then 'filtered_high_str_ref_divergence' end], lambda x: x is not null)"""
_CHECKED = f"{V.V_READ_CALLS}, checked as (select *, {_HARD} as hard from v_read_calls)"
_LIMITS = """limits as (select locus_id, count(*) as n_good,
    median(mean_str_quality) - 1.5 * (quantile_cont(mean_str_quality, 0.75) - quantile_cont(mean_str_quality, 0.25)) as mean_low,
    median(mean_str_quality) + 1.5 * (quantile_cont(mean_str_quality, 0.75) - quantile_cont(mean_str_quality, 0.25)) as mean_high,
    median(q10_str_quality) - 1.5 * (quantile_cont(q10_str_quality, 0.75) - quantile_cont(q10_str_quality, 0.25)) as q10_low,
    median(q10_str_quality) + 1.5 * (quantile_cont(q10_str_quality, 0.75) - quantile_cont(q10_str_quality, 0.25)) as q10_high,
    median(str_error_rate) - 1.5 * (quantile_cont(str_error_rate, 0.75) - quantile_cont(str_error_rate, 0.25)) as err_low,
    median(str_error_rate) + 1.5 * (quantile_cont(str_error_rate, 0.75) - quantile_cont(str_error_rate, 0.25)) as err_high
    from checked where len(hard) = 0 group by locus_id)"""
_OUTLIERS = f"""{_CHECKED}, {_LIMITS}, out as (select c.*, list_concat(hard, case when len(hard) = 0 and n_good >= 10 then list_filter([
    case when mean_str_quality < mean_low and mean_str_quality < 30 then 'outlier_str_quality' end,
    case when q10_str_quality < q10_low and q10_str_quality < 30 then 'outlier_q10_str_quality' end,
    case when str_error_rate > err_high and str_error_rate > 0.005 then 'outlier_error_rate' end], lambda x: x is not null) else [] end) as reasons
    from checked c left join limits using (locus_id))"""


@query(f"with {_CHECKED} select locus_id, query_name, array_to_string(hard, ';') as outlier_reasons from checked")
def qc_hard_filter(spark, sf_dir):
    return qc.hard_filter(V.read_calls(spark, sf_dir)).select("locus_id", "query_name", F.array_join("outlier_reasons", ";").alias("outlier_reasons"))


@query(f"""with {_CHECKED}, {_LIMITS} select locus_id, n_good, round(mean_low, 6) as mean_low, round(mean_high, 6) as mean_high, round(q10_low, 6) as q10_low,
    round(q10_high, 6) as q10_high, round(err_low, 6) as err_low, round(err_high, 6) as err_high from limits""")
def qc_robust_thresholds(spark, sf_dir):
    t = qc.thresholds(qc.hard_filter(V.read_calls(spark, sf_dir)).where(F.size("outlier_reasons") == 0))
    names = {"mean_str_quality": "mean", "q10_str_quality": "q10", "str_error_rate": "err"}
    return t.select("locus_id", "n_good", *[r6(f"{m}_{s}").alias(f"{n}_{s}") for m, n in names.items() for s in ("low", "high")])


@query(f"with {_OUTLIERS} select locus_id, query_name, array_to_string(reasons, ';') as outlier_reasons, case when len(reasons) > 0 then 'outlier' else 'none' end as haplotype from out")
def qc_outliers(spark, sf_dir):
    return qc.outliers(V.read_calls(spark, sf_dir)).select("locus_id", "query_name", F.array_join("outlier_reasons", ";").alias("outlier_reasons"), "haplotype")


@query(f"""with {_OUTLIERS} select locus_id, count(*) as n_reads, count(*) filter (len(hard) > 0) as n_hard, count(*) filter (len(hard) = 0 and len(reasons) > 0) as n_robust,
    count(*) filter (len(reasons) = 0) as n_passed from out group by locus_id""")
def qc_split_counts(spark, sf_dir):
    o = qc.outliers(V.read_calls(spark, sf_dir))
    hard = F.exists("outlier_reasons", lambda x: x.startswith("filtered"))
    return o.groupBy("locus_id").agg(
        F.count(F.lit(1)).alias("n_reads"), F.count_if(hard).alias("n_hard"),
        F.count_if(~hard & (F.size("outlier_reasons") > 0)).alias("n_robust"), F.count_if(F.size("outlier_reasons") == 0).alias("n_passed"),
    )


@query("""select l_partkey as locus_id, 'chr' || case l_partkey % 4 when 0 then 'X' when 1 then 'Y' else (l_partkey % 4)::varchar end as chrom, count(*) as depth,
    case when count(*) < 30 then 1 when l_partkey % 4 = 0 then 1 when l_partkey % 4 = 1 then 1 else 2 end as ploidy from lineitem group by l_partkey""")
def depth_ploidy(spark, sf_dir):
    from tandem.config import Config

    m = F.col("l_partkey") % 4
    calls = V.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("locus_id"), F.concat(F.lit("chr"), F.when(m == 0, "X").when(m == 1, "Y").otherwise(m.cast("string"))).alias("chrom"))
    return qc.depth_ploidy(calls, "XY", Config(min_haplotyping_depth=30))


@query("""select l_partkey as locus_id, l_linenumber as haplotype, min(l_orderkey) as query_name from lineitem group by 1, 2 having count(*) = 1""")
def singleton_groups(spark, sf_dir):
    return qc.singletons(V.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("locus_id"), F.col("l_linenumber").alias("haplotype"), F.col("l_orderkey").alias("query_name")))


# --- summaries -------------------------------------------------------------------------------------------------------

_LABELLED = f"{V.V_READ_CALLS}, labelled as (select *, case alignment_type when 'spanning' then 'h1' else 'h2' end as haplotype from v_read_calls)"


def labelled(spark, sf_dir):
    return V.read_calls(spark, sf_dir).withColumn("haplotype", F.when(F.col("alignment_type") == "spanning", "h1").otherwise("h2"))


@query(f"""with {_LABELLED}, x as (select locus_id, haplotype, unnest([0, 1]) as idx, unnest(kmer_count) as c from labelled)
    select locus_id, haplotype, idx, round(avg(c), 6) as mean, round(stddev_pop(c), 6) as sd, median(c)::double as median,
    round(quantile_cont(c, 0.75) - quantile_cont(c, 0.25), 6) as iqr, count(*) as n from x group by 1, 2, 3""")
def group_summary(spark, sf_dir):
    g = summary.group_summary(labelled(spark, sf_dir))
    return g.select("locus_id", "haplotype", "idx", r6("mean").alias("mean"), r6("sd").alias("sd"), "median", r6("iqr").alias("iqr"), "n")


@query(f"""with {_LABELLED}, {V.V_SATELLITES}, x as (select locus_id, haplotype, unnest([0, 1]) as idx, unnest(kmer_count) as c from labelled),
    g as (select locus_id, haplotype, idx, count(*) as n, max(c) as longest from x group by 1, 2, 3)
    select locus_id, haplotype, idx, n, longest, satellite from g left join v_satellites using (locus_id, idx)""")
def left_join_satellites(spark, sf_dir):
    long = labelled(spark, sf_dir).select("locus_id", "haplotype", F.posexplode("kmer_count").alias("idx", "c"))
    g = long.groupBy("locus_id", "haplotype", "idx").agg(F.count(F.lit(1)).alias("n"), F.max("c").alias("longest"))
    return summary.with_units(g, V.satellites(spark, sf_dir)).select("locus_id", "haplotype", "idx", "n", "longest", "satellite")


@query("""select l_partkey as locus_id, round(sum(l_quantity * l_extendedprice) / sum(l_extendedprice), 6) as mean,
    round(sum(l_extendedprice * l_quantity * l_quantity) / sum(l_extendedprice) - power(sum(l_quantity * l_extendedprice) / sum(l_extendedprice), 2), 3) as var from lineitem group by 1""")
def weighted_mean(spark, sf_dir):
    rows = V.table(spark, sf_dir, "lineitem").withColumn("locus_id", F.col("l_partkey"))
    return summary.weighted_moments(rows, "l_quantity", "l_extendedprice").select("locus_id", r6(F.col("mean")).alias("mean"), F.round("var", 3).alias("var"))


@query("""with g as (select user_id as locus_id, (event_id % 7)::int as pos, event_type as symbol, min(event_id) as seq, count(*) as votes from events group by 1, 2, 3)
    select locus_id, pos, symbol, votes from (select *, row_number() over (partition by locus_id, pos order by votes desc, seq) as rn from g) where rn = 1""")
def majority_vote(spark, sf_dir):
    e = V.table(spark, sf_dir, "events").select(F.col("user_id").alias("locus_id"), (F.col("event_id") % 7).cast("int").alias("pos"), F.col("event_type").alias("symbol"), F.col("event_id").alias("seq"))
    return summary.majority(e)


@query("""with c as (select l_partkey as locus_id, l_returnflag as haplotype, (l_quantity * 7)::bigint as count from lineitem),
    m as (select locus_id, greatest(max(count), 1) as longest from c group by 1),
    b as (select c.*, ceil(longest / least(100, longest)::double)::bigint as width from c join m using (locus_id))
    select locus_id, haplotype, count // width * width as bin, count(*) as n from b group by 1, 2, 3""")
def length_histogram(spark, sf_dir):
    c = V.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("locus_id"), F.col("l_returnflag").alias("haplotype"), (F.col("l_quantity") * 7).cast("long").alias("count"))
    return summary.length_histogram(c)


@query("""with g as (select l_partkey as locus_id, l_returnflag as haplotype, avg(l_quantity) as mean, stddev_pop(l_quantity) + 0.5 as sd, count(*) as n from lineitem group by 1, 2),
    x as (select *, unnest(range(0, 51, 10))::int as x from g), d as (select *, exp(-0.5 * power((x - mean) / sd, 2)) / (sd * sqrt(2 * pi())) as density from x)
    select locus_id, haplotype, x, round(density, 6) as density, round(density / max(density) over (partition by locus_id, haplotype) * n, 6) as scaled from d""")
def density_normalised(spark, sf_dir):
    g = V.table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("locus_id"), F.col("l_returnflag").alias("haplotype")).agg(
        F.avg("l_quantity").alias("mean"), (F.stddev_pop("l_quantity") + 0.5).alias("sd"), F.count(F.lit(1)).alias("n"))
    x = g.withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(50), F.lit(10))))
    d = x.withColumn("density", summary.normal_density(F.col("x"), F.col("mean"), F.col("sd")))
    return summary.normalised_density(d).select("locus_id", "haplotype", "x", r6("density").alias("density"), r6("scaled").alias("scaled"))


@query("""with p as (select l_partkey as locus_id, case l_returnflag when 'A' then 'h1' when 'N' then 'hom' else 'h2' end as haplotype, avg(l_quantity) as mean,
    min(l_quantity) / 10 as mean_lower, case when max(l_tax) < 0.08 then null else max(l_quantity) / 10 end as mean_upper from lineitem group by 1, l_returnflag),
    t as (select p_partkey as locus_id, p_size % 2 = 0 as is_significant from part)
    select locus_id, haplotype, round(mean, 6) as mean, is_significant, coalesce(mean_upper - mean_lower > 2, false) as wide from p join t using (locus_id)
    where (is_significant and haplotype <> 'hom') or (not is_significant and haplotype = 'hom')""")
def wide_ci_flag(spark, sf_dir):
    flag = F.col("l_returnflag")
    p = V.table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("locus_id"), F.when(flag == "A", "h1").when(flag == "N", "hom").otherwise("h2").alias("haplotype")).agg(
        F.avg("l_quantity").alias("mean"), (F.min("l_quantity") / 10).alias("mean_lower"), F.when(F.max("l_tax") < 0.08, None).otherwise(F.max("l_quantity") / 10).alias("mean_upper"))
    t = V.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("locus_id"), (F.col("p_size") % 2 == 0).alias("is_significant"))
    return summary.significant_parameters(p, t).select("locus_id", "haplotype", r6("mean").alias("mean"), "is_significant", "wide")


@query("""with s as (select l_partkey as locus_id, l_linenumber as part, count(*) as n from lineitem group by 1, 2),
    r as (select *, sum(n) over (partition by locus_id order by part)::bigint as stop, row_number() over (partition by locus_id order by part) as rn from s)
    select locus_id, part, n, stop - n as start, stop from r where rn % 2 = 1""")
def running_stripe(spark, sf_dir):
    s = V.table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("locus_id"), F.col("l_linenumber").alias("part")).agg(F.count(F.lit(1)).alias("n"))
    return summary.stripes(s, "part").select("locus_id", "part", "n", "start", "stop")


@query(f"""with {_LABELLED} select locus_id, query_name, row_number() over (partition by locus_id order by haplotype,
    case alignment_type when 'left_flanking' then 1 when 'spanning' then 2 else 3 end, case alignment_type when 'right_flanking' then -kmer_count[1] else kmer_count[1] end, query_name)::int as read_id from labelled""")
def read_order_id(spark, sf_dir):
    return summary.read_order(labelled(spark, sf_dir).withColumn("length", F.col("kmer_count")[0]), "query_name").select("locus_id", "query_name", "read_id")


# --- k-mers ----------------------------------------------------------------------------------------------------------


@query(f"""with {V.V_SEQUENCES}, k as (select locus_id, query_name, unnest([sequence[i:i + 10] for i in range(1, len(sequence) - 9)]) as kmer from v_sequences),
    r as (select locus_id, kmer, query_name, count(*) as times from k group by 1, 2, 3),
    u as (select locus_id, kmer, min(query_name) as query_name, sum(times) as times from r group by 1, 2 having count(*) = 1),
    w as (select locus_id, query_name, sum(times) as wrong from u group by 1, 2), o as (select locus_id, count(*) as reads from v_sequences group by 1)
    select locus_id, query_name, round(case when len(sequence) = 0 or reads < 2 then 0 else coalesce(wrong, 0) / 11 / len(sequence) end, 6) as str_error_rate
    from v_sequences join o using (locus_id) left join w using (locus_id, query_name)""")
def kmer_error_rate(spark, sf_dir):
    return reads.kmer_error_rate(V.sequences(spark, sf_dir)).withColumn("str_error_rate", r6("str_error_rate"))


_PIECES = f"""{V.V_SEQUENCES}, pieces as (select query_name, unnest([sequence[i:i + 2] for i in range(1, len(sequence) - 1, 3)]) as kmer from v_sequences),
    freq as (select kmer, count(*) as n, count(distinct query_name) as n_reads from pieces group by 1)"""


def pieces(spark, sf_dir):
    s = V.sequences(spark, sf_dir)
    return s.select("query_name", F.explode(C.pieces(F.col("sequence"), 3)).alias("kmer"))


@query(f"with {_PIECES} select kmer, n, n_reads from freq")
def kmer_frequency(spark, sf_dir):
    return summary.kmer_frequency(pieces(spark, sf_dir))


@query(f"with {_PIECES} select kmer, n, n_reads from freq order by n_reads desc, n desc, kmer limit 12")
def kmer_counts_top12(spark, sf_dir):
    return summary.top_kmers(summary.kmer_frequency(pieces(spark, sf_dir)))


@query(f"""with {_PIECES}, top as (select kmer from freq order by n_reads desc, n desc, kmer limit 12)
    select query_name, coalesce(t.kmer, 'Other') as label, count(*) as n from pieces p left join top t on p.kmer = t.kmer group by 1, 2""")
def kmer_other_bucket(spark, sf_dir):
    p = pieces(spark, sf_dir)
    return summary.bucket_others(p, summary.top_kmers(summary.kmer_frequency(p))).groupBy("query_name", "label").agg(F.count(F.lit(1)).alias("n"))


@query(f"""with {V.V_SYMBOL_RUNS}, z as (select query_name, len(kmers) as n, unnest(range(len(kmers)))::int as idx, unnest(kmers) as kmer, unnest(list_reverse(kmers)) as ref_kmer from v_symbol_runs)
    select query_name, idx, kmer, ref_kmer, (ascii(upper(kmer)) - 33)::double as quality, (least(ascii(kmer), 43) - 33)::int * 10 as mod_5mc, (idx + 0)::int as place from z""")
def kmers_zip_explode(spark, sf_dir):
    """K-mers of reads as a report takes them; qualities and methylation are written as characters."""
    first = lambda x: F.substring(x, 1, 1)
    calls = V.symbol_runs(spark, sf_dir).select(
        F.lit("all").alias("locus_id"), "query_name", F.lit("h1").alias("haplotype"), F.lit("spanning").alias("alignment_type"), F.col("kmers").alias("obs_kmers"), F.reverse("kmers").alias("ref_kmers"),
        F.transform("kmers", lambda x: F.chr(F.least(F.ascii(x), F.lit(43)))).alias("mod_5mc_kmers"), F.transform("kmers", lambda x: first(F.upper(x))).alias("qual_kmers"))
    return report.kmers(calls).select("query_name", "idx", "kmer", "ref_kmer", "quality", F.col("mod_5mc").cast("int").alias("mod_5mc"), "place")


@query(f"""with {V.V_SYMBOL_RUNS}, e as (select query_name, unnest(range(len(kmers))) as i, unnest(kmers) as k from v_symbol_runs),
    s as (select *, case when k is distinct from lag(k) over (partition by query_name order by i) then 1 else 0 end as new from e),
    g as (select *, sum(new) over (partition by query_name order by i) as run from s), c as (select query_name, run, any_value(k) as k, count(*) as n from g group by 1, 2)
    select query_name, string_agg(n::varchar || '(' || k || ')', '-' order by run) as contracted from c group by 1""")
def run_length_contract(spark, sf_dir):
    return V.symbol_runs(spark, sf_dir).select("query_name", C.contract_runs(F.col("kmers")).alias("contracted"))


_SETS = """a as (select distinct event_type || (user_id % 500) as kmer from events where value < 5), b as (select distinct event_type || (user_id % 500) as kmer from events where value > 20)"""


def _sets(spark, sf_dir):
    e, k = V.table(spark, sf_dir, "events"), F.concat("event_type", (F.col("user_id") % 500).cast("string")).alias("kmer")
    return e.where("value < 5").select(k), e.where("value > 20").select(k)


@query(f"with {_SETS} select kmer from a intersect select kmer from b")
def set_intersect(spark, sf_dir):
    a, b = _sets(spark, sf_dir)
    return a.intersect(b)


@query(f"with {_SETS} select kmer from a except select kmer from b")
def set_except(spark, sf_dir):
    a, b = _sets(spark, sf_dir)
    return a.distinct().join(b.distinct(), "kmer", "left_anti")


# --- reads -----------------------------------------------------------------------------------------------------------


@query(f"""with {V.V_LOCI}, {V.V_INTERVALS} select locus_id, query_name, l_linenumber, l_suppkey, r.start as read_start, r."end" as read_end
    from v_intervals r join v_loci s on r.start < s."end" and s.start < r."end" """)
def interval_join(spark, sf_dir):
    return reads.overlaps(V.intervals(spark, sf_dir), V.loci(spark, sf_dir)).select("locus_id", "query_name", "l_linenumber", "l_suppkey", "read_start", "read_end")


@query("""select l_orderkey as query_name, l_partkey, l_suppkey, l_linenumber from lineitem l where l_returnflag = 'R' and not exists (
    select 1 from lineitem p where p.l_returnflag <> 'R' and p.l_orderkey = l.l_orderkey)""")
def anti_join(spark, sf_dir):
    """Returned items as supplementary alignments: those of orders without any other."""
    a = V.table(spark, sf_dir, "lineitem").select(
        F.lit("all").alias("locus_id"), F.col("l_orderkey").alias("query_name"), F.when(F.col("l_returnflag") == "R", reads.SUPPLEMENTARY).otherwise(0).alias("flag"), "l_partkey", "l_suppkey", "l_linenumber")
    return reads.split_alignments(a)[1].select("query_name", "l_partkey", "l_suppkey", "l_linenumber")


@query("select l_partkey as locus_id, count(*) as n from lineitem where l_partkey in (select p_partkey from part where p_size < 10) group by 1")
def semi_join(spark, sf_dir):
    chosen = V.table(spark, sf_dir, "part").where("p_size < 10").select(F.col("p_partkey").alias("locus_id"))
    rows = V.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("locus_id"))
    return summary.at_loci(rows, chosen).groupBy("locus_id").agg(F.count(F.lit(1)).alias("n"))


@query("select 'good' as kind, l_orderkey as query_name, l_partkey as locus_id from lineitem where l_returnflag = 'N' union all select 'removed', l_orderkey, l_partkey from lineitem where l_returnflag = 'R'")
def union_reads(spark, sf_dir):
    a = V.table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_orderkey").alias("query_name"), F.col("l_partkey").alias("locus_id"))
    part = lambda flag: a.where(F.col("l_returnflag") == flag).drop("l_returnflag")
    return summary.both_kinds(part("N"), part("R"))


@query("""with n as (select user_id as locus_id, event_type as name, event_id, row_number() over (partition by user_id, event_type order by event_id) - 1 as turn from events)
    select locus_id, event_id, case when turn = 0 then name else name || '_' || turn end as query_name from n""")
def unique_names(spark, sf_dir):
    e = V.table(spark, sf_dir, "events").select(F.col("user_id").alias("locus_id"), F.col("event_type").alias("query_name"), "event_id")
    return reads.unique_names(e, "event_id").select("locus_id", "event_id", "query_name")


_QUAL = """q as (select user_id as query_name, list(floor(value * 3)::int % 45 order by ts, event_id) as quals from events group by 1)"""


def _qualities(spark, sf_dir):
    e = V.table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", (F.floor(F.col("value") * 3).cast("int") % 45).alias("q")))).alias("e"))
    return e.select(F.col("user_id").alias("query_name"), F.col("e.q").alias("quals"))


@query(f"with {_QUAL} select query_name, round(list_avg(quals), 6) as mean_str_quality, trunc(round(list_aggregate(quals, 'quantile_cont', 0.1), 9))::int as q10_str_quality from q")
def q10_quality(spark, sf_dir):
    return _qualities(spark, sf_dir).select("query_name", r6(C.mean_quality(F.col("quals"))).alias("mean_str_quality"), C.q10_quality(F.col("quals")).alias("q10_str_quality"))


@query(f"""with {_QUAL}, w as (select *, len(quals) as n from q),
    t as (select *, coalesce([i for i in range(0, 50) if len(quals[i + 1:i + 3]) > 0 and list_min(quals[i + 1:i + 3]) >= 17][1], 0) as a,
        coalesce([j for j in range(0, 50) if n - j - 1 > 0 and list_min(quals[greatest(n - j - 1 - 3, 0) + 1:n - j - 1]) >= 17][1], 0) as b from w)
    select query_name, (case when a + b >= n then 0 else a end)::int as trim_start, (case when a + b >= n then 0 else b end)::int as trim_end from t""")
def low_quality_trim(spark, sf_dir):
    a, b = C.low_quality_trim(F.col("quals"), window=3)
    return _qualities(spark, sf_dir).select("query_name", a.alias("trim_start"), b.alias("trim_end"))


@query(f"""with {V.V_SEQUENCES}, c as (select *, least(query_name % 80, 50) as l, least(query_name % 13, 50) as r from v_sequences)
    select query_name, case when len(sequence) - l - r <= 0 then '' else sequence[l + 1:len(sequence) - r] end as sequence, (query_name % 80 - l)::int as n_left, (query_name % 13 - r)::int as n_right from c""")
def soft_clip_trim(spark, sf_dir):
    s = V.sequences(spark, sf_dir)
    a, b = (F.col("query_name") % 80).cast("int"), (F.col("query_name") % 13).cast("int")
    left, right = F.least(a, F.lit(50)), F.least(b, F.lit(50))
    return s.select("query_name", C.trim_text(F.col("sequence"), left, right).alias("sequence"), (a - left).alias("n_left"), (b - right).alias("n_right"))


@query("""with m as (select event_id, case event_id % 5 when 0 then '' else chr((33 + event_id % 11)::int) || chr((33 + user_id % 11)::int) || '0' end as m from events)
    select event_id, case when m = '' then 0 else list_max([v for v in [(unicode(c) - 33) * 10 for c in string_split(m, '')] if v between 0 and 100]) end::int as mod_percent from m""")
def mod_decode(spark, sf_dir):
    e = V.table(spark, sf_dir, "events")
    m = F.when(F.col("event_id") % 5 == 0, "").otherwise(F.concat(F.chr(33 + F.col("event_id") % 11), F.chr(33 + F.col("user_id") % 11), F.lit("0")))
    return e.select("event_id", m.alias("m")).select("event_id", C.mod_percent(F.col("m")).alias("mod_percent"))


@query("""select doc_id, round(case when len(t) = 0 then 0 else list_avg([unicode(c) - 33 for c in string_split(t, '')]) end, 6) as mean_quality
    from (select doc_id, regexp_replace(text, '[^!-~]', '', 'g') as t from documents)""")
def qual_decode(spark, sf_dir):
    d = V.table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", "[^!-~]", "").alias("t"))
    return d.select("doc_id", r6(C.mean_of_quality_text(F.col("t"))).alias("mean_quality"))


# --- structures and sequences ----------------------------------------------------------------------------------------

_STRUCTURES = """s as (select p_partkey, case p_partkey % 5 when 0 then '(CAG)*' when 1 then '(CAG)*CAACAG(CCG)*' when 2 then 'GT(AARRG)+' when 3 then '(GCN)*(GAA)+TT' else '(C)*A(NGC)+(CTG)*GG' end as structure from part)"""


def _structures(spark, sf_dir):
    m = F.col("p_partkey") % 5
    s = F.when(m == 0, "(CAG)*").when(m == 1, "(CAG)*CAACAG(CCG)*").when(m == 2, "GT(AARRG)+").when(m == 3, "(GCN)*(GAA)+TT").otherwise("(C)*A(NGC)+(CTG)*GG")
    return V.table(spark, sf_dir, "part").select("p_partkey", "p_size", s.alias("structure"))


@query(rf"""with {_STRUCTURES} select p_partkey, array_to_string(regexp_extract_all(structure, '\(([A-Z]+)\)[*+]', 1), ',') as units,
    array_to_string([(x = '*')::varchar for x in regexp_extract_all(structure, '\([A-Z]+\)([*+])', 1)], ',') as skippable,
    array_to_string(string_split(regexp_replace(structure, '\([A-Z]+\)[*+]', '|', 'g'), '|'), ',') as breaks from s""")
def structure_parse(spark, sf_dir):
    s = F.col("structure")
    return _structures(spark, sf_dir).select(
        "p_partkey", F.array_join(C.structure_units(s), ",").alias("units"), F.array_join(C.structure_skippable(s).cast("array<string>"), ",").alias("skippable"),
        F.array_join(C.structure_breaks(s), ",").alias("breaks"))


@query(r"""with r as (select p_partkey, 'chr' || (p_partkey % 22 + 1) || ':' || (p_partkey * 100) || '-' || (p_partkey * 100 + p_size) as region from part)
    select p_partkey, regexp_extract(region, '^(.+):(\d+)-(\d+)$', 1) as chrom, regexp_extract(region, '^(.+):(\d+)-(\d+)$', 2)::bigint as start, regexp_extract(region, '^(.+):(\d+)-(\d+)$', 3)::bigint as "end" from r""")
def region_parse(spark, sf_dir):
    p = F.col("p_partkey")
    region = F.concat(F.lit("chr"), (p % 22 + 1).cast("string"), F.lit(":"), (p * 100).cast("string"), F.lit("-"), (p * 100 + F.col("p_size")).cast("string"))
    r = V.table(spark, sf_dir, "part").select("p_partkey", region.alias("region"))
    return r.select("p_partkey", C.region_chrom(F.col("region")).alias("chrom"), C.region_start(F.col("region")).alias("start"), C.region_end(F.col("region")).alias("end"))


_UNITS = "u as (select unnest(['CAG', 'AARRG', 'GCN', 'NGC', 'TRRAA']) as unit, unnest(['CAG', 'AA[AG][AG]G', 'GC[ACGT]', '[ACGT]GC', 'T[AG][AG]AA']) as pattern)"


@query(f"with {V.V_SEQUENCES}, {_UNITS} select query_name, unit, regexp_matches(sequence, pattern) as found from v_sequences, u")
def iupac_match(spark, sf_dir):
    u = F.explode(F.array(*[F.lit(x) for x in ("CAG", "AARRG", "GCN", "NGC", "TRRAA")]))
    s = V.sequences(spark, sf_dir).select("query_name", "sequence", u.alias("unit"))
    return s.select("query_name", "unit", F.rlike("sequence", C.iupac_pattern(F.col("unit"))).alias("found"))


@query("""select p_partkey, (len(regexp_extract(repeat('CAG', p_size) || 'CAA' || repeat('CAG', 2), '^((?:CAG)*)', 1)) // 3)::int as n_exact,
    (len(regexp_extract(repeat('CAG', p_size) || 'CAA' || repeat('CAG', 2), '^((?:CA[AG])*)', 1)) // 3)::int as n_ambiguous from part""")
def repeat_count_regex(spark, sf_dir):
    s = F.concat(F.expr("repeat('CAG', p_size)"), F.lit("CAA"), F.lit("CAGCAG"))
    return V.table(spark, sf_dir, "part").select("p_partkey", C.repeat_count(s, F.lit("CAG")).alias("n_exact"), C.repeat_count(s, F.lit("CAR")).alias("n_ambiguous"))


@query(r"""with o as (select p_partkey, repeat('I', p_size % 7) || repeat('=', p_size) || repeat('X', p_size % 3) || 'DD' || repeat('M', p_partkey % 9) || repeat('D', p_partkey % 5) as ops from part),
    t as (select p_partkey, regexp_replace(ops, '^[ID]{1,3}|[ID]{1,3}$', '', 'g') as ops from o)
    select p_partkey, round(case when len(ops) = 0 then 0 else len(regexp_replace(ops, '[M=]', '', 'g')) / len(ops) end, 6) as divergence from t""")
def ref_divergence(spark, sf_dir):
    ops = F.expr("concat(repeat('I', p_size % 7), repeat('=', p_size), repeat('X', p_size % 3), 'DD', repeat('M', cast(p_partkey % 9 as int)), repeat('D', cast(p_partkey % 5 as int)))")
    return V.table(spark, sf_dir, "part").select("p_partkey", ops.alias("ops")).select("p_partkey", r6(C.ref_divergence(F.col("ops"), F.lit(3))).alias("divergence"))


_PAIRS = f"""{V.V_SEQUENCES}, p as (select a.query_name as a, b.query_name as b, a.sequence as sa, b.sequence as sb,
    ['left_flanking', 'spanning', 'right_flanking'][a.query_name % 3 + 1] as ka, ['left_flanking', 'spanning', 'right_flanking'][a.query_name // 3 % 3 + 1] as kb
    from v_sequences a join v_sequences b on b.query_name = a.query_name + 1),
    n as (select *, least(len(sa), len(sb)) as n, case when ka <> 'spanning' then ka[1:1] when kb <> 'spanning' then kb[1:1] else '-' end as da,
    case when kb <> 'spanning' then kb[1:1] when ka <> 'spanning' then ka[1:1] else '-' end as db from p),
    t as (select *, case da when 'l' then left(sa, n) when 'r' then right(sa, n) else sa end as ta, case db when 'l' then left(sb, n) when 'r' then right(sb, n) else sb end as tb from n)"""


@query(f"with {_PAIRS} select a, b, len(ta)::int as len_a, len(tb)::int as len_b, levenshtein(ta, tb)::int as distance from t")
def flank_trim_distance(spark, sf_dir):
    return _flank_trim(V.sequences(spark, sf_dir), F.col("sequence"), F.col("sequence"))


def _flank_trim(s, first, second):
    kinds = F.array(*[F.lit(x) for x in ("left_flanking", "spanning", "right_flanking")])
    a = s.select(F.col("query_name").alias("a"), first.alias("sa"))
    b = s.select((F.col("query_name") - 1).alias("a"), F.col("query_name").alias("b"), second.alias("sb"))
    n = int(s.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # explicit, so that tasks aren't merged by their bytes
    p = a.repartition(n, "a").join(b.repartition(n, "a"), "a").withColumn("ka", F.get(kinds, (F.col("a") % 3).cast("int"))).withColumn("kb", F.get(kinds, (F.floor(F.col("a") / 3) % 3).cast("int")))
    ta, tb = C.compare_pair(F.col("sa"), F.col("ka"), F.col("sb"), F.col("kb"))
    cut = p.select("a", "b", ta.alias("first"), tb.alias("second")).withColumns({"len_a": F.length("first"), "len_b": F.length("second")})
    return summary.distances(cut, "a").select("a", "b", "len_a", "len_b", "distance")


@query(f"""with {V.V_SEQUENCES}, c as (select locus_id, 'h' || row_number() over (partition by locus_id order by query_name) as haplotype, sequence as consensus, 'spanning' as kind
        from v_sequences qualify row_number() over (partition by locus_id order by query_name) <= 2),
    d as (select r.locus_id, query_name, haplotype, levenshtein(left(sequence, least(len(sequence), len(consensus))), left(consensus, least(len(sequence), len(consensus)))) as distance from v_sequences r join c using (locus_id))
    select locus_id, query_name, haplotype, distance::int as distance from (select *, row_number() over (partition by locus_id, query_name order by distance, haplotype) as rn from d) where rn = 1""")
def nearest_consensus(spark, sf_dir):
    s = V.sequences(spark, sf_dir)
    return _nearest_of_two(s, s, F.col("sequence"), F.col("sequence"))


def _nearest_of_two(s, reads_, sequence, consensus):
    turn = F.row_number().over(Window.partitionBy("locus_id").orderBy("query_name"))
    centres = s.withColumn("turn", turn).where("turn <= 2").select("locus_id", F.concat(F.lit("h"), F.col("turn").cast("string")).alias("haplotype"), consensus.alias("consensus"), F.lit("spanning").alias("kind"))
    flank = reads_.select("locus_id", "query_name", F.lit("left_flanking").alias("alignment_type"), sequence.alias("sequence"))
    return summary.nearest(flank, centres)


# --- VCF -------------------------------------------------------------------------------------------------------------


@query("""with o as (select 'chr' || i as chrom, i as ord from range(0, 10) t(i)), r as (select p_partkey, 'chr' || (p_partkey % 13) as chrom, p_partkey * 100 as start, p_partkey * 100 + p_size as "end" from part)
    select p_partkey, r.chrom, row_number() over (order by coalesce(ord, 1000000), start, "end", p_partkey) as place from r left join o using (chrom)""")
def vcf_sort(spark, sf_dir):
    p = F.col("p_partkey")
    r = V.table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("chr"), (p % 13).cast("string")).alias("chrom"), (p * 100).alias("start"), (p * 100 + F.col("p_size")).alias("end"))
    order = spark.range(10).select(F.concat(F.lit("chr"), F.col("id").cast("string")).alias("chrom"), F.col("id").alias("ord"))
    ranked = r.join(order, "chrom", "left").withColumn("ord", F.coalesce("ord", F.lit(1000000)))
    return ranked.withColumn("place", F.row_number().over(Window.orderBy("ord", "start", "end", "p_partkey")).cast("long")).select("p_partkey", "chrom", "place")


# --- kernels; SQL has no counterpart ---------------------------------------------------------------------------------


def _loci(spark, sf_dir):
    """Line items as counts of suppliers: the line number is the count, the return flag the kind of read."""
    kind = F.when(F.col("l_returnflag") == "N", "spanning").when(F.col("l_returnflag") == "A", "left_flanking").otherwise("right_flanking")
    count = F.when(F.col("l_suppkey") % 3 == 0, F.when(F.col("l_linenumber") > 3, 30).otherwise(12)).otherwise(F.col("l_linenumber") + 10)
    calls = V.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("string").alias("locus_id"), kind.alias("alignment_type"), F.array(count.cast("int")).alias("kmer_count"))
    return genotype.genotype_loci(calls)


@query()
def haplotyping(spark, sf_dir):
    return _loci(spark, sf_dir).select("locus_id", F.inline("labels")).select("locus_id", "alignment_type", F.array_join(F.col("kmer_count").cast("array<string>"), "-").alias("kmer_count"), "haplotype")


@query()
def lrt(spark, sf_dir):
    return genotype.test_summary(_loci(spark, sf_dir))


@query()
def confidence_intervals(spark, sf_dir):
    return genotype.parameter_summary(_loci(spark, sf_dir))


_ANCHORS = ("ACGTTGCAAGCTTAGGCATCCGATAGCTGTACCTGAAGTCCGATTACGCATGGACTTAGC", "TTGACCATGCGTAAGCCTATGGCATCAGTTCGAACTGCCATAGTCAGGTTACCAGATCGT")


def _simulated(spark, sf_dir):
    """Parts as reads of two loci: anchors around as many units as the size says, an edit in some."""
    n = F.col("p_size")
    body = F.when(F.col("p_partkey") % 2 == 0, F.expr("repeat('CAG', p_size)")).otherwise(F.concat(F.expr("repeat('GAA', p_size)"), F.lit("TTC"), F.expr("repeat('CCG', p_size % 5)")))
    text = F.concat(F.lit(_ANCHORS[0]), body, F.when(F.col("p_partkey") % 7 == 0, "").otherwise(F.lit(_ANCHORS[1])))
    reads_ = V.table(spark, sf_dir, "part").where(n > 0).select(
        F.when(F.col("p_partkey") % 2 == 0, "one").otherwise("two").alias("locus_id"), F.col("p_partkey").cast("string").alias("query_name"), F.lit("+").alias("strand"), text.alias("sequence"),
        F.array_repeat(F.lit(30), F.length(text)).alias("qualities"), F.repeat(F.lit("0"), F.length(text)).alias("mod_5mc_probs"))
    loci = spark.createDataFrame(
        [("one", *_ANCHORS, ["CAG"], [True], ["", ""]), ("two", *_ANCHORS, ["GAA", "CCG"], [True, True], ["", "TTC", ""])],
        "locus_id string, left_anchor string, right_anchor string, units array<string>, skippable array<boolean>, breaks array<string>")
    return calls_.align(reads_, loci)


@query("""select case when p_partkey % 2 = 0 then 'one' else 'two' end as locus_id, p_partkey::varchar as query_name, null::varchar as error_flags, case when p_partkey % 7 = 0 then 'left_flanking' else 'spanning' end as alignment_type,
    case when p_partkey % 2 = 0 then p_size::varchar else p_size || '-' || (p_size % 5) end as kmer_count,
    case when p_partkey % 2 = 0 then p_size || '(CAG)' else p_size || '(GAA)-1(TTC)' || case when p_size % 5 > 0 then '-' || (p_size % 5) || '(CCG)' else '' end end as contracted from part where p_size > 0""")
def graph_align(spark, sf_dir):
    """The reads are made with as many units as the size says, and the aligner has to find them."""
    a = _simulated(spark, sf_dir)
    return a.select("locus_id", "query_name", "error_flags", "alignment_type", F.array_join(F.col("kmer_count").cast("array<string>"), "-").alias("kmer_count"), C.contract_runs(F.coalesce("obs_kmers", F.array().cast("array<string>"))).alias("contracted"))


@query()
def consensus(spark, sf_dir):
    a = _simulated(spark, sf_dir).where("error_flags is null")
    found = consensus_.consensus(a.withColumn("haplotype", F.when(F.element_at("kmer_count", 1) < 20, "h1").otherwise("h2")))
    return found.select("locus_id", "haplotype", "kind", C.contract_runs(F.col("kmers")).alias("contracted"), "spanning_reads", "flanking_reads")


@query("""select p_partkey, a, b, round(case when greatest(len(a), len(b)) = 0 then 0 else levenshtein(a, b) / greatest(len(a), len(b)) end, 6) as rate
    from (select p_partkey, p_name as a, p_type || p_brand as b from part)""")
def levenshtein_rate(spark, sf_dir):
    """The weighted rate with both weights 1."""
    ship(spark)

    @F.pandas_udf("double")
    def rate(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([alignment.levenshtein_rate(x, y, 1.0, 1.0) for x, y in zip(a, b, strict=True)], dtype="float64")

    rows = V.table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("a"), F.concat("p_type", "p_brand").alias("b"))
    return rows.select("p_partkey", "a", "b", r6(rate("a", "b")).alias("rate"))


@query("""select l_orderkey, l_linenumber, l_partkey, l_suppkey, round(case when greatest(len(a), len(b)) = 0 then 0 else levenshtein(a, b) / greatest(len(a), len(b)) end, 6) as rate
    from (select *, p_name as a, l_returnflag || p_brand as b from lineitem join part on l_partkey = p_partkey)""")
def levenshtein_share(spark, sf_dir):
    rows = V.table(spark, sf_dir, "lineitem").join(V.table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", r6(C.levenshtein_share(F.col("p_name"), F.concat("l_returnflag", "p_brand"))).alias("rate"))


# --- report and files ------------------------------------------------------------------------------------------------

_ORDER = "case l_returnflag when 'A' then 1 when 'N' then 2 else 3 end"


def _plotted(spark, sf_dir):
    """Line items as labelled reads; the haplotype is the last digit of the supplier, 0 an outlier."""
    kind = F.when(F.col("l_returnflag") == "N", "spanning").when(F.col("l_returnflag") == "A", "left_flanking").otherwise("right_flanking")
    label = F.when(F.col("l_suppkey") % 10 == 0, "outlier").when(F.col("l_suppkey") % 10 < 5, "h1").otherwise("h2")
    return V.table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").cast("string").alias("locus_id"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_suppkey").alias("query_name"), label.alias("haplotype"), kind.alias("alignment_type"),
        F.col("l_quantity").cast("int").alias("length"), F.array(F.col("l_quantity").cast("int"), "l_linenumber").alias("kmer_count"), F.col("l_discount").alias("mean_str_quality"), F.col("l_tax").alias("str_error_rate"))


_PLOTTED = f"""v as (select l_partkey::varchar as locus_id, l_orderkey || '-' || l_linenumber || '-' || l_suppkey as query_name,
    case when l_suppkey % 10 = 0 then 'outlier' when l_suppkey % 10 < 5 then 'h1' else 'h2' end as haplotype, {_ORDER} as kind, l_returnflag, l_quantity::int as length, l_linenumber, l_discount, l_tax from lineitem)"""


@query(f"""with {_PLOTTED}, o as (select *, row_number() over (partition by locus_id order by haplotype, kind, case when kind = 3 then -length else length end, query_name) as read_id from v),
    g as (select locus_id, haplotype, min(read_id) as a, max(read_id) as b, count(*) as size from o group by 1, 2)
    select locus_id, haplotype, (a - case when size < 10 then 0.5 else 0 end)::double as first, (b + case when size < 10 then 0.5 else 0 end)::double as last, size from g""")
def report_group_sizes(spark, sf_dir):
    return report.group_sizes(summary.read_order(_plotted(spark, sf_dir), "query_name"))


@query(f"""with {_PLOTTED}, n as (select locus_id, count(*) filter (haplotype <> 'outlier') as haplotyped, count(*) filter (haplotype = 'outlier') as outliers from v group by 1),
    f as (select locus_id, count(*) as filtered from v where l_linenumber = 7 group by 1)
    select n.locus_id, 'chr1' as chrom, n.locus_id::bigint * 100 as start, n.locus_id::bigint * 100 + 9 as "end", '(CAG)*' as structure,
    'http://localhost:60151/goto?locus=chr1:' || (n.locus_id::bigint * 100) || '-' || (n.locus_id::bigint * 100 + 9) as link, haplotyped, outliers, coalesce(filtered, 0) as filtered from n left join f using (locus_id)""")
def report_regions(spark, sf_dir):
    r = _plotted(spark, sf_dir)
    at = F.col("locus_id").cast("long") * 100
    loci = r.select("locus_id").distinct().select("locus_id", F.lit("chr1").alias("chrom"), at.alias("start"), (at + 9).alias("end"), F.lit("(CAG)*").alias("structure"))
    return report.regions(r, r.where(F.element_at("kmer_count", 2) == 7), loci)


@query(f"""with {_PLOTTED}, c as (select locus_id, case when l_returnflag = 'N' then 'spanning' else 'flanking' end as kind, unnest([0, 1])::int as idx, unnest([length, l_linenumber]) as x from v),
    w as (select locus_id, idx, ceil(greatest(max(x), 1) / least(100, greatest(max(x), 1))) as width from c group by 1, 2)
    select locus_id, idx, kind, (floor(x / width) * width)::bigint as bin, count(*) as n from c join w using (locus_id, idx) group by all""")
def report_lengths(spark, sf_dir):
    return report.lengths(_plotted(spark, sf_dir))


@query(f"with {_PLOTTED} select locus_id, haplotype, l_discount as mean_str_quality, l_tax as str_error_rate from v")
def report_quality_points(spark, sf_dir):
    return report.quality_points(_plotted(spark, sf_dir))


def _coloured(spark, sf_dir):
    e = V.table(spark, sf_dir, "events")
    own = F.concat("event_type", F.lit("_"), (F.col("user_id") % 9).cast("string"))
    ref = F.when(F.col("event_id") % 3 == 0, F.concat("event_type", F.lit("_0")))
    return e.select(F.col("user_id").alias("query_name"), own.alias("kmer"), ref.alias("ref_kmer"), F.when(F.col("value") > 10, "outlier").otherwise("h1").alias("haplotype"))


_COLOURED = """v as (select user_id as query_name, event_type || '_' || (user_id % 9) as kmer, case when event_id % 3 = 0 then event_type || '_0' end as ref_kmer,
    case when value > 10 then 'outlier' else 'h1' end as haplotype from events)"""


@query(f"""with {_COLOURED} select kmer, count(*) as n from v where haplotype = 'outlier' and (len(kmer) < 8 or kmer in (select ref_kmer from v where ref_kmer is not null)) group by 1 order by n desc, kmer limit 12""")
def report_outlier_kmers(spark, sf_dir):
    return report.outlier_kmers(_coloured(spark, sf_dir), longest=8)


@query(f"""with {_COLOURED}, r as (select ref_kmer as kmer, count(*) as n, 1099511627776 as n_reads from v where ref_kmer is not null group by 1),
    o as (select kmer, count(*) as n, count(distinct query_name) as n_reads from v where kmer not in (select kmer from r) group by 1)
    select * from (select * from r union all select * from o) order by n_reads desc, n desc, kmer limit 12""")
def report_top_kmers(spark, sf_dir):
    return report.top_kmers(_coloured(spark, sf_dir))


@query(f"""with {V.V_SEQUENCES} select '@' || query_name || chr(10) || sequence || chr(10) || '+' || chr(10) || repeat('+', len(sequence)) as value from v_sequences""")
def fastq_records(spark, sf_dir):
    s = V.sequences(spark, sf_dir)
    return files.fastq(s.select(F.col("query_name").cast("string").alias("query_name"), "sequence", F.array_repeat(F.lit(10), F.length("sequence")).alias("qualities")))


@query("""select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity::int || '-' || l_linenumber as kmer_count, case when l_tax > 0.05 then 'high_tax;returned' else '' end as outlier_reasons, l_returnflag || '|' || l_linestatus as obs_kmers from lineitem""")
def delimited_table(spark, sf_dir):
    none = F.array().cast("array<string>")
    t = V.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.array(F.col("l_quantity").cast("int"), "l_linenumber").alias("kmer_count"),
        F.when(F.col("l_tax") > 0.05, F.array(F.lit("high_tax"), F.lit("returned"))).otherwise(none).alias("outlier_reasons"), F.array("l_returnflag", "l_linestatus").alias("obs_kmers"))
    return files.delimited(t)


@query("""select p_partkey, (p_size % 4)::int as first, (p_size % 3)::int as second, 1 as third from part""")
def path_counts(spark, sf_dir):
    """Paths of node names with as many visits as the size says; ``satellite_1`` isn't ``satellite_10``."""
    n = lambda name, k: F.array_repeat(F.lit(name), F.col("p_size") % k)
    path = F.concat(F.array(F.lit("left_anchor")), n("satellite_0", 4), n("satellite_1_0_A", 3), F.array(F.lit("sub_satellite_1_1"), F.lit("satellite_10"), F.lit("right_anchor")))
    p = V.table(spark, sf_dir, "part").select("p_partkey", path.alias("path")).withColumn("c", files.path_counts(F.col("path"), 11))
    return p.select("p_partkey", F.col("c")[0].alias("first"), F.col("c")[1].alias("second"), F.col("c")[10].alias("third"))


@query("""with a as (select l_partkey, l_partkey::varchar as locus_id, 'chr' || (l_partkey % 13) as chrom, l_partkey * 10 as start, l_partkey * 10 + 6 as "end", round(avg(l_quantity), 3) as m, min(l_quantity)::int as lo, max(l_quantity)::int as hi,
        count(*) filter (l_returnflag = 'N') as sp, count(*) filter (l_returnflag <> 'N') as fl from lineitem group by l_partkey)
    select chrom, start, "end", chrom || chr(9) || start || chr(9) || 'Tandem.' || locus_id || '.1' || chr(9) || substr(repeat('ACGTTGCA', 40000), (start + 1)::int, 6) || chr(9) || '<STR' || floor(m)::int || '>' || chr(9) || '.' || chr(9) || 'PASS'
        || chr(9) || 'END=' || "end" || ';LOCUSID=' || locus_id || ';RU=CAG;REPID=' || locus_id || chr(9) || 'GT:LC:AD:ADSP:ADFL:REPCN:REPCI' || chr(9)
        || '1:' || (sp + fl) || ':' || (sp + fl) || ':' || sp || ':' || fl || ':' || m::varchar || ':' || lo || '.0-' || hi || '.0' as value from a""")
def vcf_format(spark, sf_dir):
    """A variant line a part: the genotype is the mean quantity."""
    q, name = F.col("l_quantity").cast("double"), F.col("l_partkey").cast("string").alias("locus_id")
    items = V.table(spark, sf_dir, "lineitem")
    fit = items.groupBy(name).agg(F.round(F.avg(q), 3).alias("mean"), F.min(q).alias("low"), F.max(q).alias("high"))
    one = F.struct(F.array("mean").alias("mean"), F.array("low").alias("mean_lower"), F.array("high").alias("mean_upper"))
    loci = fit.select("locus_id", F.lit(False).alias("is_significant"), one.alias("h1"), one.alias("h2"), one.alias("hom"))
    calls = items.select(name, F.lit("hom").alias("haplotype"), F.when(F.col("l_returnflag") == "N", "spanning").otherwise("left_flanking").alias("alignment_type"))
    at = F.col("locus_id").cast("long") * 10
    units = fit.select("locus_id", F.lit(0).alias("idx"), F.lit("CAG").alias("satellite"), F.col("locus_id").alias("satellite_id"), F.concat(F.lit("chr"), (F.col("locus_id").cast("long") % 13).cast("string")).alias("chrom"), at.alias("start"), (at + 6).alias("end"))
    reference = spark.range(13).select(F.concat(F.lit("chr"), F.col("id").cast("string")).alias("chrom"), F.repeat(F.lit("ACGTTGCA"), F.lit(40000)).alias("sequence"))
    order = spark.range(10).select(F.concat(F.lit("chr"), F.col("id").cast("string")).alias("chrom"), F.col("id").alias("ord"))
    return vcf.records(vcf.alleles(loci, calls), units, reference, order).select("chrom", "start", "end", "value")
