"""From a simulated genome and alignments to tables, variants and a report."""

import json
import random

import bamfile
import pytest
from pyspark.sql import functions as F

from tandem.config import Config
from tandem.operators import genotype, qc
from tandem.plans import cli, pipeline
from tandem.sources import files


@pytest.fixture(scope="module")
def world(tmp_path_factory):
    d = tmp_path_factory.mktemp("world")
    r = random.Random(11)
    dna = lambda n: "".join(r.choices("ACGT", k=n))
    left, middle, right = dna(1200), dna(1500), dna(1200)
    chrom = left + "CAG" * 10 + middle + "GAA" * 6 + "TTC" + "CCG" * 4 + right
    a, b = len(left), len(left) + 30 + len(middle)
    (d / "g.fa").write_text(f">chr1 test\n{chrom}\n")
    (d / "g.fa.fai").write_text(f"chr1\t{len(chrom)}\t11\t{len(chrom)}\t{len(chrom) + 1}\n")
    (d / "c.json").write_text(json.dumps([
        {"LocusId": "ONE", "LocusStructure": "(CAG)*", "ReferenceRegion": f"chr1:{a}-{a + 30}"},
        {"LocusId": "TWO", "LocusStructure": "(GAA)*TTC(CCG)*", "ReferenceRegion": [f"chr1:{b}-{b + 18}", f"chr1:{b + 21}-{b + 33}"], "VariantId": ["T1", "T2"]},
    ]))
    records = []
    for i in range(24):
        n = 10 if i < 12 else 17
        seq = left[-700:] + "CAG" * n + middle[:700]
        records.append((a - 700, f"one{i}", seq, 30 + 3 * n))
    for i in range(16):
        seq = middle[-600:] + "GAA" * 9 + "TTC" + "CCG" * 4 + right[:600]
        records.append((b - 600, f"two{i}", seq, 0))
    records.append((a - 700, "cut", left[-700:] + "CAG" * 9, 0))
    records.append((a - 700, "poor", left[-700:] + "CAG" * 10 + middle[:700], -1))
    rows = []
    for pos, name, seq, kind in sorted(records):
        quals = [8 if kind == -1 else 35] * len(seq)
        rows.append((0, bamfile.record(name, 0, pos, [(len(seq), "M")], seq, quals)))
    bamfile.write(d / "r.bam", [("chr1", len(chrom))], rows, index=True)
    return d


@pytest.fixture(scope="module")
def result(spark, world):
    return pipeline.run(spark, str(world / "r.bam"), str(world / "g.fa"), str(world / "c.json"), str(world / "out"), str(world / "v.vcf"), "s1", with_consensus=True, with_contracted=True)


def test_reads(result):
    rows = {(r.locus_id, r.query_name): r for r in result["reads"].collect()}
    assert rows["ONE", "one0"].kmer_count == [10] and rows["ONE", "one20"].kmer_count == [17]
    assert rows["TWO", "two3"].kmer_count == [9, 4]
    assert rows["TWO", "two3"].obs_kmers == ["GAA"] * 9 + ["TTC"] + ["CCG"] * 4
    assert rows["ONE", "cut"].alignment_type == "left_flanking" and rows["ONE", "cut"].kmer_count == [9]
    assert rows["ONE", "poor"].haplotype == "outlier" and "filtered_low_mean_str_quality" in rows["ONE", "poor"].outlier_reasons
    assert {rows["ONE", f"one{i}"].haplotype for i in range(12)} == {"h1"} and {rows["ONE", f"one{i}"].haplotype for i in range(12, 24)} == {"h2"}
    assert {rows["TWO", f"two{i}"].haplotype for i in range(16)} == {"hom"}


def test_tables(result):
    tests = {r.locus_id: r for r in result["summary"].collect()}
    assert tests["ONE"].is_significant and not tests["TWO"].is_significant
    p = {(r.locus_id, r.haplotype, r.idx): r for r in result["par_summary"].collect()}
    assert p["ONE", "h1", 0]["mean"] == 10 and p["ONE", "h2", 0]["mean"] == 17 and p["ONE", "h1", 0].satellite == "CAG"
    assert [p["TWO", "hom", i]["mean"] for i in (0, 1)] == [9, 4]
    g = {(r.locus_id, r.haplotype, r.idx): r for r in result["haplotypes"].collect()}
    assert g["ONE", "h2", 0].n == 12 and g["ONE", "h2", 0].sd == 0
    c = {(r.locus_id, r.haplotype): r for r in result["consensus"].collect()}
    assert c["ONE", "h2"].contracted == "17(CAG)" and c["TWO", "hom"].contracted == "9(GAA)-1(TTC)-4(CCG)"


def test_files(result, world, spark):
    lines = (world / "v.vcf").read_text().splitlines()
    assert lines[0] == "##fileformat=VCFv4.2" and "##ALT=<ID=STR17,Description=\"Short Tandem Repeat with 17 repeat units\">" in lines
    body = [x.split("\t") for x in lines if not x.startswith("#")]
    assert [(x[2].split(".", 1)[1], x[4], x[9].split(":")[0]) for x in body] == [("ONE.1", "<STR10>,<STR17>", "1/2"), ("TWO.1", "<STR9>", "1"), ("TWO.2", "<STR4>", "1")]
    keys, values = body[0][8].split(":"), body[0][9].split(":")
    own = dict(zip(keys, values, strict=True))
    assert own["CONS"] == "CAG" * 10 + "," + "CAG" * 17 and own["CONTRCONS"] == "10(CAG),17(CAG)" and own["REPCN"] == "10.0,17.0"
    assert "Tandem repeats of s1" in (world / "out/report.html").read_text()
    back = spark.read.option("header", True).csv(str(world / "out/reads.csv"))
    assert back.where("locus_id = 'TWO'").select("kmer_count").distinct().first()[0] == "9-4"


def test_subset(spark, world):
    assert [r.locus_id for r in pipeline.load_loci(spark, str(world / "c.json"), str(world / "g.fa"), ["TWO", "NOPE"]).collect()] == ["TWO"]
    with pytest.raises(ValueError):
        pipeline.load_loci(spark, str(world / "c.json"), str(world / "g.fa"), ["NOPE"])


def test_command_line():
    a = cli.parser().parse_args(["-i", "b", "-r", "f", "-s", "c", "-o", "o", "--max-trim", "7", "--heterozygozity-alpha", "0.01"])
    assert (a.max_trim, a.heterozygozity_alpha, a.anchor_length) == (7, 0.01, Config.anchor_length)
    with pytest.raises(SystemExit):
        cli.parser().parse_args([])


def test_supplementary_reads(spark):
    from tandem.operators.reads import primary_alignments

    near = spark.createDataFrame([("L", "a", 0, None), ("L", "a", 2048, "chr1,5,+,1M,0,0;"), ("L", "b", 2048, "chr2,8,+,1M,0,0;"), ("L", "b", 2048, "chr2,8,+,1M,0,0;"), ("L", "c", 256, None)], "locus_id string, query_name string, flag int, sa string")
    every = spark.createDataFrame([("b", 0, "chr2", 7, None), ("b", 2048, "chr2", 7, None), ("a", 0, "chr1", 4, None)], "query_name string, flag int, chrom string, pos long, sa string")
    assert sorted((r.query_name, r.flag) for r in primary_alignments(near, every).collect()) == [("a", 0), ("b", 0)]


def test_ploidy(spark):
    rows = [("x", "chrX")] * 12 + [("y", "chrY")] * 12 + [("a", "chr1")] * 12 + [("few", "chr1")] * 3
    df = spark.createDataFrame(rows, "locus_id string, chrom string")
    assert {r.locus_id: r.ploidy for r in qc.depth_ploidy(df, "XY").collect()} == {"x": 1, "y": 1, "a": 2, "few": 1}
    assert {r.locus_id: r.ploidy for r in qc.depth_ploidy(df, "XX").collect()} == {"x": 2, "y": 0, "a": 2, "few": 1}


def test_no_copies_no_result(spark):
    calls = spark.createDataFrame([("y", "spanning", [3])] * 12, "locus_id string, alignment_type string, kmer_count array<int>")
    ploidy = spark.createDataFrame([("y", 0)], "locus_id string, ploidy int")
    assert genotype.genotype_loci(calls, ploidy).count() == 0


def test_delimited(spark):
    df = spark.createDataFrame([(1, [1, 2], ["a", "b"], ["CAG", "CAA"])], "i int, kmer_count array<int>, outlier_reasons array<string>, obs_kmers array<string>")
    assert list(files.delimited(df).first()) == [1, "1-2", "a;b", "CAG|CAA"]
    assert files.delimited(df).select(F.col("kmer_count")).dtypes == [("kmer_count", "string")]
