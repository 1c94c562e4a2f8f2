import json
import struct

import bamfile
import pytest
from pyspark.sql import functions as F

from tandem.config import Config
from tandem.sources import bam, files

#: Fixed value: a read of a published case.
PACIFIC = "ACTTTTTCCAACCCTAACTCGTTCAGTTGCGTATTGCTAACCCTAACCCTAACCCTAACCCTAACCCTAACCCTAACCCAACCCCCACCCTCACCCTCACCCTCACCCTCACCCTAACCCTAACCCTAACCCTAACCCTAACCCTAACCCCTAACCCCTAACCCCTAACCCTAACCCTAACCCCTAACCCCTAACCCCTAACCCCTAACCCTAACCCTAACCCTAACCCAACCCTAACCCTAACCCTAACCCTAACCCTAACCCTAACCCTAACCCTAACCCTCTAACCCTCTAACCCTAACCCTAACCCTCTAACCCTAACCCTAACCCTAACCCTAACCCTAACCCTAACCCTAACCCTACCCTAACCCTACCCCTAACCCTAACCCTAACCCTAACCCTAACCCTAACCCTAACCCTACCCTAACCCCAACCCCAACCCCAACCCCAACCCCAACCCCAACCCTAACCCTAACCCTAACCCTAACCCTACCCTAACCCTAACCCTAACCCTAA"


@pytest.mark.parametrize(
    ("seq", "mm", "ml", "want"),
    [
        ("A", "C+m?,;", [], "0"),
        ("C", "C+m?,0;", [0], "!"),
        ("C", "C+m?,0;", [255], "+"),
        ("AAAA", "C+m?,;", [], "0000"),
        ("AAAA", "C+m?;", [], "0000"),
        ("ATCG", "C+m,0;", [128], "00&0"),
        ("ATCGATCG", "C+m,0,0;", [128, 64], "00&000#0"),
        (PACIFIC, "C+h?,7,1;C+m?,7,1;", [32, 6, 56, 11], "0" * 19 + "#" + "0" * 9 + "!" + "0" * (len(PACIFIC) - 30)),
        ("ATCG", None, None, "0000"),
    ],
)
def test_methylation(seq, mm, ml, want):
    assert bam.methylation(seq, False, mm, ml) == want


def test_methylation_of_reverse_reads():
    assert bam.methylation("CGAT", True, "C+m,0;", [128]) == "0&00"
    with pytest.raises(ValueError):
        bam.methylation("CC", False, "C+m,0;C+m,1;", [1, 2])


@pytest.fixture
def alignments(tmp_path):
    tags = b"SAZchr2,101,+,10M,60,0;\0" + b"MMZC+m,0;\0MLBC" + struct.pack("<iB", 1, 128)
    rows = []
    for i in range(8):
        rows.append((0, bamfile.record(f"r{i}", 0, 100 + 10 * i, [(5, "S"), (10, "M"), (2, "D"), (3, "S")], "ACGTACGTACGTACGTAC", range(18), 16 if i % 2 else 0, tags)))
    for i in range(4):
        rows.append((1, bamfile.record(f"s{i}", 1, 50 + i, [(4, "=")], "ACGT", [255] * 4, 2048)))
    return [("chr1", 5000), ("chr0", 10), ("chr2", 900)], [(0, r) if k == 0 else (2, r[:4] + struct.pack("<i", 2) + r[8:]) for k, r in rows]


@pytest.mark.parametrize("index", [False, True])
def test_bam(spark, tmp_path, alignments, index):
    bamfile.write(tmp_path / "a.bam", *alignments, index=index)
    bam.register(spark)
    df = spark.read.format("bam").load(str(tmp_path / "a.bam"))
    rows = {r.query_name: r for r in df.collect()}
    assert len(rows) == 12
    r = rows["r1"]
    assert (r.chrom, r.pos, r.end, r.cigar, r.strand, r.n_soft_clipped_left, r.n_soft_clipped_right) == ("chr1", 110, 122, "5S10M2D3S", "-", 5, 3)
    assert r.sequence == "ACGTACGTACGTACGTAC" and r.qualities == list(range(18)) and r.sa.startswith("chr2,101")
    assert rows["r0"].mod_5mc_probs == "0&" + "0" * 16
    assert rows["s0"].qualities == [] and rows["s0"].chrom == "chr2"
    assert df.where("chrom = 'chr2' and pos < 52").count() == 2
    assert df.where("chrom = 'chr1' and pos >= 150").count() == 3
    if index:
        assert df.rdd.getNumPartitions() == 3


@pytest.mark.parametrize("index", [False, True])
def test_regions(spark, tmp_path, alignments, index):
    bamfile.write(tmp_path / "a.bam", *alignments, index=index)
    bam.register(spark)
    got = lambda text: sorted(r.query_name for r in spark.read.format("bam").option("regions", text).load(str(tmp_path / "a.bam")).collect())
    assert got("chr1:100-101") == ["r0"]
    rows = spark.read.format("bam").load(str(tmp_path / "a.bam")).collect()
    for text in ("chr1:130-131,chr1:131-141,chr2:53-54", "chr1:0-5000", "chr2:0-1", "chr9:1-2", "chr1:4000-4001,chr1:120-130"):
        want = [(c, int(a), int(b)) for c, _, ab in (x.rpartition(":") for x in text.split(",")) for a, b in [ab.split("-")]]
        low = lambda r: any(r.chrom == c and r.pos < b and r.end > a for c, a, b in want)  # noqa: B023, E731
        wide = got(text)
        assert len(wide) == len(set(wide)) and {r.query_name for r in rows if low(r)} <= set(wide) <= {r.query_name for r in rows if any(r.chrom == c for c, _, _ in want)}


def test_merged_regions():
    assert bam.merged("b:5-9,a:10-20,a:15-30,a:9000000-9000001") == {"a": [(10, 30), (9000000, 9000001)], "b": [(5, 9)]}


def test_folder_of_files(spark, tmp_path, alignments):
    for name in ("a", "b"):
        bamfile.write(tmp_path / f"{name}.bam", *alignments, index=name == "a")
    bam.register(spark)
    assert spark.read.format("bam").load(str(tmp_path)).count() == 24


def test_fasta_and_index(spark, tmp_path):
    (tmp_path / "g.fa").write_text(">chr1 one\nACGT\nACG\n>chr2\nTTT\n")
    (tmp_path / "g.fa.fai").write_text("chr2\t3\t20\t3\t4\nchr1\t7\t10\t4\t5\n")
    assert {r.chrom: r.sequence for r in files.read_fasta(spark, str(tmp_path / "g.fa")).collect()} == {"chr1": "ACGTACG", "chr2": "TTT"}
    assert [(r.chrom, r.ord) for r in files.read_fai(spark, str(tmp_path / "g.fa.fai")).orderBy("ord").collect()] == [("chr1", 0), ("chr2", 1)]


def test_gaf(spark, tmp_path):
    line = lambda n, path, score: "\t".join([n, "9", "0", "9", "+", path, "20", "1", "10", "9", "9", "60", f"AS:i:{score}", "cg:Z:4=1X4="])
    (tmp_path / "a.gaf").write_text("\n".join([line("r10", ">a>satellite_1>satellite_10", 1), line("r1", ">satellite_1>satellite_1_0>b", 2), line("r1", ">x", 3)]) + "\n")
    rows = files.read_gaf(spark, str(tmp_path / "a.gaf"))
    got = {r.query_name: r for r in rows.withColumn("n", files.path_counts(F.col("path"), 2)).collect()}
    assert got["r1"].path == ["satellite_1", "satellite_1_0", "b"] and got["r1"].cigar == "4=1X4=" and got["r1"].n == [0, 2]
    assert got["r10"].n == [0, 1]


def test_fastq(spark):
    df = spark.createDataFrame([("r", "ACG", [0, 30, 60])], "query_name string, sequence string, qualities array<int>")
    assert files.fastq(df).first().value == "@r\nACG\n+\n!?]"


def test_catalogue(spark, tmp_path):
    entries = [
        {"LocusId": "A", "LocusStructure": "(CAG)*", "ReferenceRegion": "chr1:10-16", "VariantType": "Repeat"},
        {"LocusId": "B", "LocusStructure": "(CAG)*CAACAG(CCG)+T", "ReferenceRegion": ["chr1:10-16", "chr1:22-28"], "VariantId": ["B1", "B2"]},
        {"LocusId": "C", "LocusStructure": "(A)*(C)*", "ReferenceRegion": "chr1:5-9"},
        {"LocusId": "D", "LocusStructure": "none", "ReferenceRegion": "chr1:5-9"},
    ]
    path = tmp_path / "c.json"
    path.write_text(json.dumps(entries))
    got = {r.locus_id: r for r in files.read_catalogue(spark, str(path)).collect()}
    assert got.keys() == {"A", "B", "C"}
    b = got["B"]
    assert (b.units, b.skippable, b.breaks, b.start, b.end) == (["CAG", "CCG"], [True, False], ["", "CAACAG", "T"], 10, 28)
    assert [s.id for s in b.satellites] == ["B1", "B2"] and [s.id for s in got["C"].satellites] == ["C.1", "C.2"] and got["A"].satellites[0].id == "A"
    assert [s.location.start for s in b.satellites] == [10, 22] and got["C"].satellites[1].location.start == 5
    fasta = spark.createDataFrame([("chr1", "".join("ACGT"[i % 4] for i in range(40)))], "chrom string, sequence string")
    a = files.with_anchors(files.read_catalogue(spark, str(path)).where("locus_id = 'A'"), fasta, Config(anchor_length=12)).first()
    assert (a.left_anchor, a.right_anchor) == ("ACGTACGTAC", "ACGTACGTACGT")


@pytest.mark.parametrize(
    "change",
    [{"LocusStructure": None}, {"ReferenceRegion": "chr1-5"}, {"ReferenceRegion": ["chr1:1-2", "chr2:1-2"]}, {"VariantId": ["x", "y"]}, {"ReferenceRegion": ["chr1:1-2", "chr1:3-4"]}],
)
def test_bad_entries(spark, tmp_path, change):
    entry = {"LocusId": "A", "LocusStructure": "(CAG)*", "ReferenceRegion": "chr1:10-16"} | change
    (tmp_path / "c.json").write_text(json.dumps([{k: v for k, v in entry.items() if v is not None}]))
    with pytest.raises(Exception, match="A"):
        files.read_catalogue(spark, str(tmp_path / "c.json")).collect()


def test_reference_by_index(spark, tmp_path):
    import random

    r = random.Random(3)
    contigs = {n: "".join(r.choices("ACGTN", k=k)) for n, k in (("c1", 137), ("c2", 60), ("c3", 1001))}
    text, fai = "", ""
    for n, s in contigs.items():
        text += f">{n} some words\n"
        fai += f"{n}\t{len(s)}\t{len(text)}\t60\t61\n"
        text += "".join(s[i : i + 60] + "\n" for i in range(0, len(s), 60))
    (tmp_path / "g.fa").write_text(text)
    (tmp_path / "g.fa.fai").write_text(fai)
    regions = [(n, a, b) for n, s in contigs.items() for a in (-5, 0, 59, 60, 61, len(s) - 1, len(s)) for b in (a, a + 1, a + 130)] + [("c9", 0, 5)]
    got = {(x.chrom, x.start, x.end): x.sequence for x in files.fetch(spark.createDataFrame(regions, "chrom string, start long, end long"), str(tmp_path / "g.fa")).collect()}
    assert got == {(n, a, b): contigs[n][max(a, 0) : max(b, 0)] for n, a, b in regions if n in contigs}
    loci = spark.createDataFrame([("L", "c3", 400, 430), ("M", "c1", 10, 12)], "locus_id string, chrom string, start long, end long")
    want = files.with_anchors(loci, files.read_fasta(spark, str(tmp_path / "g.fa")), Config(anchor_length=100))
    assert sorted(map(tuple, files.anchors_by_index(loci, str(tmp_path / "g.fa"), Config(anchor_length=100)).collect())) == sorted(map(tuple, want.collect()))
