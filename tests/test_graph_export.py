import pytest

from tandem.functions.alignment import levenshtein_rate
from tandem.functions.graph import gfa, repeat_graph
from tandem.operators.graph import locus_graphs, register

LEFT, RIGHT = "A" * 300 + "C" * 200, "G" * 200 + "T" * 300


def walks(edges, length):
    """All node sequences from the left anchor of a given number of steps."""
    out = [["left_anchor"]]
    for _ in range(length):
        out = [[*w, b] for w in out for a, b in edges if a == w[-1]]
    return out


def test_units_breaks_and_skips():
    nodes, edges = repeat_graph(LEFT, RIGHT, ["CAG", "CCG"], [False, True], ["", "TT", "AC"])
    assert dict(nodes) == {"left_anchor": "A" * 300, "left_anchor_overlap": "C" * 200, "satellite_0": "CAG", "break_1": "TT", "satellite_1": "CCG", "break_2": "AC", "right_anchor_overlap": "G" * 200, "right_anchor": "T" * 300}
    assert set(edges) == {
        ("left_anchor", "left_anchor_overlap"), ("left_anchor_overlap", "satellite_0"), ("satellite_0", "satellite_0"), ("satellite_0", "break_1"), ("break_1", "satellite_1"),
        ("satellite_1", "satellite_1"), ("break_1", "break_2"), ("satellite_1", "break_2"), ("break_2", "right_anchor_overlap"), ("right_anchor_overlap", "right_anchor"),
    }
    assert len(edges) == len(set(edges))


def test_ambiguity_codes():
    nodes, edges = repeat_graph("", "", ["ARG", "NC"], [False, False], ["", "", ""], 200)
    bases = dict(nodes)
    spelt = {"".join(bases[n] for n in w if "satellite" in n) for w in walks(edges, 7) if w[-1] == "right_anchor_overlap"}
    assert spelt == {a + b for a in ("AAG", "AGG") for b in ("AC", "CC", "GC", "TC")}
    assert {(a, b) for a, b in edges if a == "sub_satellite_0_2"} == {("sub_satellite_0_2", "satellite_0_0"), *(("sub_satellite_0_2", f"satellite_1_0_{x}") for x in "ACGT")}


def test_text():
    lines = gfa("AC", "GT", ["CAG"], [False], ["", ""], 1).splitlines()
    assert lines[:5] == ["S\tleft_anchor\tA", "S\tleft_anchor_overlap\tC", "S\tsatellite_0\tCAG", "S\tright_anchor_overlap\tG", "S\tright_anchor\tT"]
    assert "L\tsatellite_0\t+\tsatellite_0\t+\t0M" in lines and len(lines) == 10


def test_rows_and_sql(spark):
    loci = spark.createDataFrame([("one", "AC", "GT", ["CAG"], [False], ["", ""])], "locus_id string, left_anchor string, right_anchor string, units array<string>, skippable array<boolean>, breaks array<string>")
    r = locus_graphs(loci).first()
    assert r.gfa == gfa("AC", "GT", ["CAG"], [False], ["", ""]) and len(r.nodes) == 5 and len(r.edges) == 5
    register(spark)
    loci.createOrReplaceTempView("some_loci")
    got = spark.sql("""select contract_kmers(array('CAG', 'CAG', 'CAA', 'CAG')) as c, contract_kmers(cast(array() as array<string>)) as none, repeat_count(array('A', 'B', 'A'), 'A') as n,
        levenshtein_rate('CAGCAG', 'CAGCTG') as r, repeat_graph(left_anchor, right_anchor, units, skippable, breaks) as g from some_loci""").first()
    assert (got.c, got.none, got.n, got.r, got.g) == ("2(CAG)-1(CAA)-1(CAG)", "", 2, pytest.approx(levenshtein_rate("CAGCAG", "CAGCTG")), r.gfa)
    assert spark.sql("select * from graph_edges('AC', 'GT', array('CAG'), array(false), array('', ''))").count() == 5
