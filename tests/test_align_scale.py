"""What goes to every task of the aligner, and how often it aligns equal reads."""

import pandas as pd
import pytest

from tandem.operators import calls
from tandem.plans.queries import _ANCHORS, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture
def loci(spark):
    return spark.createDataFrame([("a", *_ANCHORS, ["CAG"], [True], ["", ""])], "locus_id string, left_anchor string, right_anchor string, units array<string>, skippable array<boolean>, breaks array<string>")


@pytest.mark.parametrize("few", [0, 10])
def test_reads_are_never_broadcast(spark, loci, monkeypatch, few):
    """Also where the plan takes them for small."""
    monkeypatch.setattr(calls, "FEW", few)
    reads = spark.range(3).selectExpr("if(id >= 0, 'a', 'b') locus_id", "string(id) query_name", "'+' strand", f"'{_ANCHORS[0] + 'CAG' * 5 + _ANCHORS[1]}' sequence", "array_repeat(30, 135) qualities", "repeat('0', 135) mod_5mc_probs")
    out = calls.align(reads, loci)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BuildLeft" not in plan and ("BuildRight" in plan) == bool(few)
    assert [r.kmer_count for r in out.collect()] == [[5]] * 3


def test_equal_reads_are_aligned_once(monkeypatch):
    seen = []
    align = calls.align_reads
    monkeypatch.setattr(calls, "align_reads", lambda locus, reads: seen.extend(reads) or align(locus, reads))
    text = _ANCHORS[0] + "CAG" * 4 + _ANCHORS[1]
    row = lambda name, quality: ("a", name, "+", text, [quality] * len(text), "", *_ANCHORS, ["CAG"], [True], ["", ""])
    columns = ["locus_id", "query_name", "strand", "sequence", "qualities", "mod_5mc_probs", "left_anchor", "right_anchor", "units", "skippable", "breaks"]
    batches = [pd.DataFrame([row("x", 30), row("y", 30), row("z", 20)], columns=columns), pd.DataFrame([row("w", 30)], columns=columns)]
    out = pd.concat(calls._align(iter(batches)))
    assert len(seen) == 2
    assert out.query_name.tolist() == ["x", "y", "z", "w"] and out.kmer_count.tolist() == [[4]] * 4
    assert [set(q) for q in out.str_qualities] == [{30}, {30}, {20}, {30}]


@pytest.mark.skipif("not __import__('os').path.isdir(DATA)")
def test_simulated_reads_are_never_broadcast(spark):
    assert "BuildLeft" not in QUERIES["graph_align"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
