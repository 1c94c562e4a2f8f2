"""K-mer error rates by packed sets against comparing all reads."""

import random

import pytest

from tandem.functions import kmers
from tandem.operators.reads import kmer_error_rate


def plain(rows, k):
    own = {(l, q): [s.encode()[i : i + k] for i in range(len(s.encode()) - k + 1)] for l, q, s in rows}
    out = set()
    for l, q, s in rows:
        others = {x for (m, p), xs in own.items() if m == l and p != q for x in xs}
        alone = sum(x not in others for x in own[l, q])
        out.add((l, q, round(alone / k / len(s), 9) if s and sum(r[0] == l for r in rows) > 1 else 0.0))
    return out


@pytest.fixture(scope="module")
def rows():
    r = random.Random(5)
    letters = lambda n, of="ACGT": "".join(r.choice(of) for _ in range(n))
    base = letters(80)
    some = [(f"l{i % 3}", i, base[: r.randrange(80)] + letters(r.randrange(9)) + base[r.randrange(80) :]) for i in range(40)]
    return [*some, ("l0", 50, ""), ("l1", 51, "ACG"), ("l2", 52, letters(60, "ACGTNRé")), ("l2", 53, "N" * 40), ("l2", 54, "N" * 30), ("lone", 55, letters(40))]


@pytest.mark.parametrize("k", [3, 11, 35])
def test_equals_comparing_all(spark, rows, k):
    df = spark.createDataFrame(rows, "locus_id string, query_name long, sequence string").repartition(3)
    got = {(r.locus_id, r.query_name, round(r.str_error_rate, 9)) for r in kmer_error_rate(df, k).collect()}
    assert got == plain(rows, k)


def test_blocks_and_merging_change_nothing(rows, monkeypatch):
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(kmers, "BUCKETS", 2)
    b = lambda part: pa.RecordBatch.from_arrays([pa.array([hash(l) for l, _, _ in part]), pa.array([q for _, q, _ in part]), pa.array([s.encode() for _, _, s in part])], names=["l", "q", "s"])

    def counts(parts):
        packed = pa.Table.from_batches(kmers.packed(5)(iter([b(p) for p in parts]))).sort_by("bucket")
        total = {}
        for x in kmers.alone(iter(packed.to_batches())):
            for q, n in zip(*(c.to_pylist() for c in x.columns), strict=True):
                total[q] = total.get(q, 0) + n
        return total

    own = [r for r in rows if len(r[2]) >= 5]
    want = counts([own])
    monkeypatch.setattr(kmers, "PLACES", 1)
    monkeypatch.setattr(kmers, "MERGE", 1)
    assert counts([own[i : i + 4] for i in range(0, len(own), 4)]) == want
    assert np.sum(list(want.values())) > 0


def test_shuffle_is_less_than_the_places(spark):
    """All places of 3,000 reads were a row of 40 bytes each before; packed sets of few distinct k-mers are small."""
    df = spark.range(3000).selectExpr("'a' locus_id", "id query_name", "repeat('ACGTTGCAAGCT', 40) sequence")
    plan = kmer_error_rate(df)._jdf.queryExecution().executedPlan().toString()
    assert "Generate explode" not in plan
    assert kmer_error_rate(df).where("str_error_rate <> 0").count() == 0
