"""Loci with equal observations are fitted once, and each has its own row."""

import pandas as pd

from tandem.config import Config
from tandem.operators import genotype


def observed(*counts):
    return [{"alignment_type": "spanning", "kmer_count": [c], "n": n} for c, n in counts]


def test_equal_loci_are_fitted_once(monkeypatch):
    fitted = []
    fit = genotype.genotype
    monkeypatch.setattr(genotype, "genotype", lambda o, ploidy: fitted.append(ploidy) or fit(o, ploidy))
    monkeypatch.setattr(genotype, "ROWS", 2)
    a, b = observed((10, 5), (20, 5)), observed((10, 6), (20, 5))
    batches = [pd.DataFrame({"locus_id": ["x", "y", "z"], "ploidy": [2, 2, 2], "observed": [a, a, a]}), pd.DataFrame({"locus_id": ["u", "v", "w"], "ploidy": [2, 1, 2], "observed": [a, a, b]})]
    out = pd.concat(genotype._loci(Config())(iter(batches)))
    assert out.locus_id.tolist() == ["x", "y", "z", "u", "v", "w"] and fitted == [2, 1, 2]
    assert out.n_reads.tolist() == [10] * 5 + [11] and out.ploidy.tolist() == [2, 2, 2, 2, 1, 2]


def test_rows_of_equal_and_other_loci(spark):
    calls = [(f"l{i}", "spanning", [c]) for i in range(6) for c in ([10] * 6 + [20] * 6 if i % 2 else [12] * 8)]
    out = genotype.genotype_loci(spark.createDataFrame(calls, "locus_id string, alignment_type string, kmer_count array<int>")).collect()
    assert {r.locus_id: (r.is_significant, r.n_reads) for r in out} == {f"l{i}": (bool(i % 2), 12 if i % 2 else 8) for i in range(6)}
