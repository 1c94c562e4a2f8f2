import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tandem.llm.ann_permutation import nearest


def brute(rows, every, k):
    good = {i: [float(np.float32(x)) for x in v] for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    out = {}
    for q in good:
        if q % every == 0:
            s = sorted((-math.fsum(a * b for a, b in zip(good[q], good[i], strict=True)), i) for i in good if i != q)
            out[q] = [(i, -x) for x, i in s[:k]]
    return out


def found(df, every, k, **options):
    out = {}
    for r in sorted(nearest(df, F.col("vec_id") % every == 0, k, **options).collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert len(out[r.query_id]) == r["rank"]
    return out


@pytest.fixture(scope="module")
def rows():
    r = np.random.default_rng(3)
    x = r.normal(size=(1500, 16)).astype(np.float32)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    rows += [(2000 + i, rows[7][1]) for i in range(60)] + [(3000 + i, rows[20][1]) for i in range(5)]
    return rows + [(4000, None), (4020, [0.0] * 16), (4040, [float("nan")] * 16), (4060, [None] * 16), (4080, [float("inf")] + [1.0] * 15), (4100, [1.0])]


@pytest.fixture(scope="module")
def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5).cache()


def test_everything_ranked_again_is_exact(vectors, rows):
    assert found(vectors, 20, 20, share=1.0) == brute([x for x in rows if x[1] is None or len(x[1]) == 16], 20, 20)


def test_recall(vectors, rows):
    want = brute([x for x in rows if x[1] is None or len(x[1]) == 16], 20, 20)
    got = found(vectors, 20, 20, pivots=128, prefix=64, share=0.15)
    assert got.keys() == want.keys()
    assert all(len(got[q]) == 20 for q in got)
    recall = np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want])
    assert recall >= 0.9


def test_few_and_none(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [1.0, 0.0]), (2, [1.0, 0.0])], "vec_id long, embedding array<float>")
    assert found(few, 20, 20) == {0: [(2, 1.0), (1, 0.5)]}
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert nearest(empty, F.col("vec_id") % 20 == 0).count() == 0


@pytest.mark.parametrize("n", [500, 2000])
def test_recall_with_the_query_s_defaults(spark, n):
    x = np.random.default_rng(n).normal(size=(n, 64)).astype(np.float32)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    want, got = brute(rows, 20, 20), found(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), 20, 20)
    assert got.keys() == want.keys()
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want]) >= 0.95
