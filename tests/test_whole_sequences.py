"""Queries over whole sequences against brute force."""

import random

import pytest

from tandem import views as V
from tandem.plans.queries import QUERIES


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Texts that are equal in their first 250 letters and differ later."""
    r = random.Random(4)
    letters = lambda n: "".join(r.choice("acgt") for _ in range(n))
    head = letters(250)
    rows = [(i, head + letters(r.randrange(5, 120)), "ab"[i % 3 == 0]) for i in range(18)]
    path = str(tmp_path_factory.mktemp("whole"))
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{path}/documents.parquet")
    return path, {x.query_name: (x.locus_id, x.sequence) for x in V.sequences(spark, path).collect()}


def test_nearest_consensus(spark, tables):
    path, s = tables
    want = set()
    for i, (locus, x) in s.items():
        two = sorted(j for j in s if s[j][0] == locus)[:2]
        d, h = min((distance(x[: len(s[j][1])], s[j][1][: len(x)]), f"h{k}") for k, j in enumerate(two, 1))
        want.add((locus, i, h, d))
    assert {tuple(r) for r in QUERIES["nearest_consensus"](spark, path).select("locus_id", "query_name", "haplotype", "distance").collect()} == want


def test_flank_trim_distance(spark, tables):
    path, s = tables
    want = set()
    for a in range(17):
        (ka, kb), x, y = ("lsr"[a % 3], "lsr"[a // 3 % 3]), s[a][1], s[a + 1][1]
        n = min(len(x), len(y))
        cut = lambda z, own, other: {"l": z[:n], "r": z[-n:], "s": z}[own if own != "s" else other]  # noqa: B023, E731
        x, y = cut(x, ka, kb), cut(y, kb, ka)
        want.add((a, a + 1, len(x), len(y), distance(x, y)))
    assert {tuple(r) for r in QUERIES["flank_trim_distance"](spark, path).select("a", "b", "len_a", "len_b", "distance").collect()} == want
