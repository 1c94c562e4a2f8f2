"""Edit distances by whole columns against the plain recurrence, and how pairs are dealt."""

import random

import pytest

from tandem.functions.alignment import distance
from tandem.operators import summary
from tandem.plans.queries import QUERIES


def plain(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_distance():
    r = random.Random(2)
    for letters in ("AC", "ACGT", "abé\U0001f600z"):
        for _ in range(300):
            a, b = ("".join(r.choice(letters) for _ in range(r.randrange(90))) for _ in range(2))
            c = a[: r.randrange(90)] + b[:3] + a[r.randrange(90) :]  # near the first
            assert distance(a, b) == plain(a, b) and distance(a, c) == plain(a, c)
    assert [distance("", ""), distance("", "ab"), distance("abc", "")] == [0, 2, 3]


def test_long_texts_take_no_square_of_steps():
    r = random.Random(3)
    a = "".join(r.choice("ACGT") for _ in range(60_000))
    assert distance(a, a[:30_000] + "T" + a[30_005:]) in (5, 4)


@pytest.mark.parametrize("name", ["nearest_consensus", "flank_trim_distance"])
def test_pairs_are_dealt_to_an_explicit_number_of_tasks(spark, tmp_path, name):
    """A few bytes may be hours of work, so tasks aren't merged by bytes."""
    spark.createDataFrame([(i, "gattaca" * (i % 5 + 1), "x") for i in range(40)], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    out = QUERIES[name](spark, str(tmp_path))
    assert out.count() >= 39
    assert "REPARTITION_BY_NUM" in out._jdf.queryExecution().executedPlan().toString()


def test_nothing_to_compare(spark):
    reads = spark.createDataFrame([("a", 1, "left_flanking", "ACGT"), ("a", 2, "spanning", "ACGA"), ("b", 3, "spanning", "A")], "locus_id string, query_name long, alignment_type string, sequence string")
    centres = spark.createDataFrame([("a", "h1", "right_flanking", "ACGG")], "locus_id string, haplotype string, kind string, consensus string")
    assert {tuple(r) for r in summary.nearest(reads, centres).collect()} == {("a", 1, "none", None), ("a", 2, "h1", 1), ("b", 3, "none", None)}
