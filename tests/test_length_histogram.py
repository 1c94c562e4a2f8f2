"""A length histogram joins nothing back and deals loci to an explicit number of tasks."""

from tandem.operators import summary


def test_plan_and_bins(spark):
    rows = [("a", "h1", 250), ("a", "h1", 251), ("a", "h2", 3), ("a", "h2", 3), ("b", "h1", 7), ("b", None, 7), (None, "h1", 5)]
    out = summary.length_histogram(spark.createDataFrame(rows, "locus_id string, haplotype string, count long"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "REPARTITION_BY_NUM" in plan
    assert {tuple(r) for r in out.where("locus_id is not null").collect()} == {("a", "h1", 249, 2), ("a", "h2", 3, 2), ("b", "h1", 7, 1), ("b", None, 7, 1)}
