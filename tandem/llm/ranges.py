"""Deals rows out in ranges of their id, from bounds that are plain values, so every run deals them alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bounds(ids: DataFrame, parts: int, column: str = "doc_id") -> list[int]:
    """At most ``parts - 1`` ascending cuts of about equally many ids, by a mergeable quantile sketch over all rows."""
    if parts < 2:
        return []
    at = [i / parts for i in range(1, parts)]
    got = ids.agg(F.percentile_approx(column, at, max(10_000, parts * 20)).alias("q")).first()["q"]
    return sorted(set(got or []))


def part_of(column: Column, cuts: list[int]) -> Column:
    """How many cuts are at or under the value: a tree of comparisons as deep as the logarithm of their number."""

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(column >= F.lit(cuts[mid]), tree(mid + 1, hi)).otherwise(tree(lo, mid))

    return tree(0, len(cuts)).cast("int")


def parts_for(df: DataFrame, rows: int, least_rows: int = 2000) -> int:
    """The session's number of shuffle partitions, fewer for a small table."""
    return max(1, min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // least_rows)))
