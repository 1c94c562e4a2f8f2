"""Repeat graphs of loci as rows and as GFA, and the kernels as functions of Spark SQL."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tandem.config import Config
from tandem.functions import alignment
from tandem.functions import graph as G
from tandem.shipping import ship


def locus_graphs(loci: DataFrame, c: Config = Config()) -> DataFrame:
    """(locus_id, gfa, nodes, edges) of each locus (locus_id, left_anchor, right_anchor, units, skippable, breaks)."""
    ship(loci.sparkSession)

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                own = (r.left_anchor, r.right_anchor, list(r.units), [bool(x) for x in r.skippable], list(r.breaks), c.min_anchor_overlap)
                nodes, edges = G.repeat_graph(*own)
                rows.append((r.locus_id, G.gfa(*own), [{"name": n, "bases": b} for n, b in nodes], [{"source": a, "target": b} for a, b in edges]))
            yield pd.DataFrame(rows, columns=["locus_id", "gfa", "nodes", "edges"])

    own = loci.select(F.col("locus_id").cast("string").alias("locus_id"), "left_anchor", "right_anchor", "units", "skippable", "breaks")
    return own.mapInPandas(task, "locus_id string, gfa string, nodes array<struct<name:string,bases:string>>, edges array<struct<source:string,target:string>>")


def register(spark: SparkSession) -> None:
    """Makes the kernels functions of SQL: contract_kmers, repeat_count, levenshtein_rate, repeat_graph (text), graph_edges (a table)."""
    ship(spark)
    from pyspark.sql.functions import pandas_udf, udtf

    spark.sql("create or replace temporary function repeat_count(kmers array<string>, unit string) returns int return size(filter(kmers, k -> k = unit))")
    spark.sql("""create or replace temporary function contract_kmers(items array<string>) returns string return array_join(transform(
        filter(sequence(0, size(items)), i -> i < size(items) and (i = 0 or items[i] <> get(items, i - 1))),
        i -> concat(coalesce(get(filter(sequence(0, size(items)), j -> j > i and (j = size(items) or get(items, j) <> items[i])), 0), size(items)) - i, '(', items[i], ')')), '-')""")

    @pandas_udf("double")
    def rate(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else alignment.levenshtein_rate(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    @pandas_udf("string")
    def text(left: pd.Series, right: pd.Series, units: pd.Series, skippable: pd.Series, breaks: pd.Series) -> pd.Series:
        return pd.Series([G.gfa(a, b, list(u), [bool(x) for x in s], list(k)) for a, b, u, s, k in zip(left, right, units, skippable, breaks, strict=True)])

    class Edges:
        def eval(self, left: str, right: str, units: list, skippable: list, breaks: list):
            yield from G.repeat_graph(left, right, list(units), [bool(x) for x in skippable], list(breaks))[1]

    spark.udf.register("levenshtein_rate", rate)
    spark.udf.register("repeat_graph", text)
    spark.udtf.register("graph_edges", udtf(Edges, returnType="source string, target string"))
