"""Mixing sources to target weights: whole copies plus one hash-seeded Bernoulli copy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tandem.llm.common import WORD, written

#: Most sources whose figures go to every task; beyond, both sides are dealt by source and hot sources split.
SMALL = 1 << 16


def n_words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """(source, source_size, target) from rows (source, size).

    Sources in code point order, null last, weigh ``weights`` in turn and share the sum of all sizes; a target stops at
    ``most`` times its source's size and the excess is shared again by weight until none is above.  That ends in targets
    ``min(most * size, level * weight)`` for one level, found by one pass over sources sorted by ``most * size / weight``:
    the first source that isn't full when all before it are.  The windows run over one row a source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    s = total.withColumn("weight", turn).withColumn("most", F.lit(most) * F.col("source_size")).withColumn("all", F.sum("source_size").over(every))
    fill = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("level", (F.col("all") - F.coalesce(F.sum("most").over(before), F.lit(0))) / F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing)))
    s = s.withColumn("level", F.min(F.when(F.col("level") * F.col("weight") <= F.col("most"), F.struct(F.col("most") / F.col("weight"), "source", "level"))).over(every)["level"])
    return s.select("source", "source_size", F.least(F.col("most").cast("double"), F.col("level") * F.col("weight")).alias("target"))


def draw(doc_id: Column, seed: str = "mix") -> Column:
    """A number in [0, 1) that the seed and the id alone decide."""
    text = F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def decisions(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(row, size, source_size, target, copies) of every row; ``row`` is a struct of all its columns.

    A document comes floor(rate) times and once more with the fraction as probability, rate = target / source_size, so at
    most ``most`` times.  Nulls: a null source is a source of its own, the last; a null or empty text has size 0 and a
    source without any word gives rate 0.  Rows that repeat an id are drawn alike.  Runs agree: the draw is a hash of the
    seed and the id.  An empty table gives an empty table; columns of any name go through inside ``row``.

    Two passes over the texts; the first is summed up before it is shuffled, so a source with a third of all rows costs no
    more than another.  The second takes its source's figures from a table of one row a source, which is written and counted
    first: with at most ``SMALL`` rows it goes to every task and no text is moved.
    """
    own = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), F.col(id_col).alias("__id"), F.col(source_col).alias("source"), n_words(text_col).alias("size"))
    of = written(targets(own.select("source", "size"), weights, most).withColumnRenamed("source", "__source"))
    if of.count() <= SMALL:
        of = F.broadcast(of)
    rate = F.coalesce(F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")), F.lit(0.0))
    copies = F.floor("rate") + F.when(draw(F.col("__id"), seed) < F.col("rate") - F.floor("rate"), 1).otherwise(0)
    return own.join(of, F.col("source").eqNullSafe(F.col("__source"))).withColumn("rate", rate).select("row", "__id", "size", "source_size", "target", copies.cast("int").alias("copies"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with each document as often as the mix takes it; the rest as in :func:`decisions`."""
    kept = decisions(docs, **options).where("copies > 0")
    return kept.select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).select("row.*")
