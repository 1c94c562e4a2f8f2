"""Rows that a join can't want stay out of its shuffle, and none that it wants does."""

from tandem.llm import common
from tandem.llm.ngram_join import ngram_components


def test_likely(spark, monkeypatch):
    rows, wanted = spark.range(-3000, 5000).withColumnRenamed("id", "doc_id"), spark.range(-50, 5000, 97).withColumnRenamed("id", "doc_id")
    want = {r.doc_id for r in wanted.collect()}
    got = {r.doc_id for r in common.likely(rows, wanted).collect()}
    assert want <= got and len(got) < len(want) + 20
    assert common.likely(rows, wanted.where("doc_id > 10000")).count() == 0
    monkeypatch.setattr(common, "BITS", 4)  # all bits are set: all rows pass
    assert common.likely(rows, wanted).count() == rows.count()


def test_join_asks_before_it_deals_texts(spark, monkeypatch):
    from tandem.llm import ngram_join

    asked = []
    monkeypatch.setattr(ngram_join, "likely", lambda rows, wanted: asked.append(wanted.count()) or common.likely(rows, wanted))
    text = " ".join(f"w{i}" for i in range(60))
    docs = [(1, text), (2, text + " end"), *((10 + i, " ".join(f"x{i}y{j}" for j in range(40))) for i in range(20))]
    out = {r.doc_id: r.component_id for r in ngram_components(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert out == {d: 1 if d < 10 else d for d, _ in docs}
    assert asked and max(asked) == 2
