import random

import pytest
from pyspark.sql import functions as F

from tandem.llm.language_id import accepted_only, held_out, identify, train

PARTS = {"aa": ["ka", "to", "ri", "mu", "ne"], "bb": ["sch", "ung", "ein", "ver", "aß"], "cc": ["eau", "tion", "ç", "ou", "é"]}


@pytest.fixture(scope="module")
def corpus(spark):
    r = random.Random(4)
    word = lambda lang: "".join(r.choice(PARTS[lang]) for _ in range(r.randrange(1, 4)))
    rows = []
    for i in range(600):
        lang = r.choice(list(PARTS))
        rows.append((i, " ".join(word(lang) for _ in range(r.randrange(3, 60))), lang if i % 10 else None, lang))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, truth string")


@pytest.fixture(scope="module")
def model(corpus):
    return train(corpus.where(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang"))


def test_held_out_accuracy(corpus, model):
    got = identify(corpus, model).join(corpus.select("doc_id", "truth"), "doc_id").where(held_out(F.col("doc_id"))).collect()
    assert len(got) > 100
    assert sum(r.lang_pred == r.truth for r in got) / len(got) > 0.98
    assert sum(r.accepted for r in got) / len(got) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_calibration(corpus, model):
    got = identify(corpus, model).join(corpus.select("doc_id", "truth"), "doc_id").where(held_out(F.col("doc_id"))).collect()
    assert abs(sum(r.score for r in got) / len(got) - sum(r.lang_pred == r.truth for r in got) / len(got)) < 0.05


def test_training_is_repeatable(corpus, model):
    again = train(corpus.where(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang"))
    assert (again.table == model.table).all() and again.temperature == model.temperature


def test_the_sample_is_bounded(corpus):
    from tandem.llm.language_id import sample

    assert sample(corpus, 60).count() < 120


def test_no_letters(spark, model):
    rows = [(1, None), (2, ""), (3, "12 !? ..."), (4, " \n"), (5, "ж"), (None, "ka to")]
    got = {r.doc_id: r for r in identify(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 and not got[i].accepted for i in (1, 2, 3, 4))
    assert got[5].lang_pred in PARTS and got[None].lang_pred == "aa"


def test_equal_texts_equal_results(spark, model):
    df = spark.createDataFrame([(i, "ka to ri " * 20) for i in range(300)] + [(i, "x" * i) for i in range(300, 500)], "doc_id long, text string")
    got = [r for r in identify(df.repartition(7), model).collect() if r.doc_id < 300]
    assert len({(r.lang_pred, round(r.score, 12)) for r in got}) == 1


def test_without_labels(spark, none):
    df = spark.createDataFrame([(1, "ka", None)], "doc_id long, text string, lang string")
    assert train(df) is None and train(none) is None
    assert identify(df, None).first().lang_pred == "und"
    assert accepted_only(df, None).count() == 1


def test_filter_keeps_columns(odd, none, corpus, model):
    out = accepted_only(odd, model)
    assert out.columns == odd.columns
    assert all(r.text for r in out.collect())
    assert accepted_only(none, model).count() == 0
    assert accepted_only(corpus, model).count() >= 0.97 * corpus.count()
