import re

import pyarrow as pa
import pytest

from tandem.llm import ngram_join
from tandem.llm.ngram_join import ngram_components, one_per_component

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, k=5, percent=80):
    def shingles(t):
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())

    sets = {i: shingles(t) for i, t in rows}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                n = len(sets[a] & sets[b])
                if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                    x, y = sorted((root(a), root(b)))
                    up[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize("percent", [50, 80, 100])
def test_equals_brute_force(docs, rows, percent):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_components(docs, 5, percent).collect()}
    assert got == brute([x[:2] for x in rows], 5, percent)


def test_links_across_a_chain(spark):
    """Neighbours in a chain link, its ends don't: components need more than one representative."""
    rows = [(i, " ".join(f"t{j}" for j in range(3 * i, 3 * i + 60))) for i in range(25)]
    rows += [(100 + i, " ".join(f"t{j}" for j in range(40, 64)) + " " + " ".join(f"own{i}-{j}" for j in range(30))) for i in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_components(df).collect()}
    assert got == brute(rows)


def test_pairs_across_components_are_no_rows():
    """Of 100 nodes that share enough lists and no component a row each leaves the task, not one a pair."""
    places = sorted((h, key) for h in range(50) for key in range(100))
    columns = {"lo": [0] * len(places), "h": [h for h, _ in places], "key": [k for _, k in places], "meta": [100 * 16 + 1] * len(places), "comp": [k for _, k in places], "rest": [0] * len(places)}
    batch = pa.record_batch({c: pa.array(v, pa.int64()) for c, v in columns.items()})
    assert sum(len(b) for b in ngram_join._across(80)(iter([batch]))) == 100


def test_blocks_lose_no_link(spark, monkeypatch):
    """Links that representatives haven't found are found between blocks and inside them."""
    monkeypatch.setattr(ngram_join, "ROUNDS", 0)
    monkeypatch.setattr(ngram_join, "MEET", 3, raising=False)
    rows = [(i, " ".join(f"t{j}" for j in range(2 * i, 2 * i + 40))) for i in range(60)]
    rows += [(100 + i, " ".join([f"s{j}" for j in range(60)] + [f"own{i}-{j}" for j in range(12 + i % 5)])) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_components(df).collect()}
    assert got == brute(rows)


def test_one_stays(docs, rows):
    want = {c for _, c in brute([x[:2] for x in rows]).values()}
    out = one_per_component(docs)
    assert out.columns == docs.columns
    assert sorted(r.doc_id for r in out.collect()) == sorted(want)


def test_odd_rows(odd, none):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_components(odd).collect()}
    assert got == {1: (1, 1), 2: (1, 2), 3: (0, 3)}
    assert ngram_components(none).count() == 0


def test_one_stays_of_odd_rows(spark, odd, none):
    """Rows without an id, repeated rows and ids with several texts."""
    tail = " ".join(f"t{i}" for i in range(40))
    rows = [(None, "x " + tail, "a"), (5, "z " + tail, "b"), (5, "only this", "c"), (5, "only this", "c"), (7, "only this", "d"), (None, "clean text", "e"), (None, "clean text", "f"), (None, None, "g"), (None, "", "h"), (None, "", "i"), (9, "", "j"), (9, "", "j"), (10, "", "k")]
    out = one_per_component(spark.createDataFrame(rows, "doc_id long, text string, more string").repartition(3))
    got = {tuple(r) for r in out.collect()}
    assert out.count() == len(got) and out.columns == ["doc_id", "text", "more"]
    assert got == {rows[i] for i in (1, 2, 5, 7, 8, 9, 10, 12)}
    assert sorted((r.doc_id, r.text or "") for r in one_per_component(odd).collect()) == [(1, "a b c"), (2, ""), (2, "d e f"), (3, "")]
    assert one_per_component(none).count() == 0
