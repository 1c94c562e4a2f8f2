import re

import pytest

from tandem.llm.mixing import decisions, mix, targets


def level(sizes, weights=(5, 2, 1), most=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    out, open_, left = {}, set(names), float(sum(sizes.values()))
    while open_:
        total = sum(w[s] for s in open_)
        over = {s for s in open_ if left * w[s] / total > most * sizes[s]}
        if not over:
            return out | {s: left * w[s] / total for s in open_}
        for s in over:
            out[s] = float(most * sizes[s])
            left -= out[s]
        open_ -= over
    return out


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 100, "c": 100}, {"a": 1, "b": 500, "c": 3, "d": 0, None: 70, "Z": 9, "é": 12}, {None: 5}, {"a": 0, "b": 0}])
def test_targets(spark, sizes):
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    got = {r.source: r.target for r in targets(df).collect()}
    assert got == pytest.approx(level(sizes))


def test_decisions(docs, rows):
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, *_ in rows}
    got = decisions(docs).collect()
    assert {r.row.doc_id: r["size"] for r in got} == size
    by = {}
    for i, _, _, s, _ in rows:
        by[s] = by.get(s, 0) + size[i]
    want = level(by)
    for r in got:
        rate = want[r.row.source] / by[r.row.source]
        assert r.target == pytest.approx(want[r.row.source])
        assert r.copies in (int(rate), int(rate) + 1) and r.copies <= 3


def test_near_the_targets(spark):
    rows = [(i, "w " * (i % 7 + 1), "abc"[i % 3]) for i in range(6000)]
    got = decisions(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    taken, target = {}, {}
    for r in got:
        taken[r.row.source] = taken.get(r.row.source, 0) + r["size"] * r.copies
        target[r.row.source] = r.target
    for s in target:
        assert taken[s] == pytest.approx(target[s], rel=0.06)


def test_copies_are_whole_rows(docs):
    out = mix(docs)
    assert out.columns == docs.columns
    n = {r.row.doc_id: r.copies for r in decisions(docs).collect()}
    got = {}
    for r in out.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert got == {i: c for i, c in n.items() if c}
    assert sorted(map(str, mix(docs).collect())) == sorted(map(str, out.collect()))


def test_odd_rows(odd, none):
    assert decisions(odd).count() == 6
    assert mix(odd).columns == odd.columns
    assert mix(none).count() == 0
