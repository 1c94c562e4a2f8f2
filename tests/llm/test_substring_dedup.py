import re

import pytest

from tandem.llm.substring_dedup import substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, k):
    first, out = {}, {}
    docs = sorted((i, WORD.findall(t or "")) for i, t in rows)
    for i, w in docs:
        gone = [False] * len(w)
        for j in range(len(w) - k + 1):
            if first.setdefault(tuple(w[j : j + k]), (i, j)) != (i, j):
                gone[j : j + k] = [True] * k
        out[i] = (" ".join(x for x, g in zip(w, gone) if not g), len(w), sum(gone))
    return out


@pytest.mark.parametrize("k", [2, 5, 20])
def test_equals_brute_force(docs, rows, k):
    got = {r.doc_id: (r.text, r.n_words, r.n_removed) for r in substring_dedup(docs, k).collect()}
    assert got == brute([x[:2] for x in rows], k)


def test_spans_cover_what_went(docs):
    for r in substring_dedup(docs, 20).collect():
        assert sum(s.stop - s.start for s in r.removed) == r.n_removed


def test_repeats_inside_a_text(spark):
    text = "a b c a b c a b c"
    got = substring_dedup(spark.createDataFrame([(0, text)], "doc_id long, text string"), 3).first()
    assert (got.text, got.n_removed) == ("a b c", 6)


def test_odd_rows(odd, none):
    got = {r.doc_id: r.text for r in substring_dedup(odd, 2).collect()}
    assert got == {1: "a b c", 2: "d e f", 3: ""}
    assert substring_dedup(none, 20).count() == 0


def test_rejects_tiny_windows(docs):
    with pytest.raises(ValueError):
        substring_dedup(docs, 1)
