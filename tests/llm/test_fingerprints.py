import hashlib

import numpy as np

from tandem.llm import fingerprints as fp
from tandem.llm import kernels as K


def sketch(text):
    return fp.sketches(K.Texts.of([text.encode()]))[0]


def test_edits(docs, rows):
    texts = sorted((i, t or "") for i, t, *_ in rows)
    got = {r.doc_id: r for r in fp.edits(docs).collect()}
    assert len(got) == len(texts)
    for j, (i, t) in enumerate(texts):
        after = texts[(j + 1) % len(texts)][1]
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        r = got[i]
        assert r.n_chars == len(t)
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        a, b, c = sketch(t), sketch(edited), sketch(after)
        assert (r.fingerprint, r.edited_fingerprint) == (fp.as_text(a), fp.as_text(b))
        assert (r.near_edited, r.near_next) == (fp.likeness(a, b), fp.likeness(a, c))
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1


def test_estimates():
    r = np.random.default_rng(1)
    w = [f"x{v}" for v in r.integers(0, 10**9, 40_000)]
    long, part = sketch(" ".join(w)), sketch(" ".join(w[1000:9000]))
    assert abs(fp.containment(part, long) - 1) < 0.02
    assert abs(fp.likeness(part, long) - 0.2) < 0.03
    assert (fp.from_text(fp.as_text(part)) == part).all()


def test_merge_is_the_fingerprint_of_both():
    for a, b in (("a b c d e f g h", "p q r s t u v"), ("one", "two"), (" ".join(map(str, range(300))), "x")):
        h = [K.shingles(K.Texts.of([t.encode()]))[0] for t in (a, b)]
        both = np.union1d(*h)
        under = both[both <= fp._under(fp.SCALE)]
        assert (fp.merge(sketch(a), sketch(b)) == (under if len(under) else both[:1])).all()


def test_columns_and_functions(docs, rows):
    got = {r.doc_id: r.fingerprint for r in fp.fingerprints(docs).collect()}
    for i, t, *_ in rows:
        assert got[i] == K.signed(sketch(t or "")).tolist()


def test_single_and_odd(spark, odd, none):
    one = fp.edits(spark.createDataFrame([(5, "abcd ef")], "doc_id long, text string")).collect()
    assert len(one) == 1 and one[0].edited_sha256 == hashlib.sha256(b"abcdabc").hexdigest()
    assert sorted(r.doc_id for r in fp.edits(odd).collect()) == [1, 2, 3]
    assert fp.edits(none).count() == 0


def test_estimates_of_short_texts():
    """Texts of 50 to 250 words against themselves with the end replaced, held against the exact similarity."""
    r = np.random.default_rng(2)
    off = []
    for n in r.integers(50, 251, 400).tolist():
        w = [f"x{v}" for v in r.integers(0, 10**9, 2 * n)]
        a, b = " ".join(w[:n]), " ".join(w[: n // 2] + w[n : 2 * n - n // 2])
        x, y = (K.shingles(K.Texts.of([t.encode()]))[0] for t in (a, b))
        off.append(abs(fp.likeness(sketch(a), sketch(b)) - fp.likeness(x, y)))
    assert np.mean(off) < 0.04 and max(off) < 0.2
