import base64
import random

import numpy as np
import pytest

from tandem.llm import kernels as K
from tandem.llm.byte_bpe import PerfectHash, Vocabulary, decode, encode, vocabulary

P = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")
PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_equals_the_library(library):
    r = random.Random(2)
    letters = "  \n\t\r'''sstrevemlldSTaé1²½! 　 \x85\x1c中文́🎉.  ​"
    texts = ["".join(r.choice(letters) for _ in range(r.randrange(40))) for _ in range(4000)] + ["a" * 3000, "<|endoftext|>", "x" + " " * 50 + "y"]
    ids, first = vocabulary(PATH).encode(K.Texts.of([t.encode() for t in texts]))
    assert [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:])] == [library.encode_ordinary(t) for t in texts]


def test_misses_in_use_are_merged_once(library, monkeypatch):
    """A full cache gives up what hasn't been used since it was last full, not what every block holds."""
    monkeypatch.setattr("tandem.llm.byte_bpe.CACHE", 3)
    own, calls = Vocabulary(PATH), []
    merge = own.merge
    monkeypatch.setattr(own, "merge", lambda *a: calls.append(1) or merge(*a))
    texts = [f"thexqzv kwzj{c}qxv" for c in "abcdefgh"]
    for text in texts:
        ids, _ = own.encode(K.Texts.of([text.encode()]))
        assert ids.tolist() == library.encode_ordinary(text)
    assert len(calls) == 1 + len(texts)


def test_round_trip(docs, rows, library):
    got = {r.doc_id: r for r in decode(encode(docs, PATH), PATH).collect()}
    for i, text, *_ in rows:
        assert got[i].ids == library.encode_ordinary(text or "")
        assert bytes(got[i].decoded) == (text or "").encode()


def test_odd_rows(odd, none):
    assert decode(encode(odd, PATH), PATH).count() == 6
    assert encode(none, PATH).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 7, 1000])
def test_perfect_hash(n):
    keys = K.mix(np.arange(n, dtype=np.uint64) * np.uint64(77) + np.uint64(5))
    table = PerfectHash(keys)
    assert table.find(keys).tolist() == list(range(n))
    assert sorted(table.slot_item[:n].tolist()) == list(range(n))
    assert (table.find(K.mix(np.arange(10**6, 10**6 + 500, dtype=np.uint64))) == -1).all()


def test_unknown_ids(spark):
    with pytest.raises(Exception, match="not in the vocabulary"):
        decode(spark.createDataFrame([(1, [10**6])], "doc_id long, ids array<int>"), PATH).collect()
