import io

import numpy as np
import pytest

from tandem.llm.sst_output import Reader, Writer, id_of, key_of, look_up, read_shards, token_table, write_shards

P = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")
PATH = P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    t = tokenizers.Tokenizer.from_file(PATH)
    return lambda text: t.encode(text, add_special_tokens=False).ids


def test_whole_table(docs, rows, library):
    got = {r.doc_id: r for r in token_table(docs, PATH, end_id=2).collect()}
    at = 0
    for i, t in sorted((i, t or "") for i, t, *_ in rows):
        assert got[i].ids == [*library(t), 2]
        assert got[i].start == at
        at += len(got[i].ids)
    assert len(got) == len(rows)


def test_mixed_characters(spark, library):
    texts = ["it's  we'll\n\n x", "<|endoftext|>", "hello <|endoftext|> world<|endoftext|><|endoftext|>\n", "<|endoftext| >", "ünïcödé 中文 🎉  　 a", "١٢٣ ½", "'s's '", "\t\t\n "]
    got = {r.doc_id: r.ids for r in token_table(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), PATH).collect()}
    assert got == {i: [*library(t), 2] for i, t in enumerate(texts)}


def test_lookup(docs, rows, library, tmp_path):
    manifest = write_shards(docs, f"file://{tmp_path}/out", PATH)
    listed = [r.asDict() for r in manifest.orderBy("shard").collect()]
    assert len(listed) > 1 or len(rows) <= 500
    for i, t, *_ in rows[::7]:
        assert look_up(listed, i).tolist() == [*library(t or ""), 2]
    assert look_up(listed, 10**9) is None
    assert read_shards(manifest).count() == len(rows)


def test_file_format():
    r = np.random.default_rng(0)
    docs = [(int(i), r.integers(0, 50_000, r.integers(0, 3000))) for i in np.unique(r.integers(-(2**62), 2**62, 400))]
    f = io.BytesIO()
    w = Writer(f, 2, 2)
    for i, ids in docs:
        w.add(i, ids)
    with pytest.raises(ValueError):
        w.add(docs[0][0], docs[0][1])
    w.close()
    reader = Reader(f)
    assert len(reader.index) > 3
    assert [(i, x.tolist()) for i, x in reader] == [(i, x.tolist()) for i, x in docs]
    for i, x in docs[::17]:
        assert reader.get(i).tolist() == x.tolist()
    assert reader.get(12345) is None
    f.seek(0)
    with pytest.raises(ValueError):
        Reader(io.BytesIO(f.read()[:-1] + b"?"))


def test_keys_sort_like_ids():
    ids = [-(2**63), -5, -1, 0, 1, 77, 2**63 - 1]
    assert sorted(map(key_of, ids)) == list(map(key_of, ids))
    assert [id_of(key_of(i)) for i in ids] == ids


def test_odd_rows(odd, none):
    assert sorted(r.doc_id for r in token_table(odd, PATH).collect()) == [1, 2, 3]
    assert token_table(none, PATH).count() == 0
