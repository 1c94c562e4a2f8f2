import random

import numpy as np

from tandem.llm import kernels as K
from tandem.llm.line_dedup import CHARS, deduped, line_dedup, lines_of, seeds, signatures
from tandem.llm.line_dedup import shingles as shingle_hashes


def shingles(line):
    s = line.strip()
    return {s[i : i + CHARS] for i in range(max(1, len(s) - CHARS + 1))}


def brute(rows, percent=80):
    places, first = [], {}
    for i, t in sorted(rows):
        for j, line in enumerate((t or "").split("\n") if t is not None else []):
            if line.strip():
                places.append((i, j, line.strip()))
                first.setdefault(line.strip(), (i, j))
    lines = sorted(first, key=first.get)
    up = {x: x for x in lines}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    sets = {x: shingles(x) for x in lines}
    for k, a in enumerate(lines):
        for b in lines[k + 1 :]:
            n = len(sets[a] & sets[b])
            if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                x, y = sorted((root(a), root(b)), key=first.get)
                up[y] = x
    stay = {first[root(x)] for x in lines}
    out = {}
    for i, t in rows:
        out[i] = t if t is None else "\n".join(line for j, line in enumerate(t.split("\n")) if not line.strip() or (i, j) in stay)
    return out


def corpus():
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 9)))
    base = [" ".join(word() for _ in range(r.randrange(1, 40))) for _ in range(60)]
    rows = []
    for i in range(50):
        lines = []
        for _ in range(r.randrange(0, 12)):
            line = r.choice(base)
            if r.random() < 0.4:
                w = line.split(" ")
                w[r.randrange(len(w))] = word()
                line = " ".join(w)
            lines.append(r.choice(["", "  ", "\t"]) + line + r.choice(["", " ", "\r"]))
            if r.random() < 0.2:
                lines.append(r.choice(["", "   "]))
        rows.append((i * 7 % 53, "\n".join(lines)))
    unspaced = ["".join(r.choice("天地玄黄宇宙洪荒日月盈昃😀") for _ in range(r.randrange(5, 150))) for _ in range(12)]
    unspaced += [f"https://example.org/{word()}/{word()}?q={word()}" for _ in range(12)]
    for i in range(100, 130):
        t = list(r.choice(unspaced))
        for _ in range(r.randrange(0, 3)):
            t[r.randrange(len(t))] = r.choice("xyz日")
        rows.append((i, "".join(t)))
    return rows + [(90, None), (91, ""), (92, "\n\n"), (93, "é ü ß\né ü ß"), (94, " ".join(word() for _ in range(3000)))]


def test_equals_brute_force(spark):
    """Nothing goes that exact comparison of all pairs keeps; of what it takes out, banding may miss one line in a hundred."""
    rows = corpus()
    got = {r.doc_id: r.text for r in line_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    want = brute(rows)
    gone = missed = 0
    for i, t in rows:
        if t is None:
            assert got[i] is None
            continue
        mine, right = got[i].split("\n"), want[i].split("\n")
        gone += len(t.split("\n")) - len(right)
        left = iter(mine)
        assert all(any(x == y for y in left) for x in right if x), (i, mine, right)
        missed += len([x for x in mine if x.strip()]) - len([x for x in right if x.strip()])
    assert gone > 100 and missed <= gone / 100


def test_counts(spark):
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in line_dedup(spark.createDataFrame([(1, "a b c d\n\nx"), (0, "x\nx\ny"), (2, "y")], "doc_id long, text string")).collect()}
    assert got == {0: ("x\ny", 3, 1), 1: ("a b c d\n", 3, 1), 2: ("", 1, 1)}


def test_lines_and_shingles():
    r = random.Random(2)
    texts = ["", "\n", "a", " a \n\n\tb\r\n", "\n\nx\n", "日本語のテキスト、長い行です\n😀 y", "".join(r.choice("ab \n日😀") for _ in range(4000))]
    row, at, start, end = lines_of(K.Texts.of([t.encode() for t in texts]))
    data = "".join(texts).encode()
    got = [(i, j, data[a:b].decode()) for i, j, a, b in zip(row.tolist(), at.tolist(), start.tolist(), end.tolist(), strict=True)]
    want = [(i, j, line.strip(" \t\n\r\x0b\x0c")) for i, t in enumerate(texts) for j, line in enumerate(t.split("\n"))]
    assert got == [x for x in want if x[2]]
    h, first = shingle_hashes(np.frombuffer(data, dtype=np.uint8), start, end)
    names, hashes = {}, {}
    for k, (_, _, line) in enumerate(got):
        pieces = [line[i : i + CHARS] for i in range(max(1, len(line) - CHARS + 1))]
        own = h[first[k] : first[k + 1]].tolist()
        assert len(pieces) == len(own)
        for p, x in zip(pieces, own, strict=True):
            assert names.setdefault(x, p) == p and hashes.setdefault(p, x) == x


def test_signatures_estimate_similarity():
    r = random.Random(6)
    lines = ["abc", "abc", "日本", "".join(r.choice("abcdefg 日é") for _ in range(300))]
    lines += [lines[3][:150] + "".join(r.choice("xyz") for _ in range(150)), "".join(r.choice("stuvw") for _ in range(9))]
    raw = [x.encode() for x in lines]
    cut = np.concatenate([[0], np.cumsum([len(x) + 1 for x in raw])])
    order = np.array([3, 0, 5, 1, 4, 2])  # lines in any order
    m = signatures(np.frombuffer(b"\n".join(raw), dtype=np.uint8), cut[:-1][order], (cut[1:] - 1)[order], seeds(400))
    same = lambda a, b: (m[:, order.tolist().index(a)] == m[:, order.tolist().index(b)]).mean()
    for a in range(6):
        for b in range(a):
            x, y = shingles(lines[a]), shingles(lines[b])
            assert abs(same(a, b) - len(x & y) / len(x | y)) < 0.08


def test_odd_rows(odd, none):
    out = deduped(odd)
    assert out.columns == odd.columns
    got = sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in out.collect())
    assert got == [(False, 1, "a b c"), (False, 1, "a b c"), (False, 2, ""), (False, 2, "d e f"), (False, 3, ""), (True, 0, "a b c")]
    assert deduped(none).count() == 0


def test_long_words_count_whole(spark):
    """Words and unspaced lines that are equal in their first characters only stay; those alike all along go."""
    long = "".join(chr(0x4E00 + 37 * i) for i in range(60))
    rows = [(0, "https://example.org/a"), (1, "https://example.org/zzz"), (2, "Andththwhwh."), (3, "Andththwhes."), (4, long), (5, long[:9] + long[:8:-1]), (6, long + "x"), (7, "see " + "0123456789" * 4), (8, "see " + "012345678" + "f" * 31)]
    got = {r.doc_id: r.text for r in line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: "" if i == 6 else t for i, t in rows}
