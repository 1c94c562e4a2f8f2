"""Cuts UTF-8 texts into the pre-tokens of byte-level tokenizers, a block of texts at a time.

The pieces are those of the pattern

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

They cover a text without gaps, so their first bytes say everything.  A piece starts where the class of characters changes
(white space, letter, number, other), with three corrections: one U+0020 before a run that isn't white space belongs to that
run; the last character of white space before something else is a piece of its own if it isn't U+0020; and a lone
apostrophe takes the letters of an English ending along.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pandas as pd

from tandem.llm import kernels as K

SPACE, LETTER, NUMBER, OTHER = range(4)
#: Fixed values of the pattern.
ENDINGS = (b"s", b"t", b"re", b"ve", b"m", b"ll", b"d")


#: Code points that can be white space, letters or numbers: planes 4 to 13 have no characters, 15 and 16 are for private use.
_RANGES = ((0, 0xD800), (0xE000, 0x40000), (0xE0000, 0xE1000))
#: Characters that the library is asked about at once: it takes longer a character the longer the text.
_ASK = 4096


def _all_text() -> list[str]:
    return [np.arange(i, min(i + _ASK, b), dtype="<u4").tobytes().decode("utf-32-le") for a, b in _RANGES for i in range(a, b, _ASK)]


def _by_tiktoken(pattern: str) -> str:
    """All characters that the pattern matches, as tiktoken's engine sees it."""
    import tiktoken

    own = tiktoken.Encoding("classes", pat_str=pattern, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
    return "".join(bytes(own.encode_ordinary(text)).decode() for text in _all_text())


def _by_tokenizers(pattern: str) -> str:
    from tokenizers import Regex, pre_tokenizers

    split = pre_tokenizers.Split(Regex(pattern), behavior="removed", invert=True)
    return "".join(piece for text in _all_text() for piece, _ in split.pre_tokenize_str(text))


@cache
def _classes(engine: str) -> np.ndarray:
    """The class of every code point, asked of the library's own engine: libraries know different versions of Unicode."""
    ask = {"tiktoken": _by_tiktoken, "tokenizers": _by_tokenizers}[engine]
    out = np.full(0x110000, OTHER, dtype=np.uint8)
    for pattern, kind in ((r"\s", SPACE), (r"\p{L}", LETTER), (r"\p{N}", NUMBER)):
        out[np.frombuffer(ask(pattern).encode("utf-32-le"), dtype=np.uint32)] = kind
    return out


def piece_starts(texts: K.Texts, engine: str) -> tuple[np.ndarray, np.ndarray]:
    """The first byte of each piece, and per text the index of its first piece; ``engine``: tiktoken or tokenizers."""
    data, n = texts.data, len(texts.data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
    cls = _classes(engine)[:256][data]
    lead = None
    wide = data >= 0x80
    if wide.any():
        lead = np.where((data & 0xC0) != 0x80, np.arange(n), 0)
        np.maximum.accumulate(lead, out=lead)
        at = np.flatnonzero(data >= 0xC0)
        byte = np.zeros(n + 3, dtype=np.int32)
        byte[:n] = data
        b0, b1, b2, b3 = byte[at], byte[at + 1] & 63, byte[at + 2] & 63, byte[at + 3] & 63
        code = np.where(b0 < 0xE0, (b0 & 31) << 6 | b1, np.where(b0 < 0xF0, (b0 & 15) << 12 | b1 << 6 | b2, (b0 & 7) << 18 | b1 << 12 | b2 << 6 | b3))
        cls[at] = _classes(engine)[np.minimum(code, 0x10FFFF)]
        cls = cls[lead]
    cut = np.ones(n, dtype=bool)
    cut[1:] = cls[1:] != cls[:-1]
    edges = texts.offsets[:-1][np.diff(texts.offsets) > 0]
    cut[edges] = True
    new_text = np.zeros(n + 1, dtype=bool)
    new_text[edges] = True
    new_text[n] = True
    run = np.flatnonzero(cut)
    after = run[1:]  # runs that follow another
    joined = after[(cls[after] != SPACE) & (cls[after - 1] == SPACE) & ~new_text[after]]
    start = cut.copy()
    blank = joined[data[joined - 1] == 0x20]
    start[blank] = False
    start[blank - 1] = True
    odd = joined[data[joined - 1] != 0x20] - 1
    start[odd if lead is None else lead[odd]] = True
    apostrophe = np.flatnonzero((data == 0x27) & start)
    apostrophe = apostrophe[apostrophe + 1 < n]
    apostrophe = apostrophe[(cls[apostrophe + 1] == LETTER) & ~new_text[apostrophe + 1]]
    if len(apostrophe):
        padded = np.concatenate([data, np.zeros(4, np.uint8)])
        done = np.zeros(len(apostrophe), dtype=bool)
        for ending in ENDINGS:
            fits = ~done
            for j, c in enumerate(ending):
                fits &= (padded[apostrophe + 1 + j] == c) & ~new_text[np.minimum(apostrophe + 1 + j, n)]
            done |= fits
            at = apostrophe[fits]
            start[at + 1] = False
            rest = at + 1 + len(ending)
            inside = rest[rest < n]
            start[inside[(cls[inside] == LETTER) & ~new_text[inside]]] = True
    starts = np.flatnonzero(start)
    return starts, np.searchsorted(starts, texts.offsets)


def distinct_pieces(texts: K.Texts, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each piece its number among the distinct ones, and for each distinct one the index of a piece."""
    ends = np.append(starts[1:], len(texts.data))
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = K.hash_spans(texts.data, starts, ends)
    code, seen = pd.factorize(h)
    rep = np.empty(len(seen), dtype=np.int64)
    rep[code[::-1]] = np.arange(len(code))[::-1]
    size = ends - starts
    padded = np.concatenate([texts.data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(texts.data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    head = eight[starts] & K._MASK[np.minimum(size, 8)]
    if (size != size[rep][code]).any() or (head != head[rep][code]).any():  # two pieces of one hash
        number: dict[bytes, int] = {}
        raw = texts.data.tobytes()
        code = np.array([number.setdefault(raw[a:b], len(number)) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
        rep = np.empty(len(number), dtype=np.int64)
        rep[code[::-1]] = np.arange(len(code))[::-1]
    return code, rep
