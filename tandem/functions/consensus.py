"""Consensus of k-mer sequences: alignment to one of them, then a vote in each column."""

from __future__ import annotations

import numpy as np

GAP = -1


def _align(centre: np.ndarray, seq: np.ndarray, free_start: bool, free_end: bool) -> list[tuple[str, int, int]]:
    """Steps (=, I, D; place in the centre; place in seq) of a least-edit alignment; free ends of the centre cost nothing."""
    n, m = len(centre), len(seq)
    at = np.arange(n + 1)
    d = np.empty((m + 1, n + 1), dtype=np.int32)
    d[0] = 0 if free_start else at
    for i in range(1, m + 1):
        row = d[i - 1] + 1
        row[1:] = np.minimum(row[1:], d[i - 1, :-1] + (centre != seq[i - 1]))
        d[i] = np.minimum.accumulate(row - at) + at
    i, j = m, n
    if free_end:
        j = int(np.argmin(d[m]))
    steps = []
    while i or (j and not free_start):
        if i and j and d[i, j] == d[i - 1, j - 1] + (centre[j - 1] != seq[i - 1]):
            i, j = i - 1, j - 1
            steps.append(("=", j, i))
        elif j and d[i, j] == d[i, j - 1] + 1:
            j -= 1
            steps.append(("D", j, -1))
        else:
            i -= 1
            steps.append(("I", j, i))
    return steps[::-1]


def majority_consensus(sequences: list[tuple[str, tuple[str, ...], int]]) -> tuple[str, ...]:
    """The consensus of (kind, k-mers, reads) sequences: spanning ones whole, flanking ones open at one end.

    Open ends don't vote.  Of equally frequent symbols the one seen first wins, spanning before left before right.
    """
    order = {"spanning": 0, "left_flanking": 1, "right_flanking": 2}
    sequences = sorted((s for s in sequences if s[1]), key=lambda s: (order[s[0]], -s[2], s[1]))
    if not sequences:
        return ()
    names = sorted({k for _, kmers, _ in sequences for k in kmers})
    code = {k: i for i, k in enumerate(names)}
    coded = [(kind, np.array([code[k] for k in kmers]), n) for kind, kmers, n in sequences]
    first = sequences[0][0]
    pool = [c for c in coded if c[0] == first]
    # the commonest spanning sequence, or the longest flanking one, which covers the others
    centre = max(pool, key=lambda c: (c[2], len(c[1])) if first == "spanning" else (len(c[1]), c[2]))[1]
    n = len(centre)
    votes: list[dict[int, int]] = [{} for _ in range(n)]
    inserted: list[list[tuple[list[int], int]]] = [[] for _ in range(n + 1)]
    for kind, seq, weight in coded:
        steps = _align(centre, seq, kind == "right_flanking", kind == "left_flanking")
        here: dict[int, list[int]] = {}
        covered = []
        for op, j, i in steps:
            if op == "I":
                here.setdefault(j, []).append(int(seq[i]))
                continue
            covered.append(j)
            symbol = int(seq[i]) if op == "=" else GAP
            votes[j][symbol] = votes[j].get(symbol, 0) + weight
        low = 0 if kind != "right_flanking" else (covered[0] + 1 if covered else n)
        high = n if kind != "left_flanking" else (covered[-1] if covered else 0)
        for g in range(low, high + 1):
            inserted[g].append((here.get(g, []), weight))
    out: list[int] = []
    for g in range(n + 1):
        depth = max((len(x) for x, _ in inserted[g]), default=0)
        for t in range(depth):
            tally: dict[int, int] = {}
            for x, w in inserted[g]:
                s = x[t] if t < len(x) else GAP
                tally[s] = tally.get(s, 0) + w
            out.append(max(tally, key=tally.__getitem__))
        if g < n and votes[g]:
            out.append(max(votes[g], key=votes[g].__getitem__))
    return tuple(names[s] for s in out if s != GAP)


def haplotype_consensus(sequences: list[tuple[str, tuple[str, ...], int]]) -> list[tuple[str, tuple[str, ...]]]:
    """(kind, k-mers) of the consensus: one if any read spans, else one for each side that has reads.

    The outermost k-mer at a flanking read's open end is left out, since it may be cut.
    """
    cut = [(kind, kmers[:-1] if kind == "left_flanking" else kmers[1:] if kind == "right_flanking" else kmers, n) for kind, kmers, n in sequences]
    if any(kind == "spanning" for kind, _, _ in cut):
        return [("spanning", majority_consensus(cut))]
    return [(kind, majority_consensus([c for c in cut if c[0] == kind])) for kind in ("left_flanking", "right_flanking") if any(c[0] == kind and c[1] for c in cut)]
