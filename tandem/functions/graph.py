"""The repeat graph of a locus, for export: nodes with their bases and directed edges, as GFA text."""

from __future__ import annotations

import re

from tandem.config import Config
from tandem.functions.alignment import IUPAC


def _parts(i: int, unit: str) -> list[list[tuple[str, str]]]:
    """The unit's nodes one after another, each a list of alternatives (name, bases); an ambiguity code has one a base."""
    parts = re.findall(f"[{''.join(IUPAC)}]|[^{''.join(IUPAC)}]+", unit)
    if len(parts) == 1 and parts[0] not in IUPAC:
        return [[(f"satellite_{i}", unit)]]
    names = [f"{'sub_' if j else ''}satellite_{i}_{j}" for j in range(len(parts))]
    return [[(f"{n}_{b}", b) for b in IUPAC[p]] if p in IUPAC else [(n, p)] for n, p in zip(names, parts, strict=True)]


def repeat_graph(left: str, right: str, units: list[str], skippable: list[bool], breaks: list[str], overlap: int = Config.min_anchor_overlap) -> tuple[list[tuple[str, str]], list[tuple[str, str]]]:
    """Nodes (name, bases) and edges (from, to): anchors at both ends, breaks, and units that lead back to themselves.

    The ``overlap`` bases of an anchor next to the repeat are a node of their own.  Whatever can come before a unit that may be
    skipped can come before what follows it, too.
    """
    nodes: list[tuple[str, str]] = []
    edges: list[tuple[str, str]] = []

    def step(before: list[str], options: list[tuple[str, str]]) -> list[str]:
        nodes.extend(options)
        edges.extend((a, name) for name, _ in options for a in before)
        return [name for name, _ in options]

    cut = max(len(left) - overlap, 0)
    ends = step(step([], [("left_anchor", left[:cut])]), [("left_anchor_overlap", left[cut:])])
    for i, broken in enumerate(breaks):
        if broken:
            ends = step(ends, [(f"break_{i}", broken)])
        if i < len(units):
            parts = _parts(i, units[i])
            entry = at = step(ends, parts[0])
            for options in parts[1:]:
                at = step(at, options)
            edges.extend((a, b) for a in at for b in entry)
            ends = ends + at if skippable[i] else at
    step(step(ends, [("right_anchor_overlap", right[:overlap])]), [("right_anchor", right[overlap:])])
    return nodes, edges


def gfa(left: str, right: str, units: list[str], skippable: list[bool], breaks: list[str], overlap: int = Config.min_anchor_overlap) -> str:
    """The graph as GFA: a line a node, then a line an edge, all forward and without overlap."""
    nodes, edges = repeat_graph(left, right, units, skippable, breaks, overlap)
    return "".join([f"S\t{name}\t{bases}\n" for name, bases in nodes] + [f"L\t{a}\t+\t{b}\t+\t0M\n" for a, b in edges])
