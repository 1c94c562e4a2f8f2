"""Column functions on repeat structures, reads and k-mers; built-in functions only, so all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ambiguity codes and the bases they stand for (fixed values).
IUPAC = {
    "R": "AG", "Y": "CT", "S": "GC", "W": "AT", "K": "GT", "M": "AC",
    "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT",
}


def structure_units(structure: Column) -> Column:
    """The units of a pattern like ``(CAG)*CAACAG(CCG)+``."""
    return F.regexp_extract_all(structure, F.lit(r"\(([A-Z]+)\)[*+]"), F.lit(1))


def structure_skippable(structure: Column) -> Column:
    """Which units may be absent: those with a star."""
    return F.transform(F.regexp_extract_all(structure, F.lit(r"\([A-Z]+\)([*+])"), F.lit(1)), lambda x: x == "*")


def structure_breaks(structure: Column) -> Column:
    """What stands before, between and after units; one more than units, empty where nothing does."""
    marked = F.regexp_replace(structure, r"\([A-Z]+\)[*+]", "|")
    return F.split(marked, r"\|", -1)


def region_chrom(region: Column) -> Column:
    return F.regexp_extract(region, r"^(.+):(\d+)-(\d+)$", 1)


def region_start(region: Column) -> Column:
    return F.regexp_extract(region, r"^(.+):(\d+)-(\d+)$", 2).cast("long")


def region_end(region: Column) -> Column:
    return F.regexp_extract(region, r"^(.+):(\d+)-(\d+)$", 3).cast("long")


def iupac_pattern(unit: Column) -> Column:
    """A regular expression for a unit: each ambiguity code as a class of bases."""
    out = unit
    for code, bases in IUPAC.items():
        # a class written with letters that aren't codes, so that later steps leave it alone
        out = F.regexp_replace(out, code, f"[{bases.lower()}]")
    return F.upper(out)


def repeat_count(sequence: Column, unit: Column) -> Column:
    """Units in the longest run at the sequence's start."""
    run = F.regexp_substr(sequence, F.concat(F.lit("^(?:"), iupac_pattern(unit), F.lit(")*")))
    return (F.coalesce(F.length(run), F.lit(0)) / F.length(unit)).cast("int")


def run_starts(items: Column) -> Column:
    """Positions (from 0) at which a run of equal items begins."""
    at = F.sequence(F.lit(0), F.size(items) - 1)
    return F.filter(at, lambda i: (i == 0) | (F.get(items, i) != F.get(items, i - 1)))


def contract_runs(items: Column) -> Column:
    """``[CAG, CAG, CAA]`` as ``2(CAG)-1(CAA)``; an empty array as an empty text.  One pass, however long the runs."""
    starts = run_starts(items)
    ends = F.concat(F.slice(starts, 2, F.greatest(F.size(starts) - 1, F.lit(0))), F.array(F.size(items)))
    runs = F.zip_with(starts, ends, lambda a, b: F.concat((b - a).cast("string"), F.lit("("), F.get(items, a), F.lit(")")))
    return F.when(F.size(items) == 0, F.lit("")).otherwise(F.array_join(runs, "-"))


def kmers(sequence: Column, k: int) -> Column:
    """All substrings of length ``k``; none of a shorter sequence.  One pass of a pattern that looks ahead."""
    return F.regexp_extract_all(sequence, F.lit(f"(?=(.{{{k}}}))"), F.lit(1))


def pieces(sequence: Column, size: int) -> Column:
    """The sequence cut in pieces of ``size``, without what is left over."""
    return F.regexp_extract_all(sequence, F.lit(f".{{{size}}}"), F.lit(0))


def mean_quality(qualities: Column) -> Column:
    """Mean of the qualities, 0 of none."""
    return F.when(F.size(qualities) == 0, F.lit(0.0)).otherwise(F.aggregate(qualities, F.lit(0).cast("long"), lambda a, x: a + x) / F.size(qualities))


def q10_quality(qualities: Column) -> Column:
    """The 10 % quantile, interpolated and cut to a whole number; 0 of none."""
    s, at = F.array_sort(qualities), 0.1 * (F.size(qualities) - 1)
    low = F.floor(at)
    a, b = F.get(s, low.cast("int")), F.coalesce(F.get(s, low.cast("int") + 1), F.get(s, low.cast("int")))
    return F.when(F.size(qualities) == 0, F.lit(0)).otherwise((a + (b - a) * (at - low)).cast("int"))


def mod_percent(encoded: Column) -> Column:
    """The largest methylation in per cent of an encoded k-mer; null if no base has a call, 0 of none."""
    values = F.transform(F.filter(F.split(encoded, ""), lambda c: c != ""), lambda c: (F.ascii(c) - 33) * 10)
    return F.when(F.length(encoded) == 0, F.lit(0)).otherwise(F.array_max(F.filter(values, lambda v: v.between(0, 100))))


def mean_of_quality_text(text: Column) -> Column:
    """Mean of qualities written as characters from ``!``; 0 of none."""
    values = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c) - 33)
    return mean_quality(values)


def quality_text(qualities: Column) -> Column:
    return F.array_join(F.transform(qualities, lambda q: F.chr(F.greatest(q, F.lit(0)) + 33)), "")


def let(value: Column, f) -> Column:
    """``f`` of a value that is made once: the expression stands in the plan once, however often ``f`` uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def trim(values: Column, left: Column, right: Column) -> Column:
    """An array without ``left`` items at its start and ``right`` at its end."""
    return F.slice(values, left + 1, F.greatest(F.size(values) - left - right, F.lit(0)))


def trim_text(text: Column, left: Column, right: Column) -> Column:
    return F.substring(text, left + 1, F.greatest(F.length(text) - left - right, F.lit(0)))


def low_quality_trim(qualities: Column, window: int = 10, least: int = 17, most: int = 50) -> tuple[Column, Column]:
    """How many bases to cut at the start and the end: up to the first window of good bases, nothing if none is within ``most``.

    A window at the end leaves out the bases cut so far and one more, so the last base is never part of it.
    """
    ends = let(qualities, lambda q: low_quality_ends(q, window, least, most))
    return ends["left"], ends["right"]


def low_quality_ends(qualities: Column, window: int = 10, least: int = 17, most: int = 50) -> Column:
    """:func:`low_quality_trim` as a struct (left, right)."""
    n = F.size(qualities)
    at = F.sequence(F.lit(0), F.lit(most - 1))
    good = lambda part: F.when(F.size(part) > 0, F.array_min(part) >= least).otherwise(F.lit(False))
    start = F.filter(at, lambda i: good(F.slice(qualities, i + 1, F.lit(window))))

    def before(j):
        last = n - j - 1  # items before it
        first = F.greatest(last - window, F.lit(0))
        return F.slice(qualities, first + 1, F.greatest(last - first, F.lit(0)))

    end = F.filter(at, lambda j: good(before(j)))
    first = lambda places: F.when(n > 0, F.coalesce(F.get(places, F.lit(0)), F.lit(0))).otherwise(0)

    def both(cut):
        some = cut["left"] + cut["right"] < n
        return F.struct(F.when(some, cut["left"]).otherwise(0).alias("left"), F.when(some, cut["right"]).otherwise(0).alias("right"))

    return let(F.struct(first(start).alias("left"), first(end).alias("right")), both)


def compare_pair(a: Column, kind_a: Column, b: Column, kind_b: Column) -> tuple[Column, Column]:
    """Two sequences cut so that they cover the same part: prefixes of what is open to the right, suffixes of what is open to the left."""
    n = F.least(F.length(a), F.length(b))

    def cut(s, own, other):
        head, tail = F.substring(s, F.lit(1), n), F.substring(s, F.length(s) - n + 1, n)
        side = F.when(own == "left_flanking", "l").when(own == "right_flanking", "r").otherwise(F.when(other == "left_flanking", "l").when(other == "right_flanking", "r").otherwise("-"))
        return F.when(side == "l", head).when(side == "r", tail).otherwise(s)

    return cut(a, kind_a, kind_b), cut(b, kind_b, kind_a)


def ref_divergence(operations: Column, longest_unit: Column) -> Column:
    """Share of differing positions in a string of operations, without the indels (at most a unit of them) at its two ends."""
    pattern = F.concat(F.lit("^[ID]{1,"), longest_unit.cast("string"), F.lit("}|[ID]{1,"), longest_unit.cast("string"), F.lit("}$"))
    s = F.regexp_replace(operations, pattern, F.lit(""))
    return F.when(F.length(s) == 0, F.lit(0.0)).otherwise(F.length(F.translate(s, "M=", "")) / F.length(s))


def levenshtein_share(a: Column, b: Column) -> Column:
    """Edit distance by the longer length; 0 of two empty sequences."""
    n = F.greatest(F.length(a), F.length(b))
    return F.when(n == 0, F.lit(0.0)).otherwise(F.levenshtein(a, b) / n)
