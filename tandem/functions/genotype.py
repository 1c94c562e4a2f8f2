"""The genotype model of one locus: discrete normal counts, one or two haplotypes.

A read's counts are a vector with one number a repeat unit.  Reads that span the locus show whole counts; flanking reads show
lower bounds.  Equal reads are one *observation* with a weight, so a locus costs what its distinct observations cost, however
deep it is sequenced.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np

from tandem.config import Config
from tandem.functions.numeric import CHI2_95_1, chi2_sf, log_ndtr, root

HALF = math.log(0.5)
#: What an impossible count is worth, and the least distance of two neighbouring tails (both fixed by the model).
IMPOSSIBLE, TAIL = -1000.0, -1e-15


def log_pmf(x: np.ndarray, mean, unit_var, min_sd: float = Config.min_sd) -> np.ndarray:
    """Log mass of whole counts under a normal of variance ``mean * unit_var``: what lies between x - 1/2 and x + 1/2."""
    sd = np.maximum(np.sqrt(np.asarray(mean, float) * unit_var), min_sd)
    z = np.round(x) - mean
    return _between(log_ndtr((z - 0.5) / sd), log_ndtr((z + 0.5) / sd))


def _between(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Log mass between two points from the logarithms of what lies below them."""
    with np.errstate(divide="ignore", invalid="ignore"):
        out = high + np.log1p(-np.exp(np.minimum(low - high, TAIL)))
    return np.where(np.isneginf(out), IMPOSSIBLE, out)


def spanning_log_pmf(x: np.ndarray, mean: np.ndarray, unit_var: np.ndarray, min_sd: float = Config.min_sd) -> np.ndarray:
    """Log mass of each row of counts, units independent."""
    if not x.size:
        return np.zeros(0)
    return log_pmf(x, mean[None, :], unit_var[None, :], min_sd).sum(1)


def cut_log_pmf(x: np.ndarray, mean, unit_var, min_sd: float = Config.min_sd) -> np.ndarray:
    """Log mass of counts at which a flanking read was cut off: flat under the rounded mean, the normal's from there on.

    Masses of neighbouring counts add up to a difference of two tails, so the total takes no sum.
    """
    mean, unit_var = np.asarray(mean, float), np.asarray(unit_var, float)
    split, top = np.round(mean), np.ceil(mean + 5 * np.sqrt(mean * unit_var))
    sd = np.maximum(np.sqrt(mean * unit_var), min_sd)
    at_split = np.exp(log_pmf(split, mean, unit_var, min_sd))
    above = np.exp(log_ndtr((top + 0.5 - mean) / sd)) - np.exp(log_ndtr((split - 0.5 - mean) / sd))
    total = above + at_split * np.maximum(split - 1, 0.0)
    with np.errstate(divide="ignore"):
        return np.where(x >= split, log_pmf(x, mean, unit_var, min_sd) - np.log(total), np.log(at_split / total))


def seen_units(x: np.ndarray, is_left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which units a flanking read counts in full, and in which it was cut: the last it reached, if any."""
    some = x != 0
    reached = np.where(is_left[:, None], np.cumsum(some[:, ::-1], axis=1)[:, ::-1] > 0, np.cumsum(some, axis=1) > 0)
    n = x.shape[1]
    edge = np.where(is_left, n - 1 - np.argmax(some[:, ::-1], axis=1), np.argmax(some, axis=1))
    cut = reached & (np.arange(n)[None, :] == edge[:, None])
    return reached & ~cut, cut


def flanking_log_pmf(x: np.ndarray, mean: np.ndarray, unit_var: np.ndarray, is_left: np.ndarray, min_sd: float = Config.min_sd) -> np.ndarray:
    if not x.size:
        return np.zeros(0)
    full, cut = seen_units(x, np.asarray(is_left, bool))
    out = np.where(full, log_pmf(x, mean[None, :], unit_var[None, :], min_sd), 0.0)
    for d in range(x.shape[1]):
        rows = cut[:, d]
        if rows.any():
            out[rows, d] = cut_log_pmf(x[rows, d], mean[d], unit_var[d], min_sd)
    return out.sum(1)


def expected_largest(x: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Per unit the expected largest count, when row i belongs to the haplotype with probability share[i], each on its own.

    The chance that the largest reaches a level is one less the chance that no row from that level on belongs.
    """
    out = np.zeros(x.shape[1] if x.ndim == 2 else 0)
    for d in range(len(out)):
        levels, at = np.unique(np.maximum(x[:, d], 0), return_inverse=True)
        none = np.ones(len(levels))
        np.multiply.at(none, at, 1 - np.asarray(share, float))
        reached = 1 - np.cumprod(none[::-1])[::-1]
        out[d] = (reached * np.diff(levels, prepend=0)).sum()
    return out


@dataclass
class Observations:
    """Distinct reads of a locus: counts (n x units), kind (0 spanning, 1 left, 2 right) and how many reads each stands for."""

    counts: np.ndarray
    kind: np.ndarray
    weight: np.ndarray
    config: Config = field(default_factory=Config)

    def __post_init__(self):
        self.counts = np.asarray(self.counts, dtype=float)
        self.kind, self.weight = np.asarray(self.kind), np.asarray(self.weight)
        order = np.lexsort((*self.counts.T[::-1], self.kind))
        self.counts, self.kind, self.weight = self.counts[order], self.kind[order], self.weight[order]
        self.spans = self.kind == 0
        self._full, self._cut = seen_units(self.counts, self.kind != 2) if len(self.counts) else (self.counts > 0, self.counts > 0)
        self._full[self.spans], self._cut[self.spans] = True, False
        self._known: dict[tuple[int, float, float], np.ndarray] = {}
        self._some_cut = self._cut.any(0)
        self._distinct = [np.unique(self.counts[:, d], return_inverse=True) for d in range(self.counts.shape[1])]
    def __len__(self) -> int:
        return int(self.weight.sum())

    @property
    def units(self) -> int:
        return self.counts.shape[1]

    def keep(self, mask: np.ndarray) -> Observations:
        return Observations(self.counts[mask], self.kind[mask], self.weight[mask], self.config)

    def unit_mass(self, d: int, mean, unit_var) -> np.ndarray:
        """Log mass of every observation's count of one unit: a row for each of the given means and variances.

        As :func:`log_pmf` and :func:`cut_log_pmf`, with all tails asked for at once.
        """
        mean, unit_var = np.broadcast_arrays(np.atleast_1d(np.asarray(mean, float)), np.atleast_1d(np.asarray(unit_var, float)))
        mean, unit_var = mean[:, None], unit_var[:, None]
        full, cut, (x, at) = self._full[:, d], self._cut[:, d], self._distinct[d]
        n, some = len(x), self._some_cut[d]
        spread = np.sqrt(mean * unit_var)
        edges = [x - 0.5 - mean, x + 0.5 - mean]
        if some:
            split = np.round(mean)
            edges += [split - 0.5 - mean, split + 0.5 - mean, np.ceil(mean + 5 * spread) + 0.5 - mean]
        tails = log_ndtr(np.concatenate(edges, axis=1) / np.maximum(spread, self.config.min_sd))
        whole = _between(tails[:, :n], tails[:, n : 2 * n])
        out = np.where(full, whole[:, at], 0.0)
        if some:
            at_split = np.exp(_between(tails[:, 2 * n : 2 * n + 1], tails[:, 2 * n + 1 : 2 * n + 2]))
            total = np.exp(tails[:, 2 * n + 2 :]) - np.exp(tails[:, 2 * n : 2 * n + 1]) + at_split * np.maximum(split - 1, 0.0)
            with np.errstate(divide="ignore"):
                out[:, cut] = np.where(x >= split, whole - np.log(total), np.log(at_split / total))[:, at[cut]]
        return out

    def one_mass(self, d: int, mean: float, unit_var: float) -> np.ndarray:
        """:meth:`unit_mass` of one mean and variance, kept: neighbours in a search share most of theirs."""
        key = (d, float(mean), float(unit_var))
        if key not in self._known:
            if len(self._known) > 4096:
                self._known.clear()
            self._known[key] = self.unit_mass(d, mean, unit_var)[0]
        return self._known[key]

    def log_mass(self, mean: np.ndarray, unit_var: np.ndarray) -> np.ndarray:
        return sum(self.one_mass(d, mean[d], unit_var[d]) for d in range(self.units))

    def hom_ll(self, mean: np.ndarray, unit_var: np.ndarray) -> float:
        return float(self.weight @ self.log_mass(mean, unit_var))

    def het_ll(self, m1: np.ndarray, m2: np.ndarray, unit_var: np.ndarray) -> float:
        return float(self.weight @ np.logaddexp(HALF + self.log_mass(m1, unit_var), HALF + self.log_mass(m2, unit_var)))

    def shares(self, m1: np.ndarray, m2: np.ndarray, unit_var: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Posterior probabilities of the two haplotypes, equally likely before."""
        a, b = self.log_mass(m1, unit_var), self.log_mass(m2, unit_var)
        total = np.logaddexp(a, b)
        return np.exp(a - total), np.exp(b - total)

    def places(self) -> np.ndarray:
        """Count vectors at which a haplotype may sit: those of spanning reads, of flanking reads that show more of some unit than any
        spanning read, and the largest that flanking reads are expected to show.  Units that a flanking read doesn't
        reach are filled from the others."""
        spanning = self.counts[self.spans]
        flank, n = self.counts[~self.spans], self.weight[~self.spans]
        if len(spanning):
            usual = np.array([x[np.searchsorted(np.cumsum(w), w.sum() / 2)] for x, w in ((np.sort(c), self.weight[self.spans][np.argsort(c, kind="stable")]) for c in spanning.T)])
            flank, n = flank[keep := (flank > spanning.max(0)).any(1)], n[keep]
        else:
            usual = np.maximum(flank.max(0), 1)
        out = [spanning, np.where(flank > 0, flank, usual)]
        if len(flank):
            out.append(np.maximum(np.round(expected_largest(flank, 1 - 0.5**n)), 1)[None, :])
        return np.unique(np.concatenate(out), axis=0)


@dataclass
class Fit:
    """Parameters of a genotype: one mean or two, a common variance a unit, and profile intervals of the means."""

    means: list[np.ndarray]
    unit_var: np.ndarray
    intervals: list[tuple[np.ndarray, np.ndarray]]
    log_lik: float


#: Values of the variance that a search looks at first, then around the best, and how often; places that pairs are made of, pairs
#: that are followed up.
GRID, FINER, TURNS, PLACES, STARTS = 20, 7, 4, 24, 3


class Search:
    """Log masses of a locus's observations at a fixed grid of variances, kept by unit and whole mean."""

    def __init__(self, o: Observations):
        self.o = o
        span = np.ptp(o.counts, axis=0).max() + 1.0
        self.floor = o.config.min_var
        self.grid = np.geomspace(self.floor, max(span * span, 2 * self.floor), GRID)
        self._known: dict[tuple[int, float], np.ndarray] = {}

    def mass(self, d: int, mean: float) -> np.ndarray:
        key = (d, float(mean))
        if key not in self._known:
            self._known[key] = self.o.unit_mass(d, mean, self.grid)
        return self._known[key]

    def var(self, d: int, means: list[float], combine) -> tuple[float, float]:
        """The variance of unit ``d`` of the largest log-likelihood, and that; ``combine`` makes log-likelihoods of the masses at each of
        the means, a row a variance."""
        grid = self.grid
        y = combine(*[self.mass(d, m) for m in means])
        i = int(np.argmax(y))
        found = float(y[i]), float(grid[i])
        if i == 0 and combine(*[self.o.unit_mass(d, m, self.floor * 1.001) for m in means])[0] <= y[0]:
            return found[1], found[0]
        low, high = np.log(grid[max(i - 1, 0)]), np.log(grid[min(i + 1, len(grid) - 1)])
        for _ in range(TURNS):
            x = np.linspace(low, high, FINER)
            y = combine(*[self.o.unit_mass(d, m, np.exp(x)) for m in means])
            i = int(np.argmax(y))
            found = max(found, (float(y[i]), float(np.exp(x[i]))))
            low, high = x[max(i - 1, 0)], x[min(i + 1, FINER - 1)]
        return max(found[1], self.floor), found[0]


def _climb(start: np.ndarray, full, rough) -> tuple[np.ndarray, float, np.ndarray]:
    """From whole numbers to a peak: steps of one in one coordinate, first with the variances held (``rough``), then with those fitted
    (``full``), until no neighbour is better."""
    at = np.asarray(start, float)
    ll, var = full(at)
    known = {tuple(at.tolist()): (ll, var)}
    steps = [s for i in range(len(at)) for s in (np.eye(len(at))[i], -np.eye(len(at))[i])]
    while True:
        held, best = rough(at, var), at
        while True:
            near = [(rough(best + s, var), i) for i, s in enumerate(steps) if (best + s).min() >= 0]
            top, i = max(near, key=lambda x: (x[0], -x[1]))
            if top <= held + 1e-9:
                break
            held, best, leap = top, best + steps[i], 1
            while (best + leap * steps[i]).min() >= 0 and (top := rough(best + leap * steps[i], var)) > held + 1e-9:  # on, ever faster
                held, best, leap = top, best + leap * steps[i], 2 * leap
        candidates = [best] if tuple(best.tolist()) != tuple(at.tolist()) else [at + s for s in steps if (at + s).min() >= 0]
        for m in candidates:
            if tuple(m.tolist()) not in known:
                known[tuple(m.tolist())] = full(m)
        m = max(candidates, key=lambda m: known[tuple(m.tolist())][0])
        if known[tuple(m.tolist())][0] <= ll + 1e-9:
            return at, ll, var
        at, (ll, var) = m, known[tuple(m.tolist())]


def _interval(o: Observations, ll, mean: np.ndarray, best: float) -> tuple[np.ndarray, np.ndarray]:
    """Where twice the loss of log-likelihood, other parameters held, reaches the 0.95 quantile."""
    low, high = np.full(len(mean), np.nan), np.full(len(mean), np.inf)
    for i in range(len(mean)):

        def loss(x: float, i=i) -> float:
            moved = mean.copy()
            moved[i] = x
            return 2 * (best - ll(moved)) - CHI2_95_1

        if loss(0.0) < 0:
            low[i] = 0.0
        else:
            a = mean[i]
            while a > 0 and loss(a) < 0:
                a /= 2
            low[i] = root(loss, a, mean[i])
        for j in range(1, 20):
            if loss(mean[i] + 2.0**j) > 0:
                high[i] = root(loss, mean[i], mean[i] + 2.0**j)
                break
    return low, high


def fit_hom(o: Observations) -> Fit:
    """One haplotype: units are independent, so each has its own search over whole means, the variance fitted to each."""
    search, places = Search(o), o.places()
    mean, var = np.zeros(o.units), np.zeros(o.units)
    for d in range(o.units):

        def full(m, d=d):
            v, ll = search.var(d, [m[0]], lambda mass: mass @ o.weight)
            return ll, v

        def rough(m, v, d=d):
            return float(o.one_mass(d, m[0], v) @ o.weight)

        seen = np.unique(places[:, d])
        level = np.array([(search.mass(d, m) @ o.weight).max() for m in seen])
        ends = [_climb(np.array([seen[i]]), full, rough) for i in np.argsort(-level, kind="stable")[:2]]
        at, _, var[d] = max(ends, key=lambda e: (e[1], -e[0][0]))
        mean[d] = at[0]
    ll = o.hom_ll(mean, var)
    return Fit([mean], var, [_interval(o, lambda y: o.hom_ll(y, var), mean, ll)], ll)


def _fit_vars(o: Observations, search: Search, m1: np.ndarray, m2: np.ndarray, start: np.ndarray) -> tuple[float, np.ndarray]:
    """The largest log-likelihood at two means and its variances, unit by unit until little is gained."""
    var = start.copy()
    a = [o.one_mass(d, m1[d], var[d]) for d in range(o.units)]
    b = [o.one_mass(d, m2[d], var[d]) for d in range(o.units)]
    best = -np.inf
    for _ in range(8):
        before = best
        for d in range(o.units):
            p, q = sum(a) - a[d] + HALF, sum(b) - b[d] + HALF
            var[d], best = search.var(d, [m1[d], m2[d]], lambda x, y, p=p, q=q: np.logaddexp(p + x, q + y) @ o.weight)
            a[d], b[d] = o.one_mass(d, m1[d], var[d]), o.one_mass(d, m2[d], var[d])
        if o.units == 1 or best - before < 1e-6:
            break
    return best, var


def fit_het(o: Observations) -> Fit:
    """Two haplotypes: all pairs of places are tried at a few variances, and the best are followed to the nearest peak of the
    log-likelihood over whole means, the variance fitted to each."""
    d, search, places = o.units, Search(o), o.places()
    if len(places) > PLACES:  # evenly by rank, least and largest among them
        places = places[np.unique(np.linspace(0, len(places) - 1, PLACES).round().astype(int))]
    mass = np.array([sum(search.mass(j, p[j]) for j in range(d)) for p in places]) + HALF
    level = []
    for i in range(len(places)):
        ll = np.logaddexp(mass[i][None], mass[i:]) @ o.weight
        at = ll.argmax(1)
        level += [(-float(ll[j, at[j]]), i, i + j, int(at[j])) for j in range(len(ll))]
    best = None
    for _, i, j, v in sorted(level)[:STARTS]:
        m, ll, var = _climb(
            np.concatenate([places[i], places[j]]),
            lambda m, v=v: _fit_vars(o, search, m[:d], m[d:], np.full(d, search.grid[v])), lambda m, var: o.het_ll(m[:d], m[d:], var),
        )
        pair = sorted((m[:d], m[d:]), key=lambda x: (x.max(), x.tolist()))
        found = (round(-ll, 7), [x.tolist() for x in pair], ll, pair, var)
        if best is None or found[:2] < best[:2]:
            best = found
    _, _, ll, (p, q), v = best
    return Fit([p, q], v, [_interval(o, lambda y: o.het_ll(y, q, v), p, ll), _interval(o, lambda y: o.het_ll(p, y, v), q, ll)], ll)


SINGLETON = "caused_singleton_in_haplotyping"


@dataclass
class Genotype:
    """What a locus gives: labels of its observations, the fits and the test."""

    counts: np.ndarray
    kind: np.ndarray
    weight: np.ndarray
    haplotype: list[str]
    reasons: list[list[str]]
    removed: list[bool]
    hom: Fit | None
    het: Fit | None
    log_lik_hom: float
    log_lik_het: float
    n_par_hom: int
    n_par_het: int
    statistic: float
    df: int
    p_value: float
    is_significant: bool


def genotype(o: Observations, ploidy: int) -> Genotype:
    """Fits one and two haplotypes, labels reads, leaves out lone reads of a haplotype and tests for heterozygosity.

    A haplotype with a single read is suspect: while more than ``min_n_outlier_detection`` reads are left, such reads are taken out
    and everything is fitted again.  With fewer they get the reason but stay: they count as ``hom`` if the test isn't significant, and
    keep the label ``outlier`` if it is.
    """
    if ploidy not in (1, 2):
        raise ValueError(f"ploidy must be 1 or 2, not {ploidy}")
    n = len(o.weight)
    key = {(int(k), *c): i for i, (k, c) in enumerate(zip(o.kind, o.counts.tolist(), strict=True))}
    label, reasons, removed = [""] * n, [[] for _ in range(n)], [False] * n
    left = o
    while True:
        at = [key[(int(k), *c)] for k, c in zip(left.kind, left.counts.tolist(), strict=True)]
        hom = fit_hom(left)
        het = fit_het(left) if ploidy == 2 else None
        if het:
            p1, p2 = left.shares(het.means[0], het.means[1], het.unit_var)
            names = np.where(p1 > p2, "h1", "h2")
        else:
            names = np.full(len(left.weight), "hom")
        lone = []
        for name in dict.fromkeys(names.tolist()):
            own = np.flatnonzero(names == name)
            if left.weight[own].sum() == 1:
                lone.append(int(own[0]))
        for j, i in enumerate(at):
            label[i] = str(names[j])
        for j in lone:
            label[at[j]] = "outlier"
            reasons[at[j]].append(SINGLETON)
        if not lone or len(left) <= o.config.min_n_outlier_detection:
            break
        for j in lone:
            removed[at[j]] = True
        left = left.keep(~np.isin(np.arange(len(left.weight)), lone))
    if ploidy == 1:
        return Genotype(o.counts, o.kind, o.weight, label, reasons, removed, hom, None, math.nan, math.nan, -1, -1, 0.0, -1, 1.0, False)
    ll_hom, ll_het = left.hom_ll(hom.means[0], hom.unit_var), left.het_ll(*het.means, het.unit_var)
    statistic, df = -2 * (ll_hom - ll_het), o.units
    p = chi2_sf(statistic, df)
    significant = bool(p < o.config.heterozygozity_alpha)
    if not significant:
        label = ["outlier" if gone else "hom" for gone in removed]
    return Genotype(o.counts, o.kind, o.weight, label, reasons, removed, hom, het, ll_hom, ll_het, 2 * o.units, 3 * o.units, statistic, df, p, significant)
