import math

import numpy as np
import pytest

from tandem.functions.genotype import Observations, expected_largest, flanking_log_pmf, genotype, log_pmf, spanning_log_pmf
from tandem.functions.numeric import chi2_sf, log_ndtr, root


def observations(spanning, left=(), right=()):
    rows = [(k, *np.atleast_1d(x)) for k, xs in enumerate((spanning, left, right)) for x, n in xs for _ in range(n)]
    u, n = np.unique(np.array(rows), axis=0, return_counts=True)
    return Observations(u[:, 1:], u[:, 0], n)


# counts, number of reads -> group sizes and means
CASES = [
    ("single read", [(1, 1)], [], [], {"hom": 1}, None),
    ("homozygous", [(2, 2)], [(1, 1)], [(1, 1)], {"hom": 4}, None),
    ("heterozygous", [(1, 3), (3, 4)], [], [], {"h1": 3, "h2": 4}, ((1,), (3,))),
    ("two units", [((2, 3), 2), ((4, 2), 3)], [], [], {"h1": 2, "h2": 3}, ((2, 3), (4, 2))),
    ("two units, flanks", [((2, 3), 2), ((4, 2), 3)], [((2, 1), 1)], [((0, 2), 1)], {"h1": 3, "h2": 4}, ((2, 3), (4, 2))),
    ("break", [((2, 3), 3), ((5, 2), 4)], [], [], {"h1": 3, "h2": 4}, ((2, 3), (5, 2))),
    ("three units", [((2, 1, 3), 2), ((3, 2, 1), 2)], [((2, 1, 1), 1)], [((0, 1, 1), 1)], {"h1": 3, "h2": 3}, ((2, 1, 3), (3, 2, 1))),
    ("1", [(765, 1), (770, 1), (778, 1)], [(863, 1), (864, 1)], [], {"h1": 3, "h2": 2}, ((771,), (864,))),
    ("2", [(12, 10), (927, 1), (940, 1), (947, 1)], [(13, 1), (798, 1), (745, 1), (362, 1)], [], {"h1": 11, "h2": 6}, ((12,), (938,))),
    ("3", [(8, 1), (9, 4), (11, 5)], [(10, 1)], [], {"h1": 5, "h2": 6}, ((9,), (11,))),
    ("4", [(8, 7), (9, 5)], [], [], {"h1": 7, "h2": 5}, ((8,), (9,))),
    ("5", [(5, 10), (12, 1), (13, 5)], [(8, 1), (10, 1)], [], {"h1": 10, "h2": 8}, ((5,), (13,))),
    ("6", [(8, 9), (107, 1), (108, 2), (109, 7), (110, 3), (111, 1)], [(66, 1), (75, 1), (96, 1), (98, 1)], [], {"h1": 9, "h2": 18}, ((8,), (109,))),
    ("7", [(28, 8), (30, 5), (31, 1)], [], [(28, 1)], {"h1": 9, "h2": 6}, ((28,), (30,))),
    ("10", [(12, 17), (958, 1)], [(54, 1), (298, 1)], [], {"h1": 17, "h2": 3}, ((12,), (958,))),
    ("11", [(12, 17), (15, 21)], [], [], {"h1": 17, "h2": 21}, ((12,), (15,))),
    ("12", [], [(7, 1)], [], {"hom": 1}, None),
    ("13", [(19, 3), (27, 9), (28, 1)], [], [], {"h1": 3, "h2": 10}, ((19,), (27,))),
    (
        "14",
        [((13, 8, 18), 1), ((15, 8, 18), 1), ((15, 9, 18), 6), ((15, 9, 20), 1), ((16, 8, 20), 1), ((16, 9, 19), 2), ((16, 9, 20), 2), ((16, 9, 21), 4), ((16, 10, 20), 1), ((16, 9, 24), 1)],
        [], [], {"h1": 8, "h2": 12}, ((15, 9, 18), (16, 9, 21)),
    ),
]


@pytest.mark.parametrize(("spanning", "left", "right", "sizes", "means"), [c[1:] for c in CASES], ids=[c[0] for c in CASES])
def test_cases(spanning, left, right, sizes, means):
    g = genotype(observations(spanning, left, right), 2)
    got = {}
    for h, n in zip(g.haplotype, g.weight):
        got[h] = got.get(h, 0) + int(n)
    assert got == sizes
    if means:
        assert tuple(tuple(m.astype(int)) for m in g.het.means) == means


def test_few_reads_beside_many():
    """Two reads three units longer than twenty equal ones: the model as it is defined tells two haplotypes."""
    g = genotype(observations([(27, 20), (30, 2)]), 2)
    assert g.is_significant and [m.tolist() for m in g.het.means] == [[27], [30]]


def test_lone_read_is_left_out():
    g = genotype(observations([(10, 12), (40, 1)]), 2)
    by = dict(zip(g.counts[:, 0].astype(int).tolist(), zip(g.haplotype, g.reasons, g.removed)))
    assert by[40] == ("outlier", ["caused_singleton_in_haplotyping"], True)
    assert by[10][0] == "hom"


def test_one_copy():
    g = genotype(observations([(10, 5), (12, 1)]), 1)
    assert set(g.haplotype) == {"hom"} and g.het is None and g.p_value == 1
    with pytest.raises(ValueError):
        genotype(observations([(1, 1)]), 3)


@pytest.mark.parametrize("seed", range(6))
def test_recovers_simulated_counts(seed):
    r = np.random.default_rng(seed)
    m1, m2 = 12, 12 + int(r.integers(4, 30))
    x = np.round(np.concatenate([r.normal(m1, 0.5, 20), r.normal(m2, 0.5, 20)])).astype(int)
    u, n = np.unique(x, return_counts=True)
    g = genotype(Observations(u[:, None], np.zeros(len(u), int), n), 2)
    assert g.is_significant
    assert abs(g.het.means[0][0] - m1) <= 1 and abs(g.het.means[1][0] - m2) <= 1
    for mean, (low, high) in zip(g.het.means, g.het.intervals):
        assert low[0] <= mean[0] <= high[0]
    order = r.permutation(len(u))
    again = genotype(Observations(u[order][:, None], np.zeros(len(u), int), n[order]), 2)
    assert (again.p_value, again.haplotype) == (g.p_value, g.haplotype)


def test_log_mass():
    assert spanning_log_pmf(np.zeros((0, 1)), np.array([0.0]), np.array([1.0])).shape == (0,)
    for x, m, v in (([[1]], [1], [0.01]), ([[1], [1]], [1], [0.01]), ([[1, 2, 3]], [1, 2, 3], [0.001] * 3)):
        got = spanning_log_pmf(np.array(x, float), np.array(m, float), np.array(v))
        assert np.allclose(got, 0, atol=1e-5) and (got <= 0).all()
    total = np.exp(log_pmf(np.arange(200), 50.0, 0.3)).sum()
    assert total == pytest.approx(1)
    # far above the mean the loss levels off, far below it doesn't
    assert log_pmf(np.array([510]), 10.0, 0.01)[0] == pytest.approx(-34.54, abs=0.01)
    assert log_pmf(np.array([5]), 10.0, 0.01)[0] == pytest.approx(-104.8, abs=0.1)


def test_flanking_log_mass():
    assert flanking_log_pmf(np.zeros((0, 1)), np.array([0.0]), np.array([1.0]), np.zeros(0, bool)).shape == (0,)
    for x in ([[1]], [[1, 1, 1]], [[1], [1]]):
        x = np.array(x, float)
        got = flanking_log_pmf(x, np.ones(x.shape[1]), np.full(x.shape[1], 0.01), np.ones(len(x), bool))
        assert np.allclose(got, 0, atol=1e-5)
    assert flanking_log_pmf(np.zeros((1, 2)), np.array([3.0, 4]), np.array([0.1, 0.1]), np.array([True]))[0] == 0


@pytest.mark.parametrize(
    ("x", "share", "want"),
    [
        ([[0, 0, 0]], [1], [0, 0, 0]),
        ([[0, 1, 1]], [1], [0, 1, 1]),
        ([[1, 1, 0], [1, 1, 0]], [1, 1], [1, 1, 0]),
        ([[1, 2], [1, 2], [2, 2]], [0, 0.5, 0.5], [1.25, 1.5]),
    ],
)
def test_expected_largest(x, share, want):
    assert np.allclose(expected_largest(np.array(x, float), np.array(share, float)), want)


def test_numeric_tools():
    assert np.allclose(log_ndtr(np.array([0.0, -1.0, 3.0, -40.0])), [math.log(0.5), -1.8410216450, -0.0013508100, -804.6084420])
    for x, df, p in ((3.841458820694124, 1, 0.05), (5.991464547107979, 2, 0.05), (7.814727903251179, 3, 0.05), (18.307038053275146, 10, 0.05)):
        assert chi2_sf(x, df) == pytest.approx(p)
    z = np.concatenate([np.linspace(-29.9, 8, 4000), [-1e-9, 0.0, 1e-9]])
    exact = np.array([math.log(0.5 * math.erfc(-x / math.sqrt(2))) for x in z])
    assert np.allclose(log_ndtr(z), exact, rtol=1e-12, atol=1e-15)
    assert root(lambda x: x**3 - 2, 0, 3) == pytest.approx(2 ** (1 / 3))
