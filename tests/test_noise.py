"""Samplers against the distributions they claim, and noise drawn once."""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np

from quietframe.operators.noise import Noise, NoiseSpec, discrete_gaussian, discrete_laplace, discrete_laplace_block, draw, draw_block, gap_weights, grid, inverse_cdf, noisy_prefix, uniform


def moments(draws):
    n = len(draws)
    mean = sum(draws) / n
    return float(mean), float(sum((x - mean) ** 2 for x in draws) / n)


def test_discrete_laplace():
    n = 6000
    draws = [discrete_laplace(Fraction(3)) for _ in range(n)]
    a = math.exp(-1 / 3)
    mean, var = moments(draws)
    want = 2 * a / (1 - a) ** 2
    assert abs(mean) < 5 * math.sqrt(want / n) and abs(var / want - 1) < 0.2
    p0 = (1 - a) / (1 + a)
    assert abs(draws.count(0) / n - p0) < 5 * math.sqrt(p0 / n)


def test_discrete_laplace_block():
    """The same distribution as one by one; huge terms go that way."""
    for scale in (Fraction(3), Fraction(7, 2), Fraction(1, 3), Fraction(1 << 31, 3)):
        n = 40_000
        draws = np.array(discrete_laplace_block(scale, n), float)
        a = math.exp(-1 / float(scale))
        want = 2 * a / (1 - a) ** 2
        assert len(draws) == n and abs(draws.mean()) < 5 * math.sqrt(want / n) and abs(draws.var() / want - 1) < 0.1
        for k in (0, 1, -1, 2):
            p = (1 - a) / (1 + a) * a ** abs(k)
            assert abs((draws == k).mean() - p) < 5 * math.sqrt(p / n) + 1e-9
    assert len(discrete_laplace_block(Fraction(1 << 60, 3), 5)) == 5
    assert discrete_laplace_block(Fraction(0), 3) == [0, 0, 0]
    spec = NoiseSpec(Noise.LAPLACE, Fraction(1, 3))
    assert all((x / grid(spec)).denominator == 1 for x in draw_block(spec, 100))
    assert draw_block(NoiseSpec(Noise.NONE, 0), 2) == [0, 0]


def test_discrete_gaussian():
    n = 3000
    mean, var = moments([discrete_gaussian(Fraction(25, 4)) for _ in range(n)])
    assert abs(mean) < 5 * 2.5 / math.sqrt(n) and abs(var / 6.25 - 1) < 0.2


def test_float_noise_is_on_its_grid():
    for spec in (NoiseSpec(Noise.LAPLACE, Fraction(1, 3)), NoiseSpec(Noise.GAUSSIAN, Fraction(1, 3))):
        g = grid(spec)
        assert all((draw(spec) / g).denominator == 1 for _ in range(50))
    _, var = moments([draw(NoiseSpec(Noise.LAPLACE, Fraction(2))) for _ in range(1500)])
    assert abs(var / 8 - 1) < 0.4


def test_none():
    assert draw(NoiseSpec(Noise.NONE, 0)) == 0 and discrete_laplace(Fraction(0)) == 0 == discrete_gaussian(Fraction(0))


def quantile(values, low, high, q, eps):
    edges = np.unique([low, *values, high])
    rank = np.array([sum(v <= e for v in values) for e in edges[:-1]], float)
    a, b = gap_weights(rank, np.diff(edges), np.full(len(rank), len(values), float), q, eps, 1)
    k = max(range(len(rank)), key=lambda i: (a[i], b[i]))
    return edges[k], edges[k + 1]


def test_gap_weights():
    values = list(range(101))
    assert all(49 <= quantile(values, 0, 100, 0.5, math.inf)[0] <= 50 for _ in range(20))
    draws = [sum(quantile(values, 0, 100, 0.5, 20.0)) / 2 for _ in range(200)]
    assert 40 < sum(draws) / 200 < 60
    assert quantile([], 2, 3, 0.5, math.inf) == (2, 3)
    # Without values the weight is the width alone.
    a, b = gap_weights(np.zeros(20000), np.tile([1.0, 3.0], 10000), np.zeros(20000), 0.5, 1.0, 1.0)
    assert abs((a[1::2] > a[::2]).mean() - 0.75) < 0.03 and not b.any()
    u = uniform(10000)
    assert 0 < u.min() and u.max() < 1 and abs(u.mean() - 0.5) < 0.03


def test_bounds():
    none = NoiseSpec(Noise.NONE, 0)
    assert noisy_prefix({0: 1}, none) == 0 and noisy_prefix({4: 2}, none) == 4 and noisy_prefix({}, none) == 0
    assert noisy_prefix({0: 95, 9: 5}, none) == 0


def test_inverse_cdf():
    a = math.exp(-1 / 3)
    cdf = lambda k: a ** -k / (1 + a) if k < 0 else 1 - a ** (k + 1) / (1 + a)
    for p in (0.01, 0.2, 0.5, 0.8, 0.975):
        k = inverse_cdf(NoiseSpec(Noise.GEOMETRIC, Fraction(3)), p)
        assert cdf(k) >= p - 1e-9 and cdf(k - 1) < p
    assert abs(inverse_cdf(NoiseSpec(Noise.LAPLACE, Fraction(2)), 0.975) - 2 * math.log(20)) < 1e-9
    assert abs(inverse_cdf(NoiseSpec(Noise.GAUSSIAN, Fraction(4)), 0.975) - 3.92) < 0.01
