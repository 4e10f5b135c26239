"""Exact samplers of discrete noise, and noise on aggregated rows.

Integers come from the operating system's generator and probabilities are compared as
fractions (Canonne, Kamath, Steinke: The Discrete Gaussian for Differential Privacy,
2020).  Noise on floats is integer noise on a power-of-two grid, and what it is added
to is summed on that grid too."""

from __future__ import annotations

import math
import os
import secrets
from dataclasses import dataclass
from enum import Enum
from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import types as T


class Noise(Enum):
    GEOMETRIC = "GEOMETRIC"
    LAPLACE = "LAPLACE"
    DISCRETE_GAUSSIAN = "DISCRETE_GAUSSIAN"
    GAUSSIAN = "GAUSSIAN"
    EXPONENTIAL = "EXPONENTIAL"
    NONE = "NONE"


@dataclass(frozen=True)
class NoiseSpec:
    """parameter: scale of (discrete) Laplace, variance of (discrete) Gaussian noise,
    epsilon of the exponential mechanism."""

    kind: Noise
    parameter: Fraction | float

    @property
    def none(self) -> bool:
        return self.kind is Noise.NONE or (self.kind is not Noise.EXPONENTIAL and self.parameter == 0)


def _bernoulli(p: Fraction) -> bool:
    return secrets.randbelow(p.denominator) < p.numerator


def _bernoulli_exp(x: Fraction) -> bool:
    """True with probability exp(-x)."""
    while x > 1:
        if not _bernoulli_exp(Fraction(1)):
            return False
        x -= 1
    k = 1
    while _bernoulli(x / k):
        k += 1
    return k % 2 == 1


def discrete_laplace(scale: Fraction) -> int:
    """P(k) in proportion to exp(-|k| / scale)."""
    scale = Fraction(scale)
    if scale == 0:
        return 0
    t, s = scale.numerator, scale.denominator
    while True:
        u = secrets.randbelow(t)
        if not _bernoulli_exp(Fraction(u, t)):
            continue
        v = 0
        while _bernoulli_exp(Fraction(1)):
            v += 1
        y = (u + t * v) // s
        negative = secrets.randbelow(2)
        if not (negative and y == 0):
            return -y if negative else y


def _below(n: int, size: int):
    """`size` integers from 0 to n - 1, each as likely (n below 2 ** 63)."""
    import numpy as np

    shift, out, have = np.uint64(64 - max(1, (n - 1).bit_length())), np.zeros(size, np.int64), 0
    while have < size:
        got = (np.frombuffer(os.urandom(8 * (size - have)), np.uint64) >> shift).astype(np.int64)
        got = got[got < n]
        out[have : have + len(got)] = got
        have += len(got)
    return out


def _exp_block(u, t: int):
    """Each true with probability exp(-u / t), for 0 <= u <= t."""
    import numpy as np

    out, open_, k = np.zeros(len(u), bool), np.arange(len(u)), 1
    while len(open_):
        on = _below(t * k, len(open_)) < u[open_]
        out[open_[~on]] = k % 2 == 1
        open_, k = open_[on], k + 1
    return out


def discrete_laplace_block(scale: Fraction, size: int):
    """`size` draws of discrete_laplace(), by the same steps on arrays; one by one where
    the scale's terms are too long for them."""
    import numpy as np

    scale = Fraction(scale)
    t, s = scale.numerator, scale.denominator
    if not 0 < t < 1 << 50:
        return [discrete_laplace(scale) for _ in range(size)]
    out, have = np.zeros(size, np.int64), 0
    while have < size:
        u = _below(t, 2 * (size - have) + 8)
        u = u[_exp_block(u, t)]
        v, open_ = np.zeros(len(u), np.int64), np.arange(len(u))
        while len(open_):
            open_ = open_[_exp_block(np.ones(len(open_), np.int64), 1)]
            v[open_] += 1
        if len(v) and int(v.max()) >= 1 << 12:  # next to impossible, and too far for these integers
            continue
        y, negative = (u + t * v) // s, _below(2, len(u)) == 1
        y = np.where(negative, -y, y)[~(negative & (y == 0))][: size - have]
        out[have : have + len(y)] = y
        have += len(y)
    return out.tolist()


def discrete_gaussian(variance: Fraction) -> int:
    """P(k) in proportion to exp(-k * k / (2 * variance))."""
    variance = Fraction(variance)
    if variance == 0:
        return 0
    t = math.isqrt(variance.numerator // variance.denominator) + 1
    while True:
        y = discrete_laplace(Fraction(t))
        if _bernoulli_exp((abs(y) - variance / t) ** 2 / (2 * variance)):
            return y


def grid(spec: NoiseSpec) -> Fraction:
    """Power of two about 2**-30 of the noise's width."""
    if spec.none:
        return Fraction(1, 1 << 40)
    width = float(spec.parameter) if spec.kind in (Noise.LAPLACE, Noise.GEOMETRIC) else math.sqrt(float(spec.parameter))
    return Fraction(2) ** (math.floor(math.log2(width)) - 30)


def draw(spec: NoiseSpec) -> Fraction:
    if spec.none:
        return Fraction(0)
    if spec.kind is Noise.GEOMETRIC:
        return Fraction(discrete_laplace(Fraction(spec.parameter)))
    if spec.kind is Noise.DISCRETE_GAUSSIAN:
        return Fraction(discrete_gaussian(Fraction(spec.parameter)))
    g = grid(spec)
    if spec.kind is Noise.LAPLACE:
        return discrete_laplace(Fraction(spec.parameter) / g) * g
    return discrete_gaussian(Fraction(spec.parameter) / g**2) * g


def draw_block(spec: NoiseSpec, size: int) -> list[Fraction]:
    """`size` draws."""
    if spec.kind is Noise.GEOMETRIC and not spec.none:
        return [Fraction(x) for x in discrete_laplace_block(Fraction(spec.parameter), size)]
    if spec.kind is Noise.LAPLACE and not spec.none:
        g = grid(spec)
        return [x * g for x in discrete_laplace_block(Fraction(spec.parameter) / g, size)]
    return [draw(spec) for _ in range(size)]


def inverse_cdf(spec: NoiseSpec, p: float) -> float:
    """The value that noise doesn't exceed with probability p."""
    if not 0 < p < 1:
        raise ValueError("a probability between 0 and 1 is needed")
    if spec.none:
        return 0.0
    b = float(spec.parameter)
    if spec.kind is Noise.LAPLACE:
        return b * math.log(2 * p) if p < 0.5 else -b * math.log(2 * (1 - p))
    if spec.kind is Noise.GEOMETRIC:
        a = math.exp(-1 / b)
        if p < a / (1 + a):  # P(X <= k) = a ** -k / (1 + a) for k < 0
            return float(math.ceil(-math.log(p * (1 + a)) / math.log(a) - 1e-12))
        return float(max(0, math.ceil(math.log((1 - p) * (1 + a)) / math.log(a) - 1 - 1e-12)))
    if spec.kind in (Noise.GAUSSIAN, Noise.DISCRETE_GAUSSIAN):
        from statistics import NormalDist

        x = NormalDist(0, math.sqrt(b)).inv_cdf(p)
        return x if spec.kind is Noise.GAUSSIAN else float(round(x))
    raise ValueError("the exponential mechanism has no distribution of its own")


def add_noise(df: DataFrame, specs: dict[str, NoiseSpec]) -> DataFrame:
    """Noise on columns of an aggregated frame (a row a group); long and double columns.
    Draws are fresh in each task; the caller materializes the frame once."""
    specs = {c: s for c, s in specs.items() if not s.none}
    if not specs:
        return df

    def run(frames):
        for f in frames:
            for c, s in specs.items():
                whole = f[c].dtype.kind == "i"
                more = draw_block(s, len(f))
                f[c] = [int(x) + int(y) if whole else float(Fraction(float(x)) + y) for x, y in zip(f[c], more, strict=True)]
            yield f

    return df.mapInPandas(run, T.StructType(df.schema.fields))


def uniform(n: int):
    """n numbers in (0, 1) from the operating system's generator."""
    import numpy as np

    return ((np.frombuffer(os.urandom(8 * n), np.uint64) >> np.uint64(11)) + 0.5) * 2.0**-53


def gap_weights(rank, width, total, q: float, epsilon: float, sensitivity: float):
    """(score, weight) of gaps of a positive width: the gap whose pair is greatest is drawn
    as the exponential mechanism draws.  A gap's utility is minus its rank's distance
    from q * total; with infinite epsilon gaps of the greatest utility alone count."""
    import numpy as np

    utility = -np.abs(rank - q * total)
    gumbel = np.log(width) - np.log(-np.log(uniform(len(width))))
    if math.isinf(epsilon):
        return np.round(utility, 9), gumbel
    return epsilon * utility / (2 * sensitivity) + gumbel, np.zeros(len(width))


def noisy_prefix(counts: dict[int, int], spec: NoiseSpec, share: float = 0.95) -> int:
    """The least bucket up to which noisy counts reach `share` of the noisy total."""
    top = max(counts, default=0)
    noisy = [max(0, counts.get(k, 0) + int(draw(spec))) for k in range(0, max(top, 63 if not spec.none else top) + 1)]
    total, run = sum(noisy), 0
    for k, n in enumerate(noisy):
        run += n
        if run >= share * total:
            return k
    return top
