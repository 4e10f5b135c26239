"""Privacy budgets in exact arithmetic."""

from __future__ import annotations

import math
from dataclasses import dataclass
from fractions import Fraction

INF = math.inf


def exact(x) -> Fraction | float:
    """A number as a fraction, floats as they are in binary; infinity stays."""
    if isinstance(x, Fraction):
        return x
    if isinstance(x, bool) or not isinstance(x, (int, float, str)):
        raise ValueError(f"{x!r} is no number that a budget can hold")
    if isinstance(x, str):
        return INF if x in ("inf", "oo") else Fraction(x)
    if isinstance(x, float) and math.isnan(x):
        raise ValueError("a budget can't be NaN")
    return INF if x == INF else Fraction(x)


def _minus(a, b):
    return INF if a == INF else a - b


@dataclass(frozen=True, eq=False)
class Budget:
    parts: tuple

    names = ()

    def __eq__(self, other):
        return type(self) is type(other) and self.parts == other.parts

    def __hash__(self):
        return hash((type(self), self.parts))

    def _same(self, other):
        if type(self) is not type(other):
            raise TypeError(f"{type(self).__name__} and {type(other).__name__} don't mix")

    def __add__(self, other):
        self._same(other)
        return type(self)(*(a + b for a, b in zip(self.parts, other.parts, strict=True)))

    def __sub__(self, other):
        self._same(other)
        return type(self)(*(max(_minus(a, b), 0) if a != INF else INF for a, b in zip(self.parts, other.parts, strict=True)))

    def __mul__(self, k):
        k = Fraction(k)
        return type(self)(*(a if a == INF and k else a * k for a in self.parts))

    __rmul__ = __mul__

    def __truediv__(self, k):
        return self * (1 / Fraction(k))

    def covers(self, other) -> bool:
        return all(a >= b for a, b in zip(self.parts, other.parts, strict=True))

    @property
    def value(self):
        out = tuple(float(p) for p in self.parts)
        return out if len(out) > 1 else out[0]

    @property
    def is_infinite(self) -> bool:
        return self.parts[0] == INF

    @property
    def is_zero(self) -> bool:
        return not any(self.parts)

    def __repr__(self):
        return f"{type(self).__name__}({', '.join(f'{n}={float(p):g}' for n, p in zip(self.names, self.parts, strict=True))})"


class PureDPBudget(Budget):
    names = ("epsilon",)

    def __init__(self, epsilon):
        e = exact(epsilon)
        if e < 0:
            raise ValueError("epsilon must be non-negative")
        super().__init__((e,))

    @property
    def epsilon(self) -> float:
        return float(self.parts[0])

    @classmethod
    def inf(cls):
        return cls(INF)


class ApproxDPBudget(Budget):
    names = ("epsilon", "delta")

    def __init__(self, epsilon, delta):
        e, d = exact(epsilon), exact(delta)
        if e < 0:
            raise ValueError("epsilon must be non-negative")
        if not 0 <= d <= 1:
            raise ValueError("delta must be between 0 and 1")
        super().__init__((e, d))

    def __add__(self, other):
        self._same(other)
        return ApproxDPBudget(self.parts[0] + other.parts[0], min(self.parts[1] + other.parts[1], Fraction(1)))

    def __mul__(self, k):
        k = Fraction(k)
        e, d = self.parts
        return ApproxDPBudget(e if e == INF and k else e * k, min(d * k, Fraction(1)))

    __rmul__ = __mul__

    def __sub__(self, other):
        self._same(other)
        if self.is_infinite:
            return self
        return super().__sub__(other)

    @property
    def epsilon(self) -> float:
        return float(self.parts[0])

    @property
    def delta(self) -> float:
        return float(self.parts[1])

    @property
    def is_infinite(self) -> bool:
        return self.parts[0] == INF or self.parts[1] == 1

    @classmethod
    def inf(cls):
        return cls(INF, 1)


class RhoZCDPBudget(Budget):
    names = ("rho",)

    def __init__(self, rho):
        r = exact(rho)
        if r < 0:
            raise ValueError("rho must be non-negative")
        super().__init__((r,))

    @property
    def rho(self) -> float:
        return float(self.parts[0])

    @classmethod
    def inf(cls):
        return cls(INF)


#: A request above what is left by at most this share of it is taken as what is left.
SLACK = Fraction(1, 10**9)


def rounded(asked: Budget, left: Budget) -> Budget:
    out = []
    for a, b in zip(asked.parts, left.parts, strict=True):
        close = a != INF and b != INF and b < a <= b * (1 + SLACK)
        out.append(b if close else a)
    return type(asked)(*out)
