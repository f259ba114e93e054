"""Binomial intervals and tests of a few counts, without special-function libraries."""

from __future__ import annotations

import math


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the regularized incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 1000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            c = 1 + num / c
            d = 1 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def beta_cdf(a: float, b: float, x: float) -> float:
    """Regularized incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def beta_quantile(a: float, b: float, q: float) -> float:
    low, high = 0.0, 1.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if beta_cdf(a, b, mid) < q else (low, mid)
    return (low + high) / 2


def clopper_pearson(k: int, n: int, level: float = 0.6827) -> tuple[float, float]:
    """Exact central interval of a proportion; (0, 1) without trials."""
    if n <= 0:
        return 0.0, 1.0
    tail = (1 - level) / 2
    low = 0.0 if k == 0 else beta_quantile(k, n - k + 1, tail)
    high = 1.0 if k == n else beta_quantile(k + 1, n - k, 1 - tail)
    return low, high


def paired_binomial(only_a: int, only_b: int) -> float:
    """Two-sided exact p of discordant counts under equal chances; 1 without any."""
    n, k = only_a + only_b, min(only_a, only_b)
    if not n:
        return 1.0
    log = lambda i: math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2)
    return min(1.0, 2 * math.fsum(math.exp(log(i)) for i in range(k + 1)))
