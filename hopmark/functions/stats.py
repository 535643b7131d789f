"""Closed forms and tables of the randomness score, and the whole-number limits that decide it."""

from __future__ import annotations

import math
from functools import cache

from hopmark.functions.labels import BINS, MAX_INC, MODULUS, TAU


def upper_gamma(m: int, x: float) -> float:
    """The regularised upper incomplete gamma function Q(m + 1/2, x)."""
    if x <= 0:
        return 1.0
    total, term = math.erfc(math.sqrt(x)), math.exp(-x) * math.sqrt(x) / math.gamma(1.5)
    for k in range(m):
        total += term
        term *= x / (k + 1.5)
    return min(1.0, total)


def chi2_tail(chi2: float, bins: int) -> float:
    """P of a chi-square statistic at least this large over an even number of equal bins."""
    return upper_gamma((bins - 2) // 2, chi2 / 2)


def uniformity(n: int, sum_squares: int, bins: int = BINS) -> float:
    """P of a sum of squared bin counts at least this large, for n draws; 1 below two draws."""
    return chi2_tail(bins * sum_squares / n - n, bins) if n >= 2 else 1.0


@cache
def binomial_tail(n: int, k: int, p: float = MAX_INC / MODULUS) -> float:
    """P of at least k successes in n trials; 1 without successes or below two trials."""
    if n < 2 or k <= 0:
        return 1.0
    return min(1.0, math.fsum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k, n + 1)))


@cache
def occupancy(n: int) -> tuple[float, ...]:
    """P of at most d distinct values in n uniform draws from MODULUS values, for d from 0 to n."""
    row = [1.0]
    for _ in range(n):
        new = [0.0] * (len(row) + 1)
        for d, v in enumerate(row):
            new[d] += v * d / MODULUS
            new[d + 1] += v * (MODULUS - d) / MODULUS
        row = new
    out, total = [], 0.0
    for v in row:
        total += v
        out.append(min(1.0, total))
    return tuple(out)


def gap_bound(n: int, gap: int) -> float:
    """A bound on P of a largest circular gap of at least `gap` among n draws."""
    return min(1.0, n * (1 - gap / MODULUS) ** (n - 1)) if n >= 2 else 1.0


@cache
def limits(longest: int = 100, tau: float = TAU) -> dict[str, list[int]]:
    """The whole-number limits that are equivalent to a score of at least tau, for each number of values present.

    squares: largest sum of squared bin counts; distinct: fewest distinct values; gap: largest circular gap; successes:
    most bounded steps, by number of pairs. An attained score may equal tau up to rounding, so tau is taken with a
    relative tolerance far below the distance to the next attainable score.
    """
    low = tau * (1 - 1e-9)
    squares, distinct, gap, successes = [0, 1], [0, 1], [MODULUS, MODULUS], [longest, longest]
    for n in range(2, longest + 1):
        squares.append(max(s for s in range(n, n * n + 1) if uniformity(n, s) >= low))
        distinct.append(next(d for d, p in enumerate(occupancy(n)) if p >= low))
        a, b = 0, MODULUS
        while a < b:
            m = (a + b + 1) // 2
            a, b = (m, b) if gap_bound(n, m) >= low else (a, m - 1)
        gap.append(a)
        successes.append(max(k for k in range(n + 1) if binomial_tail(n, k) >= low))
    return {"squares": squares, "distinct": distinct, "gap": gap, "successes": successes}
