"""Special functions in numpy, from published series and continued fractions."""

from __future__ import annotations

import math

import numpy as np

# Lanczos coefficients for g = 7, n = 9.
LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)

_erfc = np.frompyfunc(math.erfc, 1, 1)


def erfc(x):
    return np.asarray(_erfc(np.asarray(x, float)), float)


def norm_cdf(z):
    return 0.5 * erfc(-np.asarray(z, float) / math.sqrt(2))


def norm_ppf(p):
    """Bisection-free: a rational start, then two Halley steps on the exact CDF."""
    p = np.asarray(p, float)
    with np.errstate(divide="ignore", invalid="ignore"):
        q = np.minimum(p, 1 - p)
        t = np.sqrt(-2 * np.log(q))
        # Abramowitz and Stegun 26.2.23.
        z = t - (2.515517 + 0.802853 * t + 0.010328 * t * t) / (1 + 1.432788 * t + 0.189269 * t * t + 0.001308 * t**3)
        z = np.where(p < 0.5, -z, z)
        for _ in range(3):
            e = (norm_cdf(z) - p) * math.sqrt(2 * math.pi) * np.exp(z * z / 2)
            z = z - e / (1 + z * e / 2)
    return np.where(p <= 0, -np.inf, np.where(p >= 1, np.inf, np.where(p == 0.5, 0.0, z)))


def gammaln(x):
    x = np.asarray(x, float) - 1
    a = np.full_like(x, LANCZOS[0])
    for i, c in enumerate(LANCZOS[1:], 1):
        a = a + c / (x + i)
    t = x + 7.5
    return 0.5 * math.log(2 * math.pi) + (x + 0.5) * np.log(t) - t + np.log(a)


def digamma(x: float) -> float:
    """For positive x: the recurrence up to 12, then the asymptotic series."""
    out = 0.0
    while x < 12:
        out -= 1 / x
        x += 1
    y = 1 / (x * x)
    # B_2k / 2k.
    return out + math.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y * (1 / 240 - y / 132))))


def trigamma(x: float) -> float:
    """For positive x: the recurrence up to 12, then the asymptotic series."""
    out = 0.0
    while x < 12:
        out += 1 / (x * x)
        x += 1
    y = 1 / (x * x)
    # B_2k.
    return out + 1 / x + y / 2 + y / x * (1 / 6 - y * (1 / 30 - y * (1 / 42 - y * (1 / 30 - y * 5 / 66))))


def gammainc(a: float, x):
    """Regularised lower incomplete gamma function."""
    x = np.maximum(np.asarray(x, float), 0)
    out = np.zeros_like(x)
    lead = np.exp(a * np.log(np.maximum(x, 1e-300)) - x - gammaln(a))
    low = x < a + 1
    if low.any():
        term = np.full(low.sum(), 1 / a)
        total, n = term.copy(), a
        for _ in range(500):
            n += 1
            term = term * x[low] / n
            total += term
            if np.all(term < total * 1e-16):
                break
        out[low] = total * lead[low]
    if (~low).any():
        v = x[~low]
        b = v + 1 - a
        c, d = np.full_like(v, 1e300), 1 / b
        h = d.copy()
        for i in range(1, 500):
            an = -i * (i - a)
            b = b + 2
            d = 1 / np.where(np.abs(an * d + b) < 1e-300, 1e-300, an * d + b)
            c = np.where(np.abs(b + an / c) < 1e-300, 1e-300, b + an / c)
            step = d * c
            h = h * step
            if np.all(np.abs(step - 1) < 1e-15):
                break
        out[~low] = 1 - lead[~low] * h
    return np.where(x <= 0, 0.0, np.clip(out, 0, 1))


def betainc(a: float, b: float, x):
    """Regularised incomplete beta function, by Lentz's continued fraction."""
    x = np.clip(np.asarray(x, float), 0, 1)

    def part(p, q, v):
        front = np.exp(gammaln(p + q) - gammaln(p) - gammaln(q) + p * np.log(np.maximum(v, 1e-300)) + q * np.log1p(-np.minimum(v, 1 - 1e-16))) / p
        c, d = np.ones_like(v), 1 / (1 - (p + q) * v / (p + 1))
        h = d.copy()
        for m in range(1, 300):
            for num in (m * (q - m) * v / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * v / ((p + 2 * m) * (p + 2 * m + 1))):
                d = 1 / np.where(np.abs(1 + num * d) < 1e-300, 1e-300, 1 + num * d)
                c = np.where(np.abs(1 + num / c) < 1e-300, 1e-300, 1 + num / c)
                h = h * d * c
            if np.all(np.abs(d * c - 1) < 1e-15):
                break
        return front * h

    low = x < (a + 1) / (a + b + 2)
    out = np.where(low, part(a, b, np.where(low, x, 0.5)), 1 - part(b, a, np.where(low, 0.5, 1 - x)))
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, out))
