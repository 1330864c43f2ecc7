"""Distribution tails and tests on a few numbers. Sufficient statistics come from Spark; this is the closed form."""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np


def _beta_fraction(a: float, b: float, x: float) -> float:
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > 1e-300 else 1e-300)
    h = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > 1e-300 else 1e-300)
            c = 1.0 + num / c
            c = c if abs(c) > 1e-300 else 1e-300
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def beta_cdf(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_p(t: float, df: float) -> float:
    """Two-sided."""
    return beta_cdf(df / 2, 0.5, df / (df + t * t))


def f_p(f: float, d1: float, d2: float) -> float:
    return beta_cdf(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)) if f > 0 else 1.0


def gamma_q(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    if x < a + 1:
        term = total = 1.0 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return 1 - total * math.exp(-x + a * math.log(x) - math.lgamma(a))
    b = x + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h * math.exp(-x + a * math.log(x) - math.lgamma(a))


def chi2_p(x: float, df: float) -> float:
    return gamma_q(df / 2, x / 2)


def normal_p(z: float) -> float:
    """Two-sided."""
    return math.erfc(abs(z) / math.sqrt(2))


def welch_t(n1, m1, v1, n2, m2, v2) -> tuple[float, float, float]:
    a, b = v1 / n1, v2 / n2
    t = (m1 - m2) / math.sqrt(a + b)
    df = (a + b) ** 2 / (a * a / (n1 - 1) + b * b / (n2 - 1))
    return t, df, t_p(t, df)


def welch_anova(n: np.ndarray, m: np.ndarray, v: np.ndarray) -> tuple[float, float, float, float]:
    k, w = len(n), n / v
    mean = (w * m).sum() / w.sum()
    lam = ((1 - w / w.sum()) ** 2 / (n - 1)).sum()
    f = (w * (m - mean) ** 2).sum() / (k - 1) / (1 + 2 * (k - 2) / (k * k - 1) * lam)
    d2 = (k * k - 1) / (3 * lam)
    return f, k - 1.0, d2, f_p(f, k - 1, d2)


def holm(ps: list[float]) -> list[float]:
    order, out, top = np.argsort(ps, kind="stable"), [0.0] * len(ps), 0.0
    for rank, k in enumerate(order):
        top = max(top, min(1.0, ps[k] * (len(ps) - rank)))
        out[k] = top
    return out


def studentized_range_p(q: float, k: int, df: float) -> float:
    """Upper tail of the studentised range, by two nested integrals on fixed grids."""
    z = np.linspace(-8, 8, 401)
    phi = np.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    cdf = np.array([0.5 * math.erfc(-v / math.sqrt(2)) for v in z])
    s = np.linspace(1e-3, max(3.0, 1 + 8 / math.sqrt(df)), 301)
    log_density = math.log(2) + df / 2 * math.log(df / 2) - math.lgamma(df / 2) + (df - 1) * np.log(s) - df * s * s / 2
    inner = np.array([np.trapezoid(k * phi * (cdf - np.interp(z - q * v, z, cdf, left=0.0)) ** (k - 1), z) for v in s])
    return float(np.clip(1 - np.trapezoid(np.exp(log_density) * inner, s), 0, 1))


def games_howell(n: np.ndarray, m: np.ndarray, v: np.ndarray) -> dict[tuple[int, int], float]:
    out = {}
    for i, j in combinations(range(len(n)), 2):
        t, df, _ = welch_t(n[i], m[i], v[i], n[j], m[j], v[j])
        out[i, j] = studentized_range_p(abs(t) * math.sqrt(2), len(n), df)
    return out


def fisher_exact(a: int, b: int, c: int, d: int) -> float:
    """Two-sided: all tables with the same margins that are no likelier."""
    def log_p(x: int) -> float:
        pick = lambda n, r: math.lgamma(n + 1) - math.lgamma(r + 1) - math.lgamma(n - r + 1)
        return pick(a + b, x) + pick(c + d, a + c - x) - pick(a + b + c + d, a + c)

    here = log_p(a)
    xs = range(max(0, a - d), min(a + b, a + c) + 1)
    return min(1.0, sum(math.exp(log_p(x)) for x in xs if log_p(x) <= here + 1e-7))


def letters(k: int, differ: set[tuple[int, int]]) -> list[str]:
    """Compact letter display: groups that share a letter do not differ."""
    columns = [set(range(k))]
    for i, j in sorted(differ):
        nxt = []
        for c in columns:
            nxt += [c - {i}, c - {j}] if i in c and j in c else [c]
        columns = [c for n, c in enumerate(nxt) if not any(c < d or (c == d and n > m) for m, d in enumerate(nxt))]
    columns.sort(key=lambda c: sorted(c))
    return ["".join(chr(97 + n) for n, c in enumerate(columns) if i in c) for i in range(k)]
