"""Shapiro-Wilk on one numpy sample: the brute-force version of the Spark operator."""

import math

import numpy as np

# FIXED VALUES: Royston (1995) polynomial coefficients of the Shapiro-Wilk approximation.
SW_C1 = [0.0, 0.221157, -0.147981, -2.07119, 4.434685, -2.706056]
SW_C2 = [0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633]
SW_C3 = [0.544, -0.39978, 0.025054, -6.714e-4]
SW_C4 = [1.3822, -0.77857, 0.062767, -0.0020322]
SW_C5 = [-1.5861, -0.31082, -0.083751, 0.0038915]
SW_C6 = [-0.4803, -0.082676, 0.0030302]
SW_G = [-2.273, 0.459]


def _poly(c, x):
    return sum(ci * x ** i for i, ci in enumerate(c))


def _ppf(p: np.ndarray) -> np.ndarray:
    from statistics import NormalDist
    nd = NormalDist()
    return np.array([nd.inv_cdf(float(v)) for v in p])


def shapiro_wilk(x: np.ndarray) -> tuple[float, float]:
    """W statistic and p-value (Royston's approximation, 3 <= n <= 5000).

    Outside that range, for which the approximation is not stated, and without spread both are
    NaN here and NULL in the table; its column ``reason`` says why.
    """
    x = np.sort(np.asarray(x, dtype=float))
    n = len(x)
    if n < 3 or n > 5000 or x[-1] - x[0] <= 0:
        return float("nan"), float("nan")
    half = n // 2
    if n == 3:
        a_half = np.array([math.sqrt(0.5)])
    else:
        m = _ppf((np.arange(1, half + 1) - 0.375) / (n + 0.25))
        summ2 = 2.0 * float(np.sum(m * m))
        ssumm2 = math.sqrt(summ2)
        rsn = 1.0 / math.sqrt(n)
        a1 = _poly(SW_C1, rsn) - m[0] / ssumm2
        a_half = -m.copy()
        if n > 5:
            a2 = -m[1] / ssumm2 + _poly(SW_C2, rsn)
            fac = math.sqrt((summ2 - 2 * m[0] ** 2 - 2 * m[1] ** 2) / (1 - 2 * a1 ** 2 - 2 * a2 ** 2))
            a_half = a_half / fac
            a_half[1] = a2
        else:
            fac = math.sqrt((summ2 - 2 * m[0] ** 2) / (1 - 2 * a1 ** 2))
            a_half = a_half / fac
        a_half[0] = a1
    a = np.zeros(n)
    a[:half] = -a_half
    a[n - half:] = a_half[::-1]
    xc = x - x.mean()
    w = float(np.dot(a, x) ** 2 / (np.dot(a, a) * np.dot(xc, xc)))
    w = min(w, 1.0)
    if n == 3:
        p = max(6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75))), 0.0)
        return w, p
    y = math.log(1 - w) if w < 1 else -math.inf
    if n <= 11:
        gamma = _poly(SW_G, n)
        if y >= gamma:
            return w, 1e-99
        y = -math.log(gamma - y)
        mu, sigma = _poly(SW_C3, n), math.exp(_poly(SW_C4, n))
    else:
        ln_n = math.log(n)
        mu, sigma = _poly(SW_C5, ln_n), math.exp(_poly(SW_C6, ln_n))
    z = (y - mu) / sigma
    return w, 0.5 * math.erfc(z / math.sqrt(2))
