"""Two-sided p-values for a handful of model coefficients on the driver."""

from __future__ import annotations

import math


def normal_p(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def student_p(t: float, df: float) -> float:
    """Regularised incomplete beta at df / (df + t^2), by its continued fraction."""
    x = df / (df + t * t)
    return _incomplete_beta(df / 2, 0.5, x)


def _incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return min(1.0, max(0.0, x))
    if x > (a + 1) / (a + b + 2):
        return 1 - _incomplete_beta(b, a, 1 - x)
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    # Evaluate the fraction from its tail.
    value = 1.0
    for m in range(300, 0, -1):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m - 1) * (a + b + m - 1) * x / ((a + 2 * m - 2) * (a + 2 * m - 1))
        value = 1 + odd / (1 + even / value)
    return front / a / value
