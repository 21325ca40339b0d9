"""How far an estimated level shift can lie from the true one."""

from __future__ import annotations

import math
from functools import lru_cache


def _log_upper(z: float) -> float:
    """Logarithm of the probability that a standard normal number exceeds z >= 0, far into the tail."""
    if z < 25:
        return math.log(0.5 * math.erfc(z / math.sqrt(2)))
    return -z * z / 2 - math.log(z * math.sqrt(2 * math.pi)) + math.log1p(-1 / z**2 + 3 / z**4)


def _side(x: float, ratio: float) -> float:
    """Probability that the place of the maximum lies beyond x > 0 on a side whose noise has ``ratio`` times the variance of the
    other one.

    The maximum of two independent drifting random walks from 0, drift -1/2 on both sides, variances 1 and ``ratio`` for this
    one (the distribution of Bai, 1997).
    """
    root = math.sqrt(x / ratio)
    head = math.exp(-x / (8 * ratio)) * root / math.sqrt(2 * math.pi)
    grown = x * (1 + ratio) / 2 + _log_upper(root * (ratio + 0.5))
    part = (2 * ratio + 1) / ratio / (1 + ratio)
    middle = (2 * ratio + 1) ** 2 / ((1 + ratio) * ratio) - 2 + x / (2 * ratio)
    below = 1 + head + part * math.exp(grown) - middle * math.exp(_log_upper(root / 2))
    return 1 - below


@lru_cache(maxsize=4096)
def reach(tail: float, ratio: float) -> float:
    """Distance, in units of (spread / shift) squared of the other side, that is exceeded on this side with probability ``tail``."""
    low, high = 1e-9, 1.0
    if _side(low, ratio) <= tail:
        return 0.0
    while _side(high, ratio) > tail and high < 1e12:
        low, high = high, 2 * high
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if _side(middle, ratio) > tail else (low, middle)
    return (low + high) / 2
