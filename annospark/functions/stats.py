"""Fisher's exact test (two-sided): column expressions, and the numeric kernel over Arrow batches.

Log-probabilities are written with binomial deviances and the small errors of
Stirling's formula (Loader's saddle-point form), so no large logarithms cancel:
their absolute error stays near 1e-10 at counts of 10^12.  The DataFrame-level
assembly is in ``annospark.operators.enrichment.fisher_columns``.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed numerical constants of the two-sided test.
TIE_TOLERANCE = 1e-7          # relative tolerance when comparing table probabilities
LEAST_LOG = -746.0            # exp of it is exactly 0 in double
CHUNK = 256                   # cells of the support summed from one anchor
_HALF_LOG_2PI = 0.5 * math.log(2.0 * math.pi)


def odds_ratio(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Sample odds ratio of ``[[a, b], [c, d]]``: a*d/(b*c), +inf when b*c = 0,
    NaN when a row or column total is 0."""
    degenerate = ((a + b) == 0) | ((c + d) == 0) | ((a + c) == 0) | ((b + d) == 0)
    bc = b.cast("double") * c.cast("double")
    return (F.when(degenerate, F.lit(float("nan")))
            .when(bc == 0, F.lit(float("inf")))
            .otherwise(a.cast("double") * d.cast("double") / bc))


def fisher_degenerate(a: Column, b: Column, c: Column, d: Column) -> Column:
    """A row or column total is zero: p = 1 and the odds ratio is NaN."""
    return ((a + b) == 0) | ((c + d) == 0) | ((a + c) == 0) | ((b + d) == 0)


# ---------------------------------------------------------------- numeric kernel
#: ln(n!) minus Stirling's main term for n up to 20.
_SMALL_ERRORS = np.array([0.0] + [math.log(math.factorial(n)) - (n + 0.5) * math.log(n) + n - _HALF_LOG_2PI for n in range(1, 21)])


def stirling_error(x: np.ndarray) -> np.ndarray:
    """ln(x!) minus Stirling's main term, x >= 1 (0 at 0, where it is not used)."""
    y = np.maximum(x, 1.0)
    y2 = y * y
    series = (1 / 12 - (1 / 360 - (1 / 1260 - 1 / 1680 / y2) / y2) / y2) / y
    return np.where(x <= 20, _SMALL_ERRORS[np.clip(x, 0, 20).astype(int)], series)


def deviance(x: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """x ln(x / mean) + mean - x, without cancellation where x is near the mean."""
    total = x + mean
    v = (x - mean) / np.where(total == 0, 1.0, total)
    v2 = v * v
    series = np.zeros_like(v)
    for k in range(9, 0, -1):  # |v| < 0.1: further terms are below the last bit
        series = v2 * (1 / (2 * k + 1) + series)
    with np.errstate(divide="ignore", invalid="ignore"):
        far = x * np.log(x / mean) + mean - x
    return np.where(x == 0, mean, np.where(np.abs(v) < 0.1, (x - mean) * v + 2 * x * v * series, far))


def log_binomial(x: np.ndarray, n: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """ln of the probability of x successes in n trials, p + q = 1."""
    with np.errstate(divide="ignore", invalid="ignore"):
        inner = (stirling_error(n) - stirling_error(x) - stirling_error(n - x) - deviance(x, n * p) - deviance(n - x, n * q)
                 - _HALF_LOG_2PI - 0.5 * (np.log(x) + np.log1p(-x / n)))
        none = np.where(p < 0.1, -deviance(n, n * q) - n * p, n * np.log(q))
        every = np.where(q < 0.1, -deviance(n, n * p) - n * q, n * np.log(p))
    return np.where(n == 0, 0.0, np.where(x == 0, none, np.where(x == n, every, inner)))


def log_hypergeometric(k: np.ndarray, n1: np.ndarray, n2: np.ndarray, r: np.ndarray) -> np.ndarray:
    """ln of the probability that k of r draws are among n1 of n1 + n2, for k in the support."""
    k, n1, n2, r = (np.asarray(a, float) for a in (k, n1, n2, r))
    n = np.maximum(n1 + n2, 1.0)
    p, q = r / n, (n - r) / n
    return log_binomial(k, n1, p, q) + log_binomial(r - k, n2, p, q) - log_binomial(r, n, p, q)


def first_below(value, limit: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The first j in [low, high) with value(j, rows) <= limit, for falling values; ``high`` if there is none."""
    low, high = low.copy(), high.copy()
    while len(rows := np.flatnonzero(low < high)):
        mid = (low[rows] + high[rows]) // 2
        found = value(mid, rows) <= limit[rows]
        high[rows] = np.where(found, mid, high[rows])
        low[rows] = np.where(found, low[rows], mid + 1)
    return high


def support_parts(tp: np.ndarray, tn: np.ndarray, fp: np.ndarray, fn: np.ndarray, chunk: int = CHUNK) -> dict[str, np.ndarray]:
    """The cells that can count for each table's p-value: ``row``, ``side`` (+1 or -1 from the mode), ``at`` (the cell
    nearest the mode), ``length``; and ``lp``, the log-probability of each table.

    On either side of the mode the probabilities fall outwards.  A side of more
    than two chunks is cut by bisection on the exact log-probability: at its
    inner end to the first cell that may be no more likely than the observed
    one, at its outer end to the last whose probability, relative to the
    observed one, is not exactly 0 in double.  So the number of cells follows
    from the standard deviation, not from the distance to the mode.
    """
    n1, n2, r = tp + fp, tn + fn, tp + tn
    low, high = np.maximum(0, r - n2), np.minimum(r, n1)
    # in doubles: the product of two longs overflows; a cell beside the mode is as likely in double
    mode = np.floor((r + 1.0) * ((n1 + 1.0) / (n1 + n2 + 2.0))).astype(np.int64)
    mode = np.clip(mode, low, high)
    lp = log_hypergeometric(tp, n1, n2, r)
    every = np.arange(len(tp))
    row = np.concatenate([every, every])
    side = np.repeat(np.array([1, -1]), len(tp))
    start = np.where(side > 0, 0, 1)
    stop = np.where(side > 0, (high - mode)[row], (mode - low)[row]) + 1

    def log_p(j: np.ndarray, rows: np.ndarray) -> np.ndarray:
        own = row[rows]
        return log_hypergeometric(mode[own] + side[rows] * j, n1[own], n2[own], r[own])
    kept = np.flatnonzero(stop > start)
    row, side, start, stop = row[kept], side[kept], start[kept], stop[kept]
    everything = np.arange(len(row))
    # a short side is summed whole, unless the ratio of its first cell to the observed one nears the largest double
    cut = np.flatnonzero((stop - start > 2 * chunk) | (log_p(start, everything) - lp[row] > -LEAST_LOG / 2))
    if len(cut):
        def of_cut(j: np.ndarray, rows: np.ndarray) -> np.ndarray:
            return log_p(j, cut[rows])
        # the cells at the inner end are compared one by one, so the bisection only has to err inwards
        start[cut] = first_below(of_cut, lp[row[cut]] + 10 * TIE_TOLERANCE, start[cut], stop[cut])
        stop[cut] = first_below(of_cut, lp[row[cut]] + LEAST_LOG, start[cut], stop[cut])
    kept = np.flatnonzero(stop > start)
    row, side, start, stop = row[kept], side[kept], start[kept], stop[kept]
    return {"row": row, "side": side, "at": mode[row] + side * start, "length": stop - start, "lp": lp}


def part_masses(at: np.ndarray, side: np.ndarray, length: np.ndarray, lp: np.ndarray, n1: np.ndarray, n2: np.ndarray,
                r: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """Sum of P(k) / P(observed) over ``length`` cells from ``at`` outwards, of cells no more likely than the observed.

    The cells are cut into chunks; each is anchored by the exact log-probability
    of its likeliest cell and summed by the ratio of neighbouring cells.
    """
    pieces = -(-length // chunk)
    part = np.repeat(np.arange(len(at)), pieces)
    offset = (np.arange(len(part)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * chunk
    width = np.minimum(chunk, length[part] - offset)
    anchor = at[part] + side[part] * offset
    sums = np.zeros(len(part))
    order = np.argsort(width, kind="stable")
    for rows in np.array_split(order, max(1, -(-len(order) // 2048))):   # of similar widths
        p = part[rows]
        relative = log_hypergeometric(anchor[rows], n1[p], n2[p], r[p]) - lp[p]
        step = np.arange(int(width[rows].max(initial=0)))
        k = anchor[rows][:, None] + side[p][:, None] * step.astype(float)
        a1, a2, ar = (x[p].astype(float)[:, None] for x in (n1, n2, r))
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(side[p][:, None] > 0, (a1 - k) * (ar - k) / ((k + 1) * (a2 - ar + k + 1)),
                             k * (a2 - ar + k) / ((a1 - k + 1) * (ar - k + 1)))
        ratio = np.where(step[None, :] + 1 < width[rows][:, None], ratio, 0.0)   # beyond the chunk
        terms = np.cumprod(np.concatenate([np.ones((len(rows), 1)), ratio[:, :-1]], axis=1), axis=1)
        likely = terms > np.exp(TIE_TOLERANCE - relative)[:, None]
        sums[rows] = np.where(likely, 0.0, terms).sum(axis=1) * np.exp(relative)
    return np.bincount(part, weights=sums, minlength=len(at))
