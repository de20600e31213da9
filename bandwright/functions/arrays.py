"""Row-local transforms of one spectrum, as Column expressions over ``array<double>``.

A value used inside a lambda is bound once per row with ``let``; without it Spark would
evaluate, say, the row mean again for every band.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-12


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and pass it to ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def doubles(values: Sequence[float]) -> Column:
    """Array literal, parsed in one go; Catalyst folds it to a single constant."""
    held = [float(v) for v in values]
    if held and np.isfinite(held).all():
        return F.expr(f"array({', '.join(f'{v!r}D' for v in held)})")
    return F.array(*[F.lit(v) for v in held]).cast("array<double>")


# ---- sums ------------------------------------------------------------------------------


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v)


def mean(x: Column) -> Column:
    return total(x) / F.size(x)


def sum_squares(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v * v)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda p, q: p * q))


def spread(x: Column, ddof: int = 0) -> Column:
    """Standard deviation, two-pass."""
    return let(
        x,
        lambda r: let(
            mean(r),
            lambda m: F.sqrt(
                F.aggregate(r, F.lit(0.0), lambda acc, v: acc + (v - m) * (v - m))
                / F.greatest(F.size(r) - ddof, F.lit(1))
            ),
        ),
    )


def linear_map(x: Column, rows: Sequence[Sequence[float]]) -> Column:
    """Dense matrix times spectrum; ``rows`` is small and fixed when the plan is built."""
    table = F.array(*[doubles(r) for r in rows])
    return let(x, lambda r: F.transform(table, lambda w: dot(w, r)))


# ---- scaling ---------------------------------------------------------------------------


def centre(x: Column) -> Column:
    return let(x, lambda r: let(mean(r), lambda m: F.transform(r, lambda v: v - m)))


def snv(x: Column, ddof: int = 1, zero: str = "floor") -> Column:
    """Standard normal variate. ``ddof=1`` floors the variance, ``ddof=0`` the deviation;
    ``zero='one'`` divides a constant spectrum by 1."""

    def scale(s: Column) -> Column:
        if zero == "one":
            return F.when(s == 0, F.lit(1.0)).otherwise(s)
        return F.greatest(s, F.lit(EPS**0.5 if ddof else EPS))

    return let(
        centre(x),
        lambda c: let(
            scale(F.sqrt(sum_squares(c) / F.greatest(F.size(c) - ddof, F.lit(1)))),
            lambda s: F.transform(c, lambda v: v / s),
        ),
    )


def _divide(x: Column, size: Callable[[Column], Column]) -> Column:
    return let(
        x,
        lambda r: let(F.greatest(size(r), F.lit(EPS)), lambda s: F.transform(r, lambda v: v / s)),
    )


def l2_normalise(x: Column) -> Column:
    return _divide(x, lambda r: F.sqrt(sum_squares(r)))


def area_normalise(x: Column) -> Column:
    return _divide(
        x, lambda r: F.aggregate(r, F.lit(0.0), lambda acc, v: acc + F.abs(v)) / F.size(r)
    )


def blend_raw_snv(x: Column, weight: float) -> Column:
    return let(
        x, lambda r: F.zip_with(r, snv(r), lambda a, b: a * (1.0 - weight) + b * weight)
    )


# ---- differences -----------------------------------------------------------------------


def lagged(x: Column, lag: int, fn: Callable[[Column, Column], Column]) -> Column:
    """``fn(x[i+lag], x[i])`` for every i that has both."""
    return let(
        x,
        lambda r: let(
            F.greatest(F.size(r) - lag, F.lit(0)),
            lambda n: F.zip_with(F.slice(r, lag + 1, n), F.slice(r, 1, n), fn),
        ),
    )


def difference(x: Column, order: int = 1) -> Column:
    for _ in range(order):
        x = lagged(x, 1, lambda b, a: b - a)
    return x


def padded_difference(x: Column, order: int = 1, pad: str = "zero") -> Column:
    """``pad='zero'`` puts leading zeros, ``pad='repeat'`` repeats the first difference."""
    if pad == "zero":
        return F.concat(F.array_repeat(F.lit(0.0), order), difference(x, order))
    for _ in range(order):
        x = let(difference(x), lambda g: F.concat(F.slice(g, 1, 1), g))
    return x


# ---- smoothing -------------------------------------------------------------------------


def moving_average(x: Column, window: int, edge: str = "shrink") -> Column:
    """Centred mean; at the ends the window shrinks or the end value is repeated."""
    radius = window // 2

    def shrinking(r: Column) -> Column:
        return F.transform(
            r,
            lambda v, k: mean(
                F.slice(
                    r,
                    F.greatest(k - radius, F.lit(0)) + 1,
                    F.least(k + radius + 1, F.size(r)) - F.greatest(k - radius, F.lit(0)),
                )
            ),
        )

    def replicated(r: Column) -> Column:
        padded = F.concat(
            F.array_repeat(F.element_at(r, 1), radius), r, F.array_repeat(F.element_at(r, -1), radius)
        )
        return let(
            padded, lambda p: F.transform(r, lambda v, k: total(F.slice(p, k + 1, 2 * radius + 1)) / (2 * radius + 1))
        )

    return let(x, shrinking if edge == "shrink" else replicated)


# 5-point quadratic smoothing weights.
SMOOTH5_WEIGHTS = (-3.0, 12.0, 17.0, 12.0, -3.0)
SMOOTH5_SCALE = 35.0


def smooth5(x: Column) -> Column:
    """5-point smoothing; the ends are means of 2 and 3 points, short rows are kept."""

    def at(r: Column, k: Column) -> Column:
        def window_mean(first: Column, count: int) -> Column:
            return total(F.slice(r, first + 1, count)) / count

        n = F.size(r)
        return (
            F.when(k == 0, window_mean(F.lit(0), 2))
            .when(k == n - 1, window_mean(n - 2, 2))
            .when(k == 1, window_mean(F.lit(0), 3))
            .when(k == n - 2, window_mean(n - 3, 3))
            .otherwise(dot(doubles(SMOOTH5_WEIGHTS), F.slice(r, k - 1, 5)) / SMOOTH5_SCALE)
        )

    return let(x, lambda r: F.when(F.size(r) < 5, r).otherwise(F.transform(r, lambda v, k: at(r, k))))


def savgol_weights(window: int, order: int, deriv: int) -> np.ndarray:
    """Row p holds the weights that evaluate the window's polynomial fit at position p."""
    pos = np.arange(window, dtype=float)
    centre_at = (window - 1) / 2
    powers = np.vander(pos - centre_at, order + 1, increasing=True)
    fit = np.linalg.pinv(powers)
    out = np.zeros((window, window))
    for p in range(window):
        t = p - centre_at
        basis = np.zeros(order + 1)
        for q in range(deriv, order + 1):
            factor = float(np.prod(np.arange(q - deriv + 1, q + 1))) if deriv else 1.0
            basis[q] = factor * t ** (q - deriv)
        out[p] = basis @ fit
    return out


def savgol(x: Column, window: int = 9, order: int = 2, deriv: int = 0) -> Column:
    """Savitzky-Golay filter; the ends use the polynomial fitted to the first and last window."""
    table = savgol_weights(window, order, deriv)
    half = window // 2

    def row(r: Column) -> Column:
        n = F.size(r)
        head = linear_map(F.slice(r, 1, window), table[:half])
        tail = linear_map(F.slice(r, n - window + 1, window), table[half + 1 :])
        body = let(
            doubles(table[half]),
            lambda w: F.transform(F.sequence(F.lit(1), n - window + 1), lambda s: dot(w, F.slice(r, s, window))),
        )
        return F.concat(head, body, tail)

    return let(x, row)


# ---- baselines -------------------------------------------------------------------------


def detrend(x: Column) -> Column:
    """Subtract the least-squares line; any evenly spaced axis gives the same residual."""

    def row(c: Column) -> Column:
        n = F.size(c).cast("double")
        middle = (n - 1) / 2
        sxy = F.aggregate(
            F.zip_with(c, F.sequence(F.lit(0), F.size(c) - 1), lambda v, k: v * (k - middle)),
            F.lit(0.0),
            lambda acc, v: acc + v,
        )
        sxx = n * (n * n - 1) / 12
        return let(
            F.struct((sxy / F.greatest(sxx, F.lit(EPS))).alias("b"), middle.alias("m")),
            lambda s: F.transform(c, lambda v, k: v - s["b"] * (k - s["m"])),
        )

    return let(centre(x), row)


def scatter_correct(x: Column, reference: Column, tiny: float = EPS) -> Column:
    """MSC: regress the row on the reference and undo intercept and slope. ``tiny`` replaces a
    slope within 1e-12 of zero (1e-12 or 1)."""

    def row(r: Column, ref: Column) -> Column:
        return let(
            F.struct(mean(r).alias("rm"), mean(ref).alias("fm")),
            lambda m: let(
                dot(F.transform(r, lambda v: v - m["rm"]), F.transform(ref, lambda v: v - m["fm"]))
                / F.greatest(sum_squares(F.transform(ref, lambda v: v - m["fm"])), F.lit(EPS)),
                lambda s: let(
                    F.when(F.abs(s) <= EPS, F.lit(tiny)).otherwise(s),
                    lambda b: F.transform(r, lambda v: (v - (m["rm"] - b * m["fm"])) / b),
                ),
            ),
        )

    return let(x, lambda r: let(reference, lambda ref: row(r, ref)))


def extended_scatter_correct(x: Column, reference: Sequence[float], degree: int = 2) -> Column:
    """EMSC: row on [reference, 1, t .. t^degree]; remove the baseline, divide by the scale.
    A scale under 1e-12 counts as 1."""
    ref = np.asarray(reference, dtype=float)
    t = np.linspace(-1.0, 1.0, len(ref))
    base = np.vstack([t**q for q in range(degree + 1)])
    fit = np.linalg.pinv(np.vstack([ref, base]).T)

    def row(r: Column, coef: Column) -> Column:
        scale = F.when(F.abs(F.element_at(coef, 1)) < EPS, F.lit(1.0)).otherwise(F.element_at(coef, 1))
        baseline = linear_map(F.slice(coef, 2, degree + 1), base.T)
        return let(scale, lambda s: F.zip_with(r, baseline, lambda v, b: (v - b) / s))

    return let(x, lambda r: let(linear_map(r, fit), lambda coef: row(r, coef)))


# ---- selection -------------------------------------------------------------------------


def band_slice(x: Column, centre_at: int, radius: int) -> Column:
    """Bands [centre - radius, centre + radius], clamped to the row."""
    lo = max(0, centre_at - radius)
    return F.slice(x, lo + 1, centre_at + radius + 1 - lo)


def band_interval(x: Column, start: int, end: int) -> Column:
    """Bands [start, end)."""
    return F.slice(x, start + 1, end - start)


def pick(x: Column, bands: Sequence[int]) -> Column:
    return F.transform(F.array(*[F.lit(int(b)) for b in bands]), lambda b: F.get(x, b))


def median3(a: Column, b: Column, c: Column) -> Column:
    """Middle of three numbers."""
    return F.greatest(F.least(a, b), F.least(F.greatest(a, b), c))


# ---- multi-view ------------------------------------------------------------------------


def multiview(x: Column) -> Column:
    return F.concat(
        x,
        moving_average(x, 3),
        moving_average(x, 5),
        centre(x),
        snv(x),
        padded_difference(x, 1),
        padded_difference(x, 2),
    )


def derivative_stack(x: Column, window: int = 9, order: int = 2, deriv: int = 1) -> Column:
    """SNV of the smoothed row joined with the derivative of the row's SNV."""
    return F.concat(
        snv(savgol(x, window, order, 0), ddof=0),
        savgol(snv(x, ddof=0), window, order, deriv),
    )
