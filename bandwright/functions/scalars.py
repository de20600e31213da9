"""Scalar, text and number functions (FN)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def parse_number(c: Column) -> Column:
    """Blank text is missing; so is text that is no number, and a number that is not finite."""
    v = F.nullif(F.trim(c), F.lit("")).try_cast("double")
    return F.when(is_finite(v), v)


def is_finite(v: Column) -> Column:
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))


def group_label(number: Column, name: Column) -> Column:
    """``n:name``; a missing name becomes ``species_n``."""
    n = F.trim(number.cast("string"))
    return F.concat_ws(":", n, F.coalesce(name, F.concat(F.lit("species_"), n)))


def text_sort_key(c: Column) -> list[Column]:
    """Integers first in number order, then text."""
    return [c.try_cast("int").asc_nulls_last(), c.asc()]


def weight_from_name(name: Column, prefix: str) -> Column:
    """``prefix`` + ``m`` + digits stands for -digits/100."""
    digits = F.regexp_extract(name, f"^{prefix}m([0-9]+)$", 1)
    return -(F.nullif(digits, F.lit("")).try_cast("double") / 100)


def utc_stamp() -> Column:
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX")


def bin_by_edges(v: Column, edges: Sequence[float]) -> Column:
    """Index of the first edge greater than the value; the last bin is open."""
    return F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]), lambda e: e <= v))


def softmax(z: str, keys: Sequence[str]) -> Column:
    """Max-shifted softmax over the bounded set of alternatives of one row."""
    w = Window.partitionBy(*keys)
    e = F.exp(F.col(z) - F.max(z).over(w))
    return e / F.sum(e).over(w)


def softmax_array(z: Column) -> Column:
    from .arrays import let, total

    return let(
        z,
        lambda r: let(
            F.array_max(r),
            lambda top: let(
                F.transform(r, lambda v: F.exp(v - top)),
                lambda e: let(total(e), lambda t: F.transform(e, lambda v: v / t)),
            ),
        ),
    )


def clip(v: Column, lo: Column | float | None, hi: Column | float | None) -> Column:
    if hi is not None:
        v = F.least(v, hi if isinstance(hi, Column) else F.lit(float(hi)))
    if lo is not None:
        v = F.greatest(v, lo if isinstance(lo, Column) else F.lit(float(lo)))
    return v


def finite_or(v: Column, fallback: Column) -> Column:
    return F.when(is_finite(v), v).otherwise(fallback)


# ---- power transforms (TGT-2..5) -------------------------------------------------------


def yeo_johnson(y: Column, lam: float | Column) -> Column:
    lam = lam if isinstance(lam, Column) else F.lit(float(lam))
    up = F.when(F.abs(lam) < 1e-12, F.log1p(y)).otherwise((F.pow(y + 1, lam) - 1) / lam)
    mirror = F.lit(2.0) - lam
    down = F.when(F.abs(mirror) < 1e-12, -F.log1p(-y)).otherwise(-(F.pow(1 - y, mirror) - 1) / mirror)
    return F.when(y >= 0, up).otherwise(down)


def yeo_johnson_inverse(t: Column, lam: float) -> Column:
    floor = F.lit(1e-12)
    up = F.expm1(t) if abs(lam) < 1e-12 else F.pow(F.greatest(t * lam + 1, floor), F.lit(1 / lam)) - 1
    m = 2.0 - lam
    down = -F.expm1(-t) if abs(m) < 1e-12 else 1 - F.pow(F.greatest(1 - t * m, floor), F.lit(1 / m))
    return F.when(t >= 0, up).otherwise(down)


def box_cox(y: Column, lam: float | Column) -> Column:
    lam = lam if isinstance(lam, Column) else F.lit(float(lam))
    return F.when(F.abs(lam) < 1e-12, F.log(y)).otherwise((F.pow(y, lam) - 1) / lam)


def box_cox_inverse(t: Column, lam: float) -> Column:
    if abs(lam) < 1e-12:
        return F.exp(t)
    return F.pow(F.greatest(t * lam + 1, F.lit(1e-12)), F.lit(1 / lam))


# Coefficients of a published rational approximation of the normal quantile.
_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)


def _horner(coef: Sequence[float], t: Column) -> Column:
    out = F.lit(coef[0])
    for c in coef[1:]:
        out = out * t + c
    return out


def normal_quantile(p: Column) -> Column:
    """Inverse of the normal distribution function, relative error about 1e-9."""
    def tail(q: Column) -> Column:
        r = F.sqrt(-2 * F.log(q))
        return _horner(_C, r) / _horner(_D, r)

    middle = p - 0.5
    core = _horner(_A, middle * middle) * middle / _horner(_B, middle * middle)
    return F.when(p < 0.02425, tail(p)).when(p > 1 - 0.02425, -tail(1 - p)).otherwise(core)
