"""The 25 named preprocessors as DataFrame functions with a fit/transform split.

Only scatter correction learns anything (its reference spectrum), and only the ``meta`` ones add
columns; they keep group number and position as columns and append them to the array.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import arrays as A


@dataclass(frozen=True)
class Preprocessor:
    """``fit(df)`` returns parameters, ``transform(df, params)`` replaces column ``x``."""

    name: str
    apply: Callable[[Column], Column]
    learns_reference: bool = False
    appends_meta: bool = False

    def fit(self, df: DataFrame) -> list[float] | None:
        if not self.learns_reference:
            return None
        from ..operators.moments import mean_spectrum

        return mean_spectrum(df)

    def transform(self, df: DataFrame, params: list[float] | None = None) -> DataFrame:
        if self.learns_reference:
            if params is None:
                raise RuntimeError(f"{self.name}: call fit first")
            return df.withColumn("x", A.scatter_correct(F.col("x"), A.doubles(params)))
        out = df.withColumn("x", self.apply(F.col("x")))
        if self.appends_meta:
            from ..operators.ordered import group_position

            out = group_position(out, "grp", "seq", "position").withColumn(
                "x",
                F.concat("x", F.array(F.coalesce(F.col("grp").cast("double"), F.lit(0.0)), F.col("position"))),
            )
        return out


def _diff(x: Column, order: int = 1) -> Column:
    return A.difference(x, order)


_TABLE: dict[str, Callable[[Column], Column]] = {
    "spectral": lambda x: x,
    "spectral_snv": A.snv,
    "spectral_diff1": _diff,
    "spectral_diff2": lambda x: _diff(x, 2),
    "spectral_snv_diff1": lambda x: _diff(A.snv(x)),
    "spectral_meta": lambda x: x,
    "spectral_snv_diff1_meta": lambda x: _diff(A.snv(x)),
    "spectral_snv_diff2": lambda x: _diff(A.snv(x), 2),
    "spectral_center": A.centre,
    "spectral_l2norm": A.l2_normalise,
    "spectral_blend_snv25": lambda x: A.blend_raw_snv(x, 0.25),
    "spectral_blend_snv50": lambda x: A.blend_raw_snv(x, 0.5),
    "spectral_smooth3": lambda x: A.moving_average(x, 3),
    "spectral_smooth5": lambda x: A.moving_average(x, 5),
    "spectral_smooth": lambda x: A.moving_average(x, 9),
    "spectral_smooth_diff1": lambda x: _diff(A.moving_average(x, 9)),
    "spectral_snv_smooth_diff1": lambda x: _diff(A.moving_average(A.snv(x), 9)),
    "spectral_sg_diff1": lambda x: _diff(A.smooth5(x)),
    "spectral_snv_sg_diff1": lambda x: _diff(A.smooth5(A.snv(x))),
    "spectral_snv_sg_diff1_meta": lambda x: _diff(A.smooth5(A.snv(x))),
    "spectral_area": A.area_normalise,
    "spectral_snv_area_diff1": lambda x: _diff(A.area_normalise(A.snv(x))),
    "spectral_detrend": A.detrend,
    "spectral_msc": lambda x: x,
    "spectral_multiview": A.multiview,
}

PREPROCESSORS: dict[str, Preprocessor] = {
    name: Preprocessor(
        name, fn, learns_reference=name == "spectral_msc", appends_meta=name.endswith("_meta")
    )
    for name, fn in _TABLE.items()
}


def get_preprocessor(name: str) -> Preprocessor:
    if name not in PREPROCESSORS:
        raise KeyError(f"unknown preprocessor {name}; known: {sorted(PREPROCESSORS)}")
    return PREPROCESSORS[name]
