"""Feature blocks cut from one spectrum: window statistics, shape, contrast, DCT, perturbation."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import arrays as A

WINDOW_STATS = ("mean", "std", "min", "max", "range", "slope", "curvature", "edge", "center_minus_mean")

# Window widths of the scan; the step equals the width.
WINDOW_WIDTHS = (4, 6, 8, 10, 16, 20, 32, 40, 64, 80, 128, 160, 240)

# Fixed values: [start, end) of the 16 level windows on the 1555-band axis.
LEVEL_WINDOWS = (
    (1332, 1336), (1352, 1356), (680, 720), (1192, 1196), (908, 912), (708, 712), (1344, 1348),
    (1330, 1340), (576, 580), (828, 832), (1320, 1324), (1200, 1440), (1320, 1360), (1480, 1500),
    (640, 720), (816, 832),
)


def split_points(n: int, bins: int) -> list[tuple[int, int]]:
    """[start, end) of ``bins`` slices, the first ones longer by one when n is not a multiple."""
    base, extra = divmod(n, bins)
    edges = [0]
    for b in range(bins):
        edges.append(edges[-1] + base + (1 if b < extra else 0))
    return list(zip(edges[:-1], edges[1:]))


# ---- windows ---------------------------------------------------------------------------


def window_stat(block: Column, width: Column | int, stat: str) -> Column:
    """One statistic of a window. The width may be a column, so one expression serves all windows."""
    w = (F.lit(width) if isinstance(width, int) else width).cast("double")

    def projected(weight, norm: Column) -> Column:
        """sum of weight(k - middle) * block[k] over the sum of squared weights."""
        terms = F.zip_with(block, F.sequence(F.lit(0), F.size(block) - 1), lambda v, k: v * weight(k - (w - 1) / 2))
        return A.total(terms) / F.greatest(norm, F.lit(A.EPS))

    if stat == "mean":
        return A.total(block) / w
    if stat == "std":
        return A.spread(block)
    if stat == "min":
        return F.array_min(block)
    if stat == "max":
        return F.array_max(block)
    if stat == "range":
        return F.array_max(block) - F.array_min(block)
    if stat == "slope":
        return projected(lambda a: a, w * (w * w - 1) / 12)
    if stat == "curvature":
        return projected(lambda a: a * a - (w * w - 1) / 12, w * (w * w - 1) * (w * w - 4) / 180)
    if stat == "edge":
        return F.element_at(block, -1) - F.element_at(block, 1)
    if stat == "center_minus_mean":
        return F.get(block, F.floor(w / 2).cast("int")) - A.total(block) / w
    raise ValueError(f"unknown statistic {stat}")


def windows(n: int, width: int, step: int) -> list[tuple[int, int]]:
    """[start, end) over n bands; windows under 3 points are left out."""
    cut = [(s, min(s + width, n)) for s in range(0, n, step)]
    return [(s, e) for s, e in cut if e - s >= 3]


def window_grid(n: int) -> list[tuple[int, int]]:
    """All windows of the scan over n bands, without repeats."""
    return list(dict.fromkeys(span for w in WINDOW_WIDTHS for span in windows(n, w, w)))


def span_table(spans: Sequence[tuple[int, int]]) -> Column:
    """The windows as an array literal of (s, e)."""
    return F.expr("array(" + ", ".join(f"named_struct('s', {a}, 'e', {b})" for a, b in spans) + ")")


def window_features(x: Column, spans: Sequence[tuple[int, int]], stats: Sequence[str]) -> Column:
    """Array of statistics, window by window. The plan does not grow with the number of windows."""

    def block(r: Column, s: Column) -> Column:
        width = s["e"] - s["s"]
        return A.let(F.slice(r, s["s"] + 1, width), lambda b: F.array(*[window_stat(b, width, t) for t in stats]))

    return A.let(x, lambda r: F.flatten(F.transform(span_table(spans), lambda s: block(r, s))))


def window_rows(x: Column, spans: Sequence[tuple[int, int]], stats: Sequence[str]) -> Column:
    """Array of (win_start, win_end, stat, v) structs, ready for ``inline``."""

    def block(r: Column, s: Column) -> Column:
        width = s["e"] - s["s"]
        return A.let(
            F.slice(r, s["s"] + 1, width),
            lambda b: F.array(
                *[
                    F.struct(
                        s["s"].cast("bigint").alias("win_start"),
                        s["e"].cast("bigint").alias("win_end"),
                        F.lit(t).alias("stat"),
                        window_stat(b, width, t).cast("double").alias("v"),
                    )
                    for t in stats
                ]
            ),
        )

    return A.let(x, lambda r: F.flatten(F.transform(span_table(spans), lambda s: block(r, s))))


def segment_means(x: Column, spans: Sequence[tuple[int, int]]) -> Column:
    return window_features(x, spans, ("mean",))


def adjacent_contrast(means: Column) -> Column:
    return A.lagged(
        means, 1, lambda b, a: (b - a) / F.greatest(F.abs(a) + F.abs(b), F.lit(A.EPS))
    )


def anchor_ratios(x: Column, means: Column, centre_at: int, radius: int) -> Column:
    """Segment means minus, over, and symmetrically over the anchor level."""
    level = A.mean(A.band_slice(x, centre_at, radius))

    def blocks(m: Column, a: Column) -> Column:
        return F.concat(
            F.transform(m, lambda v: v - a),
            F.transform(m, lambda v: v / F.greatest(F.abs(a), F.lit(A.EPS))),
            F.transform(m, lambda v: (v - a) / F.greatest(F.abs(v) + F.abs(a), F.lit(A.EPS))),
        )

    return A.let(means, lambda m: A.let(level, lambda a: blocks(m, a)))


def anchor_shape(x: Column, n: int, centre_at: int, radii: Sequence[int] = (2, 5, 10, 20, 40)) -> Column:
    """Eight shape numbers per radius around one band."""

    def one(r: Column, radius: int) -> Column:
        lo, hi = max(0, centre_at - radius), min(n, centre_at + radius + 1)
        width = hi - lo
        mid = width // 2

        def numbers(b: Column) -> Column:
            left = A.mean(F.slice(b, 1, max(1, mid)))
            tail = width - min(width, mid + 1)
            right = A.mean(F.slice(b, min(width, mid + 1) + 1, tail)) if tail else F.element_at(b, -1)
            area = A.total(A.lagged(b, 1, lambda q, p: (p + q) / 2))
            return F.array(
                window_stat(b, width, "mean"),
                window_stat(b, width, "std"),
                window_stat(b, width, "range"),
                window_stat(b, width, "slope"),
                window_stat(b, width, "curvature"),
                left - right,
                F.get(b, F.lit(mid)) - (left + right) / 2,
                area,
            )

        return A.let(A.band_interval(r, lo, hi), numbers)

    return A.let(x, lambda r: F.flatten(F.array(*[one(r, q) for q in radii])))


def level_minus_mean(x: Column, spans: Sequence[tuple[int, int]] = LEVEL_WINDOWS) -> Column:
    """Mean of each window minus the row mean; a window outside the row gives 0."""

    def level(r: Column, m: Column, s: int, e: int) -> Column:
        cut = A.band_interval(r, s, e)
        return F.when(F.size(r) <= s, F.lit(0.0)).otherwise(A.mean(cut) - m)

    return A.let(x, lambda r: A.let(A.mean(r), lambda m: F.array(*[level(r, m, s, e) for s, e in spans])))


# ---- shape, frequency, events ----------------------------------------------------------


def dct_rows(n: int, which: Sequence[int]) -> list[list[float]]:
    """Rows of the orthonormal DCT-II matrix."""
    rows = []
    for k in which:
        scale = math.sqrt((1 if k == 0 else 2) / n)
        rows.append([scale * math.cos(math.pi * (2 * j + 1) * k / (2 * n)) for j in range(n)])
    return rows


def dct_low(x: Column, n: int, count: int = 8) -> Column:
    return A.linear_map(x, dct_rows(n, range(min(count, n))))


def dct_features(x: Column, n: int) -> Column:
    """8 low coefficients and the running energies of the 6 highest."""
    high = [n - 1 - k for k in range(min(6, n))]

    def running(c: Column) -> Column:
        return F.transform(c, lambda v, k: F.sqrt(A.sum_squares(F.slice(c, 1, k + 1))))

    return A.let(
        x, lambda r: F.concat(dct_low(r, n), A.let(A.linear_map(r, dct_rows(n, high)), running))
    )


def shape_features(x: Column, n: int, size: int = 14) -> Column:
    """4, 6, 10 or 14 numbers: derivative statistics, quarter means, first DCT coefficients."""

    def numbers(r: Column, g: Column, h: Column) -> list[Column]:
        def abs_(a: Column) -> Column:
            return F.transform(a, lambda v: F.abs(v))

        out = [A.mean(g), A.spread(g), F.array_max(abs_(g)), A.mean(abs_(h))]
        if size >= 6:
            out += [A.spread(h), F.array_max(abs_(h))]
        if size >= 10:
            out += [A.mean(A.band_interval(r, s, e)) for s, e in split_points(n, 4)]
        return out

    def row(r: Column) -> Column:
        base = A.let(
            A.difference(r), lambda g: A.let(A.difference(g), lambda h: F.array(*numbers(r, g, h)))
        )
        return F.concat(base, dct_low(r, n, 4)) if size >= 14 else base

    return A.let(x, row)


def event_features(x: Column, n: int) -> Column:
    """Extremes, difference sizes, places of the extremes, and left against right mean rank."""

    def rank_gap(r: Column) -> Column:
        order = F.array_sort(
            F.transform(r, lambda v, k: F.struct(v.alias("v"), k.alias("k")))
        )
        half = n // 2
        places = F.transform(order, lambda s, rank: F.struct(s["k"].alias("k"), rank.alias("rank")))

        def side(ranked: Column, left: bool) -> Column:
            def keep(s: Column) -> Column:
                return (s["k"] < half) if left else (s["k"] >= half)

            return F.aggregate(
                F.filter(ranked, keep), F.lit(0.0), lambda acc, s: acc + s["rank"]
            ) / (half if left else n - half)

        return A.let(places, lambda p: (side(p, True) - side(p, False)) / max(1, n - 1))

    def row(r: Column, g: Column, h: Column) -> Column:
        last = max(1, n - 1)
        return F.array(
            F.array_max(r),
            F.array_min(r),
            F.array_max(r) - F.array_min(r),
            F.array_max(F.transform(g, lambda v: F.abs(v))),
            A.mean(F.transform(g, lambda v: F.abs(v))),
            F.array_max(F.transform(h, lambda v: F.abs(v))),
            A.mean(F.transform(h, lambda v: F.abs(v))),
            (F.array_position(r, F.array_max(r)) - 1) / last,
            (F.array_position(r, F.array_min(r)) - 1) / last,
            rank_gap(r),
        )

    return A.let(
        x, lambda r: A.let(A.difference(r), lambda g: A.let(A.difference(g), lambda h: row(r, g, h)))
    )


# Segments as (first, end) quarters of the axis, and what is added to both sides of a ratio.
CONTRAST_QUARTERS = ((0, 1), (1, 2), (2, 3), (3, 4), (0, 2), (2, 4))
CONTRAST_OFFSET = 1e-6


def contrast_features(x: Column, n: int) -> Column:
    """Segment means, then difference and ratio of each mean with every later one."""
    bounds = [(n * first // 4, n * end // 4) for first, end in CONTRAST_QUARTERS]
    segments = F.array(*[F.struct(F.lit(first + 1).alias("at"), F.lit(end - first).alias("size")) for first, end in bounds if end > first])
    means = F.transform(segments, lambda s: A.mean(F.slice(x, s["at"], s["size"])))

    def against_later(m: Column) -> Column:
        later = lambda place: F.slice(m, place + 2, F.size(m))
        pair = lambda a, b: F.array(a - b, (a + CONTRAST_OFFSET) / (b + CONTRAST_OFFSET))
        return F.flatten(F.flatten(F.transform(m, lambda a, place: F.transform(later(place), lambda b: pair(a, b)))))

    return A.let(means, lambda m: F.concat(m, against_later(m)))


def segment_features(x: Column, n: int) -> Column:
    """Mean and deviation of 4, 5 and 10 uneven bins."""
    spans = [span for bins in (4, 5, 10) for span in split_points(n, bins)]

    def block(r: Column, s: int, e: int) -> Column:
        return A.let(A.band_interval(r, s, e), lambda b: F.array(A.mean(b), A.spread(b)))

    return A.let(x, lambda r: F.flatten(F.array(*[block(r, s, e) for s, e in spans])))


def safe_denominator(v: Column) -> Column:
    return F.when(F.abs(v) < 1e-3, F.when(v < 0, F.lit(-1e-3)).otherwise(F.lit(1e-3))).otherwise(v)


def ratio_features(x: Column, n: int) -> Column:
    """Lag 1-3 ratios and differences and 5-segment contrasts, clipped to 20 in size."""

    def segments(m: Column) -> Column:
        at = [F.get(m, F.lit(k)) for k in range(5)]
        out = []
        for a in range(5):
            for b in range(a + 1, 5):
                out += [at[a] - at[b], at[a] / safe_denominator(at[b])]
        return F.array(*out)

    def row(r: Column) -> Column:
        blocks = []
        for lag in (1, 2, 3):
            blocks.append(A.lagged(r, lag, lambda b, a: b / safe_denominator(a)))
            blocks.append(A.lagged(r, lag, lambda b, a: b - a))
        means = F.array(*[A.mean(A.band_interval(r, s, e)) for s, e in split_points(n, 5)])
        return F.concat(*blocks, A.let(means, segments))

    return F.transform(
        A.let(x, row),
        lambda v: F.when(F.isnan(v), F.lit(0.0)).otherwise(F.greatest(F.least(v, F.lit(20.0)), F.lit(-20.0))),
    )


# ---- named unions and key strings ------------------------------------------------------


def _sg_snv(x: Column, window: int) -> Column:
    return A.snv(A.savgol(x, window), ddof=0, zero="one")


SEARCH_VIEWS = (
    "raw", "smooth5", "snv", "diff1", "diff2", "smooth5_diff1", "snv_diff1", "snv_diff2",
)


def _snv(x: Column) -> Column:
    return A.snv(x, ddof=0, zero="one")


def _smooth(x: Column, width: int) -> Column:
    return A.moving_average(x, width, edge="replicate")


def _corrected(x: Column, width: int, reference: Sequence[float] | None) -> Column:
    """Smoothed spectrum brought onto the mean smoothed spectrum of the fit rows."""
    if reference is None:
        raise ValueError("a scatter-corrected view needs the mean smoothed spectrum of the fit rows")
    return A.scatter_correct(A.savgol(x, width), A.doubles(reference), tiny=1.0)


# Views used by name in the searches, from a spectrum and, where one is needed, a reference spectrum.
VIEWS: dict[str, Callable[[Column, Sequence[float] | None], Column]] = {
    "raw": lambda x, _: x,
    "center": lambda x, _: A.centre(x),
    "snv": lambda x, _: _snv(x),
    "detrend_snv": lambda x, _: A.detrend(_snv(x)),
    "smooth5": lambda x, _: _smooth(x, 5),
    "smooth11": lambda x, _: _smooth(x, 11),
    "diff1": lambda x, _: A.difference(x, 1),
    "diff2": lambda x, _: A.difference(x, 2),
    "snv_diff1": lambda x, _: A.difference(_snv(x), 1),
    "snv_diff2": lambda x, _: A.difference(_snv(x), 2),
    "smooth5_diff1": lambda x, _: A.difference(_smooth(x, 5), 1),
    "sg7_snv": lambda x, _: _sg_snv(x, 7),
    "sg9_snv": lambda x, _: _sg_snv(x, 9),
    "sg11_snv": lambda x, _: _sg_snv(x, 11),
    "sg9_snv_d1": lambda x, _: A.savgol(_snv(x), 11, 2, 1),
    "sg9_snv_d2": lambda x, _: A.savgol(_snv(x), 11, 2, 2),
    "sg9_snv_stack_d1": lambda x, _: F.concat(_sg_snv(x, 9), A.savgol(_snv(x), 11, 2, 1)),
    "sg9_snv_stack_d2": lambda x, _: F.concat(_sg_snv(x, 9), A.savgol(_snv(x), 11, 2, 2)),
    "msc_sg7": lambda x, reference: _corrected(x, 7, reference),
    "msc_sg9": lambda x, reference: _corrected(x, 9, reference),
    "msc_sg11": lambda x, reference: _corrected(x, 11, reference),
}


def view(x: Column, name: str, reference: Sequence[float] | None = None) -> Column:
    if name not in VIEWS:
        raise ValueError(f"unknown view {name}")
    return VIEWS[name](x, reference)


def feature_set(x: Column, n: int, name: str, reference: Sequence[float] | None = None) -> Column:
    """Named unions of the blocks above."""
    sg = _sg_snv(x, 9)
    snv0 = A.snv(x, ddof=0, zero="one")

    def d(order: int) -> Column:
        return A.padded_difference(sg, order, pad="repeat")

    blocks = {
        "shape_compact": lambda: [segment_features(sg, n), event_features(sg, n), dct_low(snv0, n)],
        "shape_ratios": lambda: [segment_features(sg, n), ratio_features(sg, n), contrast_features(sg, n)],
        "shape_deriv": lambda: [d(1), d(2), event_features(sg, n), dct_features(snv0, n)],
        "shape_all": lambda: [
            sg, d(1), d(2), segment_features(sg, n), ratio_features(sg, n), event_features(sg, n),
            contrast_features(sg, n), dct_features(snv0, n),
        ],
        "mv_core": lambda: [x, snv0, sg, view(x, "msc_sg9", reference), d(1), event_features(sg, n)],
        "mv_dct": lambda: [
            snv0, A.detrend(snv0), dct_features(snv0, n), d(1), d(2), contrast_features(sg, n),
        ],
        "mv_contrast": lambda: [sg, d(1), d(2), event_features(sg, n), contrast_features(sg, n)],
        "event": lambda: [event_features(sg, n), contrast_features(sg, n)],
    }
    if name not in blocks:
        raise ValueError(f"unknown feature set {name}")
    return F.concat(*blocks[name]())


def parse_key(key: str) -> tuple[str, str, int, int]:
    """``view:stat:start:end``."""
    name, stat, start, end = key.split(":")
    return name, stat, int(start), int(end)


def features_from_keys(x: Column, keys: Sequence[str]) -> Column:
    """One number per key; each view is built once per row."""
    parsed = [parse_key(k) for k in keys]
    names = sorted({p[0] for p in parsed})
    views = F.struct(*[view(x, v).alias(v) for v in names])

    def one(v: Column, name: str, stat: str, s: int, e: int) -> Column:
        return A.let(A.band_interval(v[name], s, e), lambda b: window_stat(b, e - s, stat))

    return A.let(views, lambda v: F.array(*[one(v, *p) for p in parsed]))


# ---- perturbation ----------------------------------------------------------------------


def unit_normal(*parts: Column | int) -> Column:
    """A standard normal number fixed by its key, so that a rerun of a task agrees."""

    def uniform(salt: int) -> Column:
        h = F.xxhash64(*[p if isinstance(p, Column) else F.lit(p) for p in parts], F.lit(salt))
        return (F.pmod(h, F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)

    return F.sqrt(-2.0 * F.log(uniform(1))) * F.cos(2 * math.pi * uniform(2))


def shift_bands(x: Column, offset: Column) -> Column:
    """Linear interpolation at band + offset, end values held."""

    def at(r: Column, o: Column, k: Column) -> Column:
        last = F.size(r) - 1
        p = F.greatest(F.lit(0.0), F.least(k + o, last.cast("double")))
        lo = F.least(F.floor(p).cast("int"), F.greatest(last - 1, F.lit(0)))
        hi = F.least(lo + 1, last)
        return F.get(r, lo) + (p - lo) * (F.get(r, hi) - F.get(r, lo))

    return A.let(x, lambda r: A.let(offset, lambda o: F.transform(r, lambda v, k: at(r, o, k))))


def perturb(x: Column, row_id: Column, scale: float, seed: int) -> Column:
    """Random offset, gain, per-band noise and sub-band shift, keyed by row id and seed."""
    draws = F.struct(
        (unit_normal(row_id, seed, -1) * scale).alias("offset"),
        (unit_normal(row_id, seed, -2) * scale + 1.0).alias("gain"),
        (unit_normal(row_id, seed, -3) * (2.0 * scale)).alias("shift"),
    )
    return A.let(
        draws,
        lambda z: F.transform(
            shift_bands(x, z["shift"]),
            lambda v, k: v * z["gain"] + z["offset"] + unit_normal(row_id, seed, k) * scale,
        ),
    )
