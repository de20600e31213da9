"""ARR: transforms and feature blocks of one spectrum, in long form (id, k, v)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import features as X
from ..functions.preprocessors import PREPROCESSORS
from ..operators.moments import mean_spectrum
from ..operators.ordered import group_position
from .fixtures import ANCHOR_BANDS, CENTRE_BAND, N_BANDS, RADIUS, SPECTRA_SQL, TRAIN_SQL, spectra, train
from .registry import d, i, query

N = N_BANDS


def unroll(df: DataFrame, col: str = "x", *keep: str) -> DataFrame:
    return df.select("id", *keep, F.posexplode(col).alias("k", "v"))


def rows_sql(expr: str, ctes: str = SPECTRA_SQL, source: str = "spectra") -> str:
    """SQL that unrolls one list expression over the spectra."""
    return f"""WITH {ctes}, r AS (SELECT id, {expr} AS a FROM {source})
SELECT id, {i('unnest(range(len(a)))', 'k')}, {d('unnest(a)', 'v')} FROM r"""


def array_query(name: str, fn, sql: str | None) -> None:
    query(name, None if sql is None else rows_sql(sql))(
        lambda spark, sf: unroll(spectra(spark, sf).withColumn("x", fn(F.col("x"))))
    )


def t(body: str, over: str = "x") -> str:
    return f"list_transform({over}, lambda v: {body})"


def idx(body: str, n: str = "len(x)") -> str:
    """List over k = 1..n."""
    return f"list_transform(range(1, CAST({n} AS BIGINT) + 1), lambda k: {body})"


SNV1 = t("(v - list_avg(x)) / sqrt(greatest(list_var_samp(x), 1e-12))")
SNV0 = t("(v - list_avg(x)) / list_stddev_pop(x)")


def sg(window: int, deriv: int, x: str = "x") -> str:
    w = X.A.savgol_weights(window, 2, deriv)
    half = window // 2

    def lit(row) -> str:
        return "[" + ", ".join(repr(float(v)) for v in row) + "]"

    table = "[" + ", ".join(lit(r) for r in w) + "]"
    start = f"greatest(1, least(k - {half}, {N} - {window} + 1))"
    return (
        f"list_transform(range(1, {N + 1}), lambda k: list_sum(list_transform(range(1, {window + 1}), "
        f"lambda j: ({table})[k - {start} + 1][j] * ({x})[{start} + j - 1])))"
    )


def diff(x: str, n: str = "len(x)") -> str:
    return f"list_transform(range(1, CAST({n} AS BIGINT)), lambda k: ({x})[k + 1] - ({x})[k])"


array_query("ARR-1", A.centre, t("v - list_avg(x)"))
array_query("ARR-2", A.snv, SNV1)
array_query("ARR-2-pop", lambda x: A.snv(x, ddof=0, zero="one"), SNV0)
array_query("ARR-3", A.l2_normalise, t("v / greatest(sqrt(list_sum(list_transform(x, lambda u: u * u))), 1e-12)"))
array_query("ARR-4", A.area_normalise, t("v / greatest(list_avg(list_transform(x, lambda u: abs(u))), 1e-12)"))
array_query("ARR-5", A.difference, idx("x[k + 1] - x[k]", "len(x) - 1"))
array_query(
    "ARR-5-second", lambda x: A.difference(x, 2), idx("x[k + 2] - 2 * x[k + 1] + x[k]", "len(x) - 2")
)
array_query("ARR-6", A.padded_difference, f"list_concat([0.0::DOUBLE], {idx('x[k + 1] - x[k]', 'len(x) - 1')})")
array_query(
    "ARR-6-repeat",
    lambda x: A.padded_difference(x, 1, pad="repeat"),
    f"list_concat([x[2] - x[1]], {idx('x[k + 1] - x[k]', 'len(x) - 1')})",
)
array_query(
    "ARR-7", lambda x: A.moving_average(x, 9), idx("list_avg(x[greatest(1, k - 4) : least(len(x), k + 4)])")
)
array_query(
    "ARR-8",
    lambda x: A.moving_average(x, 5, edge="replicate"),
    idx("list_avg(list_transform(range(k - 2, k + 3), lambda j: x[greatest(1, least(len(x), j))]))"),
)
array_query(
    "ARR-9",
    A.smooth5,
    idx(
        """CASE WHEN k = 1 THEN (x[1] + x[2]) / 2 WHEN k = 2 THEN (x[1] + x[2] + x[3]) / 3
        WHEN k = len(x) - 1 THEN (x[-3] + x[-2] + x[-1]) / 3 WHEN k = len(x) THEN (x[-2] + x[-1]) / 2
        ELSE (-3 * x[k - 2] + 12 * x[k - 1] + 17 * x[k] + 12 * x[k + 1] - 3 * x[k + 2]) / 35 END"""
    ),
)
array_query("ARR-10", lambda x: A.savgol(x, 9, 2, 0), sg(9, 0))
array_query("ARR-10-d1", lambda x: A.savgol(x, 11, 2, 1), sg(11, 1))

LINE = """list_transform(range(1, CAST(len(x) AS BIGINT) + 1), lambda k: x[k] - list_avg(x)
  - list_sum(list_transform(range(1, CAST(len(x) AS BIGINT) + 1), lambda j: (j - (len(x) + 1) / 2.0) * (x[j] - list_avg(x))))
  / list_sum(list_transform(range(1, CAST(len(x) AS BIGINT) + 1), lambda j: (j - (len(x) + 1) / 2.0) ** 2)) * (k - (len(x) + 1) / 2.0))"""
array_query("ARR-11", A.detrend, LINE)
array_query(
    "ARR-12",
    A.detrend,
    """list_transform(range(0, 64), lambda k: x[k + 1] - list_avg(x)
  - list_sum(list_transform(range(0, 64), lambda j: (-1 + 2 * j / 63.0) * x[j + 1]))
  / list_sum(list_transform(range(0, 64), lambda j: (-1 + 2 * j / 63.0) ** 2)) * (-1 + 2 * k / 63.0))""",
)
array_query(
    "ARR-13",
    lambda x: A.blend_raw_snv(x, 0.25),
    t("0.75 * v + 0.25 * (v - list_avg(x)) / sqrt(greatest(list_var_samp(x), 1e-12))"),
)

REF_CTE = """,
ref AS (SELECT list(m ORDER BY band) AS f FROM (
  SELECT band, avg(v) AS m FROM (SELECT unnest(range(64)) AS band, unnest(x) AS v FROM train) GROUP BY band))"""


@query(
    "ARR-14",
    f"""WITH {TRAIN_SQL}{REF_CTE},
s AS (SELECT id, x, f, list_avg(x) AS rm, list_avg(f) AS fm,
        list_sum(list_transform(range(1, 65), lambda k: (x[k] - list_avg(x)) * (f[k] - list_avg(f))))
        / greatest(list_sum(list_transform(f, lambda u: (u - list_avg(f)) ** 2)), 1e-12) AS b0
      FROM spectra, ref),
r AS (SELECT id, list_transform(x, lambda v: (v - (rm - b * fm)) / b) AS a
      FROM (SELECT *, CASE WHEN abs(b0) <= 1e-12 THEN 1e-12 ELSE b0 END AS b FROM s))
SELECT id, {i('unnest(range(64))', 'k')}, {d('unnest(a)', 'v', 4)} FROM r""",
    digits=4,
)
def arr_14(spark, sf):
    """Scatter correction of every row; the reference is the mean train spectrum."""
    ref = mean_spectrum(train(spark, sf))
    return unroll(spectra(spark, sf).withColumn("x", A.scatter_correct(F.col("x"), A.doubles(ref))))


@query("ARR-15", digits=2)
def arr_15(spark, sf):
    ref = mean_spectrum(train(spark, sf))
    return unroll(spectra(spark, sf).withColumn("x", A.extended_scatter_correct(F.col("x"), ref, 1)))


def _ma(w: int) -> str:
    r = w // 2
    return idx(f"list_avg(x[greatest(1, k - {r}) : least(len(x), k + {r})])")


array_query(
    "ARR-16",
    A.multiview,
    "x || "
    + " || ".join(
        [
            _ma(3), _ma(5), t("v - list_avg(x)"), SNV1,
            f"list_concat([0.0::DOUBLE], {idx('x[k + 1] - x[k]', 'len(x) - 1')})",
            f"list_concat([0.0::DOUBLE, 0.0::DOUBLE], {idx('x[k + 2] - 2 * x[k + 1] + x[k]', 'len(x) - 2')})",
        ]
    ),
)


@query(
    "ARR-17",
    f"""WITH {SPECTRA_SQL}, a AS (SELECT id, {sg(9, 0)} AS g, {SNV0} AS s FROM spectra),
r AS (SELECT id, list_transform(g, lambda v: (v - list_avg(g)) / list_stddev_pop(g)) || {sg(9, 1, 's')} AS a FROM a)
SELECT id, {i('unnest(range(128))', 'k')}, {d('unnest(a)', 'v')} FROM r""",
)
def arr_17(spark, sf):
    return unroll(spectra(spark, sf).withColumn("x", A.derivative_stack(F.col("x"))))


@query(
    "ARR-18",
    f"""WITH {SPECTRA_SQL}
SELECT id, grp, {d('(seq - min(seq) OVER w) / greatest(max(seq) OVER w - min(seq) OVER w, 1.0::DOUBLE)', 'position')}
FROM spectra WINDOW w AS (PARTITION BY grp)""",
)
def arr_18(spark, sf):
    return group_position(spectra(spark, sf), "grp", "seq", "position").select("id", "grp", "position")


array_query("ARR-19", lambda x: A.band_slice(x, CENTRE_BAND, RADIUS), "x[29:35]")
array_query("ARR-20", lambda x: A.pick(x, ANCHOR_BANDS), "[x[11], x[32], x[51]]")


@query(
    "ARR-21",
    f"""WITH {SPECTRA_SQL}
SELECT id, {d('(x[31] + x[32] + x[33]) / 3', 'mean3')}, {d('list_sort([x[31], x[32], x[33]])[2]', 'median3')}
FROM spectra""",
)
def arr_21(spark, sf):
    a, b, c = (F.get("x", F.lit(k)) for k in (30, 31, 32))
    return spectra(spark, sf).select(
        "id", ((a + b + c) / 3).alias("mean3"), A.median3(a, b, c).alias("median3")
    )


def win_sql(spans, stats) -> str:
    """SQL for window statistics of b = x[s+1 : e]."""
    exprs = {
        "mean": "list_avg(b)",
        "std": "list_stddev_pop(b)",
        "min": "list_min(b)",
        "max": "list_max(b)",
        "range": "list_max(b) - list_min(b)",
        "slope": "list_sum(list_transform(range(1, CAST(w AS BIGINT) + 1), lambda k: (k - (w + 1) / 2.0) * b[k])) / (w * (w * w - 1) / 12.0)",
        "curvature": """list_sum(list_transform(range(1, CAST(w AS BIGINT) + 1), lambda k: ((k - (w + 1) / 2.0) ** 2 - (w * w - 1) / 12.0) * b[k]))
          / greatest(list_sum(list_transform(range(1, CAST(w AS BIGINT) + 1), lambda k: ((k - (w + 1) / 2.0) ** 2 - (w * w - 1) / 12.0) ** 2)), 1e-12)""",
        "edge": "b[-1] - b[1]",
        "center_minus_mean": "b[w // 2 + 1] - list_avg(b)",
    }
    values = ", ".join(f"({s}, {e})" for s, e in spans)
    parts = " UNION ALL ".join(
        f"SELECT id, {i('s', 'win_start')}, {i('e', 'win_end')}, '{st}' AS stat, {d(exprs[st], 'v')} FROM blocks"
        for st in stats
    )
    return f"""WITH {SPECTRA_SQL}, spans(s, e) AS (VALUES {values}),
blocks AS (SELECT id, s, e, e - s AS w, x[s + 1 : e] AS b FROM spectra, spans)
{parts}"""


SPANS8 = X.windows(N, 8, 8)


@query("ARR-22", win_sql(SPANS8, X.WINDOW_STATS))
def arr_22(spark, sf):
    return spectra(spark, sf).select("id", F.inline(X.window_rows(F.col("x"), SPANS8, X.WINDOW_STATS)))


@query("ARR-23", win_sql(X.window_grid(N), ("mean",)))
def arr_23(spark, sf):
    """Window means over the whole grid of widths."""
    return spectra(spark, sf).select("id", F.inline(X.window_rows(F.col("x"), X.window_grid(N), ("mean",))))


MEANS8 = "list_transform(range(0, 8), lambda k: list_avg(x[k * 8 + 1 : k * 8 + 8]))"


@query(
    "ARR-24",
    f"""WITH {SPECTRA_SQL}, m AS (SELECT id, {MEANS8} AS m, list_avg(x[29:35]) AS l FROM spectra),
r AS (SELECT id, list_transform(range(1, 8), lambda k: (m[k + 1] - m[k]) / greatest(abs(m[k]) + abs(m[k + 1]), 1e-12))
  || list_transform(m, lambda v: v - l) || list_transform(m, lambda v: v / greatest(abs(l), 1e-12))
  || list_transform(m, lambda v: (v - l) / greatest(abs(v) + abs(l), 1e-12)) AS a FROM m)
SELECT id, {i('unnest(range(len(a)))', 'k')}, {d('unnest(a)', 'v', 4)} FROM r""",
    digits=4,
)
def arr_24(spark, sf):
    x = F.col("x")
    means = X.segment_means(x, SPANS8)
    return unroll(
        spectra(spark, sf)
        .withColumn("m", means)
        .withColumn("x", F.concat(X.adjacent_contrast(F.col("m")), X.anchor_ratios(x, F.col("m"), CENTRE_BAND, RADIUS)))
    )


def anchor_shape_sql(radius: int) -> str:
    lo, hi = max(0, CENTRE_BAND - radius), min(N, CENTRE_BAND + radius + 1)
    w = hi - lo
    mid = w // 2
    b = f"x[{lo + 1}:{hi}]"
    axis = f"(k - {(w + 1) / 2})"
    curve = f"({axis} ** 2 - {(w * w - 1) / 12})"
    ks = f"range(1, {w + 1})"
    left, right = f"list_avg(x[{lo + 1}:{lo + mid}])", f"list_avg(x[{lo + mid + 2}:{hi}])"
    return f"""[list_avg({b}), list_stddev_pop({b}), list_max({b}) - list_min({b}),
      list_sum(list_transform({ks}, lambda k: {axis} * x[{lo} + k])) / list_sum(list_transform({ks}, lambda k: {axis} ** 2)),
      list_sum(list_transform({ks}, lambda k: {curve} * x[{lo} + k])) / list_sum(list_transform({ks}, lambda k: {curve} ** 2)),
      {left} - {right}, x[{lo + mid + 1}] - ({left} + {right}) / 2,
      list_sum({b}) - (x[{lo + 1}] + x[{hi}]) / 2]"""


array_query(
    "ARR-25",
    lambda x: X.anchor_shape(x, N, CENTRE_BAND, (2, 5, 10)),
    " || ".join(anchor_shape_sql(r) for r in (2, 5, 10)),
)
LEVELS = ((0, 4), (8, 16), (28, 35), (40, 56), (48, 64))
array_query(
    "ARR-26",
    lambda x: X.level_minus_mean(x, LEVELS),
    "[" + ", ".join(f"list_avg(x[{s + 1}:{e}]) - list_avg(x)" for s, e in LEVELS) + "]",
)

DCT = "list_transform(range(0, {n}), lambda q: (CASE WHEN q = 0 THEN sqrt(1 / 64.0) ELSE sqrt(2 / 64.0) END) * list_sum(list_transform(range(0, 64), lambda j: x[j + 1] * cos(pi() * (2 * j + 1) * q / 128.0))))"
D1 = idx("x[k + 1] - x[k]", "len(x) - 1")
D2 = idx("x[k + 2] - 2 * x[k + 1] + x[k]", "len(x) - 2")
ABS = "list_transform({}, lambda u: abs(u))"


@query(
    "ARR-27",
    f"""WITH {SPECTRA_SQL}, q AS (SELECT id, x, {D1} AS g, {D2} AS h FROM spectra),
r AS (SELECT id, [list_avg(g), list_stddev_pop(g), list_max({ABS.format('g')}), list_avg({ABS.format('h')}),
  list_stddev_pop(h), list_max({ABS.format('h')}), list_avg(x[1:16]), list_avg(x[17:32]), list_avg(x[33:48]), list_avg(x[49:64])]
  || {DCT.format(n=4)} AS a FROM q)
SELECT id, {i('unnest(range(14))', 'k')}, {d('unnest(a)', 'v')} FROM r""",
)
def arr_27(spark, sf):
    return unroll(spectra(spark, sf).withColumn("x", X.shape_features(F.col("x"), N, 14)))


array_query(
    "ARR-28",
    lambda x: X.dct_features(x, N),
    f"""{DCT.format(n=8)} || list_transform(range(1, 7), lambda m: sqrt(list_sum(list_transform(range(64 - m, 64),
      lambda q: (sqrt(2 / 64.0) * list_sum(list_transform(range(0, 64), lambda j: x[j + 1] * cos(pi() * (2 * j + 1) * q / 128.0)))) ** 2))))""",
)


@query(
    "ARR-29",
    f"""WITH {SPECTRA_SQL}, q AS (SELECT id, x, {D1} AS g, {D2} AS h,
  list_transform(range(1, 65), lambda k: len(list_filter(range(1, 65), lambda j: x[j] < x[k] OR (x[j] = x[k] AND j < k)))) AS rk FROM spectra),
r AS (SELECT id, [list_max(x), list_min(x), list_max(x) - list_min(x), list_max({ABS.format('g')}), list_avg({ABS.format('g')}),
  list_max({ABS.format('h')}), list_avg({ABS.format('h')}), (list_position(x, list_max(x)) - 1) / 63.0, (list_position(x, list_min(x)) - 1) / 63.0,
  (list_avg(rk[1:32]) - list_avg(rk[33:64])) / 63.0] AS a FROM q)
SELECT id, {i('unnest(range(10))', 'k')}, {d('unnest(a)', 'v')} FROM r""",
)
def arr_29(spark, sf):
    return unroll(spectra(spark, sf).withColumn("x", X.event_features(F.col("x"), N)))


_CON = [(a, b) for a in range(1, 7) for b in range(a + 1, 7)]


@query(
    "ARR-30",
    f"""WITH {SPECTRA_SQL}, q AS (SELECT id, [list_avg(x[1:16]), list_avg(x[17:32]), list_avg(x[33:48]), list_avg(x[49:64]),
  list_avg(x[1:32]), list_avg(x[33:64])] AS m FROM spectra),
r AS (SELECT id, m || [{', '.join(f'm[{a}] - m[{b}], (m[{a}] + 1e-6) / (m[{b}] + 1e-6)' for a, b in _CON)}] AS a FROM q)
SELECT id, {i('unnest(range(len(a)))', 'k')}, {d('unnest(a)', 'v', 3)} FROM r""",
    digits=3,
)
def arr_30(spark, sf):
    return unroll(spectra(spark, sf).withColumn("x", X.contrast_features(F.col("x"), N)))


array_query(
    "ARR-31",
    lambda x: X.segment_features(x, N),
    "["
    + ", ".join(
        f"list_avg(x[{s + 1}:{e}]), list_stddev_pop(x[{s + 1}:{e}])"
        for bins in (4, 5, 10)
        for s, e in X.split_points(N, bins)
    )
    + "]",
)


def _safe(v: str) -> str:
    return f"(CASE WHEN abs({v}) < 1e-3 THEN CASE WHEN {v} < 0 THEN -1e-3 ELSE 1e-3 END ELSE {v} END)"


_RAT = [(a, b) for a in range(1, 6) for b in range(a + 1, 6)]
_LAGS = " || ".join(
    f"list_transform(range(1, {65 - g}), lambda k: x[k + {g}] / {_safe('x[k]')}) || list_transform(range(1, {65 - g}), lambda k: x[k + {g}] - x[k])"
    for g in (1, 2, 3)
)


@query(
    "ARR-32",
    f"""WITH {SPECTRA_SQL}, q AS (SELECT id, x, [{', '.join(f'list_avg(x[{s + 1}:{e}])' for s, e in X.split_points(N, 5))}] AS m FROM spectra),
r AS (SELECT id, list_transform({_LAGS} || [{', '.join(f"m[{a}] - m[{b}], m[{a}] / {_safe(f'm[{b}]')}" for a, b in _RAT)}],
  lambda v: greatest(least(v, 20.0::DOUBLE), -20.0::DOUBLE)) AS a FROM q)
SELECT id, {i('unnest(range(len(a)))', 'k')}, {d('unnest(a)', 'v')} FROM r""",
)
def arr_32(spark, sf):
    return unroll(spectra(spark, sf).withColumn("x", X.ratio_features(F.col("x"), N)))


@query(
    "ARR-33",
    f"""WITH {SPECTRA_SQL}, q0 AS (SELECT id, {sg(9, 0)} AS g0, x AS x0 FROM spectra),
q AS (SELECT id, x0, list_transform(g0, lambda v: (v - list_avg(g0)) / list_stddev_pop(g0)) AS x FROM q0),
p AS (SELECT id, x, {D1} AS g, {D2} AS h, list_transform(x0, lambda v: (v - list_avg(x0)) / list_stddev_pop(x0)) AS s,
  list_transform(range(1, 65), lambda k: len(list_filter(range(1, 65), lambda j: x[j] < x[k] OR (x[j] = x[k] AND j < k)))) AS rk FROM q),
r AS (SELECT id, [{', '.join(f'list_avg(x[{s + 1}:{e}]), list_stddev_pop(x[{s + 1}:{e}])' for bins in (4, 5, 10) for s, e in X.split_points(N, bins))}]
  || [list_max(x), list_min(x), list_max(x) - list_min(x), list_max({ABS.format('g')}), list_avg({ABS.format('g')}),
  list_max({ABS.format('h')}), list_avg({ABS.format('h')}), (list_position(x, list_max(x)) - 1) / 63.0, (list_position(x, list_min(x)) - 1) / 63.0,
  (list_avg(rk[1:32]) - list_avg(rk[33:64])) / 63.0] || {DCT.format(n=8).replace('x[j + 1]', 's[j + 1]')} AS a FROM p)
SELECT id, {i('unnest(range(len(a)))', 'k')}, {d('unnest(a)', 'v')} FROM r""",
)
def arr_33(spark, sf):
    return unroll(spectra(spark, sf).withColumn("x", X.feature_set(F.col("x"), N, "shape_compact")))


KEYS = ("raw:mean:8:16", "raw:slope:24:40", "diff1:std:0:16", "snv:edge:16:32", "snv_diff1:range:4:12")

array_query(
    "ARR-34",
    lambda x: X.features_from_keys(x, KEYS),
    f"""[list_avg(x[9:16]), list_sum(list_transform(range(1, 17), lambda k: (k - 8.5) * x[24 + k])) / 340.0,
  list_stddev_pop(({diff('x')})[1:16]), (x[32] - x[17]) / list_stddev_pop(x),
  (list_max(({diff('x')})[5:12]) - list_min(({diff('x')})[5:12])) / list_stddev_pop(x)]""",
)


@query("ARR-35")
def arr_35(spark, sf):
    return unroll(spectra(spark, sf).withColumn("x", X.perturb(F.col("x"), F.col("id"), 0.005, 7)))


@query(
    "ARR-36",
    f"""WITH {SPECTRA_SQL}, a AS (SELECT id, {SNV1} AS s FROM spectra),
b AS (SELECT id, list_transform(s, lambda v: v / greatest(list_avg(list_transform(s, lambda u: abs(u))), 1e-12)) AS s FROM a),
r AS (SELECT id, {diff('s', '64')} AS a FROM b)
SELECT id, {i('unnest(range(63))', 'k')}, {d('unnest(a)', 'v')} FROM r""",
)
def arr_36(spark, sf):
    """One preprocessor taken from the registry by name."""
    return unroll(PREPROCESSORS["spectral_snv_area_diff1"].transform(spectra(spark, sf)))
