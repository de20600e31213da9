"""Checking SQL for queries whose answer needs a small solve.

Linear systems are solved by conjugate gradients, latent components by deflation and penalised fits by
coordinate descent, each as a recursive query over lists.
"""

from __future__ import annotations

import re

from . import q_compare, q_fits, q_neighbours, q_order, q_runs  # noqa: F401  (register the queries first)
from .fixtures import CAND_SQL, SPECTRA_SQL, TRAIN_SQL
from .q_arrays import REF_CTE, SNV0
from .q_compare import LATEST_SQL, NAMED_SQL
from .q_fits import TR_LONG_SQL
from .q_neighbours import ENERGY_SQL
from .registry import check, d, i

DOT = "list_dot_product"


def moments(dim: int, ddof: int = 0, weighted: bool = False) -> str:
    """From src(k, x, y): scaled X'X (a), X'y (b), means (m), deviations (s), ym and n per key."""
    return f"""ii AS (SELECT unnest(range(1, {dim + 1})) AS i), jj AS (SELECT unnest(range(1, {dim + 1})) AS j),
m1 AS (SELECT k, i, avg(x[i]) AS m, sqrt(var_pop(x[i]) * count(*) / (count(*) - {ddof})) AS s, covar_pop(x[i], y) * count(*) AS xy FROM src, ii GROUP BY k, i),
m2 AS (SELECT k, i, j, covar_pop(x[i], x[j]) * count(*) AS v FROM src, ii, jj GROUP BY k, i, j),
m3 AS (SELECT m2.k, m2.i, list(v / (p.s * q.s) ORDER BY m2.j) AS r FROM m2 JOIN m1 p ON p.k = m2.k AND p.i = m2.i JOIN m1 q ON q.k = m2.k AND q.i = m2.j GROUP BY m2.k, m2.i),
m4 AS (SELECT k, list(r ORDER BY i) AS a FROM m3 GROUP BY k), m5 AS (SELECT k, list(xy / s ORDER BY i) AS b, list(m ORDER BY i) AS m, list(s ORDER BY i) AS s FROM m1 GROUP BY k),
m6 AS (SELECT k, avg(y) AS ym, count(*) AS n FROM src GROUP BY k), sysm AS (SELECT * FROM m4 JOIN m5 USING (k) JOIN m6 USING (k))"""


def cg(system: str, steps: int) -> str:
    """Solve a w = b per key from ``system`` (k, a, b); the answer is sol(k, w)."""
    return f"""cg AS (SELECT k, a, 0 AS it, list_transform(b, lambda v: 0.0::DOUBLE) AS w, b AS r, b AS p, {DOT}(b, b) AS rs FROM {system}
  UNION ALL SELECT k, a, it + 1, w, r, list_transform(r, lambda v, h: v + (CASE WHEN rs0 < 1e-300 THEN 0 ELSE rs / rs0 END) * p[h]), rs FROM (
    SELECT k, a, it, w, r, p, rs0, {DOT}(r, r) AS rs FROM (
      SELECT k, a, it, p, rs AS rs0, list_transform(w, lambda v, h: v + al * p[h]) AS w, list_transform(r, lambda v, h: v - al * ap[h]) AS r FROM (
        SELECT *, CASE WHEN rs < 1e-26 THEN 0 ELSE rs / {DOT}(p, ap) END AS al FROM (SELECT *, list_transform(a, lambda row: {DOT}(row, p)) AS ap FROM cg WHERE it < {steps}))))),
sol AS (SELECT k, w FROM cg WHERE it = {steps})"""


def plus_diagonal(alpha: str) -> str:
    return f"list_transform(a, lambda row, g: list_transform(row, lambda v, h: CASE WHEN g = h THEN v + {alpha} ELSE v END))"


def scored(x: str = "x") -> str:
    """Prediction from w, m, s and ym."""
    return f"ym + list_sum(list_transform({x}, lambda v, h: (v - m[h]) / s[h] * w[h]))"


def pls(comps: int) -> str:
    """Components comp(k, c, w, p, q) of sysm."""
    return f"""pl AS (SELECT k, 0 AS c, a, b, [0.0::DOUBLE] AS w, [0.0::DOUBLE] AS p, 0.0::DOUBLE AS q FROM sysm
  UNION ALL SELECT k, c + 1, list_transform(a, lambda row, g: list_transform(row, lambda v, h: v - tt * p[g] * p[h])), list_transform(b, lambda v, h: v - tt * q * p[h]), w, p, q FROM (
    SELECT k, c, a, b, w, tt, list_transform(aw, lambda v: v / tt) AS p, {DOT}(b, w) / tt AS q FROM (
      SELECT *, {DOT}(w, aw) AS tt FROM (SELECT *, list_transform(a, lambda row: {DOT}(row, w)) AS aw FROM (
        SELECT k, c, a, b, list_transform(b, lambda v: v / sqrt({DOT}(b, b))) AS w FROM pl WHERE c < {comps}))))),
comp AS (SELECT k, c, w, p, q FROM pl WHERE c > 0)"""


def deflate(rows: str) -> str:
    """Rows (id, k, z) run through comp: walk(id, k, c, t, yh)."""
    return f"""walk AS (SELECT id, k, 0 AS c, z, 0.0::DOUBLE AS t, 0.0::DOUBLE AS yh FROM {rows}
  UNION ALL SELECT id, k, c, list_transform(z, lambda v, h: v - t * p[h]), t, yh + t * q FROM (
    SELECT walk.id, walk.k, comp.c, walk.z, walk.yh, comp.p, comp.q, {DOT}(walk.z, comp.w) AS t FROM walk JOIN comp ON comp.k = walk.k AND comp.c = walk.c + 1))"""


def rec(ctes: str) -> str:
    return "WITH RECURSIVE " + ctes


SCALED = "list_transform({x}, lambda v, h: (v - m[h]) / s[h])"
TOP = """wtop AS (SELECT band, row_number() OVER (ORDER BY abs(c) DESC, band DESC) AS rn FROM (SELECT band, corr(v, y) AS c FROM tb GROUP BY band))"""


def picked(k: int) -> str:
    """List of the k best bands, 1-based for DuckDB."""
    return f"(SELECT list(band + 1 ORDER BY rn) FROM wtop WHERE rn <= {k})"


# ---- row-local and one band ------------------------------------------------------------

check(
    "ARR-15",
    rec(f"""{TRAIN_SQL}{REF_CTE},
dsg AS (SELECT f, list_transform(range(0, 64), lambda k: -1 + 2 * k / 63.0) AS t FROM ref), sysm AS (SELECT id AS k, x, f, t,
  [[{DOT}(f, f), list_sum(f), {DOT}(f, t)], [list_sum(f), 64.0, list_sum(t)], [{DOT}(f, t), list_sum(t), {DOT}(t, t)]] AS a, [{DOT}(f, x), list_sum(x), {DOT}(t, x)] AS b FROM spectra, dsg),
{cg('(SELECT k, a, b FROM sysm)', 6)},
r AS (SELECT k AS id, list_transform(x, lambda v, h: (v - w[2] - w[3] * t[h]) / CASE WHEN abs(w[1]) < 1e-12 THEN 1 ELSE w[1] END) AS o FROM sysm JOIN sol USING (k))
SELECT id, {i('unnest(range(64))', 'k')}, {d('unnest(o)', 'v', 2)} FROM r"""),
)

MSC_SQL = f"""{TRAIN_SQL}{REF_CTE},
ms AS (SELECT id, grp, x, y, list_avg(x) AS rm, list_avg(f) AS fm, list_sum(list_transform(range(1, 65), lambda k: (x[k] - list_avg(x)) * (f[k] - list_avg(f)))) / list_sum(list_transform(f, lambda u: (u - list_avg(f)) ** 2)) AS b FROM spectra, ref),
mr AS (SELECT id, grp, x, y, list_transform(x, lambda v: (v - (rm - b * fm)) / b) AS z FROM ms)"""
check(
    "UDF-1",
    f"WITH {MSC_SQL} SELECT id, {i('unnest(range(64))', 'k')}, {d('unnest(z)', 'v', 4)} FROM mr WHERE grp > 6",
)
check(
    "MOD-2-msc",
    f"""WITH {MSC_SQL}, bb AS (SELECT y, unnest(range(64)) AS band, unnest(z) AS v FROM mr WHERE grp <= 6), top AS (SELECT band FROM (SELECT band, corr(v, y) AS c FROM bb GROUP BY band) ORDER BY abs(c) DESC, band LIMIT 1),
f AS (SELECT regr_slope(y, x[band + 1]) AS b, regr_intercept(y, x[band + 1]) AS a, min(y) AS lo, max(y) AS hi, any_value(band) AS band FROM train, top)
SELECT id, {d('greatest(least(a + b * x[band + 1], hi), lo)', 'y_pred')} FROM test, f""",
)

# ---- ridge -----------------------------------------------------------------------------

check(
    "MOD-3-weighted",
    rec(f"""{TR_LONG_SQL}, {TOP}, qq AS (SELECT quantile_cont(y, 0.7) AS q FROM train),
wr AS (SELECT list_transform({picked(6)}, lambda b: x[b]) AS x, y, CASE WHEN y >= q THEN 2.0 ELSE 1.0 END AS w FROM train, qq),
ii AS (SELECT unnest(range(1, 7)) AS i), jj AS (SELECT unnest(range(1, 7)) AS j),
m1 AS (SELECT i, stddev_pop(x[i]) AS s, sum(w * x[i]) / sum(w) AS m FROM wr, ii GROUP BY i), ymx AS (SELECT sum(w * y) / sum(w) AS ym FROM wr),
m2 AS (SELECT p.i, q.i AS j, sum(w * (x[p.i] - p.m) * (x[q.i] - q.m)) / (any_value(p.s) * any_value(q.s)) AS v FROM wr, m1 p, m1 q GROUP BY p.i, q.i),
m5 AS (SELECT i, sum(w * (x[i] - m) * (y - ym)) / any_value(s) AS b FROM wr, m1, ymx GROUP BY i),
sysm AS (SELECT 1 AS k, (SELECT list(r ORDER BY i) FROM (SELECT i, list(v ORDER BY j) AS r FROM m2 GROUP BY i)) AS a, (SELECT list(b ORDER BY i) FROM m5) AS b, (SELECT list(m ORDER BY i) FROM m1) AS m, (SELECT list(s ORDER BY i) FROM m1) AS s, ym FROM ymx),
{cg(f"(SELECT k, {plus_diagonal('100.0')} AS a, b FROM sysm)", 12)}
SELECT id, {d(scored(f'list_transform({picked(6)}, lambda b: x[b])'), 'y_pred')} FROM test, sysm JOIN sol USING (k)"""),
)

_ENS = ((3, 100.0), (5, 30.0), (5, 100.0), (6, 100.0), (8, 300.0))
_ENS_MASK = "list_transform(a, lambda row, g: list_transform(row, lambda v, h: CASE WHEN g > kk OR h > kk THEN (g = h)::INT ELSE v + CASE WHEN g = h THEN al ELSE 0 END END))"
check(
    "MOD-5",
    rec(f"""{TR_LONG_SQL}, {TOP}, src AS (SELECT 0 AS k, list_transform({picked(8)}, lambda b: x[b]) AS x, y FROM train), {moments(8)},
ens(k, kk, al) AS (VALUES {', '.join(f'({n}, {k}, {a}::DOUBLE)' for n, (k, a) in enumerate(_ENS))}),
big AS (SELECT ens.k, {_ENS_MASK} AS a, list_transform(b, lambda v, h: CASE WHEN h > kk THEN 0.0 ELSE v END) AS b, m, s, ym FROM sysm, ens),
{cg('(SELECT k, a, b FROM big)', 16)}, lim AS (SELECT min(y) AS lo, max(y) AS hi FROM train),
pr AS (SELECT id, greatest(least({scored(f'list_transform({picked(8)}, lambda b: x[b])')}, hi), lo) AS p FROM test, lim, big JOIN sol USING (k))
SELECT id, {d('avg(p)', 'y_pred')} FROM pr GROUP BY id"""),
)

# ---- partial least squares -------------------------------------------------------------


def pls_check(name: str, comps: int, x: str, dim: int, out: str) -> None:
    check(
        name,
        rec(f"""{TRAIN_SQL}, src AS (SELECT 1 AS k, {x} AS x, y FROM train), {moments(dim, 1)}, {pls(comps)},
zr AS (SELECT id, k, {SCALED.format(x=x)} AS z FROM {'test' if out == 'pred' else 'spectra'}, sysm), {deflate('zr')}
""")
        + (
            f"SELECT id, {d('ym + yh', 'y_pred')} FROM walk JOIN sysm USING (k) WHERE c = {comps}"
            if out == "pred"
            else f"SELECT id, {i('c - 1', 'k')}, {d('t', 'v')} FROM walk WHERE c > 0"
        ),
    )


pls_check("MOD-6", 4, "x", 64, "pred")
pls_check("MOD-6-window", 2, "x[29:35]", 7, "pred")
pls_check("TGT-9", 4, "x", 64, "scores")
check(
    "CV-9",
    rec(f"""{TRAIN_SQL}, folds AS (SELECT DISTINCT grp AS fold FROM train), src AS (SELECT fold AS k, x, y FROM train JOIN folds ON grp <> fold), {moments(64, 1)}, {pls(3)},
zr AS (SELECT id, k, {SCALED.format(x='x')} AS z FROM train JOIN sysm ON grp = k), {deflate('zr')}
SELECT id, {i('k', 'fold_id')}, {d('ym + yh', 'y_pred')} FROM walk JOIN sysm USING (k) WHERE c = 3"""),
)

# ---- elastic net -----------------------------------------------------------------------

check(
    "MOD-8",
    rec(f"""{TR_LONG_SQL}, {TOP}, src AS (SELECT 1 AS k, list_transform({picked(5)}, lambda b: x[b]) AS x, y FROM train), {moments(5)},
cd AS (SELECT 0 AS it, [0.0, 0.0, 0.0, 0.0, 0.0]::DOUBLE[] AS w
  UNION ALL SELECT it + 1, list_transform(w, lambda v, h: CASE WHEN h = g THEN sign(rho) * greatest(abs(rho) - n * 0.03 * 0.2, 0) / (a[g][g] + n * 0.03 * 0.8) ELSE v END) FROM (
    SELECT it, w, g, a, n, b[g] - {DOT}(a[g], w) + a[g][g] * w[g] AS rho FROM (SELECT it, w, it % 5 + 1 AS g, a, b, n FROM cd, sysm WHERE it < 1000)))
SELECT id, {d(scored(f'list_transform({picked(5)}, lambda b: x[b])'), 'y_pred')} FROM test, sysm, (SELECT w FROM cd WHERE it = 1000)"""),
)

# ---- power of the target ---------------------------------------------------------------

YJ = "CASE WHEN abs({l}) < 1e-12 THEN ln(1 + y) ELSE (pow(y + 1, {l}) - 1) / {l} END"
BC = "CASE WHEN abs({l}) < 1e-12 THEN ln(y) ELSE (pow(y, {l}) - 1) / {l} END"


def power_check(name: str, form: str, jac: str) -> None:
    steps = "lo0 AS (SELECT -2.0::DOUBLE AS lo, 4.0::DOUBLE AS hi)"
    for r in range(5):
        steps += f""",
g{r} AS (SELECT lo + (hi - lo) / 12 * q AS l, (hi - lo) / 12 AS st FROM lo{r}, (SELECT unnest(range(13)) AS q)),
k{r} AS (SELECT l, any_value(st) AS st, -0.5 * count(*) * ln(var_pop({form.format(l='l')})) + (l - 1) * sum({jac}) AS ll FROM train, g{r} GROUP BY l),
lo{r + 1} AS (SELECT arg_max(l, ll) - any_value(st) AS lo, arg_max(l, ll) + any_value(st) AS hi, arg_max(l, ll) AS best FROM k{r})"""
    check(
        name,
        f"""WITH {TRAIN_SQL}, {steps}, ft AS (SELECT best, avg({form.format(l='best')}) AS m, stddev_pop({form.format(l='best')}) AS s FROM train, lo5 GROUP BY best)
SELECT id, {d(f"({form.format(l='best')} - m) / s", 't', 4)}, {d('y', 'back', 4)} FROM spectra, ft""",
    )


power_check("TGT-3", YJ, "ln(1 + y)")
power_check("TGT-4", BC, "ln(y)")

# ---- greedy steps ----------------------------------------------------------------------

_far = """pd AS (SELECT a.id AS a, b.id AS b, sqrt(list_sum(list_transform(range(1, 65), lambda k: (a.x[k] - b.x[k]) ** 2))) AS dd FROM spectra a, spectra b),
mid AS (SELECT list(m ORDER BY band) AS c FROM (SELECT band, avg(v) AS m FROM (SELECT unnest(range(64)) AS band, unnest(x) AS v FROM spectra) GROUP BY band)),
c1 AS (SELECT id, 1 AS pos FROM spectra, mid ORDER BY list_sum(list_transform(range(1, 65), lambda k: (x[k] - c[k]) ** 2)) DESC, id LIMIT 1)"""
for _k in range(2, 9):
    _far += f""",
c{_k} AS (SELECT * FROM c{_k - 1} UNION ALL (SELECT a, {_k} FROM pd WHERE b IN (SELECT id FROM c{_k - 1}) AND a NOT IN (SELECT id FROM c{_k - 1}) GROUP BY a ORDER BY min(dd) DESC, a LIMIT 1))"""
check("TOP-14", f"WITH {SPECTRA_SQL}, {_far} SELECT id, {i('pos', 'pos')} FROM c8")

check(
    "CV-1-folds",
    rec(f"""{SPECTRA_SQL}, c AS (SELECT grp, count(*) AS c, row_number() OVER (ORDER BY count(*) DESC, min(id)) AS o FROM spectra GROUP BY grp),
g AS (SELECT 0::BIGINT AS o, NULL::BIGINT AS grp, NULL::BIGINT AS fold, [0, 0, 0, 0, 0]::BIGINT[] AS sz
  UNION ALL SELECT c.o, c.grp, list_position(sz, list_min(sz)) - 1, list_transform(sz, lambda v, h: CASE WHEN h = list_position(sz, list_min(sz)) THEN v + c.c ELSE v END) FROM g JOIN c ON c.o = g.o + 1)
SELECT id, {i('fold', 'fold_id')} FROM spectra JOIN g USING (grp)"""),
)

# ---- weights, views, gates -------------------------------------------------------------

check(
    "WGT-4",
    rec(f"""{TRAIN_SQL}, src AS (SELECT 1 AS k, x, y FROM train), {moments(64)},
zz AS (SELECT id AS k, list_transform(a, lambda row: list_transform(row, lambda v: v / n)) AS a, {SCALED.format(x='x')} AS b FROM spectra, sysm),
{cg('(SELECT k, a, b FROM zz)', 100)}
SELECT k AS id, {d(f'{DOT}(w, b)', 'lev', 5)} FROM zz JOIN sol USING (k)"""),
)


def _energy_view(name: str, expr: str, dim: int) -> str:
    """The energy tables over one view, every table name suffixed with the view."""
    sql = ENERGY_SQL[len(SPECTRA_SQL) :].replace("range(1, 65)", f"range(1, {dim + 1})").replace("FROM spectra", f"FROM v_{name}")
    for t in ("nr", "smp", "dd", "spr", "cr", "en"):
        sql = re.sub(rf"(\n|FROM |JOIN |, ){t}( |\)|$)", rf"\g<1>{t}_{name}\g<2>", sql)
    cosine = f""",
mu_{name} AS (SELECT grp, k, avg(x[k]) AS m FROM (SELECT grp, x, unnest(range(1, {dim + 1})) AS k FROM v_{name}) GROUP BY ALL), cm_{name} AS (SELECT grp, list(m ORDER BY k) AS mu FROM mu_{name} GROUP BY grp),
co_{name} AS (SELECT a.grp AS test_grp, b.grp AS train_grp, 1 - list_dot_product(a.mu, b.mu) / greatest(sqrt(list_dot_product(a.mu, a.mu) * list_dot_product(b.mu, b.mu)), 1e-12) AS cd FROM cm_{name} a, cm_{name} b)"""
    return f",\nv_{name} AS (SELECT id, grp, {expr} AS x FROM spectra)" + sql + cosine


_views = {
    "raw": ("x", 64), "snv": (SNV0, 64), "diff1": ("list_transform(range(1, 64), lambda k: x[k + 1] - x[k])", 63),
}
_votes = SPECTRA_SQL + "".join(_energy_view(n, e, k) for n, (e, k) in _views.items())
_all = " UNION ALL ".join(
    f"SELECT test_grp, train_grp, row_number() OVER (PARTITION BY test_grp ORDER BY energy, cd, train_grp) AS pos FROM en_{n} JOIN co_{n} USING (test_grp, train_grp) WHERE test_grp > 6 AND train_grp <= 6" for n in _views
)
check(
    "JN-13",
    f"""WITH {_votes}, al AS ({_all}), vc AS (SELECT test_grp, train_grp, count(*) AS c FROM al WHERE pos <= 3 GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY test_grp ORDER BY c DESC, train_grp) AS rn FROM vc)
SELECT test_grp, string_agg(train_grp || '=' || c, '; ' ORDER BY rn) AS votes, 3::BIGINT AS n_views FROM rk WHERE rn <= 5 GROUP BY test_grp""",
)

# ---- score estimation ------------------------------------------------------------------

check(
    "CMP-5",
    rec(f"""{LATEST_SQL}, src AS (SELECT 1 AS k, [coalesce(leave_one_species, 0), coalesce(group_species, 0), coalesce(random, 0)] AS x, measured AS y FROM local_
  WHERE measured IS NOT NULL AND coalesce(leave_one_species, group_species, random) IS NOT NULL), {moments(3)}, {cg('(SELECT k, a, b FROM sysm)', 6)},
pr AS (SELECT experiment, {scored('[coalesce(leave_one_species, 0), coalesce(group_species, 0), coalesce(random, 0)]')} AS p FROM local_, sysm JOIN sol USING (k))
SELECT experiment, {d('CASE WHEN p BETWEEN 5 AND 50 THEN p END', 'fitted', 4)} FROM pr"""),
)
_INPUTS = "[coalesce(leave_one_species, 0), coalesce(group_species, 0), coalesce(random, 0)]"
check(
    "CMP-6",
    rec(f"""{NAMED_SQL}, src AS (SELECT 1 AS k, {_INPUTS} AS x, measured AS y FROM named
  WHERE measured IS NOT NULL AND coalesce(leave_one_species, group_species, random) IS NOT NULL), {moments(3)}, {cg('(SELECT k, a, b FROM sysm)', 6)},
pr AS (SELECT experiment, {scored(_INPUTS)} AS p FROM (SELECT experiment, leave_one_species, group_species, random FROM named) u, sysm JOIN sol USING (k) WHERE coalesce(leave_one_species, group_species, random) IS NOT NULL),
e AS (SELECT named.*, CASE WHEN w IS NOT NULL THEN CASE WHEN qf.a * w * w + qf.b * w + qf.c > 0 THEN sqrt(qf.a * w * w + qf.b * w + qf.c) END END AS quad, CASE WHEN p BETWEEN 5 AND 50 THEN p END AS fitted,
  CASE WHEN predictor LIKE 'single%' AND preprocessor = 'spectral_snv_diff1' THEN 'estimated_anchor_snv_diff1' WHEN predictor = 'single_feature_linear' THEN 'estimated_simple_linear'
    WHEN predictor = 'topk_ridge' THEN 'estimated_complex' ELSE 'estimated_median' END AS fam FROM named LEFT JOIN qf ON true LEFT JOIN pr USING (experiment)),
f AS (SELECT *, CASE fam WHEN 'estimated_anchor_snv_diff1' THEN [0.55, 0.25, 0.20] WHEN 'estimated_simple_linear' THEN [0.35, 0.35, 0.30] ELSE [0.15, 0.35, 0.50] END AS kw FROM e),
v AS (SELECT *, CASE WHEN fam = 'estimated_median' THEN list_median(list_filter([leave_one_species, group_species, random], lambda t: t IS NOT NULL)) ELSE
  (coalesce(kw[1] * leave_one_species, 0) + coalesce(kw[2] * group_species, 0) + coalesce(kw[3] * random, 0))
  / nullif(CASE WHEN leave_one_species IS NULL THEN 0 ELSE kw[1] END + CASE WHEN group_species IS NULL THEN 0 ELSE kw[2] END + CASE WHEN random IS NULL THEN 0 ELSE kw[3] END, 0) END AS fv FROM f)
SELECT experiment, name, {d('coalesce(measured, quad, fitted, fv)', 'estimate', 4)}, CASE WHEN measured IS NOT NULL THEN 'measured' WHEN quad IS NOT NULL THEN 'public_feedback_quadratic' WHEN fitted IS NOT NULL THEN 'fitted'
  WHEN fv IS NOT NULL THEN fam ELSE 'missing' END AS source, regexp_matches(lower(name || ' ' || predictor), 'group_curve|meta_monotonic|topk_quantile|clip|lowtail|low_tail') AS denied, {d('leave_one_species', 'leave_one_species', 4)} FROM v"""),
)
check(
    "CMP-7",
    rec(f"""{LATEST_SQL}, ok AS (SELECT experiment, [leave_one_species, group_species, random] AS x, measured AS y FROM local_ WHERE measured IS NOT NULL AND leave_one_species IS NOT NULL AND group_species IS NOT NULL AND random IS NOT NULL),
src AS (SELECT p.experiment AS k, q.x, q.y FROM ok p JOIN ok q ON p.experiment <> q.experiment), {moments(3)}, {cg(f"(SELECT k, {plus_diagonal('1.0')} AS a, b FROM sysm)", 8)},
pr AS (SELECT ok.experiment, ok.y, {scored('ok.x')} AS p FROM ok JOIN sysm ON sysm.k = ok.experiment JOIN sol ON sol.k = ok.experiment)
SELECT experiment, {d('y', 'measured', 4)}, {d('p', 'estimate', 4)}, {d('p - y', 'error', 4)} FROM pr"""),
)

# ---- principal components --------------------------------------------------------------

SQUARINGS = 14


def pca(comps: int, scaled: bool = False) -> str:
    """Leading eigenvectors pc(k, c, v, lam) of sysm by repeated squaring and deflation; the largest
    loading of each is positive. Unscaled components undo the scaling of ``a`` first."""
    start = "a" if scaled else "list_transform(a, lambda row, g: list_transform(row, lambda v, h: v * s[g] * s[h]))"
    turn = SQUARINGS + 1
    return f"""eg AS (SELECT k, 0 AS it, {start} AS a, {start} AS b, [0.0::DOUBLE] AS v, 0.0::DOUBLE AS lam FROM sysm
  UNION ALL SELECT k, it + 1, CASE WHEN sq THEN a ELSE list_transform(a, lambda row, g: list_transform(row, lambda u, h: u - lam * v[g] * v[h])) END,
    CASE WHEN sq THEN list_transform(b2, lambda row: list_transform(row, lambda u: u / tr)) ELSE list_transform(a, lambda row, g: list_transform(row, lambda u, h: u - lam * v[g] * v[h])) END, v, lam FROM (
    SELECT k, it, a, sq, b2, v, CASE WHEN sq THEN 0 ELSE {DOT}(v, list_transform(a, lambda row: {DOT}(row, v))) END AS lam,
      CASE WHEN sq THEN list_sum(list_transform(b2, lambda row, g: row[g])) END AS tr FROM (
      SELECT k, it, a, sq, b2, CASE WHEN sq THEN v0 ELSE list_transform(cv, lambda u: u / sqrt({DOT}(cv, cv)) * sign(cv[list_position(list_transform(cv, lambda t: abs(t)), list_max(list_transform(cv, lambda t: abs(t))))])) END AS v FROM (
        SELECT k, it, a, v AS v0, it % {turn} < {SQUARINGS} AS sq, CASE WHEN it % {turn} < {SQUARINGS} THEN list_transform(b, lambda row: list_transform(b, lambda col: {DOT}(row, col))) END AS b2,
          b[list_position(list_transform(b, lambda row, g: row[g]), list_max(list_transform(b, lambda row, g: row[g])))] AS cv FROM eg WHERE it < {comps * turn})))),
pc AS (SELECT k, it // {turn} AS c, v, lam FROM eg WHERE it > 0 AND it % {turn} = 0)"""


SRC_TRAIN = "src AS (SELECT 1 AS k, x, y FROM train)"
CENTRED = "list_transform(x, lambda v, h: v - m[h])"

check(
    "TGT-7",
    rec(f"""{TRAIN_SQL}, {SRC_TRAIN}, {moments(64)}, {pca(5)}
SELECT id, {i('c - 1', 'k')}, {d(f'{DOT}({CENTRED}, pc.v)', 'v')} FROM spectra, sysm, pc"""),
)
check(
    "AGG-28-scores",
    rec(f"""{TRAIN_SQL}, {SRC_TRAIN}, {moments(64)}, {pca(3)}, sc AS (SELECT id, grp, c, {DOT}({CENTRED}, pc.v) AS t FROM spectra, sysm, pc)
SELECT grp, CASE WHEN grp <= 6 THEN 'train' ELSE 'test' END AS domain, {i('count(*) // 3', 'n')}, {', '.join(d(f'avg(CASE WHEN c = {c} THEN t END)', f'pc{c}') for c in (1, 2, 3))} FROM sc GROUP BY grp"""),
)
_DROP = f"""sc AS (SELECT id, grp, y, c, any_value(pc.v) AS l, any_value(lam) AS lam, any_value({DOT}({CENTRED}, pc.v)) AS t FROM spectra, sysm, pc GROUP BY id, grp, y, c)"""
_LEFT = f"""rm AS (SELECT id, any_value(x) AS x, list(l ORDER BY c) AS ls, list(t ORDER BY c) AS ts FROM (SELECT s.id, s.x, sc.c, sc.l, sc.t FROM spectra s JOIN sc ON sc.id = s.id WHERE sc.c IN (SELECT c FROM gone)) GROUP BY id)
SELECT id, {i('unnest(range(64))', 'k')}, {d('unnest(list_transform(x, lambda v, h: v - list_sum(list_transform(ts, lambda t, g: t * ls[g][h]))))', 'v')} FROM rm"""
check(
    "TGT-12",
    rec(f"""{TRAIN_SQL}, {SRC_TRAIN}, {moments(64)}, {pca(10)}, {_DROP},
gone AS (SELECT c FROM (SELECT c, abs(corr(t, y)) AS r FROM sc WHERE grp <= 6 GROUP BY c) ORDER BY r, c LIMIT 3), {_LEFT}"""),
)
check(
    "TGT-13",
    rec(f"""{TRAIN_SQL}, src AS (SELECT 1 AS k, x, y FROM spectra), {moments(64)}, {pca(10)}, {_DROP},
sf AS (SELECT c, abs(avg(CASE WHEN grp > 6 THEN t END) - avg(CASE WHEN grp <= 6 THEN t END)) / sqrt(any_value(lam) / (count(*) - 1)) AS sh, abs(corr(CASE WHEN grp <= 6 THEN t END, CASE WHEN grp <= 6 THEN y END)) AS r FROM sc GROUP BY c),
gone AS (SELECT c FROM sf ORDER BY sh / greatest(r, 1e-3) DESC, c LIMIT 2), {_LEFT}"""),
)
check(
    "MOD-7",
    rec(f"""{TRAIN_SQL}, {SRC_TRAIN}, {moments(64)}, {pca(25, scaled=True)},
wt AS (SELECT list(pc.v ORDER BY c) AS vs, list({DOT}(pc.v, b) / (lam + 300) ORDER BY c) AS ws, any_value(m) AS m, any_value(s) AS s, any_value(ym) AS ym FROM pc, sysm)
SELECT id, {d(f"ym + list_sum(list_transform(vs, lambda u, c: ws[c] * {DOT}(u, {SCALED.format(x='x')})))", 'y_pred')} FROM test, wt"""),
)
_PICK5 = f"list_transform({picked(5)}, lambda b: x[b])"
check(
    "MOD-4",
    rec(f"""{TR_LONG_SQL}, {TOP}, src AS (SELECT 1 AS k, {_PICK5} AS x, y FROM train), {moments(5)}, {pca(5, scaled=True)},
al AS (SELECT unnest([3.0, 10.0, 30.0, 100.0, 300.0, 1000.0]::DOUBLE[]) AS al), zr AS (SELECT id, y, {SCALED.format(x='x')} AS z, ym, n FROM (SELECT id, y, {_PICK5} AS x FROM train), sysm),
lo AS (SELECT al, id, any_value(zr.y) - any_value(zr.ym) - sum({DOT}(z, pc.v) * {DOT}(pc.v, b) / (lam + al)) AS e, 1.0 / any_value(zr.n) + sum({DOT}(z, pc.v) ** 2 / (lam + al)) AS h FROM zr, pc, sysm, al GROUP BY al, id),
best AS (SELECT al FROM lo GROUP BY al ORDER BY sum((e / (1 - h)) ** 2), al LIMIT 1),
tz AS (SELECT id, {SCALED.format(x='x')} AS z, ym, b FROM (SELECT id, {_PICK5} AS x FROM test), sysm)
SELECT id, {d(f'any_value(ym) + sum({DOT}(z, pc.v) * {DOT}(pc.v, b) / (lam + al))', 'y_pred')} FROM tz, pc, best GROUP BY id"""),
)
_DIFF1 = "list_transform(range(1, 64), lambda k: x[k + 1] - x[k])"
_DIFF2 = "list_transform(range(1, 63), lambda k: x[k + 2] - 2 * x[k + 1] + x[k])"
_ABS = "list_transform({}, lambda u: abs(u))"
check(
    "TGT-11",
    rec(f"""{TRAIN_SQL}, {SRC_TRAIN}, {moments(64)}, {pca(18)}, q AS (SELECT id, grp, x, {_DIFF1} AS g, {_DIFF2} AS h FROM spectra),
sh AS (SELECT id, grp, [list_avg(g), list_stddev_pop(g), list_max({_ABS.format('g')}), list_avg({_ABS.format('h')}), list_stddev_pop(h), list_max({_ABS.format('h')}), list_avg(x[1:16]), list_avg(x[17:32]), list_avg(x[33:48]), list_avg(x[49:64])]
  || list_transform(range(0, 4), lambda q: (CASE WHEN q = 0 THEN sqrt(1 / 64.0) ELSE sqrt(2 / 64.0) END) * list_sum(list_transform(range(0, 64), lambda j: x[j + 1] * cos(pi() * (2 * j + 1) * q / 128.0)))) AS f FROM q),
fu AS (SELECT id, grp, unnest(range(14)) AS j, unnest(f) AS u FROM sh), fs AS (SELECT j, avg(u) AS fm, stddev_pop(u) AS fd FROM fu WHERE grp <= 6 GROUP BY j)
SELECT id, {i('c - 1', 'k')}, {d(f'{DOT}({CENTRED}, pc.v)', 'v')} FROM spectra, sysm, pc UNION ALL SELECT id, {i('18 + j', 'k')}, {d('0.5 * (u - fm) / fd', 'v')} FROM fu JOIN fs USING (j)"""),
)
check(
    "DRF-6-gate",
    f"""WITH {CAND_SQL}, t AS (SELECT *, pred - anchor AS df, y_true - anchor AS rs, CASE WHEN id % 3 = 0 THEN 100.0 ELSE 0 END AS pr, CASE WHEN id % 5 = 0 THEN anchor / 1000 ELSE 0 END AS ic FROM cand),
b AS (SELECT candidate, CASE WHEN stddev_pop(df) <= 1e-9 THEN 0 ELSE corr(df, ic) END AS icc, CASE WHEN stddev_pop(df) <= 1e-9 THEN 0 ELSE corr(df, pr) END AS pc, sum((abs(df) > 1e-12)::INT) AS ch, sqrt(avg(df ** 2)) AS rm, max(abs(df)) AS mx,
  sum((pred < 0)::INT) AS ng, sum((abs(df) > 1e-12 AND abs(df) >= 1000 - 1e-12)::INT) AS cs, sqrt(avg((greatest(pred, 0) - y_true) ** 2)) - sqrt(avg((anchor - y_true) ** 2)) AS od,
  sum((abs(df) > 1e-12 AND abs(ic) <= 1e-12)::INT) AS nw, sum((abs(df) > 1e-12 AND abs(ic) > 1e-12)::INT) / greatest(sum((abs(df) > 1e-12)::INT), 1) AS ov FROM t GROUP BY candidate),
gt AS (SELECT candidate, CASE WHEN count(*) FILTER (abs(df) > 1e-12) = 0 OR stddev_pop(df) FILTER (abs(df) > 1e-12) <= 1e-9 THEN 0 ELSE corr(df, rs) FILTER (abs(df) > 1e-12) END AS gc FROM t GROUP BY candidate),
g AS (SELECT candidate, max(abs(s)) AS sh, max(c) AS mc, sum((dl < 0)::INT) AS im FROM (SELECT candidate, grp, avg(df) AS s, sum((abs(df) > 1e-12)::INT) AS c, sqrt(avg((greatest(pred, 0) - y_true) ** 2)) - sqrt(avg((anchor - y_true) ** 2)) AS dl FROM t GROUP BY candidate, grp) GROUP BY candidate),
tp AS (SELECT candidate, max(c) AS tc FROM (SELECT candidate, grp, count(*) AS c FROM (SELECT *, row_number() OVER (PARTITION BY candidate ORDER BY abs(df) DESC, id DESC) AS rn FROM t) WHERE rn <= 10 GROUP BY ALL) GROUP BY candidate),
rr AS (SELECT *, concat_ws('|', CASE WHEN ng > 0 THEN 'negative' END, CASE WHEN NOT ch BETWEEN 16 AND 28 THEN 'changed_count' END, CASE WHEN NOT rm BETWEEN 0.006 AND 0.020 THEN 'slot1_diff_range' END, CASE WHEN mx > 0.16 THEN 'max_diff' END,
  CASE WHEN sh > 0.008 THEN 'species_shift' END, CASE WHEN mc > 6 THEN 'species_concentration' END, CASE WHEN tc > 3 THEN 'top10_species' END, CASE WHEN cs > 0 THEN 'clip_saturation' END, CASE WHEN od > -0.0035 THEN 'weak_oof' END,
  CASE WHEN im < 9 THEN 'weak_groups' END, CASE WHEN gc < 0.30 THEN 'bad_signal_corr' END, CASE WHEN nw < 6 THEN 'too_few_q5_new_rows' END, CASE WHEN abs(icc) > 0.80 THEN 'q5_corr' END, CASE WHEN ov > 0.65 THEN 'q5_overlap' END,
  CASE WHEN abs(pc) > 0.75 THEN 'prior_corr' END) AS rt FROM b JOIN gt USING (candidate) JOIN g USING (candidate) JOIN tp USING (candidate))
SELECT candidate, {d('gc', 'gate_corr', 4)}, {d('icc', 'increment_corr', 4)}, {d('pc', 'prior_corr', 4)}, rt AS reject_reasons, CASE WHEN rt = '' THEN 'pass' ELSE 'reject' END AS submit_gate FROM rr""",
)

# ---- quantile-normal scores ------------------------------------------------------------


def normal_quantile(p: str) -> str:
    """The rational approximation of ``functions.scalars`` as SQL."""
    from ..functions.scalars import _A, _B, _C, _D

    def horner(coef, t: str) -> str:
        out = repr(coef[0])
        for c in coef[1:]:
            out = f"({out} * {t} + {c!r})"
        return out

    def tail(q: str) -> str:
        t = f"sqrt(-2 * ln({q}))"
        return f"{horner(_C, t)} / {horner(_D, t)}"

    u = f"({p} - 0.5)"
    core = f"{horner(_A, f'({u} * {u})')} * {u} / {horner(_B, f'({u} * {u})')}"
    return f"CASE WHEN {p} < 0.02425 THEN {tail(p)} WHEN {p} > 1 - 0.02425 THEN -({tail(f'(1 - {p})')}) ELSE {core} END"


def placed(v: str, m: str) -> str:
    """Share of the way through the quantile list q, cut at 1e-7."""
    j = f"len(list_filter(q, lambda u: u <= {v}))"
    return f"greatest(1e-7, least(1 - 1e-7, CASE WHEN {v} <= q[1] THEN 0 WHEN {v} >= q[-1] THEN 1 ELSE ({j} - 1 + ({v} - q[{j}]) / (q[{j} + 1] - q[{j}])) / ({m} - 1) END))"


# As many quantiles as the operator takes: 1000, or the train rows where they are fewer.
check(
    "TGT-6",
    f"""WITH {TR_LONG_SQL}, size AS (SELECT least(1000, count(*)) AS m FROM (SELECT DISTINCT id FROM tb)),
srt AS (SELECT band, list(v ORDER BY v) AS s, count(*) AS n FROM tb GROUP BY band),
qt AS (SELECT band, m, list_transform(range(m), lambda j: s[CAST(floor((n - 1) * j / (m - 1.0)) AS INT) + 1]
  + (s[CAST(ceil((n - 1) * j / (m - 1.0)) AS INT) + 1] - s[CAST(floor((n - 1) * j / (m - 1.0)) AS INT) + 1]) * ((n - 1) * j / (m - 1.0) - floor((n - 1) * j / (m - 1.0)))) AS q FROM srt, size),
pl AS (SELECT id, band, {placed('v', 'm::DOUBLE')} AS p FROM bands JOIN qt USING (band))
SELECT id, {i('band', 'k')}, {d(normal_quantile('p'), 'v')} FROM pl""",
)
check(
    "TGT-6-target",
    f"""WITH {SPECTRA_SQL}, qt AS (SELECT list(y ORDER BY y) AS q FROM spectra), pl AS (SELECT id, {placed('y', 'len(q)::DOUBLE')} AS p FROM spectra, qt)
SELECT id, {d(normal_quantile('p'), 't')} FROM pl""",
)
