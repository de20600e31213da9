"""Closed-form and iterative fits on one small aggregated matrix. No data rows reach these functions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np

from .moments import Gram


@dataclass
class Linear:
    """Prediction x . coef + intercept."""

    coef: np.ndarray
    intercept: float
    info: dict = field(default_factory=dict)


@dataclass
class Latent:
    """Scores ((x - mean) / scale) . loadings."""

    mean: np.ndarray
    scale: np.ndarray
    loadings: np.ndarray
    variance: np.ndarray

    @property
    def matrix(self) -> np.ndarray:
        """d x k map from raw bands to scores, before the offset."""
        return self.loadings / self.scale[:, None]

    @property
    def offset(self) -> np.ndarray:
        return -self.mean @ self.matrix


def scales(g: Gram, ddof: int = 0) -> np.ndarray:
    sd = np.sqrt(np.maximum(np.diag(g.sxx) / max(g.n - ddof, 1), 0.0))
    return np.where(sd < 1e-12, 1.0, sd)


def expand(g: Gram, bands: Sequence[int] | None, coef: np.ndarray, t: int, **info) -> Linear:
    """Coefficients on all bands with the intercept at the means."""
    full = np.zeros(g.d)
    full[list(bands) if bands is not None else slice(None)] = coef
    return Linear(full, g.y_mean(t) - float(full @ g.mean), info)


def band_corr(g: Gram, t: int = 0) -> np.ndarray:
    n1 = max(g.n - 1, 1)
    sx = np.sqrt(np.maximum(np.diag(g.sxx) / n1, 1e-12))
    sy = np.sqrt(max(g.syy(t) / n1, 1e-12))
    return (g.sxy(t) / n1) / np.maximum(sx * sy, 1e-12)


def top_bands(g: Gram, k: int, t: int = 0, min_var: float = 0.0) -> list[int]:
    """Largest |corr|, ties to the higher band."""
    c = np.abs(band_corr(g, t))
    ok = np.diag(g.sxx) / max(g.n - 1, 1) >= min_var
    order = [j for j in np.lexsort((-np.arange(g.d), -c)) if ok[j]]
    return [int(j) for j in order[:k]] or list(range(min(k, g.d)))


def best_band(g: Gram, t: int = 0) -> int:
    """Largest |corr|, ties to the lower band."""
    return int(np.argmax(np.abs(band_corr(g, t))))


def mean_only(g: Gram, t: int = 0) -> Linear:
    return Linear(np.zeros(g.d), g.y_mean(t))


def one_band(g: Gram, band: int | None = None, t: int = 0) -> Linear:
    b = best_band(g, t) if band is None else min(band, g.d - 1)
    sxx = g.sxx[b, b]
    slope = 0.0 if sxx <= 1e-12 else g.sxy(t)[b] / sxx
    return expand(g, [b], np.array([slope]), t, band=b)


def ridge(g: Gram, alpha: float, bands: Sequence[int] | None = None, ddof: int = 0, scale: bool = True, t: int = 0) -> Linear:
    """Ridge on scaled bands with a free intercept."""
    s = g if bands is None else g.take(bands)
    sd = scales(s, ddof) if scale else np.ones(s.d)
    a = s.sxx / np.outer(sd, sd)
    w = np.linalg.solve(a + alpha * np.eye(s.d), s.sxy(t) / sd)
    return expand(g, bands, w / sd, t)


def pls_parts(g: Gram, k: int, scale: bool = True, t: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rotations (d x k) on scaled bands, target loadings and scales, from X'X and X'y only."""
    sd = scales(g, 1) if scale else np.ones(g.d)
    xx, xy = g.sxx / np.outer(sd, sd), g.sxy(t) / sd
    k = int(min(k, g.d, max(g.n - 1, 1)))
    rot, load, q = [], [], []
    for _ in range(k):
        norm = np.linalg.norm(xy)
        if norm < 1e-14:
            break
        w = xy / norm
        r = w - sum(((p @ w) * b for p, b in zip(load, rot)), np.zeros(g.d))
        tt = float(r @ xx @ r)
        if tt < 1e-14:
            break
        p = xx @ r / tt
        qa = float(r @ xy) / tt
        xy = xy - p * qa * tt
        rot.append(r)
        load.append(p)
        q.append(qa)
    if not rot:
        return np.zeros((g.d, 1)), np.zeros(1), sd
    return np.column_stack(rot), np.asarray(q), sd


def pls(g: Gram, k: int, bands: Sequence[int] | None = None, scale: bool = True, t: int = 0) -> Linear:
    s = g if bands is None else g.take(bands)
    rot, q, sd = pls_parts(s, k, scale, t)
    return expand(g, bands, rot @ q / sd, t)


def pls_latent(g: Gram, k: int, scale: bool = True, t: int = 0) -> Latent:
    rot, q, sd = pls_parts(g, k, scale, t)
    return Latent(g.mean, sd, rot, q)


def pca(g: Gram, k: int, scale: bool = False, whiten: bool = False) -> Latent:
    """Leading eigenvectors; the largest loading of each is positive."""
    sd = scales(g) if scale else np.ones(g.d)
    cov = g.sxx / np.outer(sd, sd) / max(g.n - 1, 1)
    k = int(min(k, max(g.n - 1, 1), g.d))
    values, vectors = np.linalg.eigh(cov)
    values, vectors = np.maximum(values[::-1][:k], 0.0), vectors[:, ::-1][:, :k]
    top = np.abs(vectors).argmax(0)
    vectors = vectors * np.where(vectors[top, np.arange(k)] < 0, -1.0, 1.0)
    if whiten:
        vectors = vectors / np.sqrt(np.maximum(values, 1e-12))
    return Latent(g.mean, sd, vectors, values)


def latent_gram(g: Gram, z: Latent) -> Gram:
    """Moments of the scores, without another pass over the data."""
    m, p = z.matrix, 1 + g.d + g.targets
    shift = (g.about - z.mean) @ m
    lift = np.zeros((p, 1 + m.shape[1] + g.targets))
    lift[0, 0] = 1.0
    lift[0, 1 : 1 + m.shape[1]] = shift
    lift[1 : 1 + g.d, 1 : 1 + m.shape[1]] = m
    lift[1 + g.d :, 1 + m.shape[1] :] = np.eye(g.targets)
    return Gram(lift.T @ g.m @ lift, np.zeros(m.shape[1]), g.targets)


def through(z: Latent, w: Linear) -> Linear:
    """A model on scores as a model on bands."""
    return Linear(z.matrix @ w.coef, float(w.intercept + z.offset @ w.coef), w.info)


def pca_ridge(g: Gram, k: int, alpha: float, scale: bool = True, t: int = 0) -> Linear:
    z = pca(g, k, scale)
    return through(z, ridge(latent_gram(g, z), alpha, scale=False, t=t))


def window_latent(g: Gram, window: int, comps: int) -> Latent:
    """Scaled PCA inside each window, from the diagonal blocks of the matrix."""
    sd = scales(g)
    cols, var = [], []
    for start in range(0, g.d, window):
        idx = list(range(start, min(start + window, g.d)))
        part = pca(g.take(idx), min(comps, len(idx)), scale=True)
        for c in range(part.loadings.shape[1]):
            full = np.zeros(g.d)
            full[idx] = part.loadings[:, c]
            cols.append(full)
            var.append(part.variance[c])
    return Latent(g.mean, sd, np.column_stack(cols), np.asarray(var))


def window_pca_ridge(g: Gram, window: int, comps: int, alpha: float, t: int = 0) -> Linear:
    z = window_latent(g, window, comps)
    return through(z, ridge(latent_gram(g, z), alpha, t=t))


def elastic_net(
    g: Gram, alpha: float, l1: float, bands: Sequence[int] | None = None, t: int = 0, iters: int = 10_000, tol: float = 1e-10
) -> Linear:
    """Coordinate descent with covariance updates on scaled bands."""
    s = g if bands is None else g.take(bands)
    sd = scales(s)
    xx, xy = s.sxx / np.outer(sd, sd), s.sxy(t) / sd
    w = np.zeros(s.d)
    grad = xy.copy()
    hard, soft = s.n * alpha * l1, s.n * alpha * (1 - l1)
    for _ in range(iters):
        step = 0.0
        for j in range(s.d):
            old = w[j]
            rho = grad[j] + xx[j, j] * old
            new = np.sign(rho) * max(abs(rho) - hard, 0.0) / max(xx[j, j] + soft, 1e-12)
            if new != old:
                grad -= xx[:, j] * (new - old)
                w[j] = new
                step = max(step, abs(new - old))
        if step < tol:
            break
    return expand(g, bands, w / sd, t, nonzero=int((w != 0).sum()))


def lasso_by_criterion(g: Gram, criterion: str = "bic", steps: int = 60, t: int = 0) -> Linear:
    """Lasso path; the penalty with the lowest AIC or BIC wins."""
    sd = scales(g)
    top = np.abs(g.sxy(t) / sd).max() / g.n
    if top <= 0:
        return mean_only(g, t)
    noise = max(float(g.syy(t) - g.sxy(t) @ np.linalg.lstsq(g.sxx, g.sxy(t), rcond=None)[0]), 1e-12)
    noise /= max(g.n - g.d - 1, 1)
    price = 2.0 if criterion == "aic" else np.log(g.n)
    best, best_score = None, np.inf
    for a in top * np.logspace(0, -4, steps):
        m = elastic_net(g, a, 1.0, t=t, tol=1e-7)
        rss = g.syy(t) - 2 * m.coef @ g.sxy(t) + m.coef @ g.sxx @ m.coef
        score = g.n * np.log(2 * np.pi * noise) + rss / noise + price * m.info["nonzero"]
        if score < best_score:
            best, best_score = m, score
            best.info["alpha"] = float(a)
    return best


def bayes_ridge(g: Gram, t: int = 0, iters: int = 300, tol: float = 1e-3) -> Linear:
    """Evidence maximisation for one weight and one noise precision (vague priors 1e-6), on scaled bands."""
    prior = 1e-6
    sd = scales(g)
    xx, xy = g.sxx / np.outer(sd, sd), g.sxy(t) / sd
    e, v = np.linalg.eigh(xx)
    e = np.maximum(e, 0.0)
    vy = v.T @ xy
    noise, weight = 1.0 / max(g.syy(t) / g.n, 1e-12), 1.0
    coef = np.zeros(g.d)
    for _ in range(iters):
        new = v @ (vy / (e + weight / noise))
        rss = max(g.syy(t) - 2 * new @ xy + new @ xx @ new, 0.0)
        gamma = float((noise * e / (weight + noise * e)).sum())
        weight = (gamma + 2 * prior) / (float(new @ new) + 2 * prior)
        noise = (g.n - gamma + 2 * prior) / (rss + 2 * prior)
        done = np.abs(new - coef).sum() < tol
        coef = new
        if done:
            break
    return expand(g, None, v @ (vy / (e + weight / noise)) / sd, t)


def ard(g: Gram, t: int = 0, iters: int = 300, tol: float = 1e-3, prune: float = 1e4) -> Linear:
    """One weight precision per band; bands over the pruning threshold leave."""
    prior = 1e-6
    lam = np.ones(g.d)
    noise = 1.0 / max(g.syy(t) / g.n, 1e-12)
    keep = np.ones(g.d, bool)
    coef = np.zeros(g.d)
    for _ in range(iters):
        if not keep.any():
            break
        xx, xy = g.sxx[np.ix_(keep, keep)], g.sxy(t)[keep]
        sigma = np.linalg.inv(np.diag(lam[keep]) + noise * xx)
        part = noise * sigma @ xy
        gamma = 1.0 - lam[keep] * np.diag(sigma)
        lam[keep] = (gamma + 2 * prior) / (part**2 + 2 * prior)
        rss = max(g.syy(t) - 2 * part @ xy + part @ xx @ part, 0.0)
        noise = (g.n - gamma.sum() + 2 * prior) / (rss + 2 * prior)
        new = np.zeros(g.d)
        new[keep] = part
        keep = keep & (lam < prune)
        new[~keep] = 0.0
        done = np.abs(new - coef).sum() < tol
        coef = new
        if done:
            break
    return expand(g, None, coef, t)
