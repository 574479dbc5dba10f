"""Numpy routines used inside grouped maps or on small driver arrays."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd


def pair_distances(v1: np.ndarray, v2: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distance, pairs, pairs of good bins) between (bin, good) lists; for one region only upwards."""
    lo1, lo2 = v1[0, 0], v2[0, 0]
    n1, n2 = v1[-1, 0] - lo1 + 1, v2[-1, 0] - lo2 + 1
    out = []
    for good in (False, True):
        a, b = np.zeros(n1), np.zeros(n2)
        a[v1[:, 0] - lo1] = v1[:, 1] if good else 1
        b[v2[:, 0] - lo2] = v2[:, 1] if good else 1
        size = 1 << int(n1 + n2 - 1).bit_length()
        out.append(np.rint(np.fft.irfft(np.fft.rfft(a[::-1], size) * np.fft.rfft(b, size), size)[: n1 + n2 - 1]).astype(np.int64))
    dist = np.arange(n1 + n2 - 1) - (n1 - 1) + (lo2 - lo1)
    keep = (out[0] > 0) & (dist >= 0 if same else np.ones(len(dist), dtype=bool))
    return dist[keep], out[0][keep], out[1][keep]


def class_pairs(at: np.ndarray, cls: np.ndarray, dists: np.ndarray) -> np.ndarray:
    """How many ordered pairs of places have each pair of classes and one of the distances.

    The spectra of the classes' 0/1 vectors, weighted by that of the distances,
    give all class pairs in one product.
    """
    lo, k = at.min(), int(cls.max()) + 1
    n = int(at.max() - lo) + 1
    size = 1 << (2 * n).bit_length()
    dists = dists[dists < n]
    allowed = np.zeros(size)
    allowed[dists] = allowed[-dists] = 1
    spectra = np.empty((k, size // 2 + 1), dtype=complex)
    for c in range(k):
        own = np.zeros(n)
        own[at[cls == c] - lo] = 1
        spectra[c] = np.fft.rfft(own, size)
    weight = np.fft.rfft(allowed).real * 2
    weight[[0, -1]] /= 2
    out = np.zeros((k, k))
    for f in range(0, len(weight), 1 << 16):
        part = spectra[:, f : f + (1 << 16)]
        out += ((part.conj() * weight[f : f + (1 << 16)]) @ part.T).real
    return np.rint(out / size).astype(np.int64)


def persistent_log_bins(end: int = 10, per_decade: int = 10) -> np.ndarray:
    """Integer edges that grow by a constant ratio and whose widths never fall."""
    grid = np.unique(np.rint(10 ** np.linspace(0, end, end * per_decade + 1)).astype(np.int64))
    return np.cumsum(np.concatenate([grid[:1], np.sort(np.diff(grid))]))


def log_bins(lo: int, hi: int, ratio: float) -> np.ndarray:
    edges = [lo]
    while edges[-1] < hi:
        edges.append(min(hi, max(edges[-1] + 1, int(round(edges[-1] * ratio)))))
    return np.array(edges)


def interpolate(at: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Piecewise linear with the end slopes carried on."""
    k = np.clip(np.searchsorted(x, at) - 1, 0, len(x) - 2)
    return y[k] + (at - x[k]) * (y[k + 1] - y[k]) / (x[k + 1] - x[k])


def quadratic_basis(at: np.ndarray, knots: np.ndarray, n: int) -> np.ndarray:
    """Values of the n quadratic B-splines at some places; the end pieces go on beyond the knots."""
    k = np.clip(np.searchsorted(knots, at, side="right") - 1, 2, n - 1)
    out, rows = np.zeros((len(at), n)), np.arange(len(at))
    t = lambda d: knots[k + d]
    rise = (at - t(0)) / (t(1) - t(0))
    left, mid, right = (at - t(-1)) / (t(1) - t(-1)), (t(2) - at) / (t(2) - t(0)), (at - t(0)) / (t(2) - t(0))
    out[rows, k - 2] = (1 - rise) * (t(1) - at) / (t(1) - t(-1))
    out[rows, k - 1] = (1 - rise) * left + rise * mid
    out[rows, k] = rise * right
    return out


def interpolate_quadratic(at: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Quadratic spline through the points, with knots midway between all but the outer ones, carried on at the ends."""
    knots = np.concatenate([[x[0]] * 3, ((x[1:] + x[:-1]) / 2)[1:-1], [x[-1]] * 3])
    return quadratic_basis(at, knots, len(x)) @ np.linalg.solve(quadratic_basis(x, knots, len(x)), y)


INTERPOLATORS = {"linear": (interpolate, 2), "quadratic": (interpolate_quadratic, 3)}


def log_smooth(x: np.ndarray, y: np.ndarray, sigma: float, per_sigma: int = 10) -> np.ndarray:
    """Gaussian mean over log10 x within five sigma, at points thinned to per_sigma a sigma, and interpolated between."""
    lx = np.log10(x)
    thin = np.unique(np.searchsorted(lx, np.append(np.arange(lx[0], lx[-1], sigma / per_sigma), lx[-1]))) if len(lx) else np.empty(0, int)
    out = np.empty(len(thin))
    for k, i in enumerate(thin):
        lo, hi = np.searchsorted(lx, (lx[i] - 5 * sigma, lx[i] + 5 * sigma))
        w = np.exp(-((lx[lo:hi] - lx[i]) ** 2) / (2 * sigma**2))
        out[k] = (w * y[lo:hi]).sum() / w.sum()
    if len(thin) < 2:
        return np.full(len(x), out[0] if len(out) else np.nan)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.exp(np.interp(lx, lx[thin], np.log(out)))


def kernel(width: int, inner: int, kind: str) -> np.ndarray:
    """Odd square kernels of half-width width around an excluded square of half-width inner."""
    y, x = np.mgrid[-width : width + 1, -width : width + 1]
    ring = (np.abs(x) > inner) | (np.abs(y) > inner)
    if kind == "donut":
        return (ring & (x != 0) & (y != 0)).astype(int)
    if kind == "vertical":
        return ((np.abs(x) <= 1) & (np.abs(y) > inner)).astype(int)
    if kind == "horizontal":
        return ((np.abs(y) <= 1) & (np.abs(x) > inner)).astype(int)
    if kind == "lowleft":  # a convolution turns kernels about, so this one reads the corner towards the diagonal
        return (ring & (x > 0) & (y < 0)).astype(int)
    if kind == "upright":
        return (ring & (x < 0) & (y > 0)).astype(int)
    raise ValueError(f"unknown kernel {kind}")


def recommend_kernels(binsize: int) -> dict[str, np.ndarray]:
    """Donut, vertical, horizontal and lower-left kernels for resolutions of 4 to 28 kb."""
    if not 4000 <= binsize <= 28000:
        raise ValueError("no recommended kernels at this resolution")
    # fixed values: least bin size, half-widths outer and inner
    steps = ((18000, 3, 1), (8000, 5, 2), (4000, 7, 4))
    w, p = next((w, p) for least, w, p in steps if binsize >= least)
    return {k: kernel(w, p, k) for k in ("donut", "vertical", "horizontal", "lowleft")}


def check_kernels(kernels: dict[str, np.ndarray], max_nans: int) -> int:
    """Half-width of kernels that are square, odd and equal in size."""
    shapes = {k.shape for k in kernels.values()}
    if len(shapes) != 1 or len(set(*shapes)) != 1 or next(iter(shapes))[0] % 2 == 0:
        raise ValueError("kernels must be square, odd and of one size")
    if max_nans > (w := next(iter(shapes))[0] // 2):
        raise ValueError("max_nans must not exceed the kernels' half-width")
    return w


def poisson_sf(lam: float, top: int) -> np.ndarray:
    """P(X > k) for k = 0..top, from log terms so that large means don't underflow."""
    last = max(top + 1, int(lam + 12 * math.sqrt(lam) + 30))
    k = np.arange(1, last + 2)
    logp = k * math.log(lam) - lam - np.array([math.lgamma(x + 1) for x in k])
    tail = np.cumsum(np.exp(logp)[::-1])[::-1]
    return np.minimum(1.0, tail[: top + 1])


def poisson_sf_at(lam: float, counts: np.ndarray) -> np.ndarray:
    """P(X > k) at some counts, by the series of the tail beyond each; work is by number of counts and spread, not by their size."""
    k = np.asarray(counts, dtype=float)
    steps = int(40 + 14 * math.sqrt(lam + 1))
    above = k >= lam  # sum the shorter tail: upwards from k + 1, or downwards from k
    lead = np.where(above, k + 1, k)
    log_lead = lead * math.log(lam) - lam - np.array([math.lgamma(x + 1) for x in lead])
    term, total = np.ones(len(k)), np.zeros(len(k))
    for i in range(steps):
        total += term
        term = term * np.where(above, lam / (lead + 1 + i), np.maximum(lead - i, 0) / lam)
    part = np.exp(log_lead) * total
    return np.clip(np.where(above, part, 1 - part), 0.0, 1.0)


def prominence(v: np.ndarray, max_dist: int | None = None) -> np.ndarray:
    """Prominence of strict local maxima among known neighbours, 0 elsewhere.

    A side ends at a higher value, or max_dist + 1 places away if that comes
    first; the lowest value up to there counts. Of maxima that neither side
    ends, the first is measured from the lowest local minimum within max_dist.
    """
    n, reach = len(v), len(v) if max_dist is None else int(max_dist)
    out = np.zeros(n)
    known = np.flatnonzero(~np.isnan(v))
    x, inner = v[known], slice(1, -1)
    turn = lambda a: known[inner][(a[inner] > a[:-2]) & (a[inner] > a[2:])]
    if len(known) < 3:
        return out
    peaks, lows = turn(x), turn(-x)
    top_seen = False
    for p in peaks.tolist():
        left, right = np.flatnonzero(v[:p] > v[p]), np.flatnonzero(v[p + 1 :] > v[p])
        stop = max(int(left[-1]) if len(left) else -1, p - reach - 1)
        end = min(p + 1 + int(right[0]) if len(right) else n, p + reach + 1)
        sides = [v[p] - np.nanmin(v[stop:p])] if stop >= 0 else []
        sides += [v[p] - np.nanmin(v[p:end])] if end < n else []
        if sides:
            out[p] = min(sides)
        elif not top_seen:
            top_seen = True
            near = lows[(lows >= p - reach) & (lows < p + reach)]
            out[p] = v[p] - (v[near].min() if len(near) else np.nanmin(v[max(p - reach, 0) : p + reach]))
    return out


def dominant(x: np.ndarray, y: np.ndarray, rank: np.ndarray, qx: np.ndarray, qy: np.ndarray) -> np.ndarray:
    """For each query the largest rank (a permutation from 0) among points with x <= qx and y <= qy; -1 where there is none.

    A prefix of the order of x is made up of blocks of powers of two, each sorted by y with running maxima.
    """
    out, n = np.full(len(qx), -1, dtype=np.int64), len(x)
    if not n:
        return out
    order = np.argsort(x, kind="stable")
    rank, left = rank[order], np.searchsorted(x[order], qx, side="right")
    levels = np.unique(y)
    m = len(levels) + 1
    of, below = np.searchsorted(levels, y[order]), np.searchsorted(levels, qy, side="right")
    by_y = np.argsort(of, kind="stable")
    for bit in range(n.bit_length()):
        use = np.flatnonzero((left >> bit) & 1)
        if not len(use):
            continue
        turn = by_y[np.argsort(by_y >> bit, kind="stable")]  # by block, then y
        block = turn >> bit
        key, best = block * m + of[turn], np.maximum.accumulate(block * n + rank[turn])
        own = (left[use] >> bit) - 1
        at = np.searchsorted(key, own * m + below[use]) - 1
        inside = (at >= 0) & (key[np.maximum(at, 0)] >= own * m)
        out[use] = np.maximum(out[use], np.where(inside, best[np.maximum(at, 0)] - own * n, -1))
    return out


def peakdet(v: np.ndarray, delta: float) -> tuple[np.ndarray, np.ndarray]:
    """Alternating (minima, maxima) that differ by more than delta from what follows."""
    first = int(np.argmin(np.isnan(v))) if len(v) else 0
    lows, highs, lo, hi, up = [], [], first, first, True
    for i, x in enumerate(v):
        if np.isnan(x):
            continue
        hi, lo = (i if x > v[hi] else hi), (i if x < v[lo] else lo)
        if up and x < v[hi] - delta:
            highs.append(hi)
            lo, up = i, False
        elif not up and x > v[lo] + delta:
            lows.append(lo)
            hi, up = i, True
    return np.array(lows, dtype=int), np.array(highs, dtype=int)


def prominence_sweep(v: np.ndarray, steps: int = 100, least_pairs: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """For each place, the largest threshold at which peakdet still calls it a minimum, and a maximum."""
    low, high = np.full(len(v), np.nan), np.full(len(v), np.nan)
    known = np.unique(v[np.isfinite(v)])
    if len(known) < 2:
        return low, high
    for delta in np.geomspace(np.diff(known).min(), known[-1] - known[0], steps):
        lows, highs = peakdet(v, delta)
        if len(lows) >= least_pairs:
            low[lows], high[highs] = delta, delta
    return low, high


def li_threshold(v: np.ndarray) -> float:
    """Minimum cross-entropy threshold by fixed-point iteration; of equal values, that value."""
    v = v[np.isfinite(v)]
    if v.min() == v.max():
        return float(v[0])
    shift = v.min()
    x, t, last = v - shift, (v - shift).mean(), -1.0
    step = np.min(np.diff(np.unique(x))) / 2 if len(np.unique(x)) > 1 else 0.0
    while abs(t - last) > step:
        high, low = x[x > t].mean(), x[x <= t].mean()
        last, t = t, (low - high) / (math.log(low) - math.log(high)) if low > 0 else high / 2
    return t + shift


def otsu_threshold(v: np.ndarray, bins: int = 256) -> float:
    """The threshold of largest variance between both sides of a histogram; of equal values, that value."""
    v = v[np.isfinite(v)]
    if v.min() == v.max():
        return float(v[0])
    n, edges = np.histogram(v[np.isfinite(v)], bins)
    mid = (edges[1:] + edges[:-1]) / 2
    w1, w2 = np.cumsum(n), np.cumsum(n[::-1])[::-1]
    m1, m2 = np.cumsum(n * mid) / np.maximum(w1, 1), (np.cumsum((n * mid)[::-1]) / np.maximum(np.cumsum(n[::-1]), 1))[::-1]
    return float(mid[int(np.argmax(w1[:-1] * w2[1:] * (m1[:-1] - m2[1:]) ** 2))])


def balance(a: np.ndarray, max_iter: int = 1000, tol: float = 1e-5, ignore_diags: int = 0) -> np.ndarray:
    """Iterative correction of a symmetric matrix; the corrected matrix has equal non-zero marginals."""
    x = np.nan_to_num(a.astype(float))
    i, j = np.indices(x.shape)
    x[np.abs(i - j) < ignore_diags] = 0
    for _ in range(max_iter):
        s = x.sum(axis=1)
        good = s != 0
        if not good.any():
            break
        s = np.where(good, s / s[good].mean(), 1.0)
        if s[good].var() < tol:
            break
        s = 1 + 0.8 * (s - 1)
        x = x / s[:, None] / s[None, :]
    return x


# Fixed values of the published method: bounds of a factor in one outer step, and the forcing terms of inexact Newton steps
FACTOR_LOW, FACTOR_HIGH, FORCING_SHARE, FORCING_MOST = 0.1, 3.0, 0.9, 0.1


def share_inside(y: np.ndarray, step: np.ndarray) -> float:
    """The largest share of a step, up to 1, that keeps all factors within their bounds."""
    edge = np.where(step < 0, FACTOR_LOW, FACTOR_HIGH)
    with np.errstate(divide="ignore", invalid="ignore"):
        limit = np.where(step == 0, np.inf, (edge - y) / step)
    return float(min(1.0, limit.min(initial=np.inf)))


def newton_correction(times, r: np.ndarray, diagonal: np.ndarray, goal: float, budget: int) -> tuple[np.ndarray, int]:
    """s with J s = r by conjugate gradients preconditioned by a diagonal, and the products it took.

    It takes a step at least, and ends at the goal (squared, in the preconditioner's norm), where the budget does, or where 1 + s would leave its bounds.
    """
    s, used = np.zeros_like(r), 0
    z = r / diagonal
    direction, size = z, float(r @ z)
    while size > 0 and (used == 0 or size > goal and used < budget):
        image, used = times(direction), used + 1
        step = size / float(direction @ image) * direction
        share = share_inside(1 + s, step)
        s = s + share * step
        if share < 1:
            break
        r = r - size / float(direction @ image) * image
        z = r / diagonal
        before, size = size, float(r @ z)
        direction = z + size / before * direction
    return s, used


def forcing_term(eta: float, before: float, after: float, tol: float) -> float:
    """How closely the next step is solved: by what the last one gained, but not abruptly closer, and never closer than asked for."""
    if not after:
        return FORCING_MOST
    held_back = FORCING_SHARE * eta**2
    wanted = max(FORCING_SHARE * after / before, held_back if held_back > FORCING_MOST else 0.0)
    return max(min(wanted, FORCING_MOST), tol / (2 * math.sqrt(after)))


def newton_scaling(product, n: int, tol: float = 1e-6, max_products: int = 300) -> tuple[np.ndarray, float]:
    """x with x * (A x) = 1 for a symmetric non-negative A given by its product with a vector, and the residual.

    With M = X A X and its marginals v, a factor 1 + s of x solves (M + diag v) s = 1 - v to first order; each outer
    step takes such a factor, found by conjugate gradients.
    """
    x, eta = np.ones(n), FORCING_MOST
    v, used = x * product(x), 1
    error = float(((1 - v) ** 2).sum())
    while error > tol**2 and used < max_products:
        jacobian = lambda p, x=x, v=v: x * product(x * p) + v * p
        s, took = newton_correction(jacobian, 1 - v, v, max(eta**2 * error, tol**2), max_products - used)
        x = x * (1 + s)
        v, used = x * product(x), used + took + 1
        before, error = error, float(((1 - v) ** 2).sum())
        eta = forcing_term(eta, before, error, tol)
    return x, math.sqrt(error)


def observed_over_expected(a: np.ndarray, good: np.ndarray, ratio: float = 1.03) -> np.ndarray:
    """A symmetric matrix over its mean by logarithmic distance bin, over good cells; a mean of 0 changes nothing."""
    n = len(a)
    out, edges = a.astype(float).copy(), log_bins(1, max(n, 2), ratio)
    i, j = np.indices(a.shape)
    d, ok = np.abs(i - j), good[:, None] & good[None, :]
    which = np.searchsorted(edges, d, side="right")
    for b in range(which.max() + 1):
        cell = (which == b) & ok
        mean = a[cell].mean() if cell.any() else 0.0
        if mean:
            out[which == b] /= mean
    return out


def eigenvectors(a: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Largest eigenvalues by magnitude with vectors as rows, zero rows left out as NaN; the largest component is positive."""
    good = np.abs(a).sum(axis=1) > 0
    values, vectors = np.full(n, np.nan), np.full((n, len(a)), np.nan)
    if good.sum() > n:
        w, v = np.linalg.eigh(a[np.ix_(good, good)])
        pick = np.argsort(-np.abs(w))[:n]
        values = w[pick]
        for k, p in enumerate(pick):
            x = v[:, p]
            vectors[k, good] = x * np.sign(x[np.argmax(np.abs(x))])
    return values, vectors


def ranks(v: np.ndarray) -> np.ndarray:
    _, back, n = np.unique(v, return_inverse=True, return_counts=True)
    return (np.cumsum(n) - (n - 1) / 2)[back]


def agreement(v: np.ndarray, track: np.ndarray, metric: str) -> float:
    """How well a track explains a vector: its sign is the phase, its size ranks vectors."""
    ok = np.isfinite(v) & np.isfinite(track)
    x, y = v[ok], track[ok]
    if len(x) < 3:
        return 0.0
    if metric == "MAD_explained":
        around = x - np.median(x)
        return float(np.median(around * (y - np.median(y))) * np.median(np.abs(around)))
    if metric == "spearmanr":
        x, y = ranks(x), ranks(y)
    r = np.corrcoef(x, y)[0, 1] if x.std() and y.std() else 0.0
    return float(abs(r) * r * x.var() if metric == "var_explained" else r)


def phase(values: np.ndarray, vectors: np.ndarray, track: np.ndarray, sort: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Flips each vector to agree with a track, by Spearman's or the named metric, and sorts by it if one is named."""
    if sort not in (None, "spearmanr", "pearsonr", "var_explained", "MAD_explained"):
        raise ValueError(f"no such metric: {sort}")
    r = np.array([agreement(v, track, sort or "spearmanr") for v in vectors])
    out = vectors * np.where(r < 0, -1.0, 1.0)[:, None]
    order = np.argsort(-np.abs(r), kind="stable") if sort else np.arange(len(values))
    return values[order], out[order]


def cis_eig(a: np.ndarray, n: int = 3, ignore_diags: int = 2, clip_percentile: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Compartment eigenvectors of one region: observed over expected minus one, vectors scaled by sqrt of the eigenvalue."""
    a = np.nan_to_num(a.astype(float))
    i, j = np.indices(a.shape)
    good = a.sum(axis=1) > 0
    if good.sum() <= ignore_diags + 3 or good.sum() <= n:
        return np.full(n, np.nan), np.full((n, len(a)), np.nan)
    a[np.abs(i - j) < ignore_diags] = 1.0
    oe = observed_over_expected(a, good)
    oe[np.abs(i - j) < ignore_diags] = 1.0
    if clip_percentile:
        oe = np.clip(oe, 0, np.percentile(oe[good][:, good], clip_percentile))
    oe -= 1
    oe[~good] = oe[:, ~good] = 0
    values, vectors = eigenvectors(oe, n)
    return values, vectors * np.sqrt(np.abs(values))[:, None]


def fake_cis(a: np.ndarray, cis: np.ndarray, seed: int = 0) -> np.ndarray:
    """Cells under cis replaced by random other cells of their row or column, symmetrically."""
    rng, out = np.random.default_rng(seed), a.copy()
    for i, j in zip(*np.nonzero(np.triu(cis)), strict=True):
        row, k = (i, j) if rng.random() < 0.5 else (j, i)
        free = np.flatnonzero(~cis[row])
        if len(free):
            out[i, j] = out[j, i] = a[row, free[(k + rng.integers(len(free))) % len(free)]]
    return out


def interp_nan(v: np.ndarray) -> np.ndarray:
    ok = np.isfinite(v)
    return np.interp(np.arange(len(v)), np.flatnonzero(ok), v[ok]) if ok.any() else v.copy()


def interp_nan_2d(a: np.ndarray, pad_zeros: bool = True) -> np.ndarray:
    """NaN rows and columns filled bilinearly from the whole ones around them, with a margin of zeros if asked for.

    The rows (columns) with most NaNs are the masked ones; a NaN elsewhere is an error.
    """
    x = np.pad(a.astype(float), 1) if pad_zeros else a.astype(float).copy()
    gap = np.isnan(x)
    if gap.any():
        if gap[[0, -1]].any() or gap[:, [0, -1]].any():
            raise ValueError("edges must not be NaN")
        rows, cols = (np.flatnonzero(n < n.max()) for n in (gap.sum(axis=1), gap.sum(axis=0)))
        if gap[np.ix_(rows, cols)].any():
            raise ValueError("there are NaNs outside the masked rows and columns")
        whole = x[np.ix_(rows, cols)]
        along = np.stack([np.interp(np.arange(x.shape[1]), cols, row) for row in whole])
        full = np.stack([np.interp(np.arange(x.shape[0]), rows, col) for col in along.T], axis=1)
        x[gap] = full[gap]
    return x[1:-1, 1:-1] if pad_zeros else x


def zoom(a: np.ndarray, shape: tuple[int, ...], same_sum: bool = False, zoom_function=None) -> np.ndarray:
    """Resampled to a shape: linear interpolation between aligned corners up to a multiple, then block means.

    zoom_function(array, finer shape) may take the interpolation's place; with
    same_sum, values shrink as their number grows.
    """
    out = a.astype(float)
    fold = [math.ceil(n / size) if size < n else 1 for n, size in zip(out.shape, shape, strict=True)]
    fine = tuple(size * k for size, k in zip(shape, fold, strict=True))
    if zoom_function:
        out = np.asarray(zoom_function(out, fine), dtype=float)
    else:
        for axis, m in enumerate(fine):
            n = out.shape[axis]
            at = np.linspace(0, n - 1, m)
            lo = np.minimum(at.astype(int), max(n - 2, 0))
            part = (at - lo).reshape([-1 if k == axis else 1 for k in range(out.ndim)])
            out = np.take(out, lo, axis) * (1 - part) + np.take(out, np.minimum(lo + 1, n - 1), axis) * part
    for axis, k in enumerate(fold):
        out = out.reshape(*out.shape[:axis], shape[axis], k, *out.shape[axis + 1 :]).mean(axis=axis + 1)
    return out * (math.prod(a.shape) / math.prod(shape)) if same_sum else out


def zoom_weights(n: int, size: int) -> pd.DataFrame:
    """(to, at, f): what each of n places along an axis adds to each of size new ones, as ``zoom`` does."""
    fold = math.ceil(n / size) if size < n else 1
    k = np.arange(size * fold)
    at = np.linspace(0, n - 1, size * fold)
    lo = np.minimum(at.astype(int), max(n - 2, 0))
    part = at - lo
    rows = pd.DataFrame({"to": np.tile(k // fold, 2), "at": np.r_[lo, np.minimum(lo + 1, n - 1)], "f": np.r_[1 - part, part] / fold})
    return rows.groupby(["to", "at"], as_index=False).f.sum()


def adaptive_coarsegrain(a: np.ndarray, counts: np.ndarray, cutoff: int = 5, max_levels: int = 8, min_shape: int = 8) -> np.ndarray:
    """Quartets of cells with one of too few counts share the mean of the 2, 4, ... wide block around them; invalid cells stay NaN.

    Every level carries sums, counts and numbers of valid cells, so blocks with
    bad cells weigh no more than what is valid in them.
    """
    n = len(a)
    size = 1 << max(n - 1, 0).bit_length()
    grown = lambda x, fill: np.pad(x.astype(float), (0, size - n), constant_values=fill)
    quartets = lambda x: x.reshape(len(x) // 2, 2, -1, 2)
    spread = lambda x: np.repeat(np.repeat(x, 2, axis=0), 2, axis=1)

    def refined(total, count, valid, depth):
        if depth == 0 or len(total) <= min_shape:
            return total
        sums = [quartets(x).sum(axis=(1, 3)) for x in (total, count, valid)]
        least = quartets(np.where(valid > 0, count, np.inf)).min(axis=(1, 3))
        with np.errstate(divide="ignore", invalid="ignore"):
            mean = refined(*sums, depth - 1) / sums[2]
        out = np.where(spread(least < cutoff), spread(mean) * valid, total)
        return np.where(valid > 0, out, 0.0)

    cells = grown(a, np.nan)
    valid = np.isfinite(cells).astype(float)
    known = valid > 0
    out = refined(np.where(known, cells, 0.0), np.where(known, grown(counts, 0), 0.0), valid, max_levels)
    return np.where(known, out, np.nan)[:n, :n]
