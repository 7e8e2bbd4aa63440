"""Overlapping emitters: regions of a frame fitted by as many Gaussians as they call for, and pairs of Gaussians around given points."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from photonflow.operators.images import gaussian, label
from photonflow.operators.localise import FITTED, READ_NOISE, _held

#: Emitters that a region may call for.
MOST = 8
ROUNDS = 80


def model(p: np.ndarray, x: np.ndarray, y: np.ndarray, k: int) -> np.ndarray:
    """k Gaussians of one width on a flat background: p (regions, 3 k + 2) holds A, x, y of each, then width and background."""
    return _bells(p, x, y, k)[0].sum(axis=2) + p[:, -1:]


def _bells(p: np.ndarray, x: np.ndarray, y: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """A times each bell (regions, pixels, k), and offsets from their centres."""
    own = p[:, : 3 * k].reshape(len(p), 1, k, 3)
    dx, dy = x[:, :, None] - own[..., 1], y[:, :, None] - own[..., 2]
    return own[..., 0] * np.exp(-(dx * dx + dy * dy) / (2 * p[:, -2][:, None, None] ** 2)), dx, dy


def _slopes(p: np.ndarray, x: np.ndarray, y: np.ndarray, k: int) -> np.ndarray:
    bells, dx, dy = _bells(p, x, y, k)
    s = p[:, -2][:, None, None]
    height = p[:, None, : 3 * k : 3]
    shape = np.divide(bells, height, out=np.zeros_like(bells), where=np.abs(height) > 1e-12)
    each = np.stack([shape, bells * dx / s**2, bells * dy / s**2], axis=3).reshape(len(p), x.shape[1], 3 * k)
    wide = (bells * (dx * dx + dy * dy)).sum(axis=2, keepdims=True) / s**3
    return np.concatenate([each, wide, np.ones_like(wide)], axis=2)


def fit(data: np.ndarray, x: np.ndarray, y: np.ndarray, noise: np.ndarray, inside: np.ndarray, start: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Parameters, their errors and chi squared of regions with k emitters each, all open regions at once; pixels not `inside` don't count.

    Damped least squares. Centres stay in the region's square and heights above 0; widths within a factor of two of their start.
    """
    p, weight, damp = start.copy(), np.where(inside, 1 / noise, 0.0), np.full(len(start), 1e-2)
    low, high = start.copy(), start.copy()
    for c, v in ((1, x), (2, y)):
        low[:, c : 3 * k : 3], high[:, c : 3 * k : 3] = v.min(axis=1)[:, None] - 0.5, v.max(axis=1)[:, None] + 0.5
    low[:, : 3 * k : 3], high[:, : 3 * k : 3] = 1e-6, np.inf
    low[:, -2], high[:, -2], low[:, -1], high[:, -1] = start[:, -2] / 2, start[:, -2] * 2, -np.inf, np.inf
    p = np.clip(p, low, high)
    cost = (((model(p, x, y, k) - data) * weight) ** 2).sum(axis=1)
    settled = np.zeros(len(p), bool)
    for _ in range(ROUNDS):
        at = np.flatnonzero(~settled)
        if not len(at):
            break
        j = _slopes(p[at], x[at], y[at], k) * weight[at, :, None]
        r = (data[at] - model(p[at], x[at], y[at], k)) * weight[at]
        square = np.einsum("nij,nik->njk", j, j)
        lift = damp[at, None] * (np.einsum("njj->nj", square) + 1e-12) + 1e-12
        step = np.linalg.solve(square + np.eye(3 * k + 2) * lift[:, None, :], np.einsum("nij,ni->nj", j, r)[..., None])[..., 0]
        new = np.clip(p[at] + step, low[at], high[at])
        after = (((model(new, x[at], y[at], k) - data[at]) * weight[at]) ** 2).sum(axis=1)
        better = after <= cost[at]
        settled[at] = better & (cost[at] - after <= 1e-9 * (1 + cost[at]))
        p[at[better]], cost[at[better]] = new[better], after[better]
        damp[at] = np.clip(np.where(better, damp[at] / 5, damp[at] * 4), 1e-9, 1e12)
        settled[at] |= damp[at] > 1e10
    j = _slopes(p, x, y, k) * weight[:, :, None]
    spread = np.linalg.pinv(np.einsum("nij,nik->njk", j, j), hermitian=True)
    return p, np.sqrt(np.maximum(np.einsum("njj->nj", spread), 0)), cost


def fit_counts(data: np.ndarray, x: np.ndarray, y: np.ndarray, noise: np.ndarray, inside: np.ndarray, width: float, most: int = MOST, exact: bool = False) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """Of each region: parameters, errors and chi squared with as many emitters (1 to `most`) as its likelihood calls for.

    From one emitter at the brightest pixel on, another is set where what is left is largest, and all are fitted anew. It is kept if chi squared falls by more
    than its three parameters are worth: three times the logarithm of the pixels that count (the Bayesian criterion). Regions stop by themselves, the
    others go on together. exact: `most` emitters, come what may.
    """
    n = len(data)
    best: list[tuple[np.ndarray, np.ndarray, float]] = [None] * n  # type: ignore[list-item]
    ground = np.where(inside, data, np.inf).min(axis=1)
    open_, now = np.arange(n), np.zeros((n, 0))
    for k in range(1, most + 1):
        d, xs, ys = data[open_], x[open_], y[open_]
        prior = np.concatenate([now, np.full((len(open_), 1), width), ground[open_, None]], axis=1) if k == 1 else now
        left = np.where(inside[open_], (d - (model(prior, xs, ys, k - 1) if k > 1 else ground[open_, None])) / noise[open_], -np.inf)
        peak = left.argmax(axis=1)
        rows = np.arange(len(open_))
        height = np.maximum((left * noise[open_])[rows, peak], 1e-3)
        start = np.concatenate([prior[:, : 3 * (k - 1)], np.stack([height, xs[rows, peak], ys[rows, peak]], axis=1), prior[:, -2:]], axis=1)
        p, error, chi = fit(d, xs, ys, noise[open_], inside[open_], start, k)
        worth = 3 * np.log(np.maximum(inside[open_].sum(axis=1), 2))
        better = np.array([best[i] is None or exact or best[i][2] - c > w for i, c, w in zip(open_, chi, worth, strict=True)])
        room = inside[open_].sum(axis=1) > 3 * k + 5
        for i, a, e, c in zip(open_[better], p[better], error[better], chi[better], strict=True):
            best[i] = (a, e, float(c))
        go = better & (room | exact)
        open_, now = open_[go], p[go]
        if not len(open_):
            break
    return best


def _square(stack: np.ndarray, frame: int, cy: int, cx: int, half: int) -> tuple[np.ndarray, ...]:
    h, w = stack.shape[1:]
    y, x = (v.ravel() for v in np.mgrid[cy - half : cy + half + 1, cx - half : cx + half + 1])
    inside = (y >= 0) & (y < h) & (x >= 0) & (x < w)
    return frame * h * w + np.clip(y, 0, h - 1) * w + np.clip(x, 0, w - 1), x.astype(float), y.astype(float), inside


COLUMNS = ("A", "x", "y", "sigma", "background", "error_A", "error_x", "error_y", "error_sigma", "error_background", "chi2")


def _rows(keys: pd.DataFrame, names: Sequence[str], found: list, regions: Sequence[int], pixels: Sequence[int]) -> pd.DataFrame:
    """A row an emitter."""
    out = []
    for (p, e, chi), region, row, count in zip(found, regions, keys.itertuples(index=False), pixels, strict=True):
        k = (len(p) - 2) // 3
        for i in range(k):
            a, b = p[3 * i : 3 * i + 3], e[3 * i : 3 * i + 3]
            out.append((*row, region, i + 1, k, *a, *p[-2:], *b, *e[-2:], chi / max(1, count - len(p))))
    return pd.DataFrame(out, columns=[*names, "region", "emitter", "n_emitters", *COLUMNS])


def _schema(frames: DataFrame, keys: Sequence[str], region: str) -> str:
    kinds = dict(frames.dtypes)
    return ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), f"region {region}, emitter int, n_emitters int", *(f"{c} double" for c in COLUMNS)])


def fit_regions(frames: DataFrame, keys: Sequence[str], sigma: float = 1.2, snr: float = 5.0, most: int = MOST, margin: int = 3) -> DataFrame:
    """A row an emitter of each bright region of each frame: keys, region, emitter, n_emitters, and COLUMNS (pixels; reduced chi squared).

    Regions are 4-connected pixels of the band-passed frame above its median by `snr` times the noise (that of the frame, or sigma of the frames as
    camera.correct() gives it). A region is fitted in the square around its bounding box and `margin`, without the pixels of other
    regions, by fit_counts(). Frames carry background as in localise(); frames without regions give no rows. Regions of one size in a batch are fitted together.
    """
    held = _held(frames, keys)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            jobs: dict[int, list[tuple]] = {}
            for i, (p, h, w) in enumerate(zip(part["pixels"], part["height"], part["width"], strict=True)):
                frame = np.asarray(p, float).reshape(h, w)
                noise = np.asarray(part["noise"].iloc[i], float).reshape(h, w) if "noise" in part else np.sqrt(READ_NOISE**2 + np.maximum(frame, 1.0))
                if "background" in part:
                    frame = frame - np.asarray(part["background"].iloc[i], float).reshape(h, w)
                if not frame.size:
                    continue
                band = gaussian(sigma)(frame) - gaussian(2.5 * sigma)(frame)
                middle = np.median(band)
                level = snr * (noise if "noise" in part else max(1.4826 * np.median(np.abs(band - middle)), 1e-9))
                ids = label(band > middle + level)
                for region in range(1, ids.max() + 1):
                    ys, xs = np.nonzero(ids == region)
                    half = max(np.ptp(ys), np.ptp(xs)) // 2 + 1 + margin
                    place, x, y, inside = _square(frame[None], 0, (ys.min() + ys.max()) // 2, (xs.min() + xs.max()) // 2, int(half))
                    other = ids.ravel()[place]
                    jobs.setdefault(int(half), []).append((i, region, frame.ravel()[place], x, y, noise.ravel()[place], inside & ((other == 0) | (other == region))))
            for half, group in sorted(jobs.items()):
                size = max(1, FITTED * 121 // (2 * half + 1) ** 2)
                for a in range(0, len(group), size):
                    at, region, *arrays = zip(*group[a : a + size], strict=True)
                    data, x, y, noise, inside = map(np.stack, arrays)
                    found = fit_counts(data, x, y, noise, inside, sigma, most)
                    yield _rows(part[list(keys)].iloc[list(at)], keys, found, region, inside.sum(axis=1))

    return held.mapInPandas(run, _schema(frames, keys, "long"))


def fit_dumbbells(frames: DataFrame, points: DataFrame, keys: Sequence[str], half: int = 7, sigma: float = 1.2, point_id: str = "point_id") -> DataFrame:
    """Two rows (emitter 1 and 2) for each point (keys, point_id, x, y in pixels): pairs of Gaussians of one width in the square of 2 half + 1 pixels around it.

    region is the point's id. Points meet their frame as one list; points without a frame are left out. The brighter emitter is the first.
    """
    given = points.groupBy(*keys).agg(F.collect_list(F.struct(F.col(point_id).alias("id"), F.col("y").cast("double").alias("y"), F.col("x").cast("double").alias("x"))).alias("spots"))
    held = _held(frames, keys).join(given, list(keys))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            jobs = []
            for i, (p, h, w, spots) in enumerate(zip(part["pixels"], part["height"], part["width"], part["spots"], strict=True)):
                frame = np.asarray(p, float).reshape(h, w)
                noise = np.asarray(part["noise"].iloc[i], float).reshape(h, w) if "noise" in part else np.sqrt(READ_NOISE**2 + np.maximum(frame, 1.0))
                if "background" in part:
                    frame = frame - np.asarray(part["background"].iloc[i], float).reshape(h, w)
                for s in spots if frame.size else ():
                    place, x, y, inside = _square(frame[None], 0, round(s["y"]), round(s["x"]), half)
                    if inside.any():
                        jobs.append((i, s["id"], frame.ravel()[place], x, y, noise.ravel()[place], inside))
            for a in range(0, len(jobs), FITTED):
                at, region, *arrays = zip(*jobs[a : a + FITTED], strict=True)
                data, x, y, noise, inside = map(np.stack, arrays)
                found = [(_ordered(p), e if p[0] >= p[3] else _swapped(e), c) for p, e, c in fit_counts(data, x, y, noise, inside, sigma, 2, exact=True)]
                yield _rows(part[list(keys)].iloc[list(at)], keys, found, region, inside.sum(axis=1))

    return held.mapInPandas(run, _schema(frames, keys, dict(points.dtypes)[point_id]))


def _swapped(p: np.ndarray) -> np.ndarray:
    return np.concatenate([p[3:6], p[:3], p[6:]])


def _ordered(p: np.ndarray) -> np.ndarray:
    return p if p[0] >= p[3] else _swapped(p)
