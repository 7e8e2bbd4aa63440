"""Frame localisation: points of a frame, and a weighted Gaussian fit around each.

A frame is one row. Frames of one shape in a batch are filtered as one stack, and all spots of a batch are fitted together.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from photonflow.operators import images

PARAMETERS = ("A", "x0", "y0", "sigma", "background", "bx", "by")
#: Noise model of counts without a camera: read noise and photon noise, in counts.
READ_NOISE = 1.0
#: Spots that are fitted at once, and frames that are held as one stack: bounds of a task's memory.
FITTED = 4096
STACKED = 1 << 23


def gaussian(p: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Gaussians on sloping backgrounds: p (spots, 7), x and y (spots, pixels)."""
    a, x0, y0, s, b, bx, by = (v[:, None] for v in p.T)
    return a * np.exp(-((x - x0) ** 2 + (y - y0) ** 2) / (2 * s * s)) + b + bx * (x - x0) + by * (y - y0)


def _slopes(p: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Derivatives of gaussian() by its parameters: (spots, pixels, 7)."""
    a, x0, y0, s, _, bx, by = (v[:, None] for v in p.T)
    dx, dy = x - x0, y - y0
    bell = np.exp(-(dx * dx + dy * dy) / (2 * s * s))
    one = np.ones_like(bell)
    return np.stack([bell, a * bell * dx / s**2 - bx, a * bell * dy / s**2 - by, a * bell * (dx * dx + dy * dy) / s**3, one, dx, dy], axis=2)


def fit_gaussians(data: np.ndarray, x: np.ndarray, y: np.ndarray, noise: np.ndarray, start: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Parameters, their errors, reduced chi squared and whether it settled, of every spot: damped least squares, all open spots at once."""
    p, damp = start.astype(float).copy(), np.full(len(start), 1e-2)
    cost = (((gaussian(p, x, y) - data) / noise) ** 2).sum(axis=1)
    settled = np.zeros(len(p), bool)
    for _ in range(rounds):
        at = np.flatnonzero(~settled)
        if not len(at):
            break
        now, xs, ys, ns = p[at], x[at], y[at], noise[at]
        j = _slopes(now, xs, ys) / ns[:, :, None]
        r = (data[at] - gaussian(now, xs, ys)) / ns
        square = np.einsum("nij,nik->njk", j, j)
        diagonal = np.einsum("njj->nj", square) + 1e-12
        step = np.linalg.solve(square + np.eye(7) * (damp[at, None] * diagonal + 1e-12)[:, None, :], np.einsum("nij,ni->nj", j, r)[..., None])[..., 0]
        new = now + step
        new[:, 3] = np.clip(np.abs(new[:, 3]), 0.2, 4 * np.abs(start[at, 3]))
        after = (((gaussian(new, xs, ys) - data[at]) / ns) ** 2).sum(axis=1)
        better = after <= cost[at]
        settled[at] = better & (cost[at] - after <= 1e-9 * (1 + cost[at]))
        p[at[better]], cost[at[better]] = new[better], after[better]
        damp[at] = np.clip(np.where(better, damp[at] / 5, damp[at] * 4), 1e-9, 1e9)
    j = _slopes(p, x, y) / noise[:, :, None]
    spread = np.linalg.pinv(np.einsum("nij,nik->njk", j, j))
    chi = cost / max(1, data.shape[1] - 7)
    return p, np.sqrt(np.maximum(np.einsum("njj->nj", spread), 0) * chi[:, None]), chi, settled


def _sparse(at: np.ndarray, brightness: np.ndarray, shape: tuple[int, ...], apart: int) -> np.ndarray:
    """Which of the places (frame, row, column) stay: from the brightest down (ties by place), unless one closer than `apart` in both axes stayed."""
    stay, taken, reach = np.zeros(len(at), bool), np.zeros(shape, bool), apart - 1
    for k in np.lexsort((at[:, 2], at[:, 1], at[:, 0], -brightness)):
        n, y, x = at[k]
        if not taken[n, y, x]:
            stay[k] = True
            taken[n, max(0, y - reach) : y + reach + 1, max(0, x - reach) : x + reach + 1] = True
    return stay


def find_spots(frames: np.ndarray, sigma: float, snr: float, apart: int, noise: np.ndarray | None = None) -> np.ndarray:
    """(row, column) of local maxima of a band-passed frame that exceed its median by `snr` times the noise; of those closer than
    `apart` pixels (in both axes) the brightest stays. For a stack of frames: (frame, row, column).

    noise: of each pixel; without it, the frame's own, from the median deviation of the band-passed frame.
    """
    stack = frames if frames.ndim == 3 else frames[None]
    band = images.gaussian(sigma)(stack) - images.gaussian(2.5 * sigma)(stack)
    middle = np.median(band, axis=(1, 2), keepdims=True)
    if noise is None:
        noise = np.maximum(1.4826 * np.median(np.abs(band - middle), axis=(1, 2), keepdims=True), 1e-9)
    padded = np.pad(band, [(0, 0), (1, 1), (1, 1)], constant_values=-np.inf)
    h, w = band.shape[1:]
    around = band.copy()
    for i in range(3):
        for j in range(3):
            np.maximum(around, padded[:, i : i + h, j : j + w], out=around)
    at = np.argwhere((band == around) & (band > middle + snr * noise))
    at = at[_sparse(at, band[tuple(at.T)], band.shape, apart)]
    return at if frames.ndim == 3 else at[:, 1:]


def fit_spots(stack: np.ndarray, spots: np.ndarray, half: int, sigma: float, noise: np.ndarray | None = None, background: np.ndarray | None = None) -> pd.DataFrame:
    """A row a spot (frame, row, column): the parameters of PARAMETERS (pixels), error_<parameter>, chi2 and settled. A spot's pixels are
    the square of 2 half + 1 around it, moved into the frame at its edges. A background is taken off before the fit, not from the noise."""
    h, w = stack.shape[1:]
    half = min(half, (min(h, w) - 1) // 2)
    centre = np.clip(spots[:, 1:], half, np.array([h, w]) - half - 1)
    off = np.arange(-half, half + 1)
    parts = []
    for i in range(0, len(spots), FITTED):
        n, c, s = spots[i : i + FITTED, 0], centre[i : i + FITTED], spots[i : i + FITTED, 1:]
        rows = (c[:, 0, None, None] + off[None, :, None] + 0 * off[None, None, :]).reshape(len(n), -1)
        columns = (c[:, 1, None, None] + 0 * off[None, :, None] + off[None, None, :]).reshape(len(n), -1)
        place = (n[:, None], rows, columns)
        data = stack[place].astype(float)
        weight = np.sqrt(READ_NOISE**2 + np.maximum(data, 1.0)) if noise is None else noise[place]
        if background is not None:
            data = data - background[place]
        low = data.min(axis=1)
        start = np.stack([data.max(axis=1) - low, s[:, 1], s[:, 0], np.full(len(n), sigma), low, 0 * low, 0 * low], axis=1)
        p, error, chi, settled = fit_gaussians(data, columns.astype(float), rows.astype(float), weight, start)
        values = {m: p[:, k] for k, m in enumerate(PARAMETERS)} | {f"error_{m}": error[:, k] for k, m in enumerate(PARAMETERS)}
        parts.append(pd.DataFrame(values | {"chi2": chi, "settled": settled}))
    return pd.concat(parts, ignore_index=True)


def _stacks(part: pd.DataFrame) -> Iterator[tuple[np.ndarray, dict[str, np.ndarray | None]]]:
    """Places in a batch of frames of one shape, as many as STACKED pixels allow, and their stacks by column."""
    for (h, w), group in part.groupby(["height", "width"], sort=False):
        step = max(1, STACKED // max(1, h * w))
        for i in range(0, len(group), step):
            rows = group.iloc[i : i + step]
            stack = lambda c: np.stack([np.asarray(v, float) for v in rows[c]]).reshape(-1, h, w)  # noqa: B023, E731
            yield rows.index.to_numpy(), {c: stack(c) for c in ("pixels", "noise", "background") if c in part.columns and h * w}


def _held(frames: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, height, width, pixels and, where frames have them, noise (their sigma) and background; frames that lack one are left out."""
    more = [F.transform(c, lambda v: v.cast("double")).alias(n) for c, n in (("sigma", "noise"), ("background", "background")) if c in frames.columns]
    whole = frames.select(*keys, "height", "width", F.transform("pixels", lambda p: p.cast("double")).alias("pixels"), *more)
    for c in whole.columns[len(keys) + 2 :]:
        whole = whole.where(F.col(c).isNotNull())
    return whole


def localise(frames: DataFrame, keys: Sequence[str], half: int = 5, sigma: float = 1.2, snr: float = 5.0, apart: int = 4, points: DataFrame | None = None) -> DataFrame:
    """A row for each spot of each frame (height, width, pixels): keys, x0 and y0 in pixels, and what else fit_spots() gives.

    Frames may carry sigma, the noise of each pixel (as camera.correct() gives it), which then weighs the fit and sets what a
    spot must exceed, and background, which is taken off first. Spots are found by find_spots(), or given as `points` (keys, x, y in
    pixels), which meet their frame as one list. Frames without spots give no rows; frames with null pixels, sigma or background are left out.
    """
    held, searched = _held(frames, keys), points is None
    if not searched:
        given = points.groupBy(*keys).agg(F.collect_list(F.struct(F.col("y").cast("double").alias("y"), F.col("x").cast("double").alias("x"))).alias("spots"))
        held = held.join(given, list(keys))
    names = [*keys, *PARAMETERS, *(f"error_{n}" for n in PARAMETERS), "chi2", "settled"]

    def listed(rows: pd.DataFrame, shape: tuple[int, ...]) -> np.ndarray:
        found = [(i, round(s["y"]), round(s["x"])) for i, spots in enumerate(rows["spots"]) for s in spots]
        return np.clip(np.array(sorted(found), int).reshape(-1, 3), 0, np.array(shape) - 1)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for at, stacks in _stacks(part):
                rows, stack, noise, background = part.loc[at], stacks["pixels"], stacks.get("noise"), stacks.get("background")
                if searched:
                    spots = find_spots(stack if background is None else np.maximum(stack - background, 0), sigma, snr, apart, noise)
                else:
                    spots = listed(rows, stack.shape)
                if len(spots):
                    found = fit_spots(stack, spots, half, sigma, noise, background)
                    own = rows[list(keys)].iloc[spots[:, 0]].reset_index(drop=True)
                    yield pd.concat([own, found], axis=1)[names]

    kinds = dict(frames.dtypes)
    columns = [f"`{k}` {kinds[k]}" for k in keys] + [f"{n} double" for n in (*PARAMETERS, *(f"error_{n}" for n in PARAMETERS), "chi2")] + ["settled boolean"]
    return held.mapInPandas(run, ", ".join(columns))


def _label_boxes(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last (row, column) of each 4-connected region, in raster order of the regions."""
    ids = images.label(mask)
    y, x = np.nonzero(ids)
    n = ids[y, x] - 1
    low, high = np.full((n.max() + 1 if len(n) else 0, 2), np.iinfo(np.int64).max), np.full((n.max() + 1 if len(n) else 0, 2), -1)
    for axis, v in enumerate((y, x)):
        np.minimum.at(low[:, axis], n, v)
        np.maximum.at(high[:, axis], n, v)
    return low, high


def _centres(band: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Centres of mass (row, column) of the boxes of a band-passed frame."""
    out = np.empty((len(low), 2))
    for i, ((y0, x0), (y1, x1)) in enumerate(zip(low, high, strict=True)):
        box = band[y0 : y1 + 1, x0 : x1 + 1]
        total = box.sum()
        out[i] = (box.sum(axis=1) @ np.arange(y0, y1 + 1)) / total, (box.sum(axis=0) @ np.arange(x0, x1 + 1)) / total
    return out


def debounce(places: np.ndarray, band: np.ndarray, radius: float) -> np.ndarray:
    """In order, each point not yet taken gives way to the brightest point closer than the radius, and takes all of those."""
    if not len(places):
        return places
    cell: dict[tuple[int, int], list[int]] = {}
    size = max(radius, 1e-9)
    for i, c in enumerate(np.floor(places / size).astype(int)):
        cell.setdefault(tuple(c), []).append(i)
    bright = band[tuple(places.astype(int).T)]
    taken, kept = np.zeros(len(places), bool), []
    for i, (cy, cx) in enumerate(np.floor(places / size).astype(int)):
        if taken[i]:
            continue
        near = np.array(sorted(k for dy in (-1, 0, 1) for dx in (-1, 0, 1) for k in cell.get((cy + dy, cx + dx), ())))
        near = near[np.hypot(*(places[near] - places[i]).T) < radius]
        kept.append(near[bright[near].argmax()] if len(near) > 1 else i)
        taken[near] = True
    return places[kept]


def detect(frame: np.ndarray, threshold: float | np.ndarray, narrow: float = 1.0, wide: float = 3.0, radius: float = 4, edge: int = 5, steps: int = 0, blur: float = 1.5) -> np.ndarray:
    """(row, column) of the point-like objects of a frame: centres of the regions in which its band-passed pixels exceed a threshold.

    Negative pixels count as 0, and `edge` pixels at each edge are left out. steps: with more than 1, thresholds fall from half the brightest pixel
    in steps of an n-th of the way to `threshold` times the frame's most frequent value, and past it by a quarter of the way; what a step has found
    is blurred by `blur` and taken off before the next.
    """
    frame = np.maximum(frame, 0.0)
    band = np.maximum(images.gaussian(narrow)(frame) - images.gaussian(wide)(frame), 0.0)
    if edge and band.shape[1] > edge:
        inside = np.zeros_like(band)
        inside[edge:-edge, edge:-edge] = band[edge:-edge, edge:-edge]
        band = inside
    if steps < 2:
        return debounce(_centres(band, *_label_boxes(band > threshold)), band, radius)
    count, bins = np.histogram(band, bins=200)
    mode = bins[count.argmax()]
    low, high = (mode if abs(mode) >= 1 else 1.0) * threshold, band.max() / 2
    if high <= low:
        return np.zeros((0, 2))
    left, found = band.copy(), []
    for level in np.arange(high, low - (high - low) / (steps - 1), -(high - low) / steps):
        first, last = _label_boxes(left > level)
        found.append(_centres(left, first, last))
        weight = np.zeros_like(left)
        for (y0, x0), (y1, x1) in zip(first, last, strict=True):
            weight[y0 : y1 + 1, x0 : x1 + 1] = 1 / np.sqrt((y1 - y0 + 1) * (x1 - x0 + 1))
        left = left - images.gaussian(blur)(CLEANED * blur * left * weight)
    return debounce(np.concatenate(found), band, radius)


#: Fixed value of the threshold scan: how much of a found object is taken off, for each pixel of blur.
CLEANED = 2 * np.sqrt(2 * np.pi) * 1.7


def detect_points(frames: DataFrame, keys: Sequence[str], threshold: float = 1.0, snr: bool = True, multithreshold: bool = False, narrow: float = 1.0, wide: float = 3.0, radius: float = 4, edge: int = 5, blur: float = 1.5) -> DataFrame:
    """keys, x and y (pixels) of the points of each frame, as detect() finds them: detections, not fits.

    snr: the threshold is times the noise of each pixel (sigma of the frames, or that of a plain camera); else it is a level, or with
    multithreshold the lowest of five. Both together raise ValueError. Frames without points give no rows; frames with null pixels or sigma are left out.
    """
    if snr and multithreshold:
        raise ValueError("a threshold scan takes no noise")
    held = _held(frames, keys)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for i, (p, h, w) in enumerate(zip(part["pixels"], part["height"], part["width"], strict=True)):
                frame = np.asarray(p, float).reshape(h, w)
                level: float | np.ndarray = threshold
                if snr:
                    level = threshold * (np.asarray(part["noise"].iloc[i]).reshape(h, w) if "noise" in part else np.sqrt(READ_NOISE**2 + np.maximum(frame, 1.0) + 1.0))
                places = detect(frame, level, narrow, wide, radius, edge, 5 if multithreshold else 0, blur) if frame.size else np.zeros((0, 2))
                out.append(part[list(keys)].iloc[[i] * len(places)].assign(x=places[:, 1], y=places[:, 0]))
            if out:
                yield pd.concat(out)

    kinds = dict(frames.dtypes)
    return held.mapInPandas(run, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "x double, y double"]))


def checksums(frames: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sum of each frame's pixels: what a frame must still hold after it was moved."""
    return frames.select(*keys, F.aggregate("pixels", F.lit(0.0), lambda s, v: s + v).alias("checksum"))
