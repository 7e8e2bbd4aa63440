"""Event kinetics (on-times, decays, brightness), joint pair statistics, wavefronts and fiducial drift."""

from __future__ import annotations

from collections.abc import Sequence
from math import pi

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from photonflow.operators.asof import as_of
from photonflow.operators.tiles import Tile, fine, meetings, pair_counts, tiles
from photonflow.operators.windows import frame_means


def area_fractions(df: DataFrame, a: Column, b: Column, t_a: float, t_b: float, keys: Sequence[str] = ()) -> DataFrame:
    """Share of a's area (rows above t_a) that b also covers, and the reverse; null where the area is empty."""
    over_a, over_b = a > t_a, b > t_b
    both = F.count_if(over_a & over_b)
    return df.groupBy(*keys).agg(F.try_divide(both, F.count_if(over_a)).alias("fraction_a"), F.try_divide(both, F.count_if(over_b)).alias("fraction_b"))


def on_times(df: DataFrame, clump: str, longest: int = 19, keys: Sequence[str] = ()) -> DataFrame:
    """frames, n: how many clumps hold so many rows, for 1 to `longest`."""
    sizes = df.groupBy(*keys, clump).agg(F.count("*").alias("frames"))
    return sizes.where(F.col("frames") <= longest).groupBy(*keys, "frames").agg(F.count("*").alias("n"))


def brightness_histogram(df: DataFrame, value: str, keys: Sequence[str], bins: int = 99, reach: float = 6.0) -> DataFrame:
    """bin, n over `bins` equal bins from 0 to `reach` times the group's mean. Two aggregations; the means have a row a group."""
    means = df.groupBy(*keys).agg((F.avg(value) * reach / bins).alias("_width"))
    joined = df.join(means, list(keys))
    at = F.floor(F.col(value) / F.col("_width")).cast("int")
    return joined.withColumn("bin", at).where(f"bin between 0 and {bins - 1}").groupBy(*keys, "bin").agg(F.count("*").alias("n"), F.first("_width").alias("width"))


def decay_histogram(df: DataFrame, t: str, keys: Sequence[str], bins: int = 100) -> DataFrame:
    """bin, at (its middle), n: events over `bins` equal steps from the group's first time to its last, which the last bin holds."""
    ends = df.groupBy(*keys).agg(F.min(t).cast("double").alias("_low"), F.max(t).cast("double").alias("_high"))
    joined = df.join(ends, list(keys))
    width = (F.col("_high") - F.col("_low")) / bins
    at = F.when(width > 0, F.least(F.floor((F.col(t) - F.col("_low")) / width), F.lit(bins - 1))).otherwise(0).cast("int")
    middle = F.first("_low") + (F.col("bin") + 0.5) * F.first(width)
    return joined.withColumn("bin", at).groupBy(*keys, "bin").agg(middle.alias("at"), F.count("*").alias("n"))


def exponential(at: np.ndarray, n: np.ndarray, rounds: int = 200) -> tuple[float, float, float]:
    """amplitude, rate, offset of the least-squares fit n = amplitude * exp(-rate * at) + offset, by damped Gauss-Newton steps on the rate."""
    span = max(float(np.ptp(at)), 1e-12)

    def solve(rate: float) -> tuple[np.ndarray, float]:
        basis = np.stack([np.exp(-rate * (at - at.min())), np.ones(len(at))], axis=1)
        c, *_ = np.linalg.lstsq(basis, n, rcond=None)
        return c, float(((basis @ c - n) ** 2).sum())

    grid = np.geomspace(0.05, 200, 60) / span
    best = int(np.argmin([solve(r)[1] for r in grid]))
    low, high = grid[max(0, best - 1)], grid[min(len(grid) - 1, best + 1)]
    golden = (np.sqrt(5) - 1) / 2
    for _ in range(rounds):
        a, b = high - golden * (high - low), low + golden * (high - low)
        low, high = (low, b) if solve(a)[1] < solve(b)[1] else (a, high)
        if high - low < 1e-12 * high:
            break
    rate = (low + high) / 2
    c, _ = solve(rate)
    return float(c[0] * np.exp(rate * at.min())), float(rate), float(c[1])


def fit_decays(histograms: DataFrame, keys: Sequence[str], at: str = "at", n: str = "n") -> DataFrame:
    """amplitude, rate, offset for each group of a histogram: a group has as many rows as the histogram has bins."""
    kinds = ", ".join(f"`{k}` {histograms.schema[k].dataType.simpleString()}" for k in keys)

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(at)
        found = exponential(group[at].to_numpy(float), group[n].to_numpy(float))
        return pd.DataFrame([[*(group[k].iloc[0] for k in keys), *found]], columns=[*keys, "amplitude", "rate", "offset"])

    return histograms.groupBy(*keys).applyInPandas(fit, f"{kinds}, amplitude double, rate double, offset double")


def _off_curve(q: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Share of off-times up to t, and its slopes by q: one exponential (root of its time), or a share of a short one beside a long one. All
    parameters are squares of q, so that none is negative."""
    p = q * q
    falls = [np.exp(-t / p[i]) for i in range(len(q) == 3, len(q))]
    slopes = [-f * t / p[i] ** 2 * 2 * q[i] for f, i in zip(falls, range(len(q) == 3, len(q)), strict=True)]
    if len(q) == 1:
        return 1 - falls[0], np.stack(slopes, axis=1)
    a, b = falls
    return p[0] * (1 - a) + (1 - p[0]) * (1 - b), np.stack([2 * q[0] * (b - a), p[0] * slopes[0], (1 - p[0]) * slopes[1]], axis=1)


def off_times(t: np.ndarray, share: np.ndarray, components: int, rounds: int = 200) -> tuple[np.ndarray, float]:
    """Parameters ([time] or [share of the first, its time, the other's]; first the shorter) of off-times' cumulative shares, and the root mean square left."""
    middle = max(float(np.interp(1 - np.exp(-1), share, t)), 1e-6)
    q = np.sqrt([middle] if components == 1 else [0.5, middle / 5, middle * 2])
    damp, cost = 1e-2, np.inf
    for _ in range(rounds):
        c, j = _off_curve(q, t)
        r = share - c
        square = j.T @ j
        step = np.linalg.solve(square + np.diag(damp * (np.diag(square) + 1e-12) + 1e-15), j.T @ r)
        new = np.maximum(np.abs(q + step), 1e-6)
        after = float(((share - _off_curve(new, t)[0]) ** 2).sum())
        now = float((r * r).sum())
        if after <= now:
            done, q, damp, cost = now - after <= 1e-14 * (1 + now), new, max(damp / 5, 1e-12), after
            if done:
                break
        else:
            damp, cost = damp * 4, now
            if damp > 1e12:
                break
    p = q * q
    if components == 2 and p[1] > p[2]:
        p = np.array([1 - p[0], p[2], p[1]])
    return p, float(np.sqrt(cost / len(t)))


def fit_off_times(cdf: DataFrame, site: str, components: int = 1, off: str = "off", share: str = "cdf") -> DataFrame:
    """site, off_time, and of two components share, off_short and off_long; residual, n: exponential blinking fitted to cumulative shares of off-times.

    cdf is offtime_cdf()'s: a row for each off-time of a site, so a site has as many rows as it has different off-times. Sites of fewer
    rows than parameters are left out.
    """
    names = ["off_time"] if components == 1 else ["share", "off_short", "off_long"]
    kind = dict(cdf.dtypes)[site]
    columns = [site, *names, "residual", "n"]

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(off)
        if len(group) < len(names):
            return pd.DataFrame([], columns=columns)
        p, rest = off_times(group[off].to_numpy(float), group[share].to_numpy(float), components)
        return pd.DataFrame([[group[site].iloc[0], *p, rest, len(group)]], columns=columns)

    return cdf.groupBy(site).applyInPandas(fit, f"`{site}` {kind}, {', '.join(f'{n} double' for n in names)}, residual double, n long")


def vector_pair_histogram(points: DataFrame, bins: int, size: float, angle_bins: int, row_id: str) -> DataFrame:
    """r_bin, theta_bin, phi_bin, n over pairs (x, y, z) closer than bins * size.

    theta = atan(dy / dx) + pi / 2 and phi = atan(dz / hypot(dx, dy)) + pi / 2, each over pi in angle_bins; a pair with
    no finite quotient takes pi / 2 of the numerator's sign. Only bins with pairs are returned.
    """
    radius, cell = bins * size, fine(bins * size)
    held = tiles(points, row_id, ("x", "y", "z"), cell)

    def angle(up: np.ndarray, along: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            turned = np.where(along != 0, np.arctan(up / along), np.sign(up) * (pi / 2)) + pi / 2
        return np.minimum(turned * angle_bins / pi, angle_bins - 1).astype(np.int64)

    def count(total: np.ndarray, d: np.ndarray, a: Tile, b: Tile, part: slice) -> None:
        row, column = np.nonzero(d < radius)
        way = np.where(a.ids[part][row] < b.ids[column], 1.0, -1.0)  # from the lower id to the higher one
        dx, dy, dz = ((b.at[k][column] - a.at[k, part][row]) * way for k in range(3))
        ring = (d[row, column] / size).astype(np.int64)
        total += np.bincount((ring * angle_bins + angle(dy, dx)) * angle_bins + angle(dz, np.hypot(dx, dy)), minlength=len(total))

    places = (bins + 1) * angle_bins * angle_bins
    found = meetings(held, held, radius, cell, once=True).mapInArrow(pair_counts(radius, 3, places, count), "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n"))
    part = lambda step, c: (F.floor(F.col("bin") / step) % c).cast("int")
    return found.select(part(angle_bins**2, bins + 1).alias("r_bin"), part(angle_bins, angle_bins).alias("theta_bin"), part(1, angle_bins).alias("phi_bin"), "n")


def central_difference(df: DataFrame, order: str, value: str, out: str, keys: Sequence[str] = ()) -> DataFrame:
    """out: half the difference of the next and the previous value, over their step in `order` halved; end rows are dropped.

    df is a curve: a row for each bin of a group.
    """
    w = Window.partitionBy(*keys).orderBy(order) if keys else Window.partitionBy(F.lit(0)).orderBy(order)
    rise = F.lead(value).over(w) - F.lag(value).over(w)
    run = F.lead(order).over(w) - F.lag(order).over(w)
    return df.withColumn(out, rise / run).where(F.col(out).isNotNull())


def piecewise_linear(t: Column, starts: Sequence[float], slopes: Sequence[float]) -> Column:
    """Sum of slopes times the time spent in each piece; a piece lasts from its start to the next one's, the last for ever."""
    ends = [*starts[1:], None]
    total = F.lit(0.0)
    for s, e, g in zip(starts, ends, slopes, strict=True):
        spent = F.greatest(t - s, F.lit(0.0))
        total = total + (F.least(spent, F.lit(float(e - s))) if e is not None else spent) * g
    return total


def wavefronts(frames: DataFrame, series: str, t: str, pixels: str, least: float, steepest: float) -> DataFrame:
    """front (array of 0 and 1): pixels above `least` that changed by less than `steepest` since the frame before; active: their sum.

    The first frame of a series has no front.
    """
    before = F.lag(pixels).over(Window.partitionBy(series).orderBy(t))
    mark = F.zip_with(pixels, before, lambda now, was: ((now > least) & (F.abs(now - was) < steepest)).cast("int"))
    front = F.coalesce(mark, F.transform(pixels, lambda _: F.lit(0)))
    return frames.withColumn("front", front).withColumn("active", F.aggregate("front", F.lit(0), lambda s, v: s + F.coalesce(v, F.lit(0))))


def fiducial_trajectory(fiducials: DataFrame, series: str, clump: str, t: str, axes: Sequence[str], least: int, half: int) -> DataFrame:
    """series, t, d_<axis>: mean place of the series' fiducials about their own centres, smoothed over t - half to t + half.

    Clumps of fewer than `least` rows don't count. Frames are added up first; a series is smoothed in blocks of time, by many tasks.
    """
    centres = fiducials.groupBy(series, clump).agg(F.count("*").alias("_n"), *(F.avg(c).alias(f"_{c}") for c in axes)).where(F.col("_n") >= least)
    moved = fiducials.join(centres, [series, clump]).where(F.col(t).isNotNull()).groupBy(series, t)
    moved = moved.agg(*(F.avg(F.col(c) - F.col(f"_{c}")).alias(f"sum_{c}") for c in axes))
    moved = moved.withColumns({f"n_{c}": F.col(f"sum_{c}").isNotNull().cast("int") for c in axes})
    return frame_means(moved, [series], t, axes, -half, half).withColumnsRenamed({f"mean_{c}": f"d_{c}" for c in axes})


def fiducial_correction(points: DataFrame, trajectory: DataFrame, series: str, t: str, axes: Sequence[str], block: int | None = None) -> DataFrame:
    """points less the trajectory at their frame; between frames of the trajectory by linear interpolation, beyond its ends by its end.

    `block`: a length of time by which series are cut, so that a long one is done by many tasks.
    """
    known = trajectory.select(series, t, F.struct(F.col(t).alias("at"), *(f"d_{c}" for c in axes)).alias("_at"))
    frames = points.select(series, t).distinct()
    frames = as_of(as_of(frames, known, [series], t, "_at", "_p", block=block), known, [series], t, "_at", "_n", ahead=True, block=block)
    share = F.coalesce(F.try_divide(F.col(t) - F.col("_p.at"), F.col("_n.at") - F.col("_p.at")), F.lit(0.0))
    at = {c: F.coalesce(F.col(f"_p.d_{c}") + share * (F.col(f"_n.d_{c}") - F.col(f"_p.d_{c}")), F.col(f"_p.d_{c}"), F.col(f"_n.d_{c}"), F.lit(0.0)) for c in axes}
    shifts = frames.select(series, t, *(v.alias(f"_{c}") for c, v in at.items()))
    return points.join(shifts, [series, t], "left").withColumns({c: F.col(c) - F.col(f"_{c}") for c in axes}).drop(*(f"_{c}" for c in axes))


def jump_mixture(counts: np.ndarray, size: float, step: float, species: int, rounds: int = 500, bins: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Diffusion coefficients (rising) and shares of species whose plane jumps over a time `step` make a histogram (bins of `size` from 0; `bins` tells
    which, if not all).

    Squared jumps of one species are exponential, so expectation and maximisation over the bins has closed steps.
    """
    square = (((np.arange(len(counts)) if bins is None else bins) + 0.5) * size)[:, None] ** 2
    mean = np.average(square[:, 0], weights=counts)
    d = mean / (4 * step) * np.geomspace(0.2, 5, species) if species > 1 else np.array([mean / (4 * step)])
    share = np.full(species, 1 / species)
    for _ in range(rounds):
        p = share * np.exp(-square / (4 * d * step)) / (4 * d * step)
        own = counts[:, None] * p / np.maximum(p.sum(axis=1, keepdims=True), 1e-300)
        weight = np.maximum(own.sum(axis=0), 1e-12)
        share, d = weight / weight.sum(), (own * square).sum(axis=0) / weight / (4 * step)
    order = np.argsort(d)
    return d[order], share[order]


def fit_jumps(histogram: DataFrame, size: float, step: float, species: int = 2) -> DataFrame:
    """species, diffusion, share from a histogram (bin, n) of jumps: its rows are few, whatever the tracks were."""

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        d, share = jump_mixture(rows["n"].to_numpy(float), size, step, species, bins=rows["bin"].to_numpy(float))
        return pd.DataFrame({"species": np.arange(species), "diffusion": d, "share": share})

    return histogram.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(fit, "species int, diffusion double, share double")
