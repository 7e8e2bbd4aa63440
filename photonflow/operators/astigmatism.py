"""Depth of points from the widths of their images, by calibration curves of a lens that widens them differently along x and y.

A calibration is a small table: channel (from 0), z, sigmax, sigmay, and z_low and z_high, between which the channel's curves are trusted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

#: Rows that a calibration may have; it is read by every task.
LONGEST = 200_000
#: Points that are held against all depths at once.
CHUNK = 1024


def smooth_curve(z: np.ndarray, value: np.ndarray, knots: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A cubic spline with the given knots, fitted by least squares, at places `at`; beyond its data it keeps its value at the end."""
    low, high = z.min(), z.max()
    span = max(high - low, 1e-12)

    def basis(v: np.ndarray) -> np.ndarray:
        u = (np.clip(v, low, high) - low) / span
        return np.stack([u**k for k in range(4)] + [np.maximum(u - (q - low) / span, 0) ** 3 for q in knots], axis=1)

    return basis(at) @ np.linalg.lstsq(basis(z), value, rcond=1e-13)[0]


def curves(calibration: pd.DataFrame, spacing: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Depths in whole steps over all channels' trusted ranges, and the channels' smoothed widths there: (channels, depths) along x and y."""
    channels = sorted(calibration["channel"].unique())
    depth = np.arange(min(0, calibration["z_low"].min()), max(0, calibration["z_high"].max()))
    wide = []
    for c in channels:
        own = calibration[calibration["channel"] == c].sort_values("z")
        own = own[(own["z"] > own["z_low"]) & (own["z"] < own["z_high"])]
        steps = np.unique(own["z"])
        every = max(1, int(spacing / np.median(np.diff(steps)))) if len(steps) > 1 else 1
        wide.append([smooth_curve(own["z"].to_numpy(float), own[s].to_numpy(float), steps[1:-1:every], depth) for s in ("sigmax", "sigmay")])
    return depth, np.array([w[0] for w in wide]), np.array([w[1] for w in wide])


def map_astigmatic_z(points: DataFrame, calibration: DataFrame, spacing: float = 75.0, z: str = "z") -> DataFrame:
    """points with astigmatic_z, astigmatic_z_lookup_error, and z moved by astigmatic_z.

    points have sigmax<channel> and sigmay<channel> and their errors error_sigmax<channel>, error_sigmay<channel>; of a calibration of one channel, also
    without the number. Each point takes the depth at which its widths miss the smoothed curves of all channels least, weighted by their errors;
    of equally good ones, the first. astigmatic_z counts against the curves' direction, as a point above the focus sees the
    lens below; the lookup error is the root of the weighted mean square that is left. Widths count without sign. Channels in which a point has no width or no
    error (null, NaN) don't count, a point without any has null in all three. Depths are told in whole units.
    """
    told = calibration.select("channel", *(F.col(c).cast("double").alias(c) for c in ("z", "sigmax", "sigmay", "z_low", "z_high"))).limit(LONGEST + 1).toPandas()
    if len(told) > LONGEST:
        raise ValueError(f"a calibration of more than {LONGEST} rows")
    depth, curve_x, curve_y = curves(told, spacing)
    channels = range(len(curve_x))
    has = {c.lower() for c in points.columns}
    name = lambda stem, c: f"{stem}{c}" if f"{stem}{c}" in has or len(curve_x) > 1 else stem
    stems = [(name("sigmax", c), name("error_sigmax", c), name("sigmay", c), name("error_sigmay", c)) for c in channels]
    columns, out = points.columns, ["astigmatic_z", "astigmatic_z_lookup_error"]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            best, left = np.full(len(part), np.nan), np.full(len(part), np.nan)
            for i in range(0, len(part), CHUNK):
                rows = part.iloc[i : i + CHUNK]
                cost, weight = np.zeros((len(rows), len(depth))), np.zeros(len(rows))
                for c, (sx, ex, sy, ey) in zip(channels, stems, strict=True):
                    for s, e, curve in ((sx, ex, curve_x[c]), (sy, ey, curve_y[c])):
                        v, d = np.abs(rows[s].to_numpy(float)), rows[e].to_numpy(float)
                        w = np.where(np.isfinite(v) & np.isfinite(d) & (d != 0), 1 / np.where(d == 0, 1, d) ** 2, 0.0)
                        w = np.nan_to_num(w)
                        cost += w[:, None] * (np.nan_to_num(v)[:, None] - curve) ** 2
                        weight += w
                at = cost.argmin(axis=1)
                some = weight > 0
                best[i : i + CHUNK] = np.where(some, 0.0 - depth[at], np.nan)
                left[i : i + CHUNK] = np.where(some, np.sqrt(cost[np.arange(len(rows)), at] / np.where(some, weight, 1)), np.nan)
            yield part.assign(astigmatic_z=best, astigmatic_z_lookup_error=left)[[*columns, *out]]

    kinds = dict(points.dtypes)
    found = points.mapInPandas(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in columns), *(f"{o} double" for o in out)]))
    found = found.withColumns({o: F.when(~F.isnan(o), F.col(o)) for o in out})
    return found.withColumn(z, (F.col(z) if z in columns else F.lit(0.0)) + F.col("astigmatic_z"))
