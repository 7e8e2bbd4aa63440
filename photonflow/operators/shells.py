"""Shells around clouds of points: radii as sums of spherical harmonics over directions, fitted by distributed least squares.

A shell is a row: keys, centre (3), axes (9: principal axes by rows), deviations (3, along them), scaling (3), degree, coefficients
(in the order of modes()), residual, n. Each key (object) has a shell of its own, and any of them may hold most of the points.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from math import factorial, pi, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from photonflow.operators.leastsquares import normal_sums, solved
from photonflow.sources.shared import kept

ALL = "_all"


def modes(degree: int) -> list[tuple[int, int]]:
    """(m, n) of the harmonics up to a degree, in order of their coefficients."""
    return [(m, n) for n in range(degree + 1) for m in range(-n, n + 1)]


def harmonics(azimuth: np.ndarray, zenith: np.ndarray, degree: int) -> np.ndarray:
    """Real spherical harmonics: a column for each of modes(). Those of m > 0 go with cos(m azimuth), those of m < 0 with its sine; they have a quarter of the
    power of the complex ones, and the signs of a complex harmonic's real and imaginary part without its alternating phase."""
    c, s = np.cos(zenith), np.sin(zenith)
    legendre: dict[tuple[int, int], np.ndarray] = {}
    diagonal = np.ones_like(c)
    for m in range(degree + 1):  # up from the diagonal, by the recurrence in n
        legendre[m, m] = diagonal
        if m < degree:
            legendre[m, m + 1] = c * (2 * m + 1) * diagonal
        for n in range(m + 2, degree + 1):
            legendre[m, n] = ((2 * n - 1) * c * legendre[m, n - 1] - (n + m - 1) * legendre[m, n - 2]) / (n - m)
        diagonal = diagonal * s * (2 * m + 1)
    out = []
    for m, n in modes(degree):
        a = abs(m)
        value = sqrt((2 * n + 1) / (4 * pi) * factorial(n - a) / factorial(n + a)) * legendre[a, n]
        if m > 0:
            value = value * np.cos(m * azimuth) / sqrt(2)
        elif m < 0:
            value = value * np.sin(a * azimuth) * -((-1) ** a) / sqrt(2)
        out.append(value)
    return np.stack(out, axis=-1)


def spherical(xyz: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Azimuth, zenith and radius; the origin has angles of 0."""
    r = np.sqrt((xyz * xyz).sum(axis=-1))
    return np.arctan2(xyz[..., 1], xyz[..., 0]), np.arccos(np.clip(np.divide(xyz[..., 2], r, out=np.ones_like(r), where=r > 0), -1, 1)), r


def cartesian(azimuth: np.ndarray, zenith: np.ndarray, r: np.ndarray) -> np.ndarray:
    return np.stack([r * np.sin(zenith) * np.cos(azimuth), r * np.sin(zenith) * np.sin(azimuth), r * np.cos(zenith)], axis=-1)


def _keyed(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """df and its keys; without keys all rows have one."""
    return (df, list(keys)) if keys else (df.withColumn(ALL, F.lit(0)), [ALL])


def frames(points: DataFrame, keys: Sequence[str], axes: Sequence[str] = ("x", "y", "z"), scaled: bool = True) -> DataFrame:
    """keys, centre, axes, deviations, scaling of each key's points: principal axes from their covariance, largest deviation first.

    scaling stretches each axis to the largest deviation; axes of no deviation are not stretched. Without `scaled`, axes stay as they are.
    """
    pairs = [(a, b) for i, a in enumerate(axes) for b in list(axes)[i:]]
    value = {c: F.col(c).cast("double") for c in axes}
    moments = points.groupBy(*keys).agg(F.array(*(F.avg(v) for v in value.values())).alias("centre"), F.array(*(F.covar_samp(value[a], value[b]) for a, b in pairs)).alias("_spread"))
    kinds = dict(points.dtypes)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = []
            for spread in part["_spread"]:
                half = np.zeros((3, 3))
                half[np.triu_indices(3)] = [0.0 if v is None or np.isnan(v) else v for v in spread]
                values, vectors = np.linalg.eigh(half + np.triu(half, 1).T)
                deviations, turned = np.sqrt(np.maximum(values[::-1], 0)), vectors[:, ::-1].T
                turned = turned * np.sign(turned[np.arange(3), np.abs(turned).argmax(axis=1)])[:, None]
                scaling = np.where(deviations > 1e-12 * deviations[0], deviations[0] / np.where(deviations > 0, deviations, 1), 1.0)
                found.append((turned.ravel(), deviations, scaling) if scaled else (np.eye(3).ravel(), np.sqrt(np.maximum(np.diag(half), 0)), np.ones(3)))
            yield part.drop(columns="_spread").assign(**{n: [f[i] for f in found] for i, n in enumerate(("axes", "deviations", "scaling"))})

    return moments.mapInPandas(run, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), *(f"{n} array<double>" for n in ("centre", "axes", "deviations", "scaling"))]))


def _shell_place(own: pd.DataFrame, names: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Azimuth, zenith and radius of one key's points in their shell's stretched frame."""
    first = own.iloc[0]
    axes = np.asarray(first["axes"], float).reshape(3, 3) * np.asarray(first["scaling"], float)[:, None]
    return spherical((own[list(names)].to_numpy(float) - np.asarray(first["centre"], float)) @ axes.T)


def fit_shells(points: DataFrame, keys: Sequence[str] = (), axes: Sequence[str] = ("x", "y", "z"), degree: int = 3, rounds: int = 2, tolerance: float = 0.3, scaled: bool = True) -> DataFrame:
    """The shell of each key's points: the radius by direction, in a frame stretched to round.

    Least squares over all points, then `rounds` times over those whose radius was missed by less than `tolerance` of it, which halves
    each round. A round is one pass over the points, which are never gathered: tasks add up Gram matrices. Points with a null or NaN
    coordinate don't count; a key of fewer points than modes gets the least coefficients that fit.
    """
    points, by = _keyed(points, keys)
    points = points.select(*by, *(F.col(c).cast("double").alias(c) for c in axes))
    for c in axes:
        points = points.where(F.col(c).isNotNull() & ~F.isnan(c))
    held = kept(frames(points, by, axes, scaled), "frames")
    width = len(modes(degree))

    def fit(shells: DataFrame, limit: float | None) -> DataFrame:
        def design(own: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            azimuth, zenith, r = _shell_place(own, axes)
            a = harmonics(azimuth, zenith, degree)
            if limit is None:
                return a, r, np.ones(len(r))
            return a, r, (np.abs(r - a @ np.asarray(own["coefficients"].iloc[0], float)) < limit * r).astype(float)

        joined = points.join(shells, by)
        return kept(solved(normal_sums(joined, by, width, design), by, width), "coefficients")

    found = fit(held, None)
    for i in range(rounds):
        found = fit(held.join(found.select(*by, "coefficients"), by), tolerance / 2**i)
    out = held.join(found, by).withColumn("degree", F.lit(degree))
    return out.drop(ALL)


def _mapped(points: DataFrame, shells: DataFrame, keys: Sequence[str], out: dict[str, str], f: Callable[[pd.DataFrame], dict[str, np.ndarray]]) -> DataFrame:
    """points with columns that follow from each key's points and shell; points of keys without a shell are left out."""
    held, by = _keyed(points, keys)
    parts, _ = _keyed(shells, keys)
    own = ["centre", "axes", "scaling", "degree", "coefficients"]
    joined, columns = held.join(parts.select(*by, *own), by).select(*held.columns, *own), held.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, rows in batch.groupby(by, dropna=False, sort=False):
                yield rows.assign(**f(rows)).drop(columns=own)[[*columns, *out]]

    kinds = dict(held.dtypes)
    found = joined.mapInPandas(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in held.columns), *(f"{n} {k}" for n, k in out.items())]))
    return found.drop(ALL)


def _surface(own: pd.Series, step: float) -> np.ndarray:
    """Places of a shell's surface on a grid of directions."""
    zenith, azimuth = (v.ravel() for v in np.mgrid[0 : pi + step : step, 0 : 2 * pi + step : step])
    return _unscaled(own, azimuth, zenith, harmonics(azimuth, zenith, int(own["degree"])) @ np.asarray(own["coefficients"], float))


def _unscaled(own: pd.Series, azimuth: np.ndarray, zenith: np.ndarray, r: np.ndarray) -> np.ndarray:
    axes = np.asarray(own["axes"], float).reshape(3, 3) / np.asarray(own["scaling"], float)[:, None]
    return cartesian(azimuth, zenith, r) @ axes + np.asarray(own["centre"], float)


def shell_coordinates(points: DataFrame, shells: DataFrame, keys: Sequence[str] = (), axes: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """points with scaled_azimuth, scaled_zenith, scaled_radius, shell_radius (in the same direction), normalized_radius, inside_shell, and
    radial_distance: that to the surface along the line from the centre, negative inside."""

    def told(own: pd.DataFrame) -> dict[str, np.ndarray]:
        azimuth, zenith, r = _shell_place(own, axes)
        first = own.iloc[0]
        surface = harmonics(azimuth, zenith, int(first["degree"])) @ np.asarray(first["coefficients"], float)
        away = np.sqrt(((_unscaled(first, azimuth, zenith, surface) - own[list(axes)].to_numpy(float)) ** 2).sum(axis=1))
        return {"scaled_azimuth": azimuth, "scaled_zenith": zenith, "scaled_radius": r, "shell_radius": surface, "normalized_radius": r / surface, "inside_shell": r < surface, "radial_distance": np.where(r < surface, -away, away)}

    number = dict.fromkeys(("scaled_azimuth", "scaled_zenith", "scaled_radius", "shell_radius", "normalized_radius"), "double")
    return _mapped(points, shells, keys, number | {"inside_shell": "boolean", "radial_distance": "double"}, told)


def distance_to_shell(points: DataFrame, shells: DataFrame, keys: Sequence[str] = (), axes: Sequence[str] = ("x", "y", "z"), step: float = 0.1) -> DataFrame:
    """points with distance_to_shell: to the nearest of the surface's places on a grid of directions `step` apart."""

    def told(own: pd.DataFrame) -> dict[str, np.ndarray]:
        surface = _surface(own.iloc[0], step)
        places, square = own[list(axes)].to_numpy(float), (surface * surface).sum(axis=1)
        away = np.empty(len(places))
        for i in range(0, len(places), 512):
            part = places[i : i + 512]
            near = (square - 2 * part @ surface.T).argmin(axis=1)
            away[i : i + 512] = np.sqrt(((part - surface[near]) ** 2).sum(axis=1))
        return {"distance_to_shell": away}

    return _mapped(points, shells, keys, {"distance_to_shell": "double"}, told)


def radius_density(shells: DataFrame, keys: Sequence[str] = (), spacing: float = 75.0, bin_width: float = 0.05, step: float = 0.1) -> DataFrame:
    """keys, bin, bin_center, counts (share of the shell's inside), volume: normalised radii of a grid of points that fill each shell.

    The grid covers the surface's bounds and is dealt as rows, one slab of one shell each, so a large shell is filled by many tasks.
    """
    held, by = _keyed(shells, keys)
    kinds = dict(held.dtypes)

    def slabs(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for _, own in part.iterrows():
                surface = _surface(own, step)
                low, high = surface.min(axis=0), surface.max(axis=0)
                z = np.arange(low[2], high[2] + spacing, spacing)
                yield pd.DataFrame([own] * len(z)).assign(_z=z, _low=[low[:2]] * len(z), _high=[high[:2]] * len(z))

    own = ["centre", "axes", "scaling", "degree", "coefficients"]
    slim = held.select(*by, *own)
    told = ", ".join(f"`{c}` {kinds[c]}" for c in slim.columns)
    dealt = slim.mapInPandas(slabs, f"{told}, _z double, _low array<double>, _high array<double>").repartition(F.rand(0))
    bins = int(round(1 / bin_width))

    def fill(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for _, row in part.iterrows():
                x, y = (v.ravel() for v in np.meshgrid(*(np.arange(a, b + spacing, spacing) for a, b in zip(row["_low"], row["_high"], strict=True)), indexing="ij"))
                axes = np.asarray(row["axes"], float).reshape(3, 3) * np.asarray(row["scaling"], float)[:, None]
                azimuth, zenith, r = spherical((np.stack([x, y, np.full(len(x), row["_z"])], axis=1) - np.asarray(row["centre"], float)) @ axes.T)
                share = r / (harmonics(azimuth, zenith, int(row["degree"])) @ np.asarray(row["coefficients"], float))
                count = np.bincount(np.minimum((share[(share >= 0) & (share < 1)] / bin_width).astype(int), bins - 1), minlength=bins)
                out.append(pd.DataFrame({"bin": np.arange(bins), "n": count}).assign(**{k: row[k] for k in by})[[*by, "bin", "n"]])
            if out:
                yield pd.concat(out)

    counts = dealt.mapInPandas(fill, ", ".join([*(f"`{k}` {kinds[k]}" for k in by), "bin int", "n long"])).groupBy(*by, "bin").agg(F.sum("n").alias("n"))
    whole = counts.groupBy(*by).agg(F.sum("n").alias("_all_n"))
    found = counts.join(whole, by).select(*by, "bin", ((F.col("bin") + 0.5) * bin_width).alias("bin_center"), F.try_divide(F.col("n"), F.col("_all_n")).alias("counts"), (F.col("_all_n") * spacing**3).alias("volume"))
    return found.drop(ALL)
