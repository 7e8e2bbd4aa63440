"""Quadratic surface patches around points, from moments of their neighbourhoods that Spark adds up."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import product
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from photonflow.operators.tiles import Tile, distances, fine, gathered, lists, meetings, tiles
from photonflow.sources.shared import kept

#: Terms of a patch over its plane, by powers of u and v.
TERMS = ((0, 0), (1, 0), (0, 1), (2, 0), (1, 1), (0, 2))
#: Powers of x, y and z up to the fourth degree.
POWERS = [p for p in product(range(5), repeat=3) if sum(p) <= 4]


def _shifted(sums: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Sums of the POWERS of neighbours' coordinates (n, 35), told about the points x (n, 3) instead of the origin."""
    power = [np.ones_like(x)]
    for _ in range(4):
        power.append(power[-1] * -x)
    out = np.zeros_like(sums)
    for k, alpha in enumerate(POWERS):
        for beta in product(*(range(a + 1) for a in alpha)):
            factor = float(np.prod([comb(a, b) for a, b in zip(alpha, beta, strict=True)]))
            rest = [power[a - b][:, i] for i, (a, b) in enumerate(zip(alpha, beta, strict=True))]
            out[:, k] += factor * sums[:, POWERS.index(beta)] * rest[0] * rest[1] * rest[2]
    return out


def _moments(points: DataFrame, radius: float) -> DataFrame:
    """_row, m: of the points (_row, x, y, z), sums of the POWERS of the displacements (over the radius) to all points closer than it, itself included.

    A pair of tiles is a product of matrices: which points are near, times the powers of the second tile's coordinates about the first's middle.
    """
    cell = fine(radius)
    held = tiles(points, "_row", ("x", "y", "z"), cell)

    def start(a: Tile) -> tuple[np.ndarray, np.ndarray]:
        return a.at.mean(axis=1), np.zeros((len(a.ids), len(POWERS)))

    def add(state: tuple[np.ndarray, np.ndarray], a: Tile, b: Tile) -> None:
        middle, sums = state
        up = [np.stack([v**k for k in range(5)]) for v in (b.at - middle[:, None]) / radius]
        powers = np.stack([up[0][i] * up[1][j] * up[2][k] for i, j, k in POWERS], axis=1)
        for part, d in distances(a, b, 3):
            sums[part] += (d < radius).astype(float) @ powers

    def finish(a: Tile, state: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
        middle, sums = state
        return pa.record_batch([pa.array(a.ids), lists(_shifted(sums, (a.at - middle[:, None]).T / radius))], names=["_row", "m"])

    kind = dict(points.dtypes)["_row"]
    found = meetings(held, held, radius, cell).mapInArrow(gathered(radius, 3, start, add, finish), f"_row {kind}, m array<double>")
    return found.groupBy("_row").agg(F.array(*(F.sum(F.col("m")[k]) for k in range(len(POWERS)))).alias("m"))


def _turned(m: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Frames (n, 9: two directions in the plane and the normal, by rows) by the spread of neighbourhoods, and the tensors of orders 0 to 4 of
    their moments along them."""
    tensors = [np.stack([m[:, POWERS.index(tuple(at.count(k) for k in range(3)))] for at in product(range(3), repeat=order)], axis=1).reshape(-1, *(3,) * order) for order in range(5)]
    n = tensors[0]
    half = tensors[2] / n[:, None, None] - tensors[1][:, :, None] * tensors[1][:, None, :] / (n * n)[:, None, None]
    axes = np.linalg.eigh(half)[1].transpose(0, 2, 1)[:, ::-1]  # the least spread last
    axes[:, 2] = np.cross(axes[:, 0], axes[:, 1])
    for order in range(1, 5):
        for _ in range(order):  # the first index is turned and goes last
            tensors[order] = np.einsum("nui,ni...->n...u", axes, tensors[order])
    return axes.reshape(-1, 9), tensors


def _fitted(gram: np.ndarray, right: np.ndarray, square: np.ndarray, n: np.ndarray, frame: np.ndarray, through: bool) -> dict[str, np.ndarray]:
    """Patches from their normal equations, all at once: curvatures and normals at the point."""
    if through:
        gram, right = gram.copy(), right.copy()
        gram[:, 0], gram[:, :, 0], right[:, 0] = 0, 0, 0
        gram[:, 0, 0] = 1
    scale = np.sqrt(np.maximum(np.einsum("nii->ni", gram), 1e-300))
    c = (np.linalg.pinv(gram / scale[:, :, None] / scale[:, None, :], rcond=1e-10, hermitian=True) @ (right / scale)[:, :, None])[:, :, 0] / scale
    left = np.sqrt(np.maximum(square - 2 * (c * right).sum(axis=1) + np.einsum("ni,nij,nj->n", c, gram, c), 0) / n)
    bu, bv, uu, uv, vv = c[:, 1], c[:, 2], 2 * c[:, 3], c[:, 4], 2 * c[:, 5]
    tilt = 1 + bu * bu + bv * bv
    gauss = (uu * vv - uv * uv) / tilt**2
    mean = ((1 + bv * bv) * uu - 2 * bu * bv * uv + (1 + bu * bu) * vv) / (2 * tilt**1.5)
    root = np.sqrt(np.maximum(mean * mean - gauss, 0))
    normal = np.einsum("ni,nij->nj", np.stack([-bu, -bv, np.ones_like(bu)], axis=1), frame.reshape(-1, 3, 3)) / np.sqrt(tilt)[:, None]
    return {"curvature1": mean + root, "curvature2": mean - root, "offset": c[:, 0] * (not through), "residual": left, **{f"n{a}": normal[:, k] for k, a in enumerate("xyz")}}


def fit_patches(points: DataFrame, radius: float, row_id: str, axes: Sequence[str] = ("x", "y", "z"), through: bool = True, least: int = 8) -> DataFrame:
    """row_id, place, n, nx, ny, nz (normal), curvature1 >= curvature2 (against the normal's side), offset, residual (root mean square) of a patch around each point.

    The patch is a quadratic height over the plane of least spread of all points closer than the radius, fitted to them by least squares;
    `through` makes it pass through the point itself (offset 0). Points of fewer than `least` neighbours (themselves included) have no
    patch. A normal's side is arbitrary. Neighbours meet in tiles, and only sums of their powers are shuffled: each task adds up 35 a point, whatever
    its number of neighbours; they are turned into the patch's frame after.
    """
    near = points.select(F.col(row_id).alias("_row"), *(F.col(c).cast("double").alias(a) for c, a in zip(axes, "xyz", strict=True))).dropna()
    near = kept(near, "points")
    joined = _moments(near, radius).where(F.col("m")[0] >= least).join(near, "_row")
    along = lambda p, q, r=0: (*(0,) * p, *(1,) * q, *(2,) * r)
    out = ["nx", "ny", "nz", "curvature1", "curvature2", "offset", "residual"]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            if not len(part):
                continue
            m = np.array(part["m"].tolist(), float)
            frame, turned = _turned(m)
            of = lambda p, q, r=0: turned[p + q + r][(slice(None), *along(p, q, r))]  # noqa: B023, E731
            gram = np.stack([np.stack([of(a + c, b + d) for c, d in TERMS], axis=1) for a, b in TERMS], axis=1)
            right = np.stack([of(a, b, 1) for a, b in TERMS], axis=1)
            found = _fitted(gram, right, of(0, 0, 2), m[:, 0], frame, through)
            found |= {"curvature1": found["curvature1"] / radius, "curvature2": found["curvature2"] / radius, "offset": found["offset"] * radius, "residual": found["residual"] * radius}
            yield part[["_row", "x", "y", "z"]].assign(n=np.rint(m[:, 0]).astype(np.int64), **found)[["_row", "x", "y", "z", "n", *out]]

    kinds = dict(joined.dtypes)
    found = joined.mapInPandas(run, f"_row {kinds['_row']}, x double, y double, z double, n long, {', '.join(f'{o} double' for o in out)}")
    return found.withColumnRenamed("_row", row_id)


def aligned_patches(patches: DataFrame, radius: float, row_id: str, threshold: float = 0.85) -> DataFrame:
    """Patches whose normal agrees with those of the patches closer than the radius: the median of the cosines (without sign, itself included) reaches the threshold."""
    patches = kept(patches, "patches")
    cell = fine(radius)
    held = tiles(patches, row_id, ("x", "y", "z"), cell, values=("nx", "ny", "nz"))

    def add(state: np.ndarray, a: Tile, b: Tile) -> None:
        n, agree, low, high = state
        for part, d in distances(a, b, 3):
            near = d < radius
            cosine = np.abs(a.at[3, part, None] * b.at[3] + a.at[4, part, None] * b.at[4] + a.at[5, part, None] * b.at[5])
            good = near & (cosine >= threshold)
            n[part] += near.sum(axis=1)
            agree[part] += good.sum(axis=1)
            high[part] = np.minimum(high[part], np.where(good, cosine, np.inf).min(axis=1))
            low[part] = np.maximum(low[part], np.where(near & ~good, cosine, -np.inf).max(axis=1))

    def finish(a: Tile, state: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch([pa.array(a.ids), *map(pa.array, state)], names=[row_id, *names])

    names = ["_n", "_agree", "_low", "_high"]
    start = lambda a: np.concatenate([np.zeros((2, len(a.ids))), np.full((1, len(a.ids)), -np.inf), np.full((1, len(a.ids)), np.inf)])
    told = meetings(held, held, radius, cell).mapInArrow(gathered(radius, 3, start, add, finish), f"`{row_id}` {dict(patches.dtypes)[row_id]}, {', '.join(f'{n} double' for n in names)}")
    told = told.groupBy(row_id).agg(F.sum("_n").alias("_n"), F.sum("_agree").alias("_agree"), F.max("_low").alias("_low"), F.min("_high").alias("_high"))
    # more than half reach the threshold; or just half, and the median is the mean of the values on both sides of it
    good = told.where((2 * F.col("_agree") > F.col("_n")) | ((2 * F.col("_agree") == F.col("_n")) & ((F.col("_low") + F.col("_high")) / 2 >= threshold)))
    return patches.join(good.select(row_id), row_id, "left_semi")


def reconstructed(patches: DataFrame, radius: float, spacing: float, row_id: str) -> DataFrame:
    """row_id, x, y, z, nx, ny, nz: points of each patch on a grid in its plane, within the radius of its point, along its principal directions as a paraboloid.

    Directions in the plane are taken so that they turn with the normal; the patch's larger curvature goes along the first.
    """
    steps = np.arange(-radius, radius + spacing / 2, spacing)
    u, v = (g.ravel() for g in np.meshgrid(steps, steps, indexing="ij"))
    inside = u * u + v * v <= radius * radius
    u, v = u[inside], v[inside]
    kinds = dict(patches.dtypes)
    names = [row_id, "x", "y", "z", "nx", "ny", "nz"]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            normal = part[["nx", "ny", "nz"]].to_numpy(float)
            least = np.eye(3)[np.abs(normal).argmin(axis=1)]
            first = np.cross(normal, least)
            first /= np.linalg.norm(first, axis=1)[:, None]
            second = np.cross(normal, first)
            k1, k2, off = (part[c].to_numpy(float)[:, None] for c in ("curvature1", "curvature2", "offset"))
            w = off + (k1 * u * u + k2 * v * v) / 2
            at = part[["x", "y", "z"]].to_numpy(float)[:, None] + u[None, :, None] * first[:, None] + v[None, :, None] * second[:, None] + w[..., None] * normal[:, None]
            slope = normal[:, None] - (k1 * u)[..., None] * first[:, None] - (k2 * v)[..., None] * second[:, None]
            slope /= np.linalg.norm(slope, axis=2, keepdims=True)
            flat = np.concatenate([at, slope], axis=2).reshape(-1, 6)
            yield pd.DataFrame(flat, columns=names[1:]).assign(**{row_id: np.repeat(part[row_id].to_numpy(), len(u))})[names]

    return patches.mapInPandas(run, f"`{row_id}` {kinds[row_id]}, {', '.join(f'{n} double' for n in names[1:])}")
