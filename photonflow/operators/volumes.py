"""Volumes as frames (keys, z, height, width, pixels) of one size a volume: nearest mask voxels, signed distances, and what follows from them.

A volume is never gathered. Slices are searched by themselves, then cut into stripes of pixels; tiles of a stripe, some slices deep, are searched
along z, each with the slices of other tiles that may hold something nearer.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from photonflow.sources.shared import kept

#: Pixels of a slice that are searched along z together.
STRIPE = 4096
#: Voxels of a stripe that are searched along z together, about.
VOXELS = 1 << 18
NONE = np.int32(-1)


def nearest_along(cost: np.ndarray, places: np.ndarray, to: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For each row of cost (rows, n) and each place of `to`, ascending like the n places and these where it is None: the least of cost + squared distance to a place, and where it is.

    The lower envelope of parabolas is built for all rows side by side. Of equally near places any one is told, the same each time; where a row
    has no finite cost, the least is infinite and the place -1.
    """
    rows, n = cost.shape
    places = np.asarray(places, float)
    to = places if to is None else np.asarray(to, float)
    hull, start = np.zeros((rows, n), np.int32), np.full((rows, n + 1), np.inf)
    top = np.full(rows, -1)
    lifted = cost + places * places
    for q in range(n):
        live = np.flatnonzero(np.isfinite(cost[:, q]))
        open_, cross = live, np.full(rows, -np.inf)
        while len(open_):
            open_ = open_[top[open_] >= 0]
            last = hull[open_, top[open_]]
            cross[open_] = (lifted[open_, q] - lifted[open_, last]) / (2 * (places[q] - places[last]))
            open_ = open_[cross[open_] <= start[open_, top[open_]]]
            top[open_] -= 1
        cross[live[top[live] < 0]] = -np.inf
        top[live] += 1
        hull[live, top[live]] = q
        start[live, top[live]] = cross[live]
        start[live, top[live] + 1] = np.inf
    at, best, where = np.zeros(rows, np.int64), np.full((rows, len(to)), np.inf), np.full((rows, len(to)), NONE)
    some = np.flatnonzero(top >= 0)
    for p in range(len(to)):
        while len(on := some[start[some, at[some] + 1] < to[p]]):
            at[on] += 1
        q = hull[some, at[some]]
        best[some, p], where[some, p] = cost[some, q] + (to[p] - places[q]) ** 2, q
    return best, where


def nearest_in_slice(mask: np.ndarray, voxel_y: float, voxel_x: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Squared distance of each pixel of masks (..., height, width) to the nearest one of its mask, and that one's row and column; infinite and -1 where the mask is empty."""
    h, w = mask.shape[-2:]
    rows = np.arange(h)[:, None]
    above = np.maximum.accumulate(np.where(mask, rows, -(1 << 30)), axis=-2)
    below = np.flip(np.minimum.accumulate(np.flip(np.where(mask, rows, 1 << 30), -2), axis=-2), -2)
    near = np.where(rows - above <= below - rows, above, below)
    cost = np.where(mask.any(axis=-2, keepdims=True), ((rows - near) * voxel_y) ** 2, np.inf)
    best, column = (v.reshape(mask.shape) for v in nearest_along(cost.reshape(-1, w), np.arange(w) * voxel_x))
    row = np.where(column >= 0, np.take_along_axis(near, np.maximum(column, 0), axis=-1), NONE)
    return best, row.astype(np.int32), column


def _cross(mask: np.ndarray) -> np.ndarray:
    """Masks (..., height, width) and the pixels beside them."""
    out = mask.copy()
    out[..., 1:, :] |= mask[..., :-1, :]
    out[..., :-1, :] |= mask[..., 1:, :]
    out[..., 1:] |= mask[..., :-1]
    out[..., :-1] |= mask[..., 1:]
    return out


def _kinds(df: DataFrame, names: Sequence[str]) -> str:
    kinds = dict(df.dtypes)
    return "".join(f"`{n}` {kinds[n]}, " for n in names)


def _sources(first: np.ndarray, last: np.ndarray, ends: np.ndarray, near: np.ndarray, bare: np.ndarray, vz: float) -> list[tuple[int, int, float, float]]:
    """(tile, other tile, lowest z, highest z): slices of other tiles of a stripe that may hold something nearer than what is known, for one side.

    A row for each tile, by z. first, last: its first and last slice with something to be found (nan: none), ends: the most that any pixel is from it
    there, squared. near: the z between which slices matter to slices that have something themselves, bare: the first and last slice that
    have nothing but look for it. What is nearest to such a slice is no further than the known ends of the tiles about it.
    """
    some = np.flatnonzero(~np.isnan(first))
    first, last, ends = first[some], last[some], ends[some]
    out = []

    def known(z: float) -> float:
        k = np.searchsorted(first, z)
        at = [(p[i], ends[i, e]) for i in (k - 1, k) if 0 <= i < len(some) for e, p in enumerate((first, last))]
        return np.sqrt(min(a + ((z - p) * vz) ** 2 for p, a in at)) / vz * (1 + 1e-9)

    for tile in range(len(near)) if len(some) else ():
        low, high = (np.inf, -np.inf) if np.isnan(near[tile, 0]) else near[tile]
        if not np.isnan(bare[tile, 0]):
            low, high = min(low, bare[tile, 0] - known(bare[tile, 0])), max(high, bare[tile, 1] + known(bare[tile, 1]))
        out += [(tile, int(i), low, high) for i in some[np.searchsorted(last, low) : np.searchsorted(first, high, "right")] if i != tile]
    return out


def feature_transform(mask: DataFrame, keys: Sequence[str] = (), voxel: Sequence[float] = (1.0, 1.0, 1.0), grow: bool = True) -> DataFrame:
    """keys, z, height, width, stripe (first pixel), and of a stripe's pixels: distance, near_x, near_y, near_z.

    mask: frames whose pixels above 0.5 are inside. distance is signed: of voxels inside, less the distance to the nearest voxel outside; of
    others, the distance to the nearest voxel inside, or of the mask grown by one voxel if `grow`, so that what touches the mask is at
    0. near_* is the voxel that was found. voxel: sizes along x, y and z; z are whole numbers, and slices may be missing. Where there is no voxel
    to be found the distance is infinite and near_* is -1. Volumes of no pixels give no rows, frames with null pixels are left out.

    A slice is one row, so it must fit in a task; a volume need not. Slices are numbered by ranges of z, so that a tile is some VOXELS of
    a stripe, however many slices a volume has. What a tile knows of its own slices tells how far along z something nearer may be, and the
    slices up to there are sent to it, which are few unless a slice's pixels are further from its mask than a tile is deep; they are read
    block by block. Of a tile's costs only their bounds meet with those of the volume's other tiles.
    """
    vx, vy, vz = map(float, voxel)
    parts = int(mask.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = mask.where(F.col("pixels").isNotNull()).select(*keys, F.col("z").cast("long").alias("z"), "height", "width", F.transform("pixels", lambda p: p > 0.5).alias("pixels"))
    own = [*keys, "z", "height", "width"]

    def pack(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield part[own].assign(bits=[np.packbits(np.asarray(p, bool)).tobytes() for p in part["pixels"]])

    bits = held.mapInPandas(pack, f"{_kinds(held, own)}bits binary")
    beside = ["_before", "_after"] if grow else []
    for name, step in zip(beside, (1, -1), strict=False):  # a slice's neighbours, packed
        near = bits.select(*(F.col(k).alias(f"_{k}_") for k in keys), (F.col("z") + step).alias("_z_"), F.col("bits").alias(name))
        same = [F.col("z") == F.col("_z_"), *(F.col(k).eqNullSafe(F.col(f"_{k}_")) for k in keys)]
        bits = bits.join(near, same, "left").drop("_z_", *(f"_{k}_" for k in keys))
    # packed slices are small beside the work that they mean, so they are dealt by number and not by size
    bits = bits.repartitionByRange(parts, *keys, "z").sortWithinPartitions(*keys, "z")
    sides = ("in", "out")
    packed = [f"{n}_{s}" for s in sides for n in ("cost", "y", "x")]

    def slices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tile, filled = TaskContext.get().partitionId() << 40, 0
        for batch in batches:
            h, w = batch["height"].to_numpy(), batch["width"].to_numpy()
            a = 0
            while a < len(batch):
                area = int(h[a] * w[a])
                other = np.flatnonzero((h[a:] != h[a]) | (w[a:] != w[a]))
                b = a + min(other[0] if len(other) else len(batch) - a, max(1, VOXELS // max(1, area)))
                part, a = batch.iloc[a:b], b
                if not area:
                    continue
                size = (len(part), int(h[b - 1]), int(w[b - 1]))
                read = lambda c: np.unpackbits(np.frombuffer(b"".join(v or bytes((area + 7) // 8) for v in part[c]), np.uint8).reshape(len(part), -1), axis=1, count=area).astype(bool).reshape(size)  # noqa: B023, E731
                inside = read("bits")
                grown = np.logical_or.reduce([_cross(inside), *map(read, beside)]) if grow else inside
                found = [v.reshape(len(part), area) for target in (~inside, grown) for v in nearest_in_slice(target, vy, vx)]
                inside = inside.reshape(len(part), area)
                tiles = []
                for _ in range(len(part)):
                    tile, filled = (tile + 1, 0) if filled >= VOXELS else (tile, filled)
                    tiles.append(tile)
                    filled += min(area, STRIPE)
                first = np.arange(0, area, STRIPE)
                cut = {n: [r[c : c + STRIPE].tobytes() for r in v for c in first] for n, v in zip(packed, found, strict=True)}
                cut["inside"] = [np.packbits(r[c : c + STRIPE]).tobytes() for r in inside for c in first]
                for side, cost, looks in zip(sides, found[::3], (inside, ~inside), strict=True):
                    cut[f"most_{side}"] = [r[c : c + STRIPE].max() for r in cost for c in first]
                    cut[f"need_{side}"] = [r[c : c + STRIPE].max() for r in np.where(looks, cost, -1.0) for c in first]
                yield part[own].iloc[np.repeat(np.arange(len(part)), len(first))].assign(_tile=np.repeat(tiles, len(first)), stripe=np.tile(first, len(part)), **cut)

    bounds = [f"{n}_{s}" for s in sides for n in ("most", "need")]
    kinds = f"{_kinds(bits, own)}_tile long, stripe long, {', '.join(f'{n} binary' for n in (*packed, 'inside'))}, {', '.join(f'{n} double' for n in bounds)}"
    stripes = kept(bits.mapInPandas(slices, kinds), "stripes")

    told = [F.min("z").alias("z")]
    for s in sides:
        has, looks, away = F.col(f"most_{s}") < float("inf"), F.col(f"need_{s}") >= 0, F.sqrt(f"need_{s}") / vz * (1 + 1e-9)
        there, bare = F.when(has, F.col("z")), F.when(looks & ~has, F.col("z"))
        ends = [F.min_by(f"most_{s}", there), F.max_by(f"most_{s}", there)]
        each = [F.min(there), F.max(there), *ends, F.min(F.when(has & looks, F.col("z") - away)), F.max(F.when(has & looks, F.col("z") + away)), F.min(bare), F.max(bare)]
        told += [v.cast("double").alias(f"{s}{i}") for i, v in enumerate(each)]
    several = stripes.groupBy(*keys, "stripe", "_tile").agg(*told).withColumn("_n", F.count("*").over(Window.partitionBy(*keys, "stripe"))).where("_n > 1")

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("z").reset_index(drop=True)
        found: dict[tuple[int, int], tuple[float, float]] = {}
        for s in sides:
            v = group[[f"{s}{i}" for i in range(8)]].to_numpy(float)
            for i, k, low, high in _sources(v[:, 0], v[:, 1], v[:, 2:4], v[:, 4:6], v[:, 6:8], vz):
                a, b = found.get((i, k), (low, high))
                found[i, k] = min(a, low), max(b, high)
        to, of = (np.array([p[e] for p in found], np.int64) for e in (0, 1))
        tile = group["_tile"].to_numpy()
        return group[[*keys, "stripe"]].iloc[to].assign(_to=tile[to], _tile=tile[of], _low=[v[0] for v in found.values()], _high=[v[1] for v in found.values()])

    pairs = several.groupBy(*keys, "stripe").applyInPandas(meet, f"{_kinds(several, keys)}stripe long, _to long, _tile long, _low double, _high double")
    pairs = pairs.select(*(F.col(n).alias(f"_{n}_") for n in (*keys, "stripe", "_tile")), "_to", "_low", "_high")
    same = [F.col(n) == F.col(f"_{n}_") for n in ("stripe", "_tile")] + [F.col(k).eqNullSafe(F.col(f"_{k}_")) for k in keys]
    use = [*own, "stripe", "_to", "_mine", *packed, "inside"]
    others = stripes.join(pairs, [*same, F.col("z").between(F.col("_low"), F.col("_high"))]).withColumn("_mine", F.lit(False)).select(use)
    met = stripes.withColumns({"_to": F.col("_tile"), "_mine": F.lit(True)}).select(use).unionAll(others)
    met = met.repartition(parts, *keys, "stripe", "_to").sortWithinPartitions(*keys, "stripe", "_to", F.desc("_mine"), "z")  # a tile's own slices come first

    class Nearest:
        """What is known of a tile's voxels."""

        def __init__(self, rows: pd.DataFrame, count: int):
            self.rows, self.z = rows, rows["z"].to_numpy()
            self.inside = np.stack([np.unpackbits(np.frombuffer(v, np.uint8), count=count).astype(bool) for v in rows["inside"]])
            self.best = np.full(self.inside.shape, np.inf)
            self.near = [np.full(self.inside.shape, NONE, kind) for kind in (np.int32, np.int32, np.int64)]

        def take(self, block: pd.DataFrame) -> None:
            for side, looks in zip(sides, (self.inside, ~self.inside), strict=True):
                cost = np.stack([np.frombuffer(v, np.float64) for v in block[f"cost_{side}"]])
                some = np.flatnonzero(np.isfinite(cost[:, 0]))  # a slice has something for all of its pixels or for none
                if not len(some) or not looks.any():
                    continue
                z = block["z"].to_numpy()[some]
                best, where = (v.T for v in nearest_along(np.ascontiguousarray(cost[some].T), z * vz, self.z * vz))
                better = looks & ((best < self.best) | (best == self.best) & (z[where] < self.near[2]))
                self.best[better] = best[better]
                row, pixel = where[better], np.nonzero(better)[1]
                for at, n in zip(self.near, ("x", "y"), strict=False):
                    at[better] = np.stack([np.frombuffer(v, np.int32) for v in block[f"{n}_{side}"].iloc[some]])[row, pixel]
                self.near[2][better] = z[row]

        def told(self) -> pd.DataFrame:
            away = np.sqrt(self.best)
            away = np.where(self.inside, -away, away)
            return self.rows[[*own, "stripe"]].assign(distance=list(away), **{f"near_{c}": list(v) for c, v in zip("xyz", self.near, strict=True)})

    def along(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, held = None, None

        def taken(block: pd.DataFrame) -> None:
            nonlocal known
            if known is None:
                known = Nearest(block[block["_mine"]], len(block["cost_in"].iloc[0]) // 8)
            elif block["_mine"].any():
                raise RuntimeError("a tile's own slices did not come first")
            known.take(block.sort_values("z"))

        for batch in batches:
            held = batch if held is None else pd.concat([held, batch], ignore_index=True)
            most = max(1, 2 * VOXELS // (len(held["cost_in"].iloc[0]) // 8)) if len(held) else 1  # holds a tile at least
            while len(held) > most:
                taken(held.iloc[:most])
                held = held.iloc[most:]
        if len(held):
            taken(held)
        yield known.told()

    return met.groupBy(*keys, "stripe", "_to").applyInPandas(along, f"{_kinds(met, [*own, 'stripe'])}distance array<double>, near_x array<int>, near_y array<int>, near_z array<long>")


def _values(stripes: DataFrame, image: DataFrame, keys: Sequence[str], roi: DataFrame | None) -> DataFrame:
    """keys, d, v: of each voxel its distance and the image's value; of those in the roi (pixels above 0.5) alone, where one is given."""
    pixels = image.select(*keys, F.col("z").cast("long").alias("z"), F.col("pixels").alias("_v"))
    held = stripes.join(pixels, [*keys, "z"])
    part = lambda c: F.slice(c, (F.col("stripe") + 1).cast("int"), F.size("distance"))
    columns = [F.col("distance").alias("d"), part("_v").alias("v")]
    if roi is not None:
        held = held.join(roi.select(*keys, F.col("z").cast("long").alias("z"), F.col("pixels").alias("_r")), [*keys, "z"])
        columns.append(part("_r").alias("r"))
    each = held.select(*keys, F.explode(F.arrays_zip(*columns)).alias("p"))
    if roi is not None:
        each = each.where("p.r > 0.5")
    return each.select(*keys, F.col("p.d").alias("d"), F.col("p.v").cast("double").alias("v"))


def _bin(d: Column, low: float, size: float, bins: int) -> Column:
    """Number of the half-open bin from `low` on, or null beyond both ends."""
    k = F.floor((d - low) / size)
    return F.when(~F.isnan(d) & (F.abs(d) < float("inf")) & (k >= 0) & (k < bins), k.cast("int"))


def _all_bins(found: DataFrame, keys: Sequence[str], bins: int, low: float, size: float) -> DataFrame:
    """A row for each bin of each key, with 0 where found has none; bin_left is its lower end."""
    every = found.select(*keys).distinct() if keys else found.sparkSession.range(1).select()
    every = every.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return every.join(found, [*keys, "bin"], "left").fillna(0).withColumn("bin_left", low + F.col("bin") * size)


def image_density_at_distance(image: DataFrame, stripes: DataFrame, keys: Sequence[str], low: float, size: float, bins: int, roi: DataFrame | None = None) -> DataFrame:
    """keys, bin, bin_left, n, mean: voxels at each distance from a mask (stripes of feature_transform()) and their mean value in the image; 0 for empty bins."""
    each = _values(stripes, image, keys, roi).withColumn("bin", _bin(F.col("d"), low, size, bins)).where("bin is not null")
    return _all_bins(each.groupBy(*keys, "bin").agg(F.count("*").alias("n"), F.avg("v").alias("mean")), keys, bins, low, size)


def distance_colocalisation(image: DataFrame, stripes: DataFrame, keys: Sequence[str], low: float = -500.0, size: float = 100.0, high: float = 2000.0, roi: DataFrame | None = None) -> DataFrame:
    """keys, bins (upper ends), enrichment, enclosed, enclosed_area of an image against a mask.

    Bins run from `low` by `size` as long as they start below `high` less one bin. enrichment: a bin's mean over the mean of the means of
    bins of more than one voxel; enclosed and enclosed_area: shares of the signal and of the voxels up to the bin's end. Only the bins of one
    key meet in a window.
    """
    bins = max(1, int(np.ceil((high - low) / size - 1e-9)) - 1)
    found = image_density_at_distance(image, stripes, keys, low, size, bins, roi)
    whole, up = Window.partitionBy(*keys, F.lit(0)), Window.partitionBy(*keys, F.lit(0)).orderBy("bin")
    total = F.col("n") * F.col("mean")
    return found.select(
        *keys, (F.col("bin_left") + size).alias("bins"), F.try_divide(F.col("mean"), F.avg(F.when(F.col("n") > 1, F.col("mean"))).over(whole)).alias("enrichment"),
        F.try_divide(F.sum(total).over(up), F.sum(total).over(whole)).alias("enclosed"), F.try_divide(F.sum("n").over(up), F.sum("n").over(whole)).alias("enclosed_area"),
    )


def distance_at_points(points: DataFrame, stripes: DataFrame, keys: Sequence[str], voxel: Sequence[float], origin: Sequence[float] = (0.0, 0.0, 0.0), rounded: bool = False, axes: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """points with mask_distance, the signed distance of the voxel that each lies in, or is nearest to if `rounded`; null beyond the volume.

    Points meet their stripe alone, so a volume's pixels are read only where points are.
    """
    at = {f"_{c}": (F.col(c).cast("double") - o) / v for c, o, v in zip(axes, origin, voxel, strict=True)}
    at = {n: (F.rint(v) if rounded else F.floor(v)).cast("long") for n, v in at.items()}
    size = stripes.select(*keys, F.col("height").alias("_h"), F.col("width").alias("_w")).distinct()
    moved = points.withColumns(dict(zip(("_x", "_y", "_z"), at.values(), strict=True)))
    moved = moved.join(size, list(keys), "left") if keys else moved.crossJoin(F.broadcast(size))  # one row
    inside = (F.col("_x") >= 0) & (F.col("_y") >= 0) & (F.col("_x") < F.col("_w")) & (F.col("_y") < F.col("_h"))
    pixel = F.when(inside, F.col("_y") * F.col("_w") + F.col("_x"))
    moved = moved.withColumns({"_pixel": pixel, "_stripe": F.floor(pixel / STRIPE) * STRIPE})
    held = stripes.select(*keys, F.col("z").alias("_z"), F.col("stripe").alias("_stripe"), "distance")
    found = moved.join(held, [*keys, "_z", "_stripe"], "left")
    value = F.get("distance", (F.col("_pixel") - F.col("_stripe")).cast("int"))
    return found.withColumn("mask_distance", value).select(*points.columns, "mask_distance")


def point_density_at_distance(points: DataFrame, stripes: DataFrame, keys: Sequence[str], voxel: Sequence[float], low: float, size: float, bins: int, origin: Sequence[float] = (0.0, 0.0, 0.0)) -> DataFrame:
    """keys, bin, bin_left, n_events, n_voxels, density: points at each distance from a mask, and points a voxel (0 where there are none)."""
    events = distance_at_points(points, stripes, keys, voxel, origin, rounded=True).withColumn("bin", _bin(F.col("mask_distance"), low, size, bins)).where("bin is not null")
    events = events.groupBy(*keys, "bin").agg(F.count("*").alias("n_events"))
    voxels = stripes.select(*keys, F.explode("distance").alias("d")).withColumn("bin", _bin(F.col("d"), low, size, bins)).where("bin is not null")
    voxels = voxels.groupBy(*keys, "bin").agg(F.count("*").alias("n_voxels"))
    both = _all_bins(voxels, keys, bins, low, size).join(events, [*keys, "bin"], "left").fillna(0, ["n_events"])
    return both.withColumn("density", F.coalesce(F.try_divide(F.col("n_events"), F.col("n_voxels")), F.lit(0.0)))


def direction_to_mask(stripes: DataFrame, voxel: Sequence[float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """stripes with dir_x, dir_y, dir_z: unit vectors from each voxel to the one that feature_transform() found; 0 where it is the voxel itself or none."""
    vx, vy, vz = map(float, voxel)
    pixel = F.sequence(F.lit(0), F.size("distance") - 1)
    place = F.transform(pixel, lambda i: F.col("stripe") + i)
    steps = {
        "_dx": F.zip_with("near_x", place, lambda a, p: (a - p % F.col("width")) * vx),
        "_dy": F.zip_with("near_y", place, lambda a, p: (a - F.floor(p / F.col("width"))) * vy),
        "_dz": F.transform("near_z", lambda a: (a - F.col("z")) * vz),
    }
    found = stripes.withColumns(steps)
    length = F.transform(F.arrays_zip("_dx", "_dy", "_dz"), lambda p: F.sqrt(p["_dx"] * p["_dx"] + p["_dy"] * p["_dy"] + p["_dz"] * p["_dz"]))
    found = found.withColumn("_length", F.zip_with(length, F.col("near_x"), lambda r, a: F.when(a >= 0, r)))
    unit = {f"dir_{c}": F.zip_with(f"_d{c}", "_length", lambda d, r: F.coalesce(F.try_divide(d, r), F.lit(0.0))) for c in "xyz"}
    return found.withColumns(unit).drop("_dx", "_dy", "_dz", "_length")


def gradient3d(frames: DataFrame, keys: Sequence[str] = (), voxel: Sequence[float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """frames with grad_x, grad_y, grad_z: half the difference of the neighbours on both sides, at an edge that to the one neighbour, by voxel size.

    z are consecutive whole numbers; where a slice lacks a neighbour the other side counts as at an edge. Slices meet their two
    neighbours by z, so that a volume of any depth is done slice by slice.
    """
    vx, vy, vz = map(float, voxel)
    held = frames.where(F.col("pixels").isNotNull()).withColumns({"pixels": F.transform("pixels", lambda p: p.cast("double")), "z": F.col("z").cast("long")})
    near = lambda step, name: held.select(*keys, (F.col("z") + step).alias("z"), F.col("pixels").alias(name))
    joined = held.join(near(1, "_before"), [*keys, "z"], "left").join(near(-1, "_after"), [*keys, "z"], "left")
    columns = joined.columns

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out: list[list[np.ndarray]] = [[], [], []]
            for p, a, b, h, w in zip(part["pixels"], part["_before"], part["_after"], part["height"], part["width"], strict=True):
                image = np.asarray(p, float).reshape(h, w)
                for i, (axis, size) in enumerate(((1, vx), (0, vy))):
                    out[i].append((np.gradient(image, axis=axis) / size if image.shape[axis] > 1 else np.zeros_like(image)).ravel())
                sides = [np.asarray(v, float).reshape(h, w) if v is not None else None for v in (a, b)]
                first, last = (image if s is None else s for s in sides)
                out[2].append(((last - first) / max(1, sum(s is not None for s in sides)) / vz).ravel())
            yield part.assign(grad_x=out[0], grad_y=out[1], grad_z=out[2])[[*columns, "grad_x", "grad_y", "grad_z"]]

    kinds = "".join(f"`{c}` {k}, " for c, k in joined.dtypes)
    return joined.mapInPandas(run, kinds + "grad_x array<double>, grad_y array<double>, grad_z array<double>").drop("_before", "_after")
