"""Image series as tables of frames (series, c, z, t, height, width, pixels) and their kernels.

Pixel arithmetic stays in Spark's array expressions. Neighbourhood kernels are numpy, on Arrow batches of whole frames.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F


def pixel_map(frames: DataFrame, f: Callable[[Column], Column], out: str = "pixels") -> DataFrame:
    return frames.withColumn(out, F.transform("pixels", f))


def scale(frames: DataFrame, factor: float) -> DataFrame:
    return pixel_map(frames, lambda p: p * factor)


def threshold(frames: DataFrame, level: float) -> DataFrame:
    return pixel_map(frames, lambda p: (p > level).cast("double"))


def normalise(frames: DataFrame) -> DataFrame:
    """Each frame scaled to 0..1 by its own extremes; a flat frame becomes 0."""
    low, high = F.array_min("pixels"), F.array_max("pixels")
    return frames.withColumn("pixels", F.transform("pixels", lambda p: F.coalesce(F.try_divide(p - low, high - low), F.lit(0.0))))


def normalise_mean(frames: DataFrame, offset: float = 0.0) -> DataFrame:
    """Each frame less the offset, over its own mean of that; a frame of no mean becomes null."""
    less = F.transform("pixels", lambda p: p.cast("double") - offset)
    mean = F.try_divide(F.aggregate(less, F.lit(0.0), lambda s, p: s + p), F.size("pixels"))
    return frames.withColumn("_mean", mean).withColumn("pixels", F.transform(less, lambda p: F.try_divide(p, F.col("_mean")))).drop("_mean")


def zoom(frames: DataFrame, factor: float) -> DataFrame:
    """Frames resampled by a factor, by linear interpolation between pixel centres; the corners stay where they are."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            done, heights, widths = [], [], []
            for p, h, w in zip(part["pixels"], part["height"], part["width"], strict=True):
                image, (nh, nw) = np.asarray(p, float).reshape(h, w), (max(1, round(h * factor)), max(1, round(w * factor)))
                y, x = (np.linspace(0, n - 1, m) if m > 1 else np.zeros(1) for n, m in ((h, nh), (w, nw)))
                rows = np.stack([np.interp(x, np.arange(w), r) for r in image])
                done.append(np.stack([np.interp(y, np.arange(h), c) for c in rows.T], axis=1).ravel())
                heights.append(nh)
                widths.append(nw)
            yield part.assign(pixels=done, height=heights, width=widths)

    wide = frames.withColumn("pixels", F.transform("pixels", lambda p: p.cast("double")))
    return wide.mapInPandas(run, wide.schema)


def join_channels(channels: list[DataFrame]) -> DataFrame:
    """Frames of several images as one, c being the number of the image."""
    out = None
    for i, frames in enumerate(channels):
        one = frames.withColumn("c", F.lit(i))
        out = one if out is None else out.unionByName(one)
    return out


def combine(a: DataFrame, b: DataFrame, keys: list[str], f: Callable[[Column, Column], Column]) -> DataFrame:
    """Pixel by pixel combination of equal frames of two images."""
    return a.join(b.select(*keys, F.col("pixels").alias("_other")), keys).withColumn("pixels", F.zip_with("pixels", "_other", f)).drop("_other")


def crop(frames: DataFrame, y: tuple[int, int], x: tuple[int, int]) -> DataFrame:
    """Rows y[0] to y[1] and columns x[0] to x[1] (ends excluded; -1 is the end)."""
    y1 = F.when(F.lit(y[1]) < 0, F.col("height")).otherwise(F.least(F.lit(y[1]), F.col("height")))
    x1 = F.when(F.lit(x[1]) < 0, F.col("width")).otherwise(F.least(F.lit(x[1]), F.col("width")))
    rows = F.transform(F.sequence(F.lit(y[0]), y1 - 1), lambda r: F.slice("pixels", r * F.col("width") + x[0] + 1, x1 - x[0]))
    cut = frames.withColumn("pixels", F.flatten(rows))  # apart: inside lambdas, names may mean columns of the same step
    return cut.withColumns({"height": y1 - y[0], "width": x1 - x[0]})


def background_subtract(frames: DataFrame, series: str, t: str, start: int, stop: int) -> DataFrame:
    """Each frame less the mean of the series' frames at start <= frame - t < stop, pixel by pixel, frames kept whole."""
    w = Window.partitionBy(series).orderBy(t).rangeBetween(start, stop - 1)
    held = frames.withColumn("_near", F.collect_list("pixels").over(w))
    total = F.aggregate("_near", F.transform("pixels", lambda p: F.lit(0.0)), lambda a, p: F.zip_with(a, p, lambda u, v: u + v))
    mean = F.transform(total, lambda s: F.try_divide(s, F.size("_near")))
    return held.withColumn("pixels", F.zip_with("pixels", mean, lambda p, m: p - m)).drop("_near")


def frame_filter(frames: DataFrame, kernel: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """A numpy kernel on every frame by itself."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            done = [kernel(np.asarray(p, float).reshape(h, w)).ravel() for p, h, w in zip(part["pixels"], part["height"], part["width"], strict=True)]
            yield part.assign(pixels=done)

    return frames.withColumn("pixels", F.transform("pixels", lambda p: p.cast("double"))).mapInPandas(run, frames.withColumn("pixels", F.transform("pixels", lambda p: p.cast("double"))).schema)


def gaussian(sigma: float) -> Callable[[np.ndarray], np.ndarray]:
    """A Gaussian blur of a frame, or of each frame of a stack, with reflected edges, four deviations wide."""
    reach = max(1, int(4 * sigma + 0.5))
    k = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    k /= k.sum()

    def blur(image: np.ndarray) -> np.ndarray:
        for axis in (image.ndim - 2, image.ndim - 1):
            padded = np.pad(image, [(reach, reach) if a == axis else (0, 0) for a in range(image.ndim)], mode="symmetric")
            n = image.shape[axis]
            parts = (padded[..., i : i + n, :] if axis == image.ndim - 2 else padded[..., i : i + n] for i in range(2 * reach + 1))
            image = sum(w * part for w, part in zip(k, parts, strict=True))
        return image

    return blur


def median3(image: np.ndarray) -> np.ndarray:
    padded = np.pad(image, 1, mode="symmetric")
    return np.median(np.lib.stride_tricks.sliding_window_view(padded, (3, 3)).reshape(*image.shape, 9), axis=2)


def label(image: np.ndarray) -> np.ndarray:
    """Numbers of the 4-connected regions above 0, in raster order, by union of neighbouring pixels' trees."""
    mask = image > 0
    places = np.arange(image.size).reshape(image.shape)
    right, down = mask[:, 1:] & mask[:, :-1], mask[1:] & mask[:-1]
    a = np.concatenate([places[:, :-1][right], places[:-1][down]])
    b = np.concatenate([places[:, 1:][right], places[1:][down]])
    root = np.arange(image.size)
    while len(a):
        ra, rb = root[a], root[b]
        apart = ra != rb
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while not np.array_equal(up := root[root], root):
            root = up
    ids = root.reshape(image.shape)
    return np.where(mask, np.searchsorted(np.unique(ids[mask]), ids) + 1, 0)


def detect_spots(frames: DataFrame, level: float, keys: list[str]) -> DataFrame:
    """Points of frames: centroid (weighted), sum and area of each connected region above a level."""
    kinds = dict(frames.dtypes)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for *key, p, h, w in part[[*keys, "pixels", "height", "width"]].itertuples(index=False):
                image = np.asarray(p, float).reshape(h, w)
                ids = label(image > level).ravel()
                inside = ids > 0
                y, x = np.divmod(np.flatnonzero(inside), w)
                v, n = image.ravel()[inside], ids[inside]
                total = np.bincount(n, v)[1:]
                for i, (s, a, cx, cy) in enumerate(zip(total, np.bincount(n)[1:], np.bincount(n, v * x)[1:], np.bincount(n, v * y)[1:], strict=True)):
                    rows.append((*key, i + 1, cx / s if s else 0.0, cy / s if s else 0.0, s, a))
            yield pd.DataFrame(rows, columns=[*keys, "label", "x", "y", "A", "area"])

    return frames.mapInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", label long, x double, y double, A double, area long")


def rotate180(frames: DataFrame) -> DataFrame:
    return frames.withColumn("pixels", F.reverse("pixels"))


def labels_to_channels(frames: DataFrame) -> DataFrame:
    """A frame for each label above 0 in a frame, with the label's mask."""
    each = frames.withColumn("channel", F.explode(F.array_distinct(F.filter("pixels", lambda p: p > 0))))
    return each.withColumn("pixels", F.transform("pixels", lambda p: (p == F.col("channel")).cast("double")))


def intensity_at_points(frames: DataFrame, points: DataFrame, keys: list[str], radii: list[float], mean: bool = False) -> DataFrame:
    """Sums (or means) in discs around each point (x, y in pixels) of its frame, as a column r<radius> each.

    A frame meets its points as one list, in one row, so that its pixels are not copied for every point; of a disc, only the
    rows that it reaches are read. Points without a frame are left out.
    """
    lists = points.groupBy(*keys).agg(F.collect_list(F.struct(*points.columns)).alias("_points"))
    joined = lists.join(frames.select(*keys, "height", "width", "pixels"), keys)

    def disc(p: Column, r: float) -> Column:
        def row(y: Column) -> Column:  # [sum, pixels] of the disc in one row of the frame
            half = F.sqrt(F.greatest(F.lit(r * r) - (y - p["y"]) * (y - p["y"]), F.lit(0.0)))
            first = F.greatest(F.ceil(p["x"] - half), F.lit(0)).cast("int")
            last = F.least(F.floor(p["x"] + half), F.col("width") - 1).cast("int")
            part = F.slice("pixels", (y * F.col("width")).cast("int") + first + 1, F.greatest(last - first + 1, F.lit(0)))
            return F.array(F.aggregate(part, F.lit(0.0), lambda s, v: s + v.cast("double")), F.size(part).cast("double"))

        low, high = F.greatest(F.ceil(p["y"] - r), F.lit(0)).cast("int"), F.least(F.floor(p["y"] + r), F.col("height") - 1).cast("int")
        rows = F.filter(F.transform(F.sequence(low, F.greatest(low, high)), row), lambda _: low <= high)
        total = F.aggregate(rows, F.array(F.lit(0.0), F.lit(0.0)), lambda s, v: F.zip_with(s, v, lambda a, b: a + b))
        return F.try_divide(total[0], total[1]) if mean else total[0]

    found = F.transform("_points", lambda p: F.struct(*(p[c].alias(c) for c in points.columns), *(disc(p, r).alias(f"r{r:g}") for r in radii)))
    return joined.select(F.inline(found))


def regions(frames: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    """Of each label of each frame: area, centroid, summed and mean intensity. Pixels of labels are exploded and grouped."""
    both = labels.select(*keys, "width", F.col("pixels").alias("_ids")).join(frames.select(*keys, "pixels"), keys)
    each = both.select(*keys, "width", F.posexplode(F.arrays_zip("_ids", "pixels")).alias("pos", "p")).where("p._ids > 0")
    v = F.col("p.pixels").cast("double")
    return each.groupBy(*keys, F.col("p._ids").cast("long").alias("label")).agg(
        F.count("*").alias("area"), F.avg(F.col("pos") % F.col("width")).alias("x"), F.avg(F.floor(F.col("pos") / F.col("width"))).alias("y"), F.sum(v).alias("total"), F.avg(v).alias("mean")
    )


def extract_rois(frames: DataFrame, points: DataFrame, keys: list[str], half: int) -> DataFrame:
    """Square crops around points (x, y in pixels), and the places in them; points too near an edge are left out."""
    joined = points.join(frames.select(*keys, "height", "width", "pixels"), keys)
    x0, y0 = F.floor(F.col("x") + 0.5) - half, F.floor(F.col("y") + 0.5) - half
    size = 2 * half + 1
    inside = (x0 > 0) & (y0 > 0) & (x0 + size < F.col("width")) & (y0 + size < F.col("height"))
    cut = joined.where(inside).withColumns({"roi_x": x0.cast("int"), "roi_y": y0.cast("int")})
    rows = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda r: F.slice("pixels", (F.col("roi_y") + r) * F.col("width") + F.col("roi_x") + 1, size))
    out = cut.withColumn("roi", F.flatten(rows)).withColumns({"x": F.col("x") - F.col("roi_x"), "y": F.col("y") - F.col("roi_y")})
    return out.drop("height", "width", "pixels")
