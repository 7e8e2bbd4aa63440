"""Cameras: per-pixel dark, gain and variance maps, cut to a frame's region of the chip, and the noise that follows from them.

A camera is a row: camera, height, width (of the chip), dark, flat and variance (arrays of the chip's pixels by rows, or null where the
camera has one value for all), and the scalars of SCALARS.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

#: What a camera without an entry has: counts of no light, electrons of read noise, electrons a count, gain, excess noise.
SCALARS = {"ad_offset": 0.0, "read_noise": 1.0, "electrons_per_count": 1.0, "em_gain": 1.0, "noise_factor": 1.0}
#: Maps of all regions together are broadcast up to so many bytes; beyond, Spark joins them as it sees fit.
BROADCAST = 64 << 20


def _region(chip: Column, width: Column, default: Column) -> Column:
    """The region's pixels of a chip's map, or one value for all of them."""
    rows = F.transform(F.sequence(F.lit(0), F.col("height") - 1), lambda r: F.slice(chip, (F.col("roi_y") + r) * width + F.col("roi_x") + 1, F.col("width")))
    flat = F.array_repeat(default, (F.col("height") * F.col("width")).cast("int"))
    return F.when(chip.isNull(), flat).otherwise(F.transform(F.flatten(rows), lambda v: v.cast("double")))


def region_maps(frames: DataFrame, cameras: DataFrame) -> DataFrame:
    """camera, roi_x, roi_y, height, width, dark, flat, variance (electrons squared) and scalars of each region that frames use.

    Regions are told apart first, so that a map is cut once for all frames of a region. A region that reaches beyond the chip has null maps.
    """
    known = {c.lower() for c in cameras.columns}
    scalars = {n: F.coalesce(F.col(n).cast("double"), F.lit(d)) if n in known else F.lit(d) for n, d in SCALARS.items()}
    chips = cameras.select("camera", F.col("height").alias("_h"), F.col("width").alias("_w"), *(F.col(m).alias(f"_{m}") if m in known else F.lit(None).cast("array<double>").alias(f"_{m}") for m in ("dark", "flat", "variance")), *(v.alias(n) for n, v in scalars.items()))
    regions = frames.select("camera", "roi_x", "roi_y", "height", "width").distinct().join(chips, "camera")
    fits = (F.col("roi_x") >= 0) & (F.col("roi_y") >= 0) & (F.col("roi_y") + F.col("height") <= F.col("_h")) & (F.col("roi_x") + F.col("width") <= F.col("_w"))
    default = {"dark": F.col("ad_offset"), "flat": F.lit(1.0), "variance": F.col("read_noise") * F.col("read_noise")}
    maps = {m: F.when(fits, _region(F.col(f"_{m}"), F.col("_w"), d)) for m, d in default.items()}
    return regions.withColumns(maps).drop("_h", "_w", "_dark", "_flat", "_variance", "ad_offset", "read_noise")


def noise(pixels: Column, variance: Column, electrons_per_count: Column, em_gain: Column, noise_factor: Column) -> Column:
    """Expected deviation (counts) of each corrected pixel: read noise, photon noise and that of the gain."""

    def one(p: Column, v: Column) -> Column:
        shot = electrons_per_count * em_gain * F.greatest(p, F.lit(1.0)) + em_gain * em_gain
        return F.sqrt(v + noise_factor * noise_factor * shot) / electrons_per_count

    return F.zip_with(pixels, variance, one)


def correct(frames: DataFrame, cameras: DataFrame, broadcast_bytes: int = BROADCAST) -> DataFrame:
    """frames (camera, roi_x, roi_y, height, width, pixels as read) with pixels less the dark map, times the flat map, and sigma, the
    noise of each pixel.

    Frames of a camera that `cameras` lacks, or of a region beyond its chip, have null pixels and null sigma. cameras has one
    row a camera. What is joined to the frames has a row a region; whether it is broadcast follows from its size.
    """
    maps = region_maps(frames, cameras)
    sizes = frames.select("camera", "roi_x", "roi_y", "height", "width").distinct().agg(F.sum(F.col("height").cast("long") * F.col("width") * 24)).first()[0] or 0
    if sizes <= broadcast_bytes:
        maps = F.broadcast(maps)
    joined = frames.join(maps, ["camera", "roi_x", "roi_y", "height", "width"], "left")
    less = F.zip_with(F.transform("pixels", lambda p: p.cast("double")), F.col("dark"), lambda p, d: p - d)
    joined = joined.withColumn("pixels", F.zip_with(less, F.col("flat"), lambda p, f: p * f))
    sigma = noise(F.col("pixels"), F.col("variance"), F.col("electrons_per_count"), F.col("em_gain"), F.col("noise_factor"))
    return joined.withColumn("sigma", sigma).select(*frames.columns, "sigma")


def maps_from_dark_frames(frames: DataFrame, camera: str, height: int, width: int, keys: Sequence[str] = (), electrons_per_count: float = 1.0) -> DataFrame:
    """A camera's row from frames of no light: dark is each pixel's mean, variance its variance in electrons squared.

    Pixels are averaged before they meet, so that a camera of any number of frames is one row of its chip's size.
    """
    each = frames.select(F.col(camera).alias("camera"), *keys, F.posexplode("pixels").alias("pos", "v"))
    each = each.groupBy("camera", *keys, "pos").agg(F.avg(F.col("v").cast("double")).alias("d"), F.var_pop(F.col("v").cast("double")).alias("s"))
    rows = each.groupBy("camera", *keys).agg(F.array_sort(F.collect_list(F.struct("pos", "d", "s"))).alias("p"))  # as many as the chip has pixels
    square = electrons_per_count * electrons_per_count
    return rows.select("camera", *keys, F.lit(height).alias("height"), F.lit(width).alias("width"), F.transform("p", lambda p: p["d"]).alias("dark"), F.transform("p", lambda p: p["s"] * square).alias("variance"), F.lit(electrons_per_count).alias("electrons_per_count"))
