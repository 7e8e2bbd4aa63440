"""Motion between frames, and regions flooded from markers."""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from photonflow.operators.images import gaussian


def _moved(image: np.ndarray, dx: np.ndarray, dy: np.ndarray) -> np.ndarray:
    """image at each pixel's place plus (dx, dy), by linear interpolation; places beyond the edges take the edge."""
    h, w = image.shape
    y = np.clip(np.arange(h)[:, None] + dy, 0, h - 1)
    x = np.clip(np.arange(w)[None, :] + dx, 0, w - 1)
    y0, x0 = np.minimum(y.astype(int), max(h - 2, 0)), np.minimum(x.astype(int), max(w - 2, 0))
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    fy, fx = y - y0, x - x0
    return (image[y0, x0] * (1 - fx) + image[y0, x1] * fx) * (1 - fy) + (image[y1, x0] * (1 - fx) + image[y1, x1] * fx) * fy


def pair_flow(a: np.ndarray, b: np.ndarray, blur: float, support: float, penalty: float = 0.0, rounds: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(dx, dy) by which each pixel of a has moved in b: least squares of brightness constancy over a Gaussian support.

    Frames are blurred first. penalty holds back large motions where there is little to tell them by; without it, pixels in which nothing varies
    have no motion. A round solves for what is left after b was moved back by the motion found so far; one round is the plain linear estimate.
    """
    first, second, wide = gaussian(blur)(a), gaussian(blur)(b), gaussian(support)
    dx = dy = np.zeros(a.shape)
    for i in range(rounds):
        back = _moved(second, dx, dy) if i else second
        middle = (first + back) / 2
        gy, gx = (np.gradient(middle, axis=k) if middle.shape[k] > 1 else np.zeros_like(middle) for k in (0, 1))
        gt = back - first
        xx, yy, xy = wide(gx * gx) + penalty, wide(gy * gy) + penalty, wide(gx * gy)
        bx, by = -wide(gx * gt), -wide(gy * gt)
        det = xx * yy - xy * xy
        flat = det <= 1e-12 * np.maximum(xx * yy, 1e-300)
        det = np.where(flat, 1.0, det)
        dx = dx + np.where(flat, 0.0, (yy * bx - xy * by) / det)
        dy = dy + np.where(flat, 0.0, (xx * by - xy * bx) / det)
    return dx, dy


def optical_flow(frames: DataFrame, series: str, t: str, blur: float = 1.0, support: float = 10.0, penalty: float = 0.0, rounds: int = 1) -> DataFrame:
    """frames (series, t, height, width, pixels) with flow_x and flow_y: the motion since the frame before plus that to the next one.

    The first and last frame of a series have one of both, a lone frame has none (0). Frames that follow each other meet once, by a join on their
    times; only times are ordered, so a series may be as long as it likes. Pairs of unlike sizes have no motion; frames with null pixels are left out.
    """
    held = frames.where(F.col("pixels").isNotNull()).withColumn("pixels", F.transform("pixels", lambda p: p.cast("double")))
    slim = held.select(F.col(series).alias("_s"), F.col(t).alias("_t"), "height", "width", F.col("pixels").alias("_a"))
    follow = slim.select("_s", "_t").withColumn("_next", F.lead("_t").over(Window.partitionBy("_s").orderBy("_t"))).where("_next is not null")
    later = slim.select("_s", F.col("_t").alias("_next"), F.col("height").alias("_h"), F.col("width").alias("_w"), F.col("_a").alias("_b"))
    pairs = slim.join(follow, ["_s", "_t"]).join(later, ["_s", "_next"]).where("height = _h and width = _w")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = [pair_flow(*(np.asarray(v, float).reshape(h, w) for v in (a, b)), blur, support, penalty, rounds) for a, b, h, w in zip(part["_a"], part["_b"], part["height"], part["width"], strict=True)]
            yield part[["_s", "_t", "_next"]].assign(dx=[f[0].ravel() for f in found], dy=[f[1].ravel() for f in found])

    kinds = dict(pairs.dtypes)
    moves = pairs.mapInPandas(run, f"_s {kinds['_s']}, _t {kinds['_t']}, _next {kinds['_next']}, dx array<double>, dy array<double>")
    ends = F.explode(F.array(F.col("_t"), F.col("_next"))).alias("_at")  # one pass over the pairs for both of their frames
    each = moves.select("_s", ends, F.struct("dx", "dy").alias("m")).groupBy("_s", "_at").agg(F.collect_list("m").alias("m"))  # two at most
    none = F.transform("pixels", lambda _: F.lit(0.0))
    add = lambda c: F.aggregate(F.coalesce("m", F.array()), none, lambda s, m: F.zip_with(s, m[c], lambda u, v: u + v))
    joined = held.join(each, (held[series] == each["_s"]) & (held[t] == each["_at"]), "left")
    return joined.withColumns({"flow_x": add("dx"), "flow_y": add("dy")}).drop("_s", "_at", "m")


def flood(image: np.ndarray, markers: np.ndarray, mask: np.ndarray | None = None) -> np.ndarray:
    """Labels of the markers spread to all pixels (of the mask) that 4-connected paths reach, lowest pixels first.

    Pixels are taken in order of value, those of one value in the order in which they were reached; markers are reached first, in raster
    order, and a pixel's neighbours in the order up, left, right, down. A pixel belongs to the marker that reached it first. Markers outside
    the mask don't count.
    """
    h, w = image.shape
    padded = np.zeros((h + 2, w + 2), bool)
    padded[1:-1, 1:-1] = True if mask is None else mask
    open_ = padded.ravel().tolist()
    labels = np.zeros((h + 2, w + 2), np.int64)
    labels[1:-1, 1:-1] = np.where(padded[1:-1, 1:-1], markers, 0)
    value = np.zeros((h + 2, w + 2))
    value[1:-1, 1:-1] = image
    out, level, steps = labels.ravel().tolist(), value.ravel().tolist(), (-(w + 2), -1, 1, w + 2)
    heap = [(level[i], n, i) for n, i in enumerate(np.flatnonzero(labels).tolist())]
    age = len(heap)
    heapq.heapify(heap)
    while heap:
        _, _, i = heapq.heappop(heap)
        for s in steps:
            j = i + s
            if open_[j] and not out[j]:
                out[j] = out[i]
                heapq.heappush(heap, (level[j], age, j))
                age += 1
    return np.array(out).reshape(h + 2, w + 2)[1:-1, 1:-1]


def watershed(frames: DataFrame, markers: DataFrame, keys: Sequence[str], mask: DataFrame | None = None) -> DataFrame:
    """frames whose pixels are the labels of flood(): markers and mask (pixels above 0.5) are frames of the same keys.

    Values are compared on a scale of 32,768 steps of each frame's largest, so that noise below a step makes no basins. Frames without markers are left out, frames
    with null pixels too; NaN counts as 0.
    """
    joined = frames.join(markers.select(*keys, F.col("pixels").alias("_markers")), list(keys))
    if mask is not None:
        joined = joined.join(mask.select(*keys, F.col("pixels").alias("_mask")), list(keys))
    joined = joined.where(F.col("pixels").isNotNull() & F.col("_markers").isNotNull()).withColumn("pixels", F.transform("pixels", lambda p: p.cast("double")))
    columns, masked = frames.columns, mask is not None

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            done = []
            for i, (p, m, h, w) in enumerate(zip(part["pixels"], part["_markers"], part["height"], part["width"], strict=True)):
                image = np.nan_to_num(np.asarray(p, float)).reshape(h, w)
                most = image.max() if image.size else 0.0
                steps = np.trunc(image / most * 2**15) if most else image
                inside = np.asarray(part["_mask"].iloc[i], float).reshape(h, w) > 0.5 if masked else None
                done.append(flood(steps, np.asarray(m, float).astype(np.int64).reshape(h, w), inside).astype(float).ravel())
            yield part.assign(pixels=done)[columns]

    return joined.mapInPandas(run, ", ".join(f"`{c}` {dict(joined.dtypes)[c]}" for c in columns))
