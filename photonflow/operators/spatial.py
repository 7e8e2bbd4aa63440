"""Distance joins on a grid of cells, and the statistics that follow from them.

Points meet only in equal or neighbouring cells, so a join is on cell keys. Crowded cells are no worse than the pairs
they really hold; callers choose the radius. The join is one that Spark's adaptive execution splits where a partition is skewed.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import product
from math import pi
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from photonflow.operators.tiles import Tile, distances, fine, gathered, lists, meetings, neighbour_counts, pair_counts, tiles
from photonflow.sources.shared import shared_dir


def _cells(axes: Sequence[str], size: float) -> list[Column]:
    return [F.floor(F.col(c) / size).cast("long") for c in axes]


def _spread(df: DataFrame, axes: Sequence[str], size: float) -> DataFrame:
    """Each point once for its own and each neighbouring cell."""
    moves = F.array(*(F.array(*map(F.lit, m)) for m in product((-1, 0, 1), repeat=len(axes))))
    out = df.withColumn("_cell", F.array(*_cells(axes, size))).withColumn("_move", F.explode(moves))
    return out.withColumn("_cell", F.zip_with("_cell", "_move", lambda a, b: a + b.cast("long"))).drop("_move")


def distance(axes: Sequence[str], a: str = "a", b: str = "b") -> Column:
    total = F.lit(0.0)
    for c in axes:
        d = F.col(f"{a}.{c}").cast("double") - F.col(f"{b}.{c}").cast("double")
        total = total + d * d
    return F.sqrt(total)


def pairs_within(left: DataFrame, right: DataFrame, axes: Sequence[str], radius: float, keys: Sequence[str] = ()) -> DataFrame:
    """Structs a (of left) and b (of right) of all pairs of equal keys at a distance below the radius, and it."""
    a = left.select(F.struct(*left.columns).alias("a"), F.array(*_cells(axes, radius)).alias("_cell"), *(F.col(k).alias(f"_{k}") for k in keys))
    b = _spread(right, axes, radius).select(F.struct(*right.columns).alias("b"), "_cell", *(F.col(k).alias(f"_{k}") for k in keys))
    return a.join(b, ["_cell", *(f"_{k}" for k in keys)]).withColumn("distance", distance(axes)).where(F.col("distance") < radius).select("a", "b", "distance")


def self_pairs(points: DataFrame, axes: Sequence[str], radius: float, row_id: str) -> DataFrame:
    """Each unordered pair of points closer than the radius once, with a.row_id < b.row_id."""
    return pairs_within(points, points, axes, radius).where(F.col(f"a.{row_id}") < F.col(f"b.{row_id}"))


def nearest(points: DataFrame, others: DataFrame, axes: Sequence[str], start: float, row_id: str, same: bool = False, max_rounds: int = 40, keys: Sequence[str] = ()) -> DataFrame:
    """row_id, neighbour, distance: of each point, the nearest of the others of equal keys (the least id of equally near ones).

    Points that find none within the radius try again at twice of it, so each round takes fewer points, on larger
    cells. The first radius is `start`, or less where the others would hold many points within it if they were spread evenly. If `same`, others are the
    points themselves and a point is not its own neighbour. Points whose keys no other has are left out; points that are still open
    after `max_rounds` (none, unless `start` is far too small) raise RuntimeError.
    """
    found, open_, dims, kind, other = None, points, len(axes), dict(points.dtypes)[row_id], dict(others.dtypes)[row_id]
    shared_dir(points.sparkSession)
    if keys:
        held = others.groupBy(*keys).agg(F.count("*").alias("_held")).where(F.col("_held") > int(same)).drop("_held")
        open_ = points.join(held, list(keys), "left_semi")
    radius, more = _spread_radius(others, axes, start, keys)

    def add(state: list[np.ndarray], a: Tile, b: Tile) -> None:
        if len(state) == 1:
            state.append(np.full(len(a.ids), b.ids[0], b.ids.dtype))
        least, which = state
        order = np.argsort(b.ids, kind="stable")
        b = Tile(b.number, b.ids[order], b.at[:, order])
        for part, d in distances(a, b, dims):
            if same:
                d[a.ids[part, None] == b.ids] = np.inf
            at = d.argmin(axis=1)  # the first, so the least id
            new, ids = d[np.arange(len(d)), at], b.ids[at]
            better = (new < radius) & ((new < least[part]) | ((new == least[part]) & (ids < which[part])))
            least[part] = np.where(better, new, least[part])
            which[part] = np.where(better, ids, which[part])

    def finish(a: Tile, state: list[np.ndarray]) -> pa.RecordBatch:
        some = np.isfinite(state[0])
        which = state[1] if len(state) > 1 else a.ids  # nothing was near: no rows, of the ids' kind
        return pa.record_batch([pa.array(a.ids[some]), pa.array(state[0][some]), pa.array(which[some])], names=["id", "distance", "neighbour"])

    for _ in range(max_rounds + more):
        cell = fine(radius)
        pairs = meetings(tiles(open_, row_id, axes, cell, keys), tiles(others, row_id, axes, cell, keys), radius, cell)
        best = pairs.mapInArrow(gathered(radius, dims, lambda a: [np.full(len(a.ids), np.inf)], add, finish), f"id {kind}, distance double, neighbour {other}")
        best = best.groupBy(F.col("id").alias(row_id)).agg(F.min(F.struct("distance", "neighbour")).alias("m"))
        best = best.select(row_id, "m.neighbour", "m.distance").checkpoint()
        found = best if found is None else found.unionByName(best)
        open_ = open_.join(best, row_id, "left_anti").checkpoint()
        if not open_.take(1) or len(others.take(2)) < 1 + same:
            return found
        radius *= 2
    raise RuntimeError(f"points without a neighbour within {radius:g}")


def _spread_radius(points: DataFrame, axes: Sequence[str], start: float, keys: Sequence[str] = ()) -> tuple[float, int]:
    """`start` halved as long as a ball of it would hold more than one of the points if each key's were spread evenly over their box, and how often."""
    ends = [f(F.col(c).cast("double")) for c in axes for f in (F.min, F.max)]
    told = points.where(reduce(and_, [F.abs(F.col(c).cast("double")) < float("inf") for c in axes])).agg(F.count("*").alias("n"), *(e.alias(f"_{i}") for i, e in enumerate(ends))).first()
    sets = points.select(*keys).distinct().count() if keys else 1
    if not told["n"]:
        return start, 0
    room = float(np.prod([max(told[f"_{2 * i + 1}"] - told[f"_{2 * i}"], start) for i in range(len(axes))]))
    apart = (room * sets / told["n"]) ** (1 / len(axes))
    more = max(0, int(np.floor(np.log2(start / apart))))
    return start / 2**more, more


def nearest_k(points: DataFrame, others: DataFrame, axes: Sequence[str], k: int, start: float, row_id: str, other_id: str) -> DataFrame:
    """row_id, near: of each point, the k nearest of the others as an array of (distance, neighbour), nearest first (ties by id); all of them where
    there are fewer.

    Points with fewer than k within the radius try again at twice of it. Those that still lack some when the radius spans all points have
    met everything. Others are counted in cells first, so that a point is only joined at a radius whose cells hold k of them.
    """
    shared_dir(points.sparkSession)
    ends = [f(F.col(c).cast("double")).alias(f"{n}{c}") for c in axes for n, f in (("low_", F.min), ("high_", F.max))]
    a, b = points.agg(*ends).first(), others.agg(F.count("*").alias("n"), *ends).first()
    slim = others.select(F.col(other_id).alias("_other"), *(F.col(c).cast("double").alias(c) for c in axes))
    open_ = points.select(F.col(row_id).alias("_row"), *(F.col(c).cast("double").alias(c) for c in axes)).checkpoint()
    none = F.array().cast(f"array<struct<distance:double,neighbour:{dict(slim.dtypes)['_other']}>>")
    if not b["n"] or a[f"low_{axes[0]}"] is None:
        return open_.select(F.col("_row").alias(row_id), none.alias("near"))
    span = sum((max(a[f"high_{c}"], b[f"high_{c}"]) - min(a[f"low_{c}"], b[f"low_{c}"])) ** 2 for c in axes) ** 0.5
    wanted, found, radius = min(k, b["n"]), None, start
    while True:
        last = radius > span
        cells = _spread(slim, axes, radius).groupBy("_cell").agg(F.count("*").alias("_n")).where(F.col("_n") >= wanted)
        likely = open_ if last else open_.withColumn("_cell", F.array(*_cells(axes, radius))).join(cells.select("_cell"), "_cell", "left_semi").drop("_cell")
        pairs = pairs_within(likely, slim, axes, radius)
        best = pairs.groupBy(F.col("a._row").alias("_row")).agg(F.array_sort(F.collect_list(F.struct("distance", F.col("b._other").alias("neighbour")))).alias("near"))
        best = best.where(F.size("near") >= wanted).select("_row", F.slice("near", 1, k).alias("near")).checkpoint()
        found = best if found is None else found.unionByName(best)
        open_ = open_.join(best, "_row", "left_anti").checkpoint()
        if last or not open_.take(1):
            return found.withColumnRenamed("_row", row_id)
        radius *= 2


def direction_to_nearest(queries: DataFrame, points: DataFrame, axes: Sequence[str], n: int, start: float, row_id: str, point_id: str) -> DataFrame:
    """row_id, azimuth, zenith, r, ux, uy, uz: from each query point to the mean of its n nearest points; a unit vector, null where it has no length."""
    near = nearest_k(queries, points, axes, n, start, row_id, point_id).select(row_id, F.explode("near.neighbour").alias("_p"))
    held = points.select(F.col(point_id).alias("_p"), *(F.col(c).cast("double").alias(f"_{c}") for c in axes))
    mean = near.join(held, "_p").groupBy(row_id).agg(*(F.avg(f"_{c}").alias(f"_{c}") for c in axes))
    moved = queries.select(row_id, *(F.col(c).cast("double").alias(c) for c in axes)).join(mean, row_id)
    x, y, z = (F.col(f"_{c}") - F.col(c) for c in axes)
    r = F.sqrt(x * x + y * y + z * z)
    return moved.select(row_id, F.atan2(y, x).alias("azimuth"), F.acos(F.try_divide(z, r)).alias("zenith"), r.alias("r"), *(F.try_divide(v, r).alias(f"u{c}") for v, c in zip((x, y, z), "xyz", strict=True)))


def keep_pairs(first: DataFrame, second: DataFrame, t: str, axes: Sequence[str], row_id: str, start: float) -> DataFrame:
    """For each point of `first`, the nearest point of `second` in the same frame; the search begins within `start`."""
    best = nearest(first.select(t, row_id, *axes), second.select(t, row_id, *axes), axes, start, row_id, keys=[t])
    return first.select(t, row_id).join(best.withColumnRenamed("neighbour", "pair"), row_id).select(t, row_id, "pair", "distance")


def pair_histogram(points: DataFrame, axes: Sequence[str], bins: int, size: float, row_id: str) -> DataFrame:
    """bin, bin_left, n: distances of all unordered pairs (of different row_id) below bins * size, truncated to bins.

    Every distance is worked out, so time grows with the pairs of near tiles; a task holds two tiles and its counts.
    """
    radius, cell = bins * size, fine(bins * size)
    held = tiles(points, row_id, axes, cell)

    def count(total: np.ndarray, d: np.ndarray, a: Tile, b: Tile, part: slice) -> None:
        total += np.bincount((d[d < radius] / size).astype(np.int64), minlength=bins + 1)

    counts = meetings(held, held, radius, cell, once=True).mapInArrow(pair_counts(radius, len(axes), bins + 1, count), "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n"))
    out = points.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).join(counts, "bin", "left").fillna(0, ["n"])
    return out.select("bin", (F.col("bin") * size).alias("bin_left"), "n")


def ripley(points: DataFrame, axes: Sequence[str], bins: int, size: float, row_id: str, area: float) -> DataFrame:
    """K, L and H up to each bin's right edge, in a bounding box of the given area (or volume), without edge correction."""
    n = points.count()
    order = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)  # a row a bin
    k = F.lit(area / (n * n)) * 2 * F.sum("n").over(order)
    flat = len(axes) == 2
    out = pair_histogram(points, axes, bins, size, row_id).select("bin", ((F.col("bin") + 1) * size).alias("r"), k.alias("K"))
    out = out.withColumn("L", F.sqrt(F.col("K") / pi) if flat else F.cbrt(F.col("K") * 3 / (4 * pi)))
    return out.withColumn("H", F.col("L") - F.col("r"))


def masked_ripley(points: DataFrame, mask: DataFrame, axes: Sequence[str], bins: int, size: float, row_id: str, area: float, per_mask_point: float, keys: Sequence[str] = ()) -> DataFrame:
    """bin, r, K with edge correction: each point's neighbours at a distance count as many times more as the mask's points at
    that distance fall short of what open space would hold. A point is its own neighbour at 0, as it is the mask's.

    `mask`: evenly spaced points of the region, of which each stands for per_mask_point. `keys` tells sets of points (simulations) apart.
    """
    slim = points.select(*keys, row_id, *axes)
    d = neighbour_counts(slim, None, axes, bins, size, row_id, "d", keys)
    w = neighbour_counts(slim, mask.select(*axes), axes, bins, size, row_id, "w", keys)
    power = len(axes)
    open_space = (F.pow(F.col("bin") + 1, F.lit(power)) - F.pow("bin", F.lit(power))) * (pi if power == 2 else 4 * pi / 3) * size**power / per_mask_point
    weighted = d.join(w, [*keys, row_id, "bin"]).groupBy(*keys, "bin").agg(F.sum(open_space * F.col("d") / F.col("w")).alias("h"))
    counts = slim.groupBy(*keys).agg(F.count("*").alias("n"))
    every = counts.crossJoin(F.broadcast(points.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))))  # sets of points times bins
    order = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)  # a row a bin
    whole = F.sum(F.coalesce("h", F.lit(0.0))).over(order)
    return every.join(weighted, [*keys, "bin"], "left").select(*keys, "bin", ((F.col("bin") + 1) * size).alias("r"), (F.lit(float(area)) / (F.col("n") * F.col("n")) * whole).alias("K"))


def ripley_envelope(k: DataFrame, points: int, mask: DataFrame, axes: Sequence[str], bins: int, size: float, area: float, per_mask_point: float, spacing: float, simulations: int = 20, significance: float = 0.05, seed: int = 0) -> DataFrame:
    """bin, r, K, K_min, K_max, p_clustered, p_dispersed: K (columns bin, r, K) against sets of as many random points of the region.

    All simulations are one job. A random point lies within half a spacing of one of the mask's points.
    """
    spark = mask.sparkSession
    places = mask.select(F.row_number().over(Window.orderBy(*axes)).alias("_k"), *axes)  # the mask is small by nature: it is a grid of one region
    total = places.count()
    draws = spark.range(simulations * points).select((F.col("id") % simulations).alias("sim"), F.col("id").alias("row"), (F.floor(F.rand(seed) * total) + 1).cast("int").alias("_k"), *((F.rand(seed + 1 + i) - 0.5).alias(f"_{c}") for i, c in enumerate(axes)))
    random = draws.join(places, "_k").select("sim", "row", *((F.col(c) + F.col(f"_{c}") * spacing).alias(c) for c in axes))
    sims = masked_ripley(random, mask, axes, bins, size, "row", area, per_mask_point, ["sim"]).select("bin", F.col("K").alias("_K"))
    both = k.join(sims, "bin").groupBy("bin", "r", "K")
    chance = lambda hits: (F.sum(hits.cast("int")) + 1) / (simulations + 1)
    return both.agg(
        F.percentile("_K", F.lit(significance)).alias("K_min"), F.percentile("_K", F.lit(1 - significance)).alias("K_max"),
        chance(F.col("_K") >= F.col("K")).alias("p_clustered"), chance(F.col("_K") <= F.col("K")).alias("p_dispersed"),
    )


def box_mask(spark, low: Sequence[float], high: Sequence[float], spacing: float, axes: Sequence[str]) -> DataFrame:
    """Evenly spaced points of a box, from its low corner on, the high sides excluded."""
    from math import ceil

    steps = [max(1, ceil((b - a) / spacing)) for a, b in zip(low, high, strict=True)]
    total, out, left = 1, [], F.col("id")
    for n, a, c in zip(steps, low, axes, strict=True):
        out.append((left % n * spacing + a).alias(c))
        left, total = F.floor(left / n), total * n
    return spark.range(total).select(*out)


def distance_features(points: DataFrame, axes: Sequence[str], bins: int, size: float, row_id: str, normalise: bool = False) -> DataFrame:
    """row_id, features: how many points, itself included, lie in each ring of `size` around a point; or their shares."""
    slim = points.select(row_id, *axes)
    counts = neighbour_counts(slim, None, axes, bins, size, row_id, "n")
    held = counts.groupBy(row_id).agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("m"))  # `bins` entries at most
    features = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.coalesce(F.try_element_at("m", b), F.lit(0)).cast("double"))
    if normalise:
        features = F.transform(features, lambda v: v / F.aggregate(features, F.lit(0.0), lambda s, u: s + u))
    return held.select(row_id, features.alias("features"))


def local_density(points: DataFrame, axes: Sequence[str], neighbours: int, radius: float, row_id: str) -> DataFrame:
    """Density from the nearest neighbours within the radius: the least squares slope of their number against d ** D."""
    cell, dims, kind = fine(radius), len(axes), dict(points.dtypes)[row_id]
    held = tiles(points, row_id, axes, cell)

    def add(best: np.ndarray, a: Tile, b: Tile) -> None:
        for part, d in distances(a, b, dims):
            d[(d >= radius) | (a.ids[part, None] == b.ids)] = np.inf
            if d.shape[1] > neighbours:
                d = np.partition(d, neighbours - 1, axis=1)[:, :neighbours]
            best[part] = np.sort(np.concatenate([best[part], d], axis=1), axis=1)[:, :neighbours]

    def finish(a: Tile, best: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch([pa.array(a.ids), lists(best)], names=["id", "near"])

    told = meetings(held, held, radius, cell).mapInArrow(gathered(radius, dims, lambda a: np.full((len(a.ids), neighbours), np.inf), add, finish), f"id {kind}, near array<double>")
    near = told.groupBy("id").agg(F.array_sort(F.flatten(F.collect_list("near"))).alias("near"))  # `neighbours` for each state of the point's tile
    near = near.select("id", F.posexplode(F.slice("near", 1, neighbours)).alias("k", "distance")).where(F.col("distance") < float("inf")).withColumn("k", F.col("k") + 1)
    d = F.pow("distance", F.lit(len(axes)))
    return near.groupBy(F.col("id").alias(row_id)).agg(F.count("*").alias("n"), F.try_divide(F.sum(d * F.col("k")), F.sum(d * d)).alias("density"))


def mean_square_displacement(df: DataFrame, track: str, t: str, axes: Sequence[str], bins: int, size: int, row_id: str) -> DataFrame:
    """Mean square distance of a track's pairs by their lag, in bins of `size`; a point meets only points of its lag range."""
    cell = F.floor(F.col(t) / (bins * size))
    a = df.select(F.struct(row_id, t, *axes).alias("a"), F.col(track), cell.alias("_cell"))
    b = df.select(F.struct(row_id, t, *axes).alias("b"), F.col(track), F.explode(F.array(cell - 1, cell, cell + 1)).alias("_cell"))
    lag = F.abs(F.col(f"a.{t}") - F.col(f"b.{t}"))
    pairs = a.join(b, [track, "_cell"]).where((F.col(f"a.{row_id}") < F.col(f"b.{row_id}")) & (lag < bins * size))
    return pairs.groupBy(F.floor(lag / size).cast("int").alias("lag")).agg(F.count("*").alias("n"), F.avg(distance(axes) * distance(axes)).alias("msd"))


def render_histogram(df: DataFrame, x: Column, y: Column, x0: float, y0: float, pixel: float) -> DataFrame:
    """Points counted by pixel."""
    return df.groupBy(F.floor((x - x0) / pixel).cast("int").alias("ix"), F.floor((y - y0) / pixel).cast("int").alias("iy")).agg(F.count("*").alias("n"))


def render_gaussian(df: DataFrame, x: str, y: str, sigma: str, x0: float, y0: float, pixel: float, reach: int = 4) -> DataFrame:
    """Each point as a normalised Gaussian stamped on the pixels within `reach` deviations, at pixel centres, summed by pixel."""
    span = lambda c, o: F.sequence(F.floor((F.col(c) - reach * F.col(sigma) - o) / pixel).cast("int"), F.floor((F.col(c) + reach * F.col(sigma) - o) / pixel).cast("int"))
    stamped = df.select(x, y, sigma, F.explode(span(x, x0)).alias("ix")).withColumn("iy", F.explode(span(y, y0)))
    dx = (F.col("ix") + 0.5) * pixel + x0 - F.col(x)
    dy = (F.col("iy") + 0.5) * pixel + y0 - F.col(y)
    s2 = F.col(sigma) * F.col(sigma)
    return stamped.groupBy("ix", "iy").agg(F.sum(F.exp(-(dx * dx + dy * dy) / (2 * s2)) / (2 * pi * s2) * pixel * pixel).alias("value"))


#: Fixed value of the likelihood rendering: the least likelihood of a point at a pixel.
LEAST_LIKELIHOOD = 1e-4


def render_likelihood(df: DataFrame, x: str, y: str, sigma: str, x0: float, y0: float, pixel: float, width: int, height: int, reach: int | None = None) -> DataFrame:
    """ix, iy, value of each of width x height pixels: the log likelihood of all points there, each a Gaussian cut at LEAST_LIKELIHOOD.

    Pixels are sampled at their corner x0 + ix * pixel. Deviations count as a pixel at least. A point adds to the pixels within `reach` of its own, six median
    deviations if none is given. Logarithms add up, so points are dealt to pixels and summed; pixels without a point near have the floor of all points.
    """
    spread = F.greatest(F.col(sigma).cast("double"), F.lit(float(pixel)))
    near = df.select(F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"), spread.alias("_s")).dropna()
    told = near.agg(F.count("*").alias("n"), F.percentile_approx("_s", 0.5, 100_000).alias("mid")).first()
    reach = reach if reach is not None else int(6 * (told["mid"] or 0) / pixel)
    floor = float(np.log(LEAST_LIKELIHOOD))
    step = F.sequence(F.lit(-reach), F.lit(reach))
    each = near.withColumn("ix", F.explode(F.transform(step, lambda d: (F.rint((F.col("_x") - x0) / pixel) + d).cast("int")))).where((F.col("ix") >= 0) & (F.col("ix") < width))
    each = each.withColumn("iy", F.explode(F.transform(step, lambda d: (F.rint((F.col("_y") - y0) / pixel) + d).cast("int")))).where((F.col("iy") >= 0) & (F.col("iy") < height))
    dx, dy = F.col("ix") * pixel + x0 - F.col("_x"), F.col("iy") * pixel + y0 - F.col("_y")
    value = -F.log(F.col("_s") * float(np.sqrt(2 * pi))) - (dx * dx + dy * dy) / (2 * F.col("_s") * F.col("_s"))
    above = each.groupBy("ix", "iy").agg(F.sum(F.greatest(value, F.lit(floor)) - floor).alias("_more"))
    return _grid(df, width, height).join(above, ["ix", "iy"], "left").select("ix", "iy", (F.coalesce("_more", F.lit(0.0)) + told["n"] * floor).alias("value"))


def _grid(df: DataFrame, width: int, height: int) -> DataFrame:
    return df.sparkSession.range(width * height).select((F.col("id") % width).cast("int").alias("ix"), F.floor(F.col("id") / width).cast("int").alias("iy"))


def render_density(df: DataFrame, x: str, y: str, row_id: str, x0: float, y0: float, pixel: float, width: int, height: int, n: int = 10) -> DataFrame:
    """ix, iy, value of each of width x height pixels: the slope of the count of points (from 0) over the squared distances of the pixel's n nearest."""
    at = _grid(df, width, height).withColumns({"_pixel": F.col("iy").cast("long") * width + F.col("ix"), "x": (F.col("ix") + 0.5) * pixel + x0, "y": (F.col("iy") + 0.5) * pixel + y0})
    near = nearest_k(at, df.select(F.col(row_id).alias("_id"), F.col(x).alias("x"), F.col(y).alias("y")), ("x", "y"), n, pixel, "_pixel", "_id")
    square = F.transform("near", lambda v: v["distance"] * v["distance"])
    total = lambda f: F.aggregate(F.transform(square, f), F.lit(0.0), lambda a, v: a + v)
    value = F.coalesce(F.try_divide(total(lambda d, i: d * i), total(lambda d: d * d)), F.lit(0.0))
    return near.select((F.col("_pixel") % width).cast("int").alias("ix"), F.floor(F.col("_pixel") / width).cast("int").alias("iy"), value.alias("value"))


def render_histogram_3d(df: DataFrame, axes: Sequence[Column], origin: Sequence[float], pixel: float, depth: float) -> DataFrame:
    """Points counted by voxel: `pixel` wide and high, `depth` deep."""
    at = [F.floor((c - o) / step).cast("int").alias(f"i{n}") for c, o, step, n in zip(axes, origin, (pixel, pixel, depth), "xyz", strict=True)]
    return df.groupBy(*at).agg(F.count("*").alias("n"))


def render_gaussian_3d(df: DataFrame, axes: Sequence[str], sigma: str, sigma_z: str, origin: Sequence[float], pixel: float, depth: float, reach: int = 4) -> DataFrame:
    """Each point as a normalised Gaussian (sigma in the plane, sigma_z along z) at the centres of the voxels within `reach`
    deviations, summed by voxel: ix, iy, iz, value."""
    parts = list(zip(axes, (sigma, sigma, sigma_z), origin, (pixel, pixel, depth), "xyz", strict=True))
    out = df.select(*axes, sigma, sigma_z)
    value = F.lit(1.0)
    for c, s, o, step, n in parts:
        low, high = (F.floor((F.col(c) + side * reach * F.col(s) - o) / step).cast("int") for side in (-1, 1))
        out = out.withColumn(f"i{n}", F.explode(F.sequence(low, high)))
        d = (F.col(f"i{n}") + 0.5) * step + o - F.col(c)
        value = value * F.exp(-d * d / (2 * F.col(s) * F.col(s))) / (F.sqrt(F.lit(2 * pi)) * F.col(s)) * step
    return out.groupBy("ix", "iy", "iz").agg(F.sum(value).alias("value"))


def octree_cells(df: DataFrame, axes: Sequence[str], origin: Sequence[float], size: float, depth: int) -> DataFrame:
    """Counts of points in the cells of every level of an octree (or quadtree), the root being one cube of `size`."""
    levels = F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("level")
    at = [F.floor((F.col(c) - o) / size * F.pow(F.lit(2.0), F.col("level"))).cast("long").alias(f"i{c}") for c, o in zip(axes, origin, strict=True)]
    return df.select(*axes, levels).groupBy("level", *at).agg(F.count("*").alias("n"))


def in_cone(dx: Column, dy: Column, dz: Column, azimuth: float, zenith: float, half_angle: float, reach: float) -> Column:
    """Whether a displacement lies in a cone around a direction, up to a distance."""
    from math import cos, sin

    r = F.sqrt(dx * dx + dy * dy + dz * dz)
    along = dx * (sin(zenith) * cos(azimuth)) + dy * (sin(zenith) * sin(azimuth)) + dz * cos(zenith)
    return (r <= reach) & (along >= r * cos(half_angle))


def drift(
    points: DataFrame, t: str, x: str, y: str, step: int, width: int, bin_size: float | None = None, shape: tuple[int, int] = (32, 32), origin: tuple[float, float] | None = None
) -> DataFrame:
    """window, n, dy, dx: shifts (in units of y and x) of overlapping time windows against the first, from histograms of their points.

    Points are counted by window and bin in Spark. A histogram has a fixed number of bins, so a window's is one row, and
    the first one, which all are compared with, is a small constant. Without a bin size and an origin (x first) the bins
    reach from each axis' least to its greatest value, the last one closed, so every point with both is counted; with
    them, points outside the grid are left out.
    """
    from collections.abc import Iterator

    import numpy as np
    import pandas as pd

    from photonflow.operators.kernels import registration_shift

    if (bin_size is None) != (origin is None):
        raise ValueError("give both a bin size and an origin, or none")
    rows, columns = shape
    last = F.floor(F.col(t) / step)
    first = F.greatest(F.lit(0), F.floor((F.col(t) - width) / step) + 1)
    if origin is None:
        points = points.where(~F.isnan(F.col(x).cast("double")) & ~F.isnan(F.col(y).cast("double")))
        x0, x1, y0, y1 = (float(v or 0) for v in points.agg(F.min(x), F.max(x), F.min(y), F.max(y)).first())
        wide, high = (x1 - x0) / columns or 1.0, (y1 - y0) / rows or 1.0
        inside = F.col(x).isNotNull() & F.col(y).isNotNull()
    else:
        (x0, y0), wide, high = origin, bin_size, bin_size
        inside = (F.col(x) >= x0) & (F.col(x) < x0 + columns * wide) & (F.col(y) >= y0) & (F.col(y) < y0 + rows * high)
    at = lambda c, low, size, bins: F.least(F.floor((F.col(c) - low) / size), F.lit(bins - 1))
    place = at(y, y0, high, rows) * columns + at(x, x0, wide, columns)
    counts = points.where(inside).select(F.explode(F.sequence(first, last)).alias("window"), place.cast("int").alias("place")).groupBy("window", "place").agg(F.count("*").alias("n"))
    images = counts.groupBy("window").agg(F.collect_list(F.struct("place", "n")).alias("cells"), F.sum("n").alias("n"))

    def image(cells) -> np.ndarray:
        out = np.zeros(rows * columns)
        for c in cells:
            out[c["place"]] = c["n"]
        return out.reshape(shape)

    start = images.orderBy("window").limit(1).collect()
    reference = image(start[0]["cells"]) if start else None

    def shift(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = [registration_shift(reference, image(c)) for c in part["cells"]]
            yield pd.DataFrame({"window": part["window"], "n": part["n"], "dy": [f[0] * high for f in found], "dx": [f[1] * wide for f in found]})

    return images.mapInPandas(shift, "window long, n long, dy double, dx double")
