"""Near points met in numpy, without a row for each pair: points are packed by grid cell into tiles, tiles meet in joins, and what is wanted of
their pairs (counts, sums, best ones) is added up in the task.

The number of pairs may grow with the square of a cell's points, but what is held in a task is two tiles and some sums, and what is shuffled is a
tile beside each tile it meets: a row of MOST points stands for as many as MOST * MOST pairs.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterator, Sequence
from itertools import product
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from photonflow.sources.shared import kept

#: Points of a tile, about.
MOST = 4096
#: A crowded cell is parted into so many along an axis at most.
FINEST = 16
#: Pairs whose distances are worked out at once.
AREA = 1 << 17
#: Tiles whose sums a task holds at once.
HELD = 32


class Tile:
    """ids, and coordinates and further values by column (n, ...)."""

    def __init__(self, number: int, ids: np.ndarray, at: np.ndarray):
        self.number, self.ids, self.at = number, ids, at


def tiles(points: DataFrame, row_id: str, axes: Sequence[str], size: float, keys: Sequence[str] = (), values: Sequence[str] = ()) -> DataFrame:
    """_tile (a number), keys, _cell, _ids, _at (an array for each axis and value), _box (each axis' ends): points packed by cells of `size`.

    Crowded cells are parted in space, and what is still crowded (points of one place) by a hash. Points without an id or a key, or with an axis that is null or not finite, are near nothing and left out.
    """
    names = [f"_{i}" for i in range(len(axes) + len(values))]
    held = points.select(F.col(row_id).alias("_id"), *(F.col(k).alias(f"_key_{k}") for k in keys), *(F.col(c).cast("double").alias(n) for c, n in zip((*axes, *values), names, strict=True)))
    held = held.dropna(subset=["_id", *(f"_key_{k}" for k in keys)])
    for n in names[: len(axes)]:
        held = held.where(F.abs(n) < float("inf"))
    held = kept(held.withColumn("_cell", F.array(*(F.floor(F.col(n) / size).cast("long") for n in names[: len(axes)]))), "points")
    place, dims = [*(f"_key_{k}" for k in keys), "_cell"], len(axes)
    crowded = held.groupBy(*place).agg(F.count("*").alias("_n")).where(F.col("_n") > MOST)
    parts = F.least(F.ceil(F.pow(F.col("_n") / MOST, F.lit(1 / dims))), F.lit(FINEST))
    dealt = held.join(crowded.select(*place, parts.alias("_parts")), place, "left").withColumn("_parts", F.coalesce("_parts", F.lit(1)))
    part = F.when(F.col("_parts") > 1, F.array(*(F.floor(F.col(n) * F.col("_parts") / size).cast("long") for n in names[:dims])))
    dealt = kept(dealt.withColumn("_part", F.coalesce(part, F.array().cast("array<long>"))), "points")
    place = [*place, "_part"]
    crowded = dealt.groupBy(*place).agg(F.count("*").alias("_n")).where(F.col("_n") > MOST)
    chunk = F.coalesce(F.pmod(F.xxhash64("_id", *names), F.ceil(F.col("_n") / MOST)), F.lit(0))
    packed = dealt.join(crowded, place, "left").groupBy(*place, chunk.alias("_chunk")).agg(F.collect_list(F.struct("_id", *names)).alias("_p"))
    column = lambda n: F.transform("_p", lambda p: p[n])
    out = packed.select(F.monotonically_increasing_id().alias("_tile"), *place[:-1], column("_id").alias("_ids"), F.array(*map(column, names)).alias("_at"))
    return kept(out.withColumn("_box", F.array(*(F.array(F.array_min(F.col("_at")[i]), F.array_max(F.col("_at")[i])) for i in range(dims)))), "tiles")


def reach(radius: float, size: float, dims: int) -> list[tuple[int, ...]]:
    """Steps between cells of `size` that may hold points closer than the radius."""
    far = ceil(radius / size)
    limit = (radius / size) ** 2 * (1 + 1e-9)
    return [m for m in product(range(-far, far + 1), repeat=dims) if sum(max(abs(k) - 1, 0) ** 2 for k in m) < limit]


def fine(radius: float) -> float:
    """A cell's size for a radius; a hair wider, so that rounding never puts near points one cell further apart."""
    return radius * (1 + 1e-9)


def meetings(left: DataFrame, right: DataFrame, radius: float, size: float, once: bool = False, apart: bool = False) -> DataFrame:
    """Rows of two tiles (columns _a, a_ids, a_at and _b, b_ids, b_at) in cells that are near, of equal keys where `right` has any; with `once`, of the
    tiles of one table each unordered pair once, a tile with itself too; with `apart`, none of one cell."""
    keys = [c for c in right.columns if c.startswith("_key_")]
    first = right.select("_cell").first()
    moves = reach(radius, size, len(first["_cell"])) if first else [(0,)]
    near = right.select(*keys, F.col("_tile").alias("_b"), F.col("_box").alias("_b_box"), "_cell", F.explode(F.array(*(F.array(*(F.lit(k).cast("long") for k in m)) for m in moves))).alias("_move"))
    if apart:
        near = near.where(F.exists("_move", lambda m: m != 0))
    near = near.withColumn("_cell", F.zip_with("_cell", "_move", lambda c, m: c + m)).drop("_move")
    pairs = left.select(*keys, "_cell", F.col("_tile").alias("_a"), F.col("_box").alias("_a_box")).join(near, [*keys, "_cell"])
    gaps = F.zip_with("_a_box", "_b_box", lambda a, b: F.greatest(a[0] - b[1], b[0] - a[1], F.lit(0.0)))
    pairs = pairs.where(F.aggregate(gaps, F.lit(0.0), lambda s, g: s + g * g) < radius * radius * (1 + 1e-9)).select("_a", "_b")
    if once:
        pairs = pairs.where("_a <= _b")
    spark = left.sparkSession
    # pairs of numbers are small beside the work that they mean, so they are dealt by number and not by size
    pairs = pairs.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism), *(["_a", "_b"] if once else ["_a"]))
    side = lambda t, n: t.select(F.col("_tile").alias(f"_{n}"), F.col("_ids").alias(f"{n}_ids"), F.col("_at").alias(f"{n}_at"))
    return pairs.join(side(right, "b"), "_b").join(side(left, "a"), "_a")


def read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Tile, Tile]]:
    def tile(batch: pa.RecordBatch, n: str) -> Callable[[int], Tile]:
        number, ids, at = (batch.column(batch.schema.get_field_index(c)) for c in (f"_{n}", f"{n}_ids", f"{n}_at"))
        number = number.to_numpy(zero_copy_only=False)
        all_ids, ends = ids.values.to_numpy(zero_copy_only=False), ids.offsets.to_numpy()
        axes = at.offsets.to_numpy()
        values, places = at.values.values.to_numpy(zero_copy_only=False), at.values.offsets.to_numpy()

        def one(i: int) -> Tile:
            columns = [values[places[k] : places[k + 1]] for k in range(axes[i], axes[i + 1])]
            return Tile(int(number[i]), all_ids[ends[i] : ends[i + 1]], np.stack(columns))

        return one

    for batch in batches:
        a, b = tile(batch, "a"), tile(batch, "b")
        for i in range(batch.num_rows):
            yield a(i), b(i)


def beside(a: Tile, b: Tile, radius: float, dims: int) -> Tile:
    """b's points that may be near any of a's."""
    low, high = a.at[:dims].min(axis=1)[:, None], a.at[:dims].max(axis=1)[:, None]
    gap = np.maximum(np.maximum(low - b.at[:dims], b.at[:dims] - high), 0)
    some = (gap * gap).sum(axis=0) < radius * radius * (1 + 1e-9)
    return b if some.all() else Tile(b.number, b.ids[some], b.at[:, some])


def distances(a: Tile, b: Tile, dims: int) -> Iterator[tuple[slice, np.ndarray]]:
    """Distances of a run of a's points to all of b's, run by run."""
    step = max(1, AREA // max(1, b.at.shape[1]))
    for s in range(0, a.at.shape[1], step):
        part, total = slice(s, s + step), None
        for k in range(dims):
            d = a.at[k, part, None] - b.at[k][None, :]
            d *= d
            total = d if total is None else np.add(total, d, out=total)
        yield part, np.sqrt(total, out=total)


def gathered(radius: float, dims: int, start: Callable[[Tile], object], add: Callable[[object, Tile, Tile], None], finish: Callable[[Tile, object], pa.RecordBatch]) -> Callable:
    """What a task does with rows of meetings(): a state for each of a's tiles, to which what is near of the tiles it meets is added. As tiles may come in any order
    and a state may be finished more than once, what is told of one point has to be put together after."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: OrderedDict[int, tuple[Tile, object]] = OrderedDict()
        for a, b in read(batches):
            if a.number not in states:
                if len(states) == HELD:
                    yield finish(*states.popitem(last=False)[1])
                states[a.number] = (a, start(a))
            states.move_to_end(a.number)
            first, state = states[a.number]
            near = beside(first, b, radius, dims)
            if len(near.ids):
                add(state, first, near)
        for state in states.values():
            yield finish(*state)

    return run


def pair_counts(radius: float, dims: int, bins: int, count: Callable[[np.ndarray, np.ndarray, Tile, Tile, slice], None]) -> Callable:
    """What a task does with rows of meetings(..., once=True): bin, n. `count` adds a run's pairs to the task's counts, by the run's distances; those
    of points of one id are infinite. Within a tile pairs come in both orders, a.at - b.at and back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, twice = np.zeros((2, bins), np.int64)
        for a, whole in read(batches):
            b = beside(a, whole, radius, dims)
            if not len(b.ids):
                continue
            same = a.number == b.number
            shared = same or len(np.intersect1d(a.ids, b.ids))
            for part, d in distances(a, b, dims):
                if shared:
                    d[a.ids[part, None] == b.ids] = np.inf
                count(twice if same else total, d, a, b, part)
        total += twice // 2
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some, pa.int32()), pa.array(total[some])], names=["bin", "n"])

    return run


def lists(rows: np.ndarray) -> pa.ListArray:
    """A list for each row of a matrix."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), pa.array(np.ascontiguousarray(rows).ravel()))


def neighbour_counts(points: DataFrame, others: DataFrame | None, axes: Sequence[str], bins: int, size: float, row_id: str, out: str, keys: Sequence[str] = ()) -> DataFrame:
    """keys, row_id, bin, <out>: of each point, how many of the others lie in each ring of `size`; rings without any are left out.

    Without others, the points of equal keys are counted around each other, a point at its own place too; others have no ids and no keys.
    """
    radius, dims = bins * size, len(axes)
    cell = fine(radius)
    mine = tiles(points, row_id, axes, cell, keys)
    theirs = mine if others is None else tiles(others.withColumn("_no", F.lit(0)), "_no", axes, cell)

    def add(counts: np.ndarray, a: Tile, b: Tile) -> None:
        for part, d in distances(a, b, dims):
            row, column = np.nonzero(d < radius)
            at = row * (bins + 1) + np.floor(d[row, column] / size).astype(np.int64)
            counts[part] += np.bincount(at, minlength=len(d) * (bins + 1)).reshape(-1, bins + 1)

    def finish(a: Tile, counts: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch([pa.array([a.number] * len(a.ids), pa.int64()), pa.array(a.ids), lists(counts)], names=["_tile", "id", "n"])

    kind = dict(points.dtypes)[row_id]
    found = meetings(mine, theirs, radius, cell).mapInArrow(gathered(radius, dims, lambda a: np.zeros((len(a.ids), bins + 1), np.int64), add, finish), f"_tile long, id {kind}, n array<long>")
    if keys:
        found = found.join(mine.select("_tile", *(F.col(f"_key_{k}").alias(k) for k in keys)), "_tile")
    each = found.select(*keys, F.col("id").alias(row_id), F.posexplode("n").alias("bin", "_n")).where("_n > 0")
    return each.groupBy(*keys, row_id, "bin").agg(F.sum("_n").alias(out))
