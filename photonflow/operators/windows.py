"""Analytic and sliding-frame operators over ordered rows of a series."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F


def track_velocity(df: DataFrame, clump: str, t: Sequence[str], x: str, y: str) -> DataFrame:
    """trackVelocity: mean length of the steps to the previous and the next point of the clump; clumpEdge: first or last."""
    w = Window.partitionBy(clump).orderBy(*t)
    step = lambda f: F.hypot(F.col(x) - f(x).over(w), F.col(y) - f(y).over(w))
    out = df.withColumns({"_a": step(F.lag), "_b": step(F.lead)})
    velocity = F.when(F.col("_a").isNull(), F.col("_b")).when(F.col("_b").isNull(), F.col("_a")).otherwise((F.col("_a") + F.col("_b")) / 2)
    return out.withColumns({"trackVelocity": F.coalesce(velocity, F.lit(0.0)), "clumpEdge": (F.col("_a").isNull() | F.col("_b").isNull()).cast("int")}).drop("_a", "_b")


def clump_size(df: DataFrame, clump: str) -> DataFrame:
    """clumpSize beside every row; counted before the join, so that a clump with most rows is not gathered."""
    return df.join(df.groupBy(clump).agg(F.count("*").alias("clumpSize")), clump, "left")


def offtime_cdf(df: DataFrame, site: str, frame: str) -> DataFrame:
    """Of each site, the gaps (frames between events, less one, above 0) in order, and the share of gaps up to each."""
    gaps = df.select(site, frame).distinct().withColumn("off", F.col(frame) - F.lag(frame).over(Window.partitionBy(site).orderBy(frame)) - 1).where("off > 0")
    counts = gaps.groupBy(site, "off").agg(F.count("*").alias("_k"))
    w = Window.partitionBy(site)
    running = F.sum("_k").over(w.orderBy("off").rowsBetween(Window.unboundedPreceding, 0))
    return counts.select(site, "off", (running / F.sum("_k").over(w)).alias("cdf"))


def frame_means(frames: DataFrame, keys: Sequence[str], t: str, values: Sequence[str], low: int, high: int, block: int | None = None) -> DataFrame:
    """keys, t, mean_<value>: of each frame (a row for each of keys and t), the mean of the values at t + low <= time <= t + high.

    values are pairs of columns sum_<value> and n_<value>, so that a frame may stand for many rows. Series are cut into blocks of `block` (eight
    times the reach, if none is given), each with the frames around it that its own reach to; a block's means are differences of its running sums, so
    a series of any length is done by many tasks and no frame is added up twice. A mean over nothing is null. Times are not null.
    """
    block = block or 8 * max(1, high - low, abs(low), abs(high))
    slim = frames.select(*keys, F.col(t).alias("_t"), *(F.col(f"{p}_{v}").cast("double").alias(f"{p}_{v}") for v in values for p in ("sum", "n")))
    place = lambda d: F.floor((F.col("_t") - d) / block).cast("long")
    dealt = slim.withColumn("_own", place(0)).withColumn("_block", F.explode(F.sequence(F.least(place(0), place(high)), F.greatest(place(0), place(low)))))

    names, reach = [*keys, "_block"], abs(low) + abs(high) + 1

    def means(group: pd.DataFrame) -> pd.DataFrame:
        """Of whole blocks in order: blocks are set so far apart on one axis that no reach crosses from one to the next."""
        change = group[names].ne(group[names].shift()) & ~(group[names].isna() & group[names].shift().isna())
        at = group["_t"].to_numpy()
        at = at - at.min() + change.any(axis=1).cumsum().to_numpy() * (np.ptp(at) + 2 * reach)
        mine = (group["_own"] == group["_block"]).to_numpy()
        begin, end = np.searchsorted(at, at[mine] + low, "left"), np.searchsorted(at, at[mine] + high, "right")
        out = group.loc[mine, [*keys, "_t"]].copy()
        for v in values:
            total, n = (np.concatenate([[0.0], np.cumsum(np.nan_to_num(group[f"{p}_{v}"].to_numpy(float)))]) for p in ("sum", "n"))
            count = n[end] - n[begin]
            out[f"mean_{v}"] = np.where(count > 0, (total[end] - total[begin]) / np.where(count > 0, count, 1), np.nan)
        return out

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for part in parts:
            part = part if rest is None else pd.concat([rest, part], ignore_index=True)
            last = part[names].iloc[-1]
            same = np.logical_and.reduce([part[c].eq(last[c]) | (part[c].isna() & pd.isna(last[c])) for c in names])
            begin = len(part) - int(np.argmin(same[::-1])) if not same.all() else 0
            if begin:
                yield means(part.iloc[:begin])
            rest = part.iloc[begin:]
        if rest is not None and len(rest):
            yield means(rest)

    kinds = dict(slim.dtypes)
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), f"_t {kinds['_t']}", *(f"mean_{v} double" for v in values)])
    found = dealt.repartition(*names).sortWithinPartitions(*names, "_t").mapInPandas(run, schema)
    return found.select(*keys, F.col("_t").alias(t), *(F.when(~F.isnan(f"mean_{v}"), F.col(f"mean_{v}")).alias(f"mean_{v}") for v in values))


def sliding_mean(df: DataFrame, key: str, t: str, value: str, start: int, stop: int, block: int | None = None) -> DataFrame:
    """background: mean of the series' values at start <= frame - t < stop; corrected: value less background. Frames are whole numbers; both are null
    where the frame or the series is.

    Rows are added up by frame before they are shuffled, means are those of frame_means(), and come back by a join on series and frame.
    """
    frames = df.where(F.col(key).isNotNull() & F.col(t).isNotNull()).groupBy(key, t).agg(F.sum(F.col(value).cast("double")).alias("sum_v"), F.count(value).alias("n_v"))
    means = frame_means(frames, [key], t, ["v"], start, stop - 1, block).withColumnRenamed("mean_v", "background")
    return df.join(means, [key, t], "left").select(*df.columns, "background", (F.col(value) - F.col("background")).alias("corrected"))


def sliding_percentile(df: DataFrame, key: str, t: Sequence[str], value: str, before: int, after: int, share: float) -> DataFrame:
    """The value of rank int(n * share) among the n rows of the window of rows around each row."""
    w = Window.partitionBy(key).orderBy(*t).rowsBetween(-before, after)
    held = F.array_sort(F.collect_list(value).over(w))
    return df.withColumn("_held", held).withColumn("percentile", F.element_at("_held", (F.floor(F.size("_held") * share) + 1).cast("int"))).drop("_held")


def runs(df: DataFrame, key: str, t: Sequence[str], flag: Column, least: int = 1) -> DataFrame:
    """Gaps and islands: contiguous rows of a series whose flag is true: key, start, stop, n; runs of `least` rows or more."""
    w = Window.partitionBy(key).orderBy(*t)
    marked = df.withColumn("_flag", flag.cast("int")).withColumn("_run", F.sum(1 - F.col("_flag")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.where("_flag = 1").groupBy(key, "_run").agg(F.min(t[0]).alias("start"), F.max(t[0]).alias("stop"), F.count("*").alias("n")).where(F.col("n") >= least).drop("_run")


def sessions(df: DataFrame, key: str, t: str, gap: int) -> DataFrame:
    """Groups of a series' rows with no gap above `gap`: key, start, stop, n."""
    w = Window.partitionBy(key).orderBy(t)
    new = F.coalesce((F.col(t) - F.lag(t).over(w) > gap).cast("int"), F.lit(1))
    marked = df.withColumn("_new", new).withColumn("_group", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(key, "_group").agg(F.min(t).alias("start"), F.max(t).alias("stop"), F.count("*").alias("n")).drop("_group")


def autocorrelation_shift(df: DataFrame, key: str, t: str, value: str, lag: int) -> DataFrame:
    """Mean product of a series' deviations at a lag of so many rows, over its variance."""
    w = Window.partitionBy(key).orderBy(t)
    m = df.withColumn("_d", F.col(value) - F.avg(value).over(Window.partitionBy(key))).withColumn("_e", F.lag("_d", lag).over(w))
    return m.groupBy(key).agg(F.try_divide(F.sum(F.col("_d") * F.col("_e")), F.sum(F.col("_d") * F.col("_d"))).alias("autocorrelation"))


def resample(df: DataFrame, key: str, z: str, value: str, step: float) -> DataFrame:
    """A series' values on an even grid from its least z, by linear interpolation: each row fills the grid up to the next.

    A z that repeats within a series has no value of its own; such rows raise an error when the plan runs.
    """
    w = Window.partitionBy(key).orderBy(z)
    marked = df.withColumns({"_z0": F.min(z).over(Window.partitionBy(key)), "_next": F.lead(z).over(w), "_to": F.lead(value).over(w)}).where("_next is not null")
    marked = marked.where(F.when(F.col("_next") == F.col(z), F.raise_error(F.lit("a z value repeats")).cast("boolean")).otherwise(F.lit(True)))
    first, last = F.ceil((F.col(z) - F.col("_z0")) / step), F.ceil((F.col("_next") - F.col("_z0")) / step) - 1
    grid = marked.where(first <= last).withColumn("k", F.explode(F.sequence(first, last)))
    at = F.col("_z0") + F.col("k") * step
    share = (at - F.col(z)) / (F.col("_next") - F.col(z))
    return grid.select(key, "k", at.alias(z), (F.col(value) + share * (F.col("_to") - F.col(value))).alias(value))


def tracks(df: DataFrame, clump: str, t: str, axes: Sequence[str]) -> DataFrame:
    """A row a track: its first and last frame, points, path length, net displacement, and mean speed over its frames."""
    w = Window.partitionBy(clump).orderBy(t)
    square = lambda f: sum(((F.col(c) - f(c)) * (F.col(c) - f(c)) for c in axes), F.lit(0.0))
    steps = df.withColumn("_step", F.coalesce(F.sqrt(square(lambda c: F.lag(c).over(w))), F.lit(0.0)))
    ends = [F.struct(t, *axes)]
    found = steps.groupBy(clump).agg(F.count("*").alias("n"), F.min(ends[0]).alias("_a"), F.max(ends[0]).alias("_b"), F.sum("_step").alias("path"))
    net = F.sqrt(sum(((F.col(f"_b.{c}") - F.col(f"_a.{c}")) * (F.col(f"_b.{c}") - F.col(f"_a.{c}")) for c in axes), F.lit(0.0)))
    return found.select(clump, "n", F.col(f"_a.{t}").alias("start"), F.col(f"_b.{t}").alias("stop"), "path", net.alias("displacement"), F.try_divide(F.col("path"), F.col(f"_b.{t}") - F.col(f"_a.{t}")).alias("speed"))


def jump_histogram(df: DataFrame, clump: str, t: str, axes: Sequence[str], size: float) -> DataFrame:
    """bin, n: lengths of the steps between consecutive points of a track, in bins of `size`."""
    w = Window.partitionBy(clump).orderBy(t)
    step = F.sqrt(sum(((F.col(c) - F.lag(c).over(w)) * (F.col(c) - F.lag(c).over(w)) for c in axes), F.lit(0.0)))
    return df.select(F.floor(step / size).cast("long").alias("bin")).where("bin is not null").groupBy("bin").agg(F.count("*").alias("n"))
