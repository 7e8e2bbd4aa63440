"""Group aggregation over labels, bins, frames and masks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Columns summed over a clump; all others are averaged.
SUMMED = ("A", "Ag", "Ar", "nPhotons")
#: Least minimum: a group's minimum is capped at this.
CAP = 1e9


def weighted_mean(value: Column, error: Column) -> Column:
    """Inverse-variance weighted mean of a group."""
    w = F.try_divide(F.lit(1.0), error * error)
    return F.try_divide(F.sum(value * w), F.sum(w))


def weighted_error(error: Column) -> Column:
    return F.sqrt(F.try_divide(F.lit(1.0), F.sum(F.try_divide(F.lit(1.0), error * error))))


def merge_clumps(df: DataFrame, label: str = "clumpIndex", discard_trivial: bool = False, dense: bool = True) -> DataFrame:
    """One row a label: sums of SUMMED, inverse-variance means of columns that have an error_<column> (whose error is
    merged as well), means of all other numeric columns, and n. Labels below 1 go if discard_trivial; otherwise, if
    dense, labels 0 to the largest all get a row, with zeros where there is nothing."""
    kinds = dict(df.dtypes)
    numeric = [c for c in df.columns if c != label and kinds[c] in ("tinyint", "smallint", "int", "bigint", "float", "double")]
    rows = df.where(F.col(label) >= 1) if discard_trivial else df
    outs = [F.count("*").alias("n")]
    for c in numeric:
        value = F.col(c).cast("double")
        if c in SUMMED:
            outs.append(F.sum(value).alias(c))
        elif f"error_{c}" in numeric:
            outs += [weighted_mean(value, F.col(f"error_{c}").cast("double")).alias(c), weighted_error(F.col(f"error_{c}").cast("double")).alias(f"error_{c}")]
        elif not (c.startswith("error_") and c[6:] in numeric):
            outs.append(F.avg(value).alias(c))
    merged = rows.groupBy(label).agg(*outs)
    return merged if discard_trivial or not dense else densify(merged, label)


def densify(df: DataFrame, label: str) -> DataFrame:
    """A row for every label from 0 to the largest, zeros where there was none."""
    top = df.agg(F.max(label).cast("long")).first()[0]
    labels = df.sparkSession.range(0 if top is None else top + 1).withColumnRenamed("id", label)
    return labels.join(df.withColumn(label, F.col(label).cast("long")), label, "left").fillna(0)


def coalesce_clumps(df: DataFrame, label: str, t: str, value: str) -> DataFrame:
    """A clump's first frame, number of frames, duration, sum and mean of a value."""
    return df.groupBy(label).agg(
        F.least(F.min(t).cast("double"), F.lit(CAP)).alias("tIndex"), F.count("*").alias("nFrames"), (F.max(t) - F.min(t) + 1).alias("burstDuration"),
        F.sum(value).alias("nPhotons"), F.avg(value).alias("photonRate"),
    )


def cluster_count_vs_time(df: DataFrame, label: str, t: str, low: int, high: int, step: int, stop: int) -> DataFrame:
    """For growing windows 0 < t < k * step: labels (0 aside) with at least `low` and at least `high` points in them.

    Each label's points are counted by step first; running sums over these few rows replace a join with every window.
    """
    steps = df.where((F.col(t) > 0) & (F.col(t) < stop) & (F.col(label) != 0)).groupBy(label, (F.floor(F.col(t) / step) + 1).alias("k")).count()
    # a window is open: a point at exactly k * step is in from the next window on, as floor(t / step) + 1 has it
    seen = steps.withColumn("seen", F.sum("count").over(Window.partitionBy(label).orderBy("k")))
    gone = seen.select("k", ((F.col("seen") >= low) & (F.col("seen") - F.col("count") < low)).cast("long").alias("a"), ((F.col("seen") >= high) & (F.col("seen") - F.col("count") < high)).cast("long").alias("b"))
    new = gone.groupBy("k").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    windows = df.sparkSession.range(1, -(-stop // step) + 1).withColumnRenamed("id", "k")
    order = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)  # a row a window
    return windows.join(new, "k", "left").select((F.col("k") * step).alias("t"), F.coalesce(F.sum("a").over(order), F.lit(0)).alias("n_low"), F.coalesce(F.sum("b").over(order), F.lit(0)).alias("n_high"))


def histogram(df: DataFrame, value: Column, edges: int, left: float, right: float, normalize: bool = False) -> DataFrame:
    """bin, bin_left, n over `edges` evenly spaced edges: edges - 1 bins, the last closed at its right end."""
    bins = edges - 1
    width = (right - left) / bins
    v = df.select(value.cast("double").alias("v")).where((F.col("v") >= left) & (F.col("v") <= right))
    counts = v.groupBy(F.least(F.floor((F.col("v") - left) / width), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    out = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).join(counts, "bin", "left").fillna(0, ["n"])
    out = out.select("bin", (left + F.col("bin") * width).alias("bin_left"), "n")
    return out.withColumn("density", F.try_divide(F.col("n"), F.sum("n").over(Window.partitionBy()) * width)) if normalize else out


def binned(df: DataFrame, by: Column, value: Column, left: float, width: float, bins: int) -> DataFrame:
    """Count, mean, population deviation and median of a value in half-open bins of another; empty bins have zeros."""
    rows = df.select(F.floor((by - left) / width).cast("int").alias("bin"), value.cast("double").alias("v")).where((F.col("bin") >= 0) & (F.col("bin") < bins) & ~F.isnan("v"))
    found = rows.groupBy("bin").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.median("v").alias("median"))
    return df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).join(found, "bin", "left").fillna(0)


def pixel_statistics(frames: DataFrame, key: str, pixels: str) -> DataFrame:
    """Variance (population), mean, median and mode (the smallest of equally frequent values) of each frame's pixel array.

    All of it happens inside the row: frames are never exploded.
    """
    p = F.transform(F.col(pixels), lambda x: x.cast("double"))
    n = F.size(p)
    mean = F.aggregate(p, F.lit(0.0), lambda a, x: a + x) / n
    out = frames.select(key, F.array_sort(p).alias("p"), mean.alias("mean"))
    n = F.size("p")
    var = F.aggregate("p", F.lit(0.0), lambda a, x: a + (x - F.col("mean")) * (x - F.col("mean"))) / n
    at = lambda i: F.element_at("p", i.cast("int"))
    median = (at(F.floor((n + 1) / 2)) + at(F.floor(n / 2) + 1)) / 2
    start = F.struct(F.lit(None).cast("double").alias("last"), F.lit(0).alias("run"), F.lit(None).cast("double").alias("mode"), F.lit(0).alias("best"))

    def step(a, x):
        run = F.when(a["last"] == x, a["run"] + 1).otherwise(F.lit(1))
        return F.struct(x.alias("last"), run.alias("run"), F.when(run > a["best"], x).otherwise(a["mode"]).alias("mode"), F.greatest(run, a["best"]).alias("best"))

    return out.select(key, var.alias("variance"), "mean", median.alias("median"), F.aggregate("p", start, step)["mode"].alias("mode"))


def projection(frames: DataFrame, pixels: str, kind: str, keys: Sequence[str] = ()) -> DataFrame:
    """Mean, Sum, Max, Min, Std (population) or Median over frames, pixel by pixel (position, value)."""
    how = {"Mean": F.avg, "Sum": F.sum, "Max": F.max, "Min": F.min, "Std": F.stddev_pop, "Median": F.median}[kind]
    return frames.select(*keys, F.posexplode(pixels).alias("pos", "v")).groupBy(*keys, "pos").agg(how(F.col("v").cast("double")).alias("value"))


def colocalisation(df: DataFrame, a: Column, b: Column, t_a: float, t_b: float) -> DataFrame:
    """One row: Pearson, overlap, thresholded Manders of both, in one pass over the pixels."""
    rows = df.select(a.cast("double").alias("a"), b.cast("double").alias("b"))
    hit = lambda x, test: F.try_divide(F.sum(F.when(test, F.col(x)).otherwise(0.0)), F.sum(x))
    return rows.agg(
        F.corr("a", "b").alias("pearson"), F.try_divide(F.sum(F.col("a") * F.col("b")), F.sqrt(F.sum(F.col("a") * F.col("a")) * F.sum(F.col("b") * F.col("b")))).alias("overlap"),
        hit("a", F.col("b") > t_b).alias("manders_a"), hit("b", F.col("a") > t_a).alias("manders_b"),
    )


def mutual_information(df: DataFrame, a: Column, b: Column, bins: int, low: float, high: float) -> DataFrame:
    """Mutual information (nats) of two values from a joint histogram of bins x bins cells."""
    cell = lambda v: F.least(F.greatest(F.floor((v - low) / ((high - low) / bins)), F.lit(0)), F.lit(bins - 1))
    joint = df.groupBy(cell(a).alias("i"), cell(b).alias("j")).agg(F.count("*").cast("double").alias("n"))  # bins ** 2 rows at most
    n = F.sum("n").over(Window.partitionBy())
    p = joint.select((F.col("n") / n).alias("p"), (F.sum("n").over(Window.partitionBy("i")) / n).alias("pi"), (F.sum("n").over(Window.partitionBy("j")) / n).alias("pj"))
    return p.agg(F.sum(F.col("p") * F.ln(F.col("p") / (F.col("pi") * F.col("pj")))).alias("mutual_information"))


def centred_moments(df: DataFrame, x: str, y: str, order: int = 4) -> DataFrame:
    """mean((x - mx)^i (y - my)^j) for i, j up to `order`: the means first, then one pass for all moments."""
    m = df.agg(F.avg(x), F.avg(y)).first()
    dx, dy = F.col(x) - m[0], F.col(y) - m[1]
    pairs = [(i, j) for i in range(order + 1) for j in range(order + 1)]
    row = df.agg(*(F.avg(F.pow(dx, F.lit(i)) * F.pow(dy, F.lit(j))).alias(f"m_{i}_{j}") for i, j in pairs))
    return row.select(F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"m_{i}_{j}").alias("moment")) for i, j in pairs))).alias("r")).select("r.*")


def cluster_moments(df: DataFrame, label: str, axes: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """Count, centroid, sample deviations, covariances and gyration radius of each label above 0: one aggregation."""
    outs = [F.count("*").alias("count"), *(F.avg(c).alias(f"{c}_mean") for c in axes), *(F.stddev_samp(c).alias(f"sigma_{c}") for c in axes)]
    outs += [F.covar_samp(a, b).alias(f"cov_{a}{b}") for i, a in enumerate(axes) for b in axes[i + 1 :]]
    square = sum((F.var_pop(c) for c in axes), F.lit(0.0))
    return df.where(F.col(label) > 0).groupBy(label).agg(*outs, F.sqrt(square).alias("gyrationRadius"))


def image_bounds(df: DataFrame, axes: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    return df.agg(*(f(c).alias(f"{c}{n}") for c in axes for f, n in ((F.min, "0"), (F.max, "1"))))


def dark_and_variance(frames: DataFrame, pixels: str, dark_limit: float, variance_limit: float, blemish: float) -> DataFrame:
    """Mean and variance (population) of each pixel over all frames; pixels beyond either limit get the blemish variance."""
    each = frames.select(F.posexplode(pixels).alias("pos", "v")).groupBy("pos").agg(F.avg(F.col("v").cast("double")).alias("dark"), F.var_pop(F.col("v").cast("double")).alias("variance"))
    bad = (F.col("dark") > dark_limit) | (F.col("variance") > variance_limit)
    return each.withColumn("variance", F.when(bad, F.lit(blemish)).otherwise(F.col("variance")))


def average_by_step(frames: DataFrame, z: Column, pixels: str, keys: Sequence[str] = ()) -> DataFrame:
    """Mean of each pixel over the frames of one z, rounded to three decimals."""
    each = frames.select(*keys, F.bround(z, 3).alias("z"), F.posexplode(pixels).alias("pos", "v"))
    return each.groupBy(*keys, "z", "pos").agg(F.avg(F.col("v").cast("double")).alias("value"))


def tile_pyramid(pixels: DataFrame, levels: int, keys: Sequence[str] = ()) -> DataFrame:
    """Pixels (x, y, v) averaged over squares of 2 ** level, for all levels at once."""
    spread = pixels.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels))))
    return spread.groupBy(*keys, "level", F.floor(F.col("x") / F.pow(F.lit(2.0), "level")).alias("tx"), F.floor(F.col("y") / F.pow(F.lit(2.0), "level")).alias("ty")).agg(F.avg("v").alias("value"))


def ranked(df: DataFrame, key: str, value: str) -> DataFrame:
    """Rows with a value, with `_rank` from 0 in order of it inside each key, and `_size`, how many the key has.

    Rows are dealt by range, so that a key with most rows is ranked by many tasks; only counts by range meet.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.where(F.col(value).isNotNull()).repartitionByRange(parts, key, value).withColumn("_part", F.spark_partition_id()).checkpoint()
    counts = placed.groupBy(key, "_part").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(key)
    counts = counts.select(F.col(key).alias("_key"), F.col("_part").alias("_in"), (F.sum("_n").over(w.orderBy("_part")) - F.col("_n")).alias("_before"), F.sum("_n").over(w).alias("_size"))
    joined = placed.join(counts, placed[key].eqNullSafe(counts["_key"]) & (placed["_part"] == counts["_in"]))
    place = F.row_number().over(Window.partitionBy(key, "_part").orderBy(value)) - 1
    return joined.withColumn("_rank", F.col("_before") + place).drop("_part", "_key", "_in", "_before")


def exact_median(df: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """key, out: the median of a column, the mean of the two middle ones where they are two."""
    middle = ranked(df.select(key, value), key, value).where((F.col("_rank") == F.floor((F.col("_size") - 1) / 2)) | (F.col("_rank") == F.floor(F.col("_size") / 2)))
    return middle.groupBy(key).agg(F.avg(value).alias(out))


def median_deviation(df: DataFrame, label: str, axes: Sequence[str], out: str = "median_abs_deviation") -> DataFrame:
    """label, out: the median distance of a label's points from the point of their medians."""
    rows = df.select(label, *axes)
    square = F.lit(0.0)
    for c in axes:
        rows = rows.join(exact_median(df, label, c, f"_{c}"), label)
        square = square + (F.col(c) - F.col(f"_{c}")) * (F.col(c) - F.col(f"_{c}"))
    return exact_median(rows.select(label, F.sqrt(square).alias("_d")), label, "_d", out)


def cumulative_histogram(df: DataFrame, value: str) -> DataFrame:
    """bins, counts: all values in order, and how far along each is, from 0 to 1."""
    rows = ranked(df.select(F.lit(0).alias("_all"), value), "_all", value)
    return rows.select(F.col(value).alias("bins"), F.coalesce(F.try_divide(F.col("_rank"), F.col("_size") - 1), F.lit(0.0)).cast("double").alias("counts"))
