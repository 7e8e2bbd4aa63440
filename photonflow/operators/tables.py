"""Table algebra: filters, projections, unions, label joins, channels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from photonflow.sources.shared import shared_dir

#: Fixed values of the channel filter: least share of the channel, most of another, weight of the normaliser.
P_DYE, P_OTHER, P_NORM = 0.1, 0.1, 0.01
#: Ids listed in a filter as literals; longer lists become a join.
LISTED = 1000


def filter_table(df: DataFrame, filters: Mapping[str, Sequence[float]]) -> DataFrame:
    """Rows with low < column < high for every filter: both ends are open, and null and NaN fail. Unknown columns raise KeyError."""
    test = F.lit(True)
    for name, bounds in filters.items():
        if name not in df.columns:
            raise KeyError(name)
        low, high = bounds
        test = test & (F.col(name) > low) & (F.col(name) < high)
    return df.where(test)


def filter_by_ids(df: DataFrame, id_column: str, ids: Sequence[int]) -> DataFrame:
    """Rows whose id is listed. A long list becomes a semi join that Spark sizes itself."""
    if len(ids) <= LISTED:
        return df.where(F.col(id_column).isin(list(ids)))
    wanted = df.sparkSession.createDataFrame([(i,) for i in set(ids)], [id_column])
    return df.join(wanted, id_column, "left_semi")


def select_columns(df: DataFrame, keys: str) -> DataFrame:
    """Columns named in a string, between white space."""
    return df.select(*keys.split())


def select_rows(df: DataFrame, rows: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Rows whose row_id is in `rows`, as often as it is there."""
    return rows.select(row_id).join(df, row_id)


def concatenate(*tables: DataFrame) -> DataFrame:
    """Union of all rows over the columns that all tables have, sorted by name, and concatSource: the table's number."""
    common = sorted(set.intersection(*(set(t.columns) for t in tables)))
    parts = [t.select(*common, F.lit(float(i)).alias("concatSource")) for i, t in enumerate(tables)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def aggregate_positional(tables: Sequence[DataFrame], suffixes: Sequence[str], row_id: str = "row_id") -> DataFrame:
    """Tables of equal length side by side, matched on row_id (a position given at ingest). Of equal names the last stays."""
    out = None
    for t, suffix in zip(tables, suffixes, strict=True):
        named = t.select(row_id, *(F.col(c).alias(f"{c}{suffix}") for c in t.columns if c != row_id))
        out = named if out is None else out.drop(*(c for c in named.columns if c != row_id)).join(named, row_id)
    return out


def add_measurements_by_label(points: DataFrame, measurements: DataFrame, label: str) -> DataFrame:
    """points with every numeric measurement as <label>_<column>; 0 where no measurement has the label.

    Measurements are taken as one row a label; Spark broadcasts them only if it finds them small.
    """
    kinds = dict(measurements.dtypes)
    numeric = [c for c in measurements.columns if c != label and kinds[c] in ("tinyint", "smallint", "int", "bigint", "float", "double")]
    right = measurements.select(label, *(F.col(c).alias(f"{label}_{c}") for c in numeric))
    return points.join(right, label, "left").fillna(0, [f"{label}_{c}" for c in numeric])


def drop_small_labels(points: DataFrame, label: str, minimum: int, count_name: str = "NEvents") -> DataFrame:
    """Labels of fewer than `minimum` points become 0; count_name holds the label's points, 0 for label 0.

    Counts come from a pre-aggregated group and a join, so that a label with most of the points is never in one task.
    """
    counts = points.where(F.col(label) != 0).groupBy(label).agg(F.count("*").alias(count_name)).where(F.col(count_name) >= minimum)
    out = points.join(counts.withColumn("_kept", F.lit(True)), label, "left")
    return out.withColumns({label: F.when(F.col("_kept"), F.col(label)).otherwise(0).cast(dict(points.dtypes)[label]), count_name: F.coalesce(count_name, F.lit(0))}).drop("_kept")


def pixel_index(x: Column, origin: float, voxel: float, point_origin: float = 0.0) -> Column:
    return F.floor((x + (point_origin - origin)) / voxel).cast("int")


def labels_from_image(points: DataFrame, pixels: DataFrame, origin: Sequence[float], voxel: Sequence[float], label: str = "objectID", minimum: int = 1) -> DataFrame:
    """Points (x, y, z) with the label of the voxel they lie in (pixels: ix, iy, iz, label); 0 outside and for labels of too few points."""
    at = points.withColumns({f"i{c}": pixel_index(F.col(c), o, v) for c, o, v in zip("xyz", origin, voxel, strict=True)})
    marked = at.join(pixels.select("ix", "iy", "iz", F.col("label").alias(label)), ["ix", "iy", "iz"], "left").fillna(0, [label]).drop("ix", "iy", "iz")
    return drop_small_labels(marked, label, minimum)


def colour_filter(df: DataFrame, channel: str | None, channels: Sequence[str], own: float = P_DYE, other: float = P_OTHER) -> DataFrame:
    """Rows that belong to a channel by their p_<channel> columns: its share is above `own` and no other's reaches `other`.

    An unknown channel (or None) selects all rows.
    """
    if channel not in channels:
        return df
    total = P_NORM * F.col("ColourNorm")
    for c in channels:
        total = total + F.col(f"p_{c}")
    others = [F.col(f"p_{c}") for c in channels if c != channel]
    most = F.lit(0.0) if not others else others[0] if len(others) == 1 else F.greatest(*others)
    return df.where((F.try_divide(F.col(f"p_{channel}"), total) > own) & (F.try_divide(most, total) < other))


def time_blocks(df: DataFrame, size: int, t: str = "t") -> DataFrame:
    """Alternating blocks of time as two pseudo channels: p_block0 is 1 in odd blocks, p_block1 in even ones."""
    block = (F.floor(F.col(t) / size) % 2).cast("double")
    return df.drop(*(c for c in df.columns if c.startswith("p_"))).withColumns({"block_id": block, "p_block0": block, "p_block1": 1 - block, "ColourNorm": F.lit(1.0)})


def fold(df: DataFrame, x: str, roi: float, views: int) -> DataFrame:
    """Views side by side folded onto one: multiviewChannel is the view's number, x is taken modulo the view's width."""
    view = F.least(F.greatest(F.floor(F.col(x) / roi), F.lit(0)), F.lit(views - 1)).cast("int")
    return df.withColumns({"multiviewChannel": view, x: F.col(x) - roi * F.floor(F.col(x) / roi)})


def species_probabilities(df: DataFrame, ratios: Mapping[str, float], g_frac: str = "gFrac", error: str = "error_gFrac") -> DataFrame:
    """p_<species>: Gaussian likelihood of the species' ratio under the measured one."""
    z = {n: (F.col(g_frac) - r) / F.col(error) for n, r in ratios.items()}
    return df.withColumns({f"p_{n}": F.exp(-v * v / 2) / (F.sqrt(F.lit(2 * 3.141592653589793)) * F.col(error)) for n, v in z.items()} | {"ColourNorm": F.lit(1.0)})


def add_metadata(df: DataFrame, metadata: Mapping[str, object], keys: Mapping[str, str]) -> DataFrame:
    """Constant columns from metadata entries (column: entry); strings are cut at 128 bytes."""
    cut = lambda v: v.encode()[:128].decode(errors="ignore") if isinstance(v, str) else v
    return df.withColumns({name: F.lit(cut(metadata[key])) for name, key in keys.items()})


def random_subset(df: DataFrame, n: int, strict: bool = False, seed: int = 0, key: Column | None = None) -> DataFrame:
    """Exactly min(n, rows) rows without replacement; strict and too few rows raise IndexError.

    Rows are drawn in order of a hash of `key` (of the whole row, if None), so the layout does not matter.
    """
    if strict and len(df.take(n)) < n:
        raise IndexError(f"fewer than {n} rows")
    key = F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns))) if key is None else key.cast("string")
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), key).cast("binary"))).limit(n)


def motion_flags(points: DataFrame, moves: DataFrame, frames: int, t: str = "t") -> DataFrame:
    """piezoUnstable: 1 minus the number of moves (column frame) within `frames` before the point; 0 is stable, as recorded.

    Moves are counted for each frame they reach, so the join is on equal frames.
    """
    reach = moves.select(F.explode(F.sequence(F.col("frame"), F.col("frame") + (frames - 1))).alias(t)).groupBy(t).agg(F.count("*").alias("_n"))
    return points.join(reach, t, "left").withColumn("piezoUnstable", 1 - F.coalesce("_n", F.lit(0))).drop("_n")


def in_cylinder(x: Column, y: Column, z: Column, centre: Sequence[float], axis: Sequence[float], radius: float, length: float) -> Column:
    """Whether a point lies in a cylinder around `axis` (a unit vector) with its middle at `centre`."""
    d = [c - o for c, o in zip((x, y, z), centre, strict=True)]
    along = sum((a * b for a, b in zip(d, axis, strict=True)), F.lit(0.0))
    square = sum((a * a for a in d), F.lit(0.0))
    return (F.abs(along) <= length / 2) & (square - along * along <= radius * radius)


def numbered_rows(df: DataFrame, order: Sequence[str], name: str = "row_id") -> DataFrame:
    """A gapless row number over all rows in the given order, from 0.

    Rows are range partitioned once, and kept so: bounds are sampled, so two exchanges would deal rows differently. They are numbered inside
    ranges; the ranges' counts alone meet in one place.
    """
    shared_dir(df.sparkSession)
    parts = df.repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *order).withColumn("_part", F.spark_partition_id()).checkpoint()
    before = parts.groupBy("_part").count()
    before = before.select("_part", (F.sum("count").over(Window.orderBy("_part")) - F.col("count")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return parts.join(before, "_part").withColumn(name, (F.col("_before") + inside).cast("long")).drop("_part", "_before")
