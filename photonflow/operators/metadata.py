"""Metadata of many sources as one table of entries: source, key, value (JSON text; null for an entry without value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def copy_entries(entries: DataFrame, other: DataFrame) -> DataFrame:
    """entries with all of other's; of an entry that both have, other's value. Sources and keys of either are kept, a null value is a value."""
    return _joined(entries, other, F.when(F.col("_there"), F.col("_other")).otherwise(F.col("value")))


def merge_entries(entries: DataFrame, other: DataFrame) -> DataFrame:
    """entries with those of other that they lack; what entries have stays, null values too."""
    return _joined(entries, other, F.when(F.col("_here"), F.col("value")).otherwise(F.col("_other")))


def _joined(entries: DataFrame, other: DataFrame, value: Column) -> DataFrame:
    a = entries.select("source", "key", "value").withColumn("_here", F.lit(True))
    b = other.select("source", "key", F.col("value").alias("_other")).withColumn("_there", F.lit(True))
    marks = {c: F.coalesce(c, F.lit(False)) for c in ("_here", "_there")}
    return a.join(b, ["source", "key"], "full").withColumns(marks).select("source", "key", value.alias("value"))


def entries_of(table: DataFrame, source: str, **columns: Column) -> DataFrame:
    """Entries from a table of one row a source: names (with a dot for each double underscore) and columns, strings quoted as JSON."""
    parts = []
    for name, column in columns.items():
        kind = table.select(column).schema[0].dataType.simpleString()
        value = F.regexp_extract(F.to_json(F.struct(column.alias("v"))), r"(?s)^\{\"v\":(.*)\}$", 1) if kind == "string" else column.cast("string")
        parts.append(F.struct(F.lit(name.replace("__", ".")).alias("key"), F.when(column.isNotNull(), value).alias("value")))
    return table.select(F.col(source).alias("source"), F.explode(F.array(*parts)).alias("e")).select("source", "e.key", "e.value")


def to_json(entries: DataFrame) -> DataFrame:
    """source, json: one object a source, keys in order; entries without a value are null. A source's entries meet in one row; repeated ones of a key stay once, the largest."""
    quoted = F.regexp_extract(F.to_json(F.struct(F.col("key").alias("v"))), r"(?s)^\{\"v\":(.*)\}$", 1)
    once = entries.groupBy("source", "key").agg(F.max("value").alias("value"))
    told = once.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("key", F.concat(quoted, F.lit(": "), F.coalesce("value", F.lit("null"))).alias("v")))).alias("e"))
    return told.select("source", F.concat(F.lit("{"), F.array_join(F.transform("e", lambda e: e["v"]), ", "), F.lit("}")).alias("json"))


def _numbers(entries: DataFrame, names: dict[str, str]) -> DataFrame:
    """source and a column for each wanted key, as a number."""
    wanted = entries.where(F.col("key").isin(*names.values()))
    return wanted.groupBy("source").agg(*(F.max(F.when(F.col("key") == k, F.col("value").try_cast("double"))).alias(n) for n, k in names.items()))


def voxel_sizes(entries: DataFrame) -> DataFrame:
    """source, x, y, z: voxel sizes in nanometres from voxelsize.x, .y and .z (micrometres); z is 0 where there is none. Sources without x or y are left out."""
    found = _numbers(entries, {c: f"voxelsize.{c}" for c in "xyz"}).where("x is not null and y is not null")
    return found.select("source", *((F.coalesce(F.col(c), F.lit(0.0)) * 1e3).alias(c) for c in "xyz"))


def origins(entries: DataFrame) -> DataFrame:
    """source, x, y, z: where a source's region begins on the camera, in nanometres: Camera.ROIOriginX and Y (pixels from 0), or Camera.ROIPosX and Y (from 1), times
    the voxel size; 0 where a source has neither. Sources without a voxel size are left out."""
    roi = _numbers(entries, {"ox": "Camera.ROIOriginX", "oy": "Camera.ROIOriginY", "px": "Camera.ROIPosX", "py": "Camera.ROIPosY"})
    found = voxel_sizes(entries).join(roi, "source", "left")
    return found.select("source", *((F.coalesce(F.col(f"o{c}"), F.col(f"p{c}") - 1, F.lit(0.0)) * F.col(c)).alias(c) for c in "xy"), F.lit(0.0).alias("z"))
