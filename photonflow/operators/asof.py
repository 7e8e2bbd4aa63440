"""As-of maps: the last event at or before a time, as one union and one window, never a range join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def as_of(
    points: DataFrame, events: DataFrame, keys: Sequence[str], t: str, value: str, out: str, default: Column | None = None, strict: bool = False, ahead: bool = False, block: float | None = None
) -> DataFrame:
    """points with the value of the last event of the same keys at or before t (before t alone, if strict).

    With `ahead` it is the first event at or after t instead. Ties among events of one time go to the largest value. Before
    the first event the default holds (null if none). `block`: a length of time by which series are cut. Each block is done by itself, and
    what holds at its start comes from the blocks before, of which a series has a row each.
    """
    columns = points.columns
    kind = dict(events.dtypes)[value]
    marks = points.withColumns({"_value": F.lit(None).cast(kind), "_event": F.lit(0 if strict else 1)})
    told = events.where(F.col(value).isNotNull()).select(*keys, t, F.col(value).alias("_value"), F.lit(1 if strict else 0).alias("_event"), F.lit(True).alias("_drop"))
    both = marks.withColumn("_drop", F.lit(False)).unionByName(told, allowMissingColumns=True)
    time = F.desc(t) if ahead else F.asc(t)
    order = [time, "_event", F.col("_value").asc_nulls_first()]
    back = (Window.unboundedPreceding, 0)
    if block is None:
        found = both.withColumn(out, F.last("_value", ignorenulls=True).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(*back)))
    else:
        both = both.withColumn("_block", F.floor(F.col(t) / block))
        inside = F.last("_value", ignorenulls=True).over(Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(*back))
        place = F.struct((-F.col(t) if ahead else F.col(t)).alias("t"), "_value")
        last = told.groupBy(*keys, F.floor(F.col(t) / block).alias("_block")).agg(F.max(place)["_value"].alias("_last"))
        last = last.unionByName(both.select(*keys, "_block").distinct(), allowMissingColumns=True).groupBy(*keys, "_block").agg(F.first("_last", ignorenulls=True).alias("_last"))
        blocks = Window.partitionBy(*keys).orderBy(F.desc("_block") if ahead else "_block").rowsBetween(Window.unboundedPreceding, -1)
        last = last.withColumn("_before", F.last("_last", ignorenulls=True).over(blocks)).where("_before is not null").drop("_last")
        same = both["_block"] == last["_block"]
        for k in keys:
            same = same & both[k].eqNullSafe(last[k])
        joined = both.withColumn("_inside", inside).join(last, same, "left").select(*(both[c] for c in both.columns), "_inside", "_before")
        found = joined.withColumn(out, F.coalesce("_inside", "_before"))
    found = found.where("not _drop")
    found = found.withColumn(out, F.coalesce(out, default)) if default is not None else found
    return found.select(*columns, out)


def state_between(points: DataFrame, events: DataFrame, keys: Sequence[str], t: str, kind: str, high: str, low: str, out: str = "state", default: bool = False, block: float | None = None) -> DataFrame:
    """Whether the last of the `high` and `low` events is a high one."""
    told = events.where(F.col(kind).isin(high, low)).select(*keys, t, (F.col(kind) == high).alias("_state"))
    return as_of(points, told, keys, t, "_state", out, F.lit(default), block=block)


def times_to_frames(points: DataFrame, starts: DataFrame, keys: Sequence[str], t: str, cycle: float) -> DataFrame:
    """Frame of a time: the frame of the last start (columns keys, t, frame) at or before it, plus whole cycles since,
    but not beyond the next start's frame. Before any start it is null."""
    w = Window.partitionBy(*keys).orderBy(t, "frame")
    told = starts.select(*keys, t, F.struct(F.col("frame").cast("double").alias("frame"), F.col(t).cast("double").alias("t0"), F.lead("frame").over(w).cast("double").alias("next")).alias("_start"))
    found = as_of(points, told, keys, t, "_start", "_s")
    frame = F.col("_s.frame") + F.floor((F.col(t) - F.col("_s.t0")) / cycle)
    return found.withColumn("frame", F.least(frame, F.col("_s.next"))).drop("_s")


def frames_to_times(frames: DataFrame, starts: DataFrame, keys: Sequence[str], frame: str, cycle: float) -> DataFrame:
    """Time of a frame: that of the last start before it (strictly; its own first frame for the first), plus cycles."""
    told = starts.select(*keys, F.col("frame").alias(frame), F.struct(F.col("frame").cast("double").alias("f0"), F.col("t").cast("double").alias("t0")).alias("_start"))
    found = as_of(frames, told, keys, frame, "_start", "_s", strict=True)
    return found.withColumn("time", F.col("_s.t0") + (F.col(frame) - F.col("_s.f0")) * cycle).drop("_s")


def event_value(description: Column, position: int) -> Column:
    """The n-th `, `-separated token of an event's description, as a number."""
    return F.try_element_at(F.split(description, ", "), F.lit(position + 1)).try_cast("double")


def backlash_corrected(events: DataFrame, keys: Sequence[str], t: str, value: str, backlash: float) -> DataFrame:
    """Event values less the backlash where the last movement was downward; zero movements keep the direction."""
    w = Window.partitionBy(*keys).orderBy(t)
    moved = events.withColumn("_d", F.signum(F.col(value) - F.lag(value).over(w)))
    way = F.last(F.when(F.col("_d") != 0, F.col("_d")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return moved.withColumn(value, F.col(value) - F.when(way < 0, F.lit(backlash)).otherwise(F.lit(0.0))).drop("_d")


def focus_events(events: DataFrame, keys: Sequence[str], t: str, name: str = "name", description: str = "description", block: float | None = None) -> DataFrame:
    """keys, t, focus: what the focus was set to, or where it landed.

    A ProtocolFocus event tells its target as the second token of its description. A PiezoOnTarget event tells a landing position, from which the offset
    in force is taken: the first token of the last PiezoOffsetUpdate at or before it, of the series' first one before any, 0 where the series
    has none. Descriptions that hold no number are left out; of events at one time both are told.
    """
    told = lambda kind, position: events.where(F.col(name) == kind).select(*keys, t, event_value(F.col(description), position).alias("_v")).where("_v is not null")
    offsets, landed = told("PiezoOffsetUpdate", 0), told("PiezoOnTarget", 0)
    first = offsets.groupBy(*keys).agg(F.min(F.struct(F.col(t).alias("t"), F.col("_v").alias("v")))["v"].alias("_first"))
    at = as_of(landed.withColumnRenamed("_v", "_position"), offsets, keys, t, "_v", "_offset", block=block)
    at = at.join(first, list(keys), "left") if keys else at.join(F.broadcast(first), how="cross")
    landed = at.select(*keys, t, (F.col("_position") - F.coalesce("_offset", "_first", F.lit(0.0))).alias("focus"))
    return told("ProtocolFocus", 1).select(*keys, t, F.col("_v").alias("focus")).unionByName(landed)


def corrected_focus(points: DataFrame, events: DataFrame, keys: Sequence[str], t: str, start: float = 0.0, name: str = "name", description: str = "description", out: str = "focus", block: float | None = None) -> DataFrame:
    """points with the focus in force: the last of focus_events() at or before t (of several at one time the largest), `start` before the first."""
    return as_of(points, focus_events(events, keys, t, name, description, block), keys, t, "focus", out, F.lit(float(start)), block=block)
