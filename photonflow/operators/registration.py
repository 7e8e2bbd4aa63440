"""Channels side by side on one camera: clumps by channel, beads paired across channels, polynomial shift maps and their use."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from photonflow.operators.clumping import find_clumps
from photonflow.operators.leastsquares import normal_sums, solved
from photonflow.operators.spatial import pairs_within
from photonflow.sources.shared import kept

#: Terms of a shift in x and y, by powers of both. Fixed names and order.
TERMS = {"mx": (1, 0), "my": (0, 1), "mx2": (2, 0), "my2": (0, 2), "mxy": (1, 1), "mxy2": (1, 2), "mx2y": (2, 1), "mx3": (3, 0), "x0": (0, 0)}
#: Length that coordinates are divided by in shift maps.
UNIT = 18e3
#: Rounds of robust refitting, and the robust deviations beyond which a pair is rejected.
ROUNDS = 6
REJECTED = 5.0


def find_clumps_within_channel(points: DataFrame, channel: str, t: str, x: str, y: str, radius: str, gap: int, row_id: str, out: str = "clumpIndex") -> DataFrame:
    """Clumps that don't mix channels, numbered on from channel to channel; a clump of a single point is no clump and gets 0."""
    found = find_clumps(points, channel, t, x, y, radius, gap, row_id, out="_clump")
    sizes = found.groupBy(channel, "_clump").agg(F.count("*").alias("_n"))
    # one row a clump; numbers of a channel are dense from 1, so offsets need one row a channel
    most = sizes.groupBy(channel).agg(F.max("_clump").alias("_most"))
    before = most.select(channel, (F.sum("_most").over(Window.orderBy(channel)) - F.col("_most")).alias("_before"))
    named = sizes.join(before, channel).select(channel, "_clump", F.when(F.col("_n") > 1, F.col("_clump") + F.col("_before")).otherwise(0).cast("long").alias(out))
    return found.join(named, [channel, "_clump"]).drop("_clump")


def paired_beads(points: DataFrame, channel: str, clump: str, axes: Sequence[str], radius: float, first: int = 0) -> DataFrame:
    """clump, channel, x, y (place in the first channel), dx, dy (first less other channel), ex, ey (their errors).

    A clump's place is the mean of its points, its error their deviation. A clump of the first channel and one of another are a pair if each is the
    other's nearest within the radius (of equally near ones, the least clump). Only clumps with a pair in every other channel are kept.
    """
    cx, cy = axes
    stats = [F.avg(cx).alias("x"), F.avg(cy).alias("y"), F.stddev_pop(cx).alias("ex"), F.stddev_pop(cy).alias("ey")]
    centres = kept(points.groupBy(F.col(channel).alias("channel"), F.col(clump).alias("clump")).agg(*stats), "centres")
    base, others = centres.where(F.col("channel") == first), centres.where(F.col("channel") != first)
    near = pairs_within(base, others, ("x", "y"), radius)
    near = kept(near.select(F.col("a.clump").alias("a"), F.col("b.channel").alias("channel"), F.col("b.clump").alias("b"), "distance"), "near")
    mine = near.groupBy("a", "channel").agg(F.min(F.struct("distance", "b")).alias("m")).select("a", "channel", F.col("m.b").alias("b"))
    theirs = near.groupBy("b", "channel").agg(F.min(F.struct("distance", "a")).alias("m")).select(F.col("m.a").alias("a"), "channel", "b")
    mutual = kept(mine.join(theirs, ["a", "channel", "b"]), "mutual")
    wanted = others.select("channel").distinct().count()
    whole = mutual.groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") == wanted).select("a")
    pairs = mutual.join(whole, "a").join(base.select(F.col("clump").alias("a"), "x", "y", F.col("ex").alias("ex0"), F.col("ey").alias("ey0")), "a")
    pairs = pairs.join(others.select("channel", F.col("clump").alias("b"), F.col("x").alias("x1"), F.col("y").alias("y1"), F.col("ex").alias("ex1"), F.col("ey").alias("ey1")), ["channel", "b"])
    return pairs.select(F.col("a").alias("clump"), "channel", "x", "y", (F.col("x") - F.col("x1")).alias("dx"), (F.col("y") - F.col("y1")).alias("dy"), F.hypot("ex0", "ex1").alias("ex"), F.hypot("ey0", "ey1").alias("ey"))


def _design(x: np.ndarray, y: np.ndarray, unit: float) -> np.ndarray:
    return np.stack([(x / unit) ** p * (y / unit) ** q for p, q in TERMS.values()], axis=1)


def fit_shifts(pairs: DataFrame, unit: float = UNIT, floor: float = 1.0, rounds: int = ROUNDS, rejected: float = REJECTED) -> DataFrame:
    """channel, dx, dy: coefficients of TERMS for the shift in x and in y; n: pairs that they rest on; rms_x, rms_y: what is left.

    Weighted least squares, each pair by its error (at least `floor`), then refitted `rounds` times with the weights of a Cauchy
    likelihood, whose tails leave outliers little say; pairs farther off than `rejected` times the median deviation (or than their error) in either axis are
    dropped and the rest is fitted by plain weighted least squares. A round is one pass over the pairs, in which normal
    equations are added up; no pair is gathered. Channels of few pairs get the least solution that fits them.
    """
    width, keys = len(TERMS), ["channel"]
    pairs = pairs.select("channel", *(F.col(c).cast("double").alias(c) for c in ("x", "y", "dx", "dy")), *(F.greatest(F.col(c).cast("double"), F.lit(float(floor))).alias(c) for c in ("ex", "ey")))
    pairs = kept(pairs.dropna(), "pairs")

    def fit(rows: DataFrame, axis: str, robust: bool) -> DataFrame:
        def design(own: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            a, b, e = _design(own["x"].to_numpy(), own["y"].to_numpy(), unit), own[f"d{axis}"].to_numpy(), own[f"e{axis}"].to_numpy()
            off = (b - a @ np.asarray(own["now"].iloc[0], float)) / e if robust else 0.0
            return a, b, 1 / (e * e * (1 + off * off))

        return solved(normal_sums(rows, keys, width, design), keys, width)

    def both(rows: DataFrame, now: DataFrame | None = None) -> DataFrame:
        """channel, dx, dy, n and what is left, by rows alone or reweighted about what is held now."""
        axes = []
        for axis in ("x", "y"):
            given = rows if now is None else rows.join(now.select("channel", F.col(f"d{axis}").alias("now")), "channel")
            found = fit(given, axis, now is not None)
            axes.append(found.select("channel", F.col("coefficients").alias(f"d{axis}"), F.col("residual").alias(f"left_{axis}"), "n"))
        return kept(axes[0].join(axes[1].drop("n"), "channel"), "shifts")

    now = both(pairs)
    for _ in range(rounds):
        now = both(pairs, now)
    held = pairs.join(now.select("channel", F.col("dx").alias("cx"), F.col("dy").alias("cy")), "channel")
    held = kept(held.withColumns({f"off_{c}": F.abs(F.col(f"d{c}") - shift(F.col("x"), F.col("y"), F.col(f"c{c}"), unit)) for c in "xy"}), "held")
    limits = held.groupBy("channel").agg(*(F.percentile_approx(f"off_{c}", 0.5).alias(f"mid_{c}") for c in "xy"))
    good = held.join(limits, "channel").where(" and ".join(f"off_{c} <= {rejected} * greatest(1.4826 * mid_{c}, e{c})" for c in "xy"))
    good = kept(good.select(*pairs.columns), "good")
    last = both(good)
    off = [F.sqrt(F.avg((F.col(f"p.d{c}") - shift(F.col("p.x"), F.col("p.y"), F.col(f"l.d{c}"), unit)) ** 2)).alias(f"rms_{c}") for c in "xy"]
    rest = good.alias("p").join(last.alias("l"), F.col("p.channel") == F.col("l.channel")).groupBy(F.col("l.channel").alias("channel")).agg(*off)
    return last.select("channel", "dx", "dy", "n").join(rest, "channel")


def shift(x: Column, y: Column, coefficients: Column, unit: float = UNIT) -> Column:
    """The shift that coefficients (an array, in the order of TERMS) give at a place."""
    total = F.lit(0.0)
    for i, (p, q) in enumerate(TERMS.values()):
        term = coefficients[i]
        for _ in range(p):
            term = term * (x / unit)
        for _ in range(q):
            term = term * (y / unit)
        total = total + term
    return total


def calibrate_shifts(points: DataFrame, channel: str, clump: str, axes: Sequence[str], radius: float, first: int = 0, unit: float = UNIT, floor: float = 1.0) -> DataFrame:
    """The shift map of all channels against the first, from beads that show in all of them; fewer than three such beads raise ValueError."""
    pairs = kept(paired_beads(points, channel, clump, axes, radius, first), "beads")
    if len(pairs.select("clump").distinct().take(3)) < 3:
        raise ValueError("fewer than three clumps have points in every channel; try a larger radius")
    return fit_shifts(pairs, unit, floor)


def shift_table(shifts: DataFrame) -> DataFrame:
    """A shift map with a row for each channel and axis, and a column for each term."""
    each = shifts.select("channel", F.explode(F.array(*(F.struct(F.lit(c).alias("axis"), F.col(f"d{c}").alias("v")) for c in "xy"))).alias("a"))
    return each.select("channel", "a.axis", *(F.col("a.v")[i].alias(n) for i, n in enumerate(TERMS)), F.lit(0.0).alias("my3"))


def shift_correct(points: DataFrame, shifts: DataFrame, channel: str, x: str = "x", y: str = "y", unit: float = UNIT) -> DataFrame:
    """points on the first channel: chromadx and chromady by the map of their channel, added to x and y; channels without a map stay."""
    maps = shifts.select(F.col("channel").alias(channel), F.col("dx").alias("_dx"), F.col("dy").alias("_dy"))
    moved = points.join(maps, channel, "left").withColumns({"chromadx": F.coalesce(shift(F.col(x), F.col(y), F.col("_dx"), unit), F.lit(0.0)), "chromady": F.coalesce(shift(F.col(x), F.col(y), F.col("_dy"), unit), F.lit(0.0))})
    return moved.withColumns({x: F.col(x) + F.col("chromadx"), y: F.col(y) + F.col("chromady")}).drop("_dx", "_dy")
