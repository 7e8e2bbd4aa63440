"""Coordinates, vector fields and physical scalars as column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from math import pi

from pyspark.sql import Column, DataFrame, functions as F

#: Fixed value: Boltzmann's constant in J / K.
BOLTZMANN = 1.38e-23


def spherical_to_cartesian(azimuth: Column, zenith: Column, r: Column) -> dict[str, Column]:
    """x, y, z; the zenith is measured from the z axis."""
    flat = r * F.sin(zenith)
    return {"x": flat * F.cos(azimuth), "y": flat * F.sin(azimuth), "z": r * F.cos(zenith)}


def cartesian_to_spherical(x: Column, y: Column, z: Column, azimuth_0: float | None = None, zenith_0: float | None = None) -> dict[str, Column]:
    """azimuth, zenith, r; with a reference direction, angles are taken against it, modulo 2 pi and pi."""
    flat = F.hypot(x, y)
    azimuth, zenith = F.atan2(y, x), F.atan2(flat, z)
    if azimuth_0 is not None or zenith_0 is not None:
        azimuth, zenith = F.pmod(azimuth - (azimuth_0 or 0.0), F.lit(2 * pi)), F.pmod(zenith - (zenith_0 or 0.0), F.lit(pi))
    return {"azimuth": azimuth, "zenith": zenith, "r": F.hypot(flat, z)}


def scaled_projection(x: Column, y: Column, z: Column, factors: Sequence[float], axes: Sequence[Sequence[float]]) -> list[Column]:
    """Coordinates along three axes, each scaled by its factor."""
    return [sum((c * float(f * a) for c, a in zip((x, y, z), axis, strict=True)), F.lit(0.0)) for f, axis in zip(factors, axes, strict=True)]


def stokes_einstein(radius: Column, viscosity: float = 0.001, dimensions: int = 3, temperature: float = 293.0) -> Column:
    """Diffusion coefficient of a sphere as the reference tables have it, in SI units."""
    return F.try_divide(F.lit(BOLTZMANN * temperature), 2 * dimensions * viscosity * radius)


def jump_probability(r: Column, diffusion: Column, t: Column) -> Column:
    """Density of a jump of length r in the plane after time t."""
    return F.try_divide(r, 2 * diffusion * t) * F.exp(-F.try_divide(r * r, 4 * diffusion * t))


def anomalous_msd(t: Column, diffusion: float, alpha: float, dimensions: int = 2) -> Column:
    """Mean square displacement 2 n D t ** alpha."""
    return F.lit(2.0 * dimensions * diffusion) * F.pow(t, F.lit(alpha))


def norm(*fields: Column) -> Column:
    """Length of a vector field's vectors, pixel by pixel: arrays of its components."""
    total = F.transform(fields[0], lambda v: v * v)
    for f in fields[1:]:
        total = F.zip_with(total, f, lambda a, b: a + b * b)
    return F.transform(total, F.sqrt)


def angles(x: Column, y: Column, z: Column | None = None) -> dict[str, Column]:
    """theta: the angle in the plane; phi: the dip angle out of it (of fields with z)."""
    theta = F.zip_with(x, y, lambda a, b: F.atan2(b, a))
    if z is None:
        return {"theta": theta}
    flat = norm(x, y)
    return {"theta": theta, "phi": F.zip_with(z, flat, lambda up, along: F.atan2(up, along))}


def project_on(x: Column, y: Column, along_x: Column, along_y: Column) -> dict[str, Column]:
    """parallel and perpendicular: a field's components along another one's directions and across them, pixel by pixel.

    A direction of no length gives null.
    """
    unit = norm(along_x, along_y)
    dot = F.zip_with(F.zip_with(x, along_x, lambda a, b: a * b), F.zip_with(y, along_y, lambda a, b: a * b), lambda a, b: a + b)
    cross = F.zip_with(F.zip_with(y, along_x, lambda a, b: a * b), F.zip_with(x, along_y, lambda a, b: a * b), lambda a, b: a - b)
    return {"parallel": F.zip_with(dot, unit, F.try_divide), "perpendicular": F.zip_with(cross, unit, F.try_divide)}


def gradient(pixels: Column, width: int | Column, across: bool = True) -> Column:
    """Central differences of a frame (an array, row by row) along its rows, or down its columns; one-sided at the edges."""
    width = F.lit(width) if isinstance(width, int) else width
    step = F.lit(1) if across else width
    at = lambda i: F.element_at(pixels, i + 1)
    last = (lambda i: i % width == width - 1) if across else (lambda i: i + width >= F.size(pixels))
    first = (lambda i: i % width == 0) if across else (lambda i: i < width)
    only = F.size(pixels) <= step

    def slope(_: Column, i: Column) -> Column:
        low, high = F.when(first(i), i).otherwise(i - step), F.when(last(i), i).otherwise(i + step)
        return F.when(only | (low == high), F.lit(0.0)).otherwise((at(high) - at(low)) * step / (high - low))

    return F.transform(pixels, slope)


def curl(vx: Column, vy: Column, width: int) -> Column:
    """Curl of a plane vector field, pixel by pixel: d vy / dx - d vx / dy."""
    return F.zip_with(gradient(vy, width), gradient(vx, width, False), lambda a, b: a - b)


def whole_column(df: DataFrame, value: str, **outs: str) -> DataFrame:
    """df with a column's mean, sum, minimum, maximum or deviation beside every row (outs: name=function), by one aggregation."""
    functions = {"mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "std": F.stddev_pop}
    return df.join(F.broadcast(df.agg(*(functions[f](value).alias(n) for n, f in outs.items()))), how="cross")
