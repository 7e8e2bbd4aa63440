import numpy as np
import pytest

from photonflow.operators import registration
from photonflow.operators.clumping import Clumper

TRUE = {1: ([40.0, -20.0, 15.0, 8.0, 5.0, 0.0, 0.0, 3.0, 60.0], [10.0, 30.0, 0.0, -12.0, 6.0, 2.0, -4.0, 0.0, -45.0]), 2: ([0.0] * 8 + [-80.0], [5.0] + [0.0] * 8)}


def at(c, x, y):
    return sum(v * (x / 18e3) ** p * (y / 18e3) ** q for v, (p, q) in zip(c, registration.TERMS.values()))


def beads(rng, n=300, outliers=20):
    """Beads in three channels with known shifts; some are moved, some lack a channel, some have strangers."""
    rows = []
    x, y = rng.uniform(0, 36e3, (2, n))
    for i in range(n):
        for channel in (0, 1, 2):
            if channel == 2 and i % 17 == 0:
                continue
            dx, dy = (at(c, x[i], y[i]) for c in TRUE[channel]) if channel else (0.0, 0.0)
            far = rng.uniform(60, 90, 2) if channel == 1 and i < outliers else (0.0, 0.0)
            for k in range(6):
                rows.append((len(rows), channel, i if channel == 0 else 1000 + i, float(x[i] - dx + far[0] + rng.normal(0, 3)), float(y[i] - dy + far[1] + rng.normal(0, 3)), k))
    rows += [(len(rows) + k, 0, 5000, 90e3, 90e3, k) for k in range(3)]
    return rows


def test_a_known_shift_is_recovered_in_spite_of_outliers(spark):
    points = spark.createDataFrame(beads(np.random.default_rng(1)), "row_id long, channel int, clump long, x double, y double, t int")
    pairs = registration.paired_beads(points, "channel", "clump", ("x", "y"), 250.0).collect()
    assert all(p.clump % 17 for p in pairs) and {p.channel for p in pairs} == {1, 2}  # seen in every channel
    shifts = registration.calibrate_shifts(points, "channel", "clump", ("x", "y"), 250.0)
    rng = np.random.default_rng(2)
    for r in shifts.collect():
        assert r.rms_x < 4 and r.rms_y < 4 and (r.channel == 2 or r.n <= 300 - 20)
        for x, y in rng.uniform(1000, 35e3, (30, 2)):
            assert abs(at(r.dx, x, y) - at(TRUE[r.channel][0], x, y)) < 4 and abs(at(r.dy, x, y) - at(TRUE[r.channel][1], x, y)) < 4
    fixed = registration.shift_correct(points, shifts, "channel").where("row_id % 6 = 0 and clump < 5000")
    truth = {r.clump % 1000: (r.x, r.y) for r in points.groupBy("channel", "clump").agg({"x": "avg", "y": "avg"}).withColumnsRenamed({"avg(x)": "x", "avg(y)": "y"}).where("channel = 0").collect()}
    off = [np.hypot(r.x - truth[r.clump % 1000][0], r.y - truth[r.clump % 1000][1]) for r in fixed.collect() if r.clump % 1000 >= 20]
    assert np.median(off) < 6 and max(off) < 30
    named = registration.shift_table(shifts).collect()
    assert {(r.channel, r.axis) for r in named} == {(c, a) for c in (1, 2) for a in "xy"} and all(r.my3 == 0 for r in named)


def test_exact_pairs_give_exact_coefficients(spark):
    rng = np.random.default_rng(3)
    rows = [(1, float(x), float(y), float(at(TRUE[1][0], x, y)), float(at(TRUE[1][1], x, y)), 0.0, None if i == 5 else 0.0) for i, (x, y) in enumerate(rng.uniform(0, 36e3, (60, 2)))]
    (got,) = registration.fit_shifts(spark.createDataFrame(rows, "channel int, x double, y double, dx double, dy double, ex double, ey double")).collect()
    assert got.n == 60 and got.dx == pytest.approx(TRUE[1][0], abs=1e-6) and got.dy == pytest.approx(TRUE[1][1], abs=1e-6)


def test_too_few_beads(spark):
    points = spark.createDataFrame([(c, i, 100.0 * i, 0.0) for c in (0, 1) for i in range(2)], "channel int, clump int, x double, y double")
    with pytest.raises(ValueError):
        registration.calibrate_shifts(points, "channel", "clump", ("x", "y"), 10.0)


def test_clumps_stay_in_their_channel(spark):
    rng = np.random.default_rng(4)
    rows = [(i, int(rng.integers(3)) * 5, int(rng.integers(40)), float(rng.uniform(0, 4)), float(rng.uniform(0, 4)), 0.2) for i in range(200)]
    got = {r.row_id: r.clumpIndex for r in registration.find_clumps_within_channel(spark.createDataFrame(rows, "row_id long, probe int, t int, x double, y double, e double"), "probe", "t", "x", "y", "e", 3, "row_id").collect()}
    want, before = {}, 0
    for probe in (0, 5, 10):
        clumper, own = Clumper(3), {}
        for r in sorted((r for r in rows if r[1] == probe), key=lambda r: (r[2], r[0])):
            own[r[0]] = clumper.add(*r[2:])
        for k, c in own.items():
            want[k] = c + before if list(own.values()).count(c) > 1 else 0
        before += max(own.values())
    assert got == want
