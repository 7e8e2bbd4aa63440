import math
import random

import numpy as np
from pyspark.sql import functions as F

from photonflow.operators import kinetics


def test_exponential_recovers_its_parameters():
    at = np.linspace(3, 50, 80)
    for amplitude, rate, offset in ((100, 0.1, 5), (40, 0.4, 0), (7, 0.03, -2)):
        got = kinetics.exponential(at, amplitude * np.exp(-rate * at) + offset)
        assert np.allclose(got, (amplitude, rate, offset), rtol=1e-3, atol=1e-3)


def test_decays_fit_each_group(spark):
    rng = random.Random(2)
    rows = [(g, rng.expovariate(r)) for g, r in (("a", 0.5), ("b", 2.0)) for _ in range(20000)]
    df = spark.createDataFrame(rows, "g string, t double")
    got = {r.g: r.rate for r in kinetics.fit_decays(kinetics.decay_histogram(df, "t", ["g"]), ["g"]).collect()}
    assert abs(got["a"] / 0.5 - 1) < 0.1 and abs(got["b"] / 2 - 1) < 0.1
    one = kinetics.decay_histogram(spark.createDataFrame([("c", 4.0)] * 3, "g string, t double"), "t", ["g"]).collect()
    assert [(r.bin, r.at, r.n) for r in one] == [(0, 4.0, 3)]


def test_vector_pairs_equal_all_pairs(spark):
    rng = random.Random(3)
    rows = [(i, *(rng.randrange(5) / 2 for _ in range(3))) for i in range(60)]
    want = {}
    for i, *a in rows:
        for j, *b in rows:
            if i < j and (r := math.dist(a, b)) < 1.6:
                x, y, z = (q - p for p, q in zip(a, b))
                turn = lambda up, along: (math.atan(up / along) if along else math.copysign(math.pi / 2, up) if up else 0) + math.pi / 2
                key = (int(r / 0.4), *(min(5, int(v * 6 / math.pi)) for v in (turn(y, x), turn(z, math.hypot(x, y)))))
                want[key] = want.get(key, 0) + 1
    got = kinetics.vector_pair_histogram(spark.createDataFrame(rows, "k long, x double, y double, z double"), 4, 0.4, 6, "k").collect()
    assert {(r.r_bin, r.theta_bin, r.phi_bin): r.n for r in got} == want


def test_fiducials_take_the_drift_away(spark):
    drift = lambda t: 0.01 * t
    marks = [("s", c, t, c * 10.0 + drift(t)) for c in range(3) for t in range(0, 100, 2)]
    points = [("s", t, 5.0 + drift(t)) for t in range(98)] + [("other", 3, 1.0)]
    moved = kinetics.fiducial_trajectory(spark.createDataFrame(marks, "s string, c int, t long, x double"), "s", "c", "t", ["x"], 5, 0)
    got = kinetics.fiducial_correction(spark.createDataFrame(points, "s string, t long, x double"), moved, "s", "t", ["x"]).collect()
    assert len(got) == len(points)
    inner = [r.x for r in got if r.s == "s"]
    assert max(inner) - min(inner) < 1e-9
    assert [r.x for r in got if r.s == "other"] == [1.0]


def test_fronts_and_pieces(spark):
    frames = spark.createDataFrame([(1, 0, [5.0, 5.0, 0.0]), (1, 1, [5.2, 9.0, 0.0])], "s int, t int, pixels array<double>")
    got = kinetics.wavefronts(frames, "s", "t", "pixels", 1.0, 0.5).orderBy("t").collect()
    assert [(r.front, r.active) for r in got] == [([0, 0, 0], 0), ([1, 0, 0], 1)]
    t = spark.createDataFrame([(-1.0,), (5.0,), (15.0,)], "t double")
    assert [r[0] for r in t.select(kinetics.piecewise_linear(F.col("t"), [0, 10], [1.0, -2.0])).collect()] == [0.0, 5.0, 0.0]


def test_two_species_of_jumps_are_told_apart(spark):
    rng = np.random.default_rng(5)
    jumps = np.concatenate([np.hypot(*rng.normal(0, np.sqrt(2 * d * 0.1), (2, n))) for d, n in ((0.2, 6000), (5.0, 3000))])
    n = np.bincount((jumps / 0.05).astype(int))
    df = spark.createDataFrame([(i, int(k)) for i, k in enumerate(n) if k], "bin long, n long")
    slow, fast = kinetics.fit_jumps(df, 0.05, 0.1).orderBy("species").collect()
    assert abs(slow.diffusion / 0.2 - 1) < 0.1 and abs(fast.diffusion / 5 - 1) < 0.1 and abs(slow.share - 2 / 3) < 0.05
    one, = kinetics.fit_jumps(df, 0.05, 0.1, 1).collect()
    assert slow.diffusion < one.diffusion < fast.diffusion and one.share == 1


def test_off_times_are_recovered(spark):
    from photonflow.operators import windows

    rng = np.random.default_rng(9)
    rows = []
    for site, times in (("one", rng.exponential(300, 4000)), ("two", np.where(rng.random(6000) < 0.4, rng.exponential(20, 6000), rng.exponential(900, 6000)))):
        rows += [(site, int(f)) for f in np.cumsum(np.ceil(times).astype(int) + 1)]
    rows += [("short", 1), ("short", 9), ("none", 4)]
    cdf = windows.offtime_cdf(spark.createDataFrame(rows, "site string, frame int"), "site", "frame")
    one = {r.site: r for r in kinetics.fit_off_times(cdf, "site").collect()}
    assert set(one) == {"one", "two", "short"} and abs(one["one"].off_time - 300) < 12 and one["one"].residual < 0.02 and one["two"].residual > 0.03
    two = {r.site: r for r in kinetics.fit_off_times(cdf, "site", 2).collect()}
    assert set(two) == {"one", "two"} and two["two"].residual < 0.02
    assert abs(two["two"]["share"] - 0.4) < 0.05 and abs(two["two"].off_short - 20) < 4 and abs(two["two"].off_long - 900) < 60
