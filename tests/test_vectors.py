import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from photonflow.operators import aggregates, clumping, images, spatial, vectors, windows


@pytest.fixture(autouse=True)
def checkpoints(spark, tmp_path_factory):
    spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))


def test_spherical_coordinates_go_there_and_back(spark):
    rng = random.Random(1)
    rows = [tuple(rng.uniform(-3, 3) for _ in range(3)) for _ in range(30)]
    df = spark.createDataFrame(rows, "x double, y double, z double")
    at = df.select("x", "y", "z", *(v.alias(n) for n, v in vectors.cartesian_to_spherical(F.col("x"), F.col("y"), F.col("z")).items()))
    back = at.select("x", "y", "z", *(v.alias(f"{n}1") for n, v in vectors.spherical_to_cartesian(F.col("azimuth"), F.col("zenith"), F.col("r")).items()))
    assert all(math.dist((r.x, r.y, r.z), (r.x1, r.y1, r.z1)) < 1e-9 for r in back.collect())
    turned = df.select(*(v.alias(n) for n, v in vectors.cartesian_to_spherical(F.col("x"), F.col("y"), F.col("z"), 1.0, 0.5).items())).collect()
    for (x, y, z), r in zip(rows, turned, strict=True):
        assert (r.azimuth, r.zenith) == (pytest.approx((math.atan2(y, x) - 1) % (2 * math.pi)), pytest.approx((math.atan2(math.hypot(x, y), z) - 0.5) % math.pi))


@pytest.mark.parametrize(("height", "width"), [(5, 7), (1, 6), (6, 1), (1, 1)])
def test_gradients_equal_numpy(spark, height, width):
    image = np.random.default_rng(2).random((height, width))
    df = spark.createDataFrame([(image.ravel().tolist(),)], "p array<double>")
    down, across = df.select(vectors.gradient(F.col("p"), width, False), vectors.gradient(F.col("p"), width)).first()
    for got, axis in ((down, 0), (across, 1)):
        want = np.gradient(image, axis=axis) if image.shape[axis] > 1 else np.zeros_like(image)
        assert np.allclose(np.reshape(got, image.shape), want)


def test_masked_ripley_of_an_even_grid_is_a_disc(spark):
    grid = spatial.box_mask(spark, (0, 0), (50, 50), 1.0, ("x", "y")).withColumn("k", F.col("x") * 50 + F.col("y"))
    got = spatial.masked_ripley(grid, grid.select("x", "y"), ("x", "y"), 5, 5.0, "k", 2500.0, 1.0).orderBy("bin").collect()
    assert np.allclose([r.K for r in got], [math.pi * r.r**2 for r in got], rtol=1e-9)
    cube = spatial.box_mask(spark, (0, 0, 0), (8, 8, 8), 1.0, ("x", "y", "z")).withColumn("k", F.col("x") * 64 + F.col("y") * 8 + F.col("z"))
    got = spatial.masked_ripley(cube, cube.select("x", "y", "z"), ("x", "y", "z"), 5, 1.0, "k", 512.0, 1.0).orderBy("bin").collect()
    assert np.allclose([r.K for r in got], [4 / 3 * math.pi * r.r**3 for r in got], rtol=1e-9)


def test_clustered_points_leave_the_envelope(spark):
    rng = random.Random(3)
    points = spark.createDataFrame([(i, 5 + 4 * (i % 2) + rng.gauss(0, 0.2), 5 + rng.gauss(0, 0.2)) for i in range(60)], "k long, x double, y double")
    mask = spatial.box_mask(spark, (0, 0), (14, 10), 1.0, ("x", "y"))
    k = spatial.masked_ripley(points, mask, ("x", "y"), 3, 1.0, "k", 140.0, 1.0)
    got = spatial.ripley_envelope(k, 60, mask, ("x", "y"), 3, 1.0, 140.0, 1.0, 1.0, simulations=10).orderBy("bin").collect()
    assert len(got) == 3 and all(r.K > r.K_max >= r.K_min and r.p_clustered == pytest.approx(1 / 11) and r.p_dispersed == 1 for r in got[:2])


def test_features_medians_and_axes(spark):
    rng = random.Random(4)
    rows = [(i, 1 + i % 3, *(rng.gauss(0, s) for s in (3, 1, 0.2))) for i in range(80)] + [(99, 9, 1.0, 2.0, 3.0)]
    df = spark.createDataFrame(rows, "k long, label int, x double, y double, z double")
    got = {r.k: r.features for r in spatial.distance_features(df, ("x", "y", "z"), 4, 0.7, "k").collect()}
    for k, _, *a in rows:
        want = [sum(1 for *_, x, y, z in rows if i * 0.7 <= math.dist(a, (x, y, z)) < (i + 1) * 0.7) for i in range(4)]
        assert got[k] == want
    shares = spatial.distance_features(df, ("x", "y", "z"), 4, 0.7, "k", True).collect()
    assert all(sum(r.features) == pytest.approx(1) for r in shares)
    spread = {r.label: r.median_abs_deviation for r in aggregates.median_deviation(df, "label", ("x", "y", "z")).collect()}
    axes = {r.label: r for r in clumping.principal_axes(df, "label").collect()}
    for label in (1, 2, 3):
        p = np.array([r[2:] for r in rows if r[1] == label])
        assert spread[label] == pytest.approx(np.median(np.linalg.norm(p - np.median(p, axis=0), axis=1)))
        _, s, v = np.linalg.svd(p - p.mean(axis=0))
        sd = s / np.sqrt(len(p) - 1)
        assert np.allclose(axes[label].sigmas, sd)
        assert axes[label].anisotropy == pytest.approx(np.std(sd**2, ddof=1) / (np.sqrt(3) * np.mean(sd**2)))
        for i in range(3):
            assert abs(np.dot(axes[label][f"axis{i}"], v[i])) == pytest.approx(1)
        assert axes[label].theta == pytest.approx(np.arctan(v[0][0] / v[0][1])) and abs(axes[label].phi) == pytest.approx(abs(np.arcsin(v[0][2])))
    assert spread[9] == 0
    steps = aggregates.cumulative_histogram(df, "x").orderBy("bins").collect()
    assert [r.bins for r in steps] == sorted(r[2] for r in rows) and np.allclose([r.counts for r in steps], np.linspace(0, 1, len(rows)))


def test_rendering_in_depth(spark):
    df = spark.createDataFrame([(0.0, 0.0, 0.0, 0.5, 0.7), (3.2, 1.0, -2.0, 0.4, 0.5)], "x double, y double, z double, s double, sz double")
    got = spatial.render_gaussian_3d(df, ("x", "y", "z"), "s", "sz", (-5, -5, -5), 0.2, 0.3).agg(F.sum("value")).first()[0]
    assert got == pytest.approx(2, abs=1e-3)
    counts = spatial.render_histogram_3d(df, [F.col(c) for c in "xyz"], (-5, -5, -5), 1.0, 2.0).collect()
    assert {(r.ix, r.iy, r.iz, r.n) for r in counts} == {(5, 5, 2, 1), (8, 6, 1, 1)}


def test_tracks_and_whole_columns(spark):
    rows = [(1, 0, 0.0, 0.0), (1, 2, 3.0, 4.0), (1, 3, 3.0, 0.0), (2, 5, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "c int, t int, x double, y double")
    got = {r.c: r for r in windows.tracks(df, "c", "t", ["x", "y"]).collect()}
    assert (got[1].n, got[1].start, got[1].stop, got[1].path, got[1].displacement, got[1].speed) == (3, 0, 3, 9.0, 3.0, 3.0)
    assert (got[2].n, got[2].path, got[2].speed) == (1, 0.0, None)
    assert {r.bin: r.n for r in windows.jump_histogram(df, "c", "t", ["x", "y"], 1.0).collect()} == {5: 1, 4: 1}
    assert {(r.m, r.s) for r in vectors.whole_column(df, "x", m="mean", s="sum").collect()} == {(1.75, 7.0)}


def test_zoom_and_means(spark):
    frames = spark.createDataFrame([(1, 2, 2, [0.0, 2.0, 4.0, 6.0])], "t int, height int, width int, pixels array<double>")
    r = images.zoom(frames, 2.0).first()
    assert (r.height, r.width) == (4, 4) and np.allclose(np.reshape(r.pixels, (4, 4))[0], np.linspace(0, 2, 4)) and r.pixels[-1] == 6
    assert images.normalise_mean(frames).first().pixels == [0.0, 2 / 3, 4 / 3, 2.0]
    both = images.join_channels([frames, images.rotate180(frames)]).orderBy("c").collect()
    assert [(b.c, b.pixels[0]) for b in both] == [(0, 0.0), (1, 6.0)]


def test_frame_means_equal_plain_sums(spark):
    rng = random.Random(5)
    rows = [(rng.choice("ab"), rng.randrange(-40, 90), rng.choice([None, rng.random()])) for _ in range(400)] + [(None, 1, 1.0), ("a", None, 2.0), ("lone", 5, 3.0)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i long, k string, t int, v double")
    for start, stop, block in ((-7, 0, 5), (-3, 4, 1), (2, 30, None), (0, 1, 50)):
        got = {r.i: (r.background, r.corrected) for r in windows.sliding_mean(df, "k", "t", "v", start, stop, block).collect()}
        assert len(got) == len(rows)
        for i, (k, t, v) in enumerate(rows):
            near = [w for a, u, w in rows if a == k and k is not None and None not in (t, u, w) and start <= u - t < stop]
            if not near:
                assert got[i] == (None, None)
            else:
                assert got[i][0] == pytest.approx(sum(near) / len(near)) and (v is None) == (got[i][1] is None)
