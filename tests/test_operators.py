import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from photonflow.operators import aggregates, asof, clumping, images, spatial, tables, windows
from photonflow.plans.recipe import Recipe
from photonflow.sources import tabular


@pytest.fixture(autouse=True)
def checkpoints(spark, tmp_path_factory):
    spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))


#: Known labels of points at one place, at frames 0, 0, 1, 3, 6 (gap, linking inside a frame).
LABELS = {
    (0, True): [1, 1, 1, 2, 3], (1, True): [1, 1, 1, 1, 2], (2, True): [1, 1, 1, 1, 1], (-1, True): [1, 1, 2, 3, 4],
    (0, False): [1, 2, 1, 3, 4], (1, False): [1, 2, 1, 1, 3], (2, False): [1, 2, 1, 1, 1], (-1, False): [1, 2, 3, 4, 5],
}


@pytest.mark.parametrize("shift", [0, 9])
@pytest.mark.parametrize(("gap", "same"), LABELS)
def test_clump_labels(spark, gap, same, shift):
    rows = [(1, i, t + shift, 0.0, 0.0, 1.0) for i, t in enumerate([0, 0, 1, 3, 6])]
    df = spark.createDataFrame(rows, "series long, row_id long, t long, x double, y double, r double")
    got = clumping.find_clumps(df, "series", "t", "x", "y", "r", gap, "row_id", same).orderBy("row_id").collect()
    assert [r.clumpIndex for r in got] == LABELS[gap, same]


def test_clumps_equal_one_scan(spark):
    rng = random.Random(1)
    rows = [(i % 3, i, rng.randrange(200), rng.random() * 5, rng.random() * 5, 0.4) for i in range(300)]
    df = spark.createDataFrame(rows, "series long, row_id long, t long, x double, y double, r double").repartition(4)
    got = {r.row_id: r.clumpIndex for r in clumping.find_clumps(df, "series", "t", "x", "y", "r", 2, "row_id").collect()}
    for s in range(3):
        c = clumping.Clumper(2)
        for _, i, t, x, y, r in sorted((r for r in rows if r[0] == s), key=lambda r: (r[2], r[1])):
            assert got[i] == c.add(t, x, y, r)


def test_merge_clumps(spark):
    rows = [(1 + i // 5, float(i), float(i), float(i), 1.0 + i) for i in range(10)]
    df = spark.createDataFrame(rows, "c int, A double, x double, y double, error_y double")
    got = {r.c: r for r in aggregates.merge_clumps(df, "c", discard_trivial=True).collect()}
    for k in (1, 2):
        mine = [r for r in rows if r[0] == k]
        w = [1 / r[4] ** 2 for r in mine]
        assert got[k].A == sum(r[1] for r in mine) and got[k].x == np.mean([r[2] for r in mine])
        assert got[k].y == pytest.approx(np.average([r[3] for r in mine], weights=w)) and got[k].error_y == pytest.approx(sum(w) ** -0.5)
    dense = aggregates.merge_clumps(df.where("c = 2"), "c").orderBy("c").collect()
    assert [r.c for r in dense] == [0, 1, 2] and dense[0].n == dense[1].A == 0


def test_tables(spark):
    df = spark.createDataFrame([(float(v), i) for i, v in enumerate([1, 2, 3, float("nan")])], "v double, k int")
    assert [r.v for r in tables.filter_table(df, {"v": (1, 3)}).collect()] == [2]
    with pytest.raises(KeyError):
        tables.filter_table(df, {"none": (0, 1)})
    many = list(range(0, 5000, 2))
    assert {r.k for r in tables.filter_by_ids(df, "k", many).collect()} == {0, 2}
    both = tables.concatenate(df.withColumn("a", F.lit(1)), df.select("k", "v"))
    assert both.columns == ["k", "v", "concatSource"] and both.count() == 8
    assert tables.random_subset(df, 3).count() == 3 and tables.random_subset(df, 9).count() == 4
    with pytest.raises(IndexError):
        tables.random_subset(df, 9, strict=True)
    rows = spark.range(500).withColumn("v", -F.col("id")).repartition(7)
    assert sorted((r.v, r.row_id) for r in tables.numbered_rows(rows, ["v"]).collect()) == [(v, i) for i, v in enumerate(range(-499, 1))]


def test_labels_from_image(spark):
    points = spark.createDataFrame([(float(x), float(y), float(z)) for x in range(10) for y in range(10) for z in range(10)], "x double, y double, z double")
    voxels = [(x, y, z, 1) for x in range(7, 10) for y in range(7, 10) for z in range(7, 10)] + [(x, y, z, 2) for x in range(5) for y in range(5) for z in range(5)]
    pixels = spark.createDataFrame(voxels, "ix int, iy int, iz int, label int")
    count = lambda least: {r.objectID: (r["count"]) for r in tables.labels_from_image(points, pixels, (0, 0, 0), (1, 1, 1), minimum=least).groupBy("objectID").count().collect()}
    assert count(1) == {0: 848, 1: 27, 2: 125} and count(28) == {0: 875, 2: 125}


def test_cluster_shapes(spark):
    cube = [(2, float(x), float(y), float(z)) for x in (-1, 1) for y in (-1, 1) for z in (-1, 1)]
    df = spark.createDataFrame([(1, float(i), 0.0, 0.0) for i in range(10)] + cube, "c int, x double, y double, z double")
    line, box = clumping.principal_axes(df, "c").orderBy("label").collect()
    assert line.anisotropy == pytest.approx(1) and line.axis0 == [1, 0, 0] and line.sigmas[0] == pytest.approx(np.std(range(10), ddof=1))
    assert box.anisotropy == pytest.approx(0, abs=1e-9)


def test_space_equals_brute_force(spark):
    rng = random.Random(3)
    pts = [(i, rng.random(), rng.random()) for i in range(120)] + [(500, 9.0, 9.0)]
    df = spark.createDataFrame(pts, "row_id long, x double, y double")
    d = lambda a, b: math.hypot(a[1] - b[1], a[2] - b[2])
    near = {r.row_id: r.distance for r in spatial.nearest(df, df, ("x", "y"), 0.05, "row_id", same=True).collect()}
    assert near == pytest.approx({a[0]: min(d(a, b) for b in pts if b is not a) for a in pts})
    got = [r.n for r in spatial.pair_histogram(df, ("x", "y"), 5, 0.1, "row_id").orderBy("bin").collect()]
    assert got == [sum(k <= d(a, b) / 0.1 < k + 1 for i, a in enumerate(pts) for b in pts[:i]) for k in range(5)]
    labels = {r.row_id: r.dbscanClumpID for r in clumping.dbscan(df, ("x", "y"), 0.08, 4, "row_id").collect()}
    core = {a[0] for a in pts if sum(d(a, b) < 0.08 for b in pts) >= 4}
    for a in pts:
        for b in pts:
            if a[0] in core and b[0] in core and d(a, b) < 0.08:
                assert labels[a[0]] == labels[b[0]] > 0
        if a[0] not in core:
            around = {labels[b[0]] for b in pts if b[0] in core and d(a, b) < 0.08}
            assert labels[a[0]] == min(around, default=0)
    kept: list = []
    for a in pts:
        if all(d(a, b) >= 0.1 for b in kept):
            kept.append(a)
    assert {r.row_id for r in clumping.overlap_rejection(df, ("x", "y"), 0.1, "row_id").where("rejected = 0").collect()} == {a[0] for a in kept}
    assert sorted(clumping.two_opt(np.array([(0, 0), (2, 0), (1, 0), (3, 0)], float)).tolist()) == [0, 1, 2, 3]


def test_as_of(spark):
    events = spark.createDataFrame([(1, 5, 1.0), (1, 9, 2.0), (2, 1, 7.0)], "k int, t long, v double")
    points = spark.createDataFrame([(1, t) for t in (4, 5, 8, 9, 30)] + [(3, 1)], "k int, t long")
    got = {(r.k, r.t): r.s for r in asof.as_of(points, events, ["k"], "t", "v", "s", F.lit(-1.0)).collect()}
    assert got == {(1, 4): -1, (1, 5): 1, (1, 8): 1, (1, 9): 2, (1, 30): 2, (3, 1): -1}
    strict = {(r.k, r.t): r.s for r in asof.as_of(points, events, ["k"], "t", "v", "s", strict=True).collect()}
    assert strict[1, 5] is None and strict[1, 9] == 1


def test_windows(spark):
    df = spark.createDataFrame([(1, t, v) for t, v in enumerate([1, 1, 0, 1, 1, 1, 0])], "k int, t long, v int")
    assert [(r.start, r.stop, r.n) for r in windows.runs(df, "k", ["t"], F.col("v") == 1, 3).collect()] == [(3, 5, 3)]
    cdf = windows.offtime_cdf(spark.createDataFrame([(1, t) for t in (0, 1, 3, 7, 10)], "k int, t long"), "k", "t").orderBy("off").collect()
    assert [(r.off, round(r.cdf, 3)) for r in cdf] == [(1, 0.333), (2, 0.667), (3, 1.0)]


def test_images(spark):
    image = np.zeros((6, 7))
    image[1, 1:3] = 5
    image[4, 5] = 3
    frames = spark.createDataFrame([(1, 6, 7, image.ravel().tolist())], "t int, height int, width int, pixels array<double>")
    spots = images.detect_spots(frames, 1.0, ["t"]).orderBy("label").collect()
    assert [(s.x, s.y, s.A, s.area) for s in spots] == [(1.5, 1, 10, 2), (5, 4, 3, 1)]
    crop = images.crop(frames, (1, -1), (1, 4)).first()
    assert (crop.height, crop.width) == (5, 3) and np.array_equal(np.reshape(crop.pixels, (5, 3)), image[1:, 1:4])
    blurred = np.array(images.frame_filter(frames, images.gaussian(1.0)).first().pixels)
    assert blurred.sum() == pytest.approx(image.sum(), rel=0.05) and blurred.max() < 5


def test_sources_and_recipe_over_files(spark, tmp_path):
    text = "# x, y\n" + "".join(f"{i},{i * i}\n" for i in range(5)) + "nan,1\nbad,2\n"
    (tmp_path / "p.csv").write_text(text)
    assert tabular.sniff_text(spark, str(tmp_path / "p.csv")) == {"delimiter": ",", "columns": ["x", "y"], "header": False}
    assert [r.y for r in tabular.read_text(spark, str(tmp_path / "p.csv"), ["x", "y"]).orderBy("x").collect()] == [0, 1, 4, 9, 16]
    nested = spark.sql("select named_struct('x0', 1.0, 'e', named_struct('y', 2)) fitResults, 3 tIndex")
    assert tabular.with_aliases(tabular.flatten_structs(nested)).first().asDict() == {"fitResults_x0": 1, "fitResults_e_y": 2, "tIndex": 3, "x": 1, "t": 3}
    tabular.write_table(spark.range(3), str(tmp_path / "once.parquet"))
    with pytest.raises(Exception, match="exists"):
        tabular.write_table(spark.range(3), str(tmp_path / "once.parquet"))
    with pytest.raises(ValueError, match="two steps"):
        Recipe([{"FilterTable": {"inputName": "a", "filters": {}, "outputName": "b"}}] * 2)
    with pytest.raises(KeyError):
        Recipe.from_yaml("- FilterTable: {inputName: a, filters: {}, outputName: b}").execute({})
    with pytest.raises(KeyError, match="no operator"):
        Recipe([{"Nothing": {"outputName": "x"}}])


def test_resample_and_cone(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0), (1, 1.0, 10.0), (1, 3.0, 30.0)], "k int, z double, v double")
    assert [(r.z, r.v) for r in windows.resample(df, "k", "z", "v", 0.75).orderBy("z").collect()] == [(0, 0), (0.75, 7.5), (1.5, 15), (2.25, 22.5)]
    with pytest.raises(Exception, match="repeats"):
        windows.resample(df.union(df), "k", "z", "v", 0.5).collect()
    p = spark.createDataFrame([(0.0, 0.0, 1.0), (0.0, 0.0, 3.0), (1.0, 0.0, 0.2)], "x double, y double, z double")
    assert p.where(spatial.in_cone(F.col("x"), F.col("y"), F.col("z"), 0.0, 0.0, 0.3, 2.0)).count() == 1


def test_drift_follows_a_moving_pattern(spark):
    rng = random.Random(2)
    spots = [(rng.uniform(10, 22), rng.uniform(10, 22)) for _ in range(12)]
    rows = [(t, x + 3 * (t >= 100), y) for t in range(200) for x, y in spots]
    df = spark.createDataFrame(rows, "t long, x double, y double")
    got = {r.window: (r.dy, r.dx) for r in spatial.drift(df, "t", "x", "y", 100, 100, 1.0, (32, 32), (0.0, 0.0)).collect()}
    assert abs(got[0][1]) < 0.5 and abs(got[1][1] - 3) < 0.7 and abs(got[1][0]) < 0.7


def test_drift_bins_every_event(spark):
    from photonflow.plans import catalogue

    for sf in ("sf0.001", "sf0.1"):
        got = {r.window: r.n for r in catalogue.queries()["drift_shifts"](spark, f"/root/testdata/{sf}").collect()}
        e = catalogue.frames_of(spark, f"/root/testdata/{sf}")
        last, first = F.floor(F.col("t") / 4000), F.greatest(F.lit(0), F.floor((F.col("t") - 10000) / 4000) + 1)
        assert got == {r.w: r["count"] for r in e.select(F.explode(F.sequence(first, last)).alias("w")).groupBy("w").count().collect()}
    rows = [(t, -500.0 + 1000 * i + 30 * (t >= 5), 7.0) for t in range(10) for i in (0, 0.3, 0.35, 1)]
    moved = spatial.drift(spark.createDataFrame([*rows, (0, None, 1.0)], "t long, x double, y double"), "t", "x", "y", 5, 5).collect()
    assert sorted((r.window, r.n) for r in moved) == [(0, 20), (1, 20)]
    assert abs({r.window: r.dx for r in moved}[1] - 30) < 1030 / 32


def test_tracks(spark):
    rows = [(t, 0.0 + t, 0.0) for t in range(5)] + [(t, 50.0, 9.0 - t) for t in range(5)] + [(9, 4.0, 0.0), (10, 5.0, 0.0)]
    df = spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], "series long, row_id long, t long, x double, y double").repartition(3)
    got = [r.clumpIndex for r in clumping.track_frames(df, "series", "t", ["x", "y"], "row_id", r0=5.0).orderBy("row_id").collect()]
    assert got == [1] * 5 + [2] * 5 + [3, 3]
    assert clumping.link_frame(np.array([[0.0], [1.0]]), np.array([[0.9]]), np.array([4, 7]), 0.2, 1.0, 0.2).tolist() == [7]


@pytest.mark.parametrize("ahead", [False, True])
@pytest.mark.parametrize("block", [None, 7])
def test_as_of_by_blocks_equals_a_scan(spark, ahead, block):
    rng = random.Random(4)
    points = [(rng.choice(["a", "b", None]), rng.randrange(-40, 90), i) for i in range(120)]
    events = [(rng.choice(["a", "b"]), rng.randrange(-30, 70), rng.choice([1.0, 2.0, 3.0, None])) for _ in range(25)]
    p = spark.createDataFrame(points, "k string, t long, i int")
    e = spark.createDataFrame(events, "k string, t long, v double")
    got = {r.i: r.state for r in asof.as_of(p, e, ["k"], "t", "v", "state", ahead=ahead, block=block).collect()}
    assert len(got) == len(points)
    for k, t, i in points:
        seen = [(-u if ahead else u, v) for key, u, v in events if key == k and v is not None and (u >= t if ahead else u <= t)]
        assert got[i] == (max(seen)[1] if seen else None)


def test_rejection_equals_a_greedy_scan(spark):
    rng = random.Random(9)
    rows = [(i, rng.random() * 3, rng.random() * 3) for i in rng.sample(range(1000), 200)]
    got = {r.i: r.rejected for r in clumping.overlap_rejection(spark.createDataFrame(rows, "i long, x double, y double"), ("x", "y"), 0.4, "i").collect()}
    kept = []
    for i, x, y in sorted(rows):
        near = any(math.dist((x, y), k) < 0.4 for k in kept)
        assert got[i] == int(near)
        if not near:
            kept.append((x, y))
    apart = spark.createDataFrame([(1, 0.0, 0.0), (2, 9.0, 9.0)], "i long, x double, y double")
    assert [r.rejected for r in clumping.overlap_rejection(apart, ("x", "y"), 0.4, "i").collect()] == [0, 0]


def test_pairs_of_a_frame_equal_all_pairs(spark):
    rng = random.Random(10)
    rows = [(i, i % 4, rng.random() * 9, rng.random()) for i in range(80)] + [(99, 7, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "i long, t int, x double, y double")
    got = {r.i: (r.pair, round(r.distance, 9)) for r in spatial.keep_pairs(df.where("i % 2 = 0 or i = 99"), df.where("i % 3 = 0"), "t", ("x", "y"), "i", 0.2).collect()}
    for i, t, *a in rows:
        if i % 2 == 0:
            distance, pair = min((math.dist(a, b), j) for j, u, *b in rows if u == t and j % 3 == 0)
            assert got[i] == (pair, round(distance, 9))
    assert 99 not in got or got[99] == (99, 0.0)


def test_subset_does_not_depend_on_layout(spark):
    df = spark.createDataFrame([(i, f"n{i}") for i in range(200)], "i int, n string")
    draws = {tuple(sorted(r.i for r in tables.random_subset(df.repartition(k), 20).collect())) for k in (1, 3, 7)}
    assert len(draws) == 1 and draws != {tuple(sorted(r.i for r in tables.random_subset(df, 20, seed=1).collect()))}


@pytest.mark.parametrize("most", [1000, 6])
def test_routes_visit_every_point_once(spark, most):
    rng = random.Random(11)
    rows = [(i, rng.random() * 4, rng.random() * 4) for i in range(150)] + [(200 + i, 1.5, 1.5) for i in range(9)]
    df = spark.createDataFrame(rows, "i long, x double, y double")
    got = [r.i for r in clumping.route_order(df, "x", "y", 2.0, "i", most=most, depth=6).collect()]
    assert sorted(got) == sorted(r[0] for r in rows)
    at = {r[0]: r[1:] for r in rows}
    length = lambda order: sum(math.dist(at[a], at[b]) for a, b in zip(order, order[1:]))
    assert length(got) < 0.35 * length([r[0] for r in rows])


def test_row_numbers_are_distinct_beyond_a_sample(spark):
    """Enough rows that range bounds are sampled, and a payload that one of the two readers doesn't need."""
    n = 2_000_000
    rows = spark.range(0, n, 1, 16).selectExpr("(id * 7919) % 1000003 + id / 4e6 AS v", "concat('payload-', id) AS payload")
    got = tables.numbered_rows(rows, ["v"])
    told = got.selectExpr("count(distinct row_id) AS d", "min(row_id) AS low", "max(row_id) AS high", "count(distinct payload) AS p").first()
    assert (told.d, told.low, told.high, told.p) == (n, 0, n - 1, n)
    assert got.selectExpr("v - lag(v) over (partition by row_id div 1000 order by row_id) AS step").where("step < 0").count() == 0
