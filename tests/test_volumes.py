import heapq
import itertools
import math

import numpy as np
import pytest

from photonflow.operators import flow, volumes
from photonflow.plans.recipe import Recipe


def frames(spark, stack, key="k", zs=None):
    zs = list(range(len(stack))) if zs is None else zs
    return spark.createDataFrame([(key, z, *s.shape, s.astype(float).ravel().tolist()) for z, s in zip(zs, stack)], "key string, z int, height int, width int, pixels array<double>")


def grown(mask, zs):
    out = mask.copy()
    for z, y, x in np.argwhere(mask):
        for dz, dy, dx in ((0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1), (1, 0, 0), (-1, 0, 0)):
            at = [i for i, v in enumerate(zs) if v == zs[z] + dz]
            if at and 0 <= y + dy < mask.shape[1] and 0 <= x + dx < mask.shape[2]:
                out[at[0], y + dy, x + dx] = True
    return out


def plain_distance(mask, zs, voxel, grow=True):
    """Signed distance by trying all pairs of voxels."""
    places = np.stack(np.meshgrid(np.array(zs) * voxel[2], np.arange(mask.shape[1]) * voxel[1], np.arange(mask.shape[2]) * voxel[0], indexing="ij"), axis=-1)
    target = grown(mask, zs) if grow else mask
    away = lambda to: np.array([[[math.inf if not len(to) else np.sqrt(((to - p) ** 2).sum(axis=1)).min() for p in row] for row in s] for s in places])
    return np.where(mask, -away(places[~mask]), away(places[target]))


def collected(found, shape, zs, column="distance"):
    out = np.full(shape, np.nan)
    for r in found:
        out[zs.index(r.z)].ravel()[r.stripe : r.stripe + len(r[column])] = r[column]
    return out


@pytest.mark.parametrize("grow", [True, False])
def test_distances_equal_all_pairs(spark, monkeypatch, grow):
    monkeypatch.setattr(volumes, "STRIPE", 16)
    rng = np.random.default_rng(1)
    voxel, zs = (1.0, 1.3, 2.5), [0, 1, 2, 5]
    cases = {"sparse": rng.random((4, 6, 7)) > 0.93, "dense": rng.random((4, 6, 7)) > 0.3, "none": np.zeros((4, 6, 7), bool), "all": np.ones((4, 6, 7), bool)}
    whole = None
    for k, m in cases.items():
        one = frames(spark, m, k, zs)
        whole = one if whole is None else whole.unionByName(one)
    found = volumes.feature_transform(whole, ["key"], voxel, grow).collect()
    for k, mask in cases.items():
        own = [r for r in found if r.key == k]
        got = collected(own, mask.shape, zs)
        assert np.allclose(got, plain_distance(mask, zs, voxel, grow))
        near = [collected(own, mask.shape, zs, f"near_{c}") for c in "xyz"]
        target = grown(mask, zs) if grow else mask
        for z, y, x in itertools.product(*map(range, mask.shape)):
            nx, ny, nz = (int(n[z, y, x]) for n in near)
            if math.isfinite(got[z, y, x]):
                to = (target if not mask[z, y, x] else ~mask)[zs.index(nz), ny, nx]
                assert to and math.isclose(abs(got[z, y, x]), math.hypot((nx - x) * voxel[0], (ny - y) * voxel[1], (nz - zs[z]) * voxel[2]), abs_tol=1e-9)
            else:
                assert (nx, ny, nz) == (-1, -1, -1)


def test_tiles_of_a_deep_volume_meet_where_something_nearer_may_be(spark, monkeypatch):
    monkeypatch.setattr(volumes, "STRIPE", 12)
    monkeypatch.setattr(volumes, "VOXELS", 36, raising=False)
    plain = volumes.nearest_along

    def shallow(cost, *places):  # no task searches more than two tiles at once
        if cost.size > 72:
            raise ValueError(f"{cost.size} voxels at once")
        return plain(cost, *places)

    monkeypatch.setattr(volumes, "nearest_along", shallow)
    rng = np.random.default_rng(7)
    shape, voxel = (32, 4, 5), (1.0, 1.5, 0.25)
    zs = sorted(rng.choice(60, 32, replace=False).tolist())
    cases = {k: np.zeros(shape, bool) for k in ("first", "ends", "corners", "none")} | {"sparse": rng.random(shape) > 0.99, "dense": rng.random(shape) > 0.3, "all": np.ones(shape, bool), "holes": rng.random(shape) < 0.995}
    cases["first"][0, 1, 2] = cases["ends"][0, 0, 0] = cases["ends"][-2, 3] = True
    cases["corners"][:, 0, 0] = True
    whole = None
    for k, m in cases.items():
        whole = frames(spark, m, k, zs) if whole is None else whole.unionByName(frames(spark, m, k, zs))
    whole = whole.unionByName(frames(spark, cases["sparse"], None, zs))
    found = volumes.feature_transform(whole, ["key"], voxel).collect()
    for k, mask in (cases | {None: cases["sparse"]}).items():
        own = [r for r in found if r.key == k]
        assert len(own) == 64
        got, near = collected(own, shape, zs), [collected(own, shape, zs, f"near_{c}") for c in "xyz"]
        assert np.allclose(got, plain_distance(mask, zs, voxel))
        sides = grown(mask, zs), ~mask
        for z, y, x in itertools.product(*map(range, shape)):
            nx, ny, nz = (int(n[z, y, x]) for n in near)
            if math.isfinite(got[z, y, x]):
                assert sides[int(mask[z, y, x])][zs.index(nz), ny, nx]
                assert math.isclose(abs(got[z, y, x]), math.hypot((nx - x) * voxel[0], (ny - y) * voxel[1], (nz - zs[z]) * voxel[2]), abs_tol=1e-9)
            else:
                assert (nx, ny, nz) == (-1, -1, -1)


def test_a_slice_by_itself():
    rng = np.random.default_rng(2)
    for shape in ((1, 1), (1, 9), (9, 1), (40, 31)):
        mask = rng.random(shape) > 0.9
        mask.flat[0] = True
        best, row, column = volumes.nearest_in_slice(mask, 0.7, 1.1)
        at = np.argwhere(mask)
        for y, x in np.ndindex(shape):
            assert math.isclose(best[y, x], min(((y - a) * 0.7) ** 2 + ((x - b) * 1.1) ** 2 for a, b in at), abs_tol=1e-9)
            assert mask[row[y, x], column[y, x]]


def test_densities_and_directions(spark):
    rng = np.random.default_rng(3)
    mask, image, voxel = np.zeros((5, 12, 12), bool), rng.random((5, 12, 12)), (100.0, 100.0, 200.0)
    mask[1:4, 4:8, 3:9] = True
    stripes = volumes.feature_transform(frames(spark, mask), ["key"], voxel)
    d = plain_distance(mask, range(5), voxel)
    low, size, high = -300.0, 100.0, 900.0
    bins = np.arange(low, high, size)
    n = [((d >= a) & (d < b)).sum() for a, b in zip(bins, bins[1:])]
    mean = [image[(d >= a) & (d < b)].mean() if k else 0.0 for a, b, k in zip(bins, bins[1:], n)]
    got = sorted(map(tuple, volumes.image_density_at_distance(frames(spark, image), stripes, ["key"], low, size, len(n)).select("bin", "n", "mean").collect()))
    assert [g[1] for g in got] == n and np.allclose([g[2] for g in got], mean)
    coloc = sorted(map(tuple, volumes.distance_colocalisation(frames(spark, image), stripes, ["key"], low, size, high).drop("key").collect()))
    total = np.array(n) * mean
    assert np.allclose([c[0] for c in coloc], bins[1:]) and np.allclose([c[1] for c in coloc], np.array(mean) / np.mean([m for m, k in zip(mean, n) if k > 1]))
    assert np.allclose([c[2] for c in coloc], np.cumsum(total) / total.sum()) and np.allclose([c[3] for c in coloc], np.cumsum(n) / np.sum(n))
    roi = np.zeros_like(image)
    roi[:, :6] = 1
    part = volumes.image_density_at_distance(frames(spark, image), stripes, ["key"], low, size, len(n), frames(spark, roi)).collect()
    assert sum(r.n for r in part) == ((d >= low) & (d < bins[-1]) & (roi > 0)).sum()
    places = rng.uniform(0, 1, (200, 3)) * (1100, 1100, 800)
    points = spark.createDataFrame([("k", *map(float, p)) for p in places] + [("k", -500.0, 0.0, 0.0), ("other", 1.0, 1.0, 1.0)], "key string, x double, y double, z double")
    away = {(r.x, r.y): r.mask_distance for r in volumes.distance_at_points(points, stripes, ["key"], voxel, rounded=True).collect()}
    for x, y, z in places:
        assert math.isclose(away[x, y], d[tuple(np.rint(np.array([z, y, x]) / (200, 100, 100)).astype(int))], abs_tol=1e-9)
    assert away[-500.0, 0.0] is None and away[1.0, 1.0] is None
    events = volumes.point_density_at_distance(points, stripes, ["key"], voxel, low, size, len(n)).collect()
    assert {r.bin: r.n_voxels for r in events if r.key == "k"} == dict(enumerate(n)) and sum(r.n_events for r in events) == sum(low <= v < bins[-1] for v in away.values() if v is not None)
    for r in volumes.direction_to_mask(stripes, voxel).collect():
        for i, u in enumerate(zip(r.dir_x, r.dir_y, r.dir_z)):
            itself = (r.near_x[i], r.near_y[i], r.near_z[i]) == (i % 12, i // 12, r.z)
            assert math.isclose(math.hypot(*u), 0 if itself else 1, abs_tol=1e-9)


def test_gradient_equals_numpy(spark):
    rng = np.random.default_rng(4)
    stack = rng.random((4, 5, 6))
    got = sorted(volumes.gradient3d(frames(spark, stack), ["key"], (2.0, 1.0, 0.5)).collect(), key=lambda r: r.z)
    dz, dy, dx = np.gradient(stack)
    for i, r in enumerate(got):
        assert np.allclose(r.grad_x, dx[i].ravel() / 2) and np.allclose(r.grad_y, dy[i].ravel()) and np.allclose(r.grad_z, dz[i].ravel() / 0.5)


def test_known_motion_is_found(spark):
    y, x = np.mgrid[:64, :80]
    scene = lambda dx, dy: np.sin((x - dx) / 4) * np.cos((y - dy) / 5) + 0.5 * np.sin((x - dx + 2 * (y - dy)) / 7)
    rows = [("a", 10 * i, 64, 80, scene(0.4 * i, -0.25 * i).ravel().tolist()) for i in range(3)] + [("b", 0, 4, 4, [1.0] * 16), ("c", 0, 4, 4, [0.0] * 16), ("c", 1, 4, 4, [0.0] * 16), ("d", 1, 4, 4, None)]
    df = spark.createDataFrame(rows, "series string, t int, height int, width int, pixels array<double>")
    got = {(r.series, r.t): (np.array(r.flow_x), np.array(r.flow_y)) for r in flow.optical_flow(df, "series", "t", 1.0, 5.0).collect()}
    assert set(got) == {("a", 0), ("a", 10), ("a", 20), ("b", 0), ("c", 0), ("c", 1)}
    for t, times in ((0, 1), (10, 2), (20, 1)):
        dx, dy = (v.reshape(64, 80)[8:-8, 8:-8] for v in got["a", t])
        assert np.abs(dx - 0.4 * times).max() < 0.06 * times and np.abs(dy + 0.25 * times).max() < 0.06 * times
    assert not got["b", 0][0].any() and not got["c", 1][1].any()
    far = flow.pair_flow(scene(0, 0), scene(2.2, 1.5), 1.0, 6.0, rounds=6)
    assert np.abs(far[0][24:-24, 24:-24] - 2.2).max() < 0.1 and np.abs(far[1][24:-24, 24:-24] - 1.5).max() < 0.1  # away from what came in at the edges


def plain_flood(image, markers, mask):
    out = {(y, x): int(markers[y, x]) for y, x in np.ndindex(image.shape) if markers[y, x] and mask[y, x]}
    heap = [(image[p], n, p) for n, p in enumerate(sorted(out))]
    heapq.heapify(heap)
    count = len(heap)
    while heap:
        _, _, (y, x) = heapq.heappop(heap)
        for p in ((y - 1, x), (y, x - 1), (y, x + 1), (y + 1, x)):
            if 0 <= p[0] < image.shape[0] and 0 <= p[1] < image.shape[1] and mask[p] and p not in out:
                out[p] = out[y, x]
                heapq.heappush(heap, (image[p], count, p))
                count += 1
    return np.array([[out.get((y, x), 0) for x in range(image.shape[1])] for y in range(image.shape[0])])


def test_watershed_equals_a_plain_heap_and_splits_basins(spark):
    rng = np.random.default_rng(5)
    for k in range(6):
        image = rng.integers(0, 4, (11, 13)).astype(float)  # many ties
        markers, mask = np.where(rng.random((11, 13)) > 0.95, rng.integers(1, 5, (11, 13)), 0), rng.random((11, 13)) > 0.2
        assert np.array_equal(flow.flood(image, markers, mask), plain_flood(image, markers, mask))
        assert np.array_equal(flow.flood(image, markers), plain_flood(image, markers, np.ones_like(mask)))
    y, x = np.mgrid[:20, :40]
    image = np.minimum(np.hypot(x - 10, y - 10), np.hypot(x - 30, y - 10))
    markers = np.zeros((20, 40))
    markers[10, 10], markers[10, 30] = 1, 2
    one = frames(spark, image[None])
    (got,) = flow.watershed(one, frames(spark, markers[None]), ["key", "z"]).collect()
    assert np.array_equal(np.array(got.pixels).reshape(20, 40)[:, :19], np.ones((20, 19))) and np.array_equal(np.array(got.pixels).reshape(20, 40)[:, 22:], np.full((20, 18), 2))
    (masked,) = flow.watershed(one, frames(spark, markers[None]), ["key", "z"], frames(spark, (x < 25)[None])).collect()
    assert set(np.array(masked.pixels).reshape(20, 40)[:, 25:].ravel()) == {0.0}


def test_recipes_of_several_outputs(spark):
    rng = np.random.default_rng(6)
    stack = rng.random((3, 5, 6))
    image = frames(spark, stack).withColumnRenamed("key", "series")
    steps = """
- Gradient2D: {inputName: image, outputNameX: gx, outputNameY: gy}
- Gradient3D: {inputName: image, outputNameZ: gz}
- SimpleThreshold: {inputName: image, threshold: 0.7, outputName: mask}
- ColocalisationEDT: {inputImage: image, inputMask: mask, inputImageB: gx, minimumDistanceNM: -2, maximumDistanceNM: 4, binSizeNM: 1, outputTable: coloc}
- Watershed: {inputImage: image, inputMarkers: mask, outputName: basins}
"""
    found = Recipe.from_yaml(steps).execute({"image": image})
    told = lambda n: np.array([r.pixels for r in sorted(found[n].collect(), key=lambda r: r.z)]).reshape(stack.shape)
    for name, axis in (("gx", 2), ("gy", 1), ("gz", 0)):
        assert np.allclose(told(name), np.gradient(stack, axis=axis))
    assert found["coloc"].count() == 5 and set(found["coloc"].columns) >= {"enrichment_m", "enclosed_m"} and (told("basins") == 1).all()
    with pytest.raises(KeyError):
        Recipe.from_yaml("- Gradient3D: {inputName: image}")
