import math

import numpy as np
import pytest

from photonflow.operators import camera, localise
from photonflow.plans.recipe import Recipe


def drawn(rng, places, size=48, sigma=1.3, photons=400.0):
    y, x = np.mgrid[:size, :size]
    image = np.full((size, size), 20.0)
    for cx, cy in places:
        image += photons * np.exp(-((x - cx) ** 2 + (y - cy) ** 2) / (2 * sigma**2))
    return rng.poisson(image).astype(float)


def test_slopes_equal_differences():
    rng = np.random.default_rng(1)
    p = np.array([[50.0, 4.2, 5.1, 1.4, 3.0, 0.1, -0.2]])
    x, y = (rng.random((2, 1, 20)) * 10)
    found = localise._slopes(p, x, y)
    for i in range(7):
        up, down = p.copy(), p.copy()
        up[0, i] += 1e-5
        down[0, i] -= 1e-5
        assert np.allclose((localise.gaussian(up, x, y) - localise.gaussian(down, x, y)) / 2e-5, found[:, :, i], atol=1e-5)


def test_errors_are_as_large_as_they_say(spark):
    rng = np.random.default_rng(2)
    frames, truth = [], {}
    for t in range(30):
        truth[t] = [(8 + 10 * (k % 4) + rng.random(), 8 + 10 * (k // 4) + rng.random()) for k in range(16)]
        frames.append((t, 48, 48, drawn(rng, truth[t]).ravel().tolist()))
    df = spark.createDataFrame(frames, "t int, height int, width int, pixels array<double>")
    got = localise.localise(df, ["t"], half=5, sigma=1.3).collect()
    assert len(got) == 30 * 16 and sum(r.settled for r in got) > 0.95 * len(got)
    ratio = []
    for r in got:
        cx, cy = min(truth[r.t], key=lambda p: math.dist(p, (r.x0, r.y0)))
        assert math.dist((cx, cy), (r.x0, r.y0)) < 0.6
        ratio.append((r.x0 - cx) / r.error_x0)
    low, high = np.percentile(ratio, [25, 75])
    assert 0.7 < high - low < 2.5 and abs(np.median([r.sigma for r in got]) - 1.3) < 0.05
    points = spark.createDataFrame([(t, *p) for t in range(3) for p in truth[t]], "t int, x double, y double")
    given = localise.localise(df, ["t"], half=5, sigma=1.3, points=points).collect()
    assert len(given) == 48 and all(min(math.dist(p, (r.x0, r.y0)) for p in truth[r.t]) < 0.6 for r in given)


def test_awkward_frames(spark):
    rows = [(1, 12, 12, [5.0] * 144), (2, 12, 12, None), (3, 3, 3, [0.0] * 4 + [99.0] + [0.0] * 4)]
    df = spark.createDataFrame(rows, "t int, height int, width int, pixels array<double>")
    got = localise.localise(df, ["t"], half=5).collect()
    assert {r.t for r in got} <= {3}
    sums = {r.t: r.checksum for r in localise.checksums(df, ["t"]).collect()}
    assert sums == {1: 720.0, 2: None, 3: 99.0}


def test_a_stack_is_filtered_as_its_frames_are():
    rng = np.random.default_rng(3)
    stack = np.stack([drawn(rng, [(10 + 5 * i, 20), (12 + 5 * i, 21), (30, 8 + i)]) for i in range(4)])
    whole = localise.find_spots(stack, 1.3, 5.0, 4)
    for i, frame in enumerate(stack):
        assert whole[whole[:, 0] == i][:, 1:].tolist() == localise.find_spots(frame, 1.3, 5.0, 4).tolist()


def chip(rng, size=64):
    """Dark, flat and variance maps of an uneven camera: some pixels are very noisy."""
    dark, flat = rng.uniform(80, 120, (size, size)), rng.uniform(0.8, 1.25, (size, size))
    return dark, flat, np.where(rng.random((size, size)) < 0.15, 4000.0, 4.0)


def test_fits_weighed_by_camera_maps(spark):
    rng = np.random.default_rng(4)
    dark, flat, variance = chip(rng)
    epc, rows, truth = 2.0, [], {}
    y, x = np.mgrid[:40, :40]
    for t in range(40):
        ox, oy = (3, 17) if t % 2 else (20, 5)
        truth[t] = [(8 + 11 * (k % 3) + rng.random(), 8 + 11 * (k // 3) + rng.random()) for k in range(9)]
        mean = np.full((40, 40), 30.0) + sum(900 * np.exp(-((x - cx) ** 2 + (y - cy) ** 2) / (2 * 1.4**2)) for cx, cy in truth[t])
        part = (slice(oy, oy + 40), slice(ox, ox + 40))
        counts = (rng.poisson(mean) + rng.normal(0, np.sqrt(variance[part]))) / epc / flat[part] + dark[part]
        rows.append((t, "cam", ox, oy, 40, 40, counts.ravel().tolist()))
    frames = spark.createDataFrame(rows, "t int, camera string, roi_x int, roi_y int, height int, width int, pixels array<double>")
    cameras = spark.createDataFrame([("cam", 64, 64, dark.ravel().tolist(), flat.ravel().tolist(), variance.ravel().tolist(), epc)], "camera string, height int, width int, dark array<double>, flat array<double>, variance array<double>, electrons_per_count double")
    points = spark.createDataFrame([(t, *p) for t in truth for p in truth[t]], "t int, x double, y double")
    corrected = camera.correct(frames, cameras)
    far = {}
    for name, df in (("maps", corrected), ("plain", corrected.drop("sigma"))):
        got = [r for r in localise.localise(df, ["t"], half=5, sigma=1.4, points=points).collect() if r.settled]
        off = np.array([[r.x0 - min(truth[r.t], key=lambda p: math.dist(p, (r.x0, r.y0)))[0], r.error_x0] for r in got])
        far[name] = off
    ratio = far["maps"][:, 0] / far["maps"][:, 1]
    assert len(far["maps"]) > 340 and 0.75 < np.subtract(*np.percentile(ratio, [84, 16])) / 2 < 1.35  # errors match their spread
    spread = {n: np.subtract(*np.percentile(v[:, 0], [84, 16])) for n, v in far.items()}
    assert spread["maps"] < 0.8 * spread["plain"]


def test_camera_regions_and_defaults(spark):
    frames = [(1, "a", 1, 0, 1, 2, [10.0, 12.0]), (2, "a", 2, 0, 1, 2, [1.0, 1.0]), (3, "plain", 5, 5, 1, 2, [3.0, 103.0]), (4, "none", 0, 0, 1, 2, [1.0, 2.0]), (5, "a", 1, 0, 1, 2, None)]
    frames = spark.createDataFrame(frames, "t int, camera string, roi_x int, roi_y int, height int, width int, pixels array<double>")
    cameras = spark.createDataFrame([("a", 1, 3, [1.0, 2.0, 3.0], [1.0, 2.0, 0.5], None, 2.0), ("plain", 100, 100, None, None, None, 3.0)], "camera string, height int, width int, dark array<double>, flat array<double>, variance array<double>, ad_offset double")
    for most in (0, camera.BROADCAST):
        got = {r.t: r for r in camera.correct(frames, cameras, most).collect()}
        assert got[1].pixels == [16.0, 4.5] and got[1].sigma == pytest.approx([math.sqrt(1 + 16 + 1), math.sqrt(1 + 4.5 + 1)])
        assert got[3].pixels == [0.0, 100.0] and got[3].sigma == pytest.approx([math.sqrt(3), math.sqrt(102)])
        assert got[2].pixels is got[4].pixels is got[5].pixels is None  # beyond the chip, no such camera, no pixels


def plain_regions(mask):
    """Boxes of 4-connected regions in raster order, by flooding."""
    seen, out = set(), []
    for start in map(tuple, np.argwhere(mask)):
        if start in seen:
            continue
        group, todo = set(), [start]
        while todo:
            y, x = todo.pop()
            if (y, x) in group or not (0 <= y < mask.shape[0] and 0 <= x < mask.shape[1] and mask[y, x]):
                continue
            group.add((y, x))
            todo += [(y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)]
        seen |= group
        ys, xs = zip(*group)
        out.append((min(ys), max(ys) + 1, min(xs), max(xs) + 1))
    return out


def plain_blur(image, sigma):
    reach = int(4 * sigma + 0.5)
    k = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    k /= k.sum()
    mirror = lambda i, n: (i % (2 * n) if i % (2 * n) < n else 2 * n - 1 - i % (2 * n))
    for axis in (0, 1):
        image = np.stack([sum(w * image.take(mirror(i + d, image.shape[axis]), axis) for w, d in zip(k, range(-reach, reach + 1))) for i in range(image.shape[axis])], axis)
    return image


def plain_detect(frame, level, edge, radius):
    frame = np.where(frame > 0, frame, 0)
    band = np.maximum(plain_blur(frame, 1.0) - plain_blur(frame, 3.0), 0)
    band[:edge] = band[-edge:] = 0
    band[:, :edge] = band[:, -edge:] = 0
    found = []
    for y0, y1, x0, x1 in plain_regions(band > level):
        w = {(y, x): band[y, x] for y in range(y0, y1) for x in range(x0, x1)}
        total = sum(w.values())
        found.append((sum(y * v for (y, _), v in w.items()) / total, sum(x * v for (_, x), v in w.items()) / total))
    kept, taken = [], set()
    for i, p in enumerate(found):
        if i not in taken:
            near = [k for k, q in enumerate(found) if math.dist(p, q) < radius]
            kept.append(found[max(near, key=lambda k: (band[int(found[k][0]), int(found[k][1])], -k))])
            taken |= set(near)
    return sorted(kept)


def test_detections_equal_a_plain_model(spark):
    rng = np.random.default_rng(5)
    frames = {t: drawn(rng, [(12 + 4 * t, 15), (30, 20 + t), (33, 22 + t), (40, 40)], size=48 + t) for t in range(5)}
    df = spark.createDataFrame([(t, *f.shape, f.ravel().tolist()) for t, f in frames.items()] + [(90, 8, 8, None), (91, 0, 0, []), (92, 9, 9, [1.0] * 81)], "t int, height int, width int, pixels array<double>")
    for snr, level in ((False, 25.0), (True, 2.0)):
        got = localise.detect_points(df, ["t"], level, snr=snr, radius=5).collect()
        for t, frame in frames.items():
            want = plain_detect(frame, level * np.sqrt(1 + np.maximum(frame, 1) + 1) if snr else level, 5, 5)
            assert sorted((r.y, r.x) for r in got if r.t == t) == [pytest.approx(p) for p in want]
        assert {r.t for r in got} == set(frames)
    recipe = Recipe.from_yaml("- DetectPoints2D: {input_name: a, threshold: 25, snr_threshold: false, output_name: out}")
    spot = spark.createDataFrame([(1, 17, 17, [100.0 * math.exp(-((i // 17 - 8) ** 2 + (i % 17 - 8) ** 2) / 3) for i in range(289)])], "t int, height int, width int, pixels array<double>")
    (one,) = recipe.execute({"a": spot})["out"].collect()
    assert (one.t, round(one.x, 9), round(one.y, 9)) == (1, 8.0, 8.0)
    with pytest.raises(ValueError):
        localise.detect_points(df, ["t"], multithreshold=True)


def test_threshold_scan_finds_weak_beside_strong():
    y, x = np.mgrid[:60, :60]
    bell = lambda a, cx, cy: a * np.exp(-((x - cx) ** 2 + (y - cy) ** 2) / (2 * 1.3**2))
    frame = bell(1000, 20, 20) + bell(400, 40, 22) + bell(150, 30, 42)
    found = localise.detect(frame, 20.0, steps=5)
    for cx, cy in ((20, 20), (40, 22), (30, 42)):
        assert min(math.dist((cy, cx), p) for p in found) < 1.5  # what stronger ones leave behind moves it
