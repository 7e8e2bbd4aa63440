import math

import numpy as np

from photonflow.operators import emitters
from photonflow.plans.recipe import Recipe


def drawn(rng, places, size=40, sigma=1.3, background=10.0):
    y, x = np.mgrid[:size, :size]
    image = np.full((size, size), background)
    for a, cx, cy in places:
        image += a * np.exp(-((x - cx) ** 2 + (y - cy) ** 2) / (2 * sigma**2))
    return rng.poisson(image).astype(float)


def test_slopes_equal_differences():
    rng = np.random.default_rng(1)
    p = np.array([[50.0, 4.2, 5.1, 30.0, 6.0, 2.5, 1.4, 3.0]])
    x, y = rng.random((2, 1, 25)) * 10
    found = emitters._slopes(p, x, y, 2)
    for i in range(8):
        up, down = p.copy(), p.copy()
        up[0, i] += 1e-5
        down[0, i] -= 1e-5
        assert np.allclose((emitters.model(up, x, y, 2) - emitters.model(down, x, y, 2)) / 2e-5, found[:, :, i], atol=1e-5)


def test_regions_get_as_many_emitters_as_they_hold(spark):
    rng = np.random.default_rng(2)
    frames, truth = [], {}
    for t in range(12):
        truth[t] = [(900.0, 9 + rng.random(), 9 + rng.random()), (900.0, 27 + rng.random(), 9.5), (700.0, 30.5 + rng.random(), 10.0), (900.0, 9.0, 28.0), (800.0, 12.3, 28.5), (700.0, 10.5, 31.0)]
        frames.append((t, 40, 40, drawn(rng, truth[t]).ravel().tolist()))
    df = spark.createDataFrame(frames + [(50, 40, 40, None), (51, 0, 0, []), (52, 9, 9, [5.0] * 81)], "t int, height int, width int, pixels array<double>")
    got = emitters.fit_regions(df, ["t"], sigma=1.3, snr=8.0).collect()
    assert {r.t for r in got} == set(truth)
    counts = [len([r for r in got if r.t == t]) for t in truth]
    assert np.mean(np.array(counts) == 6) > 0.8 and max(counts) <= 8
    ratio = []
    for t in truth:
        for a, cx, cy in truth[t]:
            near = min((r for r in got if r.t == t), key=lambda r: math.dist((cx, cy), (r.x, r.y)))
            if math.dist((cx, cy), (near.x, near.y)) < 0.5:
                ratio.append((near.x - cx) / near.error_x)
    assert len(ratio) > 65 and 0.6 < np.subtract(*np.percentile(ratio, [84, 16])) / 2 < 1.6  # errors match their spread


def test_dumbbells_of_a_known_distance(spark):
    rng = np.random.default_rng(3)
    frames, points, truth = [], [], {}
    for t in range(20):
        cx, cy, angle = 20 + rng.random(), 20 + rng.random(), rng.uniform(0, np.pi)
        half = 1.9 * np.array([np.cos(angle), np.sin(angle)])
        truth[t] = [(1500.0, cx + half[0], cy + half[1]), (900.0, cx - half[0], cy - half[1])]
        frames.append((t, 40, 40, drawn(rng, truth[t]).ravel().tolist()))
        points.append((t, 100 + t, cx, cy))
    points += [(0, 7, 500.0, 500.0), (99, 8, 1.0, 1.0)]
    f, p = spark.createDataFrame(frames, "t int, height int, width int, pixels array<double>"), spark.createDataFrame(points, "t int, point_id long, x double, y double")
    got = emitters.fit_dumbbells(f, p, ["t"], sigma=1.2).collect()
    assert len(got) == 40 and {r.region for r in got} == {100 + t for t in truth}
    for t in truth:
        one, two = sorted((r for r in got if r.t == t), key=lambda r: r.emitter)
        assert one.A >= two.A and math.dist((one.x, one.y), truth[t][0][1:]) < 0.3 and math.dist((two.x, two.y), truth[t][1][1:]) < 0.4
        assert abs(math.dist((one.x, one.y), (two.x, two.y)) - 3.8) < 0.4 and abs(one.sigma - 1.3) < 0.15
    steps = "- MultifitBlobs: {inputImage: a, blobSigma: 1.3, threshold: 8, outputName: many}\n- FitDumbells: {inputImage: a, inputPositions: p, outputName: pairs}"
    found = Recipe.from_yaml(steps).execute({"a": f, "p": p})
    assert found["pairs"].count() == 40 and found["many"].count() >= 35
