import numpy as np
import pytest

from photonflow.operators import astigmatism, clumping, spatial, surfaces, tiles


def test_curvature_of_a_sphere_and_a_saddle(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(3000, 3))
    ball = 50 * v / np.linalg.norm(v, axis=1)[:, None]
    u = rng.uniform(-40, 40, (3000, 2))
    saddle = np.column_stack([u + 500, (u[:, 0] ** 2 - u[:, 1] ** 2) / 160])
    rows = [(i, *map(float, p)) for i, p in enumerate(np.concatenate([ball, saddle]))] + [(9000, 9e3, 9e3, 9e3), (9001, None, 1.0, 1.0)]
    found = surfaces.fit_patches(spark.createDataFrame(rows, "i long, x double, y double, z double"), 12.0, "i").collect()
    assert {r.i for r in found} <= set(range(6000)) and len(found) > 5900
    round_ = [r for r in found if r.i < 3000]
    assert np.allclose([abs(r.curvature1) for r in round_] + [abs(r.curvature2) for r in round_], 1 / 50, atol=0.003)
    away = [abs(np.dot((r.nx, r.ny, r.nz), (r.x, r.y, r.z))) / 50 for r in round_]
    assert min(away) > 0.99
    middle = [r for r in found if r.i >= 3000 and np.hypot(r.x - 500, r.y - 500) < 8]
    assert len(middle) > 30 and np.allclose([r.curvature1 for r in middle], 1 / 80, atol=0.002) and np.allclose([r.curvature2 for r in middle], -1 / 80, atol=0.002)


def test_patches_are_kept_by_their_neighbours_and_drawn(spark):
    y, x = np.mgrid[:20, :20].astype(float)
    rows = [(i, float(a), float(b), 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0) for i, (a, b) in enumerate(zip(x.ravel(), y.ravel()))] + [(900, 10.5, 10.5, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0)]
    patches = spark.createDataFrame(rows, "i long, x double, y double, z double, nx double, ny double, nz double, curvature1 double, curvature2 double, offset double")
    assert {r.i for r in surfaces.aligned_patches(patches, 1.6, "i").collect()} == set(range(400))
    bowl = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.02, 0.02, 0.0)], patches.schema)
    drawn = surfaces.reconstructed(bowl, 10.0, 2.0, "i").collect()
    assert len(drawn) == 81 and all(r.z == pytest.approx(0.01 * (r.x**2 + r.y**2)) for r in drawn)
    assert all(np.hypot(np.hypot(r.nx, r.ny), r.nz) == pytest.approx(1) and r.nx * r.x <= 1e-12 for r in drawn)


def test_depths_lie_within_their_errors(spark):
    rng = np.random.default_rng(2)
    wide = lambda z, d: 130 * np.sqrt(1 + ((z - d) / 350) ** 2)
    lens = spark.createDataFrame([(c, float(z), float(wide(z, 220 + 30 * c)), float(wide(z, -220 + 30 * c)), -450.0, 450.0) for c in (0, 1) for z in range(-500, 501, 20)], "channel int, z double, sigmax double, sigmay double, z_low double, z_high double")
    z = rng.uniform(-350, 350, 400)
    s = [wide(z, 220) + rng.normal(0, 2, 400), wide(z, -220) + rng.normal(0, 2, 400), wide(z, 250) + rng.normal(0, 2, 400), wide(z, -190) + rng.normal(0, 2, 400)]
    rows = [(i, 1000.0, *(float(v[i]) * (-1) ** i for v in s), 2.0, 2.0, 2.0, 2.0) for i in range(400)]
    rows += [(400, 0.0, *(float(v[0]) for v in s[:2]), float("nan"), None, 2.0, 2.0, 2.0, 2.0), (401, 0.0, None, None, None, None, 2.0, 2.0, 2.0, 2.0)]
    points = spark.createDataFrame(rows, "i long, z double, sigmax0 double, sigmay0 double, sigmax1 double, sigmay1 double, error_sigmax0 double, error_sigmay0 double, error_sigmax1 double, error_sigmay1 double")
    got = {r.i: r for r in astigmatism.map_astigmatic_z(points, lens).collect()}
    off = np.array([-got[i].astigmatic_z - z[i] for i in range(400)])
    assert np.std(off) < 12 and np.abs(off).max() < 60 and all(got[i].z == 1000 + got[i].astigmatic_z for i in range(400))
    assert abs(got[400].astigmatic_z + z[0]) < 40 and got[401].astigmatic_z is got[401].astigmatic_z_lookup_error is got[401].z is None
    plain = points.select("i", "sigmax0", "sigmay0", "error_sigmax0", "error_sigmay0").toDF("i", "sigmax", "sigmay", "error_sigmax", "error_sigmay")
    one = {r.i: r.astigmatic_z for r in astigmatism.map_astigmatic_z(plain, lens.where("channel = 0")).collect()}
    assert np.std([-one[i] - z[i] for i in range(400)]) < 16


def test_splines_keep_cubics_and_end_values():
    z = np.linspace(-100, 100, 41)
    f = lambda v: 3 + 0.1 * v - 2e-3 * v**2 + 1e-5 * v**3
    at = np.array([-150.0, -100, -33.3, 0, 71, 100, 200])
    assert np.allclose(astigmatism.smooth_curve(z, f(z), np.array([-50.0, 0, 50]), at), f(np.clip(at, -100, 100)))


def test_nearest_k_equals_all_pairs(spark):
    rng = np.random.default_rng(3)
    a, b = rng.uniform(0, 1, (60, 3)), np.concatenate([rng.uniform(0, 1, (90, 3)), [[50.0, 50, 50]], [[0.5, 0.5, 0.5]] * 3])
    left = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(a)] + [(99, 49.0, 50.0, 50.0)], "i long, x double, y double, z double")
    right = spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(b)], "k long, x double, y double, z double")
    where = {r.i: (r.x, r.y, r.z) for r in left.collect()}
    for k in (1, 4, 200):
        got = {r.i: [(n.distance, n.neighbour) for n in r.near] for r in spatial.nearest_k(left, right, ("x", "y", "z"), k, 0.05, "i", "k").collect()}
        assert set(got) == set(where)
        for i, near in got.items():
            want = sorted((float(np.sqrt(((b[m] - where[i]) ** 2).sum())), m) for m in range(len(b)))[:k]
            assert [n for _, n in near] == [n for _, n in want] and np.allclose([d for d, _ in near], [d for d, _ in want])
    assert [r.near for r in spatial.nearest_k(left.limit(1), right.where("false"), ("x", "y", "z"), 2, 1.0, "i", "k").collect()] == [[]]


def test_rejection_along_a_chain_takes_few_rounds(spark):
    """2,000 points in a line, each too near the one before it: every other one goes."""
    rows = [(i, 0.9 * i, 0.0) for i in range(2000)] + [(5000 + i, float(x), float(y)) for i, (x, y) in enumerate(np.random.default_rng(4).uniform(3000, 3040, (300, 2)))]
    got = {r.i: r.rejected for r in clumping.overlap_rejection(spark.createDataFrame(rows, "i long, x double, y double"), ("x", "y"), 1.0, "i", block=200.0).collect()}
    assert [got[i] for i in range(2000)] == [0, 1] * 1000
    for block in (3.0, 32.0):
        again = {r.i: r.rejected for r in clumping.overlap_rejection(spark.createDataFrame(rows[2000:], "i long, x double, y double"), ("x", "y"), 4.0, "i", block=block).collect()}
        kept = []
        for i, x, y in rows[2000:]:
            near = any(np.hypot(x - a, y - b) < 4 for _, a, b in kept)
            assert again[i] == near
            if not near:
                kept.append((i, x, y))


def test_patches_of_crowded_tiles_equal_least_squares(spark, monkeypatch):
    """Neighbourhoods meet as tiles: cells of more than MOST points, some of them of one place, are parted and dealt."""
    monkeypatch.setattr(tiles, "MOST", 16)
    monkeypatch.setattr(tiles, "HELD", 1)
    rng = np.random.default_rng(5)
    p = rng.normal(0, 0.3, (300, 3)) * (1, 1, 0.05)
    p[:40] = p[0]
    points = spark.createDataFrame([(i, *map(float, q)) for i, q in enumerate(p)], "i long, x double, y double, z double")
    found = {r.i: r for r in surfaces.fit_patches(points, 0.25, "i").collect()}
    d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(axis=2))
    assert set(found) == set(np.flatnonzero((d < 0.25).sum(axis=1) >= 8).tolist())
    for i, r in found.items():
        q = p[d[i] < 0.25] - p[i]
        axes = np.linalg.eigh(np.cov(q.T, bias=True))[1].T[::-1]
        u, v, w = (axes @ q.T) / 0.25
        terms = np.stack([u, v, u * u, u * v, v * v], axis=1)
        c = np.linalg.lstsq(terms, w, rcond=1e-8)[0]
        assert r.n == len(q) and r.residual == pytest.approx(0.25 * np.sqrt(np.mean((w - terms @ c) ** 2)), abs=1e-6)
    patches = spark.createDataFrame([(i, *map(float, q), *map(float, n)) for i, (q, n) in enumerate(zip(p, rng.normal(size=p.shape)))], "i long, x double, y double, z double, nx double, ny double, nz double")
    rows = patches.orderBy("i").collect()
    n = np.array([(r.nx, r.ny, r.nz) for r in rows])
    agree = {i for i in range(len(p)) if np.median(np.abs(n[d[i] < 0.25] @ n[i])) >= 0.8}
    assert 0 < len(agree) < len(p) and {r.i for r in surfaces.aligned_patches(patches, 0.25, "i", 0.8).collect()} == agree
