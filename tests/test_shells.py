import numpy as np
import pytest

from photonflow.operators import shells


def sphere(rng, n, radius, centre, stretch=(1, 1, 1), noise=0.0):
    v = rng.normal(size=(n, 3))
    v /= np.linalg.norm(v, axis=1)[:, None]
    return v * (radius + rng.normal(0, noise, (n, 1))) * stretch + centre


def test_harmonics_are_orthogonal_and_have_known_values():
    """By quadrature over the sphere: norms of 1 for m = 0, a quarter of that else; and low orders in closed form."""
    z, w = np.polynomial.legendre.leggauss(24)
    azimuth, zenith = np.meshgrid(np.arange(48) * np.pi / 24, np.arccos(z))
    a = shells.harmonics(azimuth.ravel(), zenith.ravel(), 5)
    gram = (a * (np.repeat(w, 48) * np.pi / 24)[:, None]).T @ a
    assert np.allclose(gram, np.diag([1.0 if m == 0 else 0.25 for m, _ in shells.modes(5)]), atol=1e-12)
    t, p = np.array([0.3, 2.0]), np.array([1.1, 2.5])
    got = dict(zip(shells.modes(2), shells.harmonics(t, p, 2).T))
    assert np.allclose(got[0, 1], np.sqrt(3 / (4 * np.pi)) * np.cos(p))
    assert np.allclose(got[1, 1], np.sqrt(3 / (8 * np.pi)) * np.sin(p) * np.cos(t) / np.sqrt(2))
    assert np.allclose(got[-1, 1], np.sqrt(3 / (8 * np.pi)) * np.sin(p) * np.sin(t) / np.sqrt(2))
    assert np.allclose(got[-2, 2], -np.sqrt(15 / (32 * np.pi)) * np.sin(p) ** 2 * np.sin(2 * t) / np.sqrt(2))


def slow_fit(xyz, degree, rounds, tolerance):
    """The same fit with numpy alone."""
    centre = xyz.mean(axis=0)
    values, vectors = np.linalg.eigh(np.cov((xyz - centre).T))
    deviation = np.sqrt(values)
    turned = (xyz - centre) @ vectors * (deviation.max() / deviation)
    azimuth, zenith, r = np.arctan2(turned[:, 1], turned[:, 0]), np.arccos(turned[:, 2] / np.linalg.norm(turned, axis=1)), np.linalg.norm(turned, axis=1)
    a = shells.harmonics(azimuth, zenith, degree)
    c = np.linalg.lstsq(a, r, rcond=None)[0]
    for i in range(rounds):
        good = np.abs(r - a @ c) / r < tolerance / 2**i
        c = np.linalg.lstsq(a[good], r[good], rcond=None)[0]
    return (a @ c) / r, good.sum()


def test_shells_of_many_objects_equal_numpy(spark):
    rng = np.random.default_rng(1)
    clouds = {"round": sphere(rng, 3000, 49, (10, -20, 5)), "long": sphere(rng, 900, 30, (0, 0, 0), (1, 2, 0.5), 0.4), "dirty": np.concatenate([sphere(rng, 1500, 40, (5, 5, 5), noise=0.3), rng.uniform(-120, 120, (90, 3))])}
    rows = [(k, i, *map(float, p)) for k, v in clouds.items() for i, p in enumerate(v)] + [("round", -1, None, 1.0, 1.0), ("long", -1, float("nan"), 1.0, 1.0)]
    points = spark.createDataFrame(rows, "label string, i int, x double, y double, z double")
    found = shells.fit_shells(points, ["label"])
    told = {r.label: r for r in found.collect()}
    placed = shells.shell_coordinates(points.where("i >= 0"), found, ["label"]).collect()
    for k, v in clouds.items():
        share, n = slow_fit(v, 3, 2, 0.3)
        got = sorted((r.i, r.normalized_radius) for r in placed if r.label == k)
        assert told[k].n == n and np.allclose([1 / s for _, s in got], share, rtol=1e-6)
    assert abs(told["round"].coefficients[0] / np.sqrt(4 * np.pi) - 49) < 1.5 and 1300 < told["dirty"].n < 1560
    assert np.allclose(sorted(told["long"].deviations), sorted(np.sqrt(np.linalg.eigvalsh(np.cov(clouds["long"].T)))))


def test_distances_insides_and_density(spark):
    rng = np.random.default_rng(2)
    points = spark.createDataFrame([tuple(map(float, p)) for p in sphere(rng, 4000, 49, (49, 49, 49))], "x double, y double, z double")
    found = shells.fit_shells(points)
    asked = [(49.0, 49.0, 49.0), (49 + 60.0, 49.0, 49.0), (49.0, 49.0, 49 + 30.0)]
    query = spark.createDataFrame(asked, "x double, y double, z double")
    away = [r.distance_to_shell for r in shells.distance_to_shell(query, found, step=0.05).collect()]
    assert away == pytest.approx([49, 11, 19], abs=0.6)
    told = shells.shell_coordinates(query, found).collect()
    assert [r.inside_shell for r in told] == [True, False, True] and [r.radial_distance for r in told[1:]] == pytest.approx([11, -19], abs=0.6)
    density = sorted((r.bin, r.bin_center, r.counts, r.volume) for r in shells.radius_density(found, spacing=2.5, bin_width=0.1).collect())
    assert len(density) == 10 and sum(d[2] for d in density) == pytest.approx(1)
    assert density[0][3] == pytest.approx(4 / 3 * np.pi * 49**3, rel=0.03)
    even = np.array([d[2] / d[1] ** 2 for d in density])
    assert np.all(np.abs(even[2:] / even[-1] - 1) < 0.12)
