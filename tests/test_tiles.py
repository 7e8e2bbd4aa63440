import numpy as np
import pytest

from photonflow.operators import clumping, kinetics, spatial, tiles


@pytest.fixture
def cloud(spark, monkeypatch):
    """Points of which many share a place, in tiles of 20 at most: every kind of tile occurs."""
    monkeypatch.setattr(tiles, "MOST", 20)
    monkeypatch.setattr(tiles, "HELD", 2)
    rng = np.random.default_rng(3)
    p = rng.normal(0, 0.4, (250, 3))
    p[:50] = p[0]
    rows = [(int(i), *map(float, q)) for i, q in zip(rng.permutation(250), p)] + [(900, None, 0.0, 0.0), (901, float("nan"), 0.0, 0.0), (902, float("inf"), 0.0, 0.0)]
    ids = np.array([r[0] for r in rows[:250]])
    return spark.createDataFrame(rows, "i long, x double, y double, z double"), ids, p, np.sqrt(((p[:, None] - p[None]) ** 2).sum(axis=2))


def test_pair_histogram_of_crowded_tiles_equals_all_pairs(cloud):
    points, ids, _, d = cloud
    want = np.bincount((d[np.triu_indices(250, 1)] / 0.05).astype(int), minlength=200)[:8]
    assert [r.n for r in spatial.pair_histogram(points, ("x", "y", "z"), 8, 0.05, "i").orderBy("bin").collect()] == want.tolist()
    twins = points.unionAll(points.where("i < 5"))  # rows of one id are no pair
    more = np.concatenate([np.arange(250), np.flatnonzero(ids < 5)])
    whole = d[np.ix_(more, more)]
    whole = whole[ids[more][:, None] < ids[more][None]]
    want = np.bincount((whole / 0.05).astype(int), minlength=200)[:8]
    assert [r.n for r in spatial.pair_histogram(twins, ("x", "y", "z"), 8, 0.05, "i").orderBy("bin").collect()] == want.tolist()


def test_vector_pairs_of_crowded_tiles_equal_all_pairs(cloud):
    points, ids, p, d = cloud
    want: dict[tuple, int] = {}
    for i, j in np.argwhere((d < 0.4) & (ids[:, None] < ids[None])):
        dx, dy, dz = p[j] - p[i]
        theta = (np.arctan(dy / dx) if dx else np.sign(dy) * np.pi / 2) + np.pi / 2
        flat = np.hypot(dx, dy)
        phi = (np.arctan(dz / flat) if flat else np.sign(dz) * np.pi / 2) + np.pi / 2
        key = (int(d[i, j] / 0.1), min(int(theta * 8 / np.pi), 7), min(int(phi * 8 / np.pi), 7))
        want[key] = want.get(key, 0) + 1
    found = kinetics.vector_pair_histogram(points, 4, 0.1, 8, "i").collect()
    assert {(r.r_bin, r.theta_bin, r.phi_bin): r.n for r in found} == want


def test_rejection_looks_at_first_points_of_crowded_cells(spark, monkeypatch):
    """Cells hold many times the points that a round looks at, and many points share a place."""
    monkeypatch.setattr(clumping, "FIRST", 2)
    rng = np.random.default_rng(8)
    p = rng.uniform(0, 2, (500, 2))
    p[100:200] = p[7]
    rows = [(i, *map(float, q)) for i, q in enumerate(p)] + [(900, None, 0.0), (901, float("nan"), 0.0)]
    df = spark.createDataFrame(rows, "i long, x double, y double")
    kept: list[int] = []
    for i in range(500):
        if not any(np.hypot(*(p[i] - p[j])) < 0.3 for j in kept):
            kept.append(i)
    for block in (2.0, 32.0):
        assert {r.i for r in clumping.overlap_rejection(df, ("x", "y"), 0.3, "i", block=block).where("rejected = 0").collect()} == {*kept, 900, 901}


@pytest.mark.parametrize("minimum", [1, 4, 9])
def test_dbscan_by_cells_equals_all_pairs(spark, monkeypatch, minimum):
    """Crowded cells, points of one place, chains, borders between clusters, noise."""
    monkeypatch.setattr(tiles, "MOST", 12)
    rng = np.random.default_rng(12)
    p = np.concatenate([rng.normal(0, 0.1, (90, 2)), rng.normal((0.8, 0), 0.12, (60, 2)), np.full((40, 2), 0.4), rng.uniform(-1, 2, (60, 2))])
    near = np.sqrt(((p[:, None] - p[None]) ** 2).sum(axis=2)) < 0.1
    core = near.sum(axis=1) >= minimum
    label = np.where(core, np.arange(len(p)), len(p))
    while True:
        new = np.where(core, np.where(near & core[None] & core[:, None], label[None], len(p)).min(axis=1), len(p))
        if (new == label).all():
            break
        label = new
    border = np.where(near & core[None], label[None], len(p)).min(axis=1)
    want = np.where(border < len(p), border + 1, 0)
    df = spark.createDataFrame([(i, *map(float, q)) for i, q in enumerate(p)] + [(900, None, 0.0)], "i long, x double, y double")
    found = {r.i: r.dbscanClumpID for r in clumping.dbscan(df, ("x", "y"), 0.1, minimum, "i").collect()}
    assert found.pop(900) == (901 if minimum == 1 else 0)
    assert [found[i] for i in range(len(p))] == want.tolist()


def test_ring_counts_of_crowded_tiles_equal_all_pairs(spark, cloud):
    points, ids, p, d = cloud
    want = {(int(ids[i]), b): int(n) for i in range(250) for b, n in enumerate(np.bincount((d[i][d[i] < 0.5] / 0.1).astype(int), minlength=5)) if n}
    assert {(r.i, r.bin): r.n for r in tiles.neighbour_counts(points, None, ("x", "y", "z"), 5, 0.1, "i", "n").collect()} == want
    mask = spark.createDataFrame(p[:100:3].tolist(), "x double, y double, z double")
    e = d[:, :100:3]
    want = {(int(ids[i]) % 2, int(ids[i]), b): int(n) for i in range(250) for b, n in enumerate(np.bincount((e[i][e[i] < 0.5] / 0.1).astype(int), minlength=5)) if n}
    keyed = points.selectExpr("*", "i % 2 AS k")
    assert {(r.k, r.i, r.bin): r.w for r in tiles.neighbour_counts(keyed, mask, ("x", "y", "z"), 5, 0.1, "i", "w", ["k"]).collect()} == want
    want = {(int(ids[i]) % 2, int(ids[i])): int(n) for i, n in enumerate(((d < 0.5) & (ids[:, None] % 2 == ids % 2)).sum(axis=1))}
    found: dict[tuple, int] = {}
    for r in tiles.neighbour_counts(keyed, None, ("x", "y", "z"), 5, 0.1, "i", "n", ["k"]).collect():
        found[r.k, r.i] = found.get((r.k, r.i), 0) + r.n
    assert found == want


def test_density_of_crowded_tiles_equals_all_pairs(cloud):
    points, ids, _, d = cloud
    found = {r.i: (r.n, r.density) for r in spatial.local_density(points, ("x", "y", "z"), 7, 0.5, "i").collect()}
    for i in range(250):
        near = np.sort(np.delete(d[i], i)[np.delete(d[i], i) < 0.5])[:7]
        if not len(near):
            assert int(ids[i]) not in found
            continue
        n, density = found[int(ids[i])]
        total = (near**6).sum()
        assert n == len(near) and (density == pytest.approx((near**3 * np.arange(1, len(near) + 1)).sum() / total) if total else density is None)


@pytest.mark.parametrize("kind", ["int", "string"])
def test_nearest_among_crowded_tiles_equals_all_pairs(spark, cloud, kind):
    """A start that spans all points is halved first; equally near ones (points of one place) are told by the least id."""
    points, ids, _, d = cloud
    name = (lambda i: int(i)) if kind == "int" else str
    df = points.where("i < 900").selectExpr(f"cast(i AS {kind}) AS i", "x", "y", "z")
    found = {r.i: (r.neighbour, r.distance) for r in spatial.nearest(df, df, ("x", "y", "z"), 4.0, "i", same=True).collect()}
    for i in range(250):
        e = np.where(np.arange(250) == i, np.inf, d[i])
        assert found[name(ids[i])] == (min(name(ids[j]) for j in np.flatnonzero(e == e.min())), pytest.approx(e.min()))
    assert len(found) == 250 and spatial._spread_radius(df, ("x", "y", "z"), 4.0)[1] > 0


def test_nearest_of_points_whose_first_tiles_hold_nothing_near(spark):
    """The two meet by their cells in the first round, but are not near."""
    a, b = (spark.createDataFrame([(i, *map(float, p))], "i long, x double, y double") for i, p in ((1, (0.1, 0.1)), (2, (1.9, 1.9))))
    assert [(r.i, r.neighbour) for r in spatial.nearest(a, b, ("x", "y"), 1.0, "i").collect()] == [(1, 2)]
