import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from photonflow.llm import simhash


def slow_fingerprint(text, size=4):
    words = (text or "").lower().split()
    if not words:
        return 0
    grams = [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(fps, radius=4):
    ids = sorted(fps)
    parent = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for i in ids:
            for j in ids:
                if (fps[i] ^ fps[j]).bit_count() <= radius and parent[i] != parent[j]:
                    parent[i] = parent[j] = min(parent[i], parent[j])
                    changed = True
    return parent


def test_link_blocks_equals_brute_force():
    rng = random.Random(5)
    for n in (1, 2, 63, 64, 65, 300):
        seeds = [rng.getrandbits(64) for _ in range(max(1, n // 4))]
        fps = []
        for _ in range(n):
            x = rng.choice(seeds)
            for _ in range(rng.randrange(7)):
                x ^= 1 << rng.randrange(64)
            fps.append(x)
        cuts = sorted({rng.randrange(1, n + 1) for _ in range(3)} | {n})
        ends = np.array([next(c for c in cuts if c > i) for i in range(n)])
        got = simhash.link_blocks(np.array(fps, np.uint64), ends, 4, items_at_once=50)
        start = 0
        for c in cuts:
            want = slow_components({i: fps[i] for i in range(start, c)})
            assert [got[i] for i in range(start, c)] == [want[i] for i in range(start, c)]
            start = c


def test_pieces_of_any_number_cover_all_bits():
    for radius in range(7):
        for equal in range(2, 6):
            masks = [m % (1 << 64) for m in simhash._masks(radius + equal, equal)]
            assert len(set(masks)) == len(masks)
            rng = random.Random(radius)
            for _ in range(20):
                x = rng.getrandbits(64)
                y = x
                for b in rng.sample(range(64), radius):
                    y ^= 1 << b
                assert any(x & m == y & m for m in masks)


def test_near_duplicates_on_awkward_rows(spark, monkeypatch):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "one Two"), (4, "ONE two"), (5, "x " * 30000), (None, "one two"), (None, "lonely text here now")]
    for i in range(10, 70):
        base = [words[rng.randrange(400)] for _ in range(300)]
        rows.append((i, " ".join(base)))
        if i % 3 == 0:
            rows.append((i, " ".join(base)))
        if i % 2:
            base[rng.randrange(300)] = "edit"
            rows.append((i + 1000, " ".join(base)))
    docs = spark.createDataFrame([(a, b, 1, "q") for a, b in rows], "doc_id long, text string, fp int, id string")
    for tile, equal in ((2048, None), (4, 3)):
        monkeypatch.setattr(simhash.links, "__defaults__", (4, tile, equal))
        got = simhash.near_duplicates(docs, shingle=4).collect()
        assert len(got) == len(rows)
        fps = {a: slow_fingerprint(b) for a, b in rows if a is not None}
        want = slow_components(fps)
        by_text = {slow_fingerprint(b) for a, b in rows if a is None}
        for r in got:
            if r.doc_id is not None:
                assert (int(r.fingerprint, 16), r.component_id) == (fps[r.doc_id], want[r.doc_id])
            else:
                assert int(r.fingerprint, 16) in by_text
        assert sorted(str(r.component_id) for r in got if r.doc_id is None) == ["3", "None"]
    assert simhash.near_duplicates(docs.where("false")).count() == 0


def slow_near(texts, size=5, least=0.8):
    """Components of texts (by id) whose sets of shingles share so much."""
    sets = {}
    for i, t in texts.items():
        w = (t or "").lower().split()
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} or {tuple(w)}
    parent = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for i in sets:
            for j in sets:
                if parent[i] != parent[j] and len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]):
                    parent[i] = parent[j] = min(parent[i], parent[j])
                    changed = True
    return parent


def test_wide_distances_equal_brute_force():
    rng = random.Random(8)
    fps = []
    for _ in range(150):
        x = rng.choice(fps) if fps and rng.random() < 0.6 else rng.getrandbits(256)
        for b in rng.sample(range(256), rng.randrange(60)):
            x ^= 1 << b
        fps.append(x)
    words = np.frombuffer(b"".join(x.to_bytes(32, "little") for x in fps), np.uint64).reshape(-1, 4)
    for radius in (0, 7, 31, 44):
        got = simhash.link_blocks(words, np.full(150, 150), radius, items_at_once=40)
        want = slow_components(dict(enumerate(fps)), radius)
        assert got.tolist() == [want[i] for i in range(150)]


def test_verified_pairs_equal_brute_force():
    rng = random.Random(6)
    sets, ends = [], []
    for size in (1, 2, 90, 40):
        seeds = [np.array(rng.sample(range(1 << 60), 60), np.uint64) for _ in range(5)]
        start = len(sets)
        for _ in range(size):
            some = rng.choice(seeds).copy()
            some[: rng.randrange(16)] = rng.sample(range(1 << 60), 1)[0]
            sets.append(np.unique(some))
        sets.append(np.zeros(0, np.uint64))
        ends += [len(sets)] * (len(sets) - start)
    fps = np.frombuffer(b"".join(simhash.wide_fingerprint(s)[0] for s in sets), np.uint64).reshape(-1, 4)
    a, b = simhash.verified(fps, sets, np.array(ends), 256, 0.8)
    assert all(len(set(sets[i]) & set(sets[j])) >= 0.8 * len(set(sets[i]) | set(sets[j])) for i, j in zip(a, b))
    want, got = list(range(len(sets))), list(range(len(sets)))
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if ends[i] == ends[j] and len(set(sets[i]) & set(sets[j])) >= 0.8 * len(set(sets[i]) | set(sets[j]))]
    for tree, some in ((want, pairs), (got, zip(a, b))):
        for i, j in some:
            low, high = sorted((tree[i], tree[j]))
            tree[:] = [low if t == high else t for t in tree]
    assert got == want and len(a) < len(pairs)


def test_near_copies_link_from_the_limit_on(spark, monkeypatch):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(3000)]
    common = [rng.choice(words) for _ in range(100)]
    rows = [(0, None), (1, ""), (2, "one Two"), (3, "ONE two"), (None, "one two"), (None, "lonely text here now"), (4, " ".join(words)), (5, " ".join(words))]
    for i in range(10, 90):
        base = [rng.choice(words) for _ in range(rng.choice([60, 300, 900]))] + common * (i % 2)  # a passage of many texts
        rows.append((i, " ".join(base)))
        if i % 4 == 0:
            rows.append((i, " ".join(base).upper()))
        if i % 3:
            for k in rng.sample(range(len(base)), max(1, len(base) // 100)):
                base[k] = "edit"
            rows.append((i + 1000, "\n".join(base)))
    for i in range(90, 130):  # one run of other words leaves 200 - n of 200 + n shingles: 0.8 at 22
        base = [rng.choice(words) for _ in range(204)]
        rows.append((i, " ".join(base)))
        n = (20, 22, 23, 30)[i % 4]
        rows.append((i + 1000, " ".join([*base[: 204 - n], *(f"e{k}" for k in range(n))])))
    docs = spark.createDataFrame([(a, b, 1, "q") for a, b in rows], "doc_id long, text string, fp int, bands string")
    want = slow_near({a: b for a, b in rows if a is not None})
    assert all((want[i + 1000] == i) == (i % 4 < 2) for i in range(90, 130))
    for tile, size in ((2048, 1 << 25), (4, 1 << 25), (2048, 4000)):
        monkeypatch.setattr(simhash.band_links, "__defaults__", (simhash.WIDE_RADIUS, tile))
        monkeypatch.setattr(simhash.verified_links, "__defaults__", (simhash.WIDE_RADIUS, simhash.ALIKE, tile, size))
        got = simhash.near_copies(docs).collect()
        assert len(got) == len(rows)
        assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want
        assert sorted(str(r.component_id) for r in got if r.doc_id is None) == ["2", "None"]
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {None} | {k for k, v in want.items() if k == v}
    assert simhash.near_copies(docs.where("false")).count() == 0 and simhash.one_of_each(docs.where("false")).count() == 0
    named = docs.withColumn("doc_id", F.when(F.col("doc_id") < 9, F.lit("no number")).otherwise(F.col("doc_id").cast("string")))
    assert simhash.near_copies(named).count() == simhash.near_duplicates(named).count() == len(rows)
    assert simhash.one_of_each(named).where("doc_id = 'no number'").count() == 6
