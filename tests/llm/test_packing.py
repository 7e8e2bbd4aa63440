import random
from itertools import combinations

from photonflow.llm import packing


def slow_pad(histogram, buckets):
    lengths = sorted(histogram)
    best = None
    for k in range(1, min(buckets, len(lengths)) + 1):
        for pick in combinations(lengths[:-1], k - 1):
            ends = [*pick, lengths[-1]]
            pad = sum(n * (min(e for e in ends if e >= x) - x) for x, n in histogram.items())
            best = pad if best is None else min(best, pad)
    return best


def test_boundaries_are_optimal():
    rng = random.Random(8)
    assert packing.boundaries({}) == [] and packing.boundaries({5: 3}) == [5]
    for _ in range(25):
        h = {rng.randrange(0, 40): rng.randrange(1, 9) for _ in range(rng.randrange(1, 12))}
        for k in (1, 2, 3, 5, 20):
            ends = packing.boundaries(h, k)
            assert len(ends) <= k and ends[-1] == max(h) and ends == sorted(set(ends))
            assert sum(n * (min(e for e in ends if e >= x) - x) for x, n in h.items()) == slow_pad(h, k)


def slow_pack(rows, upper):
    """id, piece, bucket, batch, slot by plain numbering."""
    pieces = []
    for key, text in rows:
        n = len((text or "").split())
        pieces += [(key, i, min(2048, n - 2048 * i)) for i in range(max(1, -(-n // 2048)))]
    out, place = [], {}
    for key, i, n in sorted(pieces, key=lambda p: (p[0] is not None, p[0] or 0, *p[1:])):
        b = sum(u < n for u in upper)
        held = packing.BUDGET // max(1, upper[b])
        k = place[b] = place.get(b, -1) + 1
        out.append((key, i, n, b, k // held, k % held))
    return sorted(out, key=str)


def test_pack_equals_plain_numbering(spark):
    rng = random.Random(9)
    rows = [(0, None), (1, ""), (2, "a " * 4100), (3, "a " * 2048), (None, "b c"), (None, None), (5, "a b"), (5, "a b")] + [(i, "w " * rng.randrange(300)) for i in range(10, 150)]
    docs = spark.createDataFrame([(*r, 3, "x") for r in rows], "doc_id long, text string, piece int, bucket string")
    got = packing.pack(docs).collect()
    assert sum(r.n_tokens for r in got) == sum(len((t or "").split()) for _, t in rows)
    assert {r.doc_id for r in got} == {k for k, _ in rows} and sorted(r.start_token for r in got if r.doc_id == 2) == [0, 2048, 4096]
    batches = {}
    for r in got:
        assert r.n_tokens <= r.bucket_tokens
        batches.setdefault((r.bucket, r.batch, r.bucket_tokens), []).append(r.slot)
    for (_, _, upper), slots in batches.items():
        assert sorted(slots) == list(range(len(slots))) and len(slots) * max(1, upper) <= packing.BUDGET
    upper = sorted({r.bucket_tokens for r in got})
    assert sorted(((r.doc_id, r.piece, r.n_tokens, r.bucket, r.batch, r.slot) for r in got), key=str) == slow_pack(rows, upper)
    assert packing.pack(docs.where("false")).count() == 0
