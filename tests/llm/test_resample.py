import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from photonflow.llm import resample

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text):
    return re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def features(text):
    w = words(text)
    return w + [f"{a} {b}" for a, b in zip(w, w[1:])]


def slow(docs, items):
    count = lambda texts: [n for n in np.bincount([zlib.crc32(f.encode()) % 10_000 for t in texts for f in features(t)] or [0], minlength=10_000) - (0 if any(features(t) for t in texts) else np.eye(1, 10_000, dtype=int)[0])]
    s, t = count([x for _, x in docs]), count(items)
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + 10_000) / ((a + 1) * (sum(t) + 10_000)))) for a, b in zip(s, t)]
    rows = []
    for k, text in docs:
        f = features(text)
        weight = sum(gain[zlib.crc32(x.encode()) % 10_000] for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if k is None else k}".encode()).hexdigest()[:8], 16)
        rows.append((k, len(words(text)), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    pool = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    drawn = pool[: 25 * len(pool) // 100]
    rest = [r for r in rows if r[1] < 20] + pool[len(drawn) :]
    return sorted([(*r, i + 1) for i, r in enumerate(drawn)] + [(*r, None) for r in rest], key=str)


@pytest.mark.parametrize("n", [1, 2, 3])
def test_crcs_equal_zlib(n):
    rng = random.Random(n)
    w = [bytes(rng.randrange(128, 256) for _ in range(rng.choice([1, 2, 5, 63, 64, 127, 128, 129, 300, 5000]))) for _ in range(120)]
    starts = np.cumsum([0, *map(len, w)])[:-1]
    got, _ = resample.crcs(np.frombuffer(b"".join(w), np.uint8), starts, n)
    assert got.tolist() == [zlib.crc32(b" ".join(w[i : i + n])) for i in range(len(w) - n + 1)]


def test_long_crc_equals_zlib():
    rng = random.Random(1)
    for size in (0, 1, 127, 128, 129, 255, 256, 257, 40_000, 1_000_003):
        data = rng.randbytes(size)
        assert resample.long_crc(np.frombuffer(data, np.uint8)) == zlib.crc32(data)


def some(rng, n):
    return " ".join(rng.choice(["Alpha", "beta,", "GAMMA;", "délta", "12", "e-f", "\U0001f600", "z" * 150]) for _ in range(n))


@pytest.mark.parametrize("block", [resample.BLOCK, 64, 1])
def test_buckets_at_any_block_size(monkeypatch, block):
    monkeypatch.setattr(resample, "BLOCK", block)
    rng = random.Random(block)
    texts = [some(rng, rng.randrange(60)) for _ in range(40)] + ["", " ", "one", "x" * 3000, ", ".join("ab" * 50), " a"]
    got = [[] for _ in texts]
    counted = np.zeros(len(texts), int)
    for who, what, owner in resample.buckets([np.frombuffer(t.encode(), np.uint8) for t in texts]):
        counted += np.bincount(owner, minlength=len(texts))
        for i, b in zip(who, what):
            got[i].append(int(b))
    assert counted.tolist() == [len(words(t)) for t in texts]
    assert [sorted(g) for g in got] == [sorted(zlib.crc32(f.encode()) % 10_000 for f in features(t)) for t in texts]


def test_resample_equals_brute_force(spark, monkeypatch):
    rng = random.Random(2)
    docs = [(i, some(rng, rng.randrange(15, 40))) for i in range(200)] + [(None, some(rng, 30)), (None, None), (300, None), (301, ""), (302, "... --"), (303, "w " * 30_000), (5, some(rng, 25))]
    docs += [(400, some(rng, 21))] * 3 + [(500 + i, docs[0][1]) for i in range(60)]
    items = [some(rng, 5) for _ in range(20)] + [None, "", "alpha beta alpha beta"]
    d = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, weight int")
    b = spark.createDataFrame([(t,) for t in items], "text string")
    for target, plain in ((b, items), (b.where("false"), [])):
        got = sorted(((r.doc_id, r.n_words, r.n_features, r.weight, r.score, r.rank) for r in resample.resample(d, target).collect()), key=str)
        assert got == slow(docs, plain)
    assert resample.resample(d.where("false"), b).count() == 0
