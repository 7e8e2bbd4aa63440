import hashlib
import random
import re

import numpy as np
import pytest

from photonflow.llm import substring


def slow(rows):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    low = {}
    for (k, _), w in zip(rows, words, strict=True):
        for i in range(len(w) - 49):
            if k is not None:
                key = tuple(w[i : i + 50])
                low[key] = min(low.get(key, k), k)
    out = []
    for (k, _), w in zip(rows, words, strict=True):
        gone = {p for i in range(len(w) - 49) if k is not None and low[tuple(w[i : i + 50])] < k for p in range(i, i + 50)}
        out.append((str(k), len(w), len(gone), hashlib.sha256(" ".join(x for p, x in enumerate(w) if p not in gone).encode()).hexdigest()))
    return sorted(out)


def test_minimisers_depend_on_the_window_alone():
    rng = random.Random(1)
    words = [str(rng.randrange(50)).encode() for _ in range(130)]
    whole = substring.minimisers(words)
    assert len(whole) == 81
    assert [int(x) for x in whole] == [int(substring.minimisers(words[i : i + 50])[0]) for i in range(81)]
    assert sum(n for _, n in substring.runs(whole, 3)) == 81
    assert substring.runs(np.array([4, 4, 4, 4, 7]), 3) == [(0, 3), (3, 1), (4, 1)]


@pytest.mark.parametrize("hot", [5000, 2])
def test_equals_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(substring, "HOT", hot)
    monkeypatch.setattr(substring, "RUN", 20)
    rng = random.Random(6)
    some = lambda n: [f"w{rng.randrange(3000)}é" for _ in range(n)]
    shared = [some(n) for n in (49, 50, 55, 120, 300)]
    rows = [(0, None), (1, ""), (2, "a " * 700), (3, "a\n" * 60), (4, "a " * 49), (None, " ".join(shared[4])), (None, None)]
    for i in range(10, 60):
        parts = [some(rng.randrange(80))]
        for _ in range(rng.randrange(3)):
            s = rng.choice(shared)
            parts += [s[rng.randrange(5) :], some(rng.randrange(70))]
        rows.append((i, rng.choice([" ", "\n", " \t"]).join(w for p in parts for w in p)))
    rows += [(rng.randrange(100, 200), rows[rng.randrange(8, 40)][1]) for _ in range(12)] + [(20, " ".join(shared[4])), (5, " ".join(shared[3] + shared[4]))]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, n_words int, mini int").repartition(3)
    got = [(str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in substring.repeated_passages(docs).collect()]
    assert sorted(got) == slow(rows)
    kept = substring.without_repeats(docs)
    assert kept.columns == docs.columns
    left = sorted((str(r.doc_id), hashlib.sha256(" ".join((r.text or "").split()).encode()).hexdigest()) for r in kept.collect())
    assert left == sorted((k, h) for k, n, gone, h in slow(rows) if n == 0 or gone < n)
    assert substring.repeated_passages(docs.where("false")).count() == 0
