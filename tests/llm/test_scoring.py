import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from photonflow.llm import attention, scoring
from photonflow.llm.langid import remainder


def test_windows_score_each_target_once():
    rng = np.random.default_rng(1)
    lengths = [1, 7, 8, 9, 40]
    before = rng.integers(0, 50, sum(lengths))
    starts = np.cumsum([0, *lengths[:-1]])
    inputs, places = attention.windows(before, starts)
    assert sorted(places[places >= 0]) == list(range(len(before)))
    for row, at in zip(inputs, places, strict=True):
        for j in range(8):
            if at[j] >= 0:
                begin = max(s for s in starts if s <= at[j])
                seen = [attention.START] * 16 + list(before[begin : at[j] + 1])
                assert list(row[: 9 + j]) == seen[len(seen) - 9 - j :]


def test_gradient_and_scorer_agree_with_differences():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 30, (5, 16)).astype(np.uint16)
    y = rng.integers(0, attention.OUTPUTS + 1, (5, 8))
    weight = rng.random((5, 8)) * (rng.random((5, 8)) < 0.8)
    out = attention.Outputs.of(rng.random((attention.RANKS + 1, attention.OUTPUTS + 1)))
    w = attention.start_weights()
    attention.named(w)["o"][:] = rng.normal(0, 0.3, attention.SHAPES["o"])
    attention.named(w)["r"][:] = rng.normal(0, 0.3, 16)
    wide = w.astype(np.float64)
    loss = lambda flat: -(attention.gradient(flat, out, x, y, weight)[0].reshape(5, 8) * weight).sum() / weight.sum()
    grad = attention.gradient(wide, out, x, y, weight)[1]
    scored = attention.Scorer(w, out).log_probability(x, y) - out.members[x[:, 8:], y]
    assert abs(loss(wide) + (scored * weight).sum() / weight.sum()) < 1e-4
    which = np.concatenate([np.full(int(np.prod(s)), i) for i, s in enumerate(attention.SHAPES.values())])
    for i in range(len(attention.SHAPES)):
        for at in np.flatnonzero(which == i)[:480:97]:
            up, down = wide.copy(), wide.copy()
            up[at] += 1e-4
            down[at] -= 1e-4
            assert abs((loss(up) - loss(down)) / 2e-4 - grad[at]) < 1e-6


def test_all_probabilities_sum_to_one():
    rng = np.random.default_rng(3)
    out = attention.Outputs.of(rng.integers(0, 3, (attention.RANKS + 1, attention.OUTPUTS + 1)).astype(float))
    assert sorted(out.place) == list(range(attention.OUTPUTS + 1))
    x = np.repeat(rng.integers(0, 99, (1, 16)).astype(np.uint16), attention.OUTPUTS + 1, axis=0)
    y = np.repeat(np.arange(attention.OUTPUTS + 1)[:, None], 8, axis=1)
    assert np.allclose(np.exp(attention.Scorer(attention.start_weights(), out).log_probability(x, y)).sum(axis=0), 1, atol=1e-4)
    v = scoring.Vocabulary.of(np.array([5.0, 0, 9, *range(3000), 0]))
    assert np.isclose(np.exp(v.share[v.rank >= attention.OUTPUTS]).sum(), 1) and not v.share[v.rank < attention.OUTPUTS].any()


def test_subwords_of_many_words_equal_those_of_each():
    encoder = scoring.subwords_of(scoring.VOCABULARY)
    words = ["the", "Ünïcode", "x's", "12a,b!", "a\u00a0", "\u00a0b", "\u3000", "日本", "'s"]
    for some in (words[:4], words, ["", *words], [""], ["\u00a0"]):
        ids, starts = encoder.encode([w.encode() for w in some])
        assert [list(x) for x in np.split(ids, starts[1:])] == [encoder.ids(w.encode()) for w in some]


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def slow_net(net, before, ids, taken):
    """ln of the probability of ids[i] after the input ranks before[: i + 1], attending one by one."""
    p = {k: v.astype(float) for k, v in attention.named(net.weights).items()}
    total = 0.0
    for i, target in enumerate(ids):
        begin = i // 8 * 8 - 8
        seen = [before[j] if j >= 0 else attention.START for j in range(begin, i + 1)]
        at = p["e"][seen[-1]]
        odds = [float(at @ p["q"] @ (p["e"][x] @ p["k"])) / 4 + p["r"][len(seen) - 1 - j] for j, x in enumerate(seen)]
        share = np.exp(np.array(odds) - max(odds))
        share /= share.sum()
        s = (at + sum(a * (p["e"][x] @ p["v"]) for a, x in zip(share, seen, strict=True))) @ p["w"] + p["b"]
        logits = s / (1 + abs(s)) @ p["o"] + net.outputs.odds[seen[-1]]
        place = net.outputs.place[min(net.vocabulary.rank[target], attention.OUTPUTS)]
        total += logits[place // 32] - np.log(np.exp(logits).sum()) + net.outputs.members[seen[-1], place] + net.vocabulary.share[target]
        taken.append(total)
    return total


def slow_score(model, inner, counts, text):
    encoder = scoring.subwords_of(scoring.VOCABULARY)
    rank = lambda i: min(model.inputs.rank[i], attention.RANKS - 1)
    pieces = [encoder.ids(w.encode()) for w in split(text)]
    before = [attention.START, *(rank(p[-1]) for p in pieces)]
    slow_net(model.outer, before, [*(p[0] for p in pieces), encoder.end], sums := [])
    out = 0.0
    for w, p, outside in zip([*split(text), None], [*pieces, None], np.diff([0, *sums]), strict=True):
        own = slow_net(inner, [rank(i) for i in p], [*p[1:], encoder.end], []) if p else 0
        out += math.log10((1 - model.corpus) * math.exp(outside + own) + model.corpus * counts[w] / model.n)
    return out


@pytest.mark.parametrize("chunk", [scoring.CHUNK, 40])
def test_scores_equal_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(scoring, "CHUNK", chunk)
    monkeypatch.setattr(scoring, "PART", max(16, chunk >> 4))
    monkeypatch.setattr(scoring, "ENTRIES", chunk)
    models, inners, done = [], [], scoring._inner
    final = scoring._score
    monkeypatch.setattr(scoring, "_score", lambda c, m: (models.append(m), final(c, m))[1])
    monkeypatch.setattr(scoring, "_inner", lambda *a: (inners.append(done(*a)), inners[-1])[1])
    rng = random.Random(4)
    words = [f"{a}{b}" for a in ("ka", "Lo", "mi", "é") for b in ("to", "re", "x", "")]
    pick = lambda k: words[k % 2 :: 2][min(int(rng.expovariate(0.6)), 7)]
    # words of two kinds take turns, which only the words before can tell
    rows = [(i, " ".join(pick(k) + ("" if rng.random() < 0.98 else str(rng.randrange(99))) for k in range(rng.randrange(1, 60)))) for i in range(150)]
    rows += [(200, None), (201, ""), (None, "ka to"), (202, "zz " * 3000), (3, rows[3][1]), (3, rows[3][1]), (4, "other words 1"), (203, "a\u00a0b \u00a0 tail" + "y" * 300)]
    docs = spark.createDataFrame([(*r, 1.0, "q") for r in rows], "doc_id long, text string, score double, key string").repartition(3)
    got = scoring.score(docs, remainder(F.col("doc_id"), 7) != 2).collect()
    train = Counter(w for k, t in rows if k is not None and zlib.crc32(str(k).encode()) % 7 != 2 for w in [*split(t), None])
    n, v = sum(train.values()), len(train)
    want = sorted((str(k), len(split(t)) + 1, sum(train[w] > 0 for w in [*split(t), None]), n, round(sum(math.log10((train[w] + 1) / (n + v + 1)) for w in [*split(t), None]), 4)) for k, t in rows)
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    model, inner = models[0], inners[0]
    assert (model.n, model.v) == (n, v) and 0 < model.corpus < 1
    by = {}
    for r in got:
        by.setdefault(str(r.doc_id), set()).add(round(r.score, 6))
    for k, t in [*rows[5:15], *rows[150:153], rows[-1]]:
        assert any(abs(slow_score(model, inner, train, t) - s) < 1e-3 * (1 + abs(s)) for s in by[str(k)]), k
    held = [r for r in got if r.doc_id is not None and r.doc_id < 150 and zlib.crc32(str(r.doc_id).encode()) % 7 == 2]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert scoring.score(docs.where("false"), F.lit(True)).count() == 0
    assert len(scoring.score(docs, F.lit(None).cast("boolean")).collect()) == len(rows)


def test_every_training_token_teaches(spark, monkeypatch):
    told, fitted = [], scoring._fitted
    monkeypatch.setattr(scoring, "_fitted", lambda *a: (told.append(fitted(*a)), told[-1])[1])
    monkeypatch.setattr(scoring, "PART", 50)
    docs = spark.createDataFrame([(i, f"one two three n{i}") for i in range(90)], "doc_id long, text string")
    tables, of = [], attention.Outputs.of
    monkeypatch.setattr(attention.Outputs, "of", classmethod(lambda cls, table: (tables.append(table.copy()), of(table))[1]))
    assert scoring.score(docs, F.col("doc_id") < 80).count() == 90
    assert tables[1].sum() == told[1][1][1] == 80 * 5
