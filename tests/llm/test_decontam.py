import random
import re

from photonflow.llm import decontam

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def split(text):
    return re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def slow(text, items, window=10):
    words, hit, names = split(text), set(), set()
    for k, t in items:
        w = split(t)
        size = min(window, len(w))
        grams = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if w else set()
        for i in range(len(words) - size + 1):
            if tuple(words[i : i + size]) in grams:
                hit |= set(range(i, i + size))
                names.add(k)
    return len(words), len(hit), len(names), sorted(str(k) for k in names if k is not None)


def test_contamination_equals_brute_force(spark, monkeypatch):
    rng = random.Random(7)
    some = lambda n, k=4: " ".join(rng.choice("abcdefgh"[:k]) for _ in range(n))
    items = [(1, some(30, 8)), (2, some(12)), (3, some(4)), (10, "A"[:0]), (11, None), (12, some(10)), (4, some(3, 8) + " z"), (13, "Über Maß"), (14, some(40, 2)), (15, some(25, 2)), (None, some(11, 8)), (None, "lost words"), (1, some(30, 8))]
    docs = [(0, None), (1, ""), (2, "x" * 50000), (None, items[0][1]), (7, some(3000)), (7, items[1][1])]
    for i in range(20, 60):
        at = rng.choice([t for _, t in items if t])
        docs.append((i, some(rng.randrange(15), 8) + ", " + at.upper()[: rng.randrange(1, 90)] + "! " + some(rng.randrange(15))))
    docs += [(99, items[7][1] + " " + items[8][1]), (100, "some LOST words"), (101, "x " + items[10][1] + " lost words")]
    d = spark.createDataFrame([(*r, "k") for r in docs], "doc_id long, text string, items string")
    b = spark.createDataFrame(items, "item_id long, text string")
    want = sorted((str(k), *slow(t, items)) for k, t in docs)
    for most in (400_000, 60, 8):
        got = decontam.contamination(d, b, shard_words=most).collect()
        assert sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r["items"]) for r in got) == want
    assert decontam.contamination(d.where("false"), b).count() == 0
    assert {r.n_hit for r in decontam.contamination(d, b.where("false")).collect()} == {0}


def test_clean_cuts_spans_and_leaves_the_rest(spark):
    item = " ".join(f"Word{i}" for i in range(20))
    docs = [(1, f"Start, here. {item.upper()}!\n" + "end " * 30, 7), (2, item, 9), (3, "fine text", 9), (4, None, None)]
    d = spark.createDataFrame(docs, "doc_id long, text string, n_chars long")
    b = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r.doc_id: (r.text, r.n_chars) for r in decontam.clean(d, b).collect()}
    text = "Start, here. !\n" + "end " * 30
    assert got == {1: (text, len(text)), 3: ("fine text", 9), 4: (None, None)}
