import math
import random
import zlib
from collections import Counter

import numpy as np

from photonflow.llm import langid


def test_counts_equal_one_text_at_a_time():
    texts = ["", "a", "Ab cd", "  é!!ß \n x", "日本 語", "𝔸𝔹c", "123", "😀 😀", "𐐀😀"]
    whole, has = langid.counts([t.encode() for t in texts])
    assert list(has) == [any(ch.isalpha() for ch in t) for t in texts]
    for t, row in zip(texts, whole, strict=True):
        assert np.array_equal(langid.counts([t.encode()])[0][0], row)
    assert np.array_equal(langid.counts([b"Ab, cd."])[0], langid.counts([b"aB cD"])[0])


def test_identify_held_out_and_awkward_rows(spark):
    rng = random.Random(3)
    sounds = {"aa": ["ka", "lo", "mi"], "bb": ["sch", "ung", "ber"], "cc": ["è", "eau", "tion"]}
    rows = [(i, " ".join("".join(rng.choice(sounds[lang]) for _ in range(3)) for _ in range(rng.randrange(5, 40))), lang) for i in range(240) for lang in [rng.choice(list(sounds))]]
    rows += [(300, None, "aa"), (301, "", "aa"), (302, "123 !!", "bb"), (303, "kalomi kalomi", None), (None, "schung berung", "bb"), (304, "kalomi " * 20000, "aa"), (0, rows[0][1], rows[0][2]), (305, "щука " * 20, "cc")]
    docs = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, lang string, score double")
    import pyspark.sql.functions as F

    got = langid.identify(docs, langid.remainder(F.col("doc_id"), 5) != 0).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[300].lang_pred == by[301].lang_pred == by[302].lang_pred == "und" and by[303].lang_pred == "aa" and by[304].lang_pred == "aa" and by[None].lang_pred == "bb"
    held = [r for r in rows[:240] if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert held and np.mean([by[k].lang_pred == lang for k, _, lang in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in got) and by[305].rejected and sum(r.rejected for r in got) < 20
    assert langid.identify(docs.where("false"), F.lit(True)).count() == 0
    assert {r.lang_pred for r in langid.identify(docs, F.lit(False)).collect()} == {"und"}


def plain_counts(text):
    """Hashed features of a text's n-grams of one to three letters and spaces, a run of spaces being one; n-grams by hand."""
    folded = "".join(c.lower()[0] if c.isalpha() else " " for c in f" {text} ")
    letters = "".join(c for i, c in enumerate(folded) if c != " " or i == 0 or folded[i - 1] != " ")
    out = Counter()
    for i in range(len(letters)):
        code = 0
        for n, c in enumerate(letters[i : i + 3], 1):
            code = (ord(c) * 2654435761 if n == 1 else (code ^ (ord(c) + n)) * 2246822519) % 2**32
            out[code >> 21] += 1
    return out


def plain_vector(count, idf):
    v = np.zeros(2048)
    for f, n in count.items():
        v[f] = math.log1p(n) * idf[f]
    return v / max(np.linalg.norm(v), 1e-9)


def plain_clusters(v):
    centres = [v.mean(axis=0) / np.linalg.norm(v.mean(axis=0))]
    while len(centres) < min(4, len(v)):
        centres.append(min(v, key=lambda x: max(x @ c for c in centres)))
    for _ in range(12):
        own = [max(range(len(centres)), key=lambda i: x @ centres[i]) for x in v]
        sums = [sum(x for x, o in zip(v, own) if o == i) for i in sorted(set(own))]
        centres = [s / np.linalg.norm(s) for s in sums]
    sizes = Counter(max(range(len(centres)), key=lambda i: x @ centres[i]) for x in v)
    return [c for i, c in enumerate(centres) if sizes[i] >= min(max(sizes.values()), max(2, len(v) / 50))]


def test_predictions_equal_plain_centroids(spark):
    import pyspark.sql.functions as F

    rng = random.Random(8)
    sounds = {"aa": ["ka", "lo", "mi", "É"], "bb": ["sch", "ung", "ber"], "cc": ["è", "eau", "tion", "日本"]}
    word = lambda lang: "".join(rng.choice(sounds[lang]) for _ in range(3))
    rows = [(i, ", ".join(word(lang) for _ in range(rng.randrange(3, 20))), lang) for i in range(150) for lang in [rng.choice(list(sounds))]]
    rows += [(i, " ".join(word(rng.choice(list(sounds))) for _ in range(9)), None) for i in range(200, 230)] + [(300, "12 -- 3", "aa"), (301, None, "bb"), (302, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    training = F.col("doc_id") % 3 != 0
    place = {r.doc_id: r.p for r in docs.select("doc_id", F.xxhash64("doc_id", "lang", "text").alias("p")).collect()}
    learned = sorted((r for r in rows if r[0] % 3 and r[2] and r[1] is not None), key=lambda r: place[r[0]])
    has = lambda t: any(c.isalpha() for c in t or "")
    df = Counter(f for _, t, _ in learned for f in plain_counts(t))
    idf = [math.log((len(learned) + 1) / (df[f] + 1)) + 1 for f in range(2048)]
    centres = []
    for lang in sorted(sounds):
        v = np.array([plain_vector(plain_counts(t), idf).astype(np.float16).astype(float) for _, t, k in learned if k == lang and has(t)])
        centres += [(lang, c) for c in plain_clusters(v)]
    got = {r.doc_id: r for r in langid.identify(docs, training).collect()}
    same = 0
    for k, t, _ in rows:
        if not has(t):
            assert got[k].lang_pred == "und" and got[k].score == 0
            continue
        cosines = sorted(((float(plain_vector(plain_counts(t), idf) @ c), lang) for lang, c in centres), reverse=True)
        assert abs(got[k].score - cosines[0][0]) < 5e-3
        same += got[k].lang_pred == cosines[0][1]
    assert same == sum(has(t) for _, t, _ in rows)
