import random
import re

from photonflow.llm import license

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def slow_base(text):
    words = re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hits = [(i, label) for phrase, label in license.BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    at = [i for i, _ in hits]
    return len(words), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits}))


def test_scan(spark):
    texts = [
        None, "", "nothing here", "The MIT License. the mit\nlicense MIT-License", "Licensed under the Apache License, Version 2.0.", "mit mit license general public license",
        "word " * 20000 + "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0.", "public license of apache under the general version", "éapache license",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
    ]
    rows = [*enumerate(texts), (None, texts[3]), (3, texts[3])]
    docs = spark.createDataFrame([(a, b, 1.0) for a, b in rows], "doc_id long, text string, score double")
    got = license.scan_licenses(docs).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    for i, t in enumerate(texts):
        r = by_id[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == slow_base(t)
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert by_id[4].labels == "apache,apache-2.0" and by_id[4].score > 0.9
    assert by_id[6].labels == "gpl,gpl-3.0" and by_id[7].labels == "cc-by-nc" and by_id[10].labels == "mit"
    assert by_id[8].labels == "" and by_id[9].base_labels == ""
    assert license.scan_licenses(docs.where("false")).count() == 0


def test_every_notice_of_one_file_is_found(spark):
    notices = " ... ".join(f"{text} filler{i}" for i, (_, text, _) in enumerate(license.TEMPLATES))
    common = "licensed under the apache license version 2 0 gnu general public license version 3 cc by 4 0"
    # words of the short notices are frequent in the corpus, those of the long ones rare
    rows = [(0, notices), *((i, " ".join(reversed(common.split()))) for i in range(1, 60))]
    got = {r.doc_id: r for r in license.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got[0].labels.split(",")) == {label for label, _, _ in license.TEMPLATES} | {"mit", "apache", "gpl"}
    assert got[1].labels == "" and got[0].score > 0.99


def test_labels_equal_an_alignment_at_every_place(spark):
    rng = random.Random(3)
    vocabulary = sorted(w.decode() for w in license.VOCABULARY)
    texts = []
    for i in range(120):
        parts = []
        for _, text, phrases in rng.sample(license.TEMPLATES, rng.randrange(4)):
            words = text.split()
            for _ in range(rng.randrange(len(words) // 2)):
                k = rng.randrange(len(words))
                words[k : k + rng.randrange(2)] = rng.choice([[], ["inserted"], [rng.choice(vocabulary)]])
            parts += [*words, *(rng.choice(vocabulary) for _ in range(rng.randrange(9))), *rng.choice([[], *(p.split() for p in phrases)])]
        texts.append(" ".join(parts))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    index = license.Index(license.inverse_frequencies(docs.withColumnRenamed("doc_id", "id")))
    seen = set()
    for r in license.scan_licenses(docs).collect():
        words = [w.encode() for w in texts[r.doc_id].split()]
        best, labels = 0.0, set(filter(None, r.base_labels.split(",")))
        for t, (label, text, phrases) in enumerate(license.TEMPLATES):
            if all(f" {p} " in f" {texts[r.doc_id]} " for p in phrases):
                share = max(license.aligned(words, s, t, index) for s in range(-len(text.split()) - 2, len(words)))
                if share >= license.SHARE:
                    labels.add(label)
                    best = max(best, share)
        assert (set(filter(None, r.labels.split(","))), round(r.score, 9)) == (labels, round(min(1.0, best), 9))
        seen |= labels
    assert len(seen) > 10
