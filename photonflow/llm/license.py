"""License scans by a positional index of rare template words."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from photonflow.llm.common import alnum_words, byte_rows

#: Fixed: phrases whose places are counted, and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Licence notices: label, text, and phrases that must stand in the file.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted free of charge",)),
    ("mit", "released under the mit license", ("mit license",)),
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    ("gpl-2.0", "this work is licensed under the gnu general public license version 2", ("general public license version 2",)),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", ("general public license version 3",)),
    ("lgpl", "this library is licensed under the gnu lesser general public license", ("lesser general public license",)),
    ("agpl", "licensed under the gnu affero general public license version 3", ("affero general public license",)),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ("redistribution and use in source and binary forms",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    ("cc-by", "licensed under cc by 4 0", ("cc by 4 0",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("distribute this software for any purpose with or without fee",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software released into the public domain",)),
)
#: Insertions tolerated; aligned share of a template's IDF needed.
SLACK = 2
SHARE = 0.6


def _words(text: str) -> list[bytes]:
    return alnum_words(text.encode())


@dataclass
class Index:
    """Of every template, its words, their IDF weights, and the rarest words with their positions: those of the highest IDF
    that together carry more than 1 - SHARE of it, so that no place with a share of SHARE lacks them all."""

    idf: dict[bytes, float]
    rarest: list[list[tuple[bytes, list[int]]]] = field(default_factory=list)
    labels: list[str] = field(default_factory=list)
    words: list[list[bytes]] = field(default_factory=list)
    phrases: list[list[list[bytes]]] = field(default_factory=list)

    def __post_init__(self):
        for label, text, phrases in TEMPLATES:
            self.labels.append(label)
            self.words.append(_words(text))
            self.phrases.append([_words(p) for p in phrases])
            at: dict[bytes, list[int]] = defaultdict(list)
            for q, w in enumerate(self.words[-1]):
                at[w].append(q)
            whole = sum(self.idf[w] for w in self.words[-1])
            some, carried = [], 0.0
            for w, positions in sorted(at.items(), key=lambda x: (-self.idf[x[0]], x[0])):  # of equal IDF, by the alphabet
                if carried > (1 - SHARE) * whole + 1e-9:
                    break
                some.append((w, positions))
                carried += self.idf[w] * len(positions)
            self.rarest.append(some)
        self.base = [(_words(p), label) for p, label in BASE.items()]
        self.weight = [sum(self.idf[w] for w in words) for words in self.words]


VOCABULARY = frozenset(w for _, text, phrases in TEMPLATES for part in (text, *phrases, *BASE) for w in _words(part))


def places(words: list[bytes], where: dict[bytes, list[int]], phrase: list[bytes]) -> list[int]:
    return [p for p in where.get(phrase[0], ()) if words[p : p + len(phrase)] == phrase]


def aligned(words: list[bytes], start: int, t: int, index: Index) -> float:
    """The share of a template's IDF whose words stand at their places from `start` on, or up to SLACK words later."""
    stands = lambda at, w: any(0 <= at + s < len(words) and words[at + s] == w for s in range(SLACK + 1))
    return sum(index.idf[w] for q, w in enumerate(index.words[t]) if stands(start + q, w)) / index.weight[t]


def scan(text: bytes | None, index: Index) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score of a text; a null text counts as empty."""
    words = alnum_words(text)
    known = VOCABULARY.intersection(words)
    if not known:
        return len(words), 0, None, None, "", "", 0.0
    where: dict[bytes, list[int]] = {w: [] for w in known}
    for p, w in enumerate(words):
        if w in known:
            where[w].append(p)
    found = [(p, label) for phrase, label in index.base for p in places(words, where, phrase)]
    base = {label for _, label in found}
    score, labels = 0.0, set(base)
    for t, rarest in enumerate(index.rarest):
        if not all(places(words, where, p) for p in index.phrases[t]):
            continue
        starts = {p - q - s for w, at in rarest for p in where.get(w, ()) for q in at for s in range(SLACK + 1)}
        share = max((aligned(words, start, t, index) for start in starts), default=0.0)
        if share >= SHARE:
            labels.add(index.labels[t])
            score = max(score, min(1.0, share))
    starts = [p for p, _ in found]
    return len(words), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score


def inverse_frequencies(docs: DataFrame) -> dict[bytes, float]:
    """IDF of the template words (a fixed, short list) over all texts (columns id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter[bytes] = Counter()
        for batch in batches:
            for _, text in byte_rows(batch, "id", "text"):
                n[b""] += 1
                n.update(VOCABULARY.intersection(alnum_words(text)))
        yield pa.record_batch([pa.array([w.decode() for w in n], pa.string()), pa.array(list(n.values()), pa.int64())], names=["word", "n"])

    counts = {r["word"].encode(): r["n"] for r in docs.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}
    total = counts.get(b"", 0)
    return {w: log((total + 1) / (counts.get(w, 0) + 0.5)) + 1e-9 for w in VOCABULARY}


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Base labels are those of the base phrases found. A template's label is added where its mandatory phrases stand in the
    file and the words aligned at one place carry SHARE of its IDF; places to look at are those that one of the template's rarest
    words tells. The score is the largest such share, 0 without any. A null text counts as empty. Repeated rows are scanned
    alike; an empty table gives no rows; other columns are not read. A text is split whole, however long, in one task.
    """
    docs = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    index = Index(inverse_frequencies(docs))
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64()]
    names = ["id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [scan(text, index) for _, text in byte_rows(batch, "id", "text")]
            columns = [pa.array([r[i] for r in found], kind) for i, kind in enumerate(kinds)]
            yield pa.record_batch([batch.column("id"), *columns], names=names)

    schema = f"id {docs.schema['id'].dataType.simpleString()}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return docs.mapInArrow(run, schema).withColumnRenamed("id", id_col)
