"""Benchmark decontamination with a generalised suffix automaton of the normalised items."""

from __future__ import annotations

import pickle
import re
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from photonflow.llm.common import ALNUM, alnum_words, byte_rows, only, shared_path, unused

WINDOW = 10
#: Words of items in one automaton, about; more items are dealt over several automata, of which a task has one at a time.
SHARD_WORDS = 400_000
#: Bytes of texts that a task takes through all automata together, where there are several.
HELD = 32 << 20
#: A document of which more than this share is hit goes as a whole in clean().
COVERAGE = 0.8


class Automaton:
    """Suffix automaton of several word sequences; substrings of items of any length are its paths."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.words: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.names = [name for name, _ in items]
        ends: list[list[int]] = []
        for _, words in items:
            last, path = 0, []
            for w in words:
                last = self._extend(last, self.words.setdefault(w, len(self.words) + 1))
                path.append(last)
            ends.append(path)
        n = len(self.next)
        holders: list[set[int]] = [set() for _ in range(n)]  # items a state's longest strings occur in
        self.short: list[list[tuple[int, int]]] = [[] for _ in range(n)]  # (length, item) of short items that end in a state
        self.shortest = window
        for k, path in enumerate(ends):
            # walk the item again: its prefixes' states are final only when all items are in
            state = 0
            ids = [self.words[w] for w in items[k][1]]
            for w in ids:
                state = self.next[state][w]
                up = state
                while up > 0 and k not in holders[up]:
                    holders[up].add(k)
                    up = self.link[up]
            if 0 < len(ids) < window:
                self.short[state].append((len(ids), k))
                self.shortest = min(self.shortest, len(ids))
        order = sorted(range(n), key=self.length.__getitem__)
        for v in order[1:]:  # an item that ends in a suffix ends here as well
            if self.short[self.link[v]]:
                self.short[v] = self.short[v] + self.short[self.link[v]]
        self.full: list[frozenset[int] | None] = [None] * n  # items that hold the window that ends a match in this state
        for v in order[1:]:
            if self.length[v] >= window:
                up = self.link[v]
                self.full[v] = frozenset(holders[v]) if self.length[up] < window else self.full[up]

    def _extend(self, last: int, w: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if w in nxt[last]:
            q = nxt[last][w]
            if length[q] == length[last] + 1:
                return q
            return self._clone(last, w, q)
        new = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p != -1 and w not in nxt[p]:
            nxt[p][w] = new
            p = link[p]
        if p != -1:
            q = nxt[p][w]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, w, q)
        return new

    def _clone(self, p: int, w: int, q: int) -> int:
        copy = len(self.next)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        self.link[q] = copy
        while p != -1 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        return copy

    def spans(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Spans [start, end) of the words inside windows of items, in order of their ends, and the items concerned."""
        get = self.words.get
        ids = [get(w, 0) for w in words]
        known = np.array(ids, np.int32) > 0
        edge = np.flatnonzero(np.diff(np.concatenate([[False], known, [False]]).astype(np.int8)))
        starts, ends = edge[::2], edge[1::2]
        wide = ends - starts >= self.shortest
        spans: list[tuple[int, int]] = []
        items: set[int] = set()
        nxt, link, length, window = self.next, self.link, self.length, self.window
        for s, e in zip(starts[wide].tolist(), ends[wide].tolist(), strict=True):
            state = run = 0
            for i in range(s, e):
                w = ids[i]
                while state and w not in nxt[state]:
                    state = link[state]
                    run = length[state]
                if w in nxt[state]:
                    state = nxt[state][w]
                    run += 1
                if run >= window:
                    spans.append((i + 1 - window, i + 1))
                    items |= self.full[state]
                for size, k in self.short[state]:
                    if size <= run:
                        spans.append((i + 1 - size, i + 1))
                        items.add(k)
        return spans, items


def _covered(spans: list[tuple[int, int]], n: int) -> np.ndarray:
    delta = np.zeros(n + 1, np.int64)
    for s, e in spans:
        delta[s] += 1
        delta[e] -= 1
    return np.cumsum(delta[:-1]) > 0


def _dealt(items: DataFrame, id_col: str, text_col: str, shard_words: int) -> tuple[DataFrame, int]:
    """Distinct items (name, text, shard), dealt by a hash into shards of about shard_words words, and how many shards there are."""
    rows = items.select(F.col(f"`{id_col}`").cast("string").alias("name"), F.col(f"`{text_col}`").cast("string").alias("text")).where("text is not null").distinct()
    words = rows.agg(F.sum(F.regexp_count("text", F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")))).first()[0] or 0
    shards = max(1, -(-words // shard_words))
    return rows.withColumn("shard", F.pmod(F.xxhash64("name", "text"), F.lit(shards))), shards


def _automaton(rows: Iterable[tuple[str | None, str]], window: int) -> Automaton:
    items = [(name, alnum_words(text.encode())) for name, text in rows]
    return Automaton(sorted((x for x in items if x[1]), key=lambda x: (x[0] or "", x[1])), window)


def _built(dealt: DataFrame, window: int) -> list[str]:
    """Where each shard's automaton was written in the shared folder, by the task that built it; a task that is run again writes the same."""
    folder = shared_path(dealt.sparkSession, "automata")

    def build(shard: pa.Table) -> pa.Table:
        store, path = FileSystem.from_uri(folder)
        store.create_dir(path)
        name = f"{shard.column('shard')[0].as_py()}-{uuid.uuid4().hex}"
        with store.open_output_stream(f"{path}/{name}") as out:
            out.write(pickle.dumps(_automaton(zip(shard.column("name").to_pylist(), shard.column("text").to_pylist(), strict=True), window), pickle.HIGHEST_PROTOCOL))
        return pa.table({"name": [name]})

    return [f"{folder}/{r['name']}" for r in dealt.groupBy("shard").applyInArrow(build, "name string").collect()]


def _read(uri: str) -> Automaton:
    store, path = FileSystem.from_uri(uri)
    with store.open_input_stream(path) as f:
        return pickle.loads(f.read())


def _past(docs: DataFrame, text_col: str, items: DataFrame, item_col: str, item_text: str, window: int, shard_words: int, finish: Callable, schema: StructType) -> DataFrame:
    """docs past the automaton of each shard of items, then finish(batch, texts' words, spans, items' names).

    The texts are read once. Items of one shard make one automaton, which is broadcast. More are built by tasks and written to the shared folder
    (which pyarrow.fs must open on every node); a task then takes HELD bytes of texts through one automaton after the other, so it has one
    of about shard_words words (or of one item) at a time.
    """
    dealt, shards = _dealt(items, item_col, item_text, shard_words)
    if shards == 1:
        made = docs.sparkSession.sparkContext.broadcast(_automaton([(r["name"], r["text"]) for r in dealt.toLocalIterator()], window))
        paths = None
    else:
        made, paths = None, _built(dealt, window)

    def told(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans = [[[] for _ in range(len(p))] for p in parts]
        names: list[list[set]] = [[set() for _ in range(len(p))] for p in parts]
        cut_up = lambda p: (alnum_words(t) for _, t in byte_rows(p, text_col, text_col))
        words = [list(cut_up(p)) for p in parts] if paths is None else None  # kept for the one small batch, else cut up each time
        for automaton in (made.value,) if paths is None else map(_read, paths):
            for k, (s, n) in enumerate(zip(spans, names, strict=True)):
                for i, text in enumerate(words[k] if words else cut_up(parts[k])):
                    found, who = automaton.spans(text)
                    s[i] += found
                    n[i] |= {automaton.names[w] for w in who}
        for k, (s, n) in enumerate(zip(spans, names, strict=True)):
            yield finish(parts[k], words[k] if words else list(cut_up(parts[k])), s, n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for part in (b.slice(i, 512) for b in batches for i in range(0, len(b), 512)):
            held.append(part)
            size += part.column(text_col).nbytes
            if paths is None or size > HELD:
                yield from told(held)
                held, size = [], 0
        if held:
            yield from told(held)

    return docs.mapInArrow(run, schema)


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, shard_words: int = SHARD_WORDS) -> DataFrame:
    """One row per row of docs: id, n_words, n_hit, n_items, items (sorted ids), spans (merged, [start, end) in words).

    A word is hit if it lies in an occurrence of `window` consecutive words of an item, or of a whole item of fewer
    words. Items of a null id hit as well; they count as one item, which has no name. A null or empty text has no words;
    without items nothing is hit. Repeated rows are judged alike, repeated items count once; an empty table gives no
    rows. Other columns of either table are not read. A text is read whole, however long, by one task.
    """
    docs = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.list_(pa.int64()))]

    def finish(part: pa.RecordBatch, texts: list, spans: list, names: list) -> pa.RecordBatch:
        rows: list[tuple] = []
        for words, s, n in zip(texts, spans, names, strict=True):
            hit = _covered(s, len(words)) if s else np.zeros(0, bool)
            edge = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
            rows.append((len(words), int(hit.sum()), len(n), sorted(n - {None}), edge.reshape(-1, 2).tolist()))
        return pa.record_batch([part.column("id"), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], names=["id", "n_words", "n_hit", "n_items", "items", "spans"])

    number = LongType()
    schema = StructType([docs.schema["id"], *(StructField(n, number) for n in ("n_words", "n_hit", "n_items")), StructField("items", ArrayType(StringType())), StructField("spans", ArrayType(ArrayType(number)))])
    return _past(docs, "text", items, item_col, item_text, window, shard_words, finish, schema).withColumnRenamed("id", id_col)


WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def without(text: bytes, words: list[bytes], spans: list[tuple[int, int]], coverage: float = COVERAGE) -> bytes | None:
    """The text without its hit spans; None if more than `coverage` of its words are hit."""
    if not spans:
        return text
    hit = _covered(spans, len(words))
    if hit.sum() > coverage * len(words):
        return None
    at = [m.span() for m in WORD.finditer(text.translate(ALNUM))]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8))).reshape(-1, 2).tolist()
    out, place = [], 0
    for s, e in edge:
        out.append(text[place : at[s][0]])
        place = at[e - 1][1]
    return b"".join([*out, text[place:]])


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, coverage: float = COVERAGE, shard_words: int = SHARD_WORDS) -> DataFrame:
    """docs with hit spans cut out of their texts and without documents of which more than `coverage` is hit.

    Documents without a hit, null and empty texts among them, stay as they are; so do repeated rows, each by itself, and rows of a
    null id. n_chars, where docs has it, follows. An empty table stays empty; all columns are kept. A text is read whole by one task, however long.
    """
    new = unused(docs, "new")
    schema = StructType([*docs.schema.fields, StructField(new, StringType())])

    def finish(part: pa.RecordBatch, texts: list, spans: list, names: list) -> pa.RecordBatch:
        rows = zip(byte_rows(part, text_col, text_col), texts, spans, strict=True)
        kept = [without(t, words, s, coverage) if t else t for (_, t), words, s in rows]
        return part.append_column(new, pa.array([x if x is None else x.decode() for x in kept], pa.string()))

    found = _past(docs, text_col, only(items, item_col, item_text), item_col, item_text, window, shard_words, finish, schema)
    found = found.where(F.col(new).isNotNull() | F.col(f"`{text_col}`").isNull())
    changed = ~F.col(new).eqNullSafe(F.col(f"`{text_col}`"))
    columns = {text_col: F.col(new)} | ({"n_chars": F.when(changed, F.length(new).cast("long")).otherwise(F.col("n_chars"))} if "n_chars" in docs.columns else {})
    return found.withColumns(columns).select(*(F.col(f"`{c}`") for c in docs.columns))


#: Every window's place in every document, by plain joins of its words.
SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
g AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS gram
  FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM (SELECT *, least(10, len(w)) AS n FROM b WHERE len(w) > 0))),
s AS (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS gram
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM g) WHERE len(w) >= n)),
h AS (SELECT r, i, s.n, item_id FROM s JOIN g ON s.n = g.n AND s.gram = g.gram),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM h) GROUP BY r),
item AS (SELECT r, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS items FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS k FROM h) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN item USING (r)
"""
