"""Exact removal of repeated passages, by super-k-mers.

Consecutive 50-word windows that share a minimiser (the least hash of their 8-word grams) travel as one packed string to
the minimiser's bucket, where sorting their windows tells exactly which occur in which document first. Minimisers that
only one document has are told apart beforehand, by hashes alone, so that most text never travels.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from photonflow.llm.common import byte_rows, cut, only, space_words, unused

WINDOW = 50
GRAM = 8
#: Windows of one packed string at most; a longer run of one minimiser is cut.
RUN = 256
#: A minimiser of more packed strings than this is dealt by a second one besides.
HOT = 1000
_EMPTY = hashlib.sha256(b"").digest()


def gram_hashes(words: list[bytes], gram: int = GRAM) -> np.ndarray:
    """Hash of each run of `gram` words."""
    hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64)
    n = len(words) - gram + 1
    with np.errstate(over="ignore"):
        grams = np.zeros(n, np.uint64)
        for k in range(gram):
            grams = grams * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + n]
        grams = (grams ^ (grams >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        grams ^= grams >> np.uint64(32)
    return grams


def _least(grams: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` hashes in a row."""
    span = 1
    while 2 * span <= width:
        grams = np.minimum(grams[:-span], grams[span:])
        span *= 2
    if span < width:
        grams = np.minimum(grams[: span - width], grams[width - span :])
    return grams


def minimisers(words: list[bytes], window: int = WINDOW, gram: int = GRAM) -> np.ndarray:
    """The least gram hash of each window of the words (as signed longs)."""
    return _least(gram_hashes(words, gram), window - gram + 1).view(np.int64)


def second_minimisers(grams: np.ndarray, first: int, n: int, mini: int, width: int) -> np.ndarray:
    """Of n windows from `first` on, which share a minimiser, the gram that is least in another order once that one is left out."""
    part = grams[first : first + n + width - 1]
    with np.errstate(over="ignore"):
        other = (part ^ np.uint64(0x94D049BB133111EB)) * np.uint64(0xD6E8FEB86659FD93)
        other ^= other >> np.uint64(32)
    other[part.view(np.int64) == mini] = np.uint64(0xFFFFFFFFFFFFFFFF)
    return _least(other, width).view(np.int64)


def runs(marks: np.ndarray, most: int = RUN) -> list[tuple[int, int]]:
    """(first window, windows) of each stretch of one minimiser, of `most` windows at most."""
    edges = [0, *(np.flatnonzero(marks[1:] != marks[:-1]) + 1).tolist(), len(marks)]
    return [(i, min(most, e - i)) for s, e in zip(edges, edges[1:], strict=False) for i in range(s, e, most)]


def _profile(docs: DataFrame, window: int) -> DataFrame:
    """id, raw (hash of the text), n_words, digest (SHA-256 of the words joined by one space), minis: the minimiser of each packed string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, minis = [], [], []
            for _, text in byte_rows(batch, "id", "text"):
                words = space_words(text)
                counts.append(len(words))
                digests.append(hashlib.sha256(b" ".join(words)).digest())
                marks = minimisers(words, window) if len(words) >= window else np.zeros(0, np.int64)
                minis.append(marks[[first for first, _ in runs(marks)]] if len(marks) else marks)
            flat = pa.ListArray.from_arrays(np.cumsum([0, *map(len, minis)]).astype(np.int32), np.concatenate(minis)) if minis else pa.array([], pa.list_(pa.int64()))
            yield pa.record_batch([batch.column("id"), batch.column("raw"), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), flat], names=["id", "raw", "n_words", "digest", "minis"])

    return docs.withColumn("raw", F.xxhash64("text")).mapInArrow(run, "id long, raw long, n_words long, digest binary, minis array<long>")


def _packed(shared: DataFrame, window: int, texts: bool) -> DataFrame:
    """Super-k-mers of the shared minimisers: id, digest, start, key (of the packed string), and with texts mini, packed.

    Windows of a hot minimiser travel by runs of a second one, in the bucket that both name: what stands about a common passage tells them apart.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 64):
                part = batch.slice(at, 64)
                rows: list[tuple] = []
                wanted = zip(part.column("digest").to_pylist(), part.column("minis").to_pylist(), part.column("hot").to_pylist(), byte_rows(part, "id", "text"), strict=True)
                for digest, minis, hot, (key, text) in wanted:
                    words = space_words(text)
                    joined = b" ".join(words)
                    if len(words) < window or hashlib.sha256(joined).digest() != digest:
                        continue  # another text of the same id
                    ends = (np.cumsum([len(w) + 1 for w in words]) - 1).tolist()
                    grams, width = gram_hashes(words), window - GRAM + 1
                    marks = _least(grams, width).view(np.int64)
                    chosen, crowded = set(minis), set(hot)
                    for first, n in runs(marks):
                        mini = int(marks[first])
                        if mini not in chosen:
                            continue
                        pieces = [(first, n, mini)]
                        if mini in crowded:
                            seconds = second_minimisers(grams, first, n, mini, width)
                            pieces = [(first + i, k, hash((mini, int(seconds[i])))) for i, k in runs(seconds)]
                        for i, k, bucket in pieces:
                            packed = joined[ends[i - 1] + 1 if i else 0 : ends[i + k + window - 2]]
                            rows.append((key, digest, i, xxhash.xxh3_128_digest(packed), bucket, packed))
                kinds = [("id", pa.int64()), ("digest", pa.binary()), ("start", pa.int32()), ("key", pa.binary()), ("mini", pa.int64()), ("packed", pa.binary())]
                pick = (0, 4, 5) if texts else (0, 1, 2, 3)
                yield pa.record_batch([pa.array([r[i] for r in rows], kinds[i][1]) for i in pick], names=[kinds[i][0] for i in pick])

    return shared.mapInArrow(run, "id long, mini long, packed binary" if texts else "id long, digest binary, start int, key binary")


def window_owners(group: list[tuple[bytes, int, int]], window: int = WINDOW) -> Iterator[tuple[bytes, list[int]]]:
    """group: distinct packed strings of one bucket with the first and last document of each. Yields, for each string
    that may lose windows, the smallest document that each of its windows occurs in."""
    if len(group) == 1:
        packed, first, last = group[0]
        if last > first:
            yield packed, [first] * (packed.count(b" ") + 2 - window)
        return
    entries = []
    owners = []
    for k, (packed, first, _) in enumerate(group):
        gaps = np.flatnonzero(np.frombuffer(packed, np.uint8) == 32).tolist()
        starts, ends = [0, *(g + 1 for g in gaps)], [*gaps, len(packed)]
        n = len(starts) - window + 1
        owners.append([first] * n)
        entries += [(packed[starts[j] : ends[j + window - 1]], first, k, j) for j in range(n)]
    entries.sort()
    seen, owner = None, 0
    for words, first, k, j in entries:
        if words != seen:
            seen, owner = words, first
        owners[k][j] = owner
    for (packed, first, last), mine in zip(group, owners, strict=True):
        if last > first or min(mine) < first:
            yield packed, mine


def _owners(packed: DataFrame, window: int) -> DataFrame:
    """key, owners of the packed strings that may lose windows. Copies of a string are one row before any bucket is filled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(groups) -> Iterator[pa.RecordBatch]:
            rows = [(xxhash.xxh3_128_digest(p), o) for g in groups for p, o in window_owners(g, window)]
            yield pa.record_batch([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.list_(pa.int64()))], names=["key", "owners"])

        done: list[list] = []
        group: list[tuple[bytes, int, int]] = []
        mini = None
        for batch in batches:
            for i in range(0, len(batch), 1024):
                part = batch.slice(i, 1024)
                for m, *row in zip(*(part.column(c).to_pylist() for c in ("mini", "packed", "first", "last")), strict=True):
                    if m != mini:
                        if group:
                            done.append(group)
                        group, mini = [], m
                        if len(done) >= 512:
                            yield from out(done)
                            done = []
                    group.append(tuple(row))
        yield from out([*done, group] if group else done)

    distinct = packed.groupBy("mini", "packed").agg(F.min("id").alias("first"), F.max("id").alias("last"))
    return distinct.repartition("mini").sortWithinPartitions("mini").mapInArrow(run, "key binary, owners array<long>")


def _spans(starts: list[int], window: int) -> list[tuple[int, int]]:
    """Merged [first, end) word spans that the windows at these starts cover."""
    out: list[list[int]] = []
    for s in sorted(starts):
        if out and s <= out[-1][1]:
            out[-1][1] = s + window
        else:
            out.append([s, s + window])
    return [tuple(x) for x in out]


def _apply(flagged: DataFrame, window: int, texts: bool) -> DataFrame:
    """id, digest, n_removed, kept_digest and, with texts, kept: the text without its covered words, else as it was."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                rows: list[tuple] = []
                for digest, starts, (key, text) in zip(part.column("digest").to_pylist(), part.column("starts").to_pylist(), byte_rows(part, "id", "text"), strict=True):
                    words = space_words(text)
                    if hashlib.sha256(b" ".join(words)).digest() != digest:
                        continue
                    kept, place, pieces, gone, byte = [], 0, [], 0, 0
                    begins = _word_places(text, words) if texts else []
                    for s, e in _spans(starts, window):
                        kept += words[place:s]
                        place, gone = e, gone + e - s
                        if texts:
                            pieces.append(text[byte : begins[s]])
                            byte = begins[e - 1] + len(words[e - 1])
                    kept += words[place:]
                    rows.append((key, digest, gone, hashlib.sha256(b" ".join(kept)).digest(), b"".join([*pieces, text[byte:]]).decode() if texts else None))
                kinds = [pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.string()]
                yield pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["id", "digest", "n_removed", "kept_digest", "kept"])

    return flagged.mapInArrow(run, "id long, digest binary, n_removed long, kept_digest binary, kept string")


def _word_places(text: bytes, words: list[bytes]) -> list[int]:
    out, at = [], 0
    for w in words:
        at = text.index(w, at)
        out.append(at)
        at += len(w)
    return out


def _changes(docs: DataFrame, window: int, texts: bool) -> tuple[DataFrame, DataFrame]:
    """What each row is (id, raw, n_words, digest, first: the smallest id with the same words), and the changes of first ones."""
    profile = cut(_profile(docs, window), "profile")
    heads = profile.where(f"n_words >= {window} and id is not null").groupBy("digest").agg(F.min("id").alias("first"))
    minis = profile.join(heads.select(F.col("first").alias("id"), "digest"), ["id", "digest"], "left_semi").select("id", "digest", F.explode("minis").alias("mini"))
    shared = minis.groupBy("mini").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count("*").alias("n")).where("low < high").select("mini", (F.col("n") > HOT).alias("hot"))
    wanted = minis.join(shared, "mini").groupBy("id", "digest").agg(F.collect_set("mini").alias("minis"), F.collect_set(F.when(F.col("hot"), F.col("mini"))).alias("hot"))
    parts = cut(docs.join(wanted, "id"), "shared")
    owners = _owners(_packed(parts, window, True), window)
    places = _packed(parts, window, False).join(owners, "key")
    places = places.select("id", "digest", F.expr("filter(transform(owners, (o, j) -> if(o < id, start + j, -1)), s -> s >= 0)").alias("starts")).where("size(starts) > 0")
    starts = places.groupBy("id", "digest").agg(F.array_distinct(F.flatten(F.collect_list("starts"))).alias("starts"))
    flagged = parts.select("id", "digest", "text").join(starts, ["id", "digest"])
    changed = _apply(flagged, window, texts).dropDuplicates(["id", "digest"])
    return profile.select("id", "raw", "n_words", "digest").join(heads, "digest", "left"), changed


def _copy(window: int):
    """Of another document's words and not the first: all its windows start there as well."""
    return (F.col("n_words") >= window) & F.coalesce(F.col("id") > F.col("first"), F.lit(False))


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per row of docs: id, n_words, n_removed, kept_sha256.

    A word is removed if it lies in a window of `window` consecutive words that also starts in a document of smaller id,
    judged on the texts as they came. Documents of fewer words (null and empty texts too) lose nothing. A null id is
    neither smaller nor larger than another: such rows lose nothing and take nothing. Rows of one id don't take from
    each other. Ids must be whole numbers; a string that is none counts as null. Repeated rows are returned as often as they
    came; an empty table gives no rows; other columns are not read. A text is split whole, however long, in one task.
    """
    docs = docs.select(F.col(f"`{id_col}`").try_cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    rows, changed = _changes(docs, window, False)
    copy = _copy(window)
    found = rows.join(changed, ["id", "digest"], "left")
    kept = F.when(copy, F.lit(_EMPTY)).otherwise(F.coalesce("kept_digest", "digest"))
    return found.select(
        F.col("id").alias(id_col), "n_words", F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"), F.lower(F.hex(kept)).alias("kept_sha256")
    )


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """docs whose texts have lost their repeated passages; the rest of a text stays as it was, white space too.

    Documents that lose all their words go; documents that had none stay. A null id loses and takes nothing; rows of one id
    don't take from each other; repeated rows stay or go together. n_chars, where docs has it, follows. An empty table stays
    empty; all columns are kept.
    """
    plain = only(docs, id_col, text_col).select(F.col(f"`{id_col}`").try_cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    rows, changed = _changes(plain, window, True)
    found = rows.join(changed, ["id", "digest"], "left")
    gone = _copy(window) | F.coalesce(F.col("kept_digest") == F.lit(_EMPTY), F.lit(False))
    edits = found.where(gone | F.col("kept").isNotNull())
    row, raw, kept, lost = (unused(docs, name) for name in ("row", "raw", "kept", "lost"))
    edits = edits.select(F.col("id").alias(row), F.col("raw").alias(raw), F.when(~gone, F.col("kept")).alias(kept), gone.alias(lost)).dropDuplicates([row, raw])
    same = (F.col(row) == F.col(f"`{id_col}`").try_cast("long")) & (F.col(raw) == F.xxhash64(F.col(f"`{text_col}`").cast("string")))
    joined = docs.join(edits, same, "left").where(~F.coalesce(F.col(lost), F.lit(False)))
    columns = {text_col: F.coalesce(F.col(kept), F.col(f"`{text_col}`"))}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.when(F.col(kept).isNotNull(), F.length(kept).cast("long")).otherwise(F.col("n_chars"))
    return joined.withColumns(columns).select(*(F.col(f"`{c}`") for c in docs.columns))


#: Every window of every document, by plain grouping of its words.
SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (SELECT r, doc_id, i, array_to_string(w[i:i + 49], ' ') AS win FROM (SELECT *, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
f AS (SELECT r, i FROM (SELECT *, min(doc_id) OVER (PARTITION BY win) AS low FROM s) WHERE low < doc_id),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 50)) AS p FROM f),
word AS (SELECT r, doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT word.r, string_agg(x, ' ' ORDER BY word.p) AS t, count(*) AS n FROM word ANTI JOIN gone ON word.r = gone.r AND word.p = gone.p GROUP BY word.r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""
