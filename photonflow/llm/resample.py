"""Importance resampling towards a target: hashed n-gram features of documents weighed by their share in the target.

Features are hashed by CRC-32. As CRC is linear, a feature's is the exclusive or of what each of its bytes contributes, which
depends on the byte and its distance from the feature's end alone, and of a constant of its length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from photonflow.llm.common import ALNUM, cut, numbered

BUCKETS = 10_000
ORDERS = 2
#: Bytes of text that are hashed at once; a longer text goes in pieces.
BLOCK = 1 << 20
#: Distances in the position table; longer features are folded by blocks of so many bytes (a power of two).
REACH = 128
FULL = np.uint32(0xFFFFFFFF)
SPACE = 0x20

_LOW = np.frombuffer(ALNUM, np.uint8)


def _position_table() -> tuple[np.ndarray, np.ndarray]:
    """What byte b contributes at a distance d from the end (row d, column b), and the CRC of n zero bytes for n up to REACH."""
    table = np.empty((REACH, 256), np.uint32)
    table[0] = [zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)]
    for d in range(1, REACH):  # one more zero byte behind
        table[d] = (table[d - 1] >> np.uint32(8)) ^ table[0][table[d - 1] & np.uint32(255)]
    return table, np.array([zlib.crc32(bytes(n)) for n in range(REACH + 1)], np.uint32)


TABLE, ZEROS = _position_table()


class _Shift:
    """Appending 2**k zero bytes to what contributions add up to: a linear map, as four tables of a byte each."""

    def __init__(self) -> None:
        one = TABLE[0]
        byte = np.arange(256, dtype=np.uint32)
        self.maps = [np.stack([(x >> np.uint32(8)) ^ one[x & np.uint32(255)] for x in (byte << np.uint32(8 * i) for i in range(4))])]

    def __call__(self, k: int, x: np.ndarray) -> np.ndarray:
        while len(self.maps) <= k:
            self.maps.append(self._apply(self.maps[-1], self.maps[-1]))
        return self._apply(self.maps[k], x)

    @staticmethod
    def _apply(m: np.ndarray, x: np.ndarray) -> np.ndarray:
        return m[0][x & np.uint32(255)] ^ m[1][(x >> np.uint32(8)) & np.uint32(255)] ^ m[2][(x >> np.uint32(16)) & np.uint32(255)] ^ m[3][x >> np.uint32(24)]


SHIFT = _Shift()


def _zeros(n: int) -> np.uint32:
    """CRC of n zero bytes."""
    x = np.array([FULL])
    for k in range(n.bit_length()):
        if n >> k & 1:
            x = SHIFT(k, x)
    return x[0] ^ FULL


def long_crc(data: np.ndarray) -> int:
    """CRC-32 of bytes of any number: blocks of REACH bytes side by side, then neighbours folded together until one is left."""
    blocks = 1 << max(0, (-(-len(data) // REACH) - 1).bit_length())
    padded = np.zeros(blocks * REACH, np.uint8)  # zeros in front contribute nothing
    padded[len(padded) - len(data) :] = data
    x = np.bitwise_xor.reduce(TABLE[np.arange(REACH - 1, -1, -1), padded.reshape(blocks, REACH)], axis=1)
    k = REACH.bit_length() - 1
    while len(x) > 1:
        x, k = SHIFT(k, x[::2]) ^ x[1::2], k + 1
    return int(x[0] ^ _zeros(len(data)))


def crcs(letters: np.ndarray, starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """CRC-32 of each n consecutive words joined by a space, for words that stand in `letters` end to end from `starts` on, and
    where each begins."""
    ends = np.append(starts[1:], len(letters))
    length = ends - starts
    count = len(starts) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    total = length[:count].copy()
    for j in range(1, n):
        total += length[j : j + count] + 1
    out = ZEROS[np.minimum(total, REACH)]
    behind = np.zeros(count, np.int64)  # bytes of the feature after the word
    for j in range(n - 1, -1, -1):
        first, last = starts[j], ends[j + count - 1]
        away = np.repeat(ends[j : j + count] + behind - 1, length[j : j + count]) - np.arange(first, last)
        parts = TABLE[np.minimum(away, REACH - 1), letters[first:last]]
        out ^= np.bitwise_xor.reduceat(parts, starts[j : j + count] - first)
        behind += length[j : j + count]
        if j:
            out ^= TABLE[np.minimum(behind, REACH - 1), SPACE]
            behind += 1
    for i in np.flatnonzero(total > REACH):
        words = [letters[starts[i + j] : ends[i + j]] for j in range(n)]
        joined = np.concatenate([x for w in words for x in (np.array([SPACE], np.uint8), w)][1:])
        out[i] = long_crc(joined)
    return out, np.arange(count)


def _pieces(text: np.ndarray, orders: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """A text's lowered bytes in pieces of about BLOCK bytes that end between words: letters, starts of words, and how many of the first
    words have been in the piece before."""
    at, kept = 0, np.zeros(0, np.uint8)
    while at < len(text):
        end = min(len(text), at + BLOCK)
        part = _LOW[text[at:end]]
        while end < len(text) and part[-1] != SPACE:  # a word never ends within a piece
            more = _LOW[text[end : end + BLOCK]]
            gap = np.flatnonzero(more == SPACE)
            stop = gap[0] + 1 if len(gap) else len(more)
            part, end = np.concatenate([part, more[:stop]]), end + stop
        at = end
        part = np.concatenate([kept, part])
        inside = part != SPACE
        first = np.flatnonzero(inside & np.concatenate([[True], ~inside[:-1]]))
        carried = int((first < len(kept)).sum())
        letters = part[inside]
        yield letters, np.cumsum(inside)[first] - 1, carried
        tail = first[-(orders - 1) :] if orders > 1 and len(first) else first[:0]
        kept = np.append(part[tail[0] :], np.uint8(SPACE)) if len(tail) else np.zeros(0, np.uint8)


def buckets(texts: list[np.ndarray], size: int = BUCKETS, orders: int = ORDERS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text's number, bucket) of all features, block by block, and the words of each text in the block."""
    group: list[tuple[int, np.ndarray]] = []

    def hashed(group: list[tuple[int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Texts side by side: features that reach over an end are left out."""
        joined = _LOW[np.concatenate([x for _, t in group for x in (t, np.array([SPACE], np.uint8))])]
        inside = joined != SPACE
        first = np.flatnonzero(inside & np.concatenate([[True], ~inside[:-1]]))
        owner = np.searchsorted(np.cumsum([len(t) + 1 for _, t in group]), first, side="right")
        letters, starts = joined[inside], np.cumsum(inside)[first] - 1
        who, what = [], []
        for n in range(1, orders + 1):
            codes, begin = crcs(letters, starts, n)
            same = owner[begin] == owner[begin + n - 1]
            who.append(owner[begin][same])
            what.append(codes[same] % np.uint32(size))
        number = np.array([i for i, _ in group])
        return number[np.concatenate(who)], np.concatenate(what).astype(np.int64), number[owner]

    held = 0
    for i, text in enumerate(texts):
        if len(text) > BLOCK:
            for letters, starts, carried in _pieces(text, orders):
                what = [codes[max(0, carried - n + 1) :] for n in range(1, orders + 1) for codes in [crcs(letters, starts, n)[0]]]
                found = np.concatenate(what)
                yield np.full(len(found), i), (found % np.uint32(size)).astype(np.int64), np.full(len(starts) - carried, i)
            continue
        group.append((i, text))
        held += len(text) + 1
        if held >= BLOCK:
            yield hashed(group)
            group, held = [], 0
    if group:
        yield hashed(group)


def _bytes(column: pa.Array) -> list[np.ndarray]:
    """UTF-8 bytes of each text, without copies; null is empty."""
    column = column.cast(pa.large_binary())
    empty = np.zeros(0, np.uint8)
    return [np.frombuffer(v.as_buffer(), np.uint8) if v.is_valid else empty for v in column]


def bucket_counts(rows: DataFrame, text_col: str = "text", size: int = BUCKETS, orders: int = ORDERS) -> np.ndarray:
    """How many features of all texts fall into each bucket: `size` numbers, whatever the table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for _, what, _ in buckets(_bytes(batch.column(0)), size, orders):
                total += np.bincount(what, minlength=size)
        used = np.flatnonzero(total)
        yield pa.record_batch([pa.array(used), pa.array(total[used])], names=["bucket", "n"])

    found = rows.select(F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(size, np.int64)
    for r in found.collect():  # at most `size` rows
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A thousand times the log of a bucket's smoothed share in the target over its share in the source, rounded down."""
    s, t, size = int(source.sum()), int(target.sum()), len(source)
    share = (target + 1.0) * float(s + size) / ((source + 1.0) * float(t + size))
    return np.array([int(np.floor(1000 * log(x))) for x in share], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", orders: int = ORDERS) -> DataFrame:
    """One row per row of docs: id, n_words, n_features, weight: the mean gain of its features, rounded down; 0 without features."""
    from pyspark.sql.pandas.types import to_arrow_type

    docs = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kind, size = to_arrow_type(docs.schema["id"].dataType), len(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.num_rows
            words, count, total = (np.zeros(rows, np.int64) for _ in range(3))
            for who, what, owner in buckets(_bytes(batch.column(1)), size, orders):
                words += np.bincount(owner, minlength=rows)
                count += np.bincount(who, minlength=rows)
                np.add.at(total, who, gain[what])
            weight = np.where(count > 0, total // np.maximum(count, 1), 0)
            yield pa.record_batch([batch.column(0).cast(kind), *map(pa.array, (words, count, weight))], names=["id", "n_words", "n_features", "weight"])

    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, n_words long, n_features long, weight long").withColumnRenamed("id", id_col)


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, seed: int = 7, size: int = BUCKETS, orders: int = ORDERS, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text") -> DataFrame:
    """One row per row of docs: id, n_words, n_features, weight, score, rank (null for what is not drawn).

    Drawn without replacement, in proportion to importance: score is the weight plus Gumbel noise told by seed and id, and of the
    documents of `least_words` or more the `percent` of highest score are ranked from 1, ties to the smaller id (a null id
    last). Null texts have no words, nor do empty ones. Rows of one id share their noise and are drawn each by itself; equal rows take
    their ranks either way. An empty table gives no rows; an empty target gives every bucket a share of one. Other columns are not read.
    Texts are hashed in blocks of a megabyte, so that one of any length takes little beside itself.

    Only bucket counts pass the driver; ranks are dealt by ranges of the score.
    """
    gain = gains(bucket_counts(docs, text_col, size, orders), bucket_counts(target, target_text, size, orders))
    found = cut(weigh(docs, gain, id_col, text_col, orders), "weights")
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")
    found = found.withColumns({"score": F.col("weight") + noise, "_pool": (F.col("n_words") >= least_words).cast("int"), "_none": F.col(f"`{id_col}`").isNull()})
    placed = numbered(found.withColumn("_down", -F.col("score")), "_pool", "_down", "_none", f"`{id_col}`", out="_place")
    drawn = int(percent * placed.where("_pool = 1").count() // 100)
    rank = F.when((F.col("_pool") == 1) & (F.col("_place") < drawn), F.col("_place") + 1)
    return placed.select(f"`{id_col}`", "n_words", "n_features", "weight", "score", rank.cast("long").alias("rank"))


#: CRC-32 of each distinct feature byte by byte, by a table that is made bit by bit.
SQL = r"""
WITH crc AS (SELECT list_transform(range(256), lambda b: list_reduce(list_concat([b], range(8)), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)) AS tab),
d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (SELECT coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM benchmark),
df AS (SELECT r, f, count(*) AS n FROM (SELECT r, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM d) GROUP BY ALL),
bf AS (SELECT f, count(*) AS n FROM (SELECT unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM b) GROUP BY f),
h AS (SELECT f, hex(encode(f)) AS x, tab FROM (SELECT f FROM df UNION SELECT f FROM bf), crc),
k AS MATERIALIZED (SELECT f, xor(list_reduce(list_concat([4294967295], list_transform(range(0, len(x) // 2), lambda i: CAST('0x' || x[2 * i + 1:2 * i + 2] AS BIGINT))),
  lambda a, c: xor(a // 256, tab[xor(a, c) % 256 + 1])), 4294967295) % 10000 AS bucket FROM h),
s AS (SELECT bucket, sum(n) AS s FROM df JOIN k USING (f) GROUP BY bucket),
t AS (SELECT bucket, sum(n) AS t FROM bf JOIN k USING (f) GROUP BY bucket),
g AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1.0::DOUBLE) * ((SELECT sum(s) FROM s) + 10000)::DOUBLE / ((s + 1.0::DOUBLE) * (coalesce((SELECT sum(t) FROM t), 0) + 10000)::DOUBLE))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (bucket)),
m AS (SELECT r, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * gain) AS BIGINT) AS total FROM df JOIN k USING (f) JOIN g USING (bucket) GROUP BY r),
z AS (SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce((total - ((total % n_features) + n_features) % n_features) // n_features, 0) AS weight,
  CAST(('0x' || sha256('7:' || doc_id)[:8]) AS BIGINT) AS h FROM d LEFT JOIN m USING (r)),
y AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM z),
o AS (SELECT *, CASE WHEN n_words >= 20 THEN row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) END AS place FROM y)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 25 * (SELECT count(*) FROM o WHERE n_words >= 20) // 100 THEN place END AS rank FROM o
"""
