"""Packing into optimal length buckets and token-budget batches."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from photonflow.llm.common import cut, numbered

MAX_TOKENS = 2048
BUCKETS = 8
BUDGET = 16384


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def boundaries(histogram: dict[int, int], buckets: int = BUCKETS) -> list[int]:
    """Upper lengths of at most `buckets` buckets that pad least in total; of equal ones, the fewest, then the shortest.

    Dynamic programming over the distinct lengths: best[j] pads all lengths up to the j-th with the last bucket ending there.
    """
    lengths = np.array(sorted(histogram), np.int64)
    if not len(lengths):
        return []
    counts = np.concatenate([[0], np.cumsum([histogram[int(x)] for x in lengths])])
    tokens = np.concatenate([[0], np.cumsum([histogram[int(x)] * int(x) for x in lengths])])
    m = len(lengths)
    cost = lengths[None, :] * (counts[None, 1:] - counts[:-1, None]) - (tokens[None, 1:] - tokens[:-1, None])  # [i, j]: i..j in one bucket
    cost = np.where(np.arange(m)[:, None] <= np.arange(m)[None, :], cost, np.iinfo(np.int64).max // 4)
    best, back = [cost[0]], [np.zeros(m, np.int64)]
    for _ in range(1, min(buckets, m)):
        through = np.concatenate([[np.iinfo(np.int64).max // 4], best[-1][:-1]])[:, None] + cost
        back.append(through.argmin(axis=0))
        best.append(through.min(axis=0))
    k = int(np.argmin([b[-1] for b in best]))
    out, j = [], m - 1
    while k >= 0:
        out.append(int(lengths[j]))
        j, k = int(back[k][j]) - 1, k - 1
    return out[::-1]


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_tokens: int = MAX_TOKENS, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """Pieces of all documents: id, piece, start_token, n_tokens, bucket, bucket_tokens, batch, slot.

    Tokens are words between ASCII white space. A document of more than max_tokens, however long, is cut into consecutive
    pieces, so nothing is lost; one without words (null or empty text) is one piece of no tokens. The histogram of piece lengths
    has at most max_tokens + 1 rows, whatever the corpus. A batch holds budget // bucket_tokens pieces (one at least) of
    one bucket, in order of id and piece; it is named by bucket and batch, and each bucket ends in at most one short batch.
    Ties: of boundaries that pad as little, the fewest, then the shortest. Rows of equal or null ids are packed as often as
    they come, equal ones in any order. An empty table gives no rows.
    """
    if budget < max_tokens:
        raise ValueError("budget must hold the longest piece")
    sized = docs.select(F.col(f"`{id_col}`").alias("id"), word_count(F.col(f"`{text_col}`").cast("string")).alias("total"))
    pieces = sized.select("id", "total", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("total") / max_tokens) - 1, F.lit(0)).cast("int"))).alias("piece"))
    start = F.col("piece").cast("long") * max_tokens
    pieces = pieces.select("id", "piece", start.alias("start_token"), F.least(F.lit(max_tokens).cast("long"), F.col("total") - start).alias("n_tokens"))
    pieces = cut(pieces, "pieces")
    histogram = {r["n_tokens"]: r["n"] for r in pieces.groupBy("n_tokens").agg(F.count("*").alias("n")).collect()}
    upper = boundaries(histogram, buckets) or [max_tokens]
    at = F.size(F.filter(F.array(*map(F.lit, upper)), lambda u: u < F.col("n_tokens")))
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("bucket") + 1)
    placed = numbered(pieces.withColumn("bucket", at), "bucket", "id", "piece", "n_tokens", out="place")
    held = pick([budget // max(1, u) for u in upper])
    return placed.select(
        F.col("id").alias(id_col), "piece", "start_token", "n_tokens", "bucket", pick(upper).cast("long").alias("bucket_tokens"),
        F.floor(F.col("place") / held).cast("long").alias("batch"), (F.col("place") % held).cast("int").alias("slot"),
    )


#: The dynamic programme with one common table for each number of buckets.
SQL = (
    r"""
WITH sized AS (SELECT doc_id, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS total FROM documents),
pieces AS (SELECT doc_id, CAST(p AS INTEGER) AS piece, p * 2048 AS start_token, least(2048, total - p * 2048) AS n_tokens
  FROM (SELECT *, unnest(range(0, CAST(greatest(ceil(total / 2048.0), 1) AS BIGINT))) AS p FROM sized)),
h AS (SELECT n_tokens AS l, count(*) AS n, row_number() OVER (ORDER BY n_tokens) AS j FROM pieces GROUP BY n_tokens),
c AS MATERIALIZED (SELECT j, l, CAST(sum(n) OVER (ORDER BY j) AS BIGINT) AS cn, CAST(sum(n * l) OVER (ORDER BY j) AS BIGINT) AS ct FROM h),
k1 AS MATERIALIZED (SELECT j, l * cn - ct AS pad, [l] AS upper FROM c),
"""
    + "".join(
        f"""k{k} AS MATERIALIZED (SELECT b.j, min(a.pad + b.l * (b.cn - p.cn) - (b.ct - p.ct)) AS pad,
  list_append(arg_min(a.upper, (a.pad + b.l * (b.cn - p.cn) - (b.ct - p.ct)) * 100000 + a.j), any_value(b.l)) AS upper
  FROM k{k - 1} a JOIN c p ON p.j = a.j JOIN c b ON b.j > a.j GROUP BY b.j),
"""
        for k in range(2, BUCKETS + 1)
    )
    + "ends AS (SELECT upper FROM ("
    + " UNION ALL ".join(f"SELECT {k} AS k, pad, upper FROM k{k} WHERE j = (SELECT max(j) FROM c)" for k in range(1, BUCKETS + 1))
    + """) ORDER BY pad, k LIMIT 1),
placed AS (SELECT pieces.*, upper, CAST(len(list_filter(upper, lambda u: u < n_tokens)) AS INTEGER) AS bucket FROM pieces, ends),
numbered AS (SELECT *, upper[bucket + 1] AS bucket_tokens, 16384 // greatest(1, upper[bucket + 1]) AS held,
  row_number() OVER (PARTITION BY bucket ORDER BY doc_id, piece) - 1 AS place FROM placed)
SELECT doc_id, piece, start_token, n_tokens, bucket, bucket_tokens, place // held AS batch, CAST(place % held AS INTEGER) AS slot FROM numbered
"""
)
