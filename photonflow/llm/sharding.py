"""Shards as the leaves of a k-d tree over document metadata, split at distributed weighted medians."""

from __future__ import annotations

import heapq
from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window, functions as F

from photonflow.llm.common import before_ranges, cut, join_groups, numbered, ranged, unused

SHARDS = 8
#: Parts that a shard holds of a unit larger than a shard.
PARTS = 4
NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double", "boolean")


def _dimension(df: DataFrame, name: str) -> Column:
    """A number as a double (null and NaN as 0), anything else as a string (null as empty)."""
    kind = dict(df.dtypes)[name]
    value = F.col(f"`{name}`")
    if kind in NUMBERS or kind.startswith("decimal"):
        return F.coalesce(F.nanvl(value.cast("double"), F.lit(0.0)), F.lit(0.0))
    return F.coalesce(value.cast("string"), F.lit(""))


def _extent(rows: DataFrame, name: str) -> Column:
    """How wide a dimension is: the range of numbers; of strings, how many there are, less one."""
    return F.max(name) - F.min(name) if dict(rows.dtypes)[name] == "double" else F.approx_count_distinct(name, 0.02).cast("double") - 1


def _medians(told: DataFrame) -> DataFrame:
    """node, at: of the nodes to be split, the first place (number, string, tie) up to which their bytes reach what is wanted.

    One sort by range over all nodes of a level together. Bytes are added up by range; only the range in which a node's median lies
    is then added up row by row.
    """
    placed = ranged(told, "node", "num", "str", "tie")
    sums = before_ranges(placed.groupBy("node", "want", "_part").agg(F.sum("size").alias("w")), "node", "w")
    # a row a node
    here = sums.where("_before < want and want <= _before + w").select("node", "_part", "_before")
    running = F.sum("size").over(Window.partitionBy("node").orderBy("num", "str", "tie"))  # rows of one place together
    inside = placed.join(F.broadcast(here), ["node", "_part"]).withColumn("reached", F.col("_before") + running)
    return inside.where("reached >= want").groupBy("node").agg(F.min(F.struct("num", "str", "tie")).alias("at"))


def _dealt(units: DataFrame, shards: int, total: int) -> tuple[DataFrame | None, list[float]]:
    """(key, part, shard) of the large units, and the bytes that each shard can still take.

    A unit is large beyond a hundredth of a shard and a ten-thousandth of everything, so there are at most ten thousand; the largest first, each goes to
    the emptiest shard. What is left of the shards is levelled, so that small units make them equal.
    """
    large = units.where(F.col("bytes") > max(total / shards / 100, total / 10_000)).select("key", "part", "bytes").collect()
    heap, rows = [(0, s) for s in range(shards)], []
    for u in sorted(large, key=lambda u: (-u["bytes"], u["key"], u["part"])):
        load, s = heapq.heappop(heap)
        rows.append((u["key"], u["part"], s))
        heapq.heappush(heap, (load + u["bytes"], s))
    loads = [load for load, _ in sorted(heap, key=lambda x: x[1])]
    small, level = total - sum(loads), 0.0
    for n, load in enumerate(sorted(loads), 1):  # the level at which the n emptiest are full
        level = (small + sum(sorted(loads)[:n])) / n
        if n == shards or level <= sorted(loads)[n]:
            break
    room = [max(0.0, level - load) for load in loads]
    return (units.sparkSession.createDataFrame(rows, "key long, part int, shard int") if rows else None), room


def _grown(units: DataFrame, dims: list[str], shards: int, room: list[float]) -> DataFrame:
    """key, part, shard of units (key, part, bytes, tie, dimensions) by a k-d tree whose leaves take what the shards have room for."""
    rows = units
    extents = {n: _extent(rows, n) for n in dims}
    whole = rows.agg(*(v.alias(n) for n, v in extents.items())).first()
    before = [0.0, *accumulate(room)]
    cumulative = rows.sparkSession.createDataFrame(list(enumerate(before)), "shard int, room double")  # a row a shard
    rows = rows.withColumns({"node": F.lit(0).cast("long"), "k": F.lit(shards), "first": F.lit(0)})
    strings = [n for n in dims if dict(rows.dtypes)[n] == "string"]
    left = F.expr("k div 2")
    for _ in range((shards - 1).bit_length()):
        nodes = rows.where("k > 1").groupBy("node", "k", "first").agg(F.sum("bytes").alias("w"), *(v.alias(n) for n, v in extents.items()))
        for name, at in (("low", F.lit(0)), ("mid", left), ("high", F.col("k"))):
            nodes = nodes.join(cumulative.select(F.col("shard").alias("_at"), F.col("room").alias(name)), (F.col("first") + at).cast("int") == F.col("_at")).drop("_at")
        share = F.array(*(F.col(n) / max(whole[n] or 0.0, 1e-9) for n in dims))
        axis = F.array_position(share, F.array_max(share)) - 1
        want = F.col("w") * F.coalesce(F.try_divide(F.col("mid") - F.col("low"), F.col("high") - F.col("low")), left / F.col("k"))
        nodes = cut(nodes.select("node", axis.alias("axis"), want.alias("want")), "nodes")
        here = lambda names, none: reduce(lambda rest, n: F.when(F.col("axis") == dims.index(n), F.col(n)).otherwise(rest), names, F.lit(none))
        told = rows.join(nodes, "node", "left").withColumns({"num": here([n for n in dims if n not in strings], 0.0), "str": here(strings, "")})
        medians = cut(_medians(told.where("want > 0").select("node", "want", "num", "str", "tie", F.col("bytes").alias("size"))), "medians")
        split = told.join(medians, "node", "left")
        right = F.coalesce(F.col("want") <= 0, F.lit(False)) | F.coalesce(F.struct("num", "str", "tie") > F.col("at"), F.lit(False))
        split = split.select(
            "key", "part", "bytes", *dims, "tie", (F.col("node") * 2 + right.cast("long")).alias("node"),
            F.when(F.col("k") == 1, 1).when(right, F.col("k") - left).otherwise(left).cast("int").alias("k"), (F.col("first") + F.when(right, left).otherwise(0)).cast("int").alias("first"),
        )
        rows = cut(split, "shards")
    return rows.select("key", "part", F.col("first").alias("shard"))


def kd_shards(docs: DataFrame, dimensions: tuple[str, ...] = ("n_chars", "source", "lang"), id_col: str = "doc_id", text_col: str = "text", shards: int | None = SHARDS, target_bytes: int | None = None) -> DataFrame:
    """One row per row of docs: id, size, text_crc32, shard, slot.

    size: UTF-8 bytes plus 1 (a null text has none). Documents of equal texts are a unit and share a shard; where a unit is larger than a
    shard's share it is cut into parts of a quarter of one, by a hash of the id, so rows equal in id and text always stay together. A unit's dimensions are those of
    its row of least id and dimensions. Units larger than a hundredth of a shard are dealt first, the largest to the emptiest
    shard; the k-d tree starts from all others. A node of k > 1 shards is split where its bytes reach what the first k // 2 of them
    have room for, along the dimension that is widest against the root's (of equally wide ones, the first named); units of one value are
    divided by a hash of the text, so ties and a value that most rows share split as evenly. Dimensions that are null count as 0 or "";
    those that docs hasn't are left out. shards is given, or follows from target_bytes. Slots are gapless from 0, by a hash of the row. An empty
    table gives no rows. Of a text, however long, only size and checksums are kept.

    A level of the tree costs one sort by range, whatever the number of its nodes. Groups are counted before they are shuffled.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary")
    dims = {f"d{i}": _dimension(docs, d) for i, d in enumerate(d for d in dimensions if d in docs.columns)} or {"d0": F.lit(0.0)}
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("crc"), F.xxhash64(text).alias("key"), *(v.alias(n) for n, v in dims.items()))
    rows = cut(rows.withColumn("tie", F.xxhash64("id", "crc", "size", *dims)), "shards")
    groups = rows.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.min(F.struct(F.col("id").isNull().alias("none"), "id", *dims)).alias("m"))
    groups = cut(groups.select("key", "n", "bytes", *(F.col(f"m.{d}").alias(d) for d in dims)), "groups")
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    shards = shards or max(1, -(-total // target_bytes))
    portion = F.col("bytes") * shards / F.lit(float(max(total, 1)))
    parts = F.when(portion > 1, F.ceil(portion * PARTS)).otherwise(1).cast("int")
    groups = groups.withColumn("parts", parts)
    deal = F.xxhash64("id", "size")
    cut_up = F.broadcast(groups.where("parts > 1").select("key", "parts", *(F.col(d).alias(f"least_{d}") for d in dims)))  # fewer than there are shards
    cut_up = rows.select("id", "size", "key").join(cut_up, "key").groupBy("key", F.pmod(deal, F.col("parts")).cast("int").alias("part"), *(F.col(f"least_{d}").alias(d) for d in dims)).agg(F.sum("size").alias("bytes"))
    whole = groups.where("parts = 1").select("key", F.lit(0).alias("part"), *dims, "bytes")
    units = cut(whole.unionByName(cut_up).withColumn("tie", F.xxhash64("key", "part")), "units")
    large, room = _dealt(units, shards, total)
    if large is None:
        placed = _grown(units, list(dims), shards, room)
    else:
        placed = large.unionByName(_grown(cut(units.join(F.broadcast(large), ["key", "part"], "left_anti"), "small"), list(dims), shards, room))
    where = placed.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("part", "shard"))).alias("places"))  # a text's parts are fewer than five times the shards
    where = cut(where.join(groups.select("key", "n", "parts"), "key"), "places")
    found = join_groups(rows.select("id", "size", "crc", "key", "tie", *dims), where, "key", "n")
    part = F.pmod(deal, F.col("parts"))
    mine = F.get(F.filter("places", lambda p: p["part"] == part), F.lit(0))
    found = cut(found.select("id", "size", F.col("crc").alias("text_crc32"), *dims, "tie", mine["shard"].alias("shard")), "placed")
    found = numbered(found, "shard", "tie", out="slot")
    return found.select(F.col("id").alias(id_col), "size", "text_crc32", "shard", "slot")


def write_shards(docs: DataFrame, path: str, column: str = "shard", **options) -> None:
    """docs as Parquet, a folder for each shard; rows are those of docs, each as often as it came, null ids and texts among them.

    `column` names the folders' column (lengthened if docs has one of that name). An empty table writes no folders.
    """
    column = unused(docs, column)
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    key = unused(docs, "key")
    text = F.col(f"`{text_col}`").cast("string")
    # the key stands for a whole row, so that rows apart in any column are apart here
    keyed = docs.withColumn(key, F.sha2(F.to_json(F.struct(*(F.col(f"`{c}`") for c in docs.columns))), 256))
    dimensions = options.pop("dimensions", ("n_chars", "source", "lang"))
    slim = keyed.select(F.col(key).alias("id"), text.alias("text"), *(F.col(f"`{d}`").alias(f"dim{i}") for i, d in enumerate(d for d in dimensions if d in docs.columns)))
    rest = {k: v for k, v in options.items() if k not in ("id_col", "text_col")}
    shards = kd_shards(slim, tuple(c for c in slim.columns if c.startswith("dim")), "id", "text", **rest).select(F.col("id").alias(key), F.col("shard").alias(column)).distinct()
    keyed.join(shards, key).drop(key).write.partitionBy(column).parquet(path)
