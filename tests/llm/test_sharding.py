import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

from photonflow.llm import sharding

DIMS = ("n_chars", "source", "lang")


def table(spark):
    rng = random.Random(2)
    rows = [(i, "é" * rng.randrange(40), "hot_source_a" if i % 3 else f"hot_source_{rng.randrange(9)}", None if i % 7 == 0 else "en", rng.randrange(90)) for i in range(600)]
    rows += [(None, None, None, None, None), (None, "", "hot", "en", 5), (9, "same", "hot", "en", 1), (9, "same", "hot", "en", 1)]
    return spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, lang string, n_chars long, size int")


def slow_shards(docs, shards):
    """id, size, crc and shard: large units to the emptiest shard, then a plain k-d tree over the rest, all over collected rows."""
    text = F.coalesce("text", F.lit("")).cast("binary")
    dims = {f"d{i}": sharding._dimension(docs, d) for i, d in enumerate(DIMS)}
    rows = docs.select(F.col("doc_id").alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("crc"), F.xxhash64(text).alias("key"), *(v.alias(k) for k, v in dims.items()))
    rows = rows.withColumn("deal", F.xxhash64("id", "size")).collect()
    total, groups = sum(r.size for r in rows), {}
    for r in rows:
        groups.setdefault(r.key, []).append(r)
    units = {}
    for key, own in groups.items():
        least, size = min(own, key=lambda r: (r.id is None, r.id or 0, *(r[d] for d in dims))), sum(r.size for r in own)
        parts = math.ceil(size * shards / total * 4) if size * shards > total else 1
        for p in range(parts):
            units[key, p] = (size / parts, parts, {d: least[d] for d in dims})
    ties = {(r.key, r.part): r.tie for r in docs.sparkSession.createDataFrame(list(units), "key long, part int").withColumn("tie", F.xxhash64("key", "part")).collect()}
    load, place = [0.0] * shards, {}
    small = {u for u in units if units[u][0] <= max(total / shards / 100, total / 10_000)}
    for u in sorted(set(units) - small, key=lambda u: (-units[u][0], u)):
        place[u] = load.index(min(load))
        load[place[u]] += units[u][0]
    low, high = 0.0, float(total)
    for _ in range(200):  # the level up to which small units fill the shards
        mid = (low + high) / 2
        low, high = (mid, high) if sum(max(0.0, mid - x) for x in load) < sum(units[u][0] for u in small) else (low, mid)
    room = [max(0.0, high - x) for x in load]
    wide = lambda some, d: max(units[u][2][d] for u in some) - min(units[u][2][d] for u in some) if isinstance(units[min(some)][2][d], float) else len({units[u][2][d] for u in some}) - 1
    root = {d: wide(small, d) if small else 0 for d in dims}

    def grow(some, k, first):
        if k == 1 or not some:
            place.update(dict.fromkeys(some, first))
            return
        axis = max(dims, key=lambda d: wide(some, d) / max(root[d], 1e-9))
        half, all_ = sum(room[first : first + k // 2]), sum(room[first : first + k])
        want, done, left = sum(units[u][0] for u in some) * (half / all_ if all_ else k // 2 / k), 0.0, set()
        for u in sorted(some, key=lambda u: (units[u][2][axis], ties[u])):
            if done >= want - 1e-6:
                break
            left.add(u)
            done += units[u][0]
        grow(left, k // 2, first)
        grow(some - left, k - k // 2, first + k // 2)

    grow(small, shards, 0)
    return sorted(str((r.id, r.size, r.crc, place[r.key, r.deal % units[r.key, 0][1]])) for r in rows)


@pytest.mark.parametrize("shards", [8, 3, 1])
@pytest.mark.parametrize("unlike", [False, True])
def test_kd_shards_equal_a_plain_tree(spark, shards, unlike):
    """Texts with many copies under different sources, and such that are nearly all unlike and small against a shard."""
    docs = table(spark)
    if unlike:
        docs = docs.unionByName(docs.withColumn("text", F.concat(F.coalesce("text", F.lit("")), F.lit(" "), F.coalesce("doc_id", F.lit(0)).cast("string"), F.lit("x" * 30)))).unionByName(docs.selectExpr("doc_id + 5000 AS doc_id", "concat('no', doc_id) AS text", "source", "lang", "n_chars", "size"))
    got = sharding.kd_shards(docs, shards=shards).collect()
    rows = docs.collect()
    assert sorted((str(r.doc_id), r["size"], r.text_crc32) for r in got) == sorted((str(r.doc_id), len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in rows)
    assert sorted(str((r.doc_id, r["size"], r.text_crc32, r.shard)) for r in got) == slow_shards(docs, shards)
    by, texts = {}, {}
    for r in got:
        by.setdefault(r.shard, []).append(r)
        texts.setdefault((r["size"], r.text_crc32), set()).add(r.shard)
    assert sorted(by) == list(range(shards)) and all(len(s) == 1 for s in texts.values())  # no group here is larger than a shard
    for part in by.values():
        assert sorted(r.slot for r in part) == list(range(len(part)))
    sizes = [sum(r["size"] for r in part) for part in by.values()]
    assert max(sizes) - min(sizes) <= 0.12 * sum(sizes) / shards
    assert sharding.kd_shards(docs.where("false")).count() == 0


def test_a_group_larger_than_a_shard_is_cut(spark):
    docs = spark.createDataFrame([(i, "hot" * 9 if i % 2 else f"text {i} " * 3, f"s{i % 5}") for i in range(2000)], "doc_id long, text string, source string")
    got = sharding.kd_shards(docs).collect()
    hot = {r.shard for r in got if r.text_crc32 == zlib.crc32(b"hot" * 9)}
    sizes = {}
    for r in got:
        sizes[r.shard] = sizes.get(r.shard, 0) + r["size"]
    assert 4 <= len(hot) <= 8 and max(sizes.values()) < 1.03 * min(sizes.values()), sizes


def test_target_bytes_and_equal_texts_everywhere(spark):
    docs = spark.createDataFrame([(i, "a" * 9) for i in range(400)], "doc_id long, text string")
    sizes = [r["n"] for r in sharding.kd_shards(docs, shards=None, target_bytes=500).groupBy("shard").count().withColumnRenamed("count", "n").collect()]
    assert len(sizes) == 8 and sum(sizes) == 400 and max(sizes) <= 80  # one text, cut by a hash of the id alone
    assert sharding.kd_shards(docs.where("false"), shards=None, target_bytes=500).count() == 0


def test_written_shards_hold_every_row(spark, tmp_path):
    docs = table(spark).withColumns({"shard": F.lit("mine"), "key": F.lit(1), "id": F.lit(None).cast("string")})
    sharding.write_shards(docs, f"{tmp_path}/out", shards=4)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert sorted(map(str, back.select(*docs.columns).collect())) == sorted(map(str, docs.collect()))
    assert {r[0] for r in back.select("shard_").distinct().collect()} == {0, 1, 2, 3}
