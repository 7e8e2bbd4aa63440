"""Shared helpers: table reading, lineage cuts in the shared folder, and byte-level tokenising."""

from __future__ import annotations

import atexit
import gc
import re
import shutil
import tempfile
import time
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

#: A-Z lowered; every ASCII byte outside 0-9 and a-z becomes a space; bytes from 0x80 stay.
ALNUM = bytes(
    (c + 32 if 0x41 <= c <= 0x5A else c) if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256)
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares. A local session that names none gets one of its own; on a cluster that would be
    another folder on every node, so there one has to be named."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not re.fullmatch(r"local(\[[\d*, ]+\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all nodes share")
        own = tempfile.mkdtemp(prefix="photonflow-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        named = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def shared_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: later jobs survive the loss of any executor."""
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Remove tables that cut() wrote and that nothing reads any more: what was made of them has been written itself."""
    for table in tables:
        spark = table.sparkSession
        for path in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            if shared_dir(spark).split(":", 1)[-1].strip("/") not in path:
                raise ValueError(f"{path} is no table of cut()")
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def settle(spark: SparkSession) -> None:
    """Collect the driver's garbage, so that Spark's cleaner removes the shuffle files of tables that nothing refers to any more."""
    gc.collect()
    time.sleep(0.5)  # what Python lets go of is released in the JVM by another thread
    spark._jvm.System.gc()


def space_words(text: bytes | None) -> list[bytes]:
    r"""Words `[^\x20\x09-\x0D]+` of UTF-8 bytes."""
    return text.split() if text else []


def alnum_words(text: bytes | None) -> list[bytes]:
    r"""Words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of UTF-8 bytes whose A-Z are lowered."""
    return text.translate(ALNUM).split() if text else []


def byte_rows(batch: pa.RecordBatch, key: str, text: str) -> Iterator[tuple[object, bytes | None]]:
    """(key, UTF-8 bytes) of each row, a slice of rows at a time so that few texts are held twice."""
    keys, texts = batch.column(key), batch.column(text)
    if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.binary() if pa.types.is_string(texts.type) else pa.large_binary())
    for i in range(0, len(keys), 256):
        yield from zip(keys.slice(i, 256).to_pylist(), texts.slice(i, 256).to_pylist(), strict=True)


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone; whatever else the table has can't clash with ours."""
    return df.select(*(F.col(f"`{n}`") for n in names))


def unused(df: DataFrame, name: str) -> str:
    """The name, or a longer one if df has a column of that name (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def ranged(rows: DataFrame, *order: str) -> DataFrame:
    """rows written in ranges of an order, with `_part`: the range's number. Rows of one place in the order share a range."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(rows.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "ranged")


def before_ranges(sums: DataFrame, group: str, value: str) -> DataFrame:
    """sums (group, _part, value), a row for each group in each range, with `_before`: the group's sum over the ranges before."""
    whole = F.sum(value).over(Window.partitionBy(group).orderBy("_part"))
    return sums.withColumn("_before", whole - F.col(value))


def numbered(rows: DataFrame, group: str, *order: str, out: str) -> DataFrame:
    """rows with their gapless numbers from 0 inside each group (no nulls), in the given order; equal rows in any order.

    Rows are dealt by range, so that a group of any size, or rows of one place in the order, are numbered by many tasks and in the same
    way at any size. rows should be scanned tables or what cut() gives, so that a task that is run again deals them alike.
    """
    tie = unused(rows, "_tie")
    placed = ranged(rows.withColumn(tie, F.monotonically_increasing_id()), group, *order, tie).drop(tie)
    # a row a range and one more a group at most; written, so that Spark knows their size
    counts = cut(before_ranges(placed.groupBy(group, "_part").agg(F.count("*").alias("_n")), group, "_n").drop("_n"), "counts")
    placed = placed.join(counts, [group, "_part"])
    place = F.row_number().over(Window.partitionBy(group, "_part").orderBy(*order)) - 1
    return placed.withColumn(out, (F.col("_before") + place).cast("long")).drop("_part", "_before")


#: Groups of more than one row in so many are joined by broadcast; there can't be more of them than this.
HEAVY = 10_000


def join_groups(rows: DataFrame, groups: DataFrame, key: str, count: str) -> DataFrame:
    """rows with what is told of their group: groups has a row for each key (no nulls) and `count`, its number of rows.

    The heavy groups, fewer than HEAVY, are joined by broadcast, the rest as Spark sees fit, so that no task gets a large group.
    """
    total = groups.agg(F.sum(count)).first()[0] or 0
    heavy = F.broadcast(groups.where(F.col(count) * HEAVY > total))
    one = rows.join(heavy, key)
    other = rows.join(heavy.select(key), key, "left_anti").join(groups, key)
    return one.unionByName(other)
