"""Exact dedup against a persistent digest index: bucketed and sorted by digest, new texts found by sort-merge anti-join, then appended.

DataFrame functions only. Only digests, lengths and ids are ever shuffled, never texts.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from photonflow.llm.common import cut, discard, join_groups, shared_path

#: What doesn't count in a text: `[\x20\x09-\x0D]`.
SPACE = " \t\n\x0b\x0c\r"

def digest(text: Column) -> Column:
    """Lower-case hex SHA-256 of a text without ASCII white space; null counts as empty."""
    return F.sha2(F.translate(F.coalesce(text.cast("string"), F.lit("")), SPACE, ""), 256)


class DigestIndex:
    """A table of (digest, n_chars, id) at `path`, in buckets sorted by digest, that outlives the session.

    A digest has a row for each time that a better text of it came; the best one holds: most code points, then smallest id (a null id
    comes last). Appending a batch again changes nothing, so a batch that failed half-way is just run again. The number of buckets and the type of
    ids are fixed when the index is made (both are kept beside it) and `buckets` and `id_type` are not looked at later.
    """

    def __init__(self, spark: SparkSession, path: str, id_type: str = "bigint", buckets: int | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        told = f"{self.path}/_definition"
        where = spark._jvm.org.apache.hadoop.fs.Path(told)
        if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
            buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
            spark.createDataFrame([(buckets, id_type)], "buckets int, id_type string").coalesce(1).write.parquet(told)
        self.buckets, self.id_type = spark.read.parquet(told).first()
        self.name = "digest_index_" + hashlib.sha256(self.path.encode()).hexdigest()[:16]
        # files name their bucket, so a new session only has to be told the layout
        spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name} (digest STRING, n_chars BIGINT, id {self.id_type}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}/rows'")

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def best(self) -> DataFrame:
        """(digest, id, n_chars) that hold; the buckets are grouped where they lie."""
        best = self.rows().groupBy("digest").agg(F.min(F.struct((-F.col("n_chars")).alias("neg"), F.col("id").isNull().alias("none"), "id")).alias("b"))
        return best.select("digest", F.col("b.id").alias("keep_id"))

    def missing(self, heads: DataFrame) -> DataFrame:
        """heads (digest, n_chars, id; one row a digest) of which the index has no text as good: a sort-merge anti-join that only moves heads."""
        known = self.rows().select("digest", F.col("n_chars").alias("n"), F.col("id").alias("i")).hint("merge")
        as_good = (F.col("n") > F.col("n_chars")) | ((F.col("n") == F.col("n_chars")) & F.coalesce(F.col("i") <= F.col("id"), F.col("id").isNull()))
        return heads.alias("h").join(known.alias("k"), (F.col("h.digest") == F.col("k.digest")) & as_good, "left_anti")

    def append(self, heads: DataFrame) -> None:
        """Take in what is missing; each task writes one bucket's file."""
        dealt = heads.repartition(self.buckets, "digest")
        self.missing(dealt).select("digest", "n_chars", "id").write.insertInto(self.name)

    def compacted(self, path: str) -> DigestIndex:
        """An index at another path that holds the best row of each digest, one sorted file a bucket."""
        out = DigestIndex(self.spark, path, self.id_type, self.buckets)
        best = self.rows().groupBy("digest").agg(F.min(F.struct((-F.col("n_chars")).alias("neg"), F.col("id").isNull().alias("none"), "id")).alias("b"))
        out.append(best.select("digest", (-F.col("b.neg")).alias("n_chars"), F.col("b.id").alias("id")))
        return out


def deduplicate(docs: DataFrame, index: DigestIndex | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    r"""One row per row of docs: id, keep_id, group_size, kept, text_sha256; the index has taken docs in.

    Texts are equal when identical without `[\x20\x09-\x0D]`. Of equal texts in docs and the index together, the row of most code
    points in the original text stays, of these the one of the smallest id, of repeated rows of an id any one; rows of a null id come last.
    keep_id is the id of that row, kept is true for it alone and false for all rows of a text of which the index holds a better
    row. group_size counts the rows of docs. Null texts equal empty ones. An empty table gives no rows; other columns are not read. A text is
    held once, however long, by the task that reads it. Without `index`, docs are held against each other only.

    Groups are counted before they are shuffled. Groups of more than one row in 10,000 are joined by broadcast (there are fewer than 10,000 of
    them), the rest by sort-merge, so no task gets a large group.
    """
    spark = docs.sparkSession
    index = index or DigestIndex(spark, shared_path(spark, "digests"), dict(docs.dtypes)[id_col])
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    told = cut(docs.select(F.col(f"`{id_col}`").alias("id"), digest(text).alias("digest"), F.length(text).cast("long").alias("n_chars"), F.monotonically_increasing_id().alias("row")), "digests")
    heads = told.groupBy("digest").agg(F.min(F.struct((-F.col("n_chars")).alias("neg"), F.col("id").isNull().alias("none"), "id", "row")).alias("b"), F.count("*").alias("group_size"))
    heads = cut(heads.select("digest", (-F.col("b.neg")).alias("n_chars"), F.col("b.id").alias("id"), F.col("b.row").alias("row"), "group_size"), "heads")
    index.append(heads)
    placed = heads.repartition(index.buckets, "digest").join(index.best().hint("merge"), "digest")
    found = cut(placed.select("digest", "keep_id", F.when(F.col("id").eqNullSafe(F.col("keep_id")), F.col("row")).alias("keep_row"), "group_size"), "found")
    discard(heads)
    told = join_groups(told.select("id", "digest", "row"), found, "digest", "group_size")
    kept = F.coalesce(F.col("row") == F.col("keep_row"), F.lit(False))
    return told.select(F.col("id").alias(id_col), "keep_id", "group_size", kept.alias("kept"), F.col("digest").alias("text_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS c, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t FROM documents)
SELECT doc_id, first_value(doc_id) OVER best AS keep_id, count(*) OVER (PARTITION BY t) AS group_size, doc_id = first_value(doc_id) OVER best AS kept, sha256(t) AS text_sha256
FROM d WINDOW best AS (PARTITION BY t ORDER BY c DESC, doc_id)
"""
