import random

from pyspark.sql import functions as F

from photonflow.operators.clumping import Clumper
from photonflow.streaming import clumps

SCHEMA = "series long, row_id long, t long, x double, y double, radius double"


def test_clumps_of_a_stream_equal_one_scan(spark, tmp_path):
    rng = random.Random(5)
    rows = sorted(((i % 2, i, rng.randrange(60), rng.random() * 4, rng.random() * 4, 0.3) for i in range(120)), key=lambda r: (r[2], r[1]))
    for k in range(3):
        part = [r for r in rows if 20 * k <= r[2] < 20 * k + 20]
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = clumps.clump_stream(clumps.read_points(spark, str(tmp_path / "in"), spark.createDataFrame([], SCHEMA).schema, 1), 2)
    clumps.write_once(stream, str(tmp_path / "out"), str(tmp_path / "state"), ["series", "row_id"]).awaitTermination()
    got = {r.row_id: r.clumpIndex for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    for s in (0, 1):
        c = Clumper(2)
        assert all(got[i] == c.add(t, x, y, r) for k, i, t, x, y, r in rows if k == s)


def test_windows_of_frames(spark, tmp_path):
    rows = [(i, float(i)) for i in range(100)]
    spark.createDataFrame(rows, "s long, v double").withColumn("ts", F.timestamp_seconds("s")).write.parquet(str(tmp_path / "in"))
    points = spark.readStream.schema("s long, v double, ts timestamp").parquet(str(tmp_path / "in"))
    q = clumps.frame_windows(points, "ts", "10 seconds", "5 seconds", [], "v").writeStream.format("memory").queryName("wins").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.table("wins").orderBy("window").collect()
    assert len(got) >= 8 and all(r.n == 10 for r in got)
