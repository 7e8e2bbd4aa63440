"""Point streams: incremental merging by label, windows of frames, clumping with bounded state, sinks without duplicates."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.query import StreamingQuery

from photonflow.operators.clumping import Clumper


def read_points(spark: SparkSession, path: str, schema, files_at_once: int = 100) -> DataFrame:
    """Files of points as they land in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(path)


def frame_windows(points: DataFrame, time: str, width: str, late: str, keys: list[str], value: str) -> DataFrame:
    """Tumbling windows of event time, closed by a watermark: count, mean and sum of a value by keys."""
    return points.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.sum(value).alias("total"))


def session_windows(points: DataFrame, time: str, gap: str, late: str, keys: list[str]) -> DataFrame:
    return points.withWatermark(time, late).groupBy(F.session_window(time, gap), *keys).agg(F.count("*").alias("n"))


def merge_by_label(points: DataFrame, label: str, t: str, value: str) -> DataFrame:
    """Running clump totals, for update or complete output: count, sum, first frame, duration."""
    return points.groupBy(label).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.min(t).alias("tIndex"), (F.max(t) - F.min(t) + 1).alias("burstDuration"))


def clump_stream(points: DataFrame, gap: int) -> DataFrame:
    """series, row_id, clumpIndex of a stream of points (series, row_id, t, x, y, radius).

    The state of a series is its recent points and its next number. Points arrive in order of time between batches;
    inside one they are sorted here. What reaches back further than gap + 1 frames is forgotten.
    """

    def scan(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        clumper = Clumper(gap)
        if state.exists:
            number, t, x, y, ids = state.get
            clumper.next_id, clumper.recent = number, list(zip(t, x, y, ids, strict=True))
        rows = pd.concat(list(parts)).sort_values(["t", "row_id"])
        rows["clumpIndex"] = [clumper.add(*r) for r in zip(rows["t"].tolist(), rows["x"].tolist(), rows["y"].tolist(), rows["radius"].tolist(), strict=True)]
        t, x, y, ids = (list(c) for c in zip(*clumper.recent, strict=True))
        state.update((clumper.next_id, t, x, y, ids))
        yield rows[["series", "row_id", "clumpIndex"]]

    return points.groupBy("series").applyInPandasWithState(
        scan, "series long, row_id long, clumpIndex long", "number long, t array<long>, x array<double>, y array<double>, ids array<long>", "append", GroupStateTimeout.NoTimeout
    )


def write_once(stream: DataFrame, path: str, checkpoint: str, keys: list[str], live: bool = False) -> StreamingQuery:
    """Append each batch's new rows as a folder named by the batch: a batch that is run again replaces its own folder."""

    def save(batch: DataFrame, number: int) -> None:
        batch.dropDuplicates(keys).write.mode("overwrite").parquet(f"{path}/batch={number}")

    out = stream.writeStream.option("checkpointLocation", checkpoint).outputMode("append").foreachBatch(save)
    return (out.trigger(processingTime="1 second") if live else out.trigger(availableNow=True)).start()
