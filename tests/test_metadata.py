import json

import pytest
from pyspark.sql import functions as F

from photonflow.operators import asof, metadata


def entries(spark, rows):
    return spark.createDataFrame(rows, "source string, key string, value string")


def test_entries_are_copied_merged_and_told_as_json(spark):
    a = entries(spark, [("s", "k", "1"), ("s", "null", None), ("s", 'quo"te', '"x"'), ("only", "k", "5")])
    b = entries(spark, [("s", "k", "2"), ("s", "null", "3"), ("s", "new", "[1, 2]"), ("other", "k", None)])
    told = lambda df: {(r.source, r.key): r.value for r in df.collect()}
    both = {("s", 'quo"te'): '"x"', ("only", "k"): "5", ("s", "new"): "[1, 2]", ("other", "k"): None}
    assert told(metadata.copy_entries(a, b)) == both | {("s", "k"): "2", ("s", "null"): "3"}
    assert told(metadata.merge_entries(a, b)) == both | {("s", "k"): "1", ("s", "null"): None}
    found = {r.source: json.loads(r.json) for r in metadata.to_json(metadata.merge_entries(a, b)).collect()}
    assert found == {"s": {"k": 1, "null": None, 'quo"te': "x", "new": [1, 2]}, "only": {"k": 5}, "other": {"k": None}}
    table = spark.createDataFrame([("s", 'a "b"\n', 1.5, None)], "id string, name string, v double, none string")
    assert told(metadata.entries_of(table, "id", name=F.col("name"), a__v=F.col("v"), none=F.col("none"))) == {("s", "name"): json.dumps('a "b"\n'), ("s", "a.v"): "1.5", ("s", "none"): None}


def test_sizes_and_origins(spark):
    rows = [("a", "voxelsize.x", "0.1"), ("a", "voxelsize.y", "0.2"), ("a", "voxelsize.z", "0.5"), ("a", "Camera.ROIOriginX", "10"), ("a", "Camera.ROIPosX", "99"), ("b", "voxelsize.x", "1"), ("b", "voxelsize.y", "1"), ("b", "Camera.ROIPosY", "3"), ("c", "voxelsize.x", "1")]
    e = entries(spark, rows)
    assert {r.source: (r.x, r.y, r.z) for r in metadata.voxel_sizes(e).collect()} == {"a": (100.0, 200.0, 500.0), "b": (1000.0, 1000.0, 0.0)}
    assert {r.source: (r.x, r.y, r.z) for r in metadata.origins(e).collect()} == {"a": (1000.0, 0.0, 0.0), "b": (0.0, 2000.0, 0.0)}


@pytest.mark.parametrize("block", [None, 3.0])
def test_focus_follows_targets_landings_and_offsets(spark, block):
    events = [("d", 1.0, "ProtocolFocus", "0, 10.5"), ("d", 2.0, "PiezoOnTarget", "12"), ("d", 4.0, "PiezoOffsetUpdate", "3, 0"), ("d", 5.0, "PiezoOnTarget", "20"), ("d", 6.0, "PiezoOnTarget", "no number"), ("e", 3.0, "PiezoOnTarget", "8"), ("d", 9.0, "PiezoOffsetUpdate", "1"), ("d", 9.0, "PiezoOnTarget", "4")]
    log = spark.createDataFrame(events, "drive string, t double, name string, description string")
    points = spark.createDataFrame([("d", float(t)) for t in range(11)] + [("e", 2.0), ("e", 3.0), ("f", 1.0)], "drive string, t double")
    got = {(r.drive, r.t): r.focus for r in asof.corrected_focus(points, log, ["drive"], "t", 7.0, block=block).collect()}
    want = {0: 7, 1: 10.5, 2: 9, 3: 9, 4: 9, 5: 17, 6: 17, 7: 17, 8: 17, 9: 3, 10: 3}
    assert got == {("d", float(t)): float(v) for t, v in want.items()} | {("e", 2.0): 7.0, ("e", 3.0): 8.0, ("f", 1.0): 7.0}
