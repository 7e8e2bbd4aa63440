"""Registered queries of the point-table, image and event operators, each over whole tables, with DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from photonflow.functions.expr import with_mappings
from photonflow.operators import aggregates, asof, astigmatism, camera, clumping, emitters, flow, images, kernels, kinetics, localise, metadata, registration, shells, spatial, surfaces, tables, vectors, volumes, windows
from photonflow.plans.recipe import Recipe
from photonflow.sources.shared import scratch as _scratch, shared_dir as _shared
from photonflow.sources.tabular import metadata_value

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
AXES = ("x", "y", "z")

#: Minutes since the first day of the series.
T_SQL = "epoch_us(ts) // 60000000 - 28401120"


def query(sql: str = ""):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with t: the frame (minute)."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").withColumn("t", (F.floor(micros / 60_000_000) - 28_401_120).cast("long"))


def points_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = [F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(AXES)]
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", *at)


def rounded(df: DataFrame, *names: str, places: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n), places) for n in names})


POINTS = "p AS (SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings)"
EVENTS = f"e AS (SELECT *, {T_SQL} AS t FROM events)"


# --- the minimum slice, as a recipe ---------------------------------------------------------------------------------
SLICE = """
- FilterTable: {inputName: merged, filters: {nPhotons: [0, 1.0e+300]}, outputName: output}
- MergeClumps: {inputName: bright, labelKey: clumpIndex, discardTrivial: true, outputName: merged}
- Mapping: {inputName: events, mappings: {A: value, nPhotons: value * 2}, outputName: mapped}
- FilterTable: {inputName: mapped, filters: {value: [10, 50]}, outputName: bright}
"""


@query(f"WITH {EVENTS} SELECT user_id AS clumpIndex, count(*) AS n, round(avg(t), 6) AS t, round(sum(value), 6) AS A, round(sum(value * 2), 6) AS nPhotons FROM e WHERE value > 10 AND value < 50 AND user_id >= 1 GROUP BY 1")
def minimum_slice(spark, sf_dir):
    events = frames_of(spark, sf_dir).select(F.col("user_id").alias("clumpIndex"), "t", "value")
    out = Recipe.from_yaml(SLICE).execute({"events": events})["output"]
    return rounded(out, "t", "A", "nPhotons").select("clumpIndex", "n", "t", "A", "nPhotons")


# --- filters, projections, unions -----------------------------------------------------------------------------------
@query("SELECT event_id, user_id, value FROM events WHERE value > 10 AND value < 50")
def filter_range_open(spark, sf_dir):
    return tables.filter_table(table(spark, sf_dir, "events"), {"value": (10, 50)}).select("event_id", "user_id", "value")


@query(
    """WITH m AS (SELECT avg(o_totalprice) AS mean, stddev_pop(o_totalprice) AS sd FROM orders), d AS (SELECT o_orderkey, o_totalprice, o_totalprice - lag(o_totalprice) OVER (ORDER BY o_orderkey) AS step FROM orders)
    SELECT o_orderkey, round((o_totalprice - mean) / sd, 6) AS z, round(sum(o_totalprice) OVER (ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) / 1e6, 4) AS total, round(step, 2) AS step, round(step - avg(step) OVER (), 3) AS rest FROM d, m"""
)
def mapping_whole_columns(spark, sf_dir):
    maps = {"z": "(o_totalprice - mean(o_totalprice)) / std(o_totalprice)", "total": "cumsum(o_totalprice) / 1000000", "step": "diff(o_totalprice)", "rest": "step - mean(diff(o_totalprice))"}
    out = with_mappings(table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").cast("double").alias("o_totalprice")), maps, order=["o_orderkey"])
    return rounded(rounded(rounded(rounded(out, "z"), "total", places=4), "step", places=2), "rest", places=3).select("o_orderkey", *maps)


@query("SELECT event_id, user_id FROM events WHERE user_id IN (1, 5, 9, 100)")
def filter_by_ids(spark, sf_dir):
    return tables.filter_by_ids(table(spark, sf_dir, "events"), "user_id", [1, 5, 9, 100]).select("event_id", "user_id")


@query(
    """SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net, round(CASE WHEN l_discount <> 0 THEN l_tax / l_discount END, 6) AS ratio,
    round(sqrt(l_quantity) + exp(-l_discount * l_discount) * pi(), 6) AS mixed, CASE WHEN l_quantity >= 10 AND l_quantity < 30 THEN 1e0 ELSE 0e0 END AS flag FROM lineitem"""
)
def mapping_expr(spark, sf_dir):
    maps = {
        "net": "l_extendedprice * (1 - l_discount)", "ratio": "l_tax / l_discount", "mixed": "sqrt(l_quantity) + exp(-l_discount ** 2) * pi",
        "flag": "(l_quantity >= 10) * (l_quantity < 30)",
    }
    out = with_mappings(table(spark, sf_dir, "lineitem"), maps)
    return rounded(rounded(out, "net", places=4), "ratio", "mixed").select("l_orderkey", "l_linenumber", *maps)


@query(f"WITH {EVENTS} SELECT event_id, least(greatest(t // 5000, 0), 3) AS multiviewChannel, t - 5000 * (t // 5000) AS t FROM e")
def mapping_fold_mod(spark, sf_dir):
    return tables.fold(frames_of(spark, sf_dir), "t", 5000, 4).select("event_id", "multiviewChannel", F.col("t").cast("long").alias("t"))


@query("SELECT p_partkey, p_brand, p_size FROM part")
def select_columns(spark, sf_dir):
    return tables.select_columns(table(spark, sf_dir, "part"), "p_partkey  p_brand p_size")


@query("SELECT c_acctbal AS acctbal, c_nationkey AS nationkey, 0e0 AS concatSource FROM customer UNION ALL SELECT s_acctbal, s_nationkey, 1e0 FROM supplier")
def concat_tables(spark, sf_dir):
    a = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nationkey"), F.col("c_acctbal").alias("acctbal"), "c_mktsegment")
    b = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nationkey"), F.col("s_acctbal").alias("acctbal"))
    return tables.concatenate(a, b)


@query(
    """WITH r AS (SELECT row_number() OVER (ORDER BY r_regionkey) - 1 AS row_id, r_name AS name_region FROM region),
    n AS (SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS row_id, n_name AS name_nation FROM nation) SELECT * FROM r JOIN n USING (row_id)"""
)
def aggregate_tables_positional(spark, sf_dir):
    r = tables.numbered_rows(table(spark, sf_dir, "region"), ["r_regionkey"]).select("row_id", F.col("r_name").alias("name"))
    n = tables.numbered_rows(table(spark, sf_dir, "nation"), ["n_nationkey"]).select("row_id", F.col("n_name").alias("name"))
    return tables.aggregate_positional([r, n], ["_region", "_nation"])


@query(
    """SELECT c.c_custkey AS label, coalesce(o.n, 0) AS label_n, round(coalesce(o.total, 0), 2) AS label_total FROM customer c
    LEFT JOIN (SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS total FROM orders GROUP BY 1) o ON o.o_custkey = c.c_custkey"""
)
def label_join_zero_fill(spark, sf_dir):
    found = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("label")).agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total"))
    points = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("label"))
    return rounded(tables.add_measurements_by_label(points, found, "label"), "label_total", places=2)


@query("WITH c AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS k FROM events) SELECT event_id, CASE WHEN k >= 60 AND user_id <> 0 THEN user_id ELSE 0 END AS label, CASE WHEN k >= 60 AND user_id <> 0 THEN k ELSE 0 END AS NEvents FROM c")
def labels_min_count(spark, sf_dir):
    return tables.drop_small_labels(table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("label")), "label", 60)


@query(
    """WITH c AS (SELECT user_id, sum(CASE WHEN event_type = 'click' THEN value ELSE 0 END) AS a, sum(CASE WHEN event_type = 'view' THEN value ELSE 0 END) AS b FROM events GROUP BY 1)
    SELECT user_id, round(a, 4) AS p_click FROM c WHERE 0.01 + a + b <> 0 AND a / (0.01 + a + b) > 0.5 AND b / (0.01 + a + b) < 0.5"""
)
def colour_filter(spark, sf_dir):
    total = lambda k: F.sum(F.when(F.col("event_type") == k, F.col("value")).otherwise(0)).alias(f"p_{k}")
    wide = table(spark, sf_dir, "events").groupBy("user_id").agg(total("click"), total("view")).withColumn("ColourNorm", F.lit(1.0))
    return rounded(tables.colour_filter(wide, "click", ["click", "view"], 0.5, 0.5), "p_click", places=4).select("user_id", "p_click")


@query(f"WITH {EVENTS} SELECT event_id, CAST((t // 100) % 2 AS DOUBLE) AS p_block0, CAST(1 - (t // 100) % 2 AS DOUBLE) AS p_block1 FROM e")
def time_blocks(spark, sf_dir):
    return tables.time_blocks(frames_of(spark, sf_dir), 100).select("event_id", "p_block0", "p_block1")


@query(
    f"""WITH {EVENTS}, m AS (SELECT user_id, t AS frame FROM e WHERE event_type = 'error'), r AS (SELECT f AS t, count(*) AS n FROM (SELECT unnest(range(frame, frame + 30)) AS f FROM m) GROUP BY 1)
    SELECT event_id, 1 - coalesce(n, 0) AS piezoUnstable FROM e LEFT JOIN r USING (t)"""
)
def motion_flags(spark, sf_dir):
    e = frames_of(spark, sf_dir)
    moves = e.where("event_type = 'error'").select(F.col("t").alias("frame"))
    return tables.motion_flags(e, moves, 30).select("event_id", "piezoUnstable")


@query("SELECT * FROM part ORDER BY md5('0:' || p_partkey) LIMIT 100")
def random_subset(spark, sf_dir):
    return tables.random_subset(table(spark, sf_dir, "part"), 100, key=F.col("p_partkey"))


@query("SELECT event_id, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE), -1) AS k FROM events")
def metadata_lookup(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", metadata_value(F.col("props"), "k", -1.0).alias("k"))


# --- aggregation ----------------------------------------------------------------------------------------------------
@query("SELECT user_id AS clumpIndex, count(*) AS n, round(sum(value), 4) AS A, round(avg(value), 6) AS m FROM events GROUP BY 1")
def merge_clumps_mean_sum(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("clumpIndex"), F.col("value").alias("A"), F.col("value").alias("m"))
    return rounded(rounded(aggregates.merge_clumps(rows, dense=False), "A", places=4), "m").select("clumpIndex", "n", "A", "m")


@query(
    """SELECT l_suppkey AS clumpIndex, count(*) AS n, round(sum(l_quantity / ((l_discount + 0.01) * (l_discount + 0.01))) / sum(1 / ((l_discount + 0.01) * (l_discount + 0.01))), 6) AS x,
    round(sqrt(1 / sum(1 / ((l_discount + 0.01) * (l_discount + 0.01)))), 8) AS error_x FROM lineitem WHERE l_suppkey >= 1 GROUP BY 1"""
)
def merge_clumps_weighted(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("clumpIndex"), F.col("l_quantity").alias("x"), (F.col("l_discount") + 0.01).alias("error_x"))
    return rounded(rounded(aggregates.merge_clumps(rows, discard_trivial=True), "x"), "error_x", places=8)


@query(f"WITH {EVENTS} SELECT user_id, CAST(min(t) AS DOUBLE) AS tIndex, count(*) AS nFrames, max(t) - min(t) + 1 AS burstDuration, round(sum(value), 4) AS nPhotons, round(avg(value), 6) AS photonRate FROM e GROUP BY 1")
def coalesce_clumps(spark, sf_dir):
    return rounded(rounded(aggregates.coalesce_clumps(frames_of(spark, sf_dir), "user_id", "t", "value"), "nPhotons", places=4), "photonRate")


@query("WITH g AS (SELECT user_id * 2 AS c, count(*) AS n, avg(value) AS m FROM events WHERE user_id <> 3 GROUP BY 1) SELECT CAST(i AS BIGINT) AS clumpIndex, coalesce(n, 0) AS n, round(coalesce(m, 0), 6) AS m FROM range(0, (SELECT max(c) + 1 FROM g)) r(i) LEFT JOIN g ON c = i")
def merge_clumps_dense(spark, sf_dir):
    rows = table(spark, sf_dir, "events").where("user_id <> 3").select((F.col("user_id") * 2).alias("clumpIndex"), F.col("value").alias("m"))
    return rounded(aggregates.merge_clumps(rows), "m")


@query(
    f"""WITH {EVENTS}, k AS (SELECT unnest(range(1, 10)) AS k), g AS (SELECT k, user_id, count(*) AS n FROM e, k WHERE t > 0 AND t < 45000 AND t < k * 5000 AND user_id <> 0 GROUP BY 1, 2)
    SELECT k * 5000 AS t, count(user_id) FILTER (n >= 20) AS n_low, count(user_id) FILTER (n >= 30) AS n_high FROM k LEFT JOIN g USING (k) GROUP BY 1"""
)
def cluster_count_vs_time(spark, sf_dir):
    return aggregates.cluster_count_vs_time(frames_of(spark, sf_dir), "user_id", "t", 20, 30, 5000, 45000)


@query("WITH h AS (SELECT least(CAST(floor((l_quantity - 1) / 7) AS INTEGER), 6) AS bin, count(*) AS n FROM lineitem WHERE l_quantity BETWEEN 1 AND 50 GROUP BY 1) SELECT CAST(i AS INTEGER) AS bin, 1 + i * 7e0 AS bin_left, coalesce(n, 0) AS n FROM range(0, 7) r(i) LEFT JOIN h ON bin = i")
def histogram_closed_last(spark, sf_dir):
    return aggregates.histogram(table(spark, sf_dir, "lineitem"), F.col("l_quantity"), 8, 1.0, 50.0)


BINNED = "WITH b AS (SELECT CAST(floor((l_quantity - 0) / 5) AS INTEGER) AS bin, l_extendedprice AS v FROM lineitem WHERE l_quantity >= 0 AND l_quantity < 60)"


@query(BINNED + " SELECT CAST(i AS INTEGER) AS bin, count(v) AS n, round(coalesce(avg(v), 0), 4) AS mean, round(coalesce(stddev_pop(v), 0), 4) AS std FROM range(0, 12) r(i) LEFT JOIN b ON bin = i GROUP BY 1")
def binned_average(spark, sf_dir):
    out = aggregates.binned(table(spark, sf_dir, "lineitem"), F.col("l_quantity"), F.col("l_extendedprice"), 0.0, 5.0, 12)
    return rounded(out, "mean", "std", places=4).select("bin", "n", "mean", "std")


@query(BINNED + " SELECT CAST(i AS INTEGER) AS bin, round(coalesce(median(v), 0), 4) AS median FROM range(0, 12) r(i) LEFT JOIN b ON bin = i GROUP BY 1")
def binned_median(spark, sf_dir):
    out = aggregates.binned(table(spark, sf_dir, "lineitem"), F.col("l_quantity"), F.col("l_extendedprice"), 0.0, 5.0, 12)
    return rounded(out, "median", places=4).select("bin", "median")


@query(
    """WITH u AS (SELECT vec_id, CAST(CAST(round(CAST(unnest(embedding) AS DOUBLE) * 10) AS BIGINT) AS DOUBLE) AS v FROM embeddings), m AS (SELECT vec_id, v, row_number() OVER (PARTITION BY vec_id ORDER BY count(*) DESC, v) AS k FROM u GROUP BY 1, 2)
    SELECT vec_id, round(var_pop(u.v), 6) AS variance, round(avg(u.v), 6) AS mean, round(median(u.v), 6) AS median, any_value(m.v) AS mode FROM u JOIN m USING (vec_id) WHERE k = 1 GROUP BY 1"""
)
def stats_by_frame(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda v: F.round(v.cast("double") * 10).cast("long")).alias("pixels"))
    return rounded(aggregates.pixel_statistics(rows, "vec_id", "pixels"), "variance", "mean", "median")


@query("SELECT label, CAST(pos AS INTEGER) AS pos, round(max(v), 6) AS value FROM (SELECT label, unnest(range(0, 64)) AS pos, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings) GROUP BY 1, 2")
def projection_max(spark, sf_dir):
    return rounded(aggregates.projection(table(spark, sf_dir, "embeddings"), "embedding", "Max", ["label"]), "value")


@query(
    """SELECT round(corr(l_quantity, l_extendedprice), 6) AS pearson, round(sum(l_quantity * l_extendedprice) / sqrt(sum(l_quantity * l_quantity) * sum(l_extendedprice * l_extendedprice)), 6) AS overlap,
    round(sum(CASE WHEN l_extendedprice > 30000 THEN l_quantity ELSE 0 END) / sum(l_quantity), 6) AS manders_a, round(sum(CASE WHEN l_quantity > 25 THEN l_extendedprice ELSE 0 END) / sum(l_extendedprice), 6) AS manders_b FROM lineitem"""
)
def coloc_pearson_manders(spark, sf_dir):
    return rounded(aggregates.colocalisation(table(spark, sf_dir, "lineitem"), F.col("l_quantity"), F.col("l_extendedprice"), 25.0, 30000.0), "pearson", "overlap", "manders_a", "manders_b")


@query(
    """WITH j AS (SELECT least(greatest(floor(l_quantity / 10), 0), 4) AS i, least(greatest(floor(l_linenumber / 10), 0), 4) AS j, CAST(count(*) AS DOUBLE) AS n FROM lineitem GROUP BY 1, 2),
    p AS (SELECT n / sum(n) OVER () AS p, sum(n) OVER (PARTITION BY i) / sum(n) OVER () AS a, sum(n) OVER (PARTITION BY j) / sum(n) OVER () AS b FROM j) SELECT round(sum(p * ln(p / (a * b))), 9) AS mutual_information FROM p"""
)
def mutual_information(spark, sf_dir):
    return rounded(aggregates.mutual_information(table(spark, sf_dir, "lineitem"), F.col("l_quantity"), F.col("l_linenumber"), 5, 0.0, 50.0), "mutual_information", places=9)


@query(
    f"""WITH {POINTS}, m AS (SELECT avg(x) AS mx, avg(y) AS my FROM p), k AS (SELECT unnest(range(0, 3)) AS k)
    SELECT CAST(a.k AS INTEGER) AS i, CAST(b.k AS INTEGER) AS j, round(avg(pow(x - mx, a.k) * pow(y - my, b.k)), 8) AS moment FROM p, m, k a, k b GROUP BY 1, 2"""
)
def centred_moments(spark, sf_dir):
    return rounded(aggregates.centred_moments(points_of(spark, sf_dir), "x", "y", 2), "moment", places=8)


@query(
    f"""WITH {POINTS} SELECT label, count(*) AS count, round(avg(x), 6) AS x_mean, round(stddev_samp(x), 6) AS sigma_x, round(covar_samp(x, y), 8) AS cov_xy,
    round(sqrt(var_pop(x) + var_pop(y) + var_pop(z)), 6) AS gyrationRadius FROM p WHERE label > 0 GROUP BY 1"""
)
def cluster_moments(spark, sf_dir):
    out = aggregates.cluster_moments(points_of(spark, sf_dir), "label")
    return rounded(rounded(out, "x_mean", "sigma_x", "gyrationRadius"), "cov_xy", places=8).select("label", "count", "x_mean", "sigma_x", "cov_xy", "gyrationRadius")


@query()
def cluster_axes(spark, sf_dir):
    return clumping.principal_axes(points_of(spark, sf_dir), "label")


@query(f"WITH {POINTS} SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, min(z) AS z0, max(z) AS z1 FROM p")
def image_bounds(spark, sf_dir):
    return aggregates.image_bounds(points_of(spark, sf_dir))


# --- windows --------------------------------------------------------------------------------------------------------
@query(
    f"""WITH {EVENTS}, s AS (SELECT event_id, sqrt((t - lag(t) OVER w) ** 2 + (value - lag(value) OVER w) ** 2) AS a, sqrt((t - lead(t) OVER w) ** 2 + (value - lead(value) OVER w) ** 2) AS b FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id))
    SELECT event_id, round(CASE WHEN a IS NULL AND b IS NULL THEN 0 WHEN a IS NULL THEN b WHEN b IS NULL THEN a ELSE (a + b) / 2 END, 4) AS trackVelocity, CAST(a IS NULL OR b IS NULL AS INTEGER) AS clumpEdge FROM s"""
)
def track_velocity(spark, sf_dir):
    return rounded(windows.track_velocity(frames_of(spark, sf_dir), "user_id", ["t", "event_id"], "t", "value"), "trackVelocity", places=4).select("event_id", "trackVelocity", "clumpEdge")


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id) AS clumpSize FROM events")
def clump_size(spark, sf_dir):
    return windows.clump_size(table(spark, sf_dir, "events"), "user_id").select("event_id", "clumpSize")


@query(
    f"""WITH {EVENTS}, g AS (SELECT user_id, t - lag(t) OVER (PARTITION BY user_id ORDER BY t) - 1 AS o FROM (SELECT DISTINCT user_id, t FROM e)), c AS (SELECT user_id, o, count(*) AS k FROM g WHERE o > 0 GROUP BY 1, 2)
    SELECT user_id, o AS off, round(sum(k) OVER (PARTITION BY user_id ORDER BY o) / sum(k) OVER (PARTITION BY user_id), 9) AS cdf FROM c"""
)
def offtime_cdf(spark, sf_dir):
    return rounded(windows.offtime_cdf(frames_of(spark, sf_dir), "user_id", "t"), "cdf", places=9)


@query(f"WITH {EVENTS} SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY t RANGE BETWEEN 1000 PRECEDING AND 1 PRECEDING), 6) AS background FROM e")
def sliding_background(spark, sf_dir):
    return rounded(windows.sliding_mean(frames_of(spark, sf_dir), "user_id", "t", "value", -1000, 0), "background").select("event_id", "background")


@query(
    f"""WITH {EVENTS}, h AS (SELECT event_id, list_sort(list(value) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN 10 PRECEDING AND CURRENT ROW)) AS l FROM e)
    SELECT event_id, l[CAST(floor(len(l) * 0.25) AS BIGINT) + 1] AS percentile FROM h"""
)
def sliding_percentile(spark, sf_dir):
    return windows.sliding_percentile(frames_of(spark, sf_dir), "user_id", ["t", "event_id"], "value", 10, 0, 0.25).select("event_id", "percentile")


@query(
    f"""WITH {EVENTS}, f AS (SELECT *, CAST(value > 10 AS INTEGER) AS f FROM e), r AS (SELECT *, sum(1 - f) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS r FROM f)
    SELECT user_id, min(t) AS start, max(t) AS stop, count(*) AS n FROM r WHERE f = 1 GROUP BY user_id, r HAVING count(*) >= 3"""
)
def gaps_islands(spark, sf_dir):
    return windows.runs(frames_of(spark, sf_dir), "user_id", ["t", "event_id"], F.col("value") > 10, 3)


@query(
    f"""WITH {EVENTS}, s AS (SELECT user_id, t, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t) <= 200 THEN 0 ELSE 1 END AS b FROM e), g AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS g FROM s)
    SELECT user_id, min(t) AS start, max(t) AS stop, count(*) AS n FROM g GROUP BY user_id, g"""
)
def session_gap(spark, sf_dir):
    return windows.sessions(frames_of(spark, sf_dir), "user_id", "t", 200)


# --- as-of ----------------------------------------------------------------------------------------------------------
@query(
    """SELECT p.event_id, coalesce(v.value, -1.0) AS state FROM (SELECT * FROM events WHERE event_type = 'purchase') p
    ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'view' GROUP BY 1, 2) v ON p.user_id = v.user_id AND p.ts >= v.ts"""
)
def asof_event_state(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return asof.as_of(e.where("event_type = 'purchase'"), e.where("event_type = 'view'"), ["user_id"], "ts", "value", "state", F.lit(-1.0)).select("event_id", "state")


@query(
    """SELECT e.event_id, coalesce(s.event_type = 'view', false) AS state FROM (SELECT * FROM events WHERE event_type = 'click') e
    ASOF LEFT JOIN (SELECT user_id, ts, max(event_type) AS event_type FROM events WHERE event_type IN ('view', 'error') GROUP BY 1, 2) s ON e.user_id = s.user_id AND e.ts >= s.ts"""
)
def bool_between_events(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return asof.state_between(e.where("event_type = 'click'"), e, ["user_id"], "ts", "event_type", "view", "error").select("event_id", "state")


@query(
    f"""WITH {EVENTS}, s AS (SELECT user_id, t, row_number() OVER (PARTITION BY user_id ORDER BY t) * 100 AS frame FROM (SELECT DISTINCT user_id, t FROM e WHERE event_type = 'error')),
    n AS (SELECT *, lead(frame) OVER (PARTITION BY user_id ORDER BY t) AS nxt FROM s)
    SELECT e.event_id, least(n.frame + floor((e.t - n.t) / 7.0), n.nxt) AS frame FROM (SELECT * FROM e WHERE event_type = 'click') e ASOF LEFT JOIN n ON e.user_id = n.user_id AND e.t >= n.t"""
)
def frame_time_roundtrip(spark, sf_dir):
    e = frames_of(spark, sf_dir)
    from pyspark.sql import Window

    starts = e.where("event_type = 'error'").select("user_id", "t").distinct()
    starts = starts.withColumn("frame", F.row_number().over(Window.partitionBy("user_id").orderBy("t")) * 100)
    return asof.times_to_frames(e.where("event_type = 'click'"), starts, ["user_id"], "t", 7.0).select("event_id", "frame")


# --- space ----------------------------------------------------------------------------------------------------------
DIST = "sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2)"


@query(f"WITH {POINTS}, d AS (SELECT a.vec_id, b.vec_id AS o, {DIST} AS d FROM p a JOIN p b ON a.vec_id <> b.vec_id) SELECT vec_id, arg_min(o, (d, o)) AS neighbour, round(min(d), 9) AS distance FROM d GROUP BY 1")
def nearest_neighbour(spark, sf_dir):
    _shared(spark)
    p = points_of(spark, sf_dir).select("vec_id", *AXES)
    return rounded(spatial.nearest(p, p, AXES, 0.05, "vec_id", same=True), "distance", places=9)


@query(f"WITH {POINTS}, d AS (SELECT a.label, a.vec_id, b.vec_id AS o, {DIST} AS d FROM p a JOIN p b ON a.label = b.label AND a.vec_id % 2 = 0 AND b.vec_id % 2 = 1) SELECT label, vec_id, arg_min(o, (d, o)) AS pair, round(min(d), 9) AS distance FROM d GROUP BY 1, 2")
def keep_pairs(spark, sf_dir):
    _shared(spark)
    p = points_of(spark, sf_dir)
    return rounded(spatial.keep_pairs(p.where("vec_id % 2 = 0"), p.where("vec_id % 2 = 1"), "label", AXES, "vec_id", 0.2), "distance", places=9)


@query(f"WITH {POINTS}, h AS (SELECT CAST(floor({DIST} / 0.01) AS INTEGER) AS bin, count(*) AS n FROM p a JOIN p b ON a.vec_id < b.vec_id WHERE {DIST} < 0.2 GROUP BY 1) SELECT CAST(i AS INTEGER) AS bin, round(i * 1e-2, 6) AS bin_left, coalesce(n, 0) AS n FROM range(0, 20) r(i) LEFT JOIN h ON bin = i")
def pair_distance_hist(spark, sf_dir):
    return rounded(spatial.pair_histogram(points_of(spark, sf_dir), AXES, 20, 0.01, "vec_id"), "bin_left")


@query(
    f"""WITH {POINTS}, h AS (SELECT CAST(floor({DIST} / 0.01) AS INTEGER) AS bin, count(*) AS n FROM p a JOIN p b ON a.vec_id < b.vec_id WHERE {DIST} < 0.2 GROUP BY 1),
    k AS (SELECT i, 1.0 / (SELECT count(*) * count(*) FROM p) * 2 * sum(coalesce(n, 0)) OVER (ORDER BY i) AS k FROM range(0, 20) r(i) LEFT JOIN h ON bin = i)
    SELECT CAST(i AS INTEGER) AS bin, round(k, 9) AS K, round(cbrt(k * 3 / (4 * pi())), 9) AS L, round(cbrt(k * 3 / (4 * pi())) - (i + 1) * 0.01, 9) AS H FROM k"""
)
def ripley_l(spark, sf_dir):
    return rounded(spatial.ripley(points_of(spark, sf_dir), AXES, 20, 0.01, "vec_id", 1.0), "K", "L", "H", places=9).select("bin", "K", "L", "H")


@query(
    f"""WITH {POINTS}, d AS (SELECT a.vec_id, {DIST} AS d, row_number() OVER (PARTITION BY a.vec_id ORDER BY {DIST}, b.vec_id) AS k FROM p a JOIN p b ON a.vec_id <> b.vec_id WHERE {DIST} < 0.1)
    SELECT vec_id, count(*) AS n, round(sum(d ** 3 * k) / sum(d ** 6), 2) AS density FROM d WHERE k <= 10 GROUP BY 1"""
)
def local_density(spark, sf_dir):
    return rounded(spatial.local_density(points_of(spark, sf_dir), AXES, 10, 0.1, "vec_id"), "density", places=2)


@query(
    f"""WITH {EVENTS} SELECT CAST(abs(a.t - b.t) // 60 AS INTEGER) AS lag, count(*) AS n, round(avg((a.value - b.value) ** 2), 4) AS msd
    FROM e a JOIN e b ON a.user_id = b.user_id AND a.event_id < b.event_id WHERE abs(a.t - b.t) < 600 GROUP BY 1"""
)
def msd_by_lag(spark, sf_dir):
    return rounded(spatial.mean_square_displacement(frames_of(spark, sf_dir), "user_id", "t", ["value"], 10, 60, "event_id"), "msd", places=4)


@query(f"WITH {POINTS} SELECT CAST(floor((x + 1) / 0.05) AS INTEGER) AS ix, CAST(floor((y + 1) / 0.05) AS INTEGER) AS iy, count(*) AS n FROM p GROUP BY 1, 2")
def render_hist2d(spark, sf_dir):
    return spatial.render_histogram(points_of(spark, sf_dir), F.col("x"), F.col("y"), -1.0, -1.0, 0.05)


@query(
    f"""WITH {POINTS}, s AS (SELECT x, y, 0.02 AS s, unnest(range(CAST(floor((x - 0.08 + 1) / 0.05) AS BIGINT), CAST(floor((x + 0.08 + 1) / 0.05) AS BIGINT) + 1)) AS ix FROM p),
    q AS (SELECT *, unnest(range(CAST(floor((y - 0.08 + 1) / 0.05) AS BIGINT), CAST(floor((y + 0.08 + 1) / 0.05) AS BIGINT) + 1)) AS iy FROM s)
    SELECT CAST(ix AS INTEGER) AS ix, CAST(iy AS INTEGER) AS iy, round(sum(exp(-(((ix + 0.5) * 0.05 - 1 - x) ** 2 + ((iy + 0.5) * 0.05 - 1 - y) ** 2) / (2 * s * s)) / (2 * pi() * s * s) * 0.0025), 6) AS value FROM q GROUP BY 1, 2"""
)
def render_gauss2d(spark, sf_dir):
    return rounded(spatial.render_gaussian(points_of(spark, sf_dir).withColumn("s", F.lit(0.02)), "x", "y", "s", -1.0, -1.0, 0.05), "value")


@query(f"WITH {POINTS} SELECT l AS level, CAST(floor((x + 1) / 2 * pow(2, l)) AS BIGINT) AS ix, CAST(floor((y + 1) / 2 * pow(2, l)) AS BIGINT) AS iy, count(*) AS n FROM p, (SELECT CAST(unnest(range(0, 6)) AS INTEGER) AS l) GROUP BY 1, 2, 3")
def quadtree_counts(spark, sf_dir):
    return spatial.octree_cells(points_of(spark, sf_dir), ["x", "y"], [-1.0, -1.0], 2.0, 5)


@query(
    f"""WITH RECURSIVE {POINTS}, n AS (SELECT a.vec_id AS a, b.vec_id AS b FROM p a JOIN p b ON {DIST} < 0.08), core AS (SELECT a AS id FROM n GROUP BY 1 HAVING count(*) >= 4),
    e AS (SELECT n.a, n.b FROM n JOIN core c ON c.id = n.a JOIN core d ON d.id = n.b), reach(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON e.a = r.b),
    comp AS (SELECT a AS id, min(b) + 1 AS c FROM reach GROUP BY 1), edge AS (SELECT n.b AS id, min(c) AS c FROM n JOIN comp ON comp.id = n.a GROUP BY 1)
    SELECT p.vec_id, coalesce(comp.c, edge.c, 0) AS "dbscanClumpID" FROM p LEFT JOIN comp ON comp.id = p.vec_id LEFT JOIN edge ON edge.id = p.vec_id"""
)
def dbscan(spark, sf_dir):
    _shared(spark)
    return clumping.dbscan(points_of(spark, sf_dir), AXES, 0.08, 4, "vec_id").select("vec_id", "dbscanClumpID")


@query()
def find_clumps(spark, sf_dir):
    e = frames_of(spark, sf_dir).withColumns({"x": F.col("value"), "y": F.lit(0.0), "r": F.lit(2.0)})
    return windows.clump_size(clumping.find_clumps(e, "user_id", "t", "x", "y", "r", 300, "event_id"), "clumpIndex").select("event_id", "user_id", "clumpIndex", "clumpSize")


@query()
def overlap_reject(spark, sf_dir):
    _shared(spark)
    return clumping.overlap_rejection(points_of(spark, sf_dir), ("x", "y"), 0.02, "vec_id").select("vec_id", "rejected")


@query()
def gmm_label(spark, sf_dir):
    return clumping.mixture_labels(points_of(spark, sf_dir), AXES, 3, "vec_id").select("vec_id", "gmmLabel")


@query()
def tsp_order(spark, sf_dir):
    _shared(spark)
    return clumping.route_order(points_of(spark, sf_dir), "x", "y", 0.2, "vec_id")


@query()
def track_features(spark, sf_dir):
    e = frames_of(spark, sf_dir)
    return clumping.track_frames(e, "event_type", "t", ["value"], "event_id", r0=5.0).select("event_id", "event_type", "clumpIndex")


# --- images ---------------------------------------------------------------------------------------------------------
def image_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each embedding as a frame of 8 x 8 pixels, its label being the series."""
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.lit(8).alias("height"), F.lit(8).alias("width"), F.transform("embedding", lambda v: v.cast("double")).alias("pixels"))


def exploded(frames: DataFrame) -> DataFrame:
    return frames.select("vec_id", F.posexplode("pixels").alias("pos", "value"))


PIXELS = "u AS (SELECT vec_id, label, CAST(unnest(range(0, 64)) AS INTEGER) AS pos, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)"


@query(f"WITH {PIXELS} SELECT vec_id, pos, round((v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w), 6) AS value FROM u WINDOW w AS (PARTITION BY vec_id)")
def image_normalise(spark, sf_dir):
    return rounded(exploded(images.normalise(image_frames(spark, sf_dir))), "value")


@query(f"WITH {PIXELS} SELECT vec_id, pos, CASE WHEN v > 0.1 THEN 1e0 ELSE 0e0 END AS value FROM u")
def image_threshold(spark, sf_dir):
    return exploded(images.threshold(image_frames(spark, sf_dir), 0.1))


@query(f"WITH {PIXELS} SELECT vec_id, CAST((pos // 8 - 2) * 3 + pos % 8 - 1 AS INTEGER) AS pos, v AS value FROM u WHERE pos // 8 >= 2 AND pos % 8 BETWEEN 1 AND 3")
def image_crop(spark, sf_dir):
    return exploded(images.crop(image_frames(spark, sf_dir), (2, -1), (1, 4)))


@query(f"WITH {PIXELS} SELECT vec_id, pos, round(v - avg(v) OVER (PARTITION BY label, pos ORDER BY vec_id RANGE BETWEEN 32 PRECEDING AND 1 PRECEDING), 6) AS value FROM u")
def image_background(spark, sf_dir):
    out = images.background_subtract(image_frames(spark, sf_dir), "label", "vec_id", -32, 0)
    return rounded(out.select("vec_id", F.posexplode("pixels").alias("pos", "value")), "value")


def mirrored(place: str) -> str:
    """A row or column of a frame of 8, reflected at the edges as often as it takes."""
    return f"least((({place}) % 16 + 16) % 16, 15 - (({place}) % 16 + 16) % 16)"


def blur_sql(sigma: float, source: str, name: str) -> str:
    """Tables: a Gaussian blur of `source` (vec_id, pos, v), columns first."""
    reach = max(1, int(4 * sigma + 0.5))
    weights = f"(SELECT d, exp(-0.5 * (d / {sigma}::DOUBLE) ** 2) / sum(exp(-0.5 * (d / {sigma}::DOUBLE) ** 2)) OVER () AS k FROM (SELECT unnest(range({-reach}, {reach + 1})) AS d))"
    return f"""{name}_y AS (SELECT s.vec_id, s.pos, sum(k * q.v) AS v FROM {source} s CROSS JOIN {weights} w JOIN {source} q ON q.vec_id = s.vec_id AND q.pos = {mirrored("s.pos // 8 + d")} * 8 + s.pos % 8 GROUP BY 1, 2),
    {name} AS (SELECT s.vec_id, s.pos, sum(k * q.v) AS v FROM {name}_y s CROSS JOIN {weights} w JOIN {name}_y q ON q.vec_id = s.vec_id AND q.pos = s.pos // 8 * 8 + {mirrored("s.pos % 8 + d")} GROUP BY 1, 2)"""


@query(f"WITH {PIXELS}, {blur_sql(1.0, 'u', 'g')} SELECT vec_id, pos, CASE WHEN round(v, 6) = 0 THEN 0e0 ELSE round(v, 6) END AS value FROM g")
def image_gaussian(spark, sf_dir):
    return rounded(exploded(images.frame_filter(image_frames(spark, sf_dir), images.gaussian(1.0))), "value")


@query()
def image_median(spark, sf_dir):
    return exploded(images.frame_filter(image_frames(spark, sf_dir), images.median3))


@query(
    f"""WITH RECURSIVE {PIXELS}, m AS (SELECT vec_id, pos, v FROM u WHERE v > 0.1),
    e AS (SELECT a.vec_id, a.pos AS a, b.pos AS b FROM m a JOIN m b ON b.vec_id = a.vec_id AND abs(a.pos // 8 - b.pos // 8) + abs(a.pos % 8 - b.pos % 8) = 1),
    r AS (SELECT vec_id, pos AS a, pos AS b FROM m UNION SELECT r.vec_id, r.a, e.b FROM r JOIN e ON e.vec_id = r.vec_id AND e.a = r.b),
    l AS (SELECT vec_id, b AS pos, min(a) AS root FROM r GROUP BY 1, 2)
    SELECT vec_id, dense_rank() OVER (PARTITION BY vec_id ORDER BY root) AS label, round(sum(v * (pos % 8)) / sum(v), 6) AS x, round(sum(v * (pos // 8)) / sum(v), 6) AS y, round(sum(v), 6) AS A, count(*) AS area FROM l JOIN m USING (vec_id, pos) GROUP BY vec_id, root"""
)
def detect_spots(spark, sf_dir):
    return rounded(images.detect_spots(image_frames(spark, sf_dir), 0.1, ["vec_id"]), "x", "y", "A")


def box_sql(how: str) -> str:
    """A 3 x 3 box around each pixel with reflected edges."""
    near = "least(greatest({c} + {d}, 0), 7)"
    row, col = near.format(c="pos // 8", d="dy"), near.format(c="pos % 8", d="dx")
    return f"""WITH {PIXELS}, m AS (SELECT a.d AS dy, b.d AS dx FROM (SELECT unnest([-1, 0, 1]) AS d) a, (SELECT unnest([-1, 0, 1]) AS d) b)
    SELECT p.vec_id, p.pos, round({how}(q.v), 6) AS value FROM (SELECT vec_id, pos, {row} * 8 + {col} AS near FROM u, m) p JOIN u q ON q.vec_id = p.vec_id AND q.pos = p.near GROUP BY 1, 2"""


def filtered(spark, sf_dir, kernel) -> DataFrame:
    return rounded(exploded(images.frame_filter(image_frames(spark, sf_dir), kernel)), "value")


@query(box_sql("max"))
def image_max_filter(spark, sf_dir):
    return filtered(spark, sf_dir, kernels.neighbourhood(np.max))


@query(box_sql("min"))
def image_min_filter(spark, sf_dir):
    return filtered(spark, sf_dir, kernels.neighbourhood(np.min))


@query(box_sql("avg"))
def image_mean_filter(spark, sf_dir):
    return filtered(spark, sf_dir, kernels.neighbourhood(np.mean))


@query(box_sql("median"))
def image_median_filter(spark, sf_dir):
    return filtered(spark, sf_dir, kernels.neighbourhood(np.median))


@query(f"WITH {PIXELS}, {blur_sql(1.0, 'u', 'a')}, {blur_sql(2.0, 'u', 'b')} SELECT vec_id, pos, CASE WHEN round(a.v - b.v, 6) = 0 THEN 0e0 ELSE round(a.v - b.v, 6) END AS value FROM a JOIN b USING (vec_id, pos)")
def image_dog(spark, sf_dir):
    return filtered(spark, sf_dir, kernels.difference_of_gaussians(1.0, 2.0))


def disc_sql(how: str, source: str) -> str:
    """The least or greatest pixel of the five of a disc of radius 1, edges reflected."""
    return f"SELECT s.vec_id, s.pos, {how}(q.v) AS v FROM {source} s CROSS JOIN (VALUES (0, 0), (0, 1), (0, -1), (1, 0), (-1, 0)) o(dy, dx) JOIN {source} q ON q.vec_id = s.vec_id AND q.pos = {mirrored('s.pos // 8 + dy')} * 8 + {mirrored('s.pos % 8 + dx')} GROUP BY 1, 2"


@query(f"WITH {PIXELS}, e AS ({disc_sql('min', 'u')}), d AS ({disc_sql('max', 'e')}) SELECT vec_id, pos, round(u.v - d.v, 6) AS value FROM u JOIN d USING (vec_id, pos)")
def image_tophat(spark, sf_dir):
    return filtered(spark, sf_dir, kernels.white_tophat(1.0))


@query()
def image_otsu(spark, sf_dir):
    return filtered(spark, sf_dir, kernels.threshold_by(kernels.otsu_level))


@query(f"WITH {PIXELS} SELECT vec_id, pos, CASE WHEN pos // 8 BETWEEN 2 AND 5 AND pos % 8 BETWEEN 2 AND 5 THEN round(v, 6) ELSE 0 END AS value FROM u")
def image_mask_edges(spark, sf_dir):
    return filtered(spark, sf_dir, kernels.mask_edges(2))


@query(f"WITH {PIXELS} SELECT vec_id, CAST(63 - pos AS INTEGER) AS pos, v AS value FROM u")
def image_rotate180(spark, sf_dir):
    return exploded(images.rotate180(image_frames(spark, sf_dir)))


@query(
    f"""WITH {PIXELS} SELECT vec_id, round(sum(v) FILTER ((pos % 8 - 3) ** 2 + (pos // 8 - 4) ** 2 <= 4), 6) AS r2, round(sum(v) FILTER ((pos % 8 - 3) ** 2 + (pos // 8 - 4) ** 2 <= 9), 6) AS r3 FROM u GROUP BY 1"""
)
def intensity_at_points(spark, sf_dir):
    frames = image_frames(spark, sf_dir)
    points = frames.select("vec_id", F.lit(3.0).alias("x"), F.lit(4.0).alias("y"))
    return rounded(images.intensity_at_points(frames, points, ["vec_id"], [2, 3]).select("vec_id", "r2", "r3"), "r2", "r3")


@query(
    f"""WITH {PIXELS} SELECT vec_id, CAST(pos % 3 + 1 AS BIGINT) AS label, count(*) AS area, round(avg(pos % 8), 6) AS x, round(avg(pos // 8), 6) AS y, round(sum(v), 6) AS total, round(avg(v), 6) AS mean FROM u WHERE pos % 3 < 2 GROUP BY 1, 2"""
)
def region_measurements(spark, sf_dir):
    frames = image_frames(spark, sf_dir)
    ids = frames.withColumn("pixels", F.transform("pixels", lambda _, i: F.when(i % 3 < 2, i % 3 + 1).otherwise(0)))
    return rounded(images.regions(frames, ids, ["vec_id"]), "x", "y", "total", "mean")


@query(
    f"""WITH {PIXELS}, g AS (SELECT pos, avg(v) AS d, var_pop(v) AS s FROM u GROUP BY 1) SELECT pos, round(d, 6) AS dark, round(CASE WHEN d > 0.005 OR s > 0.02 THEN 1 ELSE s END, 6) AS variance FROM g"""
)
def dark_variance_map(spark, sf_dir):
    return rounded(aggregates.dark_and_variance(table(spark, sf_dir, "embeddings"), "embedding", 0.005, 0.02, 1.0), "dark", "variance")


@query(f"WITH {PIXELS} SELECT CAST(label AS DOUBLE) / 4 AS z, pos, round(avg(v), 6) AS value FROM u GROUP BY 1, 2")
def average_by_step(spark, sf_dir):
    return rounded(aggregates.average_by_step(table(spark, sf_dir, "embeddings"), F.col("label") / 4.0, "embedding"), "value")


@query(
    f"""WITH {PIXELS} SELECT vec_id, l AS level, CAST((pos % 8) // (1 << l) AS BIGINT) AS tx, CAST((pos // 8) // (1 << l) AS BIGINT) AS ty, round(avg(v), 6) AS value
    FROM u, (SELECT CAST(unnest(range(0, 4)) AS INTEGER) AS l) GROUP BY 1, 2, 3, 4"""
)
def tile_pyramid(spark, sf_dir):
    each = exploded(image_frames(spark, sf_dir))
    pixels = each.select("vec_id", (F.col("pos") % 8).alias("x"), F.floor(F.col("pos") / 8).alias("y"), F.col("value").alias("v"))
    return rounded(aggregates.tile_pyramid(pixels, 3, ["vec_id"]), "value")


@query(
    f"""WITH {EVENTS}, d AS (SELECT user_id, CAST(t AS DOUBLE) AS t, avg(value) AS v FROM e GROUP BY 1, 2), n AS (SELECT *, min(t) OVER (PARTITION BY user_id) AS z, lead(t) OVER w AS nt, lead(v) OVER w AS nv FROM d WINDOW w AS (PARTITION BY user_id ORDER BY t)),
    g AS (SELECT *, unnest(range(CAST(ceil((t - z) / 500) AS BIGINT), CAST(ceil((nt - z) / 500) AS BIGINT))) AS k FROM n WHERE nt IS NOT NULL)
    SELECT user_id, k, z + k * 500 AS t, round(v + (z + k * 500 - t) / (nt - t) * (nv - v), 9) AS v FROM g"""
)
def resample_linear(spark, sf_dir):
    e = frames_of(spark, sf_dir).groupBy("user_id", F.col("t").cast("double").alias("t")).agg(F.avg("value").alias("v"))
    return rounded(windows.resample(e, "user_id", "t", "v", 500.0), "v", places=9)


@query()
def drift_shifts(spark, sf_dir):
    e = frames_of(spark, sf_dir).withColumns({"x": F.col("user_id").cast("double"), "y": F.col("value")})
    return spatial.drift(e, "t", "x", "y", 4000, 10000)


@query(f"WITH {POINTS} SELECT vec_id FROM p WHERE sqrt(x * x + y * y + z * z) <= 0.3 AND z >= sqrt(x * x + y * y + z * z) * cos(0.8)")
def points_in_cone(spark, sf_dir):
    p = points_of(spark, sf_dir)
    return p.where(spatial.in_cone(F.col("x"), F.col("y"), F.col("z"), 0.0, 0.0, 0.8, 0.3)).select("vec_id")


# --- kinetics, joint statistics, fiducials --------------------------------------------------------------------------
@query("SELECT l_returnflag, round(count(*) FILTER (l_quantity > 25 AND l_extendedprice > 30000) / count(*) FILTER (l_quantity > 25), 9) AS fraction_a, round(count(*) FILTER (l_quantity > 25 AND l_extendedprice > 30000) / count(*) FILTER (l_extendedprice > 30000), 9) AS fraction_b FROM lineitem GROUP BY 1")
def area_fractions(spark, sf_dir):
    out = kinetics.area_fractions(table(spark, sf_dir, "lineitem"), F.col("l_quantity"), F.col("l_extendedprice"), 25.0, 30000.0, ["l_returnflag"])
    return rounded(out, "fraction_a", "fraction_b", places=9)


@query("WITH c AS (SELECT event_type, user_id, count(*) AS frames FROM events GROUP BY 1, 2) SELECT event_type, frames, count(*) AS n FROM c WHERE frames <= 19 GROUP BY 1, 2")
def on_times(spark, sf_dir):
    return kinetics.on_times(table(spark, sf_dir, "events"), "user_id", 19, ["event_type"])


@query(
    """WITH m AS (SELECT event_type, avg(value) * 6 / 99 AS width FROM events GROUP BY 1)
    SELECT event_type, CAST(floor(value / width) AS INTEGER) AS bin, count(*) AS n, round(any_value(width), 6) AS width FROM events JOIN m USING (event_type) WHERE floor(value / width) BETWEEN 0 AND 98 GROUP BY 1, 2"""
)
def brightness_histogram(spark, sf_dir):
    return rounded(kinetics.brightness_histogram(table(spark, sf_dir, "events"), "value", ["event_type"]), "width")


DECAYS = f"""{EVENTS}, m AS (SELECT event_type, min(t) AS low, (max(t) - min(t)) / 100 AS step FROM e GROUP BY 1),
    h AS (SELECT event_type, CAST(least(floor((t - low) / step), 99) AS INTEGER) AS bin, count(*) AS n, any_value(low) AS low, any_value(step) AS step FROM e JOIN m USING (event_type) GROUP BY 1, 2)"""


@query(f"WITH {DECAYS} SELECT event_type, bin, round(low + (bin + 0.5) * step, 6) AS at, n FROM h")
def decay_histogram(spark, sf_dir):
    return rounded(kinetics.decay_histogram(frames_of(spark, sf_dir), "t", ["event_type"]), "at")


@query()
def decay_fits(spark, sf_dir):
    return kinetics.fit_decays(kinetics.decay_histogram(frames_of(spark, sf_dir), "t", ["event_type"]), ["event_type"])


@query()
def off_time_fits(spark, sf_dir):
    """Blinking of each user's events; known times are found in the tests."""
    return rounded(kinetics.fit_off_times(windows.offtime_cdf(frames_of(spark, sf_dir), "user_id", "t"), "user_id"), "off_time", "residual", places=3)


@query(
    f"""WITH {POINTS}, d AS (SELECT {DIST} AS r, b.x - a.x AS dx, b.y - a.y AS dy, b.z - a.z AS dz FROM p a JOIN p b ON a.vec_id < b.vec_id WHERE {DIST} < 0.2),
    q AS (SELECT r, coalesce(CASE WHEN dx <> 0 THEN atan(dy / dx) END, sign(dy) * pi() / 2) + pi() / 2 AS theta, coalesce(CASE WHEN dx <> 0 OR dy <> 0 THEN atan(dz / sqrt(dx * dx + dy * dy)) END, sign(dz) * pi() / 2) + pi() / 2 AS phi FROM d)
    SELECT CAST(floor(r / 0.05) AS INTEGER) AS r_bin, CAST(least(floor(theta * 8 / pi()), 7) AS INTEGER) AS theta_bin, CAST(least(floor(phi * 8 / pi()), 7) AS INTEGER) AS phi_bin, count(*) AS n FROM q GROUP BY 1, 2, 3"""
)
def vector_pair_histogram(spark, sf_dir):
    return kinetics.vector_pair_histogram(points_of(spark, sf_dir), 4, 0.05, 8, "vec_id")


@query(
    f"""WITH {POINTS}, h AS (SELECT CAST(floor({DIST} / 0.01) AS INTEGER) AS bin, count(*) AS n FROM p a JOIN p b ON a.vec_id < b.vec_id WHERE {DIST} < 0.2 GROUP BY 1),
    k AS (SELECT i, 1.0 / (SELECT count(*) * count(*) FROM p) * 2 * sum(coalesce(n, 0)) OVER (ORDER BY i) AS k FROM range(0, 20) r(i) LEFT JOIN h ON bin = i),
    l AS (SELECT i, cbrt(k * 3 / (4 * pi())) AS l FROM k), d AS (SELECT i, (lead(l) OVER (ORDER BY i) - lag(l) OVER (ORDER BY i)) / 2 AS d FROM l)
    SELECT CAST(i AS INTEGER) AS bin, round(d / 0.01, 6) AS "dL", round(d / 0.01 - 1, 6) AS "dH" FROM d WHERE d IS NOT NULL"""
)
def ripley_differences(spark, sf_dir):
    """Both are per unit of distance."""
    curve = spatial.ripley(points_of(spark, sf_dir), AXES, 20, 0.01, "vec_id", 1.0)
    slope = F.col("dL") / 0.01
    return rounded(kinetics.central_difference(curve, "bin", "L", "dL").select("bin", slope.alias("dL"), (slope - 1).alias("dH")), "dL", "dH")


@query(f"WITH {EVENTS} SELECT event_id, round(CASE WHEN t > 0 THEN least(t, 5000) * 5e-1 ELSE 0 END + CASE WHEN t > 5000 THEN least(t - 5000, 10000) * -25e-2 ELSE 0 END + CASE WHEN t > 15000 THEN (t - 15000) * 125e-3 ELSE 0 END, 6) AS shift FROM e")
def piecewise_drift(spark, sf_dir):
    shift = kinetics.piecewise_linear(F.col("t"), (0.0, 5000.0, 15000.0), (0.5, -0.25, 0.125))
    return rounded(frames_of(spark, sf_dir).select("event_id", shift.alias("shift")), "shift")


@query(
    f"""WITH {PIXELS}, l AS (SELECT vec_id, pos, v, lag(v) OVER (PARTITION BY label, pos ORDER BY vec_id) AS was FROM u)
    SELECT vec_id, CAST(count(*) FILTER (v > 0.05 AND abs(v - was) < 0.1) AS INTEGER) AS active FROM l GROUP BY 1"""
)
def wavefront_activity(spark, sf_dir):
    return kinetics.wavefronts(image_frames(spark, sf_dir), "label", "vec_id", "pixels", 0.05, 0.1).select("vec_id", "active")


@query(
    f"""WITH {EVENTS}, c AS (SELECT event_type, user_id, avg(value) AS v FROM e GROUP BY 1, 2 HAVING count(*) >= 3),
    m AS (SELECT e.event_type, t, avg(value - v) AS v FROM e JOIN c USING (event_type, user_id) GROUP BY 1, 2),
    s AS (SELECT event_type, t, avg(v) OVER (PARTITION BY event_type ORDER BY t RANGE BETWEEN 500 PRECEDING AND 500 FOLLOWING) AS d FROM m),
    b AS (SELECT e.event_id, e.value, e.t, (SELECT max(s.t) FROM s WHERE s.event_type = e.event_type AND s.t <= e.t) AS lo, (SELECT min(s.t) FROM s WHERE s.event_type = e.event_type AND s.t >= e.t) AS hi, event_type FROM e)
    SELECT event_id, round(value - coalesce(p.d + CASE WHEN hi <> lo THEN (b.t - lo) / (hi - lo) ELSE 0 END * (n.d - p.d), p.d, n.d, 0), 6) AS value
    FROM b LEFT JOIN s p ON p.event_type = b.event_type AND p.t = lo LEFT JOIN s n ON n.event_type = b.event_type AND n.t = hi"""
)
def fiducial_corrected(spark, sf_dir):
    e = frames_of(spark, sf_dir)
    moved = kinetics.fiducial_trajectory(e, "event_type", "user_id", "t", ["value"], 3, 500)
    return rounded(kinetics.fiducial_correction(e, moved, "event_type", "t", ["value"], 5000).select("event_id", "value"), "value")

# --- vectors, rendering in depth, region statistics, localisation ----------------------------------------------------
@query(f"""WITH {POINTS} SELECT vec_id, round(atan2(y, x), 9) AS azimuth, round(atan2(sqrt(x * x + y * y), z), 9) AS zenith, round(sqrt(x * x + y * y + z * z), 9) AS r FROM p""")
def spherical_coordinates(spark, sf_dir):
    at = vectors.cartesian_to_spherical(*map(F.col, AXES))
    return rounded(points_of(spark, sf_dir).select("vec_id", *(v.alias(n) for n, v in at.items())), *at, places=9)


@query(f"""WITH {POINTS} SELECT vec_id, round((1 + abs(z)) * sin(y) * cos(x), 9) AS x, round((1 + abs(z)) * sin(y) * sin(x), 9) AS y, round((1 + abs(z)) * cos(y), 9) AS z FROM p""")
def cartesian_coordinates(spark, sf_dir):
    at = vectors.spherical_to_cartesian(F.col("x"), F.col("y"), 1 + F.abs("z"))
    return rounded(points_of(spark, sf_dir).select("vec_id", *(v.alias(n) for n, v in at.items())), *at, places=9)


@query(f"""WITH {POINTS} SELECT vec_id, round(2 * y, 9) AS a, round(0.5 * x, 9) AS b, round(-3 * z, 9) AS c FROM p""")
def scaled_axes(spark, sf_dir):
    at = vectors.scaled_projection(*map(F.col, AXES), (2.0, 0.5, 3.0), ((0, 1, 0), (1, 0, 0), (0, 0, -1)))
    return rounded(points_of(spark, sf_dir).select("vec_id", *(v.alias(n) for n, v in zip("abc", at, strict=True))), *"abc", places=9)


@query(
    f"""SELECT l_orderkey, l_linenumber, round(1.38e-23 * 293 / (6e-3 * (l_quantity * 1e-9)) * 1e12, 9) AS diffusion, round(l_quantity / (2 * 4.0 * 2.0) * exp(-l_quantity * l_quantity / (4 * 4.0 * 2.0)), 12) AS jump,
    round(4 * 0.5 * pow(l_quantity, 0.8), 9) AS msd FROM lineitem"""
)
def diffusion_scalars(spark, sf_dir):
    q = F.col("l_quantity").cast("double")
    outs = {"diffusion": vectors.stokes_einstein(q * 1e-9) * 1e12, "jump": vectors.jump_probability(q, F.lit(4.0), F.lit(2.0)), "msd": vectors.anomalous_msd(q, 0.5, 0.8)}
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *(v.alias(n) for n, v in outs.items()))
    return rounded(rounded(df, "diffusion", "msd", places=9), "jump", places=12)


FIELD = f"WITH {PIXELS}, f AS (SELECT vec_id, CAST(pos AS INTEGER) AS pos, v AS a, lead(v, 32) OVER w AS b FROM u WINDOW w AS (PARTITION BY vec_id ORDER BY pos))"


@query(FIELD + " SELECT vec_id, pos, round(sqrt(a * a + b * b), 9) AS norm, round(atan2(b, a), 9) AS theta FROM f WHERE pos < 32")
def vector_norm_angle(spark, sf_dir):
    frames = image_frames(spark, sf_dir).select("vec_id", F.slice("pixels", 1, 32).alias("a"), F.slice("pixels", 33, 32).alias("b"))
    out = frames.select("vec_id", vectors.norm(F.col("a"), F.col("b")).alias("norm"), vectors.angles(F.col("a"), F.col("b"))["theta"].alias("theta"))
    each = out.select("vec_id", F.posexplode(F.arrays_zip("norm", "theta")).alias("pos", "v")).select("vec_id", "pos", "v.norm", "v.theta")
    return rounded(each, "norm", "theta", places=9)


@query(FIELD + " SELECT vec_id, pos, round((a * 3 + b * 4) / 5, 9) AS parallel, round((b * 3 - a * 4) / 5, 9) AS perpendicular FROM f WHERE pos < 32")
def vector_projection(spark, sf_dir):
    frames = image_frames(spark, sf_dir).select("vec_id", F.slice("pixels", 1, 32).alias("a"), F.slice("pixels", 33, 32).alias("b"))
    along_x, along_y = F.transform("a", lambda _: F.lit(3.0)), F.transform("a", lambda _: F.lit(4.0))
    out = vectors.project_on(F.col("a"), F.col("b"), along_x, along_y)
    each = frames.select("vec_id", F.posexplode(F.arrays_zip(*(v.alias(n) for n, v in out.items()))).alias("pos", "v"))
    return rounded(each.select("vec_id", "pos", "v.parallel", "v.perpendicular"), "parallel", "perpendicular", places=9)


@query(
    f"""WITH {PIXELS}, n AS (SELECT vec_id, pos, v, lag(v) OVER r AS l, lead(v) OVER r AS g, lag(v) OVER c AS u, lead(v) OVER c AS d FROM u
      WINDOW r AS (PARTITION BY vec_id, pos // 8 ORDER BY pos), c AS (PARTITION BY vec_id, pos % 8 ORDER BY pos))
    SELECT vec_id, pos, round(CASE WHEN l IS NULL THEN g - v WHEN g IS NULL THEN v - l ELSE (g - l) / 2 END, 9) AS across, round(CASE WHEN u IS NULL THEN d - v WHEN d IS NULL THEN v - u ELSE (d - u) / 2 END, 9) AS down FROM n"""
)
def image_gradient(spark, sf_dir):
    frames = image_frames(spark, sf_dir).select("vec_id", vectors.gradient(F.col("pixels"), 8).alias("across"), vectors.gradient(F.col("pixels"), 8, False).alias("down"))
    each = frames.select("vec_id", F.posexplode(F.arrays_zip("across", "down")).alias("pos", "v")).select("vec_id", "pos", "v.across", "v.down")
    return rounded(each, "across", "down", places=9)


@query(f"WITH {PIXELS} SELECT vec_id, round(sum(v), 6) AS checksum FROM u GROUP BY 1")
def frame_checksums(spark, sf_dir):
    return rounded(localise.checksums(image_frames(spark, sf_dir), ["vec_id"]), "checksum")


@query(f"WITH {POINTS} SELECT CAST(floor((x + 1) / 0.1) AS INTEGER) AS ix, CAST(floor((y + 1) / 0.1) AS INTEGER) AS iy, CAST(floor((z + 1) / 0.25) AS INTEGER) AS iz, count(*) AS n FROM p GROUP BY 1, 2, 3")
def render_hist3d(spark, sf_dir):
    return spatial.render_histogram_3d(points_of(spark, sf_dir), [F.col(c) for c in AXES], (-1, -1, -1), 0.1, 0.25)


@query(
    f"""WITH {POINTS}, s AS (SELECT *, unnest(range(CAST(floor((x - 4 * 0.04 + 1) / 0.1) AS BIGINT), CAST(floor((x + 4 * 0.04 + 1) / 0.1) AS BIGINT) + 1)) AS ix FROM p),
    t AS (SELECT *, unnest(range(CAST(floor((y - 4 * 0.04 + 1) / 0.1) AS BIGINT), CAST(floor((y + 4 * 0.04 + 1) / 0.1) AS BIGINT) + 1)) AS iy FROM s),
    v AS (SELECT *, unnest(range(CAST(floor((z - 4 * 0.08 + 1) / 0.25) AS BIGINT), CAST(floor((z + 4 * 0.08 + 1) / 0.25) AS BIGINT) + 1)) AS iz FROM t)
    SELECT CAST(ix AS INTEGER) AS ix, CAST(iy AS INTEGER) AS iy, CAST(iz AS INTEGER) AS iz, round(sum(exp(-(pow((ix + 0.5) * 0.1 - 1 - x, 2) + pow((iy + 0.5) * 0.1 - 1 - y, 2)) / (2 * 0.04 * 0.04) - pow((iz + 0.5) * 0.25 - 1 - z, 2) / (2 * 0.08 * 0.08))
      / (2 * pi() * 0.04 * 0.04 * sqrt(2 * pi()) * 0.08) * 0.1 * 0.1 * 0.25), 6) AS value FROM v GROUP BY 1, 2, 3"""
)
def render_gauss3d(spark, sf_dir):
    p = points_of(spark, sf_dir).withColumns({"s": F.lit(0.04), "sz": F.lit(0.08)})
    return rounded(spatial.render_gaussian_3d(p, AXES, "s", "sz", (-1, -1, -1), 0.1, 0.25), "value")


@query(f"""WITH {POINTS}, m AS (SELECT label, median(x) AS mx, median(y) AS my, median(z) AS mz FROM p GROUP BY 1) SELECT label, round(median(sqrt((x - mx) ** 2 + (y - my) ** 2 + (z - mz) ** 2)), 9) AS median_abs_deviation FROM p JOIN m USING (label) GROUP BY 1""")
def cluster_median_deviation(spark, sf_dir):
    _shared(spark)
    return rounded(aggregates.median_deviation(points_of(spark, sf_dir), "label", AXES), "median_abs_deviation", places=9)


@query("SELECT l_extendedprice AS bins, round((row_number() OVER (ORDER BY l_extendedprice) - 1) / ((SELECT count(*) FROM lineitem) - 1), 9) AS counts FROM lineitem")
def cumulative_histogram(spark, sf_dir):
    _shared(spark)
    return rounded(aggregates.cumulative_histogram(table(spark, sf_dir, "lineitem"), "l_extendedprice"), "counts", places=9)


@query(
    f"""WITH {POINTS}, d AS (SELECT a.vec_id, CAST(floor({DIST} / 0.02) AS INTEGER) AS b, count(*) AS n FROM p a JOIN p b ON {DIST} < 0.1 GROUP BY 1, 2)
    SELECT vec_id, CAST(k AS INTEGER) AS ring, coalesce(n, 0) AS n FROM (SELECT vec_id, unnest(range(0, 5)) AS k FROM p) LEFT JOIN d USING (vec_id) WHERE d.b = k OR d.b IS NULL"""
    .replace("LEFT JOIN d USING (vec_id) WHERE d.b = k OR d.b IS NULL", "q LEFT JOIN d ON d.vec_id = q.vec_id AND d.b = k").replace("SELECT vec_id, CAST(k", "SELECT q.vec_id, CAST(k")
)
def distance_features(spark, sf_dir):
    found = spatial.distance_features(points_of(spark, sf_dir), AXES, 5, 0.02, "vec_id")
    return found.select("vec_id", F.posexplode("features").alias("ring", "v")).select("vec_id", "ring", F.col("v").cast("long").alias("n"))


#: Corners of a region, and points of it 0.05 apart.
BOX = "m AS (SELECT i * 5e-2 - 5e-1 AS x, j * 5e-2 - 5e-1 AS y FROM range(0, 20) a(i), range(0, 20) b(j))"
FLAT = "sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)"


@query(
    f"""WITH {POINTS}, {BOX}, q AS (SELECT vec_id, x, y FROM p WHERE abs(x) < 0.5 AND abs(y) < 0.5), k AS (SELECT CAST(i AS INTEGER) AS bin FROM range(0, 5) r(i)),
    d AS (SELECT a.vec_id, CAST(floor({FLAT} / 0.04) AS INTEGER) AS bin, count(*) AS d FROM q a JOIN q b ON {FLAT} < 0.2 GROUP BY 1, 2), w AS (SELECT a.vec_id, CAST(floor({FLAT} / 0.04) AS INTEGER) AS bin, count(*) AS w FROM q a JOIN m b ON {FLAT} < 0.2 GROUP BY 1, 2),
    h AS (SELECT bin, sum((2 * bin + 1) * pi() * 0.04 * 0.04 / 0.0025 * d / w) AS h FROM d JOIN w USING (vec_id, bin) GROUP BY 1)
    SELECT bin, round((bin + 1) * 0.04, 9) AS r, round(1.0 / (SELECT count(*) * count(*) FROM q) * sum(coalesce(h, 0)) OVER (ORDER BY bin), 9) AS "K" FROM k LEFT JOIN h USING (bin)"""
)
def ripley_masked(spark, sf_dir):
    p = points_of(spark, sf_dir).where((F.abs("x") < 0.5) & (F.abs("y") < 0.5)).select("vec_id", "x", "y")
    mask = spatial.box_mask(spark, (-0.5, -0.5), (0.5, 0.5), 0.05, ("x", "y"))
    return rounded(spatial.masked_ripley(p, mask, ("x", "y"), 5, 0.04, "vec_id", 1.0, 0.0025), "r", "K", places=9)


def cameras_of(frames: DataFrame, electrons_per_count: float, noise_factor: float = 1.0, em_gain: float = 1.0) -> DataFrame:
    """A camera for each label: its dark and variance maps from the label's own frames, an uneven flat map."""
    maps = camera.maps_from_dark_frames(frames, "label", 8, 8, electrons_per_count=electrons_per_count)
    return maps.withColumns({"flat": F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: 1 + i / 128.0), "noise_factor": F.lit(noise_factor), "em_gain": F.lit(em_gain)})


@query(
    f"""WITH {PIXELS}, m AS (SELECT label, pos, avg(v) AS d, var_pop(v) * 0.25 AS s FROM u GROUP BY 1, 2),
    c AS (SELECT vec_id, u.pos, s, (v - d) * (1 + u.pos / 128e0) AS c FROM u JOIN m ON m.label = u.label AND m.pos = u.pos)
    SELECT vec_id, CAST((pos // 8 - 2) * 7 + pos % 8 - 1 AS INTEGER) AS pos, round(c, 6) AS value, round(sqrt(s + 1.96 * (0.5 * 2 * greatest(c, 1) + 4)) / 0.5, 6) AS sigma FROM c WHERE pos // 8 >= 2 AND pos % 8 >= 1"""
)
def camera_corrected(spark, sf_dir):
    """Regions of frames, corrected by their part of the chip's maps, with the noise of each pixel."""
    frames = image_frames(spark, sf_dir)
    regions = images.crop(frames, (2, -1), (1, -1)).withColumns({"camera": F.col("label"), "roi_x": F.lit(1), "roi_y": F.lit(2)})
    out = camera.correct(regions, cameras_of(frames, 0.5, 1.4, 2.0))
    return rounded(out.select("vec_id", F.posexplode(F.arrays_zip("pixels", "sigma")).alias("pos", "p")).select("vec_id", "pos", F.col("p.pixels").alias("value"), F.col("p.sigma").alias("sigma")), "value", "sigma")


@query()
def localise_gaussian(spark, sf_dir):
    """Spots of the frames and their Gaussian fits, weighed by the maps of the frames' cameras; tested on drawn spots."""
    frames = image_frames(spark, sf_dir).withColumns({"camera": F.col("label"), "roi_x": F.lit(0), "roi_y": F.lit(0)})
    out = localise.localise(camera.correct(frames, cameras_of(frames, 1000.0)), ["vec_id"], half=2, sigma=1.0, snr=0.5, apart=3)
    return rounded(out.select("vec_id", "x0", "y0", "sigma", "A", "settled"), "x0", "y0", "sigma", "A", places=3)


@query()
def multi_emitters(spark, sf_dir):
    """Regions of the frames, each fitted by as many Gaussians as it calls for; tested on drawn emitters."""
    frames = images.pixel_map(image_frames(spark, sf_dir), lambda p: (p + 0.5) * 200)
    out = emitters.fit_regions(frames, ["vec_id"], sigma=1.0, snr=2.0, most=3, margin=2)
    return rounded(out.select("vec_id", "region", "emitter", "n_emitters", "x", "y", "A", "sigma"), "x", "y", "A", "sigma", places=3)


@query()
def detect_points(spark, sf_dir):
    """Places of point-like objects in the frames, held against a plain model in the tests."""
    return rounded(localise.detect_points(image_frames(spark, sf_dir), ["vec_id"], 0.05, snr=False, radius=2, edge=1), "x", "y")


@query(
    f"""WITH {EVENTS}, s AS (SELECT user_id, t, event_id, value, coalesce(sqrt((value - lag(value) OVER w) ** 2), 0) AS step FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t * 1000000 + event_id)),
    a AS (SELECT user_id, count(*) AS n, min(t * 1000000 + event_id) AS start, max(t * 1000000 + event_id) AS stop, sum(step) AS path, arg_min(value, t * 1000000 + event_id) AS v0, arg_max(value, t * 1000000 + event_id) AS v1 FROM s GROUP BY 1)
    SELECT user_id, n, start, stop, round(path, 4) AS path, round(abs(v1 - v0), 6) AS displacement FROM a"""
)
def extract_tracks(spark, sf_dir):
    e = frames_of(spark, sf_dir).withColumn("at", F.col("t") * 1_000_000 + F.col("event_id"))
    out = windows.tracks(e, "user_id", "at", ["value"])
    return rounded(rounded(out, "path", places=4), "displacement").select("user_id", "n", "start", "stop", "path", "displacement")


@query(
    f"""WITH {EVENTS}, s AS (SELECT abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY t * 1000000 + event_id)) AS d FROM e)
    SELECT CAST(floor(d / 0.5) AS BIGINT) AS bin, count(*) AS n FROM s WHERE d IS NOT NULL GROUP BY 1"""
)
def jump_histogram(spark, sf_dir):
    e = frames_of(spark, sf_dir).withColumn("at", F.col("t") * 1_000_000 + F.col("event_id"))
    return windows.jump_histogram(e, "user_id", "at", ["value"], 0.5)


@query(f"WITH {PIXELS} SELECT vec_id, pos, round((v + 2) / avg(v + 2) OVER (PARTITION BY vec_id), 6) AS value FROM u")
def image_normalise_mean(spark, sf_dir):
    return rounded(exploded(images.normalise_mean(image_frames(spark, sf_dir), -2.0)), "value")


@query(f"WITH {PIXELS} SELECT vec_id, pos, round(least(greatest(pow(v, 2) * 3 - 0.01, 0), 0.05), 9) AS value FROM u")
def image_arithmetic(spark, sf_dir):
    steps = "- Pow: {inputName: a, power: 2, outputName: b}\n- Scale: {inputName: b, scale: 3, outputName: c}\n- Offset: {inputName: c, offset: -0.01, outputName: d}\n- Clip: {inputName: d, min: 0, max: 0.05, outputName: out}"
    return rounded(exploded(Recipe.from_yaml(steps).execute({"a": image_frames(spark, sf_dir)})["out"]), "value", places=9)


@query(f"WITH {PIXELS} SELECT a.vec_id, a.pos, CASE WHEN abs(a.v - b.v) <= 0.01 + 0.1 * abs(b.v) THEN 1e0 ELSE 0e0 END AS value FROM u a JOIN u b ON b.vec_id = a.vec_id AND b.pos = 63 - a.pos")
def image_is_close(spark, sf_dir):
    a = image_frames(spark, sf_dir).withColumn("series", F.col("vec_id"))
    out = Recipe.from_yaml("- IsClose: {inputName0: a, inputName1: b, abs_tolerance: 0.01, rel_tolerance: 0.1, outputName: out}").execute({"a": a, "b": images.rotate180(a)})["out"]
    return exploded(out)


@query(
    f"""WITH {POINTS}, k AS (SELECT a.vec_id, b.vec_id AS other, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) AS d FROM p a JOIN p b ON b.label = 1 AND a.label = 0),
    o AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, other) AS r FROM k) SELECT vec_id, CAST(r AS INTEGER) AS place, other AS neighbour, round(d, 6) AS distance FROM o WHERE r <= 5"""
)
def nearest_five(spark, sf_dir):
    p = points_of(spark, sf_dir)
    near = spatial.nearest_k(p.where("label = 0"), p.where("label = 1"), AXES, 5, 0.02, "vec_id", "vec_id")
    each = near.select("vec_id", F.posexplode("near").alias("place", "n"))
    return rounded(each.select("vec_id", (F.col("place") + 1).alias("place"), F.col("n.neighbour").alias("neighbour"), F.col("n.distance").alias("distance")), "distance")


@query(
    f"""WITH {POINTS}, k AS (SELECT a.vec_id, a.x AS ax, a.y AS ay, a.z AS az, b.x, b.y, b.z, row_number() OVER (PARTITION BY a.vec_id ORDER BY sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2), b.vec_id) AS r FROM p a JOIN p b ON b.label = 3 AND a.label = 2),
    m AS (SELECT vec_id, avg(x) - any_value(ax) AS dx, avg(y) - any_value(ay) AS dy, avg(z) - any_value(az) AS dz FROM k WHERE r <= 4 GROUP BY 1), l AS (SELECT *, sqrt(dx * dx + dy * dy + dz * dz) AS r FROM m)
    SELECT vec_id, round(atan2(dy, dx), 6) AS azimuth, round(acos(dz / r), 6) AS zenith, round(r, 6) AS r, round(dx / r, 6) AS ux, round(dy / r, 6) AS uy, round(dz / r, 6) AS uz FROM l"""
)
def direction_to_nearest(spark, sf_dir):
    p = points_of(spark, sf_dir)
    return rounded(spatial.direction_to_nearest(p.where("label = 2"), p.where("label = 3"), AXES, 4, 0.05, "vec_id", "vec_id"), "azimuth", "zenith", "r", "ux", "uy", "uz")


@query(
    f"""WITH {POINTS}, g AS (SELECT CAST(i % 20 AS INTEGER) AS ix, CAST(i // 20 AS INTEGER) AS iy FROM (SELECT unnest(range(0, 400)) AS i)),
    k AS (SELECT ix, iy, (x - ((ix + 0.5) * 0.05 - 0.5)) ** 2 + (y - ((iy + 0.5) * 0.05 - 0.5)) ** 2 AS d, row_number() OVER (PARTITION BY ix, iy ORDER BY d, vec_id) - 1 AS r FROM p, g)
    SELECT ix, iy, round(sum(d * r) / sum(d * d), 3) AS value FROM k WHERE r < 10 GROUP BY 1, 2"""
)
def render_density(spark, sf_dir):
    return rounded(spatial.render_density(points_of(spark, sf_dir), "x", "y", "vec_id", -0.5, -0.5, 0.05, 20, 20), "value", places=3)


@query(
    f"""WITH {POINTS}, g AS (SELECT CAST(i % 30 AS INTEGER) AS ix, CAST(i // 30 AS INTEGER) AS iy FROM (SELECT unnest(range(0, 900)) AS i)),
    s AS (SELECT x, y, greatest(0.02 + abs(z) / 10, 0.03) AS s FROM p), f AS (SELECT ln(0.0001) AS f)
    SELECT ix, iy, round((SELECT count(*) * ln(0.0001) FROM p) + coalesce(sum(greatest(-ln(s * sqrt(2 * pi())) - ((ix * 0.03 - 0.45 - x) ** 2 + (iy * 0.03 - 0.45 - y) ** 2) / (2 * s * s), f) - f)
      FILTER (WHERE abs(round_even((x + 0.45) / 0.03, 0) - ix) <= 4 AND abs(round_even((y + 0.45) / 0.03, 0) - iy) <= 4), 0), 5) AS value FROM g, s, f GROUP BY 1, 2"""
)
def render_likelihood(spark, sf_dir):
    points = points_of(spark, sf_dir).withColumn("s", 0.02 + F.abs("z") / 10)
    return rounded(spatial.render_likelihood(points, "x", "y", "s", -0.45, -0.45, 0.03, 30, 30, reach=4), "value", places=5)


#: Widths of an astigmatic lens along x and y by depth: exact parabolas, so that a spline through them is they.
WIDTHS = {"sigmax": (150.0, 0.1, 3e-4), "sigmay": (150.0, -0.1, 3e-4)}


@query(
    f"""WITH {POINTS}, t AS (SELECT vec_id, 150 + 0.1 * (x * 400) + 3e-4 * (x * 400) ** 2 + 8 * y AS sx, 150 - 0.1 * (x * 400) + 3e-4 * (x * 400) ** 2 + 8 * z AS sy, 4 + 3 * abs(y) AS ex, 5 + 2 * abs(z) AS ey FROM p),
    d AS (SELECT CAST(unnest(range(-390, 390)) AS DOUBLE) AS d), c AS (SELECT vec_id, d, ((sx - (150 + 0.1 * d + 3e-4 * d * d)) ** 2 / ex ** 2 + (sy - (150 - 0.1 * d + 3e-4 * d * d)) ** 2 / ey ** 2) / (1 / ex ** 2 + 1 / ey ** 2) AS c FROM t, d)
    SELECT vec_id, 0 - arg_min(d, c) AS astigmatic_z, round(sqrt(min(c)), 5) AS error, 0 - arg_min(d, c) AS z FROM c GROUP BY 1"""
)
def map_astigmatic_z(spark, sf_dir):
    wide = lambda z, c: c[0] + c[1] * z + c[2] * z * z
    depth = F.col("x") * 400
    points = points_of(spark, sf_dir).select("vec_id", (wide(depth, WIDTHS["sigmax"]) + 8 * F.col("y")).alias("sigmax"), (wide(depth, WIDTHS["sigmay"]) + 8 * F.col("z")).alias("sigmay"), (4 + 3 * F.abs("y")).alias("error_sigmax"), (5 + 2 * F.abs("z")).alias("error_sigmay"))
    lens = spark.range(-40, 41).select(F.lit(0).alias("channel"), (F.col("id") * 10.0).alias("z"), *(wide(F.col("id") * 10.0, c).alias(n) for n, c in WIDTHS.items()), F.lit(-390.0).alias("z_low"), F.lit(390.0).alias("z_high"))
    out = astigmatism.map_astigmatic_z(points, lens)
    return rounded(out.select("vec_id", "astigmatic_z", F.col("astigmatic_z_lookup_error").alias("error"), "z"), "error", places=5)


@query()
def surface_patches(spark, sf_dir):
    """Quadratic patches around the points; curvatures of known surfaces are found in the tests."""
    _shared(spark)
    found = surfaces.aligned_patches(surfaces.fit_patches(points_of(spark, sf_dir), 0.2, "vec_id"), 0.2, "vec_id", 0.3)
    return rounded(found.select("vec_id", "n", "curvature1", "curvature2", "residual"), "curvature1", "curvature2", "residual", places=4)


#: Events of a focus drive: targets, landings and offsets, told by kind.
FOCUS_SQL = f"""{EVENTS}, k AS (SELECT user_id % 50 AS drive, t * 1000000 + event_id AS tm, event_type AS kind, value AS v, event_id FROM e),
    o AS (SELECT drive, tm, v AS off FROM k WHERE kind = 'error'), f AS (SELECT drive, arg_min(off, tm) AS first FROM o GROUP BY 1),
    l AS (SELECT drive, tm, max(v) - coalesce(arg_max(off, otm), any_value(first), 0) AS focus FROM (SELECT k.drive, k.tm, v, off, o.tm AS otm, first FROM k LEFT JOIN o ON o.drive = k.drive AND o.tm <= k.tm LEFT JOIN f ON f.drive = k.drive WHERE kind = 'purchase') GROUP BY 1, 2),
    x AS (SELECT drive, tm, v AS focus FROM k WHERE kind = 'view' UNION ALL SELECT * FROM l)"""


def focus_log(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = frames_of(spark, sf_dir).select("event_id", (F.col("user_id") % 50).alias("drive"), (F.col("t") * 1_000_000 + F.col("event_id")).alias("at"), "event_type", "value")
    name = F.element_at(F.create_map(F.lit("view"), F.lit("ProtocolFocus"), F.lit("purchase"), F.lit("PiezoOnTarget"), F.lit("error"), F.lit("PiezoOffsetUpdate")), F.col("event_type"))
    number = F.col("value").cast("string")
    told = F.when(F.col("event_type") == "view", F.concat(F.lit("0, "), number)).otherwise(F.concat(number, F.lit(", 0")))
    return e, e.select("drive", "at", name.alias("name"), told.alias("description")).where("name is not null")


@query(f"WITH {FOCUS_SQL} SELECT k.event_id, round(coalesce(arg_max(x.focus, x.tm), 7), 6) AS focus FROM k LEFT JOIN x ON x.drive = k.drive AND x.tm <= k.tm WHERE kind = 'click' GROUP BY 1")
def corrected_focus(spark, sf_dir):
    """The focus in force at each click: targets and landings less the offset of their time."""
    e, log = focus_log(spark, sf_dir)
    clicks = e.where("event_type = 'click'").select("event_id", "drive", "at")
    return rounded(asof.corrected_focus(clicks, log, ["drive"], "at", 7.0, block=2e9).select("event_id", "focus"), "focus")


ENTRIES_SQL = """a AS (SELECT n_nationkey AS source, 'voxelsize.x' AS key, CAST(n_nationkey AS VARCHAR) AS value FROM nation UNION ALL SELECT n_nationkey, 'name', '"' || n_name || '"' FROM nation),
    b AS (SELECT s_nationkey AS source, 'voxelsize.x' AS key, CAST(count(*) AS VARCHAR) AS value FROM supplier GROUP BY 1 UNION ALL SELECT s_nationkey, 'voxelsize.y', CAST(max(s_suppkey) AS VARCHAR) FROM supplier GROUP BY 1
      UNION ALL SELECT s_nationkey, 'Camera.ROIPosX', CAST(min(s_suppkey) AS VARCHAR) FROM supplier GROUP BY 1)"""


def entry_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    n = metadata.entries_of(table(spark, sf_dir, "nation"), "n_nationkey", voxelsize__x=F.col("n_nationkey"), name=F.col("n_name"))
    s = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("n"), F.max("s_suppkey").alias("high"), F.min("s_suppkey").alias("low"))
    return n, metadata.entries_of(s, "s_nationkey", voxelsize__x=F.col("n"), voxelsize__y=F.col("high"), Camera__ROIPosX=F.col("low"))


@query(f"WITH {ENTRIES_SQL} SELECT source, key, coalesce(b.value, a.value) AS value FROM a FULL JOIN b USING (source, key)")
def metadata_copied(spark, sf_dir):
    return metadata.copy_entries(*entry_tables(spark, sf_dir))


@query(f"WITH {ENTRIES_SQL}, m AS (SELECT source, key, coalesce(a.value, b.value) AS value FROM a FULL JOIN b USING (source, key)) SELECT source, '{{' || string_agg('\"' || key || '\": ' || value, ', ' ORDER BY key) || '}}' AS json FROM m GROUP BY 1")
def metadata_json(spark, sf_dir):
    return metadata.to_json(metadata.merge_entries(*entry_tables(spark, sf_dir)))


@query(f"WITH {ENTRIES_SQL} SELECT source, CAST(x.value AS DOUBLE) * 1000 * (CAST(p.value AS DOUBLE) - 1) AS x, 0e0 AS y, 0e0 AS z FROM b x JOIN b p USING (source) WHERE x.key = 'voxelsize.x' AND p.key = 'Camera.ROIPosX'")
def metadata_origins(spark, sf_dir):
    return metadata.origins(metadata.copy_entries(*entry_tables(spark, sf_dir)))


# --- channels, shells, volumes ----------------------------------------------------------------------------------------
#: A known shift of the channels 1 and 2 against 0, in the order of registration.TERMS, for coordinates over a unit of 1.
SHIFTS = {1: ([0.02, -0.01, 0.03, 0.01, -0.02, 0.01, 0.0, 0.02, 0.05], [0.01, 0.0, 0.0, -0.03, 0.02, 0.0, 0.01, 0.0, -0.04]), 2: ([0.0, 0.01, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.1], [0.0, -0.02, 0.0, 0.0, 0.01, 0.0, 0.0, 0.0, 0.0])}


def shift_sql(coefficients: list[float], x: str, y: str) -> str:
    return " + ".join(f"{c}::DOUBLE * " + " * ".join(["1"] + [x] * p + [y] * q) for c, (p, q) in zip(coefficients, registration.TERMS.values(), strict=True))


def known_shifts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c, *v) for c, v in SHIFTS.items()], "channel int, dx array<double>, dy array<double>")


@query(
    f"""WITH {POINTS} SELECT vec_id, CAST(label % 3 AS INTEGER) AS channel,
    round(x + CASE label % 3 WHEN 1 THEN {shift_sql(SHIFTS[1][0], "x", "y")} WHEN 2 THEN {shift_sql(SHIFTS[2][0], "x", "y")} ELSE 0 END, 6) AS x,
    round(y + CASE label % 3 WHEN 1 THEN {shift_sql(SHIFTS[1][1], "x", "y")} WHEN 2 THEN {shift_sql(SHIFTS[2][1], "x", "y")} ELSE 0 END, 6) AS y FROM p"""
)
def shift_corrected(spark, sf_dir):
    points = points_of(spark, sf_dir).withColumn("channel", (F.col("label") % 3).cast("int"))
    return rounded(registration.shift_correct(points, known_shifts(spark), "channel", unit=1.0).select("vec_id", "channel", "x", "y"), "x", "y")


@query(
    "SELECT * FROM (VALUES "
    + ", ".join(f"({c}, '{a}', " + ", ".join(f"{v / 1000:.8f}::DOUBLE" for v in k) + ")" for c, both in SHIFTS.items() for a, k in zip("xy", both, strict=True))
    + f") v(channel, axis, {', '.join(registration.TERMS)}) WHERE (SELECT count(*) FROM embeddings) > 0"
)
def calibrate_shifts(spark, sf_dir):
    """Every point seen twice in three channels, two of them moved by a thousandth of the known shifts: pairing and fit give the shifts back."""
    _shared(spark)
    seen = points_of(spark, sf_dir).select("vec_id", "x", "y").withColumn("d", F.explode(F.array(F.lit(-1e-6), F.lit(1e-6))))
    first = seen.select(F.lit(0).alias("channel"), "vec_id", (F.col("x") + F.col("d")).alias("x"), (F.col("y") - F.col("d")).alias("y"))
    moved = seen.withColumn("channel", F.explode(F.array(F.lit(1), F.lit(2)))).join(known_shifts(spark), "channel")
    moved = moved.select("channel", "vec_id", *((F.col(c) - registration.shift(F.col("x"), F.col("y"), F.col(f"d{c}"), 1.0) / 1000 + F.col("d")).alias(c) for c in "xy"))
    found = registration.calibrate_shifts(first.unionByName(moved), "channel", "vec_id", ("x", "y"), 0.0005, unit=1.0, floor=1e-7)
    return rounded(registration.shift_table(found).drop("my3"), *registration.TERMS, places=6)


@query()
def clumps_within_channel(spark, sf_dir):
    """Clumps of events that don't mix types; held against a plain scan in the tests."""
    _shared(spark)
    e = frames_of(spark, sf_dir).withColumns({"y": F.lit(0.0), "radius": F.lit(1.0)})
    return registration.find_clumps_within_channel(e, "event_type", "t", "value", "y", "radius", 2, "event_id").select("event_id", "event_type", "clumpIndex")


SHELL_SQL = f"""WITH {POINTS}, m AS (SELECT label, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM p GROUP BY 1),
    r AS (SELECT p.label, vec_id, sqrt((x - cx) ** 2 + (y - cy) ** 2 + (z - cz) ** 2) AS r FROM p JOIN m USING (label)),
    a AS (SELECT label, avg(r) AS c FROM r GROUP BY 1), b AS (SELECT label, avg(r) AS c FROM r JOIN a USING (label) WHERE abs(r - c) < 0.8 * r GROUP BY 1),
    c AS (SELECT label, avg(r) AS c, count(*) AS n FROM r JOIN b USING (label) WHERE abs(r - c) < 0.4 * r GROUP BY 1)"""


@query(SHELL_SQL + " SELECT label, round(c, 6) AS radius, n FROM c")
def shell_radius(spark, sf_dir):
    """The shells of all labels in one fit of degree 0: mean radii, refitted twice without outliers."""
    _shared(spark)
    found = shells.fit_shells(points_of(spark, sf_dir), ["label"], degree=0, tolerance=0.8, scaled=False)
    return rounded(found.select("label", (F.col("coefficients")[0] / np.sqrt(4 * np.pi)).alias("radius"), "n"), "radius")


@query(SHELL_SQL + " SELECT vec_id, round(r.r / c, 5) AS normalized_radius, r.r < c AS inside_shell, round(r.r - c, 6) AS radial_distance FROM r JOIN c USING (label)")
def shell_coordinates(spark, sf_dir):
    _shared(spark)
    points = points_of(spark, sf_dir)
    found = shells.fit_shells(points, ["label"], degree=0, tolerance=0.8, scaled=False)
    out = shells.shell_coordinates(points, found, ["label"]).select("vec_id", "normalized_radius", "inside_shell", "radial_distance")
    return rounded(rounded(out, "radial_distance"), "normalized_radius", places=5)


@query()
def harmonic_shell(spark, sf_dir):
    """Shells of degree 3 in stretched frames, with the distance of every point; held against numpy in the tests."""
    _shared(spark)
    points = points_of(spark, sf_dir)
    found = shells.fit_shells(points, ["label"], tolerance=0.8)
    return rounded(shells.distance_to_shell(points, found, ["label"]).select("vec_id", "distance_to_shell"), "distance_to_shell")


#: Frames of a label as a volume with missing slices; the mask is what is bright. Voxels are 1 x 1.5 x 0.25.
VOXEL = (1.0, 1.5, 0.25)
DISTANCE_SQL = f"""WITH {PIXELS}, v AS (SELECT label, vec_id AS z, pos, pos % 8 AS x, pos // 8 AS y, v, v > 0.2 AS m FROM u),
    g AS (SELECT v.label, v.z, v.pos, bool_or(o.m) AS g FROM v JOIN v o ON o.label = v.label AND abs(o.z - v.z) + abs(o.x - v.x) + abs(o.y - v.y) <= 1 GROUP BY 1, 2, 3),
    w AS (SELECT v.*, g FROM v JOIN g USING (label, z, pos)),
    d AS (SELECT a.label, a.z, a.pos, any_value(a.v) AS v, CASE WHEN a.m THEN -1 ELSE 1 END * sqrt(min((a.x - b.x) ** 2 + 2.25 * (a.y - b.y) ** 2 + 0.0625 * (a.z - b.z) ** 2)) AS d
      FROM w a JOIN w b ON b.label = a.label AND CASE WHEN a.m THEN NOT b.m ELSE b.g END GROUP BY 1, 2, 3, a.m)"""


def mask_stripes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    stack = image_frames(spark, sf_dir).withColumnRenamed("vec_id", "z")
    return stack, volumes.feature_transform(images.threshold(stack, 0.2), ["label"], VOXEL)


@query(DISTANCE_SQL + " SELECT z AS vec_id, CAST(pos AS INTEGER) AS pos, round(d, 6) AS distance FROM d")
def mask_distance(spark, sf_dir):
    _, stripes = mask_stripes(spark, sf_dir)
    each = stripes.select(F.col("z").alias("vec_id"), "stripe", F.posexplode("distance").alias("pos", "distance"))
    return rounded(each.select("vec_id", (F.col("stripe") + F.col("pos")).cast("int").alias("pos"), "distance"), "distance")


@query(
    DISTANCE_SQL
    + """, b AS (SELECT label, CAST(floor((d + 1.1) / 0.5) AS INTEGER) AS bin, count(*) AS n, avg(v) AS mean FROM d WHERE d >= -1.1 AND d < 3.4 GROUP BY 1, 2),
    e AS (SELECT label, bin, coalesce(n, 0) AS n, coalesce(mean, 0) AS mean FROM (SELECT * FROM (SELECT DISTINCT label FROM b) CROSS JOIN (SELECT unnest(range(0, 9)) AS bin)) k LEFT JOIN b USING (label, bin))
    SELECT label, round(bin * 0.5 - 0.6, 6) AS bins, round(mean / avg(mean) FILTER (WHERE n > 1) OVER (PARTITION BY label), 6) AS enrichment,
    round(sum(n * mean) OVER w / sum(n * mean) OVER (PARTITION BY label), 6) AS enclosed, round(sum(n) OVER w / sum(n) OVER (PARTITION BY label), 6) AS enclosed_area FROM e WINDOW w AS (PARTITION BY label ORDER BY bin)"""
)
def distance_colocalisation(spark, sf_dir):
    stack, stripes = mask_stripes(spark, sf_dir)
    return rounded(volumes.distance_colocalisation(stack, stripes, ["label"], -1.1, 0.5, 3.9), "bins", "enrichment", "enclosed", "enclosed_area")


@query(
    DISTANCE_SQL
    + f""", p AS (SELECT CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, label, vec_id FROM embeddings),
    q AS (SELECT label, vec_id, CAST(floor((y * 10 + 4) / 1.5) * 8 + floor(x * 10 + 4) AS INTEGER) AS pos FROM p WHERE x * 10 + 4 >= 0 AND x * 10 + 4 < 8 AND y * 10 + 4 >= 0 AND (y * 10 + 4) / 1.5 < 8)
    SELECT p.vec_id, round(d, 6) AS mask_distance FROM p LEFT JOIN q ON q.vec_id = p.vec_id LEFT JOIN d ON d.label = q.label AND d.z = q.vec_id AND d.pos = q.pos"""
)
def distance_at_points(spark, sf_dir):
    """The mask's distance where the points of each frame lie."""
    _, stripes = mask_stripes(spark, sf_dir)
    points = points_of(spark, sf_dir).select("vec_id", "label", (F.col("x") * 10 + 4).alias("x"), (F.col("y") * 10 + 4).alias("y"), (F.col("vec_id") * 0.25).alias("z"))
    return rounded(volumes.distance_at_points(points, stripes, ["label"], VOXEL).select("vec_id", "mask_distance"), "mask_distance")


@query(
    f"""WITH {PIXELS}, v AS (SELECT label, vec_id AS z, pos, pos % 8 AS x, pos // 8 AS y, v FROM u)
    SELECT v.z AS vec_id, CAST(v.pos AS INTEGER) AS pos, round((coalesce(r.v, v.v) - coalesce(l.v, v.v)) / ((r.v IS NOT NULL)::INT + (l.v IS NOT NULL)::INT), 6) AS gx,
    round((coalesce(d.v, v.v) - coalesce(u.v, v.v)) / ((d.v IS NOT NULL)::INT + (u.v IS NOT NULL)::INT) / 1.5, 6) AS gy,
    round(coalesce((coalesce(a.v, v.v) - coalesce(b.v, v.v)) / nullif((a.v IS NOT NULL)::INT + (b.v IS NOT NULL)::INT, 0) / 0.25, 0), 6) AS gz FROM v
    LEFT JOIN v r ON r.z = v.z AND r.x = v.x + 1 AND r.y = v.y LEFT JOIN v l ON l.z = v.z AND l.x = v.x - 1 AND l.y = v.y
    LEFT JOIN v d ON d.z = v.z AND d.x = v.x AND d.y = v.y + 1 LEFT JOIN v u ON u.z = v.z AND u.x = v.x AND u.y = v.y - 1
    LEFT JOIN v a ON a.z = v.z + 1 AND a.label = v.label AND a.pos = v.pos LEFT JOIN v b ON b.z = v.z - 1 AND b.label = v.label AND b.pos = v.pos"""
)
def gradient_3d(spark, sf_dir):
    out = volumes.gradient3d(image_frames(spark, sf_dir).withColumnRenamed("vec_id", "z"), ["label"], VOXEL)
    each = out.select(F.col("z").alias("vec_id"), F.posexplode(F.arrays_zip("grad_x", "grad_y", "grad_z")).alias("pos", "g"))
    return rounded(each.select("vec_id", "pos", F.col("g.grad_x").alias("gx"), F.col("g.grad_y").alias("gy"), F.col("g.grad_z").alias("gz")), "gx", "gy", "gz")


@query()
def direction_to_mask(spark, sf_dir):
    """Unit vectors from each voxel to the mask's edge."""
    _, stripes = mask_stripes(spark, sf_dir)
    out = volumes.direction_to_mask(stripes, VOXEL)
    each = out.select(F.col("z").alias("vec_id"), "stripe", F.posexplode(F.arrays_zip("dir_x", "dir_y", "dir_z")).alias("pos", "g"))
    return rounded(each.select("vec_id", (F.col("stripe") + F.col("pos")).cast("int").alias("pos"), F.col("g.dir_x").alias("dx"), F.col("g.dir_y").alias("dy"), F.col("g.dir_z").alias("dz")), "dx", "dy", "dz")


@query()
def watershed(spark, sf_dir):
    """Frames flooded from their lowest pixels; held against a plain heap in the tests."""
    frames = image_frames(spark, sf_dir)
    rank = F.transform("pixels", lambda p: F.when(p == F.array_min("pixels"), 1.0).when(p == F.element_at(F.array_sort("pixels"), 2), 2.0).otherwise(0.0))
    return exploded(flow.watershed(frames, frames.withColumn("pixels", rank), ["vec_id"]))


@query()
def frame_motion(spark, sf_dir):
    """Motion between the frames of each label; known motions are found in the tests."""
    out = flow.optical_flow(image_frames(spark, sf_dir), "label", "vec_id", 1.0, 2.0, 0.001)
    each = out.select("vec_id", F.posexplode(F.arrays_zip("flow_x", "flow_y")).alias("pos", "g"))
    return rounded(each.select("vec_id", "pos", F.col("g.flow_x").alias("dx"), F.col("g.flow_y").alias("dy")), "dx", "dy")


# --- streams --------------------------------------------------------------------------------------------------------
@query(f"WITH {EVENTS} SELECT user_id, count(*) AS n, round(sum(value), 4) AS total, min(t) AS \"tIndex\", max(t) - min(t) + 1 AS \"burstDuration\" FROM e GROUP BY 1")
def stream_merge_clumps(spark, sf_dir):
    """The running totals of a stream that has read all of the table: state in the engine, last update of each label."""
    from photonflow.streaming import clumps

    _shared(spark)
    source = table(spark, sf_dir, "events")
    stream = clumps.read_points(spark, f"{sf_dir}/events.parque[t]", source.schema)  # a pattern: the table may be a file or a folder
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    stream = stream.withColumn("t", (F.floor(micros / 60_000_000) - 28_401_120).cast("long"))
    target = _scratch(spark, "totals")
    last = clumps.merge_by_label(stream, "user_id", "t", "value").writeStream.outputMode("complete").option("checkpointLocation", f"{target}-state").trigger(availableNow=True)
    last.foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(target)).start().awaitTermination()
    return rounded(spark.read.parquet(target), "total", places=4)
