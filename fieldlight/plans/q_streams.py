"""Queries of windows and streams (K)."""

from pyspark.sql import functions as F

from ..operators import joins
from ..operators.mosaic import daily_first_valid
from ..sources import commits
from ..streaming import streams
from . import inputs
from .inputs import OBSERVATIONS
from .q_sources import folder
from .registry import query

_PREFIX = "w(w, a, z) AS (VALUES (1, 19723, 19728), (2, 19723, 19735), (3, 19723, 19753), (4, 19000, 19010))"


def prefixes(spark):
    return spark.createDataFrame([(1, 19723, 19728), (2, 19723, 19735), (3, 19723, 19753), (4, 19000, 19010)], "w int, start int, end int")


_K1 = """WITH e AS (SELECT user_id, ts, value FROM events), s AS (SELECT user_id, value, unnest(generate_series(time_bucket(INTERVAL '1 day', ts, TIMESTAMP '1970-01-01') - INTERVAL '2 days', time_bucket(INTERVAL '1 day', ts, TIMESTAMP '1970-01-01'), INTERVAL '1 day')) AS "start" FROM e)
SELECT user_id % 10 AS grp, "start", count(*) AS n, round(sum(value), 6) AS total FROM s GROUP BY ALL"""


def _events(spark, sf, df=None):
    e = inputs.table(spark, sf, "events") if df is None else df
    return e.select((F.col("user_id") % 10).alias("grp"), F.col("ts").cast("timestamp").alias("ts"), "value", "event_id")


@query("k1_rolling_windows", _K1)
def k1(spark, sf):
    r = streams.rolling(_events(spark, sf), ["grp"], "ts", "3 days", "1 day", "10 days", "value")
    return r.select("grp", F.col("start").cast("timestamp_ntz").alias("start"), "n", F.round("total", 6).alias("total"))


@query("k1_rolling_stream", _K1 + " HAVING \"start\" + INTERVAL 3 DAY <= (SELECT max(ts) FROM events) - INTERVAL 10 DAY")
def k1s(spark, sf):
    """The same over a stream of the files, appended as the watermark, ten days behind the latest event, closes windows."""
    path = f"{sf}/events.parquet"
    e = streams.event_stream(spark, f"{sf}/event[s].parquet", spark.read.parquet(path).schema)  # a pattern: a stream's path is a folder otherwise
    r = streams.rolling(_events(spark, sf, e), ["grp"], "ts", "3 days", "1 day", "10 days", "value")
    out = streams.drained(r, folder(spark))
    return out.select("grp", F.col("start").cast("timestamp_ntz").alias("start"), "n", F.round("total", 6).alias("total"))


_OUT = f"WITH {OBSERVATIONS}, {_PREFIX}, m AS (SELECT sample_id, epoch_day, bool_or(valid) AS valid FROM observations GROUP BY ALL), s AS (SELECT DISTINCT sample_id FROM observations)"


@query("k2_window_outcomes", _OUT + " SELECT s.sample_id, w.w, count(m.epoch_day) AS days, count(*) FILTER (m.valid) AS valid_days, CASE WHEN count(*) FILTER (m.valid) > 0 THEN 'complete' ELSE 'empty_window' END AS outcome FROM s CROSS JOIN w LEFT JOIN m ON m.sample_id = s.sample_id AND m.epoch_day >= a AND m.epoch_day < z GROUP BY ALL")
def k2(spark, sf):
    """Daily mosaics into cumulative windows; a window without a valid day is explicit."""
    o = inputs.observations(spark, sf)
    m = daily_first_valid(o, ["sample_id", "epoch_day"], ["acquired", "obs_id"], "valid", "bands", "obs_id")
    w = prefixes(spark)
    got = joins.observations_in_windows(m, w, "epoch_day").groupBy("sample_id", "w").agg(F.count("*").alias("days"), F.count_if("valid").alias("valid_days"))
    every = joins.cross_small(o.select("sample_id").distinct(), [1, 2, 3, 4], "w")
    out = every.join(got, ["sample_id", "w"], "left").fillna(0, ["days", "valid_days"])
    return out.withColumn("outcome", F.when(F.col("valid_days") > 0, "complete").otherwise("empty_window"))


@query("k3_window_slice", f"WITH {OBSERVATIONS} SELECT obs_id, epoch_day FROM observations WHERE valid AND epoch_day >= 19730 AND epoch_day < 19737")
def k3(spark, sf):
    o = inputs.observations(spark, sf).where("valid AND epoch_day >= 19730 AND epoch_day < 19737")
    return o.orderBy("epoch_day", "obs_id").select("obs_id", "epoch_day")


_K4 = f"WITH {OBSERVATIONS}, w AS (SELECT i AS w, 19723 + i * 3 AS a, 19723 + i * 3 + 7 AS z FROM (SELECT CAST(unnest(range(8)) AS INTEGER) AS i)) SELECT sample_id, w, count(*) AS n, round(sum(value), 6) AS total FROM observations JOIN w ON epoch_day >= a AND epoch_day < z GROUP BY ALL"


@query("k4_late_rows", _K4)
def k4(spark, sf):
    """Every 17th row comes late; only the windows it falls into are computed again, and the result is that of all rows."""
    o = inputs.observations(spark, sf).select("obs_id", "sample_id", "epoch_day", "value")
    w = streams.window_table(spark, 19723, 19753, 7, 3)
    early, late = o.where("obs_id % 17 <> 0"), o.where("obs_id % 17 = 0")
    old = joins.observations_in_windows(early, w, "epoch_day").groupBy("sample_id", "w").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    r = streams.recomputed(old, early, late, w, "sample_id", "epoch_day", "obs_id", "value")
    return r.withColumn("total", F.round("total", 6))


@query("k4_touched_windows", f"WITH {OBSERVATIONS}, w AS (SELECT i AS w, 19723 + i * 3 AS a, 19723 + i * 3 + 7 AS z FROM (SELECT CAST(unnest(range(8)) AS INTEGER) AS i)) SELECT DISTINCT sample_id, w FROM observations JOIN w ON epoch_day >= a AND epoch_day < z WHERE obs_id % 400 = 0")
def k4b(spark, sf):
    late = inputs.observations(spark, sf).where("obs_id % 400 = 0")
    return streams.touched(late, streams.window_table(spark, 19723, 19753, 7, 3), "sample_id", "epoch_day")


@query("k5_empty_windows", _OUT + " SELECT s.sample_id, w.w FROM s CROSS JOIN w WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.sample_id = s.sample_id AND m.valid AND epoch_day >= a AND epoch_day < z)")
def k5(spark, sf):
    return k2(spark, sf).where("outcome = 'empty_window'").select("sample_id", "w")


@query("k6_resumed_groups", f"WITH {OBSERVATIONS} SELECT epoch_day, count(*) AS n FROM observations GROUP BY epoch_day")
def k6(spark, sf):
    """A run that finished some days and stopped inside the next ones, before their markers: the rerun writes the unmarked days only."""
    path = folder(spark)
    g = inputs.observations(spark, sf).groupBy("epoch_day").agg(F.count("*").alias("n"))
    commits.resumed(g.where("epoch_day < 19735"), path, ["epoch_day"], "r1")
    commits.write_data(g.where("epoch_day BETWEEN 19735 AND 19740").withColumn("n", F.lit(-1).cast("long")), path, ["epoch_day"])  # stopped here
    commits.resumed(g, path, ["epoch_day"], "r1")
    return commits.committed(spark, path, ["epoch_day"]).select("epoch_day", "n")


@query("k7_stream_dedup", "SELECT count(*) AS n, count(DISTINCT event_id) AS ids FROM events")
def k7(spark, sf):
    path = f"{sf}/events.parquet"
    e = streams.event_stream(spark, f"{sf}/event[s].parquet", spark.read.parquet(path).schema)  # a pattern: a stream's path is a folder otherwise
    twice = _events(spark, sf, e)
    d = streams.deduplicated(twice.unionByName(twice), "event_id", "ts", "40 days")
    return streams.drained(d, folder(spark)).agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("ids"))


@query("k4_keyed_state", _K4)
def k4c(spark, sf):
    """The same windows from a stream of files in any order, with state by hash of the key."""
    o = inputs.observations(spark, sf).select("obs_id", "sample_id", "epoch_day", "value")
    path, w = folder(spark), streams.window_table(spark, 19723, 19753, 7, 3)
    o.repartition(3, "value").write.parquet(f"{path}/in")
    stream = streams.event_stream(spark, f"{path}/in", o.schema)
    streams.micro_batches(stream, f"{path}/state", f"{path}/out", w, "sample_id", "epoch_day", "obs_id", "value", f"{path}/check", 16)
    return spark.read.parquet(f"{path}/out").select("sample_id", "w", "n", F.round("total", 6).alias("total"))


@query("k7_conflicting_content", "SELECT event_id, 'accepted' AS kind FROM events UNION ALL SELECT event_id, 'conflict' FROM events WHERE event_id % 11 = 0")
def k7b(spark, sf):
    """Each event comes twice, every eleventh with another value the second time: that one goes to the side."""
    e = inputs.table(spark, sf, "events").select("event_id", "user_id", "value")
    path = folder(spark)
    e.write.parquet(f"{path}/in")
    files = len(spark.read.parquet(f"{path}/in").inputFiles())  # a batch has the files of one write
    e.withColumn("value", F.when(F.col("event_id") % 11 == 0, F.col("value") + 1).otherwise(F.col("value"))).write.mode("append").parquet(f"{path}/in")
    streams.accepted_once(streams.event_stream(spark, f"{path}/in", e.schema, files), f"{path}/ok", f"{path}/odd", "event_id", ["user_id", "value"], f"{path}/check", 16)
    side = lambda at, kind: spark.read.parquet(f"{path}/{at}").select("event_id", F.lit(kind).alias("kind"))
    return side("ok", "accepted").unionByName(side("odd", "conflict"))


@query("k8_many_windows", _K4)
def k8(spark, sf):
    w = streams.window_table(spark, 19723, 19753, 7, 3)
    g = joins.observations_in_windows(inputs.observations(spark, sf), w, "epoch_day").groupBy("sample_id", "w")
    return g.agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))


@query("k9_skip_finished", f"WITH {inputs.TASKS} SELECT task_id FROM tasks WHERE status <> 'succeeded'")
def k9(spark, sf):
    t = inputs.tasks(spark, sf).withColumn("key", F.sha2(F.col("task_id").cast("string"), 256))
    return t.join(t.where("status = 'succeeded'").select("key"), "key", "left_anti").select("task_id")
