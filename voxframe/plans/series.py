"""Queries over metric series, in batch and as streams."""

from pyspark.sql import functions as F

from voxframe.plans.files import cut_windows
from voxframe.plans.registry import query
from voxframe.plans.scores import STATE
from voxframe.session import scratch_dir
from voxframe.streaming import jobs, metrics, state

SERIES = ["run_id", "metric"]
STREAM_FILES = 4


def stamp(df, name="start"):
    return df.withColumn(name, F.date_format(name, "yyyy-MM-dd HH:mm:ss"))


def stream_of(s, table, name):
    """A source table as a stream of several files, each a micro-batch.

    Rows of one series are dealt over all files, so state lives across batches.
    """
    rows = s.spark.read.parquet(f"{s.sf_dir}/{table}.parquet")
    path = scratch_dir(s.spark, f"stream-{table}")
    rows.repartition(STREAM_FILES).write.parquet(path)
    return metrics.read_metrics(s.spark, path, rows.schema, "parquet", 1)


def series_stream(s):
    """The stream behind fixture T."""
    return stream_of(s, "events", "T").selectExpr(
        "event_id as step", "cast(ts as timestamp) as ts", "user_id as run_id", "event_type as metric", "value",
        "case when user_id % 2 = 0 then value * 1e-7 else value * 1e-2 end as loss", "cast(day(ts) as int) as epoch",
    )


TUMBLE = """
    select run_id, metric, strftime(time_bucket(interval '6 hours', ts), '%Y-%m-%d %H:%M:%S') as start, arg_max(value, (ts, step)) as value from T group by 1, 2, 3"""


@query("sample_tumbling", "T", TUMBLE)
def sample_tumbling(s):
    return stamp(metrics.sample_tumbling(s.T, SERIES, "6 hours"))


def in_order(s, rows, file, files, path):
    """Rows as a stream of files that arrive one after the other, by number."""
    for f in range(files):  # a file's time is its place in the order
        rows.filter(F.col(file) == f).drop(file).coalesce(1).write.mode("append").parquet(path)
    return metrics.read_metrics(s.spark, path, rows.drop(file).schema, "parquet", 1)


def timed(s, file):
    rows = s.T.select("step", F.col("ts").cast("timestamp").alias("ts"), "run_id", "metric", "value")
    return rows.withColumn("f", F.expr(file))


@query("sample_tumbling_stream", "T", TUMBLE)
def sample_tumbling_stream(s):
    """Events in the order of their days: none is later than the watermark."""
    path = scratch_dir(s.spark, "tumbling")
    stream = in_order(s, timed(s, "cast(floor((day(ts) - 1) / 8) as int)"), "f", 4, f"{path}-in")
    sampled = metrics.sample_tumbling(stream, SERIES, "6 hours", "1 hour")
    jobs.run_available(sampled, path, f"{path}-state")
    return stamp(jobs.latest(s.spark, path, [*SERIES, "start"]))


#: Files in which the events arrive: eight days each, every twentieth two files late.
ARRIVAL = "cast(floor((day(ts) - 1) / 8) as int) + case when step % 20 = 0 then 2 else 0 end"
ARRIVALS = f"""
    with a as (select *, {ARRIVAL} as f, time_bucket(interval '6 hours', ts) as start from T), m as (select f, max(ts) as m from a group by 1),
    c as (select f, max(m) over (order by f rows between unbounded preceding and 1 preceding) as clock from m),
    r as (select a.*, coalesce(start + interval '6 hours' <= clock - interval '3 days', false) as late from a join c using (f))"""


def arrivals(s):
    """(samples, late rows) of the events in their order of arrival."""
    path = scratch_dir(s.spark, "arrivals")
    stream = in_order(s, timed(s, ARRIVAL), "f", 6, f"{path}/in")
    jobs.sample_arrivals(stream, SERIES, "6 hours", "3 days", path, f"{path}/state")
    return jobs.arrived_samples(s.spark, path, SERIES)


@query("sample_arrivals", "T", f"""{ARRIVALS}
    select run_id, metric, strftime(start, '%Y-%m-%d %H:%M:%S') as start, arg_max(value, (ts, step)) as value from r where not late group by 1, 2, 3""")
def sample_arrivals(s):
    return stamp(arrivals(s)[0])


@query("late_rows", "T", f"{ARRIVALS} select run_id, metric, count(*) as n, min(step) as first_step from r where late group by 1, 2")
def late_rows(s):
    return arrivals(s)[1].groupBy(*SERIES).agg(F.count("*").alias("n"), F.min("step").alias("first_step"))


#: Two layouts of monitor files; small values are not measured (empty cells).
MONITORS = {0: ["gpu0_util_pct", "mem_used_gb", "cpu_load_1m"], 1: ["cpu_load_1m", "gpu0_power_w", "gpu0_mem_mb", "gpu0_util_pct"]}


def monitor_sql():
    cells = {"gpu0_util_pct": ("%", "value"), "mem_used_gb": ("GB", "value / 4"), "cpu_load_1m": (None, "value / 8"), "gpu0_power_w": ("W", "value * 2"), "gpu0_mem_mb": ("MB", "value * 64")}
    parts = []
    for k, names in MONITORS.items():
        for n in names:
            unit, value = cells[n]
            unit = f"'{unit}'" if unit else "cast(null as varchar)"
            parts.append(f"select step % 2 as layout, ts, '{n}' as metric, {unit} as unit, {value} as value from m where step % 2 = {k} and {value} >= 10")
    return "with m as (select step, date_trunc('second', ts) as ts, floor(value) as value from T), r as (" + " union all ".join(parts) + """)
        select layout, strftime(ts, '%Y-%m-%d %H:%M:%S') as ts, metric, unit, count(*) as n, sum(value) as total from r group by 1, 2, 3, 4"""


@query("monitor_long_form", "T", monitor_sql())
def monitor_long_form(s):
    """Wide monitor files with different headers, streamed into long rows."""
    values = {"gpu0_util_pct": "value", "mem_used_gb": "value / 4", "cpu_load_1m": "value / 8", "gpu0_power_w": "value * 2", "gpu0_mem_mb": "value * 64"}
    rows = s.T.select("step", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"), F.floor("value").cast("double").alias("value"))
    cell = {n: F.when(F.expr(v) >= 10, F.expr(v).cast("string")).otherwise("") for n, v in values.items()}
    line = F.when(F.col("step") % 2 == 0, F.concat_ws(",", "at", *[cell[n] for n in MONITORS[0]])).otherwise(F.concat_ws(",", "at", *[cell[n] for n in MONITORS[1]]))
    heads = s.spark.createDataFrame([(k, -1, ",".join(["timestamp", *names])) for k, names in MONITORS.items()], "layout long, pos long, line string")
    lines = rows.select((F.col("step") % 2).alias("layout"), F.col("step").alias("pos"), line.alias("line")).unionByName(heads)
    path = scratch_dir(s.spark, "monitor")
    lines.repartition("layout").sortWithinPartitions("layout", "pos").select("layout", "line").write.partitionBy("layout").text(f"{path}/in")
    jobs.monitor_stream(s.spark, f"{path}/in", f"{path}/out", f"{path}/state", 1)
    found = s.spark.read.parquet(f"{path}/out/batch=*")
    layout = F.regexp_extract("file", "layout=([0-9]+)/", 1).cast("long")
    return stamp(found, "ts").groupBy(layout.alias("layout"), "ts", "metric", "unit").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


@query("read_metrics", "T", "select run_id, count(*) as n, round(sum(value), 4) as total from T group by 1")
def read_metrics(s):
    path = scratch_dir(s.spark, "metrics")
    jobs.run_available(series_stream(s), path, f"{path}-state", "append")
    rows = s.spark.read.parquet(f"{path}/batch=*")
    return rows.groupBy("run_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("active_share", "T", """
    select run_id, strftime(time_bucket(interval '1 day', ts), '%Y-%m-%d %H:%M:%S') as start, round(avg(case when value >= 75 then 1e0 else 0e0 end), 6) as share from T group by 1, 2""")
def active_share(s):
    return stamp(metrics.active_share(s.T, ["run_id"], "1 day")).withColumn("share", F.round("share", 6))


@query("epoch_progress", "T", "select step, cast(floor(step % 3125 * 100 / 3125) as int) as epoch_progress_pct from T")
def epoch_progress(s):
    return metrics.epoch_progress(s.T).select("step", "epoch_progress_pct")


METRICS = ["click", "error", "view"]


@query("epoch_rollup", "T", "select run_id, epoch, " + ", ".join(
    f"arg_max(value, (ts, step)) filter (where metric = '{m}') as {m}" for m in METRICS) + " from T group by 1, 2")
def epoch_rollup(s):
    return metrics.epoch_rollup(s.T, ["run_id"], METRICS)


COLLAPSE = """
    with f as (select run_id, min((ts, step)) filter (where loss < 1e-4) as first, arg_min(epoch, (ts, step)) filter (where loss < 1e-4) as first_epoch, max((ts, step)) filter (where loss >= 1e-4) as last from T group by 1)
    select run_id, first_epoch, coalesce(first is not null and first_epoch <= 5 and (last is null or last < first), false) as collapsed from f"""


@query("collapse_alert", "T", COLLAPSE)
def collapse_alert(s):
    return metrics.collapse_alert(s.T, "run_id")


@query("collapse_alert_stream", "T", COLLAPSE)
def collapse_alert_stream(s):
    path = scratch_dir(s.spark, "alerts")
    jobs.run_available(metrics.collapse_alert(series_stream(s), "run_id"), path, f"{path}-state", "complete")
    return jobs.latest(s.spark, path, ["run_id"])


@query("collapse_alert_state", "T", COLLAPSE)
def collapse_alert_state(s):
    """The alert as state per run: a row when the answer for a run changes."""
    state.use_state_store(s.spark)
    path = scratch_dir(s.spark, "alert-state")
    jobs.run_available(state.collapse_alerts(series_stream(s), "run_id"), path, f"{path}-state")
    return jobs.latest(s.spark, path, ["run_id"]).drop("alerts")


@query("review_states", "EV", STATE)
def review_states(s):
    """The review log as a stream, dealt over files that do not keep its order."""
    state.use_state_store(s.spark)
    path = scratch_dir(s.spark, "review-state")
    s.EV.withColumn("_f", F.pmod(F.xxhash64("seq"), F.lit(STREAM_FILES))).repartition(STREAM_FILES, "_f").drop("_f").write.parquet(f"{path}-in")
    events = metrics.read_metrics(s.spark, f"{path}-in", s.EV.schema, "parquet", 1)
    jobs.run_available(state.review_states(events), path, f"{path}-state")
    return jobs.latest(s.spark, path, ["patch_id"])


@query("ema_smooth", "T", """
    with recursive n as (select run_id, step, sqrt(value) as value, row_number() over (partition by run_id order by step) as i from T),
    e as (select run_id, step, i, value as smooth from n where i = 1 union all select n.run_id, n.step, n.i, 1e-2 * n.value + 99e-2 * e.smooth from e join n on n.run_id = e.run_id and n.i = e.i + 1)
    select run_id, step, round(smooth, 6) as smooth from e""")
def ema_smooth(s):
    # square roots, so that no result sits exactly on a rounding tie
    return metrics.ema_smooth(s.T.withColumn("value", F.sqrt("value")), "run_id", block=500).select("run_id", "step", F.round("smooth", 6).alias("smooth"))


@query("monitor_time", "T", "select step, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') as at, cast(epoch(date_trunc('second', ts)) as bigint) as unix from T")
def monitor_time(s):
    text = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    at = F.to_timestamp(text, "yyyy-MM-dd HH:mm:ss")
    return s.T.select("step", F.date_format(at, "yyyy-MM-dd HH:mm:ss").alias("at"), F.unix_timestamp(at).alias("unix"))


@query("materialize_stream", "W V", """
    select w.patch_id, cast(coalesce(sum(floor(v.value)), 0) as bigint) as total
    from W w left join V v on v.volume_id = w.volume_id and v.z >= w.z0 and v.z < w.z0 + 6 and v.y >= w.y0 and v.y < w.y0 + 6 and v.x >= w.x0 and v.x < w.x0 + 6 group by 1""")
def materialize_stream(s):
    out = scratch_dir(s.spark, "stream-patches")
    windows = stream_of(s, "customer", "W").selectExpr(
        "c_custkey as patch_id", "cast(floor(c_custkey / 15) as int) as volume_id", "cast(c_custkey % 13 - 2 as int) as z0",
        "cast((c_custkey * 7) % 13 - 2 as int) as y0", "cast((c_custkey * 5) % 13 - 2 as int) as x0",
    )
    jobs.materialize_stream(windows, cut_windows(s), "patch_id", out, f"{out}-state")
    stored = s.spark.read.parquet(out)
    return stored.select("patch_id", F.aggregate("data", F.lit(0).cast("bigint"), lambda a, v: a + v).alias("total"))


@query("cache_state", "W", "select count(*) as cached, (select count(*) from W) as total, false as complete from W where z0 < 4")
def cache_state(s):
    return jobs.cache_state(s.W.filter("z0 < 4"), s.W, "patch_id")
