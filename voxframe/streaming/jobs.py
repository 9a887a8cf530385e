"""Running streams into tables."""

import hashlib

from pyspark.sql import functions as F

from voxframe.sources.sinks import existing, saturate
from voxframe.streaming import metrics, state


def run_available(df, path, checkpoint, mode="update"):
    """Process what is there, batch by batch, and stop.

    Each batch replaces its own folder, so a repeated batch after a failure
    leaves no duplicates.
    """
    def write(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    query = (
        df.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
    )
    query.awaitTermination()
    return query


def latest(spark, path, keys):
    """The newest version of each row of an update-mode table."""
    rows = spark.read.option("basePath", path).parquet(f"{path}/batch=*")
    values = F.struct(*[c for c in rows.columns if c not in ("batch", *keys)])
    return rows.groupBy(*keys).agg(F.max_by(values, "batch").alias("_v")).select(*keys, "_v.*")


def materialize_stream(manifests, cut, key, out, checkpoint):
    """Write-through of arriving manifest rows: each patch is stored once.

    Which keys have arrived is the stream's own state, started from the keys of
    the store: a batch reads its own rows and their state, never the store. A
    batch replaces its own folder, so a repeated one leaves no duplicates.
    """
    spark = manifests.sparkSession
    state.use_state_store(spark)
    # One folder per checkpoint: batch numbers start anew with each of them.
    run = hashlib.md5(checkpoint.encode()).hexdigest()

    def write(batch, batch_id):
        rows = saturate(cut(batch).filter("data is not null"))
        rows.write.mode("overwrite").parquet(f"{out}/run={run}/batch={batch_id}")

    query = (
        state.first_arrivals(manifests, key, existing(spark, out, key, manifests.schema[key].dataType.simpleString()))
        .writeStream.option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
    )
    query.awaitTermination()
    return query


def sample_arrivals(series, keys, interval, delay, path, checkpoint):
    """Tumbling samples of a stream, with the rows that come too late in a table.

    The clock of a batch is the latest event time of the batches before it, less
    ``delay`` (an interval text). A row whose interval ends at or before the
    clock is late: it changes no sample and goes to ``late`` instead. Both tables
    have one folder per batch, which a repeated batch replaces.
    """
    def write(batch, batch_id):
        spark = batch.sparkSession
        clock = None
        if batch_id:
            clock = spark.read.parquet(f"{path}/clock/batch={batch_id - 1}").first()[0]
        rows = batch.withColumn("_end", F.window("ts", interval)["end"])
        on_time = F.lit(True) if clock is None else F.col("_end") > F.timestamp_micros(F.lit(clock)) - F.expr(f"interval {delay}")
        marked = rows.withColumn("_on_time", F.coalesce(on_time, F.lit(True)))
        samples = metrics.sample_tumbling(marked.filter("_on_time"), keys, interval, order=True)
        samples.write.mode("overwrite").parquet(f"{path}/samples/batch={batch_id}")
        marked.filter("NOT _on_time").select(batch.columns).write.mode("overwrite").parquet(f"{path}/late/batch={batch_id}")
        latest_ts = batch.agg(F.greatest(F.max(F.unix_micros("ts")), F.lit(clock).cast("long")).alias("ts"))
        latest_ts.write.mode("overwrite").parquet(f"{path}/clock/batch={batch_id}")

    query = series.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    return query


def arrived_samples(spark, path, keys):
    """(samples, late rows) of ``sample_arrivals``: the last value of each interval."""
    rows = spark.read.option("basePath", f"{path}/samples").parquet(f"{path}/samples/batch=*")
    samples = rows.groupBy(*keys, "start").agg(F.max_by("value", "order").alias("value"))
    return samples, spark.read.option("basePath", f"{path}/late").parquet(f"{path}/late/batch=*")


def monitor_stream(spark, folder, path, checkpoint, files_per_trigger=None):
    """Monitor files of any header as long rows, batch by batch."""
    def write(batch, batch_id):
        metrics.long_form(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    lines = metrics.monitor_lines(spark, folder, files_per_trigger)
    query = lines.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    return query


def cache_state(stored, manifest, key):
    """Counts of cached and expected patches, and whether all are there."""
    cached = stored.select(key).distinct().agg(F.count("*").alias("cached"))
    total = manifest.agg(F.count("*")).scalar()
    return cached.withColumn("total", total).withColumn("complete", F.col("cached") >= F.col("total"))
