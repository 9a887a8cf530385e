"""Metric series: file streams, tumbling samples, epochs, alerts, smoothing."""

import math

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxframe import schemas
from voxframe.operators.ranking import row_numbers

# Sampling interval, activity level, steps per epoch, alert rule.
SAMPLE_SECONDS = 5
ACTIVE_PCT = 75
STEPS_PER_EPOCH = 3125
COLLAPSE_LOSS = 1e-4
COLLAPSE_EPOCHS = 5


def read_metrics(spark, path, schema=None, fmt="csv", files_per_trigger=None, glob=None):
    """A folder of metric files as a stream."""
    reader = spark.readStream.schema(schema or schemas.MONITOR).format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True).option("comment", "#")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path)


def monitor_lines(spark, path, files_per_trigger=None):
    """The lines of monitor files as a stream of (file, line)."""
    reader = spark.readStream.option("recursiveFileLookup", True)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"))


#: What the last part of a column name says about its unit.
UNITS = {"pct": "%", "mb": "MB", "gb": "GB", "w": "W"}


def long_form(lines, first="timestamp"):
    """Lines (file, line) of wide CSV files to (file, ts, metric, unit, value).

    Each file has a header of its own, the line that begins with the ``first``
    column; files may have different columns, in any order. Empty cells, cells
    beyond the header and cells that are no numbers give no row. ``unit`` comes
    from the end of the column name and is null for plain numbers.
    """
    cells = F.split("line", ",", -1)
    header = F.col("line").startswith(first + ",")
    names = lines.filter(header).groupBy("file").agg(F.split(F.max("line"), ",", -1).alias("names"))
    rows = lines.filter(~header & (F.col("line") != "") & ~F.col("line").startswith("#")).join(names, "file")
    wide = rows.select("file", F.to_timestamp(F.get(cells, F.lit(0)), "yyyy-MM-dd HH:mm:ss").alias("ts"), "names", cells.alias("cells"))
    found = wide.select("file", "ts", F.explode(F.arrays_zip("names", "cells")).alias("p")).select(
        "file", "ts", F.col("p.names").alias("metric"), F.col("p.cells").try_cast("double").alias("value")
    )
    units = F.create_map(*[F.lit(x) for pair in UNITS.items() for x in pair])
    unit = F.try_element_at(units, F.element_at(F.split("metric", "_"), -1))
    return found.filter(F.col("metric").isNotNull() & (F.col("metric") != first) & F.col("value").isNotNull()).select(
        "file", "ts", "metric", unit.alias("unit"), "value"
    )


def sample_tumbling(series, keys, interval=f"{SAMPLE_SECONDS} seconds", watermark=None, order=False):
    """Last value of each series per interval.

    On a stream give ``watermark``: rows later than it are dropped, which also
    bounds the state. ``order`` adds what the value is the last by, for samples
    that are put together later.
    """
    if watermark:
        series = series.withWatermark("ts", watermark)
    at = F.struct("ts", "step")
    extra = [F.max(at).alias("order")] if order else []
    return (
        series.groupBy(F.window("ts", interval).alias("w"), *keys)
        .agg(F.max_by("value", at).alias("value"), *extra)
        .select(*keys, F.col("w.start").alias("start"), "value", *["order"] * order)
    )


def active_share(series, keys, interval, thr=ACTIVE_PCT, watermark=None):
    """Share of samples at or above a level per interval."""
    if watermark:
        series = series.withWatermark("ts", watermark)
    share = F.avg(F.when(F.col("value") >= thr, 1.0).otherwise(0.0)).alias("share")
    return (
        series.groupBy(F.window("ts", interval).alias("w"), *keys)
        .agg(share)
        .select(*keys, F.col("w.start").alias("start"), "share")
    )


def epoch_progress(df, step="step", steps_per_epoch=STEPS_PER_EPOCH):
    """Percent of the current epoch."""
    done = F.col(step) % steps_per_epoch
    return df.withColumn("epoch_progress_pct", F.floor(done * 100 / steps_per_epoch).cast("int"))


def epoch_rollup(series, keys, metrics, order=("ts", "step")):
    """Last value of each named metric per epoch, one column per metric."""
    at = F.struct(*order)
    last = lambda m: F.max_by(F.when(F.col("metric") == m, F.col("value")), F.when(F.col("metric") == m, at)).alias(m)
    return series.groupBy(*keys, "epoch").agg(*[last(m) for m in metrics])


def collapse_alert(series, run, thr=COLLAPSE_LOSS, epochs=COLLAPSE_EPOCHS):
    """Runs whose loss falls below ``thr`` in the first epochs and stays there.

    Works on a batch, and on a stream in complete mode: per run it keeps only
    the first step below and the last step not below.
    """
    below = F.col("loss") < thr
    at = F.struct("ts", "step")
    per = series.groupBy(run).agg(
        F.min(F.when(below, at)).alias("_first"),
        F.min_by(F.when(below, F.col("epoch")), F.when(below, at)).alias("first_epoch"),
        F.max(F.when(~below, at)).alias("_last"),
    )
    stays = F.col("_last").isNull() | (F.col("_last") < F.col("_first"))
    alert = F.col("_first").isNotNull() & (F.col("first_epoch") <= epochs) & stays
    return per.select(run, "first_epoch", F.coalesce(alert, F.lit(False)).alias("collapsed"))


#: Longest block of a running sum, and the powers of ten a scaled sum may span.
EMA_BLOCK = 10000
EMA_SPAN = 250


def ema_smooth(series, run, order="step", alpha=0.01, value="value", block=EMA_BLOCK):
    """Exponential smoothing; the first value of a run is its seed.

    Positions are cut into blocks. Inside a block the recursion is a scaled
    running sum; the block ends are carried by the same recursion with the decay
    of a whole block, level by level. The block length follows from ``alpha``
    (at most ``block``), so any alpha in (0, 1] works. No task ever sorts a whole
    run, and nothing that a double can hold is cut off.
    """
    if not 0 < alpha <= 1:
        raise ValueError("alpha must be in (0, 1]")
    bucket = F.floor(F.col(order) / EMA_BLOCK)
    df = row_numbers(series, [run], F.col(order), [], "_i", bucket=bucket)
    if alpha == 1:
        return df.withColumn("smooth", F.col(value).cast("double")).drop("_i")
    weight = F.when(F.col("_i") == 0, F.lit(1.0)).otherwise(F.lit(alpha))
    terms = df.withColumn("_v0", weight * F.col(value))
    return _decayed(terms, run, "_i", "_v0", 1.0 - alpha, block, 0).withColumnRenamed("_s0", "smooth").drop("_i", "_v0")


def _decayed(df, run, index, term, keep, block, level):
    """Add ``_s<level>``: the sum of all earlier terms and this one, each times
    ``keep`` to the power of its distance; ``index`` counts from 0 per run."""
    out, digits = f"_s{level}", -math.log10(keep)
    if digits > EMA_SPAN / 10:
        # So steep that terms further back than this are 0 as doubles.
        rows = W.partitionBy(run).orderBy(index)
        parts = [F.coalesce(F.lag(term, j).over(rows), F.lit(0.0)) * keep**j for j in range(1, math.ceil(330 / digits))]
        return df.withColumn(out, sum(parts, F.col(term)))
    size = max(2, min(block, int(EMA_SPAN / digits)))
    b, k, end, carry = f"_b{level}", f"_k{level}", f"_v{level + 1}", f"_s{level + 1}"
    df = df.withColumns({b: F.floor(F.col(index) / size), k: (F.col(index) % size).cast("double")})
    inside = W.partitionBy(run, b).orderBy(k).rowsBetween(W.unboundedPreceding, 0)
    scaled = F.sum(F.col(term) * F.pow(F.lit(keep), -F.col(k))).over(inside)
    df = df.withColumn("_local", scaled * F.pow(F.lit(keep), F.col(k)))
    ends = df.groupBy(run, b).agg(F.max_by("_local", k).alias(end))
    carried = _decayed(ends, run, b, end, keep**size, block, level + 1).select(run, (F.col(b) + 1).alias(b), carry)
    joined = df.join(carried, [run, b], "left")
    total = F.col("_local") + F.coalesce(carry, F.lit(0.0)) * F.pow(F.lit(keep), F.col(k) + 1)
    return joined.withColumn(out, total).drop(b, k, "_local", carry)
