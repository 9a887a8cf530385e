"""Percentiles, histograms and Otsu thresholds of dense rows."""

from pyspark.sql import functions as F

from voxframe.functions.scalar import let, unflatten_index
from voxframe.operators import kernels
from voxframe.operators.dense import _fill

# Percentiles of the distribution record.
AUDIT_PERCENTILES = {"p90": 90.0, "p95": 95.0, "p99": 99.0, "p99_5": 99.5, "p99_9": 99.9}


def percentile_of_sorted(a, pct):
    """Linear interpolation between closest ranks of a sorted array."""
    pos = F.lit(pct / 100.0) * (F.size(a) - 1)
    low = F.floor(pos).cast("int")
    lo = F.get(a, low)
    hi = F.get(a, F.least(low + 1, F.size(a) - 1))
    return lo + (hi - lo) * (pos - low)


def _finite(v):
    return ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))


def distribution_stats(patches, keys, data="data"):
    """Upper percentiles, max and max / p99 of the finite voxels.

    One sort per patch row and no shuffle. ``max_over_p99`` is infinite when p99
    is not positive; everything is 0 without finite voxels.
    """

    def stats(a):
        fields = [percentile_of_sorted(a, p).alias(n) for n, p in AUDIT_PERCENTILES.items()]
        return F.struct(*fields, F.element_at(a, -1).alias("max"))

    clean = F.sort_array(F.filter(F.col(data), _finite))
    df = patches.withColumn("_d", let(clean, lambda a: F.when(F.size(a) > 0, stats(a))))
    out = {n: F.coalesce(F.col(f"_d.{n}"), F.lit(0.0)) for n in [*AUDIT_PERCENTILES, "max"]}
    ratio = (
        F.when(F.col("_d").isNull(), F.lit(0.0))
        .when(F.col("_d.p99") > 0, F.col("_d.max") / F.col("_d.p99"))
        .otherwise(F.lit(float("inf")))
    )
    return df.select(*keys, *[v.alias(n) for n, v in out.items()], ratio.alias("max_over_p99"))


def percentile_range(patches, keys, lo=5.0, hi=99.5, ignore_zeros=True):
    """Robust intensity range; (0, 1) if empty, hi = lo + 1 if not above lo."""
    keep = (lambda v: _finite(v) & (v > 0)) if ignore_zeros else _finite
    both = let(
        F.sort_array(F.filter("data", keep)),
        lambda a: F.when(
            F.size(a) > 0,
            F.struct(percentile_of_sorted(a, lo).alias("lo"), percentile_of_sorted(a, hi).alias("hi")),
        ),
    )
    df = patches.withColumn("_r", both)
    low = F.coalesce(F.col("_r.lo"), F.lit(0.0))
    high = F.coalesce(F.col("_r.hi"), F.lit(1.0))
    return df.select(*keys, low.alias("lo"), F.when(high > low, high).otherwise(low + 1.0).alias("hi"))


def histogram(patches, keys, bins=256):
    """Equal-width counts over [min, max] of each patch: (keys, lo, hi, bin, n).

    Voxels are counted in their own row; at most ``bins`` rows per patch move.
    """
    ends = kernels.pin(patches).select(*keys, F.array_min("data").alias("lo"), F.array_max("data").alias("hi"), "data")
    counts = ends.select(*keys, "lo", "hi", kernels.histogram(F.col("data"), F.col("lo"), F.col("hi"), bins).alias("_n"))
    rows = counts.select(*keys, "lo", "hi", F.posexplode("_n").alias("bin", "n")).filter("n > 0")
    return rows.groupBy(*keys, "lo", "hi", "bin").agg(F.sum("n").alias("n"))


def multi_otsu(hist, keys, classes=2, bins=256):
    """Last threshold that maximises the between-class variance, as a bin centre.

    Candidates are scanned inside the patch's own row of ``bins`` counts, so
    nothing is emitted per pair of thresholds. Null where there are fewer
    distinct bins than classes; the mask is then empty.
    """
    if classes not in (2, 3):
        raise ValueError("classes must be 2 or 3")
    entry = F.struct(F.col("bin").alias("idx"), F.col("n").cast("double").alias("value"))
    c = hist.groupBy(*keys, "lo", "hi").agg(F.sort_array(F.collect_list(entry)).alias("_e"))
    used = F.size("_e")
    last = (
        F.when(used < classes, F.lit(None).cast("int"))
        .when(used == classes, F.try_element_at("_e", F.lit(-2))["idx"])
        .otherwise(F.col("_best"))
    )
    c = c.withColumn("_best", kernels.otsu_index(_fill(F.col("_e"), bins, F.lit(0.0)), classes))
    width = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    return c.withColumn("bin", last).select(
        *keys, "bin", (F.col("lo") + (F.col("bin") + 0.5) * width).alias("threshold")
    )


def mask_above(patches, thresholds, keys):
    """Sparse mask of voxels above their patch's threshold; none where it is null."""
    joined = patches.join(thresholds.filter("threshold is not null").select(*keys, "threshold"), list(keys))
    rows = joined.select(*keys, "threshold", "dy", "dx", F.posexplode("data").alias("_i", "value"))
    z, y, x = unflatten_index(F.col("_i"), F.col("dy"), F.col("dx"))
    return rows.filter("value > threshold").select(*keys, z.alias("z"), y.alias("y"), x.alias("x"))
