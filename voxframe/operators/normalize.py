"""Normalisation of dense rows and reference statistics.

Everything here is a projection over patch rows: no shuffle. Only the pooling
of reference statistics aggregates, over a few numbers per patch.
"""

from pyspark.sql import functions as F

from voxframe.functions.scalar import array_sum, let
from voxframe.operators import kernels
from voxframe.session import ensure_checkpoint_dir


def moments(data, ddof=0):
    """Struct (n, mean, sd) of an array; sd over n - ddof."""
    def with_mean(m):
        ss = F.aggregate(data, F.lit(0.0), lambda a, v: a + (v - m) * (v - m))
        return F.struct(
            F.size(data).alias("n"), m.alias("mean"), F.sqrt(ss / (F.size(data) - ddof)).alias("sd")
        )

    return let(array_sum(data) / F.size(data), with_mean)


def zscore(patches, degenerate="keep", eps=1e-8):
    """(v - mean) / sd per patch, population sd.

    A flat patch is left as it is ('keep': sd <= eps) or centred ('center':
    sd < eps).
    """
    return kernels.pin(patches).withColumn("data", kernels.zscore(F.col("data"), degenerate != "keep", eps))


def zscore_valid(patches, valid, min_valid=4096, eps=1e-8):
    """Z-score by the voxels where ``valid`` (array of 0/1) is set; others become 0.

    Patches with fewer than ``min_valid`` valid voxels are dropped.
    """
    ready = kernels.pin(kernels.pin(patches), valid)
    return ready.withColumn("data", kernels.zscore_valid(F.col("data"), F.col(valid), min_valid, eps)).filter("data IS NOT NULL")


def minmax(patches, eps=1e-8):
    """Scale to [0, 1]; unchanged if the range is at most eps."""
    return kernels.pin(patches).withColumn("data", kernels.minmax(F.col("data"), eps))


def window_stats(patches, raw="data", corrected="data", min_valid=5000, keys=("patch_id",)):
    """mu, sigma, n over voxels with raw > 0; null if too few or flat."""
    ready = kernels.pin(kernels.pin(patches, raw), corrected)
    m = ready.select(*keys, kernels.positive_moments(F.col(raw), F.col(corrected)).alias("_m"))
    n, mean, sd = (F.get("_m", F.lit(i)) for i in range(3))
    enough = F.when(n >= min_valid, F.struct(n.cast("int").alias("n"), mean.alias("mean"), sd.alias("sd")))
    s = m.withColumn("_s", enough).withColumn("_ok", F.col("_s.sd") >= 1e-6)
    return s.select(
        *keys,
        F.when(F.col("_ok"), F.col("_s.mean")).alias("mu"),
        F.when(F.col("_ok"), F.col("_s.sd")).alias("sigma"),
        F.when(F.col("_ok"), F.col("_s.n")).alias("n_valid"),
    )


def global_stats(chunks, by, min_valid=1000, pct=0.05, missing=(0.0, 1.0), raw="data", corrected=None):
    """Foreground mean and sd of whole volumes stored as chunk rows.

    Foreground is what the ``raw`` intensities put above the 5th percentile of
    their non-zero voxels if there are more than ``min_valid`` of those, else
    above 0, and what is above 0 in ``corrected`` too. Mean and population sd are
    those of the ``corrected`` values there (by default of the raw ones). Volumes
    with at most ``min_valid`` such voxels get ``missing``, null arrays count as
    empty ones, and voxels that are NaN or not above 0 belong to no foreground.

    One pass over the voxels, in their own rows: a chunk becomes one row per
    distinct raw value, with the numbers that merge (``kernels.moments_by_value``).
    16-bit data has at most 65,536 of them. These rows are stored; cut, mean and
    deviations are three sums over them, so nothing that is large cancels.
    """
    ensure_checkpoint_dir(chunks.sparkSession)
    rows = kernels.moments_by_value(chunks, by, raw, corrected or raw).checkpoint()
    counts = rows.groupBy(*by, "v").agg(F.sum("n_raw").alias("n_raw"))
    cut = counts.groupBy(*by).agg(F.sum("n_raw").alias("_nz"), F.percentile("v", F.lit(pct), F.col("n_raw")).alias("_p"))
    above = F.col("v") > F.when(F.col("_nz") > min_valid, F.col("_p")).otherwise(F.lit(0.0))
    fore = rows.join(cut, list(by)).filter(above & (F.col("n") > 0))
    mean = fore.groupBy(*by).agg(F.sum("n").alias("n_fore"), (F.sum(F.col("mean") * F.col("n")) / F.sum("n")).alias("_m"))
    gap = F.col("mean") - F.col("_m")
    found = fore.join(mean, list(by)).groupBy(*by).agg(
        F.first("n_fore").alias("n_fore"), F.first("_m").alias("_m"), F.sum(F.col("m2") + F.col("n") * gap * gap).alias("_ss")
    )
    # Volumes without foreground (flat or empty ones) have a row, too.
    stats = chunks.select(*by).distinct().join(found, list(by), "left").withColumn("n_fore", F.coalesce("n_fore", F.lit(0)))
    few = F.col("n_fore") <= min_valid
    return stats.select(
        *by,
        "n_fore",
        F.when(few, F.lit(missing[0])).otherwise(F.col("_m")).alias("mu"),
        F.when(few, F.lit(missing[1])).otherwise(F.sqrt(F.col("_ss") / F.col("n_fore"))).alias("sigma"),
    )


def pool_reference_stats(stats, global_, by=("patch_id",), ref=("ref_dataset", "ref_subject")):
    """Mean of mu and root mean variance over a patch's references.

    A reference without window statistics falls back to its global ones and is
    marked ``[global]``. ``stats``: (*by, *ref, mu, sigma); ``global_``:
    (*ref, global_mu, global_sigma).
    """
    name = F.concat_ws("/", *[F.col(r) for r in ref])
    fell = F.col("mu").isNull()
    df = stats.join(global_, list(ref), "left").withColumns(
        {
            "_mu": F.coalesce("mu", "global_mu"),
            "_var": F.pow(F.coalesce("sigma", "global_sigma"), F.lit(2.0)),
            "_fell": fell.cast("int"),
            "_name": F.when(fell, F.concat(name, F.lit("[global]"))).otherwise(name),
        }
    )
    return df.groupBy(*by).agg(
        F.avg("_mu").alias("mu"),
        F.sqrt(F.avg("_var")).alias("sigma"),
        F.sum("_fell").alias("fallback_count"),
        F.sort_array(F.collect_list("_name")).alias("references"),
    )


def reference_zscore(patches, mu="mu", sigma="sigma"):
    """(v - mu) / max(sigma, 1e-6) with columns of the same row."""
    scale = F.greatest(F.col(sigma), F.lit(1e-6))
    return kernels.pin(patches).withColumn("data", kernels.affine(F.col("data"), F.col(mu).cast("double"), scale.cast("double")))


def bias_correct(patches, fields, on, scale, origin=("z0", "y0", "x0")):
    """Divide by a low-resolution bias field, sampled linearly; 1 outside it.

    ``fields``: (on, bz, by, bx, bias) one dense row per volume; ``scale``: bias
    voxels per image voxel (z, y, x); ``origin``: window corner columns. Only
    field rows are joined, so no voxel is shuffled.
    """
    df = kernels.pin(kernels.pin(patches.join(fields, on), "bias"))
    columns = lambda names: [F.col(n) for n in names]
    data = kernels.over_field(
        F.col("data"), columns(("dz", "dy", "dx")), columns(origin), F.col("bias"), columns(("bz", "by", "bx")), [float(k) for k in scale]
    )
    return df.withColumn("data", data).drop("bz", "by", "bx", "bias")
