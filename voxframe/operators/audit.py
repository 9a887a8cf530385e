"""Quality audit of labelled patches."""

from pyspark.sql import functions as F

from voxframe.operators import components as cc
from voxframe.operators import filters, histogram, kernels

# Window of the local mean, thresholds of the flags.
LOCAL_FILTER_SIZE = 15
HEAVY_TAIL_RATIO = 10
HEAVY_TAIL_FRACTION = 0.02
HEAVY_TAIL_DIM = 0.30
SPARSE_FRACTION = 0.015
NEGATIVE_SHARE = 0.20
TINY_SHARE = 0.50
LOW_LOCAL_RATIO = 1.10


def component_values(components, patches, keys, arrays):
    """Component voxels with the values of dense arrays at their place.

    The positives of a patch are collected (bounded by its shape) and meet the
    one dense row of that patch; dense voxels are never exploded or shuffled.
    """
    e = F.struct("component", "z", "y", "x")
    grouped = components.repartition(*keys).groupBy(*keys).agg(F.collect_list(e).alias("_v"))
    joined = patches.select(*keys, "dy", "dx", *arrays.values()).join(grouped, list(keys))
    return kernels.cells_at(joined, keys, "_v", {c: n for n, c in arrays.items()})


def audit_flags(batch_expected="expected_sparse"):
    """Flags of an audit record; none without components."""
    n = F.greatest(F.col("n_components"), F.lit(1))
    dim = (F.col("comp_neg") + F.col("comp_borderline")) / n
    tiny = (F.col("b_0_5") + F.col("b_5_10")) / n
    heavy = F.col("max_over_p99") > HEAVY_TAIL_RATIO
    tests = [
        (heavy & (F.col("gold_fraction") > HEAVY_TAIL_FRACTION) & (dim > HEAVY_TAIL_DIM), "HEAVY_TAIL_OVERSEG"),
        (F.col(batch_expected) & heavy & (F.col("gold_fraction") > SPARSE_FRACTION), "SPARSE_EXPECTED"),
        (F.col("comp_neg") / n > NEGATIVE_SHARE, "NEG_NORM_COMPONENTS"),
        (tiny > TINY_SHARE, "TINY_DOMINATED"),
        (F.col("mean_local_ratio") < LOW_LOCAL_RATIO, "LOW_CONFIDENCE"),
    ]
    flags = F.array_compact(F.array(*[F.when(t, F.lit(name)) for t, name in tests]))
    return F.when(F.col("n_components") > 0, flags).otherwise(F.array().cast("array<string>"))


def audit_patches(patches, components, keys, n_voxels, sparse_batch=None):
    """One audit record per patch.

    ``patches``: dense rows with ``data`` (raw) and ``norm``; ``components``:
    labelled mask voxels; ``sparse_batch``: condition of patches where sparse
    signal is expected.
    """
    local = filters.uniform_filter(patches, LOCAL_FILTER_SIZE, out="local")
    values = component_values(components, local, keys, {"norm": "norm", "raw": "data", "local": "local"})
    stats = (
        values.groupBy(*keys, "component")
        .agg(
            F.count("*").alias("size"),
            F.avg("norm").alias("mean_norm"),
            F.avg("raw").alias("mean_raw"),
            F.avg("local").alias("mean_local"),
        )
        .withColumn("ratio", F.when(F.col("mean_local") > 1e-6, F.col("mean_raw") / F.col("mean_local")))
    )
    per_patch = stats.groupBy(*keys).agg(
        F.count("*").alias("n_components"),
        F.sum("size").alias("labeled_voxels"),
        *cc.confidence_columns(),
        *cc.size_bin_columns(),
        F.avg("ratio").alias("mean_local_ratio"),
    )
    spread = histogram.distribution_stats(patches, [*keys, *_extra(sparse_batch)], "norm")
    record = spread.join(per_patch, list(keys), "left")
    counts = [c for c in per_patch.columns if c not in (*keys, "mean_local_ratio")]
    record = record.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in counts})
    record = record.withColumns(
        {
            "mean_local_ratio": F.coalesce("mean_local_ratio", F.lit(0.0)),
            "gold_fraction": F.col("labeled_voxels") / float(n_voxels),
        }
    )
    if sparse_batch is None:
        record = record.withColumn("expected_sparse", F.lit(False))
    return record.withColumn("flags", audit_flags()).drop("expected_sparse")


def _extra(sparse_batch):
    return [] if sparse_batch is None else [sparse_batch.alias("expected_sparse")]


def audit_report(records, key, k=10):
    """(count per flag, flagged share, top k suspects by flag count then id)."""
    flags = records.select(F.explode("flags").alias("flag")).groupBy("flag").agg(F.count("*").alias("n"))
    n = F.size("flags")
    share = records.agg(
        F.count("*").alias("n_total"),
        F.count_if(n > 0).alias("n_flagged"),
        (F.count_if(n > 0) / F.greatest(F.count("*"), F.lit(1))).alias("share"),
    )
    top = records.filter(n > 0).select(key, n.alias("n_flags"), "flags").orderBy(F.desc("n_flags"), key).limit(k)
    return flags, share, top
