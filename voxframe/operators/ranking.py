"""Numbering and top-k that hold when one group owns a large share of the rows."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

RANK_BITS = 32


def row_numbers(df, by, rank, ties, name="pos", bits=12, bucket=None):
    """0-based position of each row within ``by``, in the order (rank, ties).

    ``rank`` is a uniform 32-bit hash. Its top bits split a group into 2^bits
    buckets of near equal size, so no task sorts a whole group: each bucket is
    numbered by itself and shifted by the number of rows in earlier buckets.
    Only the per-bucket counts pass through the offset window. For other
    orders, pass a ``bucket`` column that never decreases with the rank.
    """
    by = list(by)
    top = F.shiftright("_rank", RANK_BITS - bits).cast("int") if bucket is None else bucket
    keyed = df.withColumn("_rank", rank).withColumn("_bucket", top)
    before = W.partitionBy(*by).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        keyed.groupBy(*by, "_bucket")
        .agg(F.count("*").alias("_n"))
        .withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    inside = W.partitionBy(*by, "_bucket").orderBy("_rank", *ties)
    return (
        keyed.join(offsets, [*by, "_bucket"])
        .withColumn(name, F.row_number().over(inside) - 1 + F.col("_offset"))
        .drop("_rank", "_bucket", "_offset")
    )


def top_k_per_group(df, by, k, order, salt_key, salts=64):
    """The first ``k`` rows of each group; ``k`` may be a column.

    A salted first pass leaves at most salts * k rows per group, so the exact
    second pass never sees a whole hot group. With a number, Spark cuts each
    group before the shuffle, too (WindowGroupLimit).
    """
    k = F.lit(k) if isinstance(k, int) else k
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*salt_key), F.lit(salts)))
    for part in ([*by, "_salt"], by):
        salted = salted.withColumn("_rn", F.row_number().over(W.partitionBy(*part).orderBy(*order)))
        salted = salted.filter(F.col("_rn") <= k)
    return salted.drop("_salt", "_rn")


def with_group_agg(df, by, *aggs):
    """Attach group aggregates by aggregate-and-join.

    Unlike an aggregate over a window this combines on the map side and never
    moves a whole group to one task.
    """
    return df.join(df.groupBy(*by).agg(*aggs), by)


def first_by(df, by, order, keep):
    """One row per group: the smallest ``order`` tuple, by a combinable min."""
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    packed = F.struct(
        *[o.alias(f"o{i}") for i, o in enumerate(order)], F.struct(*keep).alias("row")
    )
    return df.groupBy(*by).agg(F.min(packed).alias("_m")).select(*by, "_m.row.*")
