"""Quotas, seeded sampling, splits and batch plans."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxframe.functions.scalar import hash_between, hash_rank, hash_uniform
from voxframe.operators.ranking import row_numbers, top_k_per_group


def allocate_quota(groups, n):
    """Rounded share of ``n`` per weighted group; the last group takes the rest.

    ``groups``: (pos, name, weight), the few region groups of a configuration.
    """
    share = F.bround(F.lit(n) * F.col("weight") / F.col("_total"), 0).cast("bigint")
    total = groups.agg(F.sum("weight"), F.max("pos")).toDF("_total", "_last")
    order = W.orderBy("pos")
    return (
        groups.withColumn("_total", total.select("_total").scalar())
        .withColumn("_last", total.select("_last").scalar())
        .withColumn("_share", share)
        .withColumn("_before", F.sum("_share").over(order.rowsBetween(W.unboundedPreceding, -1)))
        .withColumn(
            "quota",
            F.when(F.col("pos") == F.col("_last"), F.lit(n) - F.coalesce("_before", F.lit(0))).otherwise(
                F.col("_share")
            ),
        )
        .drop("_total", "_last", "_share", "_before")
    )


def _per_group(df, quotas):
    """Every row of ``df`` once per group; the group list is a scalar value."""
    packed = quotas.agg(
        F.sort_array(F.collect_list(F.struct(F.col("pos").alias("group_pos"), F.col("name").alias("group_name"), "quota")))
    )
    return df.withColumn("_g", F.explode(packed.scalar())).select("*", "_g.*").drop("_g")


def spread_even(quotas, subjects):
    """Even share per subject; the remainder goes to the first subjects.

    ``subjects.pos`` is a dense 0-based index.
    """
    n = subjects.agg(F.count("*")).scalar()
    share = F.floor(F.col("quota") / F.col("_s")) + (F.col("pos") < F.col("quota") % F.col("_s")).cast("bigint")
    return (
        _per_group(subjects, quotas)
        .withColumn("_s", n)
        .withColumn("n", share)
        .filter("n > 0")
        .drop("_s", "quota")
    )


def spread_round_robin(quotas, subjects, seed, key="subject_id"):
    """Deal each quota over a shuffled subject order, then shuffle the deals."""
    per_group = _per_group(subjects, quotas)
    order = row_numbers(
        per_group, ["group_name"], hash_rank(seed, "group_name", key), [key], "slot"
    ).select("group_name", "slot", key)
    n = subjects.agg(F.count("*")).scalar()
    deals = (
        quotas.filter("quota > 0")
        .select(F.col("name").alias("group_name"), F.explode(F.sequence(F.lit(0), F.col("quota") - 1)).alias("i"))
        .withColumn("_s", n)
        .withColumn("slot", F.col("i") % F.col("_s"))
        .drop("_s")
    )
    dealt = deals.join(order, ["group_name", "slot"]).drop("slot")
    return row_numbers(dealt, [], hash_rank(f"{seed}-deal", "group_name", "i"), ["group_name", "i"])


def sample_region_centers(label_voxels, labels, quota, seed, by="volume_id"):
    """``quota`` random voxels inside each region group of each subject.

    ``labels``: (label, group_name); ``quota``: (group_name, n) or
    (by, group_name, n), of any size.
    """
    keys = [by, "group_name"] if by in quota.columns else ["group_name"]
    tagged = label_voxels.join(labels, "label").join(quota, keys)
    cell = [by, "z", "y", "x"]
    ranked = tagged.withColumn("_h", hash_rank(seed, *cell))
    return top_k_per_group(
        ranked, [by, "group_name"], F.col("n"), ["_h", "z", "y", "x"], ["z", "y", "x"]
    ).drop("_h", "n")


def sample_n(df, n, seed, key):
    """``n`` rows without replacement; every row if there are fewer."""
    return df.orderBy(hash_rank(seed, key), key).limit(n)


def sample_per_group(df, by, k, seed, key, strict=False):
    """``k`` rows of each group; with ``strict`` a short group is an error."""
    ranked = df.withColumn("_h", hash_rank(seed, by, key))
    picked = top_k_per_group(ranked, [by], k, ["_h", key], [key]).drop("_h")
    if strict:
        sizes = df.groupBy(by).agg(F.count("*").alias("_size"))
        enough = F.assert_true(F.col("_size") >= k, F.format_string("group %s is short", F.col(by).cast("string")))
        picked = picked.join(sizes, by).filter(enough.isNull()).drop("_size")
    return picked


def seeded_shuffle(df, seed, key, name="pos"):
    """Position of each row in a seeded random order."""
    return row_numbers(df, [], hash_rank(seed, key), [key], name)


def group_split(df, group, frac, seed, explicit=None):
    """Hold out whole groups: max(1, round(S * frac)) of them, or a given list."""
    if explicit is not None:
        held = F.col(group).isin(*explicit)
        return df.withColumn("split", F.when(held, "val").otherwise("train"))
    groups = df.select(group).distinct()
    n = groups.agg(F.greatest(F.lit(1), F.bround(F.count("*") * F.lit(float(frac)), 0)).cast("bigint")).scalar()
    val = (
        row_numbers(groups, [], hash_rank(seed, group), [group], "_pos")
        .filter(F.col("_pos") < n)
        .select(group, F.lit("val").alias("_split"))
    )
    return (
        df.join(val, group, "left")
        .withColumn("split", F.coalesce("_split", F.lit("train")))
        .drop("_split")
    )


def repeat_rows(df, r, name="copy"):
    """Every row max(1, r) times, numbered from 1."""
    return df.withColumn(name, F.explode(F.sequence(F.lit(1), F.lit(max(1, int(r))))))


def crop_pairs(df, key, crop, overlap, seed, dims=("dim_z", "dim_y", "dim_x")):
    """Two crop origins per patch with a bounded offset per axis."""
    reach = int(crop * (1.0 - overlap))
    out = df
    for d, axis in zip(dims, "zyx"):
        room = F.col(d) - crop
        room = F.when(room >= 0, room).otherwise(
            F.raise_error(F.format_string("patch too small for crop %d", F.lit(crop))).cast("int")
        )
        first = hash_between(f"{seed}-a{axis}", 0, room, key)
        out = out.withColumn(f"{axis}1", first)
        lo = F.greatest(F.lit(0), F.col(f"{axis}1") - reach)
        hi = F.least(room, F.col(f"{axis}1") + reach)
        out = out.withColumn(f"{axis}2", hash_between(f"{seed}-b{axis}", lo, hi, key))
    return out


def plan_batches(df, batch, seed, key, drop_last=True):
    """Shuffled batch number of every row for one epoch."""
    planned = seeded_shuffle(df, seed, key).withColumn(
        "batch", F.floor(F.col("pos") / batch).cast("bigint")
    )
    if not drop_last:
        return planned
    full = df.agg(F.floor(F.count("*") / batch)).scalar()
    return planned.filter(F.col("batch") < full)


def middle_slab_sample(grid, n, seed, volume="volume_id", key="patch_id", bright=None):
    """``n`` random tiles of the middle z row of each volume's grid.

    With ``bright``, the tiles (volume, key) that ``keys.drop_dark_patches``
    kept, dark tiles are skipped; the middle row is that of the whole grid.
    """
    mid = grid.groupBy(volume).agg(F.sort_array(F.collect_set("gz")).alias("_zs")).select(
        volume, F.element_at("_zs", (F.floor(F.size("_zs") / 2) + 1).cast("int")).alias("gz")
    )
    slab = grid.join(mid, [volume, "gz"], "left_semi")
    if bright is not None:
        slab = slab.join(bright.select(volume, key), [volume, key], "left_semi")
    slab = slab.withColumn("_h", hash_rank(seed, volume, key))
    return top_k_per_group(slab, [volume], n, ["_h", key], [key]).drop("_h")


def substitute_failed(df, pos, failed, seed, payload):
    """Replace a failed row by a random other row, or by zeros if that failed too.

    ``pos`` is a dense 0-based index. Only failed rows take part in the self
    join, on the drawn position.
    """
    n = df.agg(F.count("*")).scalar()
    fine = df.filter(~F.col(failed)).withColumn("source_pos", F.col(pos))
    drawn = (
        df.filter(F.col(failed))
        .withColumn("_n", n)
        .withColumn("source_pos", F.floor(hash_uniform(seed, pos) * F.col("_n")).cast("bigint"))
    )
    donors = df.select(
        F.col(pos).alias("source_pos"), F.col(failed).alias("_donor_failed"), F.col(payload).alias("_donor")
    )
    value = F.when(F.col("_donor_failed"), F.lit(0.0)).otherwise(F.col("_donor"))
    replaced = drawn.join(donors, "source_pos").withColumn(payload, value)
    return fine.unionByName(replaced.select(*fine.columns))
