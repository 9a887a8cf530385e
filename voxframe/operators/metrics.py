"""Segmentation and embedding scores."""

from pyspark.sql import functions as F

from voxframe.functions.scalar import cosine, sigmoid
from voxframe.operators import components as cc
from voxframe.operators import kernels

# Weight of each deep-supervision level.
LEVEL_WEIGHTS = [1.0, 0.5, 0.25, 0.125, 0.0625]


def dice(pred, truth, by, on, smooth=1, patches=None):
    """(2I + s) / (P + T + s) of sparse masks per ``by`` (a batch or a patch).

    A sparse mask does not show empty patches: with the list of ``patches``
    those that are empty on both sides get their 1.0.
    """
    p = pred.select(*on).withColumn("_p", F.lit(1))
    t = truth.select(*on).withColumn("_t", F.lit(1))
    both = p.join(t, list(on), "full_outer")
    if patches is not None:
        both = patches.select(*by).distinct().join(both, list(by), "left")
    hit = F.count_if(F.col("_p").isNotNull() & F.col("_t").isNotNull())
    score = (2 * hit + smooth) / (F.count("_p") + F.count("_t") + smooth)
    return both.groupBy(*by).agg(score.alias("dice"))


def _soft_dice(p, t, smooth):
    inter, union = F.sum(p * t), F.sum(p) + F.sum(t)
    return 1.0 - (2.0 * inter + smooth) / (union + smooth)


def bce_with_logits(x, t):
    """Stable element-wise binary cross entropy of a logit column."""
    return F.greatest(x, F.lit(0.0)) - x * t + F.log1p(F.exp(-F.abs(x)))


def soft_dice_loss(df, by, prob="prob", truth="truth", smooth=1.0):
    """1 - soft dice per sample; average the result for the loss of a batch."""
    return df.groupBy(*by).agg(_soft_dice(F.col(prob), F.col(truth), smooth).alias("loss"))


def bce_loss(df, by, logit="logit", truth="truth"):
    return df.groupBy(*by).agg(F.avg(bce_with_logits(F.col(logit), F.col(truth))).alias("loss"))


def dice_ce(df, by, logit="logit", truth="truth", dice_weight=0.5, ce_weight=0.5):
    """Weighted soft dice of the sigmoid plus cross entropy, per sample."""
    x, t = F.col(logit), F.col(truth)
    loss = dice_weight * _soft_dice(sigmoid(x), t, 1.0) + ce_weight * F.avg(bce_with_logits(x, t))
    return df.groupBy(*by).agg(loss.alias("loss"))


def deep_supervision_score(preds, truth, keys, full, sizes, weights=LEVEL_WEIGHTS):
    """Weighted dice_ce over output levels of decreasing size.

    ``preds``: (*keys, level, z, y, x, logit) with ``sizes[level]``^3 cells;
    ``truth``: positive voxels (*keys, z, y, x) on ``full``^3 cells, read at
    floor(i * full / size). Returns (*keys, score).
    """
    size = F.element_at(F.array(*[F.lit(n) for n in sizes]), F.col("level") + 1)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), F.col("level") + 1)
    at = preds
    for a in "zyx":
        at = at.withColumn(a, F.floor(F.col(a) * F.lit(full) / size).cast("int"))
    found = at.join(truth.select(*keys, "z", "y", "x").withColumn("_t", F.lit(1.0)), [*keys, "z", "y", "x"], "left")
    found = found.withColumn("truth", F.coalesce("_t", F.lit(0.0)))
    per_level = dice_ce(found, [*keys, "level"])
    return per_level.groupBy(*keys).agg(F.sum(weight * F.col("loss")).alias("score"))


def ntxent(views, batch, temperature=0.5, similarity="cosine", pair="pair_id", vector="embedding", block=512):
    """Contrastive loss and top-1 accuracy per batch of paired views.

    Views are dealt into blocks of about ``block`` rows. Every block of anchors
    meets every block of its batch, and the log sum of exponentials is put
    together from the parts, so a batch may have any size. A view without a mate
    in its batch is an error.
    """
    if similarity not in ("cosine", "dot"):
        raise ValueError("similarity must be cosine or dot")
    sizes = views.groupBy(batch).agg(F.ceil(F.count("*") / block).alias("_blocks"))
    rows = F.sort_array(F.collect_list(F.struct(F.col(pair).alias("p"), F.col(vector).cast("array<double>").alias("v"))))
    dealt = views.join(sizes, batch).withColumn("_block", F.pmod(F.xxhash64(pair, F.col(vector).cast("string")), F.col("_blocks")))
    packed = dealt.groupBy(batch, "_block").agg(rows.alias("_r"), F.first("_blocks").alias("_blocks"))
    packed = packed.select(batch, "_block", "_blocks", F.flatten(F.transform("_r", lambda r: r["v"])).alias("_a"), F.transform("_r", lambda r: r["p"]).alias("_p"))
    others = packed.select(batch, F.col("_block").alias("_other"), F.col("_a").alias("_b"), F.col("_p").alias("_q"))
    meet = packed.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)))
    both = meet.join(others, [batch, "_other"])
    both = kernels.pin(both, "_a").withColumn("_same", F.col("_block") == F.col("_other"))
    parts = kernels.ntxent(F.col("_a"), F.col("_p"), F.col("_b"), F.col("_q"), F.col("_same"), temperature, similarity == "cosine")
    part = both.select(batch, "_block", parts.alias("_s")).select(
        batch, "_block", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("_s") - 2, F.lit(3)), lambda i: F.slice("_s", i, 3))).alias("_i", "_t")
    )
    part = part.select(batch, "_block", "_i", *[F.get("_t", F.lit(j)).alias(n) for j, n in enumerate(("_pos", "_top", "_sum"))])
    anchor = part.groupBy(batch, "_block", "_i").agg(
        F.max("_pos").alias("_pos"), F.max("_top").alias("_top"), F.collect_list(F.struct("_top", "_sum")).alias("_parts")
    )
    found = F.assert_true(F.col("_pos") > F.lit(float("-inf")), "a view has no mate in its batch").isNull()
    high = F.greatest("_pos", "_top")
    total = F.exp(F.col("_pos") - F.col("_high")) + F.aggregate(
        "_parts", F.lit(0.0), lambda acc, t: acc + F.when(t["_sum"] > 0, t["_sum"] * F.exp(t["_top"] - F.col("_high"))).otherwise(F.lit(0.0))
    )
    scored = anchor.filter(found).withColumn("_high", high)
    # the positive is listed first, so a tie counts as right
    return scored.groupBy(batch).agg(
        F.avg(F.col("_high") + F.ln(total) - F.col("_pos")).alias("loss"),
        F.avg((F.col("_pos") >= F.col("_top")).cast("double")).alias("accuracy"),
    )


def regression_loss(online, target, on, by, vector="embedding"):
    """mean(2 - 2 cos) of paired vectors per ``by``."""
    t = target.select(*on, F.col(vector).alias("_target"))
    loss = F.avg(2.0 - 2.0 * cosine(F.col(vector), F.col("_target"), 1e-12))
    return online.join(t, list(on)).groupBy(*by).agg(loss.alias("loss"))


def component_count_error(pred, truth, keys, conn=26, patches=None):
    """Object counts of two masks: difference, spurious and missed objects.

    With the list of ``patches`` those that are empty on both sides get zeros.

    A predicted object is spurious if it touches no true voxel, and a true one
    is missed if no predicted voxel touches it.
    """
    p = cc.connected_components(pred, keys, conn)
    t = cc.connected_components(truth, keys, conn)
    cell = [*keys, "z", "y", "x"]

    def count(objects, other, missed):
        touched = objects.join(other.select(*cell).withColumn("_hit", F.lit(1)), cell, "left")
        per = touched.groupBy(*keys, "component").agg(F.count("_hit").alias("_hits"))
        n = "n_pred" if missed == "spurious" else "n_truth"
        return per.groupBy(*keys).agg(F.count("*").alias(n), F.count_if(F.col("_hits") == 0).alias(missed))

    both = count(p, truth, "spurious").join(count(t, pred, "missed"), list(keys), "full_outer")
    if patches is not None:
        both = patches.select(*keys).distinct().join(both, list(keys), "left")
    zero = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("n_pred", "spurious", "n_truth", "missed")}
    return both.withColumns(zero).withColumn("count_error", F.abs(F.col("n_pred") - F.col("n_truth")))
