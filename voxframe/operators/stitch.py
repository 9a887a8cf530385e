"""Overlap blending, ensemble voting, encoding, rasterising."""

import math

from pyspark.sql import functions as F

from voxframe.functions.scalar import binarize_u8, encode_prob_u8
from voxframe.operators import kernels
from voxframe.session import spread

AXES = "zyx"


def blend_tiles(preds, keys, patch, edge, gaussian=True, owner=False, sigma=None):
    """Weighted mean of overlapping window predictions, as chunk rows.

    ``preds``: dense rows of ``patch``^3 cells (*keys, w{a}0 window corner,
    data). With ``owner`` the columns z0, z1, y0 ... bound the box a window's
    super-tile owns, and nothing outside it is kept, so every voxel has one
    owner. A window is cut at the chunk borders of the output inside its own
    row; what moves is one array per (window, chunk), never single voxels. The
    windows over one chunk are bounded by the overlap. Returns (*keys, cz, cy,
    cx, dz, dy, dx, data) with 0 where nothing was predicted.
    """
    lo = {a: F.greatest(F.col(f"w{a}0"), F.col(f"{a}0")) if owner else F.col(f"w{a}0") for a in AXES}
    end = {a: F.col(f"w{a}0") + patch for a in AXES}
    hi = {a: F.least(end[a], F.col(f"{a}1")) if owner else end[a] for a in AXES}
    bounds = {f"{n}{a}": v[a].cast("long") for n, v in (("w", {a: F.col(f"w{a}0") for a in AXES}), ("lo", lo), ("hi", hi)) for a in AXES}
    rows = preds.select(*keys, *[v.alias(n) for n, v in bounds.items()], "data").dropna(subset=[*bounds, "data"])
    pieces = kernels.window_pieces(rows, keys, patch, edge)
    chunk = [*keys, "cz", "cy", "cx"]
    # Pieces move as they are; the order of a sum is that of their places.
    grouped = pieces.repartition(*chunk).groupBy(*chunk).agg(F.sort_array(F.collect_list(F.struct("place", "p"))).alias("_p"))
    width = float(sigma) if sigma else patch / 8.0
    profile = gaussian_profile(patch, width) if gaussian else [1.0] * patch
    blended = kernels.blend(F.col("_p"), profile, edge)
    ready = kernels.pin(grouped, "_p")
    return ready.select(*chunk, *[F.lit(edge).alias(f"d{a}") for a in AXES], blended.alias("data"))


def gaussian_profile(patch, sigma):
    """Weight along one axis of a window, largest value 1."""
    mid = (patch - 1) / 2.0
    raw = [math.exp(-((i - mid) ** 2) / (2.0 * sigma * sigma)) for i in range(patch)]
    return [v / max(raw) for v in raw]


def ensemble_vote(preds, keys, thr=0.5):
    """Share of members above the threshold; majority mask from share 0.5."""
    share = F.avg(F.when(F.col("prob") > thr, F.lit(1.0)).otherwise(F.lit(0.0)))
    return preds.groupBy(*keys).agg(share.alias("share")).withColumn("mask", (F.col("share") >= 0.5).cast("int"))


def ensemble_disagreement(preds, keys):
    """Population variance of the members' predictions per voxel."""
    return preds.groupBy(*keys).agg(F.var_pop("prob").alias("variance"))


def encode_and_binarize(preds, thr=0.5):
    """8-bit code of a probability and its thresholded mask."""
    return preds.withColumn("code", encode_prob_u8(F.col("prob"))).withColumn(
        "mask", binarize_u8(F.col("code"), thr)
    )


def foreground_share(masked, keys):
    return masked.groupBy(*keys).agg(F.avg("mask").alias("foreground"))


def rasterize_spheres(points, keys, radius_um, voxel_mm, shape):
    """Union of balls of a physical radius around points, in anisotropic voxels."""
    r2, lo, hi, step = float(radius_um) ** 2, {}, {}, {}
    for a, mm, size in zip(AXES, voxel_mm, shape):
        reach = radius_um / (mm * 1000.0)
        lo[a] = F.greatest(F.lit(0), F.floor(F.col(a) - reach).cast("int"))
        hi[a] = F.least(F.lit(size), F.ceil(F.col(a) + reach).cast("int") + 1) - 1
        step[a] = lambda at, a=a, mm=mm: (at - F.col(a)) * F.lit(mm) * 1000.0
    cells = {a: F.when(lo[a] <= hi[a], F.sequence(lo[a], hi[a])).otherwise(F.array().cast("array<int>")) for a in "zy"}
    # Small files of points must not stay one task; points that are the same count once.
    df = points.select(*keys, *AXES).repartition(spread(points.sparkSession), *keys, *AXES)
    df = df.withColumn("_z", F.explode(cells["z"])).withColumn("_y", F.explode(cells["y"]))
    dz, dy = step["z"](F.col("_z")), step["y"](F.col("_y"))
    flat = F.lit(0.0) + dz * dz + dy * dy
    inside = lambda x: F.col("_d2") + step["x"](x) * step["x"](x) <= r2
    # The ends of a line by the root, then put right by the exact test.
    half = F.sqrt(F.lit(r2) - F.col("_d2")) / F.lit(voxel_mm[2] * 1000.0)
    first, last = F.ceil(F.col("x") - half).cast("int"), F.floor(F.col("x") + half).cast("int")
    first = F.when(inside(first - 1), first - 1).when(inside(first), first).otherwise(first + 1)
    last = F.when(inside(last + 1), last + 1).when(inside(last), last).otherwise(last - 1)
    lines = df.withColumn("_d2", flat).filter(F.col("_d2") <= r2)
    # What moves and is merged is one line of a ball, never single voxels.
    lines = lines.select(*keys, "_z", "_y", F.greatest(first, lo["x"]).alias("_x0"), F.least(last, hi["x"]).alias("_x1"))
    lines = lines.filter("_x0 <= _x1").distinct()
    merged = lines.groupBy(*keys, "_z", "_y").agg(F.collect_list(F.sequence("_x0", "_x1")).alias("_x"))
    x = F.explode(F.array_distinct(F.flatten("_x")))
    return merged.select(*keys, F.col("_z").alias("z"), F.col("_y").alias("y"), x.alias("x"))


def overlap_share(candidate, reference, keys, variant, thr):
    """Share of reference voxels that each variant covers, both above ``thr``.

    ``reference``: (keys, i, j, k, value); ``candidate`` adds ``variant``.
    """
    ref = reference.filter(F.col("value") > thr)
    total = ref.groupBy(*keys).agg(F.count("*").alias("_ref"))
    cand = candidate.filter(F.col("value") > thr)
    hits = (
        cand.join(ref.select(*keys, "i", "j", "k"), [*keys, "i", "j", "k"])
        .groupBy(*keys, variant)
        .agg(F.count("*").alias("_hit"))
    )
    variants = cand.select(*keys, variant).distinct()
    return (
        variants.join(total, list(keys))
        .join(hits, [*keys, variant], "left")
        .select(*keys, variant, (F.coalesce("_hit", F.lit(0)) / F.col("_ref")).alias("share"))
    )
