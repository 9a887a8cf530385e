"""Coordinates, boxes, grids and windows."""

from itertools import product

from pyspark.sql import functions as F

from voxframe.operators import kernels
from voxframe.functions.scalar import half_even, let

AXES = "zyx"

# resampled = full-resolution * scale, where no sidecar exists.
DEFAULT_SCALE_ZYX = (0.6875, 0.40625, 0.40625)


def phys_to_voxel(df, affines, on="dataset", point=("pz", "py", "px"), out="c"):
    """Physical mm to full-resolution voxels by a diagonal affine table.

    ``affines``: (on, vz, vy, vx, oz, oy, ox), voxel size and origin.
    """
    joined = df.join(affines, on)
    for axis, p in zip(AXES, point):
        joined = joined.withColumn(f"{out}{axis}", (F.col(p) - F.col(f"o{axis}")) / F.col(f"v{axis}"))
    return joined


def apply_inverse_affine(df, matrix, point=("pz", "py", "px"), out="c"):
    """Homogeneous transform by a row-major 4x4 array column that is already inverted."""
    for row, axis in enumerate(AXES):
        terms = [F.get(matrix, F.lit(4 * row + k)) * F.col(p) for k, p in enumerate(point)]
        df = df.withColumn(f"{out}{axis}", terms[0] + terms[1] + terms[2] + F.get(matrix, F.lit(4 * row + 3)))
    return df


def rescale_voxel(df, src="c", out="r", scale="s", inverse=False):
    """Full-resolution to resampled voxels, or back."""
    for axis, default in zip(AXES, DEFAULT_SCALE_ZYX):
        s = F.coalesce(F.col(f"{scale}{axis}"), F.lit(default))
        v = F.col(f"{src}{axis}")
        df = df.withColumn(f"{out}{axis}", v / s if inverse else v * s)
    return df


def box_from_center(df, um, center="c", voxel_um="u"):
    """Box of a physical side length around a centre, in anisotropic voxels."""
    for axis in AXES:
        df = df.withColumn(f"n{axis}", half_even(F.lit(float(um)) / F.col(f"{voxel_um}{axis}")))
        df = df.withColumn(f"{axis}0", half_even(F.col(f"{center}{axis}") - F.col(f"n{axis}") / 2))
        df = df.withColumn(f"{axis}1", F.col(f"{axis}0") + F.col(f"n{axis}"))
    return df


def bound(df, policy, dim="dim_", shape=None):
    """Deal with boxes that leave the volume.

    clip: cut to the volume. pad: keep the size, record the valid part
    (``{axis}_lo``, ``{axis}_hi``, box relative). reject: add ``reason``;
    with ``shape`` (z, y, x) a box of another shape is a "shape mismatch" first.
    shift: slide inside and re-derive the centre ``c{axis}``.
    """
    lo = {a: F.col(f"{a}0") for a in AXES}
    hi = {a: F.col(f"{a}1") for a in AXES}
    full = {a: F.col(f"{dim}{a}") for a in AXES}
    if policy == "clip":
        for a in AXES:
            df = df.withColumns({f"{a}0": F.greatest(F.lit(0), lo[a]), f"{a}1": F.least(full[a], hi[a])})
        return df
    if policy == "pad":
        for a in AXES:
            start = F.greatest(F.lit(0), -lo[a])
            stop = F.greatest(start, F.least(full[a], hi[a]) - lo[a])
            df = df.withColumns({f"{a}_lo": start, f"{a}_hi": stop})
        return df
    if policy == "reject":
        outside = F.lit(False)
        for a in AXES:
            outside = outside | (lo[a] < 0) | (hi[a] > full[a])
        reason = F.when(outside, "out of bounds")
        if shape is not None:
            wrong = F.lit(False)
            for a, n in zip(AXES, shape):
                wrong = wrong | (hi[a] - lo[a] != F.lit(n))
            reason = F.when(wrong, "shape mismatch").otherwise(reason)
        return df.withColumn("reason", reason)
    if policy == "shift":
        for a in AXES:
            size = hi[a] - lo[a]
            start = F.greatest(F.lit(0), F.least(lo[a], full[a] - size))
            df = df.withColumns({f"{a}0": start, f"{a}1": start + size, f"c{a}": (start + start + size) / 2.0})
        return df
    raise ValueError(f"unknown policy {policy}")


def split_rejected(df):
    """(kept rows, skipped rows with a reason)."""
    return df.filter(F.col("reason").isNull()).drop("reason"), df.filter(F.col("reason").isNotNull())


# --- grids ----------------------------------------------------------------


def tile_starts(extent, patch):
    """Starts of the full tiles of an axis; one start even if it is smaller."""
    n = F.greatest(F.lit(1), F.floor((extent - patch) / patch).cast("int") + 1)
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: i * patch)


def tile_grid(volumes, patch, mm="mm_"):
    """Non-overlapping tiles with grid index, physical origin and id."""
    df = volumes
    for a in AXES:
        df = df.select("*", F.posexplode(tile_starts(F.col(f"dim_{a}"), patch)).alias(f"g{a}", f"{a}0"))
    for a in AXES:
        df = df.withColumns(
            {
                f"{a}1": F.col(f"{a}0") + patch,
                f"phys_{a}": F.col(f"{a}0") * F.col(f"{mm}{a}"),
                f"size_{a}": F.lit(patch) * F.col(f"{mm}{a}"),
            }
        )
    return df.withColumn("patch_id", F.format_string("patch_z%02d_y%02d_x%02d", "gz", "gy", "gx"))


def match_grids(grid, mm="mm_", fine="fr_mm_", fine_dim=None, tolerance_mm=0.01):
    """The same physical boxes in a second resolution, as ``f{axis}0/1``.

    With ``fine_dim`` (prefix of the second shape) the extents must agree.
    """
    df = grid
    if fine_dim:
        off = F.lit(False)
        for a in AXES:
            gap = F.abs(F.col(f"{fine_dim}{a}") * F.col(f"{fine}{a}") - F.col(f"dim_{a}") * F.col(f"{mm}{a}"))
            off = off | (gap > tolerance_mm)
        # assert_true yields null, or fails the job on the first bad volume
        df = df.filter(F.assert_true(~off, "physical extents differ").isNull())
    for a in AXES:
        ratio = F.col(f"{mm}{a}") / F.col(f"{fine}{a}")
        start = half_even(F.col(f"{a}0") * ratio)
        df = df.withColumn(f"f{a}0", start).withColumn(
            f"f{a}1", F.col(f"f{a}0") + half_even((F.col(f"{a}1") - F.col(f"{a}0")) * ratio)
        )
    return df


def window_positions(extent, patch, stride):
    """Regular starts plus a last start flush with the end, as an array column."""
    last = extent - patch
    regular = F.sequence(F.lit(0), F.greatest(last, F.lit(0)), F.lit(stride))
    return F.when(extent <= patch, F.array(F.lit(0))).otherwise(F.array_union(regular, F.array(last)))


def window_grid(volumes, patch, stride):
    """One row per sliding window of each volume."""
    df = volumes
    for a in AXES:
        df = df.withColumn(f"{a}0", F.explode(window_positions(F.col(f"dim_{a}"), patch, stride)))
    return df


def supertile_grid(volumes, inner, patch, stride):
    """Owned inner boxes with their halo buffers.

    The inner size is rounded up to the stride; a buffer starts at
    ``{axis}0 - halo`` and is ``inner + 2 * halo`` wide.
    """
    if patch % stride:
        raise ValueError("stride must divide patch")
    halo = max(0, patch - stride)
    inner = -(-inner // stride) * stride
    df = volumes
    for a in AXES:
        d = F.col(f"dim_{a}")
        df = df.withColumn(f"{a}0", F.explode(F.sequence(F.lit(0), d - 1, F.lit(inner))))
        df = df.withColumns(
            {
                f"{a}1": F.least(d, F.col(f"{a}0") + inner),
                f"b{a}0": F.col(f"{a}0") - halo,
                f"b{a}1": F.col(f"{a}0") + inner + halo,
            }
        )
    return df.withColumns({"halo": F.lit(halo), "buffer": F.lit(inner + 2 * halo)})


def supertile_windows(tiles, patch, stride):
    """Window starts inside the buffer of each super-tile, in volume voxels."""
    df = tiles
    for a in AXES:
        steps = F.sequence(F.lit(0), F.col("buffer") - patch, F.lit(stride))
        df = df.withColumn(f"w{a}0", F.explode(steps)).withColumn(f"w{a}0", F.col(f"w{a}0") + F.col(f"b{a}0"))
    return df


def region_bbox_patch(centroids, patch, ratio, by="region_tag"):
    """A patch centred in the bounding box of each region's centroids.

    ``ratio``: coarse voxel / fine voxel per axis (z, y, x). Regions that cannot
    contain the patch come back with a reason.
    """
    df = centroids.groupBy(by).agg(
        *[F.min(a).alias(f"lo_{a}") for a in AXES], *[(F.max(a) + 1).alias(f"hi_{a}") for a in AXES]
    )
    inside = F.lit(True)
    for a, r in zip(AXES, ratio):
        lo, hi = F.col(f"lo_{a}") / F.lit(float(r)), F.col(f"hi_{a}") / F.lit(float(r))
        start = half_even((lo + hi) / 2.0 - patch / 2)
        df = df.withColumn(f"{a}0", start).withColumn(f"{a}1", F.col(f"{a}0") + patch)
        inside = inside & (lo <= F.col(f"{a}0")) & (F.col(f"{a}1") <= hi)
        fine = half_even(F.col(f"{a}0") * F.lit(float(r)))
        df = df.withColumn(f"f{a}0", fine).withColumn(f"f{a}1", F.col(f"f{a}0") + int(round(patch * r)))
    return df.withColumn("reason", F.when(~inside, "patch not contained in region"))


def pick_level(stores, cap, by="volume_id", name="entry"):
    """Highest stored pyramid level up to ``cap``; 0 without any."""
    level = F.when(F.col(name).rlike("^[0-9]+$"), F.col(name).try_cast("int"))
    return stores.groupBy(by).agg(F.least(F.coalesce(F.max(level), F.lit(0)), F.lit(cap)).alias("level"))


# --- dense and sparse shapes ----------------------------------------------

FLIPS = ["noflip", "flipx", "flipy", "flipz", "flipxy", "flipxz", "flipyz", "flipxyz"]


def _axis_order(perm):
    if sorted(perm) != sorted(AXES):
        raise ValueError("perm names each of z, y and x once")
    return list(perm)


def reorient(voxels, shape, flips=FLIPS, perm="xyz"):
    """Copies of sparse voxels with their axes in another order, one per flip.

    Output columns i, j, k follow the axes that ``perm`` names, any of the six
    orders; flips name axes of the input, whatever their new place.
    """
    dim = dict(zip(AXES, shape))
    variants = F.explode(F.array(*[F.lit(f) for f in flips]))
    df = voxels.withColumn("variant", variants)

    def flipped(axis):
        return F.when(F.substring("variant", 5, 3).contains(axis), F.lit(dim[axis] - 1) - F.col(axis)).otherwise(F.col(axis))

    return df.withColumns({c: flipped(a) for c, a in zip("ijk", _axis_order(perm))}).drop("z", "y", "x")


def reorient_dense(patches, flips=FLIPS, perm="xyz"):
    """As ``reorient``, of dense rows: dz, dy, dx are the extents in the new order."""
    order = _axis_order(perm)
    df = kernels.pin(patches.withColumn("variant", F.explode(F.array(*[F.lit(f) for f in flips]))))
    turned = [F.substring("variant", 5, 3).contains(a) for a in AXES]
    data = kernels.transpose(F.col("data"), F.col("dz"), F.col("dy"), F.col("dx"), [AXES.index(a) for a in order], turned)
    dims = {f"d{to}": F.col(f"d{a}").alias(f"d{to}") for to, a in zip(AXES, order)}
    return df.select(*[c for c in df.columns if c not in ("data", *dims)], *dims.values(), data.alias("data"))


def foreground_bbox(voxels, by, thr, value="value"):
    """Half-open bounding box of the voxels at or above a threshold."""
    return voxels.filter(F.col(value) >= thr).groupBy(*by).agg(
        *[F.min(a).alias(f"{a}0") for a in AXES], *[(F.max(a) + 1).alias(f"{a}1") for a in AXES]
    )


def cut_box(data, dims, start, size):
    """Sub-box of a C-order array, zeros outside; whole lines along x are copied.

    All offsets are bound to one struct first: written out inside the lambda,
    they would be evaluated again for every line.
    """
    dz, dy, dx = dims
    z0, y0, x0 = start
    nz, ny, nx = size
    skip = F.least(nx, F.greatest(F.lit(0), -x0))
    stop = F.greatest(skip, F.least(nx, dx - x0))
    bound = F.struct(
        *[v.cast("int").alias(n) for v, n in zip((dz, dy, dx, z0, y0, nz, ny), ("dz", "dy", "dx", "z0", "y0", "nz", "ny"))],
        (x0 + skip + 1).cast("int").alias("from"),
        (stop - skip).cast("int").alias("n"),
        F.array_repeat(F.lit(0.0), skip.cast("int")).alias("left"),
        F.array_repeat(F.lit(0.0), (nx - stop).cast("int")).alias("right"),
        F.array_repeat(F.lit(0.0), nx.cast("int")).alias("blank"),
    )

    def line(b, z, y):
        inside = (z >= 0) & (z < b["dz"]) & (y >= 0) & (y < b["dy"]) & (b["n"] > 0)
        body = F.slice(data, (z * b["dy"] + y) * b["dx"] + b["from"], b["n"])
        return F.when(inside, F.concat(b["left"], body, b["right"])).otherwise(b["blank"])

    def lines(b):
        zs = F.sequence(b["z0"], b["z0"] + b["nz"] - 1)
        ys = F.sequence(b["y0"], b["y0"] + b["ny"] - 1)
        return F.flatten(F.transform(zs, lambda z: F.flatten(F.transform(ys, lambda y: line(b, z, y)))))

    return let(bound, lines)


def recrop(patches, start, size):
    """Cut a sub-box out of dense rows, zeros where it leaves the patch.

    ``start`` and ``size`` are (z, y, x) columns or numbers.
    """
    start = [F.lit(v) if isinstance(v, int) else v for v in start]
    size = [F.lit(v) if isinstance(v, int) else v for v in size]
    dims = [F.col(d) for d in ("dz", "dy", "dx")]
    # two steps: inside a lambda, "dz" would otherwise resolve to the new dz
    return patches.withColumn("data", let(F.col("data"), lambda d: cut_box(d, dims, start, size))).withColumns(
        {f"d{a}": v.cast("int") for a, v in zip(AXES, size)}
    )


def slice_windows(buffers, keys, patch, stride, buffer):
    """Sliding windows of buffers that are already cut, one row per window.

    ``buffers``: dense rows of ``buffer``^3 cells with their corner b{a}0. The
    volume is read once per buffer, not once per overlapping window.
    """
    steps = range(0, buffer - patch + 1, stride)
    starts = F.array(*[F.struct(*[F.lit(v).alias(a) for v, a in zip(p, AXES)]) for p in product(steps, steps, steps)])
    dims, size = [F.lit(buffer)] * 3, [F.lit(patch)] * 3

    def window(data, w):
        return F.struct(w.alias("at"), cut_box(data, dims, [w["z"], w["y"], w["x"]], size).alias("data"))

    windows = let(F.col("data"), lambda d: F.transform(starts, lambda w: window(d, w)))
    rows = buffers.select(*keys, *[f"b{a}0" for a in AXES], F.explode(windows).alias("_w"))
    return rows.select(
        *keys,
        *[(F.col(f"_w.at.{a}") + F.col(f"b{a}0")).alias(f"w{a}0") for a in AXES],
        *[F.lit(patch).alias(f"d{a}") for a in AXES],
        F.col("_w.data").alias("data"),
    )


def pad_to(patches, size):
    """Grow dense rows to ``size``^3 with zeros at the far corner."""
    return recrop(patches, (0, 0, 0), (size, size, size))


def central_crop(patches, n):
    """[d//2 - n//2, d//2 + n//2) per axis."""
    half = n // 2
    start = [F.floor(F.col(f"d{a}") / 2).cast("int") - half for a in AXES]
    return recrop(patches, start, (2 * half, 2 * half, 2 * half))
