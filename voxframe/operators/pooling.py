"""Pooling, pyramids, resampling and projections."""

from pyspark.sql import functions as F

from voxframe.operators import kernels


def block_reduce(patches, factors, how="mean", pad=True):
    """Pool dense rows by (fz, fy, fx) blocks.

    ``pad``: extend with zeros to a multiple (a mean divides by the whole
    block); otherwise the remainder is cropped. Chunks whose edge is a multiple
    of the factors pool on their own, without a shuffle.
    """
    dims = {}
    for d, f in zip(("dz", "dy", "dx"), factors):
        ratio = F.col(d) / f
        dims[d] = (F.ceil(ratio) if pad else F.floor(ratio)).cast("int")
    pooled = kernels.pool(F.col("data"), F.col("dz"), F.col("dy"), F.col("dx"), factors, how, pad)
    return kernels.pin(patches).withColumn("data", pooled).withColumns(dims)


def block_mean(patches, f):
    """Mean over f^3 blocks, remainder cropped."""
    return block_reduce(patches, (f, f, f), "mean", pad=False)


def pyramid_mean_yx(patches, f):
    """Next level of an 8-bit volume: y and x only, rounded half up."""
    pooled = block_reduce(patches, (1, f, f), "mean", pad=False)
    encode = lambda v: F.floor(F.least(F.greatest(v + 0.5, F.lit(0.0)), F.lit(255.0))).cast("double")
    return pooled.withColumn("data", F.transform("data", encode))


def pyramid_max_yx(mask, keys, f, dims=None):
    """Next level of a sparse mask: y and x only.

    ``dims`` (dy, dx) crops the remainder as a dense pyramid does.
    """
    if dims:
        dy, dx = dims
        mask = mask.filter((F.col("y") < dy // f * f) & (F.col("x") < dx // f * f))
    cell = [F.col("z"), F.floor(F.col("y") / f).cast("int").alias("y"), F.floor(F.col("x") / f).cast("int").alias("x")]
    return mask.select(*keys, *cell).distinct()


def _to_grid(shape, n):
    out = []
    for a, size in zip("zyx", shape):
        size = F.lit(size) if isinstance(size, int) else size
        scaled = F.floor(F.col(a) * (F.lit(float(n)) / size)).cast("int")
        out.append(F.least(scaled, F.lit(n - 1)).alias(a))
    return out


def pool_to_grid(mask, keys, shape, n):
    """Max-pool a sparse mask of any box shape onto n^3 cells."""
    return mask.select(*keys, *_to_grid(shape, n)).distinct()


def pool_labels_to_grid(voxels, keys, shape, n, label="label"):
    """As pool_to_grid, keeping the largest label per cell."""
    cells = voxels.filter(F.col(label) > 0).select(*keys, *_to_grid(shape, n), label)
    return cells.groupBy(*keys, "z", "y", "x").agg(F.max(label).alias(label))


def _axis_map(size, out, rule):
    """Source coordinate of each output index along one axis."""
    steps = F.sequence(F.lit(0), F.lit(out - 1))
    if rule == "endpoints":
        scale = (size - 1) / F.lit(float(max(out - 1, 1)))
        return F.transform(steps, lambda i: i * scale)
    if rule == "half_pixel":
        scale = size / F.lit(float(out))
        return F.transform(steps, lambda i: F.greatest((i + 0.5) * scale - 0.5, F.lit(0.0)))
    raise ValueError(rule)


def gather(patches, maps, shape):
    """Read ``data`` at three integer index arrays; negative or null reads 0."""
    oz, oy, ox = shape
    ready = kernels.pin(patches.withColumns({f"_m{a}": m for m, a in zip(maps, "zyx")}))
    for a in "zyx":
        ready = kernels.pin(ready, f"_m{a}")
    data = kernels.gather(*[F.col(c) for c in ("data", "dz", "dy", "dx", "_mz", "_my", "_mx")])
    return ready.withColumn("data", data).drop("_mz", "_my", "_mx").withColumns(
        {"dz": F.lit(oz), "dy": F.lit(oy), "dx": F.lit(ox)}
    )


def resample_nearest(patches, shape):
    """Endpoint-aligned nearest neighbour, ties half up."""
    maps = [
        F.transform(_axis_map(F.col(d), n, "endpoints"), lambda c: F.floor(c + 0.5).cast("int"))
        for d, n in zip(("dz", "dy", "dx"), shape)
    ]
    return gather(patches, maps, shape)


def resample_affine_nearest(patches, shape, scale, offset):
    """Nearest neighbour onto a reference grid: source = target * scale + offset."""
    def source(n, k, o):
        steps = F.sequence(F.lit(0), F.lit(n - 1))
        return F.transform(steps, lambda i: F.floor(i * F.lit(float(k)) + F.lit(float(o)) + 0.5).cast("int"))

    return gather(patches, [source(n, k, o) for n, k, o in zip(shape, scale, offset)], shape)


def resample_linear(patches, shape, rule="endpoints", saturate=True):
    """Trilinear resampling; with ``saturate`` to unsigned 16-bit integers."""
    maps = [_axis_map(F.col(d), n, rule) for d, n in zip(("dz", "dy", "dx"), shape)]
    out = kernels.pin(patches).withColumn(
        "data", kernels.sample_grid(F.col("data"), F.col("dz"), F.col("dy"), F.col("dx"), *maps)
    )
    if saturate:
        clamp = lambda v: F.floor(F.least(F.greatest(v, F.lit(0.0)), F.lit(65535.0))).cast("double")
        out = out.withColumn("data", F.transform("data", clamp))
    return out.withColumns({d: F.lit(n) for d, n in zip(("dz", "dy", "dx"), shape)})


def project_max(patches, keys, axis):
    """Maximum along an axis: one row per (keys, a, b) of the other two axes."""
    others = [a for a in "zyx" if a != axis]
    a, b = others
    flat = kernels.project_max(F.col("data"), F.col("dz"), F.col("dy"), F.col("dx"), "zyx".index(axis))
    ready = kernels.pin(patches).select(*keys, F.col(f"d{b}").alias("_n"), flat.alias("_flat"))
    rows = ready.select(*keys, "_n", F.posexplode("_flat").alias("_o", "value"))
    return rows.select(
        *keys, F.floor(F.col("_o") / F.col("_n")).cast("int").alias(a), F.pmod("_o", "_n").alias(b), "value"
    )


def project_mask(mask, keys, axis):
    """any() along an axis of a sparse mask."""
    return mask.select(*keys, *[a for a in "zyx" if a != axis]).distinct()


def pyramid(chunks, keys, levels, scale_zyx):
    """Levels 0..levels of an 8-bit chunk table and their voxel scales.

    Every level is pooled from level 0, so that no rounding is rounded again;
    chunk edges are multiples of 2^levels. Returns (level rows, scale rows);
    write the first with ``partitionBy("level")``.
    """
    rows = chunks.withColumn("level", F.lit(0))
    for level in range(1, levels + 1):
        rows = rows.unionByName(pyramid_mean_yx(chunks, 2**level).withColumn("level", F.lit(level)))
    z, y, x = scale_zyx
    scales = chunks.select(*keys).distinct().select(*keys, F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("level"))
    grow = F.pow(F.lit(2.0), F.col("level"))
    return rows, scales.select(*keys, "level", F.lit(z).alias("sz"), (F.lit(y) * grow).alias("sy"), (F.lit(x) * grow).alias("sx"))
