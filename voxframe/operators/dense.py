"""The two layouts of voxel data and the moves between them.

Sparse: one row per non-zero voxel, ``(*keys, z, y, x, value)``.
Dense: one row per patch or chunk, ``(*keys, dz, dy, dx, data)`` with ``data``
in C order. A dense row is bounded by the patch shape, so per-patch work needs
no shuffle and no group can grow past one patch.
"""

from pyspark.sql import functions as F

from voxframe.functions.scalar import flatten_index, unflatten_index
from voxframe.operators import kernels


def _fill(entries, cells, zero):
    """Expand sorted (idx, value) entries to a full array, zeros in the gaps."""
    index = F.transform(entries, lambda e: e["idx"])
    before = F.concat(F.array(F.lit(-1)), F.slice(index, F.lit(1), F.size(index) - 1))
    runs = F.zip_with(
        entries,
        before,
        lambda e, p: F.concat(F.array_repeat(zero, e["idx"] - p - 1), F.array(e["value"])),
    )
    tail = F.array_repeat(zero, F.lit(cells - 1) - F.element_at(index, -1))
    return F.concat(F.flatten(runs), tail)


def to_patches(voxels, keys, shape, value="value"):
    """Sparse voxels to one dense row per key; of a repeated voxel the largest value."""
    dz, dy, dx = shape
    entry = F.struct(
        flatten_index(F.col("z"), F.col("y"), F.col("x"), dy, dx).cast("int").alias("idx"),
        F.col(value).cast("double").alias("value"),
    )
    # Voxels move as they are: collected before, there would be a list of one or two
    # of them for each patch in each task.
    grouped = voxels.repartition(*keys).groupBy(*keys).agg(F.collect_list(entry).alias("_e"))
    ready = kernels.pin(grouped, "_e")
    return ready.select(
        *keys, F.lit(dz).alias("dz"), F.lit(dy).alias("dy"), F.lit(dx).alias("dx"), kernels.fill(F.col("_e"), dz * dy * dx).alias("data")
    )


def to_chunks(voxels, keys, edge, value="value"):
    """Sparse voxels to chunk rows of ``edge``^3 cells; empty chunks are absent."""
    cell = [F.floor(F.col(a) / edge).cast("int").alias(f"c{a}") for a in "zyx"]
    local = [F.pmod(F.col(a), F.lit(edge)).alias(a) for a in "zyx"]
    chunked = voxels.select(*keys, *cell, *local, F.col(value).alias("value"))
    return to_patches(chunked, [*keys, "cz", "cy", "cx"], (edge, edge, edge))


def to_voxels(patches, keys, keep=None, value="value"):
    """Dense rows to voxel rows; ``keep`` filters on the column ``value``."""
    rows = patches.select(*keys, "dy", "dx", F.posexplode("data").alias("_i", value))
    if keep is not None:
        rows = rows.filter(keep)
    z, y, x = unflatten_index(F.col("_i"), F.col("dy"), F.col("dx"))
    return rows.select(*keys, z.alias("z"), y.alias("y"), x.alias("x"), value)


def chunk_voxels(chunks, keys, edge, keep=None, value="value"):
    """Chunk rows to voxel rows in volume coordinates."""
    rows = to_voxels(chunks, [*keys, "cz", "cy", "cx"], keep, value)
    at = [(F.col(f"c{a}") * edge + F.col(a)).alias(a) for a in "zyx"]
    return rows.select(*keys, *at, value)
