"""Connected components of sparse masks and whole volumes, and their statistics."""

import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxframe.operators.kernels import contacts, label_runs as chunk_runs
from voxframe.operators.ranking import row_numbers
from voxframe.session import RoundTables, bound_batches, ensure_checkpoint_dir

# Bits of one axis in a voxel code; codes order by (z, y, x).
AXIS_BITS = 21
CELL = 64


def voxel_code(z, y, x):
    """One number for a voxel; a coordinate outside the range is an error."""
    inside = F.lit(True)
    for c in (z, y, x):
        inside = inside & (c >= 0) & (c < F.lit(1 << AXIS_BITS))
    fits = F.assert_true(inside, "a voxel coordinate is outside 0 .. 2^21 - 1").isNull()
    return F.when(
        fits,
        F.shiftleft(z.cast("bigint"), 2 * AXIS_BITS) + F.shiftleft(y.cast("bigint"), AXIS_BITS) + x.cast("bigint"),
    )


def runs_along_x(mask, keys):
    """Maximal runs of neighbouring voxels in each x line: (keys, z, y, x0, x1)."""
    line = W.partitionBy(*keys, "z", "y").orderBy("x")
    return (
        mask.select(*keys, "z", "y", "x")
        .withColumn("_run", F.col("x") - F.row_number().over(line))
        .groupBy(*keys, "z", "y", "_run")
        .agg(F.min("x").alias("x0"), F.max("x").alias("x1"))
        .drop("_run")
        .withColumn("u", voxel_code(F.col("z"), F.col("y"), F.col("x0")))
    )


def _edges(runs, keys, conn):
    """Touching runs of neighbouring lines.

    Runs meet on (line, x cell): a run lists the cells it reaches, and a pair
    that shares several counts in the first, so a noisy line never joins every
    run with every other.
    """
    reach = 1 if conn == 26 else 0
    steps = [(0, 1), (1, -1), (1, 0), (1, 1)] if conn == 26 else [(0, 1), (1, 0)]
    cell = lambda x: F.floor(x / CELL).cast("int")
    to = F.explode(F.array(*[F.struct(F.lit(dz).alias("dz"), F.lit(dy).alias("dy")) for dz, dy in steps]))
    a = (
        runs.select(*keys, "z", "y", F.col("x0").alias("a0"), F.col("x1").alias("a1"), "u")
        .withColumn("_t", to)
        .withColumns({"z": F.col("z") + F.col("_t.dz"), "y": F.col("y") + F.col("_t.dy")})
        .drop("_t")
        .withColumn("_cell", F.explode(F.sequence(cell(F.col("a0") - reach), cell(F.col("a1") + reach))))
    )
    b = runs.select(*keys, "z", "y", F.col("x0").alias("b0"), F.col("x1").alias("b1"), F.col("u").alias("v")).withColumn(
        "_cell", F.explode(F.sequence(cell(F.col("b0")), cell(F.col("b1"))))
    )
    touch = (F.col("a1") + reach >= F.col("b0")) & (F.col("b1") + reach >= F.col("a0"))
    first = F.col("_cell") == cell(F.greatest(F.col("a0") - reach, F.col("b0")))
    return a.join(b, [*keys, "z", "y", "_cell"]).filter(touch & first).select(*keys, "u", "v")


def _roots(edges, keys, jumps=2):
    """(keys, u, root) for every vertex with an edge.

    Each round links a vertex to its smallest neighbour, shortens the links by
    pointer jumping, and contracts the graph: linked vertices become one, loops
    and duplicates vanish. The graph at least halves per round, so the work is
    that of the first rounds. Rounds are tables in the shared folder; they are
    composed backwards at the end, and only the result stays.
    """
    tables, rounds = RoundTables(edges.sparkSession, "components"), []
    edges = tables.keep(edges)
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(*keys, F.col("v").alias("u"), F.col("u").alias("v")))
        link = both.groupBy(*keys, "u").agg(F.min("v").alias("p")).withColumn("p", F.least("u", "p"))
        for _ in range(jumps):
            nxt = link.select(*keys, F.col("u").alias("p"), F.col("p").alias("_q"))
            link = link.join(nxt, [*keys, "p"]).select(*keys, "u", F.col("_q").alias("p"))
        link = tables.keep(link)
        rounds.append(link)
        of_u = link.select(*keys, "u", F.col("p").alias("_pu"))
        of_v = link.select(*keys, F.col("u").alias("v"), F.col("p").alias("_pv"))
        contracted = (
            edges.join(of_u, [*keys, "u"])
            .join(of_v, [*keys, "v"])
            .filter("_pu <> _pv")
            .select(*keys, F.least("_pu", "_pv").alias("u"), F.greatest("_pu", "_pv").alias("v"))
            .distinct()
        )
        done, edges = edges, tables.keep(contracted)
        tables.drop(done)
    if not rounds:
        tables.drop(edges)
        return None
    root = rounds.pop()
    while rounds:
        later = root.select(*keys, F.col("u").alias("p"), F.col("p").alias("_root"))
        root = (
            rounds.pop()
            .join(later, [*keys, "p"], "left")
            .select(*keys, "u", F.coalesce("_root", "p").alias("p"))
        )
    root = tables.keep(root.withColumnRenamed("p", "root"))
    tables.drop_all_but(root)
    return root


def label_runs(mask, keys, conn=26):
    """Runs along x with the ``component`` they belong to.

    ``component`` is the code of the first voxel (in z, y, x order) of the
    object, unique within the keys.
    """
    if conn not in (6, 26):
        raise ValueError("conn must be 6 or 26")
    ensure_checkpoint_dir(mask.sparkSession)
    runs = runs_along_x(mask, keys).checkpoint()
    roots = _roots(_edges(runs, keys, conn), keys)
    if roots is None:
        return runs.withColumn("component", F.col("u")).drop("u")
    return (
        runs.join(roots, [*keys, "u"], "left")
        .withColumn("component", F.coalesce("root", "u"))
        .drop("u", "root")
    )


def connected_components(mask, keys, conn=26):
    """Every mask voxel with its ``component``."""
    runs = label_runs(mask, keys, conn)
    return runs.select(*keys, "component", "z", "y", F.explode(F.sequence("x0", "x1")).alias("x"))


#: Half of the neighbours of a chunk: the other half has it as such a neighbour.
FORWARD = [d for d in itertools.product((-1, 0, 1), repeat=3) if d > (0, 0, 0)]


def _key_fields(df, names):
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name in names)


def _labelled(batch, edge, conn):
    """Objects of the chunks of a batch that have foreground: (rows, corners, cells, firsts).

    All chunks are labelled at once, one below the other with an empty plane in
    between. ``cells`` are the places of the foreground in the stack of these
    chunks, ``firsts`` those of the first voxel of each one's object.
    """
    data = batch.column("data")
    rows = np.flatnonzero(data.is_valid().to_numpy(zero_copy_only=False))
    mask = data.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(rows), edge, edge, edge) > 0
    use = mask.any(axis=(1, 2, 3))
    rows, mask = rows[use], mask[use]
    corners = np.stack([batch.column(f"c{a}").to_numpy(zero_copy_only=False)[rows].astype(np.int64) * edge for a in "zyx"], axis=1)
    apart = np.zeros((len(rows), edge + 1, edge, edge), bool)
    apart[:, :edge] = mask
    plane, size = edge**2, edge**3
    return rows, corners, *(i - i // (size + plane) * plane for i in chunk_runs(apart.reshape(len(rows) * (edge + 1), edge, edge), conn))


def _codes(places, corners, edge):
    """Codes of voxels by their places in a stack of chunks."""
    of, at = np.divmod(places, edge**3)
    z, y, x = (k + corners[of, i] for i, k in enumerate((at // edge**2, at // edge % edge, at % edge)))
    if len(places) and max(z.max(), y.max(), x.max()) >= 1 << AXIS_BITS:
        raise ValueError("a voxel coordinate is outside 0 .. 2^21 - 1")
    return z << 2 * AXIS_BITS | y << AXIS_BITS | x


def face_contacts(chunks, keys, edge, conn=26):
    """(keys, u, v): objects of neighbouring chunks that touch, by their labels.

    A chunk sends the cells at each border to the pair of chunks that share it:
    rows of one face, edge or corner, never voxels of the inside.
    """
    steps = [d for d in FORWARD if conn == 26 or sum(map(abs, d)) == 1]
    names = [*keys, "cz", "cy", "cx"]

    def slabs(batches):
        for batch in batches:
            rows, corners, cells, firsts = _labelled(batch, edge, conn)
            labels = np.full(len(rows) * edge**3, -1, np.int64)
            labels[cells] = _codes(firsts, corners, edge)
            labels = labels.reshape(len(rows), edge, edge, edge)
            for number, step in enumerate(steps):
                for side in (0, 1):
                    # The lower chunk gives its far cells, the upper one its near cells.
                    ends = [slice(None) if s == 0 else slice(edge - 1, edge) if (s > 0) == (side == 0) else slice(0, 1) for s in step]
                    border = labels[(slice(None), *ends)].reshape(len(rows), edge ** step.count(0))
                    use = np.flatnonzero((border >= 0).any(axis=1))
                    if not len(use):
                        continue
                    lower = corners[use] // edge - (0 if side == 0 else np.array(step))
                    sent = pa.ListArray.from_arrays(pa.array(np.arange(len(use) + 1) * border.shape[1], pa.int32()), pa.array(border[use].ravel()))
                    same = (pa.array(np.full(len(use), k), pa.int32()) for k in (number, side))
                    kept = (batch.column(k).take(pa.array(rows[use])) for k in keys)
                    yield pa.RecordBatch.from_arrays([*kept, *(pa.array(c, pa.int32()) for c in lower.T), *same, sent], names=[*names, "step", "side", "cells"])

    def pairs(batches):
        for batch in batches:
            number = batch.column("step").to_numpy()
            for k in np.unique(number).tolist():
                of = np.flatnonzero(number == k)
                shape = [len(of), *(edge if s == 0 else 1 for s in steps[k])]
                a, b = (batch.column(c).take(pa.array(of)).flatten().to_numpy().reshape(shape) for c in "ab")
                pair, u, v = contacts(a, b, steps[k], conn).T
                take = pa.array(of[pair])
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).take(take) for c in keys), pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], names=[*keys, "u", "v"]
                )

    fields = _key_fields(chunks, keys)
    sent = chunks.select(*names, "data").mapInArrow(slabs, f"{fields}, cz int, cy int, cx int, step int, side int, cells array<long>")
    both = sent.groupBy(*names, "step").agg(
        F.max(F.when(F.col("side") == 0, F.col("cells"))).alias("a"), F.max(F.when(F.col("side") == 1, F.col("cells"))).alias("b")
    )
    met = both.filter("a IS NOT NULL AND b IS NOT NULL").select(*keys, "step", "a", "b")
    return met.mapInArrow(pairs, f"{fields}, u long, v long").distinct()


def volume_components(chunks, keys, edge, conn=26):
    """Chunk rows of a mask to chunk rows of component codes, -1 outside the mask.

    ``chunks``: (*keys, cz, cy, cx, data) of edge^3 cells, foreground above 0;
    absent chunks and null arrays are empty. Codes are those of
    ``connected_components``: the first voxel of the whole object. Two levels:
    each chunk labels its own cells, and only the labels that touch a border
    enter the contraction, so its rows are a share of the faces, not of the
    volume. A chunk then takes the short list of its labels that changed.
    """
    if conn not in (6, 26):
        raise ValueError("conn must be 6 or 26")
    ensure_checkpoint_dir(chunks.sparkSession)
    bound_batches(chunks.sparkSession)
    roots = _roots(face_contacts(chunks, keys, edge, conn), keys)
    names = [*keys, "cz", "cy", "cx"]
    rows = chunks.select(*names, "data")
    if roots is None:
        rows = rows.withColumn("changed", F.lit(None).cast("array<struct<u:bigint,root:bigint>>"))
    else:
        # A label is the code of a voxel in its own chunk.
        shift, low = (2 * AXIS_BITS, AXIS_BITS, 0), F.lit((1 << AXIS_BITS) - 1)
        own = [F.floor(F.shiftright("u", k).bitwiseAND(low) / edge).cast("int").alias(f"_c{a}") for k, a in zip(shift, "zyx")]
        changed = roots.filter("u <> root").groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *own).agg(
            F.collect_list(F.struct("u", "root")).alias("changed")
        )
        on = [F.col(k) == F.col(f"_k{i}") for i, k in enumerate(keys)] + [F.col(f"c{a}") == F.col(f"_c{a}") for a in "zyx"]
        rows = rows.join(changed, on, "left").select(*names, "data", "changed")

    def run(batches):
        for batch in batches:
            found, corners, cells, firsts = _labelled(batch, edge, conn)
            roots = np.full(len(found) * edge**3, -1, np.int64)
            roots[firsts] = _codes(firsts, corners, edge)
            changed = batch.column("changed").take(pa.array(found))
            size = pa.compute.fill_null(pa.compute.list_value_length(changed), 0).to_numpy(zero_copy_only=False)
            if size.any():
                # A label is the code of a voxel of its chunk, so it tells its own place.
                of, new = np.repeat(np.arange(len(found)), size), changed.flatten()
                u, low = new.field("u").to_numpy(), (1 << AXIS_BITS) - 1
                z, y, x = ((u >> k & low) - corners[of, i] for i, k in enumerate((2 * AXIS_BITS, AXIS_BITS, 0)))
                roots[((of * edge + z) * edge + y) * edge + x] = new.field("root").to_numpy()
            flat = np.full(len(found) * edge**3, -1, np.int64)
            flat[cells] = roots[firsts]
            kept = [batch.column(c).take(pa.array(found)) for c in names]
            dims = [pa.array(np.full(len(found), edge), pa.int32())] * 3
            offsets = pa.array(np.arange(len(found) + 1) * edge**3, pa.int32())
            yield pa.RecordBatch.from_arrays([*kept, *dims, pa.ListArray.from_arrays(offsets, pa.array(flat))], names=[*names, "dz", "dy", "dx", "data"])

    return rows.mapInArrow(run, f"{_key_fields(chunks, names)}, dz int, dy int, dx int, data array<long>")


def component_sizes(components, keys):
    return components.groupBy(*keys, "component").agg(F.count("*").alias("size"))


def size_filter(components, keys, min_voxels=15):
    """Drop small components and renumber the rest 1..n in order of first voxel."""
    kept = component_sizes(components, keys).filter(F.col("size") >= min_voxels)
    plane = F.shiftright("component", 2 * AXIS_BITS)
    numbered = row_numbers(kept, keys, F.col("component"), [], "_n", bucket=plane).select(
        *keys, "component", (F.col("_n") + 1).cast("bigint").alias("component_id")
    )
    return components.join(numbered, [*keys, "component"])


def drop_large(components, keys, max_voxels=5000):
    """Components of at most ``max_voxels``, and what was removed per key."""
    big = component_sizes(components, keys).filter(F.col("size") > max_voxels)
    removed = big.groupBy(*keys).agg(F.count("*").alias("n_removed"), F.sum("size").alias("voxels_removed"))
    return components.join(big.select(*keys, "component"), [*keys, "component"], "left_anti"), removed


def component_stats(components, voxels, keys, eps=1e-6):
    """Size, means and brightness against the surroundings of each component.

    ``voxels``: (keys, z, y, x, norm, raw, local).
    """
    joined = components.join(voxels, [*keys, "z", "y", "x"])
    stats = joined.groupBy(*keys, "component").agg(
        F.count("*").alias("size"),
        F.avg("norm").alias("mean_norm"),
        F.avg("raw").alias("mean_raw"),
        F.avg("local").alias("mean_local"),
    )
    return stats.withColumn(
        "ratio", F.when(F.col("mean_local") > eps, F.col("mean_raw") / F.col("mean_local"))
    )


# Lower bounds of the component size bins; the last is open.
SIZE_BINS = (0, 5, 10, 20, 50, 100, 300, 1000)


def size_bin_columns(size="size"):
    """One count aggregate per size bin, named b_<lo>_<hi>."""
    out = []
    for lo, hi in zip(SIZE_BINS, [*SIZE_BINS[1:], None]):
        inside = F.col(size) >= lo
        if hi is not None:
            inside = inside & (F.col(size) < hi)
        out.append(F.count_if(inside).alias(f"b_{lo}_{hi if hi is not None else 'inf'}"))
    return out


def size_bins(sizes, keys, patches=None):
    """Components by size; ``patches`` without components get zeros."""
    if patches is not None:
        sizes = patches.select(*keys).distinct().join(sizes, list(keys), "left")
    return sizes.groupBy(*keys).agg(*size_bin_columns())


def confidence_counts(stats, keys):
    """Components with mean norm below 0, in [0, 1) and from 1."""
    return stats.groupBy(*keys).agg(*confidence_columns())


def confidence_columns():
    n = F.col("mean_norm")
    return [
        F.count_if(n < 0).alias("comp_neg"),
        F.count_if((n >= 0) & (n < 1)).alias("comp_borderline"),
        F.count_if(n >= 1).alias("comp_confident"),
    ]


def mask_stats(boxes, mask, keys, n_voxels):
    """Positive voxels, share of the box and an empty flag per patch."""
    counts = mask.groupBy(*keys).agg(F.count("*").alias("mask_pos_vox"))
    pos = F.coalesce("mask_pos_vox", F.lit(0))
    return boxes.join(counts, list(keys), "left").select(
        *keys,
        pos.cast("bigint").alias("mask_pos_vox"),
        (pos / n_voxels).alias("fraction"),
        (pos == 0).alias("empty"),
    )
