"""Array kernels for neighbourhood reads inside one dense row.

Spark's lambda functions are interpreted at about 2 us per voxel for a five-tap
filter; these small vectorised helpers run on Arrow batches at a fraction of
that. Spark decides the partitioning; a kernel only ever sees single patches.
"""

import itertools
import math
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxframe.session import bound_batches

# Send the helpers with the functions: executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ARRAY = T.ArrayType(T.DoubleType())
#: Bytes of a batch of dense rows, unless the session has a lower bound.
BATCH_BYTES = 4 << 20


def _kernel(return_type):
    """An Arrow function that the optimiser keeps in its own projection.

    Merged into a later lambda expression, a Python function could not be
    evaluated at all, and named twice it would run twice. Marking it
    non-deterministic is Spark's way to forbid both; the functions are pure.
    """
    return lambda fn: F.arrow_udf(fn, return_type).asNondeterministic()


def pin(patches, name="data"):
    """Compute a column before a kernel reads it.

    Arguments that contain lambdas over structs are not evaluated when the
    optimiser merges them into a Python function's argument list; a
    non-deterministic guard around the column keeps the two apart.
    """
    bound_batches(patches.sparkSession, BATCH_BYTES)
    guard = F.monotonically_increasing_id() >= 0
    return patches.withColumn(name, F.when(guard, F.col(name)))


def _rows(data):
    """Views of the rows of a list column, without copying."""
    flat = data.values.to_numpy(zero_copy_only=False)
    offsets = data.offsets.to_numpy()
    for i in range(len(data)):
        yield flat[offsets[i] : offsets[i + 1]]


def _pack(rows):
    rows = list(rows)
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows], dtype=np.int64)]).astype(np.int64)
    if offsets[-1] >= 1 << 31:
        raise ValueError("a batch holds more cells than a list column can address: lower spark.sql.execution.arrow.maxBytesPerBatch")
    offsets = offsets.astype(np.int32)
    flat = np.concatenate(rows) if rows else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, type=pa.float64()))


def _packed(flat, sizes, unknown=None, absent=None):
    """Rows of ``sizes`` cells from one flat array; null cells and null rows by mask."""
    ends = np.cumsum(sizes, dtype=np.int64)
    if len(ends) and ends[-1] >= 1 << 31:
        raise ValueError("a batch holds more cells than a list column can address: lower spark.sql.execution.arrow.maxBytesPerBatch")
    offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(flat, pa.float64(), mask=unknown), mask=None if absent is None else pa.array(absent))


def _ints(*columns):
    """Columns of whole numbers side by side."""
    return np.stack([c.to_numpy(zero_copy_only=False) for c in columns], axis=1).astype(np.int64)


def _matrix(lists, width):
    """A list column of ``width`` whole numbers per row as one matrix."""
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


#: Boxes of more cells than this on average are worth a numpy call each.
LARGE_BOX = 4096


def _box_cells(size):
    """(box, z, y, x) of every cell of some boxes, box by box in C order."""
    n = size.prod(axis=1)
    box = np.repeat(np.arange(len(size)), n)
    at = np.arange(len(box)) - np.repeat(np.cumsum(n) - n, n)
    line, x = np.divmod(at, size[box, 2])
    z, y = np.divmod(line, size[box, 1])
    return box, z, y, x


def _cut_boxes(flat, first, dims, corner, size):
    """Cells of boxes, one after the other: box i lies in the row of ``dims`` cells
    that starts at ``first[i]`` of the flat array."""
    n = size.prod(axis=1)
    if n.sum() > LARGE_BOX * len(n):
        boxes = (tuple(slice(a, a + k) for a, k in zip(c, s)) for c, s in zip(corner.tolist(), size.tolist()))
        return np.concatenate([flat[f : f + math.prod(dims)].reshape(dims)[b].ravel() if k else flat[:0] for f, b, k in zip(first.tolist(), boxes, n.tolist())])
    box, z, y, x = _box_cells(size)
    z, y, x = (k + corner[box, i] for i, k in enumerate((z, y, x)))
    return flat[first[box] + (z * dims[1] + y) * dims[2] + x]


def _pieces(lists, width):
    """(row, place, cells) of a list column of (place, p): the row of each piece, its
    ``width`` numbers, and the cells of all pieces."""
    of = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    inner = lists.flatten()
    return of, _matrix(inner.field("place"), width), inner.field("p").flatten().to_numpy(zero_copy_only=False)


def _value_moments(raw, corrected):
    """Distinct raw values above 0, their number, and of the corrected values above
    0 there the number, the mean and the squared deviations from it."""
    use = raw > 0
    values, code, n_raw = np.unique(raw[use], return_inverse=True, return_counts=True)
    c = corrected[use]
    ok = (c > 0) & np.isfinite(c)
    c = np.where(ok, c, 0.0)
    n = np.bincount(code, weights=ok, minlength=len(values)).astype(np.int64)
    mean = np.bincount(code, weights=c, minlength=len(values)) / np.maximum(n, 1)
    off = np.where(ok, c - mean[code], 0.0)
    return values, n_raw, n, mean, np.bincount(code, weights=off * off, minlength=len(values))


def moments_by_value(chunks, by, raw, corrected):
    """(*by, v, n_raw, n, mean, m2): one row per chunk and distinct raw value.

    The numbers merge: over rows, squared deviations from any centre are the sum
    of m2 + n * (mean - centre)^2.
    """
    names, numbers = list(by), ["v", "n_raw", "n", "mean", "m2"]

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                both = [batch.column(c)[i].values for c in ("_raw", "_corrected")]
                if None in both:
                    continue
                columns = _value_moments(*(np.asarray(x.cast(pa.float64()).to_numpy(zero_copy_only=False)) for x in both))
                key = [batch.column(k).take(pa.array(np.full(len(columns[0]), i))) for k in names]
                yield pa.RecordBatch.from_arrays([*key, *map(pa.array, columns)], names=[*names, *numbers])

    rows = chunks.select(*by, F.col(raw).alias("_raw"), F.col(corrected).alias("_corrected"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in names)
    return rows.mapInArrow(run, f"{fields}, v double, n_raw long, n long, mean double, m2 double")


def _shapes(dz, dy, dx):
    return zip(dz.to_pylist(), dy.to_pylist(), dx.to_pylist())


def _convolve(vol, taps, edge):
    """Weighted sum of shifted copies along each axis in turn; no taps, no change."""
    if not len(taps):
        return vol
    half = len(taps) // 2
    for axis in range(3):
        n = vol.shape[axis]
        pad = [(half, half) if a == axis else (0, 0) for a in range(3)]
        wide = np.pad(vol, pad, mode=edge)
        out = np.zeros_like(vol)
        for k, w in enumerate(taps):
            out += w * wide[tuple(slice(k, k + n) if a == axis else slice(None) for a in range(3))]
        vol = out
    return vol


@_kernel(ARRAY)
def _separable_reflect(data: pa.Array, dz: pa.Array, dy: pa.Array, dx: pa.Array, taps: pa.Array) -> pa.Array:
    out = (
        _convolve(v.reshape(s), t, "symmetric").ravel()
        for v, s, t in zip(_rows(data), _shapes(dz, dy, dx), _rows(taps))
    )
    return _pack(out)


@_kernel(ARRAY)
def _separable_replicate(data: pa.Array, dz: pa.Array, dy: pa.Array, dx: pa.Array, taps: pa.Array) -> pa.Array:
    out = (
        _convolve(v.reshape(s), t, "edge").ravel()
        for v, s, t in zip(_rows(data), _shapes(dz, dy, dx), _rows(taps))
    )
    return _pack(out)


def separable(data, dz, dy, dx, taps, edge):
    """Same one-dimensional taps along z, y and x.

    ``edge``: 'reflect' (d c b a | a b c d | d c b a) or 'replicate'.
    """
    udf = {"reflect": _separable_reflect, "replicate": _separable_replicate}[edge]
    return udf(data, dz, dy, dx, taps)


def _trilinear(vol, z, y, x, outside):
    """Linear interpolation at the grid spanned by three coordinate vectors."""
    out = vol
    for axis, at in enumerate((z, y, x)):
        n = out.shape[axis]
        low = np.clip(np.floor(at).astype(np.int64), 0, n - 1)
        high = np.minimum(low + 1, n - 1)
        shape = [-1 if a == axis else 1 for a in range(3)]
        t = np.clip(at - low, 0.0, 1.0).reshape(shape)
        out = np.take(out, low, axis=axis) * (1.0 - t) + np.take(out, high, axis=axis) * t
    if outside is not None:
        for axis, at in enumerate((z, y, x)):
            off = (at < 0) | (at > vol.shape[axis] - 1)
            if off.any():
                index = [slice(None)] * 3
                index[axis] = off
                out[tuple(index)] = outside
    return out


@_kernel(ARRAY)
def _sample_grid(
    data: pa.Array, dz: pa.Array, dy: pa.Array, dx: pa.Array, z: pa.Array, y: pa.Array, x: pa.Array, outside: pa.Array
) -> pa.Array:
    out = (
        _trilinear(v.reshape(s), a, b, c, o).ravel()
        for v, s, a, b, c, o in zip(
            _rows(data), _shapes(dz, dy, dx), _rows(z), _rows(y), _rows(x), outside.to_pylist()
        )
    )
    return _pack(out)


def sample_grid(data, dz, dy, dx, z, y, x, outside=None):
    """Trilinear samples of a dense row on the grid of three coordinate arrays.

    Coordinates past the edge take the edge value, or ``outside`` if given.
    """
    fill = F.lit(None).cast("double") if outside is None else F.lit(float(outside))
    return _sample_grid(data, dz, dy, dx, z, y, x, fill)


def _read_at(vol, *maps):
    """Cells at three index vectors; indices outside the volume read 0."""
    out = vol
    for axis, at in enumerate(maps):
        at = np.nan_to_num(np.asarray(at, np.float64), nan=-1.0).astype(np.int64)
        n = vol.shape[axis]
        out = np.take(out, np.clip(at, 0, n - 1), axis=axis)
        index = [slice(None)] * 3
        index[axis] = (at < 0) | (at >= n)
        out[tuple(index)] = 0.0
    return out


@_kernel(ARRAY)
def _gather(data: pa.Array, dz: pa.Array, dy: pa.Array, dx: pa.Array, z: pa.Array, y: pa.Array, x: pa.Array) -> pa.Array:
    return _pack(
        _read_at(v.reshape(s), a, b, c).ravel()
        for v, s, a, b, c in zip(_rows(data), _shapes(dz, dy, dx), _rows(z), _rows(y), _rows(x))
    )


def gather(data, dz, dy, dx, z, y, x):
    """Cells of a dense row on the grid of three index arrays."""
    return _gather(data, dz, dy, dx, z, y, x)


@_kernel(ARRAY)
def _project_max(data: pa.Array, dz: pa.Array, dy: pa.Array, dx: pa.Array, axis: pa.Array) -> pa.Array:
    return _pack(
        v.reshape(s).max(axis=a).ravel() for v, s, a in zip(_rows(data), _shapes(dz, dy, dx), axis.to_pylist())
    )


def project_max(data, dz, dy, dx, axis):
    """Largest cell along an axis (0 is z), the other two in C order."""
    return _project_max(data, dz, dy, dx, F.lit(axis))


def _oriented(v, shape, flips, plane, turns):
    vol = np.flip(v.reshape(shape), [a for a in range(3) if flips[a]])
    return np.rot90(vol, turns, [(0, 1), (0, 2), (1, 2)][plane]).ravel()


def _otsu_index(counts, classes):
    """Index of the last threshold that maximises the between-class variance."""
    bins = len(counts)
    w = np.cumsum(counts)
    m = np.cumsum(counts * np.arange(bins))

    def term(weight, moment):
        return np.where(weight > 0, moment * moment / np.where(weight > 0, weight, 1.0), 0.0)

    last = term(w[-1] - w, m[-1] - m)
    first = term(w, m)
    if classes == 2:
        return int(np.argmax((first + last)[: bins - 1]))
    score = first[:, None] + term(w[None, :] - w[:, None], m[None, :] - m[:, None]) + last[None, :]
    t1, t2 = np.arange(bins)[:, None], np.arange(bins)[None, :]
    score = np.where((t2 > t1) & (t1 <= bins - 3) & (t2 <= bins - 2), score, -1.0)
    return int(np.argmax(score)) % bins


@_kernel(T.IntegerType())
def _otsu(counts: pa.Array, classes: pa.Array) -> pa.Array:
    return pa.array(
        [_otsu_index(c, k) for c, k in zip(_rows(counts), classes.to_pylist())], type=pa.int32()
    )


def otsu_index(counts, classes):
    """First best last-threshold bin of a histogram with 2 or 3 classes."""
    return _otsu(counts, F.lit(classes))


def _contrastive(anchors, pairs, others, mates, same, temperature, cosine):
    """Parts of the NT-Xent loss of some anchors against some other views.

    Per anchor: the positive's logit (-inf if it is not here), the largest
    negative logit, and the sum of exp(logit - largest). ``same`` says that the
    views are the anchors themselves.
    """
    if cosine:
        anchors, others = (r / np.maximum(np.linalg.norm(r, axis=1, keepdims=True), 1e-8) for r in (anchors, others))
    logits = anchors @ others.T / temperature
    mate = pairs[:, None] == mates[None, :]
    negative = np.where(mate, -np.inf, logits)
    if same:
        mate = mate & ~np.eye(len(pairs), dtype=bool)
    positive = np.where(mate, logits, -np.inf).max(axis=1)
    top = negative.max(axis=1)
    total = np.exp(negative - np.where(np.isfinite(top), top, 0.0)[:, None]).sum(axis=1)
    return np.stack([positive, top, total], axis=1)


@_kernel(ARRAY)
def _ntxent(a: pa.Array, p: pa.Array, b: pa.Array, q: pa.Array, same: pa.Array, temperature: pa.Array, cosine: pa.Array) -> pa.Array:
    ids = lambda column: (np.array(x) for x in column.to_pylist())
    return _pack(
        _contrastive(x.reshape(len(i), -1), i, y.reshape(len(j), -1), j, s, t, c).ravel()
        for x, i, y, j, s, t, c in zip(
            _rows(a), ids(p), _rows(b), ids(q), same.to_pylist(), temperature.to_pylist(), cosine.to_pylist()
        )
    )


def ntxent(a, p, b, q, same, temperature, cosine):
    """[positive, top, total] of each anchor of one block against another block."""
    return _ntxent(a, p, b, q, same, F.lit(float(temperature)), F.lit(bool(cosine)))


@_kernel(ARRAY)
def _cut(data: pa.Array, place: pa.Array, edge: pa.Array) -> pa.Array:
    if not len(data):
        return _packed(np.zeros(0), [])
    first, m = data.offsets.to_numpy().astype(np.int64), _matrix(place, 6)
    # An absent chunk has no cells.
    size = np.where((np.diff(first) > 0)[:, None], m[:, 3:], 0)
    flat = data.values.to_numpy(zero_copy_only=False)
    return _packed(_cut_boxes(flat, first[:-1], [edge[0].as_py()] * 3, m[:, :3], size), size.prod(axis=1))


def cut(data, corner, size, edge):
    """The part of a chunk of ``edge``^3 cells at ``corner``; an absent chunk has none."""
    return _cut(data, F.array(*corner, *size), F.lit(edge))


@_kernel(ARRAY)
def _assemble(pieces: pa.Array, dz: pa.Array, dy: pa.Array, dx: pa.Array) -> pa.Array:
    dims = _ints(dz, dy, dx)
    cells = dims.prod(axis=1)
    first = np.cumsum(cells) - cells
    out = np.zeros(cells.sum())
    of, m, flat = _pieces(pieces, 6)
    if len(flat) > LARGE_BOX * len(m):
        at = 0
        for row, (*corner, nz, ny, nx) in zip(of.tolist(), m.tolist()):
            n = nz * ny * nx
            box = tuple(slice(a, a + k) for a, k in zip(corner, (nz, ny, nx)))
            out[first[row] : first[row] + cells[row]].reshape(dims[row])[box] = flat[at : at + n].reshape(nz, ny, nx)
            at += n
        return _packed(out, cells)
    box, z, y, x = _box_cells(m[:, 3:])
    z, y, x = (k + m[box, i] for i, k in enumerate((z, y, x)))
    row = of[box]
    out[first[row] + (z * dims[row, 1] + y) * dims[row, 2] + x] = flat
    return _packed(out, cells)


def assemble(pieces, dz, dy, dx):
    """Dense row of disjoint pieces, zeros elsewhere; each has a ``place`` (corner and
    size) and the cells ``p``."""
    return _assemble(pieces, dz, dy, dx)


def window_pieces(windows, keys, patch, edge):
    """(*keys, cz, cy, cx, place, p): windows of ``patch``^3 cells cut at chunk borders.

    ``windows``: (*keys, w{a} corner, lo{a} and hi{a} of the part to keep, data).
    ``place`` is nine integers: corner in the chunk, size, corner in the window.
    """
    names = [*keys, "cz", "cy", "cx", "place", "p"]
    bound_batches(windows.sparkSession, BATCH_BYTES)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            corner, lo, hi = (_ints(*[batch.column(f"{c}{a}") for a in "zyx"]) for c in ("w", "lo", "hi"))
            start = lo // edge
            row, *steps = _box_cells(np.where(lo < hi, (hi - 1) // edge - start + 1, 0))
            chunk = start[row] + np.stack(steps, axis=1)
            first = np.maximum(lo[row], chunk * edge)
            size = np.minimum(hi[row], (chunk + 1) * edge) - first
            inside = first - corner[row]
            data = batch.column("data")
            cells = _cut_boxes(data.values.to_numpy(zero_copy_only=False), data.offsets.to_numpy().astype(np.int64)[row], [patch] * 3, inside, size)
            place = np.concatenate([first - chunk * edge, size, inside], axis=1).astype(np.int32)
            place = pa.ListArray.from_arrays(pa.array(np.arange(len(place) + 1) * 9, pa.int32()), pa.array(place.ravel()))
            kept = [batch.column(k).take(pa.array(row)) for k in keys]
            yield pa.RecordBatch.from_arrays(
                [*kept, *(pa.array(c, pa.int32()) for c in chunk.T), place, _packed(cells, size.prod(axis=1))], names=names
            )

    fields = [f for k in keys for f in windows.schema.fields if f.name == k]
    ints = [T.StructField(c, T.IntegerType()) for c in ("cz", "cy", "cx")]
    lists = [T.StructField("place", T.ArrayType(T.IntegerType())), T.StructField("p", ARRAY)]
    return windows.mapInArrow(run, T.StructType([*fields, *ints, *lists]))


def blend(pieces, profile, edge):
    """Weighted mean of the pieces of one chunk, as ``window_pieces`` gives them.

    ``profile``: window weight along an axis; a cell's weights are floored at 1e-3.
    """
    profile = np.array(profile, np.float64)

    def run(pieces: pa.Array) -> pa.Array:
        of, m, flat = _pieces(pieces, 9)
        box, z, y, x = _box_cells(m[:, 3:6])
        w = profile[z + m[box, 6]] * profile[y + m[box, 7]] * profile[x + m[box, 8]]
        w = np.maximum(w, 1e-3)
        at = ((of[box] * edge + z + m[box, 0]) * edge + y + m[box, 1]) * edge + x + m[box, 2]
        n = len(pieces) * edge**3
        total, weight = (np.bincount(at, weights=v, minlength=n) for v in (flat * w, w))
        out = np.where(weight > 1e-6, total / np.maximum(weight, 1e-6), 0.0)
        return _packed(out, np.full(len(pieces), edge**3))

    return _kernel(ARRAY)(run)(pieces)


@_kernel(ARRAY)
def _fill(entries: pa.Array, cells: pa.Array) -> pa.Array:
    if not len(entries):
        return _packed(np.zeros(0), [])
    n, rows = cells[0].as_py(), len(entries)
    of = np.repeat(np.arange(rows), np.diff(entries.offsets.to_numpy()))
    inner = entries.flatten()
    idx, value = inner.field("idx"), inner.field("value")
    placed, known = idx.is_valid().to_numpy(zero_copy_only=False), value.is_valid().to_numpy(zero_copy_only=False)
    absent = np.zeros(rows, bool)
    absent[of[~placed]] = True
    value = value.to_numpy(zero_copy_only=False)
    if not placed.all():
        of, value, known, idx = of[placed], value[placed], known[placed], idx.drop_null()
    idx = idx.to_numpy(zero_copy_only=False).astype(np.int64)
    if len(idx) and not (0 <= idx.min() and idx.max() < n):
        raise ValueError("a voxel lies outside the shape of its patch")
    at = of * n + idx
    flat, unknown = np.zeros(rows * n), np.zeros(rows * n, bool)
    flat[at] = 1.0
    if flat.sum() < len(at):
        # The largest value of a repeated voxel stays.
        order = np.lexsort((value, known, at))
        at, value, known = at[order], value[order], known[order]
    flat[at], unknown[at] = value, ~known
    return _packed(flat, np.full(rows, n), unknown, absent)


def fill(entries, cells):
    """Dense row of ``cells`` cells from its (idx, value) entries in any order, 0 elsewhere.

    A null value is a null cell; a null index makes the row null.
    """
    return _fill(entries, F.lit(cells))


def merged(n, u, v):
    """The smallest member of each of ``n`` elements' group, given linked pairs."""
    root = np.arange(n)
    while True:
        a, b = root[u], root[v]
        apart = a != b
        if not apart.any():
            return root
        u, v = u[apart], v[apart]
        a, b = a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up


def label_runs(mask, conn):
    """Flat position of the first voxel of each foreground voxel's object in one chunk.

    Runs along x are linked to those they touch in the lines before and below;
    (flat positions of the foreground, their labels), in C order.
    """
    dz, dy, dx = mask.shape
    reach, steps = (1, [(0, 1), (1, -1), (1, 0), (1, 1)]) if conn == 26 else (0, [(0, 1), (1, 0)])
    wide = np.zeros((dz * dy, dx + 2), np.int8)
    wide[:, 1:-1] = mask.reshape(dz * dy, dx)
    edge = np.diff(wide, axis=1)
    line, x0 = np.nonzero(edge == 1)
    _, x1 = np.nonzero(edge == -1)
    z, y, width = line // dy, line % dy, dx + 4
    first_key, end_key = line * width + x0 + 2, line * width + x1 + 2
    us, vs = [], []
    for sz, sy in steps:
        use = np.flatnonzero((z + sz < dz) & (y + sy >= 0) & (y + sy < dy))
        other = (line[use] + sz * dy + sy) * width + 2
        lo = np.searchsorted(end_key, other + x0[use] - reach, side="right")
        hi = np.searchsorted(first_key, other + x1[use] + reach, side="left")
        n = np.maximum(hi - lo, 0)
        ends = np.cumsum(n)
        us.append(np.repeat(use, n))
        vs.append(np.repeat(lo - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0))
    root = merged(len(line), np.concatenate(us), np.concatenate(vs))
    return np.flatnonzero(mask.ravel()), np.repeat((line * dx + x0)[root], x1 - x0)


def contacts(a, b, step, conn):
    """Distinct labels that touch across the borders of pairs of chunks: (pair, label, label).

    ``a`` and ``b`` are the cells of either side, pair by pair, with one cell along
    the axes of ``step`` that are not 0; background is negative.
    """
    spread = [range(-1, 2) if s == 0 and conn == 26 else range(1) for s in step]
    found = []
    for shift in itertools.product(*spread):
        left = a[(slice(None), *(slice(max(0, -k), n - max(0, k)) for k, n in zip(shift, a.shape[1:])))]
        right = b[(slice(None), *(slice(max(0, k), n - max(0, -k)) for k, n in zip(shift, b.shape[1:])))]
        both = (left >= 0) & (right >= 0)
        found.append(np.stack([np.nonzero(both)[0], left[both], right[both]], axis=1))
    return np.unique(np.concatenate(found), axis=0)


def _reduce_blocks(vol, factors, how, pad):
    """Pooled copy of one dense row."""
    if pad:
        vol = np.pad(vol, [(0, -n % f) for n, f in zip(vol.shape, factors)])
    shape = [n // f for n, f in zip(vol.shape, factors)]
    vol = vol[tuple(slice(0, n * f) for n, f in zip(shape, factors))]
    cells = vol.reshape([k for n, f in zip(shape, factors) for k in (n, f)])
    if how == "max":
        return cells.max(axis=(1, 3, 5))
    # The order of the sum is that of the cells, whatever the shape.
    parts = [cells[:, i, :, j, :, k] for i in range(factors[0]) for j in range(factors[1]) for k in range(factors[2])]
    return sum(parts[1:], parts[0].copy()) / float(math.prod(factors))


@_kernel(ARRAY)
def _pool(data: pa.Array, dz: pa.Array, dy: pa.Array, dx: pa.Array, factors: pa.Array, how: pa.Array, pad: pa.Array) -> pa.Array:
    return _pack(
        _reduce_blocks(v.reshape(s), tuple(f), h, p).ravel()
        for v, s, f, h, p in zip(_rows(data), _shapes(dz, dy, dx), factors.to_pylist(), how.to_pylist(), pad.to_pylist())
    )


def pool(data, dz, dy, dx, factors, how, pad):
    """Mean or max over blocks of a dense row; the rest is padded with 0 or cropped."""
    return _pool(data, dz, dy, dx, F.array(*[F.lit(f) for f in factors]), F.lit(how), F.lit(pad))


@_kernel(ARRAY)
def _transpose(data: pa.Array, dz: pa.Array, dy: pa.Array, dx: pa.Array, perm: pa.Array, flips: pa.Array) -> pa.Array:
    return _pack(
        np.flip(v.reshape(s), [a for a in range(3) if f[a]]).transpose(p).ravel()
        for v, s, p, f in zip(_rows(data), _shapes(dz, dy, dx), perm.to_pylist(), flips.to_pylist())
    )


def transpose(data, dz, dy, dx, perm, flips):
    """Flip axes (three boolean columns), then put them in the order ``perm``."""
    return _transpose(data, dz, dy, dx, F.array(*[F.lit(p) for p in perm]), F.array(*flips))


def _scaled(v, mean, sd):
    """(v - mean) / sd."""
    return (v - mean) / sd


@_kernel(ARRAY)
def _zscore(data: pa.Array, center: pa.Array, eps: pa.Array) -> pa.Array:
    def one(v, center, eps):
        mean, sd = v.mean(), v.std()
        if center:
            return _scaled(v, mean, sd) if sd >= eps else v - mean
        return _scaled(v, mean, sd) if sd > eps else v

    return _pack(one(v, c, e) if len(v) else v for v, c, e in zip(_rows(data), center.to_pylist(), eps.to_pylist()))


def zscore(data, center, eps):
    """Scale a row by its own mean and population sd; a flat one is kept or centred."""
    return _zscore(data, F.lit(center), F.lit(float(eps)))


@_kernel(ARRAY)
def _zscore_valid(data: pa.Array, valid: pa.Array, least: pa.Array, eps: pa.Array) -> pa.Array:
    def one(v, ok, least, eps):
        # As in SQL, nothing is at least a sum with an unknown part.
        if not np.trunc(ok).sum() >= least:
            return None
        ok = ok > 0
        real = v[ok]
        sd = real.std() if len(real) else 0.0
        out = np.zeros(len(v))
        out[ok] = _scaled(real, real.mean() if len(real) else 0.0, sd if sd > eps else 1.0)
        return out

    rows = zip(_rows(data), _rows(valid.cast(pa.list_(pa.float64()))), least.to_pylist(), eps.to_pylist())
    out = [one(v, ok, k, e) if known else None for (v, ok, k, e), known in zip(rows, valid.is_valid().to_pylist())]
    absent = np.array([r is None for r in out], bool)
    rows = [np.zeros(0) if r is None else r for r in out]
    return _packed(np.concatenate(rows) if rows else np.zeros(0), [len(r) for r in rows], None, absent)


def zscore_valid(data, valid, min_valid, eps):
    """Scale by the cells where ``valid`` is above 0; the others become 0. Null where
    fewer than ``min_valid`` are valid."""
    return _zscore_valid(data, valid, F.lit(min_valid), F.lit(float(eps)))


@_kernel(ARRAY)
def _minmax(data: pa.Array, eps: pa.Array) -> pa.Array:
    def one(v, eps):
        if not len(v) or not v.max() - v.min() > eps:
            return v
        return (v - v.min()) / (v.max() - v.min())

    return _pack(one(v, e) for v, e in zip(_rows(data), eps.to_pylist()))


def minmax(data, eps):
    """Scale a row to [0, 1]; unchanged if its range is at most eps."""
    return _minmax(data, F.lit(float(eps)))


@_kernel(ARRAY)
def _positive_moments(raw: pa.Array, corrected: pa.Array) -> pa.Array:
    starts, ends = (x.offsets.to_numpy().astype(np.int64) for x in (raw, corrected))
    sizes = np.diff(ends)
    row = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(ends[0], ends[-1])
    own = at - ends[:-1][row] + starts[:-1][row]
    there = own < starts[1:][row]
    r, c = (x.values.to_numpy(zero_copy_only=False) for x in (raw, corrected))
    there[there] = raw.values.is_valid().to_numpy(zero_copy_only=False)[own[there]]
    # A cell that is not a number counts as above 0, as in Spark; a null one does not.
    there[there] = ~(r[own[there]] <= 0)
    row, at = row[there], at[there]
    n = np.bincount(row, minlength=len(sizes))
    total = np.bincount(row, weights=c[at], minlength=len(sizes))
    mean = total / np.maximum(n, 1)
    sd = np.sqrt(np.bincount(row, weights=(c[at] - mean[row]) ** 2, minlength=len(sizes)) / np.maximum(n, 1))
    absent = n == 0
    absent[row[~corrected.values.is_valid().to_numpy(zero_copy_only=False)[at]]] = True
    return _packed(np.stack([n, mean, sd], axis=1).ravel(), np.full(len(sizes), 3), None, absent)


def positive_moments(raw, corrected):
    """[n, mean, population sd] of the corrected cells where ``raw`` is above 0; null
    without such cells."""
    return _positive_moments(raw, corrected)


def _fields_at(vols, at, outside):
    """As ``_trilinear``, for many volumes of one shape with coordinates of their own."""
    out = vols
    for axis, a in enumerate(at, 1):
        n = out.shape[axis]
        shape = [len(a), *(a.shape[1] if k == axis else 1 for k in (1, 2, 3))]
        low = np.clip(np.floor(a).astype(np.int64), 0, n - 1)
        t = np.clip(a - low, 0.0, 1.0).reshape(shape)
        low, high = low.reshape(shape), np.minimum(low + 1, n - 1).reshape(shape)
        out = np.take_along_axis(out, low, axis) * (1.0 - t) + np.take_along_axis(out, high, axis) * t
    for axis, a in enumerate(at, 1):
        off = (a < 0) | (a > vols.shape[axis] - 1)
        out = np.where(off.reshape([len(a), *(a.shape[1] if k == axis else 1 for k in (1, 2, 3))]), outside, out)
    return out


def over_field(data, dims, origin, field, shape, scale):
    """Cells divided by a low-resolution field, sampled linearly; 1 outside it.

    ``origin``: corner of the row in the field's volume; ``scale``: field cells per
    cell along z, y and x.
    """
    def run(data: pa.Array, dz: pa.Array, dy: pa.Array, dx: pa.Array, z: pa.Array, y: pa.Array, x: pa.Array,
            field: pa.Array, bz: pa.Array, by: pa.Array, bx: pa.Array) -> pa.Array:
        sizes, corners, shapes = _ints(dz, dy, dx), _ints(z, y, x), _ints(bz, by, bx)
        values, fields = (c.values.to_numpy(zero_copy_only=False) for c in (data, field))
        first, start = data.offsets.to_numpy(), field.offsets.to_numpy()
        unknown = data.values.is_null().to_numpy(zero_copy_only=False)[first[0] : first[-1]]
        out = np.array(values[first[0] : first[-1]])
        # Neighbouring rows of one shape are sampled at once.
        both = np.concatenate([sizes, shapes], axis=1)
        cells = max(1, BATCH_BYTES // (8 * int(sizes.prod(axis=1).max(initial=1))))
        apart = [0, *(np.flatnonzero((both[1:] != both[:-1]).any(axis=1)) + 1).tolist(), len(both)]
        for a, z in ((i, min(i + cells, z)) for a, z in zip(apart, apart[1:]) for i in range(a, z, cells)):
            if np.any(first[a + 1 : z + 1] == first[a:z]):
                # A null row among them.
                full = [i for i in range(a, z) if first[i + 1] > first[i]]
            else:
                full = range(a, z)
            if not len(full):
                continue
            at = [(corners[full, k][:, None] + np.arange(sizes[a, k])) * scale[k] for k in range(3)]
            vols = np.stack([fields[start[i] : start[i + 1]].reshape(shapes[a]) for i in full])
            b = np.maximum(_fields_at(vols, at, 1.0).reshape(len(full), -1), 1e-6)
            for i, row in zip(full, b):
                out[first[i] - first[0] : first[i + 1] - first[0]] /= row
        return _packed(out, np.diff(first), unknown, data.is_null().to_numpy(zero_copy_only=False))

    return _kernel(ARRAY)(run)(data, *dims, *origin, field, *shape)


def cells_at(patches, keys, entries, arrays):
    """(*keys, *entry fields, *arrays): a row per entry with the cells at its place.

    ``entries``: list of structs with z, y, x among their fields; ``arrays``: new
    names of columns of dense cells. A place outside reads null.
    """
    fields = patches.schema[entries].dataType.elementType.fields
    bound_batches(patches.sparkSession, BATCH_BYTES)

    def run(batches):
        for batch in batches:
            lists = batch.column(entries)
            row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            inner = lists.flatten()
            z, y, x = _ints(*[inner.field(a) for a in "zyx"]).T
            dims = _ints(batch.column("dy"), batch.column("dx"))[row]
            place = (z * dims[:, 0] + y) * dims[:, 1] + x
            found = []
            for name in arrays:
                data = batch.column(name)
                first = data.offsets.to_numpy().astype(np.int64)
                size = np.diff(first)[row]
                found.append(data.values.take(pa.array(first[row] + place, mask=(place < 0) | (place >= size))))
            kept = [batch.column(k).take(pa.array(row)) for k in keys]
            yield pa.RecordBatch.from_arrays(
                [*kept, *(inner.field(f.name) for f in fields), *found], names=[*keys, *(f.name for f in fields), *arrays.values()]
            )

    known = {f.name: f for f in patches.schema.fields}
    rows = patches.select(*keys, "dy", "dx", entries, *arrays)
    return rows.mapInArrow(run, T.StructType([*(known[k] for k in keys), *fields, *(T.StructField(n, T.DoubleType()) for n in arrays.values())]))


@_kernel(ARRAY)
def _affine(data: pa.Array, shift: pa.Array, scale: pa.Array) -> pa.Array:
    return _pack((v - m) / k for v, m, k in zip(_rows(data), shift.to_pylist(), scale.to_pylist()))


def affine(data, shift, scale):
    """(v - shift) / scale with numbers of the same row."""
    return _affine(data, shift, scale)


# --- steps of augmented copies, one after the other in one function


def _cell_hash(base, n):
    """As the column function ``cell_hash``, for cells 0 to n - 1."""
    mod, i = np.int64(2147483647), np.arange(n, dtype=np.int64)
    first = (base + i * np.int64(48271)) % mod
    second = (first * first + base) % mod
    return (second * second + i) % mod


def _normals(a, b, n):
    """Standard normal draws of n cells from two hashes (Box-Muller)."""
    u1, u2 = (_cell_hash(a, n) + 1.0) / 2147483647.0, _cell_hash(b, n) / 2147483647.0
    return np.sqrt(-2.0 * np.log(u1)) * np.cos(6.283185307179586 * u2)


def _limited(v, clamp):
    return np.clip(v, 0.0, 1.0) if clamp else v


def _noised(v, shape, apply, sd, a, b, clamp):
    return _limited(v + sd * _normals(a, b, len(v)), clamp) if apply else v


def _blurred(v, shape, taps):
    return _convolve(v.reshape(shape), taps, "edge").ravel()


def _jittered(v, shape, apply, shift, contrast, clamp):
    if not apply or not len(v):
        return v
    return _limited((v - v.mean()) * contrast + v.mean() + shift, clamp)


def _power(v, g, keep):
    out = np.maximum(v - v.min(), 1e-8) ** g
    if not keep:
        return out
    sd = lambda x: np.sqrt(((x - x.mean()) ** 2).sum() / (len(x) - 1)) + 1e-8
    return (out - out.mean()) / sd(out) * sd(v) + v.mean()


def _powered(v, shape, apply, g, mode):
    if not apply or not len(v):
        return v
    if mode == "plain":
        return np.clip(np.maximum(v, 1e-8) ** g, 0.0, 1.0)
    if mode == "signed":
        return np.sign(v) * np.maximum(np.abs(v), 1e-6) ** g
    return _power(v, g, mode == "keep")


def _regrown(v, shape, *small):
    """Nearest-neighbour shrink to ``small``, then trilinear growth back."""
    down = [np.floor(np.arange(n) * d / n) for n, d in zip(small, shape)]
    up = [np.maximum((np.arange(d) + 0.5) * (n / d) - 0.5, 0.0) for n, d in zip(small, shape)]
    return _trilinear(_trilinear(v.reshape(shape), *down, None), *up, None).ravel()


def _ramped(v, shape, apply, strength, axis, clamp):
    if not apply:
        return v
    n = shape[axis]
    at = np.arange(n).reshape([-1 if i == axis else 1 for i in range(3)])
    return _limited(v.reshape(shape) - strength + strength * 2.0 * at / max(n - 1, 1), clamp).ravel()


def _clipped(v, shape, lo, hi):
    return np.clip(v, lo, hi)


def orient(flips, plane, turns):
    """Flip axes (array of three booleans), then rotate by quarter turns in a plane.

    Planes: 0 is (z, y), 1 is (z, x), 2 is (y, x).
    """
    return _oriented, flips, plane, turns


def noise(apply, sd, a, b, clamp=False):
    """Add normal draws of a standard deviation from two hash bases."""
    return _noised, apply, sd, a, b, F.lit(clamp)


def blur(taps):
    """The same taps along z, y and x, edges replicated; none leave a row as it is."""
    return _blurred, taps


def jitter(apply, shift, contrast, clamp=False):
    """Contrast around the mean, then a shift."""
    return _jittered, apply, shift, contrast, F.lit(clamp)


def gamma(apply, g, mode):
    """Power of the values: ``plain`` in [0, 1], ``signed`` with their sign, or above
    the minimum, with mean and sample sd restored (``keep``) or not (``free``)."""
    return _powered, apply, g, F.lit(mode)


def regrow(*small):
    """Shrink to ``small`` cells along z, y and x, and grow back."""
    return _regrown, *small


def ramp(apply, strength, axis, clamp=False):
    """Add a linear ramp from -strength to strength along an axis (0 is z)."""
    return _ramped, apply, strength, axis, F.lit(clamp)


def clip(lo, hi):
    return _clipped, F.lit(float(lo)), F.lit(float(hi))


def run_steps(data, dz, dy, dx, steps):
    """Dense rows after some steps, each a row function and its parameter columns.

    All of them run in one Python function: every function of its own costs a
    worker process per task, with a batch of rows in each. Where a step's
    ``apply`` is false, a row stays as it is.
    """
    functions = [(fn, [f"s{i}_{k}" for k in range(len(params))]) for i, (fn, *params) in enumerate(steps)]
    columns = [p.alias(name) for (_, names), (_, *params) in zip(functions, steps) for name, p in zip(names, params)]

    def run(data: pa.Array, dz: pa.Array, dy: pa.Array, dx: pa.Array, params: pa.Array) -> pa.Array:
        def one(v, shape, p):
            for fn, names in functions:
                v = fn(v, shape, *(p[n] for n in names))
            return v

        return _pack(one(v, s, p) for v, s, p in zip(_rows(data), _shapes(dz, dy, dx), params.to_pylist()))

    return _kernel(ARRAY)(run)(data, dz, dy, dx, F.struct(*columns))


def hashed_volumes(ids, key, edge):
    """(key, dz, dy, dx, data) of (key, base): a cube of values in [0, 1) per hash base.

    An id takes a few bytes and its volume many, so what is returned at once is
    bounded, not what is read.
    """
    cells = edge**3
    most = max(1, BATCH_BYTES // (8 * cells))

    def run(batches):
        for batch in batches:
            for first in range(0, batch.num_rows, most):
                part = batch.slice(first, most)
                bases = part.column("base").to_pylist()
                flat = [np.full(cells, np.nan) if b is None else _cell_hash(b, cells) / 2147483647.0 for b in bases]
                unknown = np.repeat([b is None for b in bases], cells)
                data = pa.ListArray.from_arrays(
                    pa.array(np.arange(len(bases) + 1) * cells, pa.int32()), pa.array(np.concatenate(flat), mask=unknown)
                )
                size = [pa.array(np.full(len(bases), edge), pa.int32())] * 3
                yield pa.RecordBatch.from_arrays([part.column(key), *size, data], names=[key, "dz", "dy", "dx", "data"])

    return ids.mapInArrow(run, f"`{key}` {ids.schema[key].dataType.simpleString()}, dz int, dy int, dx int, data array<double>")


def _counts(v, lo, hi, bins):
    """Equal-width counts over [lo, hi]; all in the first bin if that is empty."""
    if not hi > lo:
        return np.bincount([0] * len(v), minlength=bins)
    at = np.floor((v - lo) / (hi - lo) * bins).astype(np.int64)
    return np.bincount(np.minimum(at, bins - 1), minlength=bins)


@_kernel(T.ArrayType(T.LongType()))
def _histogram(data: pa.Array, lo: pa.Array, hi: pa.Array, bins: pa.Array) -> pa.Array:
    rows = [_counts(v, a, b, k) for v, a, b, k in zip(_rows(data), lo.to_pylist(), hi.to_pylist(), bins.to_pylist())]
    return pa.array([r.astype(np.int64) for r in rows], pa.list_(pa.int64()))


def histogram(data, lo, hi, bins):
    """Counts of a dense row in ``bins`` equal steps from lo to hi."""
    return _histogram(data, lo, hi, F.lit(bins))
