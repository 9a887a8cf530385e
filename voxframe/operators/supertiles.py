"""Sliding-window inference over whole volumes, from chunk rows to chunk rows.

Windows of ``patch``^3 voxels start at the multiples of ``stride`` from
``stride - patch`` on (a stride divides a patch). Blocks of any number of windows
with a halo of ``patch - stride`` give the same windows, so none is built: every
window belongs to the chunk that its first voxel lies in.

* ``windows``: each chunk sends the part that its lower neighbours need to them,
  once. A chunk with these parts holds all its windows; they leave it as rows,
  already normalised by the voxels inside the volume.
* a model is any function from these rows to rows with ``data`` replaced.
* ``blend``: the predictions of one chunk are added up where they are, and the
  sums go back to the chunks they cover. Weights are not sent: they follow from
  the starts of the windows.

A row holds one window, or one chunk and its halo; what moves is
((edge + patch - stride) / edge)^3 times the volume each way, whatever the overlap.
"""

import collections
import functools
import itertools
import math
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import functions as F

from voxframe.operators.stitch import gaussian_profile

cloudpickle.register_pickle_by_value(sys.modules[__name__])

AXES = "zyx"
#: Bytes of voxels in one record batch, beyond single rows.
BATCH = 4 << 20


def _check(edge, patch, stride):
    if patch % stride:
        raise ValueError("stride must divide patch")
    return patch - math.gcd(stride, edge)


def _starts(t, edge, patch, stride):
    """Window starts in chunk ``t`` of an axis, before the end of the volume is known."""
    low = max(t * edge, stride - patch)
    return range(-(-low // stride) * stride, (t + 1) * edge, stride)


def _some_start(t, edge, patch, stride):
    return len(_starts(t, edge, patch, stride)) > 0


def _spans(t, dim, edge, patch, stride):
    """(start in the chunk's block, first and end voxel inside the volume) of an axis' windows."""
    starts = [x for x in _starts(t, edge, patch, stride) if x < dim]
    return [(x - t * edge, max(0, -x), min(patch, dim - x)) for x in starts]


class _Rows:
    """Rows collected into record batches; arrays come as numpy arrays."""

    def __init__(self, schema):
        self.schema, self.rows, self.size = schema, [], 0

    def add(self, row):
        self.rows.append(row)
        self.size += sum(x.nbytes for x in row if isinstance(x, np.ndarray))

    def full(self):
        return self.size >= BATCH or len(self.rows) >= 4096

    def take(self):
        columns = []
        for field, values in zip(self.schema, zip(*self.rows) if self.rows else [[]] * len(self.schema)):
            if pa.types.is_list(field.type):
                offsets = np.cumsum([0, *map(len, values)]).astype(np.int32)
                flat = np.concatenate(values) if len(values) else np.zeros(0)
                columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, field.type.value_type)))
            else:
                columns.append(pa.array(values, field.type))
        self.rows, self.size = [], 0
        return pa.RecordBatch.from_arrays(columns, schema=self.schema)


def _schema(df, keys, ints, arrays):
    """DDL and Arrow schema: keys as in ``df``, then integers, then arrays."""
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = {f.name: f.dataType for f in df.schema.fields}
    arrow = [(k, to_arrow_type(kinds[k])) for k in keys] + [(c, pa.int32()) for c in ints]
    arrow += [(c, pa.list_({"int": pa.int32(), "float": pa.float32(), "double": pa.float64()}[t])) for c, t in arrays.items()]
    ddl = [f"`{k}` {kinds[k].simpleString()}" for k in keys] + [f"{c} int" for c in ints] + [f"{c} array<{t}>" for c, t in arrays.items()]
    return ", ".join(ddl), pa.schema(arrow)


def _column(array):
    """A column without nulls as numbers."""
    return array.to_numpy(zero_copy_only=False)


def _lists(array):
    """All values of an array column and the bounds of its rows in them."""
    return array.values.to_numpy(zero_copy_only=False), array.offsets.to_numpy()


def _cubes(array, edge):
    """An array column of rows of edge^3 values, as one array of cubes."""
    values, ends = _lists(array)
    if (np.diff(ends) != edge**3).any():
        raise ValueError(f"rows must have {edge}^3 values")
    return values[ends[0] : ends[-1]].reshape(len(array), edge, edge, edge)


def _slices(n, size):
    """Bounds of slices of n rows of ``size`` bytes that hold about BATCH bytes, one row at least."""
    step = max(1, BATCH // max(1, size))
    return [(a, min(n, a + step)) for a in range(0, n, step)]


def _take(batch, names, rows):
    return [batch.column(c).take(pa.array(rows)) for c in names]


def _table(schema, keys, ints, arrays):
    """A record batch: key columns, integers, and arrays of one length per column."""
    columns = [*keys, *[pa.array(x, pa.int32()) for x in ints]]
    for field, x in zip(list(schema)[len(columns) :], arrays):
        x = x.reshape(len(x), -1)
        offsets = np.arange(len(x) + 1, dtype=np.int32) * np.int32(x.shape[1])
        columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(x.ravel(), field.type.value_type)))
    return pa.RecordBatch.from_arrays(columns, schema=schema)


def _kind(df):
    """Windows are single floats unless the chunks hold doubles."""
    return "double" if dict(df.dtypes)["data"] == "array<double>" else "float"


def halo_parts(chunks, keys, edge, patch, stride):
    """What each chunk sends to the chunks whose windows reach it: one row each.

    ``place``: corner and size of the part in the receiver's block.
    """
    reach, kind = _check(edge, patch, stride), _kind(chunks)
    width = edge + reach
    steps = range(-(-width // edge))
    ddl, schema = _schema(chunks, keys, ["tz", "ty", "tx"], {"place": "int", "part": kind})

    def run(batches):
        some_start = functools.lru_cache(1 << 14)(_some_start)
        for batch in batches:
            batch = batch.filter(batch.column("data").is_valid())
            for a, z in _slices(batch.num_rows, 8 * edge**3):
                some = batch.slice(a, z - a)
                vols = _cubes(some.column("data"), edge)
                at = np.stack([_column(some.column(f"c{x}")) for x in AXES], axis=1)
                for step in itertools.product(steps, repeat=3):
                    to = at - np.array(step)
                    # A chunk in which no window starts gets nothing.
                    rows = np.flatnonzero([all(some_start(t, edge, patch, stride) for t in place) for place in to.tolist()])
                    if len(rows):
                        size = [min(edge, width - d * edge) for d in step]
                        place = np.array([*(d * edge for d in step), *size], np.int32)
                        part = vols[rows, : size[0], : size[1], : size[2]]
                        yield _table(schema, _take(some, keys, rows), to[rows].T, [np.tile(place, (len(rows), 1)), part])

    return chunks.select(*keys, "cz", "cy", "cx", "data").mapInArrow(run, ddl)


def windows(chunks, volumes, keys, edge, patch, stride, min_valid=4096, eps=1e-8, normalise=True):
    """One row per window with at least ``min_valid`` voxels inside the volume.

    ``chunks``: (*keys, cz, cy, cx, data) of edge^3 cells, absent ones are 0;
    ``volumes``: (*keys, dim_z, dim_y, dim_x). Values are scaled by mean and
    population sd of the voxels inside the volume (only centred if sd <= eps);
    those outside it are 0. Returns (*keys, tz, ty, tx, dim_z, dim_y, dim_x, wz0,
    wy0, wx0, dz, dy, dx, data), t the chunk that the window starts in.
    """
    reach, kind = _check(edge, patch, stride), _kind(chunks)
    parts = halo_parts(chunks, keys, edge, patch, stride)
    blocks = volumes.select(*keys, *[F.col(f"dim_{a}").cast("int").alias(f"dim_{a}") for a in AXES])
    for a in AXES:
        first = math.floor((stride - patch) / edge)
        blocks = blocks.withColumn(f"t{a}", F.explode(F.sequence(F.lit(first), F.floor((F.col(f"dim_{a}") - 1) / edge).cast("int"))))
    # Chunks that are absent still have windows: every block gets a row of its own.
    at, dims = [f"t{a}" for a in AXES], [f"dim_{a}" for a in AXES]
    piece = F.struct("place", "part")
    joined = parts.select(*keys, *at, *[F.lit(None).cast("int").alias(d) for d in dims], piece.alias("piece")).unionByName(
        blocks.select(*keys, *at, *dims, F.lit(None).cast(f"struct<place:array<int>,part:array<{kind}>>").alias("piece"))
    )
    whole = joined.groupBy(*keys, *at).agg(*[F.max(d).alias(d) for d in dims], F.collect_list("piece").alias("pieces")).filter("dim_z IS NOT NULL")
    ints = [*at, *dims, "wz0", "wy0", "wx0", "dz", "dy", "dx"]
    ddl, schema = _schema(whole, keys, ints, {"data": kind})
    dtype = np.float64 if kind == "double" else np.float32

    def cut(blocks, found):
        """The windows ``found`` of ``blocks``, those alike at once."""
        out = np.zeros((len(found), patch, patch, patch), dtype)
        alike = collections.defaultdict(list)
        for j, (_, *spans) in enumerate(found):
            alike[tuple(spans)].append(j)
        for spans, own in alike.items():
            source = tuple(slice(s + b, s + h) for s, b, h in spans)
            inside = tuple(slice(b, h) for _, b, h in spans)
            real = blocks[(np.array([found[j][0] for j in own]), *source)]
            if normalise:
                shape = real.shape
                real = real.astype(np.float64).reshape(len(own), -1)
                sd = real.std(axis=1, keepdims=True)
                real = ((real - real.mean(axis=1, keepdims=True)) / np.where(sd > eps, sd, 1.0)).reshape(shape)
            out[(np.array(own), *inside)] = real
        return out

    def run(batches):
        size = (edge + reach) ** 3 * np.dtype(dtype).itemsize
        windows_of = functools.lru_cache(1 << 14)(_spans)
        for batch in batches:
            for a, z in _slices(batch.num_rows, size):
                some = batch.slice(a, z - a)
                to, dim = (np.stack([_column(some.column(c)) for c in names], axis=1) for names in (at, dims))
                blocks = np.zeros((z - a, *(edge + reach,) * 3), dtype)
                pieces = some.column("pieces")
                ends = pieces.offsets.to_numpy()
                place, place_ends = _lists(pieces.values.field("place"))
                part, part_ends = _lists(pieces.values.field("part"))
                for i, (first, last) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())):
                    for k in range(first, last):
                        z0, y0, x0, *n = place[place_ends[k] : place_ends[k] + 6].tolist()
                        blocks[i, z0 : z0 + n[0], y0 : y0 + n[1], x0 : x0 + n[2]] = part[part_ends[k] : part_ends[k + 1]].reshape(n)
                found = []
                for i, (t, d) in enumerate(zip(to.tolist(), dim.tolist())):
                    for spans in itertools.product(*[windows_of(x, y, edge, patch, stride) for x, y in zip(t, d)]):
                        reaches = [h - b for _, b, h in spans]
                        if min(reaches) > 0 and math.prod(reaches) >= min_valid:
                            found.append((i, *spans))
                for a_, z_ in _slices(len(found), patch**3 * np.dtype(dtype).itemsize):
                    use = found[a_:z_]
                    rows = np.array([i for i, *_ in use])
                    start = to[rows] * edge + np.array([[s for s, _, _ in spans] for _, *spans in use])
                    same = np.full((3, len(use)), patch)
                    yield _table(schema, _take(some, keys, rows), [*to[rows].T, *dim[rows].T, *start.T, *same], [cut(blocks, use)])

    return whole.mapInArrow(run, ddl)


def _profile(patch, sigma):
    return np.array(gaussian_profile(patch, float(sigma))) if sigma else np.ones(patch)


def _covered(starts, edge, patch, width):
    """(step, size, starts that reach it) of the chunks that a block's windows cover."""
    found = []
    for step in itertools.product(range(-(-width // edge)), repeat=3):
        size = [min(edge, width - d * edge) for d in step]
        over = [s for s in starts if all(x < d * edge + n and x + patch > d * edge for x, d, n in zip(s, step, size))]
        if over:
            found.append((step, size, np.array(over, np.int32)))
    return found


def _weight(profile, lo, hi):
    z, y, x = (profile[a:b] for a, b in zip(lo, hi))
    return np.maximum(z[:, None, None] * y[None, :, None] * x[None, None, :], 1e-3)


def blend(preds, keys, edge, patch, stride, gaussian=True, sigma=None, encode=False):
    """Weighted mean of the windows over each voxel, as chunk rows.

    ``preds``: the rows of ``windows`` with ``data`` replaced; their order is
    free. Chunks that no window covers are absent; cells outside the volume, and
    those with a weight of at most 1e-6, are 0. With ``encode`` probabilities
    become codes 0 to 255.
    """
    reach, kind = _check(edge, patch, stride), _kind(preds)
    width = edge + reach
    profile = _profile(patch, (sigma or patch / 8.0) if gaussian else None)
    at, dims = [f"t{a}" for a in AXES], [f"dim_{a}" for a in AXES]
    ints = ["cz", "cy", "cx", *dims, *[f"s{a}" for a in AXES]]
    ddl, schema = _schema(preds, keys, ints, {"size": "int", "starts": "int", "part": kind})

    def send(covered, key, to, dim, total, starts):
        low = [t * edge for t in to]
        for step, size, over in covered(tuple(tuple(x - b for x, b in zip(s, low)) for s in starts), edge, patch, width):
            c = [t + d for t, d in zip(to, step)]
            if all(0 <= k * edge < d for k, d in zip(c, dim)):
                part = total[tuple(slice(d * edge, d * edge + n) for d, n in zip(step, size))]
                yield (*key, *c, *dim, *to, np.array(size, np.int32), (over + np.array(low, np.int32)).ravel(), part.ravel())

    def add(batches):
        out, group, total, starts = _Rows(schema), None, None, []
        covered, weight = functools.lru_cache(256)(_covered), _weight(profile, (0, 0, 0), (patch,) * 3)
        for batch in batches:
            if not batch.num_rows:
                continue
            owns = list(zip(*[batch.column(c).to_pylist() for c in (*keys, *at, *dims)]))
            places = list(zip(*[batch.column(f"w{a}0").to_pylist() for a in AXES]))
            for a, z in _slices(batch.num_rows, 8 * patch**3):
                scaled = _cubes(batch.column("data").slice(a, z - a), patch) * weight
                for own, start, data in zip(owns[a:z], places[a:z], scaled):
                    if own != group:
                        if starts:
                            for row in send(covered, group[: len(keys)], group[-6:-3], group[-3:], total, starts):
                                out.add(row)
                                if out.full():
                                    yield out.take()
                        group, total, starts = own, np.zeros((width,) * 3), []
                    oz, oy, ox = (s - t * edge for s, t in zip(start, own[-6:-3]))
                    total[oz : oz + patch, oy : oy + patch, ox : ox + patch] += data
                    starts.append(start)
        if starts:
            for row in send(covered, group[: len(keys)], group[-6:-3], group[-3:], total, starts):
                out.add(row)
        yield out.take()

    parts = preds.select(*keys, *at, *dims, *[f"w{a}0" for a in AXES], "data").mapInArrow(add, ddl)
    sent = F.struct("sz", "sy", "sx", "size", "starts", "part")
    whole = parts.groupBy(*keys, "cz", "cy", "cx").agg(*[F.max(d).alias(d) for d in dims], F.collect_list(sent).alias("parts"))
    out_kind = "int" if encode else kind
    out_ddl, out_schema = _schema(whole, keys, ["cz", "cy", "cx", "dz", "dy", "dx"], {"data": out_kind})

    def weights(starts):
        """Sum of the weights of the windows at ``starts``, counted from the chunk."""
        weight = np.zeros((edge,) * 3)
        for start in starts:
            a, z = [max(s, 0) for s in start], [min(s + patch, edge) for s in start]
            box = tuple(slice(x, y) for x, y in zip(a, z))
            weight[box] += _weight(profile, [x - s for x, s in zip(a, start)], [y - s for y, s in zip(z, start)])
        return weight

    def mean(batches):
        out = _Rows(out_schema)
        # As many sums of weights as fit a batch stay with a task.
        summed = functools.lru_cache(max(1, BATCH // (8 * edge**3)))(weights)
        for batch in batches:
            if not batch.num_rows:
                continue
            own = list(zip(*[batch.column(k).to_pylist() for k in keys]))
            at, sizes = ([*zip(*[batch.column(n).to_pylist() for n in names])] for names in (("cz", "cy", "cx"), dims))
            parts = batch.column("parts")
            ends = parts.offsets.to_numpy().tolist()
            fields = {c: parts.values.field(c) for c in ("sz", "sy", "sx", "size", "starts", "part")}
            sent = list(zip(*[_column(fields[f"s{a}"]).tolist() for a in AXES]))
            size, size_ends = _lists(fields["size"])
            starts, start_ends = _lists(fields["starts"])
            part, part_ends = _lists(fields["part"])
            for i, (c, dim) in enumerate(zip(at, sizes)):
                total, low = np.zeros((edge,) * 3), [k * edge for k in c]
                # Parts in a fixed order: sums of floats depend on it.
                found = sorted((sent[k], starts[start_ends[k] : start_ends[k + 1]].tolist(), k) for k in range(ends[i], ends[i + 1]))
                for _, _, k in found:
                    n = size[size_ends[k] : size_ends[k + 1]].tolist()
                    total[: n[0], : n[1], : n[2]] += part[part_ends[k] : part_ends[k + 1]].reshape(n)
                from_chunk = np.array([x for _, s, _ in found for x in s]).reshape(-1, 3) - np.array(low)
                weight = summed(tuple(map(tuple, from_chunk.tolist())))
                data = np.where(weight > 1e-6, total / np.maximum(weight, 1e-6), 0.0)
                for axis, (b, d) in enumerate(zip(low, dim)):
                    if d - b < edge:
                        index = [slice(None)] * 3
                        index[axis] = slice(max(0, d - b), None)
                        data[tuple(index)] = 0.0
                if encode:
                    data = np.floor(np.clip(data * 255.0 + 0.5, 0, 255)).astype(np.int32)
                out.add((*own[i], *c, edge, edge, edge, data.ravel()))
                if out.full():
                    yield out.take()
        yield out.take()

    return whole.mapInArrow(mean, out_ddl)


def infer(chunks, volumes, keys, model, edge, patch=128, stride=64, min_valid=4096, gaussian=True, sigma=None, encode=True):
    """Windows, model, blend: chunk rows of a volume to chunk rows of its prediction."""
    rows = windows(chunks, volumes, keys, edge, patch, stride, min_valid)
    return blend(model(rows), keys, edge, patch, stride, gaussian, sigma, encode)
