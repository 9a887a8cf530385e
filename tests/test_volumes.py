"""Whole-volume work against plain numpy: statistics, inference, components, axes."""

import io
import itertools
import math
import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from voxframe.functions import scalar
from voxframe.operators import augment, components, dense, geometry, kernels, normalize, pooling, stitch, supertiles
from voxframe.session import scratch_dir
from voxframe.sources import readers

AXES = "zyx"


def chunk_rows(spark, volumes, edge, kind="double"):
    """Chunk rows (volume_id, cz, cy, cx, data) of {id: array}; empty chunks are absent."""
    rows = []
    for i, vol in volumes.items():
        wide = np.pad(vol, [(0, -n % edge) for n in vol.shape])
        for c in itertools.product(*[range(n // edge) for n in wide.shape]):
            part = wide[tuple(slice(k * edge, (k + 1) * edge) for k in c)]
            if part.any():
                rows.append((i, *c, part.ravel().tolist()))
    return spark.createDataFrame(rows, f"volume_id int, cz int, cy int, cx int, data array<{kind}>")


def shapes(spark, volumes):
    return spark.createDataFrame([(i, *v.shape) for i, v in volumes.items()], "volume_id int, dim_z int, dim_y int, dim_x int")


def assembled(rows, shape, edge):
    out = np.zeros([n + -n % edge for n in shape])
    for r in rows:
        out[tuple(slice(r[f"c{a}"] * edge, (r[f"c{a}"] + 1) * edge) for a in AXES)] = np.reshape(r["data"], (edge,) * 3)
    return out[tuple(slice(0, n) for n in shape)]


# --- statistics -----------------------------------------------------------


def test_global_stats_cut_on_raw_and_measure_corrected(spark):
    rng, rows, want = np.random.default_rng(3), [], {}
    for i in range(5):
        raw = rng.integers(0, 60 if i else 3, 4096).astype(float)
        # Means far above the spread: sums of squares would cancel.
        corrected = raw * rng.normal(1, 1e-4, 4096) + (1e7 if i == 2 else 0) * (raw > 0)
        corrected[rng.random(4096) < 0.1] = 0.0
        corrected[rng.random(4096) < 0.02] = np.nan
        if i == 4:
            corrected[:] = 0
        for c in range(4):
            part = slice(c * 1024, (c + 1) * 1024)
            rows.append((i, c, raw[part].tolist(), corrected[part].tolist()))
        nonzero = raw[raw > 0]
        fore = (raw > (np.percentile(nonzero, 5) if len(nonzero) > 1000 else 0)) & (corrected > 0)
        n = int(fore.sum())
        want[i] = (n, corrected[fore].mean() if n > 1000 else 0.0, corrected[fore].std() if n > 1000 else 1.0)
    rows += [(6, 0, None, None), (7, 0, [], []), (8, 0, [5.0] * 9, None)]
    want |= {i: (0, 0.0, 1.0) for i in (6, 7, 8)}
    chunks = spark.createDataFrame(rows, "volume_id int, c int, raw array<double>, corrected array<double>")
    got = {r.volume_id: r for r in normalize.global_stats(chunks, ["volume_id"], raw="raw", corrected="corrected").collect()}
    assert set(got) == set(want)
    for i, (n, mu, sigma) in want.items():
        assert got[i].n_fore == n
        np.testing.assert_allclose([got[i].mu, got[i].sigma], [mu, sigma], rtol=1e-9)


def test_scaling_kernels_equal_numpy(spark):
    rng = np.random.default_rng(1)
    rows = [(i, 2, 2, 5, v.tolist()) for i, v in enumerate([rng.normal(5, 2, 20), np.full(20, 3.0), rng.integers(0, 2, 20) * 1.0])]
    patches = spark.createDataFrame(rows, "patch_id int, dz int, dy int, dx int, data array<double>")
    for degenerate, flat in (("keep", 3.0), ("center", 0.0)):
        got = {r.patch_id: np.array(r.data) for r in normalize.zscore(patches, degenerate).collect()}
        assert all(got[1] == flat)
        np.testing.assert_allclose(got[0], (np.array(rows[0][4]) - np.mean(rows[0][4])) / np.std(rows[0][4]))
    got = {r.patch_id: np.array(r.data) for r in normalize.minmax(patches).collect()}
    assert all(got[1] == 3.0) and got[0].min() == 0 and got[0].max() == 1
    pooled = pooling.block_reduce(patches, (2, 2, 2), "max").filter("patch_id = 0").first()
    assert (pooled.dz, pooled.dy, pooled.dx) == (1, 1, 3)
    padded = np.pad(np.reshape(rows[0][4], (2, 2, 5)), [(0, 0), (0, 0), (0, 1)])
    np.testing.assert_allclose(pooled.data, [padded[:, :, k : k + 2].max() for k in (0, 2, 4)])


# --- inference ------------------------------------------------------------


def sigmoid(windows):
    """A stand-in for a network, as a function from rows to rows."""
    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index("data")
            data = batch.column("data")
            flat = data.values.to_numpy()
            out = pa.ListArray.from_arrays(data.offsets, pa.array(1 / (1 + np.exp(-flat)), data.type.value_type))
            yield batch.set_column(at, "data", out)

    return windows.mapInArrow(run, windows.schema)


def infer_by_buffers(vol, patch, stride, inner, min_valid, gaussian=True):
    """Super-tiles with halos, one after the other."""
    halo = patch - stride
    g = np.exp(-((np.arange(patch) - (patch - 1) / 2) ** 2) / (2 * (patch / 8) ** 2))
    g /= g.max()
    weight = np.maximum(g[:, None, None] * g[None, :, None] * g[None, None, :], 1e-3) if gaussian else np.ones((patch,) * 3)
    out, size = np.zeros(vol.shape), inner + 2 * halo
    for tile in itertools.product(*[range(0, n, inner) for n in vol.shape]):
        buffer, valid = np.zeros((size,) * 3), np.zeros((size,) * 3, bool)
        lo = [max(0, t - halo) for t in tile]
        hi = [min(n, t + inner + halo) for t, n in zip(tile, vol.shape)]
        at = tuple(slice(a - t + halo, b - t + halo) for a, b, t in zip(lo, hi, tile))
        buffer[at], valid[at] = vol[tuple(slice(a, b) for a, b in zip(lo, hi))], True
        total, weights = np.zeros(buffer.shape), np.zeros(buffer.shape)
        for start in itertools.product(range(0, size - patch + 1, stride), repeat=3):
            box = tuple(slice(s, s + patch) for s in start)
            ok = valid[box]
            if ok.sum() < min_valid:
                continue
            real = buffer[box][ok].astype(np.float64)
            sd = real.std()
            z = np.where(ok, (buffer[box] - real.mean()) / (sd if sd > 1e-8 else 1.0), 0.0)
            total[box] += weight / (1 + np.exp(-z))
            weights[box] += weight
        own = tuple(slice(halo, halo + min(inner, n - t)) for t, n in zip(tile, vol.shape))
        final = np.where(weights[own] > 1e-6, total[own] / np.maximum(weights[own], 1e-6), 0.0)
        out[tuple(slice(t, t + min(inner, n - t)) for t, n in zip(tile, vol.shape))] = final
    return out


@pytest.mark.parametrize("edge, patch, stride, gaussian", [(6, 8, 4, True), (4, 8, 4, True), (16, 8, 4, False), (5, 8, 2, True), (8, 8, 8, False)])
def test_inference_equals_buffers(spark, edge, patch, stride, gaussian):
    rng = np.random.default_rng(edge)
    volumes = {1: rng.integers(0, 50, (17, 9, 12)).astype(float), 2: rng.integers(0, 9, (8, 8, 21)).astype(float), 3: np.zeros((9, 9, 9))}
    volumes[1][:, :, 6:] = 0  # absent chunks inside a volume
    got = supertiles.infer(
        chunk_rows(spark, volumes, edge), shapes(spark, volumes), ["volume_id"], sigmoid, edge, patch, stride, min_valid=100, gaussian=gaussian, encode=False
    ).collect()
    for i, vol in volumes.items():
        want = infer_by_buffers(vol, patch, stride, 8, 100, gaussian)
        np.testing.assert_allclose(assembled([r for r in got if r.volume_id == i], vol.shape, edge), want, atol=1e-9)


def test_predictions_in_any_order_give_the_same_blend(spark):
    vol = {1: np.random.default_rng(0).integers(0, 50, (12, 12, 12)).astype(float)}
    rows = sigmoid(supertiles.windows(chunk_rows(spark, vol, 6), shapes(spark, vol), ["volume_id"], 6, 6, 3, min_valid=50))
    plain = assembled(supertiles.blend(rows, ["volume_id"], 6, 6, 3).collect(), (12,) * 3, 6)
    dealt = assembled(supertiles.blend(rows.repartition(7), ["volume_id"], 6, 6, 3).collect(), (12,) * 3, 6)
    np.testing.assert_allclose(plain, dealt, atol=1e-12)
    codes = assembled(supertiles.blend(rows, ["volume_id"], 6, 6, 3, encode=True).collect(), (12,) * 3, 6)
    assert (codes == np.floor(np.clip(plain * 255 + 0.5, 0, 255))).all()
    with pytest.raises(ValueError, match="stride"):
        supertiles.windows(chunk_rows(spark, vol, 6), shapes(spark, vol), ["volume_id"], 6, 6, 4)


def test_inference_at_full_size(spark):
    """Windows of 128^3; as super-tiles each of them would lie in a buffer of 256^3."""
    vol = np.random.default_rng(5).integers(0, 900, (140, 100, 70)).astype(np.float32)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        got = supertiles.infer(chunk_rows(spark, {1: vol}, 64, "float"), shapes(spark, {1: vol}), ["volume_id"], sigmoid, 64, encode=False).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    want = infer_by_buffers(vol, 128, 64, 128, 4096)
    np.testing.assert_allclose(assembled(got, vol.shape, 64), want, atol=1e-5)


def test_levels_are_pooled_from_level_0(spark):
    vol = np.random.default_rng(2).integers(0, 255, (4, 8, 8)).astype(float)
    chunks = chunk_rows(spark, {1: vol}, 4).withColumns({d: F.lit(4) for d in ("dz", "dy", "dx")})
    rows, _ = pooling.pyramid(chunks, ["volume_id"], 2, (1.0, 1.0, 1.0))
    for r in rows.filter("level = 2").collect():
        part = vol[r.cz * 4 : r.cz * 4 + 4, r.cy * 4 : r.cy * 4 + 4, r.cx * 4 : r.cx * 4 + 4]
        np.testing.assert_array_equal(np.array(r.data), np.floor(np.clip(part.mean(axis=(1, 2)) + 0.5, 0, 255)))


# --- components -----------------------------------------------------------


def snake(n):
    """One object, a line folded through the whole volume."""
    vol = np.zeros((n, n, n))
    for z in range(0, n, 2):
        for y in range(0, n, 2):
            vol[z, y, :] = 1
            if y + 2 < n:
                vol[z, y + 1, 0 if (y // 2) % 2 else n - 1] = 1
        if z + 2 < n:
            vol[z + 1, 0 if (z // 2) % 2 else (n - 1) // 2 * 2, 0] = 1
    return vol


@pytest.mark.parametrize("conn, edge", [(6, 4), (26, 4), (26, 3), (6, 16)])
def test_volume_components_equal_the_sparse_ones(spark, conn, edge):
    rng = np.random.default_rng(conn + edge)
    volumes = {i: (rng.random((11, 9, 13)) < share).astype(float) for i, share in enumerate((0.05, 0.2, 0.4, 0.97))}
    volumes[9] = snake(12)
    voxels = [(i, *map(int, at)) for i, v in volumes.items() for at in np.argwhere(v)]
    sparse = components.connected_components(spark.createDataFrame(voxels, "volume_id int, z int, y int, x int"), ["volume_id"], conn)
    empty = spark.createDataFrame([(77, 0, 0, 0, None), (78, 0, 0, 0, [0.0] * edge**3)], "volume_id int, cz int, cy int, cx int, data array<double>")
    chunks = chunk_rows(spark, volumes, edge).unionByName(empty)
    labelled = components.volume_components(chunks, ["volume_id"], edge, conn)
    found = dense.chunk_voxels(labelled, ["volume_id"], edge, keep=F.col("component") >= 0, value="component")
    columns = ["volume_id", "z", "y", "x", "component"]
    got = sorted(map(tuple, found.select(columns).collect()))
    assert got == sorted(map(tuple, sparse.select(columns).collect()))
    if conn == 6:
        assert len({c for i, *_, c in got if i == 9}) == 1


def test_contacts_are_a_share_of_the_faces(spark):
    rows = components.face_contacts(chunk_rows(spark, {1: np.ones((16, 16, 16))}, 8), ["volume_id"], 8, 26).count()
    # One object per chunk: 28 pairs of 8 chunks that all touch one another.
    assert rows == 28


def test_round_tables_go(spark):
    before = scratch_dir(spark, "x").rsplit("/", 1)[0].removeprefix("file:")
    seen = set(os.listdir(before)) if os.path.isdir(before) else set()
    components.volume_components(chunk_rows(spark, {1: snake(12)}, 4), ["volume_id"], 4, 6).count()
    new = [d for d in os.listdir(before) if d.startswith("components-") and d not in seen]
    assert [len(os.listdir(f"{before}/{d}")) for d in new] == [1]


def test_labels_of_a_chunk():
    rng = np.random.default_rng(8)
    for conn, share in itertools.product((6, 26), (0.1, 0.3, 0.6, 1.0)):
        mask = rng.random((5, 6, 7)) < share
        at, first = kernels.label_runs(mask, conn)
        want = {}
        for p in map(tuple, np.argwhere(mask)):
            if p in want:
                continue
            stack = [p]
            while stack:
                q = stack.pop()
                if q in want or not all(0 <= c < n for c, n in zip(q, mask.shape)) or not mask[q]:
                    continue
                want[q] = np.ravel_multi_index(p, mask.shape)
                stack += [tuple(np.add(q, d)) for d in itertools.product((-1, 0, 1), repeat=3) if conn == 26 or sum(map(abs, d)) == 1]
        assert dict(zip(at.tolist(), first.tolist())) == {np.ravel_multi_index(q, mask.shape): int(v) for q, v in want.items()}


# --- axes -----------------------------------------------------------------


def test_reorient_in_all_orders(spark):
    vol = np.random.default_rng(4).integers(1, 9, (2, 3, 4)).astype(float)
    patches = spark.createDataFrame([(1, 2, 3, 4, vol.ravel().tolist())], "patch_id int, dz int, dy int, dx int, data array<double>")
    voxels = spark.createDataFrame([(*map(int, p), float(vol[tuple(p)])) for p in np.argwhere(vol)], "z int, y int, x int, value double")
    for perm in itertools.permutations(AXES):
        dense_rows = {r.variant: r for r in geometry.reorient_dense(patches, perm=perm).collect()}
        sparse_rows = geometry.reorient(voxels, (2, 3, 4), perm=perm).collect()
        assert set(dense_rows) == set(geometry.FLIPS)
        for name, r in dense_rows.items():
            want = np.flip(vol, [i for i, a in enumerate(AXES) if a in name[4:]]).transpose([AXES.index(a) for a in perm])
            assert (r.dz, r.dy, r.dx) == want.shape
            np.testing.assert_array_equal(np.reshape(r.data, want.shape), want)
            assert all(want[s.i, s.j, s.k] == s.value for s in sparse_rows if s.variant == name)
    with pytest.raises(ValueError, match="perm"):
        geometry.reorient(voxels, (2, 3, 4), perm="zzx")


def test_windows_in_slices_are_those_of_single_rows(spark, monkeypatch):
    """Slices of any size give the same windows and blends, also where no window is inside."""
    rng = np.random.default_rng(3)
    dims = {1: (5, 7, 4), 2: (9, 3, 6), 3: (2, 2, 2)}
    cells = [(v, z, y, x, float(rng.integers(0, 9))) for v, d in dims.items() for z, y, x in np.ndindex(*d)]
    chunks = dense.to_chunks(spark.createDataFrame(cells, "volume_id int, z int, y int, x int, value double"), ["volume_id"], 4)
    volumes = spark.createDataFrame([(v, *d) for v, d in dims.items()], "volume_id int, dim_z int, dim_y int, dim_x int")

    def found():
        windows = supertiles.windows(chunks, volumes, ["volume_id"], 4, 6, 3, min_valid=20)
        blended = supertiles.blend(windows, ["volume_id"], 4, 6, 3)
        return [sorted(map(str, df.collect())) for df in (windows, blended)]

    whole = found()
    monkeypatch.setattr(supertiles, "BATCH", 1)
    assert found() == whole and len(whole[0]) > 8


def test_infer_volume_reads_stored_codes(spark, tmp_path):
    """The inference runs once: the levels and the scales read what it has stored."""
    rows = [(o, 5 * o, s, 1, float(o % 50)) for o in range(60) for s in (1, 2)]
    kinds = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double"
    spark.createDataFrame(rows, kinds).write.parquet(f"{tmp_path}/lineitem.parquet")
    calls = spark.sparkContext.accumulator(0)
    infer = supertiles.infer

    def counted(chunks, volumes, keys, model, *args, **options):
        def seen(batches):
            for batch in batches:
                calls.add(batch.num_rows)
                yield batch

        return infer(chunks, volumes, keys, lambda w: model(w.mapInArrow(seen, w.schema)), *args, **options)

    from voxframe.plans import all_queries

    supertiles.infer = counted
    try:
        found = all_queries.QUERIES["infer_volume"](spark, str(tmp_path)).count()
    finally:
        supertiles.infer = infer
    windows = 2 * sum(math.prod(n) >= 100 for n in itertools.product([3, 6, 6, 6, 3], repeat=3))
    assert found == 2 * (12**3 + 12 * 6 * 6 + 12 * 3 * 3) and calls.value == windows


# --- batches --------------------------------------------------------------


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_views_are_worked_out_in_one_function(spark):
    """Every Python function of a plan costs a process per task, with a batch of rows in each."""
    vol = np.random.default_rng(5).random((4, 4, 4))
    patches = spark.createDataFrame([(1, 4, 4, 4, vol.ravel().tolist())], "patch_id int, dz int, dy int, dx int, data array<double>")
    for preset in augment.PRESETS:
        assert plan_of(augment.augment(patches, ["patch_id"], 3, preset, 2)).count("ArrowEvalPython") == 1
    d = augment.Draws("3-view1", ["patch_id"])
    steps = (augment.orient, augment.gaussian_noise, augment.blur, augment.intensity_jitter, augment.gamma, augment.low_resolution, augment.brightness_gradient)
    alone = patches
    for step in steps:
        alone = step(alone, d)
    np.testing.assert_allclose(augment.augment(patches, ["patch_id"], 3).first().data, alone.first().data, rtol=0, atol=0)


def test_synthetic_volumes_in_bounded_batches(spark, monkeypatch):
    ids = spark.createDataFrame([(i,) for i in range(5)], "pos long")
    cells = F.transform(F.sequence(F.lit(0), F.lit(26)), lambda i: scalar.cell_hash(scalar.hash_rank(7, "pos") % scalar.CELL_MOD, i) / float(scalar.CELL_MOD))
    want = {r.pos: r.data for r in ids.select("pos", cells.alias("data")).collect()}
    monkeypatch.setattr(kernels, "BATCH_BYTES", 1)
    rows = readers.synthetic_volumes(ids, "pos", 3, 7)
    assert {r.pos: r.data for r in rows.collect()} == want
    assert "MapInArrow" in plan_of(rows)


def test_decoded_arrays_are_bounded_by_bytes(spark, monkeypatch):
    name, files = "spark.sql.execution.arrow.maxBytesPerBatch", []
    for i in range(4):
        out = io.BytesIO()
        np.save(out, np.full((1, 2, i + 1, 2), i, np.uint16))
        files.append((f"p{i}", bytearray(out.getvalue())))
    before = spark.conf.get(name)
    spark.conf.set(name, str(64 << 20))
    monkeypatch.setattr(kernels, "BATCH_BYTES", 100)
    try:
        decoded = readers.decode_arrays(spark.createDataFrame(files, "path string, content binary").coalesce(1))
        assert spark.conf.get(name) == "100"
        assert sorted((r.path, r.dz, r.dy, r.dx, r.data) for r in decoded.collect()) == [(f"p{i}", 2, i + 1, 2, [float(i)] * (4 * i + 4)) for i in range(4)]
    finally:
        spark.conf.set(name, before)


def test_chunks_of_a_batch_are_labelled_at_once(monkeypatch):
    calls, runs = [], components.chunk_runs
    monkeypatch.setattr(components, "chunk_runs", lambda mask, conn: calls.append(1) or runs(mask, conn))
    full, none = [1.0] * 8, [0.0] * 8
    batch = pa.RecordBatch.from_pydict({"cz": [0, 1, 2, 3], "cy": [0] * 4, "cx": [0] * 4, "data": [full, none, None, full]})
    rows, corners, cells, firsts = components._labelled(batch, 2, 26)
    assert len(calls) == 1 and rows.tolist() == [0, 3] and corners[:, 0].tolist() == [0, 6]
    assert cells.tolist() == list(range(16)) and firsts.tolist() == [0] * 8 + [8] * 8


def test_balls_move_as_lines(spark):
    rng = np.random.default_rng(6)
    points = [(f"r{i % 2}", *map(float, p)) for i, p in enumerate(rng.integers(-4, 52, (40, 3)) / 4)] * 2
    df = spark.createDataFrame(points, "region string, z double, y double, x double")
    shape, mm = (9, 10, 11), (3e-3, 1e-3, 2e-3)
    got = stitch.rasterize_spheres(df, ["region"], 5.0, mm, shape)
    want = set()
    for region, *p in set(points):
        for at in np.ndindex(*shape):
            if sum(((a - c) * m * 1000.0) ** 2 for a, c, m in zip(at, p, mm)) <= 25.0:
                want.add((region, *at))
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(want) and set(rows) == want
    assert "REPARTITION_BY_NUM" in plan_of(got)
