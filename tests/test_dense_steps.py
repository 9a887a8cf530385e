"""Dense steps on whole batches: the same cells whatever the shapes, and no lambda per cell."""

import __spark_entry__ as entry
import numpy as np
import pytest
from pyspark.sql import functions as F

from voxframe.operators import audit, dense, joins, normalize, stitch

RNG = np.random.default_rng(5)
BOX = "patch_id int, volume_id int, z0 int, z1 int, y0 int, y1 int, x0 int, x1 int"


def rows(spark, arrays, shape, name="data"):
    d = dict(zip(("dz", "dy", "dx"), shape))
    made = [(i, *d.values(), None if a is None else [None if v is None else float(v) for v in a]) for i, a in enumerate(arrays)]
    return spark.createDataFrame(made, f"patch_id int, dz int, dy int, dx int, {name} array<double>")


@pytest.mark.parametrize("name", ["zscore_valid", "blend_tiles_uniform", "reference_chain", "audit_flags", "patch_audit"])
def test_no_lambda_runs_over_all_cells(spark, sf_dir, name):
    text = entry.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "zip_with(" not in text


def test_a_repeated_voxel_keeps_the_shape(spark):
    cells = [(1, 0, 0, 1, 3.0), (1, 0, 0, 1, 7.0), (1, 1, 1, 1, None), (2, 0, 1, 0, 1.0)]
    vox = spark.createDataFrame(cells, "patch_id int, z int, y int, x int, value double")
    got = {r.patch_id: r.data for r in dense.to_patches(vox, ["patch_id"], (2, 2, 2)).collect()}
    assert got == {1: [0, 7, 0, 0, 0, 0, 0, None], 2: [0, 0, 1, 0, 0, 0, 0, 0]}


def test_a_voxel_outside_its_patch_is_an_error(spark):
    vox = spark.createDataFrame([(1, 2, 0, 0, 3.0)], "patch_id int, z int, y int, x int, value double")
    with pytest.raises(Exception, match="outside the shape"):
        dense.to_patches(vox, ["patch_id"], (2, 2, 2)).collect()


@pytest.mark.parametrize("edge", [4, 20])
def test_windows_of_any_size_match_slicing(spark, edge):
    vol = RNG.integers(1, 9, (2 * edge, edge + 1, edge)).astype(float)
    vox = dense.to_voxels(rows(spark, [vol.ravel()], vol.shape).withColumnRenamed("patch_id", "volume_id"), ["volume_id"])
    chunks = dense.to_chunks(vox, ["volume_id"], edge)
    cut = [(i, i % 3, -1 - i, 2 * edge - i, i, edge + 2, -i, edge) for i in range(6)]
    got = {r.patch_id: r for r in joins.extract_windows(spark.createDataFrame(cut, BOX), chunks, ["volume_id"], edge).collect()}
    wide = np.pad(vol, 3 * edge)
    for i, v, *ends in cut:
        z0, z1, y0, y1, x0, x1 = (e + 3 * edge for e in ends)
        real = wide[z0:z1, y0:y1, x0:x1] if v == 0 else np.zeros((z1 - z0, y1 - y0, x1 - x0))
        assert np.array_equal(np.array(got[i].data), real.ravel())


@pytest.mark.parametrize("patch", [4, 17])
def test_blending_any_size_matches_the_sums(spark, patch):
    edge, corners = patch + 1, [(0, 0, 0), (2, 1, 0), (patch, 0, -1), (0, 0, 0)]
    data = RNG.random((len(corners), patch**3))
    made = [(7, *c, d.tolist()) for c, d in zip(corners, data)] + [(8, 0, 0, 0, None), (8, None, 0, 0, data[0].tolist())]
    preds = spark.createDataFrame(made, "volume_id int, wz0 int, wy0 int, wx0 int, data array<double>")
    out = dense.chunk_voxels(stitch.blend_tiles(preds, ["volume_id"], patch, edge), ["volume_id"], edge).collect()
    profile = np.array(stitch.gaussian_profile(patch, patch / 8.0))
    weights = np.maximum(profile[:, None, None] * profile[:, None] * profile, 1e-3)
    total, weight = np.zeros((2, 3 * edge, 3 * edge, 3 * edge))
    for (z, y, x), d in zip(corners, data):
        at = tuple(slice(k + edge, k + edge + patch) for k in (z, y, x))
        total[at] += d.reshape((patch,) * 3) * weights
        weight[at] += weights
    assert {r.volume_id for r in out} == {7}
    for r in out:
        at = (r.z + edge, r.y + edge, r.x + edge)
        assert r.value == pytest.approx(total[at] / weight[at] if weight[at] else 0.0, abs=1e-12)


def test_too_few_or_unknown_valid_cells_drop_a_patch(spark):
    df = rows(spark, [[1, 2, 3, 9]] * 4, (1, 2, 2))
    valid = F.when(F.col("patch_id") == 0, F.lit("[1,1,1,0]")).when(F.col("patch_id") == 1, "[1,0,0,0]").when(F.col("patch_id") == 2, "[1,1,null,1]")
    out = normalize.zscore_valid(df.withColumn("valid", F.from_json(valid, "array<int>")), "valid", 2).collect()
    assert [r.patch_id for r in out] == [0]
    assert out[0].data == pytest.approx([-1.5**0.5, 0.0, 1.5**0.5, 0.0])


def test_window_moments_with_unknown_cells(spark):
    nan = float("nan")
    raw = rows(spark, [[1, 0, 2, 3], [1, None, 2, 3], [1, nan, 2, 3], [0, 0, 0, 0], None], (1, 2, 2))
    out = {r.patch_id: r for r in normalize.window_stats(raw, min_valid=3).collect()}
    assert (out[0].mu, out[0].n_valid) == (2.0, 3) and (out[1].mu, out[1].n_valid) == (2.0, 3)
    assert np.isnan(out[2].mu) and out[2].n_valid == 4 and out[3].mu is None and out[4].mu is None


def test_fields_of_several_shapes(spark):
    made = [(i, 2, 2, 2, [8.0] * 8, 0, 0, 4 * i) for i in range(3)]
    df = spark.createDataFrame([*made, (3, 2, 2, 2, None, 0, 0, 0), (4, 1, 1, 2, [None, 6.0], 0, 0, 0)], "volume_id int, dz int, dy int, dx int, data array<double>, z0 int, y0 int, x0 int")
    bias = [(i, 3, 3, 3 - i % 2, [2.0] * (9 * (3 - i % 2))) for i in range(5)]
    fields = spark.createDataFrame(bias, "volume_id int, bz int, by int, bx int, bias array<double>")
    got = {r.volume_id: r.data for r in normalize.bias_correct(df, fields, ["volume_id"], (0.5, 0.5, 0.5)).collect()}
    assert got == {0: [4.0] * 8, 1: [8.0] * 8, 2: [8.0] * 8, 3: None, 4: [None, 3.0]}


def test_component_values_outside_are_null(spark):
    df = rows(spark, [[1, 2, None, 4]], (1, 2, 2))
    comps = spark.createDataFrame([(0, 5, 0, 0, 1), (0, 5, 0, 1, 0), (0, 6, 3, 0, 0), (9, 1, 0, 0, 0)], "patch_id int, component long, z int, y int, x int")
    got = audit.component_values(comps, df, ["patch_id"], {"raw": "data"}).collect()
    assert sorted((r.component, r.z, r.y, r.x, r.raw) for r in got if r.raw is not None) == [(5, 0, 0, 1, 2.0)]
    assert len(got) == 3 and {r.patch_id for r in got} == {0}


@pytest.mark.parametrize("name", ["reference_chain", "reference_chain_stats"])
def test_chunks_and_pairs_of_the_chain_are_made_once(spark, sf_dir, name):
    text = entry.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    # All steps read the stored chunks and pairs; none goes back to the source or makes pairs again.
    assert "l_suppkey" not in text and "_salt" not in text
