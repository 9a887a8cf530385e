"""Hand-made cases of the rounding, edge and precedence rules."""

import io
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxframe.functions import scalar
from voxframe.operators import components as cc
from voxframe.operators import (
    audit,
    augment,
    dense,
    filters,
    geometry,
    histogram,
    joins,
    keys,
    metrics,
    normalize,
    pooling,
    ranking,
    review,
    sampling,
    stitch,
)
from voxframe.sources import readers, sinks
from voxframe.streaming import jobs
from voxframe.streaming import metrics as series


def patch(spark, volume, key=1):
    a = np.asarray(volume, dtype=float)
    return spark.createDataFrame(
        [(key, *a.shape, a.ravel().tolist())], "patch_id int, dz int, dy int, dx int, data array<double>"
    )


def array_of(df):
    r = df.collect()[0]
    return np.array(r["data"]).reshape(r["dz"], r["dy"], r["dx"])


def mask_rows(spark, voxels):
    return spark.createDataFrame([(1, *v) for v in voxels], "patch_id int, z int, y int, x int")


def n_components(spark, voxels, conn):
    out = cc.connected_components(mask_rows(spark, voxels), ["patch_id"], conn)
    assert out.count() == len(set(voxels))
    return out.select("component").distinct().count()


RNG = np.random.default_rng(3)


# --- rounding -------------------------------------------------------------


def test_half_even(spark):
    values = [0.5, 1.5, 2.5, -0.5, -1.5, 2.4999]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r[0] for r in df.select(scalar.half_even(F.col("v"))).collect()] == [round(v) for v in values]


def test_encode_and_binarize(spark):
    df = spark.createDataFrame([(0.0,), (0.5,), (0.503,), (1.0,), (1.7,)], "prob double")
    rows = stitch.encode_and_binarize(df, 0.5).collect()
    assert [r["code"] for r in rows] == [0, 128, 128, 255, 255]
    assert [r["mask"] for r in rows] == [0, 0, 0, 1, 1]


def test_vote_is_strict_then_not_strict(spark):
    rows = [(1, 0, 0.5), (1, 1, 0.6), (2, 0, 0.5), (2, 1, 0.5), (3, 0, 0.9)]
    out = stitch.ensemble_vote(spark.createDataFrame(rows, "voxel int, member int, prob double"), ["voxel"])
    assert {r["voxel"]: (r["share"], r["mask"]) for r in out.collect()} == {1: (0.5, 1), 2: (0.0, 0), 3: (1.0, 1)}


# --- layouts and windows --------------------------------------------------


def test_dense_round_trip(spark):
    vol = RNG.integers(0, 3, (3, 4, 5)).astype(float)
    vox = dense.to_voxels(patch(spark, vol), ["patch_id"], F.col("value") > 0)
    assert np.array_equal(array_of(dense.to_patches(vox, ["patch_id"], (3, 4, 5))), vol)


@pytest.mark.parametrize("box", [(-2, -1, 3, 4, 5, 6), (1, 2, 0, 6, 7, 5), (-9, -9, -9, -4, -4, -4), (-1, -1, -1, 9, 9, 9)])
def test_windows_match_slicing(spark, box):
    vol = RNG.integers(1, 9, (7, 8, 6)).astype(float)
    vox = dense.to_voxels(patch(spark, vol).withColumnRenamed("patch_id", "volume_id"), ["volume_id"])
    chunks = dense.to_chunks(vox, ["volume_id"], 4)
    row = spark.createDataFrame([(5, 1, *box)], "patch_id int, volume_id int, z0 int, y0 int, x0 int, z1 int, y1 int, x1 int")
    got = array_of(joins.extract_windows(row, chunks, ["volume_id"], 4))
    wide = np.pad(vol, 12)
    z0, y0, x0, z1, y1, x1 = (v + 12 for v in box)
    assert np.array_equal(got, wide[z0:z1, y0:y1, x0:x1])


def test_pad_then_crop_is_identity(spark):
    vol = RNG.random((4, 4, 4))
    padded = geometry.pad_to(patch(spark, vol), 6)
    back = geometry.recrop(padded, (0, 0, 0), (4, 4, 4))
    assert np.array_equal(array_of(back), vol)
    assert np.array_equal(array_of(geometry.central_crop(padded, 3)), np.pad(vol, ((0, 2),) * 3)[2:4, 2:4, 2:4])


def test_slice_windows(spark):
    vol = RNG.random((6, 6, 6))
    buf = patch(spark, vol).withColumns({"bz0": F.lit(-2), "by0": F.lit(0), "bx0": F.lit(5)})
    rows = geometry.slice_windows(buf, ["patch_id"], 4, 2, 6).collect()
    assert len(rows) == 8
    for r in rows:
        z, y, x = r["wz0"] + 2, r["wy0"], r["wx0"] - 5
        assert np.array_equal(np.array(r["data"]), vol[z : z + 4, y : y + 4, x : x + 4].ravel())


@pytest.mark.parametrize("policy,want", [("clip", (0, 3)), ("shift", (0, 5))])
def test_bounds(spark, policy, want):
    df = spark.createDataFrame([(-2, 3)], "z0 int, z1 int")
    for a in "yx":
        df = df.withColumns({f"{a}0": F.lit(0), f"{a}1": F.lit(2)})
    df = df.withColumns({f"dim_{a}": F.lit(8) for a in "zyx"})
    r = geometry.bound(df, policy).collect()[0]
    assert (r["z0"], r["z1"]) == want
    assert geometry.bound(df, "reject").collect()[0]["reason"] == "out of bounds"
    p = geometry.bound(df, "pad").collect()[0]
    assert (p["z_lo"], p["z_hi"]) == (2, 5)


def test_grid_starts(spark):
    df = spark.createDataFrame([(50,), (64,), (65,), (130,)], "n int")
    out = df.select(geometry.tile_starts(F.col("n"), 64), geometry.window_positions(F.col("n"), 64, 48)).collect()
    assert [r[0] for r in out] == [[0], [0], [0], [0, 64]]
    assert [r[1] for r in out] == [[0], [0], [0, 1], [0, 48, 66]]


def test_extent_mismatch_is_an_error(spark):
    grid = geometry.tile_grid(
        spark.createDataFrame([(1, 64, 64, 64, 1.0, 1.0, 1.0)], "volume_id int, dim_z int, dim_y int, dim_x int, mm_z double, mm_y double, mm_x double"), 64
    ).withColumns({f"fr_mm_{a}": F.lit(0.5) for a in "zyx"} | {f"fr_dim_{a}": F.lit(100) for a in "zyx"})
    with pytest.raises(Exception, match="extents differ"):
        geometry.match_grids(grid, fine_dim="fr_dim_").collect()


# --- normalisation, thresholds --------------------------------------------


def test_flat_patch(spark):
    flat = patch(spark, np.full((2, 2, 2), 7.0))
    assert (array_of(normalize.zscore(flat)) == 7).all()
    assert (array_of(normalize.zscore(flat, "center")) == 0).all()
    assert (array_of(normalize.minmax(flat)) == 7).all()
    assert normalize.window_stats(flat, min_valid=1).collect()[0]["mu"] is None
    h = histogram.histogram(flat, ["patch_id"])
    assert h.count() == 1
    assert histogram.multi_otsu(h, ["patch_id"]).collect()[0]["threshold"] is None


def test_empty_distribution(spark):
    r = histogram.distribution_stats(patch(spark, np.full((1, 1, 2), np.nan)), ["patch_id"]).collect()[0]
    assert (r["p99"], r["max"], r["max_over_p99"]) == (0.0, 0.0, 0.0)
    low = histogram.distribution_stats(patch(spark, np.full((1, 1, 2), -1.0)), ["patch_id"]).collect()[0]
    assert math.isinf(low["max_over_p99"])
    rng = histogram.percentile_range(patch(spark, np.zeros((1, 1, 2))), ["patch_id"]).collect()[0]
    assert (rng["lo"], rng["hi"]) == (0.0, 1.0)


def test_otsu_splits_two_levels(spark):
    vol = np.r_[np.zeros(50), np.ones(14)].reshape(4, 4, 4)
    h = histogram.histogram(patch(spark, vol), ["patch_id"])
    t = histogram.multi_otsu(h, ["patch_id"])
    assert 0 < t.collect()[0]["threshold"] < 1
    assert histogram.mask_above(patch(spark, vol), t, ["patch_id"]).count() == 14
    assert histogram.multi_otsu(h, ["patch_id"], 3).collect()[0]["threshold"] is None


# --- filters and resampling -----------------------------------------------


def test_filters_keep_constants_and_agree_with_numpy(spark):
    flat = patch(spark, np.full((4, 5, 6), 3.0))
    for f in (filters.gaussian_filter, filters.uniform_filter):
        assert np.allclose(array_of(f(flat)), 3.0)
    assert np.allclose(array_of(filters.gaussian_blur_5(flat, 0.4)), 3.0)
    line = np.arange(5.0).reshape(1, 1, 5)
    got = array_of(filters.uniform_filter(patch(spark, line), 3))
    assert np.allclose(got.ravel(), [1 / 3, 1, 2, 3, 11 / 3])


def test_resample_same_size_is_identity(spark):
    vol = RNG.integers(0, 99, (4, 4, 4)).astype(float)
    p = patch(spark, vol)
    assert np.array_equal(array_of(pooling.resample_nearest(p, (4, 4, 4))), vol)
    assert np.array_equal(array_of(pooling.resample_linear(p, (4, 4, 4))), vol)
    assert np.array_equal(array_of(pooling.resample_linear(p, (4, 4, 4), "half_pixel")), vol)
    assert array_of(pooling.resample_nearest(p, (1, 2, 2))).tolist() == [[[vol[0, 0, 0], vol[0, 0, 3]], [vol[0, 3, 0], vol[0, 3, 3]]]]


def test_pooling_pads_or_crops(spark):
    vol = np.ones((3, 3, 3))
    assert array_of(pooling.block_mean(patch(spark, vol), 2)).tolist() == [[[1.0]]]
    padded = array_of(pooling.block_reduce(patch(spark, vol), (2, 2, 2), "mean"))
    assert padded[0, 0, 0] == 1.0 and padded[1, 1, 1] == 1 / 8


# --- components -----------------------------------------------------------


def test_connectivity(spark):
    assert n_components(spark, [(0, 0, 0), (1, 1, 1)], 26) == 1
    assert n_components(spark, [(0, 0, 0), (1, 1, 1)], 6) == 2
    assert n_components(spark, [(0, 0, 0), (0, 1, 1)], 6) == 2
    assert n_components(spark, [(0, 0, 0), (0, 0, 1), (0, 0, 2), (0, 5, 5)], 6) == 2
    assert n_components(spark, [(3, 3, 3)], 26) == 1


def test_components_agree_with_flood_fill(spark):
    rnd = random.Random(4)
    # wide in x, so that runs cross the join cells
    voxels = {(rnd.randrange(4), rnd.randrange(6), rnd.randrange(150)) for _ in range(900)}
    voxels |= {(2, 2, x) for x in range(10, 140)}
    for conn in (6, 26):
        left, count = set(voxels), 0
        while left:
            count += 1
            stack = [left.pop()]
            while stack:
                z, y, x = stack.pop()
                for d in np.ndindex(3, 3, 3):
                    s = tuple(v - 1 for v in d)
                    if conn == 6 and sum(map(abs, s)) != 1:
                        continue
                    n = (z + s[0], y + s[1], x + s[2])
                    if n in left:
                        left.remove(n)
                        stack.append(n)
        assert n_components(spark, sorted(voxels), conn) == count


def test_spiral_is_one_object(spark):
    voxels, x, y, step = [], 0, 0, 16
    dx, dy = 1, 0
    voxels.append((0, y + 20, x + 20))
    while step > 0:
        for _ in range(2):
            for _ in range(step):
                x, y = x + dx, y + dy
                voxels.append((0, y + 20, x + 20))
            dx, dy = -dy, dx
        step -= 2
    assert n_components(spark, voxels, 6) == 1


def test_size_filter_renumbers(spark):
    voxels = [(0, 0, 0), (0, 5, 0), (0, 5, 1), (3, 0, 0), (3, 0, 1)]
    comps = cc.connected_components(mask_rows(spark, voxels), ["patch_id"])
    kept = cc.size_filter(comps, ["patch_id"], 2)
    assert sorted({(r["component_id"], r["z"]) for r in kept.collect()}) == [(1, 0), (2, 3)]
    rest, removed = cc.drop_large(comps, ["patch_id"], 1)
    assert rest.count() == 1 and removed.collect()[0]["voxels_removed"] == 4


# --- stitching, metrics ---------------------------------------------------


def test_blending_a_constant(spark):
    vols = spark.createDataFrame([(1, 7, 7, 7)], "volume_id int, dim_z int, dim_y int, dim_x int")
    grid = geometry.window_grid(vols, 4, 2).select("volume_id", *[F.col(f"{a}0").alias(f"w{a}0") for a in "zyx"])
    preds = grid.withColumns({"dz": F.lit(4), "dy": F.lit(4), "dx": F.lit(4), "data": F.array_repeat(F.lit(0.3), 64)})
    chunks = stitch.blend_tiles(preds, ["volume_id"], 4, 5)
    out = dense.chunk_voxels(chunks, ["volume_id"], 5, value="prob").filter("prob > 0")
    assert out.count() == 343
    assert out.filter(F.abs(F.col("prob") - 0.3) > 1e-12).count() == 0


def vectors(spark, rows):
    return spark.createDataFrame(rows, "pair_id int, batch_id int, embedding array<double>")


def test_regression_loss_ends(spark):
    a = vectors(spark, [(1, 0, [1.0, 2.0]), (2, 0, [3.0, -1.0])])
    opposite = vectors(spark, [(1, 0, [-1.0, -2.0]), (2, 0, [-3.0, 1.0])])
    loss = lambda x, y: metrics.regression_loss(x, y, ["pair_id"], ["batch_id"]).collect()[0]["loss"]
    b = lambda df: df.drop("batch_id")
    assert loss(a, b(a)) == pytest.approx(0.0, abs=1e-12)
    assert loss(a, b(opposite)) == pytest.approx(4.0)


def test_contrastive_loss_falls_for_similar_pairs(spark):
    base = RNG.normal(size=(6, 8))
    same = [(i, 0, v.tolist()) for i, v in enumerate(base)] * 2
    other = [(i, 0, v.tolist()) for i, v in enumerate(base)] + [(i, 0, v.tolist()) for i, v in enumerate(RNG.normal(size=(6, 8)))]
    s = metrics.ntxent(vectors(spark, same), "batch_id").collect()[0]
    o = metrics.ntxent(vectors(spark, other), "batch_id").collect()[0]
    assert s["loss"] < o["loss"] and s["accuracy"] == 1.0
    cut = metrics.ntxent(vectors(spark, same), "batch_id", block=3).collect()[0]
    assert cut["loss"] == pytest.approx(s["loss"]) and cut["accuracy"] == 1.0
    with pytest.raises(Exception, match="no mate"):
        metrics.ntxent(vectors(spark, same[1:]), "batch_id").collect()


def test_dice_smoothing(spark):
    empty = mask_rows(spark, [(0, 0, 0)]).filter("z > 5")
    one = mask_rows(spark, [(0, 0, 0)])
    on = ["patch_id", "z", "y", "x"]
    assert metrics.dice(one, one, ["patch_id"], on).collect()[0]["dice"] == 1.0
    assert metrics.dice(one, empty, ["patch_id"], on).collect()[0]["dice"] == 0.5


# --- augmentation ---------------------------------------------------------


def test_flips_and_turns_are_identities_when_repeated(spark):
    vol = RNG.random((3, 3, 3))
    p = patch(spark, vol).withColumn("copy", F.lit(1))
    d = augment.Draws(1, ["patch_id", "copy"])
    assert np.array_equal(array_of(augment.flip3d(augment.flip3d(p, d), d)), vol)
    turned = p
    for _ in range(4):
        turned = augment.rot90_3d(turned, d)
    assert np.array_equal(array_of(turned), vol)


def test_zoom_one_is_a_no_op(spark):
    vol = RNG.random((4, 4, 4))
    d = augment.Draws(1, ["patch_id"])
    cfg = {"zoom": (1.0, 1.0), "p": 1.0, "p_channel": 1.0}
    assert np.allclose(array_of(augment.low_resolution(patch(spark, vol), d, cfg)), vol)


def test_gradient_changes_zeros_and_mask_follows_image(spark):
    d = augment.Draws(5, ["patch_id", "copy"])
    zeros = patch(spark, np.zeros((4, 4, 4))).withColumn("copy", F.lit(1))
    assert array_of(augment.brightness_gradient(zeros, d, {**augment.GRADIENT, "p": 1.0})).any()
    vol = (RNG.random((4, 4, 4)) > 0.7).astype(float)
    images = augment.copies(patch(spark, vol), 12)
    masks = augment.copies(dense.to_voxels(patch(spark, vol), ["patch_id"], F.col("value") > 0).drop("value"), 12)
    k = ["patch_id", "copy"]
    moved = dense.to_voxels(augment.orient(images, d), k, F.col("value") > 0).drop("value")
    other = augment.orient_mask(masks, d, 4).select(*k, "z", "y", "x")
    assert moved.exceptAll(other).count() == 0 and other.exceptAll(moved).count() == 0


def test_two_views_of_each_preset(spark):
    p = patch(spark, RNG.random((4, 4, 4)))
    for preset in augment.PRESETS:
        rows = augment.two_views(p, ["patch_id"], 3, preset).collect()
        assert [r["view"] for r in rows] == [1, 2] and rows[0]["data"] != rows[1]["data"]
        if preset == "legacy":
            assert all(0 <= v <= 1 for r in rows for v in r["data"])


# --- keys, sampling, review -----------------------------------------------


def test_quota_sums_to_n(spark):
    g = spark.createDataFrame([(0, "a", 0.5), (1, "b", 0.25), (2, "c", 0.25), (3, "d", 0.0)], "pos int, name string, weight double")
    for n in (0, 1, 3, 10):
        rows = {r["name"]: r["quota"] for r in sampling.allocate_quota(g, n).collect()}
        assert sum(rows.values()) == n
        assert rows["a"] == round(n * 0.5)


def test_split_shares_no_group(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    out = sampling.group_split(orders, "o_custkey", 0.2, 3)
    assert out.groupBy("o_custkey").agg(F.countDistinct("split").alias("n")).filter("n > 1").count() == 0
    n = orders.select("o_custkey").distinct().count()
    assert out.filter("split = 'val'").select("o_custkey").distinct().count() == max(1, round(n * 0.2))


def test_crop_pairs_overlap(spark):
    df = spark.range(200).selectExpr("id", "40 as dim_z", "33 as dim_y", "32 as dim_x")
    out = sampling.crop_pairs(df, "id", 32, 0.75, 1)
    for a, room in zip("zyx", (8, 1, 0)):
        assert out.filter((F.abs(F.col(f"{a}1") - F.col(f"{a}2")) > 8) | ~F.col(f"{a}1").between(0, room) | ~F.col(f"{a}2").between(0, room)).count() == 0
    with pytest.raises(Exception, match="patch too small"):
        sampling.crop_pairs(df, "id", 64, 0.5, 1).collect()


def test_short_group_is_an_error(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "roi string, id int")
    assert sampling.sample_per_group(df, "roi", 1, 0, "id", strict=True).count() == 2
    with pytest.raises(Exception, match="is short"):
        sampling.sample_per_group(df, "roi", 2, 0, "id", strict=True).collect()


def test_numbering_of_a_hot_group(spark):
    df = spark.range(5000).withColumn("g", F.when(F.col("id") < 4000, 0).otherwise(F.col("id") % 7))
    out = ranking.row_numbers(df, ["g"], scalar.hash_rank(1, "id"), ["id"]).collect()
    for g in range(7):
        rows = [r for r in out if r["g"] == g]
        assert sorted(r["pos"] for r in rows) == list(range(len(rows)))


def test_unknown_id_is_an_error(spark):
    df = spark.createDataFrame([("a",)], "patch_id string")
    with pytest.raises(ValueError, match="no patch matches"):
        keys.filter_scope(df, "patch_id", ids=["a", "zz"])


@pytest.mark.parametrize(
    "markers,status",
    [
        (["A"], "accept"), (["A.txt"], "accept"), (["R"], "reject"), (["M_wip.txt"], "maybe"), (["Misc"], "maybe"),
        (["A", "R.txt"], "conflict"), (["A", "M"], "conflict"), (["A", "A_empty"], "edge"), (["A", "empty"], "accept"),
        (["empty"], "empty"), (["notes"], "unreviewed"), ([], "unreviewed"),
    ],
)
def test_marker_precedence(spark, markers, status):
    df = spark.createDataFrame([(markers, False, False), (markers, True, False), (markers, True, True)], "m array<string>, f boolean, gone boolean")
    rows = df.select(review.classify_markers(F.col("m"), F.col("f"), F.col("gone"))).collect()
    assert [r[0] for r in rows] == [status, "reject", "missing"]


def test_review_events(spark):
    ev = [
        ("p", 1, "init", "otsu2", False, None), ("p", 2, "review", None, False, "fine"), ("p", 3, "init", "otsu3", False, None),
        ("q", 1, "init", "otsu2", False, None), ("q", 2, "review", None, False, "n"), ("q", 3, "init", "otsu3", True, None),
        ("r", 1, "review", None, False, "n"), ("r", 2, "unmark", None, False, None), ("r", 3, "review", None, False, None),
    ]
    df = spark.createDataFrame(ev, "patch_id string, seq int, kind string, variant string, force boolean, notes string")
    got = {r["patch_id"]: tuple(r)[1:] for r in review.apply_review_events(df).collect()}
    assert got == {"p": ("otsu2", True, True, "fine"), "q": ("otsu3", True, False, "n"), "r": (None, False, True, None)}


def test_audit_flags_need_components(spark):
    cols = "n_components int, comp_neg int, comp_borderline int, b_0_5 int, b_5_10 int, max_over_p99 double, gold_fraction double, mean_local_ratio double, expected_sparse boolean"
    df = spark.createDataFrame([(0, 0, 0, 0, 0, 99.0, 0.5, 0.0, True), (10, 3, 1, 4, 2, 11.0, 0.03, 1.0, True), (10, 0, 0, 0, 0, 2.0, 0.0, 2.0, False)], cols)
    rows = [r[0] for r in df.select(audit.audit_flags()).collect()]
    assert rows[0] == [] and rows[2] == []
    assert rows[1] == ["HEAVY_TAIL_OVERSEG", "SPARSE_EXPECTED", "NEG_NORM_COMPONENTS", "TINY_DOMINATED", "LOW_CONFIDENCE"]


# --- files and streams ----------------------------------------------------


def test_array_files(spark, tmp_path):
    vol = RNG.integers(0, 70000, (1, 2, 3, 4))
    np.save(tmp_path / "p1.npy", vol)
    got = readers.read_array_patches(spark, str(tmp_path))
    assert np.array_equal(array_of(got), vol[0])
    content = sinks.encode_arrays(got, F.lit("x")).collect()[0]["content"]
    assert np.array_equal(np.load(io.BytesIO(content)), np.clip(vol[0], 0, 65535))


def test_files(spark, tmp_path):
    (tmp_path / "a.ome.zarr" / "0").mkdir(parents=True)
    (tmp_path / "a.ome.zarr" / "0" / "c1").write_text("xx")
    (tmp_path / "a.ome.zarr" / "zarr.json").write_text("{}")
    (tmp_path / "s_region2_gt.csv").write_text("x,y,z\n1,2,3\n")
    good, bad = tmp_path / "1_meta.json", tmp_path / "2_meta.json"
    good.write_text(json.dumps({"subject_id": "sub-1", "dataset": "d"}, indent=2))
    bad.write_text("{oops")
    (tmp_path / "_wt_cache").mkdir()
    (tmp_path / "_wt_cache" / "3_meta.json").write_text("{}")
    listed = {r["path"].rsplit("/", 1)[1]: r["n_files"] for r in readers.list_dataset(spark, [str(tmp_path)]).collect()}
    assert listed["a.ome.zarr"] == 2
    assert [tuple(r) for r in readers.read_centroids(spark, str(tmp_path)).collect()] == [("region2", 1, 2, 3)]
    patches, failures = readers.rebuild_manifest(spark, str(tmp_path))
    assert [r["subject_id"] for r in patches.collect()] == ["sub-1"]
    assert [r["text"] for r in failures.collect()] == ["{oops"]


def test_manifest_document(spark, tmp_path):
    doc = {"config": {"stain": "Abeta", "region_groups": {"ctx": {"regions": ["a"], "weight": 0.5}}}, "patches": [{"subject_id": "s", "center_phys": [1, 2, 3]}, {"subject_id": "t"}]}
    (tmp_path / "m.json").write_text(json.dumps(doc, indent=2))
    config, patches = readers.read_manifest(spark, str(tmp_path / "m.json"))
    assert config.collect()[0]["region_groups"]["ctx"]["weight"] == 0.5
    assert [(r["subject_id"], r["center_phys"]) for r in patches.collect()] == [("s", [1.0, 2.0, 3.0]), ("t", None)]


METRIC = "step long, ts timestamp, run string, value double"


def feed(spark, folder, rows, name):
    spark.createDataFrame(rows, "step long, ts string, run string, value double").selectExpr(
        "step", "cast(ts as timestamp) as ts", "run", "value"
    ).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{name}")


def test_stream_restart_and_late_rows(spark, tmp_path):
    src, out, state = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")

    def go():
        stream = series.read_metrics(spark, f"{src}/*", METRIC, "parquet", 1)
        jobs.run_available(series.sample_tumbling(stream, ["run"], "5 seconds", "10 seconds"), out, state)
        return {(r["run"], str(r["start"])[11:]): r["value"] for r in jobs.latest(spark, out, ["run", "start"]).collect()}

    feed(spark, src, [(1, "2024-01-01 00:00:01", "a", 1.0), (2, "2024-01-01 00:00:04", "a", 2.0)], "f1")
    assert go() == {("a", "00:00:00"): 2.0}
    feed(spark, src, [(3, "2024-01-01 00:05:00", "a", 3.0)], "f2")
    first = go()
    assert first == {("a", "00:00:00"): 2.0, ("a", "00:05:00"): 3.0}
    # older than the watermark: dropped
    feed(spark, src, [(9, "2024-01-01 00:00:04", "a", 99.0)], "f3")
    assert go() == first
    assert go() == first


def test_materialize_skips_and_reports(spark, tmp_path):
    out = str(tmp_path / "store")
    manifest = spark.createDataFrame([(1,), (2,), (3,)], "patch_id int")

    def cut(todo):
        data = F.when(F.col("patch_id") != 3, F.array(F.lit(-1.0), F.lit(70000.7)))
        return todo.select("patch_id", *[F.lit(1).alias(d) for d in ("dz", "dy")], F.lit(2).alias("dx"), data.alias("data"))

    first = sinks.materialize_patches(cut, manifest.filter("patch_id = 1"), "patch_id", out).collect()[0]
    assert tuple(first) == (1, 0, 1, 0)
    second = sinks.materialize_patches(cut, manifest, "patch_id", out).collect()[0]
    assert tuple(second) == (3, 1, 1, 1)
    assert [r["data"] for r in spark.read.parquet(out).collect()] == [[0, 65535]] * 2


@pytest.mark.parametrize("alpha, block", [(0.2, 1), (0.2, 7), (0.2, 100), (0.5, 10000), (0.999, 3), (1.0, 5), (1e-6, 4)])
def test_ema_blocks(spark, alpha, block):
    values = RNG.random(60).tolist()
    df = spark.createDataFrame([("r", i, v) for i, v in enumerate(values)], "run string, step long, value double")
    want = [values[0]]
    for v in values[1:]:
        want.append(alpha * v + (1 - alpha) * want[-1])
    got = series.ema_smooth(df, "run", alpha=alpha, block=block).orderBy("step").collect()
    assert np.allclose([r["smooth"] for r in got], want)


def test_collapse_alert(spark):
    rows = [("c", 1, 1, 1.0), ("c", 2, 2, 1e-6), ("c", 3, 9, 1e-7), ("back", 1, 1, 1e-6), ("back", 2, 3, 0.5), ("late", 1, 9, 1e-6), ("fine", 1, 1, 0.3)]
    df = spark.createDataFrame(rows, "run string, step long, epoch int, loss double").withColumn("ts", F.timestamp_seconds("step"))
    got = {r["run"]: r["collapsed"] for r in series.collapse_alert(df, "run").collect()}
    assert got == {"c": True, "back": False, "late": False, "fine": False}
