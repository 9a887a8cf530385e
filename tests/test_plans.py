"""Physical plans: what must not appear, and what must be pruned."""

import __spark_entry__ as entry
import pytest
from pyspark.sql import functions as F

from voxframe.operators import dense, joins, sampling
from voxframe.plans.registry import Source


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


NO_NESTED_LOOP = [
    "extract_windows", "points_in_boxes", "label_at_center", "attach_references", "spread_even", "spread_round_robin",
    "blend_tiles", "reference_zscore", "bias_correct", "resample_linear", "ensemble_vote", "group_split", "ntxent",
    "suffix_match", "discover_subjects", "deep_supervision_score", "overlap_share", "sample_region_centers", "seeded_shuffle",
    "volume_components", "infer_volume", "blend_supertiles", "reference_chain", "global_stats_corrected", "list_tree",
]


@pytest.mark.parametrize("name", NO_NESTED_LOOP)
def test_no_nested_loops(spark, sf_dir, name):
    text = plan(entry.queries()[name](spark, sf_dir))
    assert "NestedLoop" not in text and "CartesianProduct" not in text


@pytest.mark.parametrize("name", ["zscore", "gaussian_filter", "minmax", "distribution_stats", "augment_symmetric", "block_mean"])
def test_patch_work_adds_no_shuffle(spark, sf_dir, name):
    s = Source(spark, sf_dir)
    base = plan(dense.to_patches(s.V, ["volume_id"], (12, 12, 12))).count("Exchange hashpartitioning")
    assert plan(entry.queries()[name](spark, sf_dir)).count("Exchange hashpartitioning") == base


#: Work on the cells of a row is a kernel; what needs numbers and names only is not.
KERNELS = {"minmax": True, "zscore": True, "multi_otsu_k2": True, "block_reduce_max": True, "dice_ce": False, "seeded_shuffle": False, "attach_references": False}


@pytest.mark.parametrize("name", KERNELS)
def test_only_kernels_use_python(spark, sf_dir, name):
    text = plan(entry.queries()[name](spark, sf_dir))
    assert ("ArrowEvalPython" in text) == KERNELS[name]


def test_scan_reads_only_used_columns(spark, sf_dir):
    text = plan(Source(spark, sf_dir).V)
    schema = text[text.index("ReadSchema") :].split("\n")[0]
    assert "l_quantity" in schema and "l_extendedprice" not in schema


def test_stored_chunks_are_pruned(spark, sf_dir, tmp_path):
    path = str(tmp_path / "chunks")
    s = Source(spark, sf_dir)
    dense.to_chunks(s.V, ["volume_id"], 6).withColumns({"channel": F.lit(0), "level": F.lit(0)}).write.partitionBy(
        "channel", "level"
    ).parquet(path)
    chunks = spark.read.parquet(path).filter("channel = 0 and level = 0 and volume_id = 3")
    boxes = spark.createDataFrame([(1, 3, 0, 4, 0, 4, 0, 4)], "patch_id int, volume_id int, z0 int, z1 int, y0 int, y1 int, x0 int, x1 int")
    text = plan(joins.extract_windows(boxes, chunks, ["volume_id"], 6))
    assert "PartitionFilters: [isnotnull(channel" in text and "EqualTo(volume_id,3)" in text


def test_top_k_does_not_sort_everything(spark, sf_dir):
    s = Source(spark, sf_dir)
    assert "TakeOrderedAndProject" in plan(sampling.sample_n(s.P, 10, 1, "patch_no"))


@pytest.mark.parametrize("name", ["connected_components_6", "seeded_shuffle", "ema_smooth", "blend_supertiles"])
def test_partition_count_does_not_matter(spark, sf_dir, name):
    def digest():
        df = entry.queries()[name](spark, sf_dir)
        return df.agg(F.count("*"), F.sum(F.xxhash64(*sorted(df.columns)).cast("decimal(38,0)"))).collect()[0]

    before = spark.conf.get("spark.sql.shuffle.partitions")
    few = digest()
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "13")
        assert digest() == few
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
