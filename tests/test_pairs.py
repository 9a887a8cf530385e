"""Pairs of patches and references are made by many tasks."""

from pyspark.sql import functions as F

from voxframe.operators import joins


def test_pairs_of_small_tables_are_made_by_many_tasks(spark):
    patches = spark.createDataFrame([(i, None if i % 50 == 0 else f"d{i % 3}") for i in range(900)], "patch_no long, dataset string")
    refs = spark.createDataFrame([(f"d{i % 2}", f"s{i}") for i in range(40)] * 2, "dataset string, subject_id string")
    pairs = joins.attach_references(patches, refs).withColumn("task", F.spark_partition_id()).collect()
    want = {(i, f"d{j % 2}", f"s{j}") for i in range(900) for j in range(40) if i % 50 == 0 or i % 3 == 2 or j % 2 == i % 3}
    assert {(r.patch_no, r.ref_dataset, r.ref_subject) for r in pairs} == want and len(pairs) == len(want)
    tasks = [r.task for r in pairs]
    # Two data sets and the pool are three keys; no task makes a third of the pairs.
    assert len(set(tasks)) > 8
    assert max(tasks.count(t) for t in set(tasks)) < len(pairs) / 3
