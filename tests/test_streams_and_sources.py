"""Streaming state, late rows, monitor files, listings and the patch folder source."""

import datetime
import glob
import os
import random

import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from voxframe.operators import joins, review
from voxframe.sources import patch_folder, readers, sinks
from voxframe.streaming import jobs, metrics, state

DAY = datetime.datetime(2024, 1, 1)


def stream_files(spark, rows, schema, folder, files):
    """Rows dealt over several files, read one file a batch."""
    for part in range(files):
        spark.createDataFrame(rows[part::files], schema).coalesce(1).write.mode("append").parquet(str(folder))
    return metrics.read_metrics(spark, str(folder), spark.read.parquet(str(folder)).schema, "parquet", 1)


# --- state ----------------------------------------------------------------

RUNS = "run_id long, ts timestamp, step long, epoch int, loss double"


def losses():
    rng, rows = random.Random(2), []
    for run in range(40):
        kind = run % 5
        for step in range(30):
            low = kind == 1 and step > 3 or kind == 2 and 3 < step < 20 or kind == 3 and step > 25 or kind == 4 and step == 0
            loss = None if rng.random() < 0.05 else 1e-6 if low else 0.5
            rows.append((run, DAY + datetime.timedelta(hours=step), step, step // 4, loss))
    return rows


@pytest.mark.parametrize("shuffled", [False, True])
def test_alerts_equal_the_batch_query(spark, tmp_path, shuffled):
    rows = losses()
    if shuffled:
        random.Random(5).shuffle(rows)
    else:
        rows.sort(key=lambda r: r[1])
    state.use_state_store(spark)
    alerts = state.collapse_alerts(stream_files(spark, rows, RUNS, tmp_path / "in", 4), "run_id")
    jobs.run_available(alerts, f"{tmp_path}/out", f"{tmp_path}/state")
    got = jobs.latest(spark, f"{tmp_path}/out", ["run_id"])
    want = metrics.collapse_alert(spark.createDataFrame(rows, RUNS), "run_id")
    columns = ["run_id", "first_epoch", "collapsed"]
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))
    assert any(r.collapsed for r in got.collect())


def test_an_alert_fires_once(spark, tmp_path):
    rows = sorted(losses(), key=lambda r: r[1])
    state.use_state_store(spark)
    # Files in the order of time: nothing that was said has to be taken back.
    for part in range(4):
        spark.createDataFrame(rows[part * 300 : (part + 1) * 300], RUNS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = metrics.read_metrics(spark, f"{tmp_path}/in", spark.createDataFrame([], RUNS).schema, "parquet", 1)
    jobs.run_available(state.collapse_alerts(stream, "run_id"), f"{tmp_path}/out", f"{tmp_path}/state")
    said = spark.read.parquet(f"{tmp_path}/out/batch=*").filter("collapsed").groupBy("run_id").agg(F.count("*").alias("n"), F.max("alerts").alias("alerts"))
    assert {(r.n, r.alerts) for r in said.filter("run_id % 5 = 1").collect()} == {(1, 1)}


def test_quiet_runs_lose_their_state(spark, tmp_path):
    state.use_state_store(spark)
    rows = [(run, DAY + datetime.timedelta(days=20 * run, hours=h), h, 0, 1e-6) for run in range(4) for h in range(3)]
    for run in range(4):
        spark.createDataFrame(rows[run * 3 : run * 3 + 3], RUNS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = metrics.read_metrics(spark, f"{tmp_path}/in", spark.createDataFrame([], RUNS).schema, "parquet", 1)
    alerts = state.collapse_alerts(stream, "run_id", watermark="1 hour", idle_ms=86_400_000)
    query = jobs.run_available(alerts, f"{tmp_path}/out", f"{tmp_path}/state")
    got = jobs.latest(spark, f"{tmp_path}/out", ["run_id"])
    assert {(r.run_id, r.collapsed) for r in got.collect()} == {(i, True) for i in range(4)}
    # The last run is not quiet yet; the others have been forgotten.
    assert query.lastProgress is None or query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 8


EVENTS = "patch_id long, seq long, kind string, variant string, force boolean, notes string"


@pytest.mark.parametrize("seed", [1, 2])
def test_review_states_replay_in_any_order(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = [
        (rng.randrange(30), i, rng.choice(["init", "init", "review", "review", "unmark"]), rng.choice(["a", "b", None]), rng.choice([True, False, False, None]), rng.choice([None, f"n{i}"]))
        for i in range(400)
    ]
    want = review.apply_review_events(spark.createDataFrame(rows, EVENTS))
    rng.shuffle(rows)
    state.use_state_store(spark)
    stream = stream_files(spark, rows, EVENTS, tmp_path / "in", 3)
    jobs.run_available(state.review_states(stream), f"{tmp_path}/out", f"{tmp_path}/state")
    got = jobs.latest(spark, f"{tmp_path}/out", ["patch_id"])
    columns = ["patch_id", "init_variant", "initialized", "reviewed", "review_notes"]
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))


# --- write-through --------------------------------------------------------


def cut_ones(todo):
    """Patches of their own id; every seventh fails."""
    data = F.when(F.col("patch_id") % 7 != 0, F.array_repeat(F.col("patch_id").cast("double"), 8))
    return todo.select("patch_id", F.lit(2).alias("dz"), F.lit(2).alias("dy"), F.lit(2).alias("dx"), data.alias("data"))


def test_write_through_stores_each_patch_once_and_never_reads_the_store(spark, tmp_path):
    out = f"{tmp_path}/store"

    def arrive(ids):
        spark.createDataFrame([(i,) for i in ids], "patch_id long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = metrics.read_metrics(spark, f"{tmp_path}/in", spark.createDataFrame([], "patch_id long").schema, "parquet", 1)
        jobs.materialize_stream(stream, cut_ones, "patch_id", out, f"{tmp_path}/state")

    arrive([1, 2, 2, 3, 7])
    stored = glob.glob(f"{out}/run=*/batch=*/part-*.parquet")
    saved = {p: open(p, "rb").read() for p in stored}
    for p in stored:  # whoever reads the store now fails
        with open(p, "wb") as broken:
            broken.write(b"not a table")
    arrive([3, 4, 5, 1])
    arrive([9])
    for p, content in saved.items():
        with open(p, "wb") as whole:
            whole.write(content)
        crc = os.path.join(os.path.dirname(p), f".{os.path.basename(p)}.crc")
        assert os.path.exists(crc)
    assert sorted(r.patch_id for r in spark.read.parquet(out).collect()) == [1, 2, 3, 4, 5, 9]
    # A new stream over an old store starts from the keys that are there.
    spark.createDataFrame([(5,), (6,)], "patch_id long").coalesce(1).write.parquet(f"{tmp_path}/in2")
    stream = metrics.read_metrics(spark, f"{tmp_path}/in2", spark.createDataFrame([], "patch_id long").schema, "parquet", 1)
    jobs.materialize_stream(stream, cut_ones, "patch_id", out, f"{tmp_path}/state2")
    assert sorted(r.patch_id for r in spark.read.parquet(out).collect()) == [1, 2, 3, 4, 5, 6, 9]


# --- series ---------------------------------------------------------------


def test_late_rows_are_kept_apart(spark, tmp_path):
    schema = "run_id long, ts timestamp, step long, value double"
    hour = datetime.timedelta(hours=1)
    batches = [[(1, DAY + 2 * hour, 1, 1.0)], [(1, DAY + 50 * hour, 2, 2.0)], [(1, DAY + 3 * hour, 3, 3.0), (1, DAY + 49 * hour, 4, 4.0)]]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = metrics.read_metrics(spark, f"{tmp_path}/in", spark.createDataFrame([], schema).schema, "parquet", 1)
    jobs.sample_arrivals(stream, ["run_id"], "6 hours", "1 day", str(tmp_path), f"{tmp_path}/state")
    samples, late = jobs.arrived_samples(spark, str(tmp_path), ["run_id"])
    assert [r.step for r in late.collect()] == [3]
    assert sorted(r.value for r in samples.collect()) == [1.0, 2.0]


def test_monitor_files_of_different_headers(spark):
    lines = [
        ("a", "timestamp,gpu0_util_pct,train_loss"), ("a", "2024-01-01 00:00:05,50,"), ("a", "2024-01-01 00:00:10,,0.5,9"), ("a", ""),
        ("b", "timestamp,mem_used_gb,gpu0_power_w,gpu0_util_pct"), ("b", "2024-01-01 00:00:05,7,n/a,1.5"), ("b", "# a note"), ("b", "2024-01-01 00:00:10,8"),
    ]
    got = metrics.long_form(spark.createDataFrame(lines, "file string, line string"))
    rows = sorted((r.file, r.ts.strftime("%S"), r.metric, r.unit, r.value) for r in got.collect())
    assert rows == [
        ("a", "05", "gpu0_util_pct", "%", 50.0), ("a", "10", "train_loss", None, 0.5),
        ("b", "05", "gpu0_util_pct", "%", 1.5), ("b", "05", "mem_used_gb", "GB", 7.0), ("b", "10", "mem_used_gb", "GB", 8.0),
    ]


# --- listings -------------------------------------------------------------


def test_listing_stops_at_stores(spark, tmp_path):
    for path in ("a/b/c/x.json", "a/y.txt", "a/s.ome.zarr/0/0.0.0", "a/s.ome.zarr/zarr.json", "b/t.ome.zarr/deep/u.ome.zarr/z", "b/é é/w.json"):
        os.makedirs(os.path.dirname(tmp_path / path), exist_ok=True)
        (tmp_path / path).write_text("12345")
    os.makedirs(tmp_path / "empty")

    def listed(*roots, **options):
        return sorted((r.path, r.kind, r.length) for r in readers.list_tree(spark, [f"{tmp_path}/{r}".rstrip("/") for r in roots], **options).collect())

    top = str(tmp_path)
    everything = [
        (f"{top}/a/b/c/x.json", "file", 5), (f"{top}/a/s.ome.zarr", "store", None), (f"{top}/a/y.txt", "file", 5),
        (f"{top}/b/t.ome.zarr", "store", None), (f"{top}/b/é é/w.json", "file", 5),
    ]
    assert listed("") == everything
    assert listed("", "a") == everything
    assert listed("a", glob="*.json") == everything[:2]
    assert listed("a/s.ome.zarr") == [everything[1]]
    assert listed("empty") == listed("absent") == []
    got = readers.list_dataset(spark, [f"file:{tmp_path}/a"]).collect()
    assert {(r.path, r.n_files, r.length) for r in got} == {(f"file:{p}", 2 if k == "store" else 1, n or 10) for p, k, n in everything[:3]}


# --- patch folder ---------------------------------------------------------

PATCHES = "patch_id string, dz int, dy int, dx int, data array<double>"


def patches_of(spark, ids):
    return spark.createDataFrame([(f"patch_{i:06d}", 1, 2, 2, [float(i), 0.0, 70000.0, 1.5]) for i in ids], PATCHES)


def test_patch_folder_round_trip(spark, tmp_path):
    patch_folder.register(spark)
    out = f"{tmp_path}/store"
    patches_of(spark, range(20)).repartition(3).write.format("patch_folder").mode("append").save(out)
    patches_of(spark, range(20, 23)).write.format("patch_folder").mode("append").save(out)
    assert not os.path.exists(f"{out}/_staging")
    read = spark.read.format("patch_folder").option("partitionBytes", 400).load(out)
    assert read.rdd.getNumPartitions() > 3
    assert {(r.patch_id, r.dz, r.dy, r.dx, tuple(r.data)) for r in read.collect()} == {(f"patch_{i:06d}", 1, 2, 2, (i, 0, 65535, 1)) for i in range(23)}
    patches_of(spark, [5]).write.format("patch_folder").mode("overwrite").save(out)
    assert [r.patch_id for r in spark.read.format("patch_folder").load(out).collect()] == ["patch_000005"]


def test_patch_folder_reads_headers_and_wanted_files_only(spark, tmp_path):
    patch_folder.register(spark)
    out = f"{tmp_path}/store"
    patches_of(spark, range(6)).write.format("patch_folder").mode("append").save(out)
    for path in glob.glob(f"{out}/*/patch_00000[0-4].npy"):  # arrays cut off behind the header
        with open(path, "r+b") as f:
            f.truncate(128)
    shapes = spark.read.format("patch_folder").schema("patch_id string, dx int").load(out)
    assert sorted(map(tuple, shapes.collect())) == [(f"patch_{i:06d}", 2) for i in range(6)]
    kept = spark.read.format("patch_folder").load(out).filter("patch_id = 'patch_000005'")
    assert [r.data[0] for r in kept.collect()] == [5.0]


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    patch_folder.register(spark)
    out = f"{tmp_path}/store"
    patches_of(spark, [1]).write.format("patch_folder").mode("append").save(out)
    wrong = patches_of(spark, range(2, 9)).withColumn("dz", F.when(F.col("patch_id") == "patch_000005", 3).otherwise(F.col("dz")))
    with pytest.raises(Exception, match="reshape|cannot"):
        wrong.repartition(2).write.format("patch_folder").mode("append").save(out)
    assert [r.patch_id for r in spark.read.format("patch_folder").load(out).collect()] == ["patch_000001"]
    assert not os.path.exists(f"{out}/_staging")


def test_patch_folder_names_files_of_other_shapes(spark, tmp_path):
    import numpy as np

    patch_folder.register(spark)
    os.makedirs(f"{tmp_path}/in")
    np.save(f"{tmp_path}/in/ok.npy", np.asfortranarray(np.arange(6, dtype=np.uint16).reshape(1, 1, 2, 3))[None])
    got = spark.read.format("patch_folder").load(f"{tmp_path}/in").first()
    assert (got.patch_id, got.dz, got.dy, got.dx, got.data) == ("ok", 1, 2, 3, [0, 1, 2, 3, 4, 5])
    np.save(f"{tmp_path}/in/flat.npy", np.zeros((2, 2)))
    with pytest.raises(PythonException, match="flat.npy"):
        spark.read.format("patch_folder").load(f"{tmp_path}/in").collect()


def test_patch_folder_moves_bounded_batches(spark, tmp_path, monkeypatch):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(64 << 20))
    try:
        patch_folder.register(spark)
        assert spark.conf.get(name) == str(patch_folder.BATCH_BYTES)
    finally:
        spark.conf.set(name, before)
    out = str(tmp_path / "patches")
    patches_of(spark, range(5)).coalesce(1).write.format("patch_folder").mode("append").save(out)
    monkeypatch.setattr(patch_folder, "BATCH_ROWS", 2)
    reader = patch_folder.PatchFolder({"path": out}).reader(spark.range(0).selectExpr("'' as patch_id", "0 as dz").schema)
    assert [b.num_rows for part in reader.partitions() for b in reader.read(part)] == [2, 2, 1]


def test_documents_are_stored_as_partitioned_text(spark, tmp_path):
    """The same files as Spark's own, without one task for all of them."""
    rows = [("a", "1"), ("b/c=d 100%", "2"), ("a", "3"), (None, "4"), ("", "5"), ("e", None), *((f"n{i}", str(i)) for i in range(40))]
    docs = spark.createDataFrame(rows, "path string, text string")
    ours, spark_own = str(tmp_path / "ours"), str(tmp_path / "own")
    sinks.write_texts(docs, ours)
    docs.repartition("path").write.partitionBy("path").text(spark_own)

    def stored(root):
        texts = {}
        for f in glob.glob(f"{root}/*/part-*"):
            texts.setdefault(os.path.basename(os.path.dirname(f)), []).extend(open(f).read().splitlines())
        return {k: sorted(v) for k, v in texts.items()}

    assert stored(ours) == stored(spark_own)
    assert len(stored(ours)) == 44


def test_suffixes_are_dealt_before_they_multiply(spark):
    stale = spark.createDataFrame([("v5_1",), ("nowhere",)], "name string")
    dirs = spark.createDataFrame([("x_v5_1",), ("a_v5_1",), ("v5_2",)], "dir string")
    found = joins.suffix_match(stale, dirs)
    assert sorted((r.name, r.resolved, r.missing) for r in found.collect()) == [("nowhere", None, True), ("v5_1", "a_v5_1", False)]
    assert "REPARTITION_BY_NUM" in found._jdf.queryExecution().executedPlan().toString()
