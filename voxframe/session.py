"""Session settings the library relies on, and the checkpoint folder."""

import re
import uuid

from pyspark.sql import SparkSession

# One dense patch row can hold 16 MB, so the default of 10,000 rows per Arrow
# batch would not fit any executor; the bytes are bounded, too.
RECOMMENDED_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Array rows cost far more work per byte than flat rows, so small shuffles
    # must not shrink to one task.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "32",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(64 << 20),
}


def local_session(cpus="*", app="voxframe", **extra):
    """A local session for tests and the bench; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
    )
    for key, value in {**RECOMMENDED_CONF, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark):
    """The shared folder: ``spark.checkpoint.dir``, or one below the warehouse.

    Both are folders that all executors reach; nothing goes to a folder of one
    machine, which others could not read after an executor is lost.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        configured = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        sc.setCheckpointDir(configured or f"{warehouse}/_checkpoints")
    return sc.getCheckpointDir()


def bound_batches(spark, size=4 << 20):
    """Bound the Arrow batches that go to Python by bytes, not by rows.

    A row may be a long text or a dense patch; the default bounds would let one
    batch of them take a large part of an executor. A bound of the session that
    is already lower stays.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    number, unit = re.fullmatch(r"(-?\d+)([kmg]?)b?", spark.conf.get(name).strip().lower()).groups()
    bound = int(number) << {"": 0, "k": 10, "m": 20, "g": 30}[unit]
    if not 0 < bound <= size:
        spark.conf.set(name, str(size))


def spread(spark):
    """Partitions of rows that grow much in their task.

    Given as a number, it is not lowered by the bytes of the rows before they grow.
    """
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)


def scratch_dir(spark, name):
    """A new folder next to the checkpoints, shared by all executors."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


class RoundTables:
    """Tables of an iteration in the shared folder, removed when they are done with.

    A table is written before the ones it was made from go, so a lost executor
    finds all it needs in the shared folder.
    """

    def __init__(self, spark, name):
        self.spark, self.folder, self.paths = spark, scratch_dir(spark, name), {}

    def keep(self, df):
        """Write a table and read it back."""
        path = f"{self.folder}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        # The schema is known: no job to infer it, and empty tables have one.
        table = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(table)] = (path, table)
        return table

    def drop(self, table):
        path, _ = self.paths.pop(id(table))
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)

    def drop_all_but(self, kept):
        for _, table in list(self.paths.values()):
            if table is not kept:
                self.drop(table)
