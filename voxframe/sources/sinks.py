"""Writers: manifests, patch stores, pyramids, array contents."""

import io
import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxframe.functions.scalar import sat_u16
from voxframe.operators.joins import pending
from voxframe.operators.kernels import BATCH_BYTES
from voxframe.session import bound_batches
from voxframe.sources.patch_folder import open_folder


def write_manifest(patches, config, path):
    """JSON patch rows and a one-row config with the patch count.

    ``config``: a dict of the remaining settings. Rows stay one per line in
    many files; a single document would pass the whole manifest through one
    task.
    """
    patches.write.mode("overwrite").json(f"{path}/patches")
    counted = patches.sparkSession.read.schema(patches.schema).json(f"{path}/patches").agg(
        F.count("*").alias("n_patches")
    )
    row = counted.select(*[F.lit(v).alias(k) for k, v in config.items()], "n_patches")
    row.write.mode("overwrite").json(f"{path}/config")


def read_manifest_rows(spark, path, schema):
    """(config, patches) of a manifest written by ``write_manifest``."""
    return spark.read.json(f"{path}/config"), spark.read.schema(schema).json(f"{path}/patches")


def saturate(patches):
    """Values as stored: unsigned 16-bit, fractions dropped."""
    return patches.withColumn("data", F.transform("data", sat_u16))


def materialize_patches(cut, manifest, key, out):
    """Write the patches that are not in the store yet.

    ``cut(todo)`` returns dense rows (key, dz, dy, dx, data) of the given
    manifest rows. Returns one row (total, skipped, saved, failed); a patch that
    ``cut`` does not return, or returns without data, counts as failed. Rows go
    in by one append, so a lost executor repeats tasks, not patches.
    """
    spark = manifest.sparkSession
    done = existing(spark, out, key)
    todo = manifest if done is None else pending(manifest, done, [key])
    # counted before the write: later the same path means other files
    skipped = 0 if done is None else manifest.join(done, key, "left_semi").count()
    saturate(cut(todo).filter("data is not null")).write.mode("append").parquet(out)
    kept = manifest.join(existing(spark, out, key), key, "left_semi").agg(F.count("*")).scalar()
    before = F.lit(skipped).cast("bigint")
    return manifest.agg(F.count("*").alias("total")).select(
        "total",
        before.alias("skipped"),
        (kept - before).alias("saved"),
        (F.col("total") - kept).alias("failed"),
    )


def existing(spark, out, key, kind=None):
    """Keys already in a store, or None if there is no store.

    With ``kind``, the key's type, no file of the store is opened to learn it.
    """
    reader = spark.read.schema(f"`{key}` {kind}") if kind else spark.read
    try:
        return reader.parquet(out).select(key)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def write_pyramid(rows, scales, path):
    """Level tables in one folder per level, and the scale table."""
    rows.write.mode("overwrite").partitionBy("level").parquet(f"{path}/levels")
    scales.write.mode("overwrite").parquet(f"{path}/scales")


def read_pyramid(spark, path):
    """(rows, scales) of a stored pyramid; a filter on ``level`` reads its folder only."""
    return spark.read.parquet(f"{path}/levels"), spark.read.parquet(f"{path}/scales")


def write_texts(docs, path):
    """One file per document (path, text), in a folder ``path=<name>`` each.

    As ``partitionBy("path").text`` would write them: rows of one path are lines of
    one file, a null or empty path is Spark's default partition. Tasks write their
    files in place, without a commit that renames each one on the driver; a file of
    a repeated task is written again.
    """
    name = F.col("path").cast("string")
    rows = docs.select(F.when(name != "", name).alias("path"), F.col("text").cast("string").alias("text"))
    # A fixed number: joined into few partitions by their bytes, small files wait for each other.
    dealt = rows.repartition(docs.sparkSession.sparkContext.defaultParallelism, "path").sortWithinPartitions("path")
    special = re.compile(r"""[\x00-\x1f"#%'*/:=?\\\x7f{\[\]^]""")

    def write(batches):
        system, root = open_folder(path)
        found = ((p, t) for b in batches for p, t in zip(b.column("path").to_pylist(), b.column("text").to_pylist()))
        for number, (name, group) in enumerate(itertools.groupby(found, key=lambda r: r[0])):
            folder = "__HIVE_DEFAULT_PARTITION__" if name is None else special.sub(lambda m: f"%{ord(m[0]):02X}", name)
            system.create_dir(f"{root}/path={folder}")
            with system.open_output_stream(f"{root}/path={folder}/part-00000.txt") as out:
                for _, text in group:
                    out.write(f"{text or ''}\n".encode())
            if number % 1000 == 999:
                yield pa.RecordBatch.from_arrays([pa.array([1000])], names=["n"])

    open_folder(path)[0].create_dir(open_folder(path)[1], recursive=True)
    bound_batches(docs.sparkSession)
    dealt.mapInArrow(write, "n long").agg(F.sum("n")).collect()


@F.arrow_udf(T.BinaryType())
def _encode(data: pa.Array, dz: pa.Array, dy: pa.Array, dx: pa.Array) -> pa.Array:
    out = []
    for v, *shape in zip(data, dz.to_pylist(), dy.to_pylist(), dx.to_pylist()):
        a = v.values.to_numpy(zero_copy_only=False).reshape(shape)
        buffer = io.BytesIO()
        np.save(buffer, np.clip(a, 0, 65535).astype(np.uint16))
        out.append(buffer.getvalue())
    return pa.array(out, type=pa.binary())


def encode_arrays(patches, name):
    """``.npy`` contents of dense rows as (path, content), unsigned 16-bit."""
    bound_batches(patches.sparkSession, BATCH_BYTES)
    return patches.select(name.alias("path"), _encode("data", "dz", "dy", "dx").alias("content"))
