"""Folders of ``.npy`` patches as a data source of their own.

    register(spark)
    spark.read.format("patch_folder").load(folder)            # patch_id, dz, dy, dx, data
    patches.write.format("patch_folder").mode("append").save(folder)

Reading deals the files over partitions by their bytes. Shapes come from the file
headers; contents are read only if ``data`` is asked for, so a schema without it
(``.schema("patch_id string, dz int")``) opens each file for a few hundred bytes.
Filters on ``patch_id`` (equal, in) drop files before any is opened.

Writing has two phases. A task writes into a folder of its own below ``_staging``
and reports it; the commit moves whole task folders into place, one rename each,
and removes the staging. A failed attempt, or a failed job, leaves nothing behind.

Defined results: leading axes of length 1 are dropped, what is left has three
axes, else the read fails and names the file; null arrays cannot be written and
fail the job; a patch that is written twice is stored twice.
"""

import sys
import uuid

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, WriterCommitMessage

from voxframe.session import bound_batches

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCHEMA = "patch_id string, dz int, dy int, dx int, data array<double>"
STAGING = "_staging"
#: Bytes of files in one partition, unless a single file is larger.
PARTITION_BYTES = 128 << 20
#: Bytes of cells, and number of rows, that a task holds at once, unless one patch has more.
BATCH_BYTES, BATCH_ROWS = 4 << 20, 4096
KINDS = {"patch_id": pa.string(), "dz": pa.int32(), "dy": pa.int32(), "dx": pa.int32(), "data": pa.list_(pa.float64())}


def open_folder(path):
    """(file system, path on it) of a folder name or address."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def patch_name(path):
    return path.rsplit("/", 1)[-1].removesuffix(".npy")


def read_header(stream):
    """(shape without leading ones, Fortran order, dtype, offset of the data)."""
    version = np.lib.format.read_magic(stream)
    reader = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
    shape, fortran, dtype = reader(stream)
    if dtype.hasobject:
        raise ValueError("objects are not read")
    while len(shape) > 3 and shape[0] == 1:
        shape = shape[1:]
    return shape, fortran, dtype


class Files(InputPartition):
    def __init__(self, paths):
        self.paths = paths


class PatchReader(DataSourceReader):
    def __init__(self, schema, options):
        self.columns = schema.fieldNames()
        self.path, self.limit = options["path"], int(options.get("partitionBytes", PARTITION_BYTES))
        self.wanted = None

    def pushFilters(self, filters):
        for f in filters:
            names = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if names is not None and f.attribute == ("patch_id",):
                self.wanted = names if self.wanted is None else self.wanted & names
            else:
                yield f

    def partitions(self):
        system, path = open_folder(self.path)
        found = system.get_file_info(fs.FileSelector(path, recursive=True))
        files = [f for f in found if f.type == fs.FileType.File and f.path.endswith(".npy") and f"/{STAGING}/" not in f.path]
        if self.wanted is not None:
            files = [f for f in files if patch_name(f.path) in self.wanted]
        groups, size = [], 0
        for f in sorted(files, key=lambda f: f.path):
            if not groups or size + f.size > self.limit:
                groups.append([])
                size = 0
            groups[-1].append(f.path)
            size += f.size
        return [Files(g) for g in groups] or [Files([])]

    def read(self, partition):
        system, _ = open_folder(self.path)
        rows, held = [], 0
        for path in partition.paths:
            with system.open_input_file(path) as stream:
                shape, fortran, dtype = read_header(stream)
                if len(shape) != 3:
                    raise ValueError(f"{path}: expected 3 axes, found {shape}")
                row = {"patch_id": patch_name(path), "dz": shape[0], "dy": shape[1], "dx": shape[2]}
                if "data" in self.columns:
                    cells = np.frombuffer(stream.read(), dtype)
                    cells = cells.reshape(shape, order="F" if fortran else "C").ravel()
                    row["data"] = cells.astype(np.float64)
                    held += row["data"].nbytes
            rows.append(row)
            if held >= BATCH_BYTES or len(rows) >= BATCH_ROWS:
                yield self._batch(rows)
                rows, held = [], 0
        if rows:
            yield self._batch(rows)

    def _batch(self, rows):
        arrays = [pa.array([r[c] for r in rows], KINDS[c]) for c in self.columns]
        return pa.RecordBatch.from_arrays(arrays, names=self.columns)


class Staged(WriterCommitMessage):
    def __init__(self, folder):
        self.folder = folder


class PatchWriter(DataSourceArrowWriter):
    def __init__(self, schema, options, overwrite):
        self.columns, self.path, self.overwrite = schema.fieldNames(), options["path"], overwrite
        self.job = uuid.uuid4().hex

    def write(self, batches):
        system, path = open_folder(self.path)
        folder = f"{path}/{STAGING}/{self.job}/{uuid.uuid4().hex}"
        system.create_dir(folder, recursive=True)
        try:
            for batch in batches:
                ids, *sizes = (batch.column(self.columns.index(c)).to_pylist() for c in ("patch_id", "dz", "dy", "dx"))
                for name, data, shape in zip(ids, batch.column(self.columns.index("data")), zip(*sizes)):
                    cells = data.values.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(shape)
                    with system.open_output_stream(f"{folder}/{name}.npy") as out:
                        np.lib.format.write_array(out, np.clip(cells, 0, 65535).astype(np.uint16), allow_pickle=False)
        except BaseException:
            system.delete_dir(folder)
            raise
        return Staged(folder)

    def commit(self, messages):
        system, path = open_folder(self.path)
        old = []
        if self.overwrite:
            old = [f for f in system.get_file_info(fs.FileSelector(path)) if not f.path.endswith(f"/{STAGING}")]
        for message in messages:
            if message is not None:
                system.move(message.folder, f"{path}/part-{message.folder.rsplit('/', 1)[-1]}")
        for f in old:
            system.delete_dir(f.path) if f.type == fs.FileType.Directory else system.delete_file(f.path)
        self._clear()

    def abort(self, messages):
        self._clear()

    def _clear(self):
        system, path = open_folder(self.path)
        staging = f"{path}/{STAGING}"
        system.delete_dir(f"{staging}/{self.job}")
        if not system.get_file_info(fs.FileSelector(staging)):
            system.delete_dir(staging)


class PatchFolder(DataSource):
    @classmethod
    def name(cls):
        return "patch_folder"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return PatchReader(schema, self.options)

    def writer(self, schema, overwrite):
        missing = {"patch_id", "dz", "dy", "dx", "data"} - set(schema.fieldNames())
        if missing:
            raise ValueError(f"columns are missing: {sorted(missing)}")
        return PatchWriter(schema, self.options, overwrite)


def register(spark):
    """Make ``patch_folder`` known to a session, filters included."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    bound_batches(spark, BATCH_BYTES)
    spark.dataSource.register(PatchFolder)
