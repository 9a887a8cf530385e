"""Readers: listings, manifests, metadata, centroids, array files."""

import fnmatch
import functools
import re

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import functions as F

from voxframe import schemas
from voxframe.functions.scalar import CELL_MOD, file_name, hash_rank
from voxframe.operators import kernels
from voxframe.operators.geometry import DEFAULT_SCALE_ZYX
from voxframe.operators.keys import ANGLED, resolve_preferred
from voxframe.session import RoundTables, bound_batches
from voxframe.sources.patch_folder import open_folder


#: A directory with such a name is one store; what is in it is not listed.
STORE = r"\.ome\.zarr$"
LISTING = "path string, kind string, length long, modified timestamp"
#: Schemes of addresses that the tasks can list on their own.
LISTED = ("file", "s3", "gs", "gcs", "hdfs", "abfs")


def list_level(directories, store=STORE, glob="*"):
    """What is directly in the given directories: (path, kind, length, modified).

    ``kind`` is ``dir``, ``store`` or ``file``; files are those whose name fits
    ``glob``. Directories are listed by the tasks; one that is gone lists nothing.
    """
    def run(batches):
        is_store = re.compile(store or "(?!)")
        for batch in batches:
            out = [[], [], [], []]
            for path in batch.column("path").to_pylist():
                prefix = "file:" if path.startswith("file:") else ""
                system, place = open_folder(path)
                scheme = path.split("://")[0] + "://" if "://" in path and not prefix else prefix
                for info in system.get_file_info(fs.FileSelector(place, allow_not_found=True)):
                    directory = info.type == fs.FileType.Directory
                    kind = ("store" if is_store.search(info.base_name) else "dir") if directory else "file"
                    if kind != "file" or fnmatch.fnmatchcase(info.base_name, glob):
                        for column, value in zip(out, (scheme + info.path, kind, None if directory else info.size, info.mtime)):
                            column.append(value)
            kinds = (pa.string(), pa.string(), pa.int64(), pa.timestamp("us", "UTC"))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names=["path", "kind", "length", "modified"])

    return directories.select("path").mapInArrow(run, LISTING)


def list_tree(spark, roots, store=STORE, glob="*"):
    """Files and stores below the roots, level by level: (path, kind, length, modified).

    The directories of a level are a table that tasks share out and list; only
    whether there is a next level comes to the driver. A store is one row and is
    not entered, so its chunks are never listed (without ``store``, a pattern of
    names, no directory is one). A root that is a store is one row; roots that
    contain one another give their rows once each.
    """
    tables = RoundTables(spark, "listing")
    start = spark.createDataFrame([(r.rstrip("/") or "/",) for r in roots], "path string").distinct()
    is_store = F.col("path").rlike(store) if store else F.lit(False)
    own = start.filter(is_store).select("path", F.lit("store").alias("kind"), F.lit(None).cast("long").alias("length"), F.lit(None).cast("timestamp").alias("modified"))
    found, level = [own], start.filter(~is_store)
    while True:
        # A directory may hold very many others: each goes to a task of its own.
        listed = tables.keep(list_level(level.repartition(F.col("path")), store, glob))
        found.append(listed.filter("kind <> 'dir'"))
        level = listed.filter("kind = 'dir'")
        if level.isEmpty():
            return functools.reduce(lambda a, b: a.unionAll(b), found).distinct()


def list_dataset(spark, roots, glob="*"):
    """Files under the roots: (path, length, modified, n_files); none is opened.

    A directory store counts as one entry, cut at its ``.ome.zarr`` name, with the
    sum of its files; ``list_tree`` has it without looking into it. Tasks list the
    directories and fold the stores. Folders that only Spark's own file systems
    reach are listed by Spark.
    """
    scheme = [re.match(r"^([A-Za-z0-9+.-]+):", r) for r in roots]
    if all(s is None or s[1] in LISTED for s in scheme):
        named = [r if s else f"file:{r}" for r, s in zip(roots, scheme)]
        files = list_tree(spark, named, store=None, glob=glob)
    else:
        reader = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob)
        files = reader.load(list(roots)).select("path", "length", F.col("modificationTime").alias("modified"))
    store = F.regexp_extract("path", r"^(.*?\.ome\.zarr)(/|$)", 1)
    entry = F.when(store != "", store).otherwise(F.col("path"))
    return files.groupBy(entry.alias("path")).agg(
        F.sum("length").alias("length"), F.max("modified").alias("modified"), F.count("*").alias("n_files")
    )


def discover_subjects(files, prefs, seg_level="roi22", bundled_labels=None):
    """Volumes, atlas and label table of each subject of each data set.

    One aggregate over the classified listing: the first standard acquisition
    (else the first angled one), resampled before full resolution, from the
    preferred derivative directory. Subjects without a volume or an atlas drop
    out; a label table may come from the subject, the data set, or
    ``bundled_labels``. ``prefs``: (root, deriv, rank).
    """
    deriv = F.regexp_extract("path", r"^(.*)/derivatives/(spimquant[^/]*)/", 2)
    root_of = lambda pattern: F.regexp_extract("path", pattern, 1)
    full = r"^(.*)/bids/(sub-[^/]+)/micr/[^/]*_SPIM\.ome\.zarr$"
    resampled = r"^(.*)/bids/derivatives/resampled/(sub-[^/]+)/micr/[^/]*_res-4um_SPIM\.ome\.zarr$"
    atlas = rf"^(.*)/derivatives/spimquant[^/]*/(sub-[^/]+)/micr/[^/]*_seg-{seg_level}_from-ABAv3_[^/]*_desc-deform_dseg\.nii\.gz$"
    table = rf"^(.*)/derivatives/spimquant[^/]*/(sub-[^/]+)/micr/[^/]*_seg-{seg_level}_from-ABAv3_[^/]*_desc-deform_dseg\.tsv$"
    spare = rf"^(.*)/derivatives/spimquant[^/]*/.*_seg-{seg_level}_[^/]*_dseg\.tsv$"
    role = (
        F.when(F.col("path").rlike(resampled), "resampled")
        .when(F.col("path").rlike(full), "full")
        .when(F.col("path").rlike(atlas), "dseg")
        .when(F.col("path").rlike(table), "labels")
    )
    subject = F.regexp_extract("path", r"/(sub-[^/]+)/micr/", 1)
    root = F.coalesce(
        *[F.nullif(root_of(p), F.lit("")) for p in (resampled, full, r"^(.*)/derivatives/spimquant[^/]*/")]
    )
    seen = files.select("path", role.alias("role"), root.alias("root"), subject.alias("subject_id"), deriv.alias("deriv"))
    found = seen.filter("deriv <> ''").select("root", "deriv").distinct()
    chosen = resolve_preferred(found, prefs, ["root"], "deriv")
    spares = (
        seen.filter(F.col("path").rlike(spare)).join(chosen, ["root", "deriv"]).groupBy("root").agg(F.min("path").alias("_spare"))
    )
    used = seen.filter("role is not null").join(chosen.withColumnRenamed("deriv", "_use"), "root")
    used = used.filter((F.col("deriv") == "") | (F.col("deriv") == F.col("_use")))
    angled = file_name(F.col("path")).rlike(ANGLED).cast("int")
    pick = lambda r: F.min(F.when(F.col("role") == r, F.struct(angled, F.col("path").alias("p"))))["p"]
    per = used.groupBy("root", "subject_id").agg(
        pick("full").alias("fullres_path"),
        pick("resampled").alias("resampled_path"),
        pick("dseg").alias("dseg_path"),
        pick("labels").alias("_labels"),
    )
    fallback = F.lit(bundled_labels).cast("string")
    out = per.join(spares, "root", "left").select(
        "root",
        "subject_id",
        F.coalesce("resampled_path", "fullres_path").alias("zarr_path"),
        F.when(F.col("resampled_path").isNotNull(), "resampled").otherwise("fullres").alias("zarr_source"),
        "fullres_path",
        "dseg_path",
        F.coalesce("_labels", "_spare", fallback).alias("labels_path"),
    )
    return out.filter("zarr_path is not null and dseg_path is not null and labels_path is not null")


def read_manifest(spark, path, one_per_file=True):
    """(config, patches) of manifest documents, one per file or one per line."""
    doc = spark.read.schema(schemas.MANIFEST).json(path, multiLine=one_per_file)
    return doc.select("config.*"), doc.select(F.explode("patches").alias("p")).select("p.*")


def rebuild_manifest(spark, root, glob="*_meta.json", skip_dir="/_wt_cache/", one_per_file=True):
    """(patches, failures) from per-patch metadata, one per file or per line.

    Files of the reference cache are skipped; unreadable records become
    failures with their file.
    """
    texts = (
        spark.read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", glob)
        .text(root, wholetext=one_per_file)
        .select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))
        .filter(~F.col("file").contains(skip_dir))
    )
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    rows = texts.withColumn("_m", F.from_json("text", schemas.PATCH_META, options))
    bad = F.col("_m").isNull() | F.col("_m._corrupt").isNotNull()
    return rows.filter(~bad).select("file", "_m.*").drop("_corrupt"), rows.filter(bad).select("file", "text")


def read_label_table(spark, path):
    """Tab-separated index, name, abbreviation."""
    return spark.read.schema(schemas.LABEL_TABLE).csv(path, sep="\t", header=True)


def read_centroids(spark, path, glob="*_gt.csv", tag=r"(region[^_./]*)", of="_metadata.file_name"):
    """Centroid rows with the region tag taken from the file name."""
    rows = (
        spark.read.schema(schemas.CENTROIDS)
        .option("header", True)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", glob)
        .csv(path)
    )
    name = F.col(of)
    found = F.regexp_extract(name, tag, 1)
    stem = F.regexp_replace(file_name(name), r"\.csv$", "")
    return rows.select(F.when(found != "", found).otherwise(stem).alias("region_tag"), "x", "y", "z")


def _whole_texts(spark, paths):
    return spark.read.option("recursiveFileLookup", True).text(paths, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")
    )


def parse_volume_meta(docs):
    """Level scales, voxel size and channel labels of metadata texts (path, text).

    Both layouts are tried; sizes are millimetres, also given in micrometres.
    """
    old = F.from_json("text", schemas.META_V04)
    new = F.from_json("text", schemas.META_V05)
    ms = F.coalesce(F.get(F.col("_o.multiscales"), F.lit(0)), F.get(F.col("_n.attributes.ome.multiscales"), F.lit(0)))
    scale_of = lambda d: F.get(
        F.filter(d["coordinateTransformations"], lambda t: t["type"] == "scale"), F.lit(0)
    )["scale"]
    df = docs.withColumns({"_o": old, "_n": new}).withColumn("_m", ms)
    levels = F.transform(F.col("_m.datasets"), lambda d: F.struct(d["path"].alias("path"), scale_of(d).alias("scale")))
    channels = F.coalesce(F.col("_o.omero.channels"), F.col("_n.attributes.ome.omero.channels"))
    first = F.get(F.col("levels"), F.lit(0))["scale"]
    return (
        df.select(
            "path",
            levels.alias("levels"),
            F.transform(channels, lambda c: c["label"]).alias("labels"),
            F.coalesce(F.col("_o.xyz_orientation"), F.col("_n.attributes.xyz_orientation")).alias("xyz_orientation"),
        )
        .withColumn("voxel_mm_zyx", F.slice(first, F.size(first) - 2, 3))
        .withColumn("voxel_um_zyx", F.transform("voxel_mm_zyx", lambda v: v * 1000))
    )


def read_volume_meta(spark, paths):
    """Metadata of volume stores, from ``.zattrs`` or ``zarr.json`` files."""
    return parse_volume_meta(_whole_texts(spark, paths))


def parse_array_shape(docs):
    """Shape of array metadata texts (path, text), same key in both layouts."""
    return docs.select("path", F.from_json("text", schemas.ARRAY_META)["shape"].alias("shape"))


def read_array_shape(spark, paths):
    """Shapes of arrays, from their metadata files."""
    return parse_array_shape(_whole_texts(spark, paths))


def parse_sidecar(docs):
    """Scale (z, y, x) and source of resampling sidecars (path, text)."""
    df = docs.withColumn("_s", F.from_json("text", schemas.SIDECAR))
    scale = [
        F.coalesce(F.col(f"_s.fullres_to_resampled.scale.{a}"), F.lit(d)).alias(f"s{a}")
        for a, d in zip("zyx", DEFAULT_SCALE_ZYX)
    ]
    size = [F.col(f"_s.source.voxel_sizes_um.{a}").alias(f"u{a}") for a in "zyx"]
    return df.select("path", *scale, *size, F.col("_s.source.path").alias("source"), F.col("_s.source.shape_czyx").alias("shape"))


def read_sidecar(spark, paths):
    return parse_sidecar(_whole_texts(spark, paths))


def patch_metadata_units(docs, orientation=None):
    """Metadata texts with scales in millimetres and an orientation.

    Every scale value is divided by 1000 and every space axis is marked as
    millimetre; texts in, texts out.
    """
    def axis(a):
        unit = F.when(a["type"] == "space", F.lit("millimeter")).otherwise(a["unit"])
        return a.withField("unit", unit)

    def transform(t):
        return t.withField(
            "scale", F.when(t["type"] == "scale", F.transform(t["scale"], lambda v: v / 1000.0)).otherwise(t["scale"])
        )

    def dataset(d):
        return d.withField("coordinateTransformations", F.transform(d["coordinateTransformations"], transform))

    def scales(m):
        return m.withField("axes", F.transform(m["axes"], axis)).withField("datasets", F.transform(m["datasets"], dataset))

    df = docs.withColumn("_d", F.from_json("text", schemas.META_V05))
    fixed = F.transform(F.col("_d.attributes.ome.multiscales"), scales)
    doc = F.col("_d").withField("attributes.ome.multiscales", fixed)
    if orientation:
        doc = doc.withField("attributes.xyz_orientation", F.lit(orientation))
    return df.select("path", F.to_json(doc).alias("text"))


DENSE = "path string, dz int, dy int, dx int, data array<double>"


def decode_arrays(files):
    """Dense rows of ``.npy`` contents (path, content).

    Leading axes of length 1 are dropped; what is left must have three axes.
    """
    most = kernels.BATCH_BYTES

    def table(paths, arrays):
        flat, ends = np.concatenate([a.ravel() for a in arrays]), np.cumsum([0, *(a.size for a in arrays)])
        size = [pa.array([a.shape[i] for a in arrays], pa.int32()) for i in range(3)]
        cells = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
        return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), *size, cells], names=["path", "dz", "dy", "dx", "data"])

    def decode(batches):
        # What is returned at once is bounded: cells take up to eight times the bytes of their file.
        paths, arrays, held = [], [], 0
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content")):
                a = np.load(pa.BufferReader(content.as_buffer()), allow_pickle=False)
                while a.ndim > 3 and a.shape[0] == 1:
                    a = a[0]
                if a.ndim != 3:
                    raise ValueError(f"{path}: expected 3 axes, found {a.shape}")
                paths.append(path.as_py())
                arrays.append(a.astype(np.float64))
                held += 8 * a.size
                if held >= most:
                    yield table(paths, arrays)
                    paths, arrays, held = [], [], 0
        if arrays:
            yield table(paths, arrays)

    bound_batches(files.sparkSession, most)
    return files.select("path", "content").mapInArrow(decode, DENSE)


def read_array_patches(spark, path, glob="*.npy"):
    """Dense rows of ``.npy`` patch files."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    )
    return decode_arrays(files)


def synthetic_volumes(ids, key, edge, seed=0):
    """A deterministic dense volume in [0, 1) per id."""
    base = hash_rank(seed, key) % CELL_MOD
    return kernels.hashed_volumes(ids.select(key, base.alias("base")), key, edge)
