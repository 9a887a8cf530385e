"""Queries that write files and read them back, and metadata parsing."""

from pyspark.sql import functions as F

from voxframe import schemas
from voxframe.functions.scalar import file_name
from voxframe.functions.sql import register
from voxframe.operators import dense, joins
from voxframe.plans.keys import sql_rank
from voxframe.plans.registry import query
from voxframe.plans.spatial import volumes
from voxframe.plans.voxels import KEY, vox
from voxframe.session import scratch_dir
from voxframe.sources import patch_folder as patch_source
from voxframe.sources import readers, sinks


@query("list_dataset", "", "select distinct concat('n', cast(c_nationkey as varchar), '.ome.zarr') as name from customer")
def list_dataset(s):
    """Stores are written from a table, one folder each, and listed by name."""
    path = scratch_dir(s.spark, "stores")
    stores = s.customer.select("c_custkey", F.concat(F.lit("n"), F.col("c_nationkey").cast("string"), F.lit(".ome.zarr")).alias("store"))
    stores.repartition("store").write.partitionBy("store").parquet(path)
    files = readers.list_dataset(s.spark, [path], "*.parquet")
    return files.select(F.regexp_extract("path", "store=([^/]*)$", 1).alias("name"))


@query("list_tree", "", """
    select distinct 'store' as kind, concat('g', cast(c_nationkey % 5 as varchar)) as parent, concat('n', cast(c_nationkey as varchar), '.ome.zarr') as name from customer
    union all select distinct 'file', concat('g', cast(c_nationkey % 5 as varchar)), 'txt' from customer""")
def list_tree(s):
    """Folders of stores and loose files, listed level by level; stores are not entered."""
    path = scratch_dir(s.spark, "tree")
    nation = F.col("c_nationkey").cast("string")
    rows = s.customer.select(F.concat(F.lit("g"), (F.col("c_nationkey") % 5).cast("string")).alias("parent"), F.concat(F.lit("n"), nation, F.lit(".ome.zarr")).alias("store"), nation.alias("value"))
    rows.repartition("parent", "store").write.partitionBy("parent", "store").parquet(f"{path}/stores")
    rows.repartition("parent").select("parent", "value").write.partitionBy("parent").text(f"{path}/loose/deep")
    found = readers.list_tree(s.spark, [f"{path}/stores", f"{path}/loose"], glob="part-*")
    name = F.when(F.col("kind") == "store", F.regexp_extract("path", "store=([^/]*)$", 1)).otherwise(F.regexp_extract("path", "[.]([a-z]+)$", 1))
    return found.select("kind", F.regexp_extract("path", "parent=([^/]*)/", 1).alias("parent"), name.alias("name"))


FULL = "'^(.*)/bids/(sub-[^/]+)/micr/[^/]*_SPIM[.]ome[.]zarr$'"
RES = "'^(.*)/bids/derivatives/resampled/(sub-[^/]+)/micr/[^/]*_res-4um_SPIM[.]ome[.]zarr$'"
DSEG = "'_seg-roi22_from-ABAv3_[^/]*_desc-deform_dseg[.]nii[.]gz$'"
TSV = "'_seg-roi22_from-ABAv3_[^/]*_desc-deform_dseg[.]tsv$'"


@query("discover_subjects", "FL", f"""
    with f as (select path, regexp_extract(path, '/(sub-[^/]+)/micr/', 1) as sub, regexp_extract(path, '^(/data/ds[0-9]+)/', 1) as root, regexp_extract(path, '/derivatives/(spimquant[^/]*)/', 1) as deriv,
                      regexp_matches(regexp_extract(path, '([^/]*)$', 1), '45deg|90deg') as angled from FL),
    ch as (select root, deriv from (select root, deriv, row_number() over (partition by root order by (case when root = '/data/ds1' and deriv = 'spimquant_c' then 0 else 1 end), deriv) as rn from (select distinct root, deriv from f where deriv <> '')) where rn = 1),
    fu as (select root, sub, path from (select *, row_number() over (partition by root, sub order by angled, path) as rn from f where regexp_matches(path, {FULL})) where rn = 1),
    re as (select root, sub, path from (select *, row_number() over (partition by root, sub order by angled, path) as rn from f where regexp_matches(path, {RES})) where rn = 1),
    ds as (select f.root, f.sub, min(path) as path from f join ch using (root, deriv) where regexp_matches(path, {DSEG}) group by 1, 2),
    ts as (select f.root, f.sub, min(path) as path from f join ch using (root, deriv) where regexp_matches(path, {TSV}) group by 1, 2),
    sp as (select root, min(path) as path from ts group by 1)
    select ds.root, ds.sub as subject_id, coalesce(re.path, fu.path) as zarr_path, case when re.path is not null then 'resampled' else 'fullres' end as zarr_source, fu.path as fullres_path, ds.path as dseg_path,
           coalesce(ts.path, sp.path, '/bundled.tsv') as labels_path
    from ds left join fu using (root, sub) left join re using (root, sub) left join ts using (root, sub) left join sp on sp.root = ds.root where coalesce(re.path, fu.path) is not null""")
def discover_subjects(s):
    prefs = s.spark.createDataFrame([("/data/ds1", "spimquant_c", 0)], "root string, deriv string, rank int")
    return readers.discover_subjects(s.FL, prefs, bundled_labels="/bundled.tsv")


def patch_rows(s):
    center = F.array("pz", "py", "px").alias("center_phys")
    return s.P.select("patch_no", "subject_id", "dataset", "track", "label", "stain_channel", center)


ROWS_SQL = "select patch_no, subject_id, dataset, track, label, pz as cz, px as cx from P"


def rows_out(df):
    return df.select(
        "patch_no", "subject_id", "dataset", "track", "label", F.get("center_phys", F.lit(0)).alias("cz"), F.get("center_phys", F.lit(2)).alias("cx")
    )


@query("write_manifest", "P", ROWS_SQL)
def write_manifest(s):
    path = scratch_dir(s.spark, "manifest")
    sinks.write_manifest(patch_rows(s), {"stain": "Abeta", "seed": 42}, path)
    return rows_out(sinks.read_manifest_rows(s.spark, path, schemas.PATCH)[1])


@query("write_manifest_config", "P", "select 'Abeta' as stain, count(*) as n_patches from P")
def write_manifest_config(s):
    path = scratch_dir(s.spark, "manifest")
    sinks.write_manifest(patch_rows(s), {"stain": "Abeta", "seed": 42}, path)
    return sinks.read_manifest_rows(s.spark, path, schemas.PATCH)[0].select("stain", "n_patches")


@query("read_manifest", "P", ROWS_SQL)
def read_manifest(s):
    path = scratch_dir(s.spark, "documents")
    rows = patch_rows(s)
    config = F.struct(F.lit("Abeta").alias("stain"), F.lit(256).alias("patch_size"))
    # one document per subject: a subject has a handful of patches
    docs = rows.groupBy("subject_id").agg(F.collect_list(F.struct(*rows.columns)).alias("patches"))
    docs.select(F.to_json(F.struct(config.alias("config"), "patches")).alias("value")).write.text(path)
    return rows_out(readers.read_manifest(s.spark, path, one_per_file=False)[1])


@query("rebuild_manifest", "P", """
    select case when label = 24 then '' else subject_id end as subject_id, case when label = 24 then '' else dataset end as dataset, label = 24 as failed, count(*) as n from P group by 1, 2, 3""")
def rebuild_manifest(s):
    path = scratch_dir(s.spark, "metas")
    good = F.to_json(F.struct("subject_id", "dataset", F.array("pz", "py", "px").alias("center_phys")))
    s.P.select(F.when(F.col("label") == 24, F.concat(F.lit("{broken "), F.col("patch_no").cast("string"))).otherwise(good).alias("value")).write.text(path)
    patches, failures = readers.rebuild_manifest(s.spark, path, "part-*", one_per_file=False)
    ok = patches.select("subject_id", "dataset", F.lit(False).alias("failed"))
    bad = failures.select(F.lit("").alias("subject_id"), F.lit("").alias("dataset"), F.lit(True).alias("failed"))
    both = ok.unionByName(bad)
    return both.groupBy("subject_id", "dataset", "failed").agg(F.count("*").alias("n"))


@query("read_label_table", "V L", """
    select l.name, count(*) as n_voxels from (select *, cast((z * 5 + y * 3 + x) % 26 as int) as label from V) v join L l on v.label = l.label group by 1""")
def read_label_table(s):
    path = scratch_dir(s.spark, "labels")
    s.L.select(F.col("label").alias("index"), "name", F.upper(F.substring("name", 1, 3)).alias("abbreviation")).write.csv(path, sep="\t", header=True)
    table = readers.read_label_table(s.spark, path).withColumnRenamed("index", "label")
    voxels = s.V.selectExpr("cast((z * 5 + y * 3 + x) % 26 as int) as label")
    return voxels.groupBy("label").agg(F.count("*").alias("n_voxels")).join(table, "label").select("name", "n_voxels")


@query("read_centroids", "C", "select region_tag, cast(x as int) as x, cast(y as int) as y, cast(z as int) as z from C")
def read_centroids(s):
    path = scratch_dir(s.spark, "centroids")
    s.C.select(F.col("region_tag").alias("source"), "x", "y", "z").write.partitionBy("source").csv(path, header=True)
    return readers.read_centroids(s.spark, path, "part-*", r"source=(g[0-9]+_region[0-9]+)/", "_metadata.file_path")


def meta_docs(s, unit=1.0):
    """One metadata document per volume, half of them in either layout."""
    level = lambda n: F.struct(
        F.lit(n).alias("path"),
        F.array(
            F.struct(F.lit("scale").alias("type"), F.array(F.lit(1.0) * unit, F.col("mm_z") * unit, F.col("fr_mm_y") * unit, F.col("fr_mm_x") * unit).alias("scale"))
        ).alias("coordinateTransformations"),
    )
    axes = F.array(
        F.struct(F.lit("c").alias("name"), F.lit("channel").alias("type"), F.lit(None).cast("string").alias("unit")),
        F.struct(F.lit("z").alias("name"), F.lit("space").alias("type"), F.lit("micrometer").alias("unit")),
    )
    ms = F.array(F.struct(F.lit("/").alias("name"), axes.alias("axes"), F.array(level("0"), level("1")).alias("datasets"))).alias("multiscales")
    omero = F.struct(F.array(F.struct(F.lit("IBA1").alias("label")), F.struct(F.lit("Abeta").alias("label"))).alias("channels")).alias("omero")
    new = F.to_json(F.struct(F.struct(F.struct(F.lit("0.5").alias("version"), ms, omero).alias("ome"), F.lit("RPI").alias("xyz_orientation")).alias("attributes")))
    old = F.to_json(F.struct(ms, omero))
    text = old if unit == 1.0 else new
    return s.B.select(
        F.col("volume_id").cast("string").alias("path"), (F.when(F.col("volume_id") % 2 == 0, new).otherwise(text)).alias("text")
    )


def stored_texts(s, docs, name):
    """One file per document (path, text) in a folder of its own; the folder."""
    path = scratch_dir(s.spark, name)
    sinks.write_texts(docs, path)
    return path


def document(path):
    return F.regexp_extract(path, "path=([^/]*)/", 1)


@query("array_shape", "B", "select cast(volume_id as varchar) as path, dim_z, dim_y, dim_x from B")
def array_shape(s):
    shape = F.to_json(F.struct(F.array(F.lit(1), "dim_z", "dim_y", "dim_x").alias("shape"), F.lit("<u2").alias("dtype")))
    path = stored_texts(s, s.B.select(F.col("volume_id").cast("string").alias("path"), shape.alias("text")), "shapes")
    out = readers.read_array_shape(s.spark, path)
    dims = [F.get("shape", F.lit(i + 1)).cast("int").alias(f"dim_{a}") for i, a in enumerate("zyx")]
    return out.select(document("path").alias("path"), *dims)


@query("read_volume_meta", "B", """
    select cast(volume_id as varchar) as path, round(mm_z * 1000, 6) as um_z, round(fr_mm_y * 1000, 6) as um_y, round(fr_mm_x, 6) as mm_x, 2 as n_levels, 'IBA1,Abeta' as labels, case when volume_id % 2 = 0 then 'RPI' end as xyz_orientation from B""")
def read_volume_meta(s):
    m = readers.read_volume_meta(s.spark, stored_texts(s, meta_docs(s), "volume-meta")).withColumn("path", document("path"))
    um = lambda i: F.round(F.get("voxel_um_zyx", F.lit(i)), 6)
    return m.select(
        "path", um(0).alias("um_z"), um(1).alias("um_y"), F.round(F.get("voxel_mm_zyx", F.lit(2)), 6).alias("mm_x"),
        F.size("levels").alias("n_levels"), F.array_join("labels", ",").alias("labels"), "xyz_orientation",
    )


@query("read_sidecar", "S", """
    select subject_id, case when pos % 3 = 0 then 6875e-4 else round(5e-1 + pos % 7 / 1e2, 6) end as sz, case when pos % 3 = 0 then 40625e-5 else 4e-1 end as sy, case when pos % 3 <> 0 then 22e-1 end as uz from S""")
def read_sidecar(s):
    full = F.to_json(
        F.struct(
            F.struct(F.struct((F.lit(0.5) + F.col("pos") % 7 / F.lit(100.0)).alias("z"), F.lit(0.4).alias("y"), F.lit(0.4).alias("x")).alias("scale")).alias("fullres_to_resampled"),
            F.struct(F.struct(F.lit(2.2).alias("z"), F.lit(1.6).alias("y"), F.lit(1.6).alias("x")).alias("voxel_sizes_um")).alias("source"),
        )
    )
    docs = s.S.select(F.col("subject_id").alias("path"), F.when(F.col("pos") % 3 != 0, full).otherwise("{}").alias("text"))
    out = readers.read_sidecar(s.spark, stored_texts(s, docs, "sidecars"))
    return out.select(document("path").alias("subject_id"), F.round("sz", 6).alias("sz"), "sy", "uz")


@query("patch_metadata_units", "B", """
    select cast(volume_id as varchar) as path, round(mm_z, 6) as mm_z, round(fr_mm_x, 6) as mm_x, 'channel:,space:millimeter' as units, 'IAR' as xyz_orientation from B""")
def patch_metadata_units(s):
    fixed = readers.patch_metadata_units(meta_docs(s, 1000.0), "IAR")
    m = readers.parse_volume_meta(fixed)
    unit = F.from_json("text", schemas.META_V05)
    axes = F.get(F.col("_d.attributes.ome.multiscales"), F.lit(0))["axes"]
    names = F.array_join(F.transform(axes, lambda a: F.concat(a["type"], F.lit(":"), F.coalesce(a["unit"], F.lit("")))), ",")
    units = fixed.withColumn("_d", unit).select("path", names.alias("units"))
    return m.join(units, "path").select(
        "path", F.round(F.get("voxel_mm_zyx", F.lit(0)), 6).alias("mm_z"), F.round(F.get("voxel_mm_zyx", F.lit(2)), 6).alias("mm_x"), "units", "xyz_orientation"
    )


@query("read_array_patches", "D", "select volume_id, z, y, x, value from D")
def read_array_patches(s):
    contents = sinks.encode_arrays(volumes(s), F.col("volume_id").cast("string"))
    decoded = readers.decode_arrays(contents).withColumn("volume_id", F.col("path").cast("int"))
    return vox(decoded)


@query("patch_folder", "D", "select volume_id, z, y, x, value from D")
def patch_folder(s):
    """Patches written to a folder of arrays and read back through the data source."""
    patch_source.register(s.spark)
    path = scratch_dir(s.spark, "patch-folder")
    named = volumes(s).withColumn("patch_id", F.format_string("patch_%06d", "volume_id")).select("patch_id", "dz", "dy", "dx", "data")
    named.write.format("patch_folder").mode("append").save(path)
    stored = s.spark.read.format("patch_folder").load(path)
    return vox(stored.withColumn("volume_id", F.regexp_extract("patch_id", "([0-9]+)$", 1).cast("int")))


@query("patch_folder_shapes", "D", "select volume_id, cast(12 as int) as dz, cast(12 as int) as dy, cast(12 as int) as dx from (select distinct volume_id from D)")
def patch_folder_shapes(s):
    """Shapes from the headers alone: no array is read."""
    patch_source.register(s.spark)
    path = scratch_dir(s.spark, "patch-folder")
    named = volumes(s).withColumn("patch_id", F.format_string("patch_%06d", "volume_id")).select("patch_id", "dz", "dy", "dx", "data")
    named.write.format("patch_folder").mode("append").save(path)
    shapes = s.spark.read.format("patch_folder").schema("patch_id string, dz int, dy int, dx int").load(path)
    return shapes.select(F.regexp_extract("patch_id", "([0-9]+)$", 1).cast("int").alias("volume_id"), "dz", "dy", "dx")


def cut_windows(s):
    chunks = dense.to_chunks(s.V, KEY, 6)

    def cut(todo):
        boxes = todo.selectExpr("patch_id", "volume_id", *[f"{a}0" for a in "zyx"], *[f"{a}0 + 6 as {a}1" for a in "zyx"])
        return joins.extract_windows(boxes, chunks, KEY, 6)

    return cut


@query("materialize_patches", "W V", """
    select w.patch_id, cast(count(v.value) as bigint) as n_positive, cast(coalesce(sum(floor(least(greatest(v.value, 0), 65535))), 0) as bigint) as total
    from W w left join V v on v.volume_id = w.volume_id and v.z >= w.z0 and v.z < w.z0 + 6 and v.y >= w.y0 and v.y < w.y0 + 6 and v.x >= w.x0 and v.x < w.x0 + 6 group by 1""")
def materialize_patches(s):
    out = scratch_dir(s.spark, "patches")
    sinks.materialize_patches(cut_windows(s), s.W, "patch_id", out)
    stored = s.spark.read.parquet(out)
    return stored.select(
        "patch_id", F.size(F.filter("data", lambda v: v > 0)).cast("bigint").alias("n_positive"), F.aggregate("data", F.lit(0).cast("bigint"), lambda a, v: a + v).alias("total")
    )


@query("materialize_patches_counts", "W", """
    select count(*) as total, count(*) filter (where z0 < 4) as skipped, count(*) filter (where z0 >= 4) as saved, cast(0 as bigint) as failed from W""")
def materialize_patches_counts(s):
    """A second run over a store that already holds a part of the patches."""
    out = scratch_dir(s.spark, "patches")
    sinks.materialize_patches(cut_windows(s), s.W.filter("z0 < 4"), "patch_id", out)
    return sinks.materialize_patches(cut_windows(s), s.W, "patch_id", out)


@query("synthetic_volumes", "S", f"""
    with b as (select pos, {sql_rank(3, 'pos')} % 2147483647 as b from S), c as (select pos, b, i, (b + i * 48271) % 2147483647 as q from b, (select unnest(range(512)) as i)),
    r as (select pos, b, i, (q * q + b) % 2147483647 as r from c)
    select pos, cast(floor(i / 64) as int) as z, cast(floor(i % 64 / 8) as int) as y, cast(i % 8 as int) as x, round(((r * r + i) % 2147483647) / 2147483647e0, 6) as value from r""")
def synthetic_volumes(s):
    vols = readers.synthetic_volumes(s.S, "pos", 8, 3)
    return vox(vols, keys=["pos"])


@query("sql_functions", "V", """
    select volume_id, z, y, x, cast(round_even(value / 4, 0) as bigint) as half, cast(floor(least(greatest(value * 2000e0, 0), 65535)) as int) as sat, round(1 / (1 + exp(-(value - 25))), 6) as sig,
           cast((z * 12 + y) * 12 + x as bigint) as flat, round(sqrt(100 - (x - 5e0) * (x - 5e0)), 6) as radius from V""")
def sql_functions(s):
    register(s.spark)
    s.V.createOrReplaceTempView("vox_v")
    return s.spark.sql("""
        select volume_id, z, y, x, vox_half_even(value / 4) as half, vox_sat_u16(value * 2000D) as sat, round(vox_sigmoid(value - 25), 6) as sig,
               vox_flatten_index(z, y, x, 12, 12) as flat, round(vox_sphere_section_radius(10D, x - 5D), 6) as radius from vox_v""")


@query("string_functions", "F", """
    select path, regexp_extract(path, '_acq-([^_/.]+)', 1) as acq, regexp_extract(path, '/(sub-[0-9]+)_', 1) as subject, regexp_extract(path, '_run-([0-9]+)_', 1) as run,
           replace(regexp_extract(path, '([^/]*)$', 1), '_SPIM.ome.zarr', '') as stem from F""")
def string_functions(s):
    from voxframe.functions.scalar import entity, strip_suffix

    p = F.col("path")
    return s.F.select(
        "path", entity(p, "acq").alias("acq"), F.concat(F.lit("sub-"), entity(p, "sub")).alias("subject"), entity(p, "run").alias("run"),
        strip_suffix(file_name(p), "_SPIM.ome.zarr").alias("stem"),
    )


@query("name_functions", "P", """
    select patch_no, concat(track, '_', lpad(cast(label as varchar), cast(greatest(length(cast(label as varchar)), 3) as int), '0'), '_', subject_id) as name, concat('patch_', lpad(cast(patch_no as varchar), cast(greatest(length(cast(patch_no as varchar)), 6) as int), '0')) as file,
           case when label % 9 = 0 then '?' else dataset end as short, case when label % 9 = 0 then '?' else dataset end as short_sql, lpad(cast(label as varchar), 3, '0') as padded_sql from P""")
def name_functions(s):
    """Padded ids and short data set names, as columns and as SQL functions."""
    from voxframe.functions.scalar import dataset_short_name, numbered_id

    register(s.spark)
    whole = F.when(F.col("label") % 9 != 0, F.concat(F.lit("mouse_app_"), "dataset"))
    return s.P.withColumn("whole", whole).select(
        "patch_no", numbered_id(F.col("track"), F.col("subject_id"), number=F.col("label")).alias("name"),
        numbered_id("patch", number=F.col("patch_no"), width=6).alias("file"), dataset_short_name(F.col("whole")).alias("short"),
        F.expr("vox_dataset_short_name(whole)").alias("short_sql"), F.expr("vox_zero_pad(label, 3)").alias("padded_sql"),
    )


@query("box_functions", "P A", """
    with b as (select patch_no, label % 7 as a, stain_channel as c from P)
    select patch_no, cast(greatest(0, least(a + 4, c + 5) - greatest(a, c)) * greatest(0, least(a + 4, c + 5) - greatest(a, c)) * greatest(0, least(a + 4, c + 5) - greatest(a, c)) as bigint) as shared from b""")
def box_functions(s):
    from voxframe.functions.scalar import box_intersect, box_volume

    a, c = F.col("label") % 7, F.col("stain_channel")
    return s.P.select("patch_no", box_volume(box_intersect(F.array(a, a, a, a + 4, a + 4, a + 4), F.array(c, c, c, c + 5, c + 5, c + 5))).alias("shared"))


@query("json_functions", "", """
    select event_id, cast(props ->> '$.k' as int) as k, cast(props ->> '$.k' as int) + 1 as k_next from events""")
def json_functions(s):
    k = F.from_json("props", "k int")["k"]
    stats = F.map_from_arrays(F.array(F.lit("k"), F.lit("next")), F.array(k, k + 1))
    text = F.to_json(stats)
    back = F.from_json(text, "map<string,int>")
    return s.events.select("event_id", back["k"].alias("k"), back["next"].alias("k_next"))


@query("hash_draws", "P", f"""
    select patch_no, {sql_rank(1, 'patch_no')} as rank, round({sql_rank(1, 'patch_no')} / 4294967296e0, 9) as uniform,
           round(sqrt(-2e0 * ln(({sql_rank(2, 'patch_no', "'u1'")} + 1e0) / 4294967296e0)) * cos(6.283185307179586e0 * ({sql_rank(2, 'patch_no', "'u2'")} / 4294967296e0)), 6) as normal from P""")
def hash_draws(s):
    from voxframe.functions.scalar import hash_normal, hash_rank, hash_uniform

    return s.P.select(
        "patch_no", hash_rank(1, "patch_no").alias("rank"), F.round(hash_uniform(1, "patch_no"), 9).alias("uniform"),
        F.round(hash_normal(2, "patch_no"), 6).alias("normal"),
    )
