"""Queries over voxel values: normalise, count, pool, resample, filter, label, audit."""

import functools
import math

from pyspark.sql import functions as F

from voxframe.operators import audit, chain, components, dense, filters, geometry, histogram, joins, normalize, pooling
from voxframe.plans.registry import query
from voxframe.plans.spatial import volumes
from voxframe.session import RoundTables, ensure_checkpoint_dir, scratch_dir
from voxframe.sources import sinks

KEY = ["volume_id"]


def vox(df, digits=6, keys=KEY):
    out = dense.to_voxels(df, keys)
    return out.withColumn("value", F.round("value", digits))


def labels_of(s):
    return s.V.selectExpr("volume_id", "z", "y", "x", "cast((z * 5 + y * 3 + x) % 26 as int) as label")


# --- normalisation --------------------------------------------------------

STATS = "select volume_id, avg(value) as m, stddev_pop(value) as s, min(value) as lo, max(value) as hi from D group by 1"


@query("zscore", "D", f"select d.volume_id, z, y, x, round((value - m) / s, 6) as value from D d join ({STATS}) t using (volume_id)")
def zscore(s):
    return vox(normalize.zscore(volumes(s)))


@query("zscore_center", "D", f"select d.volume_id, z, y, x, round(case when s >= 1e-8 then (value - m) / s else value - m end, 6) as value from D d join ({STATS}) t using (volume_id)")
def zscore_center(s):
    return vox(normalize.zscore(volumes(s), "center"))


WD = """
    select w.patch_id, w.volume_id, i as z, j as y, k as x, z0 + i between 0 and 11 and y0 + j between 0 and 11 and x0 + k between 0 and 11 as ok, coalesce(v.value, 0e0) as value
    from (select * from W, (select cast(unnest(range(6)) as int) as i) a, (select cast(unnest(range(6)) as int) as j) b, (select cast(unnest(range(6)) as int) as k) c) w
    left join V v on v.volume_id = w.volume_id and v.z = z0 + i and v.y = y0 + j and v.x = x0 + k"""


def windows(s):
    """Windows of W with their corner and an inside-the-volume array."""
    corner = [f"{a}0" for a in "zyx"]
    # A window that is listed again is cut once and returned as often.
    boxes = s.W.groupBy("patch_id", "volume_id", *corner).agg(F.count("*").alias("_n"))
    tile = F.struct("patch_id", "volume_id", *corner, "_n").alias("tile")
    boxes = boxes.select(tile, "volume_id", *corner, *[(F.col(c) + 6).alias(c.replace("0", "1")) for c in corner])
    cut = joins.extract_windows(boxes, dense.to_chunks(s.V, KEY, 6), KEY, 6, "tile").select("tile.*", "dz", "dy", "dx", "data")
    # Planes of lines of cells: six flags along each axis tell those of all cells.
    for a in "zyx":
        at = F.sequence(F.col(f"{a}0"), F.col(f"{a}0") + 5)
        cut = cut.withColumn(f"_{a}", F.transform(at, lambda i: i.between(0, 11).cast("int")))
    cut = cut.withColumn("_y", F.flatten(F.transform("_y", lambda ok: F.when(ok == 1, F.col("_x")).otherwise(F.array_repeat(F.lit(0), 6)))))
    cut = cut.withColumn("_z", F.flatten(F.transform("_z", lambda ok: F.when(ok == 1, F.col("_y")).otherwise(F.array_repeat(F.lit(0), 36)))))
    return cut.withColumn("valid", F.col("_z")).withColumn("_n", F.explode(F.array_repeat(F.lit(1), F.col("_n").cast("int")))).drop("_n", "_z", "_y", "_x")


@query("zscore_valid", "W V", f"""
    with wd as ({WD}), st as (select patch_id, avg(value) as m, stddev_pop(value) as s from wd where ok group by 1 having count(*) >= 100)
    select patch_id, z, y, x, round(case when ok then (value - m) / (case when s > 1e-8 then s else 1e0 end) else 0e0 end, 6) as value from wd join st using (patch_id)""")
def zscore_valid(s):
    return vox(normalize.zscore_valid(windows(s), "valid", 100), keys=["patch_id"])


@query("minmax", "D", f"select d.volume_id, z, y, x, round((value - lo) / (hi - lo), 6) as value from D d join ({STATS}) t using (volume_id)")
def minmax(s):
    return vox(normalize.minmax(volumes(s)))


@query("window_stats", "W V", f"""
    with wd as ({WD}), st as (select patch_id, avg(value) filter (where value > 0) as m, stddev_pop(value) filter (where value > 0) as s, count(*) filter (where value > 0) as n from wd group by 1)
    select patch_id, round(case when n >= 30 and s >= 1e-6 then m end, 6) as mu, round(case when n >= 30 and s >= 1e-6 then s end, 6) as sigma,
           cast(case when n >= 30 and s >= 1e-6 then n end as int) as n_valid from st""")
def window_stats(s):
    out = normalize.window_stats(windows(s), min_valid=30)
    return out.select("patch_id", F.round("mu", 6).alias("mu"), F.round("sigma", 6).alias("sigma"), "n_valid")


GLOBAL = """
    with p as (select volume_id, count(*) as nz, quantile_cont(value, 0.05) as q from V where value > 0 group by 1),
    f as (select v.volume_id, v.value from V v join p using (volume_id) where v.value > case when nz > 200 then q else 0 end)
    select a.volume_id, count(f.value) as n_fore, case when count(f.value) <= 200 then 0e0 else avg(f.value) end as mu, case when count(f.value) <= 200 then 1e0 else stddev_pop(f.value) end as sigma
    from (select distinct volume_id from V) a left join f on f.volume_id = a.volume_id group by 1"""


@query("global_stats", "V", f"select volume_id, cast(n_fore as bigint) as n_fore, round(mu, 6) as mu, round(sigma, 6) as sigma from ({GLOBAL})")
def global_stats(s):
    out = normalize.global_stats(dense.to_chunks(s.V, KEY, 6), KEY, 200)
    return out.select("volume_id", "n_fore", F.round("mu", 6).alias("mu"), F.round("sigma", 6).alias("sigma"))


#: A stand-in for a bias-corrected copy: some voxels fade to nothing.
CORRECTED = "case when (y + 2 * x) % 7 = 0 then 0e0 else value / (1 + z * 5e-2) + x * 25e-2 end"


@query("global_stats_corrected", "V", f"""
    with p as (select volume_id, count(*) as nz, quantile_cont(value, 0.05) as q from V where value > 0 group by 1),
    f as (select v.volume_id, {CORRECTED} as c from V v join p using (volume_id) where v.value > case when nz > 200 then q else 0 end),
    g as (select volume_id, count(*) as n, avg(c) as m, stddev_pop(c) as s from f where c > 0 group by 1)
    select a.volume_id, coalesce(n, 0) as n_fore, round(case when n > 200 then m else 0e0 end, 6) as mu, round(case when n > 200 then s else 1e0 end, 6) as sigma
    from (select distinct volume_id from V) a left join g using (volume_id)""")
def global_stats_corrected(s):
    """Cut on the raw intensities, moments of the corrected ones."""
    raw = dense.to_chunks(s.V, KEY, 6).withColumnRenamed("data", "raw")
    corrected = dense.to_chunks(s.V.withColumn("value", F.expr(CORRECTED)), KEY, 6).select(*KEY, "cz", "cy", "cx", F.col("data").alias("corrected"))
    both = raw.join(corrected, [*KEY, "cz", "cy", "cx"])
    out = normalize.global_stats(both, KEY, 200, raw="raw", corrected="corrected")
    return out.select("volume_id", "n_fore", F.round("mu", 6).alias("mu"), F.round("sigma", 6).alias("sigma"))


@query("pool_reference_stats", "", """
    with st as (select l_orderkey as patch_id, l_returnflag as ref_dataset, l_linestatus as ref_subject,
                       case when count(*) >= 2 then avg(l_quantity) end as mu, case when count(*) >= 2 then stddev_pop(l_quantity) end as sigma from lineitem group by 1, 2, 3),
    gl as (select l_returnflag as ref_dataset, l_linestatus as ref_subject, avg(l_quantity) as gm, stddev_pop(l_quantity) as gs from lineitem group by 1, 2)
    select patch_id, round(avg(coalesce(mu, gm)), 6) as mu, round(sqrt(avg(pow(coalesce(sigma, gs), 2))), 6) as sigma, cast(sum(case when mu is null then 1 else 0 end) as bigint) as fallback_count,
           string_agg(concat(ref_dataset, '/', ref_subject, case when mu is null then '[global]' else '' end), ',' order by concat(ref_dataset, '/', ref_subject, case when mu is null then '[global]' else '' end)) as refs
    from st join gl using (ref_dataset, ref_subject) group by 1""")
def pool_reference_stats(s):
    li = s.lineitem.select(
        F.col("l_orderkey").alias("patch_id"), F.col("l_returnflag").alias("ref_dataset"), F.col("l_linestatus").alias("ref_subject"), "l_quantity"
    )
    many = F.count("*") >= 2
    stats = li.groupBy("patch_id", "ref_dataset", "ref_subject").agg(
        F.when(many, F.avg("l_quantity")).alias("mu"), F.when(many, F.stddev_pop("l_quantity")).alias("sigma")
    )
    glob = li.groupBy("ref_dataset", "ref_subject").agg(
        F.avg("l_quantity").alias("global_mu"), F.stddev_pop("l_quantity").alias("global_sigma")
    )
    out = normalize.pool_reference_stats(stats, glob)
    return out.select(
        "patch_id", F.round("mu", 6).alias("mu"), F.round("sigma", 6).alias("sigma"), "fallback_count", F.array_join("references", ",").alias("refs")
    )


@query("reference_zscore", "V D", f"select d.volume_id, z, y, x, round((value - mu) / greatest(sigma, 1e-6), 6) as value from D d join ({GLOBAL}) g using (volume_id)")
def reference_zscore(s):
    stats = normalize.global_stats(dense.to_chunks(s.V, KEY, 6), KEY, 200)
    return vox(normalize.reference_zscore(volumes(s).join(stats, KEY)))


CHAIN = """
    with ds as (select distinct volume_id, cast(floor(volume_id / 10) as bigint) as ds from V),
    c as (select volume_id, z, y, x, value as raw, value / case when z > 8 or y > 8 or x > 8 then 1e0 else 1 + volume_id % 4 / 10e0 end as c from V),
    pr as (select w.patch_id, r.volume_id as ref, w.z0, w.y0, w.x0 from W w join ds r on r.ds = floor(w.volume_id / 10) and r.volume_id % 10 in (0, 3)),
    st as (select patch_id, ref, avg(c.c) as m, stddev_pop(c.c) as s, count(c.c) as n from pr left join c on c.volume_id = pr.ref and c.z between z0 and z0 + 5 and c.y between y0 and y0 + 5 and c.x between x0 and x0 + 5 and c.raw > 0 group by 1, 2),
    q as (select volume_id, count(*) as nz, quantile_cont(raw, 0.05) as q from c where raw > 0 group by 1),
    gl as (select q.volume_id, case when count(c.c) > 200 then avg(c.c) else 0e0 end as m, case when count(c.c) > 200 then stddev_pop(c.c) else 1e0 end as s from q join c on c.volume_id = q.volume_id and c.raw > case when nz > 200 then q else 0 end and c.c > 0 group by 1),
    u as (select st.*, n >= 30 and st.s >= 1e-6 as ok, gl.m as gm, gl.s as gs from st join gl on gl.volume_id = st.ref),
    po as (select patch_id, avg(case when ok then m else gm end) as mu, sqrt(avg(pow(case when ok then s else gs end, 2))) as sigma, count(*) filter (where not ok) as fallback_count from u group by 1),
    """


def reference_chain(s):
    """Windows of W against the windows of two reference volumes of the same set."""
    volume = F.col("volume_id")
    # Read by every step below, so the chunks are made once.
    chunks = RoundTables(s.spark, "reference-chunks").keep(dense.to_chunks(s.V, KEY, 6))
    boxes = s.W.selectExpr("patch_id", "volume_id", *[f"{a}0" for a in "zyx"], *[f"{a}0 + 6 as {a}1" for a in "zyx"])
    refs = chunks.select("volume_id").distinct().filter("volume_id % 10 in (0, 3)")
    subjects = refs.select(F.floor(volume / 10).cast("string").alias("dataset"), volume.cast("string").alias("subject_id"))
    patches = boxes.withColumn("dataset", F.floor(volume / 10).cast("string")).drop("volume_id")
    pairs = joins.attach_references(patches, subjects).filter("not pooled").withColumn("volume_id", F.col("ref_subject").cast("int"))
    bias = F.array_repeat(1 + volume % 4 / F.lit(10.0), 27)
    fields = refs.select("volume_id", *[F.lit(3).alias(f"b{a}") for a in "zyx"], bias.alias("bias"))
    return chain.reference_normalised(boxes, pairs, chunks, fields, "patch_id", "volume_id", 6, (0.25, 0.25, 0.25), 4, 30, 200)


@query("reference_chain_stats", "W V", CHAIN + """
    o as (select patch_id from W) select patch_id, round(mu, 6) as mu, round(sigma, 6) as sigma, fallback_count from po join o using (patch_id)""")
def reference_chain_stats(s):
    out = reference_chain(s)
    return out.select("patch_id", F.round("mu", 6).alias("mu"), F.round("sigma", 6).alias("sigma"), "fallback_count")


@query("reference_chain", "W V", CHAIN + """
    i as (select cast(unnest(range(4)) as int) as i)
    select w.patch_id, a.i as z, b.i as y, d.i as x, round((coalesce(v.value, 0) - mu) / greatest(sigma, 1e-6), 6) as value from W w join po using (patch_id), i a, i b, i d
      left join V v on v.volume_id = w.volume_id and v.z = w.z0 + 1 + a.i and v.y = w.y0 + 1 + b.i and v.x = w.x0 + 1 + d.i""")
def reference_chain_windows(s):
    return vox(reference_chain(s), keys=["patch_id"])


FIELD = "select volume_id, cast(floor(z / 4) as int) as z, cast(floor(y / 4) as int) as y, cast(floor(x / 4) as int) as x, 1 + sum(value) / 6400 as b from D group by 1, 2, 3, 4"


@query("bias_correct", "D", f"""
    with fb as ({FIELD}), co as (select unnest([0, 1]) as c),
    pt as (select *, z * 25e-2 as fz, y * 25e-2 as fy, x * 25e-2 as fx from D),
    sm as (select p.volume_id, p.z, p.y, p.x, p.value, sum(fb.b * (case when i.c = 0 then 1 - (fz - floor(fz)) else fz - floor(fz) end) * (case when j.c = 0 then 1 - (fy - floor(fy)) else fy - floor(fy) end)
             * (case when k.c = 0 then 1 - (fx - floor(fx)) else fx - floor(fx) end)) as b
           from pt p, co i, co j, co k, fb where fb.volume_id = p.volume_id and fb.z = least(floor(fz) + i.c, 2) and fb.y = least(floor(fy) + j.c, 2) and fb.x = least(floor(fx) + k.c, 2)
           group by 1, 2, 3, 4, 5)
    select volume_id, z, y, x, round(value / greatest(case when z > 8 or y > 8 or x > 8 then 1e0 else b end, 1e-6), 6) as value from sm""")
def bias_correct(s):
    field = pooling.block_mean(volumes(s), 4).select(
        "volume_id", F.col("dz").alias("bz"), F.col("dy").alias("by"), F.col("dx").alias("bx"),
        F.transform("data", lambda v: v * 64 / 6400 + 1.0).alias("bias"),
    )
    df = volumes(s).withColumns({"z0": F.lit(0), "y0": F.lit(0), "x0": F.lit(0)})
    return vox(normalize.bias_correct(df, field, KEY, (0.25, 0.25, 0.25)))


# --- pooling and resampling -----------------------------------------------


def _block_sql(fz, fy, fx, expr, where="true"):
    return f"""select volume_id, cast(floor(z / {fz}) as int) as z, cast(floor(y / {fy}) as int) as y, cast(floor(x / {fx}) as int) as x, {expr} as value
        from D where {where} group by 1, 2, 3, 4"""


@query("block_mean", "D", _block_sql(5, 5, 5, "round(sum(value) / 125, 6)", "z < 10 and y < 10 and x < 10"))
def block_mean(s):
    return vox(pooling.block_mean(volumes(s), 5))


@query("block_reduce_max", "D", _block_sql(2, 5, 3, "max(value)"))
def block_reduce_max(s):
    return vox(pooling.block_reduce(volumes(s), (2, 5, 3), "max"))


@query("block_reduce_mean", "D", _block_sql(2, 5, 3, "round(sum(value) / 30, 6)"))
def block_reduce_mean(s):
    return vox(pooling.block_reduce(volumes(s), (2, 5, 3), "mean"))


@query("pyramid_mean_yx", "D", _block_sql(1, 5, 5, "floor(least(greatest(sum(value) / 25 + 0.5, 0e0), 255e0))", "y < 10 and x < 10"))
def pyramid_mean_yx(s):
    return vox(pooling.pyramid_mean_yx(volumes(s), 5))


@query("pyramid_max_yx", "M", """
    select distinct volume_id, z, cast(floor(y / 2) as int) as y, cast(floor(x / 2) as int) as x from M""")
def pyramid_max_yx(s):
    return pooling.pyramid_max_yx(s.M, KEY, 2, (12, 12))


ORDERS = ("zyx", "zxy", "yzx", "yxz", "xzy", "xyz")
TURNS = ("noflip", "flipxz")


def orders_sql(source):
    flip = lambda a: f"case when strpos(substr(variant, 5), '{a}') > 0 then 11 - {a} else {a} end"
    parts = (f"select volume_id, '{p}' as perm, variant, " + ", ".join(f"{flip(a)} as {c}" for a, c in zip(p, "ijk")) + f", value from {source}, turns where value > 30" for p in ORDERS)
    return "with turns as (select unnest(['noflip', 'flipxz']) as variant) " + " union all ".join(parts)


@query("reorient_orders", "V", orders_sql("V"))
def reorient_orders(s):
    """Sparse voxels in all six orders of the axes."""
    bright = s.V.filter("value > 30")
    parts = [geometry.reorient(bright, (12, 12, 12), TURNS, p).withColumn("perm", F.lit(p)) for p in ORDERS]
    return functools.reduce(lambda a, b: a.unionByName(b), parts).select("volume_id", "perm", "variant", "i", "j", "k", "value")


@query("reorient_dense", "D", orders_sql("D"))
def reorient_dense(s):
    """Dense rows in all six orders of the axes."""
    parts = [geometry.reorient_dense(volumes(s), TURNS, p).withColumn("perm", F.lit(p)) for p in ORDERS]
    rows = functools.reduce(lambda a, b: a.unionByName(b), parts)
    cells = dense.to_voxels(rows, ["volume_id", "perm", "variant"], keep=F.col("value") > 30)
    return cells.select("volume_id", "perm", "variant", F.col("z").alias("i"), F.col("y").alias("j"), F.col("x").alias("k"), "value")


@query("pool_to_grid", "M", """
    select distinct volume_id, cast(least(floor(z * (5e0 / 12)), 4) as int) as z, cast(least(floor(y * (5e0 / 12)), 4) as int) as y, cast(least(floor(x * (5e0 / 12)), 4) as int) as x from M""")
def pool_to_grid(s):
    return pooling.pool_to_grid(s.M, KEY, (12, 12, 12), 5)


@query("pool_labels_to_grid", "V", """
    select volume_id, cast(least(floor(z * (5e0 / 12)), 4) as int) as z, cast(least(floor(y * (5e0 / 12)), 4) as int) as y, cast(least(floor(x * (5e0 / 12)), 4) as int) as x, max(label) as label
    from (select *, cast((z * 5 + y * 3 + x) % 26 as int) as label from V) where label > 0 group by 1, 2, 3, 4""")
def pool_labels_to_grid(s):
    return pooling.pool_labels_to_grid(labels_of(s), KEY, (12, 12, 12), 5)


def _near(n, out):
    return f"cast(floor(i * ({n - 1} / {float(out - 1)}e0) + 0.5) as int)"


@query("resample_nearest", "D", f"""
    with ax as (select cast(unnest(range(7)) as int) as i)
    select d.volume_id, a.i as z, b.i as y, c.i as x, d.value from ax a, ax b, ax c, D d
    where d.z = {_near(12, 7).replace('i *', 'a.i *')} and d.y = {_near(12, 7).replace('i *', 'b.i *')} and d.x = {_near(12, 7).replace('i *', 'c.i *')}""")
def resample_nearest(s):
    return vox(pooling.resample_nearest(volumes(s), (7, 7, 7)))


@query("resample_affine_nearest", "D", """
    with ax as (select cast(unnest(range(8)) as int) as i), g as (select volume_id, a.i as z, b.i as y, c.i as x from (select distinct volume_id from D), ax a, ax b, ax c)
    select g.volume_id, g.z, g.y, g.x, coalesce(d.value, 0e0) as value from g left join D d on d.volume_id = g.volume_id
      and d.z = floor(g.z * 15e-1 + -2e0 + 0.5) and d.y = floor(g.y * 2e0 + 0e0 + 0.5) and d.x = floor(g.x * 1e0 + 3e0 + 0.5)""")
def resample_affine_nearest(s):
    return vox(pooling.resample_affine_nearest(volumes(s), (8, 8, 8), (1.5, 2.0, 1.0), (-2.0, 0.0, 3.0)))


def linear_sql(out, coord, final):
    """Separable linear interpolation of D to out^3."""
    text = "with ax as (select i, floor(c) as lo, least(floor(c) + 1, 11) as hi, c - floor(c) as t from (select cast(i as int) as i, " + coord + f" as c from (select unnest(range({out})) as i)))"
    prev, names = "D", []
    for n, a in enumerate("zyx"):
        others = [b for b in "zyx" if b != a]
        cols = ", ".join([f"l.{b}" for b in others])
        text += f", l{n} as materialized (select l.volume_id, ax.i as {a}, {cols}, l.value * (1 - ax.t) + h.value * ax.t as value from {prev} l join ax on l.{a} = ax.lo join {prev} h on h.volume_id = l.volume_id and h.{a} = ax.hi and {' and '.join(f'h.{b} = l.{b}' for b in others)})"
        prev = f"l{n}"
    return text + f" select volume_id, z, y, x, {final} as value from {prev}"


@query("resample_linear", "D", linear_sql(5, "i * (11 / 4e0)", "floor(least(greatest(value, 0e0), 65535e0))"))
def resample_linear(s):
    return vox(pooling.resample_linear(volumes(s), (5, 5, 5)))


@query("project_max", "D", "select volume_id, z, x, max(value) as value from D group by 1, 2, 3")
def project_max(s):
    return pooling.project_max(volumes(s), KEY, "y")


@query("project_mask", "M", "select distinct volume_id, y, x from M")
def project_mask(s):
    return pooling.project_mask(s.M, KEY, "z")


@query("write_pyramid", "D", """
    with l1 as (select volume_id, z, cast(floor(y / 2) as int) as y, cast(floor(x / 2) as int) as x, floor(least(greatest(sum(value) / 4 + 0.5, 0e0), 255e0)) as value from D group by 1, 2, 3, 4),
    l2 as (select volume_id, z, cast(floor(y / 4) as int) as y, cast(floor(x / 4) as int) as x, floor(least(greatest(sum(value) / 16 + 0.5, 0e0), 255e0)) as value from D group by 1, 2, 3, 4),
    a as (select 0 as level, * from D union all select 1, * from l1 union all select 2, * from l2)
    select volume_id, level, round(4e-3 * pow(2e0, level), 6) as sy, count(*) as n, sum(value) as total, sum(value * (z * 10000 + y * 100 + x)) as moment from a group by 1, 2, 3""")
def write_pyramid(s):
    path = scratch_dir(s.spark, "pyramid")
    sinks.write_pyramid(*pooling.pyramid(volumes(s), KEY, 2, (4e-3, 4e-3, 4e-3)), path)
    rows, scales = sinks.read_pyramid(s.spark, path)
    out = dense.to_voxels(rows, ["volume_id", "level"]).groupBy("volume_id", "level").agg(
        F.count("*").alias("n"), F.sum("value").alias("total"),
        F.sum(F.col("value") * (F.col("z") * 10000 + F.col("y") * 100 + F.col("x"))).alias("moment"),
    )
    return out.join(scales.select("volume_id", "level", F.round("sy", 6).alias("sy")), ["volume_id", "level"])


# --- counts ---------------------------------------------------------------


@query("distribution_stats", "D", """
    select volume_id, round(quantile_cont(value, 0.90), 6) as p90, round(quantile_cont(value, 0.95), 6) as p95, round(quantile_cont(value, 0.99), 6) as p99,
           round(quantile_cont(value, 0.995), 6) as p99_5, round(quantile_cont(value, 0.999), 6) as p99_9, max(value) as max,
           round(case when quantile_cont(value, 0.99) > 0 then max(value) / quantile_cont(value, 0.99) else cast('Infinity' as double) end, 6) as max_over_p99 from D group by 1""")
def distribution_stats(s):
    d = histogram.distribution_stats(volumes(s), KEY)
    return d.select("volume_id", "max", *[F.round(c, 6).alias(c) for c in d.columns if c not in ("volume_id", "max")])


@query("percentile_range", "V", """
    select volume_id, round(lo, 6) as lo, round(case when hi > lo then hi else lo + 1 end, 6) as hi
    from (select volume_id, quantile_cont(value, 0.05) as lo, quantile_cont(value, 0.995) as hi from V where value > 0 group by 1)""")
def percentile_range(s):
    return histogram.percentile_range(volumes(s), KEY).select("volume_id", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))


HIST = """select volume_id, lo, hi, cast(case when hi > lo then least(floor((value - lo) / (hi - lo) * 256), 255) else 0 end as int) as bin, count(*) as n
          from D join (select volume_id, min(value) as lo, max(value) as hi from D group by 1) e using (volume_id) group by 1, 2, 3, 4"""


@query("histogram", "D", HIST)
def hist(s):
    return histogram.histogram(volumes(s), KEY)


OTSU = f"""
    with h as ({HIST}), g as (select v.volume_id, v.lo, v.hi, b.bin, coalesce(h.n, 0) as n from (select distinct volume_id, lo, hi from h) v, (select cast(unnest(range(256)) as int) as bin) b
              left join h on h.volume_id = v.volume_id and h.bin = b.bin),
    c as (select *, cast(sum(n) over w as double) as cw, cast(sum(n * bin) over w as double) as cm, cast(sum(n) over (partition by volume_id) as double) as tw, cast(sum(n * bin) over (partition by volume_id) as double) as tm
          from g window w as (partition by volume_id order by bin))"""


def _term(w, m):
    return f"(case when {w} > 0 then ({m}) * ({m}) / ({w}) else 0e0 end)"


@query("multi_otsu_k2", "D", OTSU + f"""
    select volume_id, bin, round(lo + (bin + 0.5) * ((hi - lo) / 256e0), 6) as threshold from (
      select *, row_number() over (partition by volume_id order by {_term('cw', 'cm')} + {_term('tw - cw', 'tm - cm')} desc, bin) as rn from c where bin <= 254) where rn = 1""")
def multi_otsu_k2(s):
    out = histogram.multi_otsu(histogram.histogram(volumes(s), KEY), KEY, 2)
    return out.withColumn("threshold", F.round("threshold", 6))


@query("multi_otsu_k3", "D", OTSU + f"""
    select volume_id, bin, round(lo + (bin + 0.5) * ((hi - lo) / 256e0), 6) as threshold from (
      select a.volume_id, a.lo, a.hi, b.bin, row_number() over (partition by a.volume_id order by {_term('a.cw', 'a.cm')} + {_term('b.cw - a.cw', 'b.cm - a.cm')} + {_term('a.tw - b.cw', 'a.tm - b.cm')} desc, a.bin, b.bin) as rn
      from c a join c b on a.volume_id = b.volume_id and b.bin > a.bin where a.bin <= 253 and b.bin <= 254) where rn = 1""")
def multi_otsu_k3(s):
    out = histogram.multi_otsu(histogram.histogram(volumes(s), KEY), KEY, 3)
    return out.withColumn("threshold", F.round("threshold", 6))


# --- filters --------------------------------------------------------------


def separable_sql(taps, edge, base="D"):
    """Three passes of the same taps; text starts with ``with``-less CTEs."""
    half = len(taps) // 2
    kernel = "kr as (select * from (values " + ", ".join(f"({i - half}, {w!r}::double)" for i, w in enumerate(taps)) + ") as t(k, w))"
    ctes, prev = [kernel], base
    for n, a in enumerate("zyx"):
        at = f"({a} - k)"
        if edge == "reflect":
            # source voxel s feeds every output o whose reflected index is s
            cand = f"unnest([{a} - k, -1 - {a} - k, 23 - {a} - k])"
        else:
            cand = None
        others = ", ".join(b for b in "zyx" if b != a)
        if edge == "reflect":
            src = f"select volume_id, {others}, w, value, {cand} as {a} from {prev}, kr"
        else:
            src = f"select volume_id, {others}, w, value, {a} - k as {a} from {prev}, kr union all select volume_id, {others}, w, value, o.o as {a} from {prev}, kr, (select cast(unnest(range(12)) as int) as o) o where ({a} = 0 and o.o + k < 0) or ({a} = 11 and o.o + k > 11)"
        ctes.append(f"f{n} as (select volume_id, {', '.join('cast(' + b + ' as int) as ' + b for b in 'zyx')}, sum(w * value) as value from ({src}) where {a} between 0 and 11 group by 1, 2, 3, 4)")
        prev = f"f{n}"
    return ", ".join(ctes), prev


def filter_query(taps, edge):
    ctes, last = separable_sql(taps, edge)
    return f"with {ctes} select volume_id, z, y, x, round(value, 6) as value from {last}"


@query("gaussian_filter", "D", filter_query(filters.gaussian_taps(0.7, 3), "reflect"))
def gaussian_filter(s):
    return vox(filters.gaussian_filter(volumes(s), 0.7))


@query("uniform_filter", "D", filter_query([1.0 / 15] * 15, "reflect"))
def uniform_filter(s):
    return vox(filters.uniform_filter(volumes(s), 15))


@query("gaussian_blur_5", "D", filter_query(filters.gaussian_taps(0.8, 2), "replicate"))
def gaussian_blur_5(s):
    return vox(filters.gaussian_blur_5(volumes(s), 0.8))


# --- components -----------------------------------------------------------

CODE = "(cast(z as bigint) * 4398046511104 + cast(y as bigint) * 2097152 + x)"


def cc_sql(mask, conn=26, name="cc"):
    """Recursive labelling: (volume_id, z, y, x, component)."""
    near = "abs(a.z - b.z) <= 1 and abs(a.y - b.y) <= 1 and abs(a.x - b.x) <= 1" if conn == 26 else "abs(a.z - b.z) + abs(a.y - b.y) + abs(a.x - b.x) = 1"
    return f"""{name}_v as (select volume_id, z, y, x, {CODE} as code from {mask}),
    {name}_e as (select a.volume_id, a.code as u, b.code as v from {name}_v a join {name}_v b on a.volume_id = b.volume_id and {near} and a.code <> b.code),
    {name}_r as (select volume_id, code, code as lab from {name}_v union select e.volume_id, e.v, r.lab from {name}_r r join {name}_e e on e.volume_id = r.volume_id and e.u = r.code and r.lab < e.v),
    {name} as (select v.volume_id, v.z, v.y, v.x, min(r.lab) as component from {name}_v v join {name}_r r on r.volume_id = v.volume_id and r.code = v.code group by 1, 2, 3, 4)"""


@query("connected_components", "M", f"with recursive {cc_sql('M')} select volume_id, z, y, x, component from cc")
def connected_components(s):
    return components.connected_components(s.M, KEY, 26)


@query("connected_components_6", "M", f"with recursive {cc_sql('M', 6)} select volume_id, z, y, x, component from cc")
def connected_components_6(s):
    return components.connected_components(s.M, KEY, 6)


def mask_chunks(s, edge=4):
    """The mask as dense chunk rows, several of which any larger object passes through."""
    return dense.to_chunks(s.M.withColumn("value", F.lit(1.0)), KEY, edge)


def label_rows(chunks, edge=4):
    rows = dense.chunk_voxels(chunks, KEY, edge, keep=F.col("component") >= 0, value="component")
    return rows.select("volume_id", "z", "y", "x", "component")


@query("volume_components", "M", f"with recursive {cc_sql('M')} select volume_id, z, y, x, component from cc")
def volume_components(s):
    """Objects through many chunks, labelled chunk by chunk and joined at the faces."""
    return label_rows(components.volume_components(mask_chunks(s), KEY, 4, 26))


@query("volume_components_6", "M", f"with recursive {cc_sql('M', 6)} select volume_id, z, y, x, component from cc")
def volume_components_6(s):
    return label_rows(components.volume_components(mask_chunks(s, 3), KEY, 3, 6), 3)


@query("size_filter", "M", f"""
    with recursive {cc_sql('M', 6)}, sz as (select volume_id, component, count(*) as n from cc group by 1, 2 having count(*) >= 3),
    nb as (select *, row_number() over (partition by volume_id order by component) as component_id from sz)
    select cc.volume_id, z, y, x, component_id from cc join nb using (volume_id, component)""")
def size_filter(s):
    return components.size_filter(components.connected_components(s.M, KEY, 6), KEY, 3).select("volume_id", "z", "y", "x", "component_id")


@query("drop_large", "M", f"""
    with recursive {cc_sql('M', 6)}, sz as (select volume_id, component, count(*) as n from cc group by 1, 2)
    select v.volume_id, coalesce(k.n, 0) as kept, coalesce(r.c, 0) as n_removed, cast(coalesce(r.v, 0) as bigint) as voxels_removed
    from (select distinct volume_id from M) v left join (select volume_id, cast(sum(n) as bigint) as n from sz where n <= 20 group by 1) k using (volume_id)
    left join (select volume_id, count(*) as c, sum(n) as v from sz where n > 20 group by 1) r using (volume_id)""")
def drop_large(s):
    kept, removed = components.drop_large(components.connected_components(s.M, KEY, 6), KEY, 20)
    counts = kept.groupBy("volume_id").agg(F.count("*").alias("kept"))
    both = s.M.select("volume_id").distinct().join(counts, KEY, "left").join(removed, KEY, "left")
    return both.select("volume_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("kept", "n_removed", "voxels_removed")])


LOCAL, LOCAL_LAST = separable_sql([1.0 / 15] * 15, "reflect")
NORM = f"nm as (select d.*, (value - m) / s as norm from D d join ({STATS}) t using (volume_id))"
COMPSTATS = f"""{{cc}}, {NORM}, {LOCAL},
    cs as (select cc.volume_id, component, count(*) as size, avg(norm) as mean_norm, avg(nm.value) as mean_raw, avg(lo.value) as mean_local
           from cc join nm using (volume_id, z, y, x) join {LOCAL_LAST} lo using (volume_id, z, y, x) group by 1, 2)"""


def with_norm(s):
    d = volumes(s)
    return normalize.zscore(d.withColumn("raw", F.col("data"))).withColumn("norm", F.col("data")).withColumn("data", F.col("raw")).drop("raw")


@query("component_stats", "D M", f"""
    with recursive {COMPSTATS.format(cc=cc_sql('M', 6))}
    select volume_id, component, size, round(mean_norm, 6) as mean_norm, round(mean_raw, 6) as mean_raw, round(mean_local, 6) as mean_local,
           round(case when mean_local > 1e-6 then mean_raw / mean_local end, 6) as ratio from cs""")
def component_stats(s):
    local = filters.uniform_filter(with_norm(s), 15, out="local")
    comps = components.connected_components(s.M, KEY, 6)
    values = audit.component_values(comps, local, KEY, {"norm": "norm", "raw": "data", "local": "local"})
    stats = components.component_stats(comps, values.drop("component"), KEY)
    return stats.select("volume_id", "component", "size", *[F.round(c, 6).alias(c) for c in ("mean_norm", "mean_raw", "mean_local", "ratio")])


BINS_SQL = ", ".join(
    f"count(*) filter (where size >= {lo}{f' and size < {hi}' if hi else ''}) as b_{lo}_{hi or 'inf'}"
    for lo, hi in zip(components.SIZE_BINS, [*components.SIZE_BINS[1:], None])
)


@query("size_bins", "M", f"""
    with recursive {cc_sql('M', 6)}, sz as (select volume_id, component, count(*) as size from cc group by 1, 2)
    select a.volume_id, {BINS_SQL} from (select cast(s_suppkey as int) as volume_id from supplier) a left join sz on sz.volume_id = a.volume_id group by 1""")
def size_bins(s):
    sizes = components.component_sizes(components.connected_components(s.M, KEY, 6), KEY)
    return components.size_bins(sizes, KEY, s.supplier.select(F.col("s_suppkey").cast("int").alias("volume_id")))


@query("confidence_counts", "D M", f"""
    with recursive {cc_sql('M', 6)}, {NORM}, cs as (select cc.volume_id, component, avg(norm) as mean_norm from cc join nm using (volume_id, z, y, x) group by 1, 2)
    select volume_id, count(*) filter (where mean_norm < 0) as comp_neg, count(*) filter (where mean_norm >= 0 and mean_norm < 1) as comp_borderline, count(*) filter (where mean_norm >= 1) as comp_confident
    from cs group by 1""")
def confidence_counts(s):
    comps = components.connected_components(s.M, KEY, 6)
    values = audit.component_values(comps, with_norm(s), KEY, {"norm": "norm"})
    return components.confidence_counts(values.groupBy("volume_id", "component").agg(F.avg("norm").alias("mean_norm")), KEY)


@query("mask_stats", "M", """
    select s.volume_id, coalesce(n, 0) as mask_pos_vox, coalesce(n, 0) / 1728 as fraction, coalesce(n, 0) = 0 as empty
    from (select cast(s_suppkey as int) as volume_id from supplier) s left join (select volume_id, count(*) as n from M where value_ok group by 1) m using (volume_id)""".replace(" where value_ok", ""))
def mask_stats(s):
    return components.mask_stats(s.supplier.select(F.col("s_suppkey").cast("int").alias("volume_id")), s.M, KEY, 1728)


# --- audit ----------------------------------------------------------------


def _flag_sql(n="n_components"):
    dim, tiny = f"(comp_neg + comp_borderline) / greatest({n}, 1)", f"(b_0_5 + b_5_10) / greatest({n}, 1)"
    tests = [
        (f"max_over_p99 > 10 and gold_fraction > 2e-2 and {dim} > 3e-1", "HEAVY_TAIL_OVERSEG"),
        ("volume_id % 3 = 0 and max_over_p99 > 10 and gold_fraction > 15e-3", "SPARSE_EXPECTED"),
        (f"comp_neg / greatest({n}, 1) > 2e-1", "NEG_NORM_COMPONENTS"),
        (f"{tiny} > 5e-1", "TINY_DOMINATED"),
        ("mean_local_ratio < 11e-1", "LOW_CONFIDENCE"),
    ]
    parts = ", ".join(f"case when {t} then '{name}' end" for t, name in tests)
    return f"case when {n} > 0 then concat_ws(',', {parts}) else '' end"


def audit_sql(cc):
    return f"""{COMPSTATS.format(cc=cc)},
    pp as (select volume_id, count(*) as n_components, cast(sum(size) as bigint) as labeled_voxels, count(*) filter (where mean_norm < 0) as comp_neg, count(*) filter (where mean_norm >= 0 and mean_norm < 1) as comp_borderline,
             count(*) filter (where mean_norm >= 1) as comp_confident, {BINS_SQL}, avg(case when mean_local > 1e-6 then mean_raw / mean_local end) as mean_local_ratio from cs group by 1),
    ds as (select volume_id, quantile_cont(norm, 0.99) as p99, max(norm) as mx from nm group by 1),
    rec as (select ds.volume_id, case when p99 > 0 then mx / p99 else cast('Infinity' as double) end as max_over_p99, coalesce(n_components, 0) as n_components, coalesce(labeled_voxels, 0) as labeled_voxels,
             coalesce(labeled_voxels, 0) / 1728e0 as gold_fraction, coalesce(mean_local_ratio, 0e0) as mean_local_ratio,
             {', '.join(f'coalesce({c}, 0) as {c}' for c in ['comp_neg', 'comp_borderline', 'comp_confident', *[f"b_{lo}_{hi or 'inf'}" for lo, hi in zip(components.SIZE_BINS, [*components.SIZE_BINS[1:], None])]])}
             from ds left join pp using (volume_id)),
    au as (select *, {_flag_sql()} as flags from rec)"""


AUDIT_COLS = ["volume_id", "n_components", "labeled_voxels", "comp_neg", "comp_borderline", "comp_confident", "b_0_5", "b_5_10", "b_20_50"]
AUDIT_OUT = ", ".join(AUDIT_COLS) + ", round(max_over_p99, 6) as max_over_p99, round(gold_fraction, 6) as gold_fraction, round(mean_local_ratio, 6) as mean_local_ratio, flags"


def audit_rows(rec):
    return rec.select(
        *AUDIT_COLS, *[F.round(c, 6).alias(c) for c in ("max_over_p99", "gold_fraction", "mean_local_ratio")], F.array_join("flags", ",").alias("flags")
    )


def stored_norm(s):
    """Dense rows with ``norm``, worked out once for all steps that read them."""
    ensure_checkpoint_dir(s.spark)
    return with_norm(s).checkpoint()


def mask_audit(s):
    comps = components.connected_components(s.M, KEY, 6)
    return audit.audit_patches(stored_norm(s), comps, KEY, 1728, F.col("volume_id") % 3 == 0)


@query("audit_patches", "D M", f"with recursive {audit_sql(cc_sql('M', 6))} select {AUDIT_OUT} from au")
def audit_patches(s):
    return audit_rows(mask_audit(s))


@query("audit_flags", "D M", f"with recursive {audit_sql(cc_sql('M', 6))} select unnest(string_split(flags, ',')) as flag, count(*) as n from au where flags <> '' group by 1")
def audit_flags(s):
    return audit.audit_report(mask_audit(s), "volume_id")[0]


@query("audit_report", "D M", f"""
    with recursive {audit_sql(cc_sql('M', 6))} select volume_id, len(string_split(flags, ',')) as n_flags, flags from au where flags <> '' order by n_flags desc, volume_id limit 10""")
def audit_report(s):
    return audit.audit_report(mask_audit(s), "volume_id")[2].select("volume_id", F.col("n_flags").cast("bigint").alias("n_flags"), F.array_join("flags", ",").alias("flags"))


OTSU_ON_NORM = OTSU[OTSU.index("with") + 4:].replace("from D join (select volume_id, min(value) as lo, max(value) as hi from D group by 1)", "from ND join (select volume_id, min(value) as lo, max(value) as hi from ND group by 1)")


@query("patch_audit", "D", f"""
    with recursive ND as (select volume_id, z, y, x, (value - m) / s as value from D join ({STATS}) t using (volume_id)), {OTSU_ON_NORM},
    th as (select volume_id, lo + (bin + 0.5) * ((hi - lo) / 256e0) as threshold from (
      select *, row_number() over (partition by volume_id order by {_term('cw', 'cm')} + {_term('tw - cw', 'tm - cm')} desc, bin) as rn from c where bin <= 254) where rn = 1),
    fg as (select volume_id, z, y, x from ND join th using (volume_id) where value > threshold),
    {cc_sql('fg', 26, 'c0')}, cc as (select * from c0 where (volume_id, component) in (select (volume_id, component) from c0 group by volume_id, component having count(*) >= 2)),
    {audit_sql('zz as (select 1)')}
    select {AUDIT_OUT} from au""")
def patch_audit(s):
    """Z-score, Otsu threshold, label, drop specks, audit."""
    df = stored_norm(s)
    norm = df.select("volume_id", "dz", "dy", "dx", F.col("norm").alias("data"))
    thresholds = histogram.multi_otsu(histogram.histogram(norm, KEY), KEY, 2)
    mask = histogram.mask_above(norm, thresholds, KEY)
    comps = components.size_filter(components.connected_components(mask, KEY, 26), KEY, 2)
    return audit_rows(audit.audit_patches(df, comps, KEY, 1728, F.col("volume_id") % 3 == 0))
