"""Queries over predictions, embeddings, reviews and point counts."""

from pyspark.sql import functions as F

from voxframe.operators import components, geometry, joins, kernels, metrics, pooling, review, stitch, supertiles
from voxframe.operators import dense
from voxframe.plans.registry import query
from voxframe.plans.spatial import CB, points_and_boxes, volumes
from voxframe.plans.voxels import cc_sql
from voxframe.session import scratch_dir
from voxframe.sources import sinks

KEY = ["volume_id"]
PV = ["patch_id", "voxel"]


# --- stitching ------------------------------------------------------------

WINDOWS = """
    select volume_id, a.s as wz0, b.s as wy0, c.s as wx0 from (select distinct volume_id from V), (select cast(unnest([0, 3, 6]) as int) as s) a, (select cast(unnest([0, 3, 6]) as int) as s) b, (select cast(unnest([0, 3, 6]) as int) as s) c"""
PRED = f"""
    select w.*, d.z, d.y, d.x, d.value / 50e0 * (1 - 1e-2 * (wz0 + wy0 + wx0)) as p from ({WINDOWS}) w join D d on d.volume_id = w.volume_id
      and d.z >= wz0 and d.z < wz0 + 6 and d.y >= wy0 and d.y < wy0 + 6 and d.x >= wx0 and d.x < wx0 + 6"""
R2 = "((z - wz0 - 2.5e0) * (z - wz0 - 2.5e0) + (y - wy0 - 2.5e0) * (y - wy0 - 2.5e0) + (x - wx0 - 2.5e0) * (x - wx0 - 2.5e0))"
WEIGHT = f"greatest(exp((0.75e0 - {R2}) / (2e0 * 0.75e0 * 0.75e0)), 1e-3)"


def faded(windows):
    """A stand-in for the model: intensity, weakened away from the origin."""
    fade = 1 - F.lit(1e-2) * (F.col("wz0") + F.col("wy0") + F.col("wx0"))
    step = (lambda v, shape, k: v / 50.0 * k, fade)
    size = [F.col(f"d{a}") for a in "zyx"]
    return kernels.pin(windows).withColumn("data", kernels.run_steps(F.col("data"), *size, [step]))


def volume_shapes(s):
    return s.V.select("volume_id").distinct().withColumns({f"dim_{a}": F.lit(12) for a in "zyx"})


def window_preds(s):
    """Predictions per sliding window, cut out of chunked volumes."""
    grid = geometry.window_grid(volume_shapes(s), 6, 3)
    boxes = grid.select(
        F.struct("volume_id", *[F.col(f"{a}0").alias(f"w{a}0") for a in "zyx"]).alias("tile"),
        "volume_id", "z0", "y0", "x0", *[(F.col(f"{a}0") + 6).alias(f"{a}1") for a in "zyx"],
    )
    cut = joins.extract_windows(boxes, dense.to_chunks(s.V, KEY, 6), KEY, 6, "tile")
    return faded(cut.select("tile.*", "dz", "dy", "dx", "data"))


def blended(chunks):
    return dense.chunk_voxels(chunks, KEY, 6, value="prob").withColumn("prob", F.round("prob", 6))


@query("blend_tiles", "D", f"""
    select volume_id, z, y, x, round(case when sum({WEIGHT}) > 1e-6 then sum(p * {WEIGHT}) / sum({WEIGHT}) else 0e0 end, 6) as prob from ({PRED}) group by 1, 2, 3, 4""")
def blend_tiles(s):
    return blended(stitch.blend_tiles(window_preds(s), KEY, 6, 6))


@query("blend_tiles_uniform", "D", f"""
    select volume_id, z, y, x, round(sum(p) / count(*), 6) as prob from ({PRED}) group by 1, 2, 3, 4""")
def blend_tiles_uniform(s):
    return blended(stitch.blend_tiles(window_preds(s), KEY, 6, 6, gaussian=False))


OWNED = """
    select d.volume_id, d.z, d.y, d.x, d.value / 50e0 * (1 - 1e-2 * (wz0 + wy0 + wx0)) as p, wz0, wy0, wx0 from (
      select v.volume_id, i - 3 + w1 as wz0, j - 3 + w2 as wy0, k - 3 + w3 as wx0, i as z0, j as y0, k as x0 from (select distinct volume_id from V) v,
        (select unnest([0, 6]) as i), (select unnest([0, 6]) as j), (select unnest([0, 6]) as k), (select unnest([0, 3, 6]) as w1), (select unnest([0, 3, 6]) as w2), (select unnest([0, 3, 6]) as w3)) t
      join D d on d.volume_id = t.volume_id and d.z between z0 and z0 + 5 and d.y between y0 and y0 + 5 and d.x between x0 and x0 + 5
        and d.z between wz0 and wz0 + 5 and d.y between wy0 and wy0 + 5 and d.x between wx0 and wx0 + 5"""


@query("blend_supertiles", "D", f"""
    select volume_id, z, y, x, round(sum(p * {WEIGHT}) / sum({WEIGHT}), 6) as prob from ({OWNED}) group by 1, 2, 3, 4""")
def blend_supertiles(s):
    """Windows of all super-tiles, each once, in the chunk that it starts in."""
    windows = supertiles.windows(dense.to_chunks(s.V, KEY, 6), volume_shapes(s), KEY, 6, 6, 3, min_valid=1, normalise=False)
    return blended(supertiles.blend(faded(windows), KEY, 6, 6, 3))


def supertile_sql(least=100):
    """Windows scaled by their voxels inside the volume, sigmoid, blend, codes, levels."""
    levels = " union all ".join(
        f"select volume_id, {k} as level, z, cast(floor(y / {2**k}) as int) as y, cast(floor(x / {2**k}) as int) as x, "
        f"cast(floor(least(greatest(avg(code) + 0.5, 0e0), 255e0)) as int) as code from c group by 1, 2, 3, 4, 5"
        for k in (1, 2)
    )
    return f"""
    with o as (select cast(unnest([-3, 0, 3, 6, 9]) as int) as s),
    w as (select d.*, a.s as wz0, b.s as wy0, c.s as wx0 from D d join o a on d.z between a.s and a.s + 5 join o b on d.y between b.s and b.s + 5 join o c on d.x between c.s and c.s + 5),
    st as (select volume_id, wz0, wy0, wx0, avg(value) as m, stddev_pop(value) as sd from w group by 1, 2, 3, 4 having count(*) >= {least}),
    p as (select volume_id, z, y, x, {WEIGHT} as wt, 1 / (1 + exp(-(value - m) / case when sd > 1e-8 then sd else 1e0 end)) as p from w join st using (volume_id, wz0, wy0, wx0)),
    c as (select volume_id, z, y, x, cast(floor(least(greatest(sum(p * wt) / sum(wt) * 255 + 0.5, 0e0), 255e0)) as int) as code from p group by 1, 2, 3, 4)
    select volume_id, 0 as level, z, y, x, code from c union all {levels}"""


@query("infer_volume", "D", supertile_sql())
def infer_volume(s):
    """From chunks of a volume to the stored pyramid of its prediction, in codes."""

    def model(windows):
        return windows.withColumn("data", F.transform("data", lambda v: 1 / (1 + F.exp(-v))))

    codes = supertiles.infer(dense.to_chunks(s.V, KEY, 4), volume_shapes(s), KEY, model, 4, 6, 3, min_valid=100)
    path = scratch_dir(s.spark, "inference")
    # Every level and the scales read the codes: written once, they are inferred once.
    codes.write.parquet(f"{path}/codes")
    codes = s.spark.read.schema(codes.schema).parquet(f"{path}/codes")
    sinks.write_pyramid(*pooling.pyramid(codes.withColumn("data", F.col("data").cast("array<double>")), KEY, 2, (4e-3, 4e-3, 4e-3)), path)
    rows, _ = sinks.read_pyramid(s.spark, path)
    voxels = dense.to_voxels(rows, [*KEY, "level", "cz", "cy", "cx", "dz"])
    edge = {"z": F.col("dz"), "y": F.lit(4) / F.pow(F.lit(2), "level"), "x": F.lit(4) / F.pow(F.lit(2), "level")}
    at = [(F.col(f"c{a}") * edge[a] + F.col(a)).cast("int").alias(a) for a in "zyx"]
    return voxels.select("volume_id", "level", *at, F.col("value").cast("int").alias("code"))


@query("ensemble_vote", "H", """
    select patch_id, voxel, round(avg(case when prob > 0.5 then 1e0 else 0e0 end), 6) as share, cast(avg(case when prob > 0.5 then 1e0 else 0e0 end) >= 0.5 as int) as mask from H group by 1, 2""")
def ensemble_vote(s):
    return stitch.ensemble_vote(s.H, PV).withColumn("share", F.round("share", 6))


@query("ensemble_disagreement", "H", "select patch_id, voxel, round(var_pop(prob), 6) as variance from H group by 1, 2")
def ensemble_disagreement(s):
    return stitch.ensemble_disagreement(s.H, PV).withColumn("variance", F.round("variance", 6))


@query("encode_and_binarize", "H", """
    with c as (select patch_id, voxel, member, cast(floor(least(greatest(prob * 255 + 0.5, 0), 255)) as int) as code from H)
    select patch_id, voxel, member, code, cast(code > round_even(0.5 * 255, 0) as int) as mask from c""")
def encode_and_binarize(s):
    return stitch.encode_and_binarize(s.H).select("patch_id", "voxel", "member", "code", "mask")


@query("foreground_share", "H", """
    select patch_id, round(avg(case when floor(least(greatest(prob * 255 + 0.5, 0), 255)) > 128 then 1 else 0 end), 6) as foreground from H group by 1""")
def foreground_share(s):
    return stitch.foreground_share(stitch.encode_and_binarize(s.H), ["patch_id"]).withColumn("foreground", F.round("foreground", 6))


@query("rasterize_spheres", "C", """
    with co as (select cast(unnest(range(-3, 4)) as int) as o)
    select distinct region_tag, cast(c.z + i.o as int) as z, cast(c.y + j.o as int) as y, cast(c.x + k.o as int) as x from C c, co i, co j, co k
    where c.z + i.o between 0 and 63 and c.y + j.o between 0 and 127 and c.x + k.o between 0 and 127
      and (i.o * 4e-3 * 1000) * (i.o * 4e-3 * 1000) + (j.o * 2e-3 * 1000) * (j.o * 2e-3 * 1000) + (k.o * 2e-3 * 1000) * (k.o * 2e-3 * 1000) <= 36""")
def rasterize_spheres(s):
    return stitch.rasterize_spheres(s.C, ["region_tag"], 6.0, (4e-3, 2e-3, 2e-3), (64, 128, 128))


@query("overlap_share", "V", """
    with f as (select volume_id, variant, case when strpos(substr(variant, 5), 'x') > 0 then 11 - x else x end as i, case when strpos(substr(variant, 5), 'y') > 0 then 11 - y else y end as j,
                      case when strpos(substr(variant, 5), 'z') > 0 then 11 - z else z end as k from V, (select unnest(['noflip', 'flipx', 'flipy', 'flipz', 'flipxy', 'flipxz', 'flipyz', 'flipxyz']) as variant) where value > 25),
    r as (select volume_id, x as i, y as j, z as k from V where value > 25), n as (select volume_id, count(*) as c from r group by 1)
    select f.volume_id, f.variant, round(count(r.i) / max(n.c), 6) as share from f join n using (volume_id) left join r on r.volume_id = f.volume_id and r.i = f.i and r.j = f.j and r.k = f.k group by 1, 2""")
def overlap_share(s):
    ref = s.V.select("volume_id", F.col("x").alias("i"), F.col("y").alias("j"), F.col("z").alias("k"), "value")
    out = stitch.overlap_share(geometry.reorient(s.V, (12, 12, 12)), ref, KEY, "variant", 25)
    return out.withColumn("share", F.round("share", 6))


# --- metrics --------------------------------------------------------------


PATCHES = "select cast(s_suppkey as int) as volume_id from supplier"


def patches(s):
    return s.supplier.select(F.col("s_suppkey").cast("int").alias("volume_id"))


def dice_query(by):
    return f"""
    with j as (select coalesce(p.volume_id, t.volume_id) as volume_id, p.z is not null as p, t.z is not null as t from M p full join M2 t on p.volume_id = t.volume_id and p.z = t.z and p.y = t.y and p.x = t.x),
    a as ({PATCHES}), k as (select a.volume_id, coalesce(j.p, false) as p, coalesce(j.t, false) as t from a left join j on j.volume_id = a.volume_id)
    select {by} as sample, round((2 * count(*) filter (where p and t) + 1) / (count(*) filter (where p) + count(*) filter (where t) + 1), 6) as dice from k group by 1"""


@query("dice_per_patch", "M M2", dice_query("volume_id"))
def dice_per_patch(s):
    out = metrics.dice(s.M, s.M2, ["volume_id"], ["volume_id", "z", "y", "x"], patches=patches(s))
    return out.select(F.col("volume_id").alias("sample"), F.round("dice", 6).alias("dice"))


@query("dice_per_batch", "M M2", dice_query("cast(floor(volume_id / 8) as bigint)"))
def dice_per_batch(s):
    batch = F.floor(F.col("volume_id") / 8).alias("sample")
    cell = ["sample", "volume_id", "z", "y", "x"]
    out = metrics.dice(s.M.select(batch, "*"), s.M2.select(batch, "*"), ["sample"], cell, patches=patches(s).select(batch))
    return out.withColumn("dice", F.round("dice", 6))


SOFT = "1 - (2 * sum(prob * truth) + 1) / (sum(prob) + sum(truth) + 1)"
BCE = "greatest(logit, 0) - logit * truth + ln(1 + exp(-abs(logit)))"
LOGITS = "select *, (prob - 5e-1) * 8 as logit from H"


def logits(s):
    return s.H.withColumn("logit", (F.col("prob") - 0.5) * 8)


@query("soft_dice_loss", "H", f"select patch_id, member, round({SOFT}, 6) as loss from H group by 1, 2")
def soft_dice_loss(s):
    return metrics.soft_dice_loss(s.H, ["patch_id", "member"]).withColumn("loss", F.round("loss", 6))


@query("bce_with_logits", "H", f"select patch_id, member, round(avg({BCE}), 6) as loss from ({LOGITS}) group by 1, 2")
def bce_with_logits(s):
    return metrics.bce_loss(logits(s), ["patch_id", "member"]).withColumn("loss", F.round("loss", 6))


DICE_CE = f"5e-1 * (1 - (2 * sum(sg * truth) + 1) / (sum(sg) + sum(truth) + 1)) + 5e-1 * avg({BCE})"


@query("dice_ce", "H", f"select patch_id, member, round({DICE_CE}, 6) as loss from (select *, 1 / (1 + exp(-logit)) as sg from ({LOGITS})) group by 1, 2")
def dice_ce(s):
    return metrics.dice_ce(logits(s), ["patch_id", "member"]).withColumn("loss", F.round("loss", 6))


LEVELS = """
    select patch_id, member as level, n, max(logit) as logit, cast(floor((voxel % (n * n * n)) / (n * n)) as int) as z, cast(floor((voxel % (n * n)) / n) as int) as y, cast(voxel % n as int) as x
    from (select *, (prob - 5e-1) * 8 as logit, case member when 0 then 8 when 1 then 6 when 2 then 4 when 3 then 2 else 1 end as n from H) group by patch_id, member, n, 5, 6, 7"""
LEVELS = LEVELS.replace("max(logit) as logit, cast", "max(logit) as logit, cast", 1)


@query("deep_supervision_score", "H", f"""
    with pl as ({LEVELS}), tv as (select distinct patch_id, cast(floor(voxel / 64) as int) as z, cast(floor((voxel % 64) / 8) as int) as y, cast(voxel % 8 as int) as x from H where truth = 1),
    jn as (select pl.patch_id, level, pl.logit, case when tv.patch_id is null then 0e0 else 1e0 end as truth, 1 / (1 + exp(-logit)) as sg from pl left join tv on tv.patch_id = pl.patch_id
           and tv.z = cast(floor(pl.z * 8 / n) as int) and tv.y = cast(floor(pl.y * 8 / n) as int) and tv.x = cast(floor(pl.x * 8 / n) as int)),
    ls as (select patch_id, level, {DICE_CE} as loss from jn group by 1, 2)
    select patch_id, round(sum(loss * (case level when 0 then 1e0 when 1 then 5e-1 when 2 then 25e-2 when 3 then 125e-3 else 625e-4 end)), 6) as score from ls group by 1""")
def deep_supervision_score(s):
    n = F.element_at(F.array(*[F.lit(v) for v in (8, 6, 4, 2, 1)]), F.col("member") + 1)
    df = logits(s).withColumn("n", n)
    v = F.col("voxel")
    cells = df.groupBy(
        "patch_id", F.col("member").alias("level"),
        F.floor((v % (F.col("n") * F.col("n") * F.col("n"))) / (F.col("n") * F.col("n"))).cast("int").alias("z"),
        F.floor((v % (F.col("n") * F.col("n"))) / F.col("n")).cast("int").alias("y"), (v % F.col("n")).alias("x"),
    ).agg(F.max("logit").alias("logit"))
    truth = s.H.filter("truth = 1").select(
        "patch_id", F.floor(v / 64).cast("int").alias("z"), F.floor((v % 64) / 8).cast("int").alias("y"), (v % 8).alias("x")
    ).distinct()
    out = metrics.deep_supervision_score(cells, truth, ["patch_id"], 8, [8, 6, 4, 2, 1])
    return out.withColumn("score", F.round("score", 6))


DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda t: cast(t[1] as double) * cast(t[2] as double)))"


def dot_sql(a, b):
    return DOT.format(a=a, b=b)


@query("l2_normalize", "E", f"""
    with u as (select vec_id, list_transform(embedding, lambda v: cast(v as double) / greatest(sqrt({dot_sql('embedding', 'embedding')}), 1e-12)) as u from E)
    select vec_id, round({dot_sql('u', 'u')}, 6) as length, round(u[1], 6) as first, round(u[64], 6) as last from u""")
def l2_normalize(s):
    from voxframe.functions.scalar import dot
    from voxframe.functions.scalar import l2_normalize as unit

    u = s.E.select("vec_id", unit(F.col("embedding")).alias("u"))
    return u.select(
        "vec_id", F.round(dot(F.col("u"), F.col("u")), 6).alias("length"), F.round(F.get("u", F.lit(0)), 6).alias("first"), F.round(F.get("u", F.lit(63)), 6).alias("last")
    )


UNIT = f"select *, sqrt({dot_sql('embedding', 'embedding')}) as nm from E"


def ntxent_sql(sim):
    return f"""
    with u as ({UNIT}), p as (select a.batch_id, a.vec_id, a.pair_id = b.pair_id as pos, {sim} / 5e-1 as l from u a join u b on a.batch_id = b.batch_id and a.vec_id <> b.vec_id),
    g as (select batch_id, vec_id, max(l) as mx, max(l) filter (where pos) as lp, max(l) filter (where not pos) as ln from p group by 1, 2),
    s as (select p.batch_id, p.vec_id, sum(exp(l - mx)) as t from p join g using (batch_id, vec_id) group by 1, 2)
    select batch_id, round(avg(mx + ln(t) - lp), 6) as loss, round(avg(case when lp >= g.ln then 1e0 else 0e0 end), 6) as accuracy from g join s using (batch_id, vec_id) group by 1"""


@query("ntxent", "E", ntxent_sql(f"({dot_sql('a.embedding', 'b.embedding')} / (a.nm * b.nm))"))
def ntxent(s):
    out = metrics.ntxent(s.E, "batch_id")
    return out.select("batch_id", F.round("loss", 6).alias("loss"), F.round("accuracy", 6).alias("accuracy"))


@query("ntxent_dot", "E", ntxent_sql(dot_sql("a.embedding", "b.embedding")))
def ntxent_dot(s):
    out = metrics.ntxent(s.E, "batch_id", similarity="dot")
    return out.select("batch_id", F.round("loss", 6).alias("loss"), F.round("accuracy", 6).alias("accuracy"))


@query("regression_loss", "E", f"""
    with u as ({UNIT}), a as (select * from u where view_name = 'i'), b as (select * from u where view_name = 'j')
    select a.batch_id, round(avg(2 - 2 * {dot_sql('a.embedding', 'b.embedding')} / (a.nm * b.nm)), 6) as loss from a join b using (pair_id) group by 1""")
def regression_loss(s):
    i, j = s.E.filter("view_name = 'i'"), s.E.filter("view_name = 'j'")
    return metrics.regression_loss(i, j, ["pair_id"], ["batch_id"]).withColumn("loss", F.round("loss", 6))


@query("component_count_error", "M M2", f"""
    with recursive {cc_sql('M', 6, 'pc')}, {cc_sql('M2', 6, 'tc')},
    p as (select volume_id, component, count(m.z) as h from pc left join M2 m using (volume_id, z, y, x) group by 1, 2), t as (select volume_id, component, count(m.z) as h from tc left join M m using (volume_id, z, y, x) group by 1, 2),
    pn as (select volume_id, count(*) as n_pred, count(*) filter (where h = 0) as spurious from p group by 1), tn as (select volume_id, count(*) as n_truth, count(*) filter (where h = 0) as missed from t group by 1)
    select volume_id, coalesce(n_pred, 0) as n_pred, coalesce(spurious, 0) as spurious, coalesce(n_truth, 0) as n_truth, coalesce(missed, 0) as missed, abs(coalesce(n_pred, 0) - coalesce(n_truth, 0)) as count_error
    from ({PATCHES}) a left join pn using (volume_id) left join tn using (volume_id)""")
def component_count_error(s):
    return metrics.component_count_error(s.M, s.M2, KEY, 6, patches(s))


# --- review ---------------------------------------------------------------

STATUS = """
    with d as (select doc_id, case when source = 'src1' then 'v0.5' else source end as source, concat(lpad(cast(doc_id % 1000 as varchar), 3, '0'), '_v05_', lang) as dir, doc_id % 11 = 5 as gone from documents), mk as (select patch_id, marker from R where not regexp_matches(marker, '[.]nii[.]gz$|[.]nrrd$') and marker not in ('rebuild_mask_4um.py', 'seg_nrrd_to_binary_nifti.py', 'view_fullres.sh')),
    a as (select patch_id, bool_or(marker in ('A', 'A.txt')) as acc, bool_or(marker in ('R', 'R.txt')) as rej, bool_or(starts_with(marker, 'M')) as may, bool_or(marker = 'empty') as emp, bool_or(marker in ('A_empty', 'empty_A', 'drop_edges_too')) as edg from mk group by 1),
    st as (select d.doc_id as patch_id, d.source as track, case when gone then 'missing' when cast(substr(dir, 1, 3) as int) between 93 and 100 and d.source = 'v0.5' then 'reject' when a.patch_id is null then 'unreviewed' when edg then 'edge' when acc and (rej or may) then 'conflict'
             when acc then 'accept' when rej then 'reject' when may then 'maybe' when emp then 'empty' else 'unreviewed' end as status from d left join a on a.patch_id = d.doc_id)"""


def classified(s):
    index = F.lpad((F.col("doc_id") % 1000).cast("string"), 3, "0")
    docs = s.documents.select(
        F.col("doc_id").alias("patch_id"),
        F.when(F.col("source") == "src1", review.FORCED_TRACK).otherwise(F.col("source")).alias("track"),
        F.concat(index, F.lit("_v05_"), "lang").alias("directory"),
        (F.col("doc_id") % 11 == 5).alias("gone"),
    )
    joined = joins.join_markers(docs, review.marker_files(s.R))
    forced = review.forced_reject(F.col("track"), F.col("directory"))
    names = F.coalesce("markers", F.array().cast("array<string>"))
    return joined.withColumn("status", review.classify_markers(names, forced, F.col("gone"))).withColumn(
        "subject_id", F.concat(F.lit("sub-"), (F.floor(F.col("patch_id") / 7)).cast("string"))
    )


@query("classify_markers", "R", STATUS + " select patch_id, status from st")
def classify_markers(s):
    return classified(s).select("patch_id", "status")


@query("accepted_manifest", "R", STATUS + " select patch_id, track, concat('sub-', cast(cast(floor(patch_id / 7) as bigint) as varchar)) as subject_id from st where status = 'accept'")
def accepted_manifest(s):
    return review.accepted_manifest(classified(s), ["patch_id", "track", "subject_id"])


@query("review_tally", "R", STATUS + """
    select 'status' as kind, status as name, count(*) as n from st group by 1, 2 union all select 'track', track, count(*) from st where status = 'accept' group by 1, 2""")
def review_tally(s):
    return review.review_tally(classified(s))


@query("patches_per_subject", "R", STATUS + """, z as (select floor(patch_id / 7) as sub, count(*) as n from st where status = 'accept' group by 1)
    select count(*) as n_subjects, min(n) as least, cast(floor(quantile_cont(n, 0.5)) as bigint) as middle, max(n) as most from z""")
def patches_per_subject(s):
    return review.patches_per_subject(review.accepted_manifest(classified(s), ["patch_id", "subject_id"]))


@query("review_notes", "", """
    with nt as (select doc_id as patch_id, case doc_id % 3 when 0 then 'A.txt' when 1 then 'M_wip.txt' else 'other.txt' end as marker, text from documents),
    u as (select patch_id, case marker when 'A.txt' then 1 else 4 end as rk, replace(trim(text), chr(10), ' | ') as note from nt where marker <> 'other.txt' and length(text) > 0)
    select patch_id, md5(note) as note_md5 from u""")
def review_notes(s):
    notes = s.documents.select(
        F.col("doc_id").alias("patch_id"), F.element_at(F.array(F.lit("A.txt"), F.lit("M_wip.txt"), F.lit("other.txt")), (F.col("doc_id") % 3 + 1).cast("int")).alias("marker"), "text"
    )
    return review.review_notes(notes).select("patch_id", F.md5("note").alias("note_md5"))


@query("manifest_summary", "P", """
    select track, dataset, count(*) filter (where label < 20) as written, count(*) filter (where label >= 20) as skipped from P group by rollup (track, dataset)""")
def manifest_summary(s):
    df = s.P.withColumn("reason", F.when(F.col("label") >= 20, "out of bounds"))
    return review.manifest_summary(df, ["track", "dataset"])


STATE = """
    select patch_id, coalesce(max_by(variant, seq) filter (where kind = 'init' and force), min_by(variant, seq) filter (where kind = 'init')) as init_variant, bool_or(kind = 'init') as initialized,
      coalesce(max_by(kind = 'review', seq) filter (where kind in ('review', 'unmark') or (kind = 'init' and force)), false) as reviewed,
      nullif(max_by(case when kind = 'unmark' then '' else notes end, seq) filter (where kind = 'unmark' or (kind = 'review' and notes is not null)), '') as review_notes
    from EV group by 1"""


@query("apply_review_events", "EV", STATE)
def apply_review_events(s):
    return review.apply_review_events(s.EV)


GOLDV = "select cast(volume_id as bigint) as patch_id, count(*) as gold_voxels from V where value > 45 group by 1"
RSTATUS = f"""select p.patch_id, g.gold_voxels, g.gold_voxels is not null as initialized, coalesce(s.reviewed, false) as reviewed, coalesce(init_variant, '-') as init_variant, coalesce(review_notes, '') as review_notes
    from (select distinct user_id as patch_id from events) p left join ({GOLDV}) g using (patch_id) left join ({STATE}) s using (patch_id)"""


def status_rows(s):
    patches = s.events.select(F.col("user_id").alias("patch_id")).distinct()
    gold = s.V.filter("value > 45").select(F.col("volume_id").cast("bigint").alias("patch_id"))
    return review.review_status(patches, review.apply_review_events(s.EV).drop("initialized"), gold)


@query("review_status", "EV V", RSTATUS)
def review_status(s):
    return status_rows(s)


@query("review_totals", "EV V", f"select count(*) as total, count(*) filter (where initialized) as initialized, count(*) filter (where reviewed) as reviewed, count(*) filter (where not reviewed) as remaining from ({RSTATUS})")
def review_totals(s):
    return review.review_totals(status_rows(s))


@query("promote_reviewed", "EV V", f"""
    select p.patch_id, p.gold_voxels as mask, coalesce(s.reviewed, false) as reviewed from ({GOLDV}) p left join ({STATE}) s using (patch_id) where coalesce(s.reviewed, false)""")
def promote_reviewed(s):
    gold = s.V.filter("value > 45").groupBy(F.col("volume_id").cast("bigint").alias("patch_id")).agg(F.count("*").alias("mask"))
    return joins.promote_reviewed(gold, review.apply_review_events(s.EV)).select("patch_id", "mask", "reviewed")


# --- points per box -------------------------------------------------------

HITS = CB + """, h as (select b.volume_id as box_id, g.region_tag, g.z, b.z0 from g join bb b on g.brain = b.brain and g.z >= b.z0 and g.z < b.z0 + 32
      and g.y >= b.y0 and g.y < b.y0 + 32 and g.x >= b.x0 and g.x < b.x0 + 32),
    n as (select box_id, region_tag, count(*) as n, sum(count(*)) over (partition by box_id) as total from h group by 1, 2)"""


def hits(s):
    points, boxes = points_and_boxes(s)
    return joins.points_in_boxes(points, boxes, 32, ["brain"])


@query("points_per_box", "C B", HITS + " select box_id, region_tag, n, cast(total as bigint) as total from n")
def points_per_box(s):
    return review.points_per_box(hits(s), ["box_id"])


@query("top_box_per_region", "C B", HITS + """,
    t as (select region_tag, box_id, n, total from (select *, row_number() over (partition by region_tag order by n desc, box_id) as rn from n) where rn = 1)
    select region_tag, box_id, n, cast(total as bigint) as total, 'region' as pick from t
    union all (select null, box_id, cast(max(total) as bigint), cast(max(total) as bigint), 'extra' from n where box_id not in (select box_id from t) group by 2 order by 3 desc, 2 limit 2)""")
def top_box_per_region(s):
    return review.top_box_per_region(review.points_per_box(hits(s), ["box_id"]), "box_id", 2)


@query("best_slice", "C B", HITS + """,
    e as (select box_id, unnest(range(greatest(z - 3, z0), least(z + 3, z0 + 31) + 1)) as slice from h), q as (select box_id, slice, count(*) as n from e group by 1, 2)
    select box_id, cast(slice as bigint) as slice, n from (select *, row_number() over (partition by box_id order by n desc, slice) as rn from q) where rn = 1""")
def best_slice(s):
    return review.best_slice(hits(s), ["box_id"], 3).withColumn("slice", F.col("slice").cast("bigint"))


MID = """
    select b.volume_id, b.patch_id, b.gy, b.gx from gr b join (select volume_id, list_sort(list_distinct(list(gz)))[cast(floor(len(list_distinct(list(gz))) / 2) as int) + 1] as gz from gr group by 1) m on m.volume_id = b.volume_id and m.gz = b.gz"""


def _middle_sql():
    from voxframe.plans.keys import sql_rank
    from voxframe.plans.spatial import GRID

    return f"""with gr as ({GRID}), sl as ({MID})
    select volume_id, patch_id from (select *, row_number() over (partition by volume_id order by {sql_rank(13, 'volume_id', 'patch_id')}, patch_id) as rn from sl where (gy * 37 + gx * 11 + volume_id) % 97 >= 50) where rn <= 4"""


@query("middle_slab_sample", "B", _middle_sql())
def middle_slab_sample(s):
    from voxframe.operators import keys, sampling
    from voxframe.plans.spatial import grid

    tiles = grid(s)
    brightest = ((F.col("gy") * 37 + F.col("gx") * 11 + F.col("volume_id")) % 97).cast("double")
    bright = keys.drop_dark_patches(tiles.withColumn("data", F.array(F.lit(0.0), brightest)))
    return sampling.middle_slab_sample(tiles, 4, 13, bright=bright).select("volume_id", "patch_id")


# --- sorts, top-k, sets ---------------------------------------------------


@query("sort_manifest", "P", "select dataset, subject_id, patch_no from P order by dataset, subject_id, patch_no")
def sort_manifest(s):
    return s.P.select("dataset", "subject_id", "patch_no").orderBy("dataset", "subject_id", "patch_no")


@query("top_k_patches", "P", "select patch_no, pz from P order by pz desc, patch_no limit 10")
def top_k_patches(s):
    return s.P.select("patch_no", "pz").orderBy(F.desc("pz"), "patch_no").limit(10)


@query("union_tracks", "P", """
    select patch_no, track, label, cast(null as varchar) as roi from P where track = 'F' union all select patch_no, track, null, dataset from P where track <> 'F'""")
def union_tracks(s):
    a = s.P.filter("track = 'F'").select("patch_no", "track", "label")
    b = s.P.filter("track <> 'F'").select("patch_no", "track", F.col("dataset").alias("roi"))
    return a.unionByName(b, allowMissingColumns=True)


@query("subject_sets", "P", """
    with t as (select distinct subject_id from P where label < 15), v as (select distinct subject_id from P where track = 'F')
    select 'both' as part, subject_id from (select * from t intersect select * from v) union all select 'train_only', subject_id from (select * from t except select * from v)""")
def subject_sets(s):
    t = s.P.filter("label < 15").select("subject_id").distinct()
    v = s.P.filter("track = 'F'").select("subject_id").distinct()
    both = t.intersect(v).select(F.lit("both").alias("part"), "subject_id")
    return both.unionByName(t.join(v, "subject_id", "left_anti").select(F.lit("train_only").alias("part"), "subject_id"))
