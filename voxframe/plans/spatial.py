"""Queries over coordinates, boxes, grids, windows and joins."""

from pyspark.sql import functions as F

from voxframe.operators import dense, geometry, joins
from voxframe.plans.keys import LV, label_voxels
from voxframe.plans.registry import query

ZYX = "zyx"
PV = "select p.*, a.vz, a.vy, a.vx, a.sz, a.sy, a.sx, a.dim_z, a.dim_y, a.dim_x, (pz - oz) / vz as cz, (py - oy) / vy as cy, (px - ox) / vx as cx from P p join A a on p.dataset = a.dataset"


def centers(s):
    return geometry.phys_to_voxel(s.P, s.A)


def rounded(*names):
    return [F.round(n, 6).alias(n) for n in names]


@query("phys_to_voxel", "P A", f"select patch_no, round(cz, 6) as cz, round(cy, 6) as cy, round(cx, 6) as cx from ({PV})")
def phys_to_voxel(s):
    return centers(s).select("patch_no", *rounded("cz", "cy", "cx"))


@query("rescale_voxel", "P A", f"""
    select patch_no, round(cz * sz, 6) as rz, round(cy * sy, 6) as ry, round(cx * sx, 6) as rx,
           round(cz * sz / sz, 6) as bz from ({PV})""")
def rescale_voxel(s):
    df = geometry.rescale_voxel(centers(s))
    back = geometry.rescale_voxel(df, src="r", out="b", inverse=True)
    return back.select("patch_no", *rounded("rz", "ry", "rx", "bz"))


BOX = "select patch_no, dim_z, dim_y, dim_x, " + ", ".join(
    f"n{a}, {a}0, {a}0 + n{a} as {a}1" for a in ZYX
) + " from (select *, " + ", ".join(
    f"cast(round_even(c{a} - n{a} / 2, 0) as bigint) as {a}0" for a in ZYX
) + " from (select *, " + ", ".join(
    f"cast(round_even(512e0 / (v{a} * 1000), 0) as bigint) as n{a}" for a in ZYX
) + f" from ({PV})))"


def boxes(s):
    df = centers(s).withColumns({f"u{a}": F.col(f"v{a}") * 1000 for a in ZYX})
    return geometry.box_from_center(df, 512.0)


@query("box_from_center", "P A", f"select patch_no, nz, ny, nx, z0, z1, y0, y1, x0, x1 from ({BOX})")
def box_from_center(s):
    return boxes(s).select("patch_no", "nz", "ny", "nx", "z0", "z1", "y0", "y1", "x0", "x1")


@query("bound_clip", "P A", "select patch_no, " + ", ".join(
    f"cast(greatest(0, {a}0) as bigint) as {a}0, cast(least(dim_{a}, {a}1) as bigint) as {a}1" for a in ZYX) + f" from ({BOX})")
def bound_clip(s):
    return geometry.bound(boxes(s), "clip").select("patch_no", *[f"{a}{e}" for a in ZYX for e in "01"])


@query("bound_pad", "P A", "select patch_no, " + ", ".join(
    f"cast(greatest(0, -{a}0) as bigint) as {a}_lo, cast(greatest(greatest(0, -{a}0), least(dim_{a}, {a}1) - {a}0) as bigint) as {a}_hi" for a in ZYX) + f" from ({BOX})")
def bound_pad(s):
    return geometry.bound(boxes(s), "pad").select("patch_no", *[f"{a}_{e}" for a in ZYX for e in ("lo", "hi")])


@query("bound_reject", "P A", f"""
    select patch_no, case when z0 < 0 or y0 < 0 or x0 < 0 or z1 > dim_z or y1 > dim_y or x1 > dim_x then 'out of bounds' end as reason from ({BOX})""")
def bound_reject(s):
    return geometry.bound(boxes(s), "reject").select("patch_no", "reason")


@query("bound_reject_shape", "P A", f"""
    select reason, count(*) as n from (select case when nz <> 51 or ny <> 41 or nx <> 41 then 'shape mismatch'
      when z0 < 0 or y0 < 0 or x0 < 0 or z1 > dim_z or y1 > dim_y or x1 > dim_x then 'out of bounds' else 'kept' end as reason from ({BOX})) group by 1""")
def bound_reject_shape(s):
    kept, skipped = geometry.split_rejected(geometry.bound(boxes(s), "reject", shape=(51, 41, 41)))
    rows = skipped.select("reason").union(kept.select(F.lit("kept").alias("reason")))
    return rows.groupBy("reason").agg(F.count("*").alias("n"))


AFFINE = ((1.25, 0.5, 0.0, -0.5), (0.0, 0.75, 0.25, 1.5), (-0.125, 0.0, 2.0, 0.25), (0.0, 0.0, 0.0, 1.0))


@query("inverse_affine", "P", "select patch_no, " + ", ".join(
    f"round({m[0]!r}::double * pz + {m[1]!r}::double * py + {m[2]!r}::double * px + {m[3]!r}::double, 6) as c{a}" for a, m in zip(ZYX, AFFINE)) + " from P")
def inverse_affine(s):
    matrix = F.array(*[F.lit(v) for row in AFFINE for v in row])
    return geometry.apply_inverse_affine(s.P, matrix).select("patch_no", *rounded("cz", "cy", "cx"))


@query("bound_shift", "P A", "select patch_no, " + ", ".join(
    f"s{a} as {a}0, s{a} + n{a} as {a}1, (s{a} + s{a} + n{a}) / 2e0 as c{a}" for a in ZYX) + " from (select *, " + ", ".join(
    f"cast(greatest(0, least({a}0, dim_{a} - n{a})) as bigint) as s{a}" for a in ZYX) + f" from ({BOX}))")
def bound_shift(s):
    return geometry.bound(boxes(s), "shift").select("patch_no", *[f"{a}{e}" for a in ZYX for e in "01"], "cz", "cy", "cx")


# --- grids ----------------------------------------------------------------

GRID = """
    select b.volume_id, gz, gy, gx, cast(gz * 64 as int) as z0, cast(gz * 64 + 64 as int) as z1, cast(gy * 64 as int) as y0, cast(gy * 64 + 64 as int) as y1,
           cast(gx * 64 as int) as x0, cast(gx * 64 + 64 as int) as x1, mm_z, mm_y, mm_x, fr_mm_z, fr_mm_y, fr_mm_x, dim_z, dim_y, dim_x,
           printf('patch_z%02d_y%02d_x%02d', gz, gy, gx) as patch_id
    from B b, (select cast(unnest(range(20)) as int) as gz) i, (select cast(unnest(range(20)) as int) as gy) j, (select cast(unnest(range(20)) as int) as gx) k
    where gz < greatest(1, floor((dim_z - 64) / 64) + 1) and gy < greatest(1, floor((dim_y - 64) / 64) + 1) and gx < greatest(1, floor((dim_x - 64) / 64) + 1)"""


def grid(s):
    return geometry.tile_grid(s.B, 64)


@query("tile_grid", "B", "select volume_id, patch_id, " + ", ".join(
    f"{a}0, {a}1, round({a}0 * mm_{a}, 6) as phys_{a}, round(64 * mm_{a}, 6) as size_{a}" for a in ZYX) + f" from ({GRID})")
def tile_grid(s):
    return grid(s).select(
        "volume_id", "patch_id", *[f"{a}{e}" for a in ZYX for e in "01"], *rounded(*[f"{p}_{a}" for p in ("phys", "size") for a in ZYX])
    )


@query("match_grids", "B", "select volume_id, patch_id, " + ", ".join(
    f"cast(round_even({a}0 * (mm_{a} / fr_mm_{a}), 0) as bigint) as f{a}0, cast(round_even({a}0 * (mm_{a} / fr_mm_{a}), 0) + round_even(64 * (mm_{a} / fr_mm_{a}), 0) as bigint) as f{a}1" for a in ZYX)
    + f" from ({GRID})")
def match_grids(s):
    g = grid(s).withColumns({f"fr_dim_{a}": F.round(F.col(f"dim_{a}") * F.col(f"mm_{a}") / F.col(f"fr_mm_{a}")) for a in ZYX})
    return geometry.match_grids(g, fine_dim="fr_dim_").select("volume_id", "patch_id", *[f"f{a}{e}" for a in ZYX for e in "01"])


@query("pair_resolutions", "B", f"""
    select volume_id, patch_id, z0, y0, x0, cast(round_even(y0 * (mm_y / fr_mm_y), 0) as bigint) as fy0 from ({GRID})""")
def pair_resolutions(s):
    coarse = grid(s).select("volume_id", "patch_id", "z0", "y0", "x0")
    fine = geometry.match_grids(grid(s)).select("volume_id", "patch_id", "fy0")
    return coarse.join(fine, ["volume_id", "patch_id"])


POSITIONS = """
    select volume_id, 'AXIS' as axis, start from (
      select volume_id, cast(unnest(case when dim_AXIS <= 64 then [0] else list_distinct(list_concat(range(0, dim_AXIS - 63, 48), [cast(dim_AXIS - 64 as bigint)])) end) as int) as start from B)"""


@query("window_positions", "B", " union all ".join(POSITIONS.replace("AXIS", a) for a in ZYX))
def window_positions(s):
    parts = [
        s.B.select("volume_id", F.lit(a).alias("axis"), F.explode(geometry.window_positions(F.col(f"dim_{a}"), 64, 48)).alias("start"))
        for a in ZYX
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


SUPER = """
    select volume_id, i as z0, least(dim_z, i + 96) as z1, j as y0, least(dim_y, j + 96) as y1, k as x0, least(dim_x, k + 96) as x1,
           i - 32 as bz0, i + 128 as bz1, j - 32 as by0, j + 128 as by1, k - 32 as bx0, k + 128 as bx1
    from B, (select cast(unnest(range(0, 2000, 96)) as int) as i) a, (select cast(unnest(range(0, 2000, 96)) as int) as j) b, (select cast(unnest(range(0, 2000, 96)) as int) as k) c
    where i < dim_z and j < dim_y and k < dim_x"""


@query("supertile_grid", "B", SUPER)
def supertile_grid(s):
    return geometry.supertile_grid(s.B, 90, 64, 32).select("volume_id", *[f"{p}{a}{e}" for p in ("", "b") for a in ZYX for e in "01"])


@query("supertile_windows", "B", f"""
    select volume_id, z0, y0, x0, bz0 + w1 as wz0, by0 + w2 as wy0, bx0 + w3 as wx0 from ({SUPER}),
      (select cast(unnest(range(0, 97, 32)) as int) as w1) p, (select cast(unnest(range(0, 97, 32)) as int) as w2) q, (select cast(unnest(range(0, 97, 32)) as int) as w3) r""")
def supertile_windows(s):
    tiles = geometry.supertile_grid(s.B, 90, 64, 32)
    return geometry.supertile_windows(tiles, 64, 32).select("volume_id", "z0", "y0", "x0", "wz0", "wy0", "wx0")


@query("region_bbox_patch", "C", """
    with b as (select region_tag, min(z) as lz, max(z) + 1 as hz, min(y) as ly, max(y) + 1 as hy, min(x) as lx, max(x) + 1 as hx from C group by 1),
    p as (select *, cast(round_even((lz / 1e0 + hz / 1e0) / 2e0 - 56 / 2, 0) as bigint) as z0, cast(round_even((ly / 2e0 + hy / 2e0) / 2e0 - 56 / 2, 0) as bigint) as y0,
                 cast(round_even((lx / 2e0 + hx / 2e0) / 2e0 - 56 / 2, 0) as bigint) as x0 from b)
    select region_tag, z0, y0, x0, cast(round_even(y0 * 2e0, 0) as bigint) as fy0, cast(round_even(y0 * 2e0, 0) as bigint) + 112 as fy1,
           case when not (lz <= z0 and z0 + 56 <= hz and ly / 2e0 <= y0 and y0 + 56 <= hy / 2e0 and lx / 2e0 <= x0 and x0 + 56 <= hx / 2e0) then 'patch not contained in region' end as reason
    from p""")
def region_bbox_patch(s):
    return geometry.region_bbox_patch(s.C, 56, (1.0, 2.0, 2.0)).select("region_tag", "z0", "y0", "x0", "fy0", "fy1", "reason")


@query("pick_level", "FL", """
    with st as (select regexp_extract(path, '/(sub-[0-9]+)/', 1) as volume_id, case when strpos(path, 'SPIM') > 0 then cast(length(path) % 7 as varchar) else '.zattrs' end as entry from FL)
    select volume_id, cast(least(coalesce(max(case when regexp_matches(entry, '^[0-9]+$') then cast(entry as int) end), 0), 4) as int) as level from st group by 1""")
def pick_level(s):
    stores = s.FL.select(
        F.regexp_extract("path", "/(sub-[0-9]+)/", 1).alias("volume_id"),
        F.when(F.col("path").contains("SPIM"), (F.length("path") % 7).cast("string")).otherwise(".zattrs").alias("entry"),
    )
    return geometry.pick_level(stores, 4)


# --- shapes ---------------------------------------------------------------


def volumes(s, name="V"):
    return dense.to_patches(getattr(s, name), ["volume_id"], (12, 12, 12))


@query("reorient", "V", """
    select volume_id, variant, i, j, k, value from (
      select volume_id, f.variant, case when strpos(substr(f.variant, 5), 'x') > 0 then 11 - x else x end as i,
             case when strpos(substr(f.variant, 5), 'y') > 0 then 11 - y else y end as j,
             case when strpos(substr(f.variant, 5), 'z') > 0 then 11 - z else z end as k, value
      from V, (select unnest(['noflip', 'flipx', 'flipy', 'flipz', 'flipxy', 'flipxz', 'flipyz', 'flipxyz']) as variant) f)""")
def reorient(s):
    return geometry.reorient(s.V, (12, 12, 12)).select("volume_id", "variant", "i", "j", "k", "value")


@query("foreground_bbox", "V", """
    select volume_id, min(z) as z0, min(y) as y0, min(x) as x0, max(z) + 1 as z1, max(y) + 1 as y1, max(x) + 1 as x1 from V where value >= 49 group by 1""")
def foreground_bbox(s):
    return geometry.foreground_bbox(s.V, ["volume_id"], 49.0)


@query("pad_to", "D", """
    select g.volume_id, g.i as z, g.j as y, g.k as x, coalesce(d.value, 0e0) as value
    from (select volume_id, i, j, k from (select distinct volume_id from D), (select cast(unnest(range(14)) as int) as i) a, (select cast(unnest(range(14)) as int) as j) b, (select cast(unnest(range(14)) as int) as k) c) g
    left join D d on d.volume_id = g.volume_id and d.z = g.i and d.y = g.j and d.x = g.k""")
def pad_to(s):
    return dense.to_voxels(geometry.pad_to(volumes(s), 14), ["volume_id"])


@query("central_crop", "D", """
    select volume_id, z - 3 as z, y - 3 as y, x - 3 as x, value from D where z between 3 and 8 and y between 3 and 8 and x between 3 and 8""")
def central_crop(s):
    return dense.to_voxels(geometry.central_crop(volumes(s), 6), ["volume_id"])


# --- joins ----------------------------------------------------------------


def window_rows(s):
    boxes = s.W.selectExpr("patch_id", "volume_id", *[f"{a}0" for a in ZYX], *[f"{a}0 + 6 as {a}1" for a in ZYX])
    return joins.extract_windows(boxes, dense.to_chunks(s.V, ["volume_id"], 6), ["volume_id"], 6)


@query("extract_windows", "W V", """
    select w.patch_id, v.z - w.z0 as z, v.y - w.y0 as y, v.x - w.x0 as x, v.value
    from W w join V v on v.volume_id = w.volume_id and v.z >= w.z0 and v.z < w.z0 + 6 and v.y >= w.y0 and v.y < w.y0 + 6 and v.x >= w.x0 and v.x < w.x0 + 6""")
def extract_windows(s):
    return dense.to_voxels(window_rows(s), ["patch_id"], F.col("value") > 0)


@query("extract_windows_shape", "W V", """
    select w.patch_id, cast(216 as int) as n, coalesce(sum(v.value), 0e0) as total
    from W w left join V v on v.volume_id = w.volume_id and v.z >= w.z0 and v.z < w.z0 + 6 and v.y >= w.y0 and v.y < w.y0 + 6 and v.x >= w.x0 and v.x < w.x0 + 6
    group by 1""")
def extract_windows_shape(s):
    return window_rows(s).select("patch_id", F.size("data").alias("n"), F.aggregate("data", F.lit(0.0), lambda a, v: a + v).alias("total"))


CB = """
    with g as (select *, regexp_extract(region_tag, '^(g[0-9]+)_', 1) as brain from C),
    bb as (select cast(volume_id as int) as volume_id, concat('g', cast(cast(floor(volume_id / 100) as bigint) as varchar)) as brain, cast((volume_id * 3) % 48 as int) as z0,
                 cast((volume_id * 5) % 96 as int) as y0, cast((volume_id * 7) % 96 as int) as x0 from B)"""


def points_and_boxes(s):
    points = s.C.withColumn("brain", F.regexp_extract("region_tag", "^(g[0-9]+)_", 1))
    boxes = s.B.selectExpr(
        "cast(volume_id as int) as box_id", "concat('g', cast(cast(floor(volume_id / 100) as bigint) as string)) as brain",
        "cast((volume_id * 3) % 48 as int) as z0", "cast((volume_id * 5) % 96 as int) as y0", "cast((volume_id * 7) % 96 as int) as x0",
    ).withColumns({f"{a}1": F.col(f"{a}0") + 32 for a in ZYX})
    return points, boxes


@query("points_in_boxes", "C B", CB + """
    select b.volume_id as box_id, g.region_tag, g.z, g.y, g.x from g join bb b on g.brain = b.brain and g.z >= b.z0 and g.z < b.z0 + 32
      and g.y >= b.y0 and g.y < b.y0 + 32 and g.x >= b.x0 and g.x < b.x0 + 32""")
def points_in_boxes(s):
    points, boxes = points_and_boxes(s)
    return joins.points_in_boxes(points, boxes, 32, ["brain"]).select("box_id", "region_tag", "z", "y", "x")


def _index(a):
    return f"floor((t.o{a} + t.s{a} * (m.{a} + 5e-1) - case when b.st_{a} > 0 then b.lo_{a} else b.hi_{a} end) / b.st_{a})"


def _meets(a):
    ends = f"t.o{a}, t.o{a} + t.s{a} * t.n{a}"
    return f"least(b.hi_{a}, greatest({ends})) > greatest(b.lo_{a}, least({ends})) + 1e-9"


ASSEMBLE = f"""
    with pr as (select t.tile_id, b.box_id from TI t join BX b on t.brain = b.brain and {' and '.join(map(_meets, ZYX))}),
    ix as (select b.box_id, {', '.join(f'{_index(a)} as {a}, ceil((b.hi_{a} - b.lo_{a}) / abs(b.st_{a})) as w_{a}' for a in ZYX)}
           from pr join TI t on t.tile_id = pr.tile_id join BX b on b.box_id = pr.box_id join M m on m.volume_id = t.tile_id),
    px as (select distinct box_id, {', '.join(f'cast({a} as int) as {a}' for a in ZYX)} from ix where {' and '.join(f'{a} >= 0 and {a} < w_{a}' for a in ZYX)})
    select px.box_id, z, y, x, n.n_tiles from px join (select box_id, count(*) as n_tiles from pr group by 1) n using (box_id)"""


@query("assemble_tiles", "TI BX M", ASSEMBLE)
def assemble_tiles(s):
    voxels = s.M.withColumnRenamed("volume_id", "tile_id")
    return joins.assemble_tiles(s.TI, voxels, s.BX, 0.05, ["brain"]).select("box_id", "z", "y", "x", "n_tiles")


@query("join_markers", "R", """
    select d.doc_id as patch_id, coalesce(m.markers, '') as markers, m.markers is null as missing
    from (select doc_id from labels union select doc_id from documents) d
    left join (select patch_id, string_agg(distinct marker, ',' order by marker) as markers from R group by 1) m on m.patch_id = d.doc_id""")
def join_markers(s):
    ids = s.labels.select(F.col("doc_id").alias("patch_id")).union(s.documents.select("doc_id")).distinct()
    return joins.join_markers(ids, s.R).select("patch_id", F.coalesce(F.array_join("markers", ","), F.lit("")).alias("markers"), "missing")


@query("label_at_center", "W V L", f"""
    select w.patch_id, coalesce(v.label, 0) as label, coalesce(l.name, printf('label=%d', coalesce(v.label, 0))) as name
    from (select patch_id, volume_id, greatest(0, least(z0 + 3, 11)) as z, greatest(0, least(y0 + 3, 11)) as y, greatest(0, least(x0 + 3, 11)) as x from W) w
    left join ({LV}) v on v.volume_id = w.volume_id and v.z = w.z and v.y = w.y and v.x = w.x
    left join L l on l.label = coalesce(v.label, 0)""")
def label_at_center(s):
    w = s.W.selectExpr("patch_id", "volume_id", *[f"{a}0 + 3 as c{a}" for a in ZYX], *[f"12 as dim_{a}" for a in ZYX])
    return joins.label_at_center(w, label_voxels(s), s.L).select("patch_id", "label", "name")


@query("union_first_wins", "P", """
    select patch_no, 'manifest' as src from P where label < 15
    union all select patch_no, 'walk' from P where label >= 10 and label >= 15""")
def union_first_wins(s):
    first = s.P.filter("label < 15").select("patch_no", F.lit("manifest").alias("src"))
    walk = s.P.filter("label >= 10").select("patch_no", F.lit("walk").alias("src"))
    return joins.union_first_wins(first, walk, ["patch_no"])


DIRS = "case when p_size % 5 = 0 then concat('other_', cast(p_partkey as string)) else concat(lpad(cast(p_partkey % 1000 as string), 3, '0'), '_v05_', cast(p_partkey as string)) end as dir"


@query("suffix_match", "", f"""
    with d as (select p_partkey, {DIRS} from part), n as (select concat('v05_', cast(p_partkey as string)) as name from part)
    select name, min(dir) as resolved, min(dir) is null as missing from n left join d on ends_with(dir, name) group by 1""")
def suffix_match(s):
    stale = s.part.selectExpr("concat('v05_', cast(p_partkey as string)) as name")
    return joins.suffix_match(stale, s.part.selectExpr(DIRS)).select("name", "resolved", "missing")


@query("upsert", "P", """
    select patch_no, case when label >= 12 then 'new' else 'old' end as version from P where label < 18 or label >= 12""")
def upsert(s):
    old = s.P.filter("label < 18").select("patch_no", F.lit("old").alias("version"))
    new = s.P.filter("label >= 12").select("patch_no", F.lit("new").alias("version"))
    return joins.upsert(old, new, ["patch_no"])


@query("pending", "P", "select patch_no, subject_id from P where label >= 10")
def pending(s):
    return joins.pending(s.P, s.P.filter("label < 10"), ["patch_no"]).select("patch_no", "subject_id")


@query("attach_references", "P RS", """
    with pool as (select distinct dataset, subject_id from RS)
    select p.patch_no, r.dataset as ref_dataset, r.subject_id as ref_subject, false as pooled from P p join pool r on r.dataset = p.dataset
    union all select p.patch_no, r.dataset, r.subject_id, true from P p, pool r where p.dataset not in (select dataset from pool)""")
def attach_references(s):
    return joins.attach_references(s.P, s.RS).select("patch_no", "ref_dataset", "ref_subject", "pooled")


GOLD = "(_seg_gold|_seg_gold_fullres)[.]nii[.]gz"


@query("pair_siblings", "GF", f"""
    with st as (select path, regexp_replace(path, '(_crop128[.]nii[.]gz|{GOLD})$', '') as stem from GF)
    select a.stem, a.path as left_path, b.path as right_path from st a join st b using (stem)
    where regexp_matches(a.path, '_crop128[.]nii[.]gz$') and regexp_matches(b.path, '{GOLD}$')""")
def pair_siblings(s):
    return joins.pair_siblings(s.GF, "_crop128[.]nii[.]gz", GOLD)


RUNS = "select distinct cast(floor(s_suppkey / 10) as bigint) as set_no from supplier"
GRIDRUN = """
    select set_no, enc, dk, fk, seed, printf('s%d_%s_%s_%s_s%d', set_no, enc, dk, fk, seed) as run_name
    from (select distinct cast(floor(s_suppkey / 10) as bigint) as set_no from supplier),
      (select unnest(['simclr', 'nnbyol3d']) as enc), (select unnest(['d10', 'd20']) as dk), (select unnest(['frozen', 'unfrozen']) as fk), (select cast(unnest(range(5)) as int) as seed)"""


def run_grid(s):
    sets = s.supplier.selectExpr("cast(floor(s_suppkey / 10) as bigint) as set_no").distinct()
    g = joins.parameter_grid(
        sets, "%s_%s_%s_s%d", enc=["simclr", "nnbyol3d"], dk=["d10", "d20"], fk=["frozen", "unfrozen"], seed=[0, 1, 2, 3, 4]
    )
    return g.withColumn("run_name", F.format_string("s%d_%s", "set_no", "run_name"))


@query("parameter_grid", "", GRIDRUN)
def parameter_grid(s):
    return run_grid(s)


@query("grid_status", "", f"""
    with g as (select *, case when seed < 2 then 'done' when seed = 2 and dk = 'd10' then 'running' else 'pending' end as state from ({GRIDRUN}))
    select run_name, state, coalesce(n.rn <= greatest(0, 50 - (select count(*) from g where state = 'running')), false) as submit
    from g left join (select run_name, row_number() over (order by run_name) as rn from g where state = 'pending') n using (run_name)""")
def grid_status(s):
    g = run_grid(s)
    state, nxt = joins.grid_status(g, g.filter("seed < 2"), g.filter("seed = 2 and dk = 'd10'"), 50)
    return state.join(nxt.select("run_name", F.lit(True).alias("submit")), "run_name", "left").select(
        "run_name", "state", F.coalesce("submit", F.lit(False)).alias("submit")
    )
