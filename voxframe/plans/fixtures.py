"""Input tables of the registered queries, derived from the star schema.

Each text runs unchanged in Spark SQL and in an SQL database. Every table
grows with its source table; none takes a subset. ``{name}`` stands for a
source table or an earlier fixture.
"""

import string

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

EDGE = 12  # cells per axis of a fixture volume

FIXTURES = {
    # One volume of 12^3 per supplier; absent voxels are 0.
    "V": """
        select cast(l_suppkey as int) as volume_id, cast(l_orderkey % 12 as int) as z,
               cast(l_partkey % 12 as int) as y,
               cast((l_suppkey * 7 + l_linenumber + cast(floor(l_orderkey / 12) as bigint)) % 12 as int) as x,
               max(l_quantity) as value
        from {lineitem} group by 1, 2, 3, 4""",
    # Foreground of V.
    "M": "select volume_id, z, y, x from {V} where value > 25",
    # A second mask over the same volumes.
    "M2": "select volume_id, z, y, x from {V} where value > 20 and value < 45",
    # One 6^3 window per customer, partly outside its volume.
    "W": """
        select c_custkey as patch_id, cast(floor(c_custkey / 15) as int) as volume_id,
               cast(c_custkey % 13 - 2 as int) as z0, cast((c_custkey * 7) % 13 - 2 as int) as y0,
               cast((c_custkey * 5) % 13 - 2 as int) as x0
        from {customer}""",
    # Label table and region groups with weights .4 .3 .2 .1 0.
    "L": "select n_nationkey as label, n_name as name, n_regionkey as group_pos from {nation}",
    "G": "select r_regionkey as pos, r_name as name, cast(4 - r_regionkey as double) / 10 as weight from {region}",
    # Subjects in a fixed order.
    "S": """
        select s_suppkey as pos, concat('sub-', lpad(cast(s_suppkey as string), 6, '0')) as subject_id,
               concat('ds', cast(s_nationkey % 5 + 1 as string)) as dataset
        from {supplier}""",
    # Reference (wild-type) subjects.
    "RS": """
        select concat('sub-', lpad(cast(s_suppkey as string), 6, '0')) as subject_id, concat('ds', cast(s_nationkey % 4 + 1 as string)) as dataset
        from {supplier} where s_acctbal < 2000""",
    # Patch manifest.
    "P": """
        select o_orderkey as patch_no, concat('sub-', lpad(cast(o_custkey as string), 6, '0')) as subject_id,
               concat('ds', substr(o_orderpriority, 1, 1)) as dataset, cast(o_custkey % 25 as int) as label,
               o_orderstatus as track, cast(o_orderkey % 3 as int) as stain_channel,
               cast(o_orderkey % 97 as double) * 5e-2 as pz, cast(o_custkey % 89 as double) * 5e-2 as py,
               cast((o_orderkey * 13) % 101 as double) * 5e-2 as px
        from {orders}""",
    # Affine and resampling scale per dataset.
    "A": """
        select concat('ds', cast(r_regionkey + 1 as string)) as dataset,
               1e-2 * (1 + r_regionkey) as vz, 125e-4 as vy, 125e-4 as vx,
               cast(r_regionkey as double) * 1e-1 as oz, 0e0 as oy, 0e0 as ox,
               6875e-4 as sz, 40625e-5 as sy, 40625e-5 as sx, 200 as dim_z, 160 as dim_y, 160 as dim_x
        from {region}""",
    # Volume shapes and scales at two resolutions, one per supplier.
    "B": """
        select s_suppkey as volume_id, cast(200 + 40 * (s_suppkey % 5) as int) as dim_z,
               cast(160 + 30 * (s_suppkey % 4) as int) as dim_y, 160 as dim_x,
               4e-3 as mm_z, 4e-3 as mm_y, 4e-3 as mm_x, 4e-3 as fr_mm_z, 2e-3 as fr_mm_y, 2e-3 as fr_mm_x
        from {supplier}""",
    # Mask tiles of a brain (ten volumes each) along z, y running backwards.
    "TI": """
        select s_suppkey as tile_id, cast(floor(s_suppkey / 10) as bigint) as brain,
               cast(s_suppkey % 10 as double) * 3e-2 as oz, 48e-3 as oy, 0e0 as ox,
               4e-3 as sz, -4e-3 as sy, 4e-3 as sx, 12 as nz, 12 as ny, 12 as nx
        from {supplier}""",
    # Physical boxes to cut from the tiled masks, output steps of either sign.
    "BX": """
        select c_custkey as box_id, cast(floor(c_custkey / 150) as bigint) as brain,
               cast(c_custkey % 150 as double) * 2e-3 as lo_z, cast(c_custkey % 150 as double) * 2e-3 + 3e-2 as hi_z,
               cast(c_custkey % 7 as double) * 3e-3 as lo_y, cast(c_custkey % 7 as double) * 3e-3 + 3e-2 as hi_y,
               cast(c_custkey % 5 as double) * 3e-3 as lo_x, cast(c_custkey % 5 as double) * 3e-3 + 3e-2 as hi_x,
               case when c_custkey % 2 = 0 then 4e-3 else -4e-3 end as st_z, case when c_custkey % 3 = 0 then -4e-3 else 4e-3 end as st_y,
               4e-3 as st_x
        from {customer}""",
    # Embedding pairs: consecutive vectors are two views of one item.
    "E": """
        select vec_id, case when vec_id % 2 = 0 then 'i' else 'j' end as view_name,
               cast(floor(vec_id / 2) as bigint) as pair_id, cast(floor(vec_id / 100) as bigint) as batch_id, embedding
        from {embeddings}""",
    # Metric stream: one run per user; even runs collapse by construction.
    "T": """
        select event_id as step, ts, user_id as run_id, event_type as metric, cast(day(ts) as int) as epoch,
               case when user_id % 2 = 0 then value * 1e-7 else value * 1e-2 end as loss, value
        from {events}""",
    # Review events of one log.
    "EV": """
        select user_id as patch_id, event_id as seq,
               case cast(floor(value) as int) % 4 when 0 then 'init' when 2 then 'unmark' else 'review' end as kind,
               case event_id % 2 when 0 then 'otsu2' else 'otsu3' end as variant, event_id % 5 = 0 as force,
               case event_id % 3 when 0 then concat('note ', cast(event_id as string)) end as notes
        from {events}""",
    # Review marker files, next to data files and helper scripts.
    "R": """
        select doc_id as patch_id, case when quality = 1 then 'A' else 'view_fullres.sh' end as marker from {labels}
        union all select doc_id, case when toxic = 1 then 'R.txt' else 'rebuild_mask_4um.py' end from {labels}
        union all select doc_id, case when doc_id % 17 = 0 then 'M_wip.txt' when doc_id % 19 = 0 then 'empty'
                                      when doc_id % 41 = 0 then 'A_empty' else 'mask_4um.nii.gz' end from {documents}
        union all select doc_id, 'crop_4um.nii.gz' from {documents}""",
    # Ensemble predictions with truth: one patch of 512 voxels per supplier, up to 5 members.
    "H": """
        select cast(l_suppkey as int) as patch_id, cast(l_partkey % 512 as int) as voxel,
               cast(l_linenumber % 5 as int) as member, max(l_discount * 10) as prob,
               case when ((l_partkey % 512) * 7 + l_suppkey) % 3 = 0 then 1 else 0 end as truth
        from {lineitem} group by 1, 2, 3, 5""",
    # Centroids; each third of a group of 2000 parts is one region.
    "C": """
        select concat('g', cast(cast(floor(p_partkey / 2000) as bigint) as string), '_region', cast(p_partkey % 3 + 1 as string)) as region_tag,
               (p_partkey * 7) % 128 as x, (p_partkey * 11) % 128 as y, (p_partkey * 13) % 64 as z
        from {part}""",
    # Subject volumes with angled variants.
    "F": """
        select concat('/data/ds', cast(c_nationkey % 5 + 1 as string), '/bids/sub-', lpad(cast(cast(floor(c_custkey / 6) as bigint) as string), 6, '0'),
               '/micr/sub-', lpad(cast(cast(floor(c_custkey / 6) as bigint) as string), 6, '0'), '_sample-brain_acq-',
               case c_custkey % 4 when 0 then 'imaris4x' when 1 then '45deg' when 2 then 'imaris4x166' else '90deg' end,
               '_run-', cast(c_custkey as string), '_SPIM.ome.zarr') as path
        from {customer}""",
    # Listing of a data set tree: full-resolution, resampled, atlas and label files.
    "FL": """
        select case k
          when 0 then concat(root, '/bids/', sub, '/micr/', sub, '_acq-', case when s % 5 = 0 then '45deg' else 'imaris4x' end, '_SPIM.ome.zarr')
          when 1 then concat(root, '/bids/', sub, '/micr/', sub, '_acq-90deg_SPIM.ome.zarr')
          when 2 then case when s % 3 = 0 then concat(root, '/bids/', sub, '/micr/', sub, '_notes.json')
                      else concat(root, '/bids/derivatives/resampled/', sub, '/micr/', sub, '_acq-imaris4x_res-4um_SPIM.ome.zarr') end
          when 3 then concat(root, '/derivatives/spimquant_', case when s % 7 = 0 then 'c' else 'b' end, '/', sub, '/micr/', sub, '_seg-roi22_from-ABAv3_level-5_desc-deform_dseg.nii.gz')
          when 4 then concat(root, '/derivatives/spimquant_b/', sub, '/micr/', sub, '_seg-roi22_from-ABAv3_level-5_desc-deform_dseg.', case when s % 2 = 0 then 'tsv' else 'json' end)
          else concat(root, '/bids/derivatives/resampled/', sub, '/micr/', sub, '_acq-45deg_res-4um_SPIM.ome.zarr') end as path
        from (select cast(c_custkey % 6 as int) as k, cast(floor(c_custkey / 6) as bigint) as s,
                     concat('/data/ds', cast(cast(floor(c_custkey / 6) as bigint) % 5 + 1 as string)) as root,
                     concat('sub-', lpad(cast(cast(floor(c_custkey / 6) as bigint) as string), 6, '0')) as sub
              from {customer}) t""",
    # Channel labels of each volume at both resolutions, and the wanted stain.
    "CH": """
        select c_custkey as volume_id,
               case c_custkey % 4 when 0 then 'Abeta' when 1 then 'IBA1' when 2 then 'CD31' else 'Iba1' end as stain,
               case c_custkey % 3 when 0 then '' when 1 then 'autof,ABETA' else 'iba1,autof' end as res_labels,
               case c_custkey % 5 when 0 then 'cd31,abeta' when 1 then 'autof,IBA1' else '' end as full_labels
        from {customer}""",
    # Extracted patch files, raw and mask, in flat directories.
    "PF": """
        select concat('/gt/', case p_size % 2 when 0 then 'raw' else 'mask' end, '/sub-', lpad(cast(cast(floor(p_partkey / 40) as bigint) as string), 4, '0'),
                      '_seg-roi22_label-', upper(substr(p_brand, 1, 5)), '_patch-', lpad(cast(cast(floor(p_partkey / 2) as bigint) % 20 as string), 4, '0'),
                      '_', case p_partkey % 2 when 0 then 'SPIM' else 'mask' end, '.nii.gz') as path
        from {part}""",
    # Gold and crop files of the fine-tune set.
    "GF": """
        select concat('/ft/ds', cast(c_nationkey % 5 + 1 as string), '/sub-', lpad(cast(cast(floor(c_custkey / 30) as bigint) as string), 4, '0'),
                      '/sub-', lpad(cast(cast(floor(c_custkey / 30) as bigint) as string), 4, '0'), '_patch', lpad(cast(cast(floor(c_custkey / 3) as bigint) % 10 as string), 2, '0'),
                      case c_custkey % 3 when 0 then '_crop128.nii.gz' when 1 then case when c_nationkey % 2 = 0 then '_seg_gold.nii.gz' else '_seg_gold_fullres.nii.gz' end
                                    else '_meta.json' end) as path
        from {customer}""",
    # Checkpoint names.
    "K": """
        select concat('ftv4_s', cast(o_custkey as string)) as run_name,
               case when o_orderkey % 11 = 0 then 'last.ckpt'
                    else concat('finetune-epoch', lpad(cast(o_orderkey % 150 as string), 4, '0'), '-dice0.',
                                lpad(cast((o_orderkey * 37) % 10000 as string), 4, '0'), '.ckpt') end as file_name
        from {orders}""",
}


def _names(text):
    return {n for _, n, _, _ in string.Formatter().parse(text) if n}


def load(spark, sf_dir, name):
    """A source table or fixture as a DataFrame."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = FIXTURES[name]
    return spark.sql(text, **{n: load(spark, sf_dir, n) for n in _names(text)})


def _closure(names, seen):
    for n in names:
        if n not in seen and n in FIXTURES:
            _closure(_names(FIXTURES[n]), seen)
            seen.append(n)
    return seen


# Dense view of V, in SQL only: the engine keeps dense data as array rows.
DENSE_SQL = """
    select g.volume_id, g.z, g.y, g.x, coalesce(v.value, 0e0) as value
    from (select volume_id, z, y, x from (select distinct volume_id from V) s,
          (select cast(unnest(range(12)) as int) as z) a, (select cast(unnest(range(12)) as int) as y) b,
          (select cast(unnest(range(12)) as int) as x) c) g
    left join V v on v.volume_id = g.volume_id and v.z = g.z and v.y = g.y and v.x = g.x"""


def oracle(uses, sql):
    """Prefix an SQL text with the fixtures it uses (``D`` is the dense V)."""
    names = uses.split()
    need = _closure(["V" if n == "D" else n for n in names], [])
    ident = {t: t for t in TABLES} | {f: f for f in FIXTURES}
    # Steps that are read more than once are worked out once.
    ctes = [f"{n} as materialized ({FIXTURES[n].format(**ident)})" for n in need]
    if "D" in names:
        ctes.append(f"D as materialized ({DENSE_SQL})")
    body = sql.strip()
    if not ctes:
        return body
    head = "with recursive " if body.lower().startswith("with recursive") else "with "
    if body.lower().startswith("with"):
        body = body[len("with recursive"):] if head == "with recursive " else body[4:]
        return f"{head}{', '.join(ctes)}, {body.strip()}"
    return f"{head}{', '.join(ctes)} {body}"
