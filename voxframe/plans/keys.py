"""Queries over listings and manifests: preferences, keys, quotas, samples."""

from pyspark.sql import functions as F

from voxframe.functions.scalar import file_name, hash_rank
from voxframe.operators import dense, keys, sampling
from voxframe.plans.registry import query

SUBJECT_DIR = "regexp_extract(path, '^(.*)/[^/]*$', 1)"


def sql_rank(seed, *parts):
    text = ", ".join([f"'{seed}'", *[f"cast({p} as varchar)" for p in parts]])
    return f"cast('0x' || substr(md5(concat_ws('|', {text})), 1, 8) as bigint)"


def _dirs(df):
    return df.withColumn("dir", F.regexp_extract("path", "^(.*)/[^/]*$", 1))


@query("prefer_standard", "F", f"""
    with d as (select {SUBJECT_DIR} as dir, path, not regexp_matches(path, '45deg|90deg') as std from F)
    select dir, path from d
    where std or not exists (select 1 from d e where e.dir = d.dir and e.std)""")
def prefer_standard(s):
    return keys.prefer_standard(_dirs(s.F), ["dir"])


@query("prefer_plain_acq", "F", f"""
    select dir, path from (
      select *, row_number() over (partition by dir order by (case when contains(path, '_acq-imaris4x_') then 0 else 1 end), path) as rn
      from (select {SUBJECT_DIR} as dir, path from F)) where rn = 1""")
def prefer_plain_acq(s):
    return keys.prefer_plain_acq(_dirs(s.F), ["dir"])


@query("resolve_preferred", "FL", """
    select root, deriv from (
      select root, deriv, row_number() over (partition by root order by
               (case when root = '/data/ds1' and deriv = 'spimquant_c' then 0 when root = '/data/ds2' and deriv = 'spimquant_z' then 0 else 1000000000 end), deriv) as rn
      from (select distinct regexp_extract(path, '^(.*)/derivatives/', 1) as root, regexp_extract(path, '/derivatives/(spimquant[^/]*)/', 1) as deriv from FL)
      where deriv <> '') where rn = 1""")
def resolve_preferred(s):
    spark = s.spark
    found = s.FL.select(
        F.regexp_extract("path", "^(.*)/derivatives/", 1).alias("root"),
        F.regexp_extract("path", "/derivatives/(spimquant[^/]*)/", 1).alias("deriv"),
    ).filter("deriv <> ''").distinct()
    prefs = spark.createDataFrame(
        [("/data/ds1", "spimquant_c", 0), ("/data/ds2", "spimquant_z", 0)], "root string, deriv string, rank int"
    )
    return keys.resolve_preferred(found, prefs, ["root"], "deriv")


@query("resolve_channel", "CH", """
    select volume_id, stain, cast(coalesce(
        nullif(coalesce(list_position(string_split(lower(res_labels), ','), lower(stain)), 0), 0) - 1,
        nullif(coalesce(list_position(string_split(lower(full_labels), ','), lower(stain)), 0), 0) - 1,
        case stain when 'IBA1' then 0 when 'Abeta' then 1 when 'CD31' then 2 end, 0) as int) as channel
    from CH""")
def resolve_channel(s):
    df = s.CH.select("volume_id", "stain", F.split("res_labels", ",").alias("r"), F.split("full_labels", ",").alias("f"))
    return keys.resolve_channel(df, "stain", ["r", "f"]).select("volume_id", "stain", "channel")


@query("split_reference_subjects", "P RS", """
    select p.patch_no, p.dataset, p.subject_id, case when r.subject_id is null then 'disease' else 'reference' end as role
    from P p left join RS r on p.dataset = r.dataset and p.subject_id = r.subject_id""")
def split_reference_subjects(s):
    disease, reference = keys.split_reference_subjects(s.P, s.RS)
    cols = ["patch_no", "dataset", "subject_id"]
    return disease.select(*cols, F.lit("disease").alias("role")).unionByName(
        reference.select(*cols, F.lit("reference").alias("role"))
    )


@query("filter_scope", "P", """
    select patch_no, dataset, subject_id from P where dataset in ('ds1', 'ds3')
    order by dataset, patch_no limit 500""")
def filter_scope(s):
    return keys.filter_scope(s.P, "patch_no", datasets=["ds1", "ds3"], limit=500, order=["dataset", "patch_no"]).select(
        "patch_no", "dataset", "subject_id"
    )


@query("alias_dataset", "P", """
    select patch_no, case dataset when 'ds1' then 'ds1_batch1' else dataset end as dataset from P""")
def alias_dataset(s):
    return keys.alias_dataset(s.P, {"ds1": "ds1_batch1"}).select("patch_no", "dataset")


PATCH_RE = "'(sub-[^_/]+)_seg-roi22_label-([A-Z0-9_]+)_patch-([0-9]+)_(SPIM|mask)[.]nii'"


@query("parse_patch_name", "PF", f"""
    with p as (select distinct path, regexp_extract(path, {PATCH_RE}, 1) as subject_id, regexp_extract(path, {PATCH_RE}, 2) as label,
                      regexp_extract(path, {PATCH_RE}, 3) as idx, regexp_extract(path, {PATCH_RE}, 4) as role from PF)
    select r.subject_id, r.label, cast(r.idx as int) as patch_idx, r.path as raw_path, min(m.path) as mask_path
    from p r join p m on r.subject_id = m.subject_id and r.label = m.label and r.idx = m.idx
    where r.role = 'SPIM' and m.role = 'mask' group by 1, 2, 3, 4""")
def parse_patch_name(s):
    return keys.parse_patch_name(s.PF.distinct())


@query("patch_key", "GF", """
    select path, regexp_replace(regexp_replace(regexp_extract(path, '([^/]*)$', 1), '_crop.*$', ''), '[.].*$', '') as patch_id,
           coalesce(try_cast(nullif(regexp_extract(path, '_patch([0-9]+)[^/]*$', 1), '') as int), -1) as patch_num
    from GF""")
def patch_key(s):
    return s.GF.select("path", *keys.patch_key(F.col("path")))


@query("assign_patch_ids", "P", f"""
    select patch_no, printf('%s_%03d_%s', dataset, row_number() over (partition by dataset order by {sql_rank(11, 'patch_no')}, patch_no), subject_id) as patch_id
    from P""")
def assign_patch_ids(s):
    return keys.assign_patch_ids(s.P, "dataset", "subject_id", hash_rank(11, "patch_no"), ["patch_no"]).select(
        "patch_no", "patch_id"
    )


@query("drop_dark_patches", "V", "select volume_id from V group by 1 having max(value) >= 50")
def drop_dark_patches(s):
    return keys.drop_dark_patches(dense.to_patches(s.V, ["volume_id"], (12, 12, 12))).select("volume_id")


@query("best_checkpoint", "K", """
    with named as (select run_name, file_name, coalesce(try_cast(regexp_extract(file_name, 'dice([0-9.]+)[.]ckpt', 1) as double), -1e0) as dice
               from K where starts_with(file_name, 'finetune-epoch'))
    select run_name, dice, file_name from (
      select *, row_number() over (partition by run_name order by dice desc, file_name desc) as rn from named) where rn = 1""")
def best_checkpoint(s):
    return keys.best_checkpoint(s.K)


# A label for every voxel of V: 0 is background.
LV = "select volume_id, z, y, x, cast((z * 5 + y * 3 + x) % 26 as int) as label from V"


def label_voxels(s):
    return s.V.selectExpr("volume_id", "z", "y", "x", "cast((z * 5 + y * 3 + x) % 26 as int) as label")


@query("region_mask", "V L", f"""
    select v.* from ({LV}) v where label <> 0 and label in (select label from L where group_pos = 2)""")
def region_mask(s):
    return keys.region_mask(label_voxels(s), s.L.filter("group_pos = 2"))


# --- quotas and samples ---------------------------------------------------

QUOTA = """
    select pos, name, cast(case when pos = (select max(pos) from G) then N - coalesce(sum(share) over (order by pos rows between unbounded preceding and 1 preceding), 0)
           else share end as bigint) as quota
    from (select pos, name, cast(round_even(N * weight / (select sum(weight) from G), 0) as bigint) as share from G)"""


def n_patches(s):
    return s.supplier.count() * 7 + 3


def quota_sql(mult=7, add=3):
    return QUOTA.replace("N ", f"((select count(*) from supplier) * {mult} + {add}) ")


@query("allocate_quota", "G", quota_sql())
def allocate_quota(s):
    return sampling.allocate_quota(s.G, n_patches(s)).select("pos", "name", "quota")


EVEN = f"""
    with q as ({quota_sql()}), n as (select count(*) as c from S)
    select * from (select s.subject_id, q.name as group_name,
      cast(floor(q.quota / n.c) + case when s.pos < q.quota % n.c then 1 else 0 end as bigint) as n
      from q, S s, n) where n > 0"""


@query("spread_even", "G S", EVEN)
def spread_even(s):
    quotas = sampling.allocate_quota(s.G, n_patches(s)).select("pos", "name", "quota")
    return sampling.spread_even(quotas, s.S.select("pos", "subject_id")).select("subject_id", "group_name", "n")


@query("spread_round_robin", "G S", f"""
    with q as ({quota_sql()}), n as (select count(*) as c from S),
    slots as (select q.name as group_name, s.subject_id, row_number() over (partition by q.name order by {sql_rank(5, 'q.name', 's.subject_id')}, s.subject_id) - 1 as slot from q, S s),
    deals as (select name as group_name, unnest(range(quota)) as i from q where quota > 0)
    select d.group_name, d.i, t.subject_id, row_number() over (order by {sql_rank('5-deal', 'd.group_name', 'd.i')}, d.group_name, d.i) - 1 as pos
    from deals d, n, slots t where t.group_name = d.group_name and t.slot = d.i % n.c""")
def spread_round_robin(s):
    quotas = sampling.allocate_quota(s.G, n_patches(s)).select("pos", "name", "quota")
    return sampling.spread_round_robin(quotas, s.S.select("subject_id"), 5)


@query("sample_region_centers", "V L G", f"""
    with lg as (select l.label, g.name as group_name, cast(g.pos * g.pos + 3 as bigint) as n from L l join G g on l.group_pos = g.pos)
    select volume_id, group_name, z, y, x, round(z * 4e-3, 6) as mm_z, round(y * 4e-3, 6) as mm_y, round(x * 4e-3, 6) as mm_x
    from (select v.*, lg.group_name, lg.n, row_number() over (partition by volume_id, group_name order by {sql_rank(7, 'volume_id', 'z', 'y', 'x')}, z, y, x) as rn
          from ({LV}) v join lg on v.label = lg.label) where rn <= n""")
def sample_region_centers(s):
    groups = s.G.select(F.col("pos").alias("group_pos"), F.col("name").alias("group_name"), (F.col("pos") * F.col("pos") + 3).cast("bigint").alias("n"))
    labels = s.L.select("label", "group_pos").join(groups.select("group_pos", "group_name"), "group_pos").drop("group_pos")
    picked = sampling.sample_region_centers(label_voxels(s), labels, groups.select("group_name", "n"), 7)
    return picked.select("volume_id", "group_name", "z", "y", "x", *[F.round(F.col(a) * 4e-3, 6).alias(f"mm_{a}") for a in "zyx"])


@query("sample_n", "P", f"select patch_no, subject_id from P order by {sql_rank(9, 'patch_no')}, patch_no limit 1000")
def sample_n(s):
    return sampling.sample_n(s.P, 1000, 9, "patch_no").select("patch_no", "subject_id")


@query("sample_per_group", "P", f"""
    select label, patch_no from (select label, patch_no, row_number() over (partition by label order by {sql_rank(3, 'label', 'patch_no')}, patch_no) as rn from P)
    where rn <= 10""")
def sample_per_group(s):
    return sampling.sample_per_group(s.P, "label", 10, 3, "patch_no", strict=True).select("label", "patch_no")


@query("seeded_shuffle", "P", f"select patch_no, row_number() over (order by {sql_rank(42, 'patch_no')}, patch_no) - 1 as pos from P")
def seeded_shuffle(s):
    return sampling.seeded_shuffle(s.P, 42, "patch_no").select("patch_no", "pos")


@query("group_split", "P", f"""
    with g as (select subject_id, row_number() over (order by {sql_rank(1, 'subject_id')}, subject_id) - 1 as r from (select distinct subject_id from P)),
    n as (select greatest(1, round_even(count(*) * 2e-1, 0)) as k from g)
    select p.patch_no, p.subject_id, case when g.r < n.k then 'val' else 'train' end as split
    from P p join g on p.subject_id = g.subject_id, n""")
def group_split(s):
    return sampling.group_split(s.P, "subject_id", 0.2, 1).select("patch_no", "subject_id", "split")


@query("repeat_rows", "P", "select patch_no, cast(unnest(range(1, 4)) as int) as copy from P")
def repeat_rows(s):
    return sampling.repeat_rows(s.P, 3).select("patch_no", "copy")


def _u(seed, *parts):
    return f"({sql_rank(seed, *parts)} / 4294967296e0)"


def _pair_sql():
    first = ", ".join(
        f"cast(0 + floor({_u(f'21-a{a}', 'volume_id')} * (dim_{a} - 128 - 0 + 1)) as bigint) as {a}1" for a in "zyx"
    )
    second = ", ".join(
        f"cast(greatest(0, {a}1 - 64) + floor({_u(f'21-b{a}', 'volume_id')} * (least(dim_{a} - 128, {a}1 + 64) - greatest(0, {a}1 - 64) + 1)) as bigint) as {a}2"
        for a in "zyx"
    )
    return f"select volume_id, z1, y1, x1, {second} from (select *, {first} from B)"


@query("crop_pairs", "B", _pair_sql())
def crop_pairs(s):
    return sampling.crop_pairs(s.B, "volume_id", 128, 0.5, 21).select("volume_id", "z1", "y1", "x1", "z2", "y2", "x2")


@query("plan_batches", "P", f"""
    with o as (select patch_no, row_number() over (order by {sql_rank(8, 'patch_no')}, patch_no) - 1 as pos from P)
    select patch_no, cast(floor(pos / 64) as bigint) as batch from o where floor(pos / 64) < (select floor(count(*) / 64) from P)""")
def plan_batches(s):
    return sampling.plan_batches(s.P, 64, 8, "patch_no").select("patch_no", "batch")


@query("substitute_failed", "P", f"""
    with pf as (select patch_no, pz, (label = 4) as failed from P), n as (select count(*) as c from P),
    d as (select pf.*, case when failed then cast(floor({_u(6, 'patch_no')} * n.c) as bigint) else patch_no end as source_pos from pf, n)
    select d.patch_no, d.source_pos, case when not d.failed then d.pz when e.failed then 0e0 else e.pz end as pz
    from d join pf e on d.source_pos = e.patch_no""")
def substitute_failed(s):
    df = s.P.selectExpr("patch_no", "pz", "label = 4 as failed")
    return sampling.substitute_failed(df, "patch_no", "failed", 6, "pz").select("patch_no", "source_pos", "pz")
