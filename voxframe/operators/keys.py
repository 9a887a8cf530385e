"""Projections, preferences and key derivation over listings and manifests."""

from pyspark.sql import functions as F

from voxframe.functions.scalar import file_name
from voxframe.operators.ranking import first_by, row_numbers, with_group_agg

# Fixed values, case sensitive: channel of a stain when no label matches.
STAIN_CHANNELS = {"IBA1": 0, "Abeta": 1, "CD31": 2}

# Acquisitions at an angle.
ANGLED = "45deg|90deg"


def prefer_standard(df, by, name="path"):
    """Drop angled acquisitions from groups that have a straight one."""
    standard = ~file_name(F.col(name)).rlike(ANGLED)
    marked = df.withColumn("_std", standard)
    return (
        with_group_agg(marked, by, F.max("_std").alias("_has"))
        .filter(F.col("_std") | ~F.col("_has"))
        .select(*df.columns)
    )


def prefer_plain_acq(df, by, name="path"):
    """One path per group: plain 4x acquisition first, then name order."""
    plain = F.when(file_name(F.col(name)).contains("_acq-imaris4x_"), 0).otherwise(1)
    return first_by(df, by, [plain, name], [name])


def resolve_preferred(df, prefs, by, name):
    """First existing entry of an ordered preference list, else name order.

    ``prefs``: (*by, name, rank), a small table.
    """
    ranked = df.join(prefs, [*by, name], "left")
    order = [F.coalesce(F.col("rank"), F.lit(1000000000)), name]
    return first_by(ranked, by, order, [name])


def resolve_channel(df, stain, labels, fallback=STAIN_CHANNELS):
    """Channel index of a stain.

    Case-insensitive label match in each of ``labels`` in turn, then a
    case-sensitive fallback by stain, then 0.
    """
    lowered = F.lower(F.col(stain))
    matches = []
    for c in labels:
        at = F.array_position(F.transform(F.col(c), lambda v: F.lower(v)), lowered)
        matches.append(F.when(at > 0, at.cast("int") - 1))
    table = F.create_map(*[F.lit(v) for kv in fallback.items() for v in kv])
    return df.withColumn(
        "channel", F.coalesce(*matches, F.try_element_at(table, F.col(stain)), F.lit(0))
    )


def split_reference_subjects(patches, refs, on=("dataset", "subject_id")):
    """(disease rows, reference rows)."""
    keys = refs.select(*on).distinct()
    return patches.join(keys, list(on), "left_anti"), patches.join(keys, list(on), "left_semi")


def filter_scope(df, id_col, subjects=None, datasets=None, ids=None, limit=None, order=None):
    """Restrict a manifest; an id that matches nothing is an error."""
    if subjects is not None:
        df = df.filter(F.col("subject_id").isin(*subjects))
    if datasets is not None:
        df = df.filter(F.col("dataset").isin(*datasets))
    if ids is not None:
        df = df.filter(F.col(id_col).isin(*ids))
        # at most len(ids) distinct values come back
        found = {r[0] for r in df.select(id_col).distinct().limit(len(ids)).collect()}
        missing = [i for i in ids if i not in found]
        if missing:
            raise ValueError(f"no patch matches {missing}")
    if limit is not None:
        df = df.orderBy(*(order or [id_col])).limit(limit)
    return df


def alias_dataset(df, overrides, name="dataset"):
    """Replace data set names that differ from their directory."""
    table = F.create_map(*[F.lit(v) for kv in overrides.items() for v in kv])
    return df.withColumn(name, F.coalesce(F.try_element_at(table, F.col(name)), F.col(name)))


# Name pattern of an extracted patch.
PATCH_NAME = r"^(sub-[^_]+)_seg-roi22_label-([A-Z0-9_]+)_patch-(\d+)_(SPIM|mask)\.nii(?:\.gz)?$"


def parse_patch_name(files):
    """Raw patches with a mask of the same stem, with the parsed entities."""
    name = file_name(F.col("path"))
    parsed = files.select(
        F.regexp_extract(name, PATCH_NAME, 1).alias("subject_id"),
        F.regexp_extract(name, PATCH_NAME, 2).alias("label"),
        F.regexp_extract(name, PATCH_NAME, 3).alias("idx"),
        F.regexp_extract(name, PATCH_NAME, 4).alias("role"),
        "path",
    ).filter("role <> ''")
    stem = ["subject_id", "label", "idx"]
    raw = parsed.filter("role = 'SPIM'").select(*stem, F.col("path").alias("raw_path"))
    masks = parsed.filter("role = 'mask'").groupBy(*stem).agg(F.min("path").alias("mask_path"))
    return raw.join(masks, stem).withColumn("patch_idx", F.col("idx").cast("int")).drop("idx")


def patch_key(path):
    """(patch id, patch number) of a patch file; -1 without a number."""
    name = file_name(path)
    number = F.try_to_number(F.nullif(F.regexp_extract(name, r"_patch(\d+)", 1), F.lit("")), F.lit("999999999"))
    return (
        F.regexp_replace(F.regexp_replace(name, "_crop.*$", ""), r"\..*$", "").alias("patch_id"),
        F.coalesce(number.cast("int"), F.lit(-1)).alias("patch_num"),
    )


def assign_patch_ids(df, by, subject, rank, ties):
    """``{group}_{n:03d}_{subject}`` with n counted over the given rows."""
    numbered = row_numbers(df, [by], rank, ties, "_n")
    return numbered.withColumn(
        "patch_id", F.format_string("%s_%03d_%s", F.col(by), F.col("_n") + 1, F.col(subject))
    ).drop("_n")


def drop_dark_patches(patches, minimum=50.0):
    """Keep dense patches whose brightest voxel reaches ``minimum``."""
    return patches.filter(F.array_max("data") >= minimum)


def best_checkpoint(files, by="run_name", name="file_name"):
    """Checkpoint with the highest score in its name; no score counts as -1."""
    files = files.filter(F.col(name).rlike(r"^finetune-epoch.*\.ckpt$"))
    score = F.regexp_extract(name, r"dice([0-9.]+)[.]ckpt$", 1)
    value = F.when(score == "", F.lit(-1.0)).otherwise(score.try_cast("double"))
    best = F.max(F.struct(F.coalesce(value, F.lit(-1.0)).alias("dice"), F.col(name)))
    return files.groupBy(by).agg(best.alias("b")).select(by, "b.dice", F.col(f"b.{name}"))


def region_mask(label_voxels, labels):
    """Voxels whose label is in ``labels`` (a list or a table); 0 is background."""
    voxels = label_voxels.filter("label <> 0")
    if isinstance(labels, (list, tuple)):
        return voxels.filter(F.col("label").isin(*labels))
    return voxels.join(labels.select("label"), "label", "left_semi")
