"""Review markers, states, summaries and point counts."""

from pyspark.sql import functions as F

from voxframe.functions.scalar import clean_note
from voxframe.operators.ranking import first_by

# Marker file names and what is not a marker.
ACCEPT = ["A", "A.txt"]
REJECT = ["R", "R.txt"]
EMPTY = ["empty"]
EDGE = ["A_empty", "empty_A", "drop_edges_too"]
HELPERS = ["rebuild_mask_4um.py", "seg_nrrd_to_binary_nifti.py", "view_fullres.sh"]
NOTE_FILES = ["A.txt", "R.txt", "M.txt", "M_wip.txt"]
FORCED_TRACK, FORCED_RANGE = "v0.5", (93, 100)


def marker_files(files, name="marker"):
    """Files that are markers: no volumes, no helper scripts."""
    return files.filter(~F.col(name).rlike(r"(\.nii\.gz|\.nrrd)$") & ~F.col(name).isin(*HELPERS))


def forced_reject(track, directory):
    """Index range of one track that is rejected whatever its markers say."""
    index = F.nullif(F.regexp_extract(directory, r"^([0-9]{3})_v05_", 1), F.lit("")).cast("int")
    return F.coalesce((track == FORCED_TRACK) & index.between(*FORCED_RANGE), F.lit(False))


def classify_markers(markers, forced=None, missing=None):
    """Review status of a marker array; the first matching rule wins."""
    has = lambda names: F.arrays_overlap(markers, F.array(*[F.lit(n) for n in names]))
    accept, reject, empty, edge = has(ACCEPT), has(REJECT), has(EMPTY), has(EDGE)
    maybe = F.exists(markers, lambda m: m.startswith("M"))
    status = F.when(missing, "missing") if missing is not None else F
    if forced is not None:
        status = status.when(forced, "reject")
    return (
        status.when(F.size(markers) <= 0, "unreviewed")
        .when(edge, "edge")
        .when(accept & (reject | maybe), "conflict")
        .when(accept, "accept")
        .when(reject, "reject")
        .when(maybe, "maybe")
        .when(empty, "empty")
        .otherwise("unreviewed")
    )


def review_notes(notes, key="patch_id", name="marker", text="text"):
    """The first non-empty note file of each patch, on one line."""
    rank = F.array_position(F.array(*[F.lit(n) for n in NOTE_FILES]), F.col(name))
    usable = notes.filter((rank > 0) & (F.length(text) > 0))
    return first_by(usable, [key], [rank], [clean_note(F.col(text)).alias("note")])


def accepted_manifest(classified, columns):
    """Clean accepts with the columns of the fine-tune set."""
    return classified.filter("status = 'accept'").select(*columns)


def review_tally(classified):
    """Counts per status and per track of the accepts, in one long table."""
    status = classified.groupBy(F.lit("status").alias("kind"), F.col("status").alias("name")).agg(F.count("*").alias("n"))
    track = (
        classified.filter("status = 'accept'")
        .groupBy(F.lit("track").alias("kind"), F.col("track").alias("name"))
        .agg(F.count("*").alias("n"))
    )
    return status.unionByName(track)


def patches_per_subject(accepted, subject="subject_id"):
    """Subjects and the least, median (truncated) and most patches of one."""
    sizes = accepted.groupBy(subject).agg(F.count("*").alias("n"))
    return sizes.agg(
        F.count("*").alias("n_subjects"),
        F.min("n").alias("least"),
        F.floor(F.percentile("n", 0.5)).cast("bigint").alias("middle"),
        F.max("n").alias("most"),
    )


def manifest_summary(df, by, reason="reason"):
    """Written and skipped rows per group, subtotal and total."""
    return df.rollup(*by).agg(
        F.count_if(F.col(reason).isNull()).alias("written"), F.count_if(F.col(reason).isNotNull()).alias("skipped")
    )


def review_status(patches, state, gold, key="patch_id"):
    """Per patch: initialised, reviewed, seed variant, gold voxels, notes."""
    return (
        patches.join(gold.groupBy(key).agg(F.count("*").alias("gold_voxels")), key, "left")
        .join(state, key, "left")
        .select(
            *patches.columns,
            "gold_voxels",
            F.col("gold_voxels").isNotNull().alias("initialized"),
            F.coalesce("reviewed", F.lit(False)).alias("reviewed"),
            F.coalesce("init_variant", F.lit("-")).alias("init_variant"),
            F.coalesce("review_notes", F.lit("")).alias("review_notes"),
        )
    )


def review_totals(status):
    return status.agg(
        F.count("*").alias("total"),
        F.count_if("initialized").alias("initialized"),
        F.count_if("reviewed").alias("reviewed"),
        F.count_if(~F.col("reviewed")).alias("remaining"),
    )


def apply_review_events(events, key="patch_id", order="seq"):
    """Final review state from an ordered event log.

    Events: ``init`` (variant; with force it resets the review; without force
    only the first init of a patch counts), ``review`` (notes kept if the event
    has none) and ``unmark`` (drops review and notes). Each field is the value
    of its latest relevant event, so one combinable aggregate is enough.
    """
    k, t = F.col("kind"), F.col(order)
    latest = lambda value, when: F.max_by(F.when(when, value), F.when(when, t))
    sets_review = k.isin("review", "unmark") | ((k == "init") & F.col("force"))
    forced_init = (k == "init") & F.col("force")
    touches_notes = (k == "unmark") | ((k == "review") & F.col("notes").isNotNull())
    first_init = F.min_by(F.when(k == "init", F.col("variant")), F.when(k == "init", t))
    return events.groupBy(key).agg(
        F.coalesce(latest(F.col("variant"), forced_init), first_init).alias("init_variant"),
        F.max(k == "init").alias("initialized"),
        F.coalesce(latest(k == "review", sets_review), F.lit(False)).alias("reviewed"),
        latest(F.when(k == "review", F.col("notes")), touches_notes).alias("review_notes"),
    )


# --- points in boxes ------------------------------------------------------


def points_per_box(hits, box, region="region_tag"):
    """Points per (box, region) and the box total."""
    per = hits.groupBy(*box, region).agg(F.count("*").alias("n"))
    total = hits.groupBy(*box).agg(F.count("*").alias("total"))
    return per.join(total, list(box))


def top_box_per_region(counts, box, extra=1, region="region_tag"):
    """The fullest box of each region, then the best of the rest by total.

    Ties go to the smaller box id. ``box`` is one id column.
    """
    top = first_by(counts, [region], [-F.col("n"), box], [box, "n", "total"]).withColumn("pick", F.lit("region"))
    rest = (
        counts.join(top.select(box).distinct(), box, "left_anti")
        .groupBy(box)
        .agg(F.max("total").alias("total"))
        .orderBy(F.desc("total"), box)
        .limit(extra)
        .select(F.lit(None).cast("string").alias(region), box, F.col("total").alias("n"), "total", F.lit("extra").alias("pick"))
    )
    return top.unionByName(rest)


def best_slice(hits, box, radius):
    """Slice of each box with most points within ``radius`` slices; first on ties.

    A box without points has no row here; its first slice is the fallback.
    """
    spread = hits.withColumn(
        "slice",
        F.explode(
            F.sequence(F.greatest(F.col("z") - radius, F.col("z0")), F.least(F.col("z") + radius, F.col("z1") - 1))
        ),
    )
    counts = spread.groupBy(*box, "slice").agg(F.count("*").alias("n"))
    return first_by(counts, box, [-F.col("n"), "slice"], ["slice", "n"])
