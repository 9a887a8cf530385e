"""Joins of boxes, points, tiles, markers and manifests.

Every interval predicate gets an equi key first (the grid cell), so Spark can
hash or sort the sides and no nested loop over voxels can occur.
"""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxframe.functions.scalar import col
from voxframe.operators import kernels
from voxframe.session import spread

AXES = "zyx"


def _cells(lo, hi, edge):
    """Grid cells a half-open interval touches."""
    return F.sequence(F.floor(lo / edge).cast("int"), F.floor((hi - 1) / edge).cast("int"))


def extract_windows(boxes, chunks, keys, edge, patch_key="patch_id"):
    """Cut one dense row per box out of chunked volumes.

    ``boxes``: (patch_key, *keys, z0, z1, y0, y1, x0, x1), half open; cells
    outside the volume or in absent chunks are 0. ``chunks`` come from
    ``dense.to_chunks`` with the same ``edge``. The join is on the chunk key; a
    chunk is cut to the box before it moves on, as one array.
    """
    # A box is a few bytes and its chunks many: a small file must not stay one task.
    touched = boxes.repartition(spread(boxes.sparkSession), patch_key)
    for a in AXES:
        touched = touched.withColumn(f"c{a}", F.explode(_cells(F.col(f"{a}0"), F.col(f"{a}1"), edge)))
    chunk_key = [*keys, "cz", "cy", "cx"]
    joined = touched.join(chunks.select(*chunk_key, "data"), chunk_key, "left")
    # the part of the box in this chunk, relative to the box and to the chunk
    for a in AXES:
        lo = F.greatest(F.col(f"{a}0"), F.col(f"c{a}") * edge)
        hi = F.least(F.col(f"{a}1"), (F.col(f"c{a}") + 1) * edge)
        joined = joined.withColumns(
            {
                f"_box_{a}": (lo - F.col(f"{a}0")).cast("int"),
                f"_chunk_{a}": (lo - F.col(f"c{a}") * edge).cast("int"),
                f"_n_{a}": (hi - lo).cast("int"),
            }
        )

    place = F.array(*[F.col(f"_{name}_{a}") for name in ("box", "n") for a in AXES])
    corner = [F.col(f"_chunk_{a}") for a in AXES]
    part = kernels.cut(F.col("data"), corner, [F.col(f"_n_{a}") for a in AXES], edge)
    piece = F.when(F.col("data").isNotNull(), F.struct(place.alias("place"), part.alias("p")))
    size = {f"d{a}": (F.col(f"{a}1") - F.col(f"{a}0")).cast("int") for a in AXES}
    pieces = joined.select(patch_key, *[v.alias(k) for k, v in size.items()], piece.alias("_p"))
    # A window is bounded by its own shape, so its collected pieces are too;
    # absent chunks are null and leave zeros. Pieces move as they are, because a
    # task has one or two of a window before.
    grouped = pieces.repartition(patch_key).groupBy(patch_key, "dz", "dy", "dx").agg(F.collect_list("_p").alias("_p"))
    data = kernels.assemble(F.col("_p"), F.col("dz"), F.col("dy"), F.col("dx"))
    return kernels.pin(grouped, "_p").select(patch_key, "dz", "dy", "dx", data.alias("data"))


def points_in_boxes(points, boxes, cell, keys=()):
    """(point, box) rows with the point inside the half-open box.

    A point has one cell; a box lists the cells it touches.
    """
    p = points.withColumns({f"_c{a}": F.floor(F.col(a) / cell).cast("int") for a in AXES})
    b = boxes
    for a in AXES:
        b = b.withColumn(f"_c{a}", F.explode(_cells(F.col(f"{a}0"), F.col(f"{a}1"), cell)))
    inside = F.lit(True)
    for a in AXES:
        inside = inside & (F.col(a) >= F.col(f"{a}0")) & (F.col(a) < F.col(f"{a}1"))
    return p.join(b, [*keys, "_cz", "_cy", "_cx"]).filter(inside).drop("_cz", "_cy", "_cx")


def assemble_tiles(tiles, voxels, boxes, cell_mm, keys=()):
    """Paste the tiles that overlap a physical box into one mask per box.

    ``tiles``: (tile_id, *keys, o{a} origin mm, s{a} signed voxel step mm,
    n{a} voxels); ``voxels``: positive tile voxels (tile_id, z, y, x);
    ``boxes``: (box_id, *keys, lo_{a}, hi_{a} in mm, st_{a} signed output step).
    Returns (box_id, z, y, x, n_tiles); overlaps combine with OR. A negative
    output step counts from the upper side of the box.
    """
    t, b = tiles, boxes
    for a in AXES:
        end = F.col(f"o{a}") + F.col(f"s{a}") * F.col(f"n{a}")
        t = t.withColumns({f"tl_{a}": F.least(F.col(f"o{a}"), end), f"th_{a}": F.greatest(F.col(f"o{a}"), end)})
    for a in AXES:
        t = t.withColumn(f"_c{a}", F.explode(_mm_cells(F.col(f"tl_{a}"), F.col(f"th_{a}"), cell_mm)))
        b = b.withColumn(f"_c{a}", F.explode(_mm_cells(F.col(f"lo_{a}"), F.col(f"hi_{a}"), cell_mm)))
    overlap = F.lit(True)
    first = F.lit(True)
    for a in AXES:
        lo = F.greatest(F.col(f"lo_{a}"), F.col(f"tl_{a}"))
        hi = F.least(F.col(f"hi_{a}"), F.col(f"th_{a}"))
        overlap = overlap & (hi > lo + 1e-9)
        # a pair meets in every shared cell; keep it in the first one only
        first = first & (F.col(f"_c{a}") == F.floor(lo / cell_mm).cast("int"))
    pairs = t.join(b, [*keys, "_cz", "_cy", "_cx"]).filter(overlap & first).drop("_cz", "_cy", "_cx")
    pairs = pairs.drop(*[k for k in keys])
    # A voxel goes where its centre falls, counted from the box side at which
    # the output axis starts; the join carries the line from index to index.
    lines = {}
    for a in AXES:
        st = F.col(f"st_{a}")
        start = F.when(st > 0, F.col(f"lo_{a}")).otherwise(F.col(f"hi_{a}"))
        lines |= {
            f"_o{a}": F.col(f"o{a}"),
            f"_s{a}": F.col(f"s{a}"),
            f"_start_{a}": start,
            f"_st_{a}": st,
            f"_n_{a}": F.ceil((F.col(f"hi_{a}") - F.col(f"lo_{a}")) / F.abs(st)).cast("int"),
        }
    pasted = pairs.select("tile_id", "box_id", *[v.alias(k) for k, v in lines.items()]).join(voxels, "tile_id")
    index = {}
    for a in AXES:
        centre = F.col(f"_o{a}") + F.col(f"_s{a}") * (F.col(a) + 0.5)
        index[a] = F.floor((centre - F.col(f"_start_{a}")) / F.col(f"_st_{a}")).cast("int")
    pasted = pasted.withColumns({f"_{a}": v for a, v in index.items()})
    for a in AXES:
        pasted = pasted.filter((F.col(f"_{a}") >= 0) & (F.col(f"_{a}") < F.col(f"_n_{a}")))
    counts = pairs.groupBy("box_id").agg(F.count("*").alias("n_tiles"))
    out = pasted.select("box_id", *[F.col(f"_{a}").alias(a) for a in AXES]).distinct()
    return out.join(counts, "box_id")


def _mm_cells(lo, hi, cell):
    return F.sequence(F.floor(lo / cell).cast("int"), F.floor(hi / cell).cast("int"))


def join_markers(patches, markers, key="patch_id", name="marker"):
    """Marker names of each patch as a sorted array; ``missing`` without a directory."""
    grouped = markers.groupBy(key).agg(F.sort_array(F.collect_set(name)).alias("markers"))
    return patches.join(grouped, key, "left").withColumn("missing", F.col("markers").isNull())


def label_at_center(patches, label_voxels, labels, keys=("volume_id",), dims=("dim_z", "dim_y", "dim_x")):
    """Region name at each patch centre, ``label=<n>`` if the table lacks it.

    The centre index is clamped into the volume; background is label 0.
    """
    at = patches
    for a, d in zip(AXES, dims):
        at = at.withColumn(a, F.greatest(F.lit(0), F.least(F.col(f"c{a}"), F.col(d) - 1)).cast("int"))
    found = at.join(label_voxels.select(*keys, *AXES, "label"), [*keys, *AXES], "left").withColumn(
        "label", F.coalesce("label", F.lit(0))
    )
    return found.join(labels.select("label", "name"), "label", "left").withColumn(
        "name", F.coalesce("name", F.format_string("label=%d", "label"))
    )


def union_first_wins(first, second, key):
    """All of ``first``, then rows of ``second`` with a new key."""
    fresh = second.join(first.select(*key), list(key), "left_anti")
    return first.unionByName(fresh, allowMissingColumns=True)


def suffix_match(stale, dirs, name="name", directory="dir"):
    """Find renamed directories: the first one that ends with the old name.

    The equi key is the end of a directory, once for every length that an old
    name has; a file system bounds those lengths.
    """
    lengths = stale.agg(F.collect_set(F.length(name))).scalar()
    # Names are few bytes and their ends many: a small file must not stay one task.
    dealt = dirs.repartition(spread(dirs.sparkSession), directory)
    sized = dealt.withColumn("_lengths", lengths)
    keyed = sized.withColumn("_n", F.explode("_lengths")).filter(F.col("_n") <= F.length(directory)).drop("_lengths")
    keyed = keyed.withColumn("_key", F.right(F.col(directory), F.col("_n")))
    best = keyed.groupBy("_key").agg(F.min(directory).alias("resolved"))
    return stale.join(best, F.col(name) == F.col("_key"), "left").drop("_key").withColumn(
        "missing", F.col("resolved").isNull()
    )


def upsert(existing, new, key):
    """Rows of ``new`` replace rows of ``existing`` with the same key."""
    return existing.join(new.select(*key), list(key), "left_anti").unionByName(new, allowMissingColumns=True)


def pending(todo, done, key, force=False):
    """Work whose output does not exist yet."""
    return todo if force else todo.join(done.select(*key), list(key), "left_anti")


def attach_references(patches, refs, on="dataset", salts=64):
    """One row per (patch, reference); a data set without references takes all.

    Pairs come from an equi join on (pooled, data set, salt): patches are dealt
    over the salts and references repeated for each, so a data set that holds a
    third of the patches is spread, and no list of references sits in a row.
    """
    known = refs.select(F.col(on).alias("ref_dataset"), F.col("subject_id").alias("ref_subject")).distinct()
    has = known.select(F.col("ref_dataset").alias(on)).distinct().withColumn("_own", F.lit(True))
    keyed = (
        patches.join(has, on, "left")
        .withColumn("pooled", F.col("_own").isNull())
        .withColumn("_key", F.when(F.col("_own"), F.col(on)))
        .withColumn("_salt", F.pmod(F.xxhash64(*patches.columns), F.lit(salts)))
    )
    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("_salt")
    own = known.select("*", F.lit(False).alias("pooled"), F.col("ref_dataset").alias("_key"), copies)
    pool = known.select("*", F.lit(True).alias("pooled"), F.lit(None).cast("string").alias("_key"), copies)
    # Null keys meet under a name of their own kind, so the join stays an equi join.
    blank = lambda df: df.withColumn("_key", F.coalesce(F.col("_key").cast("string"), F.lit("")))
    # Small tables make many pairs: both sides are dealt before their rows multiply.
    key = ["pooled", "_key", "_salt"]
    deal = lambda df: blank(df).repartition(spread(patches.sparkSession), *key)
    return deal(keyed).join(deal(own.union(pool)), key).select(
        *patches.columns, "pooled", "ref_dataset", "ref_subject"
    )


def pair_siblings(files, left, right, aliases=None, path="path"):
    """Pair files of one patch by stem, e.g. crops with gold masks.

    ``left`` and ``right`` are suffix patterns; ``aliases`` maps odd stems.
    """
    name = F.col(path)
    stem = F.regexp_replace(name, f"({left}|{right})$", "")
    if aliases:
        table = F.create_map(*[F.lit(v) for kv in aliases.items() for v in kv])
        stem = F.coalesce(F.try_element_at(table, stem), stem)
    keyed = files.withColumn("stem", stem)
    a = keyed.filter(name.rlike(f"{left}$")).select("stem", F.col(path).alias("left_path"))
    b = keyed.filter(name.rlike(f"{right}$")).select("stem", F.col(path).alias("right_path"))
    return a.join(b, "stem")


def parameter_grid(df, name_format, **axes):
    """Every combination of parameter values for every row of ``df``.

    Axis values are configuration lists; combinations come from exploding them.
    """
    for axis, values in axes.items():
        df = df.withColumn(axis, F.explode(F.array(*[F.lit(v) for v in values])))
    return df.withColumn("run_name", F.format_string(name_format, *[F.col(a) for a in axes]))


def grid_status(grid, done, queued, cap, key="run_name"):
    """State of each grid member, and which to submit next under the cap."""
    state = (
        grid.join(done.select(key, F.lit(True).alias("_done")).distinct(), key, "left")
        .join(queued.select(key, F.lit(True).alias("_queued")).distinct(), key, "left")
        .withColumn(
            "state",
            F.when(F.col("_done"), "done").when(F.col("_queued"), "running").otherwise("pending"),
        )
        .drop("_done", "_queued")
    )
    # At most ``cap`` rows are numbered, and those beyond what is running drop out.
    active = queued.select(key).distinct().agg(F.count("*")).scalar()
    first = state.filter("state = 'pending'").orderBy(key).limit(cap)
    nxt = first.withColumn("_n", F.row_number().over(W.orderBy(key))).filter(F.col("_n") <= F.lit(cap) - active).drop("_n")
    return state, nxt


def promote_reviewed(patches, state, include_unreviewed=False, key="patch_id", mask="mask"):
    """Patches that have a mask and a review."""
    joined = patches.join(state, key, "left").withColumn("reviewed", F.coalesce("reviewed", F.lit(False)))
    keep = col(mask).isNotNull()
    return joined.filter(keep if include_unreviewed else keep & F.col("reviewed"))
