"""Merkle manifest of a dataset, level by level with lag and lead windows.

Every row is a leaf. The leaves of a source, in the order of their ids, form a
tree of runs of 16 nodes, and the roots of the sources form a tree of their own.

* Texts are hashed once, where they are read. What moves after that is a row of
  about a hundred bytes.
* ``numbered`` sorts by range (no group, however large, is in one task) and takes
  a row's place in its group from its place in its partition and the counts of
  the partitions before.
* A level is one shuffle by (group, block of 256 runs). Columns of fixed offsets
  (lag 1 to 15, lead 1 to 15) hold the neighbours; slot and length of the run
  mask those that belong to other runs. The rest are the siblings, and the first
  row of each run hashes itself and them to the parent.
* Proofs come down again: each level joins its parents' paths, 16 rows to one.
  The number of levels is the logarithm of the largest group.

Digests are 32 bytes in tables and lowercase hex where they are hashed.

Defined results: nulls in any field hash as ``-`` and differ from empty texts; a
null source is a group of its own, before all others; null ids come first in
their source; equal ids are ordered by their leaves, and of equal rows each
takes a place of its own; texts of any length are one leaf; a source of one row
is its own subroot and a table with one source has that subroot as root; an
empty table gives no rows; further columns, of whatever name, are ignored.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from voxframe.session import ensure_checkpoint_dir

WIDTH = 16
#: Runs that one window partition holds.
RUNS = 256
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def hash_of(raw):
    """Digest of the lowercase hex of the digests in ``raw``."""
    return F.unhex(F.sha2(F.lower(F.hex(raw)), 256))


def leaf(**fields):
    """Digest of a row; ``fields`` replace columns of that name."""

    def part(name):
        value = fields.get(name, F.col(name)).cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.unhex(F.sha2(F.concat(*map(part, FIELDS)), 256))


def leaves(docs, tampered):
    """doc_id, group, digest, and the digest that a check finds."""
    changed = F.when(tampered, F.translate("text", UPPER, LOWER)).otherwise(F.col("text"))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        # The empty key sorts first and stands for null.
        F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("group"),
        leaf().alias("digest"),
        leaf(text=changed).alias("found"),
    )


def numbered(rows, order):
    """Add ``idx`` (from 0 within ``group``, by ``order``) and ``n``, the group's rows."""
    rows = rows.withColumn("tie", F.monotonically_increasing_id()).checkpoint()
    key = ["group", *order, "tie"]
    placed = (
        rows.repartitionByRange(*key)
        .sortWithinPartitions(*key)
        .withColumn("at", F.monotonically_increasing_id())
        .withColumn("part", F.shiftright("at", 33))
        .checkpoint()
    )
    # One row for each group of a partition: at most partitions and groups.
    counts = placed.groupBy("group", "part").agg(F.min("at").alias("first"), F.count("*").alias("rows"))
    whole = Window.partitionBy("group")
    before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(
        F.col("group").alias("g"),
        F.col("part").alias("p"),
        (F.coalesce(F.sum("rows").over(before), F.lit(0)) - F.col("first")).alias("shift"),
        F.sum("rows").over(whole).alias("n"),
    )
    return (
        placed.join(counts, (F.col("group") == F.col("g")) & (F.col("part") == F.col("p")))
        .withColumn("idx", F.col("at") + F.col("shift"))
        .drop("g", "p", "shift", "at", "part", "tie")
        .checkpoint()
    )


def with_siblings(level):
    """Add ``left`` and ``right``: the digests of the run before and after a node."""
    run = Window.partitionBy("group", "block").orderBy("idx")
    first = F.col("idx") - F.col("slot")
    length = F.least(F.lit(WIDTH), F.col("n") - first)
    none = F.lit(b"")
    left = [F.when(F.col("slot") >= j, F.lag("digest", j).over(run)).otherwise(none) for j in range(WIDTH - 1, 0, -1)]
    right = [F.when(F.col("slot") + j < length, F.lead("digest", j).over(run)).otherwise(none) for j in range(1, WIDTH)]
    return (
        level.withColumn("block", F.floor(F.col("idx") / (WIDTH * RUNS)))
        .withColumn("slot", F.pmod("idx", F.lit(WIDTH)).cast("int"))
        .repartition("group", "block")
        .withColumn("left", F.concat(*left))
        .withColumn("right", F.concat(*right))
    )


def up(level):
    """The next level: first rows of a run hash the run."""
    return (
        with_siblings(level.filter("n > 1").select("group", "idx", "n", "digest"))
        .filter("slot = 0")
        .select(
            "group",
            (F.col("idx") / WIDTH).cast("long").alias("idx"),
            F.ceil(F.col("n") / WIDTH).alias("n"),
            hash_of(F.concat("digest", "right")).alias("digest"),
        )
    )


def tree(base):
    """The levels of all groups from ``base`` (group, idx, n, digest) upwards."""
    most = base.agg(F.max("n")).first()[0] or 0
    levels = [base]
    while most > 1:
        levels.append(up(levels[-1]).checkpoint())
        most = -(-most // WIDTH)
    return levels


def tops(levels):
    """group, digest, depth of the last node of each group."""
    out = None
    for depth, level in enumerate(levels):
        top = level.filter("n = 1").select("group", "digest", F.lit(depth).alias("depth"))
        out = top if out is None else out.unionAll(top)
    return out


def paths(levels, ends):
    """Add to the rows of the first level what their tops carry, and ``path``.

    ``ends`` has one row per group: group, depth, path and further columns. A
    path is a list of (left, right), from the node's own run upwards.
    """
    carried = [c for c in ends.columns if c not in ("group", "depth", "path")]
    below = None
    for depth in range(len(levels) - 1, -1, -1):
        # Groups that end here have no parents: their one node takes the end.
        above = ends.filter(F.col("depth") == depth).select("group", F.lit(0).cast("long").alias("run"), "path", *carried)
        if below is not None:
            above = above.unionAll(below.select("group", F.col("idx").alias("run"), "path", *carried))
        above = above.select(F.col("group").alias("g"), F.col("run").alias("r"), F.col("path").alias("rest"), *carried)
        level = with_siblings(levels[depth])
        own = F.when(F.col("n") > 1, F.array(F.struct("left", "right"))).otherwise(F.array().cast("array<struct<left:binary,right:binary>>"))
        run = F.when(F.col("n") > 1, (F.col("idx") / WIDTH).cast("long")).otherwise(F.lit(0).cast("long"))
        below = (
            level.withColumn("run", run)
            .join(above, (F.col("group") == F.col("g")) & (F.col("run") == F.col("r")))
            .withColumn("path", F.concat(own, "rest"))
            .select(*levels[depth].columns, "path", *carried)
        )
    return below


def fold(digest, path):
    """The root that a leaf gives with the siblings of ``path``."""
    return F.aggregate(path, digest, lambda x, s: hash_of(F.concat(s["left"], x, s["right"])))


def manifest(spark, docs, tampered):
    """One row per document: its leaf, subroot, root, proof, and what a check finds.

    ``tampered`` says which rows a check meets with the letters of their text in
    lower case; all others are met as they are.
    """
    ensure_checkpoint_dir(spark)
    base = numbered(leaves(docs, tampered), ["doc_id", "digest"])
    levels = tree(base)
    roots = tops(levels).checkpoint()
    # The subroots are the leaves of one more tree, in the order of the sources.
    upper = numbered(roots.select(F.lit("").alias("group"), F.col("group").alias("source"), "digest", "depth"), ["source"])
    upper_levels = tree(upper)
    end = tops(upper_levels).select(
        "group", "depth", F.array().cast("array<struct<left:binary,right:binary>>").alias("path"), F.col("digest").alias("root")
    )
    ends = paths(upper_levels, end).select(F.col("source").alias("group"), F.col("digest").alias("subroot"), "depth", "path", "root")
    rows = paths(levels, ends.checkpoint())
    siblings = F.aggregate("path", F.lit(b""), lambda x, s: F.concat(x, s["left"], s["right"]))

    def text(digest):
        return F.lower(F.hex(digest))

    rows = rows.withColumn("folded", fold(F.col("found"), F.col("path")))
    return rows.select(
        "doc_id",
        text("digest").alias("leaf"),
        text("subroot").alias("subroot"),
        text("root").alias("root"),
        F.sha2(text(siblings), 256).alias("proof_sha256"),
        text("folded").alias("folded_root"),
        (F.col("folded") == F.col("root")).alias("verified"),
    )


def every_fifth(docs):
    """Rows whose crc32 of the decimal id 5 divides; rows without id are none."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
