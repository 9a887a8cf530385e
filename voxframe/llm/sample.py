"""Bounded training samples of labelled documents, and the hold-out rule."""

from pyspark.sql import functions as F


def fold(column, folds):
    """crc32 of the id as text, modulo ``folds``."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % folds


def labelled(docs, labels, target, folds, held_out, size, longest=200_000):
    """At most ``size`` rows (text, label) outside the held-out fold, on the driver.

    The ids are drawn by hash first; only that many texts (of at most
    ``longest`` characters) then come to the driver. Rows without label do not
    count.
    """
    ids = (
        labels.filter(F.col(target).isin(0, 1) & F.col("doc_id").isNotNull())
        .filter(F.coalesce(fold("doc_id", folds) != held_out, F.lit(False)))
        .groupBy(F.col("doc_id").cast("long").alias("label_id"))
        .agg(F.max(target).alias("label"))
        .orderBy(F.xxhash64("label_id"), "label_id")
        .limit(size)
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("label_id"), F.coalesce("text", F.lit("")).alias("text"))
    found = texts.filter(F.length("text") <= longest).join(F.broadcast(ids), "label_id").orderBy("label_id", "text").limit(2 * size)
    table = found.select("text", F.col("label").cast("int")).toArrow()
    return table.column("text").combine_chunks(), table.column("label").to_numpy().astype("float64")
