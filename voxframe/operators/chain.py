"""Patches normalised against reference subjects, from boxes to cropped windows.

The steps are those of the other modules; here they are put together so that a
voxel moves once for the window it is in, and everything else that moves is a few
numbers: reference windows become their statistics where they are cut, and these
reach the patch's box before its own window is cut.
"""

from pyspark.sql import functions as F

from voxframe.operators import geometry, joins, normalize
from voxframe.session import RoundTables

AXES = "zyx"
CORNERS = [f"{a}{e}" for a in AXES for e in "01"]


def corrected_chunks(chunks, fields, on, scale, edge):
    """Chunk rows with ``raw`` and ``corrected`` arrays, for ``global_stats``."""
    placed = chunks.withColumns({f"{a}0": F.col(f"c{a}") * edge for a in AXES}).withColumn("raw", F.col("data"))
    return normalize.bias_correct(placed, fields, on, scale).select(*on, "cz", "cy", "cx", "raw", F.col("data").alias("corrected"))


def reference_window_stats(pairs, chunks, fields, key, volume, edge, scale, min_valid=5000):
    """(key, ref_dataset, ref_subject, mu, sigma) of each patch's box in its references.

    ``pairs``: (key, ref_dataset, ref_subject, volume, box); the volume is that of
    the reference. Null where the window holds too little of it.
    """
    label = F.struct(key, "ref_dataset", "ref_subject", volume, *[f"{a}0" for a in AXES]).alias("tile")
    boxes = pairs.select(label, volume, *CORNERS)
    cut = joins.extract_windows(boxes, chunks, [volume], edge, "tile").select("tile.*", "dz", "dy", "dx", "data")
    both = normalize.bias_correct(cut.withColumn("raw", F.col("data")), fields, [volume], scale)
    return normalize.window_stats(both, "raw", "data", min_valid, (key, "ref_dataset", "ref_subject"))


def reference_normalised(boxes, pairs, chunks, fields, key, volume, edge, scale, crop, min_valid=5000, min_global=1000):
    """Cropped windows in units of the references, with how these were come by.

    ``boxes``: (key, volume, box) of the patches; ``pairs`` as above; ``chunks``:
    (volume, cz, cy, cx, dz, dy, dx, data) of all volumes; ``fields``: the bias
    field of the references (``normalize.bias_correct``). Statistics of reference
    windows are pooled; those of the whole volume stand in where a window holds
    too little. Returns (key, mu, sigma, fallback_count, references, dz, dy, dx, data).
    """
    # Pairs are a join that three steps read, so they are stored.
    pairs = RoundTables(pairs.sparkSession, "reference-pairs").keep(pairs)
    stats = reference_window_stats(pairs, chunks, fields, key, volume, edge, scale, min_valid)
    subjects = pairs.select("ref_dataset", "ref_subject", volume).distinct()
    wild = chunks.join(subjects.select(volume).distinct(), volume, "left_semi")
    whole = normalize.global_stats(corrected_chunks(wild, fields, [volume], scale, edge), [volume], min_global, raw="raw", corrected="corrected")
    whole = subjects.join(whole, volume).select("ref_dataset", "ref_subject", F.col("mu").alias("global_mu"), F.col("sigma").alias("global_sigma"))
    pooled = normalize.pool_reference_stats(stats, whole, (key,))
    carried = [key, "mu", "sigma", "fallback_count", "references"]
    labelled = boxes.join(pooled, key).select(F.struct(*carried).alias("tile"), volume, *CORNERS)
    cut = joins.extract_windows(labelled, chunks, [volume], edge, "tile").select("tile.*", "dz", "dy", "dx", "data")
    return geometry.central_crop(normalize.reference_zscore(cut), crop)
