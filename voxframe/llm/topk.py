"""Exact top-k inner products by Fagin's threshold algorithm.

Components become floor(scale * x), so scores are integers. In each block of
candidates every dimension has a list of rows sorted by value. For a query the
lists are read in parallel, downwards where its component is positive and upwards
where it is negative, at doubling depth; each newly met row is scored in full.
No unseen row can score more than the query against the values at the current
depth. Reading stops when the kth score is above that bound (above, not at: an
unseen row might tie with a smaller id).

Defined results: vectors that are null or hold null or non-finite components
take no part; vectors of different dimension never meet; rows repeated with one
id are candidates each, but never of a query with that id; fewer than k
candidates give fewer rows; texts have no part in this, and an empty table gives
no rows. Components of any size are ranked by exact integers; a score that no
long can hold is given as the nearest long, and scores are told apart up to 38
digits. Other columns are ignored.
"""

import math
import sys

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import functions as F

from voxframe.llm import vectors as vx
from voxframe.session import ensure_checkpoint_dir

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: The first depth reads about as many entries as the block has rows; then it grows.
GROWTH = 8


def numbers(values, query):
    """The narrowest kind of number in which all sums are exact."""
    if object in (values.dtype, query.dtype):
        return object
    with np.errstate(over="ignore"):
        most = np.abs(values).max(initial=0) * np.abs(query).sum(axis=-1).max(initial=0)
    return np.float32 if most < 2.0**24 else np.float64 if most < 2.0**53 else np.int64 if most < 2.0**62 else object


def floored(matrix, scale):
    """floor(scale * x), as doubles where these hold it, else as whole numbers."""
    with np.errstate(over="ignore"):
        values = np.floor(scale * matrix)
    if np.isfinite(values).all():
        return values
    # Doubles beyond 2**53 are whole numbers.
    whole = [math.floor(scale * x) if abs(x) < 2.0**53 else scale * int(x) for x in matrix.ravel().tolist()]
    return np.array(whole, object).reshape(matrix.shape)


def as_kind(values, kind):
    if kind is not object:
        return values.astype(kind)
    return np.array([int(v) for v in values.ravel().tolist()], object).reshape(values.shape)


def threshold_top(ids, values, order, query, k, own):
    """(positions, scores) of rows that hold the k best for one query.

    ``order`` has one row per dimension: the positions by ascending value.
    """
    n = len(values)
    up, down = np.flatnonzero(query < 0), np.flatnonzero(query > 0)
    lists = len(up) + len(down)
    fresh = np.ones(n, bool)
    have, scores, kept, left = [], [], np.zeros(0, values.dtype), n
    depth = min(n, max(k, n // max(lists, 16))) if lists else n
    while True:
        if depth == n:
            new = np.flatnonzero(fresh)
        else:
            met = np.zeros(n, bool)
            met[order[up, :depth]] = True
            met[order[down, n - depth :]] = True
            met &= fresh
            new = np.flatnonzero(met)
            fresh[new] = False
        left -= len(new)
        new = new[ids[new] != own]
        score = np.take(values, new, axis=0) @ query
        have.append(new)
        scores.append(score)
        kept = np.concatenate([kept, score])
        if len(kept) > k:
            kept = np.partition(kept, len(kept) - k)[-k:] if kept.dtype != object else np.sort(kept)[-k:]
        if not left:
            break
        bound = values[order[up, depth - 1], up] @ query[up] + values[order[down, n - depth], down] @ query[down]
        if len(kept) >= k and kept.min() > bound:
            break
        depth = min(GROWTH * depth, n)
    scores = np.concatenate(scores)
    return np.concatenate(have), scores if scores.dtype == object else scores.astype(np.int64)


def _kernel(scale):
    def run(ids, matrix, query_ids, queries, k):
        values, queries = floored(matrix, scale), floored(queries, scale)
        kind = numbers(values, queries)
        values, queries = as_kind(values, kind), as_kind(queries, kind)
        order = np.ascontiguousarray(np.argsort(values, axis=0, kind="stable").T.astype(np.int32))
        for own, query in zip(query_ids, queries):
            have, scores = threshold_top(ids, values, order, query, k, own)
            best = vx.best_rows(ids[have], scores, k)
            yield own, ids[have][best], scores[best]

    return run


def top_k(spark, vectors, queries, k=20, scale=64):
    """query_id, rank, vec_id, score for every row of ``queries``."""
    ensure_checkpoint_dir(spark)
    found = vx.search(spark, vectors, queries, k, _kernel(scale), "decimal(38,0)")
    low, high = F.lit(-(2**63)).cast("decimal(38,0)"), F.lit(2**63 - 1).cast("decimal(38,0)")
    return found.withColumn("score", F.least(F.greatest("score", low), high).cast("long"))


def every(vectors, step=20):
    return vectors.filter(F.col("vec_id") % step == 0)
