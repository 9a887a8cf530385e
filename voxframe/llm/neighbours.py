"""Nearest neighbours by stable projections and kd-trees.

Largest inner product becomes smallest distance by one more component,
sqrt(M^2 - |x|^2) with M the longest candidate of the block (0 for queries). A
Gaussian, so 2-stable, projection maps the longer vectors to ``dims`` numbers:
projected squared distances are the true ones times a chi-square variable. A
kd-tree over the projections lists each query's projected neighbours leaf after
leaf, nearest first; they are verified on the full vectors. With d the kth true
distance so far and r the projected distance from which on nothing was looked
at, a better row is missed with a probability of at most 1 - F(r^2 / d^2), F the
chi-square distribution. The search stops when that falls below ``risk``.

Every row is indexed, in blocks of bounded size; nothing is fitted on a sample.

Defined results: vectors that are null, zero or hold null or non-finite
components take no part; vectors of different dimension never meet; rows repeated
with one id are candidates each, but never of a query with that id; fewer than k
candidates give fewer rows. Other columns are ignored.
"""

import math
import sys

import numpy as np
from pyspark import cloudpickle

from voxframe.llm import vectors as vx
from voxframe.session import ensure_checkpoint_dir

cloudpickle.register_pickle_by_value(sys.modules[__name__])

DIMS = 8
LEAF = 64
RISK = 0.02
LEAVES_AT_ONCE = 4


def chi_square_quantile(p, dims):
    """Value at which the chi-square distribution of even ``dims`` reaches ``p``."""

    def below(x):
        term = total = 1.0
        for j in range(1, dims // 2):
            term *= x / 2 / j
            total += term
        return 1 - math.exp(-x / 2) * total

    low, high = 0.0, 1e3
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if below(mid) < p else (low, mid)
    return high


def kd_tree(points, leaf=LEAF):
    """(order, starts, low, high): rows by leaf, leaf bounds and boxes."""
    order, cuts, todo = np.arange(len(points)), [], [(0, len(points))]
    while todo:
        a, z = todo.pop()
        if z - a <= leaf:
            cuts.append((a, z))
            continue
        own = points[order[a:z]]
        axis = int(np.argmax(np.ptp(own, axis=0)))
        half = (z - a) // 2
        order[a:z] = order[a:z][np.argpartition(own[:, axis], half)]
        todo += [(a, a + half), (a + half, z)]
    cuts.sort()
    starts = np.array([a for a, _ in cuts])
    sorted_points = points[order]
    return order, np.append(starts, len(points)), np.minimum.reduceat(sorted_points, starts), np.maximum.reduceat(sorted_points, starts)


def _kernel(dims, risk, seed):
    bar = chi_square_quantile(1 - risk, dims)

    def run(ids, matrix, query_ids, queries, k):
        norms = (matrix**2).sum(axis=1)
        top = norms.max()
        rng = np.random.default_rng(seed)
        projection = rng.standard_normal((matrix.shape[1] + 1, dims))
        longer = np.column_stack([matrix, np.sqrt(np.maximum(top - norms, 0))])
        order, starts, low, high = kd_tree(longer @ projection)
        ids, matrix = ids[order], matrix[order]
        at = queries @ projection[:-1]
        for own, query, point in zip(query_ids, queries, at):
            gap = np.maximum(low - point, 0) + np.maximum(point - high, 0)
            radius = (gap**2).sum(axis=1)
            leaves = np.argsort(radius, kind="stable")
            length = float(query @ query) + top
            rows, scores, first = [], [], 0
            kept = np.zeros(0)
            while first < len(leaves):
                if len(kept) >= k:
                    d2 = max(length - 2 * kept[0], 0.0)
                    if radius[leaves[first]] >= bar * d2:
                        break
                use = np.concatenate([np.arange(starts[j], starts[j + 1]) for j in leaves[first : first + LEAVES_AT_ONCE]])
                use = use[ids[use] != own]
                value = matrix[use] @ query
                rows.append(use)
                scores.append(value)
                kept = np.concatenate([kept, value])
                if len(kept) > k:
                    kept = np.partition(kept, len(kept) - k)[-k:]
                kept[: len(kept)] = np.sort(kept)
                first += LEAVES_AT_ONCE
            rows, scores = np.concatenate(rows), np.concatenate(scores)
            if len(kept):
                # Final scores row by row in a fixed order: equal vectors tie.
                close = scores >= kept[0] - 1e-9 * max(1.0, abs(float(kept[0])))
                rows = rows[close]
                exact = (matrix[rows] * query).sum(axis=1)
                best = vx.best_rows(ids[rows], exact, k)
                yield own, ids[rows][best], exact[best]

    return run


def nearest(spark, vectors, queries, k=20, dims=DIMS, risk=RISK, seed=11):
    """query_id, rank, vec_id, score (inner product) for every row of ``queries``."""
    ensure_checkpoint_dir(spark)
    return vx.search(
        spark, vectors, queries, k, _kernel(dims, risk, seed), "double", usable=lambda m: (m != 0).any(axis=1)
    )
