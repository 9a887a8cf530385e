"""Vector tables in packed blocks, queries against blocks, and final ranks.

Rows are packed where they are read, without a shuffle, into blocks of bounded
size. Query blocks are sent once to every slot of candidate blocks; each pair of
blocks yields at most k rows per query, and a window keeps the best of all.
"""

import decimal
import sys

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Window
from pyspark.sql import functions as F

from voxframe.session import bound_batches

cloudpickle.register_pickle_by_value(sys.modules[__name__])

PACKED = "block long, dim int, ids array<long>, data binary"


def packed(rows, size, usable=None):
    """Blocks of at most ``size`` vectors of one dimension, doubles in row order.

    Null vectors and vectors with null or non-finite components take no part,
    nor do rows without id, nor rows that ``usable`` (of a matrix) refuses.
    """

    def run(batches):
        task, seq = TaskContext.get().partitionId(), 0
        for whole in batches:
            for start in range(0, whole.num_rows, size):
                batch = whole.slice(start, size)
                vectors = batch.column("embedding").cast(pa.list_(pa.float64()))
                ids = batch.column("vec_id").to_pylist()
                by_dim = {}
                flat = vectors.values.to_numpy(zero_copy_only=False)
                offsets = vectors.offsets.to_numpy()
                for i, valid in enumerate(vectors.is_valid().to_pylist()):
                    if valid and ids[i] is not None:
                        by_dim.setdefault(int(offsets[i + 1] - offsets[i]), []).append(i)
                for dim, at in by_dim.items():
                    matrix = np.array([flat[offsets[i] : offsets[i + 1]] for i in at], np.float64).reshape(len(at), dim)
                    use = np.isfinite(matrix).all(axis=1)
                    if usable is not None:
                        use &= usable(matrix)
                    if use.any():
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array([task << 32 | seq], pa.int64()),
                                pa.array([dim], pa.int32()),
                                pa.array([[ids[i] for i, u in zip(at, use) if u]], pa.list_(pa.int64())),
                                pa.array([matrix[use].astype("<f8").tobytes()], pa.binary()),
                            ],
                            names=["block", "dim", "ids", "data"],
                        )
                        seq += 1

    return rows.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(run, PACKED)


MOST = 10**38 - 1


def _scores(values, score_type):
    if score_type == "double":
        return pa.array(values, pa.float64())
    if values.dtype == object:
        return pa.array([decimal.Decimal(max(-MOST, min(MOST, int(v)))) for v in values], pa.decimal128(38, 0))
    return pa.array(values, pa.int64()).cast(pa.decimal128(38, 0))


def search(spark, vectors, queries, k, kernel, score_type, block=4096, usable=None):
    """Best k candidates of every query: query_id, rank, vec_id, score.

    ``kernel(ids, matrix, query_ids, query_matrix, k)`` yields (query id, ids,
    scores) for one pair of blocks. A query is no candidate of its own. Equal
    scores rank by the smaller id.
    """
    bound_batches(spark)
    candidates = packed(vectors, block, usable).checkpoint()
    asked = packed(queries, block // 4, usable).checkpoint()
    slots = max(1, min(candidates.count(), 20_000))
    left = candidates.withColumn("slot", F.pmod(F.xxhash64("block"), F.lit(slots)))
    right = asked.select(
        F.col("dim").alias("q_dim"),
        F.col("ids").alias("q_ids"),
        F.col("data").alias("q_data"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slots - 1).cast("long"))).alias("slot"),
    )
    pairs = left.repartition(slots, "slot").join(right.repartition(slots, "slot"), "slot").filter("dim = q_dim")

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                matrix = np.frombuffer(row["data"], "<f8").reshape(-1, row["dim"])
                queries = np.frombuffer(row["q_data"], "<f8").reshape(-1, row["dim"])
                out = [[], [], []]
                for query, ids, scores in kernel(np.array(row["ids"]), matrix, row["q_ids"], queries, k):
                    out[0].append(np.full(len(ids), query))
                    out[1].append(ids)
                    out[2].append(scores)
                if out[0]:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(out[0]), pa.int64()), pa.array(np.concatenate(out[1]), pa.int64()), _scores(np.concatenate(out[2]), score_type)],
                        names=["query_id", "vec_id", "score"],
                    )

    found = pairs.select("dim", "ids", "data", "q_ids", "q_data").mapInArrow(run, f"query_id long, vec_id long, score {score_type}")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def best_rows(ids, scores, k):
    """Positions of the k best scores, equal ones by the smaller id."""
    if len(scores) > k:
        bar = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = np.flatnonzero(scores >= bar)
    else:
        keep = np.arange(len(scores))
    return keep[np.lexsort((ids[keep], -scores[keep]))][:k]
