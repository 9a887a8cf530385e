"""Best-fit packing after Martello-Toth dominance reduction.

Documents become token pieces of at most ``capacity`` ids (only longer
documents are cut; the first piece takes the remainder). The number of pieces of
each length is at most ``capacity`` numbers, whatever the corpus, so the plan is
made from them on the driver:

1. Reduction, from the longest length down. Let r be the room a piece leaves.
   No piece fits into r: the piece stays alone. A piece of exactly r exists: the
   pair is fixed. The two shortest pieces together exceed r: at most one piece
   can join, and the longest that fits is fixed. The three shortest together
   exceed r and no two that fit exceed the longest single that fits: that single
   is fixed. Each time every other way to fill the sequence is dominated, so the
   fixed sequences belong to some best packing. Equal cases are fixed together.
2. The remainder is packed by best fit, longest first, again by counts.

Pieces then find their places by their rank within their length. Ranks come from
salted sub-groups, so a length that a third of all pieces share is spread over
all tasks. Nothing is dropped; the packing holds every id once.

Defined results: a null or empty text is one piece with the single end id; longer
texts than ``capacity`` are cut, whatever their length; equal lengths are placed
in any order; repeated rows and null ids are packed as they are; an empty table
gives no rows; other columns are ignored.
"""

import sys
import zlib

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Window
from pyspark.sql import functions as F

from voxframe.llm import bpe
from voxframe.llm import text as tx
from voxframe.session import bound_batches, ensure_checkpoint_dir

cloudpickle.register_pickle_by_value(sys.modules[__name__])

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs, path, capacity=2048, end_id=0, added=None):
    """One row per piece; ``path`` is the rank file of the vocabulary.

    ``added``: {text: id} of tokens that are no merges (``bpe.added_tokens``).
    """
    added = dict(added or {})

    def run(batches):
        for batch in tx.blocks(batches, limit=tx.BLOCK_BYTES):
            ids, counts = bpe.encode_with_added(*tx.raw(batch.column("text")), path, added)
            at = np.cumsum(counts)
            content = np.insert(ids, at, end_id).astype("<u4").tobytes()
            out = {"doc_id": [], "piece": [], "start": [], "length": [], "ids_crc32": []}
            base = 0
            for doc, n in zip(batch.column("doc_id").to_pylist(), (counts + 1).tolist()):
                start, size = 0, (n - 1) % capacity + 1
                for piece in range(-(-n // capacity)):
                    out["doc_id"].append(doc)
                    out["piece"].append(piece)
                    out["start"].append(start)
                    out["length"].append(size)
                    out["ids_crc32"].append(zlib.crc32(content[4 * (base + start) : 4 * (base + start + size)]))
                    start, size = start + size, capacity
                base += n
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[k], pa.int32() if k == "piece" else pa.int64()) for k in out], names=list(out)
            )

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


def _smallest(count, n, without):
    """The n shortest pieces left, one of length ``without`` taken out."""
    out = []
    for size in np.flatnonzero(count).tolist():
        left = int(count[size]) - (size == without)
        out += [size] * min(n - len(out), left)
        if len(out) == n:
            break
    return out


def _largest(count, room, without):
    """The longest piece left that fits into ``room``, or 0."""
    for size in np.flatnonzero(count[: room + 1])[::-1].tolist():
        if count[size] - (size == without) > 0:
            return size
    return 0


def _best_pair(count, room, without):
    """The largest sum within ``room`` of two pieces left, or 0."""
    left = count.copy()
    left[without] -= 1
    best = 0
    for size in np.flatnonzero(left[: room + 1]).tolist():
        left[size] -= 1
        other = _largest(left, room - size, -1)
        left[size] += 1
        if other:
            best = max(best, size + other)
    return best


def reduce_counts(count, capacity):
    """Fix dominating sets; returns them with their numbers and what is left."""
    count, fixed = count.copy(), []

    def fix(sizes, n):
        for size in sizes:
            count[size] -= n
        fixed.append((tuple(sizes), n))

    for size in range(capacity, 0, -1):
        while count[size]:
            room = capacity - size
            small = _smallest(count, 3, size)
            partner = _largest(count, room, size)
            if not partner:
                fix((size,), int(count[size]))
                continue
            times = int(min(count[size], count[partner])) if partner != size else int(count[size]) // 2
            if partner == room:
                fix((size, partner), times)
            elif len(small) < 2 or small[0] + small[1] > room:
                # The two shortest may change when one of them runs out.
                fix((size, partner), times if partner not in small[:2] else 1)
            elif (len(small) < 3 or sum(small) > room) and _best_pair(count, room, size) <= partner:
                fix((size, partner), 1)
            else:
                break
    return fixed, count


def best_fit(count, capacity):
    """Best fit, longest first, over counts; groups of equal sequences."""
    open_by_room, made = {}, []
    for size in range(capacity, 0, -1):
        left = int(count[size])
        while left:
            rooms = [r for r in open_by_room if r >= size]
            if rooms:
                room = min(rooms)
                sizes, n = open_by_room[room].pop()
                if not open_by_room[room]:
                    del open_by_room[room]
                # As many of these pieces as fit, one sequence after the other.
                per = min(room // size, left)
                full = min(n, left // per)
                if n > full:
                    open_by_room.setdefault(room, []).append((sizes, n - full))
            else:
                sizes, room = (), capacity
                per = min(capacity // size, left)
                full = left // per
            left -= full * per
            group = ((*sizes, *[size] * per), full)
            rest = room - per * size
            if rest:
                open_by_room.setdefault(rest, []).append(group)
            else:
                made.append(group)
    return made + [g for groups in open_by_room.values() for g in groups]


def plan(lengths, capacity=2048):
    """Sequences for ``lengths`` ({length: pieces}): [(lengths, how many)]."""
    count = np.zeros(capacity + 1, np.int64)
    for size, n in lengths.items():
        count[size] = n
    fixed, rest = reduce_counts(count, capacity)
    return fixed + best_fit(rest, capacity)


def _slots(groups):
    """For each length and rank interval: where those pieces go.

    At most a few intervals for each length, so the table is bounded by the
    capacity: (length, first rank, first sequence, per sequence, offset).
    """
    used, rows, base = {}, [], 0
    for sizes, n in groups:
        offset = 0
        for size in sorted(set(sizes), reverse=True):
            per = sizes.count(size)
            rows.append((size, used.get(size, 0), base, per, offset))
            used[size] = used.get(size, 0) + per * n
            offset += per * size
        base += n
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def ranked(pieces, parts):
    """Add ``rank``, numbers from 0 within each length, without hot groups.

    ``row`` tells the rows of ``pieces`` apart, so that equal ones, however many,
    are spread like all others; it is dropped.
    """
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(parts)))
    local = salted.withColumn("local", F.row_number().over(Window.partitionBy("length", "salt").orderBy("row")))
    n = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = n.select(
        F.col("length").alias("o_length"),
        F.col("salt").alias("o_salt"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"),
    )
    return (
        local.join(offsets, (F.col("length") == F.col("o_length")) & (F.col("salt") == F.col("o_salt")))
        .withColumn("rank", F.col("before") + F.col("local") - 1)
        .select(*[c for c in pieces.columns if c != "row"], "rank")
    )


def pack(spark, docs, path, capacity=2048, added=None):
    """One row per piece with its sequence and its place there."""
    ensure_checkpoint_dir(spark)
    bound_batches(spark)
    # Cutting reads all texts; the short table of pieces is used three times.
    pieces = token_pieces(docs, path, capacity, added=added).withColumn("row", F.monotonically_increasing_id()).checkpoint()
    lengths = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots = _slots(plan(lengths, capacity))
    keys = slots[:, 0] << 44 | slots[:, 1]

    def place(batches):
        for batch in batches:
            size = batch.column("length").to_numpy().astype(np.int64)
            rank = batch.column("rank").to_numpy().astype(np.int64)
            row = slots[np.searchsorted(keys, size << 44 | rank, side="right") - 1]
            j = rank - row[:, 1]
            per = np.maximum(row[:, 3], 1)
            names = [n for n in batch.schema.names if n != "rank"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in names), pa.array(row[:, 2] + j // per), pa.array(row[:, 4] + j % per * size)],
                names=[*names, "sequence_id", "offset"],
            )

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return ranked(pieces, parts).mapInArrow(place, f"{PIECES}, sequence_id long, offset long")
