"""Near-duplicate classes by one-permutation MinHash.

1. One pass over the texts: the set of distinct word shingles of each document,
   its digest, and a one-permutation signature: one hash function, one minimum
   per bin, empty bins filled by optimal densification (each empty bin probes
   its own pseudo-random sequence of bins, the same for all documents, until it
   meets a filled one). Bands of the signature become bucket keys.
2. Documents with equal sets collapse to one node, so a group of exact copies
   costs one row from here on.
3. Every bucket links its members to one centre only (a star): pairs grow with
   the members, never with their square. Bands choose centres in two orders.
   Candidate pairs are confirmed on the full sets of both texts. Components.
4. What the stars leave open are pairs of a bucket that are in different
   components. The members of such buckets meet by their rarest shingles: in one
   order for all, by rising frequency, two sets of the threshold's similarity
   share one of their first n - ceil(t n) + 1. Pairs of one component are left
   out, as are pairs whose sizes, or the places of the shared shingle, leave too
   little to share. That loses no pair, and members of one template that differ
   in what is their own never meet. Frequencies come from counters of a fixed
   number; where they err, a shingle is only put in another place for all.

The number of bands is chosen so that a pair at the threshold shares no bucket
with a probability below 1e-6. Shingles are compared by 64-bit hashes.

Defined results: texts without words (null and empty ones too) have no shingles
and are linked with nothing; fewer words than a shingle make one shingle of the
whole sequence; texts of any length are compared whole; repeated rows belong to
the same class and are all returned; the rows of an id with several texts are in
the classes of these; a row without id takes no
part (its class is null, it is kept); an empty table gives no rows. Other columns
are ignored.
"""

import hashlib
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import functions as F

from voxframe.llm import text as tx
from voxframe.session import RoundTables, bound_batches, ensure_checkpoint_dir

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BINS_LOG2 = 8
MISS = 1e-6
#: Orders in which buckets choose their centres in a round. All buckets share an
#: order, so a member of many buckets meets few different centres.
ORDERS = 2
#: Counters of shingles (8 MB at most to all executors).
COUNTERS = 1 << 20
#: Rows of a shingle that meet the outsiders of it in one task.
BLOCK_MEMBERS = 4096
#: Most ids that are sent to all executors (8 bytes each); more are joined.
BROADCAST_IDS = 400_000


def banding(percent, bins=1 << BINS_LOG2):
    """Rows per band and bands: the longest rows that keep misses below MISS."""
    t = percent / 100
    rows = max(r for r in range(1, 17) if r == 1 or (1 - t**r) ** (bins // r) < MISS)
    return rows, bins // rows


def shingle_sets(data, offsets, k):
    """Sorted distinct shingle hashes of all texts in a row, and their numbers."""
    data = tx.LOWER[data]
    starts, ends, row = tx.words(data, offsets)
    n = len(offsets) - 1
    if len(starts) == 0:
        return np.zeros(0, np.uint64), np.zeros(n, np.int64)
    word = tx.slice_hash(tx.prefix_hash(data), starts, ends)
    m = len(word)
    odd = tx.mix(np.arange(k, dtype=np.uint64)) | np.uint64(1)
    total = word.copy()
    whole = np.arange(m) + k <= m
    for j in range(1, k):
        same = np.zeros(m, bool)
        same[: m - j] = row[j:] == row[: m - j]
        total[: m - j] += np.where(same[: m - j], word[j:] * odd[j], np.uint64(0))
        whole &= same
    first = np.concatenate([[True], row[1:] != row[:-1]])
    count = np.bincount(row, minlength=n)
    use = whole | (first & (count[row] < k))
    hashes, rows = tx.mix(total[use]), row[use]
    cuts = np.searchsorted(rows, np.arange(n + 1))
    sets = [np.unique(hashes[a:z]) for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
    return np.concatenate(sets), np.array([len(s) for s in sets], np.int64)


def _probes(bins):
    return (tx.mix(np.arange(4096 * bins, dtype=np.uint64)) % np.uint64(bins)).astype(np.int64).reshape(4096, bins)


def signatures(hashes, counts, bins=1 << BINS_LOG2):
    """Densified one-permutation signatures of the non-empty sets."""
    n = len(counts)
    row = np.repeat(np.arange(n), counts)
    at = row * bins + (hashes >> np.uint64(64 - bins.bit_length() + 1)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else np.zeros(0, np.int64)
    signature = np.zeros(n * bins, np.uint64)
    filled = np.zeros(n * bins, bool)
    signature[at[first]] = hashes[first]
    filled[at[first]] = True
    signature, filled = signature.reshape(n, bins), filled.reshape(n, bins)
    r, c = np.nonzero(~filled & filled.any(axis=1)[:, None])
    probes = tx.worker_cache(f"probes{bins}", lambda: _probes(bins))
    for attempt in range(len(probes)):
        if not len(r):
            break
        source = probes[attempt][c]
        hit = filled[r, source]
        signature[r[hit], c[hit]] = signature[r[hit], source[hit]]
        r, c = r[~hit], c[~hit]
    for i, j in zip(r.tolist(), c.tolist()):  # practically never
        signature[i, j] = signature[i, np.flatnonzero(filled[i])[0]]
    return signature


def band_keys(signature, rows, bands):
    keys = np.zeros((len(signature), bands), np.uint64)
    for j in range(rows):
        keys = tx.mix(keys + signature[:, j : rows * bands : rows][:, :bands] + np.uint64(j + 1))
    return tx.mix(keys + np.arange(bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


SKETCH = "doc_id long, text_hash binary, n_shingles long, digest binary, bands array<long>"


def text_hash():
    return F.unhex(F.md5("text"))


def sketches(docs, k, percent):
    rows, bands = banding(percent)

    def run(batches):
        for batch in tx.blocks(batches):
            hashes, counts = shingle_sets(*tx.raw(batch.column("text")), k)
            keys = band_keys(signatures(hashes, counts), rows, bands)
            ends = np.cumsum(counts)
            digests = [hashlib.blake2b(hashes[e - c : e].tobytes(), digest_size=16).digest() for e, c in zip(ends.tolist(), counts.tolist())]
            some = counts > 0
            offsets = np.concatenate([[0], np.cumsum(np.where(some, bands, 0))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("text_hash"),
                    pa.array(counts),
                    pa.array(digests, pa.binary()),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[some].ravel())),
                ],
                names=["doc_id", "text_hash", "n_shingles", "digest", "bands"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text", text_hash().alias("text_hash")).mapInArrow(run, SKETCH)


def confirmed(pairs, docs, k, percent):
    """Pairs of nodes (a, b) whose full sets reach the threshold.

    Texts join by id, and of the texts of an id only the one that was hashed counts.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    ids = pairs.select(F.col("id_a").alias("id")).union(pairs.select(F.col("id_b").alias("id"))).distinct()
    if 2 * pairs.count() <= BROADCAST_IDS:
        # Few texts are asked for: drop the others before they are shuffled.
        texts = texts.join(F.broadcast(ids), "id", "left_semi")
    b = texts.select(F.col("id").alias("id_b"), F.col("text").alias("text_b"))
    a = texts.select(F.col("id").alias("id_a"), F.col("text").alias("text_a"))
    both = pairs.select("a", "b", "id_a", "id_b", "digest_a", "digest_b").join(b, "id_b").join(a, "id_a")

    def run(batches):
        for batch in tx.blocks(batches, "text_b"):
            ids = batch.column("a").to_numpy()
            # One text per distinct text of a centre, not one per pair.
            _, first, code = np.unique(ids, return_index=True, return_inverse=True)
            left, n_left = shingle_sets(*tx.raw(batch.column("text_a").take(pa.array(first))), k)
            right, n_right = shingle_sets(*tx.raw(batch.column("text_b")), k)
            le, re = np.cumsum(n_left), np.cumsum(n_right)
            keep = np.zeros(batch.num_rows, bool)
            da, db = batch.column("digest_a").to_pylist(), batch.column("digest_b").to_pylist()
            for i, c in enumerate(code.tolist()):
                x, y = left[le[c] - n_left[c] : le[c]], right[re[i] - n_right[i] : re[i]]
                # Ids that stand for several texts: only the text that was hashed counts.
                if hashlib.blake2b(y.tobytes(), digest_size=16).digest() != db[i]:
                    continue
                if hashlib.blake2b(x.tobytes(), digest_size=16).digest() != da[i]:
                    x = shingle_sets(*tx.raw(batch.column("text_a").slice(i, 1)), k)[0]
                    if hashlib.blake2b(x.tobytes(), digest_size=16).digest() != da[i]:
                        continue
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep[i] = 100 * common >= percent * (len(x) + len(y) - common)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep))

    return both.mapInArrow(run, "a long, b long")


def components(edges):
    """(node, label): the smallest node reachable, for every node with an edge.

    Each round takes the smallest label of the neighbours, then the label of
    that label. Rounds are cut by checkpoints, which also lets Spark split the
    joins on the busy nodes.
    """
    arcs = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(
        edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    )
    # Rows of two numbers: a sixteenth of the usual partitions is enough for them.
    few = max(8, int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 16)
    labels = arcs.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("label")).coalesce(few).checkpoint()
    total = None
    while True:
        new = labels.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]
        if new == total:
            return labels.select(F.col("u").alias("node"), "label")
        total = new
        near = arcs.join(labels.select(F.col("u").alias("v"), "label"), "v").groupBy("u").agg(F.min("label").alias("near"))
        hooked = labels.join(near, "u").select("u", F.least("label", "near").alias("label")).coalesce(few).checkpoint()
        up = hooked.select(F.col("u").alias("label"), F.col("label").alias("top"))
        labels = hooked.join(up, "label", "left").select("u", F.least("label", "top").alias("label")).coalesce(few).checkpoint()


def _pairs(met, nodes):
    """Distinct pairs (a, b) of what met, with their ids and digests."""
    pairs = met.select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b")).distinct()
    for side in "ab":
        names = {"node": side, "doc": f"id_{side}", "digest": f"digest_{side}"}
        pairs = pairs.join(nodes.select(*[F.col(c).alias(n) for c, n in names.items()]), side)
    return pairs


def near_enough(n, m, percent):
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def _sets(batch, k):
    """(row, its shingles) of a batch, where they are those that were hashed."""
    hashes, counts = shingle_sets(*tx.raw(batch.column("text")), k)
    digests, end = batch.column("digest").to_pylist(), 0
    for i, n in enumerate(counts.tolist()):
        end += n
        own = hashes[end - n : end]
        if hashlib.blake2b(own.tobytes(), digest_size=16).digest() == digests[i]:
            yield i, own


def counted(rows, k):
    """(counter, n): how often the shingles of the rows' texts occur, by counter."""

    def run(batches):
        total = np.zeros(COUNTERS, np.int64)
        for batch in tx.blocks(batches):
            for _, own in _sets(batch, k):
                np.add.at(total, (own & np.uint64(COUNTERS - 1)).astype(np.int64), 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["counter", "n"])

    return rows.mapInArrow(run, "counter int, n long").groupBy("counter").agg(F.sum("n").alias("n"))


def rare_shingles(rows, k, percent, counts):
    """(token, pos, node, n, label): the first shingles of each set, rarest first."""

    def run(batches):
        for batch in tx.blocks(batches):
            out, at = [], []
            for i, own in _sets(batch, k):
                n = len(own)
                often = counts.value[(own & np.uint64(COUNTERS - 1)).astype(np.int64)]
                out.append(own[np.lexsort((own, often))[: n + (-percent * n) // 100 + 1]])
                at.append(i)
            sizes = [len(x) for x in out]
            take = pa.array(np.repeat(np.array(at, np.int64), sizes))
            pos = np.concatenate([np.arange(x, dtype=np.int32) for x in sizes]) if sizes else np.zeros(0, np.int32)
            token = np.concatenate(out).view(np.int64) if out else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(token), pa.array(pos), *(batch.column(c).take(take) for c in ("node", "n", "label"))],
                names=["token", "pos", "node", "n", "label"],
            )

    return rows.mapInArrow(run, "token long, pos int, node long, n int, label long")


def _meetings(tokens, percent):
    """Pairs (a, node) of different components that share a rare shingle.

    Rows of a shingle meet those outside its largest component only, in blocks,
    so that a shingle of very many sets is the work of many tasks.
    """
    mixed = (
        tokens.groupBy("token", "label")
        .agg(F.count("*").alias("size"))
        .groupBy("token")
        .agg(F.max(F.struct("size", "label")).alias("top"), F.sum("size").alias("members"))
        .filter(F.col("members") > F.col("top.size"))
        .select("token", F.col("top.label").alias("largest"), F.ceil(F.col("members") / BLOCK_MEMBERS).cast("int").alias("blocks"))
    )
    rows = tokens.join(mixed, "token")
    outsiders = rows.filter("label <> largest").select(
        "token",
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
        *[F.col(c).alias(f"{c}_a") for c in ("pos", "n", "label")],
        F.col("node").alias("a"),
    )
    dealt = rows.select("token", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"), "pos", "node", "n", "label")
    # Behind a shared shingle at these places at most so many can follow.
    room = F.least(F.col("n") - F.col("pos"), F.col("n_a") - F.col("pos_a"))
    enough = (100 + percent) * room >= percent * (F.col("n") + F.col("n_a"))
    return dealt.join(outsiders, ["token", "block"]).filter((F.col("label") != F.col("label_a")) & near_enough("n", "n_a", percent) & enough)


def _open_pairs(spark, docs, nodes, shared, labels, k, percent, tables):
    """Candidate pairs of different components among the members of mixed buckets."""
    rows = shared.join(labels, "node", "left").select("bucket", "node", F.coalesce("label", "node").alias("label"))
    mixed = rows.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high")
    members = rows.join(mixed.select("bucket"), "bucket", "left_semi").select("node", "label").distinct()
    members = tables.keep(members.join(nodes.select("node", "n", "digest", "doc"), "node"))
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    few = members.count() <= BROADCAST_IDS
    asked = texts.join(F.broadcast(members) if few else members, F.col("id") == F.col("doc")).select("node", "n", "label", "digest", "text")
    table = np.zeros(COUNTERS, np.int32)
    for row in counted(asked, k).toArrow().to_batches():
        table[row.column("counter").to_numpy()] = np.minimum(row.column("n").to_numpy(), 2**31 - 1)
    counts = spark.sparkContext.broadcast(table)
    # One row per set: several rows of the id may hold the same text.
    tokens = tables.keep(rare_shingles(asked, k, percent, counts).distinct())
    return _pairs(_meetings(tokens, percent), nodes)


def classes(spark, docs, k, percent):
    """One row per row of ``docs``: doc_id, text_hash, n_shingles, label, component_id.

    ``label`` tells the classes apart, also those that share their smallest id.
    """
    ensure_checkpoint_dir(spark)
    bound_batches(spark)
    tables = RoundTables(spark, "neardup")
    sketched = tables.keep(sketches(docs, k, percent))
    some = sketched.filter("n_shingles > 0 and doc_id is not null")
    first = F.min(F.struct("doc_id", "n_shingles", "bands")).alias("s")
    # A node is a set; its number is its own, as an id may have several texts.
    nodes = tables.keep(
        some.groupBy("digest")
        .agg(first)
        .select("digest", F.col("s.doc_id").alias("doc"), F.col("s.n_shingles").cast("int").alias("n"), "s.bands")
        .withColumn("node", F.monotonically_increasing_id())
    )
    # Bands take their centres in ORDERS different orders, so that most members
    # meet several centres at once.
    members = nodes.select("node", "doc", "n", F.posexplode("bands").alias("band", "bucket"))
    turn = F.col("band") % ORDERS
    order = F.when(turn == 0, F.col("doc")).otherwise(F.xxhash64("doc", turn.cast("long")))
    star = F.struct(order.alias("order"), F.col("node").alias("a"), F.col("n").alias("n_a"))
    centres = members.groupBy("bucket").agg(F.min(star).alias("s"), F.count("*").alias("members")).filter("members > 1")
    # Only the buckets with several members are of any use from here on.
    shared = tables.keep(members.join(centres.select("bucket", "s.a", "s.n_a"), "bucket").select("bucket", "node", "n", "a", "n_a"))
    met = shared.filter((F.col("node") != F.col("a")) & near_enough("n", "n_a", percent))
    pairs = tables.keep(_pairs(met, nodes))
    edges = tables.keep(confirmed(pairs, docs, k, percent).distinct())
    labels = components(edges)
    pairs = tables.keep(_open_pairs(spark, docs, nodes, shared, labels, k, percent, tables))
    found = tables.keep(confirmed(pairs, docs, k, percent).distinct())
    if not found.isEmpty():
        labels = components(edges.union(found))
    named = nodes.select("digest", "node", "doc").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    smallest = named.groupBy("label").agg(F.min("doc").alias("component_id"))
    of_digest = tables.keep(named.join(smallest, "label").select("digest", "label", "component_id"))
    linked = some.join(of_digest, "digest").select("doc_id", "text_hash", "n_shingles", "label", "component_id")
    none = F.lit(None).cast("long").alias("label")
    alone = sketched.filter("n_shingles = 0 or doc_id is null").select("doc_id", "text_hash", "n_shingles", none, F.col("doc_id").alias("component_id"))
    rows = tables.keep(linked.union(alone))
    tables.drop_all_but(rows)
    return rows


def near_duplicates(spark, docs, k=5, percent=80):
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept."""
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept")
    return classes(spark, docs, k, percent).select("doc_id", "n_shingles", "component_id", kept)


def keep_one(spark, docs, k=5, percent=80):
    """One row of each class, with all its columns: a row of the smallest id.

    Rows are told apart by id and text, so a text of its own stays where another
    row of the same id is a copy. Of rows with the same id, class and text one
    stays, whichever its other columns; where the smallest id has several texts
    of the class, the one of the smallest hash does. Rows without id or without
    words all stay.
    """
    rows = classes(spark, docs, k, percent).filter("n_shingles > 0 and doc_id is not null")
    own = rows.groupBy("label", "component_id", "doc_id", "text_hash").agg(F.count("*").alias("rows"))
    # Of a class: its smallest text of the smallest id.
    best = own.filter("doc_id = component_id").groupBy("label").agg(F.min("text_hash").alias("best"))
    marked = own.join(best, "label").withColumn("stays", (F.col("doc_id") == F.col("component_id")) & (F.col("text_hash") == F.col("best")))
    marked = marked.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), "stays", "rows").checkpoint()
    named = docs.withColumn("__text_hash", text_hash())

    def same(keys):
        return (named["doc_id"].cast("long") == keys["__id"]) & (named["__text_hash"] == keys["__hash"])

    gone, again = marked.filter("not stays"), marked.filter("stays and rows > 1")
    if again.isEmpty():
        return named.join(gone, same(gone), "left_anti").select(docs.columns)
    more = marked.filter("not stays or rows > 1")
    once = named.join(again, same(again), "left_semi").dropDuplicates(["doc_id", "__text_hash"])
    return named.join(more, same(more), "left_anti").unionAll(once).select(docs.columns)
