"""Byte-level BPE by a global shuffle of distinct words.

``encode`` cuts whole texts into pre-tokens and numbers the distinct ones of
each block of a few megabytes. Words that are tokens themselves are known at
once. All others travel, one copy per block, to the task that owns their hash
bucket; there each distinct word is merged once, and the ids go back to the
blocks, where the texts are put together again by position. Positions travel as
numbers of distinct words, compressed, so a frequent word costs no more shuffle
than a rare one and no task ever gathers the occurrences of a word.

``decode`` joins the bounded table of token bytes.

Defined results: a null or empty text has no tokens; in others, bytes that are no
UTF-8 count (and are decoded) as U+FFFD; texts of any length are one unit; repeated
rows and null ids are kept as they are; an empty table gives no rows; other columns
of the input are ignored.
"""

import base64
import itertools
import json
import re
import sys

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import functions as F

from voxframe.llm import text as tx
from voxframe.session import bound_batches

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK_BYTES = 2 << 20
#: Words whose ids a task remembers; the table is emptied when it is full.
REMEMBERED = 1 << 18


def rank_file(path):
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def ranks(path):
    """{token bytes: id}, for the words that are tokens."""
    return tx.worker_cache(f"ranks {path}", lambda: rank_file(path))


def merger(path):
    """The function from the bytes of one word to its ids."""

    def build():
        import tiktoken

        encoding = tiktoken.Encoding("ranks", pat_str=r"[\s\S]+", mergeable_ranks=rank_file(path), special_tokens={})
        return encoding._core_bpe.encode_single_piece

    return tx.worker_cache(f"merger {path}", build)


class TokenBytes:
    """The table of token bytes."""

    def __init__(self, path):
        found = rank_file(path)
        tokens = [b""] * (max(found.values()) + 1)
        for token, rank in found.items():
            tokens[rank] = token
        self.sizes = np.array([len(x) for x in tokens], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def decode(self, ids):
        """Bytes of the ids and the number of bytes of each id."""
        size = self.sizes[ids]
        end = np.cumsum(size)
        total = int(end[-1]) if len(end) else 0
        at = np.repeat(self.starts[ids] - (end - size), size) + np.arange(total)
        return self.bytes[at], size


def distinct(data, offsets):
    """Distinct pre-tokens of a block, the number of each occurrence, its row."""
    data, offsets = tx.valid(data, offsets)
    starts, ends, rows = tx.pieces(data, offsets)
    hashes = tx.slice_hash(tx.prefix_hash(data), starts, ends)
    found, first, code = np.unique(hashes, return_index=True, return_inverse=True)
    content = data.tobytes()
    words = [content[a:z] for a, z in zip(starts[first].tolist(), ends[first].tolist())]
    return words, found, code, rows


def expand(code, ids, sizes):
    """Ids of all occurrences in a row, given the ids of each distinct word."""
    start = np.cumsum(sizes) - sizes
    n = sizes[code]
    end = np.cumsum(n)
    total = int(end[-1]) if len(end) else 0
    return ids[np.repeat(start[code] - (end - n), n) + np.arange(total)], n


def encode_block(data, offsets, path):
    """Ids of a block of texts and the number of ids of each text."""
    words, _, code, rows = distinct(data, offsets)
    merge = merger(path)
    found = [merge(w) for w in words]
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    ids = np.fromiter(itertools.chain.from_iterable(found), np.uint32, int(sizes.sum()))
    ids, n = expand(code, ids, sizes)
    return ids, np.bincount(rows, weights=n, minlength=len(offsets) - 1).astype(np.int64)


def added_tokens(path):
    """{text: id} of the added tokens of a tokenizer's JSON file."""
    with open(path, encoding="utf-8") as lines:
        return {t["content"]: t["id"] for t in json.load(lines)["added_tokens"]}


def encode_with_added(data, offsets, path, added):
    """As ``encode_block``; the texts of ``added`` tokens become their ids.

    They are found in the raw text, and what lies between is encoded alone.
    """
    data, offsets = tx.valid(data, offsets)
    if not any(token.encode() in data.tobytes() for token in added):
        return encode_block(data, offsets, path)
    content = data.tobytes()
    pattern = re.compile(b"|".join(sorted((re.escape(t.encode()) for t in added), key=len, reverse=True)))
    ends, rows, token = [0], [], []
    kept = []
    for i, (a, z) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        for found in [*pattern.finditer(content, a, z), None]:
            stop = found.start() if found else z
            kept.append(content[a:stop])
            ends.append(ends[-1] + stop - a)
            rows.append(i)
            token.append(added[found[0].decode()] if found else -1)
            a = found.end() if found else z
    ids, counts = encode_block(np.frombuffer(b"".join(kept), np.uint8), np.array(ends, np.int64), path)
    token, rows = np.array(token), np.array(rows)
    ids = np.insert(ids, np.cumsum(counts)[token >= 0], token[token >= 0])
    return ids, np.bincount(rows, weights=counts + (token >= 0), minlength=len(offsets) - 1).astype(np.int64)


def _pack(array):
    """Compressed numbers, their low bytes first, then the next ones, and so on."""
    planes = np.ascontiguousarray(array.view(np.uint8).reshape(-1, array.itemsize).T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True) if len(array) else b""


def _unpack(blob, size, kind):
    if not size:
        return np.zeros(0, kind)
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(blob, size * width, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(width, -1).T).view(kind).ravel()


def _numbered(batches, path, buckets):
    """Each block with its number, ids where known, and bucket of the other words."""
    task = TaskContext.get()
    table = ranks(path)
    for seq, batch in enumerate(tx.blocks(batches, limit=BLOCK_BYTES)):
        data, offsets = tx.raw(batch.column("text"))
        words, hashes, code, rows = distinct(data, offsets)
        known = np.fromiter((table.get(w, -1) for w in words), np.int64, len(words))
        bucket = np.where(known < 0, (hashes % np.uint64(buckets)).astype(np.int64), -1)
        # Neighbours in a bucket share beginnings, which compresses well.
        order = np.array(sorted(range(len(words)), key=words.__getitem__), np.int64)
        order = order[np.argsort(bucket[order], kind="stable")]
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        yield (
            (task.partitionId() << 32) | seq,
            batch,
            [words[i] for i in order.tolist()],
            known[order],
            bucket[order],
            hashes[order],
            place[code],
            np.bincount(rows, minlength=batch.num_rows),
        )


REQUEST = "block long, bucket int, n int, size int, check long, words binary, lengths binary"


def _requests(path, buckets):
    def run(batches):
        for block, _, words, _, bucket, hashes, _, _ in _numbered(batches, path, buckets):
            out = {k: [] for k in ("block", "bucket", "n", "size", "check", "words", "lengths")}
            cuts = np.searchsorted(bucket, np.arange(buckets + 1))
            for b in range(buckets):
                own = words[cuts[b] : cuts[b + 1]]
                if own:
                    content = b"".join(own)
                    out["block"].append(block)
                    out["bucket"].append(b)
                    out["n"].append(len(own))
                    out["size"].append(len(content))
                    out["check"].append(_check(hashes[cuts[b] : cuts[b + 1]]))
                    out["words"].append(pa.compress(content, codec="zstd", asbytes=True))
                    out["lengths"].append(_pack(np.array([len(w) for w in own], np.uint32)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[k], t) for k, t in zip(out, (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()))],
                names=list(out),
            )

    return run


ANSWER = "block long, bucket int, n int, check long, size int, ids binary, counts binary"


def _check(hashes):
    """One number for words in their order, as a signed long."""
    weights = np.arange(1, 2 * len(hashes) + 1, 2, dtype=np.uint64)
    return int((tx.mix(hashes) * weights).sum(dtype=np.uint64).astype(np.int64)) if len(hashes) else 0


def _answers(path):
    """Merge each distinct word of this task's buckets once."""

    def run(batches):
        merge, seen = merger(path), {}
        for batch in batches:
            ids_out, counts_out, sizes = [], [], []
            for row in batch.to_pylist():
                content = pa.decompress(row["words"], row["size"], codec="zstd", asbytes=True)
                ends = np.cumsum(_unpack(row["lengths"], row["n"], np.uint32).astype(np.int64)).tolist()
                ids, counts, start = [], [], 0
                for end in ends:
                    word = content[start:end]
                    start = end
                    got = seen.get(word)
                    if got is None:
                        if len(seen) >= REMEMBERED:
                            seen.clear()
                        got = seen[word] = tuple(merge(word))
                    ids.extend(got)
                    counts.append(len(got))
                ids_out.append(_pack(np.array(ids, np.uint32)))
                counts_out.append(_pack(np.array(counts, np.uint32)))
                sizes.append(len(ids))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("block", "bucket", "n", "check")), pa.array(sizes, pa.int32()), pa.array(ids_out, pa.binary()), pa.array(counts_out, pa.binary())],
                names=["block", "bucket", "n", "check", "size", "ids", "counts"],
            )

    return run


POSITIONS = "block long, doc_ids array<long>, n int, total int, distinct int, check long, counts binary, codes binary, known binary"


def _signed(n):
    """A whole number modulo 2**64, as a signed long."""
    return (n + (1 << 63)) % (1 << 64) - (1 << 63)


def _positions(path, buckets):
    def run(batches):
        for block, batch, words, known, bucket, hashes, code, counts in _numbered(batches, path, buckets):
            cuts = np.searchsorted(bucket, np.arange(buckets + 1))
            check = sum(_check(hashes[a:z]) for a, z in zip(cuts[:-1], cuts[1:]))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([block], pa.int64()),
                    pa.array([batch.column("doc_id").to_pylist()], pa.list_(pa.int64())),
                    pa.array([batch.num_rows], pa.int32()),
                    pa.array([len(code)], pa.int32()),
                    pa.array([len(words)], pa.int32()),
                    pa.array([_signed(check)], pa.int64()),
                    pa.array([_pack(counts.astype(np.uint32))], pa.binary()),
                    pa.array([_pack(code.astype(np.uint32))], pa.binary()),
                    pa.array([_pack(known.astype(np.int32))], pa.binary()),
                ],
                names=["block", "doc_ids", "n", "total", "distinct", "check", "counts", "codes", "known"],
            )

    return run


def _assemble(left, right):
    """Ids of one block's texts from positions and answers."""
    out_ids, out_doc = [], []
    answers = {}
    for row in right.to_pylist():
        answers[row["bucket"]] = row
    for row in left.to_pylist():
        known = _unpack(row["known"], row["distinct"], np.int32).astype(np.int64)
        order = sorted(answers)
        ids = [known[known >= 0].astype(np.uint32)]
        sizes = [np.ones(len(ids[0]), np.int64)]
        for b in order:
            a = answers[b]
            ids.append(_unpack(a["ids"], a["size"], np.uint32))
            sizes.append(_unpack(a["counts"], a["n"], np.uint32).astype(np.int64))
        sizes = np.concatenate(sizes)
        if len(sizes) != len(known) or _signed(sum(a["check"] for a in answers.values())) != row["check"]:
            raise RuntimeError("a block of texts was cut differently when it was read again")
        code = _unpack(row["codes"], row["total"], np.uint32).astype(np.int64)
        ids, n = expand(code, np.concatenate(ids), sizes)
        counts = _unpack(row["counts"], row["n"], np.uint32).astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(n)])[np.cumsum(counts)] if len(counts) else []
        content, start = ids.astype("<u4").tobytes(), 0
        for doc, end in zip(row["doc_ids"], ends):
            out_doc.append(doc)
            out_ids.append(content[4 * start : 4 * int(end)])
            start = int(end)
    return pa.table([pa.array(out_doc, pa.int64()), pa.array([len(x) // 4 for x in out_ids], pa.int64()), pa.array(out_ids, pa.binary())], names=["doc_id", "n_tokens", "ids"])


def encode(spark, docs, path):
    """One row per document: doc_id, n_tokens, ids (little-endian 32-bit)."""
    bound_batches(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(F.col("doc_id").cast("long"), "text")
    asked = texts.mapInArrow(_requests(path, parts), REQUEST)
    answers = asked.repartition(parts, "bucket").mapInArrow(_answers(path), ANSWER)
    positions = texts.mapInArrow(_positions(path, parts), POSITIONS)
    return positions.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        _assemble, "doc_id long, n_tokens long, ids binary"
    )


def decode(encoded, path):
    """Add ``decoded``, the bytes of the ids."""

    def run(batches):
        table = tx.worker_cache(f"bytes {path}", lambda: TokenBytes(path))
        for batch in batches:
            blobs = batch.column("ids")
            decoded = []
            for blob in blobs:
                ids = np.frombuffer(blob.as_py() or b"", "<u4")
                decoded.append(table.decode(ids)[0].tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(decoded, pa.binary())], names=[*batch.schema.names, "decoded"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return encoded.mapInArrow(run, f"{fields}, decoded binary")


def digests(spark, docs, path):
    """Encode, decode, and reduce both to digests."""
    both = decode(encode(spark, docs, path), path)
    return both.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
