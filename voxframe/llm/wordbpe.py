"""BPE with word ends: a segment tree over the ranks of adjacent pairs.

A vocabulary file names the special tokens, the normaliser (NFC, lower case), the
cuts (contractions, runs of letters, single numbers, runs of other signs; white
space goes) and the ranked merges. ``encode`` follows it for whole texts:

1. Special tokens are found in the raw text; what lies between is normalised and
   cut. Character classes and normalisation come from the rules of the file's
   own library, so its Unicode version decides.
2. The distinct words of a block are encoded once each. A word is a row of byte
   symbols, its last with the word end. The leaves of a segment tree hold
   (rank, position) of each adjacent pair, inner nodes the smaller of their two
   children: the root is the leftmost pair of the lowest rank. Merging it
   changes three leaves, each a path to the root; it ends when no pair at the
   root can be merged. A word of n bytes costs O(n log n), whatever its length.
3. Ids go back to all occurrences by their position.

``decode`` joins the token strings by one blank, as a file without decoder asks.
There is no shuffle: memory is one block of texts and a bounded table of words.

Defined results: a null or empty text has no ids and decodes to the empty text;
bytes that are no UTF-8 count as U+FFFD; a text of any length is one unit and is
never cut; equal texts get equal ids, ties of rank go to the leftmost pair;
repeated rows and null ids stay as they are; an empty table gives an empty one;
other columns, of whatever name, are ignored.
"""

import itertools
import json
import re
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import functions as F

from voxframe.llm import bpe
from voxframe.llm import text as tx
from voxframe.session import bound_batches

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Words whose ids a worker remembers; the table is emptied when it is full.
REMEMBERED = 1 << 18
NONE = 1 << 62
POSITION = (1 << 32) - 1


def byte_signs():
    """The printable sign that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    signs = {b: chr(b) for b in plain}
    for b in range(256):
        signs.setdefault(b, chr(256 + len(signs) - len(plain)))
    return signs


class Vocabulary:
    """Tokens, merges and special tokens of one file."""

    def __init__(self, path):
        with open(path, encoding="utf-8") as lines:
            file = json.load(lines)
        ids, end = file["model"]["vocab"], file["model"]["end_of_word_suffix"]
        added = {t["content"]: t["id"] for t in file["added_tokens"]}
        signs = byte_signs()
        self.inner = [ids[signs[b]] for b in range(256)]
        self.last = [ids[signs[b] + end] for b in range(256)]
        self.rank, self.made = {}, []
        for a, b in file["model"]["merges"]:
            self.rank.setdefault((ids[a], ids[b]), len(self.made))
            self.made.append(ids[a + b])
        self.special = re.compile("|".join(sorted(map(re.escape, added), key=len, reverse=True)))
        self.special_id = added
        table = {i: t for t, i in (ids | added).items()}
        tokens = [table.get(i, "").encode() for i in range(max(table) + 1)]
        self.sizes = np.array([len(t) + 1 for t in tokens], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(t + b" " for t in tokens), np.uint8)
        self.seen = {}

    def merge(self, word):
        """Ids of one word: the lowest, then leftmost pair merges until none can."""
        sym = [self.inner[b] for b in word]
        sym[-1] = self.last[word[-1]]
        n = len(sym)
        if n == 1:
            return sym
        rank, made = self.rank, self.made
        size = 1 << (n - 2).bit_length()
        tree = [NONE] * (2 * size)
        for i in range(n - 1):
            r = rank.get((sym[i], sym[i + 1]))
            if r is not None:
                tree[size + i] = r << 32 | i
        for i in range(size - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while (top := tree[1]) < NONE:
            i = top & POSITION
            j = after[i]
            sym[i], sym[j] = made[top >> 32], None
            k = after[i] = after[j]
            h = before[i]
            changed = [(j, None), (i, None if k >= n else rank.get((sym[i], sym[k])))]
            if k < n:
                before[k] = i
            if h >= 0:
                changed.append((h, rank.get((sym[h], sym[i]))))
            for at, r in changed:
                if at == n - 1:  # the last symbol starts no pair
                    continue
                node = size + at
                best = NONE if r is None else r << 32 | at
                while tree[node] != best:
                    tree[node] = best
                    if node == 1:
                        break
                    best = min(best, tree[node ^ 1])
                    node >>= 1
        return [s for s in sym if s is not None]

    def ids(self, word):
        found = self.seen.get(word)
        if found is None:
            if len(self.seen) >= REMEMBERED:
                self.seen.clear()
            found = self.seen[word] = self.merge(word)
        return found

    def decode(self, ids):
        """The token strings of one text, joined by one blank."""
        size = self.sizes[ids]
        end = np.cumsum(size)
        if not len(end):
            return ""
        at = np.repeat(self.starts[ids] - (end - size), size) + np.arange(int(end[-1]))
        return self.bytes[at[:-1]].tobytes().decode()


def vocabulary(path):
    return tx.worker_cache(f"vocabulary {path}", lambda: Vocabulary(path))


def class_runs():
    """(first code point, class) of the runs of equal class, from the library.

    0 white space, 1 letter, 2 number, 3 other. A few thousand numbers that are
    made once, on the driver, and travel with the tasks.
    """

    def build():
        from tokenizers import Regex, pre_tokenizers

        points = "".join(chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000)
        table = np.full(0x110000, 3, np.uint8)
        for code, pattern in ((1, r"\p{L}+"), (2, r"\p{N}+"), (0, r"\s+")):
            for run, _ in pre_tokenizers.Split(Regex(pattern), "removed", invert=True).pre_tokenize_str(points):
                table[np.frombuffer(run.encode("utf-32-le"), np.uint32)] = code
        first = np.flatnonzero(np.concatenate([[True], table[1:] != table[:-1]]))
        return first, table[first]

    return tx.worker_cache("class runs", build)


def class_table(runs):
    first, code = runs
    return tx.worker_cache("class table", lambda: np.repeat(code, np.diff(np.append(first, 0x110000))))


def normalised(text):
    """NFC and lower case, as the library's normaliser does."""
    if text.isascii():
        return text.lower()

    def build():
        from tokenizers import normalizers

        return normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])

    return tx.worker_cache("normaliser", build).normalize_str(text)


def cuts(data, offsets, kinds):
    """Byte starts, byte ends and rows of the words of normalised texts."""
    if not len(data):
        zero = np.zeros(0, np.int64)
        return zero, zero, zero
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    kind, m = kinds[points], len(points)
    first = np.zeros(m + 1, bool)
    first[np.searchsorted(lead, offsets)] = True
    start = first[:m] | (kind == 2) | np.concatenate([[True], kind[1:] != kind[:-1]])
    # A contraction takes letters after an apostrophe at which a match begins.
    i = np.flatnonzero((points == 39) & start)
    i = i[i + 1 < m]
    i = i[~first[i + 1]]
    if len(i):
        one = points[i + 1]
        two = np.where((i + 2 < m) & ~first[np.minimum(i + 2, m)], points[np.minimum(i + 2, m - 1)], 0)
        size = np.where(np.isin(one, [ord(x) for x in "stmd"]), 1, 0)
        size = np.where(((one == ord("r")) | (one == ord("v"))) & (two == ord("e")), 2, size)
        size = np.where((one == ord("l")) & (two == ord("l")), 2, size)
        i, size = i[size > 0], size[size > 0]
        start[i + 1] = False
        rest = i + 1 + size
        start[rest[rest < m]] = True
    at = np.flatnonzero(start)
    starts, ends = lead[at], np.append(lead[at[1:]], len(data))
    ink = kind[at] != 0
    starts, ends = starts[ink], ends[ink]
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def encode_block(texts, path, runs):
    """Ids of all texts in a row, and the number of ids of each."""
    vocab = vocabulary(path)
    parts, row, special = [], [], []
    for i, text in enumerate(texts):
        at = 0
        for found in vocab.special.finditer(text) if "<" in text else ():
            parts.append(normalised(text[at : found.start()]).encode())
            special.append((len(parts), vocab.special_id[found[0]], i))
            row.append(i)
            at = found.end()
        parts.append(normalised(text[at:]).encode())
        row.append(i)
    data = np.frombuffer(b"".join(parts), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts], dtype=np.int64)]).astype(np.int64)
    starts, ends, part = cuts(data, offsets, class_table(runs))
    hashes = tx.slice_hash(tx.prefix_hash(data), starts, ends)
    _, first, code = np.unique(hashes, return_index=True, return_inverse=True)
    content = data.tobytes()
    words = [vocab.ids(content[a:z]) for a, z in zip(starts[first].tolist(), ends[first].tolist())]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ids = np.fromiter(itertools.chain.from_iterable(words), np.int32, int(sizes.sum()))
    ids, n = bpe.expand(code, ids, sizes)
    of_part = np.bincount(part, weights=n, minlength=len(parts)).astype(np.int64)
    counts = np.bincount(np.array(row, np.int64), weights=of_part, minlength=len(texts)).astype(np.int64)
    if special:
        after, token, text = map(np.array, zip(*special))
        ids = np.insert(ids, np.cumsum(of_part)[after - 1], token)
        counts += np.bincount(text, minlength=len(texts))
    return ids, counts


def strings(column):
    """Texts of a column; null is empty, bytes that are no UTF-8 are replaced."""
    column = column.cast(pa.binary()) if not pa.types.is_large_string(column.type) else column.cast(pa.large_binary())
    return [(x.as_py() or b"").decode("utf-8", "replace") for x in column]


def encode(spark, docs, path):
    """One row per document: doc_id, n_tokens, ids."""
    bound_batches(spark)
    runs = class_runs()

    def run(batches):
        for batch in tx.blocks(batches):
            ids, counts = encode_block(strings(batch.column("text")), path, runs)
            offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids, pa.int32()))],
                names=["doc_id", "n_tokens", "ids"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids array<int>")


def decode(encoded, path):
    """Add ``decoded``, the text of the ids."""

    def run(batches):
        vocab = vocabulary(path)
        for batch in batches:
            decoded = [vocab.decode(np.asarray(x.values if x.is_valid else [], np.int64)) for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(decoded, pa.string())], names=[*batch.schema.names, "decoded"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return encoded.mapInArrow(run, f"{fields}, decoded string")


def digests(spark, docs, path):
    """Encode, decode, and reduce both to digests."""
    both = decode(encode(spark, docs, path), path)
    return both.select(
        "doc_id",
        "n_tokens",
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
