"""Vectorised text helpers for the Arrow stages of this subpackage.

Every helper sees a few megabytes of whole texts at a time (``blocks``), so the
memory of a task does not depend on the number of rows Spark puts in a batch.
"""

import sys
import types

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import cloudpickle

# Send the helpers with the functions: executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK_BYTES = 1 << 20
MULTIPLIER = 0x9E3779B97F4A7C15 | 1


def worker_cache(key, build):
    """A value built once per Python worker (functions arrive anew with each task)."""
    module = sys.modules.setdefault("_voxframe_llm_cache", types.ModuleType("_voxframe_llm_cache"))
    if key not in module.__dict__:
        module.__dict__[key] = build()
    return module.__dict__[key]


def raw(column):
    """Bytes and offsets of a string column; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if len(offsets) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def valid(data, offsets):
    """The same texts in UTF-8: in each, bytes that are none become U+FFFD."""
    try:
        data.tobytes().decode()
        first = offsets[:-1][offsets[:-1] < len(data)]
        if not ((data[first] & 0xC0) == 0x80).any():
            return data, offsets
    except UnicodeDecodeError:
        pass
    rows = [data[a:z].tobytes().decode("utf-8", "replace").encode() for a, z in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
    return np.frombuffer(b"".join(rows), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in rows], dtype=np.int64)])


def blocks(batches, name="text", limit=BLOCK_BYTES):
    """Cut record batches at whole rows into blocks of about ``limit`` text bytes."""
    for batch in batches:
        _, offsets = raw(batch.column(name))
        first, n = 0, batch.num_rows
        while first < n:
            last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
            last = min(max(last, first + 1), n, first + 20_000)
            yield batch.slice(first, last - first)
            first = last
    pa.default_memory_pool().release_unused()


def mix(h):
    """Finaliser that spreads every input bit over a 64-bit hash."""
    h = np.asarray(h, np.uint64)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(n):
    """Powers of the hash multiplier and of its inverse modulo 2**64."""

    def build(size):
        inverse = pow(MULTIPLIER, -1, 1 << 64)
        out = []
        for base in (MULTIPLIER, inverse):
            x = np.full(size, base & (2**64 - 1), np.uint64)
            x[0] = 1
            out.append(np.cumprod(x, dtype=np.uint64))
        return out

    size = (int(n) // (1 << 20) + 1) << 20
    return worker_cache(f"powers{size}", lambda: build(size))


def prefix_hash(data):
    """Running polynomial sums: slices of ``data`` get hashes by ``slice_hash``."""
    power, _ = _powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    out[1:] = data
    out[1:] += np.uint64(1)
    out[1:] *= power[: len(data)]
    return np.cumsum(out, out=out)


def slice_hash(prefix, starts, ends):
    """Hash of ``data[start:end]`` for each slice, whatever its position."""
    _, inverse = _powers(len(prefix))
    return mix((prefix[ends] - prefix[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def words(data, offsets):
    """Starts, ends and row numbers of the runs without the six ASCII spaces."""
    n = len(data)
    if n == 0:
        zero = np.zeros(0, np.int64)
        return zero, zero, zero
    ink = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], ink[:-1]])
    after = np.concatenate([ink[1:], [False]])
    starts = np.flatnonzero(ink & (~before | edge[:n]))
    ends = np.flatnonzero(ink & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


#: A-Z to a-z, other bytes unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def ngrams(data, n):
    """32-bit hashes of all windows of ``n`` bytes (one per start position)."""
    m = len(data) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint32)
    out = np.full(m, n, np.uint32)
    for j in range(n):
        out *= np.uint32(0x01000193)
        out += data[j : j + m]
        out ^= out << np.uint32(7)
    out ^= out >> np.uint32(15)
    out *= np.uint32(0x2C1B3C6D)
    out ^= out >> np.uint32(12)
    return out


def _class_table():
    """Character class of each code point: 0 space, 1 letter, 2 number, 3 other."""
    table = np.full(0x110000, 3, np.uint8)
    points = "".join(chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000)
    for code, pattern in ((1, r"\p{L}+"), (2, r"\p{N}+"), (0, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, points):
            low, high = ord(m[0][0]), ord(m[0][-1])
            if high - low + 1 == len(m[0]):
                table[low : high + 1] = code
            else:
                table[[ord(x) for x in m[0]]] = code
    return table


def pieces(data, offsets):
    """Byte starts, byte ends and row numbers of the pre-tokens of each text.

    The same cuts as the published pattern of the rank files: contractions, runs
    of letters, numbers or other signs with one leading space, and white space
    of which the last character is left to what follows. Every row is cut alone.
    """
    n = len(data)
    if n == 0:
        zero = np.zeros(0, np.int64)
        return zero, zero, zero
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    if len(lead) != len(points):
        raise ValueError("a text is not valid UTF-8")
    kind = worker_cache("classes", _class_table)[points]
    m = len(points)
    first = np.zeros(m + 1, bool)
    row_start = np.searchsorted(lead, offsets)
    first[row_start] = True
    first[m] = True
    change = np.concatenate([[True], kind[1:] != kind[:-1]])
    start = change | first[:m]
    # White space before something else: its last character starts a piece of
    # its own, or goes with what follows if it is a blank.
    i = np.flatnonzero(change & ~first[:m] & (kind != 0))
    i = i[kind[i - 1] == 0]
    start[i - 1] = True
    start[i] = points[i - 1] != 32
    # Contractions take the letters after an apostrophe that starts a piece.
    i = np.flatnonzero((points == 39) & start)
    i = i[i + 1 < m]
    i = i[~first[i + 1]]
    if len(i):
        one = points[i + 1]
        j = np.minimum(i + 2, m - 1)
        two = np.where((i + 2 < m) & ~first[np.minimum(i + 2, m)], points[j], 0)
        size = np.where(np.isin(one, [ord(x) for x in "stmd"]), 1, 0)
        size = np.where(((one == ord("r")) | (one == ord("v"))) & (two == ord("e")), 2, size)
        size = np.where((one == ord("l")) & (two == ord("l")), 2, size)
        i, size = i[size > 0], size[size > 0]
        start[i + 1] = False
        rest = i + 1 + size
        start[rest[rest < m]] = True
    at = np.flatnonzero(start)
    starts = lead[at]
    ends = np.append(starts[1:], n)
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1
