"""Secret scan: fixed patterns and a randomness test battery, all in columns.

Patterns find assignments, access keys and long hexadecimal runs. The battery
looks at every other run of 20 or more characters of the usual encodings. The
encoding (hexadecimal, base 32, 36, 62, 64) is inferred from the characters in
use; against its alphabet three tests ask whether the run could be uniformly
random: chi-squared of the character counts, the runs test above and below the
middle of the alphabet, and lag-1 serial correlation. Fisher's method combines
the three p-values to one.

A high combined p alone proves little for short runs, as the tests lack power
there. So discoveries are controlled by length class: runs of letters alone
(words, by all odds) are tested in the same way as decoys, and each class takes
the lowest cut p >= 0.01 at which the false discoveries are estimated to be at
most ``MAX_FALSE`` of the candidates that pass: the decoys that pass (and one
more), times the candidates that fail all cuts for each decoy that does. Every
distinct run counts once, however often it occurs. A class without a cut of its
own that has fewer than ``THIN`` passing candidates or decoys is pooled with its
neighbours, step by step. The counts behind the cuts cover all documents; where
these hold next to no decoys, a few candidates still prove nothing.

Defined results: a null text is empty and has no spans; a text of any length, with
any number of matches, is scanned whole, in time that grows with both; offsets
count code points, ends are exclusive; equal starts are ordered by kind as listed;
repeated rows and rows without id are scanned as they are; an empty table gives no
rows; other columns are ignored, and ``redact`` keeps them.
"""

import functools
import math

import numpy as np
from pyspark.sql import functions as F

from voxframe.functions.scalar import let
from voxframe.session import ensure_checkpoint_dir

# The patterns of the base kinds, in the order of their rank.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")

# A run of one alphabet as a whole; of a run that mixes both, the parts of either.
RUN = (
    r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/]{20,}+(?![_-])"
    r"|(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20,}+|(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{20,}+"
)
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: (pattern of the whole run, alphabet), narrowest first; decoys have no digit.
ENCODINGS = (
    (r"^(?=.*[0-9])(?=.*[a-f])[0-9a-f]+$", DIGITS + LOWER[:6]),
    (r"^(?=.*[0-9])(?=.*[A-F])[0-9A-F]+$", DIGITS + UPPER[:6]),
    (r"^(?=.*[2-7])(?=.*[A-Z])[A-Z2-7]+$", UPPER + DIGITS[2:8]),
    (r"^(?=.*[0-9])(?=.*[a-z])[a-z0-9]+$", DIGITS + LOWER),
    (r"^(?=.*[0-9])(?=.*[A-Z])[A-Z0-9]+$", DIGITS + UPPER),
    (r"^(?=.*[0-9])(?=.*[A-Za-z])[A-Za-z0-9]+$", DIGITS + UPPER + LOWER),
    (r"^(?=.*[0-9])(?=.*[A-Za-z])[A-Za-z0-9+/]+$", UPPER + LOWER + DIGITS + "+/"),
    (r"^(?=.*[0-9])(?=.*[A-Za-z])[A-Za-z0-9_-]+$", UPPER + LOWER + DIGITS + "-_"),
)
DECOYS = ((r"^[a-z]+$", LOWER), (r"^[A-Z]+$", UPPER), (r"^[A-Za-z]+$", UPPER + LOWER))
LENGTHS = (20, 24, 28, 32, 40, 48, 64, 96)
CUTS = (0.01, 0.02, 0.05, 0.1, 0.2, 0.3, 0.5)
MAX_FALSE = 0.05
THIN = 20


#: Values that one step of a running total adds up.
STEP = 64


def _fold(values, add):
    return F.aggregate(values, F.lit(0), add)


def _running(values, add, use):
    """``use(before)``, where ``before(i)`` combines the first ``i`` of ``values``.

    Totals of 64 values, and of 64 of these, are kept, so a place costs a few
    hundred steps, whatever the number of values; no array grows step by step.
    """

    def blocks(v):
        count = F.ceil(F.size(v) / STEP).cast("int")
        return F.when(
            count > 0, F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda j: _fold(F.slice(v, j * STEP + 1, F.lit(STEP)), add))
        ).otherwise(F.array().cast("array<int>"))

    def place(i, ones, some, many):
        block, whole = F.floor(i / STEP).cast("int"), F.floor(i / STEP**2).cast("int")
        parts = (F.slice(many, F.lit(1), whole), F.slice(some, whole * STEP + 1, block - whole * STEP), F.slice(ones, block * STEP + 1, i - block * STEP))
        return functools.reduce(add, [_fold(part, add) for part in parts])

    return let(
        values, lambda ones: let(blocks(ones), lambda some: let(blocks(some), lambda many: use(lambda i: place(i, ones, some, many))))
    )


def _located(text, pattern, more=None):
    """Structs (start, end, token[, more]) of all matches, in order.

    The pieces between the matches give the offsets: lengths add up.
    """
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    empty = F.array().cast("array<struct<start:int,end:int,token:string,more:string>>")
    both = F.struct(matches.alias("matches"), F.split(text, pattern, -1).alias("pieces"), (more if more is not None else matches).alias("extra"))

    def rows(b):
        n = F.size(b["matches"])
        steps = F.zip_with(b["matches"], F.slice(b["pieces"], F.lit(1), n), lambda m, p: F.char_length(m) + F.char_length(p))

        def row(before, i):
            token = F.get(b["matches"], i)
            end = before(i + 1)
            return F.struct((end - F.char_length(token)).alias("start"), end.alias("end"), token.alias("token"), F.get(b["extra"], i).alias("more"))

        return _running(steps, lambda x, y: x + y, lambda before: F.transform(F.sequence(F.lit(0), n - 1), lambda i: row(before, i)))

    return F.when(text.rlike(pattern), let(both, rows)).otherwise(empty)


def _normal_tail(z):
    """Two-sided tail of the normal distribution (Abramowitz and Stegun 7.1.26)."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return F.greatest(poly * F.exp(-x * x), F.lit(1e-300))


def _with(row, **more):
    """The struct with more fields."""
    return functools.reduce(lambda r, item: r.withField(item[0], item[1]), more.items(), row)


def _tested(tokens):
    """Add ``decoy``, ``n`` and the combined ``p`` to the runs that have an encoding."""

    def inferred(t):
        alphabet, decoy = F.lit(None).cast("string"), F.lit(False)
        for pattern, symbols in reversed(DECOYS):
            alphabet = F.when(t["token"].rlike(pattern), F.lit(symbols)).otherwise(alphabet)
            decoy = F.when(t["token"].rlike(pattern), F.lit(True)).otherwise(decoy)
        for pattern, symbols in reversed(ENCODINGS):
            alphabet = F.when(t["token"].rlike(pattern), F.lit(symbols)).otherwise(alphabet)
        return F.struct(t["start"].alias("start"), t["end"].alias("end"), t["token"].alias("token"), alphabet.alias("alphabet"), decoy.alias("decoy"))

    def coded(t):
        code = F.transform(F.split(t["token"], ""), lambda c: (F.instr(t["alphabet"], c) - 1).cast("double"))
        squares = F.aggregate(
            F.split(t["alphabet"], ""),
            F.lit(0.0),
            lambda s, c: s + F.pow(F.length(t["token"]) - F.length(F.replace(t["token"], c, F.lit(""))), F.lit(2.0)),
        )
        return _with(t, code=code, squares=squares, n=F.length(t["token"]).cast("double"), m=F.length(t["alphabet"]).cast("double"))

    def centred(t):
        mean = F.aggregate(t["code"], F.lit(0.0), lambda s, x: s + x) / t["n"]
        return _with(t, mean=mean, high=F.size(F.filter(t["code"], lambda x: x >= t["m"] / 2)).cast("double"))

    def measured(t):
        head, tail = F.slice(t["code"], 1, F.size(t["code"]) - 1), F.slice(t["code"], 2, F.size(t["code"]) - 1)
        half = t["m"] / 2
        switches = F.size(F.filter(F.zip_with(head, tail, lambda x, y: (x >= half) != (y >= half)), lambda b: b))
        products = F.aggregate(
            F.zip_with(head, tail, lambda x, y: (x - t["mean"]) * (y - t["mean"])), F.lit(0.0), lambda s, x: s + x
        )
        spread = F.aggregate(t["code"], F.lit(0.0), lambda s, x: s + (x - t["mean"]) * (x - t["mean"]))
        return _with(t, runs=switches.cast("double") + 1, products=products, spread=spread)

    def combined(t):
        n, m, free = t["n"], t["m"], t["m"] - 1
        chi2 = t["squares"] * m / n - n
        # Wilson and Hilferty; only uneven counts count against the run.
        z = (F.pow(F.greatest(chi2, F.lit(0.0)) / free, F.lit(1 / 3)) - (1 - 2 / (9 * free))) / F.sqrt(2 / (9 * free))
        p1 = F.when(z > 0, _normal_tail(z) / 2).otherwise(1 - _normal_tail(z) / 2)
        both = 2 * t["high"] * (n - t["high"])
        variance = both * (both - n) / (n * n * (n - 1))
        p2 = F.when(variance > 0, _normal_tail((t["runs"] - both / n - 1) / F.sqrt(variance))).otherwise(F.lit(1e-300))
        p3 = F.when(t["spread"] > 0, _normal_tail(t["products"] / t["spread"] * F.sqrt(n) + 1 / F.sqrt(n))).otherwise(F.lit(1e-300))
        s = -(F.ln(p1) + F.ln(p2) + F.ln(p3))
        return F.struct(
            t["start"].alias("start"),
            t["end"].alias("end"),
            t["decoy"].alias("decoy"),
            F.xxhash64(t["token"]).alias("hash"),
            t["n"].cast("int").alias("n"),
            (F.exp(-s) * (1 + s + s * s / 2)).alias("p"),
        )

    known = F.filter(F.transform(tokens, inferred), lambda t: t["alphabet"].isNotNull())
    for step in (coded, centred, measured, combined):
        known = F.transform(known, step)
    return known


def length_class(n):
    out = F.lit(LENGTHS[0])
    for low in LENGTHS[1:]:
        out = F.when(n >= low, F.lit(low)).otherwise(out)
    return out


def findings(docs):
    """Add ``__base`` (spans of the patterns) and ``__tokens`` (tested runs)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    # A short value fails, but has used up its characters, so it is dropped last.
    assign = F.filter(
        _located(text, ASSIGN, F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))), lambda t: F.length(t["more"]) >= 6
    )

    def spans(found, rank):
        return F.transform(found, lambda t: F.struct(t["start"].alias("start"), F.lit(rank).alias("rank"), t["end"].alias("end")))

    base = F.array_sort(
        F.concat(spans(assign, 0), spans(_located(text, ACCESS), 1), spans(_located(text, HEX), 2))
    )
    return docs.withColumn("__base", base).withColumn("__tokens", _tested(_located(text, RUN)))


def cut_of(counts):
    """The lowest cut at which few enough of the passing candidates are false, or None.

    ``counts`` holds decoys and candidates in all, then those that pass each cut.
    """
    (decoys, passing_decoys), (candidates, passing) = ((side[0], side[1:]) for side in counts)
    null = (candidates - passing[0] + 1) / (decoys - passing_decoys[0] + 1)
    for cut, false, true in zip(CUTS, passing_decoys, passing):
        if true and (1 + false) * null <= MAX_FALSE * true:
            return cut
    return None


def thresholds(found):
    """{length class: cut of p} from the counts of all documents (a bounded table)."""
    t = found.select(F.explode("__tokens").alias("t")).select("t.hash", length_class(F.col("t.n")).alias("length"), "t.decoy", "t.p")
    # Equal runs have equal results: each counts once.
    t = t.groupBy("hash", "length", "decoy").agg(F.max("p").alias("p"))
    sides = [[F.count_if((F.col("decoy") == d) & (F.col("p") >= cut)) for cut in (0.0, *CUTS)] for d in (True, False)]
    counts = {row["length"]: np.array(row["counts"]) for row in t.groupBy("length").agg(F.array(*[F.array(*side) for side in sides]).alias("counts")).collect()}
    none, out = np.zeros((2, 1 + len(CUTS)), np.int64), {}
    for i, length in enumerate(LENGTHS):
        for reach in range(len(LENGTHS)):
            pool = sum((counts.get(near, none) for near in LENGTHS[max(0, i - reach) : i + reach + 1]), none)
            cut = cut_of(pool.tolist())
            if cut is not None:
                out[length] = cut
            if cut is not None or (pool[0, 0] >= THIN and pool[1, 1] >= THIN):
                break
    return out


def all_spans(found, cuts):
    """Add ``__spans``: base spans and the discoveries that touch none of them."""
    def limit(n):
        out = F.lit(2.0)
        for low in LENGTHS:
            out = F.when(n >= low, F.lit(cuts.get(low, 2.0))).otherwise(out)
        return out

    def before(spans, x):
        """How many of the spans, in the order of their starts, start before x."""
        def half(at, step):
            more = (at + step <= F.size(spans)) & (F.get(spans, at + step - 1)["start"] < x)
            return F.when(more, at + step).otherwise(at)

        return F.aggregate(F.array(*[F.lit(1 << b) for b in range(29, -1, -1)]), F.lit(0), half)

    def touches(spans, t):
        # Spans of one kind do not overlap: the last that starts before the end decides.
        last = before(spans, t["end"])
        return (last > 0) & F.coalesce(F.get(spans, last - 1)["end"] > t["start"], F.lit(False))

    def found_new(kinds):
        def new(t):
            free = functools.reduce(lambda x, y: x & y, [~touches(kinds[f"k{rank}"], t) for rank in range(3)])
            return ~t["decoy"] & (t["p"] >= limit(t["n"])) & free

        return F.filter("__tokens", new)

    by_kind = F.struct(*[F.filter("__base", lambda b: b["rank"] == rank).alias(f"k{rank}") for rank in range(3)])
    random = F.transform(
        let(by_kind, found_new), lambda t: F.struct(t["start"].alias("start"), F.lit(3).alias("rank"), t["end"].alias("end"))
    )
    return found.withColumn("__spans", F.array_sort(F.concat("__base", random)))


def written(spans):
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def _count(spans, rank):
    return F.size(F.filter(spans, lambda s: s["rank"] == rank)).cast("long").alias(f"n_{KINDS[rank]}")


def scan(spark, docs):
    """One row per document: doc_id, counts by kind, base_sha256, spans."""
    ensure_checkpoint_dir(spark)
    found = findings(docs.select("doc_id", "text")).drop("text").checkpoint()
    spans = all_spans(found, thresholds(found))
    n = [_count("__base", rank) for rank in range(3)]
    return spans.select(
        "doc_id",
        *n,
        _count("__spans", 3),
        F.sha2(written("__base"), 256).alias("base_sha256"),
        written("__spans").alias("spans"),
    )


def _masked(text, spans, mask):
    """The text with ``mask`` for each maximal union of spans, in order of start."""
    ends = F.transform(spans, lambda s: s["end"])

    def pieces(read):
        def use(before):
            def piece(s, i):
                at = before(i)
                return F.when(s["start"] >= at, F.concat(read(at, s["start"] - at), F.lit(mask))).otherwise("")

            last = before(F.size(spans))
            return F.concat(F.array_join(F.transform(spans, piece), ""), read(last, F.char_length(text) - last))

        return _running(ends, lambda x, y: F.greatest(x, y), use)

    # Reading at a place walks there from the start of a text; where many places
    # are read, its characters are laid out once.
    many = let(F.split(text, ""), lambda chars: pieces(lambda at, n: F.array_join(F.slice(chars, at + 1, n), "")))
    return F.when(F.size(spans) > STEP, many).otherwise(pieces(lambda at, n: F.substring(text, at + 1, n)))


def redact(docs, mask="[SECRET]"):
    """The documents with every span replaced by ``mask``; columns as before."""
    ensure_checkpoint_dir(docs.sparkSession)
    found = findings(docs).checkpoint()
    spans = all_spans(found, thresholds(found))
    text = F.col("text")
    masked = let(F.col("__spans"), lambda s: _masked(text, s, mask))
    return spans.withColumn("text", F.when(F.size("__spans") > 0, masked).otherwise(text)).select(*docs.columns)
