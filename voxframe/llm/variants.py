"""Spelling variants by composition of finite-state machines.

Words that differ by one inserted, deleted or replaced letter are the pairs that
the vocabulary acceptor, composed with a one-edit transducer and the acceptor
again, accepts.

1. Words are counted block by block and summed by a shuffle of partial counts.
2. The vocabulary is parted by the initial states of the machines. Cut the longer
   word of a pair in halves: the edit lies in one of them, and the other half is
   the same in both. So all words that share a half (and a length, or one letter
   less) start from one state, the one reached by that half, and only the rest of
   them is left to accept. A word is in four such parts. A part that holds too
   many words has its rest cut in halves again, which loses no pair; a rest of one
   letter has at most as many words as the alphabet has letters. Whether a part is
   too large is read off a table of fixed size.
3. A part builds the minimised acceptors of its long and short rests: equal right
   languages are one state. The composition is walked state by state: equal
   letters keep the transducer in its first state, an edit takes it to its second,
   in which both acceptors must agree to the end. States are solved once each.
4. Each word gathers the number of its near words and the most frequent of them;
   forms are followed to their last by pointer doubling, in as many rounds as the
   largest count allows.

Defined results: null and empty texts have no words; bytes that are no UTF-8
part words; a run of any length is one word; rows repeated with one id count
each; a row without id has the empty id in the hash; ties of the largest count go
to the smallest word in code-point order; an empty table gives no words; other
columns, of whatever name, are ignored.
"""

import collections
import itertools
import math
import re
import sys
import zlib

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import functions as F

from voxframe.llm import text as tx
from voxframe.session import bound_batches, ensure_checkpoint_dir

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# What a run of letters is.
LETTERS = "[A-Za-zÀ-ÿ]+"
LEAST_LETTERS, LEAST_COUNT, RATIO = 6, 5, 5
#: Distinct words that a task counts before it hands them on.
HELD = 100_000
#: Buckets of the table of part sizes (8 MB at most), and the largest bucket that
#: is not cut again. Bucket numbers depend on the part alone.
BUCKETS, LARGEST = 1 << 20, 20_000
LOWER_BYTES = tx.LOWER.tobytes()


def letter_runs(batch):
    """(id as text, its lower-cased letter runs) of each row of a batch."""
    runs = re.compile(LETTERS)
    content, offsets = tx.raw(batch.column("text"))
    content = content.tobytes().translate(LOWER_BYTES)
    for i, (a, z) in zip(batch.column("doc_id").to_pylist(), zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        yield "" if i is None else str(i), runs.findall(content[a:z].decode("utf-8", "replace"))


def planted(key, run, every):
    """The run as it counts: where ``every`` divides its hash, a letter is missing."""
    h = zlib.crc32(run.encode(), zlib.crc32(f"{key}:".encode()))
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(docs, every=199, letters=LEAST_LETTERS, least=LEAST_COUNT):
    """(word, n) of the words with enough letters and occurrences."""

    def run(batches):
        held = collections.Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        for batch in tx.blocks(batches):
            for key, runs in letter_runs(batch):
                for word, n in collections.Counter(runs).items():
                    if len(word) >= letters and len(word := planted(key, word, every)) >= letters:
                        held[word] += n
                if len(held) >= HELD:
                    yield out()
                    held.clear()
        yield out()

    counted = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def _parted(rows):
    """Add the key of a part: class, place and what its words share."""
    start, tail = F.col("start"), F.col("word").substr(F.col("end") + 1 - F.when(F.col("long"), 0).otherwise(1), F.length("word"))
    shared = F.concat_ws(" ", F.col("size"), start, F.col("end"), F.substring("word", F.lit(1), start), tail)
    return rows.withColumn("key", F.unhex(F.md5(shared)))


def parts(words):
    """Rows (word, n, size, long, start, end, key): a word in each of its parts.

    ``size`` is the length of the longer words of the part, which this word has
    (``long``) or falls short of by one. ``start`` and ``end`` bound the letters
    of the longer words that are not shared.
    """
    size = F.explode(F.array(F.struct(F.length("word").alias("size"), F.lit(True).alias("long")), F.struct((F.length("word") + 1).alias("size"), F.lit(False).alias("long"))))
    rows = words.select("word", "n", size.alias("s")).select("word", "n", "s.*")
    return _parted(_halves(rows.withColumn("start", F.lit(0)).withColumn("end", F.col("size"))))


def _halves(rows):
    middle = ((F.col("start") + F.col("end")) / 2).cast("int")
    halves = F.array(F.struct(F.col("start").alias("start"), middle.alias("end")), F.struct(middle.alias("start"), F.col("end").alias("end")))
    return rows.withColumn("half", F.explode(halves)).select("word", "n", "size", "long", "half.start", "half.end")


def refined(rows, largest=LARGEST, buckets=BUCKETS):
    """Cut the rest of crowded parts in halves until no part is crowded."""
    bucket = F.pmod(F.xxhash64("key"), F.lit(buckets))
    done = None
    while True:
        rows = rows.withColumn("bucket", bucket).checkpoint()
        crowded = rows.groupBy("bucket").agg(F.count("*").alias("rows")).filter(F.col("rows") > largest).select("bucket")
        # A rest of one letter has no more words than letters: nothing to cut.
        marked = rows.join(F.broadcast(crowded.withColumn("crowded", F.lit(True))), "bucket", "left")
        cut = F.coalesce("crowded", F.lit(False)) & (F.col("end") - F.col("start") > 1)
        settled = marked.filter(~cut).drop("bucket", "crowded")
        done = settled if done is None else done.unionAll(settled)
        again = marked.filter(cut).drop("bucket", "crowded", "key")
        if again.isEmpty():
            return done
        rows = _parted(_halves(again))


class Acceptor:
    """Minimised acceptors of words of one length, with a common register.

    A state is its number; ``arcs[state]`` are its letters and the states after
    them. States with the same arcs are one, so a state is its right language.
    """

    END = 0

    def __init__(self):
        self.arcs, self.number = [()], {(): 0}
        self.tails, self.both = {0: [""]}, {}

    def state(self, words, at=0):
        """The state that accepts the sorted, distinct ``words`` from ``at`` on."""
        if at == len(words[0]):
            return self.END
        arcs, first = [], 0
        for i in range(1, len(words) + 1):
            if i == len(words) or words[i][at] != words[first][at]:
                arcs.append((words[first][at], self.state(words[first:i], at + 1)))
                first = i
        key = tuple(arcs)
        found = self.number.get(key)
        if found is None:
            found = self.number[key] = len(self.arcs)
            self.arcs.append(key)
        return found

    def language(self, p):
        found = self.tails.get(p)
        if found is None:
            found = self.tails[p] = [a + x for a, q in self.arcs[p] for x in self.language(q)]
        return found

    def common(self, p, q):
        """What both states accept: the transducer has made its edit."""
        if p == q:
            return self.language(p)
        key = (p, q) if p < q else (q, p)
        found = self.both.get(key)
        if found is None:
            other = dict(self.arcs[q])
            found = self.both[key] = [a + x for a, s in self.arcs[p] if a in other for x in self.common(s, other[a])]
        return found


def replacements(machine, p, solved):
    """Pairs of words from state ``p`` that differ in one letter, the smaller first."""
    found = solved.get(p)
    if found is None:
        arcs = machine.arcs[p]
        found = [(a + x, a + y) for a, q in arcs for x, y in replacements(machine, q, solved)]
        for i, (a, q) in enumerate(arcs):
            for b, r in arcs[i + 1 :]:
                found += [(a + x, b + x) for x in machine.common(q, r)]
        solved[p] = found
    return found


def deletions(machine, p, q, solved):
    """Pairs (x, y): y is x, from ``p``, without one letter, and accepted from ``q``.

    Of the letters of a repeat the last counts as deleted, so a pair is met once.
    """
    key = (p, q)
    found = solved.get(key)
    if found is None:
        other = dict(machine.arcs[q])
        found = [(a + x, a + y) for a, s in machine.arcs[p] if a in other for x, y in deletions(machine, s, other[a], solved)]
        for a, s in machine.arcs[p]:
            found += [(a + x, x) for x in machine.common(s, q) if not x.startswith(a)]
        solved[key] = found
    return found


def near_in_part(long, short):
    """Index pairs of near words: among ``long``, and between ``long`` and ``short``.

    The words are given without what they share, all of one length and all of
    one letter less.
    """
    machine = Acceptor()
    p = machine.state(sorted(long))
    place = {x: i for i, x in enumerate(long)}
    same = [(place[x], place[y]) for x, y in replacements(machine, p, {})]
    less = []
    if short:
        q = machine.state(sorted(short))
        place_short = {y: i for i, y in enumerate(short)}
        less = [(place[x], place_short[y]) for x, y in deletions(machine, p, q, {})]
    return same, less


def _solve(rows):
    """Rows (word, n_near, near_n, near) of one part."""
    long, short = [r for r in rows if r["long"]], [r for r in rows if not r["long"]]
    if not long or len(rows) < 2:
        return
    start, end = rows[0]["start"], rows[0]["end"]
    a, b = [r["word"][start:end] for r in long], [r["word"][start : end - 1] for r in short]
    # A repeated letter that goes on behind the part is deleted in another part.
    after = long[0]["word"][end : end + 1]
    head, tail = _shared(a + b) if end - start > 64 else (0, 0)
    same, less = near_in_part([x[head : len(x) - tail] for x in a], [x[head : len(x) - tail] for x in b])
    pairs = [(long[i], long[j]) for i, j in same]
    pairs += [(long[i], short[j]) for i, j in less if not (after and a[i] == b[j] + after)]
    count, best = collections.Counter(), {}
    for x, y in pairs:
        for u, v in ((x, y), (y, x)):
            word, mark = u["word"], (-v["n"], v["word"])
            count[word] += 1
            best[word] = min(best.get(word, mark), mark)
    for word, n in count.items():
        yield word, n, -best[word][0], best[word][1]


def _shared(words):
    """Letters that all words begin and end with, at most all but one of the shortest."""
    low, high, least = min(words), max(words), min(map(len, words)) - 1
    head = 0
    while head < least and low[head] == high[head]:
        head += 1
    turned = [w[::-1] for w in words]
    low, high, tail = min(turned), max(turned), 0
    while tail < least - head and low[tail] == high[tail]:
        tail += 1
    return max(head, 0), max(tail, 0)


def _compose(batches):
    """Solve the parts of a task one by one; its rows are sorted by part."""
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 1 << 20))
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
    rows, out = (row for batch in batches for row in batch.to_pylist()), []
    for _, part in itertools.groupby(rows, key=lambda row: row["key"]):
        out += _solve(list(part))
        if len(out) >= 10_000:
            yield _batch(out, kinds)
            out = []
    yield _batch(out, kinds)


def _batch(rows, kinds):
    columns = zip(*rows) if rows else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["word", "n_near", "near_n", "near"])


def near_words(words, largest=LARGEST, buckets=BUCKETS):
    """(word, n_near, near_n, near) of the words that have near words."""
    rows = refined(parts(words), largest, buckets).repartition("key").sortWithinPartitions("key")
    found = rows.select("key", "word", "n", "size", "long", "start", "end").mapInArrow(_compose, "word string, n_near long, near_n long, near string")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select(
        "word", "n_near", (-F.col("best.less")).alias("near_n"), F.col("best.near").alias("near")
    )


def roots(forms, most, ratio=RATIO):
    """(word, root): the last form that is reached from each word with a form.

    ``forms`` has (word, form); counts grow by ``ratio`` with every step, so
    the largest count ``most`` bounds the steps. Each round doubles them.
    """
    steps = math.ceil(math.log(max(most, 1), ratio)) + 1
    rows = forms.select("word", F.col("form").alias("root"))
    for _ in range(max(steps, 2).bit_length()):
        further = rows.select(F.col("word").alias("root"), F.col("root").alias("last"))
        rows = rows.join(further, "root", "left").select("word", F.coalesce("last", "root").alias("root")).checkpoint()
    return rows


def group_variants(spark, docs, every=199, letters=LEAST_LETTERS, least=LEAST_COUNT, ratio=RATIO):
    """One row per word: word, form, root, n, n_near, form_n."""
    ensure_checkpoint_dir(spark)
    bound_batches(spark)
    words = word_counts(docs, every, letters, least).checkpoint()
    near = near_words(words).withColumnRenamed("word", "w")
    likely = F.col("near_n") >= ratio * F.col("n")
    rows = (
        words.join(near, F.col("word") == F.col("w"), "left")
        .select(
            "word",
            F.when(likely, F.col("near")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            F.when(likely, F.col("near_n")).alias("form_n"),
        )
        .checkpoint()
    )
    most = rows.agg(F.max("n")).first()[0]
    last = roots(rows.filter("form IS NOT NULL"), most or 1, ratio).withColumnRenamed("word", "w")
    return rows.join(last, F.col("word") == F.col("w"), "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
