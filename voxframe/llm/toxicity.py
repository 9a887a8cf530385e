"""Toxicity classifier with counterfactual regularisation.

Features of a document are the presence of its words and of byte n-grams that
lie inside a word or open one. Those that the training sample ties to the label
beyond chance (a likelihood-ratio test) enter a logistic regression in numpy.
Each labelled text that mentions an identity term gets counterfactuals in which
the term is replaced by the others of the list; the training loss adds the
squared change of the logit between the two (weight ``PENALTY``), so the score
does not move with the group that is named, and a neutral mention stays neutral.

The sample is bounded by ``SAMPLE`` documents (exact repeats count once);
scoring covers every whole text.

Defined results: a null or empty text has no features and gets the score of the
bias; texts of any length are scored whole; repeated rows get the same score; a
row without id is scored and counts as not held out; a score at the cut is
predicted 1; without labels every score is 0.5, with labels of one class, or with
too few for any feature to be kept, it is the share of that label (smoothed where
there is one class only); an empty table gives no rows; other columns are ignored.
"""

import re
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import functions as F

from voxframe.llm import sample
from voxframe.llm import text as tx
from voxframe.session import bound_batches

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SAMPLE = 3000
GRAMS = (4, 5, 6, 7)
MIN_TEXTS = 6
MIN_EVIDENCE = 36.0
PENALTY = 4.0
RIDGE = 0.002
BUCKET_BITS = 22

# Identity terms that are exchanged for one another.
IDENTITY_TERMS = (
    "asian atheist black blind buddhist catholic christian deaf disabled female gay hindu homosexual immigrant "
    "indigenous jewish latino lesbian male migrant muslim protestant queer refugee straight transgender white"
).split()


def features(data, offsets):
    """(hashes, rows) of the words and n-grams, in pieces."""
    data = tx.LOWER[data]
    letter = ((data >= 97) & (data <= 122)) | (data >= 128)
    data = np.where(letter, data, np.uint8(32))
    n = len(data)
    row = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
    left = (np.repeat(offsets[1:], np.diff(offsets)) - np.arange(n)).astype(np.int32)
    # Letters from each position to the next other sign.
    gap = np.append(np.flatnonzero(~letter), n)
    run = (np.repeat(gap, np.diff(np.concatenate([[-1], gap])))[:n] - np.arange(n)).astype(np.int32)
    run = np.minimum(run, left)
    opens = np.zeros(n, np.int32)
    opens[:-1] = np.where(letter[:-1], 0, np.minimum(run[1:] + 1, left[:-1]))
    for size in GRAMS:
        use = np.flatnonzero((run >= size) | (opens >= size))
        yield tx.ngrams(data, size)[use], row[use]
    starts, ends, rows = tx.words(data, offsets)
    if len(starts):
        yield (tx.slice_hash(tx.prefix_hash(data), starts, ends) >> np.uint64(32)).astype(np.uint32), rows.astype(np.int32)


def presence(text):
    """Distinct feature hashes of one text."""
    found = [h for h, _ in features(*tx.raw(pa.array([text], pa.string())))]
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint32)


def evidence(seen, positive, n, n_positive):
    """Likelihood-ratio statistic of a feature against the label, signed."""

    def part(k, m, p):
        return k * np.log(np.maximum(k, 1e-9) / np.maximum(m * p, 1e-9))

    rate = n_positive / n
    g = 2 * (part(positive, seen, rate) + part(seen - positive, seen, 1 - rate))
    return np.where(positive >= seen * rate, g, -g)


def counterfactuals(text, terms=IDENTITY_TERMS):
    """The text with each identity term in it replaced by each other term."""
    pattern = re.compile(r"\b(" + "|".join(map(re.escape, terms)) + r")\b", re.I | re.A)
    named = sorted({m[0].lower() for m in pattern.finditer(text)})
    return [
        re.sub(rf"\b{re.escape(old)}\b", new, text, flags=re.I | re.A) for old in named for new in terms if new != old
    ]


def train(texts, labels, terms=IDENTITY_TERMS, penalty=PENALTY, rounds=500):
    """(hashes, weights, bias) of the selected features, hashes ascending."""
    seen, sets, y, names = set(), [], [], []
    for text, label in zip(texts, labels):
        if text not in seen:
            seen.add(text)
            sets.append(presence(text))
            y.append(label)
            names.append(text)
    y, n = np.array(y), len(sets)
    if n == 0 or y.min() == y.max():
        rate = (y.sum() + 1) / (n + 2)
        return np.zeros(0, np.uint32), np.zeros(0), float(np.log(rate / (1 - rate)))
    bits = np.uint32(32 - BUCKET_BITS)
    count, hits = np.zeros(1 << BUCKET_BITS, np.int32), np.zeros(1 << BUCKET_BITS, np.int32)
    for s, label in zip(sets, y):
        count[s >> bits] += 1
        if label:
            hits[s >> bits] += 1
    likely = (count >= MIN_TEXTS) & (hits >= MIN_TEXTS // 2)
    kept = [s[likely[s >> bits]] for s in sets]
    pool, code = np.unique(np.concatenate(kept), return_inverse=True)
    row = np.repeat(np.arange(n), [len(s) for s in kept])
    total = np.bincount(code, minlength=len(pool))
    positive = np.bincount(code, weights=y[row], minlength=len(pool))
    strong = (total >= MIN_TEXTS) & (evidence(total, positive, n, y.sum()) >= MIN_EVIDENCE)
    new = np.cumsum(strong) - 1
    use = strong[code]
    hashes, row, code = pool[strong], row[use], new[code[use]]
    # Differences between a text and its counterfactuals, on selected features:
    # (which, feature, +1 or -1), equal differences once.
    seen, which, feature, sign = set(), [], [], []
    for text in names:
        base = None
        for other in counterfactuals(text, terms):
            base = np.isin(hashes, presence(text)) if base is None else base
            changed = np.isin(hashes, presence(other))
            at = np.flatnonzero(base != changed).astype(np.int32)
            way = np.where(base[at], np.int8(1), np.int8(-1))
            key = (at.tobytes(), way.tobytes())
            if len(at) and key not in seen:
                which.append(np.full(len(at), len(seen), np.int32))
                feature.append(at)
                sign.append(way)
                seen.add(key)
    which, feature, sign = (np.concatenate(c) if c else np.zeros(0, np.int32) for c in (which, feature, sign))
    n_swaps = len(seen)
    weights, bias = np.zeros(len(hashes)), float(np.log(y.mean() / (1 - y.mean())))
    m, v = np.zeros(len(hashes) + 1), np.zeros(len(hashes) + 1)
    for t in range(1, rounds + 1):
        z = bias + np.bincount(row, weights=weights[code], minlength=n)
        error = 1 / (1 + np.exp(-z)) - y
        grad = np.bincount(code, weights=error[row], minlength=len(hashes)) / n * 20 + RIDGE * weights
        if n_swaps:
            moved = np.bincount(which, weights=sign * weights[feature], minlength=n_swaps)
            grad += 2 * penalty * np.bincount(feature, weights=sign * moved[which], minlength=len(hashes)) / n_swaps
        grad = np.append(grad, error.mean() * 20)
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        step = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
        weights, bias = weights - step[:-1], bias - step[-1]
    z = bias + np.bincount(row, weights=weights[code], minlength=n)
    return hashes, weights, float(bias - _cut(z, y))


def _cut(z, y):
    """The logit that parts the labels best (Youden), in the middle of its gap.

    Only between different logits can a cut lie. Where there are none (no feature
    was kept), or none parts the labels, the logits stay as they are: 0.
    """
    order = np.argsort(z, kind="stable")
    z, y = z[order], y[order]
    gain = np.cumsum(1 - y) / (1 - y).sum() - np.cumsum(y) / y.sum()
    gain = np.where(z[1:] > z[:-1], gain[:-1], -np.inf)
    if not len(gain) or gain.max() <= 0:
        return 0.0
    k = int(np.argmax(gain))
    return (z[k] + z[k + 1]) / 2


def scores(data, offsets, hashes, weights, bias):
    n = len(offsets) - 1
    z = np.full(n, bias)
    if len(hashes):
        bits = np.uint32(32 - BUCKET_BITS)
        maybe = np.zeros(1 << BUCKET_BITS, bool)
        maybe[hashes >> bits] = True
        pairs = []
        for h, row in features(data, offsets):
            use = np.flatnonzero(maybe[h >> bits])
            at = np.minimum(np.searchsorted(hashes, h[use]), len(hashes) - 1)
            right = hashes[at] == h[use]
            pairs.append(row[use][right].astype(np.int64) * len(hashes) + at[right])
        pairs = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
        z += np.bincount(pairs // len(hashes), weights=weights[pairs % len(hashes)], minlength=n)
    return 1 / (1 + np.exp(-np.clip(z, -700, 700)))


def fitted(spark, docs, labels, sample_size, folds, held_out):
    bound_batches(spark)
    texts, y = sample.labelled(docs, labels, "toxic", folds, held_out, sample_size)
    return spark.sparkContext.broadcast(train(texts.to_pylist(), y))


def classify(spark, docs, labels, sample_size=SAMPLE, folds=5, held_out=0, cut=0.5):
    """One row per document: doc_id, held_out, score, predicted."""
    model = fitted(spark, docs, labels, sample_size, folds, held_out)

    def run(batches):
        for batch in tx.blocks(batches):
            score = scores(*tx.raw(batch.column("text")), *model.value)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)], names=["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")
    return scored.select(
        "doc_id",
        F.coalesce(sample.fold("doc_id", folds) == held_out, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= cut).cast("int").alias("predicted"),
    )


def keep(spark, docs, labels, sample_size=SAMPLE, folds=5, held_out=0, cut=0.5):
    """The documents with a score below ``cut``, with all their columns."""
    model = fitted(spark, docs, labels, sample_size, folds, held_out)

    def run(batches):
        for batch in tx.blocks(batches):
            yield batch.filter(pa.array(scores(*tx.raw(batch.column("text")), *model.value) < cut))

    return docs.mapInArrow(run, docs.schema)
