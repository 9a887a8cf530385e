"""Quality classifier: supervised subword embeddings.

A document is the mean of learned vectors of its words plus the mean of learned
vectors of its character n-grams (of bytes, across blanks), both hashed into one
table; a word that repeats the one before it counts as one shared word. A
softmax layer on top gives the score. Vectors and output are trained by plain
stochastic gradient descent in numpy on a bounded sample of labelled rows
(``SAMPLE`` documents); scoring covers every whole text. As all steps behind the
table are linear, scoring needs one number per hashed feature.

Defined results: a null or empty text has no features and gets the score of the
bias; texts of any length are scored whole; repeated rows get the same score; a
row without id is scored and counts as not held out; a score at the cut is
predicted 1; without labels, or with labels of one class, the scores are those of
the untrained or the one-sided model; an empty table gives no rows; other columns
are ignored.
"""

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
BITS = 18
DIM = 8
EPOCHS = 8
RATE = 2.0
GRAMS = (2, 3, 4)
#: Features of weight zero added to every mean, so short texts stay near the prior.
SMOOTH = {"gram": 60, "word": 15}


def parts(data, offsets):
    """(buckets, rows) of the n-grams, then of the words."""
    n = len(data)
    shift = np.uint32(32 - BITS)
    last = np.zeros(n, np.int32)  # bytes left in the row after each position
    last[:] = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(n)
    row = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
    for size in GRAMS:
        h = tx.ngrams(data, size) >> shift
        inside = last[: len(h)] >= size
        yield "gram", h[inside], row[: len(h)][inside]
    starts, ends, rows = tx.words(data, offsets)
    word = tx.slice_hash(tx.prefix_hash(data), starts, ends)
    same = np.concatenate([[False], (word[1:] == word[:-1]) & (rows[1:] == rows[:-1])]) if len(word) else np.zeros(0, bool)
    yield "word", np.where(same, 0, (word >> np.uint64(64 - BITS)).astype(np.int64)).astype(np.uint32), rows.astype(np.int32)


def train(texts, labels, seed=7):
    """(table, bias): the logit of a bucket's vector, and of no feature at all."""
    rng = np.random.default_rng(seed)
    examples = []
    for text, y in zip(texts, labels):
        found = {"gram": [], "word": []}
        for kind, bucket, _ in parts(*tx.raw(pa.array([text]))):
            found[kind].append(bucket)
        index, weight = [], []
        for kind, lists in found.items():
            bucket, count = np.unique(np.concatenate(lists), return_counts=True)
            index.append(bucket)
            weight.append(count / (count.sum() + SMOOTH[kind]))
        examples.append((np.concatenate(index).astype(np.int32), np.concatenate(weight).astype(np.float32), int(y)))
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (1 << BITS, DIM)).astype(np.float32)
    out, bias = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
    step, steps = 0, EPOCHS * len(examples)
    for _ in range(EPOCHS):
        for k in rng.permutation(len(examples)):
            index, weight, y = examples[k]
            rate = RATE * (1 - step / steps)
            step += 1
            mean = weight @ vectors[index]
            z = mean @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            back = out @ p
            out -= rate * np.outer(mean, p)
            bias -= 0.1 * rate * p
            # A bucket may be both an n-gram's and a word's.
            np.subtract.at(vectors, index, rate * weight[:, None] * back)
    return vectors @ (out[:, 1] - out[:, 0]), float(bias[1] - bias[0])


def scores(data, offsets, table, bias):
    n = len(offsets) - 1
    total = {k: np.zeros(n) for k in ("gram", "word")}
    count = {k: np.zeros(n) for k in ("gram", "word")}
    for kind, bucket, row in parts(data, offsets):
        total[kind] += np.bincount(row, weights=table[bucket], minlength=n)
        count[kind] += np.bincount(row, minlength=n)
    z = bias + sum(total[k] / (count[k] + SMOOTH[k]) for k in total)
    return 1 / (1 + np.exp(-np.clip(z, -700, 700)))


def fitted(spark, docs, labels, sample_size, folds, held_out):
    bound_batches(spark)
    texts, y = sample.labelled(docs, labels, "quality", folds, held_out, sample_size)
    table, bias = train(texts.to_pylist(), y) if len(y) else (np.zeros(1 << BITS, np.float32), 0.0)
    return spark.sparkContext.broadcast((table, bias))


def classify(spark, docs, labels, sample_size=SAMPLE, folds=4, held_out=2, cut=0.7):
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


def keep(spark, docs, labels, sample_size=SAMPLE, folds=4, held_out=2, cut=0.7):
    """The documents with a score at least ``cut``, with all their columns."""
    model = fitted(spark, docs, labels, sample_size, folds, held_out)

    def run(batches):
        for batch in tx.blocks(batches):
            yield batch.filter(pa.array(scores(*tx.raw(batch.column("text")), *model.value) >= cut))

    return docs.mapInArrow(run, docs.schema)
