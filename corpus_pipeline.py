"""Corpus pipeline: classify, filter, deduplicate, redact and pack documents.

Each stage is one function of ``STAGES``: (spark, docs, sf_dir) -> DataFrame. All
but the last return the columns of their input. ``run`` writes every stage as
Parquet in the shared folder and reads it back as the next one's input, so no
stage is ever computed twice and a lost executor costs one stage at most.

* quality: documents scored below 0.7 go; repeated texts are scored alike.
* toxicity: documents scored 0.5 or more go.
* near_dedup: of each class of near duplicates (five words, 0.8) the document
  with the smallest id stays; documents without id or words are no duplicates.
* secrets: spans of secrets become ``[SECRET]``; no document goes.
* packing: token pieces of all documents, in sequences of at most 2048 ids.

Null and empty texts pass all filters that their scores pass; an empty table
gives empty stages; further columns are carried along up to the last stage.
"""

import public_tokenizers

from voxframe.llm import neardup, packing, quality, secrets, toxicity
from voxframe.session import scratch_dir

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def _labels(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def keep_quality(spark, docs, sf_dir):
    return quality.keep(spark, docs, _labels(spark, sf_dir))


def drop_toxic(spark, docs, sf_dir):
    return toxicity.keep(spark, docs, _labels(spark, sf_dir))


def near_dedup(spark, docs, sf_dir):
    return neardup.keep_one(spark, docs)


def redact_secrets(spark, docs, sf_dir):
    return secrets.redact(docs)


def pack(spark, docs, sf_dir):
    return packing.pack(spark, docs, RANKS)


STAGES = [
    ("quality", keep_quality),
    ("toxicity", drop_toxic),
    ("near_dedup", near_dedup),
    ("secrets", redact_secrets),
    ("packing", pack),
]

#: Trained models and hashing decide here; no SQL equivalent.
ORACLE_SQL = None


def run(spark, sf_dir):
    folder = scratch_dir(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
