"""The stages of the corpus pipeline, and what they keep."""

import collections
import inspect
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_operators import ODD, clashing, docs_of
from voxframe.llm import neardup, quality, queries, secrets, toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    """Every stage's output, written and read again."""
    folder, out = tmp_path_factory.mktemp("stages"), []
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out.append(docs)
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
        out.append(docs)
    return out


def test_stages_are_named_and_take_three_arguments():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "near_dedup", "secrets", "packing"]
    assert all(list(inspect.signature(f).parameters) == ["spark", "docs", "sf_dir"] for _, f in corpus_pipeline.STAGES)


def test_each_stage_works_on_what_the_last_one_kept(stages):
    rows = [collections.Counter(map(tuple, d.select("doc_id", "text").collect())) for d in stages[:4]]
    assert all(d.columns == COLUMNS for d in stages[:5])
    for before, after in zip(rows, rows[1:]):
        assert not after - before
    kept = {r.doc_id for r in stages[3].collect()}
    assert kept == {r.doc_id for r in stages[4].collect()}
    assert kept == {r.doc_id for r in stages[5].collect()}
    assert not secrets.findings(stages[4]).filter("size(__base) > 0").count()


def test_no_near_duplicates_stay(spark, stages):
    again = neardup.near_duplicates(spark, stages[3])
    assert again.filter("not kept").count() == 0


def test_run_equals_its_stages(spark, sf_dir, stages):
    got = corpus_pipeline.run(spark, sf_dir)
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert got.columns == stages[5].columns
    assert sorted(map(tuple, got.select(*key).collect())) == sorted(map(tuple, stages[5].select(*key).collect()))


def test_every_operator_has_one_query():
    numbers = sorted(int(name[2:].split("_")[0]) for name in queries.QUERIES)
    assert numbers == list(range(1, 14))


def _odd_folder(spark, sf_dir, folder, docs):
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{sf_dir}/labels.parquet").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_odd_rows_go_through_every_stage(spark, sf_dir, tmp_path):
    """Nulls, empty and long texts, ties, repeated rows and ids, clashing columns."""
    odd = [(1_000_000 + i if i is not None else None, t) for i, t in ODD]
    odd += [(1_000_050, "Two texts of one id, the first of which is here in full"), (1_000_050, "and a second text that nothing else in the table resembles")]
    odd += [(1_000_060, "password=hunter22 " * 2000), (1_000_061, "secret: abcdefgh " * 3), (1_000_061, "secret: abcdefgh " * 3)]
    small = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    docs = clashing(small.unionByName(docs_of(spark, odd).select(*COLUMNS)))
    docs = docs.withColumns({c: F.lit("x") for c in ("text_hash", "node", "component_id", "kept", "row", "length", "__spans", "alphabet")})
    folder = _odd_folder(spark, sf_dir, tmp_path, docs)
    current = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")

    def rows(df):
        return collections.Counter((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())

    outs = []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, current, folder).write.parquet(f"{tmp_path}/{i}")
        after = spark.read.parquet(f"{tmp_path}/{i}")
        if name != "packing":
            assert after.columns == docs.columns
        if name in ("quality", "toxicity"):
            module, column, keep = (quality, "predicted", 1) if name == "quality" else (toxicity, "predicted", 0)
            fit = module.classify(spark, current.select("doc_id", "text"), labels)
            judged = collections.Counter(r.doc_id for r in fit.collect() if r[column] == keep)
            assert judged == collections.Counter(r.doc_id for r in after.select("doc_id").collect())
        if name == "near_dedup":
            before = [(i, t) for (i, t), n in rows(current).items() for _ in range(n)]
            want = collections.Counter()
            for (i, t), (_, n, component, _) in zip(before, _classes_in_order(before)):
                if i is None or not n:
                    want[i, t] += 1
                elif i == component:
                    want[i, t] = 1
            assert rows(after) == want
        if name == "secrets":
            assert rows(after).total() == rows(current).total()
            assert not secrets.findings(after).filter("size(__base) > 0").count()
            assert {i for i, _ in rows(after)} == {i for i, _ in rows(current)}
        if name == "packing":
            assert {r.doc_id for r in after.collect()} == {i for i, _ in rows(current)}
        outs.append(current := after)
    got, want = corpus_pipeline.run(spark, folder), outs[-1]
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, got.select(*key).collect()), key=repr) == sorted(map(tuple, want.select(*key).collect()), key=repr)


def _classes_in_order(rows):
    """As ``_classes`` (five words, 0.8), in the order of the rows."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(lower))
        sets.append({tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set())
    # Distinct sets are nodes: an id with several texts is in several classes.
    nodes = {}
    for (i, _), s in zip(rows, sets):
        if i is not None and s:
            nodes[frozenset(s)] = min(i, nodes.get(frozenset(s), i))
    label = dict(nodes)
    changed = True
    pairs = [(x, y) for x in nodes for y in nodes if x is not y and 100 * len(x & y) >= 80 * len(x | y)]
    while changed:
        changed = False
        for x, y in pairs:
            low = min(label[x], label[y])
            changed |= label[x] != low or label[y] != low
            label[x] = label[y] = low
    return [(i, len(s), label.get(frozenset(s), i) if i is not None else None, None) for (i, _), s in zip(rows, sets)]


def test_an_empty_table_gives_empty_stages(spark, sf_dir, tmp_path):
    folder = _odd_folder(spark, sf_dir, tmp_path, docs_of(spark, []))
    got = corpus_pipeline.run(spark, folder)
    assert got.count() == 0 and got.columns[:5] == ["doc_id", "piece", "start", "length", "ids_crc32"]
