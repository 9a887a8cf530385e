"""Merkle manifest, spelling variants and word-end BPE against brute force."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tests.llm.test_operators import DOCS, ODD, clashing, docs_of
from voxframe.llm import merkle, variants, wordbpe

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _tree(nodes):
    """The root, and for each node the (left, right) siblings on its way up."""
    paths, level, own = [[] for _ in nodes], list(nodes), list(range(len(nodes)))
    while len(level) > 1:
        for path, o in zip(paths, own):
            run = o // 16 * 16
            path.append((level[run:o], level[o + 1 : run + 16]))
        own = [o // 16 for o in own]
        level = [_h(*level[a : a + 16]) for a in range(0, len(level), 16)]
    return level[0], paths


def _manifest(rows):
    def field(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    groups = collections.defaultdict(list)
    for i, text, lang, source, n in rows:
        seen = text.translate(LOWER) if text and i is not None and zlib.crc32(str(i).encode()) % 5 == 0 else text
        digests = [_h(*map(field, (i, source, lang, n, t))) for t in (text, seen)]
        groups[source].append((i is not None, i or 0, *digests, i))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for name in names:
        own = sorted(groups[name], key=lambda x: x[:4])
        trees.append((own, *_tree([x[2] for x in own])))
    root, upper = _tree([t[1] for t in trees]) if trees else (None, [])
    out = []
    for (own, subroot, paths), above in zip(trees, upper):
        for x, path in zip(own, paths):
            cur = x[3]
            for a, b in path + above:
                cur = _h(*a, cur, *b)
            proof = _h(*(d for a, b in path + above for d in a + b))
            out.append((x[4], x[2], subroot, root, proof, cur, cur == root))
    return sorted(out, key=repr)


def _manifest_of(spark, rows):
    docs = clashing(spark.createDataFrame(rows, DOCS)).withColumns({c: F.lit("x") for c in ("group", "idx", "n", "slot", "left", "root", "tie")})
    return sorted(map(tuple, merkle.manifest(spark, docs, merkle.every_fifth(docs)).collect()), key=repr)


def test_manifest_equals_brute_force(spark):
    rows = [(i, t, "en", None if i == 2 else "S", None if t is None else len(t)) for i, t in ODD]
    # Sources of 1, 16, 17 and 600 rows, one of them empty text, repeated rows and ids.
    for source, n in (("one", 1), ("full", 16), ("é", 17), ("", 3), ("big", 600)):
        rows += [(1000 * n - i, f"Text {i % 90}", None, source, i) for i in range(n)]
    rows += [(7, "Same", None, "big", 1)] * 40 + [(None, "Same", None, None, None)] * 2
    random.Random(1).shuffle(rows)
    got = _manifest_of(spark, rows)
    assert got == _manifest(rows)
    assert {r[-1] for r in got} == {True, False}


@pytest.mark.parametrize("rows", [[], [(5, "A", "en", None, 1)], [(1, None, None, "s", None)] * 18])
def test_manifest_of_few(spark, rows):
    assert _manifest_of(spark, rows) == _manifest(rows)


def _near(u, v):
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v)) == 1
    u, v = sorted((u, v), key=len, reverse=True)
    return len(u) == len(v) + 1 and any(u[:i] + u[i + 1 :] == v for i in range(len(u)))


def _variants(rows):
    count = collections.Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            at = h % len(run)
            count[run[:at] + run[at + 1 :] if h % 199 == 0 else run] += 1
    words = {w: n for w, n in count.items() if len(w) >= 6 and n >= 5}
    near = {w: [v for v in words if v != w and abs(len(v) - len(w)) < 2 and _near(w, v)] for w in words}
    best = {w: min(vs, key=lambda v: (-words[v], v)) for w, vs in near.items() if vs}
    form = {w: b for w, b in best.items() if words[b] >= 5 * words[w]}
    out = []
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(near[w]), words[form[w]] if w in form else None))
    return sorted(out)


@pytest.fixture(scope="module")
def crowd():
    """Words over few letters, so that most have several near words; and long ones."""
    rng = random.Random(4)
    pool = ["".join(rng.choice("abé") for _ in range(rng.randint(6, 8))) for _ in range(500)]
    rows = [(i, " ".join(rng.choice(pool[: int(10 ** rng.uniform(0.5, 2.7))]) for _ in range(60))) for i in range(250)]
    rows += [(400 + i, "Colour, COLOUR colour! colouur") for i in range(5)] + [(500 + i, "colour " * 40 + "colou " + "colouurs") for i in range(8)]
    whole = "ab" * 400
    for w in (whole, whole[:90] + "c" + whole[90:], whole[:700] + "c" + whole[700:], whole[:-1]):
        rows += [(600, w)] * 6
    return [*ODD, *rows, *[(700, "Ünïcodë×÷ Ālphabet")] * 6, *[(None, "without id")] * 5]


def test_variants_equal_brute_force(spark, crowd):
    docs = clashing(docs_of(spark, crowd)).withColumns({c: F.lit("x") for c in ("word", "n", "key", "size", "form", "root")})
    got = sorted(map(tuple, variants.group_variants(spark, docs).collect()))
    assert got == _variants(crowd)
    assert sum(r[4] for r in got) > 300 and any(r[1] and r[2] != r[1] for r in got)
    assert variants.group_variants(spark, docs_of(spark, [])).count() == 0


@pytest.mark.parametrize("largest, buckets", [(20, 64), (0, 4)])
def test_crowded_parts_are_cut_without_loss(spark, crowd, largest, buckets):
    words = variants.word_counts(docs_of(spark, [r for r in crowd if len(r[1] or "") < 700])).checkpoint()
    whole = sorted(map(tuple, variants.near_words(words).collect()))
    assert sorted(map(tuple, variants.near_words(words, largest, buckets).collect())) == whole


def test_states_are_minimised_and_pairs_met_once():
    rng = random.Random(9)
    for _ in range(300):
        size = rng.randint(1, 7)
        long = list({"".join(rng.choice("abc") for _ in range(size)) for _ in range(rng.randint(1, 30))})
        short = list({"".join(rng.choice("abc") for _ in range(size - 1)) for _ in range(rng.randint(0, 12))})
        same, less = variants.near_in_part(long, short)
        assert sorted(tuple(sorted((long[i], long[j]))) for i, j in same) == sorted((a, b) for a in long for b in long if a < b and _near(a, b))
        assert sorted((long[i], short[j]) for i, j in less) == sorted((a, b) for a in long for b in short if _near(a, b))
    machine = variants.Acceptor()
    machine.state(sorted(a + b + c for a in "abc" for b in "abc" for c in "abc"))
    assert len(machine.arcs) == 4


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(WORD_BPE)


def test_word_bpe_equals_the_library(tokenizer):
    rng = random.Random(3)
    signs = [*"ab 1'\n\t\r.,streTmvld!é中١²ⅧΣİÀ", " ", "　", "\x1c", "\x85", "'s", "'re", "  ", "'ll", "é", "՘", "Ɤ"]
    signs += ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|", "hello", "World"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 16))) for _ in range(8000)] + ["", "a" * 3000, "ab" * 2000 + "!?" * 999]
    ids, counts = wordbpe.encode_block(texts, WORD_BPE, wordbpe.class_runs())
    at = 0
    for text, n in zip(texts, counts.tolist()):
        want = tokenizer.encode(text, add_special_tokens=False).ids
        assert ids[at : at + n].tolist() == want, text
        assert wordbpe.vocabulary(WORD_BPE).decode(ids[at : at + n].astype(np.int64)) == tokenizer.decode(want, skip_special_tokens=False)
        at += n


def _plain_merges(word, vocab):
    """The leftmost pair of the lowest rank, found anew for every merge."""
    ids = [*(vocab.inner[b] for b in word[:-1]), vocab.last[word[-1]]]
    while True:
        ranks = [vocab.rank.get(p, 1 << 40) for p in zip(ids, ids[1:])]
        if not ranks or min(ranks) == 1 << 40:
            return ids
        i = ranks.index(min(ranks))
        ids[i : i + 2] = [vocab.made[ranks[i]]]


def test_segment_tree_merges_the_leftmost_lowest_pair():
    rng, vocab = random.Random(6), wordbpe.Vocabulary(WORD_BPE)
    for _ in range(3000):
        word = "".join(rng.choice("etaoinshr") for _ in range(rng.randint(1, 40))).encode()
        assert vocab.merge(word) == _plain_merges(word, vocab)


def test_word_bpe_query(spark, tokenizer):
    rows = [*ODD, (11, "A<|endoftext|>b"), (12, "word " * 50_000), (13, "x" * 100_000)]
    docs = clashing(docs_of(spark, rows)).withColumns({c: F.lit("x") for c in ("ids", "n_tokens", "decoded")})
    got = sorted(map(tuple, wordbpe.digests(spark, docs, WORD_BPE).collect()), key=repr)
    want = []
    for i, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        decoded = tokenizer.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), _h(" ".join(map(str, ids))), _h(decoded)))
    assert got == sorted(want, key=repr)
    assert wordbpe.digests(spark, docs_of(spark, []), WORD_BPE).count() == 0
