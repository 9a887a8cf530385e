"""Registered queries of this subpackage and their SQL."""

import public_tokenizers

from voxframe.llm import bpe, merkle, neardup, neighbours, packing, pages, quality, secrets, topk, toxicity, variants, warc, wordbpe

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_randomness_secrets(spark, sf_dir):
    return secrets.scan(spark, _table(spark, sf_dir, "documents"))


def op2_counterfactual_toxicity(spark, sf_dir):
    return toxicity.classify(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_best_fit_packing(spark, sf_dir):
    return packing.pack(spark, _table(spark, sf_dir, "documents"), RANKS, added=bpe.added_tokens(BYTE_BPE))


def op4_stable_projection_neighbours(spark, sf_dir):
    vectors = _table(spark, sf_dir, "embeddings")
    return neighbours.nearest(spark, vectors, topk.every(vectors))


def op5_host_suffix_html(spark, sf_dir):
    return pages.main_text(spark, _table(spark, sf_dir, "pages"))


def op6_subword_quality(spark, sf_dir):
    return quality.classify(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_minhash_near_dedup(spark, sf_dir):
    return neardup.near_duplicates(spark, _table(spark, sf_dir, "documents"), k=3, percent=85)


def op8_splittable_warc(spark, sf_dir):
    return warc.round_trip(spark, _table(spark, sf_dir, "pages"))


def op9_byte_bpe(spark, sf_dir):
    return bpe.digests(spark, _table(spark, sf_dir, "documents"), RANKS)


def op10_threshold_top_k(spark, sf_dir):
    vectors = _table(spark, sf_dir, "embeddings")
    return topk.top_k(spark, vectors, topk.every(vectors))


def op11_lag_lead_manifest(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return merkle.manifest(spark, docs, merkle.every_fifth(docs))


def op12_transducer_variants(spark, sf_dir):
    return variants.group_variants(spark, _table(spark, sf_dir, "documents"))


def op13_segment_tree_bpe(spark, sf_dir):
    return wordbpe.digests(spark, _table(spark, sf_dir, "documents"), WORD_BPE)


QUERIES = {
    "op1_randomness_secrets": op1_randomness_secrets,
    "op2_counterfactual_toxicity": op2_counterfactual_toxicity,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_stable_projection_neighbours": op4_stable_projection_neighbours,
    "op5_host_suffix_html": op5_host_suffix_html,
    "op6_subword_quality": op6_subword_quality,
    "op7_minhash_near_dedup": op7_minhash_near_dedup,
    "op8_splittable_warc": op8_splittable_warc,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_threshold_top_k": op10_threshold_top_k,
    "op11_lag_lead_manifest": op11_lag_lead_manifest,
    "op12_transducer_variants": op12_transducer_variants,
    "op13_segment_tree_bpe": op13_segment_tree_bpe,
}
NEAR_DEDUP = r"""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
    FROM documents),
s AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s
    FROM w),
n AS (SELECT doc_id, len(s) AS n FROM s),
x AS (SELECT doc_id, unnest(s) AS x FROM s),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM x a JOIN x b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (
    SELECT a, b FROM common JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 85 * (p.n + q.n - c)),
arc AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, arc.b FROM reach r JOIN arc ON r.b = arc.a)
SELECT n.doc_id, n.n AS n_shingles, r.component_id, n.doc_id = r.component_id AS kept
FROM n JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) r ON r.a = n.doc_id
"""

TOP_K = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings
    WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(c.v) + 1), lambda i: c.v[i] * q.v[i])) AS score
    FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id AND len(c.v) = len(q.v)),
r AS (
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id,
        CAST(score AS BIGINT) AS score
    FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

WARC = """
SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest,
    CASE WHEN strlen(html) >= 100 AND page_id > min(page_id) OVER w THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN strlen(html) >= 100 AND page_id > min(page_id) OVER w THEN min(page_id) OVER w END AS refers_to
FROM pages WINDOW w AS (PARTITION BY coalesce(html, ''))
"""

#: The 256 remainders of crc32, from its polynomial, as the one row of ``crc``.
CRC = """crc AS (
    SELECT list_transform(range(256), lambda b: list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0],
        lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t)"""


def crc32(text):
    """SQL of the unsigned crc32 of a text's UTF-8 bytes."""
    byte = f"CAST('0x' || substr(hex(encode({text})), 2 * i + 1, 2) AS BIGINT)"
    return (
        f"xor(list_reduce([4294967295] || list_transform(range(strlen({text})), lambda i: {byte}), "
        "lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"
    )


#: Levels of each tree in the SQL: up to 16**8 leaves.
DEPTH = 8


def _merkle_sql():
    def field(x, size=None):
        return f"coalesce({size or f'length({x})'} || ':' || {x}, '-')"

    def leaf(text):
        fields = [field("CAST(doc_id AS VARCHAR)"), field("source", "strlen(source)"), field("lang", "strlen(lang)")]
        return f"sha256({' || '.join([*fields, field('CAST(n_chars AS VARCHAR)'), field(text, f'strlen({text})')])})"

    def level(name, i):
        """Nodes of the next level, and every leaf with what it folds to there."""
        run = "array_to_string(list(digest ORDER BY idx), '')"
        others = "ds[1 : c.idx % 16] || ds[c.idx % 16 + 2 :]"
        own = "ds[1 : c.idx % 16] || [cur] || ds[c.idx % 16 + 2 :]"
        return f"""
{name}{i + 1} AS MATERIALIZED (
    SELECT g, idx // 16 AS idx, max(n + 15) // 16 AS n, CASE WHEN max(n) = 1 THEN max(digest) ELSE sha256({run}) END AS digest
    FROM {name}{i} GROUP BY g, idx // 16),
c{name}{i + 1} AS MATERIALIZED (
    SELECT id, c.g, c.idx // 16 AS idx, CASE WHEN n = 1 THEN cur ELSE sha256(array_to_string({own}, '')) END AS cur,
        CASE WHEN n = 1 THEN proof ELSE proof || array_to_string({others}, '') END AS proof
    FROM c{name}{i} c JOIN (SELECT g, idx // 16 AS run, max(n) AS n, list(digest ORDER BY idx) AS ds FROM {name}{i} GROUP BY g, idx // 16) r
    ON r.g = c.g AND r.run = c.idx // 16)"""

    lower = "CASE WHEN " + crc32("CAST(doc_id AS VARCHAR)") + " % 5 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END"
    levels = ",".join(level("s", i) for i in range(DEPTH))
    upper = ",".join(level("u", i) for i in range(DEPTH))
    return f"""
WITH {CRC},
seen AS (SELECT *, {lower} AS seen FROM documents, crc),
s0 AS MATERIALIZED (
    SELECT row_number() OVER () AS id, g, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, digest) - 1 AS idx,
        count(*) OVER (PARTITION BY g) AS n, digest, found, doc_id
    FROM (SELECT coalesce('=' || source, '') AS g, doc_id, {leaf("text")} AS digest, {leaf("seen")} AS found FROM seen)),
cs0 AS (SELECT id, g, idx, found AS cur, '' AS proof FROM s0),{levels},
u0 AS MATERIALIZED (
    SELECT g AS sub, 0 AS g, row_number() OVER (ORDER BY g) - 1 AS idx, count(*) OVER () AS n, digest FROM s{DEPTH}),
cu0 AS (SELECT c.id, u0.g, u0.idx, c.cur, c.proof FROM cs{DEPTH} c JOIN u0 ON u0.sub = c.g),{upper}
SELECT s0.doc_id, s0.digest AS leaf, u0.digest AS subroot, u{DEPTH}.digest AS root, sha256(proof) AS proof_sha256,
    cur AS folded_root, cur = u{DEPTH}.digest AS verified
FROM s0 JOIN cu{DEPTH} c ON c.id = s0.id JOIN u0 ON u0.sub = s0.g JOIN u{DEPTH} ON TRUE
"""


VARIANTS = f"""
WITH RECURSIVE {CRC},
r AS (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\u00C0-\u00FF]+')) AS r
    FROM documents),
d AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' || r AS k, r, count(*) AS n FROM r WHERE length(r) >= 6 GROUP BY ALL),
h AS (SELECT r, n, {crc32("k")} AS h FROM d, crc),
w AS MATERIALIZED (
    SELECT word, CAST(sum(n) AS BIGINT) AS n
    FROM (SELECT CASE WHEN h % 199 = 0 THEN r[1 : h % length(r)] || r[h % length(r) + 2 :] ELSE r END AS word, n FROM h)
    WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
cut AS MATERIALIZED (
    SELECT word, i, word[1 : i - 1] || word[i + 1 :] AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM w)),
near AS (
    SELECT a.word, b.word AS other FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
    UNION SELECT cut.word, w.word FROM cut JOIN w ON w.word = cut.rest
    UNION SELECT w.word, cut.word FROM cut JOIN w ON w.word = cut.rest),
best AS (
    SELECT near.word, count(*) AS n_near, min({{'less': -o.n, 'other': other}}) AS b
    FROM near JOIN w o ON o.word = near.other GROUP BY near.word),
f AS MATERIALIZED (
    SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -b.less >= 5 * w.n THEN b.other END AS form,
        CASE WHEN -b.less >= 5 * w.n THEN -b.less END AS form_n
    FROM w LEFT JOIN best ON best.word = w.word),
reach AS (
    SELECT word, word AS root, form FROM f
    UNION ALL SELECT reach.word, f.word, f.form FROM reach JOIN f ON f.word = reach.form)
SELECT f.word, f.form, reach.root, f.n, f.n_near, f.form_n FROM f JOIN reach ON reach.word = f.word AND reach.form IS NULL
"""

ORACLES = {
    "op11_lag_lead_manifest": _merkle_sql(),
    "op12_transducer_variants": VARIANTS,
    "op7_minhash_near_dedup": NEAR_DEDUP,
    "op8_splittable_warc": WARC,
    "op10_threshold_top_k": TOP_K,
}
