"""Registered queries of the training-data operators, on whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from corpusmill.llm import (chaining, decontam, embed_cells, ngram_join, packing, prefix_trie, quality, suffix_dedup, token_tree,
                            toxicity, url_trie, warc, whitening)

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
URL_RULES = [url_trie.rule("allow", "com/"), url_trie.rule("block", "example.com/en/"),
             url_trie.rule("allow", "www.example.com/en/"), url_trie.rule("block", "net/es/"),
             url_trie.rule("block", "net/fr/")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chained_passages(spark, sf_dir):
    """One row per passage and document that holds it, with the document's class."""
    return chaining.with_classes(chaining.repeated_passages(table(spark, sf_dir, "documents")))


def op2_latent_decontamination(spark, sf_dir):
    return decontam.benchmark_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_embedding_cells(spark, sf_dir):
    return embed_cells.embedding_classes(table(spark, sf_dir, "embeddings")) \
        .select("vec_id", "n_links", "component_id", "kept")


def op4_token_trees(spark, sf_dir):
    """Token counts of every text before and after its revision."""
    trees = token_tree.build_trees(table(spark, sf_dir, "documents"), TOKENIZER)
    return token_tree.apply_edits(token_tree.revision(trees), TOKENIZER) \
        .select("doc_id", "n_before", "n_tokens", "n_edits", "n_encoded")


def op5_best_fit_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), TOKENIZER)


def op6_weak_toxicity(spark, sf_dir):
    return toxicity.score_texts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_suffix_buckets(spark, sf_dir):
    return suffix_dedup.dedup_bytes(table(spark, sf_dir, "documents"))


def op8_token_groups(spark, sf_dir):
    return ngram_join.jaccard_classes(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op9_warc_archive(spark, sf_dir):
    return warc.pages_through_warc(table(spark, sf_dir, "pages")) \
        .select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_url_trie(spark, sf_dir):
    return url_trie.judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op11_nb_support_vectors(spark, sf_dir):
    return quality.score_texts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_cholesky_whitening(spark, sf_dir):
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_prefix_trie(spark, sf_dir):
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_chained_passages": op1_chained_passages,
    "op2_latent_decontamination": op2_latent_decontamination,
    "op3_embedding_cells": op3_embedding_cells,
    "op4_token_trees": op4_token_trees,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_weak_toxicity": op6_weak_toxicity,
    "op7_suffix_buckets": op7_suffix_buckets,
    "op8_token_groups": op8_token_groups,
    "op9_warc_archive": op9_warc_archive,
    "op10_url_trie": op10_url_trie,
    "op11_nb_support_vectors": op11_nb_support_vectors,
    "op12_cholesky_whitening": op12_cholesky_whitening,
    "op13_prefix_trie": op13_prefix_trie,
}

ORACLE = {
    "op3_embedding_cells": """
        WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
        l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
              WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
        r(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
        c AS (SELECT a, min(b) AS root FROM r GROUP BY a),
        n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
        SELECT v.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.root AS component_id, c.root = v.vec_id AS kept
        FROM v JOIN c ON c.a = v.vec_id LEFT JOIN n ON n.a = v.vec_id""",
    "op8_token_groups": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) >= 5 THEN array_to_string(w[i:i + 4], ' ') ELSE array_to_string(w, ' ') END AS g,
                     CASE WHEN len(w) >= 5 THEN 5 ELSE len(w) END AS k
              FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.k = b.k AND a.doc_id <> b.doc_id
              GROUP BY a.doc_id, b.doc_id),
        l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 80 * (x.n + y.n - o)),
        r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
        c AS (SELECT a, min(b) AS root FROM r GROUP BY a)
        SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.root AS component_id
        FROM documents d JOIN c ON c.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id""",
    "op9_warc_archive": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
        q AS (SELECT page_id, octet_length(encode(h)) AS payload_bytes, sha256(h) AS payload_digest FROM p),
        w AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM q)
        SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
        FROM w""",
    "op10_url_trie": r"""
        WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
                   FROM pages),
        s AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                     regexp_extract(regexp_replace(rest, '^[^/?#]*', ''), '^[^?#]*') AS path FROM u),
        r AS (SELECT *, CASE WHEN host = 'www.example.com' OR ends_with(host, '.www.example.com') THEN
                            CASE WHEN starts_with(path, '/en/') THEN 'www.example.com/en/' END END AS a,
                     CASE WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/')
                          THEN 'example.com/en/' END AS b,
                     CASE WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS c,
                     CASE WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
                          WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/' END AS d
              FROM s)
        SELECT page_id, host, path, coalesce(a, b, c, d) AS rule,
               CASE WHEN coalesce(a, b, c, d) IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict
        FROM r""",
    "op13_prefix_trie": r"""
        WITH t AS (
            SELECT conv_id, struct_pack(r := coalesce(role, ''), x := coalesce("text", '')) AS v,
                   row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
                       sha256(concat(octet_length(encode(coalesce(role, ''))), ':', coalesce(role, ''), coalesce("text", '')))) - 1 AS pos
            FROM conversations WHERE conv_id IS NOT NULL),
        hx AS (SELECT DISTINCT conv_id, conv_id - conv_id % 5 AS b, conv_id::VARCHAR AS z FROM t),
        h AS (SELECT conv_id, b, xor(list_reduce(list_prepend(4294967295::BIGINT, [ascii(z[j + 1])::BIGINT for j in range(0, strlen(z))]),
                     lambda acc, y: list_reduce(list_prepend(xor(acc, y), [i::BIGINT for i in range(0, 8)]),
                         lambda u, w: CASE WHEN u % 2 = 1 THEN xor(u // 2, 3988292384::BIGINT) ELSE u // 2 END)), 4294967295::BIGINT) % 9 AS h
              FROM hx),
        k AS (SELECT h.conv_id, h.b, h.h, least(h.h, (SELECT count(*) FROM t WHERE t.conv_id = h.b)) AS k FROM h),
        r AS (SELECT k.conv_id, t.pos, t.v FROM k JOIN t ON t.conv_id = k.b AND t.pos < k.k
              UNION ALL SELECT k.conv_id, t.pos - k.h + k.k, t.v FROM k JOIN t ON t.conv_id = k.conv_id AND t.pos >= k.h),
        c AS (SELECT k.conv_id, coalesce(list(r.v ORDER BY r.pos) FILTER (WHERE r.pos IS NOT NULL), []) AS p
              FROM k LEFT JOIN r ON r.conv_id = k.conv_id GROUP BY k.conv_id),
        m AS (SELECT conv_id AS c, len(p) AS n, d, p[:d] AS seq FROM (SELECT *, unnest(range(0, len(p) + 1)) AS d FROM c)),
        g AS (SELECT seq, d, min(c) AS conv_id, count(*) AS n_convs, any_value(strlen(seq[d].x)) AS last,
                     coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE n = d), '') AS ends FROM m GROUP BY seq, d),
        row AS (SELECT m.c, m.d, g.conv_id AS owner FROM m JOIN g ON g.seq = m.seq AND g.d = m.d),
        e AS (SELECT g.*, p.owner AS parent FROM g LEFT JOIN row p ON p.c = g.conv_id AND p.d = g.d - 1),
        ch AS (SELECT parent, d - 1 AS d, count(*) AS n FROM e WHERE d > 0 GROUP BY ALL),
        f AS (SELECT e.*, coalesce(ch.n, 0) AS n_children, CASE WHEN e.d = 0 THEN 0 ELSE (n_convs - 1) * last END AS own
              FROM e LEFT JOIN ch ON ch.parent = e.conv_id AND ch.d = e.d),
        s AS (SELECT a.owner AS conv_id, a.d, count(*) FILTER (WHERE f.n_children = 0) AS n_leaves, sum(f.own) AS saved
              FROM f JOIN row a ON a.c = f.conv_id AND a.d <= f.d GROUP BY ALL)
        SELECT f.conv_id::BIGINT AS conv_id, f.d::BIGINT AS depth, f.parent::BIGINT AS parent_conv_id, f.n_convs::BIGINT AS n_convs,
               f.n_children::BIGINT AS n_children, s.n_leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, sha256(f.ends) AS ends_sha256
        FROM f JOIN s ON s.conv_id = f.conv_id AND s.d = f.d""",
}
