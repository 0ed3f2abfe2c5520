"""Registered queries of the subpackage: each operator over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from paysift.llm.bit_slices import top_inner_products
from paysift.llm.byte_gru import identify_languages
from paysift.llm.cotrain import quality_scores
from paysift.llm.embed_passes import near_vectors
from paysift.llm.fm_dedup import repeated_starts, strip_repeats
from paysift.llm.hilbert_pack import pack_along_curve
from paysift.llm.hyper_shard import shuffle_into_shards
from paysift.llm.llr_quality import llr_quality
from paysift.llm.merkle_butterfly import (folded, leaf_digest,
                                          merkle_manifest, proof_digest)
from paysift.llm.minhash_forest import near_duplicates
from paysift.llm.systematic_mix import mix_sources
from paysift.llm.token_shards import read_shards, write_shards
from paysift.llm.turn_trie import prefix_trie
from paysift.llm.words import n_words
from paysift.session import shared_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_embedding_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(_table(spark, sf_dir, "embeddings"))


def op2_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), shingle=2)


def op3_pack_hilbert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_along_curve(_table(spark, sf_dir, "documents"),
                            public_tokenizers.path("byte_bpe_50k.json"))


def op4_quality_llr(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = llr_quality(_table(spark, sf_dir, "documents"),
                      _table(spark, sf_dir, "labels"), order=2,
                      buckets=1 << 16)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols",
                      "n_dup_lines", "n_repeat_words", "base_failed",
                      "kept", "llr")


def op5_language_gru(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(_table(spark, sf_dir, "documents"))


def op6_mix_systematic(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "documents").select(
        "doc_id", "source", n_words(F.col("text")).alias("size"))
    return mix_sources(rows).select(
        "doc_id", "size", "source_size", "target",
        (F.col("copies") * F.col("size")).alias("taken"))


def op7_quality_cotrain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(_table(spark, sf_dir, "documents"),
                          _table(spark, sf_dir, "labels"))


def op8_shard_hypergeometric(spark: SparkSession,
                             sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = _table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).cast("long").alias("text_crc32"))
    return shuffle_into_shards(rows).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"),
        "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "token-shards")
    write_shards(_table(spark, sf_dir, "documents"), path,
                 public_tokenizers.path("word_bpe_49k.json"))
    return read_shards(spark, path)


def op10_substring_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return strip_repeats(docs, repeated_starts(docs), digest=True)


_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def op11_merkle_butterfly(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")

    def leaf(text):
        return leaf_digest(*[F.col(c) for c in (
            "doc_id", "source", "lang", "n_chars")], text)
    third = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    text = F.col("text")
    rows = docs.select(
        "doc_id", "lang", leaf(text).alias("leaf"), F.when(third, leaf(
            F.translate(text, _CAPITALS, _CAPITALS.lower())))
        .alias("forged"))
    root = folded(F.coalesce("forged", "leaf"), F.col("proof"))
    return merkle_manifest(rows, carry=["forged"]).select(
        "doc_id", "leaf", "subroot", "root",
        proof_digest(F.col("proof")).alias("proof_sha256"),
        root.alias("folded_root")) \
        .withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_turn_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(_table(spark, sf_dir, "conversations")) \
        .drop("id", "parent")


def op13_topk_bit_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_inner_products(_table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_embedding_passes": op1_embedding_passes,
    "op2_minhash_forest": op2_minhash_forest,
    "op3_pack_hilbert": op3_pack_hilbert,
    "op4_quality_llr": op4_quality_llr,
    "op5_language_gru": op5_language_gru,
    "op6_mix_systematic": op6_mix_systematic,
    "op7_quality_cotrain": op7_quality_cotrain,
    "op8_shard_hypergeometric": op8_shard_hypergeometric,
    "op9_wavelet_tokens": op9_wavelet_tokens,
    "op10_substring_fm": op10_substring_fm,
    "op11_merkle_butterfly": op11_merkle_butterfly,
    "op12_turn_trie": op12_turn_trie,
    "op13_topk_bit_slices": op13_topk_bit_slices,
}

#: Components: the smallest id reachable over ``link``, per row of ``nodes``.
_REACH = """
reach AS (
  SELECT id, id AS top FROM nodes
  UNION
  SELECT l.b, r.top FROM reach r JOIN link l ON l.a = r.id
), comp AS (SELECT id, min(top) AS component_id FROM reach GROUP BY id)"""

#: CRC-32 by table, as a function of a text.
_CRC = r"""
crc_table AS (
  SELECT list(v ORDER BY i) AS steps FROM (
    SELECT i, list_reduce([i] || [0, 0, 0, 0, 0, 0, 0, 0], lambda c, x:
      CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
    FROM range(256) r(i))
)"""


def _crc(value: str) -> str:
    return (f"xor(4294967295, list_reduce([4294967295] || list_transform("
            f"string_split({value}::VARCHAR, ''), lambda s: "
            f"ascii(s)::BIGINT), lambda c, b: xor(c >> 8, "
            f"steps[(xor(c, b) & 255) + 1])))")


#: Levels that the SQL of the Merkle tree spells out, for each of its trees.
_LEVELS = 7


def _merkle_sql() -> str:
    def part(c: str) -> str:
        return (f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, "
                f"'-')")

    def leaf(text: str) -> str:
        return "sha256(" + " || ".join(map(part, (
            "doc_id", "source", "lang", "n_chars", text))) + ")"
    out = [f"""
WITH{_CRC}, d AS (
  SELECT doc_id, lang, {leaf("text")} AS leaf,
    CASE WHEN {_crc("doc_id")} % 3 = 0 THEN {leaf(
        f"translate(text, '{_CAPITALS}', '{_CAPITALS.lower()}')")} END
      AS forged
  FROM documents, crc_table
), a0 AS (
  SELECT lang AS g, row_number() OVER (
    PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
    leaf AS h, doc_id, forged FROM d
)"""]

    def levels(t: str, key: str) -> None:
        for k in range(_LEVELS):
            out.append(f""", {t}{k + 1} AS (
  SELECT g, CASE WHEN n > 1 THEN i // 8 ELSE i END AS i,
    CASE WHEN max(n) > 1 THEN sha256(string_agg(h, '' ORDER BY i))
         ELSE min(h) END AS h
  FROM (SELECT g, i, h, count(*) OVER (PARTITION BY g) AS n FROM {t}{k})
  GROUP BY g, CASE WHEN n > 1 THEN i // 8 ELSE i END, n
)""")
    levels("a", "g")
    out.append(f""", b0 AS (
  SELECT 0 AS g, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS i, h,
    g AS lang FROM a{_LEVELS}
)""")
    levels("b", "g")
    # fold: x is the own node, p the siblings' digests so far
    out.append(f""", f0 AS (
  SELECT g, i, i AS row, h AS leaf, doc_id, coalesce(forged, h) AS x,
    '' AS p FROM a0
)""")

    def fold(t: str, f: str, k: int) -> None:
        out.append(f""", {f}{k + 1} AS (
  WITH r AS (SELECT g, i // 8 AS up, list(h ORDER BY i) AS hs,
               sum(count(*)) OVER (PARTITION BY g) AS n
             FROM {t}{k} GROUP BY g, i // 8)
  SELECT {f}{k}.* REPLACE (
    CASE WHEN r.n > 1 THEN {f}{k}.i // 8 ELSE {f}{k}.i END AS i,
    CASE WHEN r.n > 1 THEN sha256(array_to_string(hs[:{f}{k}.i % 8] || [x]
      || hs[{f}{k}.i % 8 + 2:], '')) ELSE x END AS x,
    CASE WHEN r.n > 1 THEN p || array_to_string(hs[:{f}{k}.i % 8]
      || hs[{f}{k}.i % 8 + 2:], '') ELSE p END AS p)
  FROM {f}{k} JOIN r ON r.g IS NOT DISTINCT FROM {f}{k}.g
    AND r.up = {f}{k}.i // 8
)""")
    for k in range(_LEVELS):
        fold("a", "f", k)
    out.append(f""", e0 AS (
  SELECT 0 AS g, b0.i, f.leaf, f.doc_id, f.x, f.p, b0.h AS subroot
  FROM f{_LEVELS} f JOIN b0 ON b0.lang IS NOT DISTINCT FROM f.g
)""")
    for k in range(_LEVELS):
        fold("b", "e", k)
    out.append(f"""
SELECT doc_id, leaf, subroot, b.h AS root, sha256(p) AS proof_sha256,
       x AS folded_root, x = b.h AS verified
FROM e{_LEVELS}, b{_LEVELS} b
""")
    return "".join(out)


#: DuckDB SQL of the same rows, where SQL can express them.
ORACLE_SQL: dict[str, str] = {
    "op11_merkle_butterfly": _merkle_sql(),
    "op12_turn_trie": f"""
WITH{_CRC}, t AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id
           ORDER BY turn NULLS FIRST, id) - 1 AS pos, id, size
  FROM (SELECT conv_id, turn, md5(strlen(coalesce(role, '')) || ':'
                 || coalesce(role, '') || coalesce(text, '')) AS id,
          length(coalesce(text, '')) AS size FROM conversations)
  WHERE conv_id IS NOT NULL
), c AS (
  SELECT c, c - c % 100 AS base, {_crc("c")} % 6 AS h
  FROM (SELECT DISTINCT c FROM t), crc_table
), turns AS (
  SELECT c.c, 0 AS part, pos, id, size
  FROM c JOIN t ON t.c = c.base WHERE pos < h
  UNION ALL
  SELECT c.c, 1, pos, id, size FROM c JOIN t ON t.c = c.c WHERE pos >= h
), seq AS (
  SELECT c.c, coalesce(s.ids, []) AS ids, coalesce(s.sizes, []) AS sizes
  FROM c LEFT JOIN (SELECT c, list(id ORDER BY part, pos) AS ids,
                      list(size ORDER BY part, pos) AS sizes
                    FROM turns GROUP BY c) s ON s.c = c.c
), m AS (
  SELECT c, d, ids[:d] AS path, CASE WHEN d > 0 THEN sizes[d] ELSE 0 END
    AS size, d = len(ids) AS ends
  FROM (SELECT c, ids, sizes, unnest(range(0, len(ids) + 1)) AS d FROM seq)
), n AS (
  SELECT path, d AS depth, min(c) AS conv_id, count(*) AS n_convs,
    (count(*) - 1) * max(size) AS saved,
    sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c)
                      FILTER (WHERE ends), '')) AS ends_sha256
  FROM m GROUP BY path, d
), k AS (
  SELECT path[:depth - 1] AS path, count(*) AS n_children FROM n
  WHERE depth > 0 GROUP BY 1
), sums AS (
  SELECT n.path[:up] AS path,
    count(*) FILTER (WHERE k.path IS NULL) AS n_leaves,
    sum(saved) AS saved_tokens
  FROM (SELECT path, saved, unnest(range(0, depth + 1)) AS up FROM n) n
  LEFT JOIN k ON k.path = n.path GROUP BY 1
)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id,
       n.n_convs, coalesce(k.n_children, 0) AS n_children, s.n_leaves,
       s.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM n JOIN sums s ON s.path = n.path LEFT JOIN k ON k.path = n.path
LEFT JOIN n p ON n.depth > 0 AND p.path = n.path[:n.depth - 1]
""",
    "op13_topk_bit_slices": r"""
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id,
    list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS q
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding,
    lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.r, a.vec_id AS query_id, b.vec_id,
    coalesce(list_sum(list_transform(list_zip(a.q, b.q),
      lambda z: z[1] * z[2])), 0)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.r <> b.r
    AND len(a.q) = len(b.q)
)
SELECT * EXCLUDE (r) FROM (
  SELECT r, query_id, row_number() OVER (PARTITION BY r
    ORDER BY score DESC, vec_id NULLS FIRST)::INTEGER AS rank, vec_id, score
  FROM s)
WHERE rank <= 10
""",
    "op1_embedding_passes": r"""
WITH RECURSIVE v AS (
  SELECT vec_id AS id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), link AS (
  SELECT x.id AS a, y.id AS b FROM v x JOIN v y
  ON x.label = y.label AND x.id <> y.id AND len(x.e) = len(y.e)
  WHERE list_cosine_similarity(x.e, y.e) >= 0.93
), nodes AS (SELECT vec_id AS id FROM embeddings),""" + _REACH + r"""
SELECT c.id AS vec_id, (SELECT count(*) FROM link WHERE a = c.id) AS n_links,
       component_id, c.id = component_id AS kept
FROM comp c
""",
    "op2_minhash_forest": r"""
WITH RECURSIVE w AS (
  SELECT doc_id AS id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT id, ws[i] || ' ' || ws[i + 1] AS g FROM (
    SELECT id, ws, unnest(range(1, len(ws))) AS i FROM w)
  UNION ALL SELECT id, ws[1] FROM w WHERE len(ws) = 1
), n AS (SELECT id, count(*) AS n FROM s GROUP BY id
), p AS (
  SELECT x.id AS a, y.id AS b, count(*) AS k FROM s x JOIN s y
  ON x.g = y.g AND x.id <> y.id GROUP BY 1, 2
), link AS (
  SELECT a, b FROM p JOIN n x ON x.id = a JOIN n y ON y.id = b
  WHERE 100 * k >= 80 * (x.n + y.n - k)
), nodes AS (SELECT doc_id AS id FROM documents),""" + _REACH + r"""
SELECT c.id AS doc_id, coalesce(n.n, 0) AS n_shingles, component_id,
       c.id = component_id AS kept
FROM comp c LEFT JOIN n ON n.id = c.id
""",
    "op10_substring_fm": r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''),
                                    '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 19], ' ') AS s FROM (
    SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w
    WHERE len(ws) >= 20)
), rep AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (
    PARTITION BY s ORDER BY doc_id, i) AS r FROM win) WHERE r > 1
), gone AS (
  SELECT DISTINCT doc_id, i + j AS p FROM rep, range(0, 20) t(j)
), k AS (
  SELECT w.doc_id, count(*) AS n, count(g.p) AS n_removed,
         string_agg(w.word, ' ' ORDER BY w.p)
           FILTER (WHERE g.p IS NULL) AS kept
  FROM (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p
        FROM w) w
  LEFT JOIN gone g ON g.doc_id = w.doc_id AND g.p = w.p GROUP BY w.doc_id
)
SELECT w.doc_id, len(w.ws)::BIGINT AS n_words,
       coalesce(k.n_removed, 0) AS n_removed,
       sha256(coalesce(k.kept, '')) AS kept_sha256
FROM w LEFT JOIN k ON k.doc_id = w.doc_id
""",
    "op6_mix_systematic": r"""
WITH d AS (
  SELECT doc_id, source,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)
           ::BIGINT AS size
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w
  FROM d GROUP BY source
), l AS (
  SELECT *, (sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER (
               ORDER BY source_size / w, source
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
            / (sum(w) OVER (ORDER BY source_size / w, source
               ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE
            AS level
  FROM s
), f AS (
  SELECT *, (3 * source_size)::DOUBLE <= w::DOUBLE * level AS whole FROM l
), t AS (
  SELECT source, source_size,
         CASE WHEN whole THEN (3 * source_size)::DOUBLE
              ELSE w::DOUBLE * (SELECT level FROM f WHERE NOT whole
                                ORDER BY source_size / w, source LIMIT 1)
         END AS target,
         ('0x' || substr(md5('mix' || CASE WHEN source IS NULL THEN '?'
            ELSE '=' || source END), 1, 8))::BIGINT::DOUBLE
           / 4294967296.0 AS u
  FROM f
), r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.u,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size::DOUBLE
              ELSE 0.0 END AS c,
         (row_number() OVER (PARTITION BY d.source
                             ORDER BY d.size, d.doc_id))::DOUBLE AS k
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       ((floor(u + c * k) - floor(u + c * (k - 1)))::BIGINT * size)::BIGINT
         AS taken
FROM r
""",
}
