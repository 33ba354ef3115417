"""The operators applied to the supplied tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placewright.llm import (
    byte_bpe, cover_tree, dart_minhash, embedding_dedup, fingerprints, line_dedup, merkle, packing, quality_classifier, quality_rules, token_counts,
    token_files, warc_zip,
)
from placewright.llm.common import documents, table


def near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of near duplicates of every document, and whether it is the one that stays."""
    return dart_minhash.near_duplicates(documents(spark, sf_dir))


def count_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir))


def classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classified(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of each document without the lines it loses."""
    return line_dedup.without_shared_lines(documents(spark, sf_dir).select("doc_id", "text")).select(
        "doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("kept_sha256"))


def byte_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(documents(spark, sf_dir))


def rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return quality_rules.judged(documents(spark, sf_dir).select("doc_id", "text", "lang", "source")).select("doc_id", *[F.col(f"_{c}").alias(c) for c in counts])


def token_file_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(documents(spark, sf_dir))


def warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_zip.archived(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compared(documents(spark, sf_dir))


def pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(documents(spark, sf_dir))


def near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector."""
    return embedding_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


def dataset_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and proof of every document, and whether its tampered form is noticed."""
    return merkle.manifest(documents(spark, sf_dir))


def hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hard negatives of every anchor and positive."""
    return cover_tree.hard_negatives(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_dart_minhash_dedup": near_dedup,
    "op2_heap_bpe_token_counts": count_tokens,
    "op3_subword_quality_classifier": classifier,
    "op4_line_dedup_bitmaps": lines,
    "op5_transducer_byte_bpe": byte_codec,
    "op6_adaptive_quality_rules": rules,
    "op7_token_id_files": token_file_round_trip,
    "op8_warc_zip": warc_round_trip,
    "op9_simhash_fingerprints": simhash,
    "op10_hierarchical_packing": pack,
    "op11_int8_tile_embedding_dedup": near_vectors,
    "op12_time_forward_merkle_manifest": dataset_manifest,
    "op13_cover_tree_hard_negatives": hard_negatives,
}

ORACLE: dict[str, str] = {}

ORACLE["op4_line_dedup_bitmaps"] = r"""
WITH lines AS (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
    FROM documents
), keyed AS (
    SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), shared AS (
    SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), marked AS (
    SELECT k.*, s.key IS NOT NULL AND k.doc_id <> s.keeper AS dropped FROM keyed k LEFT JOIN shared s ON k.key = s.key
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (dropped)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

ORACLE["op8_warc_zip"] = """
WITH p AS (
    SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
    SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND first < page_id THEN first END AS refers_to
FROM f
"""

ORACLE["op11_int8_tile_embedding_dedup"] = """
WITH RECURSIVE v AS (
    SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), fit AS (
    SELECT * FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM fit a JOIN fit b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.9
), reached AS (
    SELECT vec_id, vec_id AS other FROM v
    UNION
    SELECT r.vec_id, l.b FROM reached r JOIN links l ON r.other = l.a
)
SELECT r.vec_id, any_value(coalesce(n.n, 0))::BIGINT AS n_links, min(other) AS component_id, r.vec_id = min(other) AS kept
FROM reached r LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) n ON r.vec_id = n.a GROUP BY r.vec_id
"""


def _tree_sql(name: str, leaves: str, levels: int) -> str:
    """CTEs of the trees over ``leaves`` (grp, pos, h): ``name_0`` to ``name_levels`` hold a level's nodes, ``name_r0`` and on what is beside a node."""
    parts = [f"{name}_0 AS (SELECT grp, pos, h, count(*) OVER (PARTITION BY grp) AS total FROM {leaves})"]
    for k in range(levels):
        parts.append(f"""{name}_r{k} AS (
    SELECT a.grp, a.pos, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
    FROM {name}_{k} a JOIN {name}_{k} b ON a.grp = b.grp AND a.pos // 3 = b.pos // 3 WHERE a.total > 1 GROUP BY a.grp, a.pos)""")
        parts.append(f"""{name}_{k + 1} AS (
    SELECT *, count(*) OVER (PARTITION BY grp) AS total FROM (
        SELECT grp, pos // 3 AS pos, CASE WHEN any_value(total) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY pos)) END AS h FROM {name}_{k} GROUP BY grp, pos // 3))""")
    return ",\n".join(parts)


def _fold_sql(name: str, tree: str, start: str, levels: int) -> str:
    """CTEs that carry ``f`` and ``p`` of rows (grp, pos, f, p, ...) up the tree's levels, to ``name_levels``."""
    parts = [f"{name}_0 AS ({start})"]
    parts += [f"""{name}_{k + 1} AS (
    SELECT d.* REPLACE (CASE WHEN t.pos IS NULL THEN f ELSE sha256(t.l || f || t.r) END AS f, p || coalesce(t.l || t.r, '') AS p, d.pos // 3 AS pos)
    FROM {name}_{k} d LEFT JOIN {tree}_r{k} t ON d.grp = t.grp AND d.pos = t.pos)""" for k in range(levels)]
    return ",\n".join(parts)


def _leaf_sql(text: str) -> str:
    fields = ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text)
    return "sha256(" + " || ".join(f"coalesce(strlen({c}) || ':' || {c}, '-')" for c in fields) + ")"


#: Levels that the SQL spells out: up to 3 ** 12 documents of a source, and 3 ** 7 sources.
LEVELS, SOURCE_LEVELS = 12, 7

ORACLE["op12_time_forward_merkle_manifest"] = f"""
WITH leaves AS (
    SELECT doc_id, coalesce('=' || source, '') AS grp, {_leaf_sql("text")} AS h, {_leaf_sql("replace(text, chr(10), '')")} AS changed,
        xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
            lambda c, b: list_reduce(list_prepend(xor(c, b), list_value(0::BIGINT, 0, 0, 0, 0, 0, 0, 0)), lambda x, y: xor(x >> 1, 3988292384::BIGINT * (x & 1)))), 4294967295::BIGINT) AS crc
    FROM documents
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, h) - 1 AS pos FROM leaves
), {_tree_sql("t", "placed", LEVELS)}, sources AS (
    SELECT '' AS grp, grp AS source, row_number() OVER (ORDER BY grp) - 1 AS pos, h FROM t_{LEVELS}
), {_tree_sql("s", "sources", SOURCE_LEVELS)}, {_fold_sql("d", "t", "SELECT grp, pos, CASE WHEN crc % 2 = 0 THEN changed ELSE h END AS f, '' AS p, doc_id, h AS leaf FROM placed", LEVELS)},
{_fold_sql("u", "s", f"SELECT s.grp, s.pos, d.f, d.p, d.doc_id, d.leaf, s.h AS subroot FROM d_{LEVELS} d JOIN sources s ON d.grp = s.source", SOURCE_LEVELS)}
SELECT doc_id, leaf, subroot, root, sha256(p) AS proof_sha256, f AS folded_root, f = root AS verified FROM u_{SOURCE_LEVELS}, (SELECT h AS root FROM s_{SOURCE_LEVELS})
"""

ORACLE["op13_cover_tree_hard_negatives"] = """
WITH c AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x
    FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT a.vec_id AS anchor, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.x, b.x)::BIGINT AS score
    FROM c a JOIN c b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), p AS (
    SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id) <= 5
)
SELECT p.anchor AS anchor_id, p.id AS positive_id, (row_number() OVER w)::INTEGER AS rank, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON p.anchor = n.anchor AND NOT n.same AND 80 * p.score <= 100 * n.score AND n.score <= p.score
WINDOW w AS (PARTITION BY p.anchor, p.id ORDER BY n.score DESC, n.id)
QUALIFY row_number() OVER w <= 5
"""
