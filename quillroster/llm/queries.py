"""The opN_ queries: each applies one operator, with its production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillroster.llm.bpe import bpe_encode
from quillroster.llm.common import documents
from quillroster.llm.decontaminate import contaminated
from quillroster.llm.exact_dedup import exact_dedup
from quillroster.llm.hard_negatives import hard_negatives
from quillroster.llm.language_id import language_id
from quillroster.llm.merkle import document_manifest
from quillroster.llm.near_dups import near_duplicates
from quillroster.llm.nearest import nearest_neighbours
from quillroster.llm.pii import find_pii
from quillroster.llm.quality import quality
from quillroster.llm.sharding import assign_shards
from quillroster.llm.substring_dedup import substring_dedup
from quillroster.llm.token_files import token_files


def vocabulary(name: str) -> str:
    """The path of a public tokenizer's file, the same on every machine."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(documents(spark, sf_dir))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(documents(spark, sf_dir))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(documents(spark, sf_dir))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(documents(spark, sf_dir))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe_encode(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"), decode=True)
    numbers = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(numbers, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op11_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_manifest(documents(spark, sf_dir), F.crc32(F.col("doc_id").cast("string")) % 7 == 0)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, F.expr("(cast(label AS long) + 1) % 10")).otherwise(F.col("label"))
    return hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0, label)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_quality": op2_quality,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_decontaminate": op4_decontaminate,
    "op5_pii": op5_pii,
    "op6_language_id": op6_language_id,
    "op7_near_duplicates": op7_near_duplicates,
    "op8_sharding": op8_sharding,
    "op9_token_files": op9_token_files,
    "op10_bpe": op10_bpe,
    "op11_nearest_neighbours": op11_nearest_neighbours,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_hard_negatives": op13_hard_negatives,
}

ORACLE_SQL: dict[str, str] = {
    "op1_exact_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
        g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
        SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
        FROM d JOIN g ON d.t = g.t
    """,
    "op3_substring_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        win AS (SELECT doc_id, i, array_to_string(w[i : i + 34], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d)),
        rep AS (SELECT s FROM win GROUP BY s HAVING count(*) > 1),
        cov AS (SELECT DISTINCT doc_id, i + k AS p FROM (SELECT doc_id, i, unnest(range(0, 35)) AS k FROM win SEMI JOIN rep USING (s))),
        words AS (SELECT doc_id, w[p] AS word, p FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d)),
        kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t FROM words ANTI JOIN cov USING (doc_id, p) GROUP BY doc_id)
        SELECT d.doc_id, len(d.w) AS n_words, coalesce(r.n, 0) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
        FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM cov GROUP BY doc_id) r USING (doc_id)
    """,
    "op12_merkle_manifest": r"""
        WITH RECURSIVE crcs AS (
            SELECT *, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
                lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END))) AS crc FROM documents),
        fields AS (
            SELECT doc_id, lang, [doc_id::VARCHAR, source, lang, n_chars::VARCHAR, text] AS f, [doc_id::VARCHAR, source, lang, (n_chars + CASE WHEN crc % 7 = 0 THEN 1 ELSE 0 END)::VARCHAR, text] AS c FROM crcs),
        leaves AS (
            SELECT doc_id, coalesce('=' || lang, '') AS g, sha256(list_aggregate(list_transform(f, lambda x: coalesce(strlen(x)::VARCHAR || ':' || x, '-')), 'string_agg', '')) AS leaf,
                sha256(list_aggregate(list_transform(c, lambda x: coalesce(strlen(x)::VARCHAR || ':' || x, '-')), 'string_agg', '')) AS changed,
                row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM fields),
        lv AS (
            SELECT g, 0 AS k, i, n, leaf AS h FROM leaves
            UNION ALL SELECT g, k + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM lv WHERE n > 1 GROUP BY g, k, i // 2, n),
        subs AS (SELECT g, h, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n FROM lv WHERE n = 1),
        tv AS (
            SELECT 0 AS k, i, n, h FROM subs
            UNION ALL SELECT k + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM tv WHERE n > 1 GROUP BY k, i // 2, n),
        steps AS (
            SELECT l.doc_id, m.k AS s, CASE WHEN o.h IS NULL THEN '' WHEN o.i % 2 = 1 THEN 'R' || o.h ELSE 'L' || o.h END AS step
            FROM leaves l JOIN (SELECT DISTINCT g, k FROM lv WHERE n > 1) m USING (g) LEFT JOIN lv o ON o.g = l.g AND o.k = m.k AND o.i = xor(l.i >> m.k, 1::BIGINT)
            UNION ALL
            SELECT l.doc_id, 1000 + m.k, CASE WHEN o.h IS NULL THEN '' WHEN o.i % 2 = 1 THEN 'R' || o.h ELSE 'L' || o.h END
            FROM leaves l JOIN subs b ON b.g = l.g CROSS JOIN (SELECT DISTINCT k FROM tv WHERE n > 1) m LEFT JOIN tv o ON o.k = m.k AND o.i = xor(b.i >> m.k, 1::BIGINT)),
        proofs AS (SELECT doc_id, list(step ORDER BY s) AS p FROM steps GROUP BY doc_id),
        folded AS (
            SELECT l.doc_id, l.leaf, b.h AS subroot, (SELECT h FROM tv WHERE n = 1) AS root, sha256(coalesce(list_aggregate(list_transform(p, lambda x: x[2:]), 'string_agg', ''), '')) AS proof_sha256,
                coalesce(list_reduce(list_prepend(l.changed, p), lambda a, x: sha256(CASE WHEN x[1] = 'L' THEN x[2:] || a ELSE a || x[2:] END)), l.changed) AS folded_root
            FROM leaves l JOIN subs b ON b.g = l.g LEFT JOIN proofs USING (doc_id))
        SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM folded
    """,
    "op13_hard_negatives": r"""
        WITH v AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
            FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_inner_product(a.e, b.e)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
        p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5),
        n AS (
            SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id)::INTEGER AS rank, other_id AS negative_id, positive_score, score AS negative_score
            FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score)
        SELECT * FROM n WHERE rank <= 5
    """,
}
