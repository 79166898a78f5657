"""The thin contract queries of the training-data operators; each runs over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, exact_dedup, language_id, media, merkle, packing, periodic, prefix_bpe, secrets, simhash, template_lines, token_counts, toxicity
from .common import table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.train(docs))


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_digest(table(spark, sf_dir, "documents"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_bpe(table(spark, sf_dir, "documents"), with_ids=False)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"), old=exact_dedup.even_half())


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents")).drop("ids")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return template_lines.line_report(table(spark, sf_dir, "documents"))


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.text_media(table(spark, sf_dir, "documents")).drop("tile")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.find_runs(table(spark, sf_dir, "documents"), tail_hash=periodic.id_hash(F.col("doc_id")), with_texts=False)


def op13_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_bpe.encode_by_prefixes(table(spark, sf_dir, "documents"), with_ids=False)


QUERIES = {f.__name__: f for f in (op1_language_id, op2_secret_scans, op3_bpe, op4_exact_dedup, op5_toxicity, op6_token_counts, op7_packing, op8_simhash, op9_line_dedup, op10_media, op11_merkle_manifest, op12_periodic_runs, op13_prefix_bpe)}

#: Equal texts share a digest: DuckDB's lower() folds more than A-Z, hence translate().
ORACLE = {
    "op4_exact_dedup": """
        WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               coalesce(doc_id = max(doc_id) OVER g, false) AS kept, text_sha256
        FROM d WINDOW g AS (PARTITION BY text_sha256)""",
    # crc32 by its definition; levels by recursion, groups and the tree above them in turn
    "op11_merkle_manifest": """
        WITH RECURSIVE
        fields AS (SELECT doc_id, coalesce('=' || lang, '') AS g, concat(' ', doc_id) AS idt,
                   concat_ws('', CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(doc_id::VARCHAR) || ':' || doc_id END,
                             CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END,
                             CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END,
                             CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(n_chars::VARCHAR) || ':' || n_chars END) AS head,
                   text, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM documents),
        leaves AS (SELECT doc_id, g, sha256(head || CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END) AS leaf,
                   sha256(head || CASE WHEN text IS NULL THEN '-' ELSE strlen(low) || ':' || low END) AS low_leaf,
                   xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(2, strlen(idt) + 1), lambda i: ascii(substr(idt, i, 1))::BIGINT)),
                       lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: xor(x >> 1, 3988292384 * (x & 1))))) % 3 = 0 AS hit FROM fields),
        placed AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY g) AS total FROM leaves),
        low AS (SELECT g, 0 AS level, place, leaf AS digest, total FROM placed
                UNION ALL SELECT g, level + 1, place // 8, sha256(string_agg(digest, '' ORDER BY place)), (any_value(total) + 7) // 8
                FROM low WHERE total > 1 GROUP BY g, level, place // 8),
        tops AS (SELECT g, digest AS subroot, level AS height, row_number() OVER (ORDER BY g) - 1 AS place, count(*) OVER () AS total FROM low WHERE total = 1),
        high AS (SELECT 0 AS level, place, subroot AS digest, total FROM tops
                 UNION ALL SELECT level + 1, place // 8, sha256(string_agg(digest, '' ORDER BY place)), (any_value(total) + 7) // 8
                 FROM high WHERE total > 1 GROUP BY level, place // 8),
        root AS (SELECT digest AS root FROM high WHERE total = 1),
        nodes AS (SELECT 'g' || g AS tree, level, place, digest FROM low WHERE total > 1 UNION ALL SELECT 'r', level, place, digest FROM high WHERE total > 1),
        runs AS (SELECT tree, level, place // 8 AS run, list(digest ORDER BY place) AS digests FROM nodes GROUP BY ALL),
        steps AS (SELECT p.g, p.place AS leaf_place, s.level AS step, s.digests, (p.place // (8 ** s.level)::BIGINT) % 8 AS spot
                  FROM placed p JOIN runs s ON s.tree = 'g' || p.g AND s.run = p.place // (8 ** (s.level + 1))::BIGINT
                  UNION ALL
                  SELECT p.g, p.place, t.height + s.level, s.digests, (t.place // (8 ** s.level)::BIGINT) % 8
                  FROM placed p JOIN tops t USING (g) JOIN runs s ON s.tree = 'r' AND s.run = t.place // (8 ** (s.level + 1))::BIGINT),
        paths AS (SELECT g, leaf_place AS place, list({'d': digests, 's': spot} ORDER BY step) AS path FROM steps GROUP BY ALL),
        folded AS (SELECT p.doc_id, p.leaf, t.subroot, r.root, coalesce(x.path, []) AS path, CASE WHEN hit THEN low_leaf ELSE leaf END AS now
                   FROM placed p JOIN tops t USING (g) CROSS JOIN root r LEFT JOIN paths x ON x.g = p.g AND x.place = p.place),
        done AS (SELECT doc_id, leaf, subroot, root,
                 sha256(coalesce(array_to_string(list_transform(path, lambda y: array_to_string(list_concat(y.d[:y.s], y.d[y.s + 2:]), '')), ''), '')) AS proof_sha256,
                 list_reduce(list_prepend(now, list_transform(path, lambda y: array_to_string(y.d[:y.s], '') || '|' || array_to_string(y.d[y.s + 2:], ''))),
                             lambda a, b: sha256(split_part(b, '|', 1) || a || split_part(b, '|', 2))) AS folded_root FROM folded)
        SELECT *, folded_root = root AS verified FROM done""",
}
