"""The registered queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cover_tree, ftrl_quality, matroska, minhash_bayes, orc_tokens, pii_boost, piece_counts, pow2_pack, secret_forest, soft_mix
from ._common import shared_folder, table
from .tokens import vocabulary


def op1_orc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark)
    orc_tokens.write_tokens(table(spark, sf_dir, "documents"), path, vocabulary("word_bpe_49k.json"), keep_space=False, end_id=2)
    return orc_tokens.digests(orc_tokens.read_tokens(spark, path))


def op2_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.round_trip(table(spark, sf_dir, "documents"))


def op3_pii_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_boost.scan(table(spark, sf_dir, "documents"))


def op4_minhash_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_bayes.near_duplicates(table(spark, sf_dir, "documents"))


OP4_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS x
  FROM documents
), s AS MATERIALIZED (
  SELECT doc_id, unnest(CASE WHEN len(x) = 0 THEN [] WHEN len(x) < 5 THEN [array_to_string(x, ' ')]
         ELSE list_distinct(list_transform(range(1, len(x) - 3), lambda i: array_to_string(x[i:i + 4], ' '))) END) AS h
  FROM w
), n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
b AS (SELECT a.doc_id AS u, c.doc_id AS v, count(*) AS m FROM s a JOIN s c USING (h) WHERE a.doc_id < c.doc_id GROUP BY ALL),
e AS MATERIALIZED (
  SELECT u, v FROM b JOIN n nu ON nu.doc_id = u JOIN n nv ON nv.doc_id = v WHERE 100 * m >= 85 * (nu.n + nv.n - m)
), g AS MATERIALIZED (SELECT u, v FROM e UNION ALL SELECT v, u FROM e),
r AS (SELECT u AS a, u AS z FROM g UNION SELECT r.a, g.v FROM r JOIN g ON g.u = r.z),
c AS (SELECT a, min(z) AS z FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.z, d.doc_id) AS component_id, coalesce(c.z, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.a = d.doc_id
"""


def op5_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_forest.findings(table(spark, sf_dir, "documents"))


def op6_soft_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return soft_mix.rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_ftrl_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ftrl_quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_counts.token_counts(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op9_pow2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pow2_pack.packed(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op10_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = cover_tree.quantised(table(spark, sf_dir, "embeddings"))
    return cover_tree.top_k(vectors, F.coalesce(F.col("id") % 50 == 0, F.lit(False)), k=5)


OP10_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 50 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_orc_tokens": op1_orc_tokens,
        "op2_matroska": op2_matroska,
        "op3_pii_boost": op3_pii_boost,
        "op4_minhash_bayes": op4_minhash_bayes,
        "op5_secret_forest": op5_secret_forest,
        "op6_soft_mix": op6_soft_mix,
        "op7_ftrl_quality": op7_ftrl_quality,
        "op8_token_counts": op8_token_counts,
        "op9_pow2_packing": op9_pow2_packing,
        "op10_cover_tree": op10_cover_tree,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_minhash_bayes": OP4_SQL, "op10_cover_tree": OP10_SQL}
