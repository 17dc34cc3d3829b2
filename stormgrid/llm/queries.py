"""Registered queries of the training-data operators: opN_<name>(spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (bpe, exact_dedup, language, near_dedup, packing, periodic_runs, pivot_index, prefix_trie, quality, recompression,
               suffix_dedup, token_store, vector_search)
from .common import prepare, table


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that no repeated window of 20 words covers."""
    prepare(spark)
    return (recompression.remove_repeats(table(spark, sf_dir, "documents"))
            .select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256")))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal texts: the row of the largest doc_id stays."""
    return (exact_dedup.exact_dedup(table(spark, sf_dir, "documents"), hash_all=True)
            .select("doc_id", "keep_id", "group_size", "kept", "text_sha256"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 ids, order kept."""
    prepare(spark)
    return packing.pack(table(spark, sf_dir, "documents"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every text."""
    prepare(spark)
    return bpe.round_trip_digest(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores, learned outside the held-out fold."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    model = quality.fit(docs, table(spark, sf_dir, "labels"), fold != 0)
    return quality.score(docs, model).select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "score",
                                             F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes that no repeated string of 50 bytes covers."""
    prepare(spark)
    return (suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
            .select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose two-word shingles agree to 80 percent."""
    prepare(spark)
    groups = near_dedup.near_groups(table(spark, sf_dir, "documents"), words=2)
    # of texts that share an id the operator keeps one; the contract compares ids only
    return groups.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all ids in compressed shards and read them back."""
    prepare(spark)
    path = token_store.fresh_path(spark)
    token_store.write_store(table(spark, sf_dir, "documents"), path)
    return token_store.read_digests(spark, path)


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each query's five best vectors."""
    prepare(spark)
    return vector_search.top_k(table(spark, sf_dir, "embeddings"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all texts, learned outside the held-out fold."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    fold = F.crc32(F.col("doc_id").cast("string")) % 4
    model = language.fit(docs, fold != 2)
    return language.identify(docs, model).select("doc_id", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "ambiguous")


def op11_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of one label with a cosine of 0.98 or more."""
    prepare(spark)
    return pivot_index.near_vectors(table(spark, sf_dir, "embeddings"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of words with at least four periods, in texts of which a tenth are given one."""
    prepare(spark)
    return periodic_runs.run_digests(periodic_runs.periodic_runs(table(spark, sf_dir, "documents"), plant=True))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of the prefix trie of all rebuilt conversations."""
    prepare(spark)
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"), rebuild=True)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_substring_dedup, op2_exact_dedup, op3_packing, op4_bpe, op5_quality, op6_suffix_dedup,
                            op7_near_dedup, op8_token_store, op9_top_k, op10_language, op11_embedding_dedup, op12_periodic_runs,
                            op13_conversation_trie)
}

ORACLE: dict[str, str] = {
    "op11_embedding_dedup": """
        WITH RECURSIVE rows AS (SELECT row_number() OVER () AS r, vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
             v AS (SELECT * FROM rows WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(e) > 0
                     AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
             links AS (SELECT a.r, b.r AS o FROM v a JOIN v b ON a.label = b.label AND a.r <> b.r AND len(a.e) = len(b.e)
                       WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
             reach AS (SELECT r, r AS o FROM v UNION SELECT reach.r, links.o FROM reach JOIN links ON links.r = reach.o),
             best AS (SELECT reach.r, min(v.vec_id) AS component_id FROM reach JOIN v ON v.r = reach.o GROUP BY 1),
             degree AS (SELECT r, count(*) AS n FROM links GROUP BY 1)
        SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(component_id, vec_id) AS component_id,
               coalesce(vec_id = coalesce(component_id, vec_id), false) AS kept
        FROM rows LEFT JOIN best USING (r) LEFT JOIN degree USING (r)""",
    "op2_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
    "op9_top_k": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
                   WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
                     AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
             p AS (SELECT q.vec_id AS query_id, c.vec_id,
                          list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2]))::BIGINT AS score
                   FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
             r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
        SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5""",
    # crc32 of the decimal id: xor with each digit, then eight steps (-1) of the reflected polynomial
    "op13_conversation_trie": """
        WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                          row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, left(coalesce(role, ''), 64), left(coalesce(text, ''), 64),
                                             sha256(coalesce(role, '') || chr(0) || coalesce(text, ''))) AS i
                   FROM conversations WHERE conv_id IS NOT NULL),
             c AS (SELECT conv_id, list(struct_pack(role := role, text := text) ORDER BY i) AS turns FROM t GROUP BY conv_id),
             h AS (SELECT conv_id, turns, xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(conv_id::VARCHAR, ''),
                            lambda x: [ord(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
                            lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END)) % 6 AS h FROM c),
             r AS (SELECT h.conv_id, list_concat(coalesce(b.turns[1:h.h], []), h.turns[h.h + 1:]) AS turns
                   FROM h LEFT JOIN c b ON b.conv_id = h.conv_id - h.conv_id % 100),
             p AS (SELECT conv_id, len(turns) AS n, d, turns[1:d] AS prefix, turns[d].text AS last
                   FROM r, LATERAL (SELECT unnest(generate_series(0, len(turns))) AS d)),
             nodes AS (SELECT prefix, d, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(any_value(length(last)), 0) AS chars,
                              sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = d), '')) AS ends_sha256
                       FROM p GROUP BY prefix, d),
             kids AS (SELECT prefix[1:d - 1] AS prefix, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1),
             known AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN kids USING (prefix)),
             above AS (SELECT prefix[1:k] AS prefix, sum((n_children = 0)::BIGINT) AS n_leaves, sum((n_convs - 1) * chars) AS saved_tokens
                       FROM known, LATERAL (SELECT unnest(generate_series(0, d)) AS k) GROUP BY 1)
        SELECT known.conv_id, known.d::BIGINT AS depth, up.conv_id AS parent_conv_id, known.n_convs, known.n_children, n_leaves::BIGINT AS n_leaves,
               saved_tokens::BIGINT AS saved_tokens, known.ends_sha256
        FROM known JOIN above USING (prefix) LEFT JOIN nodes up ON known.d > 0 AND up.prefix = known.prefix[1:known.d - 1]""",
}
