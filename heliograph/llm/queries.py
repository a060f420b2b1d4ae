"""Registered queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.llm.chat import rendered_turns
from heliograph.llm.embedding_dedup import near_vectors
from heliograph.llm.exact_dedup import exact_groups
from heliograph.llm.mixing import mixed_counts
from heliograph.llm.ngram_join import ngram_groups
from heliograph.llm.packing import pack_documents
from heliograph.llm.secret_scan import scan_digest
from heliograph.llm.sharding import shard_digest
from heliograph.llm.suffix_dedup import without_repeats
from heliograph.llm.toxicity import toxicity_scores
from heliograph.llm.trie import prefix_trie
from heliograph.llm.warc import round_trip
from heliograph.llm.whitening import whitened
from heliograph.tables import table

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages"))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = ngram_groups(table(spark, sf_dir, "documents"), k=3, num=90, den=100)
    return groups.select("doc_id", "n_shingles", "component_id")


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_digest(table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed_counts(table(spark, sf_dir, "documents"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = without_repeats(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())[1]


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rendered_turns(table(spark, sf_dir, "conversations"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_digest(table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``deviation`` as a long; null where it needs more than 63 bits."""
    return whitened(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.expr("try_cast(deviation AS long)"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_warc, op2_ngram_jaccard, op3_embedding_dedup, op4_sharding, op5_mixing,
        op6_suffix_dedup, op7_toxicity, op8_packing, op9_exact_dedup, op10_chat, op11_prefix_trie, op12_secret_scan, op13_whitening,
    )
}

ORACLES = {
    "op9_exact_dedup": r"""
        WITH d AS (
            SELECT doc_id, length(coalesce(text, '')) AS points,
                   sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
            FROM documents)
        SELECT doc_id,
               first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id) AS keep_id,
               count(*) OVER (PARTITION BY text_sha256) AS group_size,
               row_number() OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id) = 1 AS kept,
               text_sha256
        FROM d
    """,
    "op10_chat": r"""
        WITH t AS (
            SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                   row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS turn
            FROM conversations),
        p AS (
            SELECT conv_id, turn, list(struct_pack(role, text)) OVER (PARTITION BY conv_id ORDER BY turn) AS upto,
                   count(*) OVER (PARTITION BY conv_id) AS n_turns FROM t),
        whole AS (SELECT conv_id, n_turns, md5(upto::VARCHAR) AS h, row_number() OVER (PARTITION BY md5(upto::VARCHAR) ORDER BY conv_id) AS r
                  FROM p WHERE turn + 1 = n_turns),
        part AS (SELECT DISTINCT md5(upto::VARCHAR) AS h FROM p WHERE turn + 1 < n_turns),
        kept AS (SELECT conv_id, n_turns FROM whole WHERE r = 1 AND h NOT IN (SELECT h FROM part))
        SELECT t.conv_id, t.turn, kept.n_turns, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS piece
        FROM t JOIN kept USING (conv_id)
    """,
    "op1_warc": r"""
        WITH p AS (
            SELECT page_id, encode(coalesce(html, '')) AS body, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS best FROM pages),
        q AS (
            SELECT page_id, octet_length(body) AS payload_bytes, best,
                   list_transform(range(8), lambda i: ('0x' || substr(sha1(body), (5 * i + 1)::INT, 5))::INT) AS twenty FROM p)
        SELECT page_id, payload_bytes,
               array_to_string(list_transform(range(32),
                   lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((twenty[(j // 4 + 1)::INT] >> (15 - 5 * (j % 4))::INT) & 31) + 1, 1)), '') AS payload_digest,
               CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> best THEN best END AS refers_to
        FROM q
    """,
    "op11_prefix_trie": r"""
        WITH t AS (
            SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
                   row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS place
            FROM conversations WHERE conv_id IS NOT NULL),
        k AS (
            SELECT c, c - c % 20 AS head,
                   xor(list_reduce(list_concat([4294967295], list_transform(string_split(c::VARCHAR, ''), lambda s: ascii(s)::BIGINT)),
                       lambda crc, b: list_reduce(list_concat([xor(crc, b)], range(8)),
                           lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) % 4 AS h
            FROM (SELECT DISTINCT c FROM t)),
        r AS (
            SELECT k.c, t.place AS place, role, text FROM k JOIN t ON t.c = k.head AND t.place < k.h
            UNION ALL SELECT k.c, t.place + 1000000, role, text FROM k JOIN t ON t.c = k.c AND t.place >= k.h),
        p AS (
            SELECT c, row_number() OVER w AS d, text, md5(list(struct_pack(role, text)) OVER w::VARCHAR) AS node FROM r WINDOW w AS (PARTITION BY c ORDER BY place)),
        path AS (SELECT c, d, text, node FROM p UNION ALL SELECT c, 0, '', '' FROM k),
        ends AS (SELECT c, max(d) AS n FROM path GROUP BY c),
        n AS (
            SELECT path.node, any_value(d) AS depth, min(path.c) AS conv_id, count(*) AS n_convs,
                   (count(*) - 1) * len(regexp_extract_all(any_value(text), '[^\x20\x09-\x0D]+')) AS own,
                   sha256(coalesce(string_agg(path.c::VARCHAR, ',' ORDER BY path.c) FILTER (d = n), '')) AS ends_sha256
            FROM path JOIN ends USING (c) GROUP BY path.node),
        up AS (SELECT n.node, b.node AS above, n.depth - b.d AS steps FROM n JOIN path b ON b.c = n.conv_id AND b.d <= n.depth),
        kids AS (SELECT above AS node, count(*) AS n_children FROM up WHERE steps = 1 GROUP BY above),
        sums AS (SELECT above AS node, sum(own)::BIGINT AS saved_tokens, count(*) FILTER (kids.node IS NULL) AS n_leaves
                 FROM up JOIN n USING (node) LEFT JOIN kids USING (node) GROUP BY above)
        SELECT n.conv_id, n.depth, parent.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, n.ends_sha256
        FROM n JOIN sums USING (node) LEFT JOIN kids USING (node) LEFT JOIN up ON up.node = n.node AND steps = 1 LEFT JOIN n parent ON parent.node = up.above
    """,
}
