"""The registered queries of this package: opN_<name>, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .archives import converted
from .byte_bpe import encode_texts
from .exact_dedup import exact_groups
from .language import identify_all
from .licences import scan
from .metric_search import top_k
from .packing import packed_documents
from .quality import quality_scores
from .shared import read_table
from .simhash import near_groups
from .substring_dedup import substring_groups


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(read_table(spark, sf_dir, "documents"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_groups(read_table(spark, sf_dir, "documents")).drop("spans")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return converted(read_table(spark, sf_dir, "pages")).drop("record_id")


def op4_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(read_table(spark, sf_dir, "documents"), ids=False)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_all(read_table(spark, sf_dir, "pages"), read_table(spark, sf_dir, "documents"))


def op7_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read_table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(read_table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(read_table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op")}


OP10_SQL = """
WITH clean AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS t FROM documents),
     groups AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM clean GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM clean JOIN groups USING (t)
"""


OP2_SQL = """
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
     win AS (SELECT doc_id, s, array_to_string(ws[s:s+19], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS s FROM w)),
     first AS (SELECT k, min({'d': doc_id, 's': s}) AS f FROM win GROUP BY k),
     gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS p FROM win JOIN first USING (k) WHERE {'d': doc_id, 's': s} > f),
     words AS (SELECT doc_id, generate_subscripts(ws, 1) AS p, unnest(ws) AS word FROM w),
     kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
"""
OP3_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
     last AS (SELECT t, max(page_id) AS last FROM p WHERE strlen(t) >= 1000 GROUP BY t)
SELECT page_id, strlen(t) AS payload_bytes, sha1(t) AS payload_digest,
       CASE WHEN last > page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN last > page_id THEN last END AS refers_to
FROM p LEFT JOIN last USING (t)
"""

OP4_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings),
     scored AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
                FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
     ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_substring_dedup": OP2_SQL, "op3_warc": OP3_SQL, "op4_topk_search": OP4_SQL, "op10_exact_dedup": OP10_SQL}
