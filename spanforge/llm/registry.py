"""The queries opN_<name>, one for each operator of this subpackage, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spanforge.llm import bestfit, html, infill, mixing, packing, quality, ranking, sharding, shingles, substrings, tokens, vectors, warc
from spanforge.llm.shared import stage_path

Query = Callable[[SparkSession, str], DataFrame]

#: The tokenizer of op1 and op9; its path is a parameter of the operators.
TOKENIZER = "word_bpe_49k.json"


#: That of op11.
BYTE_TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.removal(table(spark, sf_dir, "documents"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingles.jaccard_components(table(spark, sf_dir, "documents"))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"))


def op6_html_rendering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op7_metric_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


def op8_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.kd_shards(table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"), tokenizer_path())


def op10_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = stage_path(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), folder)
    return warc.read(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bestfit.pack(table(spark, sf_dir, "documents"), tokenizer_path(BYTE_TOKENIZER))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = infill.restored(infill.fill_in_middle(table(spark, sf_dir, "documents")))
    return infill.digests(rows, output_sha256=rows["output"], restored_sha256=rows["restored"])


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Query] = {
    "op1_retrieval_packing": op1_retrieval_packing,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_ngram_jaccard_join": op3_ngram_jaccard_join,
    "op4_source_mixing": op4_source_mixing,
    "op5_quality_rules": op5_quality_rules,
    "op6_html_rendering": op6_html_rendering,
    "op7_metric_range_join": op7_metric_range_join,
    "op8_kd_sharding": op8_kd_sharding,
    "op9_token_counts": op9_token_counts,
    "op10_warc_archives": op10_warc_archives,
    "op11_best_fit_packing": op11_best_fit_packing,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_ranked_search": op13_ranked_search,
}

ORACLE_SQL: dict[str, str] = {
    "op3_ngram_jaccard_join": r"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS s FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
        c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        l AS (SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * k >= 75 * (p.n + q.n - k)),
        r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
        m AS (SELECT x, min(y) AS component_id FROM r GROUP BY 1)
        SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id FROM documents d LEFT JOIN n USING (doc_id) JOIN m ON x = d.doc_id
    """,
    "op4_source_mixing": mixing.SQL,
    "op7_metric_range_join": """
        WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL),
        l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
        r AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
        m AS (SELECT x, min(y) AS component_id FROM r GROUP BY 1)
        SELECT vec_id, (SELECT count(*) FROM l WHERE l.x = vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN m ON x = vec_id
    """,
    "op10_warc_archives": """
        WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
        f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM p)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN first < page_id OR page_id IS NULL AND first IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN first < page_id OR page_id IS NULL THEN first END AS refers_to
        FROM f
    """,
    "op12_fill_in_middle": infill.SQL,
    "op13_ranked_search": ranking.SQL,
}
