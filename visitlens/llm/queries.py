"""Registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from visitlens.llm import (
    dual_tree_search,
    embed_dedup,
    html_main,
    importance,
    packing,
    paragraph_sketch,
    pii_disclosure,
    quality_llr,
    secret_scan,
    sentencepiece_viterbi,
    sharding,
    simhash,
    warc_fixity,
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    """Where a public tokenizer's file lies; the same place on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def word_tokenizer() -> str:
    return tokenizer_file("word_bpe_49k.json")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded and decoded again."""
    return sentencepiece_viterbi.round_trips(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.main_texts(table(spark, sf_dir, "pages"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), word_tokenizer())


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_report(table(spark, sf_dir, "documents"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_report(table(spark, sf_dir, "documents"))


def op6_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


def op7_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as WARC records, audited against a replica in which the first character of one page in 16, by
    the page's own hash, was overwritten."""
    pages = table(spark, sf_dir, "pages")
    hit = F.sha2(F.col("html").cast("binary"), 256).startswith("0")
    damaged = F.when(hit, F.concat(F.lit("#"), F.substring("html", 2, 1 << 30))).otherwise(F.col("html"))
    return warc_fixity.audit_pages(pages, pages.withColumn("html", damaged))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_llr.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_disclosure.whole_report(table(spark, sf_dir, "documents"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dual_tree_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraph_sketch.edit_report(table(spark, sf_dir, "documents"))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_main_text": op2_main_text,
    "op3_packing": op3_packing,
    "op4_sharding": op4_sharding,
    "op5_secrets": op5_secrets,
    "op6_embeddings": op6_embeddings,
    "op7_warc_fixity": op7_warc_fixity,
    "op8_simhash": op8_simhash,
    "op9_quality": op9_quality,
    "op10_personal_data": op10_personal_data,
    "op11_lexical_search": op11_lexical_search,
    "op12_fingerprints": op12_fingerprints,
    "op13_resampling": op13_resampling,
}

ORACLES: dict[str, str] = {
    "op7_warc_fixity": r"""
        WITH blocks AS (
            SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html,
                   'HTTP/1.1 200 OK' || chr(13) || chr(10) || 'Content-Type: text/html; charset=utf-8'
                   || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') AS http
            FROM pages
        ), records AS (
            SELECT page_id, html, cast(page_id // 4096 AS varchar) AS file_id,
                   'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10)
                   || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10)
                   || 'WARC-Date: 2024-01-01T00:00:00Z' || chr(13) || chr(10)
                   || 'WARC-Target-URI: ' || url || chr(13) || chr(10)
                   || 'Content-Type: application/http; msgtype=response' || chr(13) || chr(10)
                   || 'Content-Length: ' || strlen(http) || chr(13) || chr(10) || chr(13) || chr(10)
                   || http || chr(13) || chr(10) || chr(13) || chr(10) AS record
            FROM blocks
        )
        SELECT page_id, file_id,
               cast(coalesce(sum(strlen(record)) OVER (PARTITION BY file_id ORDER BY page_id
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bigint) AS "offset",
               strlen(record) AS length, sha256(record) AS sha256,
               CASE WHEN sha256(html) LIKE '0%' THEN 'changed' ELSE 'sound' END AS fault
        FROM records
    """,
    # Every pair is compared here; the operator finds them through its index.
    "op6_embeddings": """
        WITH RECURSIVE v AS (
            SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
        ), link AS (
            SELECT a.vec_id AS a, b.vec_id AS b
            FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9
        ), reach AS (
            SELECT vec_id AS a, vec_id AS b FROM v
            UNION
            SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a
        ), component AS (
            SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a
        ), degree AS (
            SELECT a AS vec_id, count(*) AS n FROM link GROUP BY a
        )
        SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
        FROM component LEFT JOIN degree USING (vec_id)
    """,
    # Every document that shares a term with an item is scored here; the operator leaves out most by their bounds.
    "op11_lexical_search": r"""
        WITH words AS (
            SELECT doc_id, unnest(regexp_extract_all(
                translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
            FROM documents
        ), asked AS (
            SELECT item_id, term, count(*) AS times FROM (
                SELECT item_id, unnest(regexp_extract_all(
                    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
                FROM benchmark) GROUP BY item_id, term
        ), lengths AS (
            SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id
        ), totals AS (
            SELECT count(*) AS n_docs, cast(sum(n) AS bigint) AS n_terms FROM lengths
        ), held AS (
            SELECT doc_id, term, count(*) AS tf FROM words SEMI JOIN asked USING (term) GROUP BY doc_id, term
        ), weights AS (
            SELECT term, cast(floor(1000 * ln((2 * n_docs + 2) / cast(2 * count(*) + 1 AS double))) AS bigint) AS w
            FROM held, totals GROUP BY term, n_docs
        ), worth AS (
            SELECT doc_id, term, (1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * n_docs) // n_terms)) AS x
            FROM held JOIN lengths USING (doc_id), totals
        ), scores AS (
            SELECT item_id, doc_id, cast(sum(times * w * x) AS bigint) AS score
            FROM asked JOIN weights USING (term) JOIN worth USING (term) GROUP BY item_id, doc_id
        ), ranked AS (
            SELECT item_id, doc_id, score,
                   cast(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS integer) AS rank
            FROM scores WHERE score > 0
        )
        SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
    """,
    # The checksum is worked out byte by byte with the usual table of 256 entries.
    "op13_resampling": r"""
        WITH table_entries AS (
            SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k:
                       CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS entries
            FROM (SELECT unnest(range(256)) AS i)
        ), texts AS (
            SELECT 0 AS kind, doc_id AS id, text FROM documents
            UNION ALL
            SELECT 1, item_id, text FROM benchmark
        ), words AS (
            SELECT kind, id, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM texts
        ), features AS (
            SELECT kind, id, unnest(w) AS feature FROM words
            UNION ALL
            SELECT kind, id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM words
        ), counted AS (
            SELECT kind, id, feature, count(*) AS n FROM features GROUP BY kind, id, feature
        ), hexed AS (
            SELECT feature, hex(encode(feature)) AS h FROM (SELECT DISTINCT feature FROM counted)
        ), hashed AS (
            SELECT feature, xor(list_reduce(
                       list_prepend(4294967295, list_transform(range(1, strlen(h), 2),
                                    lambda i: cast('0x' || substr(h, cast(i AS bigint), 2) AS bigint))),
                       lambda c, b: xor(c >> 8, entries[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket
            FROM hexed, table_entries
        ), buckets AS (
            SELECT bucket, sum(n) FILTER (kind = 0) AS s, sum(n) FILTER (kind = 1) AS t
            FROM counted JOIN hashed USING (feature) GROUP BY bucket
        ), totals AS (
            SELECT coalesce(sum(s), 0) AS s_all, coalesce(sum(t), 0) AS t_all FROM buckets
        ), gains AS (
            SELECT bucket, cast(floor(1000 * ln(
                       (coalesce(t, 0) + 1)::double * (s_all + 10000)::double
                       / ((coalesce(s, 0) + 1)::double * (t_all + 10000)::double))) AS bigint) AS gain
            FROM buckets, totals
        ), weights AS (
            SELECT id AS doc_id, sum(n) AS n_features, floor(sum(n * gain) / sum(n)) AS weight
            FROM counted JOIN hashed USING (feature) JOIN gains USING (bucket) WHERE kind = 0 GROUP BY id
        ), scored AS (
            SELECT w.id AS doc_id, len(w) AS n_words, cast(coalesce(n_features, 0) AS bigint) AS n_features,
                   cast(coalesce(weight, 0) AS bigint) AS weight,
                   cast(coalesce(weight, 0) + floor(-1000 * ln(-ln(
                       (cast('0x' || substr(sha256('7:' || w.id), 1, 8) AS bigint) + 0.5::double) / 4294967296))) AS bigint) AS score
            FROM words w LEFT JOIN weights ON w.id = weights.doc_id WHERE kind = 0
        ), ranked AS (
            SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n
            FROM scored WHERE n_words >= 20
        )
        SELECT doc_id, n_features, weight, score, CASE WHEN place <= 25 * n // 100 THEN place END AS rank
        FROM scored LEFT JOIN ranked USING (doc_id)
    """,
}
