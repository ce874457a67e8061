"""The training-data queries by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm import license_scan
from tideline.llm.common import read

Query = Callable[[SparkSession, str], DataFrame]


#: Host, path and verdict of the query's rules.
URL_RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listed are the urls of the pages whose id is labelled toxic."""
    from tideline.llm.url_filter import Rule, filter_urls

    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    toxic = read(spark, sf_dir, "labels").filter("toxic = 1").select(F.col("doc_id").alias("page_id"))
    listed = pages.join(toxic, "page_id", "left_semi").select("url")
    return filter_urls(pages, listed, [Rule(*rule) for rule in URL_RULES])


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(read(spark, sf_dir, "documents"))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tideline.llm.decontaminate import find_leaks

    return find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tideline.llm.warc import read_warc, write_warc

    pages = read(spark, sf_dir, "pages")
    kind = pages.schema["page_id"].dataType
    return read_warc(write_warc(pages, min_bytes=0)).select(
        F.col("page_id").cast(kind).alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.col("refers_to").cast(kind).alias("refers_to"),
    )


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tideline.llm.packing import pack_documents

    docs = read(spark, sf_dir, "documents")
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2, capacity=1024)


def op6_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tideline.llm.sharding import shard_documents

    return shard_documents(read(spark, sf_dir, "documents"), shards=24)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tideline.llm.tokens import count_tokens

    return count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), 4096)


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tideline.llm.near_dedup import near_duplicates

    return near_duplicates(read(spark, sf_dir, "documents"), width=3, threshold=0.85)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tideline.llm.language import identify_languages

    return identify_languages(read(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tideline.llm.quality import judge_documents

    return judge_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


ORACLES = {
    "op1_url_filter": r"""
        with p as (
            select page_id,
                coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
                coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path
            from pages),
        listed as (
            select distinct host || path as key from p
            where host || path <> '' and page_id in (select doc_id from labels where toxic = 1)),
        r(verdict, rhost, rpath) as (values ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'),
            ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
        judged as (
            select p.*, host || path in (select key from listed) as listed,
                (select max_by(struct_pack(rule := rhost || rpath, verdict := verdict), length(rhost || rpath)) from r
                 where (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath)) as best
            from p)
        select page_id, host, path, best.rule as rule, listed,
            coalesce(best.verdict, case when listed then 'block' else 'allow' end) as verdict
        from judged""",
    "op2_license_scan": license_scan.oracle_sql(),
}


def queries() -> dict[str, Query]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
