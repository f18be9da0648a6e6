"""Queries of this subpackage and, where SQL can express them, their twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runefold.llm import garbled, heavy, leaks, seen, tokens


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries whose key occurred earlier in their store."""
    return seen.seen_before(table(spark, sf_dir, "kv_log"), table(spark, sf_dir, "mem_entries"))


def p3_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the filters hold and how often they claim a key that is certainly absent."""
    return seen.audit(table(spark, sf_dir, "kv_log"), table(spark, sf_dir, "mem_entries"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys with at least 0.5 % of the log's rows that have a key."""
    return heavy.heavy_hitters(table(spark, sf_dir, "kv_log"), "key", 0.005).select(F.lower(F.hex("key")).alias("key_hex"))


def p4_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same keys with their exact row counts."""
    return heavy.heavy_hitters(table(spark, sf_dir, "kv_log"), "key", 0.005).select(F.lower(F.hex("key")).alias("key_hex"), "n_rows")


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return tokens.token_ids(table(spark, sf_dir, "documents"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that carry passages of test items, and which."""
    return leaks.leaked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p7_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The characters to remove from each document, merged."""
    return leaks.removal_spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a garbled passage."""
    documents = table(spark, sf_dir, "documents")
    return garbled.garbled(documents, garbled.fit(documents))


def p8_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same documents with the chains found and the text restored where it can be."""
    documents = table(spark, sf_dir, "documents")
    return garbled.garbled(documents, garbled.fit(documents), restored=True)


QUERIES = {f.__name__: f for f in (p3_found, p3_audit, p4_found, p4_counts, p6_ids, p7_found, p7_spans, p8_found, p8_restored)}

_FREQUENT = "from kv_log where key is not null group by key having count(*) >= 0.005 * (select count(key) from kv_log)"

SQL = {
    "p3_found": """with l as (select store_id, key, min(ts) as ts from kv_log where key is not null group by 1, 2),
        m as (select entry_id, store_id, key, ts, row_number() over (partition by store_id, key order by ts, entry_id) as n from mem_entries where key is not null and ts is not null)
        select m.entry_id from m left join l on l.store_id = m.store_id and l.key = m.key where m.n > 1 or l.ts < m.ts""",
    "p4_found": "select lower(hex(key)) as key_hex " + _FREQUENT,
    "p4_counts": "select lower(hex(key)) as key_hex, count(*) as n_rows " + _FREQUENT,
}
