"""Queries p1, p2 and p5 over the test tables, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runefold.operators import changefeed, ledger, smallfiles
from runefold.shared import parallelism, workspace


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of listed sorted tables, each once, read from the consolidated files."""
    records, _ = smallfiles.consolidated_runs(spark, *(table(spark, sf_dir, t) for t in ("kv_run", "sstables", "lsm_levels")))
    return records.select("store_id", "seq").dropDuplicates()


def p1_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and bounds that the consolidated files hold, per store: what the copy must preserve."""
    records, _ = smallfiles.consolidated_runs(spark, *(table(spark, sf_dir, t) for t in ("kv_run", "sstables", "lsm_levels")))
    return records.groupBy("store_id").agg(
        F.count("*").alias("n_rows"), F.countDistinct("sst_id").alias("n_tables"), F.sum(F.col("tombstone").cast("long")).alias("n_tombstones"), F.min("ts").alias("min_ts"), F.max("ts").alias("max_ts"), F.min(F.lower(F.hex("key"))).alias("min_key"), F.max(F.lower(F.hex("key"))).alias("max_key")
    )


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current keys of every store with the sequence number of their newest record."""
    state = changefeed.live(changefeed.fold(table(spark, sf_dir, "kv_log"), ["store_id", "key"], ["ts", "seq"]))
    return state.select("store_id", F.lower(F.hex("key")).alias("key_hex"), "seq")


def p2_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current keys with their values: the log folded onto the records that runs hold already."""
    folded = changefeed.fold(table(spark, sf_dir, "kv_log"), ["store_id", "key"], ["ts", "seq"], payload=["value"], base=table(spark, sf_dir, "kv_run"))
    return changefeed.live(folded).select("store_id", F.lower(F.hex("key")).alias("key_hex"), "ts", "seq", F.lower(F.hex("value")).alias("value_hex"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records added or changed since each store's last successful run, processed through the ledger."""
    base = workspace(spark, "ledger")
    return ledger.process(ledger.Ledger(spark, f"{base}/items"), table(spark, sf_dir, "kv_log"), table(spark, sf_dir, "wal_index"), f"{base}/out", parallelism(spark))


def p5_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same records after failures: one worker dies between writing and committing, one while
    writing, one wakes up after its lease has expired and writes other rows; a last one finishes."""
    base, now = workspace(spark, "ledger"), [0.0]
    book = ledger.Ledger(spark, f"{base}/items", clock=lambda: now[0])
    log, runs, out, items = table(spark, sf_dir, "kv_log"), table(spark, sf_dir, "wal_index"), f"{base}/out", parallelism(spark)
    plan = ledger.plan_run(book, log, runs, items)
    planned = spark.read.parquet(plan["covers"]["work"])

    def write(leases: dict, rows: DataFrame) -> None:
        for item, token in leases.items():
            rows.where(F.col(ledger.ITEM) == item).drop(ledger.ITEM).write.mode("overwrite").parquet(f"{out}/{ledger.ITEM}={item}/__token={token}")

    dead = book.lease("dies before the commit", 10, 1)
    write(dead, planned)
    book.lease("dies while writing", 10, 1)
    slow = book.lease("sleeps", 10, 1)
    now[0] = 20.0  # all leases have expired
    result = ledger.process(book, log, runs, out, items, worker="last", lease_s=1e9, most=max(1, items // 3))
    write(slow, planned.withColumn("seq", -F.col("seq")))
    for leases in (dead, slow):
        for item, token in leases.items():
            try:
                book.commit(item, token)
            except ledger.StaleLease:
                continue
            raise RuntimeError("a stale worker could commit")
    return ledger.results(book, result)


QUERIES = {f.__name__: f for f in (p1_found, p1_layout, p2_found, p2_state, p5_found, p5_resumed)}

_LISTED = r"""
with names as (select distinct store_id, regexp_extract(trim(directory_name), '([^/]+?)(?:/+\.?)*$', 1) as name from lsm_levels where directory_name is not null),
listed as (select distinct s.store_id, s.sst_id from sstables s join names n on s.store_id = n.store_id
           and regexp_extract(trim(s.base_path), '([^/]+?)(?:/+\.?)*$', 1) = n.name where n.name <> '')
"""
_HEX = "lower(hex({}))"

SQL = {
    "p1_found": _LISTED + "select distinct r.store_id, r.seq from kv_run r join listed l on r.store_id = l.store_id and r.sst_id = l.sst_id",
    "p1_layout": _LISTED
    + """select r.store_id, count(*) as n_rows, count(distinct r.sst_id) as n_tables, sum(r.tombstone::int)::bigint as n_tombstones,
           min(r.ts) as min_ts, max(r.ts) as max_ts, min(lower(hex(r.key))) as min_key, max(lower(hex(r.key))) as max_key
         from kv_run r join listed l on r.store_id = l.store_id and r.sst_id = l.sst_id group by r.store_id""",
    "p2_found": """select store_id, lower(hex(key)) as key_hex, seq from
        (select *, row_number() over (partition by store_id, key order by ts desc, seq desc) as n from kv_log where key is not null)
        where n = 1 and not coalesce(tombstone, false)""",
    "p2_state": """with r as (select store_id, key, ts, seq, tombstone, value from kv_log union all select store_id, key, ts, seq, tombstone, value from kv_run)
        select store_id, lower(hex(key)) as key_hex, ts, seq, lower(hex(value)) as value_hex from
        (select *, row_number() over (partition by store_id, key order by ts desc, seq desc, tombstone desc, value desc) as n from r where key is not null)
        where n = 1 and not coalesce(tombstone, false)""",
    "p5_found": """with done as (select store_id, arg_max(coalesce(current_value, 0), run_no) as at from wal_index where lower(trim(status)) = 'ok' group by store_id)
        select l.store_id, l.seq from kv_log l left join done d on l.store_id = d.store_id where l.key is not null
        group by l.store_id, l.seq, d.at having min(l.wal_pos) >= coalesce(d.at, 0)""",
}
SQL["p5_resumed"] = SQL["p5_found"]
