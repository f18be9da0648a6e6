"""Queries for the engine's own operators over the test tables, and their SQL twins.

``events`` serves as an operation log: key ``user/NNNNN``, value the event
type, errors are deletes. Every query runs over its whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from runefold.functions import codec, integrity, simhash
from runefold.functions.hashing import xxh3_early_udf
from runefold.operators import compaction, ratelimit, resolve, scan, sketches, smallfiles
from runefold.plans.problems import table
from runefold.schema import RESERVED
from runefold.sources import wal


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.concat(F.lit("user/"), F.lpad(F.col("user_id").cast("string"), 5, "0")).cast("binary").alias("key"),
        F.col("event_type").cast("binary").alias("value"),
        (F.col("event_type") == "error").alias("tombstone"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"),
        F.col("event_id").alias("seq"),
    )


def _text(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.decode(F.col(c), "UTF-8") for c in columns})


EVENTS_SQL = """ev as (select 'user/' || lpad(user_id::varchar, 5, '0') as key, event_type as value, event_type = 'error' as tombstone, epoch_us(ts) as ts, event_id as seq from events)"""
RESOLVED_SQL = EVENTS_SQL + """, res as (select * from (select *, row_number() over (partition by key order by ts desc, seq desc, tombstone desc, value desc) as n from ev) where n = 1)"""


def kv_current_state(spark, d):
    return _text(resolve.state(event_log(spark, d)), "key", "value").select("key", "value", "ts", "seq")


def kv_store_versions(spark, d):
    """All versions of every store's keys, numbered from the newest."""
    rows = table(spark, d, "kv_log").where("key is not null").select("store_id", "key", "ts", "seq").distinct()
    found = scan.numbered(rows, ["store_id", "key"], [F.desc("ts"), F.desc("seq")], "version")
    return found.select("store_id", F.lower(F.hex("key")).alias("key_hex"), "seq", F.col("version").cast("int").alias("version"))


def kv_point_get(spark, d):
    return _text(resolve.point_get(event_log(spark, d), b"user/00042"), "key", "value").select("key", "value", "ts")


def kv_batch_get(spark, d):
    """Values of all customers' numbers taken as user keys; absent ones give null."""
    keys = table(spark, d, "customer").select(F.concat(F.lit("user/"), F.lpad(F.col("c_custkey").cast("string"), 5, "0")).cast("binary").alias("key"))
    return _text(resolve.batch_get(event_log(spark, d), keys), "key", "value").select("key", "value", "ts")


def kv_get_deleted(spark, d):
    return _text(resolve.deleted(event_log(spark, d)), "key").select("key", "ts", "seq")


def kv_arrival_order(spark, d):
    return _text(resolve.last_arrival(event_log(spark, d)), "key", "value").select("key", "value", "ts", "seq")


def kv_lru_keys(spark, d):
    """What a cache of 50 keys holds after all events."""
    return _text(resolve.most_recent_keys(event_log(spark, d), 50), "key")


def _orders(spark, d) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select(F.concat(F.lit("order/"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0")).cast("binary").alias("key"), F.col("o_orderstatus").cast("binary").alias("value"), F.lit(False).alias("tombstone"), F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("ts"), F.col("o_orderkey").alias("seq"))


def kv_range_scan(spark, d):
    return _text(scan.range_scan(_orders(spark, d), b"order/000000100", b"order/000001000"), "key", "value").select("key", "value")


def kv_range_scan_page(spark, d):
    return _text(scan.page(scan.range_scan(_orders(spark, d), b"order/000000100", b"order/000001000"), 2, 20), "key", "value").select("key", "value")


def _customers(spark, d) -> DataFrame:
    c = table(spark, d, "customer")
    return c.select(F.col("c_name").cast("binary").alias("key"), F.col("c_mktsegment").cast("binary").alias("value"), F.lit(False).alias("tombstone"), F.lit(0).cast("bigint").alias("ts"), F.col("c_custkey").alias("seq"))


def kv_prefix_scan(spark, d):
    return _text(scan.prefix_scan(_customers(spark, d), b"Customer#00000"), "key", "value").select("key", "value")


def kv_prefix_scan_page(spark, d):
    return _text(scan.page(scan.prefix_scan(_customers(spark, d), b"Customer#"), 3, 20), "key", "value").select("key", "value")


def kv_prefix_scan_store(spark, d):
    """Live keys under one prefix in every store of the write-ahead log."""
    log = table(spark, d, "kv_log").where(scan.has_prefix(F.col("key"), b"acct/"))
    return resolve.state(log, by=("store_id", "key"), include_system=True).select("store_id", F.lower(F.hex("key")).alias("key_hex"), "seq")


def kv_cursor_walk(spark, d):
    """Place of every live key in key order: what a cursor visits."""
    placed = scan.positions(resolve.state(event_log(spark, d)).select("key", "value"))
    return _text(placed, "key", "value").select("position", "key", "value")


def _lineitem_runs(spark, d) -> DataFrame:
    li = table(spark, d, "lineitem")
    return li.select(
        F.concat(F.lit("part/"), F.lpad(F.col("l_partkey").cast("string"), 9, "0")).cast("binary").alias("key"),
        F.concat(F.col("l_orderkey").cast("string"), F.lit(":"), F.col("l_linenumber").cast("string")).cast("binary").alias("value"),
        (F.col("l_returnflag") == "R").alias("tombstone"),
        F.unix_micros(F.col("l_shipdate").cast("timestamp")).alias("ts"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"),
        F.col("l_linenumber").cast("bigint").alias("run_id"),
    )


def kv_compaction_merge(spark, d):
    """All runs of line items merged: newest version of each part, deletes kept."""
    return _text(compaction.merge_runs(_lineitem_runs(spark, d)), "key", "value").select("key", "value", "tombstone", "ts", "seq")


def kv_run_ranges(spark, d):
    return _text(compaction.describe(_lineitem_runs(spark, d)), "min_key", "max_key")


def _order_runs(spark, d, size: int) -> DataFrame:
    o = table(spark, d, "orders")
    key = F.lpad((F.col("o_custkey")).cast("string"), 9, "0")
    return o.groupBy(F.floor(F.col("o_orderkey") / size).cast("bigint").alias("run_id")).agg(F.min(key).alias("min_key"), F.max(key).alias("max_key"))


def kv_leveled_overlap(spark, d):
    """Pairs of an upper and a lower run with overlapping key ranges, runs being stretches of suppliers and parts."""
    uppers = table(spark, d, "supplier").groupBy(F.floor(F.col("s_suppkey") / 7).cast("bigint").alias("run_id")).agg(F.min("s_suppkey").alias("min_key"), F.max("s_suppkey").alias("max_key"))
    lowers = table(spark, d, "part").groupBy(F.floor(F.col("p_partkey") / 11).cast("bigint").alias("run_id")).agg(F.min("p_partkey").alias("min_key"), F.max("p_partkey").alias("max_key"))
    return compaction.overlap_pairs(uppers, lowers)


def kv_range_pruning(spark, d):
    """Order runs that a range scan over customers has to open."""
    return compaction.overlapping_runs(_order_runs(spark, d, 97), "000000010", "000000019")


def kv_memtable_runs(spark, d):
    """The event log cut into runs as full in-memory tables are flushed."""
    runs = compaction.cut_runs(event_log(spark, d))
    return _text(compaction.describe(runs), "min_key", "max_key")


def kv_wal_retained(spark, d):
    """Log rows per store behind the position of its last successful run: what truncation leaves."""
    from runefold.operators.ledger import committed_positions

    log = table(spark, d, "kv_log").join(committed_positions(table(spark, d, "wal_index")), "store_id", "left")
    return log.where("wal_pos >= coalesce(committed, 0)").groupBy("store_id").agg(F.count("*").alias("n_rows"), F.min("wal_pos").alias("first_pos"))


def kv_reserved_rejects(spark, d):
    log = table(spark, d, "kv_log").where(resolve.reserved(F.col("key")))
    return log.groupBy("store_id", F.lower(F.hex("key")).alias("key_hex")).agg(F.count("*").alias("n_rows"))


def kv_config_defaults(spark, d):
    c = table(spark, d, "db_configs")
    from runefold.schema import DBConfig

    k = DBConfig()
    return c.select(
        "store_id",
        F.coalesce("sstable_dir", F.lit(k.sstable_dir)).alias("sstable_dir"),
        F.coalesce("write_ahead_log_dir", F.lit(k.write_ahead_log_dir)).alias("write_ahead_log_dir"),
        F.coalesce("memory_table_type", F.lit(k.memory_table_type)).alias("memory_table_type"),
        F.coalesce("memory_table_capacity", F.lit(k.memory_table_capacity)).alias("memory_table_capacity"),
        F.coalesce("lsm_max_level", F.lit(k.lsm_max_level)).alias("lsm_max_level"),
        F.coalesce("sstable_single_file", F.lit(k.sstable_single_file)).alias("sstable_single_file"),
    )


def kv_size_tiered_plan(spark, d):
    """Levels that size-tiered compaction merges now, per store, from the listed directories."""
    listed = table(spark, d, "lsm_levels").where("level is not null").select("store_id", "level", smallfiles.last_component("directory_name").alias("name")).where("name is not null").distinct()
    return compaction.size_tiered_levels(listed, "store_id")


def xxh3_hashes(spark, d):
    """Early XXH3 of customer names with two seeds; no SQL twin exists."""
    return table(spark, d, "customer").select("c_custkey", *[xxh3_early_udf(F.col("c_name").cast("binary"), F.lit(i).cast("bigint")).alias(f"h{i}") for i in (0, 1)])


BITS, HASHES = sketches.bloom_parameters(0.01, 10_000)
ROWS, COLUMNS = sketches.cms_parameters()


def bloom_positions(spark, d):
    return sketches.bloom_build(table(spark, d, "customer"), "c_name", BITS, HASHES)


def bloom_contains(spark, d):
    """Which customer numbers a filter over the events' users claims to hold."""
    bits, hashes = sketches.bloom_parameters(0.1, 1000)
    bloom = sketches.bloom_build(table(spark, d, "events"), "user_id", bits, hashes)
    return sketches.bloom_contains(table(spark, d, "customer").select(F.col("c_custkey").alias("user_id")), "user_id", bloom, bits, hashes)


def cms_cells(spark, d):
    return sketches.cms_build(table(spark, d, "lineitem"), "l_partkey", ROWS, COLUMNS)


def cms_estimate(spark, d):
    sketch = sketches.cms_build(table(spark, d, "lineitem"), "l_partkey", ROWS, COLUMNS)
    return sketches.cms_estimate(table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey")), "l_partkey", sketch, ROWS, COLUMNS)


def hll_registers(spark, d):
    return sketches.hll_build(table(spark, d, "events"), "user_id")


def hll_estimate(spark, d):
    return sketches.hll_estimate(sketches.hll_build(table(spark, d, "events"), "user_id"))


def distinct_accurate(spark, d):
    """Distinct users by Spark's own estimator, which corrects small numbers, beside the exact number."""
    return table(spark, d, "events").agg(F.countDistinct("user_id").alias("exact"), (F.abs(F.approx_count_distinct("user_id", 0.01) - F.countDistinct("user_id")) <= 0.05 * F.countDistinct("user_id")).alias("within_5_percent"))


def simhash_fingerprint(spark, d):
    return simhash.fingerprints(table(spark, d, "documents"), "doc_id", "text")


def simhash_hamming(spark, d):
    """Distance of every document's fingerprint to that of its source's first document."""
    docs = table(spark, d, "documents").where("source is not null").select("doc_id", "source")
    prints = simhash.fingerprints(table(spark, d, "documents"), "doc_id", "text").join(docs, "doc_id")
    first = prints.groupBy("source").agg(F.min(F.struct("doc_id", "fingerprint")).alias("f")).select("source", F.col("f.fingerprint").alias("other"))
    return prints.join(first, "source").select("doc_id", simhash.hamming(F.col("fingerprint"), F.col("other")).alias("distance"))


def merkle_leaves(spark, d):
    return integrity.merkle_leaves(table(spark, d, "documents").select("doc_id", F.col("text").cast("binary").alias("data")), "doc_id", "data")


def merkle_root(spark, d):
    docs = table(spark, d, "documents").select("doc_id", integrity.leaf_hashes(F.col("text").cast("binary")).alias("leaves"))
    return docs.select("doc_id", integrity.merkle_root(F.col("leaves")).alias("root"))


def merkle_diff(spark, d):
    """Chunks that change when every digit 7 of a text becomes 8."""
    docs = table(spark, d, "documents").select("doc_id", F.col("text").cast("binary").alias("a"), F.translate("text", "7", "8").cast("binary").alias("b"))
    return integrity.merkle_diff(integrity.merkle_leaves(docs, "doc_id", "a"), integrity.merkle_leaves(docs, "doc_id", "b"), "doc_id")


def dict_encode(spark, d):
    words = codec.dictionary(event_log(spark, d))
    return _text(codec.dictionary_encode(event_log(spark, d).select("seq", "key"), words), "key").select("seq", "key", "ordinal")


def dict_decode(spark, d):
    words = codec.dictionary(event_log(spark, d))
    coded = codec.dictionary_encode(event_log(spark, d).select("seq", "key"), words).select("seq", "ordinal")
    return _text(codec.dictionary_decode(coded, words), "key").select("seq", "key")


def vlq_encode(spark, d):
    o = table(spark, d, "orders")
    return o.select("o_orderkey", F.lower(F.hex(codec.encoded(F.col("o_orderkey") * 1000))).alias("code"))


def vlq_decode(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", codec.encoded(F.col("o_orderkey") * 1000).alias("code"))
    return o.select("o_orderkey", codec.decode_udf("code").alias("r"), F.octet_length("code").alias("size")).select("o_orderkey", F.col("r.value").cast("bigint").alias("value"), F.col("r.length").alias("length"))


def wal_replay_crc(spark, d):
    """Stored records whose checksum fits after every third one was damaged: all others, in number per store."""
    log = wal.with_checksum(table(spark, d, "kv_log").where("key is not null"))
    damaged = log.withColumn("value", F.when(F.col("seq") % 3 == 0, F.concat(F.coalesce("value", F.lit(b"")), F.lit(b"!"))).otherwise(F.col("value"))).withColumn("tombstone", F.when(F.col("seq") % 3 == 0, ~F.col("tombstone")).otherwise(F.col("tombstone")))
    return wal.intact(damaged).groupBy("store_id").agg(F.count("*").alias("n_rows"))


def wal_segments_roundtrip(spark, d):
    """The event log written as byte segments and read back."""
    rows = wal.read_segments(wal.write_segments(event_log(spark, d), 1000))
    return _text(rows, "key", "value").select("key", "value", "tombstone", "ts", "error")


def token_bucket_admit(spark, d):
    log = table(spark, d, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "event_id")
    return ratelimit.admit(log, "user_id", "us", "event_id", capacity=3, rate=1).select("event_id", "granted")


QUERIES = {
    f.__name__: f
    for f in (
        kv_current_state, kv_store_versions, kv_point_get, kv_batch_get, kv_get_deleted, kv_arrival_order, kv_lru_keys, kv_range_scan, kv_range_scan_page,
        kv_prefix_scan, kv_prefix_scan_page, kv_prefix_scan_store, kv_cursor_walk, kv_compaction_merge, kv_run_ranges, kv_leveled_overlap, kv_range_pruning,
        kv_memtable_runs, kv_size_tiered_plan, kv_wal_retained, kv_reserved_rejects, xxh3_hashes, kv_config_defaults, bloom_positions, bloom_contains, cms_cells, cms_estimate, hll_registers,
        hll_estimate, distinct_accurate, simhash_fingerprint, simhash_hamming, merkle_leaves, merkle_root, merkle_diff, dict_encode, dict_decode, vlq_encode,
        vlq_decode, wal_replay_crc, wal_segments_roundtrip, token_bucket_admit,
    )
}


def _md5(value: str, seed: str) -> str:
    return f"('0x' || substr(md5({seed}::varchar || '|' || {value}::varchar), 1, 15))::bigint"


_ORDERS_SQL = "o as (select 'order/' || lpad(o_orderkey::varchar, 9, '0') as key, o_orderstatus as value from orders)"
_LINES_SQL = """li as (select 'part/' || lpad(l_partkey::varchar, 9, '0') as key, l_orderkey::varchar || ':' || l_linenumber::varchar as value,
    l_returnflag = 'R' as tombstone, epoch_us(l_shipdate) as ts, l_orderkey * 8 + l_linenumber as seq, l_linenumber::bigint as run_id from lineitem)"""


def _bloom_sql(source: str, column: str, bits: int, hashes: int) -> str:
    return f"select distinct {_md5(column, 'i')} % {bits} as position from (select distinct {column} from {source} where {column} is not null), range({hashes}) r(i)"


_CMS_SQL = f"""cells as (select r.i::int as row, {_md5("l_partkey", "r.i")} % {COLUMNS} as col, sum(n)::bigint as count
    from (select l_partkey, count(*) as n from lineitem where l_partkey is not null group by 1), range({ROWS}) r(i) group by 1, 2)"""
_HLL_SQL = f"""h as (select {_md5("user_id", "0")} as h from events where user_id is not null),
    reg as (select (h >> 50)::int as bucket, max(least(50, case when h = 0 then 64 else bit_count((h & -h) - 1) end) + 1)::int as rho from h group by 1)"""
_WORDS_SQL = "w as (select doc_id, unnest(string_split_regex(lower(regexp_replace(text, '[,;]', '', 'g')), '[\\s\\p{Z}]+')) as w from documents where text is not null)"


def _simhash_sql() -> str:
    stops = ", ".join(f"'{s}'" for s in simhash.STOP_WORDS)
    sums = " + ".join(f"(case when sum(((h >> {i}) & 1) * 2 - 1) > 0 then {1 << i} else 0 end)::bigint" for i in range(60))
    return f"""{_WORDS_SQL}, hs as (select doc_id, ('0x' || substr(md5(w), 1, 15))::bigint as h from w where w <> '' and w not in ({stops})),
        fp as (select d.doc_id, coalesce(s.f, 0) as fingerprint from documents d left join (select doc_id, {sums} as f from hs group by doc_id) s on d.doc_id = s.doc_id)"""


_LEAVES_SQL = """bytes as (select doc_id, hex(encode(text)) as x from documents where text is not null and text <> ''),
    leaves as (select doc_id, i::int as chunk, sha256(unhex(substr(x, i * 2048 + 1, 2048))) as hash from (select doc_id, x, unnest(range((length(x) + 2047) // 2048)) as i from bytes))"""


def _root_sql(levels: int = 14) -> str:
    out = [_LEAVES_SQL, "l0 as (select doc_id, chunk as i, hash from leaves)"]
    for k in range(1, levels + 1):
        out.append(f"l{k} as (select doc_id, i // 2 as i, case when count(*) = 2 then sha256(string_agg(hash, '' order by i)) else min(hash) end as hash from l{k - 1} group by doc_id, i // 2)")
    return ", ".join(out) + f" select d.doc_id, l.hash as root from documents d left join l{levels} l on d.doc_id = l.doc_id"


SQL = {
    "kv_current_state": f"with {RESOLVED_SQL} select key, value, ts, seq from res where not tombstone",
    "kv_store_versions": """select store_id, lower(hex(key)) as key_hex, seq, row_number() over (partition by store_id, key order by ts desc, seq desc) as version
        from (select distinct store_id, key, ts, seq from kv_log where key is not null)""",
    "kv_point_get": f"with {RESOLVED_SQL} select key, value, ts from res where not tombstone and key = 'user/00042'",
    "kv_batch_get": f"""with {RESOLVED_SQL}, k as (select distinct 'user/' || lpad(c_custkey::varchar, 5, '0') as key from customer)
        select k.key, r.value, r.ts from k left join (select * from res where not tombstone) r on k.key = r.key""",
    "kv_get_deleted": f"with {RESOLVED_SQL} select key, ts, seq from res where tombstone",
    "kv_arrival_order": f"with {EVENTS_SQL} select key, value, ts, seq from (select *, row_number() over (partition by key order by seq desc) as n from ev) where n = 1",
    "kv_lru_keys": f"with {EVENTS_SQL} select key, max(seq) as last_seq from ev group by key order by last_seq desc limit 50",
    "kv_range_scan": f"with {_ORDERS_SQL} select key, value from o where key between 'order/000000100' and 'order/000001000'",
    "kv_range_scan_page": f"with {_ORDERS_SQL} select key, value from o where key between 'order/000000100' and 'order/000001000' order by key limit 20 offset 40",
    "kv_prefix_scan": "select c_name as key, c_mktsegment as value from customer where starts_with(c_name, 'Customer#00000')",
    "kv_prefix_scan_page": "select c_name as key, c_mktsegment as value from customer where starts_with(c_name, 'Customer#') order by c_name limit 20 offset 60",
    "kv_prefix_scan_store": """select store_id, lower(hex(key)) as key_hex, seq from
        (select *, row_number() over (partition by store_id, key order by ts desc, seq desc) as n from kv_log where starts_with(hex(key), hex('acct/'::blob)))
        where n = 1 and not coalesce(tombstone, false)""",
    "kv_cursor_walk": f"with {RESOLVED_SQL} select row_number() over (order by key) - 1 as position, key, value from res where not tombstone",
    "kv_compaction_merge": f"""with {_LINES_SQL} select key, value, tombstone, ts, seq from
        (select *, row_number() over (partition by key order by ts desc, seq desc, tombstone desc, value desc) as n from li) where n = 1""",
    "kv_run_ranges": f"with {_LINES_SQL} select run_id, min(key) as min_key, max(key) as max_key, count(*) as n_rows from li group by run_id",
    "kv_leveled_overlap": """with u as (select (s_suppkey // 7)::bigint as id, min(s_suppkey) as a, max(s_suppkey) as b from supplier group by 1),
        l as (select (p_partkey // 11)::bigint as id, min(p_partkey) as a, max(p_partkey) as b from part group by 1)
        select u.id as upper_id, l.id as lower_id from u join l on u.b >= l.a and l.b >= u.a""",
    "kv_range_pruning": """select * from (select (o_orderkey // 97)::bigint as run_id, min(lpad(o_custkey::varchar, 9, '0')) as min_key, max(lpad(o_custkey::varchar, 9, '0')) as max_key from orders group by 1)
        where max_key >= '000000010' and '000000019' >= min_key""",
    "kv_memtable_runs": f"""with {EVENTS_SQL}, n as (select *, (row_number() over (order by seq) - 1) // 801 as run_id from ev)
        select run_id::bigint as run_id, min(key) as min_key, max(key) as max_key, count(*) as n_rows from n group by 1""",
    "kv_size_tiered_plan": r"""with recursive c as (select store_id, level, count(*) as n from
            (select distinct store_id, level, regexp_extract(trim(directory_name), '([^/]+?)(?:/+\.?)*$', 1) as name from lsm_levels where directory_name is not null and level is not null) where name <> '' group by 1, 2),
        m as (select store_id, 0 as level, n as n_runs from c where level = 0 and n > 5 union all
            select m.store_id, m.level + 1 as level, coalesce(c.n, 0) + 1 as n_runs from m left join c on c.store_id = m.store_id and c.level = m.level + 1
            where m.level < 5 and coalesce(c.n, 0) + 1 > 5)
        select store_id, level, n_runs from m""",
    "kv_wal_retained": """with done as (select store_id, arg_max(coalesce(current_value, 0), run_no) as at from wal_index where lower(trim(status)) = 'ok' group by store_id)
        select l.store_id, count(*) as n_rows, min(wal_pos) as first_pos from kv_log l left join done d on l.store_id = d.store_id where wal_pos >= coalesce(d.at, 0) group by 1""",
    "kv_reserved_rejects": "select store_id, lower(hex(key)) as key_hex, count(*) as n_rows from kv_log where "
    + " or ".join(f"starts_with(lower(hex(key)), '{p.hex()}')" for p in RESERVED)
    + " group by 1, 2",
    "kv_config_defaults": """select store_id, coalesce(sstable_dir, './sstables/') as sstable_dir, coalesce(write_ahead_log_dir, './wal/') as write_ahead_log_dir,
        coalesce(memory_table_type, 'BTree') as memory_table_type, coalesce(memory_table_capacity, 1000) as memory_table_capacity,
        coalesce(lsm_max_level, 5) as lsm_max_level, coalesce(sstable_single_file, false) as sstable_single_file from db_configs""",
    "bloom_positions": _bloom_sql("customer", "c_name", BITS, HASHES),
    "bloom_contains": "with b as ({}), q as (select distinct c_custkey as user_id from customer) select user_id, bool_and(position in (select position from b)) as contained from (select user_id, {} % {} as position from q, range({}) r(i)) group by 1".format(
        _bloom_sql("events", "user_id", *sketches.bloom_parameters(0.1, 1000)), _md5("user_id", "i"), *sketches.bloom_parameters(0.1, 1000)
    ),
    "cms_cells": f"with {_CMS_SQL} select * from cells",
    "cms_estimate": f"""with {_CMS_SQL} select q.l_partkey, min(coalesce(c.count, 0))::bigint as estimate from
        (select p_partkey as l_partkey, r.i::int as row, {_md5("p_partkey", "r.i")} % {COLUMNS} as col from (select distinct p_partkey from part), range({ROWS}) r(i)) q
        left join cells c on q.row = c.row and q.col = c.col group by 1""",
    "hll_registers": f"with {_HLL_SQL} select * from reg",
    "hll_estimate": f"with {_HLL_SQL} select round({0.7213 * 1024 / (1024 + 1.079)!r}::double * 1024 * (1024.0::double / (sum(pow(2.0::double, -rho)) + 1024 - count(*))))::bigint as estimate from reg",
    "distinct_accurate": "select count(distinct user_id) as exact, true as within_5_percent from events",
    "simhash_fingerprint": f"with {_simhash_sql()} select doc_id, fingerprint from fp",
    "simhash_hamming": f"""with {_simhash_sql()}, p as (select fp.*, d.source from fp join documents d on fp.doc_id = d.doc_id where d.source is not null),
        f as (select source, arg_min(fingerprint, doc_id) as other from p group by 1) select p.doc_id, bit_count(xor(p.fingerprint, f.other))::int as distance from p join f on p.source = f.source""",
    "merkle_leaves": f"with {_LEAVES_SQL} select doc_id, chunk, hash from leaves",
    "merkle_root": f"with {_root_sql()}",
    "merkle_diff": "with "
    + _LEAVES_SQL
    + ", "
    + _LEAVES_SQL.replace("encode(text)", "encode(replace(text, '7', '8'))").replace("bytes as", "bytes2 as").replace("from bytes", "from bytes2").replace("leaves as", "leaves2 as")
    + " select a.doc_id, a.chunk from leaves a join leaves2 b on a.doc_id = b.doc_id and a.chunk = b.chunk where a.hash <> b.hash",
    "dict_encode": f"""with {EVENTS_SQL}, f as (select key, min(seq) as s from ev group by 1), n as (select key, row_number() over (order by s, key) - 1 as ordinal from f)
        select ev.seq, ev.key, n.ordinal from ev join n on ev.key = n.key""",
    "dict_decode": f"with {EVENTS_SQL} select seq, key from ev",
    "vlq_encode": """select o_orderkey, lower(ltrim(string_agg(case when g > 0 and (v >> (7 * g)) = 0 then '' else lpad(hex((v >> (7 * g)) & 127 | (case when g > 0 then 128 else 0 end)), 2, '0') end, '' order by g desc))) as code
        from (select o_orderkey, o_orderkey * 1000 as v from orders), range(9) r(g) group by o_orderkey""",
    "vlq_decode": "select o_orderkey, o_orderkey * 1000 as value, (case when o_orderkey = 0 then 1 else floor(log2(o_orderkey * 1000) / 7) + 1 end)::int as length from orders",
    "wal_replay_crc": "select store_id, count(*) as n_rows from kv_log where key is not null and seq % 3 <> 0 group by 1",
    "wal_segments_roundtrip": f"with {EVENTS_SQL} select key, case when tombstone then null else value end as value, tombstone, ts, null::varchar as error from ev",
    "token_bucket_admit": """with recursive e as (select user_id, event_id, epoch_us(ts) as us, row_number() over (partition by user_id order by ts, event_id) as n from events where user_id is not null and ts is not null),
        b as (select user_id, event_id, us, n, 3 - 1 as tokens, true as granted from e where n = 1 union all
        select e.user_id, e.event_id, e.us, e.n, t.have - (case when t.have >= 1 then 1 else 0 end) as tokens, t.have >= 1 as granted
        from b join e on e.user_id = b.user_id and e.n = b.n + 1, lateral (select least(3, b.tokens + trunc((e.us - b.us) / 1000000.0)::int) as have) t)
        select event_id, granted from b""",
}
