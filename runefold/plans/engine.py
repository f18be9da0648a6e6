"""Queries that run the engine and its byte forms over the test tables, and their SQL twins."""

from __future__ import annotations

import hashlib
import itertools
import struct

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runefold.engine import KvEngine
from runefold.functions import codec, hashing, integrity, simhash
from runefold.operators import compaction, ratelimit, resolve, scan, sketches, smallfiles
from runefold.plans import kv
from runefold.plans.problems import table
from runefold.schema import LOG, DBConfig
from runefold.shared import workspace
from runefold.sources import wal


def _engine(spark: SparkSession, **config) -> KvEngine:
    return KvEngine(spark, workspace(spark, "engine"), DBConfig(**config))


def _applied(spark, d, policy: str) -> KvEngine:
    """An engine that got all events in four bulk writes, each flushed; levels are so small that runs are merged."""
    e = _engine(spark, compaction_algorithm_type=policy, lsm_max_per_level=1, lsm_leveled_amplification=1, lsm_max_level=3)
    log = kv.event_log(spark, d)
    ends = log.agg(F.min("seq").alias("a"), F.max("seq").alias("b")).first()
    if ends["a"] is None:
        return e
    step = (ends["b"] - ends["a"]) // 4 + 1
    for k in range(4):
        e.apply_many(log.where(F.col("seq").between(ends["a"] + k * step, ends["a"] + (k + 1) * step - 1)))
        e.flush()
    return KvEngine(spark, e.path, e.config)  # opened again


def kv_engine_compacted(spark, d):
    """Current state from the runs that size-tiered compaction left."""
    e = _applied(spark, d, "SizeTiered")
    return kv._text(resolve.state(e.operations()), "key", "value").select("key", "value", "ts", "seq")


def kv_engine_leveled(spark, d):
    """The same by leveled compaction, and everything merged into one run at last."""
    e = _applied(spark, d, "Leveled")
    e.compact()
    if len(e.runs()) > 1:
        raise RuntimeError("a full merge leaves one run")
    return kv._text(resolve.state(e.operations()), "key", "value").select("key", "value", "ts", "seq")


def kv_engine_calls(spark, d):
    """Nations put one by one, those of region 0 deleted, all read back through the engine's single calls."""
    e, rows = _engine(spark), table(spark, d, "nation").select("n_name", "n_regionkey").collect()  # a table of fixed size
    for r in rows:
        e.insert(r["n_name"].encode(), str(r["n_regionkey"]).encode())
    for r in rows:
        if r["n_regionkey"] == 0:
            e.delete(r["n_name"].encode())
    e = KvEngine(spark, e.path, e.config)
    e.flush()
    got = [(r["n_name"], v if (v := e.get(r["n_name"].encode())) is None else v.decode()) for r in rows]
    e.shut_down()
    return spark.createDataFrame(got, "key string, value string")


def kv_engine_pages(spark, d):
    """A page of a prefix scan and one of a range scan over runs and memory; runs outside the bounds are not read."""
    e = _engine(spark)
    c = kv._customers(spark, d)
    e.apply_many(c)
    e.flush()
    one = e.prefix_scan(b"Customer#", 2, 15).select(F.lit("prefix").alias("kind"), "key", "value")
    other = e.range_scan(b"Customer#000000010", b"Customer#000000100", 1, 25).select(F.lit("range").alias("kind"), "key", "value")
    return kv._text(one.unionByName(other), "key", "value")


def kv_leveled_plan(spark, d):
    """Runs that leveled compaction merges now, per store, from the listed directories."""
    names = table(spark, d, "lsm_levels").where("level is not null").select("store_id", "level", smallfiles.last_component("directory_name").alias("name")).where("name is not null").distinct()
    runs = table(spark, d, "sstables").select("store_id", F.col("sst_id").alias("run_id"), smallfiles.last_component("base_path").alias("name"), "min_key", "max_key")
    return compaction.leveled_inputs(runs.join(names, ["store_id", "name"]).select("store_id", "level", "run_id", "min_key", "max_key").distinct(), "store_id", amplification=2)


def kv_cursor_steps(spark, d):
    """Every live key by ``next``, back to the start by ``prev``, and the first again after ``stop``; a cursor in each task walks one range of keys."""
    laid = scan.Laid(resolve.state(kv.event_log(spark, d)), block=100)
    n = laid.n_rows

    def steps(start, size):
        c = scan.Cursor(laid, place=start)
        for i in range(start, start + size):
            yield i, "next", bytes(c.next()["key"]).decode()
        if start + size == n and c.next() is not None:
            raise RuntimeError("no row follows the last")
        for i in reversed(range(start, start + size)):
            yield 2 * n - 1 - i, "prev", bytes(c.prev()["key"]).decode()
        if not start:
            if c.prev() is not None:
                raise RuntimeError("no row comes before the first")
            c.next()
            c.stop()
            yield 2 * n, "first", bytes(c.next()["key"]).decode()

    def walk(batches):
        import pyarrow as pa

        for k in (k for b in batches for k in b.column(0).to_pylist()):
            found = steps(laid.starts[k], laid.sizes[k])
            while some := list(itertools.islice(found, 10_000)):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*some)], ["step", "move", "key"])

    ranges = len(laid.files)
    return spark.range(0, ranges, 1, max(1, ranges)).mapInArrow(walk, "step long, move string, key string")


def kv_prefix_trimmed(spark, d):
    """A prefix with trailing zero bytes in its compatible form."""
    return kv._text(scan.prefix_scan(kv._customers(spark, d), b"Customer#00000\0\0", compat_trim=True), "key", "value").select("key", "value")


def kv_physical_delete(spark, d):
    """Newest versions, tombstones included, after every version of the deleted keys was removed."""
    log = kv.event_log(spark, d)
    return kv._text(resolve.resolve(resolve.without(log, resolve.deleted(log))), "key", "value").select("key", "value", "ts", "seq")


def kv_run_reads(spark, d):
    """Values of all customers' numbers taken as user keys, from a written run whose Merkle leaves fit."""
    at = f"{workspace(spark, 'run')}/run"
    compaction.write_run(compaction.merge_runs(kv.event_log(spark, d)).select(*LOG.fieldNames()), at)
    compaction.seal_run(spark, at)
    if not compaction.run_damage(spark, at).isEmpty():
        raise RuntimeError("the run is not as it was written")
    keys = table(spark, d, "customer").select(F.concat(F.lit("user/"), F.lpad(F.col("c_custkey").cast("string"), 5, "0")).cast("binary").alias("key"))
    return kv._text(resolve.batch_get(spark.read.schema(LOG).parquet(at), keys), "key", "value").select("key", "value", "ts")


def wal_append_replay(spark, d):
    """Puts and deletes appended to a log table, replayed behind its middle."""
    at = f"{workspace(spark, 'wal')}/log"
    log = kv.event_log(spark, d)
    wal.append(log.where("not tombstone"), at, 5000)
    wal.append(log.where("tombstone"), at)
    middle = log.agg(F.floor(F.max("seq") / 2).alias("m")).first()["m"] or 0
    return kv._text(wal.replay(spark, at, middle), "key", "value").select("key", "value", "tombstone", "ts", "seq")


def wal_segment_layout(spark, d):
    """Byte place of every record in the log's segments, as read back."""
    rows = wal.read_segments(wal.write_segments(kv.event_log(spark, d), 1000))
    return kv._text(rows, "key").select("segment", "place", "key")


def wal_stream_records(spark, d):
    """The event log cut at every 5,000 bytes, records over two or more files included, and read back."""
    rows = wal.read_stream(wal.cut_segments(wal.write_segments(kv.event_log(spark, d), 1000), 5000))
    return kv._text(rows, "key", "value").select("key", "value", "tombstone", "ts")


def record_bytes(spark, d):
    """The table form of every event's record, without its checksum, in fixed and variable width."""
    log = kv.event_log(spark, d)
    fixed, variable = (codec.table_record_udf("key", "value", "tombstone", "ts", F.lit(x)) for x in (False, True))
    size = F.length(F.regexp_extract(F.hex("v"), "^((?:[89A-F].)*[0-7].)", 1)) / 2  # the checksum is a number of variable length itself
    rows = log.select("seq", fixed.alias("f"), variable.alias("v"))
    return rows.select("seq", F.lower(F.hex(F.substring("f", 5, F.lit(1 << 30)))).alias("fixed"), F.lower(F.hex(F.substring("v", (size + 1).cast("int"), F.lit(1 << 30)))).alias("variable"))


def crc32c_names(spark, d):
    """CRC-32C of every customer's name."""
    return table(spark, d, "customer").select("c_custkey", integrity.crc32c_udf(F.col("c_name").cast("binary")).alias("crc"))


def merkle_bytes(spark, d):
    """Leaves of every document's tree, written to bytes and read back."""
    docs = table(spark, d, "documents").select("doc_id", integrity.leaf_hashes(F.col("text").cast("binary")).alias("leaves"))

    def there_and_back(batches):
        for pdf in batches:
            pdf["leaves"] = [integrity.merkle_from_bytes(integrity.merkle_bytes(list(x))) for x in pdf["leaves"]]
            yield pdf

    return docs.where(F.size("leaves") > 0).mapInPandas(there_and_back, "doc_id long, leaves array<string>").select("doc_id", F.posexplode("leaves").alias("chunk", "hash"))


def dict_words(spark, d):
    """Keys of all ordinals of the dictionary."""
    words = codec.dictionary(kv.event_log(spark, d))
    return kv._text(codec.dictionary_decode(words.select("ordinal"), words), "key").select("ordinal", "key")


def token_bucket_states(spark, d):
    """Stored form of every user's bucket after all requests."""
    log = table(spark, d, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "event_id")
    end = ratelimit.states(log, "user_id", "us", "event_id", capacity=3, rate=1)
    return end.select("user_id", F.lower(F.hex(ratelimit.bucket_bytes_udf(F.lit(3), "tokens", "last", F.lit(1)))).alias("state"))


# Byte forms of sketches, with hashes that SQL has too; their size follows from the parameters.


def _digest(spark, data: bytes) -> DataFrame:
    return spark.createDataFrame([(len(data), hashlib.sha256(data).hexdigest())], "n_bytes long, sha256 string")


def bloom_stored(spark, d):
    found = sketches.bloom_build(table(spark, d, "customer"), "c_name", kv.BITS, kv.HASHES)
    return _digest(spark, sketches.bloom_bytes([r[0] for r in found.collect()], kv.BITS, kv.HASHES))


def cms_stored(spark, d):
    found = sketches.cms_build(table(spark, d, "lineitem"), "l_partkey", kv.ROWS, kv.COLUMNS)
    return _digest(spark, sketches.cms_bytes([tuple(r) for r in found.collect()], kv.ROWS, kv.COLUMNS))


def hll_stored(spark, d):
    found = sketches.hll_build(table(spark, d, "events"), "user_id")
    return _digest(spark, sketches.hll_bytes([tuple(r) for r in found.collect()], 10))


# Sketches of the engine, with the hash of stored ones; keys of eight bytes, whose hashes SQL can express.


def _eights(spark, d) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", F.lpad(F.col("c_custkey").cast("string"), 8, "0").alias("k"))


def xxh3_eights(spark, d):
    """Hashes of keys of eight bytes with two seeds, the 64-bit fingerprint of the same text, and its distance to another."""
    rows = _eights(spark, d).withColumn("b", F.col("k").cast("binary"))
    first = simhash.simhash_exact_udf(F.lit("00000001"))
    return rows.select("c_custkey", *[hashing.xxh3_early_udf("b", F.lit(i).cast("bigint")).alias(f"h{i}") for i in (0, 1)], simhash.simhash_exact_udf("k").alias("fingerprint"), simhash.hamming(simhash.simhash_exact_udf("k"), first).alias("distance"))


def engine_bloom(spark, d):
    """Set bits of a named filter of the engine, from its stored bytes."""
    e = _engine(spark)
    e.bloom_filter_create(b"names", 0.01, 2000)
    e.bloom_filter_insert_many(b"names", _eights(spark, d), "k")
    found, _, _ = sketches.bloom_from_bytes(e.bloom_filter_get(b"names"))
    return spark.createDataFrame([(p,) for p in found], "position long")


def engine_count_min(spark, d):
    """Counters of a named count-min sketch of the engine, from its stored bytes."""
    e = _engine(spark)
    e.count_min_sketch_create(b"names", 0.01, 0.9)
    e.count_min_sketch_increase_many(b"names", _eights(spark, d), "k")
    found, _, _ = sketches.cms_from_bytes(e.count_min_sketch_get(b"names"))
    return spark.createDataFrame(found, "row int, col long, count long")


def engine_hyperloglog(spark, d):
    """Registers of a named HyperLogLog of the engine, from its stored bytes, with its estimate."""
    e = _engine(spark)
    e.hyperloglog_create(b"names")
    e.hyperloglog_increase_many(b"names", _eights(spark, d), "k")
    found, _ = sketches.hll_from_bytes(e.hyperloglog_get(b"names"))
    return spark.createDataFrame(found, "bucket int, rho int").withColumn("estimate", F.lit(e.hyperloglog_get_count(b"names")).cast("long"))


QUERIES = {
    f.__name__: f
    for f in (
        kv_engine_compacted, kv_engine_leveled, kv_engine_calls, kv_engine_pages, kv_leveled_plan, kv_cursor_steps, kv_prefix_trimmed, kv_physical_delete, kv_run_reads, wal_append_replay,
        wal_segment_layout, wal_stream_records, record_bytes, crc32c_names, merkle_bytes, dict_words, token_bucket_states, bloom_stored, cms_stored, hll_stored, xxh3_eights, engine_bloom, engine_count_min, engine_hyperloglog,
    )
}

_TOP = "18446744073709551616::uhugeint"


def _times(a: str, b: int) -> str:
    return f"((({a})::uhugeint * {b}::uhugeint) % {_TOP})::ubigint"


def _xxh3_sql(seed: str, source: str) -> str:
    """CTEs: ``hash`` with ``c_custkey, seed, h`` (unsigned) of the eight-digit key of every row of ``source``."""
    x = " + ".join(f"ascii(substr(k, {i + 1}, 1))::uhugeint * {256**i}::uhugeint" for i in range(8))
    secret = int.from_bytes(hashing.SECRET[:8], "little")
    return f"""h1 as (select c_custkey, r.seed, xor(({x})::ubigint, (({secret}::uhugeint + r.seed::uhugeint) % {_TOP})::ubigint) as v from (select c_custkey, lpad(c_custkey::varchar, 8, '0') as k from {source}), {seed} r(seed)),
        h2 as (select c_custkey, seed, ((8::uhugeint + {_times("xor(v, v >> 51)", hashing.P32_1)}) % {_TOP})::ubigint as v from h1),
        h3 as (select c_custkey, seed, {_times("xor(v, v >> 47)", hashing.P64_2)} as v from h2),
        h4 as (select c_custkey, seed, {_times("xor(v, v >> 37)", hashing.P64_3)} as v from h3),
        hash as (select c_custkey, seed, xor(v, v >> 32) as h from h4)"""


_SIGNED = f"(case when {{0}} >= 9223372036854775808::ubigint then {{0}}::hugeint - {_TOP.replace('uhugeint', 'hugeint')} else {{0}}::hugeint end)::bigint"


def _little(x: str, width: int) -> str:
    """Hex digits of a number, low byte first; numbers of up to eight bytes."""
    digits = f"lpad(lower(hex({x})), 16, '0')"
    return "(" + " || ".join(f"substr({digits}, {15 - 2 * i}, 2)" for i in range(min(8, width))) + (f" || '{'00' * (width - 8)}'" if width > 8 else "") + ")"


def _vlq_sql(x: str) -> str:
    """Hex digits of a number of up to 63 bits in variable length."""
    parts = [f"(case when {x} >= {1 << 7 * g}::bigint or {g} = 0 then lpad(lower(hex((({x} >> {7 * g}) & 127) | {128 if g else 0})), 2, '0') else '' end)" for g in range(8, -1, -1)]
    return "(" + " || ".join(parts) + ")"


_EV = kv.EVENTS_SQL
_STATE = f"with {kv.RESOLVED_SQL} select key, value, ts, seq from res where not tombstone"
_LIVE = f"{kv.RESOLVED_SQL}, live as (select key, row_number() over (order by key) - 1 as i, count(*) over () as n from res where not tombstone)"
_NAME = r"regexp_extract(trim({}), '([^/]+?)(?:/+\.?)*$', 1)"
_SIZE = "37 + length(key) + (case when tombstone then 0 else length(value) end)"

SQL = {
    "kv_engine_compacted": _STATE,
    "kv_engine_leveled": _STATE,
    "kv_engine_calls": "select n_name as key, case when n_regionkey = 0 then null else n_regionkey::varchar end as value from nation",
    "kv_engine_pages": """select * from (select 'prefix' as kind, c_name as key, c_mktsegment as value from customer where starts_with(c_name, 'Customer#') order by c_name limit 15 offset 30)
        union all select * from (select 'range' as kind, c_name as key, c_mktsegment as value from customer where c_name between 'Customer#000000010' and 'Customer#000000100' order by c_name limit 25 offset 25)""",
    "kv_leveled_plan": f"""with n as (select distinct store_id, level, {_NAME.format("directory_name")} as name from lsm_levels where directory_name is not null and level is not null),
        r as (select distinct s.store_id, n.level, s.sst_id, s.min_key, s.max_key from sstables s join n on s.store_id = n.store_id and {_NAME.format("s.base_path")} = n.name where n.name <> ''),
        m as (select store_id, level, min(sst_id) as main_id from r group by 1, 2 having count(*) > 5 * pow(2, level)),
        a as (select m.*, r.min_key, r.max_key from m join r on r.store_id = m.store_id and r.level = m.level and r.sst_id = m.main_id)
        select store_id, level, main_id, main_id as input_id from m union all
        select a.store_id, a.level, a.main_id, r.sst_id as input_id from a join r on r.store_id = a.store_id and r.level = a.level + 1 and r.max_key >= a.min_key and a.max_key >= r.min_key""",
    "kv_cursor_steps": f"""with {_LIVE} select i as step, 'next' as move, key from live union all select 2 * n - 1 - i as step, 'prev' as move, key from live
        union all select 2 * n as step, 'first' as move, key from live where i = 0""",
    "kv_prefix_trimmed": kv.SQL["kv_prefix_scan"],
    "kv_physical_delete": _STATE,
    "kv_run_reads": kv.SQL["kv_batch_get"],
    "wal_append_replay": f"with {_EV} select key, value, tombstone, ts, seq from ev where seq > (select max(seq) // 2 from ev)",
    "wal_segment_layout": f"""with {_EV}, n as (select *, row_number() over (order by seq) - 1 as i, {_SIZE} as size from ev)
        select (i // 1000)::bigint as segment, (sum(size) over (partition by i // 1000 order by i) - size)::bigint as place, key from n""",
    "wal_stream_records": f"with {_EV} select key, case when tombstone then null else value end as value, tombstone, ts from ev",
    "record_bytes": f"""with {_EV}, e as (select seq, ts, tombstone, case when tombstone then '' else value end as v, key from ev)
        select seq, {_little("ts", 16)} || (case when tombstone then '01' else '00' end) || {_little("length(key)", 8)} || (case when tombstone then '' else {_little("length(v)", 8)} end) || lower(hex(encode(key))) || lower(hex(encode(v))) as fixed,
            {_vlq_sql("ts")} || (case when tombstone then '01' else '00' end) || {_vlq_sql("length(key)")} || (case when tombstone then '' else {_vlq_sql("length(v)")} end) || lower(hex(encode(key))) || lower(hex(encode(v))) as variable from e""",
    "crc32c_names": f"""with recursive t as (select b::bigint as b, 0 as k, b::bigint as v from range(256) r(b) union all select b, k + 1, xor(v >> 1, case when v & 1 = 1 then {0x82F63B78} else 0 end) from t where k < 8),
        tab as (select b, v from t where k = 8),
        c as (select c_custkey, c_name, 0 as i, 4294967295::bigint as crc from customer union all
            select c.c_custkey, c.c_name, c.i + 1, xor(tab.v, c.crc >> 8) from c join tab on tab.b = xor(c.crc & 255, ascii(substr(c.c_name, c.i + 1, 1))) where c.i < length(c.c_name))
        select c_custkey, xor(crc, 4294967295) as crc from c where i = length(c_name)""",
    "merkle_bytes": kv.SQL["merkle_leaves"],
    "dict_words": f"with {_EV}, f as (select key, min(seq) as s from ev group by 1) select row_number() over (order by s, key) - 1 as ordinal, key from f",
    "token_bucket_states": f"""{kv.SQL["token_bucket_admit"].rsplit("select event_id", 1)[0]} select user_id, {_little("3", 8)} || {_little("tokens", 8)} || {_little("us", 16)} || {_little("1", 8)} as state
        from b where (user_id, n) in (select user_id, max(n) from e group by 1)""",
    "bloom_stored": f"""with p as ({kv._bloom_sql("customer", "c_name", kv.BITS, kv.HASHES)}), x as (select '{struct.pack("<BQ", kv.HASHES, kv.BITS).hex()}' || string_agg(case when p.position is null then '00' else '01' end, '' order by r.i) as x from range({kv.BITS}) r(i) left join p on p.position = r.i)
        select (length(x) // 2)::bigint as n_bytes, sha256(unhex(x)) as sha256 from x""",
    "cms_stored": f"""with {kv._CMS_SQL}, x as (select '{struct.pack("<QQ", kv.ROWS, kv.COLUMNS).hex()}' || string_agg({_little("coalesce(c.count, 0)", 8)}, '' order by r.i) as x from range({kv.ROWS * kv.COLUMNS}) r(i) left join cells c on c.row * {kv.COLUMNS} + c.col = r.i)
        select (length(x) // 2)::bigint as n_bytes, sha256(unhex(x)) as sha256 from x""",
    "hll_stored": f"""with {kv._HLL_SQL}, x as (select '{struct.pack("<dIQ", 0.7213 * 1024 / (1024 + 1.079), 10, 1024).hex()}' || string_agg(lpad(lower(hex(coalesce(rho, 0))), 2, '0'), '' order by r.i) as x from range(1024) r(i) left join reg on reg.bucket = r.i)
        select (length(x) // 2)::bigint as n_bytes, sha256(unhex(x)) as sha256 from x""",
    "xxh3_eights": f"""with {_xxh3_sql("(values (0), (1))", "customer")}, {_xxh3_sql("(values (0))", "(select 1 as c_custkey)").replace("h1 ", "o1 ").replace("h2 ", "o2 ").replace("h3 ", "o3 ").replace("h4 ", "o4 ").replace("hash as", "other as").replace("from h1)", "from o1)").replace("from h2)", "from o2)").replace("from h3)", "from o3)").replace("from h4)", "from o4)")}
        select a.c_custkey, {_SIGNED.format("a.h")} as h0, {_SIGNED.format("b.h")} as h1, {_SIGNED.format("a.h")} as fingerprint, bit_count(xor({_SIGNED.format("a.h")}, {_SIGNED.format("o.h")}))::int as distance
        from hash a join hash b on a.c_custkey = b.c_custkey and a.seed = 0 and b.seed = 1, other o""",
    "engine_bloom": f"with {_xxh3_sql(f'range({sketches.bloom_parameters(0.01, 2000)[1]})', 'customer')} select distinct (h % {sketches.bloom_parameters(0.01, 2000)[0]})::bigint as position from hash",
    "engine_count_min": f"with {_xxh3_sql(f'range({sketches.cms_parameters(0.01, 0.9)[0]})', 'customer')} select seed::int as row, (h % {sketches.cms_parameters(0.01, 0.9)[1]})::bigint as col, count(*) as count from hash group by 1, 2",
    "engine_hyperloglog": f"""with {_xxh3_sql("(values (0))", "customer")},
        reg as (select (h >> 54)::int as bucket, max(least(54, case when h = 0 then 64 else (select min(i) from range(64) r(i) where (hash.h >> i) & 1 = 1) end) + 1)::int as rho from hash group by 1)
        select bucket, rho, (select round({0.7213 * 1024 / (1024 + 1.079)!r}::double * 1024 * (1024.0::double / (sum(pow(2.0::double, -rho)) + 1024 - count(*))))::bigint from reg) as estimate from reg""",
}
