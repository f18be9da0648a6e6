"""Resolution, scans, runs, sketches, rate limiting, log and facade, against dictionary models."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from runefold.engine import KvEngine
from runefold.operators import compaction, ratelimit, resolve, scan, sketches
from runefold.plans import engine as plans
from runefold.schema import LOG, DBConfig, ProbabilisticTypeError, ReservedKeyError, TokenBucketError
from runefold.sources import wal

OPS = "key binary, value binary, tombstone boolean, ts long, seq long"


def random_ops(n: int, seed: int = 1) -> list[tuple]:
    r = random.Random(seed)
    keys = [b"", b"a", b"a\0", b"ab", b"b", b"\xff", b"\xff\xff", "老".encode(), b"bl00m_f1lt3r/x"]
    return [(r.choice([*keys, None]), r.choice([b"", b"v%d" % i, None]), r.random() < 0.3, r.randrange(20), i) for i in range(n)]


def model(ops):
    newest = {}
    for k, v, dead, ts, seq in ops:
        if k is not None and (k not in newest or (ts, seq) > newest[k][2:]):
            newest[k] = (v, dead, ts, seq)
    return newest


def as_bytes(v):
    return None if v is None else bytes(v)


def test_resolve_matches_model_in_any_order_with_repeats(spark):
    ops = random_ops(300)
    want = model(ops)
    shuffled = ops + ops[:100]
    random.Random(5).shuffle(shuffled)
    df = spark.createDataFrame(shuffled, OPS).repartition(5)
    got = {as_bytes(r["key"]): (as_bytes(r["value"]), r["tombstone"], r["ts"], r["seq"]) for r in resolve.resolve(df).collect()}
    assert got == want
    live = {as_bytes(r["key"]) for r in resolve.state(df, include_system=True).collect()}
    assert live == {k for k, v in want.items() if not v[1]}
    assert b"bl00m_f1lt3r/x" not in {as_bytes(r["key"]) for r in resolve.state(df).collect()}


def test_resolve_empty_and_extra_columns(spark):
    empty = spark.createDataFrame([], OPS)
    assert resolve.resolve(empty).count() == 0
    odd = spark.createDataFrame([(b"k", b"v", False, 1, 1, "x", 3)], OPS + ", `__v` string, count int")
    assert [tuple(r)[:1] for r in resolve.resolve(odd).collect()] == [(bytearray(b"k"),)]


def test_gets(spark):
    ops = spark.createDataFrame([(b"a", b"1", False, 1, 1), (b"a", None, True, 2, 2), (b"b", b"", False, 1, 3)], OPS)
    assert resolve.point_get(ops, b"a").count() == 0
    assert as_bytes(resolve.point_get(ops, b"b").first()["value"]) == b""
    asked = spark.createDataFrame([(b"a",), (b"b",), (b"c",), (None,), (b"b",)], "key binary")
    assert {as_bytes(r["key"]): as_bytes(r["value"]) for r in resolve.batch_get(ops, asked).collect()} == {b"a": None, b"b": b"", b"c": None}
    assert [as_bytes(r["key"]) for r in resolve.deleted(ops).collect()] == [b"a"]


def test_key_filter_is_pushed_to_the_scan(spark, tmp_path):
    spark.createDataFrame([(b"a", b"1", False, 1, 1)], OPS).write.parquet(str(tmp_path / "t"))
    plan = scan.prefix_scan(spark.read.parquet(str(tmp_path / "t")), b"ab\xff")._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(key" in plan and "LessThan(key" in plan


def test_successor():
    assert scan.successor(b"ab") == b"ac" and scan.successor(b"a\xff") == b"b" and scan.successor(b"\xff\xff") is None and scan.successor(b"") is None


@pytest.fixture(scope="module")
def alphabet(spark):
    keys = [bytes([a, b]) for a in range(65, 91) for b in range(65, 91)]
    return spark.createDataFrame([(k, k, False, 1, i) for i, k in enumerate(keys)], OPS).cache(), keys


def test_prefix_and_range_pages(spark, alphabet):
    ops, keys = alphabet
    got = [as_bytes(r["key"]) for r in scan.page(scan.prefix_scan(ops, b"B"), 1, 10).collect()]
    assert got == [k for k in keys if k[:1] == b"B"][10:20]
    assert scan.page(scan.range_scan(ops, b"AA", b"ZZ"), 0, 0).count() == 0
    assert scan.range_scan(ops, b"C", b"B").count() == 0
    assert scan.prefix_scan(ops, b"").count() == len(keys)
    with pytest.raises(ValueError):
        scan.page(ops, -1, 5)


def test_positions(spark, alphabet):
    ops, keys = alphabet
    placed = {as_bytes(r["key"]): r["position"] for r in scan.positions(resolve.state(ops)).collect()}
    assert placed == {k: i for i, k in enumerate(keys)}


def test_cursor(spark, alphabet):
    ops, keys = alphabet
    c = scan.Cursor(scan.prefix_scan(ops, b"A"), block=7)
    assert c.prev() is None
    walked = [as_bytes(c.next()["key"]) for _ in range(26)]
    assert walked == keys[:26] and c.next() is None
    assert [as_bytes(c.prev()["key"]) for _ in range(26)] == keys[:26][::-1] and c.prev() is None
    c.next()
    c.stop()
    assert as_bytes(c.next()["key"]) == b"AA"


def test_merge_keeps_state_and_tombstones(spark):
    ops = random_ops(200, 7)
    df = spark.createDataFrame(ops, OPS)
    once = compaction.merge_runs(df.where("seq < 120")).select(*LOG.fieldNames()).unionByName(df.where("seq >= 120"))
    assert sorted(map(str, resolve.resolve(once).collect())) == sorted(map(str, resolve.resolve(df).collect()))


def test_runs_are_cut_as_tables_fill(spark):
    ops = spark.createDataFrame([(b"k%d" % (i % 7), None, False, i, i) for i in range(2000)], OPS)
    sizes = [r["n_rows"] for r in compaction.describe(compaction.cut_runs(ops)).orderBy("run_id").collect()]
    assert sizes == [801, 801, 398]


def test_overlap_pairs_against_brute_force(spark):
    r = random.Random(3)
    runs = lambda n: [(i, a := r.randrange(1000), a + r.randrange(60)) for i in range(n)]
    up, low = runs(60), runs(80)
    df = lambda x: spark.createDataFrame(x, "run_id long, min_key long, max_key long")
    got = sorted(tuple(p) for p in compaction.overlap_pairs(df(up), df(low), buckets=8).collect())
    assert got == sorted((a, b) for a, p, q in up for b, s, t in low if q >= s and t >= p)


def test_compaction_plans():
    run = lambda i, a="a", b="z": compaction.Run(i, a, b)
    p = compaction.size_tiered([[run(i) for i in range(6)], [run(9)], []], 5, 10)
    assert p.merges == [compaction.Merge((0, 1, 2, 3, 4, 5), 1, 10)] and [len(x) for x in p.levels] == [0, 2, 0]
    assert compaction.size_tiered([[run(i) for i in range(5)], [], []], 5, 10).merges == []
    p = compaction.size_tiered([[run(i) for i in range(3)], [run(7), run(8)], [run(9)]], 2, 10)
    assert [m.level for m in p.merges] == [1, 2] and [len(x) for x in p.levels] == [0, 0, 2]
    p = compaction.leveled([[run(0, "c", "f"), run(1)], [run(5, "a", "b"), run(6, "e", "k")], []], 1, 10, 10)
    assert p.merges == [compaction.Merge((6, 0), 1, 10)]
    assert p.levels[1] == [run(5, "a", "b"), run(10, "c", "k")] and p.levels[0] == [run(1)]


def test_written_run_is_sorted(spark, tmp_path):
    ops = spark.createDataFrame(random_ops(100, 2), OPS).where("key is not null")
    compaction.write_run(compaction.merge_runs(ops), str(tmp_path / "run"), 1)
    keys = [as_bytes(r["key"]) for r in spark.read.parquet(str(tmp_path / "run")).collect()]
    assert keys == sorted(set(keys)) and keys


def test_bloom(spark):
    assert sketches.bloom_parameters() == (4792529, 2)
    assert sketches.bloom_parameters(0.01, 10) == (9585, 6)
    assert sketches.bloom_parameters(0.5, 1000)[1] == 0
    bits, hashes = sketches.bloom_parameters(0.01, 1000)
    members = spark.createDataFrame([(str(i),) for i in range(0, 400, 2)] + [(None,)], "v string")
    halves = sketches.bloom_union(*(sketches.bloom_build(members.where(c), "v", bits, hashes) for c in ("v < '2'", "v >= '2'")))
    asked = spark.createDataFrame([(str(i),) for i in range(400)] + [(None,)], "v string")
    got = {r["v"]: r["contained"] for r in sketches.bloom_contains(asked, "v", halves, bits, hashes).collect()}
    assert all(got[str(i)] for i in range(0, 400, 2)) and sum(got[str(i)] for i in range(1, 400, 2)) < 12 and None not in got
    assert all(r["contained"] for r in sketches.bloom_contains(asked, "v", halves, bits, 0).collect())
    data = sketches.bloom_bytes([1, 5], 10, 3)
    assert sketches.bloom_from_bytes(data) == ([1, 5], 10, 3)
    with pytest.raises(ValueError):
        sketches.bloom_from_bytes(data[:-1])


def test_count_min(spark):
    assert sketches.cms_parameters() == (16, 4096)
    with pytest.raises(ValueError):
        sketches.cms_parameters(0.1, 1.0)
    rows, columns = sketches.cms_parameters()
    values = spark.createDataFrame([("video1",), ("video2",), ("video3",), ("video4",), ("video4",), (None,)], "v string")
    s = sketches.cms_build(values, "v", rows, columns)
    s = sketches.cms_union(s, s)
    asked = spark.createDataFrame([("video1",), ("video4",), ("none",)], "v string")
    assert {r["v"]: r["estimate"] for r in sketches.cms_estimate(asked, "v", s, rows, columns).collect()} == {"video1": 2, "video4": 4, "none": 0}
    cells = [(0, 1, 5), (1, 3, 7)]
    assert sketches.cms_from_bytes(sketches.cms_bytes(cells, 2, 4)) == (cells, 2, 4)


def test_hyperloglog(spark):
    empty = sketches.hll_build(spark.createDataFrame([], "v string"), "v")
    assert sketches.hll_estimate(empty).first()["estimate"] == 738
    values = spark.range(10000).select(F.concat(F.lit("test"), F.col("id")).alias("v"))
    s = sketches.hll_build(values, "v")
    n = sketches.hll_estimate(sketches.hll_union(s, s)).first()["estimate"]
    assert abs(n - 10000) < 800
    assert sketches.hll_from_bytes(sketches.hll_bytes([(3, 4)], 4)) == ([(3, 4)], 4)
    assert sketches.hll_precision(1) == 4 and sketches.hll_precision(99) == 16


def test_token_bucket(spark):
    tokens, ok = ratelimit.step(100, None, 0, 50, 100, 10)
    tokens, refused = ratelimit.step(tokens, 0, 1000, 60, 100, 10)
    tokens, later = ratelimit.step(tokens, 1000, 6_001_000, 60, 100, 10)
    assert (ok, refused, later) == (True, False, True)
    rows = [(b, t and t * 1000, i) for i, (b, t) in enumerate([("a", j) for j in range(1000)] + [("b", 0), (None, 1), ("b", None)])]
    got = ratelimit.admit(spark.createDataFrame(rows, "b string, us long, i long"), "b", "us", "i", capacity=10, rate=100).collect()
    assert sum(r["granted"] for r in got if r["b"] == "a") == 10 and len(got) == len(rows)
    assert [r["granted"] for r in got if r["b"] is None or r["us"] is None] == [False, False]
    assert ratelimit.bucket_from_bytes(ratelimit.bucket_bytes(5, 3, 1 << 70, 9)) == (5, 3, 1 << 70, 9)


@pytest.mark.parametrize(("capacity", "rate", "cost"), [(3, 1, 1), (40, 1, 1), (9, 2, 3), (300, 1, 1)])
def test_a_hot_bucket_fills_many_tasks(spark, capacity, rate, cost):
    r = random.Random(capacity)
    t, rows = 0, []
    for i in range(3000):
        t += r.choice([0, 1000, 90_000, 400_000, 1_200_000])
        rows.append(("hot" if i % 10 < 8 else f"b{r.randrange(5)}", t, i))
    rows += [(None, 5, 9001), ("hot", None, 9002)]
    df = spark.createDataFrame(rows, "b string, t long, i int").repartition(3)
    got = {x["i"]: x["granted"] for x in ratelimit.admit(df, "b", "t", "i", capacity, rate, cost).collect()}
    state, want = {}, {9001: False, 9002: False}
    for b, t, i in rows[:3000]:
        tokens, last = state.get(b, (capacity, None))
        tokens, want[i] = ratelimit.step(tokens, last, t, cost, capacity, rate)
        state[b] = (tokens, t)
    assert got == want and 0 < sum(got.values()) < 3000


def test_a_hot_key_is_numbered_in_ranges(spark):
    rows = [(1 if i % 3 else None, b"hot" if i % 10 else b"k%d" % (i % 50), i) for i in range(2000)]
    got = scan.numbered(spark.createDataFrame(rows, "s int, key binary, n int"), ["s", "key"], [F.desc("n")], "number").collect()
    want = {}
    for s, k, n in sorted(rows, key=lambda r: -r[2]):
        want.setdefault((s, k), []).append(n)
    assert {(r["s"], as_bytes(r["key"]), r["n"]): r["number"] for r in got} == {(*g, n): i + 1 for g, ns in want.items() for i, n in enumerate(ns)}


def test_cursor_holds_one_block_in_both_directions(spark, alphabet):
    ops, keys = alphabet
    c, r, at = scan.Cursor(scan.prefix_scan(ops, b"A"), block=5), random.Random(2), 0
    for _ in range(60):
        if r.random() < 0.6:
            row = c.next()
            assert (row and as_bytes(row["key"])) == (keys[at] if at < 26 else None)
            at = min(26, at + 1)
        else:
            row = c.prev()
            assert (row and as_bytes(row["key"])) == (keys[at - 1] if at else None)
            at = max(0, at - 1)
        assert len(c.held) <= 5


def jobs_of(spark, group, f):
    """What ``f`` returns, and how many Spark jobs it ran."""
    spark.sparkContext.setJobGroup(group, group)
    try:
        return f(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext._jsc.clearJobGroup()


def test_a_walk_of_many_blocks_runs_its_query_once(spark, alphabet):
    ops, keys = alphabet
    c = scan.Cursor(resolve.state(ops), block=7)

    def walk():
        there = [c.next() for _ in keys]
        assert c.next() is None and c.next() is None and len(c.held) <= 7
        back = [c.prev() for _ in keys]
        assert c.prev() is None and len(c.held) <= 7
        return there, back

    (there, back), jobs = jobs_of(spark, "walk", walk)
    assert there == resolve.state(ops).orderBy("key").collect() == back[::-1]
    assert jobs <= 10  # of 97 blocks in each direction
    r, at = random.Random(5), 0
    for _ in range(3000):
        if r.random() < 0.6:
            row, want, at = c.next(), keys[at : at + 1], min(len(keys), at + 1)
        else:
            row, want, at = c.prev(), keys[at - 1 : at] if at else [], max(0, at - 1)
        assert [as_bytes(x["key"]) for x in (row,) if x] == want
    laid = c.laid
    c.stop()
    assert as_bytes(c.next()["key"]) == keys[0] and c.laid is None and c.prev() == there[0]
    with pytest.raises(FileNotFoundError):
        open(laid.files[-1].removeprefix("file://"))  # deleted


@pytest.mark.parametrize("n", [0, 1, 6, 7, 8, 14, 15])
def test_cursor_at_the_ends_of_blocks(spark, n):
    keys = [b"%03d" % i for i in range(n)]
    df = spark.createDataFrame([(k, b"v", False, 1, i) for i, k in enumerate(keys)], OPS)
    laid = scan.Laid(df, 7)
    assert laid.n_rows == n
    for c in (scan.Cursor(df, block=7), scan.Cursor(laid)):
        for _ in range(2):
            assert c.prev() is None
            assert [as_bytes(c.next()["key"]) for _ in keys] == keys and c.next() is None and c.next() is None
            assert [as_bytes(c.prev()["key"]) for _ in keys] == keys[::-1] and c.prev() is None
            c.stop()
    for i in range(n + 1):
        after, before = scan.Cursor(laid, place=i), scan.Cursor(laid, place=i)
        assert ((row := after.next()) and as_bytes(row["key"])) == (keys[i] if i < n else None)
        assert ((row := before.prev()) and as_bytes(row["key"])) == (keys[i - 1] if i else None)
    with pytest.raises(ValueError):
        scan.Cursor(df, block=0)


@pytest.mark.parametrize("users", [0, 1, 1999])
def test_cursor_steps_of_many_keys(spark, tmp_path, users):
    r = random.Random(users)
    rows = [(i, datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=r.randrange(50)), r.randrange(users), r.choice(["view", "click", "error"])) for i in range(3 * users)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    newest = {}
    for i, ts, user, kind in rows:
        newest[user] = max(newest.get(user, (ts, i, kind)), (ts, i, kind))
    live = [f"user/{u:05}" for u in sorted(newest) if newest[u][2] != "error"]
    want = [(i, "next", k) for i, k in enumerate(live)] + [(len(live) + i, "prev", k) for i, k in enumerate(live[::-1])] + [(2 * len(live), "first", k) for k in live[:1]]
    got, jobs = jobs_of(spark, f"steps-{users}", lambda: plans.kv_cursor_steps(spark, str(tmp_path)).collect())
    assert sorted(tuple(x) for x in got) == want
    assert jobs <= 10


def test_log_segments_and_damage(spark, tmp_path):
    ops = spark.createDataFrame([(b"k%d" % i, None if i % 2 else b"v" * i, bool(i % 2), i, i) for i in range(50)], OPS)
    segments = wal.write_segments(ops, 20)
    rows = wal.read_segments(segments).collect()
    assert len(rows) == 50 and not any(r["error"] for r in rows) and {r["segment"] for r in rows} == {0, 1, 2}
    broken = segments.withColumn("data", F.when(F.col("segment") == 0, F.concat(F.lit(b"!"), F.substring("data", 2, 1 << 30))).when(F.col("segment") == 1, F.substring("data", 1, 40)).otherwise(F.col("data")))
    errors = [r["error"] for r in wal.read_segments(broken).collect()]
    assert errors.count("crc") == 1 and errors.count("torn") == 1 and errors.count(None) == 19 + 10
    wal.append(ops, str(tmp_path / "log"), 10)
    assert wal.replay(spark, str(tmp_path / "log"), 39).count() == 10
    checked = wal.with_checksum(ops)
    assert wal.intact(checked).count() == 50
    assert wal.intact(checked.withColumn("ts", F.col("ts") + 1)).count() == 0


@pytest.mark.parametrize("size", [40, 64, 300, 5000])
def test_records_that_span_files(spark, size):
    rows = [(b"k%d" % i, b"v" * (i * 7 % 90), i % 9 == 0, i, i) for i in range(60)] + [(b"long", b"x" * 700, False, 60, 60)]
    files = wal.cut_segments(wal.write_segments(spark.createDataFrame(rows, OPS), 13), size)
    assert files.agg(F.max(F.octet_length("data"))).first()[0] <= size
    got = wal.read_stream(files).collect()
    assert sorted((as_bytes(r["key"]), as_bytes(r["value"]), r["ts"], r["error"]) for r in got) == sorted((k, None if d else v, t, None) for k, v, d, t, _ in rows)
    last = files.agg(F.max("file")).first()[0]
    cut = wal.read_stream(files.where(F.col("file") < last)).collect()
    assert sum(r["error"] == "torn" for r in cut) <= 1 and {r["error"] for r in cut} <= {None, "torn"}


def test_config(tmp_path):
    c = DBConfig(memory_table_capacity=500)
    c.save(str(tmp_path / "c.json"))
    assert DBConfig.load(str(tmp_path / "c.json")) == c
    (tmp_path / "d.json").write_text('{"lsm_max_level": null, "other": 1}')
    assert DBConfig.load(str(tmp_path / "d.json")) == DBConfig()
    with pytest.raises(ValueError):
        DBConfig(lsm_max_level=1)


def test_engine_end_to_end(spark, tmp_path):
    now = [0]
    e = KvEngine(spark, f"file://{tmp_path}/db", clock=lambda: now[0])
    assert e.get(b"k") is None
    e.insert(b"k", b"1")
    now[0] += 1
    e.insert(b"k", b"2")
    e.delete(b"missing")
    assert e.get(b"k") == b"2"
    for f in (lambda: e.insert(b"hyp3r_l0g_l0g/x", b""), lambda: e.get(b"t0k3n_buck3t/state"), lambda: e.delete(b"bl00m_f1lt3r/")):
        with pytest.raises(ReservedKeyError):
            f()
    refused = e.apply_many(spark.createDataFrame([(b"m", b"3", False, 1, 100), (None, b"", False, 1, 101), (b"$1m_ha$h/", b"", False, 1, 102)], OPS))
    assert refused.count() == 2
    e.compact()
    e.delete(b"m")
    again = KvEngine(spark, f"file://{tmp_path}/db", clock=lambda: 10)
    assert again.get(b"k") == b"2" and again.get(b"m") is None  # of equal times, the later operation counts
    again.insert(b"n", b"4")
    assert [as_bytes(r["key"]) for r in again.range_scan(b"a", b"z").collect()] == [b"k", b"n"]


def test_engine_compacts_and_truncates_a_long_log(spark, tmp_path):
    e = KvEngine(spark, f"file://{tmp_path}/db", DBConfig(lsm_max_per_level=2))
    rows = [(b"k%d" % (i % 4), b"%d" % i, False, i, i) for i in range(12)]
    for i in range(0, 12, 4):
        e.apply_many(spark.createDataFrame(rows[i : i + 4], OPS).coalesce(1))
    files = [f for f in (tmp_path / "db" / "log").iterdir() if f.suffix == ".parquet"]
    assert files == [] and not e.needs_compaction()
    assert {as_bytes(r["key"]): as_bytes(r["value"]) for r in resolve.state(e.operations()).collect()} == {b"k%d" % i: b"%d" % (8 + i) for i in range(4)}
    e.insert(b"k0", b"new")
    assert e.get(b"k0") == b"new" and e.get(b"k3") == b"11"


def test_engine_sketches_and_limits(spark, tmp_path):
    e = KvEngine(spark, f"file://{tmp_path}/db", DBConfig(token_bucket_capacity=1000, token_bucket_refill_rate=0))
    with pytest.raises(ProbabilisticTypeError):
        e.bloom_filter_insert(b"none", b"x")
    e.bloom_filter_create(b"f", 0.01, 1000)
    e.bloom_filter_insert(b"f", b"value1")
    assert e.bloom_filter_contains(b"f", b"value1") and not e.bloom_filter_contains(b"f", b"value2")
    e.count_min_sketch_create(b"c")
    e.count_min_sketch_increase_many(b"c", spark.range(1000).select(F.lit(b"value1").alias("v")), "v")
    assert e.count_min_sketch_get_count(b"c", b"value1") == 1000 and e.count_min_sketch_get_count(b"c", b"value2") == 0
    e.hyperloglog_create(b"h")
    e.hyperloglog_increase_count(b"h", b"x")
    assert e.hyperloglog_get_count(b"h") > 0 and len(e.hyperloglog_get(b"h")) == 20 + 1024
    assert e.sim_hash_calculate_hamming_distance("Ripe pears, fall", "ripe PEARS fall") == 0
    e.tokens = 1
    with pytest.raises(TokenBucketError):
        e.bloom_filter_contains(b"f", b"x")


def many_puts(e, n, keys, now):
    for i in range(n):
        now[0] += 1
        e._append([(b"key_%05d" % (i % keys), b"%d" % i if i % 7 else None, i % 7 == 0)])


@pytest.mark.parametrize("policy", ["SizeTiered", "Leveled"])
def test_engine_flushes_and_merges_runs_by_policy(spark, tmp_path, policy):
    now = [0]
    config = DBConfig(memory_table_capacity=50, memory_table_pool_num=1, lsm_max_per_level=2, lsm_max_level=3, lsm_leveled_amplification=1, compaction_algorithm_type=policy)
    e = KvEngine(spark, f"file://{tmp_path}/db", config, clock=lambda: now[0])
    many_puts(e, 420, 60, now)  # ten flushes
    levels = [r["level"] for r in e.runs()]
    assert max(levels) >= 1 and levels.count(0) <= 2
    folders = [p.name for p in (tmp_path / "db" / "runs").iterdir() if not p.name.endswith("-merkle") and not p.name.startswith(".")]
    assert sorted(folders) == sorted(r["run"] for r in e.runs())  # merged runs are gone
    assert e.damaged_runs().count() == 0
    want = {b"key_%05d" % (i % 60): (None if i % 7 == 0 else b"%d" % i) for i in range(420)}
    again = KvEngine(spark, f"file://{tmp_path}/db", config, clock=lambda: now[0])
    assert len(again.memory) == len(e.memory) > 0
    for x in (e, again):
        got = {as_bytes(r["key"]): as_bytes(r["value"]) for r in resolve.state(x.operations()).collect()}
        assert got == {k: v for k, v in want.items() if v is not None}
        assert all(x.get(k) == want[k] for k in (b"key_00000", b"key_00007", b"key_00059"))
    e.compact()
    assert len(e.runs()) == 1 and len([p for p in (tmp_path / "db" / "runs").iterdir()]) == 2
    assert [n for n in (tmp_path / "db" / "wal").iterdir() if not n.name.startswith(".")] == []
    e.remove_keys(spark.createDataFrame([(b"key_00001",), (None,)], "key binary"))
    assert resolve.resolve(e.operations()).count() == 59 and e.get(b"key_00001") is None


def test_damaged_runs_are_reported(spark, tmp_path):
    e = KvEngine(spark, f"file://{tmp_path}/db")
    e.apply_many(spark.range(500).selectExpr("cast(cast(id as string) as binary) as key", "cast('v' as binary) as value", "false as tombstone", "id as ts", "id as seq"))
    e.flush()
    run = tmp_path / "db" / "runs" / e.runs()[0]["run"]
    file = next(p for p in run.iterdir() if p.suffix == ".parquet")
    data = bytearray(file.read_bytes())
    data[len(data) // 2] ^= 1
    file.write_bytes(data)
    (run / f".{file.name}.crc").unlink(missing_ok=True)
    assert [(r["file"], r["chunk"]) for r in e.damaged_runs().collect()] == [(file.name, 0)]


def test_memory_and_cache_answer_without_jobs(spark, tmp_path):
    now = [0]
    e = KvEngine(spark, f"file://{tmp_path}/db", DBConfig(cache_max_size=2), clock=lambda: now[0])
    for k in (b"a", b"b", b"c"):
        assert e.get(k) is None
    assert list(e.cache) == [b"b", b"c"]  # absent keys are remembered, the oldest answer is dropped
    e.operations = None
    assert e.get(b"b") is None
    now[0] = 5
    e.insert(b"b", b"1")
    e.delete(b"c")
    assert e.get(b"b") == b"1" and e.get(b"c") is None and list(e.cache) == []


def test_state_of_the_rate_limiter_outlives_the_engine(spark, tmp_path):
    config = DBConfig(token_bucket_capacity=3, token_bucket_refill_rate=0)
    e = KvEngine(spark, f"file://{tmp_path}/db", config, clock=lambda: 7)
    e.insert(b"a", b"1")
    e.insert(b"a", b"2")
    again = KvEngine(spark, f"file://{tmp_path}/db", config, clock=lambda: 8)
    assert again.tokens == 1 and again.last == 7
    again.insert(b"b", b"")
    with pytest.raises(TokenBucketError):
        again.insert(b"c", b"")


def test_torn_and_damaged_appends_are_passed_over(spark, tmp_path):
    e = KvEngine(spark, f"file://{tmp_path}/db", clock=lambda: 1)
    e._append([(b"a", b"1", False), (b"b", b"2", False), (b"c", b"3", False)])
    file = next(p for p in (tmp_path / "db" / "wal").iterdir() if p.suffix == ".log")
    data = bytearray(file.read_bytes())
    data[45] ^= 1  # in the second record
    file.write_bytes(data[:-1])
    (file.parent / f".{file.name}.crc").unlink(missing_ok=True)
    again = KvEngine(spark, f"file://{tmp_path}/db", clock=lambda: 2)
    assert {k: v[3] for k, v in again.memory.items()} == {b"a": b"1"} and again._seq == 2


def test_two_engines_cannot_publish_over_each_other(spark, tmp_path):
    a, c = (KvEngine(spark, f"file://{tmp_path}/db", clock=lambda: 1) for _ in range(2))
    a._append([(b"x", b"1", False)])
    with pytest.raises(Exception, match="exists"):
        c._append([(b"y", b"1", False)])
    b = KvEngine(spark, f"file://{tmp_path}/db", clock=lambda: 1)
    a.flush()
    with pytest.raises(Exception, match="exists"):
        b.flush()
    with pytest.raises(ValueError):
        a._publish(a._state | {"seq": -1})
    assert a.get(b"x") == b"1" and len(a.runs()) == 1


def test_streams_of_other_users_keep_running(spark, tmp_path):
    rows = spark.createDataFrame([(b"k%d" % i, b"v", False, i, i) for i in range(20)], OPS)
    rows.repartition(2).write.parquet(str(tmp_path / "in"))
    e = KvEngine(spark, f"file://{tmp_path}/db", clock=lambda: 1)
    other = spark.readStream.format("rate").load().writeStream.format("memory").queryName("other").start()
    try:
        e.ingest(spark.readStream.schema(OPS).parquet(str(tmp_path / "in")), f"file://{tmp_path}/cp").awaitTermination()
        e.shut_down()
        assert other.isActive and e.batch_get(rows.select("key")).where("value is not null").count() == 20
    finally:
        other.stop()
