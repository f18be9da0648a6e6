"""Consolidation of files, change feeds and the work-item ledger on small fixtures."""

import datetime
import decimal
import os
import random

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from runefold.operators import changefeed, ledger, smallfiles
from runefold.sources.blocks import BlockError, BlockWriter, read_footer

# Consolidation


def write_files(folder, n, **options):
    r = random.Random(n)
    rows = []
    for i in range(n):
        part = [{"k": r.randrange(50) if r.random() < 0.9 else None, "s": None if r.random() < 0.2 else "x" * r.randrange(40), "b": r.random() < 0.5, "l": [1] * r.randrange(3)} for _ in range(r.randrange(6))]
        table = pa.Table.from_pylist(part, schema=pa.schema([("k", pa.int64()), ("s", pa.string()), ("b", pa.bool_()), ("l", pa.list_(pa.int32()))]))
        pq.write_table(table, f"{folder}/{i}.parquet", **options)
        rows += part
    return rows


@pytest.mark.parametrize("options", [{"use_dictionary": False}, {"use_dictionary": True}, {"use_dictionary": False, "compression": "snappy", "data_page_version": "2.0"}])
def test_blocks_are_copied_not_changed(tmp_path, options):
    rows = write_files(tmp_path, 30, **options)
    with open(tmp_path / "out", "wb") as sink:
        w = BlockWriter(sink)
        for i in range(30):
            w.add((tmp_path / f"{i}.parquet").read_bytes())
        w.close()
    back = pq.read_table(tmp_path / "out")
    assert back.to_pylist() == rows
    meta = pq.ParquetFile(tmp_path / "out").metadata
    assert meta.num_rows == len(rows)
    if not options["use_dictionary"]:
        assert meta.num_row_groups == 1
        s = meta.row_group(0).column(0).statistics
        known = [r["k"] for r in rows if r["k"] is not None]
        assert (s.min, s.max, s.null_count) == (min(known), max(known), len(rows) - len(known))


BOUNDS = {
    "unsigned": (pa.uint32(), [[1, 3_000_000_000], [5, 10]]),
    "unsigned_wide": (pa.uint64(), [[2**63 + 5, 7], [1, 2**64 - 1]]),
    "negative": (pa.int64(), [[-5, 3], [-(2**40), 2**40]]),
    "date": (pa.date32(), [[datetime.date(1960, 1, 1)], [datetime.date(2020, 1, 1), None]]),
    "decimal": (pa.decimal128(30, 2), [[decimal.Decimal("-12345678901234567890.25"), decimal.Decimal("3.50")], [decimal.Decimal("99999999999999999999.00")]]),
    "small_decimal": (pa.decimal128(7, 2), [[decimal.Decimal("-3.25")], [decimal.Decimal("-1.00"), decimal.Decimal("2.00")]]),
    "text": (pa.string(), [["z", "é"], ["", "a"]]),
    "bytes": (pa.binary(), [[b"\xff\x01", b"\x7f"], [b"", b"\x80"]]),
    "double": (pa.float64(), [[-1.5, 2.5], [float("nan"), 100.0]]),
    "zeros": (pa.float64(), [[0.0], [-0.0]]),
    "stamp": (pa.timestamp("us"), [[datetime.datetime(1950, 1, 1)], [datetime.datetime(2030, 1, 1)]]),
    "flag": (pa.bool_(), [[True], [False, None]]),
}


@pytest.mark.parametrize("name", BOUNDS)
def test_pushed_filters_lose_no_row_of_a_merged_file(spark, tmp_path, name):
    kind, parts = BOUNDS[name]
    with open(tmp_path / "out.parquet", "wb") as sink:
        w = BlockWriter(sink)
        for i, part in enumerate(parts):
            for options in ({}, {"store_decimal_as_integer": True}) if name == "small_decimal" else ({},):
                pq.write_table(pa.table({"x": pa.array(part, kind)}), tmp_path / f"{i}", use_dictionary=False, **options)
            w.add((tmp_path / f"{i}").read_bytes())
        w.close()
    path = tmp_path / "out.parquet"
    assert pq.ParquetFile(path).metadata.num_row_groups == 1
    for v in (v for part in parts for v in part if v is not None):
        if v == v:
            want = sum(w == v for part in parts for w in part)
            assert pq.read_table(path, filters=pc.field("x") == pa.scalar(v, kind)).num_rows == want
            lit = F.lit(decimal.Decimal(v) if name == "unsigned_wide" else v)
            assert spark.read.parquet(f"file://{path}").where(F.col("x") == lit).count() == want
    s = pq.ParquetFile(path).metadata.row_group(0).column(0).statistics
    known = [v for part in parts for v in part if v is not None and v == v]
    if name in ("double", "unsigned", "unsigned_wide", "negative", "stamp", "text", "bytes", "small_decimal"):
        assert (s.min, s.max) == (min(known), max(known))


def test_files_with_dictionaries_keep_their_row_groups(tmp_path):
    rows = [{"s": "ab" * (i % 3), "n": i % 7} for i in range(400)]
    with open(tmp_path / "out", "wb") as sink:
        w = BlockWriter(sink)
        for i in range(4):
            pq.write_table(pa.Table.from_pylist(rows[100 * i : 100 * i + 100]), tmp_path / "in", use_dictionary=True, row_group_size=50)
            w.add((tmp_path / "in").read_bytes())
        w.close()
    meta = pq.ParquetFile(tmp_path / "out").metadata
    assert [meta.row_group(i).num_rows for i in range(meta.num_row_groups)] == [50] * 8  # as many and as large as in the inputs
    assert pq.read_table(tmp_path / "out").to_pylist() == rows
    assert pq.read_table(tmp_path / "out", filters=[("n", "==", 6)]).num_rows == sum(r["n"] == 6 for r in rows)


def test_damaged_and_foreign_files_are_refused(tmp_path):
    write_files(tmp_path, 1)
    data = (tmp_path / "0.parquet").read_bytes()
    with pytest.raises(BlockError):
        read_footer(data[:-1])
    pq.write_table(pa.table({"other": [1]}), tmp_path / "other")
    with open(tmp_path / "out", "wb") as sink:
        w = BlockWriter(sink)
        w.add(data)
        with pytest.raises(BlockError):
            w.add((tmp_path / "other").read_bytes())


def test_consolidate_keeps_every_row_once(spark, tmp_path, monkeypatch):
    folder = tmp_path / "small"
    folder.mkdir()
    rows = write_files(folder, 60, use_dictionary=False)
    pq.write_table(pa.table({"other": [1, 2]}), folder / "other.parquet")
    files = smallfiles.list_files(spark, f"file://{folder}")
    monkeypatch.setattr(smallfiles, "FAN_IN", 7)  # three levels
    report = smallfiles.consolidate(files.unionByName(files), f"file://{tmp_path}/large", trail=f"file://{tmp_path}/trail").collect()
    assert len(report) == 2 and sum(r["rows"] for r in report) == len(rows) + 2 and sorted(r["files"] for r in report) == [1, 60]
    big = max(report, key=lambda r: r["rows"])
    back = pq.read_table(big["path"].removeprefix("file://")).to_pylist()
    assert sorted(map(str, back)) == sorted(map(str, rows))
    assert [f for f in os.listdir(tmp_path / "large") if f.endswith(".tmp")] == []
    trail = spark.read.parquet(f"file://{tmp_path}/trail").collect()
    assert sorted(r["path"] for r in trail) == sorted(r["path"] for r in files.collect())
    assert {r["output"] for r in trail} == {r["path"] for r in report}


def test_bins_follow_sizes(spark, tmp_path):
    folder = tmp_path / "mixed"
    folder.mkdir()
    for i in range(40):
        pq.write_table(pa.table({"x": list(range(400 if i % 4 else 4000)), "n": [i] * (400 if i % 4 else 4000)}), folder / f"{i:02d}.parquet", use_dictionary=False, compression="none")
    files = smallfiles.list_files(spark, f"file://{folder}")
    total = files.agg(F.sum("size")).first()[0]
    report = smallfiles.consolidate(files, f"file://{tmp_path}/large", target_bytes=total // 5, group_bytes=20_000).collect()
    assert 5 <= len(report) <= 7 and max(r["bytes"] for r in report) < 1.6 * total / 5
    got = pq.read_table(tmp_path / "large")
    assert got.num_rows == 30 * 400 + 10 * 4000 and set(got["n"].to_pylist()) == set(range(40))


TABLES = "store_id long, sst_id long, base_path string"
LEVELS = "store_id long, level int, pos int, directory_name string"
RECORDS = "store_id long, sst_id long, key binary, value binary, tombstone boolean, ts long, seq long, `__part` string"


def test_listed_tables_and_spellings(spark):
    sst = [(1, 1, "./sstables/a_s"), (1, 2, "./sstables/../sstables/b_m/"), (1, 3, "x//c_m"), (1, 4, None), (2, 5, "./sstables/a_s"), (2, 6, "d_m/."), (1, 7, "e_m"), (1, 8, "")]
    lev = [(1, 0, 0, "a_s/"), (1, 0, 1, "./b_m"), (1, 0, 2, "c_m"), (1, 0, 2, "c_m"), (2, 0, 0, " d_m "), (3, 0, 0, "e_m"), (1, 1, 1, None), (1, 1, 2, "gone")]
    got = smallfiles.listed_tables(spark.createDataFrame(sst, TABLES), spark.createDataFrame(lev, LEVELS))
    assert sorted(map(tuple, got.collect())) == [(1, 1), (1, 2), (1, 3), (2, 6)]


def test_consolidated_runs(spark):
    sst = spark.createDataFrame([(1, 1, "p/a"), (1, 2, "p/b"), (2, 3, "p/a")], TABLES)
    lev = spark.createDataFrame([(1, 0, 0, "a"), (2, 0, 0, "a")], LEVELS)
    rows = [(1, 1, b"k", None, False, 1, i, "clash") for i in range(30)] * 2 + [(1, 2, b"x", b"", True, 1, 99, None), (2, 3, b"", b"v", None, None, 5, None)]
    records = spark.createDataFrame(rows, RECORDS)
    got, report = smallfiles.consolidated_runs(spark, records, sst, lev)
    assert got.columns == records.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, records.where("sst_id <> 2").collect()))
    assert report.agg(F.sum("rows")).first()[0] == 61
    hot = smallfiles.export_tables(records, smallfiles.listed_tables(sst, lev), smallfiles.workspace(spark, "hot"), part_rows=10).collect()
    assert sum(r["rows"] for r in hot) == 61 and len(hot) > 3  # the large table is split
    empty, _ = smallfiles.consolidated_runs(spark, records.limit(0), sst, lev)
    assert empty.count() == 0


# Change feed

CHANGES = "store long, k string, n long, tombstone boolean, v string, `count` string"


def test_fold_is_independent_of_order_and_batches(spark):
    r = random.Random(4)
    rows = [(r.randrange(2), r.choice(["a", "b", "", None]), r.choice([None, *range(8)]), r.choice([True, False, None]), r.choice(["x", "y", None]), "c") for _ in range(200)]
    rows += rows[:50]
    one = changefeed.fold(spark.createDataFrame(rows, CHANGES), ["store", "k"], ["n"], payload=["v"])
    r.shuffle(rows)
    first = changefeed.fold(spark.createDataFrame(rows[:100], CHANGES), ["store", "k"], ["n"], payload=["v"])
    two = changefeed.fold(spark.createDataFrame(rows[100:], CHANGES), ["store", "k"], ["n"], payload=["v"], base=first)
    assert sorted(map(str, one.collect())) == sorted(map(str, two.collect()))
    assert None not in {x["k"] for x in one.collect()}


def test_late_change_does_not_revive_a_deleted_key(spark):
    base = changefeed.fold(spark.createDataFrame([(1, "a", 5, True, None, None)], CHANGES), ["store", "k"], ["n"], payload=["v"])
    late = spark.createDataFrame([(1, "a", 4, False, "old", None), (1, "b", 1, None, "new", None)], CHANGES)
    got = changefeed.live(changefeed.fold(late, ["store", "k"], ["n"], payload=["v"], base=base))
    assert [(x["k"], x["v"]) for x in got.collect()] == [("b", "new")]
    assert changefeed.fold(late.limit(0), ["store", "k"], ["n"]).count() == 0


# Ledger


def test_leases_expire_and_tokens_fence(spark, tmp_path):
    now = [0.0]
    book = ledger.Ledger(spark, f"file://{tmp_path}/ledger", clock=lambda: now[0])
    assert book.plan(2, {"a": 1}) == book.plan(9, {}) == {"items": 2, "covers": {"a": 1}}
    old = book.lease("first", 10, 1)
    assert old == {0: 1} and book.states() == {0: ("leased", 1), 1: ("pending", 0)}
    now[0] = 11
    new = book.lease("second", 10, 5)
    assert new == {0: 2, 1: 1}
    with pytest.raises(ledger.StaleLease):
        book.commit(0, old[0])
    book.commit(0, new[0], 7)
    with pytest.raises(ledger.StaleLease):
        book.commit(0, new[0])
    assert book.done() == [0]


LOG = "store_id long, wal_pos long, key binary, seq long"
RUNS = "store_id long, run_no int, status string, current_value long"


def log_of(spark, n, start=0):
    return spark.createDataFrame([(i % 3, 10 * i, b"k", i) for i in range(start, n)], LOG)


def pairs(df):
    return sorted((r["store_id"], r["seq"]) for r in df.collect())


def test_process_resumes_after_a_failure(spark, tmp_path):
    now = [0.0]
    book = ledger.Ledger(spark, f"file://{tmp_path}/ledger", clock=lambda: now[0])
    log, runs, out = log_of(spark, 100), spark.createDataFrame([], RUNS), f"file://{tmp_path}/out"
    ledger.plan_run(book, log, runs, 4)
    assert len(book.lease("died", 10, 2)) == 2
    with pytest.raises(RuntimeError):
        ledger.process(book, log, runs, out, 4, most=1)
    now[0] = 20
    want = [(i % 3, i) for i in range(100)]
    for _ in range(2):
        assert pairs(ledger.process(book, log, runs, out, 4)) == sorted(want)


def test_a_log_that_grows_between_attempts_loses_and_repeats_nothing(spark, tmp_path):
    now = [0.0]
    runs = spark.createDataFrame([(0, 1, "ok", 60)], RUNS)
    book = ledger.Ledger(spark, f"file://{tmp_path}/first", clock=lambda: now[0])
    ledger.plan_run(book, log_of(spark, 100), runs, 4)
    out = f"file://{tmp_path}/out-1"
    died = book.lease("died", 10, 2)
    with pytest.raises(RuntimeError):
        ledger.process(book, log_of(spark, 100), runs, out, 4)  # two items are done, two wait
    grown = log_of(spark, 200).unionByName(spark.createDataFrame([(7, 5, b"new store", 1), (0, 30, b"again", 99)], LOG))
    now[0] = 20
    first = pairs(ledger.process(book, grown, runs, out, 4))
    assert first == sorted((i % 3, i) for i in range(100) if i % 3 or 10 * i >= 60) and len(died) == 2
    after = ledger.successor(book).selectExpr("store_id", "2 as run_no", "'ok' as status", "current_value")
    again = ledger.Ledger(spark, f"file://{tmp_path}/second")
    second = pairs(ledger.process(again, grown, runs.unionByName(after), f"file://{tmp_path}/out-2", 4))
    assert second == sorted([(i % 3, i) for i in range(100, 200)] + [(7, 1)])
    third = ledger.Ledger(spark, f"file://{tmp_path}/third")
    last = runs.unionByName(after).unionByName(ledger.successor(again).selectExpr("store_id", "3 as run_no", "'ok' as status", "current_value"))
    assert pairs(ledger.process(third, grown, last, f"file://{tmp_path}/out-3", 4)) == []


def test_stale_writers_change_nothing(spark, tmp_path):
    now = [0.0]
    book = ledger.Ledger(spark, f"file://{tmp_path}/ledger", clock=lambda: now[0])
    log, runs, out = log_of(spark, 200), spark.createDataFrame([], RUNS), f"file://{tmp_path}/out"
    plan = ledger.plan_run(book, log, runs, 1)
    old = book.lease("slow", 10, 1)
    now[0] = 11
    done = ledger.process(book, log, runs, out, 1)
    spark.read.parquet(plan["covers"]["work"]).limit(50).drop("__item").write.mode("overwrite").parquet(f"{out}/__item=0/__token={old[0]}")
    with pytest.raises(ledger.StaleLease):
        book.commit(0, old[0])
    assert len(pairs(done)) == len(pairs(ledger.results(book, done))) == 200


def test_leases_are_renewed(spark, tmp_path):
    now = [0.0]
    book = ledger.Ledger(spark, f"file://{tmp_path}/ledger", clock=lambda: now[0])
    book.plan(1, {})
    (token,) = book.lease("a", 10, 1).values()
    now[0] = 8
    assert book.renew(0, token, 10, 1)
    now[0] = 15
    assert book.lease("b", 10, 1) == {} and book.states()[0] == ("leased", token)
    now[0] = 19
    assert book.lease("b", 10, 1) == {0: token + 1}
    assert not book.renew(0, token, 10, 2)


def test_changed_since_against_model(spark):
    log = [(1, 10, b"a", 1), (1, 20, b"a", 1), (1, 30, b"b", 2), (1, 40, None, 3), (1, 50, b"c", 3), (2, 5, b"a", 1), (2, 6, b"", 9), (1, None, b"z", 8), (3, 1, b"q", 1)]
    runs = [(1, 1, "ok", 15), (1, 2, " OK ", 30), (1, 2, "ok", 30), (1, 3, "failed", 99), (1, 4, None, 99), (2, 1, "failed", 99), (3, 1, "ok", 100), (3, 2, "Ok", None)]
    got = ledger.changed_since(spark.createDataFrame(log, LOG), spark.createDataFrame(runs, RUNS), 3)
    assert sorted((r["store_id"], r["seq"]) for r in got.collect()) == [(1, 2), (1, 3), (1, 8), (2, 1), (2, 9), (3, 1)]
    assert {r["__item"] for r in got.collect()} <= {0, 1, 2}
