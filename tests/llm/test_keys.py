"""Ribbon filters, membership in time order, and heavy hitters against brute force."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from runefold.llm import heavy, seen
from runefold.llm.ribbon import Ribbon


@pytest.mark.parametrize("n", [0, 1, 2, 300, 5000])
def test_ribbon_holds_its_keys_and_few_others(n):
    r = np.random.default_rng(n)
    keys, others = r.integers(-(2**63), 2**63 - 1, n), r.integers(-(2**63), 2**63 - 1, 100_000)
    f = Ribbon(np.concatenate([keys, keys]), bits=10)
    assert f.contains(keys).all() and f.n == n
    wrong = f.contains(others).mean()
    assert wrong == 0 if not n else 0.5 / 1024 < wrong < 1.6 / 1024
    if n >= 5000:
        assert f.nbytes * 8 / n < 10 * 1.25


LOG = "store_id long, key binary, ts long, value binary, h string"
ENTRIES = "entry_id long, store_id long, key binary, ts long, seen string"


def fixture(n, seed):
    r = random.Random(seed)
    key = lambda: None if r.random() < 0.03 else b"hot" if r.random() < 0.4 else b"" if r.random() < 0.05 else b"k%d" % r.randrange(400)
    log = [(r.randrange(3), key(), r.randrange(300), None, "x") for _ in range(n)]
    entries = [(i, r.choice([0, 1, 2, None]), key(), r.choice([None, *range(0, 300)]), "y") for i in range(n)]
    return log, entries


def brute(log, entries):
    out = set()
    for i, s, k, t, _ in entries:
        if None in (s, k, t):
            continue
        if any(a == s and b == k and c < t for a, b, c, *_ in log) or any(a == s and b == k and None not in (c,) and (c, j) < (t, i) for j, a, b, c, _ in entries):
            out.add(i)
    return out


@pytest.mark.parametrize("batch_keys", [16, 1 << 12])
def test_seen_before_matches_brute_force(spark, batch_keys):
    log, entries = fixture(700, batch_keys)
    got = [r["entry_id"] for r in seen.seen_before(spark.createDataFrame(log, LOG), spark.createDataFrame(entries, ENTRIES), batch_keys=batch_keys).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(log, entries)


def test_seen_before_on_empty_tables(spark):
    log, entries = fixture(20, 1)
    no_log, no_entries = spark.createDataFrame([], LOG), spark.createDataFrame([], ENTRIES)
    assert seen.seen_before(no_log, no_entries).count() == 0
    got = {r["entry_id"] for r in seen.seen_before(no_log, spark.createDataFrame(entries, ENTRIES)).collect()}
    assert got == brute([], entries)
    assert seen.seen_before(spark.createDataFrame(log, LOG), no_entries).count() == 0


def test_audit_counts_wrong_answers(spark):
    log = spark.range(20000).select(F.lit(1).cast("long").alias("store_id"), F.col("id").cast("string").cast("binary").alias("key"), F.col("id").alias("ts"))
    a = seen.audit(log, spark.createDataFrame([], ENTRIES), probes=80000, batch_keys=512, bits=8).first()
    assert a["keys"] > 19000 and a["generations"] >= 4 and a["probes"] == 80000
    expected = a["generations"] / 4 / 256
    assert 0.3 * expected < a["wrong_rate"] < 2 * expected
    assert seen.audit(log, spark.createDataFrame([], ENTRIES), probes=5000, batch_keys=512).first()["wrong"] == 0


def test_small_tables_are_sealed_too(spark):
    log, entries = fixture(1500, 5)
    log, entries = spark.createDataFrame(log, LOG), spark.createDataFrame(entries, ENTRIES)
    a = seen.audit(log, entries, probes=3000).first()
    assert a["generations"] >= 6 and a["probes"] == 3000 and a["wrong_rate"] == 0 and a["open_bytes"] < 8 * a["keys"]
    assert seen.audit(log.limit(0), entries.limit(0), probes=10).first()["wrong_rate"] is None


def test_code_corrects_two_symbols():
    r = random.Random(1)
    for _ in range(200):
        f = r.randrange(1 << 44)
        word = heavy.symbols(np.array([f], np.uint64))[0].tolist()
        assert heavy.decode(word) == f
        for p in r.sample(range(heavy.LENGTH), 2):
            word[p] ^= r.randrange(1, 16)
        assert heavy.decode(word) == f


@pytest.mark.parametrize(("share", "groups"), [(0.005, 1024), (0.02, 64)])
def test_heavy_hitters_match_exact_counts(spark, share, groups):
    r = random.Random(groups)
    values = [b"hot"] * 4000 + [None] * 300 + [b""] * 260
    for i in range(40):
        values += [b"k%d" % i] * r.randrange(20, 260)
    values += [b"rare%d" % r.randrange(3000) for _ in range(6000)]
    r.shuffle(values)
    df = spark.createDataFrame([(v, 1) for v in values], "key binary, n_rows int").repartition(5)
    counts = Counter(v for v in values if v is not None)
    want = {k: n for k, n in counts.items() if n >= share * sum(counts.values())}
    got = heavy.heavy_hitters(df, "key", share, groups=groups).collect()
    assert {bytes(x["key"]): x["n_rows"] for x in got} == want
    assert all(x["approx_rows"] >= x["n_rows"] for x in got)


@pytest.mark.parametrize("share", [0.002, 0.0001])
def test_groups_grow_until_all_frequent_values_are_told_apart(spark, monkeypatch, share):
    monkeypatch.setattr(heavy, "MOST_GROUPS", 256)  # then slices
    r = random.Random(8)
    values = [f"v{i}" for i in range(500) for _ in range(r.randrange(15, 40))] + [f"rare{i}" for i in range(3000)]
    r.shuffle(values)
    counts = Counter(values)
    got = heavy.heavy_hitters(spark.createDataFrame([(v,) for v in values], "v string"), "v", share, groups=64, repetitions=2).collect()
    assert {x["v"]: x["n_rows"] for x in got} == {k: n for k, n in counts.items() if n >= share * len(values)} and len(got) > 50
    assert all(x["approx_rows"] >= x["n_rows"] for x in got)


def test_heavy_hitters_of_nothing_and_of_one(spark):
    assert heavy.heavy_hitters(spark.createDataFrame([], "k string"), "k", 0.1).count() == 0
    assert heavy.heavy_hitters(spark.createDataFrame([(None,)], "k string"), "k", 0.1).count() == 0
    assert [tuple(r) for r in heavy.heavy_hitters(spark.createDataFrame([("a",)] * 3, "k string"), "k", 0.1).collect()] == [("a", 3, 3)]


def test_values_that_share_all_groups_are_reported(spark):
    counters = heavy.counters_of(spark.range(4000).select((F.col("id") % 40).alias("k")), "k", 64, 1)
    assert heavy.unresolved(counters.sum(axis=1, keepdims=True), 40)
