"""Scalar functions against known values and pure-Python models."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from runefold.functions import codec, hashing, integrity, simhash, thrift


def test_early_xxh3_known_value():
    assert hashing.xxh3_early(b"abcd") == 10927344704649967500
    assert hashing.xxh3_early(b"") == 0


def test_early_xxh3_uses_every_byte_at_every_length():
    for n in (1, 2, 3, 4, 8, 9, 16, 17, 64, 65, 128, 129, 240, 241, 1024, 1025, 5000):
        base = bytes(random.Random(n).randbytes(n))
        seen = {hashing.xxh3_early(base), hashing.xxh3_early(base, 7)}
        for i in random.Random(n).sample(range(n), min(n, 20)):
            seen.add(hashing.xxh3_early(base[:i] + bytes([base[i] ^ 1]) + base[i + 1 :]))
        assert len(seen) == 2 + min(n, 20)


def test_simhash_known_value_and_pairs():
    assert simhash.simhash_exact("ABCD") == 10927344704649967500
    assert simhash.simhash_exact("") == simhash.simhash_exact(None) == 0
    a, b = simhash.simhash_exact("Green apples, ripe pears"), simhash.simhash_exact("green APPLES ripe; pears")
    assert a == b
    c = simhash.simhash_exact("a completely different sentence about harbour engines")
    assert (a ^ c).bit_count() > 15


def test_simhash_relational_matches_model(spark):
    texts = ["the quick brown fox", "", None, "Fox, brown; QUICK", "naïve café déjà", "same words same words"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r["i"]: r["fingerprint"] for r in simhash.fingerprints(rows, "i", "t").collect()}
    import hashlib

    for i, t in enumerate(texts):
        sums = [0] * 60
        for w in (t or "").replace(",", "").replace(";", "").lower().split():
            if w not in simhash.STOP_WORDS:
                h = int(hashlib.md5(w.encode()).hexdigest()[:15], 16)
                sums = [s + (1 if h >> b & 1 else -1) for b, s in enumerate(sums)]
        assert got[i] == sum(1 << b for b in range(60) if sums[b] > 0), t


@pytest.mark.parametrize(("value", "code"), [(401, "8311"), (0, "00"), (192, "8140"), (64, "40"), (0x1FFFFF, "ffff7f")])
def test_variable_length_vectors(spark, value, code):
    assert codec.encode(value).hex() == code
    assert codec.decode(bytes.fromhex(code)) == (value, len(code) // 2)


def test_variable_length_limits(spark):
    assert codec.decode(codec.encode((1 << 128) - 1)) == ((1 << 128) - 1, 19)
    assert codec.decode(b"\xff" * 19)[0] is None
    assert codec.decode(b"\x80") == (None, 1)
    values = [0, 1, 127, 128, 16383, 16384, (1 << 63) - 1, None, -1]
    rows = spark.createDataFrame([(v,) for v in values], "v long").select("v", F.hex(codec.encoded(F.col("v"))).alias("h"))
    for r in rows.collect():
        assert r["h"] == (None if r["v"] is None or r["v"] < 0 else codec.encode(r["v"]).hex().upper())


def test_dictionary_by_first_occurrence(spark):
    ops = spark.createDataFrame([(b"b", 5), (b"a", 9), (b"b", 1), (None, 0), (b"c", 5)], "key binary, seq long")
    words = codec.dictionary(ops)
    assert {bytes(r["key"]): r["ordinal"] for r in words.collect()} == {b"b": 0, b"c": 1, b"a": 2}
    asked = spark.createDataFrame([(0,), (7,)], "ordinal long")
    assert {r["ordinal"]: r["key"] for r in codec.dictionary_decode(asked, words).collect()} == {0: bytearray(b"b"), 7: None}


def test_records_round_trip_and_damage():
    for r in (codec.Record(b"", b"", False, 0), codec.Record("老".encode(), None, True, 1 << 90), codec.Record(b"k" * 300, b"v" * 5000, False, 5)):
        data = codec.write_log_record(r)
        back, end = codec.read_log_record(data)
        assert back == r and end == len(data)
        for variable in (True, False):
            data = codec.write_table_record(r, variable)
            assert codec.read_table_record(data, 0, variable) == (r, len(data))
            with pytest.raises((codec.CRCError, EOFError)):
                codec.read_table_record(data[:-1] + bytes([data[-1] ^ 1]), 0, variable)
    with pytest.raises(EOFError):
        codec.read_log_record(b"123")


def test_crc32c(spark):
    assert integrity.crc32c(b"123456789") == 0xE3069283
    values = [b"", b"a", b"123456789", bytes(range(256)) * 5]
    assert integrity.crc32c_many(values).tolist() == [integrity.crc32c(v) for v in values]
    rows = spark.createDataFrame([(v,) for v in [b"123456789", None]], "v binary").select(integrity.crc32c_udf("v").alias("c"))
    assert [r["c"] for r in rows.collect()] == [0xE3069283, None]


def merkle_model(data: bytes) -> str | None:
    import hashlib

    level = [hashlib.sha256(data[i : i + 1024]).hexdigest() for i in range(0, len(data), 1024)]
    while len(level) > 1:
        level = [hashlib.sha256((level[i] + level[i + 1]).encode()).hexdigest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0] if level else None


def test_merkle(spark):
    data = [b"", b"x", b"y" * 1024, b"z" * 1025, bytes(range(256)) * 40, b"w" * 7 * 1024, None]
    rows = spark.createDataFrame(list(enumerate(data)), "i int, d binary")
    got = {r["i"]: r["r"] for r in rows.select("i", integrity.merkle_root(integrity.leaf_hashes(F.col("d"))).alias("r")).collect()}
    assert got == {i: None if d is None else merkle_model(d) for i, d in enumerate(data)}
    other = rows.withColumn("d", F.when(F.col("i") == 4, F.concat(F.substring("d", 1, 2000), F.lit(b"!"), F.substring("d", 2002, 100000))).when(F.col("i") == 3, F.substring("d", 1, 1024)).otherwise(F.col("d")))
    diff = integrity.merkle_diff(integrity.merkle_leaves(rows, "i", "d"), integrity.merkle_leaves(other, "i", "d"), "i")
    assert sorted(map(tuple, diff.collect())) == [(3, 1), (4, 1)]
    leaves = ["a" * 64, "b" * 64]
    assert integrity.merkle_from_bytes(integrity.merkle_bytes(leaves)) == leaves


def test_thrift_round_trip():
    s = {1: (thrift.I32, -5), 2: (thrift.LIST, (thrift.STRUCT, [{1: (thrift.BINARY, b"x" * 200)}] * 20)), 4: (thrift.TRUE, None), 40: (thrift.I64, 1 << 50), 41: (thrift.DOUBLE, b"12345678")}
    assert thrift.load(thrift.dump(s)) == s


def test_many_hashes_at_once_are_those_of_single_values():
    r = random.Random(12)
    values = [r.randbytes(n) for n in [*range(0, 300), 512, 513, 1023, 1024, 1025, 1100, 2048, 5000] for _ in range(2)]
    seeds = np.array([r.choice([0, 1, r.randrange(1 << 64)]) for _ in values], np.uint64)
    assert hashing.xxh3_early_many(values, seeds).tolist() == [hashing.xxh3_early(v, int(s)) for v, s in zip(values, seeds)]
    assert hashing.xxh3_early(b"abcd") == 10927344704649967500


def test_long_checksums():
    r = random.Random(13)
    values = [r.randbytes(n) for n in (0, 1, 4095, 4096, 4097, 8192, 8193, 20_000)] + [b"123456789"]
    assert integrity.crc32c_many(values).tolist() == [integrity.crc32c(v) for v in values]
    assert integrity.crc32c_many([b"123456789"])[0] == 0xE3069283
    assert len(integrity.crc32c_many([bytes(10_000_000)])) == 1
