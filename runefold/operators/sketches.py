"""Bloom filter, count-min sketch and HyperLogLog as tables that merge, plus their byte forms.

A sketch is a small relation (positions; cells; registers). Building one is a
``groupBy`` with map-side partial aggregation, merging two is a union and the
same aggregation, and asking many values at once is a join; the sketch's size
is bounded by its parameters, never by the data. Null values are not added and
give a null answer when asked. ``hasher(value, seed)`` is pluggable; the
default is 60 bits of md5, which any SQL engine can check.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runefold.functions.hashing import md5_60

Hasher = Callable[[Column, Column], Column]
HASH_BITS = 60


def default_hash(value: Column, seed: Column) -> Column:
    return md5_60(value, seed)


def unsigned_mod(h: Column, m: int) -> Column:
    """Remainder of a hash read as an unsigned 64-bit number."""
    return F.pmod(F.shiftrightunsigned(h, 1) % m * 2 + h.bitwiseAND(F.lit(1)), F.lit(m))


def _clamp(x: float, low: float, high: float) -> float:
    return min(max(x, low), high)


# Bloom filter


def bloom_parameters(probability: float = 0.1, capacity: int = 1_000_000) -> tuple[int, int]:
    """(bits, hashes). The number of hashes follows from the whole part of bits per key, so high probabilities give 0."""
    n, p = int(_clamp(capacity, 1000, 100_000_000)), _clamp(probability, 0.001, 1.0)
    m = int(-n * math.log(p) / math.log(2) ** 2)
    return m, int((m // n) * math.log(2))


def bloom_positions(values: DataFrame, column: str, bits: int, hashes: int, hasher: Hasher = default_hash) -> DataFrame:
    """Every value with each of its positions."""
    if not hashes:
        return values.where("false").withColumn("position", F.lit(0).cast("bigint"))
    seeds = values.where(F.col(column).isNotNull()).withColumn("__i", F.explode(F.sequence(F.lit(0), F.lit(hashes - 1))))
    return seeds.withColumn("position", unsigned_mod(hasher(F.col(column), F.col("__i")), bits)).drop("__i")


def bloom_build(values: DataFrame, column: str, bits: int, hashes: int, hasher: Hasher = default_hash) -> DataFrame:
    """The set bits: ``position``."""
    return bloom_positions(values.select(column), column, bits, hashes, hasher).select("position").distinct()


def bloom_union(*filters: DataFrame) -> DataFrame:
    out = filters[0]
    for f in filters[1:]:
        out = out.unionByName(f)
    return out.distinct()


def bloom_contains(asked: DataFrame, column: str, bloom: DataFrame, bits: int, hashes: int, hasher: Hasher = default_hash) -> DataFrame:
    """Distinct asked values with ``contained``; without hashes everything is contained."""
    asked = asked.select(column).where(F.col(column).isNotNull()).distinct()
    if not hashes:
        return asked.withColumn("contained", F.lit(True))
    hits = bloom_positions(asked, column, bits, hashes, hasher).join(bloom.withColumn("__set", F.lit(1)), "position", "left")
    return hits.groupBy(column).agg((F.count("__set") == hashes).alias("contained"))


def bloom_bytes(positions: list[int], bits: int, hashes: int) -> bytes:
    """Byte form: hashes u8, bits u64, one byte per bit."""
    body = bytearray(bits)
    for p in positions:
        body[p] = 1
    return struct.pack("<BQ", hashes, bits) + bytes(body)


def bloom_from_bytes(data: bytes) -> tuple[list[int], int, int]:
    if len(data) < 9:
        raise ValueError("too short for a Bloom filter")
    hashes, bits = struct.unpack("<BQ", data[:9])
    if len(data) != 9 + bits:
        raise ValueError("length does not fit the number of bits")
    return [i for i, b in enumerate(data[9:]) if b], bits, hashes


# Count-min sketch


def cms_parameters(probability: float = 0.001, tolerance: float = 0.99999) -> tuple[int, int]:
    """(rows, columns); columns are a power of two."""
    if tolerance >= 1:
        raise ValueError("a tolerance of 1 needs endless rows")
    p, t = _clamp(probability, 0.001, 1.0), _clamp(tolerance, 0.001, 1.0)
    rows = max(1, math.floor(math.log(1 - t) / math.log(0.5)))
    return rows, max(2, 1 << (round(math.e / p) - 1).bit_length())


def cms_build(values: DataFrame, column: str, rows: int, columns: int, hasher: Hasher = default_hash) -> DataFrame:
    """Cells ``row, col, count``. Values are counted first, so a frequent one is hashed once per task."""
    counted = values.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("__n"))
    spread = counted.withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(rows - 1))))
    return spread.withColumn("col", unsigned_mod(hasher(F.col(column), F.col("row")), columns)).groupBy("row", "col").agg(F.sum("__n").alias("count"))


def cms_union(*sketches: DataFrame) -> DataFrame:
    out = sketches[0]
    for s in sketches[1:]:
        out = out.unionByName(s)
    return out.groupBy("row", "col").agg(F.sum("count").alias("count"))


def cms_estimate(asked: DataFrame, column: str, sketch: DataFrame, rows: int, columns: int, hasher: Hasher = default_hash) -> DataFrame:
    """Distinct asked values with ``estimate``, at least the true count."""
    asked = asked.select(column).where(F.col(column).isNotNull()).distinct().withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(rows - 1))))
    cells = asked.withColumn("col", unsigned_mod(hasher(F.col(column), F.col("row")), columns)).join(sketch, ["row", "col"], "left")
    return cells.groupBy(column).agg(F.min(F.coalesce("count", F.lit(0))).cast("bigint").alias("estimate"))


def cms_bytes(cells: list[tuple[int, int, int]], rows: int, columns: int) -> bytes:
    """Byte form: rows u64, columns u64, counters u64 row by row."""
    grid = [0] * (rows * columns)
    for r, c, n in cells:
        grid[r * columns + c] = n
    return struct.pack(f"<QQ{len(grid)}Q", rows, columns, *grid)


def cms_from_bytes(data: bytes) -> tuple[list[tuple[int, int, int]], int, int]:
    if len(data) < 16:
        raise ValueError("too short for a count-min sketch")
    rows, columns = struct.unpack("<QQ", data[:16])
    if len(data) != 16 + 8 * rows * columns:
        raise ValueError("length does not fit rows and columns")
    grid = struct.unpack(f"<{rows * columns}Q", data[16:])
    return [(i // columns, i % columns, n) for i, n in enumerate(grid) if n], rows, columns


# HyperLogLog


def hll_precision(precision: int = 10) -> int:
    return int(_clamp(precision, 4, 16))


def hll_build(values: DataFrame, column: str, precision: int = 10, hasher: Hasher = default_hash, bits: int = HASH_BITS) -> DataFrame:
    """Registers ``bucket, rho``: the top bits choose the bucket, trailing zeros give rho."""
    p = hll_precision(precision)
    h = values.where(F.col(column).isNotNull()).select(hasher(F.col(column), F.lit(0)).alias("h"))
    zeros = F.when(F.col("h") == 0, F.lit(64)).when(F.col("h") == F.lit(-(1 << 63)), F.lit(63)).otherwise(F.bit_count(F.col("h").bitwiseAND(-F.col("h")) - 1))
    return h.select(F.shiftrightunsigned("h", bits - p).cast("int").alias("bucket"), (F.least(F.lit(bits - p), zeros) + 1).cast("int").alias("rho")).groupBy("bucket").agg(F.max("rho").alias("rho"))


def hll_union(*sketches: DataFrame) -> DataFrame:
    out = sketches[0]
    for s in sketches[1:]:
        out = out.unionByName(s)
    return out.groupBy("bucket").agg(F.max("rho").alias("rho"))


def hll_estimate(sketch: DataFrame, precision: int = 10) -> DataFrame:
    """One row ``estimate``; no correction for small numbers, so an empty sketch of precision 10 says 738."""
    m = 1 << hll_precision(precision)
    alpha = 0.7213 * m / (m + 1.079)
    total = F.coalesce(F.sum(F.pow(F.lit(2.0), -F.col("rho"))), F.lit(0.0)) + F.lit(m) - F.count("rho")
    return sketch.agg(F.round(F.lit(alpha * m) * (F.lit(float(m)) / total)).cast("bigint").alias("estimate"))


def hll_bytes(registers: list[tuple[int, int]], precision: int) -> bytes:
    """Byte form: constant f64, precision u32, length u64, registers u8."""
    m = 1 << precision
    body = bytearray(m)
    for b, r in registers:
        body[b] = r
    return struct.pack("<dIQ", 0.7213 * m / (m + 1.079), precision, m) + bytes(body)


def hll_from_bytes(data: bytes) -> tuple[list[tuple[int, int]], int]:
    if len(data) < 20:
        raise ValueError("too short for a HyperLogLog")
    _, precision, m = struct.unpack("<dIQ", data[:20])
    if len(data) != 20 + m or m != 1 << precision:
        raise ValueError("length does not fit the precision")
    return [(i, r) for i, r in enumerate(data[20:]) if r], precision
