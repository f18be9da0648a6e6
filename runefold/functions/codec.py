"""Variable-length integers, the key dictionary, and record layouts.

An integer is written in base 128, highest group first; all bytes but the last
have their top bit set. Up to 128 bits.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runefold.functions.integrity import crc32c
from runefold.operators.scan import positions


class CRCError(ValueError):
    """A record's checksum does not fit its content."""


def encode(value: int) -> bytes:
    if value < 0 or value >> 128:
        raise ValueError("0 to 2**128 - 1 can be encoded")
    out = [value & 0x7F]
    while value := value >> 7:
        out.append(value & 0x7F | 0x80)
    return bytes(reversed(out))


def decode(data: bytes) -> tuple[int | None, int]:
    """(value, bytes read); the value is None above 128 bits or where the data ends too early."""
    value = 0
    for i, b in enumerate(data):
        value = value << 7 | b & 0x7F
        if value >> 128:
            return None, i + 1
        if b < 0x80:
            return value, i + 1
    return None, len(data)


def encoded(value: Column) -> Column:
    """Binary encoding of a non-negative BIGINT, from built-in functions only; null for null and negative values."""
    parts = []
    for g in range(8, -1, -1):
        rest = F.shiftrightunsigned(value, 7 * g)
        byte = rest.bitwiseAND(F.lit(0x7F)) + F.lit(0x80 if g else 0)
        parts.append(F.when((rest > 0) | F.lit(g == 0), F.lpad(F.hex(byte), 2, "0")).otherwise(F.lit("")))
    return F.when(value >= 0, F.unhex(F.concat(*parts)))


@F.pandas_udf(T.StructType([T.StructField("value", T.DecimalType(38, 0)), T.StructField("length", T.IntegerType())]))
def decode_udf(data: pd.Series) -> pd.DataFrame:
    """Value (null if it can't be decoded, or above 38 digits) and bytes read."""
    from decimal import Decimal

    rows = [(None, None) if d is None else decode(bytes(d)) for d in data]
    return pd.DataFrame({"value": [None if v is None or v >= 10**38 else Decimal(v) for v, _ in rows], "length": pd.array([n for _, n in rows], dtype="Int32")})


def dictionary(ops: DataFrame) -> DataFrame:
    """``key, ordinal``: keys numbered from 0 by first occurrence (least ``seq``; ties by key).

    The order comes from a range partition with per-partition offsets, so no
    task holds all keys.
    """
    first = ops.dropna(subset=["key"]).groupBy("key").agg(F.min("seq").alias("first_seq"))
    placed = positions(first.select(F.struct("first_seq", "key").alias("key")))
    return placed.select(F.col("key.key").alias("key"), F.col("position").alias("ordinal"))


def dictionary_encode(rows: DataFrame, words: DataFrame) -> DataFrame:
    """Adds ``ordinal``; null for keys the dictionary lacks."""
    return rows.join(words, "key", "left")


def dictionary_decode(rows: DataFrame, words: DataFrame) -> DataFrame:
    """Adds ``key`` for ``ordinal``; null for unknown ordinals, which callers treat as an error."""
    return rows.join(words, "ordinal", "left")


@dataclass(frozen=True)
class Record:
    key: bytes
    value: bytes | None
    tombstone: bool
    ts: int


def write_log_record(r: Record) -> bytes:
    """crc u32, ts u128, tombstone u8, key length u64, value length u64, key, value."""
    value = b"" if r.tombstone or r.value is None else r.value
    body = r.ts.to_bytes(16, "little") + struct.pack("<BQQ", r.tombstone, len(r.key), len(value)) + r.key + value
    return struct.pack("<I", crc32c(body)) + body


def read_log_record(data: bytes, at: int = 0) -> tuple[Record, int]:
    """(record, place after it); ``CRCError`` on a wrong checksum, ``EOFError`` where the data ends too early."""
    if at + 37 > len(data):
        raise EOFError("the log ends inside a record header")
    crc, ts = struct.unpack_from("<I", data, at)[0], int.from_bytes(data[at + 4 : at + 20], "little")
    dead, n_key, n_value = struct.unpack_from("<BQQ", data, at + 20)
    end = at + 37 + n_key + n_value
    if end > len(data):
        raise EOFError("the log ends inside a record")
    if crc32c(data[at + 4 : end]) != crc:
        raise CRCError(f"record at byte {at}")
    key, value = data[at + 37 : at + 37 + n_key], data[at + 37 + n_key : end]
    return Record(key, None if dead else value, bool(dead), ts), end


def write_table_record(r: Record, variable: bool = True) -> bytes:
    """The sorted table's form: integers of fixed width or variable length; deletes carry no value."""

    def put(n: int, width: int) -> bytes:
        return encode(n) if variable else n.to_bytes(width, "little")

    body = put(r.ts, 16) + bytes([r.tombstone]) + put(len(r.key), 8)
    if not r.tombstone:
        body += put(len(r.value or b""), 8)
    body += r.key + (b"" if r.tombstone else r.value or b"")
    crc = crc32c(body)
    return (encode(crc) if variable else struct.pack("<I", crc)) + body


@F.pandas_udf(T.BinaryType())
def table_record_udf(key: pd.Series, value: pd.Series, tombstone: pd.Series, ts: pd.Series, variable: pd.Series) -> pd.Series:
    """``write_table_record`` of each row."""
    return pd.Series([write_table_record(Record(bytes(k), None if v is None else bytes(v), bool(d), int(t)), bool(x)) for k, v, d, t, x in zip(key, value, tombstone, ts, variable)])


def read_table_record(data: bytes, at: int = 0, variable: bool = True) -> tuple[Record, int]:
    def get(at: int, width: int) -> tuple[int, int]:
        if variable:
            v, n = decode(data[at : at + 19])
            if v is None:
                raise EOFError("an integer ends too early")
            return v, at + n
        if at + width > len(data):
            raise EOFError("an integer ends too early")
        return int.from_bytes(data[at : at + width], "little"), at + width

    crc, body = get(at, 4)
    ts, p = get(body, 16)
    dead, p = data[p], p + 1
    n_key, p = get(p, 8)
    n_value, p = (0, p) if dead else get(p, 8)
    end = p + n_key + n_value
    if end > len(data):
        raise EOFError("the table ends inside a record")
    if crc32c(data[body:end]) != crc:
        raise CRCError(f"record at byte {at}")
    return Record(data[p : p + n_key], None if dead else data[p + n_key : end], bool(dead), ts), end
