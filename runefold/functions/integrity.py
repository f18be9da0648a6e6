"""Merkle trees over 1024-byte chunks, and CRC-32C.

A leaf is the SHA-256 (hex) of its chunk, a parent that of its children's hex
strings; an odd node moves up unhashed. Empty and null data have no root.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK = 1024


def leaf_hashes(data: Column, chunk: int = CHUNK) -> Column:
    """Array of the leaves' hashes; empty for empty data."""
    n = F.ceil(F.octet_length(data) / chunk).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.sha2(F.substring(data, i * chunk + 1, F.lit(chunk)), 256))).otherwise(F.array().cast("array<string>"))


def merkle_root(leaves: Column) -> Column:
    """Root over an array of leaf hashes, level by level inside the row; null without leaves."""

    def up(level: Column, _: Column) -> Column:
        pairs = F.sequence(F.lit(0), F.floor((F.size(level) - 1) / 2).cast("int"))
        return F.transform(pairs, lambda i: F.when(2 * i + 1 < F.size(level), F.sha2(F.concat(level[2 * i], F.get(level, 2 * i + 1)), 256)).otherwise(level[2 * i]))

    height = F.ceil(F.log2(F.greatest(F.size(leaves), F.lit(1)))).cast("int")
    steps = F.when(height > 0, F.sequence(F.lit(1), height)).otherwise(F.array().cast("array<int>"))
    return F.when(F.size(leaves) > 0, F.aggregate(steps, leaves, up)[0])


def merkle_leaves(rows: DataFrame, id_column: str, data_column: str) -> DataFrame:
    """``id_column, chunk, hash``."""
    return rows.select(id_column, F.posexplode(leaf_hashes(F.col(data_column))).alias("chunk", "hash"))


def merkle_diff(a: DataFrame, b: DataFrame, id_column: str) -> DataFrame:
    """Chunks that differ or that only one side has, from two tables of leaves."""
    both = a.withColumnRenamed("hash", "__a").join(b.withColumnRenamed("hash", "__b"), [id_column, "chunk"], "full")
    return both.where(~F.col("__a").eqNullSafe(F.col("__b"))).select(id_column, "chunk")


def merkle_bytes(leaves: list[str]) -> bytes:
    """Byte form: the leaves' hex strings, 64 bytes each."""
    return "".join(leaves).encode()


def merkle_from_bytes(data: bytes) -> list[str]:
    if len(data) % 64:
        raise ValueError("a leaf takes 64 bytes")
    return [data[i : i + 64].decode() for i in range(0, len(data), 64)]


def _table() -> np.ndarray:
    """CRC-32C (reflected polynomial 0x82F63B78) of every byte."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, t >> np.uint32(1) ^ np.uint32(0x82F63B78), t >> np.uint32(1)).astype(np.uint32)
    return t


_CRC = _table()


#: Longer values are cut, and the checksums of the parts combined.
PART = 4096


def _steps(parts: list[bytes], start: np.ndarray) -> np.ndarray:
    """State of the checksum after each part: byte j of all that are long enough in one step."""
    sizes = np.array([len(v) for v in parts], np.int64)
    order = np.argsort(-sizes, kind="stable")
    data = np.frombuffer(b"".join(parts[i] for i in order) or b"\0", np.uint8)
    at = np.concatenate([[0], np.cumsum(sizes[order])])[:-1] if len(parts) else np.zeros(0, np.int64)
    crc = start[order].copy()
    falling = -sizes[order]
    for j in range(int(sizes.max(initial=0))):
        n = int(np.searchsorted(falling, -j, side="left"))
        crc[:n] = _CRC[(crc[:n] ^ data[at[:n] + j]) & 0xFF] ^ crc[:n] >> np.uint32(8)
    out = np.empty(len(parts), np.uint32)
    out[order] = crc
    return out


@functools.cache
def _behind_zeros() -> np.ndarray:
    """[place of a state's byte, its value] -> what PART zero bytes make of it; the state is the sum of its bytes' parts."""
    states = (np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]).reshape(-1)
    for _ in range(PART):
        states = _CRC[states & 0xFF] ^ states >> np.uint32(8)
    return states.reshape(4, 256)


def crc32c_many(values: list[bytes]) -> np.ndarray:
    """CRC-32C of many values at once. A long value is its first bytes and parts of PART bytes; each part costs as much as a short value."""
    parts, start, count = [], [], []
    for v in values:
        head = len(v) - (max(0, len(v) - 1) // PART) * PART
        cuts = range(head, len(v), PART)
        parts += [v[:head], *(v[i : i + PART] for i in cuts)]
        start += [0xFFFFFFFF] + [0] * len(cuts)
        count.append(1 + len(cuts))
    states = _steps(parts, np.array(start, np.uint32))
    if len(parts) == len(values):
        return ~states
    out, at, table = np.empty(len(values), np.uint32), 0, _behind_zeros().tolist()
    for k, n in enumerate(count):
        state = int(states[at])
        for x in states[at + 1 : at + n].tolist():
            state = table[0][state & 0xFF] ^ table[1][state >> 8 & 0xFF] ^ table[2][state >> 16 & 0xFF] ^ table[3][state >> 24] ^ x
        out[k] = state
        at += n
    return ~out


_CRC_LIST = _CRC.tolist()


def crc32c(value: bytes) -> int:
    """CRC-32C of one value."""
    crc = 0xFFFFFFFF
    for b in value:
        crc = _CRC_LIST[(crc ^ b) & 0xFF] ^ crc >> 8
    return crc ^ 0xFFFFFFFF


@F.pandas_udf(T.LongType())
def crc32c_udf(values: pd.Series) -> pd.Series:
    """CRC-32C of binary values; null for null."""
    out = pd.Series([None] * len(values), dtype="Int64", index=values.index)
    there = values.notna()
    if there.any():
        out[there] = crc32c_many([bytes(v) for v in values[there]]).astype(np.int64)
    return out
