"""Hash functions of the engine.

``md5_60`` is a column expression (60 bits, never negative) that any SQL engine
can repeat; relational sketches and fingerprints use it by default.
``xxh3_early`` is the pre-release 64-bit XXH3 (as published with xxHash 0.7.2),
needed where stored fingerprints must be the same bits. Confirmed against a
known value for 4 to 8 bytes; other lengths follow the published algorithm.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MASK = (1 << 64) - 1
# Multipliers and the default secret of the published algorithm.
P32_1, P32_2, P32_3 = 0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D
P64_1, P64_2, P64_3, P64_4, P64_5 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5
SECRET = bytes.fromhex(
    "b8fe6c3923a44bbe7c01812cf721ad1cded46de9839097db7240a4a4b7b3671f"
    "cb79e64eccc0e578825ad07dccff7221b8084674f743248ee03590e6813a264c"
    "3c2852bb91c300cb88d0658b532ea371644897a20df94e3819ef46a9deacd8a8"
    "fa763fe39c343ff9dcbbc7c70b4f1d8a51e04bcdb45931c89f7ec9d9787364ea"
    "c5ac8334d3ebc3c581a0fffa1363eb170ddd51b7f0da49d316552629d4689e2b"
    "16be587d47a1fc8ff8b8d17ad031ce45cb3a8f95160428afd7fbcabb4b407e00"
)[:192]


def md5_60(value: Column, seed: int | Column | None = None) -> Column:
    """First 15 hex digits of md5, of ``seed|value`` if there is a seed, as a number. Null for null."""
    if seed is not None:
        value = F.concat((F.lit(str(seed)) if isinstance(seed, int) else seed.cast("string")), F.lit("|"), value.cast("string"))
    return F.conv(F.substring(F.md5(value), 1, 15), 16, 10).cast("bigint")


def _u64(b: bytes, at: int) -> int:
    return int.from_bytes(b[at : at + 8], "little")


def _u32(b: bytes, at: int) -> int:
    return int.from_bytes(b[at : at + 4], "little")


def _finish(h: int) -> int:
    h = (h ^ h >> 37) * P64_3 & MASK
    return h ^ h >> 32


def _fold(a: int, b: int) -> int:
    p = a * b
    return (p ^ p >> 64) & MASK


def _mix16(d: bytes, at: int, secret_at: int, seed: int) -> int:
    return _fold(_u64(d, at) ^ _u64(SECRET, secret_at) + seed & MASK, _u64(d, at + 8) ^ _u64(SECRET, secret_at + 8) - seed & MASK)


def xxh3_early(data: bytes, seed: int = 0) -> int:
    """Unsigned 64-bit hash."""
    n = len(data)
    if n == 0:
        return 0
    if n <= 3:
        joined = data[0] | data[n >> 1] << 8 | data[-1] << 16 | n << 24
        return _finish((joined ^ _u32(SECRET, 0) + seed & MASK) * P64_1 & MASK)
    if n <= 8:
        keyed = (_u32(data, 0) | _u32(data, n - 4) << 32) ^ _u64(SECRET, 0) + seed & MASK
        mixed = n + (keyed ^ keyed >> 51) * P32_1 & MASK
        return _finish((mixed ^ mixed >> 47) * P64_2 & MASK)
    if n <= 16:
        low = _u64(data, 0) ^ _u64(SECRET, 0) + seed & MASK
        high = _u64(data, n - 8) ^ _u64(SECRET, 8) - seed & MASK
        return _finish(n + low + high + _fold(low, high) & MASK)
    if n <= 128:
        pairs = -(-n // 32)
        total = n * P64_1
        for i in range(pairs):
            total += _mix16(data, 16 * i, 32 * i, seed) + _mix16(data, n - 16 * (i + 1), 32 * i + 16, seed)
        return _finish(total & MASK)
    if n <= 240:
        total = n * P64_1 + sum(_mix16(data, 16 * i, 16 * i, seed) for i in range(8))
        total = _finish(total & MASK)
        total += sum(_mix16(data, 16 * i, 16 * (i - 8) + 3, seed) for i in range(8, n // 16))
        return _finish(total + _mix16(data, n - 16, 136 - 17, seed) & MASK)
    return _long(data, seed)


def _long(data: bytes, seed: int) -> int:
    """Inputs above 240 bytes: eight lanes over stripes of 64 bytes, scrambled after each block of 16 stripes."""
    secret = SECRET
    if seed:
        secret = b"".join((_u64(SECRET, i) + (seed if i % 16 == 0 else -seed) & MASK).to_bytes(8, "little") for i in range(0, 192, 8))
    lanes = [P32_3, P64_1, P64_2, P64_3, P64_4, P32_2, P64_5, P32_1]
    per_block = (len(secret) - 64) // 8

    def stripe(at: int, secret_at: int) -> None:
        for i in range(8):
            value = _u64(data, at + 8 * i)
            key = value ^ _u64(secret, secret_at + 8 * i)
            lanes[i] = lanes[i] + value + (key & 0xFFFFFFFF) * (key >> 32) & MASK

    whole = (len(data) - 1) // (64 * per_block)
    for block in range(whole):
        for s in range(per_block):
            stripe((block * per_block + s) * 64, 8 * s)
        for i in range(8):
            lanes[i] = ((lanes[i] ^ lanes[i] >> 47) ^ _u64(secret, len(secret) - 64 + 8 * i)) * P32_1 & MASK
    start = whole * per_block * 64
    for s in range((len(data) - 1 - start) // 64 if len(data) % 64 == 0 else (len(data) - start) // 64):
        stripe(start + 64 * s, 8 * s)
    stripe(len(data) - 64, len(secret) - 64 - 7)
    total = len(data) * P64_1
    for i in range(0, 8, 2):
        total += _fold(lanes[i] ^ _u64(secret, 11 + 8 * i), lanes[i + 1] ^ _u64(secret, 19 + 8 * i))
    return _finish(total & MASK)


def signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


# The same for many values at once: one step for all values of a length.

_WORDS = np.frombuffer(SECRET, "<u8")


def _n(x: int) -> np.uint64:
    return np.uint64(x & MASK)


def _finish_many(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> _n(37)) * _n(P64_3)
    return h ^ h >> _n(32)


def _fold_many(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Low and high half of the 128-bit products, combined."""
    half, low = _n(32), _n(0xFFFFFFFF)
    al, ah, bl, bh = a & low, a >> half, b & low, b >> half
    first, second = al * bh, ah * bl
    carry = (al * bl >> half) + (first & low) + (second & low)
    return a * b ^ ah * bh + (first >> half) + (second >> half) + (carry >> half)


def _equal_length(data: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """Hashes of the rows of a byte matrix."""
    n = data.shape[1]

    def u64(at: int, of: np.ndarray = data) -> np.ndarray:
        return np.ascontiguousarray(of[:, at : at + 8]).view("<u8")[:, 0]

    def u32(at: int) -> np.ndarray:
        return np.ascontiguousarray(data[:, at : at + 4]).view("<u4")[:, 0].astype(np.uint64)

    def mix16(at: int, secret_at: int) -> np.ndarray:
        return _fold_many(u64(at) ^ seed + _n(_u64(SECRET, secret_at)), u64(at + 8) ^ _n(_u64(SECRET, secret_at + 8)) - seed)

    if n == 0:
        return np.zeros(len(data), np.uint64)
    if n <= 3:
        joined = data[:, 0].astype(np.uint64) | data[:, n >> 1].astype(np.uint64) << _n(8) | data[:, -1].astype(np.uint64) << _n(16) | _n(n << 24)
        return _finish_many((joined ^ seed + _n(_u32(SECRET, 0))) * _n(P64_1))
    if n <= 8:
        keyed = (u32(0) | u32(n - 4) << _n(32)) ^ seed + _n(_u64(SECRET, 0))
        mixed = _n(n) + (keyed ^ keyed >> _n(51)) * _n(P32_1)
        return _finish_many((mixed ^ mixed >> _n(47)) * _n(P64_2))
    if n <= 16:
        low, high = u64(0) ^ seed + _n(_u64(SECRET, 0)), u64(n - 8) ^ _n(_u64(SECRET, 8)) - seed
        return _finish_many(_n(n) + low + high + _fold_many(low, high))
    total = np.full(len(data), _n(n * P64_1))
    if n <= 128:
        for i in range(-(-n // 32)):
            total += mix16(16 * i, 32 * i) + mix16(n - 16 * (i + 1), 32 * i + 16)
        return _finish_many(total)
    if n <= 240:
        for i in range(8):
            total += mix16(16 * i, 16 * i)
        total = _finish_many(total)
        for i in range(8, n // 16):
            total += mix16(16 * i, 16 * (i - 8) + 3)
        return _finish_many(total + mix16(n - 16, 136 - 17))
    words = np.where(np.arange(24) % 2 == 0, _WORDS + seed[:, None], _WORDS - seed[:, None])
    secret = np.ascontiguousarray(words).view(np.uint8)
    lanes = np.tile(np.array([P32_3, P64_1, P64_2, P64_3, P64_4, P32_2, P64_5, P32_1], np.uint64), (len(data), 1))
    per_block, half, low = (192 - 64) // 8, _n(32), _n(0xFFFFFFFF)

    def stripe(at: int, secret_at: int) -> None:
        nonlocal lanes
        value = np.ascontiguousarray(data[:, at : at + 64]).view("<u8")
        key = value ^ np.ascontiguousarray(secret[:, secret_at : secret_at + 64]).view("<u8")
        lanes = lanes + value + (key & low) * (key >> half)

    whole = (n - 1) // (64 * per_block)
    for block in range(whole):
        for s in range(per_block):
            stripe((block * per_block + s) * 64, 8 * s)
        lanes = ((lanes ^ lanes >> _n(47)) ^ np.ascontiguousarray(secret[:, 128:192]).view("<u8")) * _n(P32_1)
    start = whole * per_block * 64
    for s in range((n - 1 - start) // 64 if n % 64 == 0 else (n - start) // 64):
        stripe(start + 64 * s, 8 * s)
    stripe(n - 64, 192 - 64 - 7)
    for i in range(0, 8, 2):
        total += _fold_many(lanes[:, i] ^ u64(11 + 8 * i, secret), lanes[:, i + 1] ^ u64(19 + 8 * i, secret))
    return _finish_many(total)


def xxh3_early_many(values: list[bytes], seeds: np.ndarray) -> np.ndarray:
    """Unsigned hashes of many values, each with its seed."""
    sizes, out = np.array([len(v) for v in values], np.int64), np.zeros(len(values), np.uint64)
    for n in np.unique(sizes):
        at = np.flatnonzero(sizes == n)
        for i in range(0, len(at), max(1, (8 << 20) // max(1, int(n)))):  # some MB at a time
            part = at[i : i + max(1, (8 << 20) // max(1, int(n)))]
            data = np.frombuffer(b"".join(values[k] for k in part), np.uint8).reshape(len(part), n)
            out[part] = _equal_length(data, seeds[part].astype(np.uint64))
    return out


@F.pandas_udf(T.LongType())
def xxh3_early_udf(values: pd.Series, seeds: pd.Series) -> pd.Series:
    """The hash as a signed BIGINT (same bits); null for null."""
    out = pd.Series([None] * len(values), dtype="Int64", index=values.index)
    there = values.notna()
    if there.any():
        out[there] = xxh3_early_many([bytes(v) for v in values[there]], seeds[there].to_numpy(np.int64).view(np.uint64)).view(np.int64)
    return out


def xxh3_hash(value: Column, seed: Column) -> Column:
    """``hasher`` of sketches whose byte forms must hold the bits of stored ones; all 64 bits, read as unsigned."""
    return xxh3_early_udf(value.cast("binary"), seed.cast("bigint"))
