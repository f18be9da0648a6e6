"""Token buckets over time-ordered requests.

A bucket starts full. At each request it first gains ``trunc(rate * seconds
since the last request)`` tokens, up to its capacity (what is cut off is lost,
even if nothing was gained), then grants the request if it holds enough.

The recurrence is sequential per bucket, but a stretch of requests is a
function from the tokens before to the tokens after it, a table of capacity + 1
numbers that soon becomes constant. Requests are cut into ranges of (bucket,
time); every range gives that table for its first bucket, the tables are
applied one after the other, and then all ranges are answered at once, each
with the state that its first bucket brings along. So a bucket with most of the
requests fills many tasks.

Rows with a null bucket or time are refused (``granted`` false). Of equal
times, the smaller tie-breaker comes first. Time running backwards adds nothing.
"""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runefold.shared import free_name, parallelism, workspace, written


def step(tokens: int, last: int | None, ts: int, cost: int, capacity: int, rate: int) -> tuple[int, bool]:
    """(tokens after the request at ``ts`` microseconds, granted)."""
    if last is not None:
        tokens = min(capacity, tokens + int(rate * (max(0, ts - last) / 1_000_000.0)))
    return (tokens - cost, True) if tokens >= cost else (tokens, False)


def _through(start: np.ndarray, ts: list[int], cost: int, capacity: int, rate: int) -> np.ndarray:
    """Tokens after the requests at ``ts`` for each number of tokens that the first one may find."""
    tokens = np.where(start >= cost, start - cost, start)
    for i in range(1, len(ts)):
        if tokens.min() == tokens.max():  # the state before no longer matters: one number goes on
            t = int(tokens[0])
            for before, now in zip(ts[i - 1 :], ts[i:]):
                t, _ = step(t, before, now, cost, capacity, rate)
            return np.full_like(tokens, t)
        have = np.minimum(capacity, tokens + int(rate * (max(0, ts[i] - ts[i - 1]) / 1_000_000.0)))
        tokens = np.where(have >= cost, have - cost, have)
    return tokens


def admit(requests: DataFrame, bucket: str, ts: str, tie: str, capacity: int = 1000, rate: int = 100, cost: int = 1, tokens_left: bool = False) -> DataFrame:
    """Adds ``granted``, and with ``tokens_left`` the bucket's ``tokens`` after the request, to ``bucket, ts, tie`` (times as microseconds, BIGINT)."""
    spark = requests.sparkSession
    rows = requests.select(bucket, ts, tie)
    part = free_name(rows, "__p")
    n = parallelism(spark)
    known = rows.where(F.col(bucket).isNotNull() & F.col(ts).isNotNull()).repartitionByRange(n, bucket, ts, tie).withColumn(part, F.spark_partition_id())
    ranged = written(known, workspace(spark, "requests")).repartitionById(n, F.col(part)).sortWithinPartitions(bucket, ts, tie)
    places, names = [ranged.columns.index(c) for c in (bucket, ts, part)], [*rows.columns, "granted", "tokens"][: None if tokens_left else -1]

    def stretches(batches):
        """(range, bucket, times) in order; times of a bucket come in several pieces."""
        for b in batches:
            keys, times, parts = (b.column(i) for i in places)
            keys, times = keys.to_pylist(), times.to_pylist()
            at = 0
            for i in range(1, len(keys) + 1):
                if i == len(keys) or keys[i] != keys[at]:
                    yield parts[0].as_py(), keys[at], times[at:i]
                    at = i

    def summarise(batches):
        p = first = now = tokens = last = begin = table = kind = None

        def seen(batches):
            nonlocal kind
            for b in batches:
                kind = b.column(places[0]).type
                yield b

        for p, key, times in stretches(seen(batches)):
            if first is None:
                first, begin, table = key, times[0], np.arange(capacity + 1)
            if key == first:
                if last is None:
                    table = _through(table, times, cost, capacity, rate)
                else:
                    gained = np.minimum(capacity, table + int(rate * (max(0, times[0] - last) / 1_000_000.0)))
                    table = _through(gained, times, cost, capacity, rate)
            elif key != now:
                tokens, last_of = capacity, None
                for t in times:
                    tokens, _ = step(tokens, last_of, t, cost, capacity, rate)
                    last_of = t
            else:
                for t in times:
                    tokens, _ = step(tokens, last, t, cost, capacity, rate)
                    last = t
            now, last = key, times[-1]
        if first is not None:
            yield pa.RecordBatch.from_pydict({"p": pa.array([p], pa.int32()), "begin": [begin], "table": [table.astype(np.int64).tolist()], "whole": [first == now], "tokens": pa.array([tokens], pa.int64()), "last": [last]}).add_column(1, "first", pa.array([first], kind)).add_column(2, "now", pa.array([now], kind))

    name = rows.schema[bucket].dataType.simpleString()
    form = f"p int, first {name}, now {name}, begin long, table array<long>, whole boolean, tokens long, last long"
    # One row a range, each with capacity + 1 numbers: bounded by the parameters.
    carried: dict[int, tuple] = {}
    state = None  # (bucket, tokens, last) at the end of the range before
    for r in sorted(ranged.mapInArrow(summarise, form).collect(), key=lambda r: r["p"]):
        known_before = state is not None and state[0] == r["first"]
        if known_before:
            carried[r["p"]] = state[1:]
        if r["whole"]:
            found = min(capacity, state[1] + int(rate * (max(0, r["begin"] - state[2]) / 1_000_000.0))) if known_before else capacity
            state = (r["first"], r["table"][found], r["last"])
        else:
            state = (r["now"], r["tokens"], r["last"])

    def answer(batches):
        now, tokens, last = None, capacity, None
        for b in batches:
            out, left = [], []
            for p, key, times in stretches([b]):
                if now is None or key != now[0]:
                    tokens, last = carried.get(p, (capacity, None)) if now is None else (capacity, None)
                    now = (key,)
                for t in times:
                    tokens, ok = step(tokens, last, t, cost, capacity, rate)
                    last = t
                    out.append(ok)
                    left.append(tokens)
            columns = [*(b.column(i) for i, c in enumerate(b.schema.names) if c != part), pa.array(out, pa.bool_()), pa.array(left, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns[: len(names)], names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", granted boolean" + ", tokens long" * tokens_left
    refused = rows.where(F.col(bucket).isNull() | F.col(ts).isNull()).withColumn("granted", F.lit(False))
    if tokens_left:
        refused = refused.withColumn("tokens", F.lit(None).cast("long"))
    return ranged.mapInArrow(answer, schema).unionByName(refused)


def states(requests: DataFrame, bucket: str, ts: str, tie: str, capacity: int = 1000, rate: int = 100) -> DataFrame:
    """``bucket, tokens, last``: what each bucket holds after all requests, and when it was asked last."""
    done = admit(requests, bucket, ts, tie, capacity, rate, tokens_left=True).where("tokens is not null")
    return done.groupBy(bucket).agg(F.max(F.struct(F.col(ts).alias("t"), F.col(tie).alias("i"), "tokens")).alias("m")).select(bucket, "m.tokens", F.col("m.t").alias("last"))


@F.pandas_udf(T.BinaryType())
def bucket_bytes_udf(capacity: pd.Series, tokens: pd.Series, last: pd.Series, rate: pd.Series) -> pd.Series:
    return pd.Series([bucket_bytes(*map(int, r)) for r in zip(capacity, tokens, last, rate)])


def bucket_bytes(capacity: int, tokens: int, last: int, rate: int) -> bytes:
    """Byte form: capacity u64, tokens u64, last refill u128, rate u64."""
    return struct.pack("<QQ", capacity, tokens) + last.to_bytes(16, "little") + struct.pack("<Q", rate)


def bucket_from_bytes(data: bytes) -> tuple[int, int, int, int]:
    if len(data) != 40:
        raise ValueError("a bucket takes 40 bytes")
    capacity, tokens = struct.unpack_from("<QQ", data)
    return capacity, tokens, int.from_bytes(data[16:32], "little"), struct.unpack_from("<Q", data, 32)[0]
