"""Most frequent items in bounded memory, by code-based identification.

A value's 44-bit fingerprint is written as 11 symbols of GF(16), followed by 4
parity symbols of a Reed-Solomon code, which correct any two wrong symbols. In
each of ``repetitions`` independent ways the value falls into one of ``groups``
groups; a group counts its rows per position and symbol (15 x 16 counters).
Whatever is frequent dominates the symbol counts of its group, so the heavy
symbols read position by position, corrected by the code, spell its
fingerprint: no list of values is ever kept. Memory is ``repetitions * groups
* 240`` counters in every task and on the driver, however many rows and
distinct values there are.

Decoding peels: the count of each candidate found is taken out of all its
groups and the rest is decoded again. Candidates are then counted exactly in a
second pass over the table, by value, and written. Afterwards the counters are
checked once more with the exact counts taken out: a value that is frequent but
was not found would have to leave a group with all 15 positions at or above the
threshold in *every* repetition; any fingerprint that such groups still spell
is counted too. If candidates could remain, everything is repeated with four
times as many groups; above ``MOST_GROUPS`` the values are taken in slices by
another hash, a pass for each, so the counters of a task stay bounded however
small the share.

Defined results: null is no value; the empty value is one; ties and the order
of rows do not matter; an empty table has no frequent values. The approximate
count is the least counter of the value over its groups (never below the true
count).
"""

from __future__ import annotations

import functools
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runefold.llm.ribbon import mix
from runefold.shared import parallelism, workspace, written

DATA, PARITY, ALPHABET = 11, 4, 16
LENGTH = DATA + PARITY
CELLS = LENGTH * ALPHABET
#: Rows of counters per shuffled block.
BLOCK = 64
#: Groups of a pass at most: 15.7 MB of counters for each repetition.
MOST_GROUPS = 1 << 13


@functools.cache
def field():
    """Exponentials and logarithms of GF(16) for x^4 + x + 1."""
    exp, x = [], 1
    for _ in range(15):
        exp.append(x)
        x = x << 1 ^ (0b10011 if x & 8 else 0)
    log = {v: i for i, v in enumerate(exp)}
    return exp, log


def times(a: int, b: int) -> int:
    exp, log = field()
    return exp[(log[a] + log[b]) % 15] if a and b else 0


@functools.cache
def parity_table() -> np.ndarray:
    """[data position, symbol] -> its contribution to the 16 parity bits."""
    exp, _ = field()
    generator = [1]
    for root in range(PARITY):
        generator = [a ^ b for a, b in zip([0, *generator], [*(times(exp[root], g) for g in generator), 0])]  # low order first
    out = np.zeros((DATA, ALPHABET), np.uint64)
    for pos, symbol in itertools.product(range(DATA), range(ALPHABET)):
        rest = [0] * LENGTH
        rest[PARITY + pos] = symbol
        for top in range(LENGTH - 1, PARITY - 1, -1):
            if factor := rest[top]:
                for k, g in enumerate(generator):
                    rest[top - PARITY + k] ^= times(factor, g)
        out[pos, symbol] = sum(v << 4 * k for k, v in enumerate(rest[:PARITY]))
    return out


@functools.cache
def corrections() -> dict[tuple, tuple]:
    """Syndrome -> the (position, difference) pairs of the only pattern of up to two errors behind it."""
    exp, _ = field()
    one = {(p, d): tuple(times(d, exp[p * j % 15]) for j in range(PARITY)) for p in range(LENGTH) for d in range(1, ALPHABET)}
    out = {(0,) * PARITY: ()} | {s: (e,) for e, s in one.items()}
    for (e, s), (f, t) in itertools.combinations(one.items(), 2):
        if e[0] != f[0]:
            out[tuple(a ^ b for a, b in zip(s, t))] = (e, f)
    return out


def symbols(fingerprints: np.ndarray) -> np.ndarray:
    """Code words: [row, position]; positions 0-3 parity, 4-14 data."""
    table, f = parity_table(), fingerprints.astype(np.uint64)
    out = np.empty((len(f), LENGTH), np.int64)
    parity = np.zeros(len(f), np.uint64)
    for p in range(DATA):
        s = (f >> np.uint64(4 * p) & np.uint64(15)).astype(np.int64)
        out[:, PARITY + p] = s
        parity ^= table[p][s]
    for p in range(PARITY):
        out[:, p] = (parity >> np.uint64(4 * p) & np.uint64(15)).astype(np.int64)
    return out


def decode(word) -> int | None:
    """Fingerprint of the code word within two symbols of ``word``."""
    exp, _ = field()
    syndrome = [0] * PARITY
    for p, v in enumerate(word):
        for j in range(PARITY):
            syndrome[j] ^= times(v, exp[p * j % 15])
    errors = corrections().get(tuple(syndrome))
    if errors is None:
        return None
    word = list(word)
    for p, d in errors:
        word[p] ^= d
    return sum(v << 4 * p for p, v in enumerate(word[PARITY:]))


def fingerprint(h: np.ndarray) -> np.ndarray:
    return np.asarray(h).view(np.uint64) & np.uint64((1 << 4 * DATA) - 1)


def group_of(fingerprints: np.ndarray, repetition: int, groups: int) -> np.ndarray:
    return ((mix(fingerprints, 7 + repetition) >> np.uint64(32)) * np.uint64(groups) >> np.uint64(32)).astype(np.int64)


def _count(h: np.ndarray, counters: np.ndarray) -> None:
    f, weight = np.unique(fingerprint(h), return_counts=True)
    word = symbols(f) + np.arange(LENGTH) * ALPHABET
    for r in range(counters.shape[0]):
        cell = group_of(f, r, counters.shape[1])[:, None] * CELLS + word
        counters[r] += np.bincount(cell.ravel(), np.repeat(weight, LENGTH), counters[r].size).astype(np.int64).reshape(counters[r].shape)


def counters_of(values: DataFrame, column: str, groups: int, repetitions: int) -> np.ndarray:
    """Counters [repetition, group, position * 16 + symbol] over all non-null values; summed on the cluster."""
    hashed = values.where(F.col(column).isNotNull()).select(F.xxhash64(column).alias("h"))
    shape = (repetitions, groups, CELLS)

    def track(batches):
        own, held, n = np.zeros(shape, np.int64), [], 0
        for b in batches:
            held.append(b.column(0).to_numpy())
            n += b.num_rows
            if n >= 1 << 18:
                _count(np.concatenate(held), own)
                held, n = [], 0
        if held:
            _count(np.concatenate(held), own)
        flat = own.reshape(-1, BLOCK * CELLS)
        used = np.flatnonzero(flat.any(axis=1))
        for i in used:
            yield pa.RecordBatch.from_pydict({"block": [int(i)], "cells": [flat[i].tobytes()]})

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for i, c in zip(b.column(0).to_pylist(), b.column(1)):
                v = np.frombuffer(c.as_buffer(), np.int64)
                total[i] = total[i] + v if i in total else v.copy()
        for i, v in total.items():
            yield pa.RecordBatch.from_pydict({"block": [i], "cells": [v.tobytes()]})

    form = "block long, cells binary"
    n = min(parallelism(values.sparkSession), max(1, repetitions * groups // BLOCK))
    out = np.zeros(shape, np.int64)
    flat = out.reshape(-1, BLOCK * CELLS)
    # The result is bounded by the parameters: repetitions * groups * 240 counters, whatever the table.
    for row in hashed.mapInArrow(track, form).repartition(n, "block").mapInArrow(add, form).toLocalIterator():
        flat[row["block"]] = np.frombuffer(row["cells"], np.int64)
    return out


def _least(counters: np.ndarray, f: int) -> int:
    """Upper bound of a fingerprint's rows: its least counter anywhere."""
    a = np.array([f], np.uint64)
    word = symbols(a)[0] + np.arange(LENGTH) * ALPHABET
    return int(min(counters[r, group_of(a, r, counters.shape[1])[0], word].min() for r in range(counters.shape[0])))


def _take(counters: np.ndarray, f: int, n: int) -> None:
    a = np.array([f], np.uint64)
    word = symbols(a)[0] + np.arange(LENGTH) * ALPHABET
    for r in range(counters.shape[0]):
        counters[r, group_of(a, r, counters.shape[1])[0], word] -= n


def identify(counters: np.ndarray, threshold: float) -> dict[int, int]:
    """Fingerprints that can have ``threshold`` rows, with an upper bound of their rows. Changes ``counters``."""
    found: dict[int, int] = {}
    while True:
        view = counters.reshape(*counters.shape[:2], LENGTH, ALPHABET)
        heaviest = view.max(axis=3)
        new = {}
        # Two wrong symbols are corrected, so thirteen heavy positions suffice to read a word.
        for r, g in np.argwhere((heaviest >= threshold).sum(axis=2) >= LENGTH - 2):
            f = decode(view[r, g].argmax(axis=1).tolist())
            if f is not None and f not in found and group_of(np.array([f], np.uint64), int(r), counters.shape[1])[0] == g and (n := _least(counters, f)) >= threshold:
                new[f] = n
        if not new:
            return found
        for f, n in sorted(new.items(), key=lambda x: -x[1]):
            n = _least(counters, f)
            if n >= threshold:
                found[f] = n
                _take(counters, f, n)


def unresolved(counters: np.ndarray, threshold: float) -> bool:
    """Whether a value with ``threshold`` rows could still hide: in every repetition some group is heavy at all positions."""
    view = counters.reshape(*counters.shape[:2], LENGTH, ALPHABET).max(axis=3)
    return bool(((view >= threshold).all(axis=2)).any(axis=1).all())


def _identified(values: DataFrame, column: str, threshold: float | None, share: float, groups: int, repetitions: int, at: str) -> tuple[DataFrame | None, float, dict[int, int]] | None:
    """``(candidates with exact counts, threshold, upper bounds)``, or None if a frequent value may have been missed."""
    whole = counters_of(values, column, groups, repetitions)
    if threshold is None:
        threshold = max(1.0, share * int(whole[0, :, :ALPHABET].sum()))
    low = F.xxhash64(column).bitwiseAND(F.lit((1 << 4 * DATA) - 1))
    candidates, rest, counted = identify(whole.copy(), threshold), whole.copy(), None
    new = candidates
    while new:
        # Candidates are bounded by the counters, not by the table; those counted before are not counted again.
        exact = values.where(F.col(column).isNotNull() & low.isin([int(f) for f in new])).groupBy(column).agg(F.count("*").alias("n_rows"))
        part = written(exact.withColumn("f", low), f"{at}-{len(candidates)}")
        counted = part if counted is None else counted.unionByName(part)
        for r in part.groupBy("f").agg(F.sum("n_rows").alias("n")).collect():
            _take(rest, r["f"], r["n"])
        new = {f: n for f, n in identify(rest.copy(), threshold).items() if f not in candidates}
        candidates = candidates | new
    if unresolved(rest, threshold):
        return None
    return counted, threshold, {f: _least(whole, f) for f in candidates}


def heavy_hitters(values: DataFrame, column: str, share: float, groups: int = 1024, repetitions: int = 4) -> DataFrame:
    """``column, n_rows, approx_rows`` of every value with at least ``share`` of the non-null rows."""
    spark, given, column = values.sparkSession, column, "__value"
    values = values.select(F.col(given).alias(column))  # a name that the result's columns can't clash with
    at, slices, total, start = workspace(spark, "heavy"), 1, None, groups
    empty = spark.createDataFrame([], values.select(column, F.lit(0).cast("long").alias("n_rows"), F.lit(0).cast("long").alias("approx_rows")).schema)
    while True:
        found = []
        for k in range(slices):
            mine = values if slices == 1 else values.where(F.pmod(F.xxhash64(F.lit(slices), column), F.lit(slices)) == k)
            threshold = None
            if slices > 1:
                total = total if total is not None else values.where(F.col(column).isNotNull()).count()
                threshold = max(1.0, share * total)
            part = _identified(mine, column, threshold, share, groups, repetitions, f"{at}/{groups}-{slices}-{k}")
            if part is None:
                break
            found.append(part)
        else:
            break
        groups, slices = (min(4 * groups, max(MOST_GROUPS, start)), slices) if groups < MOST_GROUPS else (groups, 4 * slices)
    out = empty
    for counted, threshold, bounds in found:
        if counted is not None:
            estimates = F.create_map(*[F.lit(int(x)).cast("long") for f, n in bounds.items() for x in (f, n)])
            out = out.unionByName(counted.where(F.col("n_rows") >= threshold).select(column, "n_rows", estimates[F.col("f")].alias("approx_rows")))
    return out.withColumnRenamed(column, given)
