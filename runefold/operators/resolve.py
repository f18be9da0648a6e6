"""Which version of a key counts: last write by (ts, seq), deletes hidden.

Filters on keys may go below ``resolve`` (Catalyst pushes grouping-key
predicates through the aggregate to the scan); filters on values or tombstones
must stay above it. Rows with a null key are no records. Of equal (ts, seq) a
delete wins, then the larger value, so results never depend on order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runefold.schema import RESERVED


def resolve(ops: DataFrame, by: Sequence[str] = ("key",), extra: Sequence[str] = ()) -> DataFrame:
    """Newest version per key, tombstones included: ``by, ts, seq, tombstone, value, extra``."""
    newest = F.max(F.struct("ts", "seq", "tombstone", "value", *extra)).alias("__v")
    return ops.dropna(subset=list(by)).groupBy(*by).agg(newest).select(*by, "__v.*")


def state(ops: DataFrame, by: Sequence[str] = ("key",), extra: Sequence[str] = (), include_system: bool = False) -> DataFrame:
    """Live keys with their newest value."""
    if not include_system and "key" in by:
        ops = ops.where(~reserved(F.col("key")))
    return resolve(ops, by, extra).where(~F.coalesce(F.col("tombstone"), F.lit(False))).drop("tombstone")


def reserved(key: Column) -> Column:
    """Whether a key stands under a reserved prefix; false for null."""
    key = key.cast("binary")
    return F.coalesce(F.greatest(*(F.startswith(key, F.lit(p)) for p in RESERVED)), F.lit(False))


def point_get(ops: DataFrame, key: bytes) -> DataFrame:
    """The live version of one key: no or one row. The equality reaches the Parquet scan."""
    return state(ops.where(F.col("key") == F.lit(key)), include_system=True)


def batch_get(ops: DataFrame, keys: DataFrame) -> DataFrame:
    """Values of a table of keys (column ``key``); absent and deleted keys give a null value.

    Every distinct asked key gives one row; a null key is asked for nothing.
    """
    asked = keys.select("key").where("key is not null").distinct()
    found = state(ops.join(asked, "key", "left_semi"), include_system=True).select("key", "value", "ts")
    return asked.join(found, "key", "left")


def deleted(ops: DataFrame) -> DataFrame:
    """Keys whose newest version is a tombstone."""
    return resolve(ops).where("tombstone").select("key", "ts", "seq")


def without(ops: DataFrame, keys: DataFrame) -> DataFrame:
    """Physical delete: the operations without any version of these keys (column ``key``); a null key removes nothing."""
    return ops.join(keys.select("key").where("key is not null").distinct(), "key", "left_anti")


def last_arrival(ops: DataFrame) -> DataFrame:
    """In-memory table semantics: the last row by arrival (``seq``) wins, whatever its timestamp."""
    last = ops.dropna(subset=["key"]).groupBy("key").agg(F.max(F.struct("seq", "ts", "tombstone", "value")).alias("__v"))
    return last.select("key", "__v.*")


def most_recent_keys(accesses: DataFrame, capacity: int) -> DataFrame:
    """What a least-recently-used cache of ``capacity`` keys holds after the accesses: a top-k by last access."""
    last = accesses.dropna(subset=["key"]).groupBy("key").agg(F.max("seq").alias("last_seq"))
    return last.orderBy(F.desc("last_seq")).limit(capacity)
