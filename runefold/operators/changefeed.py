"""Applying a feed of inserts, updates and deletes.

``fold`` keeps, per key, the maximum of ``struct(sequence..., operation,
payload...)``. The maximum is commutative, associative and idempotent: order
of arrival, repeats and retries cannot change the result, partial results of
map tasks combine before the shuffle (a hot key leaves each task as one row),
and a folded table can be folded again with later changes. Tombstones stay in
the folded table, so a change that arrives after the delete but is older than
it does not bring the key back; ``live`` drops them only on reading.

Defined results: rows with a null key part in ``required`` are torn and no
record; a null sequence sorts before every other; equal sequences with unequal
content take the larger ``(operation, payload)`` (a delete before an insert),
so the result is the same on every run. An empty feed gives an empty table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fold(changes: DataFrame, keys: Sequence[str], sequence: Sequence[str], operation: str = "tombstone", payload: Sequence[str] = (), base: DataFrame | None = None, required: Sequence[str] | None = None) -> DataFrame:
    """One row per key: ``keys, sequence..., operation, payload...`` of the newest change, tombstones included."""
    cols = [*keys, *sequence, operation, *payload]
    rows = changes.select(*cols)
    if base is not None:
        rows = rows.unionByName(base.select(*cols))
    rows = rows.dropna(subset=list(required if required is not None else keys))
    newest = F.max(F.struct(*sequence, operation, *payload)).alias("__newest")
    return rows.groupBy(*keys).agg(newest).select(*keys, *[F.col("__newest")[c].alias(c) for c in (*sequence, operation, *payload)])


def live(folded: DataFrame, operation: str = "tombstone") -> DataFrame:
    """The current rows: those whose newest change is no delete (a null operation deletes nothing)."""
    return folded.where(~F.coalesce(F.col(operation), F.lit(False))).drop(operation)
