"""Has this key been seen before? One pass in time order with ribbon filters.

Rows of the log and the entries are reduced to a 64-bit hash of (store, key)
and their time. Map tasks keep of every batch only the earliest row of a hash
(an entry that is not the earliest of its batch is known to be seen and needs
no probe), so a hot key leaves a task once per batch. The rest is split by
hash into partitions, sorted by time and streamed:

* the *open batch* holds the newest distinct hashes exactly;
* when it reaches ``batch_keys``, or as many keys as were sealed before, but at
  most ``MOST_OPEN``, it is *sealed*: a ribbon filter replaces it;
* an entry is seen if the open batch or any sealed generation has its hash.

Batches double, so generations grow with the logarithm of the keys, up to
``MOST_OPEN``. The number of partitions follows the number of rows
(``PARTITION_ROWS``), so a partition holds some ten full generations at most and
memory per task is one open batch and its filters, about ``bits`` x 1.15 bits
per earlier key of the partition, whatever the keys' length and however large
the table. The sort spills, the stream does not keep rows.

Defined results: rows with a null key, store or time are no records; an entry
whose own key, store or time is null has not been seen (and is not returned).
The empty key is a key. Of equal times, an entry with the smaller id comes
first, and a log row is not earlier than an entry of the same time. Wrong
answers are one-sided: a seen key is always reported; an unseen one is
reported with a probability below generations x 2**-bits, plus that of a
collision of 64-bit hashes. ``audit`` measures it with keys that are certainly
absent: strings in a store whose number is above that of every store. They are
hashed and routed as all other rows and asked last.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runefold.llm.ribbon import Ribbon
from runefold.shared import parallelism

#: Keys of an open batch at most, beyond one Arrow batch (8 bytes each).
MOST_OPEN = 1 << 20
#: Keys of the first batch that is sealed.
BATCH_KEYS = 16
#: Rows of a partition, about.
PARTITION_ROWS = 8 << 20
EVENT = "h long, ts long, src int, id long, seen boolean"


def events(log: DataFrame, entries: DataFrame) -> DataFrame:
    """``h, ts, src, id`` of all records; src 0: an entry, 1: a log row."""
    h = F.xxhash64("store_id", "key").alias("h")
    known = "key is not null and store_id is not null and ts is not null"
    a = entries.where(known).select(h, "ts", F.lit(0).alias("src"), F.col("entry_id").alias("id"))
    b = log.where(known).select(h, "ts", F.lit(1).alias("src"), F.lit(0).cast("long").alias("id"))
    return a.unionByName(b)


def _first_in_batch(batches):
    """Keep the earliest row of each hash in a batch; other entries are seen, other log rows redundant."""
    for b in batches:
        if not b.num_rows:
            continue
        h, ts, src, id_ = (b.column(i).to_numpy() for i in range(4))
        order = np.lexsort((id_, src, ts, h))
        first = np.ones(len(h), bool)
        first[order[1:]] = h[order[1:]] != h[order[:-1]]
        keep = first | (src == 0)
        yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (h, ts, src, id_, ~first)], ["h", "ts", "src", "id", "seen"])


class Stream:
    """The state of one partition."""

    def __init__(self, batch_keys: int, bits: int):
        self.batch_keys, self.bits = batch_keys, bits
        self.open, self.sealed, self.keys = np.zeros(0, np.int64), [], 0

    def add(self, h: np.ndarray) -> np.ndarray:
        """Whether each hash, in order, came earlier; the rest is remembered."""
        out, i = [], 0
        while i < len(h):  # Arrow batches may be larger than the batches that are sealed
            j = i + max(self.batch_keys, self.keys // 2)
            out.append(self._add(h[i:j]))
            i = j
        return np.concatenate(out) if out else np.zeros(0, bool)

    def _add(self, h: np.ndarray) -> np.ndarray:
        seen = np.ones(len(h), bool)
        _, first = np.unique(h, return_index=True)
        seen[first] = False
        at = np.flatnonzero(~seen)
        hit = np.isin(h[at], self.open)
        for f in self.sealed:
            rest = ~hit
            hit[rest] = f.contains(h[at[rest]])
        seen[at] = hit
        new = h[at[~hit]]
        self.keys += len(new)
        self.open = np.concatenate([self.open, new])
        if len(self.open) >= min(max(self.batch_keys, self.keys // 2), MOST_OPEN):
            self.sealed.append(Ribbon(self.open, self.bits))
            self.open = np.zeros(0, np.int64)
        return seen

    def probe(self, h: np.ndarray) -> int:
        """How many of these hashes any sealed generation claims to hold."""
        hit = np.zeros(len(h), bool)
        for f in self.sealed:
            rest = np.flatnonzero(~hit)
            hit[rest] = f.contains(h[rest])
        return int(hit.sum())


def _routed(rows: DataFrame, partitions: int | None, *tables: DataFrame) -> DataFrame:
    # Counts of whole tables read the files' footers only.
    n = partitions or max(parallelism(rows.sparkSession), -(-sum(t.count() for t in tables) // PARTITION_ROWS))
    first = rows.mapInArrow(_first_in_batch, EVENT)
    # Answered entries need no state: they are spread by id, so a hot key does not gather them in one partition.
    return first.repartition(n, F.when(F.col("seen"), F.col("id")).otherwise(F.col("h"))).sortWithinPartitions("ts", "src", "id")


def seen_before(log: DataFrame, entries: DataFrame, batch_keys: int = BATCH_KEYS, bits: int = 32, partitions: int | None = None) -> DataFrame:
    """``entry_id`` of every entry whose key occurred earlier in its store."""

    def run(batches):
        state = Stream(batch_keys, bits)
        for b in batches:
            h, src, id_, known = (b.column(b.schema.get_field_index(c)) for c in ("h", "src", "id", "seen"))
            known = known.to_numpy(zero_copy_only=False)
            answer = known.copy()
            answer[~known] = state.add(h.to_numpy()[~known])
            yield pa.RecordBatch.from_arrays([pa.array(id_.to_numpy()[answer & (src.to_numpy() == 0)])], ["entry_id"])

    return _routed(events(log, entries), partitions, log, entries).mapInArrow(run, "entry_id long")


def audit(log: DataFrame, entries: DataFrame, probes: int = 100_000, batch_keys: int = BATCH_KEYS, bits: int = 32, partitions: int | None = None) -> DataFrame:
    """One row: keys held, sealed generations, bytes of the filters, absent keys asked of sealed filters, and how many of them were wrongly found."""
    spark = log.sparkSession
    stores = log.select("store_id").unionByName(entries.select("store_id"))
    absent = stores.agg((F.coalesce(F.max("store_id"), F.lit(0)) + 1).alias("store_id")).crossJoin(spark.range(probes).select(F.concat(F.lit("absent/"), F.col("id").cast("string")).cast("binary").alias("key"), "id"))  # one row with each probe
    asked = absent.select(F.xxhash64("store_id", "key").alias("h"), F.lit((1 << 63) - 1).alias("ts"), F.lit(2).alias("src"), "id")

    def run(batches):
        state, n, wrong = Stream(batch_keys, bits), 0, 0
        for b in batches:
            h, src, known = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("h", "src", "seen"))
            state.add(h[~known & (src < 2)])
            if state.sealed and (last := h[src == 2]).size:  # sorted to the end
                n += len(last)
                wrong += state.probe(last)
        yield pa.RecordBatch.from_pydict(
            {
                "keys": [state.keys],
                "generations": [len(state.sealed)],
                "filter_bytes": [sum(f.nbytes for f in state.sealed)],
                "open_bytes": [state.open.nbytes],
                "probes": [n],
                "wrong": [wrong],
            }
        )

    parts = _routed(events(log, entries).unionByName(asked), partitions, log, entries).mapInArrow(run, "keys long, generations long, filter_bytes long, open_bytes long, probes long, wrong long")
    total = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in parts.columns]
    return parts.agg(*total).withColumn("wrong_rate", F.when(F.col("probes") > 0, F.col("wrong") / F.col("probes")))
