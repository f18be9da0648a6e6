"""Range and prefix scans, pages, and a cursor in both directions."""

from __future__ import annotations

import functools
import itertools
import uuid
from bisect import bisect_right
from collections.abc import Sequence

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from runefold.operators.resolve import state
from runefold.shared import free_name, open_fs, parallelism, remove, workspace, written


def successor(prefix: bytes) -> bytes | None:
    """The least key above all keys with this prefix; None if there is none (all 0xFF, or empty)."""
    p = prefix.rstrip(b"\xff")
    return p[:-1] + bytes([p[-1] + 1]) if p else None


def in_range(key: Column, low: bytes, high: bytes) -> Column:
    """Both ends included."""
    return (key >= F.lit(low)) & (key <= F.lit(high))


def has_prefix(key: Column, prefix: bytes) -> Column:
    """``startswith`` with the bounds it implies, which the Parquet scan can use; the prefix alone is not pushed down."""
    if not prefix:
        return key.isNotNull()
    out = key >= F.lit(prefix)
    end = successor(prefix)
    return (out & (key < F.lit(end)) if end else out) & F.startswith(key, F.lit(prefix))


def trimmed(prefix: bytes) -> bytes:
    """Compatible form of a prefix: without trailing zero bytes, one zero byte if nothing is left."""
    return prefix.rstrip(b"\0") or b"\0"


def range_scan(ops: DataFrame, low: bytes, high: bytes, include_system: bool = False) -> DataFrame:
    """Live keys in [low, high], unordered; an inverted range is empty."""
    return state(ops.where(in_range(F.col("key"), low, high)), include_system=include_system)


def prefix_scan(ops: DataFrame, prefix: bytes, include_system: bool = False, compat_trim: bool = False) -> DataFrame:
    return state(ops.where(has_prefix(F.col("key"), trimmed(prefix) if compat_trim else prefix)), include_system=include_system)


def page(rows: DataFrame, number: int, size: int) -> DataFrame:
    """Rows [number * size, (number + 1) * size) in key order; size 0 is empty. Plans as a top-k, not as a full sort."""
    if number < 0 or size < 0:
        raise ValueError("page and size must not be negative")
    return rows.orderBy("key").offset(number * size).limit(size)


def page_after(rows: DataFrame, last: bytes | None, size: int) -> DataFrame:
    """The page after a key (keyset paging): its cost does not grow with the page number."""
    return (rows if last is None else rows.where(F.col("key") > F.lit(last))).orderBy("key").limit(size)


def page_before(rows: DataFrame, first: bytes, size: int) -> DataFrame:
    """The rows before a key, nearest first."""
    return rows.where(F.col("key") < F.lit(first)).orderBy(F.desc("key")).limit(size)


def positions(rows: DataFrame) -> DataFrame:
    """Every row with its place in key order, from 0, without one task holding all rows.

    Range-partitioned, sorted and written once to the shared folder: borders of
    ranges are sampled, so they must not be drawn again between counting and
    numbering. A partition's offset is the sum of the counts before it. Rows of
    equal keys take neighbouring places in no set order.
    """
    spark = rows.sparkSession
    part, place, before = (free_name(rows, c) for c in ("__p", "__i", "__before"))
    ordered = rows.repartitionByRange(parallelism(spark), "key").sortWithinPartitions("key").withColumn(part, F.spark_partition_id())
    # The place within a partition: the low 33 bits of the increasing id count its rows.
    ordered = written(ordered.withColumn(place, F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), workspace(spark, "positions"))
    counts = ordered.groupBy(part).agg(F.count("*").alias("n"))
    offsets = counts.select(part, F.coalesce(F.sum("n").over(W.orderBy(part).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias(before))
    # One row per partition: bounded by the number of partitions.
    return ordered.join(F.broadcast(offsets), part).withColumn("position", F.col(before) + F.col(place)).drop(part, place, before)


def numbered(rows: DataFrame, by: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    """Adds ``name``: the number of each row, from 1, among those that agree in ``by``; rows of one group may fill any number of tasks.

    Ranges of (group, order) are numbered by themselves, then a range whose
    first group began earlier adds that group's rows before it. ``order`` should
    tell the rows of a group apart; else rows with equal places are numbered in no set order.
    """
    spark = rows.sparkSession
    part, place, before = (free_name(rows, c) for c in ("__p", "__i", "__before"))
    ranged = written(rows.repartitionByRange(parallelism(spark), *by, *order).withColumn(part, F.spark_partition_id()), workspace(spark, "numbered"))
    inside = ranged.withColumn(place, F.row_number().over(W.partitionBy(part, *by).orderBy(*order)))
    counts = ranged.groupBy(part, *by).agg(F.count("*").alias("__n"))
    sums = counts.withColumn(before, F.sum("__n").over(W.partitionBy(*by).orderBy(part).rowsBetween(W.unboundedPreceding, -1))).where(F.col(before) > 0)
    carried = sums.select(F.col(part).alias("__cp"), *[F.col(c).alias(f"__c_{c}") for c in by], before)
    same = F.col(part) == F.col("__cp")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__c_{c}"))
    # A range has one group at most that began before it, so this table is bounded by the number of ranges.
    return inside.join(F.broadcast(carried), same, "left").withColumn(name, F.col(place) + F.coalesce(before, F.lit(0))).select(*rows.columns, F.col(name).cast("bigint").alias(name))


def _cut(batches, size: int):
    """Arrow batches of ``size`` rows each, but for the last."""
    import pyarrow as pa

    rest = None
    for b in batches:
        b = b if rest is None else pa.concat_batches([rest, b])
        full = b.num_rows // size * size
        yield from (b.slice(i, size) for i in range(0, full, size))
        rest = b.slice(full)
    if rest is not None and rest.num_rows:
        yield rest


@functools.lru_cache(maxsize=2)
def _reader(uri: str):
    import pyarrow as pa

    fs, path = open_fs(uri)
    return pa.ipc.open_file(fs.open_input_file(path))


class Laid:
    """Rows laid out once in key order, so that driver and tasks can read any block of ``block`` rows by itself.

    Each range of keys is an Arrow file in the shared folder, and a block one of
    its batches; a file's last block may be shorter. Only files that a finished
    task returned are known, so repeated attempts do no harm.
    """

    def __init__(self, rows: DataFrame, block: int):
        if block < 1:
            raise ValueError("a block holds one row at least")
        spark = rows.sparkSession
        self.schema, self.block, self.at = rows.schema, block, (at := workspace(spark, "laid"))

        def write(batches):
            import pyarrow as pa

            blocks, name, n = _cut(batches, block), f"{at}/{uuid.uuid4().hex}", 0
            if (first := next(blocks, None)) is None:
                return
            fs, path = open_fs(name)
            with fs.open_output_stream(path) as sink, pa.ipc.new_file(sink, first.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                for b in itertools.chain([first], blocks):
                    out.write_batch(b)
                    n += b.num_rows
            yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "path": [name], "n": [n]})

        ordered = rows.repartitionByRange(parallelism(spark), "key").sortWithinPartitions("key")
        found = sorted(ordered.mapInArrow(write, "part int, path string, n long").collect())  # one row per range
        self.files, self.sizes = [r["path"] for r in found], [r["n"] for r in found]
        self.starts = list(itertools.accumulate(self.sizes, initial=0))
        self.n_rows = self.starts.pop()

    def read(self, place: int) -> tuple[int, list]:
        """The block that holds row ``place``, and the place of its first row."""
        import pyarrow as pa
        from pyspark.sql.conversion import ArrowTableToRowsConversion

        k = bisect_right(self.starts, place) - 1
        i = (place - self.starts[k]) // self.block
        found = pa.Table.from_batches([_reader(self.files[k]).get_batch(i)])
        return self.starts[k] + i * self.block, ArrowTableToRowsConversion.convert(found, self.schema)


class Cursor:
    """Walks live keys of a scan: ``next`` gives row i and steps on, ``prev`` steps back and gives row i - 1.

    One block of rows is held. The first is a bounded query. A walk that leaves
    it lays all rows out once; after that every block, in either direction, is
    one read of a file, so a whole walk is linear and memory does not grow with it.
    Rows that are laid out already can be walked from any ``place``, in a task too.
    """

    def __init__(self, rows: DataFrame | Laid, block: int = 256, place: int = 0):
        if block < 1:
            raise ValueError("a block holds one row at least")
        self.rows, self.block = rows, block
        self.laid = rows if isinstance(rows, Laid) else None
        if place and not self.laid:
            raise ValueError("only rows that are laid out have places")
        self.held, self.start, self.place, self.asked = [], 0, place, False

    def stop(self) -> None:
        """Back to before the first row; what was laid out for this cursor is deleted."""
        if self.laid is not None and self.laid is not self.rows:
            remove(self.rows.sparkSession, self.laid.at)
            self.laid = None
        self.held, self.start, self.place, self.asked = [], 0, 0, False

    def _hold(self, place: int) -> bool:
        """Holds the block with row ``place``; False if there is no such row."""
        if self.laid is None and not self.asked:
            self.held, self.asked = page_after(self.rows, None, self.block).collect(), True  # one block
        if self.start <= place < self.start + len(self.held):
            return True
        if self.laid is None and len(self.held) == self.block:
            self.laid = Laid(self.rows, self.block)
        if self.laid is None or place >= self.laid.n_rows:
            return False
        self.start, self.held = self.laid.read(place)
        return True

    def next(self):
        if not self._hold(self.place):
            return None
        self.place += 1
        return self.held[self.place - 1 - self.start]

    def prev(self):
        if not self.place or not self._hold(self.place - 1):
            return None
        self.place -= 1
        return self.held[self.place - self.start]
