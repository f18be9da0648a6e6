"""The write-ahead log: appending, segments of checksummed records, replay and retention."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from runefold.functions.codec import CRCError, Record, read_log_record, write_log_record
from runefold.functions.integrity import crc32c_udf
from runefold.operators.scan import positions
from runefold.schema import LOG
from runefold.shared import workspace, written


def append(ops: DataFrame, path: str, records_per_file: int = 0) -> None:
    """Append operations to the log table; ``records_per_file`` bounds its files (0: no bound)."""
    ops.select(*LOG.fieldNames()).write.mode("append").option("maxRecordsPerFile", records_per_file).parquet(path)


def replay(spark: SparkSession, path: str, after_seq: int | None = None) -> DataFrame:
    """The log's operations, those after a sequence number if given; the bound reaches the scan."""
    log = spark.read.schema(LOG).parquet(path)
    return log if after_seq is None else log.where(F.col("seq") > after_seq)


def retained(log: DataFrame, flushed_seq: int) -> DataFrame:
    """What is left after truncation up to ``flushed_seq``."""
    return log.where(F.col("seq") > flushed_seq)


def record_content(key: Column, value: Column, tombstone: Column, ts: Column) -> Column:
    """Bytes that a record's checksum covers, from built-in functions; big numbers low byte first."""

    def little(x: Column, width: int) -> Column:
        digits = F.lpad(F.hex(x), 2 * width, "0")
        return F.unhex(F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in range(width - 1, -1, -1)]))

    empty = F.lit(b"")
    body = F.when(tombstone, empty).otherwise(F.coalesce(value, empty))
    return F.concat(little(ts, 8), F.lit(bytes(8)), F.when(tombstone, F.lit(b"\x01")).otherwise(F.lit(b"\x00")), little(F.octet_length(key).cast("bigint"), 8), little(F.octet_length(body).cast("bigint"), 8), key, body)


def with_checksum(ops: DataFrame) -> DataFrame:
    """Adds ``crc``, the record's CRC-32C; null where the key is null (a torn write)."""
    return ops.withColumn("crc", crc32c_udf(record_content(F.col("key"), F.col("value"), F.col("tombstone"), F.col("ts"))))


def intact(ops: DataFrame) -> DataFrame:
    """Rows whose stored ``crc`` fits their content; the rest is dropped, as a replay passes over damaged records."""
    checked = ops.withColumn("__crc", crc32c_udf(record_content(F.col("key"), F.col("value"), F.col("tombstone"), F.col("ts"))))
    return checked.where(F.col("__crc") == F.col("crc")).drop("__crc")


def write_segments(ops: DataFrame, records_per_segment: int) -> DataFrame:
    """``segment, first_seq, data``: the log as byte segments of whole records, in order of ``seq``."""
    # Places in log order from a range partition; a segment's rows stay together by its number.
    placed = positions(ops.withColumnRenamed("key", "__key").withColumnRenamed("seq", "key")).withColumn("segment", F.floor(F.col("position") / records_per_segment).cast("bigint"))
    placed = placed.withColumnRenamed("key", "seq").withColumnRenamed("__key", "key").repartition("segment").sortWithinPartitions("segment", "seq")

    def pack(batches):
        now, first, data = None, None, bytearray()
        for b in batches:
            for segment, seq, key, value, dead, ts in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("segment", "seq", "key", "value", "tombstone", "ts"))):
                if now is not None and segment != now:
                    yield pa.RecordBatch.from_pydict({"segment": [now], "first_seq": [first], "data": [bytes(data)]})
                    data = bytearray()
                if segment != now:
                    now, first = segment, seq
                data += write_log_record(Record(key, value, dead, ts))
        if now is not None:
            yield pa.RecordBatch.from_pydict({"segment": [now], "first_seq": [first], "data": [bytes(data)]})

    return placed.mapInArrow(pack, "segment long, first_seq long, data binary")


def read_segments(segments: DataFrame) -> DataFrame:
    """``segment, place, key, value, tombstone, ts, error`` of every record; a damaged one has an error and the reader goes on behind it.

    A record that ends after its segment is reported as torn.
    """

    def unpack(batches):
        for pdf in batches:
            out = []
            for segment, data in zip(pdf["segment"], pdf["data"]):
                at, data = 0, bytes(data)
                while at < len(data):
                    try:
                        r, end = read_log_record(data, at)
                        out.append((segment, at, r.key, r.value, r.tombstone, r.ts, None))
                    except CRCError:
                        end = at + 37 + int.from_bytes(data[at + 21 : at + 29], "little") + int.from_bytes(data[at + 29 : at + 37], "little")
                        out.append((segment, at, None, None, None, None, "crc"))
                    except EOFError:
                        out.append((segment, at, None, None, None, None, "torn"))
                        break
                    at = end
            yield pd.DataFrame(out, columns=["segment", "place", "key", "value", "tombstone", "ts", "error"]).astype({"tombstone": "boolean", "ts": "Int64"})

    return segments.select("segment", "data").mapInPandas(unpack, "segment long, place long, key binary, value binary, tombstone boolean, ts long, error string")


def cut_segments(segments: DataFrame, file_bytes: int) -> DataFrame:
    """``file, data``: the segments' bytes in one stream, cut at every ``file_bytes`` wherever records end, as a log that rotates by size."""
    sizes = segments.select("segment", F.octet_length("data").cast("bigint").alias("size"))
    # Sizes only, a row a segment.
    starts = sizes.withColumn("start", F.coalesce(F.sum("size").over(W.orderBy("segment").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    placed = segments.select("segment", "data").join(starts, "segment").where("size > 0")
    first, last = F.floor(F.col("start") / file_bytes), F.floor((F.col("start") + F.col("size") - 1) / file_bytes)
    pieces = placed.withColumn("file", F.explode(F.sequence(first, last)))
    begin = F.greatest(F.col("file") * file_bytes - F.col("start"), F.lit(0))
    end = F.least((F.col("file") + 1) * file_bytes - F.col("start"), F.col("size"))
    cut = pieces.select("file", F.struct("start", F.substring("data", (begin + 1).cast("int"), (end - begin).cast("int")).alias("data")).alias("piece"))
    # A file's pieces hold ``file_bytes`` together.
    whole = F.aggregate(F.array_sort(F.collect_list("piece")), F.lit(b""), lambda a, p: F.concat(a, p["data"]))
    return cut.groupBy("file").agg(whole.alias("data")).select(F.col("file").cast("bigint").alias("file"), "data")


def _first_record(data: bytes) -> int | None:
    """The least offset at which a record with a fitting checksum begins, None if there is none."""
    b = np.frombuffer(data, np.uint8)
    n = len(b) - 36
    if n <= 0:
        return None
    plausible = b[20 : 20 + n] <= 1
    for high in (*range(25, 29), *range(33, 37)):  # upper halves of both lengths
        plausible &= b[high : high + n] == 0
    for at in np.flatnonzero(plausible).tolist():
        try:
            read_log_record(data, at)
            return at
        except (CRCError, EOFError):
            continue
    return None


def _records(data: bytes, at: int, out: list) -> int:
    """Append (key, value, tombstone, ts, error) of the records from ``at`` on; where the data ends inside one, its start."""
    while at < len(data):
        try:
            r, at = read_log_record(data, at)
            out.append((r.key, r.value, r.tombstone, r.ts, None))
        except CRCError:
            at += 37 + int.from_bytes(data[at + 21 : at + 29], "little") + int.from_bytes(data[at + 29 : at + 37], "little")
            out.append((None, None, None, None, "crc"))
        except EOFError:
            break
    return at


_FOUND = ["key", "value", "tombstone", "ts", "error"]
_RECORD = "key binary, value binary, tombstone boolean, ts long, error string"


def read_stream(files: DataFrame) -> DataFrame:
    """``key, value, tombstone, ts, error`` of a log whose records may span files (``file, data``, in order of ``file``).

    Every file is read by itself from the first place where a record's checksum
    fits. What lies before it, and what is left at its end, are joined with the
    neighbours' over files without such a place. A damaged record has an error
    (``crc``), as has what remains of one whose end or start is missing (``torn``).
    """

    def inside(batches):
        for pdf in batches:
            out = []
            for file, data in zip(pdf["file"], pdf["data"]):
                data, found = bytes(data), []
                at = _first_record(data)
                end = len(data) if at is None else _records(data, at, found)
                out += [(file, None, None, None, *r) for r in found]
                out.append((file, at is not None, data[:at] if at is not None else data, data[end:], None, None, None, None, None))
            yield pd.DataFrame(out, columns=["file", "synced", "head", "tail", *_FOUND]).astype({"synced": "boolean", "tombstone": "boolean", "ts": "Int64"})

    read = files.select("file", "data").mapInPandas(inside, f"file long, synced boolean, head binary, tail binary, {_RECORD}")
    read = written(read, workspace(files.sparkSession, "log"))
    whole, ends = read.where("synced is null").select(*_FOUND), read.where("synced is not null").select("file", "synced", "head", "tail")
    # One row a file, without its bytes.
    groups = ends.select("file", "synced", F.sum(F.col("synced").cast("long")).over(W.orderBy("file")).alias("g"))
    placed = ends.join(groups.select("file", "g"), "file")
    heads = placed.select((F.col("g") - F.col("synced").cast("long")).alias("g"), "file", F.lit(0).alias("side"), F.col("head").alias("data"))
    tails = placed.where("synced").select("g", "file", F.lit(1).alias("side"), F.col("tail").alias("data"))
    # What lies between two places that fit is one record, or what is left of it.
    spans = heads.unionByName(tails).where(F.octet_length("data") > 0).groupBy("g").agg(F.aggregate(F.array_sort(F.collect_list(F.struct("file", "side", "data"))), F.lit(b""), lambda a, p: F.concat(a, p["data"])).alias("data"))

    def across(batches):
        for pdf in batches:
            out = []
            for data in pdf["data"]:
                if _records(bytes(data), 0, out) < len(data):
                    out.append((None, None, None, None, "torn"))
            yield pd.DataFrame(out, columns=_FOUND).astype({"tombstone": "boolean", "ts": "Int64"})

    return whole.unionByName(spans.select("data").mapInPandas(across, _RECORD))
