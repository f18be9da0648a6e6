"""Far too many small files: consolidation by copying encoded blocks.

``consolidate`` takes a table of file paths, cuts it in order of path into bins
and lets one task per bin copy the files' encoded column blocks into one larger
file with a rewritten footer (``sources.blocks``). Only paths and sizes are
shuffled; no value is decoded or re-encoded.

A file weighs its share of ``target_bytes``, but at least 1 / ``FAN_IN``; a bin
takes weight 1. Where files are so small that bins end far below
``target_bytes``, the bins' files are binned again, until they are well sized
(a level is 256 times fewer files, so two levels take 65,536 files a result);
intermediate files are deleted. Row groups without dictionaries fuse at every
level; those with dictionaries stay as they are, so such results have few files
but the row groups of the inputs.

Defined results
* A file whose schema differs from the first of its bin goes to another output
  of the same bin, one per schema; different codecs are never fused.
* Empty files (no rows) add nothing but are counted. A path listed twice is
  read once. A null path is no file.
* Output names follow from bin and schema alone and files are moved into place
  when complete, so a task that runs again replaces its own output.
* Validation: every output's schema fingerprint, block count and row total are
  read back from its footer; the totals must equal those of the inputs' footers
  and each listed path must be reported exactly once, else ``BlockError``.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from runefold.shared import free_name, open_fs, parallelism, remove, workspace, written
from runefold.sources.blocks import BlockError, BlockWriter, Ranged, read_footer

#: Files that one task copies, about.
FAN_IN = 256
#: Files read ahead of the copying where they lie on another machine.
AHEAD = 16
REPORT = "bin long, path string, schema string, files long, blocks_in long, rows_in long, blocks long, rows long, bytes long, inputs array<string>"


def last_component(path) -> F.Column:
    """Directory name at the end of a path, whatever way the rest is spelled.

    Blanks around it, trailing slashes and trailing ``/.`` do not count; null
    and paths without a name give null.
    """
    return F.nullif(F.regexp_extract(F.trim(path), r"([^/]+?)(?:/+\.?)*$", 1), F.lit(""))


def listed_tables(sstables: DataFrame, levels: DataFrame) -> DataFrame:
    """``store_id, sst_id`` of the sorted tables that a level of their store lists, each once."""
    names = levels.select("store_id", last_component("directory_name").alias("name")).where("name is not null").distinct()
    return sstables.select("store_id", "sst_id", last_component("base_path").alias("name")).join(names, ["store_id", "name"], "left_semi").select("store_id", "sst_id").distinct()


def export_tables(records: DataFrame, tables: DataFrame, out: str, part_rows: int = 1 << 16) -> DataFrame:
    """One small file per sorted table under ``out``; gives ``path, size, rows``.

    This lays the records out as the store's own directories hold them: a file
    per table, without dictionaries. A table above ``part_rows`` gets several
    files, so that one huge table does not end in one task.
    """
    cols = [c for c in records.columns if c not in ("store_id", "sst_id")]
    part, n_parts = free_name(records, "__part"), free_name(records, "__n_parts")
    parts = records.groupBy("store_id", "sst_id").agg(F.count("*").alias("n")).join(tables, ["store_id", "sst_id"], "left_semi").select("store_id", "sst_id", F.ceil(F.col("n") / part_rows).cast("int").alias(n_parts))
    rows = (
        records.join(parts, ["store_id", "sst_id"])
        .withColumn(part, F.when(F.col(n_parts) > 1, F.pmod(F.xxhash64(*cols), F.col(n_parts))).otherwise(F.lit(0)).cast("int"))
        .drop(n_parts)
    )
    n = parallelism(records.sparkSession)
    rows = rows.repartition(n, "store_id", "sst_id", part).sortWithinPartitions("sst_id", "store_id", part)

    def write(batches):
        import pyarrow.compute as pc
        import pyarrow.parquet as pq

        fs, root = open_fs(out)
        made, held, key = set(), [], None

        def flush():
            table = pa.Table.from_batches(held).drop_columns([part])
            store, sst, number = key
            folder = f"{root}/{sst % 1024}"
            if folder not in made:
                fs.create_dir(folder, recursive=True)
                made.add(folder)
            sink = pa.BufferOutputStream()
            with pq.ParquetWriter(sink, table.schema, use_dictionary=False, compression="snappy", store_schema=False) as w:
                w.write_table(table)
            data = sink.getvalue()
            name = f"{folder}/{store}-{sst}-{number}.parquet"
            tmp = f"{folder}/.{uuid.uuid4().hex}.tmp"
            with fs.open_output_stream(tmp) as f:
                f.write(data)
            fs.move(tmp, name)  # attempts that run at once, or end early, leave whole files only
            return f"{out}{name[len(root):]}", data.size, table.num_rows

        done = []
        for b in batches:
            if not b.num_rows:
                continue
            cols_ = [b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("store_id", "sst_id", part)]
            change = [0, *((sum((c[1:] != c[:-1]).astype("i1") for c in cols_)).nonzero()[0] + 1).tolist(), b.num_rows]
            for i, j in zip(change, change[1:]):
                k = tuple(int(c[i]) for c in cols_)
                if key is not None and k != key:
                    done.append(flush())
                    held = []
                key = k
                held.append(b.slice(i, j - i))
            if len(done) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done)], ["path", "size", "rows"])
                done = []
        if held:
            done.append(flush())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done)], ["path", "size", "rows"])

    return rows.mapInArrow(write, "path string, size long, rows long")


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """``path, size`` of all files below a folder; the listing runs on the cluster."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(folder).select("path", F.col("length").alias("size"))


def consolidate(files: DataFrame, out: str, target_bytes: int = 128 << 20, group_bytes: int = 64 << 20, trail: str | None = None) -> DataFrame:
    """Copy ``files`` (``path, size``) into few files below ``out``; gives the report, one row per output.

    ``files`` in the report counts input files, ``blocks_in`` and ``inputs``
    what the last level copied. With ``trail``, a table ``path, output`` of
    every input file and the output that holds it is written there.
    """
    spark = files.sparkSession
    listed = files.where("path is not null").groupBy("path").agg(F.max("size").alias("size")).select("path", "size", F.lit(1).cast("long").alias("files"), F.lit("").alias("schema"))
    places, level, before = None, 0, None
    base = workspace(spark, "consolidate")
    while True:
        ordered, n, n_files, n_bytes, bins = _binned(listed, target_bytes, f"{base}/listing-{level}")
        # Well sized, or no longer fewer: files of many schemas can't share an output.
        last = bins <= 1.5 * math.ceil(n_bytes / target_bytes) or bins == 1 or (before is not None and 2 * n > before)
        before = n
        folder = out.rstrip("/") if last else f"{base}/level-{level}"
        report = _validated(_merge(ordered, bins, folder, group_bytes), n_files, f"{base}/report-{level}")
        if trail:
            step = report.select(F.explode("inputs").alias("path"), F.col("path").alias("output"))
            places = step if places is None else places.withColumnRenamed("output", "__at").join(step.withColumnRenamed("path", "__at"), "__at").select("path", "output")
        if level:
            remove(spark, f"{base}/level-{level - 1}")
        if last:
            break
        listed = report.select("path", F.col("bytes").alias("size"), "files", "schema")
        level += 1
    if trail:
        places.write.mode("overwrite").parquet(trail)
    return report


def _binned(files: DataFrame, target_bytes: int, at: str) -> tuple[DataFrame, int, int, int, int]:
    """``(files with their bin, files, input files they stand for, bytes, bins)``: running weight in order of schema and path, over ranges with offsets, so no task sees all paths."""
    spark = files.sparkSession
    ranged = files.repartitionByRange(parallelism(spark), "schema", "path").withColumn("__p", F.spark_partition_id())
    ranged = written(ranged.withColumn("__w", F.greatest(F.coalesce("size", F.lit(0)) / F.lit(float(target_bytes)), F.lit(1.0 / FAN_IN))), at)
    sums = ranged.groupBy("__p").agg(F.count("*").alias("n"), F.sum("__w").alias("w"), F.sum("files").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("size"))
    total = sums.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "w", "files", "size"))).first()
    # One row per range: bounded by the number of partitions.
    before = sums.select("__p", F.coalesce(F.sum("w").over(W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)).alias("__before"))
    running = F.coalesce(F.sum("__w").over(W.partitionBy("__p").orderBy("schema", "path").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    binned = ranged.withColumn("__run", running).join(F.broadcast(before), "__p").withColumn("bin", F.floor(F.col("__run") + F.col("__before")).cast("int"))
    return binned.select("path", "files", "bin"), total["n"], total["files"], total["size"], int(total["w"]) + 1


def _validated(report: DataFrame, listed: int, at: str) -> DataFrame:
    report = written(report, at)
    seen = report.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("files", "rows_in", "rows"))).first()
    if seen["files"] != listed or seen["rows_in"] != seen["rows"]:
        raise BlockError(f"{listed} files were listed, {seen['files']} copied; rows {seen['rows_in']} in, {seen['rows']} out")
    return report


def _contents(paths: list[str], group_bytes: int) -> Iterator:
    """The bytes of each file in turn; files above ``group_bytes`` are read in ranges, others ahead where reading waits for a network."""
    from pyarrow import fs

    def fetch(path: str):
        src, at = open_fs(path)
        f = src.open_input_file(at)
        size = f.size()
        if size > group_bytes:
            return Ranged(f, size)
        with f:
            return f.read()

    if not paths or isinstance(open_fs(paths[0])[0], fs.LocalFileSystem):
        yield from map(fetch, paths)
        return
    with ThreadPoolExecutor(AHEAD) as pool:
        waiting = [pool.submit(fetch, p) for p in paths[:AHEAD]]
        for i in range(len(paths)):
            yield waiting.pop(0).result()
            if i + AHEAD < len(paths):
                waiting.append(pool.submit(fetch, paths[i + AHEAD]))


def _merge(files: DataFrame, bins: int, out: str, group_bytes: int) -> DataFrame:
    """One output per bin and schema; ``files`` has ``path, files, bin``."""
    spread = files.repartitionById(bins, F.col("bin")).sortWithinPartitions("bin", "path")

    def merge(batches):
        def pour(bin_, members):
            fs, root = open_fs(out)
            fs.create_dir(root, recursive=True)
            writers = {}
            for (p, n), data in zip(members, _contents([p for p, _ in members], group_bytes)):
                footer = read_footer(data)
                kind = footer.fingerprint
                if kind not in writers:
                    tmp = f"{root}/.{bin_:06d}-{kind}.{uuid.uuid4().hex}.tmp"
                    sink = fs.open_output_stream(tmp)
                    writers[kind] = (BlockWriter(sink, group_bytes), sink, tmp, [])
                writers[kind][0].add(data, footer, n)
                writers[kind][3].append(p)
                if isinstance(data, Ranged):
                    data.file.close()
            for kind, (w, sink, tmp, inputs) in writers.items():
                size = w.close()
                sink.close()
                final = f"{root}/bin-{bin_:06d}-{kind}.parquet"
                with fs.open_input_file(tmp) as f:
                    back = read_footer(Ranged(f, size))
                if back.rows != w.rows or back.fingerprint != kind or len(back.groups) != len(w.out):
                    raise BlockError(f"{final}: footer does not match what was copied")
                fs.move(tmp, final)
                yield bin_, f"{out.rstrip('/')}/{final.rsplit('/', 1)[1]}", kind, w.files, w.blocks_in, w.rows, len(back.groups), back.rows, size, inputs

        names = ["bin", "path", "schema", "files", "blocks_in", "rows_in", "blocks", "rows", "bytes", "inputs"]
        now, members = None, []
        for b in batches:
            for bin_, path, n in zip(*(b.column(c).to_pylist() for c in ("bin", "path", "files"))):
                if now is not None and bin_ != now:
                    for r in pour(now, members):
                        yield pa.RecordBatch.from_pylist([dict(zip(names, r))])
                    members = []
                now = bin_
                members.append((path, n))
        if members:
            for r in pour(now, members):
                yield pa.RecordBatch.from_pylist([dict(zip(names, r))])

    return spread.mapInArrow(merge, REPORT)


def consolidated_runs(spark: SparkSession, records: DataFrame, sstables: DataFrame, levels: DataFrame, target_bytes: int = 128 << 20) -> tuple[DataFrame, DataFrame]:
    """``(records, report)``: all records of listed tables from few large files, and how they got there.

    The records are those of the files, a record as often as its tables hold
    it; callers that want each record once take ``dropDuplicates``.
    """
    base = workspace(spark, "runs")
    files = written(export_tables(records, listed_tables(sstables, levels), f"{base}/tables"), f"{base}/files")
    report = consolidate(files, f"{base}/large", target_bytes)
    expected = files.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("r")).first()["r"]
    copied = report.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("r")).first()["r"]
    if expected != copied:
        raise BlockError(f"{expected} rows were exported, {copied} copied")
    remove(spark, f"{base}/tables")  # laid out here, and copied whole
    if not expected:
        return spark.createDataFrame([], records.schema), report
    return spark.read.schema(records.schema).parquet(f"{base}/large"), report
