"""Sorted runs: cutting, describing, planning and merging them.

A run is a set of rows sorted by key; its description is ``level, run_id,
min_key, max_key, n_rows``. Planning works on descriptions only. Merging keeps
the newest version of every key and all tombstones, since older runs may
remain elsewhere. Which version is newest follows from (ts, seq), never from
the order of runs.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runefold.operators.resolve import resolve
from runefold.operators.scan import positions
from runefold.shared import hadoop_fs, open_fs, parallelism


def flush_threshold(capacity: int) -> int:
    """An in-memory table is full beyond 80 % of its capacity: rows it takes at most."""
    return int(0.8 * capacity) + 1


def cut_runs(ops: DataFrame, capacity: int = 1000, order: str = "seq") -> DataFrame:
    """Adds ``run_id``: consecutive stretches of ``flush_threshold(capacity)`` operations in log order.

    Places come from a range partition with offsets; no task holds the whole log.
    """
    spread = positions(ops.withColumnRenamed("key", "__key").withColumnRenamed(order, "key"))
    return spread.withColumn("run_id", F.floor(F.col("position") / flush_threshold(capacity)).cast("bigint")).drop("position").withColumnRenamed("key", order).withColumnRenamed("__key", "key")


def describe(rows: DataFrame, by: tuple[str, ...] = ("run_id",)) -> DataFrame:
    """Zone map: ``by, min_key, max_key, n_rows``."""
    return rows.groupBy(*by).agg(F.min("key").alias("min_key"), F.max("key").alias("max_key"), F.count("*").alias("n_rows"))


def overlaps(a_min: Column, a_max: Column, b_min: Column, b_max: Column) -> Column:
    """Closed key ranges that share a key."""
    return (a_max >= b_min) & (b_max >= a_min)


def overlapping_runs(runs: DataFrame, low, high) -> DataFrame:
    """Runs that can hold a key of [low, high]: what a range scan has to open."""
    return runs.where(overlaps(F.col("min_key"), F.col("max_key"), F.lit(low), F.lit(high)))


def overlap_pairs(uppers: DataFrame, lowers: DataFrame, buckets: int = 64) -> DataFrame:
    """``upper_id, lower_id`` of runs with overlapping key ranges.

    Key ranges are cut at bucket borders (quantiles of the lower bounds) and
    joined by bucket, so only runs that share a stretch of the key space meet;
    a pair is reported where the larger of its lower bounds lies, hence once.
    """
    bounds = [r[0] for r in _borders(uppers.select("min_key").unionByName(lowers.select("min_key")), buckets)]

    def place(key: Column) -> Column:
        return F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= key)) if bounds else F.lit(0)

    def spread(runs: DataFrame, side: str) -> DataFrame:
        return runs.select(F.col("run_id").alias(f"{side}_id"), F.col("min_key").alias(f"{side}_min"), F.col("max_key").alias(f"{side}_max"), F.explode(F.sequence(place(F.col("min_key")), place(F.col("max_key")))).alias("__bucket"))

    pairs = spread(uppers, "upper").join(spread(lowers, "lower"), "__bucket")
    pairs = pairs.where(overlaps(F.col("upper_min"), F.col("upper_max"), F.col("lower_min"), F.col("lower_max")))
    return pairs.where(F.col("__bucket") == place(F.greatest("upper_min", "lower_min"))).select("upper_id", "lower_id")


def _borders(keys: DataFrame, buckets: int) -> list:
    """At most ``buckets`` - 1 border keys, bounded by the parameter."""
    ranged = keys.where("min_key is not null").distinct().repartitionByRange(buckets, "min_key")
    return ranged.groupBy(F.spark_partition_id()).agg(F.min("min_key").alias("b")).select("b").orderBy("b").offset(1).collect()


def merge_runs(rows: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """Newest version of every key over all given runs, tombstones kept."""
    return resolve(rows, extra=extra)


def write_run(rows: DataFrame, path: str, partitions: int | None = None) -> None:
    """A sorted run: key-ranged files, sorted, with a Parquet Bloom filter on the key and page checksums."""
    spread = rows.repartitionByRange(partitions, "key") if partitions else rows.repartitionByRange("key")
    (
        spread.sortWithinPartitions("key")
        .write.mode("overwrite")
        .option("parquet.bloom.filter.enabled#key", "true")
        .option("parquet.bloom.filter.expected.ndv#key", "1000000")
        .option("parquet.page.write-checksum.enabled", "true")
        .parquet(path)
    )


#: Bytes of a run's file that one Merkle leaf covers.
LEAF_BYTES = 1 << 20


def run_leaves(spark: SparkSession, path: str, leaf_bytes: int = LEAF_BYTES) -> DataFrame:
    """``file, chunk, hash``: Merkle leaves of a run's files as they are stored.

    Files are read in the executors, a leaf at a time; only their names are listed on the driver.
    """
    fs, at = hadoop_fs(spark, path)
    names = [s.getPath().getName() for s in fs.listStatus(at) if s.getPath().getName().endswith(".parquet")]

    def read(batches):
        for b in batches:
            for name in b.column(0).to_pylist():
                src, root = open_fs(path)
                with src.open_input_stream(f"{root}/{name}") as f:
                    chunk = 0
                    while data := f.read(leaf_bytes):
                        yield pa.RecordBatch.from_pydict({"file": [name], "chunk": pa.array([chunk], pa.int32()), "hash": [hashlib.sha256(data).hexdigest()]})
                        chunk += 1

    files = spark.createDataFrame([(n,) for n in names], "file string")
    return files.repartition(max(1, min(len(names), parallelism(spark))), "file").mapInArrow(read, "file string, chunk int, hash string")


def seal_run(spark: SparkSession, path: str) -> None:
    """Store the run's Merkle leaves beside it."""
    run_leaves(spark, path).write.mode("overwrite").parquet(f"{path}-merkle")


def run_damage(spark: SparkSession, path: str) -> DataFrame:
    """``file, chunk`` of every leaf that is not as it was when the run was sealed, missing and additional ones included."""
    sealed = spark.read.schema("file string, chunk int, hash string").parquet(f"{path}-merkle").withColumnRenamed("hash", "__sealed")
    both = sealed.join(run_leaves(spark, path), ["file", "chunk"], "full")
    return both.where(~F.col("hash").eqNullSafe(F.col("__sealed"))).select("file", "chunk")


def size_tiered_levels(runs: DataFrame, by: str, max_per_level: int = 5, last_level: int = 6) -> DataFrame:
    """``by, level, n_runs`` of the levels that a size-tiered compaction of each store merges.

    ``runs`` has a row ``by, level`` for each run. Starting from level 0, a
    level above ``max_per_level`` becomes one run of the next, which may
    then be too full itself; ``n_runs`` includes that run. The last level is
    never merged, and the first level that fits ends the cascade.
    """
    counts = runs.groupBy(by, "level").agg(F.count("*").alias("n")).groupBy(by).agg(F.map_from_entries(F.collect_list(F.struct(F.col("level").cast("int"), "n"))).alias("__n"))

    def at(level: Column, moved: Column) -> Column:
        return F.coalesce(F.try_element_at(F.col("__n"), level), F.lit(0)) + moved

    # One array of at most ``last_level`` entries per store.
    start = F.struct(F.lit(1).cast("bigint").alias("go"), F.lit(0).cast("bigint").alias("moved"), F.array().cast("array<struct<level:int,n_runs:bigint>>").alias("out"))

    def step(acc: Column, level: Column) -> Column:
        n = at(level, acc["moved"])
        full = (acc["go"] == 1) & (n > max_per_level)
        grown = F.concat(acc["out"], F.array(F.struct(level.alias("level"), n.alias("n_runs"))))
        return F.struct(F.when(full, 1).otherwise(0).cast("bigint").alias("go"), F.when(full, 1).otherwise(0).cast("bigint").alias("moved"), F.when(full, grown).otherwise(acc["out"]).alias("out"))

    merged = counts.select(by, F.aggregate(F.sequence(F.lit(0), F.lit(last_level - 1)), start, step)["out"].alias("__out"))
    return merged.select(by, F.explode("__out").alias("__o")).select(by, "__o.level", "__o.n_runs")


def leveled_inputs(runs: DataFrame, by: str, max_per_level: int = 5, amplification: int = 10) -> DataFrame:
    """``by, level, main_id, input_id``: what leveled compaction of each store merges, as its levels are now.

    ``runs`` has ``by, level, run_id, min_key, max_key``; a smaller ``run_id``
    is older. A level above ``max_per_level * amplification ** level`` gives its
    oldest run (``main_id``), which merges with the runs of the next level whose
    key ranges meet its own; ``input_id`` is each of these and the run itself.
    A store has one such run a level, so no pair of other runs is formed.
    """
    full = runs.groupBy(by, "level").agg(F.count("*").alias("n"), F.min(F.struct("run_id", "min_key", "max_key")).alias("m"))
    full = full.where(F.col("n") > max_per_level * F.pow(F.lit(amplification), F.col("level")))
    main = full.select(F.col(by).alias("__by"), F.col("level").alias("__level"), F.col("m.run_id").alias("main_id"), F.col("m.min_key").alias("__a"), F.col("m.max_key").alias("__b"))
    below = (F.col(by) == F.col("__by")) & (F.col("level") == F.col("__level") + 1) & overlaps(F.col("min_key"), F.col("max_key"), F.col("__a"), F.col("__b"))
    hit = runs.join(main, below).select(by, F.col("__level").alias("level"), "main_id", F.col("run_id").alias("input_id"))
    return main.select(F.col("__by").alias(by), F.col("__level").alias("level"), "main_id", F.col("main_id").alias("input_id")).unionByName(hit)


@dataclass(frozen=True)
class Run:
    """What planning needs of a run. ``id`` grows with age: smaller is older."""

    id: int
    min_key: bytes
    max_key: bytes


@dataclass(frozen=True)
class Merge:
    """Merge ``inputs`` (run ids) into one run of ``level``."""

    inputs: tuple[int, ...]
    level: int
    output: int


@dataclass
class Plan:
    levels: list[list[Run]]
    merges: list[Merge] = field(default_factory=list)


def _merged(runs: list[Run], id_: int) -> Run:
    return Run(id_, min(r.min_key for r in runs), max(r.max_key for r in runs))


def size_tiered(levels: list[list[Run]], max_per_level: int, next_id: int) -> Plan:
    """While a level holds more than ``max_per_level`` runs, all of them become one run of the next; the last level is left alone."""
    plan = Plan([list(x) for x in levels])
    for level in range(len(levels) - 1):
        runs = plan.levels[level]
        if len(runs) <= max_per_level:
            break
        plan.merges.append(Merge(tuple(r.id for r in runs), level + 1, next_id))
        plan.levels[level] = []
        plan.levels[level + 1].append(_merged(runs, next_id))
        next_id += 1
    return plan


def leveled(levels: list[list[Run]], max_per_level: int, amplification: int, next_id: int) -> Plan:
    """A level above ``max_per_level * amplification ** level`` gives its oldest run to the next, merged with the runs it overlaps there."""
    plan = Plan([list(x) for x in levels])
    for level in range(len(levels) - 1):
        if len(plan.levels[level]) <= max_per_level * amplification**level:
            break
        main, *plan.levels[level] = plan.levels[level]
        below = plan.levels[level + 1]
        hit = [r for r in below if r.max_key >= main.min_key and main.max_key >= r.min_key]
        plan.merges.append(Merge((*(r.id for r in hit), main.id), level + 1, next_id))
        plan.levels[level + 1] = [r for r in below if r not in hit] + [_merged([*hit, main], next_id)]
        next_id += 1
    return plan
