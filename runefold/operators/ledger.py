"""Processing only new or changed records: a ledger of work items.

A run covers the log between two positions of every store: the committed
position of its last successful run and the end of the log when the run was
planned. Both are frozen in the plan, so attempts that resume a run cover the
same records however far the log has grown, and the ends become the next run's
starts (``successor``).

The records are split into work items (hash slices, so no store makes an item
large) and written once, a folder per item. An item is *pending*, *leased* (to
one worker, until a time) or *done*. The ledger is a folder of small immutable
files in the shared folder:

    plan.json            number of items, where bounds and work lie; written once
    i<item>-t<token>     a lease: created exclusively, holds worker and expiry
    i<item>-t<token>-r<n>  a renewal of that lease
    i<item>.done         the commit: created exclusively, holds token, rows and path

``token`` is the fencing token: every lease of an item has the next number. An
item whose newest lease expired is pending again; committing needs the newest
token, so a worker that slept through its lease is refused (``StaleLease``).
Output of an attempt goes to a path given by item and token; the commit names
it and readers take only named paths, so whatever a stale worker still writes
stays unseen, and a retried task replaces its own files.

"Created exclusively" needs a file system that refuses to create a file twice:
HDFS, ABFS, GCS and local disks do; for S3 the creation asks for a conditional
write, which Hadoop 3.4.2 and later honour.
"""

from __future__ import annotations

import json
import threading
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runefold.shared import hadoop_fs, written

ITEM = "__item"


class StaleLease(RuntimeError):
    """The lease is not the newest of its item, or the item is done already."""


class Ledger:
    def __init__(self, spark: SparkSession, folder: str, clock: Callable[[], float] = time.time):
        self.spark, self.folder, self.clock = spark, folder.rstrip("/"), clock
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs, at = hadoop_fs(spark, self.folder)
        self._fs.mkdirs(at)

    def _create(self, name: str, content: dict) -> bool:
        """Create a file unless it exists; whether this call made it."""
        at = self._path(f"{self.folder}/{name}")
        if self._fs.exists(at):
            return False
        try:
            out = self._fs.createFile(at).overwrite(False).opt("fs.option.create.conditional.overwrite", True).build()
            out.write(bytearray(json.dumps(content).encode()))
            out.close()
        except Exception as e:
            if self._fs.exists(at):
                return False
            raise e
        return True

    def _read(self, name: str) -> dict | None:
        at = self._path(f"{self.folder}/{name}")
        if not self._fs.exists(at):
            return None
        f = self._fs.open(at)
        try:
            data = bytes(f.readAllBytes()).decode()
        finally:
            f.close()
        return json.loads(data) if data else None  # empty: its writer died between creating and writing

    def plan(self, items: int, covers: dict) -> dict:
        """Make the plan, or return the one that an earlier attempt made."""
        self._create("plan.json", {"items": items, "covers": covers})
        return self._read("plan.json")

    def planned(self) -> dict | None:
        return self._read("plan.json")

    def _names(self) -> list[str]:
        return [s.getPath().getName() for s in self._fs.listStatus(self._path(self.folder))]

    def states(self) -> dict[int, tuple[str, int]]:
        """Of each item its state and newest token (0: never leased)."""
        names = self._names()
        done = {int(n[1:].split(".")[0]) for n in names if n.endswith(".done")}
        leases: dict[int, dict[int, int]] = {}
        for n in names:
            if n.startswith("i") and "-t" in n:
                item, token, *renewal = (int(x[1:]) for x in n.split("-"))
                mine = leases.setdefault(item, {})
                mine[token] = max(mine.get(token, 0), renewal[0] if renewal else 0)
        out = {}
        for item in range(self._read("plan.json")["items"]):
            token = max(leases.get(item, {0: 0}))
            if item in done:
                out[item] = ("done", token)
                continue
            until = 0.0
            if token:
                renewal = leases[item][token]
                lease = self._read(f"i{item}-t{token}-r{renewal}" if renewal else f"i{item}-t{token}")
                until = lease["until"] if lease else 0.0
            out[item] = ("leased" if until > self.clock() else "pending", token)
        return out

    def lease(self, worker: str, seconds: float, most: int) -> dict[int, int]:
        """Up to ``most`` pending items, each with its fencing token."""
        got = {}
        for item, (state, token) in self.states().items():
            if len(got) == most:
                break
            if state == "pending" and self._create(f"i{item}-t{token + 1}", {"worker": worker, "until": self.clock() + seconds}):
                got[item] = token + 1
        return got

    def _newest(self, item: int, token: int) -> bool:
        return self._fs.exists(self._path(f"{self.folder}/i{item}-t{token}")) and not self._fs.exists(self._path(f"{self.folder}/i{item}-t{token + 1}"))

    def renew(self, item: int, token: int, seconds: float, n: int) -> bool:
        """Extend a lease for the ``n``-th time (from 1), if it is still the newest."""
        return self._newest(item, token) and self._create(f"i{item}-t{token}-r{n}", {"until": self.clock() + seconds})

    def commit(self, item: int, token: int, rows: int | None = None, path: str | None = None) -> None:
        if not self._newest(item, token):
            raise StaleLease(f"item {item}: token {token} is not the newest")
        if not self._create(f"i{item}.done", {"token": token, "rows": rows, "path": path}):
            raise StaleLease(f"item {item} was committed by another worker")

    def done(self) -> list[int]:
        return sorted(i for i, (s, _) in self.states().items() if s == "done")

    def outputs(self) -> dict[int, str | None]:
        """The path that the commit of each done item names."""
        return {int(n[1:].split(".")[0]): (self._read(n) or {}).get("path") for n in self._names() if n.endswith(".done")}


class _Renewing:
    """Keeps a group's leases alive while its job runs."""

    def __init__(self, ledger: Ledger, leases: dict[int, int], seconds: float):
        self.ledger, self.leases, self.seconds, self.stop = ledger, leases, seconds, threading.Event()
        self.thread = threading.Thread(target=self._run, daemon=True)

    def _run(self) -> None:
        n = 0
        while not self.stop.wait(self.seconds / 3):
            n += 1
            for item, token in self.leases.items():
                self.ledger.renew(item, token, self.seconds, n)

    def __enter__(self):
        self.thread.start()

    def __exit__(self, *_):
        self.stop.set()
        self.thread.join()


def plan_run(ledger: Ledger, log: DataFrame, runs: DataFrame, items: int) -> dict:
    """The run's plan: as an earlier attempt made it, else bounds and work items are frozen now.

    An attempt that dies while planning leaves nothing that counts; of several
    planners, those that come late use the first one's plan.
    """
    if (plan := ledger.planned()) is None:
        at = f"{ledger.folder}-plan-{uuid.uuid4().hex}"
        bounds = written(run_bounds(log, runs), f"{at}/bounds")
        # An item's rows meet in one task, so it gets one file instead of one from every task.
        work = changed_between(log, bounds, items).repartition(items, ITEM)
        work.write.mode("overwrite").partitionBy(ITEM).parquet(f"{at}/work")
        plan = ledger.plan(items, {"bounds": f"{at}/bounds", "work": f"{at}/work"})
    return plan


def process(ledger: Ledger, log: DataFrame, runs: DataFrame, out: str, items: int, worker: str = "worker", lease_s: float = 3600, most: int | None = None, transform: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Run every work item of the planned run to the end and read the result.

    Calling it again after a failure resumes: done items are not processed
    again, leased ones once their lease has expired. Items are leased in groups
    of ``most`` (four for every core), each group is one job and committed
    before the next, so a failure repeats one group at most. ``transform`` maps
    the item's records (``store_id, seq``) row by row to what is written; it
    must be a function of its input. An item that another worker took over is
    left to that worker.
    """
    spark = log.sparkSession
    plan = plan_run(ledger, log, runs, items)
    most = most or 4 * spark.sparkContext.defaultParallelism
    shape = log.select("store_id", "seq").schema
    planned = spark.read.schema(f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in shape)}, {ITEM} int").parquet(plan["covers"]["work"])
    transform = transform or (lambda records: records)
    while got := ledger.lease(worker, lease_s, most):
        token = F.create_map(*[F.lit(x) for pair in got.items() for x in pair])[F.col(ITEM)]
        mine = transform(planned.where(F.col(ITEM).isin(*got))).withColumn("__token", token)
        with _Renewing(ledger, got, lease_s):
            mine.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(ITEM, "__token").parquet(out)
        for item, t in got.items():
            try:
                ledger.commit(item, t, path=f"{out}/{ITEM}={item}/__token={t}")
            except StaleLease:
                pass  # another worker's output counts for this item
    left = [i for i, (s, _) in ledger.states().items() if s != "done"]
    if left:
        raise RuntimeError(f"items {left} are leased to other workers; call again when they are done")
    return results(ledger, transform(planned).drop(ITEM))


def results(ledger: Ledger, like: DataFrame) -> DataFrame:
    """What the committed paths hold, with the columns of ``like``; items without rows have no folder."""
    spark = like.sparkSession
    there = [p for p in ledger.outputs().values() if p and ledger._fs.exists(ledger._path(p))]
    return spark.read.schema(like.schema).parquet(*there) if there else spark.createDataFrame([], like.schema)


def committed_positions(runs: DataFrame) -> DataFrame:
    """``store_id, committed``: position of the last successful run of each store.

    Success is the status ``ok``, whatever its case and outer blanks; the last
    is that of the highest ``run_no`` (end times may mislead). Repeated rows of
    a run agree; should they not, the largest position counts. A null position
    counts as 0.
    """
    ok = runs.where("lower(trim(status)) = 'ok' and store_id is not null and run_no is not null")
    last = ok.groupBy("store_id").agg(F.max(F.struct("run_no", F.coalesce("current_value", F.lit(0)).alias("v"))).alias("m"))
    return last.select("store_id", F.col("m.v").alias("committed"))


def run_bounds(log: DataFrame, runs: DataFrame) -> DataFrame:
    """``store_id, low, high`` of each store in the log: a run covers positions from ``low`` on and below ``high``, the end of the log now."""
    ends = log.groupBy("store_id").agg((F.coalesce(F.max("wal_pos"), F.lit(-1)) + 1).alias("high"))
    return ends.join(committed_positions(runs), "store_id", "left").select("store_id", F.coalesce("committed", F.lit(0)).alias("low"), "high")


def changed_between(log: DataFrame, bounds: DataFrame, items: int) -> DataFrame:
    """``store_id, seq, __item``: records first delivered within their store's bounds.

    Rows with a null key are torn writes and no deliveries. The first position
    of each record is a minimum, so repeats shrink before the shuffle; slices
    follow the record, not the store, so a store with a third of the log is
    spread over all items. A null ``wal_pos`` is a delivery at no known
    position and never proves that a record was processed.
    """
    first = log.where("key is not null").groupBy("store_id", "seq").agg(F.min("wal_pos").alias("__first"))
    # One row per store; Spark broadcasts it only below autoBroadcastJoinThreshold.
    named = bounds.select(F.col("store_id").alias("__store"), "low", "high")
    new = first.join(named, F.col("store_id").eqNullSafe(F.col("__store"))).where("__first is null or (__first >= low and __first < high)")
    return new.select("store_id", "seq", F.pmod(F.xxhash64("store_id", "seq"), F.lit(items)).cast("int").alias(ITEM))


def changed_since(log: DataFrame, runs: DataFrame, items: int) -> DataFrame:
    """``changed_between`` from the committed positions to the end of the log as it is."""
    return changed_between(log, run_bounds(log, runs), items)


def successor(ledger: Ledger) -> DataFrame:
    """``store_id, current_value`` that a finished run leaves as the committed position of each store: where the next run begins."""
    if any(s != "done" for s, _ in ledger.states().values()):
        raise RuntimeError("the run is not finished")
    bounds = ledger.spark.read.parquet(ledger.planned()["covers"]["bounds"])
    return bounds.select("store_id", F.greatest("low", "high").alias("current_value"))
