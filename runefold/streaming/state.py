"""Streaming ingestion of the log into a table of newest versions, and token buckets with state."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from runefold.operators.ratelimit import step
from runefold.operators.resolve import resolve
from runefold.shared import hadoop_fs, remove


def newest_versions(stream: DataFrame) -> DataFrame:
    """Newest version per key of a stream, in update mode; the aggregation state is the table.

    The maximum is commutative, so late and repeated rows need no watermark.
    """
    newest = F.max(F.struct("ts", "seq", "tombstone", "value")).alias("__v")
    return stream.where("key is not null").groupBy("key").agg(newest).select("key", "__v.*")


def merge_into(target: str, parts: int = 64, keep: int = 2):
    """``foreachBatch`` function that folds each micro-batch into a table of newest versions under ``target``.

    The table is cut into ``parts`` by key hash and a batch rewrites only the
    parts it touches. ``v<batch>.json`` names the folder of every part and is
    written last, so a batch that runs again finds its version complete or
    writes the same rows anew, and readers (``current``) never see half a
    version. Folders that the newest ``keep`` versions do not name are deleted.
    """

    def fold(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = _versions(spark, target)
        if batch_id in before:
            return
        older = [v for v in before if v < batch_id]
        places = _places(spark, target, max(older)) if older else {}
        rows = batch.select("key", "ts", "seq", "tombstone", "value").withColumn("__part", F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int"))
        touched = [r[0] for r in rows.where("key is not null").select("__part").distinct().collect()]  # bounded by the parameter
        held = [f"{target}/{places[str(p)]}" for p in touched if str(p) in places]
        if held:
            old = spark.read.schema("key binary, ts long, seq long, tombstone boolean, value binary").parquet(*held)
            rows = rows.unionByName(old.withColumn("__part", F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int")))
        resolve(rows, by=("__part", "key")).write.mode("overwrite").partitionBy("__part").parquet(f"{target}/data/v{batch_id}")
        places |= {str(p): f"data/v{batch_id}/__part={p}" for p in touched}
        fs, at = hadoop_fs(spark, f"{target}/v{batch_id}.json")
        out = fs.create(at, True)
        out.write(bytearray(json.dumps(places).encode()))
        out.close()
        _expire(spark, target, [v for v in (*before, batch_id) if v <= batch_id], keep)

    return fold


def _expire(spark, target: str, versions: list[int], keep: int) -> None:
    kept = sorted(versions)[-keep:]
    named = {p for v in kept for p in _places(spark, target, v).values()}
    for v in set(versions) - set(kept):
        remove(spark, f"{target}/v{v}.json")
    fs, root = hadoop_fs(spark, f"{target}/data")
    for folder in fs.listStatus(root) if fs.exists(root) else []:
        name = folder.getPath().getName()
        if int(name[1:]) > max(kept):
            continue
        for part in fs.listStatus(folder.getPath()):
            own = part.getPath().getName()
            if own.startswith("__part=") and f"data/{name}/{own}" not in named:
                fs.delete(part.getPath(), True)


def _places(spark, target: str, version: int) -> dict[str, str]:
    fs, at = hadoop_fs(spark, f"{target}/v{version}.json")
    f = fs.open(at)
    try:
        return json.loads(bytes(f.readAllBytes()).decode())
    finally:
        f.close()


def _versions(spark, target: str) -> list[int]:
    fs, path = hadoop_fs(spark, target)
    if not fs.exists(path):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    return [int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json")]


def current(spark, target: str) -> DataFrame:
    found = _versions(spark, target)
    places = [f"{target}/{p}" for p in _places(spark, target, max(found)).values()] if found else []
    form = "key binary, ts long, seq long, tombstone boolean, value binary"
    return spark.read.schema(form).parquet(*places) if places else spark.createDataFrame([], form)


def admit_stream(stream: DataFrame, bucket: str, ts: str, tie: str, capacity: int = 1000, rate: int = 100) -> DataFrame:
    """``bucket, tie, granted`` of a stream of requests; each bucket's tokens and last time are state.

    Rows of a bucket are put in order of time within each micro-batch.
    """
    kinds = {f.name: f.dataType.simpleString() for f in stream.schema}

    def take(key, batches, state: GroupState):
        tokens, last = state.get if state.exists else (capacity, None)
        rows = pd.concat(list(batches)).sort_values([ts, tie])
        granted = []
        for t in rows[ts].tolist():
            tokens, ok = step(tokens, last, t, 1, capacity, rate)
            last = t
            granted.append(ok)
        state.update((tokens, last))
        yield pd.DataFrame({bucket: rows[bucket].to_numpy(), tie: rows[tie].to_numpy(), "granted": granted})

    known = stream.where(F.col(bucket).isNotNull() & F.col(ts).isNotNull()).select(bucket, ts, tie)
    return known.groupBy(bucket).applyInPandasWithState(take, f"`{bucket}` {kinds[bucket]}, `{tie}` {kinds[tie]}, granted boolean", "tokens long, last long", "append", GroupStateTimeout.NoTimeout)
