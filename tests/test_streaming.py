"""Structured Streaming forms against their batch twins."""

from pyspark.sql import functions as F

from runefold.operators import ratelimit, resolve
from runefold.streaming import state

OPS = "key binary, value binary, tombstone boolean, ts long, seq long"


def test_streamed_versions_match_batch(spark, tmp_path):
    rows = [(b"k%d" % (i % 5), b"v%d" % i, i % 7 == 0, (i * 37) % 50, i) for i in range(60)]
    ops = spark.createDataFrame(rows, OPS)
    ops.repartition(3).write.parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(OPS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
    target = f"file://{tmp_path}/target"
    q = stream.writeStream.foreachBatch(state.merge_into(target)).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    want = resolve.resolve(ops)
    got = state.current(spark, target).select(*want.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    fold = state.merge_into(target)
    fold(ops, max(state._versions(spark, target)))  # a batch that was written already
    assert state.current(spark, target).count() == want.count()
    q = state.newest_versions(stream).writeStream.outputMode("complete").format("memory").queryName("newest").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(str, spark.table("newest").select(*want.columns).collect())) == sorted(map(str, want.collect()))


def test_a_batch_rewrites_the_parts_it_touches(spark, tmp_path):
    target, fold = f"file://{tmp_path}/t", state.merge_into(f"file://{tmp_path}/t", parts=8)
    rows = [(b"k%d" % i, b"v", False, 1, i) for i in range(200)]
    fold(spark.createDataFrame(rows, OPS), 0)
    fold(spark.createDataFrame([(b"k3", b"new", False, 2, 500), (None, b"", False, 3, 501)], OPS), 1)
    fold(spark.createDataFrame([(b"k4", b"late", False, 0, 502)], OPS), 2)
    fold(spark.createDataFrame([], OPS), 3)
    got = {bytes(r["key"]): bytes(r["value"]) for r in state.current(spark, target).collect()}
    assert got == {k: v for k, v, *_ in rows} | {b"k3": b"new"}
    kept = sorted(str(p.relative_to(tmp_path / "t")) for p in (tmp_path / "t" / "data").glob("v*/__part=*"))
    assert len([p for p in kept if "/v1/" in f"/{p}"]) == len([p for p in kept if "/v2/" in f"/{p}"]) == 1 and len(kept) == 8
    assert sorted(state._versions(spark, target)) == [2, 3]


def test_streamed_rate_limit_matches_batch(spark, tmp_path):
    rows = spark.range(200).select((F.col("id") % 3).alias("b"), (F.col("id") * 90_000).alias("us"), "id")
    rows.coalesce(1).sortWithinPartitions("us").write.option("maxRecordsPerFile", 80).parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "log"))
    q = state.admit_stream(stream, "b", "us", "id", capacity=3, rate=2).writeStream.format("memory").queryName("granted").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r["id"]: r["granted"] for r in spark.table("granted").collect()}
    want = {r["id"]: r["granted"] for r in ratelimit.admit(rows, "b", "us", "id", capacity=3, rate=2).collect()}
    assert got == want and len(got) == 200
