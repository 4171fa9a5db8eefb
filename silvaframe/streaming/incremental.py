"""Streaming forms (STR-1 .. STR-3): counts that follow a growing folder.

Every stream runs with a checkpoint in the shared folder and counts each input file once.
``resumed_counts`` keeps its state under a path of the caller's and goes on from there;
``available_now`` runs what is there and gives the aggregate of this one run.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import runtime as R


def file_stream(spark: SparkSession, path: str, glob: str | None = None, per_trigger: int | None = None) -> DataFrame:
    """A folder of Parquet files as a stream; the schema is that of the files there are.

    ``glob``: one table of the folder, which is a file or a folder of its own.
    """
    r = spark.readStream.schema(spark.read.parquet(f"{path}/{glob}" if glob else path).schema)
    if glob and R.children(spark, f"{path}/{glob}") not in ([], [glob]):
        path = f"{path}/{glob}"
    elif glob:
        r = r.option("pathGlobFilter", glob)
    if per_trigger:
        r = r.option("maxFilesPerTrigger", per_trigger)
    return r.parquet(path)


def pair_counts(stream: DataFrame) -> DataFrame:
    """STR-2: number of (species_id, a, b) observations, each image's once as the source gives it."""
    return stream.groupBy("species_id", "a", "b").agg(F.count(F.lit(1)).alias("n"))


def resumed_counts(stream: DataFrame, keys: list[str], path: str, buckets: int = 16) -> DataFrame:
    """STR-2: counts per key of all rows that ever came, from a state in ``path`` that outlives the run.

    Each micro-batch is counted by itself and merged into the hash buckets it touches, in folders of its own; a
    manifest then names the live folders.  A batch that is repeated after a failure finds its number in
    the manifest and does nothing.  A later run with the same path goes on behind the last file; one without
    new files gives the counts as they are.
    """
    spark = stream.sparkSession
    schema = stream.select(*keys, F.lit(0).cast("long").alias("n")).schema

    def state() -> dict:
        found = [n for n in R.children(spark, path) if n.startswith("manifest-")]
        return json.loads(R.read_text(spark, f"{path}/{found[-1]}")) if found else {"batch": -1, "live": {}}

    def counts(live: dict, only: set[str] | None = None) -> DataFrame:
        paths = [p for b, p in live.items() if only is None or b in only]
        return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)

    def merge(batch: DataFrame, number: int) -> None:
        now = state()
        if number <= now["batch"]:
            return
        delta = batch.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
        bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
        new = f"{path}/batch-{number:09d}"
        delta.withColumn("bucket", bucket).write.mode("overwrite").partitionBy("bucket").parquet(f"{new}/delta")
        touched = {n.split("=")[1] for n in R.children(spark, f"{new}/delta") if n.startswith("bucket=")}
        if touched:
            both = counts(now["live"], touched).unionByName(spark.read.schema(schema).parquet(f"{new}/delta").drop("bucket"))
            both = both.groupBy(*keys).agg(F.sum("n").alias("n")).withColumn("bucket", bucket)
            both.write.mode("overwrite").partitionBy("bucket").parquet(f"{new}/state")
        live = now["live"] | {b: f"{new}/state/bucket={b}" for b in touched}
        R.write_text(spark, f"{path}/manifest-{number:09d}", json.dumps({"batch": number, "live": live}))

    q = stream.writeStream.foreachBatch(merge).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return counts(state()["live"])


def windowed_counts(stream: DataFrame, time: str, key: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and means per event-time window and key; rows later than ``late`` behind the newest may be dropped."""
    t = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return t.groupBy(F.window(time, width).alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))


def running_means(stream: DataFrame, key: str, values: list[str]) -> DataFrame:
    """STR-3: means per key of an append-only log."""
    return stream.groupBy(key).agg(*[F.avg(v).alias(v) for v in values], F.count(F.lit(1)).alias("n"))


def available_now(result: DataFrame, what: str) -> DataFrame:
    """Run a streaming aggregate over all there is and give its last state as a table.

    Each micro-batch replaces the state's table in a new folder; the last one counts.
    """
    spark = result.sparkSession
    path = R.scratch(spark, what)
    last: list[str] = []

    def keep(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/state-{n}")
        last.append(f"{path}/state-{n}")

    q = result.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    if not last:
        return spark.createDataFrame([], result.schema)
    return spark.read.parquet(last[-1])
