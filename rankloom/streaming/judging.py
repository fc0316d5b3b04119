"""Judging as a stream: append-only results, resumption by what is done, gates, and windowed counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rankloom.operators.setops import latest

PAIR = ["query_id", "comment_id"]


def pending(requests: DataFrame, done: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Distinct requests without a result."""
    keys = keys or PAIR
    return requests.dropDuplicates(keys).join(done.select(*keys), keys, "left_anti")


def hashed(payload: DataFrame, fields: list[str]) -> DataFrame:
    """With the digest of the fields a judge sees, by which a resumed run knows that nothing changed."""
    return payload.withColumn("payload_sha256", F.sha2(F.to_json(F.struct(*[F.col(f) for f in sorted(fields)])), 256))


def changed(payload: DataFrame, done: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Done requests whose payload has another digest now."""
    keys = keys or PAIR
    return payload.select(*keys, "payload_sha256").join(done.select(*keys, F.col("payload_sha256").alias("was")), keys).filter("payload_sha256 <> was")


def append_new(stream: DataFrame, path: str, checkpoint: str, keys: list[str], judge: Callable[[DataFrame], DataFrame], trigger: dict | None = None) -> StreamingQuery:
    """Judges what arrives and is not done yet and appends it to a parquet folder. A batch that is run again after a loss
    finds its keys done and adds nothing, so results are written once."""

    def batch(df: DataFrame, _: int) -> None:
        spark = df.sparkSession
        try:
            done = spark.read.parquet(path).select(*keys)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            done = df.select(*keys).limit(0)
        judge(pending(df, done, keys)).write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def gated(anchors: DataFrame, verdict: Callable[[DataFrame], bool], rest: Callable[[], DataFrame]) -> DataFrame | None:
    """The rest of a run, only if the anchors pass."""
    return rest() if verdict(anchors) else None


def windowed_counts(events: DataFrame, time: str, by: list[str], window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """(start, by, n): counts per tumbling window; rows later than `late` are dropped in a stream, none in a batch."""
    return events.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), *by, "n")


def first_deliveries(events: DataFrame, key: str, time: str, late: str = "1 day") -> DataFrame:
    """Each key once within the watermark."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark([key]) if events.isStreaming else events.dropDuplicates([key])


def latest_deliveries(events: DataFrame, keys: list[str], time: str) -> DataFrame:
    """The last delivery of each key; of equal times the one with the largest row digest."""
    return latest(events, keys, [F.desc_nulls_last(time), F.desc(F.xxhash64(*events.columns))])


def replay(spark: SparkSession, path: str, per_trigger: int = 1) -> DataFrame:
    """A stored folder of parquet files as a stream."""
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", per_trigger).parquet(path)
