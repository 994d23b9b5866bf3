"""The append-only event log as a stream: what was counted before is not read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.plans.cut import own_path


def append_events(events: DataFrame, log: str) -> None:
    """Adds events to the log folder; files of others are left alone."""
    events.write.mode("append").json(log)


def counts_from_stream(spark: SparkSession, source: str, schema, group: list[str], state: str | None = None, fmt: str = "parquet") -> DataFrame:
    """Counts per group over all files of a folder or file pattern, read as a stream to its present end.

    With a `state` folder that is kept, a later call reads only files that came since. Each batch
    adds its partial counts to a table in the state folder under its own number, so a batch that is
    repeated after a failure replaces itself and nothing counts twice.
    """
    state = state or own_path(spark, "stream")

    def add(batch: DataFrame, number: int) -> None:
        batch.groupBy(*group).agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{state}/counts/batch={number}")

    stream = spark.readStream.schema(schema).format(fmt).load(source)
    q = stream.select(*group).writeStream.foreachBatch(add).option("checkpointLocation", f"{state}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{state}/counts").groupBy(*group).agg(F.sum("n").alias("n"))


def latest_per_key(events: DataFrame, keys: list[str], order: list[str], value: list[str]) -> DataFrame:
    """The values of the last event of each key, without sorting a key's events."""
    return events.groupBy(*keys).agg(F.max_by(F.struct(*value), F.struct(*order)).alias("_v")).select(*keys, *[F.col(f"_v.{c}").alias(c) for c in value])
