"""Streams: counts of the activity feed, repeats dropped within a watermark, incremental upserts, and the newest events as state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def activity_counts(events: DataFrame, window: str = "1 day", late: str = "1 day") -> DataFrame:
    """(window_start, event_type, n) of events (ts, event_type); works on batches and streams."""
    if "event_id" not in events.columns or not events.isStreaming:
        events = events.withWatermark("ts", late)
    grouped = events.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"))
    return grouped.select(F.col("w.start").alias("window_start"), "event_type", "n")


def without_repeats(events: DataFrame, key: str = "event_id", late: str = "1 day") -> DataFrame:
    """events (ts and the key) without those whose key came before, within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def upsert_stream(stream: DataFrame, path: str, checkpoint: str, key: str = "id", order: str = "version", buckets: int = 16, available_now: bool = False, mode: str = "append") -> StreamingQuery:
    """Appends each micro-batch under path as a folder of its own, keyed by bucket, so that a batch costs its own size only.

    read_upserts gives the latest row of each key. A batch that runs again replaces its own folder.
    """

    def append(batch: DataFrame, number: int) -> None:
        rank = F.row_number().over(W.partitionBy(key).orderBy(F.desc(order)))
        last = batch.withColumn("place_of_row", rank).where("place_of_row = 1").drop("place_of_row")
        dealt = last.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/batch={number}")

    writer = stream.writeStream.outputMode(mode).foreachBatch(append).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_upserts(spark: SparkSession, path: str, key: str = "id", order: str = "version") -> DataFrame:
    """The latest row of each key: the largest order, of equals that of the later batch."""
    rows = spark.read.option("basePath", path).parquet(f"{path}/batch=*")
    others = [c for c in rows.columns if c not in (key, "batch", "bucket")]
    best = F.max_by(F.struct(*others), F.struct(order, "batch"))
    return rows.groupBy(key).agg(best.alias("row")).select(key, *[F.col(f"row.{c}").alias(c) for c in others])


def compact_upserts(spark: SparkSession, path: str, to: str, key: str = "id", order: str = "version", buckets: int = 16) -> None:
    """Writes what read_upserts gives as one batch under another path."""
    rows = read_upserts(spark, path, key, order)
    rows.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")).write.partitionBy("bucket").parquet(f"{to}/batch=0")


def newest_by_key(events: DataFrame, key: str = "event_type", id_col: str = "event_id", ts: str = "ts", n: int = 40, salts: int = 8) -> DataFrame:
    """A stream (slot, key, version, ids, times) of the newest n events of each key, as state: one row for each slot that a
    micro-batch changes. Times are in microseconds. newest_of merges the slots of a key.

    A key's events are dealt to salts slots by id, so that a hot key is the work of several tasks; each slot's state has n events at
    most, so that late events of any age find their place. An event that comes again changes nothing; of equal times the
    larger id is newer. Events without id or time are left out, a null key is a key.
    """
    kind = events.schema[id_col].dataType
    out = T.StructType([T.StructField("slot", T.StringType()), T.StructField("key", T.StringType()), T.StructField("version", T.LongType()), T.StructField("ids", T.ArrayType(kind)), T.StructField("times", T.ArrayType(T.LongType()))])
    state = T.StructType(out.fields[2:])

    def keep(name: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        version, ids, times = held.get if held.exists else (0, [], [])
        best = before = sorted(zip(times, ids, strict=True), reverse=True)
        for frame in frames:
            new = frame.sort_values(["time", "id"], ascending=False).drop_duplicates().head(n)
            best = sorted({*best, *zip(new["time"].tolist(), new["id"].tolist(), strict=True)}, reverse=True)[:n]
        if best != before:
            version, ids, times = version + 1, [i for _, i in best], [t for t, _ in best]
            held.update((version, ids, times))
            yield pd.DataFrame({"slot": [name[0]], "key": [name[1]], "version": [version], "ids": [ids], "times": [times]})

    key_of, salt = F.col(key).cast("string"), F.pmod(F.xxhash64(id_col), F.lit(salts)).cast("string")
    slot = F.concat(salt, F.when(key_of.isNull(), "").otherwise(F.concat(F.lit(":"), key_of)))
    rows = events.where(F.col(id_col).isNotNull() & F.col(ts).isNotNull()).select(slot.alias("slot"), key_of.alias("key"), F.col(id_col).alias("id"), F.unix_micros(F.col(ts).cast("timestamp")).alias("time"))
    return rows.groupBy("slot", "key").applyInPandasWithState(keep, out, state, "update", GroupStateTimeout.NoTimeout)


def newest_of(slots: DataFrame, n: int = 40) -> DataFrame:
    """(key, id, time, rank) of the newest n events of each key: slots as newest_by_key gives them, the latest row of each slot."""
    each = slots.select("key", F.inline(F.arrays_zip(F.col("ids").alias("id"), F.col("times").alias("time"))))
    each = each.toDF("key", "id", "time")
    rank = F.row_number().over(W.partitionBy("key").orderBy(F.desc("time"), F.desc("id")))
    return each.withColumn("rank", rank).where(F.col("rank") <= n)
