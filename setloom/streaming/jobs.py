"""Structured Streaming jobs: duplicate-tolerant intake, online counters per key, and records met by their settlement.

Each job takes a streaming DataFrame, so that files, sockets or topics can feed it. The queries run them over the events
table until it has been read (availableNow) and return what the job has written, to be equal to the batch result.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from setloom.sources.storage import shared_dir

#: How late a row may come, and how long after a view its purchase counts.
LATE, SETTLED_WITHIN = "2 hours", "1 hour"
KINDS = ("click", "error", "purchase", "signup", "view")


def work_dir(spark: SparkSession) -> str:
    """A new folder for sinks and stream checkpoints, below the one that the cluster shares."""
    return f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"


def events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream; event time becomes a timestamp, which watermarks need."""
    path = os.path.join(sf_dir, "events.parquet")
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).parquet(os.path.join(sf_dir, "events*.parquet"))
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def written(made: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream to the end of its input into Parquet and read the result."""
    spark, folder = made.sparkSession, work_dir(made.sparkSession)
    query = made.writeStream.format("parquet").outputMode(mode).option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(made.schema).parquet(f"{folder}/out")


def intake(stream: DataFrame, key: str, time: str, late: str = LATE) -> DataFrame:
    """Rows without the repeats of a key that come within the watermark; state is dropped once it has passed."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def settled(records: DataFrame, results: DataFrame, how: str = "inner", late: str = LATE, within: str = SETTLED_WITHIN) -> DataFrame:
    """Records (user_id, recorded_id, recorded_at) with the results (user_id, settled_id, settled_at, value) of the same user soon after.

    With how="leftOuter" records that no result met come out, with nulls, when the watermark has passed them.
    """
    a, b = records.withWatermark("recorded_at", late).alias("a"), results.withWatermark("settled_at", late).alias("b")
    near = F.expr(f"a.user_id = b.user_id and b.settled_at >= a.recorded_at and b.settled_at <= a.recorded_at + interval {within}")
    return a.join(b, near, how).select("a.user_id", "recorded_id", "settled_id", "recorded_at", "settled_at", "value")


def _count(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Counts of each kind and the newest event of one user; the state is one row of fixed width."""
    counts = list(state.get) if state.exists else [0] * (len(KINDS) + 1)
    for frame in frames:
        for i, kind in enumerate(KINDS):
            counts[i] += int((frame["event_type"] == kind).sum())
        counts[-1] = max(counts[-1], int(frame["event_id"].max()))
    state.update(tuple(counts))
    yield pd.DataFrame([[key[0], *counts]], columns=["user_id", *KINDS, "newest"])


def online_counters(stream: DataFrame) -> DataFrame:
    """A row per user and micro-batch with the counters so far: the last one of a user is the batch result."""
    fields = ", ".join(f"{k} long" for k in (*KINDS, "newest"))
    return stream.groupBy("user_id").applyInPandasWithState(_count, f"user_id long, {fields}", fields, "append", GroupStateTimeout.NoTimeout)


def l1_intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table fed twice, as a source that repeats itself does: every event comes out once."""
    stream = events_stream(spark, sf_dir).select("event_id", "ts", "user_id", "event_type", "value")
    # the two feeds are equal, so whichever row of an event comes first is right
    out = written(intake(stream.unionByName(stream), "event_id", "ts"))
    return out.select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "user_id", "event_type", "value")


def l2_online_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = written(online_counters(events_stream(spark, sf_dir).select("user_id", "event_id", "event_type")))
    return out.groupBy("user_id").agg(*(F.max(c).alias(c) for c in (*KINDS, "newest")))


def l3_settled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views with the purchases of the same user within an hour."""
    events = lambda kind: events_stream(spark, sf_dir).where(F.col("event_type") == kind)
    records = events("view").select("user_id", F.col("event_id").alias("recorded_id"), F.col("ts").alias("recorded_at"))
    results = events("purchase").select("user_id", F.col("event_id").alias("settled_id"), F.col("ts").alias("settled_at"), "value")
    return written(settled(records, results)).select("user_id", "recorded_id", "settled_id", "value")


#: Lengths of windows, their step where they slide, and the gap that ends a session.
TUMBLE, SLIDE, GAP = "1 hour", "30 minutes", "20 minutes"
KINDS_OF_WINDOW = ("tumbling", "sliding", "session")


def windowed(stream: DataFrame, kind: str, late: str = LATE) -> DataFrame:
    """user_id, start, end, n, total of each window of (user_id, ts, value). A window's state goes when the watermark has passed it."""
    held = {"tumbling": F.window("ts", TUMBLE), "sliding": F.window("ts", TUMBLE, SLIDE), "session": F.session_window("ts", GAP)}[kind]
    made = stream.withWatermark("ts", late).groupBy("user_id", held.alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return made.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")


def completed(made: DataFrame) -> DataFrame:
    """Run a stream of windows to the end of its input and read the windows as they are then, open ones as well.

    Each micro-batch replaces the result, as a table behind a dashboard would be. To append closed windows only, use written().
    """
    spark, folder = made.sparkSession, work_dir(made.sparkSession)

    def replace(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")
        newest.append(number)

    newest: list[int] = []
    made.writeStream.outputMode("complete").foreachBatch(replace).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    if not newest:
        return spark.createDataFrame([], made.schema)
    return spark.read.schema(made.schema).parquet(f"{folder}/out/batch={newest[-1]}")


def l4_streamed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events and their value for each user in tumbling, sliding and session windows, counted as they stream in."""
    out = None
    for kind in KINDS_OF_WINDOW:
        stream = events_stream(spark, sf_dir).select("user_id", "ts", "value")
        one = completed(windowed(stream, kind)).select(F.lit(kind).alias("kind"), "user_id", *(F.col(c).cast("timestamp_ntz").alias(c) for c in ("start", "end")), "n", F.round("total", 4).alias("total"))
        out = one if out is None else out.unionByName(one)
    return out


QUERIES = {"l1_intake": l1_intake, "l2_online_counters": l2_online_counters, "l3_settled": l3_settled, "l4_streamed_windows": l4_streamed_windows}
ORACLE_SQL = {
    "l1_intake": "select event_id, ts, user_id, event_type, value from events",
    "l2_online_counters": "select user_id, " + ", ".join(f"cast(count(*) filter (where event_type = '{k}') as bigint) as {k}" for k in KINDS) + ", max(event_id) as newest from events group by user_id",
    "l3_settled": "select a.user_id, a.event_id as recorded_id, b.event_id as settled_id, b.value from events a join events b on a.user_id = b.user_id and b.ts >= a.ts and b.ts <= a.ts + interval 1 hour where a.event_type = 'view' and b.event_type = 'purchase'",
    "l4_streamed_windows": """with steps as (select user_id, ts, value, time_bucket(interval 1 hour, ts) as a, time_bucket(interval 30 minutes, ts) as b from events),
parts as (select 'tumbling' as kind, user_id, a as start, a + interval 1 hour as "end", value from steps union all select 'sliding', user_id, b, b + interval 1 hour, value from steps union all select 'sliding', user_id, b - interval 30 minutes, b + interval 30 minutes, value from steps),
gaps as (select user_id, ts, value, case when ts < lag(ts) over (partition by user_id order by ts, event_id) + interval 20 minutes then 0 else 1 end as opens, event_id from events),
numbered as (select *, sum(opens) over (partition by user_id order by ts, event_id) as s from gaps)
select kind, user_id, start, "end", count(*) as n, round(sum(value), 4) as total from parts group by kind, user_id, start, "end"
union all select 'session', user_id, min(ts), max(ts) + interval 20 minutes, count(*), round(sum(value), 4) from numbered group by user_id, s""",
}
