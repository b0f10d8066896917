"""Inbound chat events as a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from parlance.operators.contract import conform, with_ingest_metadata

EVENT_SCHEMA = (
    "id string, eventType string, direction string, receivedAt string, processedAt string, "
    "textContent string, instanceId string, chatId string, "
    "rawPayload struct<pushName: string, isFromMe: boolean, messageTimestamp: string, "
    "key: struct<remoteJid: string, remoteJidAlt: string, fromMe: boolean, participant: string>>"
)
GROUP_MARK = "@g.us"


def read_events(
    spark: SparkSession, path: str, max_files_per_trigger: int | None = None
) -> DataFrame:
    """Stream of the JSON event files that arrive in a folder."""
    reader = spark.readStream.schema(EVENT_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.json(path)


def new_messages(events: DataFrame) -> DataFrame:
    """Inbound ``message.received`` events not processed yet, with their time as ``received_at``."""
    return events.filter(
        (F.col("eventType") == "message.received")
        & (F.col("direction") == "inbound")
        & (F.coalesce("processedAt", F.lit("")) == "")
    ).withColumn("received_at", F.col("receivedAt").try_cast("timestamp"))


def dedup_stream(
    events: DataFrame, key: str = "id", ttl: str = "24 hours"
) -> DataFrame:
    """Each id once. Repeats that arrive within ``ttl`` are always dropped; later ones may come
    through. What counts is the time of arrival here, not the event's own time: an event that
    comes days late, as after an outage, is new and stays."""
    arrived = events.withColumn("_arrived_at", F.current_timestamp())
    return (
        arrived.withWatermark("_arrived_at", ttl)
        .dropDuplicatesWithinWatermark([key])
        .drop("_arrived_at")
    )


def since_start(events: DataFrame, start: Column) -> DataFrame:
    """Drops events received before the start, or written before it; unreadable times too.

    Events that do not say when they were written stay.
    """
    written = F.timestamp_seconds(F.col("rawPayload.messageTimestamp").try_cast("bigint"))
    return events.filter(
        (F.col("received_at") >= start) & F.coalesce(written >= start, F.lit(True))
    )


def non_empty(*values: Column) -> Column:
    """First value that is neither NULL nor empty."""
    return F.coalesce(*[F.when(v != "", v) for v in values])


def lead_messages(events: DataFrame) -> DataFrame:
    """Drops own, group and blank messages; adds the sender id before the @ and the bare text."""
    payload, key = F.col("rawPayload"), F.col("rawPayload.key")
    sender = non_empty(key["remoteJidAlt"], key["remoteJid"], F.col("chatId"))

    def in_group(value: Column) -> Column:
        return F.coalesce(value.contains(GROUP_MARK), F.lit(False))

    own = F.coalesce(key["fromMe"], F.lit(False)) | F.coalesce(payload["isFromMe"], F.lit(False))
    group = (
        in_group(sender)
        | in_group(F.col("chatId"))
        | in_group(key["remoteJid"])
        | (F.coalesce(key["participant"], F.lit("")) != "")
    )
    text = F.regexp_replace("textContent", r"(?U)^\s+|\s+$", "")
    return events.filter(~own & ~group & (text != "")).withColumns(
        {
            "sender_id": F.coalesce(F.substring_index(sender, "@", 1), F.lit("")),
            "text": text,
            "sender_name": F.coalesce(payload["pushName"], F.lit("")),
        }
    )


def filter_events(events: DataFrame, start: Column) -> DataFrame:
    """All filters of the event source in a row."""
    return lead_messages(since_start(new_messages(events), start))


def closed_by(stream: DataFrame, markers: DataFrame) -> DataFrame:
    """A stream together with end markers, for a source that has ended or pauses.

    Windows and sessions are given out once the newest time lies behind them by the allowed
    lateness; the last ones of a source stay open for ever. A marker is a row of a later time and
    an otherwise unused key, added once the source is used up, as later rows would be late. It
    closes all before it and is itself not given out.
    """
    return stream.unionByName(markers)


def repeated_errors(
    diagnostics: DataFrame,
    time: str = "timestamp",
    window: str = "6 hours",
    slide: str = "1 hour",
    late: str = "1 hour",
    more_than: int = 3,
) -> DataFrame:
    """Errors that come more than three times in a sliding window of six hours."""
    return (
        diagnostics.withWatermark(time, late)
        .groupBy(F.window(time, window, slide), "error_hash")
        .agg(F.count(F.lit(1)).alias("repeticoes"))
        .filter(F.col("repeticoes") > more_than)
        .select(
            F.col("window.start").alias("window_start"),
            F.col("window.end").alias("window_end"),
            "error_hash",
            "repeticoes",
        )
    )


def sessions(
    messages: DataFrame,
    time: str = "timestamp",
    gap: str = "120 minutes",
    late: str = "1 hour",
) -> DataFrame:
    """Sessions per conversation; a silence of exactly the gap already ends one."""
    # a session window still takes a row at its very end, so it ends a microsecond before the gap does
    tick = F.expr("interval 1 microsecond")
    return (
        messages.withWatermark(time, late)
        .groupBy("conversation_id", F.session_window(time, f"{gap} -1 microsecond"))
        .agg(F.count(F.lit(1)).alias("messages"))
        .select(
            "conversation_id",
            F.col("session_window.start").alias("session_start"),
            (F.col("session_window.end") + tick).alias("session_end"),
            "messages",
        )
    )


def ingest_stream(
    spark: SparkSession, source: str, schema: T.StructType, sink: str, checkpoint: str
) -> StreamingQuery:
    """Loads the files that are new since the last run into the Bronze folder.

    The checkpoint remembers loaded files, and the file sink commits each batch once, so a run
    that is repeated or interrupted loads nothing twice.
    """
    files = spark.readStream.schema(schema).parquet(source)
    return write_available(with_ingest_metadata(conform(files, schema)), sink, checkpoint)


def write_available(df: DataFrame, sink: str, checkpoint: str) -> StreamingQuery:
    """Processes all that is there now into a Parquet folder, and stops."""
    return (
        df.writeStream.format("parquet")
        .outputMode("append")
        .option("path", sink)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
