"""Results of a stream that are right after every trigger, open windows included.

A result is a table keyed by what its rows are about. Each trigger hands over the rows that have
changed, and these replace the stored ones. Every row bears the number of the batch that wrote it,
and the table's log the highest one, so a batch that is replayed changes nothing.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from parlance.sources import incremental
from parlance.sources.incremental import KeyedTable

#: Column that says which batch wrote a row.
BATCH = "_batch"


def window_table(root: str, entity: str, key: tuple[str, ...], window: str = "window_start") -> KeyedTable:
    """Table of window results, one partition per day of the windows, so that closed days are left alone."""
    return KeyedTable(root, entity, key, BATCH, part=f"cast(date_format({window}, 'yyyyMMdd') as int)")


def apply_batch(rows: DataFrame, batch_id: int, table: KeyedTable) -> DataFrame:
    """Puts the changed rows of a batch in place of the stored ones; a known batch changes nothing."""
    return incremental.load(rows.withColumn(BATCH, F.lit(batch_id).cast("long")), table)


def keep_windows(results: DataFrame, table: KeyedTable, checkpoint: str) -> StreamingQuery:
    """Runs a windowed aggregation in update mode over all that is there now: open windows are given
    out as they stand, and are replaced as they grow. What is stored after a trigger equals the same
    aggregation over everything that has arrived (but for rows behind the watermark)."""
    return (
        results.writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(lambda rows, batch_id: apply_batch(rows, batch_id, table))
        .trigger(availableNow=True)
        .start()
    )


def current(spark: SparkSession, table: KeyedTable) -> DataFrame:
    return incremental.current(spark, table).drop(BATCH)


# Sessions: update mode has none, and a late row may join two of them


def session_table(root: str, entity: str = "sessions", parts: int = 64) -> KeyedTable:
    """Table of sessions; all of one conversation are in one partition."""
    return KeyedTable(
        root, entity, ("conversation_id", "session_start"), BATCH, deleted="gone",
        part=f"cast(pmod(xxhash64(conversation_id), {parts}) as int)",
    )


def _joined(parts: DataFrame, gap: timedelta) -> DataFrame:
    """Sessions from parts (conversation_id, session_start, last, messages) of any sources: parts less
    than ``gap`` apart are one."""
    order = Window.partitionBy("conversation_id").orderBy("session_start", "last")
    before = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.col("_before").isNull() | (F.col("session_start") >= F.col("_before") + F.lit(gap))
    numbered = parts.withColumn("_before", before).withColumn("_no", F.sum(opens.cast("int")).over(order))
    return numbered.groupBy("conversation_id", "_no").agg(
        F.min("session_start").alias("session_start"), F.max("last").alias("last"), F.sum("messages").alias("messages")
    ).drop("_no")


def merge_sessions(messages: DataFrame, batch_id: int, table: KeyedTable, time: str, gap: timedelta) -> None:
    """Adds the messages of one batch to the stored sessions of their conversations.

    The batch is brought to sessions of its own first, by an aggregation, so a hot conversation
    meets its stored sessions as a few rows. Conversations that a replayed batch has reached
    before are skipped. Rows without conversation or time are left out.
    """
    spark = messages.sparkSession
    rows = messages.where(F.col(time).isNotNull() & F.col("conversation_id").isNotNull())
    # a session window still takes a row at its very end, so it ends a microsecond before the gap does
    span = int(gap / timedelta(microseconds=1)) - 1
    fresh = rows.groupBy("conversation_id", F.session_window(time, f"{span} microseconds").alias("s")).agg(
        F.min(time).alias("session_start"), F.max(time).alias("last"), F.count(F.lit(1)).alias("messages")
    ).drop("s")
    stored = incremental.saved(spark, table.path)
    if stored is None:
        changed = _joined(fresh, gap).withColumn("gone", F.lit(False))
    else:
        touched = fresh.select("conversation_id").distinct()
        parts = [r[0] for r in touched.select(table.partition()).distinct().collect()]
        known = stored.where(F.col(incremental.PART).isin(parts)).join(touched, "conversation_id", "left_semi")
        reached = known.where(F.col(BATCH) >= batch_id).select("conversation_id").distinct()
        known = known.where(~F.col(incremental.GONE)).select("conversation_id", "session_start", "last", "messages")
        fresh = fresh.join(reached, "conversation_id", "left_anti")
        known = known.join(reached, "conversation_id", "left_anti")
        whole = _joined(known.unionByName(fresh), gap).withColumn("gone", F.lit(False))
        # stored sessions that were taken into one that begins earlier
        keys = ["conversation_id", "session_start"]
        lost = known.join(whole.select(*keys), keys, "left_anti").withColumn("gone", F.lit(True))
        same = [*keys, "last", "messages"]
        changed = whole.join(known.select(*same), same, "left_anti").unionByName(lost)
    apply_batch(changed, batch_id, table)


def keep_sessions(
    messages: DataFrame, table: KeyedTable, checkpoint: str, time: str = "timestamp",
    gap: timedelta = timedelta(minutes=120),
) -> StreamingQuery:
    """Sessions per conversation over all that has arrived, after every trigger; a silence of exactly
    ``gap`` ends one. No watermark: a late message, however late, finds its session or joins two."""
    return (
        messages.writeStream.option("checkpointLocation", checkpoint)
        .foreachBatch(lambda rows, batch_id: merge_sessions(rows, batch_id, table, time, gap))
        .trigger(availableNow=True)
        .start()
    )


def sessions_now(spark: SparkSession, table: KeyedTable, gap: timedelta = timedelta(minutes=120)) -> DataFrame:
    """(conversation_id, session_start, session_end, messages) as stored; a session ends ``gap`` after
    its last message."""
    return current(spark, table).select(
        "conversation_id", "session_start", (F.col("last") + F.lit(gap)).alias("session_end"), "messages"
    )
