"""Keyed incremental load: changed rows above a stored watermark, merged into a table by key.

The table is a Parquet folder in which a row's partition follows from its key alone, so a change
or a deletion touches the partition of its key and no other. A load reads the rows of the source
above the watermark, keeps the newest version of each key, drops those that the table has already
seen, and rewrites the partitions of the rest by dynamic partition overwrite. The watermark is
written last: a load that is interrupted is simply run again.
"""

from __future__ import annotations

import datetime
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from parlance.sources.tables import written_once

#: Column of the table that names the partition, and the one that marks deleted keys.
PART, GONE = "_part", "_deleted"
#: Files of a partition that is written anew; tasks a core that write the first rows.
SLICES, FIRST = 8, 4


@dataclass(frozen=True)
class KeyedTable:
    """A table of the newest version of each key.

    ``version`` orders the versions of a key and is the column the watermark is about; ``deleted``
    is a condition on source rows. ``parts`` is the number of partitions by key hash, fixed for the
    life of the table; ``part`` may give another partition, as an expression over the key columns.
    ``lookback`` is how far below the watermark rows are read again, so that versions that arrive
    late are found.
    """

    root: str
    entity: str
    key: tuple[str, ...]
    version: str
    deleted: str = "false"
    parts: int = 64
    part: str | None = None
    lookback: datetime.timedelta | int | float | None = None

    @property
    def path(self) -> str:
        return f"{self.root.rstrip('/')}/{self.entity}"

    @property
    def watermark_path(self) -> str:
        return f"{self.root.rstrip('/')}/_watermarks/{self.entity}"

    @property
    def layout_path(self) -> str:
        """An empty file with the table's columns, for a table that has no rows yet."""
        return f"{self.root.rstrip('/')}/_layouts/{self.entity}"

    def partition(self) -> Column:
        if self.part is not None:
            return F.expr(self.part)
        return F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in self.key]), F.lit(self.parts)).cast("int")


def saved(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at a path, or None where nothing has been written yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def watermark(spark: SparkSession, table: KeyedTable):
    """Highest version loaded so far, or None."""
    log = saved(spark, table.watermark_path)
    return None if log is None else log.agg(F.max("watermark")).first()[0]


def changed_rows(source: DataFrame, table: KeyedTable, mark) -> DataFrame:
    """Rows of ``source`` that may be new: versions from the watermark less the lookback on. The limit
    is a literal, so it reaches the Parquet scan."""
    if mark is None:
        return source.where(F.col(f"`{table.version}`").isNotNull())
    if table.lookback is None:
        return source.where(F.col(f"`{table.version}`") > F.lit(mark))
    return source.where(F.col(f"`{table.version}`") >= F.lit(mark - table.lookback))


def _state(rows: DataFrame, table: KeyedTable) -> Column:
    """What is compared of two rows of a key: the version, then whether it is a deletion, then all
    other columns, so that one of them is always the newer one."""
    rest = sorted(c for c in rows.columns if c not in (*table.key, table.version, GONE, PART))
    return F.struct(F.col(f"`{table.version}`"), F.col(GONE), *[F.col(f"`{c}`") for c in rest])


def load(source: DataFrame, table: KeyedTable) -> DataFrame:
    """Brings the table up to date with ``source``: merges its rows from the watermark on, then moves
    the watermark. Returns the report of ``merge``."""
    spark = source.sparkSession
    return merge(changed_rows(source, table, watermark(spark, table)), table)


def _compared(batch: DataFrame, stored: DataFrame, table: KeyedTable) -> DataFrame:
    """Rows of the batch with ``_newer`` (than the table's row of the key) and ``_was_gone`` (the table
    has the key as deleted; null without the key).

    The versions of the table's rows decide, and only they are shuffled. Rows of a key that agree in
    version and deletion are compared in all columns, which are fetched for those keys.
    """
    key = [F.col(f"`{k}`") for k in table.key]
    # partitions of the batch only: at most as many names as the table has partitions
    parts = [r[0] for r in batch.select(PART).distinct().collect()]
    old = stored.where(F.col(PART).isin(parts)) if parts else stored.limit(0)
    known = old.select(PART, *key, F.struct(F.col(f"`{table.version}`").alias("v"), F.col(GONE).alias("g")).alias("_was"))
    now = F.struct(F.col("_state")[table.version].alias("v"), F.col("_state")[GONE].alias("g"))
    newer = F.when(F.col("_was").isNull(), True).when(now != F.col("_was"), now > F.col("_was"))
    moved = batch.join(known, [PART, *table.key], "left").withColumns({"_newer": newer, "_was_gone": F.col("_was")["g"]})
    moved = written_once(moved.drop("_was"), f"merge-{table.entity}")
    tied = moved.where("_newer is null")
    if tied.isEmpty():
        return moved
    rest = old.join(tied.select(PART, *key), [PART, *table.key], "left_semi")
    rest = rest.select(PART, *key, _state(rest, table).alias("_was"))
    settled = tied.join(rest, [PART, *table.key]).withColumn("_newer", F.col("_state") > F.col("_was")).drop("_was")
    settled = written_once(settled, f"merge-{table.entity}-tied")
    return moved.where("_newer is not null").unionByName(settled)


def _unpacked(columns: list[str], table: KeyedTable) -> list[Column]:
    """The table's columns from a row's key and ``_state``, PART last."""
    plain = (*table.key, PART)
    found = [F.col(f"`{c}`") if c in plain else F.col("_state")[c].alias(c) for c in columns if c != PART]
    return [*found, F.col(PART)]


def _write(rows: DataFrame, table: KeyedTable) -> None:
    """Replaces the partitions that the rows are in."""
    writer = rows.write.option("partitionOverwriteMode", "dynamic").option("compression", "zstd")
    writer.partitionBy(PART).mode("overwrite").parquet(table.path)


def _first(per_key: DataFrame, columns: list[str], table: KeyedTable) -> tuple:
    """Writes the first rows of a table; (rows read, newest version, living keys, partitions).

    The rows are written as they come out of the grouping by key, with no further shuffle: a partition
    has at most one file for each of FIRST tasks a core. The rows read are counted by the tasks that
    write, each once.
    """
    spark, watch = per_key.sparkSession, Observation()
    few = per_key.coalesce(FIRST * spark.sparkContext.defaultParallelism)
    few = few.observe(watch, F.coalesce(F.sum("_read"), F.lit(0)).alias("read"))
    _write(few.select(*_unpacked(columns, table)), table)
    written = saved(spark, table.path)
    if written is None:
        return 0, None, 0, 0
    version = F.max(F.col(f"`{table.version}`"))
    newest, living, parts = written.agg(version, F.count_if(~F.col(GONE)), F.count_distinct(PART)).first()
    return watch.get["read"], newest, living, parts


def _rewritten(fresh: DataFrame, stored: DataFrame, columns: list[str], table: KeyedTable) -> int:
    """Writes the partitions of ``fresh`` anew, with its rows in place of the old ones of their keys;
    how many they are.

    The only shuffle of the old rows is by partition and a few slices of it, so that there are few
    files, each in the order of the key.
    """
    touched = [r[0] for r in fresh.select(PART).distinct().collect()]
    if not touched:
        return 0
    key = [F.col(f"`{k}`") for k in table.key]
    new = fresh.select(*_unpacked(columns, table), F.lit(1).alias("_merge_new"))
    old = stored.where(F.col(PART).isin(touched)).withColumn("_merge_new", F.lit(0))
    within = [F.col(PART), F.col("_merge_slice"), *key]
    slices = F.pmod(F.xxhash64(F.lit("slice"), *key), F.lit(SLICES))  # not the hash of the partition
    both = new.unionByName(old).withColumn("_merge_slice", slices).repartition(PART, "_merge_slice")
    place = F.row_number().over(Window.partitionBy(*within).orderBy(F.desc("_merge_new")))
    merged = both.withColumn("_merge_place", place).where("_merge_place = 1").sortWithinPartitions(*within)
    # a dynamic overwrite replaces the old files when all new ones are there, so they can be read
    # until then
    _write(merged.select(*[F.col(f"`{c}`") for c in columns]), table)
    return len(touched)


def merge(rows: DataFrame, table: KeyedTable) -> DataFrame:
    """Puts the newest versions among ``rows`` into the table; returns one row: entity, read (rows),
    inserted, changed, deleted, stale (newest versions here that are not newer than the table's),
    parts (partitions rewritten), watermark.

    Rows without a full key, or without a version, are left out. A deleted key stays in the table as
    a mark, so that an older version that comes later does not bring it back. The columns of the
    rows must be those of the table.
    """
    spark = rows.sparkSession
    mark = watermark(spark, table)
    for name in (*table.key, table.version):
        rows = rows.where(F.col(f"`{name}`").isNotNull())
    rows = rows.withColumns({GONE: F.coalesce(F.expr(table.deleted), F.lit(False)), PART: table.partition()})
    # a maximum per key: the order of arrival does not matter, and a hot key is one row per task
    per_key = rows.groupBy(PART, *[F.col(f"`{k}`") for k in table.key]).agg(
        F.max(_state(rows, table)).alias("_state"), F.count(F.lit(1)).alias("_read")
    )
    stored = saved(spark, table.path)
    if stored is None:
        rows.limit(0).write.mode("ignore").parquet(table.layout_path)
        read, newest, inserted, touched = _first(per_key, rows.columns, table)
        counts = (inserted, 0, 0, 0)
    elif set(stored.columns) != set(rows.columns):
        raise ValueError(f"columns of {table.entity} differ: {sorted(stored.columns)}, {sorted(rows.columns)}")
    else:
        batch = written_once(per_key, f"changes-{table.entity}")
        read, newest = batch.agg(F.coalesce(F.sum("_read"), F.lit(0)), F.max(F.col("_state")[table.version])).first()
        moved = _compared(batch, stored, table)
        gone, was_gone = F.col("_state")[GONE], F.coalesce("_was_gone", F.lit(True))
        counts = moved.agg(
            F.count_if(F.col("_newer") & ~gone & was_gone), F.count_if(F.col("_newer") & ~gone & ~was_gone),
            F.count_if(F.col("_newer") & gone & ~was_gone), F.count_if(~F.col("_newer")),
        ).first()
        touched = _rewritten(moved.where("_newer"), stored, rows.columns, table)
    result = spark.createDataFrame(
        [(table.entity, read, *counts, touched)],
        "entity string, read long, inserted long, changed long, deleted long, stale long, parts int",
    ).withColumn("watermark", F.greatest(F.lit(newest), F.lit(mark)).cast(rows.schema[table.version].dataType))
    if read:
        result.write.mode("append").parquet(table.watermark_path)
    return result


def current(spark: SparkSession, table: KeyedTable) -> DataFrame:
    """The living rows of the table, in the source's columns."""
    rows = saved(spark, table.path)
    if rows is None:
        rows = spark.read.parquet(table.layout_path)
    return rows.where(~F.col(GONE)).drop(GONE, PART)
