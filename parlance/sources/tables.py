"""Table scans, sinks and file listings."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parlance.session import work_dir

RAW_MESSAGE_SCHEMA = T.StructType(
    [
        T.StructField(name, T.StringType(), True)
        for name in (
            "message_id", "conversation_id", "timestamp", "direction", "sender_phone",
            "sender_name", "message_type", "message_body", "status", "channel", "campaign_id",
            "agent_id", "conversation_outcome", "metadata",
        )
    ]
)


def read_parquet(
    spark: SparkSession, path: str, schema: T.StructType | None = None, merge_schema: bool = False
) -> DataFrame:
    """All Parquet under a prefix; with a schema no file is opened to infer one.

    ``merge_schema`` reads files of an older and a newer layout together, with NULL for the
    columns a file lacks.
    """
    reader = spark.read.option("mergeSchema", str(merge_schema).lower())
    if schema is not None:
        reader = reader.schema(schema)
    return reader.parquet(path.rstrip("/"))


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Overwrites a folder, written by the executors."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def written_once(df: DataFrame, name: str) -> DataFrame:
    """Written into the shared work folder and read back: what is read more than once is computed
    once, every reader sees the same rows, and a lost executor repeats no more than this step."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def file_inventory(spark: SparkSession, path: str) -> DataFrame:
    """Path, size and modification time of every file under a prefix; no file content is read."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(path)
        .select(
            F.col("path").alias("file_path"),
            F.col("length").alias("size_bytes"),
            F.col("modificationTime").alias("modified_at"),
        )
    )


def rows_per_file(df: DataFrame) -> DataFrame:
    """Rows that a scan reads from each of its files."""
    return df.groupBy(F.col("_metadata.file_path").alias("file_path")).agg(
        F.count(F.lit(1)).alias("rows")
    )


def _at(path: str | None) -> dict[str, str]:
    return {"path": path} if path else {}


def append_table(df: DataFrame, table: str, path: str | None = None) -> None:
    """Append that refuses a changed schema; the table is created (at ``path``) if it is absent."""
    spark = df.sparkSession
    if spark.catalog.tableExists(table):
        want = [(f.name, f.dataType) for f in spark.table(table).schema.fields]
        have = [(f.name, f.dataType) for f in df.schema.fields]
        if want != have:
            raise ValueError(f"schema of {table} differs: expected {want}, got {have}")
    df.write.mode("append").options(**_at(path)).saveAsTable(table)


def read_table(spark: SparkSession, table: str, columns: list[str] | None = None) -> DataFrame:
    """A table of the catalog by name; a missing table or column raises."""
    found = spark.table(table)
    return found if columns is None else found.select(*[F.col(f"`{c}`") for c in columns])


def evolve_table(df: DataFrame, table: str, path: str | None = None) -> list[str]:
    """Append that lets the table grow: columns that the catalog does not know are added to it first;
    stored files are left as they are and read as NULL there. Columns that ``df`` lacks become NULL.
    A column of another type raises. Returns the names of the columns added."""
    spark = df.sparkSession
    if not spark.catalog.tableExists(table):
        append_table(df, table, path)
        return []
    known = {f.name.lower(): f for f in spark.table(table).schema.fields}
    for f in df.schema.fields:
        if f.name.lower() in known and known[f.name.lower()].dataType != f.dataType:
            raise ValueError(f"{f.name} of {table} is {known[f.name.lower()].dataType}, not {f.dataType}")
    new = [f for f in df.schema.fields if f.name.lower() not in known]
    if new:
        listed = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in new)
        spark.sql(f"alter table {table} add columns ({listed})")
    present = {c.lower() for c in df.columns}
    # rows go in by name, in the order of the catalog
    rows = df.select(*[
        F.col(f"`{f.name}`") if f.name.lower() in present else F.lit(None).cast(f.dataType).alias(f.name)
        for f in spark.table(table).schema.fields
    ])
    rows.write.mode("append").insertInto(table)
    return [f.name for f in new]


def overwrite_table(
    df: DataFrame, table: str, replace_schema: bool = False, path: str | None = None
) -> DataFrame:
    """Overwrites a table and reads it back.

    Columns that only the old table has are kept as NULLs (merged schema), unless
    ``replace_schema`` drops them. The plan must not read the table it replaces.
    """
    spark = df.sparkSession
    if not replace_schema and spark.catalog.tableExists(table):
        present = {name.lower() for name in df.columns}
        for field in spark.table(table).schema.fields:
            if field.name.lower() not in present:
                df = df.withColumn(field.name, F.lit(None).cast(field.dataType))
    df.write.mode("overwrite").options(**_at(path)).saveAsTable(table)
    spark.catalog.refreshTable(table)
    return spark.table(table)


def row_count(df: DataFrame) -> DataFrame:
    """Row count as a one-row DataFrame; a scan that reads no column. A missing table raises."""
    return df.agg(F.count(F.lit(1)).alias("rows"))


def union_layouts(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of an older and a newer layout, with NULL where a layout lacks a column."""
    return old.unionByName(new, allowMissingColumns=True)


def export_sample(df: DataFrame, rows: int, file_format: str, path: str) -> None:
    """First rows as CSV with a header, or as Parquet with every column as text."""
    sample = df.limit(rows).select(*[F.col(f"`{c}`").cast("string").alias(c) for c in df.columns])
    if file_format == "csv":
        sample.coalesce(1).write.mode("overwrite").option("header", True).option(
            "encoding", "UTF-8"
        ).csv(path)
    elif file_format == "parquet":
        sample.coalesce(1).write.mode("overwrite").parquet(path)
    else:
        raise ValueError(f"export format must be csv or parquet, not {file_format!r}")
