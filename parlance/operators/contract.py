"""Schema and value contract of the raw message table."""

from __future__ import annotations

from collections.abc import Collection, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parlance.sources.tables import RAW_MESSAGE_SCHEMA

REQUIRED_COLUMNS = frozenset(RAW_MESSAGE_SCHEMA.names)

# Allowed values (a collection) or pattern (a string) per column
VALUE_RULES: dict[str, Collection[str] | str] = {
    "conversation_id": r"^conv_[0-9a-f]{8}$",
    "direction": ("inbound", "outbound"),
    "message_type": (
        "text", "audio", "image", "document", "sticker", "contact", "video", "location",
    ),
    "status": ("sent", "delivered", "read", "failed"),
    "channel": ("whatsapp",),
}


def conform(df: DataFrame, schema: T.StructType, cast: bool = False) -> DataFrame:
    """Columns of the schema in its order: extra ones dropped, missing ones a typed NULL.

    Present columns keep their type, unless ``cast`` converts them (NULL where that fails).
    """
    present = set(df.columns)

    def column(field: T.StructField):
        if field.name not in present:
            return F.lit(None).cast(field.dataType).alias(field.name)
        value = F.col(f"`{field.name}`")
        return value.try_cast(field.dataType).alias(field.name) if cast else value

    return df.select(*[column(field) for field in schema.fields])


def validate_columns(df: DataFrame, required: Collection[str] = REQUIRED_COLUMNS) -> DataFrame:
    """One row: whether all required columns are there, which are missing, which are extra."""
    missing = sorted(set(required) - set(df.columns))
    extra = sorted(set(df.columns) - set(required))
    return df.sparkSession.createDataFrame(
        [(not missing, missing, extra)],
        "is_valid boolean, missing array<string>, extra array<string>",
    )


def value_violations(
    df: DataFrame, rules: Mapping[str, Collection[str] | str] = VALUE_RULES
) -> DataFrame:
    """Rows per column that break its value rule; one pass over the table. NULLs do not count."""
    counts = {}
    for name, rule in rules.items():
        fits = F.col(name).rlike(rule) if isinstance(rule, str) else F.col(name).isin(*rule)
        counts[name] = F.count_if(~fits)
    totals = df.agg(*[count.alias(name) for name, count in counts.items()])
    pairs = [
        F.struct(F.lit(name).alias("column_name"), F.col(name).alias("violations"))
        for name in counts
    ]
    return totals.select(F.inline(F.array(*pairs)))


def with_ingest_metadata(df: DataFrame, run_id: str | None = None) -> DataFrame:
    """Adds load time, source file and run id (load time as text unless one is given)."""
    now = F.current_timestamp()
    run = F.lit(run_id) if run_id else F.date_format(now, "yyyyMMdd_HHmmss")
    return df.withColumns(
        {
            "_ingestion_timestamp": now,
            "_source_file": F.col("_metadata.file_path"),
            "_run_id": run,
        }
    )
