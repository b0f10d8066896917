"""Declarative column edits: a list of operations applied one after the other.

An operation is a dict: ``{"op": "rename_column", "column": "a", "new_name": "b"}``.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Types whose conversion can fail on a value; these are tried, and give NULL on failure
NULL_PRONE_TYPES = frozenset(
    {
        "int", "integer", "bigint", "long", "smallint", "short", "tinyint", "byte", "double",
        "float", "decimal", "date", "timestamp", "boolean",
    }
)
Operation = Mapping[str, Any]


def is_null_prone(data_type: str | None) -> bool:
    base = re.split(r"[(\s]", (data_type or "").strip().lower(), maxsplit=1)[0]
    return base in NULL_PRONE_TYPES


def _drop(df: DataFrame, op: Operation) -> DataFrame:
    return df.drop(op["column"])


def _rename(df: DataFrame, op: Operation) -> DataFrame:
    return df.withColumnRenamed(op["column"], op["new_name"])


def _cast(df: DataFrame, op: Operation) -> DataFrame:
    value, kind = F.col(op["column"]), op["data_type"]
    return df.withColumn(
        op["column"], value.try_cast(kind) if is_null_prone(kind) else value.cast(kind)
    )


def _trim(df: DataFrame, op: Operation) -> DataFrame:
    return df.withColumn(op["column"], F.trim(op["column"]))


def _regex_replace(df: DataFrame, op: Operation) -> DataFrame:
    return df.withColumn(
        op["column"], F.regexp_replace(op["column"], op["pattern"], op["replacement"])
    )


def _coalesce(df: DataFrame, op: Operation) -> DataFrame:
    sources = op.get("source_columns") or [op["column"]]
    return df.withColumn(op["column"], F.coalesce(*[F.col(c) for c in sources]))


def _derive(df: DataFrame, op: Operation) -> DataFrame:
    return df.withColumn(op["column"], F.expr(op["expression"]))


def _filter(df: DataFrame, op: Operation) -> DataFrame:
    return df.filter(F.expr(op["expression"]))


def _date_format(df: DataFrame, op: Operation) -> DataFrame:
    return df.withColumn(op["column"], F.date_format(op["column"], op["format"]))


def _json_extract(df: DataFrame, op: Operation) -> DataFrame:
    return df.withColumn(op["new_name"], F.get_json_object(op["column"], op["json_path"]))


def _mask(df: DataFrame, op: Operation) -> DataFrame:
    return df.withColumn(op["column"], F.lit("[REDACTED]"))


# Operation -> (what it does, fields it needs)
OPERATIONS: dict[str, tuple[Callable[[DataFrame, Operation], DataFrame], tuple[str, ...]]] = {
    "drop_column": (_drop, ("column",)),
    "rename_column": (_rename, ("column", "new_name")),
    "cast_column": (_cast, ("column", "data_type")),
    "trim": (_trim, ("column",)),
    "regex_replace": (_regex_replace, ("column", "pattern", "replacement")),
    "coalesce": (_coalesce, ("column",)),
    "derive_column": (_derive, ("column", "expression")),
    "filter_rows": (_filter, ("expression",)),
    "date_format": (_date_format, ("column", "format")),
    "json_extract": (_json_extract, ("column", "json_path", "new_name")),
    "mask_pii": (_mask, ("column",)),
}


def check_operation(op: Operation) -> None:
    """Raises ValueError for an unknown operation or a missing field."""
    name = op.get("op")
    if name not in OPERATIONS:
        raise ValueError(f"unknown operation: {name!r}")
    for field in OPERATIONS[name][1]:
        value = op.get(field)
        if value is None or (value == "" and field != "replacement"):
            raise ValueError(f"{name} needs {field}")


def apply_ops(df: DataFrame, ops: Sequence[Operation]) -> DataFrame:
    """The DataFrame after all operations, each seeing the columns the ones before it left."""
    for op in ops:
        check_operation(op)
    for op in ops:
        df = OPERATIONS[op["op"]][0](df, op)
    return df


def warnings_for(ops: Sequence[Operation]) -> list[str]:
    """One line per cast that may turn values into NULL."""
    return [
        f"cast of {op['column']} to {op['data_type']} gives NULL for values that do not fit"
        for op in ops
        if op["op"] == "cast_column" and is_null_prone(op["data_type"])
    ]


def schema_diff(before: DataFrame, after: DataFrame, ops: Sequence[Operation]) -> list[dict]:
    """Columns before and after: kept, renamed (with the old name), derived or dropped."""
    origin = {name: name for name in before.columns}
    for op in ops:
        if op["op"] == "rename_column" and op["column"] in origin:
            origin[op["new_name"]] = origin.pop(op["column"])
        elif op["op"] == "drop_column":
            origin.pop(op["column"], None)
    types = dict(after.dtypes)
    changes = []
    for name in after.columns:
        source = origin.get(name)
        state = "derived" if source is None else "kept" if source == name else "renamed"
        changes.append({"name": name, "type": types[name], "state": state, "from": source})
    gone = set(before.columns) - {c["from"] for c in changes}
    changes += [
        {"name": name, "type": kind, "state": "dropped", "from": name}
        for name, kind in before.dtypes
        if name in gone
    ]
    return changes


def cast_losses(df: DataFrame, ops: Sequence[Operation]) -> DataFrame:
    """The warnings with what they come to over all rows: one row per cast that may give NULL, with
    its column and type, the values it was applied to, and those it lost. Rows that a later filter
    drops do not count."""
    for op in ops:
        check_operation(op)
    casts = []
    for i, op in enumerate(ops):
        risky = op["op"] == "cast_column" and is_null_prone(op["data_type"])
        if risky:
            df = df.withColumn(f"_had_{i}", F.col(f"`{op['column']}`").isNotNull())
        df = OPERATIONS[op["op"]][0](df, op)
        if risky:
            lost = F.col(f"_had_{i}") & F.col(f"`{op['column']}`").isNull()
            df = df.withColumn(f"_lost_{i}", lost)
            casts.append((i, op))
    counts = [F.count_if(f"_{kind}_{i}").alias(f"{kind}_{i}") for i, _ in casts for kind in ("had", "lost")]
    if not casts:
        return df.sparkSession.createDataFrame([], "place int, column string, data_type string, converted long, lost long, warning string")
    rows = [
        F.struct(
            F.lit(i).alias("place"), F.lit(op["column"]).alias("column"), F.lit(op["data_type"]).alias("data_type"),
            F.col(f"had_{i}").alias("converted"), F.col(f"lost_{i}").alias("lost"), F.lit(warning).alias("warning"),
        )
        for (i, op), warning in zip(casts, warnings_for(ops))
    ]
    return df.agg(*counts).select(F.inline(F.array(*rows)))


def schema_table(df: DataFrame, ops: Sequence[Operation]) -> DataFrame:
    """``schema_diff`` as rows (name, type, state, from, filled), with the number of rows in which the
    column has a value: after the operations, or before them for a dropped one."""
    after = apply_ops(df, ops)
    changes = schema_diff(df, after, ops)

    def counted(side: DataFrame, wanted: list[dict]) -> DataFrame | None:
        if not wanted:
            return None
        row = side.agg(*[F.count(F.col(f"`{c['name']}`")).alias(f"n{k}") for k, c in enumerate(wanted)])
        return row.select(F.inline(F.array(*[
            F.struct(
                F.lit(c["name"]).alias("name"), F.lit(c["type"]).alias("type"), F.lit(c["state"]).alias("state"),
                F.lit(c["from"]).cast("string").alias("from"), F.col(f"n{k}").alias("filled"),
            )
            for k, c in enumerate(wanted)
        ])))

    kept = counted(after, [c for c in changes if c["state"] != "dropped"])
    gone = counted(df, [c for c in changes if c["state"] == "dropped"])
    return gone if kept is None else kept if gone is None else kept.unionByName(gone)


@dataclass(frozen=True)
class Preview:
    before: DataFrame
    after: DataFrame
    warnings: list[str]
    schema: list[dict]


def preview(df: DataFrame, ops: Sequence[Operation], rows: int) -> Preview:
    """First rows before and after the operations, with warnings and the schema difference."""
    after = apply_ops(df, ops)
    return Preview(
        df.limit(rows), after.limit(rows), warnings_for(ops), schema_diff(df, after, ops)
    )
