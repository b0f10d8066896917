import pytest

from parlance.operators import transform


@pytest.fixture
def df(spark):
    return spark.sql(
        """select ' a ' as name, '12' as n, '{"city": "SP"}' as meta, cast(null as string) as e,
        timestamp '2024-03-05 10:20:00' as t
        union all select 'b', 'x', '{}', 'z', null"""
    )


def test_all_operations_in_order(df):
    ops = [
        {"op": "trim", "column": "name"},
        {"op": "rename_column", "column": "name", "new_name": "who"},
        {"op": "regex_replace", "column": "who", "pattern": "b", "replacement": ""},
        {"op": "cast_column", "column": "n", "data_type": "int"},
        {"op": "cast_column", "column": "n", "data_type": "string"},
        {"op": "json_extract", "column": "meta", "json_path": "$.city", "new_name": "city"},
        {"op": "coalesce", "column": "e", "source_columns": ["e", "city"]},
        {"op": "derive_column", "column": "size", "expression": "length(who)"},
        {"op": "date_format", "column": "t", "format": "yyyyMMdd"},
        {"op": "mask_pii", "column": "city"},
        {"op": "drop_column", "column": "meta"},
    ]
    after = transform.apply_ops(df, ops)
    assert after.columns == ["who", "n", "e", "t", "city", "size"]
    assert sorted(map(tuple, after.collect()), key=str) == [
        ("", None, "z", None, "[REDACTED]", 0),
        ("a", "12", "SP", "20240305", "[REDACTED]", 1),
    ]
    assert transform.apply_ops(df, [{"op": "filter_rows", "expression": "n = '12'"}]).count() == 1


def test_later_operations_see_the_new_name(df):
    ops = [
        {"op": "rename_column", "column": "name", "new_name": "x"},
        {"op": "rename_column", "column": "x", "new_name": "y"},
        {"op": "filter_rows", "expression": "y = 'b'"},
    ]
    assert transform.apply_ops(df, ops).count() == 1


@pytest.mark.parametrize(
    "op",
    [
        {"op": "explode"}, {"op": "drop_column"}, {"op": "rename_column", "column": "a"},
        {"op": "cast_column", "column": "a"}, {"op": "trim"},
        {"op": "regex_replace", "column": "a", "pattern": "x"},
        {"op": "derive_column", "column": "a"}, {"op": "filter_rows"},
        {"op": "date_format", "column": "a"},
        {"op": "json_extract", "column": "a", "json_path": "$.b"},
    ],
)
def test_incomplete_operations(df, op):
    with pytest.raises(ValueError):
        transform.apply_ops(df, [op])


def test_null_prone_types():
    prone = ["int", "integer", "double", "decimal(10,2)", "timestamp", "date", "boolean"]
    assert all(transform.is_null_prone(t) for t in prone)
    assert not any(transform.is_null_prone(t) for t in ("string", "varchar(50)", None))


def test_preview(df):
    ops = [
        {"op": "rename_column", "column": "name", "new_name": "who"},
        {"op": "drop_column", "column": "meta"},
        {"op": "cast_column", "column": "n", "data_type": "int"},
        {"op": "derive_column", "column": "k", "expression": "1"},
    ]
    shown = transform.preview(df, ops, 1)
    assert shown.before.count() == 1 and shown.after.count() == 1 and len(shown.warnings) == 1
    states = {c["name"]: (c["state"], c["from"]) for c in shown.schema}
    assert states == {
        "who": ("renamed", "name"), "n": ("kept", "n"), "e": ("kept", "e"), "t": ("kept", "t"),
        "k": ("derived", None), "meta": ("dropped", "meta"),
    }


def test_losses_of_casts(spark):
    df = spark.createDataFrame([("1", "x"), ("b", "2"), (None, "3"), ("4", None)], "a string, b string")
    ops = [
        {"op": "cast_column", "column": "a", "data_type": "int"},
        {"op": "rename_column", "column": "a", "new_name": "c"},
        {"op": "cast_column", "column": "c", "data_type": "string"},
        {"op": "cast_column", "column": "b", "data_type": "double"},
    ]
    got = [(r["place"], r["column"], r["converted"], r["lost"]) for r in transform.cast_losses(df, ops).collect()]
    assert got == [(0, "a", 3, 1), (3, "b", 3, 1)]
    assert transform.cast_losses(df, ops[1:2]).count() == 0
    found = {r["name"]: (r["state"], r["from"], r["filled"]) for r in transform.schema_table(df, ops[:2] + [{"op": "drop_column", "column": "b"}]).collect()}
    assert found == {"c": ("renamed", "a", 2), "b": ("dropped", "b", 3)}
