import pytest

from quillgrid.functions.columns import nan_to_null
from quillgrid.operators import columns
from quillgrid.operators.filters import apply_filters


def test_contains_is_literal(spark, rows):
    df = spark.createDataFrame([("a.b",), ("axb",), (None,)], "label string")
    assert rows(apply_filters(df, {"label": {"contains": "."}})) == [("a.b",)]
    assert rows(apply_filters(df, {"label": {"contains": "A"}})) == [("a.b",), ("axb",)]
    assert rows(apply_filters(df, {"label": {"contains": "none"}})) == []


def test_contains_on_numbers(spark, rows):
    df = spark.createDataFrame([(1e7,), (2.5,)], "v double")
    assert rows(apply_filters(df, {"v": {"contains": "10000000.0"}})) == [(1e7,)]


def test_missing_never_matches(spark, rows):
    df = nan_to_null(spark.createDataFrame([(float("nan"),), (None,), (2.0,)], "v double"))
    for rule in ({"gte": 1}, {"lte": 5}, {"eq": 2}):
        assert rows(apply_filters(df, {"v": rule})) == [(2.0,)]


def test_rules_of_other_types(spark, rows):
    df = spark.createDataFrame([("5", 5), ("x", 6)], "t string, n int")
    assert rows(apply_filters(df, {"t": {"eq": 5}})) == []
    assert rows(apply_filters(df, {"n": {"eq": "5"}})) == []
    with pytest.raises(ValueError, match="compared"):
        apply_filters(df, {"t": {"gte": 5}})


def test_unknown_columns_and_rules_are_ignored(spark):
    df = spark.createDataFrame([(1,), (2,)], "v int")
    assert apply_filters(df, {"w": {"eq": 1}, "v": 1}).count() == 2
    assert apply_filters(df, {}).count() == 2


def test_odd_column_names(spark, rows):
    df = spark.createDataFrame([(1, 2)], "`a.b` int, `c``d` int")
    assert rows(apply_filters(df, {"a.b": {"eq": 1}, "c`d": {"gte": 2}})) == [(1, 2)]


def test_preview_cells(spark, rows):
    df = spark.createDataFrame([("abcdefgh", 1)], "visible string, hidden int")
    shown, hidden = columns.truncate_columns(df, 1)
    assert rows(columns.preview_cells(shown, 4)) == [("abcd...",)] and hidden == 1
    df = spark.sql(
        "SELECT X'010203' AS b, TIMESTAMP_NTZ'2024-01-02 03:04:05' AS t, DATE'2024-01-02' AS d,"
        " TIMESTAMP'2024-01-02 03:04:05.5' AS f, CAST(NULL AS STRING) AS n"
    )
    assert rows(columns.preview_cells(df)) == [
        ("<binary value: 3 bytes>", "2024-01-02T03:04:05", "2024-01-02",
         "2024-01-02T03:04:05.500000", None)
    ]


def test_search_columns(spark):
    df = spark.createDataFrame([(1, 2, 3)], "UserName int, user_id int, total int")
    assert columns.search_columns(df, "USER").columns == ["UserName", "user_id"]
