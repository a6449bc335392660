import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillgrid.plans import charts

CATEGORIES = [("Computers", 200), ("Computers", 50), ("Furniture", 75)]


def test_bar_sums(spark, rows):
    df = spark.createDataFrame([("South", 100), ("South", 50), ("North", 80)], "region string, revenue int")
    spec = {"chart_type": "bar", "x_column": "region", "y_column": "revenue", "aggregation": "sum"}
    assert rows(charts.build_chart(df, spec)) == [("North", 80), ("South", 150)]


@pytest.mark.parametrize(
    "aggregation, expected",
    [
        ("mean", [("Filled", 5.0)]),
        ("min", [("Filled", 5.0)]),
        ("max", [("Filled", 5.0)]),
        ("sum", [("Empty", 0.0), ("Filled", 5.0)]),
        ("count", [("Empty", 0), ("Filled", 1)]),
    ],
)
def test_groups_without_values(spark, rows, aggregation, expected):
    df = spark.createDataFrame(
        [("Empty", None), ("Empty", None), ("Filled", 5.0)], "region string, revenue double"
    )
    assert rows(charts.grouped_series(df, "region", "revenue", aggregation)) == expected


def test_missing_key_is_last(spark, rows):
    df = spark.createDataFrame([(None, 1), ("b", 2), ("a", 3)], "k string, v int")
    assert rows(charts.grouped_series(df, "k", "v")) == [("a", 3), ("b", 2), ("nan", 1)]


def test_group_labels_keep_number_order(spark, rows):
    df = spark.createDataFrame([(10.0, 1), (9.5, 1), (100.0, 1)], "k double, v int")
    assert [r[0] for r in rows(charts.grouped_series(df, "k", "v"))] == ["9.5", "10.0", "100.0"]


def test_limits(spark):
    df = spark.range(300).select(F.col("id").alias("k"), F.lit(1).alias("v"))
    assert charts.grouped_series(df, "k", "v").count() == 100
    pie = charts.build_chart(df, {"chart_type": "pie", "x_column": "k", "y_column": "v"})
    assert [int(r.label) for r in pie.collect()] == list(range(20))
    assert charts.build_chart(df, {"chart_type": "pie", "x_column": "k"}).count() == 20
    assert charts.build_chart(df, {"chart_type": "table"}).count() == 100


def test_kpi_of_missing_values(spark, rows):
    df = spark.createDataFrame([(None,), (None,)], "revenue double")
    spec = {"chart_type": "kpi", "y_column": "revenue", "title": "Revenue"}
    assert rows(charts.build_chart(df, spec | {"aggregation": "mean"})) == [("Revenue", None)]
    assert rows(charts.build_chart(df, spec | {"aggregation": "sum"})) == [("Revenue", 0.0)]
    assert rows(charts.build_chart(df, spec)) == [("Revenue", 0)]


def test_chart_errors(spark):
    df = spark.createDataFrame([("a", 1)], "k string, v int")
    for spec, message in [
        ({"chart_type": "radar"}, "Unsupported chart type"),
        ({"chart_type": "bar", "x_column": "none", "y_column": "v"}, "No such x"),
        ({"chart_type": "bar", "x_column": "k", "y_column": "none"}, "No such y"),
        ({"chart_type": "kpi", "y_column": "none"}, "No such value"),
        ({"chart_type": "bar", "x_column": "v", "y_column": "k", "aggregation": "sum"}, "numeric"),
    ]:
        with pytest.raises(ValueError, match=message):
            charts.build_chart(df, spec)


def expected_histogram(values):
    counts = pd.cut(pd.Series(values, dtype="float64"), bins=10).value_counts().sort_index()
    return [(str(label), int(n)) for label, n in counts.items()]


@pytest.mark.parametrize(
    "values",
    [
        list(range(1, 101)),
        [0.0, 0.01, 0.02, 0.03, 0.04, 0.05, 0.06, 0.07, 0.08, 0.09, 0.1],
        [-5.0, 0.0, 12345678.9],
        [1e-5, 2e-5, 9e-5],
        [100000.0, 100000.001, 100000.002],
        [0.0] * 4,
        [7.5] * 3,
        [-3.0] * 2,
    ],
)
def test_histogram_bins(spark, rows, values):
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
    assert rows(charts.histogram(df, "v")) == expected_histogram(values)


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.floats(-1e6, 1e6).map(lambda x: round(x, 3)), min_size=2, max_size=40))
def test_histogram_counts_of_random_values(spark, rows, values):
    if len(set(values)) < 2:
        return
    df = spark.createDataFrame([(v,) for v in values], "v double")
    low, high = min(values), max(values)
    edges = np.linspace(low, high, 11)
    edges[0] -= (high - low) * 0.001
    codes = np.clip(np.searchsorted(edges, values, side="left") - 1, 0, 9)
    want = np.bincount(codes, minlength=10).tolist()
    assert [r[1] for r in rows(charts.histogram(df, "v"))] == want


def test_histogram_without_values(spark):
    with pytest.raises(Exception, match="No values"):
        charts.histogram(spark.createDataFrame([(None,)], "v double"), "v").collect()
    assert charts.histogram_lenient(spark.createDataFrame([(None,)], "v double"), "v").count() == 0


def test_lenient_histogram(spark, rows):
    df = spark.createDataFrame([("200",), ("50",), ("75",), ("n/a",), (None,)], "total string")
    found = rows(charts.histogram_lenient(df, "total"))
    assert len(found) == 10 and sum(n for _, n in found) == 3
    assert found[0] == ("50–65", 1) and found[-1] == ("185–200", 1)
    same = spark.createDataFrame([(4,), (4,)], "v int")
    assert rows(charts.histogram_lenient(same, "v")) == [("4", 2)]


def test_lenient_groups(spark, rows):
    df = spark.createDataFrame(CATEGORIES + [("Services", None)], "category string, total int")
    expect = {
        "sum": [("Computers", 250.0), ("Furniture", 75.0), ("Services", 0.0)],
        "count": [("Computers", 2), ("Furniture", 1), ("Services", 0)],
        "mean": [("Computers", 125.0), ("Furniture", 75.0)],
        "min": [("Computers", 50.0), ("Furniture", 75.0)],
        "max": [("Computers", 200.0), ("Furniture", 75.0)],
    }
    for aggregation, want in expect.items():
        assert rows(charts.build_chart_lenient(df, "category", "total", aggregation)) == want


def test_lenient_unknown_key(spark, rows):
    df = spark.createDataFrame([(None, "1"), ("a", "x")], "k string, v string")
    assert rows(charts.grouped_lenient(df, "k", "v", "sum")) == [("Unknown", 1.0), ("a", 0.0)]


def test_lenient_kpi(spark, rows):
    df = spark.createDataFrame(CATEGORIES, "category string, total int")
    figure = charts.build_chart_lenient(df, "category", "total", "min", "kpi")
    assert rows(figure) == [("min of total", 50.0)]
    empty = spark.createDataFrame([("x", None)], "category string, total int")
    assert rows(charts.key_figure_lenient(empty, "total", "mean")) == [("mean of total", None)]
    assert rows(charts.key_figure_lenient(empty, "total", "sum")) == [("sum of total", 0.0)]


def test_shares(spark, rows):
    series = spark.createDataFrame(
        [("Computers", 250.0), ("Furniture", 75.0), ("Loss", -10.0)], "label string, value double"
    )
    found = rows(charts.shares(series, [F.col("label")]))
    assert found == [("Computers", 250.0, 76.9), ("Furniture", 75.0, 23.1), ("Loss", 0.0, 0.0)]
    nothing = spark.createDataFrame([("a", -1.0)], "label string, value double")
    assert rows(charts.shares(nothing)) == [("a", 0.0, 0.0)]


def test_limits_can_be_lifted(spark):
    df = spark.range(300).selectExpr("id AS k", "id AS v")
    for kind, shown in (("bar", 100), ("pie", 20), ("table", 100)):
        spec = {"chart_type": kind, "x_column": "k", "y_column": "v"}
        assert charts.build_chart(df, spec).count() == shown
        assert charts.build_chart(df, spec | {"limit": 7}).count() == 7
        assert charts.build_chart(df, spec | {"limit": None}).count() == 300
