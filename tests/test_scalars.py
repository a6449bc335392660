import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillgrid.functions import scalars


def one(spark, value, dtype, function):
    return spark.createDataFrame([(value,)], f"v {dtype}").select(function(F.col("v"))).first()[0]


@pytest.mark.parametrize(
    "function, dtype, value, want",
    [
        (scalars.escape_markup, "string", "<b>A & B</b>", "&lt;b&gt;A &amp; B&lt;/b&gt;"),
        (scalars.display_number, "double", 1234.5, "1,234.5"),
        (scalars.display_number, "double", 1000000.0, "1,000,000"),
        (scalars.display_number, "double", 0.005, "0.01"),
        (scalars.display_number, "int", 100, "100"),
        (scalars.display_number, "double", -1234.567, "-1,234.57"),
        (scalars.export_name, "string", "/data/a b/sales.v-1.csv", "processed-sales.v-1.csv"),
        (scalars.snake_to_words, "string", "drop_duplicate_rows", "drop duplicate rows"),
        (scalars.clamp_percent, "int", 120, 100),
        (scalars.clamp_percent, "int", -3, 0),
        (scalars.half_even, "double", 0.5, 0.0),
        (scalars.half_even, "double", 1.5, 2.0),
        (lambda c: scalars.cut_text(c, 3), "string", "abcd", "abc..."),
        (lambda c: scalars.cut_text(c, 4), "string", "abcd", "abcd"),
        (lambda c: scalars.text_prefix(c, 2), "string", "abcd", "ab"),
        (lambda c: scalars.older_than(c, F.lit(5)), "int", None, False),
        (lambda c: scalars.older_than(c, F.lit(5)), "int", 4, True),
        (scalars.as_number, "string", " 12 ", 12.0),
        (scalars.as_number, "string", "-.5e1", -5.0),
        (scalars.as_number, "string", "1d", None),
        (scalars.as_number, "string", "NaN", None),
        (scalars.as_number, "string", "Infinity", None),
        (scalars.as_number, "string", "", None),
    ],
)
def test_scalar(spark, function, dtype, value, want):
    assert one(spark, value, dtype, function) == want


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.floats(allow_nan=False), min_size=60, max_size=120))
def test_double_text_is_the_shortest_form(spark, values):
    values = values + [1e7, 1e15, 1e16, 123456789.125, 1e-4, 9.999e-5, 0.00012, -0.0, 1e22, 5e-324]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    found = {r.i: r.t for r in df.select("i", scalars.double_text(F.col("v")).alias("t")).collect()}
    for i, v in enumerate(values):
        if abs(v) == float("inf"):
            continue
        assert float(found[i]) == v
        assert ("e" in found[i]) == ("e" in repr(v)), (found[i], repr(v))
        if "e" not in repr(v) and len(repr(v)) < 14:
            assert found[i] == repr(v)
