import pytest

from quillgrid.operators import cleaning
from quillgrid.plans import profile

ORDERS = [(1, 10), (1, 10), (2, None)]


@pytest.fixture
def orders(spark):
    return spark.createDataFrame(ORDERS, "order_id int, total int")


def test_drop_duplicates(spark, orders):
    assert sorted(map(tuple, cleaning.drop_duplicates(orders).collect())) == [(1, 10), (2, None)]
    nan = float("nan")
    odd = spark.createDataFrame([(nan,), (nan,), (None,), (0.0,), (-0.0,)], "v double")
    assert cleaning.drop_duplicates(odd).count() == 2
    maps = spark.sql("SELECT map('a', 1, 'b', 2) m UNION ALL SELECT map('b', 2, 'a', 1)")
    kept = cleaning.drop_duplicates(maps)
    assert kept.count() == 1 and kept.schema == maps.schema


def test_checked_steps(orders):
    for step, message in [
        (("drop_columns", {"columns": ["x"]}), "no column named x"),
        (("rename_columns", {"mapping": {"x": "y"}}), "no column named x"),
        (("rename_columns", {"mapping": {"total": "order_id"}}), "the same name"),
        (("fill_nulls", {"values": {"x": 1}}), "no column named x"),
        (("cast_types", {"mapping": {"x": "string"}}), "no column named x"),
        (("cast_types", {"mapping": {"total": "complex"}}), "Unsupported type"),
        (("sort", {}), "No such cleaning step"),
        (("drop_columns", {"columns": ["order_id", "total"]}), "No column"),
    ]:
        with pytest.raises(ValueError, match=message):
            cleaning.apply_operation(orders, *step)


def test_swap_names(orders):
    swapped = cleaning.rename_columns(orders, {"total": "order_id", "order_id": "total"})
    assert swapped.columns == ["total", "order_id"]


def test_fill_keeps_or_widens_the_type(orders, rows):
    kept = cleaning.fill_nulls(orders, {"total": 25})
    assert rows(kept)[2] == (2, 25) and dict(kept.dtypes)["total"] == "int"
    wider = cleaning.fill_nulls(orders, {"total": 0.5})
    assert rows(wider) == [(1, 10.0), (1, 10.0), (2, 0.5)]
    text = cleaning.fill_nulls(orders, {"total": "none"})
    assert [r[1] for r in rows(text)] == ["10", "10", "none"]


def test_strict_casts(spark, orders, rows):
    assert rows(cleaning.cast_types(orders, {"total": "float64"}))[2] == (2, None)
    assert rows(cleaning.cast_types(orders, {"total": "string"}))[0] == (1, "10")
    assert rows(cleaning.cast_types(orders, {"total": "Int64"}))[2] == (2, None)
    with pytest.raises(Exception, match="missing values"):
        cleaning.cast_types(orders, {"total": "int64"}).collect()
    for bad in ("abc", "1d", ""):
        df = spark.createDataFrame([(bad,)], "t string")
        with pytest.raises(Exception):
            cleaning.cast_types(df, {"t": "float64"}).collect()
    df = spark.createDataFrame([("abc",)], "t string")
    with pytest.raises(Exception):
        cleaning.cast_types(df, {"t": "int64"}).collect()


def test_lenient_steps(orders, rows):
    assert rows(cleaning.fill_nulls_lenient(orders, "total", "25"))[2] == (2, 25)
    assert rows(cleaning.fill_nulls_lenient(orders, "total"))[2] == (2, 0)
    assert rows(cleaning.cast_lenient(orders, "total"))[0] == (1, "10")
    text = cleaning.fill_nulls(orders, {"total": "oops"})
    assert rows(cleaning.cast_lenient(text, "total", "number")) == [
        (1, 10.0), (1, 10.0), (2, None)
    ]


def test_lenient_text_of_doubles(spark, rows):
    values = [1.0, -3.0, 0.5, 1e20, 1e21, 1e-7, 1.5e-5, 12345678.25, -0.0, None]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r[0] for r in rows(cleaning.cast_lenient(df, "v"))] == [
        "1", "-3", "0.5", "100000000000000000000", "1e+21", "1e-7", "0.000015", "12345678.25", "0", None,
    ]



def test_steps_in_order(orders, rows):
    steps = [
        {"operation": "drop_duplicates"},
        {"operation": "fill_nulls", "parameters": {"values": {"total": 25}}},
        {"operation": "rename_columns", "parameters": {"mapping": {"total": "revenue"}}},
        {"operation": "cast_types", "parameters": {"mapping": {"revenue": "string"}}},
    ]
    done = cleaning.apply_steps(orders, steps)
    assert done.columns == ["order_id", "revenue"]
    assert sorted(rows(done)) == [(1, "10"), (2, "25")]


def test_maps_are_compared_by_their_entries(spark):
    import datetime as dt

    a, b = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 1, 0, 0, 0, 1)
    rows = [
        ({"x": a, "y": b}, [{"m": 1}]), ({"y": b, "x": a}, [{"m": 1}]), ({"x": b, "y": b}, [{"m": 1}]),
        ({"x": a, "y": b}, [{"m": 2}]), (None, None), (None, None),
    ]
    df = spark.createDataFrame(rows, "times map<string,timestamp>, key array<map<string,int>>")
    assert cleaning.drop_duplicates(df).columns == ["times", "key"]
    assert cleaning.drop_duplicates(df).count() == 4
    assert profile.duplicate_rows(df).first()[0] == 2
    assert {r["column"]: r["unique_count"] for r in profile.distinct_counts(df).collect()} == {"times": 2, "key": 2}
