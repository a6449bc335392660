import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillgrid.plans import profile, report

SALES = [
    (1001, "2026-01-03", "Ada", 240.0),
    (1002, "2026-01-04", "Ben", 99.5),
    (1002, "2026-01-04", "Ben", 99.5),
    (1003, "2026-01-05", "Cem", None),
    (1004, "2026-01-06", "Dia", 75.25),
    (1005, "2026-01-07", "Eva", 310.0),
]
SALES_SCHEMA = "order_id int, order_date string, customer string, total double"


def test_summary_and_penalty(spark, rows):
    df = spark.createDataFrame(SALES, SALES_SCHEMA)
    assert rows(profile.penalty_score(df)) == [(1, 1, 92)]
    found = profile.summary(df).first()
    assert (found.rows, found.columns, found.duplicate_rows, found.missing_cells) == (6, 4, 1, 1)
    score = max(0, round(100 - 1 / 24 * 60 - 1 / 6 * 40))
    assert (found.missing_percentage, found.quality_score) == (round(100 / 24, 2), score)


def test_empty_table(spark, rows):
    df = spark.createDataFrame([], "a int, b string")
    found = profile.summary(df).first()
    assert (found.rows, found.duplicate_rows, found.missing_cells, found.quality_score) == (0, 0, 0, 100)
    listed = profile.column_profile(df).orderBy("position").collect()
    assert [(r.column, r.unique_count, r["mean"]) for r in listed] == [("a", 0, None), ("b", 0, None)]


def test_empty_text_counts_as_missing_in_penalty(spark, rows):
    df = spark.createDataFrame([("", 1), (None, 2)], "t string, n int")
    assert rows(profile.penalty_score(df)) == [(0, 2, 94)]


def test_correlation_limit(spark, rows):
    df = spark.createDataFrame([(1, 2, 3), (2, 4, 6)], "one int, two int, three int")
    found = profile.correlations(df, limit=2)
    assert sorted(rows(found)) == [
        ("one", "one", 1.0), ("one", "two", 1.0), ("two", "one", 1.0), ("two", "two", 1.0)
    ]
    assert rows(profile.correlation_width(df, 2)) == [(2, 1)]
    assert profile.correlations(df.select("one")).count() == 0


def test_correlations_of_gaps_and_constants(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"a": rng.normal(1e6, 2, 400), "b": rng.normal(0, 1, 400)})
    pdf["c"] = pdf["a"] * -0.5 + rng.normal(0, 1, 400)
    pdf["flat"] = 7.3
    pdf.loc[::3, "b"] = None
    pdf.loc[::5, "c"] = None
    columns = list(pdf.columns)
    records = [tuple(None if pd.isna(v) else float(v) for v in r) for r in pdf.itertuples(index=False)]
    df = spark.createDataFrame(records, ", ".join(f"{c} double" for c in columns)).repartition(5)
    found = {(r.column_a, r.column_b): r.correlation for r in profile.correlations(df).collect()}
    want = pdf.corr().round(4)
    for a in columns:
        for b in columns:
            expected = want.loc[a, b]
            if "flat" in (a, b):
                assert found[a, b] is None
            else:
                assert found[a, b] == pytest.approx(expected, abs=1e-9)


def reference_stats(values):
    clean = pd.Series(values, dtype="float64").dropna()
    q1, q2, q3 = clean.quantile([0.25, 0.5, 0.75])
    span = 1.5 * (q3 - q1)
    outliers = int(((clean < q1 - span) | (clean > q3 + span)).sum())
    return q1, q2, q3, outliers


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    st.lists(st.one_of(st.none(), st.integers(-50, 50), st.integers(-(10**9), 10**9)), max_size=60),
    st.floats(-1e3, 1e3).map(lambda x: round(x, 2)),
)
def test_quartiles_of_random_values(spark, values, scale):
    numbers = [None if v is None else v * scale for v in values]
    df = spark.createDataFrame([(v,) for v in numbers], "v double")
    found = profile.column_quartiles(df).collect()
    if not any(v is not None for v in numbers):
        assert found == []
        return
    q1, q2, q3, _ = reference_stats(numbers)
    assert (found[0].q1, found[0].median, found[0].q3) == pytest.approx((q1, q2, q3), rel=1e-12)


def test_quartiles_do_not_depend_on_the_cuts(spark):
    """One value holds a third of all rows, and the cuts are far off."""
    values = [5] * 400 + list(range(800))
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    counts = profile._value_counts(df, [F.col("v")])
    q1, q2, q3, _ = reference_stats(values)
    for cuts in ([0, 0, 0, 0, 0, 0], [-1, 5, 5, 5, 900, 901], [1, 2, 3, 4, 5, 6]):
        frame = spark.createDataFrame(
            [(0, *map(float, cuts))],
            "column int, " + ", ".join(f"cut{i} double" for i in range(6)),
        )
        for region_rows in (1, 7, 100, 10_000):
            if region_rows > 1 or cuts[0] == 1:
                assert profile.exact_quartiles(counts, frame, region_rows) == {0: (q1, q2, q3)}


def test_column_profile(spark):
    values = [None, 1, 2, 2, 3, 4, 4, 4, 5, 400]
    df = spark.createDataFrame(
        [(v, None, "x" if v else None, bool(v), {"k": v or 0}) for v in values],
        "n int, nothing double, t string, b boolean, m map<string,int>",
    ).withColumn("d", F.col("n").cast("decimal(10,2)"))
    for exact in (True, False):
        if not exact:
            df = df.drop("m")
        found = {r.column: r for r in profile.column_profile(df, exact).collect()}
        _, median, _, outliers = reference_stats(values)
        for name in ("n", "d"):
            r = found[name]
            assert (r.missing_count, r.missing_percentage, r.unique_count) == (1, 10.0, 6)
            assert (r.outlier_count, r["mean"]) == (outliers, round(425 / 9, 4))
            assert exact is False or r.median == median
        r = found["nothing"]
        assert (r.missing_count, r.unique_count, r.outlier_count, r.median) == (10, 0, None, None)
        assert (found["t"].unique_count, found["t"].outlier_count) == (1, None)
        assert (found["b"].unique_count, found["b"]["mean"]) == (2, None)


def test_distinct_counts_of_large_integers_and_long_text(spark):
    big = 2**60
    long = "x" * 500
    df = spark.createDataFrame(
        [(big, long + "a"), (big + 1, long + "b"), (big + 1, long + "b")], "n bigint, t string"
    )
    found = {r.column: r.unique_count for r in profile.distinct_counts(df).collect()}
    assert found == {"n": 2, "t": 2}


def test_duplicates_survive_hash_collisions(spark, monkeypatch):
    """With one hash for all rows the count must still be exact."""
    df = spark.createDataFrame(
        [("a" * 40, "b", i // 2) for i in range(10)] + [(None, "b", 1)] * 3,
        "x string, y string, z int",
    )
    assert profile.duplicate_rows(df).first()[0] == 7
    monkeypatch.setattr(profile.F, "xxhash64", lambda *c: F.lit(1).cast("bigint"))
    assert profile.duplicate_rows(df).first()[0] == 7


def test_suggestions(spark, rows):
    df = spark.createDataFrame([(1, None), (1, None), (2, "x")], "a int, b string")
    assert [r.suggestion for r in profile.suggestions_for(df).orderBy("position").collect()] == [
        "Remove duplicate rows.",
        "Review column 'b' because more than 20% of its values are missing.",
    ]
    lines = report.recommendations(df).orderBy("position").collect()
    assert [r.line[:2] for r in lines] == ["- ", "- "]


def test_report_width(spark):
    df = spark.range(3).select(*[F.col("id").alias(f"c{i}") for i in range(30)])
    found = report.column_quality(df)
    assert found.count() == 25
    assert {r.metric: r.value for r in report.executive_summary(df).collect()} == {
        "Rows": "3", "Columns": "30", "Duplicates": "0", "Missing data": "0.0%"
    }


def test_no_task_sorts_more_than_a_region(spark, monkeypatch):
    """Whatever the first cuts leave, regions are cut until they are small."""
    sorted_rows = []
    sort = profile._sorted_out

    def spy(kept, wanted):
        sorted_rows.extend(r["count"] for r in kept.groupBy("column", "region").count().collect())
        return sort(kept, wanted)

    monkeypatch.setattr(profile, "_sorted_out", spy)
    df = spark.range(30_000).select(F.pmod(F.xxhash64("id"), F.lit(10**6)).cast("double").alias("v"), (F.col("id") % 9).cast("double").alias("w"))
    values = df.toPandas()
    counts = profile._value_counts(df, [F.col("v"), F.col("w")])
    cuts = spark.createDataFrame([(0, -1.0), (1, 99.0)], "column int, cut0 double")
    found = profile.exact_quartiles(counts, cuts, region_rows=50)
    assert found == {i: tuple(values[c].quantile(p) for p in (0.25, 0.5, 0.75)) for i, c in enumerate("vw")}
    assert len(sorted_rows) >= 4 and max(sorted_rows) <= 50


def test_profile_counts_missing_and_duplicates_once(spark, monkeypatch):
    calls = []
    for name in ("_missing", "duplicate_rows"):
        monkeypatch.setattr(profile, name, lambda df, f=getattr(profile, name), n=name: calls.append(n) or f(df))
    found = profile.profile(spark.createDataFrame([(1, None), (1, None), (2, "x")], "a int, b string"), limit=None)
    for part in (found.summary, found.columns, found.suggestions, found.correlations, found.correlation_width):
        part.collect()
    assert sorted(calls) == ["_missing", "duplicate_rows"]
    assert found.summary.first()["duplicate_rows"] == 1
    assert [r["suggestion"] for r in found.suggestions.orderBy("position").collect()][0] == "Remove duplicate rows."


def test_nested_times_a_microsecond_apart_differ(spark):
    df = spark.sql(
        "SELECT array(timestamp '2024-01-01 00:00:00.000001') t, named_struct('a', NULL, 'b', 1) s"
        " UNION ALL SELECT array(timestamp '2024-01-01 00:00:00.000002'), named_struct('a', 1, 'b', NULL)"
    )
    got = {r["column"]: r["unique_count"] for r in profile.distinct_counts(df).collect()}
    assert got == {"t": 2, "s": 2}


def test_duplicates_by_digest(spark):
    rows = [(None, "a", 0.0), ("a", None, 0.0), (None, "a", -0.0), ("", "a", 0.0), (None, "a", float("nan"))]
    df = spark.createDataFrame(rows, "x string, y string, z double")
    assert profile.duplicate_rows(df).first()[0] == 1
    plan = profile.duplicate_rows(df)._jdf.queryExecution().executedPlan().toString()
    shuffled = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert len(shuffled) == 1 and "hashpartitioning(_groupingexpression" in shuffled[0]


def test_the_sketch_is_compared_without_one_list_of_all_values(spark, tmp_path, monkeypatch):
    """`percentile` brings every distinct value of a column to one task."""
    from quillgrid.suite import QUERIES, load_all, profiles

    load_all()
    numbers = profiles.LINEITEM_NUMBERS
    items = spark.range(3_000).select(
        *[
            F.when(F.col("id") % 11 != i, F.pmod(F.xxhash64("id", F.lit(i)), F.lit(40 * (i + 1)))).alias(c)
            for i, c in enumerate(numbers)
        ],
        F.lit("A").alias("l_returnflag"), F.lit("F").alias("l_linestatus"), F.current_date().alias("l_shipdate"),
    )
    items = items.withColumn("l_tax", F.lit(None).cast("double"))
    items.write.parquet(str(tmp_path / "lineitem.parquet"))
    asked = (0.48, 0.52, 0.999)
    found = {r["column"]: r["values"] for r in profile.column_quantiles(items, asked).collect()}
    values = items.select(*numbers).toPandas().astype("float64")
    expected = {c: [values[c].quantile(p) for p in asked] for c in numbers if c != "l_tax"}
    assert found.keys() == expected.keys()
    for c, v in expected.items():
        assert found[c] == pytest.approx(v, rel=1e-12)

    monkeypatch.setattr(F, "percentile", lambda *_: pytest.fail("one task sees all values"))
    rows = {r["column"]: tuple(r)[1:] for r in QUERIES["profile_sketch_is_close"](spark, str(tmp_path)).collect()}
    assert set(rows) == set(profiles.LINEITEM_COLUMNS)
    for c, r in rows.items():
        assert r == ((True, True, True, True) if c in expected else (True, True, None, None))
