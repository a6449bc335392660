"""The data behind a chart: grouped series, shares, single figures, histograms and tables.

Two families share the aggregates. The strict one works on typed columns; the lenient one
reads numbers out of text. Every chart is one lazy plan: scan, filter, partial aggregate,
final aggregate over few rows, ordered limit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgrid.functions.columns import col, first_rows, is_numeric, type_of
from quillgrid.functions.scalars import (
    display_number,
    double_text,
    label_text,
    measure,
    value_text,
)
from quillgrid.operators.filters import apply_filters

# The chart kinds, the aggregations, and how many entries each chart shows.
CHART_TYPES = ("bar", "line", "pie", "histogram", "scatter", "table", "kpi")
AGGREGATIONS = ("sum", "mean", "count", "min", "max")
SERIES_GROUPS = 100
PIE_GROUPS = 20
TABLE_ROWS = 100
SHARE_SLICES = 8
BINS = 10
MISSING_LABEL = "nan"
UNKNOWN_LABEL = "Unknown"


def _aggregate(value: Column, dtype: T.DataType, aggregation: str) -> Column:
    """The aggregate over non-missing values; a sum over none is 0."""
    if aggregation not in AGGREGATIONS:
        raise ValueError(f"Unsupported aggregation: {aggregation}")
    if aggregation in ("sum", "mean") and not is_numeric(dtype):
        raise ValueError(f"A {aggregation} needs a numeric column.")
    if aggregation == "sum":
        return F.coalesce(F.sum(value), F.lit(0))
    return {"mean": F.avg, "count": F.count, "min": F.min, "max": F.max}[aggregation](value)


def _require(df: DataFrame, name: str | None, message: str) -> str:
    if not name or name not in df.columns:
        raise ValueError(message)
    return name


def grouped_series(
    df: DataFrame, x: str, y: str, aggregation: str | None = None, limit: int | None = SERIES_GROUPS
) -> DataFrame:
    """`label, value` per group in key order, the missing key last.

    Groups whose aggregate is missing are left out before the limit. Grouping and aggregate
    run on the key itself; only the shown groups are turned into text.
    """
    value = _aggregate(col(y), type_of(df, y), aggregation or "sum")
    groups = df.groupBy(col(x).alias("_key")).agg(value.alias("value"))
    shown = groups.filter(F.col("value").isNotNull())
    shown = first_rows(shown.orderBy(F.col("_key").asc_nulls_last()), limit)
    label = F.coalesce(value_text(F.col("_key"), type_of(df, x)), F.lit(MISSING_LABEL))
    return shown.select(label.alias("label"), "value")


def category_counts(df: DataFrame, x: str, limit: int | None = PIE_GROUPS) -> DataFrame:
    """The most frequent categories, missing ones counted under their text form."""
    dtype = type_of(df, x)

    def label(key: Column) -> Column:
        return F.coalesce(value_text(key, dtype), F.lit(MISSING_LABEL)).alias("label")

    if isinstance(dtype, T.StringType):
        counts = df.groupBy(label(col(x))).agg(F.count(F.lit(1)).alias("value"))
    else:
        # Count the keys themselves and turn only the distinct ones into text.
        groups = df.groupBy(col(x).alias("_key")).agg(F.count(F.lit(1)).alias("n"))
        counts = groups.groupBy(label(F.col("_key"))).agg(F.sum("n").alias("value"))
    return first_rows(counts.orderBy(F.col("value").desc(), F.col("label").asc()), limit)


def key_figure(df: DataFrame, column: str, aggregation: str | None = None, title: str = ""):
    """One row: the title and one aggregate of the column."""
    value = _aggregate(col(column), type_of(df, column), aggregation or "count")
    return df.agg(value.alias("value")).select(F.lit(title).alias("label"), "value")


def key_figures(df: DataFrame, column: str, titles: dict[str, str]) -> DataFrame:
    """A row for each title and its aggregate of the column, all from one scan, as doubles."""
    dtype = type_of(df, column)
    found = df.agg(
        *[_aggregate(col(column), dtype, a).alias(str(i)) for i, a in enumerate(titles.values())]
    )
    entries = [
        F.struct(F.lit(title).alias("label"), F.col(str(i)).cast("double").alias("value"))
        for i, title in enumerate(titles)
    ]
    return found.select(F.inline(F.array(*entries)))


def key_figures_lenient(df: DataFrame, column: str, aggregations: list[str]) -> DataFrame:
    """The same over the readable numbers of a column, each titled after itself."""
    slim = df.select(measure(col(column), type_of(df, column)).alias("value"))
    return key_figures(slim, "value", {f"{a} of {column}": a for a in aggregations})


def _rounded_edge(edge: Column, precision: Column) -> Column:
    """An edge at the given number of decimals, significant ones where it is below 1."""
    size = F.abs(edge)
    small = precision - 1 - F.floor(F.log10(size))
    scale = F.pow(F.lit(10.0), F.when(size < 1, small).otherwise(precision))
    return F.when(edge == 0, edge).otherwise(F.rint(edge * scale) / scale)


def _let(value: Column, use) -> Column:
    """Bind a value to a name inside an expression, so that it is computed once."""
    return F.get(F.transform(F.array(value), use), 0)


def _edge_labels(edges: Column) -> Column:
    """`(low, high]` labels; edges get the fewest decimals, at least three, that differ."""

    def rounded(all_edges: Column) -> Column:
        tries = F.transform(
            F.sequence(F.lit(3), F.lit(15)),
            lambda p: F.transform(all_edges, lambda e: _rounded_edge(e, p)),
        )
        apart = F.filter(tries, lambda t: F.size(F.array_distinct(t)) == BINS + 1)
        return F.transform(F.coalesce(F.get(apart, 0), all_edges), double_text)

    def intervals(texts: Column) -> Column:
        return F.transform(
            F.slice(texts, 1, BINS),
            lambda low, i: F.concat(F.lit("("), low, F.lit(", "), F.get(texts, i + 1), F.lit("]")),
        )

    return _let(edges, lambda e: _let(rounded(e), intervals))


def _bounds() -> Column:
    """The least value `lo`, the greatest `hi` and the number `n` of the values `v`."""
    return F.struct(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("v").alias("n"))


def _binned(df: DataFrame, value: Column, beyond, labels) -> DataFrame:
    """One row with the bounds `b`, the labels and the counts of the ten bins.

    The bounds enter the counting pass as a scalar subquery, and `beyond(v, b, i)` tells
    whether v is past the inner edge i. The pass is a single aggregate: it needs no join, and
    every task hands on one row.
    """
    values = df.select(value.alias("v"))
    bounds = values.agg(_bounds().alias("b")).scalar()
    counts = values.select("v", bounds.alias("b")).agg(
        _bounds().alias("b"),
        *[F.count_if(beyond(F.col("v"), F.col("b"), i)).alias(f"past{i}") for i in range(1, BINS)],
    )
    past = [F.col("b.n"), *[F.col(f"past{i}") for i in range(1, BINS)], F.lit(0)]
    in_bin = F.array(*[past[i] - past[i + 1] for i in range(BINS)])
    return counts.select("b", _let(F.col("b"), labels).alias("labels"), in_bin.alias("in_bin"))


def _label_rows(row: DataFrame, counts: Column) -> DataFrame:
    pairs = F.arrays_zip(F.col("labels"), counts.alias("value"))
    return row.select(F.inline(pairs)).toDF("label", "value")


def histogram(df: DataFrame, column: str) -> DataFrame:
    """Ten equal-width bins, closed on the right, with empty bins kept.

    The lowest edge is lowered by 0.1 % of the range so that the least value is inside. A
    column with one value spreads 0.1 % of it (0.001 at zero) to both sides.
    """
    if not is_numeric(type_of(df, column)):
        raise ValueError("A histogram needs a numeric column.")
    row = _binned(
        df,
        col(column).cast("double"),
        lambda v, b, i: v > b["lo"] + i * ((b["hi"] - b["lo"]) / BINS),
        _interval_labels,
    )
    middle = F.transform(
        F.sequence(F.lit(0), F.lit(BINS - 1)),
        lambda i: F.when(i == BINS // 2 - 1, F.col("b.n")).otherwise(F.lit(0)),
    )
    constant = F.col("b.lo") == F.col("b.hi")
    return _label_rows(row, F.when(constant, middle).otherwise(F.col("in_bin")))


def _interval_labels(b: Column) -> Column:
    """The ten bin labels from the bounds; no values at all is an error."""
    lo, hi = b["lo"], b["hi"]
    constant = lo == hi
    spread = F.when(lo == 0, 0.001).otherwise(F.abs(lo) * 0.001)
    first = F.when(constant, lo - spread).otherwise(lo)
    last = F.when(constant, hi + spread).otherwise(hi)
    lowest = F.when(constant, first).otherwise(first - (last - first) * 0.001)
    between = F.transform(
        F.sequence(F.lit(1), F.lit(BINS - 1)), lambda i: first + i * ((last - first) / BINS)
    )
    labels = _edge_labels(F.concat(F.array(lowest), between, F.array(last)))
    none = F.raise_error(F.lit("No values to count.")).cast("array<string>")
    return F.when(b["n"] == 0, none).otherwise(labels)


def histogram_lenient(df: DataFrame, column: str) -> DataFrame:
    """Ten bins closed on the left, the last one on both sides, over the readable numbers.

    One distinct value gives one bin, no value gives none.
    """

    def beyond(v: Column, b: Column, i: int) -> Column:
        width = F.nullif((b["hi"] - b["lo"]) / BINS, F.lit(0.0))
        return F.floor((v - b["lo"]) / width) >= i

    row = _binned(df, measure(col(column), type_of(df, column)), beyond, _range_labels)
    single = F.col("b.lo") == F.col("b.hi")
    counts = F.when(single, F.array("b.n")).otherwise(F.col("in_bin"))
    return _label_rows(row.filter("b.n > 0"), counts)


def _range_labels(b: Column) -> Column:
    """`start–end` labels, or the one value there is."""
    lo, hi = b["lo"], b["hi"]
    step = (hi - lo) / BINS
    whole = (lo == F.floor(lo)) & (F.abs(lo) < 1e15)
    single = F.when(whole, lo.cast("decimal(20,0)").cast("string")).otherwise(double_text(lo))
    labels = F.transform(
        F.sequence(F.lit(0), F.lit(BINS - 1)),
        lambda i: F.concat(
            display_number(lo + step * i),
            F.lit("–"),
            display_number(F.when(i == BINS - 1, hi).otherwise(lo + step * (i + 1))),
        ),
    )
    return F.when(lo == hi, F.array(single)).otherwise(labels)


def _lenient_aggregate(value: Column, aggregation: str) -> Column:
    return _aggregate(value, T.DoubleType(), aggregation)


def grouped_lenient(df: DataFrame, x: str, y: str, aggregation: str = "sum") -> DataFrame:
    """`label, value` per group over readable numbers; a missing key is `Unknown`.

    Sum and count keep groups without numbers, the others leave them out.
    """
    key = F.coalesce(label_text(col(x), type_of(df, x)), F.lit(UNKNOWN_LABEL))
    value = _lenient_aggregate(F.col("_value"), aggregation)
    slim = df.select(key.alias("label"), measure(col(y), type_of(df, y)).alias("_value"))
    groups = slim.groupBy("label").agg(value.alias("value"))
    return groups.filter(F.col("value").isNotNull()).orderBy("label")


def key_figure_lenient(df: DataFrame, column: str, aggregation: str = "count") -> DataFrame:
    """One aggregate over the readable numbers, titled after itself."""
    slim = df.select(measure(col(column), type_of(df, column)).alias("_value"))
    value = _lenient_aggregate(F.col("_value"), aggregation)
    return slim.agg(value.alias("value")).select(
        F.lit(f"{aggregation} of {column}").alias("label"), "value"
    )


def shares(
    series: DataFrame, order: list[Column] | None = None, limit: int | None = SHARE_SLICES
) -> DataFrame:
    """`label, value, percent` of the first slices, all with None, negatives counted as 0."""
    first = first_rows(series.orderBy(*order) if order else series, limit)
    slices = first.select("label", F.greatest(F.col("value"), F.lit(0)).alias("value"))
    total = slices.agg(F.sum("value")).scalar()
    percent = F.round(F.try_divide(F.col("value"), total) * 100, 1)
    return slices.withColumn("percent", F.coalesce(percent, F.lit(0.0)))


def table_rows(
    df: DataFrame, order: list[Column] | None = None, limit: int | None = TABLE_ROWS
) -> DataFrame:
    """The first rows by the given keys; without keys, any rows."""
    return first_rows(df.orderBy(*order) if order else df, limit)


def build_chart(df: DataFrame, spec: dict, order: list[Column] | None = None) -> DataFrame:
    """Chart data for a spec with `chart_type` and, as needed, `x_column`, `y_column`,
    `aggregation`, `filters` and `title`. `order` sorts the rows of a table chart. `limit` in
    the spec changes how many entries are shown; None shows all.
    """
    kind = spec.get("chart_type")
    if kind not in CHART_TYPES:
        raise ValueError(f"Unsupported chart type: {kind}")
    x, y, aggregation = spec.get("x_column"), spec.get("y_column"), spec.get("aggregation")
    rows = apply_filters(df, spec.get("filters"))
    if kind == "table":
        return table_rows(rows, order, spec.get("limit", TABLE_ROWS))
    if kind == "kpi":
        column = _require(df, y or x, "No such value column.")
        return key_figure(rows, column, aggregation, spec.get("title", ""))
    x = _require(df, x, "No such x column.")
    if kind == "histogram":
        return histogram(rows, x)
    if kind == "pie":
        if y in df.columns:
            return grouped_series(rows, x, y, aggregation, spec.get("limit", PIE_GROUPS))
        return category_counts(rows, x, spec.get("limit", PIE_GROUPS))
    y = _require(df, y, "No such y column.")
    return grouped_series(rows, x, y, aggregation, spec.get("limit", SERIES_GROUPS))


def build_chart_lenient(
    df: DataFrame,
    x: str,
    y: str,
    aggregation: str,
    kind: str = "bar",
    order: list[Column] | None = None,
    limit: int | None = TABLE_ROWS,
) -> DataFrame:
    """Chart data with numbers read out of text; `limit` is for tables, None shows all rows."""
    if kind == "table":
        return table_rows(df, order, limit)
    if kind == "kpi":
        return key_figure_lenient(df, y, aggregation)
    if kind == "histogram":
        return histogram_lenient(df, y)
    return grouped_lenient(df, x, y, aggregation)
