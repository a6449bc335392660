"""Profiling a table: shape, columns, duplicates, correlations, score and suggestions.

What grows with the data is kept out of single tasks. Exact distinct counts and exact
quartiles both come from one shuffled table of value counts, `column, value, n`:

* distinct values are its rows,
* quartiles are found by rank: a sample gives two cut points close around each quartile, the
  counts between the cuts say which region holds the wanted rank, and regions of more than
  REGION_ROWS rows are cut again. The cuts only set the size of a region; whatever they are, the
  value found is exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgrid.functions.columns import (
    col,
    comparable,
    is_floating,
    is_numeric,
    numeric_columns,
    type_of,
)
from quillgrid.functions.scalars import half_even
from quillgrid.session import checkpointed

# How many numeric columns are correlated, and the limits that trigger advice.
CORRELATION_COLUMNS = 50
MISSING_ADVICE_PERCENT = 20
OUTLIER_SPAN = 1.5
NOISE = 1e-14
QUARTILES = (0.25, 0.5, 0.75)

# The sketch's accuracy: its ranks are off by at most rows / SKETCH_ACCURACY.
SKETCH_ACCURACY = 10_000
# Which share of the rows the first cuts around quartiles are sketched from, and how far from the
# quartile they are, as a share of the rows.
CUT_SAMPLE, CUT_MARGIN = 0.05, 0.005
# The most rows of a region that one task sorts, and into how many parts a larger one is cut.
REGION_ROWS = 200_000
CUTS_AGAIN = 64
LONG_TEXT_BYTES = 64


# JSON in which different values differ: missing fields are written, times to the microsecond.
EXACT_JSON = {
    "ignoreNullFields": "false",
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}


def schema_listing(df: DataFrame) -> DataFrame:
    """`position, column, type`, one row per column, without reading any data."""
    rows = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "position int, column string, type string")


def _missing(df: DataFrame) -> DataFrame:
    """One row: `rows` and the missing count of every column, named by position."""
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[(F.count(F.lit(1)) - F.count(col(c))).alias(str(i)) for i, c in enumerate(df.columns)],
    )


def missing_values(df: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """`column, missing_count, missing_percentage`, counted in one pass, or before."""
    counts = _missing(df) if counts is None else counts
    entries = F.array(
        *[
            F.struct(F.lit(c).alias("column"), F.col(str(i)).alias("missing_count"))
            for i, c in enumerate(df.columns)
        ]
    )
    long = counts.select("rows", F.inline(entries))
    share = F.col("missing_count") * 100.0 / F.greatest("rows", F.lit(1))
    return long.select("column", "missing_count", half_even(share, 2).alias("missing_percentage"))


def _comparable_text(value: Column, dtype: T.DataType) -> Column:
    """A short text that is equal exactly for equal values; long text becomes its SHA-256."""
    if isinstance(dtype, (T.ArrayType, T.StructType, T.MapType)):
        value = F.to_json(comparable(value, dtype), EXACT_JSON)
    elif isinstance(dtype, T.BinaryType):
        value = F.hex(value)
    elif not isinstance(dtype, T.StringType):
        return value.cast("string")
    digest = F.concat(F.lit("sha256:"), F.sha2(value, 256))
    return F.when(F.octet_length(value) <= LONG_TEXT_BYTES, value).otherwise(digest)


def _value_kinds(df: DataFrame, columns: list[str]) -> list[list[Column]]:
    """The columns, grouped by the type their values can be counted in without loss."""
    kinds: dict[str, list[Column]] = {"bigint": [], "double": [], "string": []}
    for name in columns:
        dtype = type_of(df, name)
        if isinstance(dtype, T.IntegralType):
            kinds["bigint"].append(col(name).cast("bigint").alias(name))
        elif is_floating(dtype):
            kinds["double"].append(col(name).cast("double").alias(name))
        else:
            kinds["string"].append(_comparable_text(col(name), dtype).alias(name))
    return [columns for columns in kinds.values() if columns]


def _value_counts(df: DataFrame, columns: list[Column]) -> DataFrame:
    """`column, value, n`: how often every value occurs; a column is its place in the list."""
    slim = df.select(*columns).toDF(*[str(i) for i in range(len(columns))])
    long = slim.unpivot([], [col(c) for c in slim.columns], "place", "value")
    long = long.filter(F.col("value").isNotNull()).select(F.col("place").cast("int").alias("column"), "value")
    return long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def _names(df: DataFrame, columns: list[Column]) -> list[str]:
    return df.select(*columns).columns


def _named(found: DataFrame, names: list[str]) -> DataFrame:
    """The names of columns in the place of their numbers."""
    return found.withColumn("column", F.array(*[F.lit(n) for n in names])[F.col("column")])


def distinct_counts(df: DataFrame, exact: bool = True) -> DataFrame:
    """`column, unique_count`, missing values not counted.

    The exact form counts rows of the value-count table instead of several distinct
    aggregates at once, which would repeat every row once per column.
    """
    if not exact:
        approx = df.agg(
            *[F.approx_count_distinct(col(c)).alias(str(i)) for i, c in enumerate(df.columns)]
        )
        entries = [
            F.struct(F.lit(c).alias("column"), F.col(str(i)).alias("unique_count"))
            for i, c in enumerate(df.columns)
        ]
        return approx.select(F.inline(F.array(*entries)))
    found = None
    for kind in _value_kinds(df, df.columns):
        one = _distinct(df, kind)
        found = one if found is None else found.unionByName(one)
    return _for_every_column(df, found, {"unique_count": 0})


def _distinct(df: DataFrame, columns: list[Column]) -> DataFrame:
    counted = _value_counts(df, columns).groupBy("column").agg(F.count(F.lit(1)).alias("unique_count"))
    return _named(counted, _names(df, columns))


def _for_every_column(df: DataFrame, found: DataFrame, defaults: dict) -> DataFrame:
    """A row for every column of the table, also for those without any value."""
    names = schema_listing(df).select("column")
    joined = names.join(found, "column", "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in defaults.items()})


def _cuts(df: DataFrame, columns: list[Column], quantiles: tuple[float, ...] = QUARTILES) -> DataFrame:
    """`column, cut0, cut1, ...`: two cut points around each quantile, sketched from a sample of the
    rows; a column is its place in the list. Without values in the sample they are NULL."""
    points = [min(max(p + side * CUT_MARGIN, 0.0), 1.0) for p in quantiles for side in (-1, 1)]
    sample = df.select(*columns).toDF(*[str(i) for i in range(len(columns))]).sample(CUT_SAMPLE, seed=1)
    sketch = sample.agg(*[F.percentile_approx(col(c), points, SKETCH_ACCURACY).alias(c) for c in sample.columns])
    found = sketch.first()
    kind = sample.schema.fields[0].dataType.simpleString()
    rows = [(i, *(found[i] or [None] * len(points))) for i in range(len(columns))]
    schema = "column int, " + ", ".join(f"cut{i} {kind}" for i in range(len(points)))
    return df.sparkSession.createDataFrame(rows, schema)


def _ranks(total: int, quantiles: tuple[float, ...]) -> list[tuple[int, int, int, float]]:
    """Number of the quantile, side, rank from 0 and weight of the upper side: the quantile p of N values lies at
    position p * (N - 1) of the sorted values, between the two neighbouring ones."""
    found = []
    for q, p in enumerate(quantiles):
        position = Fraction(p) * (total - 1)
        low = position.numerator // position.denominator
        found += [(q, 0, low, float(position - low)), (q, 1, low + (position != low), float(position - low))]
    return found


def exact_quartiles(
    counts: DataFrame, cuts: DataFrame, region_rows: int = REGION_ROWS,
    quantiles: tuple[float, ...] = QUARTILES,
) -> dict[int, tuple[float, ...]]:
    """The exact quartiles, or other quantiles, with linear interpolation, of every column that has
    values.

    `counts` is a table `column, value, n` without repeated pairs, and `cuts` has some cut points of
    every column. What the driver sees is the number of values between cuts, and at the end two
    values per quantile and column. Regions between cuts that hold a wanted rank are cut again until
    none has more than `region_rows` rows, and only then sorted, so no task sorts more.
    """
    edges = [c for c in cuts.columns if c != "column"]
    region = sum(F.when(F.col("value") > F.col(c), 1).otherwise(0) for c in edges)
    # One row of a few numbers per column of the profiled table.
    placed = counts.join(F.broadcast(cuts), "column").select(
        "column", "value", "n", region.cast("bigint").alias("region")
    )
    sizes = _region_sizes(placed)
    if not sizes:
        return {}
    wanted: dict[tuple[int, int], list] = {}  # what is looked for in a region: rank inside it, and for what
    for column in {c for c, _ in sizes}:
        before = 0
        ranks = _ranks(sum(n for (c, _), (n, _) in sizes.items() if c == column), quantiles)
        for at in sorted(r for c, r in sizes if c == column):
            n = sizes[column, at][0]
            inside = [(rank - before, q, side, w) for q, side, rank, w in ranks if before <= rank < before + n]
            if inside:
                wanted[column, at] = inside
            before += n
    kept = _only(placed, wanted)
    while any(sizes[at][1] > region_rows for at in wanted):
        kept = checkpointed(kept)
        points = [i / CUTS_AGAIN for i in range(1, CUTS_AGAIN)]
        again = kept.groupBy("column", "region").agg(
            F.percentile_approx("value", points, SKETCH_ACCURACY).alias("points")
        )
        # At most two regions per quantile and column, with CUTS_AGAIN numbers each.
        below = F.size(F.filter("points", lambda c: c < F.col("value")))
        inner = (F.col("region") * CUTS_AGAIN + below).alias("region")
        placed = kept.join(F.broadcast(again), ["column", "region"]).select("column", "value", "n", inner)
        sizes, outer, wanted = _region_sizes(placed), wanted, {}
        for (column, at), looked_for in outer.items():
            before = 0
            for part in range(at * CUTS_AGAIN, (at + 1) * CUTS_AGAIN):
                n = sizes.get((column, part), (0, 0))[0]
                inside = [(rank - before, *rest) for rank, *rest in looked_for if before <= rank < before + n]
                if inside:
                    wanted[column, part] = inside
                before += n
        kept = _only(placed, wanted)
    return _sorted_out(kept, wanted)


def _region_sizes(placed: DataFrame) -> dict[tuple[int, int], tuple[int, int]]:
    """Number of values and of rows of every region."""
    sizes = placed.groupBy("column", "region").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("rows"))
    return {(r["column"], r["region"]): (r["n"], r["rows"]) for r in sizes.collect()}


def _only(placed: DataFrame, wanted: dict) -> DataFrame:
    """The rows of the wanted regions, of which there are at most two per quantile and column."""
    listed = placed.sparkSession.createDataFrame(sorted(wanted), "column int, region bigint")
    return placed.join(F.broadcast(listed), ["column", "region"], "left_semi")


def _sorted_out(kept: DataFrame, wanted: dict) -> dict[int, tuple[float, ...]]:
    asked = [(*at, rank, q, side) for at, ranks in wanted.items() for rank, q, side, _ in ranks]
    listed = kept.sparkSession.createDataFrame(asked, "column int, region bigint, rank bigint, q int, side int")
    upto = F.sum("n").over(Window.partitionBy("column", "region").orderBy("value"))
    ranked = kept.select("column", "region", F.col("value").cast("double").alias("value"), "n", upto.alias("upto"))
    found = ranked.join(F.broadcast(listed), ["column", "region"]).where("rank < upto AND rank >= upto - n")
    values = {(r["column"], r["q"], r["side"]): r["value"] for r in found.collect()}
    weights = {(at[0], q): w for at, ranks in wanted.items() for _, q, _, w in ranks}
    return {
        column: tuple(
            values[column, q, 0] + (values[column, q, 1] - values[column, q, 0]) * weights[column, q]
            for q in sorted({q for c, q in weights if c == column})
        )
        for column in sorted({at[0] for at in wanted})
    }


def _numeric_stats(df: DataFrame, columns: list[Column]) -> DataFrame:
    """`column, unique_count, mean, median, outlier_count` of columns of one type.

    The counted values are written once; everything else reads them.
    """
    counts = checkpointed(_value_counts(df, columns))
    quartiles = exact_quartiles(counts, _cuts(df, columns))
    value = F.col("value").cast("double")
    bounds = []
    for i in range(len(columns)):
        low, _, high = quartiles.get(i, (0.0, 0.0, 0.0))
        span = (high - low) * OUTLIER_SPAN
        bounds.append(F.struct(F.lit(low - span).alias("low"), F.lit(high + span).alias("high")))
    bound = F.array(*bounds)[F.col("column")]
    outside = (value < bound["low"]) | (value > bound["high"])
    medians = F.array(*[F.lit(quartiles[i][1] if i in quartiles else None).cast("double") for i in range(len(columns))])
    stats = counts.groupBy("column").agg(
        F.count(F.lit(1)).alias("unique_count"),
        (F.sum(value * F.col("n")) / F.sum("n")).alias("mean"),
        F.sum(F.when(outside, F.col("n")).otherwise(0)).alias("outlier_count"),
    )
    return _named(stats.withColumn("median", medians[F.col("column")]), _names(df, columns))


def _approximate_stats(df: DataFrame) -> DataFrame:
    """The same statistics from sketches: two passes over the data, nothing shuffled.

    The sketches are one scalar subquery; the second pass counts values outside its bounds.
    """
    numeric = numeric_columns(df)
    names = {c: str(i) for i, c in enumerate(df.columns)}
    sketch = df.agg(
        *[F.approx_count_distinct(col(c)).alias(f"d{i}") for c, i in names.items()],
        *[F.avg(col(c)).alias(f"m{names[c]}") for c in numeric],
        *[
            F.percentile_approx(col(c).cast("double"), list(QUARTILES), SKETCH_ACCURACY).alias(
                f"q{names[c]}"
            )
            for c in numeric
        ],
    )
    sketched = sketch.select(F.struct("*").alias("s")).scalar().alias("_sketch")
    s = F.col("_sketch")

    def outside(c: str) -> Column:
        q = s[f"q{names[c]}"]
        span = (q[2] - q[0]) * OUTLIER_SPAN
        return (col(c) < q[0] - span) | (col(c) > q[2] + span)

    counted = df.select(*[col(c) for c in numeric], sketched).agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(outside(c)).alias(f"o{names[c]}") for c in numeric],
    )
    nothing = F.lit(None)
    stats = [
        F.struct(
            F.lit(c).alias("column"),
            s[f"d{i}"].alias("unique_count"),
            (s[f"m{i}"] if c in numeric else nothing.cast("double")).alias("mean"),
            (s[f"q{i}"][1] if c in numeric else nothing.cast("double")).alias("median"),
            (
                F.when(s[f"q{i}"].isNotNull(), F.col(f"o{i}"))
                if c in numeric
                else nothing.cast("bigint")
            ).alias("outlier_count"),
        )
        for c, i in names.items()
    ]
    return counted.select("*", sketched).select(F.inline(F.array(*stats)))


def _exact_stats(df: DataFrame) -> DataFrame:
    """The statistics of every column; each type is scanned with only its own columns."""
    decimals = [c for c in df.columns if _is_decimal(df, c)]
    kinds = _value_kinds(df, [c for c in df.columns if c not in decimals])
    found = None
    for kind in kinds + [[col(c)] for c in decimals]:
        if is_numeric(df.select(*kind).schema.fields[0].dataType):
            one = _numeric_stats(df, kind)
        else:
            one = _distinct(df, kind)
        found = one if found is None else found.unionByName(one, allowMissingColumns=True)
    absent = {"mean": "double", "median": "double", "outlier_count": "bigint"}
    return found.withColumns(
        {c: F.lit(None).cast(t) for c, t in absent.items() if c not in found.columns}
    )


def _is_decimal(df: DataFrame, name: str) -> bool:
    return isinstance(type_of(df, name), T.DecimalType)


def column_profile(
    df: DataFrame, exact: bool = True, counts: DataFrame | None = None
) -> DataFrame:
    """One row per column: position, type, missing, distinct, outliers, mean and median.

    The numeric statistics are NULL for columns that are no numbers or hold no value.
    """
    stats = _exact_stats(df) if exact else _approximate_stats(df)
    missing = missing_values(df, counts)
    listed = schema_listing(df).join(missing, "column").join(stats, "column", "left")
    return listed.select(
        "position",
        "column",
        "type",
        "missing_count",
        "missing_percentage",
        F.coalesce("unique_count", F.lit(0)).alias("unique_count"),
        "outlier_count",
        half_even(F.col("mean"), 4).alias("mean"),
        half_even(F.col("median"), 4).alias("median"),
    )


def _row_key(df: DataFrame) -> list[Column]:
    """All columns in a comparable form: maps as sorted lists of entries, one zero for floats."""

    def form(f: T.StructField) -> Column:
        value = comparable(col(f.name), f.dataType)
        return value + F.lit(0.0).cast(f.dataType) if is_floating(f.dataType) else value

    return [form(f).alias(f"c{i}") for i, f in enumerate(df.schema.fields)]


def duplicate_rows(df: DataFrame) -> DataFrame:
    """One row `duplicate_rows`: rows beyond the first of each group of equal ones.

    Rows are grouped by the SHA-256 of their cells, so that rows of any width are shuffled once
    and as 32 bytes, after equal ones of a task were merged.
    """
    digest = F.unhex(F.sha2(F.to_json(F.struct(*_row_key(df)), EXACT_JSON), 256))
    groups = df.groupBy(digest.alias("digest")).agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"))


def quality_score(rows: Column, columns: Column, duplicates: Column, missing: Column) -> Column:
    """100 minus up to 60 for the share of missing cells and up to 40 for duplicate rows."""
    cells = F.greatest(rows * columns, F.lit(1))
    lost = F.lit(100) - missing / cells * 60 - duplicates / F.greatest(rows, F.lit(1)) * 40
    return F.greatest(F.lit(0), half_even(lost, 0).cast("int"))


def summary(
    df: DataFrame, counts: DataFrame | None = None, duplicates: DataFrame | None = None
) -> DataFrame:
    """One row: rows, columns, duplicates, missing cells, their share and the score.

    Missing values and duplicates that were counted before can be passed.
    """
    width = len(df.columns)
    counts = _missing(df) if counts is None else counts
    duplicates = duplicate_rows(df) if duplicates is None else duplicates
    missing = sum((F.col(str(i)) for i in range(width)), F.lit(0))
    shape = counts.select(
        "rows", missing.alias("missing_cells"), F.lit(None).cast("bigint").alias("duplicate_rows")
    )
    parts = shape.unionByName(duplicates, allowMissingColumns=True)
    whole = parts.agg(
        F.max("rows").alias("rows"),
        F.max("missing_cells").alias("missing_cells"),
        F.max("duplicate_rows").alias("duplicate_rows"),
    )
    columns = F.lit(width).cast("bigint")
    cells = F.greatest(F.col("rows") * columns, F.lit(1))
    return whole.select(
        "rows",
        columns.alias("columns"),
        "duplicate_rows",
        "missing_cells",
        half_even(F.col("missing_cells") / cells * 100, 2).alias("missing_percentage"),
        quality_score(
            F.col("rows"), columns, F.col("duplicate_rows"), F.col("missing_cells")
        ).alias("quality_score"),
    )


def penalty_score(df: DataFrame) -> DataFrame:
    """One row: duplicates, missing cells and 100 less 5 and 3 points for each of them.

    Here empty text counts as missing.
    """

    def empty(f: T.StructField) -> Column:
        value = col(f.name)
        blank = value.isNull()
        return blank | (value == "") if isinstance(f.dataType, T.StringType) else blank

    missing = sum((F.count_if(empty(f)) for f in df.schema.fields), F.lit(0))
    counted = df.agg(missing.alias("missing_count"))
    parts = counted.unionByName(
        duplicate_rows(df).withColumnRenamed("duplicate_rows", "duplicate_count"),
        allowMissingColumns=True,
    )
    whole = parts.agg(
        F.max("duplicate_count").alias("duplicate_count"),
        F.max("missing_count").alias("missing_count"),
    )
    score = F.lit(100) - F.col("duplicate_count") * 5 - F.col("missing_count") * 3
    return whole.withColumn("score", F.greatest(F.lit(0), score))


def suggestions(missing: DataFrame, duplicates: DataFrame) -> DataFrame:
    """`position, suggestion` from the missing values per column and the duplicate count."""
    repeated = duplicates.filter(F.col("duplicate_rows") > 0).select(
        F.lit(-1).alias("position"), F.lit("Remove duplicate rows.").alias("suggestion")
    )
    sparse = missing.filter(F.col("missing_percentage") > MISSING_ADVICE_PERCENT).select(
        "position",
        F.concat(
            F.lit("Review column '"),
            F.col("column"),
            F.lit("' because more than 20% of its values are missing."),
        ).alias("suggestion"),
    )
    return repeated.unionByName(sparse)


def suggestions_for(df: DataFrame) -> DataFrame:
    positions = schema_listing(df).select("position", "column")
    return suggestions(positions.join(missing_values(df), "column"), duplicate_rows(df))


def correlation_columns(
    df: DataFrame, limit: int | None = CORRELATION_COLUMNS
) -> tuple[list[str], int]:
    """The numeric columns that are correlated, all with None, and how many are left out."""
    numeric = numeric_columns(df)
    return numeric[:limit], len(numeric) - len(numeric[:limit])


def _pair_moments(width: int):
    """Sums over one task's rows for every pair of columns, as a few small matrix products.

    Fifty columns make 1,225 pairs of six sums each. As single aggregates they pass the
    limit for generated code; as products of a batch with itself they are nearly free. Only
    width * width rows leave a task.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((6, width, width))
        for batch in batches:
            x = batch.to_numpy(dtype=np.float64, na_value=np.nan)
            here = ~np.isnan(x)
            x, here = np.where(here, x, 0.0), here.astype(np.float64)
            squares = x * x
            sums += np.stack(
                [here.T @ here, x.T @ here, here.T @ x, x.T @ x, squares.T @ here, here.T @ squares]
            )
        a, b = np.triu_indices(width)
        names = ("n", "sx", "sy", "sxy", "sxx", "syy")
        moments = {name: sums[i, a, b] for i, name in enumerate(names)}
        yield pd.DataFrame({"a": a.astype(np.int32), "b": b.astype(np.int32), **moments})

    return run


def correlations(df: DataFrame, limit: int | None = CORRELATION_COLUMNS) -> DataFrame:
    """`column_a, column_b, correlation`: Pearson over the rows where both are present.

    Every unordered pair is computed once and written in both directions; a column with
    itself is 1 if it varies. An undefined correlation is NULL. Values are first shifted by
    their column's mean, which keeps the sums of squares accurate.
    """
    names, _ = correlation_columns(df, limit)
    if len(names) < 2:
        empty = "column_a string, column_b string, correlation double"
        return df.sparkSession.createDataFrame([], empty)
    numbers = [col(c).cast("double") for c in names]
    means = df.agg(*[F.avg(v).alias(f"m{i}") for i, v in enumerate(numbers)])
    means = means.select(F.struct("*").alias("means")).scalar()
    beside = df.select(*[v.alias(f"v{i}") for i, v in enumerate(numbers)], means.alias("means"))
    shifted = beside.select(
        *[(F.col(f"v{i}") - F.col(f"means.m{i}")).alias(f"x{i}") for i in range(len(names))]
    )
    sums = shifted.mapInPandas(
        _pair_moments(len(names)),
        "a int, b int, n double, sx double, sy double, sxy double, sxx double, syy double",
    )
    total = sums.groupBy("a", "b").agg(
        *[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxy", "sxx", "syy")]
    )
    n = F.greatest("n", F.lit(1.0))
    spread_x = F.col("sxx") - F.col("sx") * F.col("sx") / n
    spread_y = F.col("syy") - F.col("sy") * F.col("sy") / n
    # What is left of a constant column's squares after the subtraction is rounding noise.
    varies = (spread_x > F.col("sxx") * NOISE) & (spread_y > F.col("syy") * NOISE)
    together = F.col("sxy") - F.col("sx") * F.col("sy") / n
    r = F.when(varies, together / (F.sqrt(spread_x) * F.sqrt(spread_y)))
    r = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r))
    name_of = F.array(*[F.lit(c) for c in names])
    pair = total.select(
        name_of[F.col("a")].alias("a"),
        name_of[F.col("b")].alias("b"),
        F.when(varies, half_even(r, 4)).alias("r"),
    )
    both = F.array_distinct(
        F.array(
            F.struct(F.col("a").alias("column_a"), F.col("b").alias("column_b")),
            F.struct(F.col("b").alias("column_a"), F.col("a").alias("column_b")),
        )
    )
    return pair.select(F.inline(both), F.col("r").alias("correlation"))


def correlation_width(df: DataFrame, limit: int | None = CORRELATION_COLUMNS) -> DataFrame:
    """One row: how many numeric columns are correlated and how many are left out."""
    names, hidden = correlation_columns(df, limit)
    return df.sparkSession.createDataFrame(
        [(len(names), hidden)], "columns_analyzed bigint, columns_truncated bigint"
    )


@dataclass
class Profile:
    """The parts of a profile, each a lazy DataFrame."""

    summary: DataFrame
    columns: DataFrame
    correlations: DataFrame
    correlation_width: DataFrame
    suggestions: DataFrame


def profile(
    df: DataFrame, exact: bool = True, limit: int | None = CORRELATION_COLUMNS
) -> Profile:
    """All parts of a profile; `limit` bounds the correlated columns, None correlates all.

    Missing values and duplicate rows are counted once, at once, for all parts.
    """
    counts, duplicates = checkpointed(_missing(df)), checkpointed(duplicate_rows(df))
    columns = column_profile(df, exact, counts)
    return Profile(
        summary=summary(df, counts, duplicates),
        columns=columns,
        correlations=correlations(df, limit),
        correlation_width=correlation_width(df, limit),
        suggestions=suggestions(columns, duplicates),
    )


def column_means(df: DataFrame) -> DataFrame:
    """`column, mean` of the numeric columns that hold values, in one pass."""
    names = [c for c in df.columns if is_numeric(type_of(df, c))]
    means = df.agg(*[F.avg(col(c)).alias(str(i)) for i, c in enumerate(names)])
    entries = [
        F.struct(F.lit(c).alias("column"), half_even(F.col(str(i)), 4).alias("mean"))
        for i, c in enumerate(names)
    ]
    return means.select(F.inline(F.array(*entries))).filter(F.col("mean").isNotNull())


def _as_doubles(df: DataFrame) -> list[Column]:
    return [col(c).cast("double").alias(c) for c in numeric_columns(df)]


def column_quartiles(df: DataFrame) -> DataFrame:
    """`column, q1, median, q3` of the numeric columns, exact."""
    found = column_quantiles(df, QUARTILES)
    return found.select("column", *[F.col("values")[i].alias(c) for i, c in enumerate(("q1", "median", "q3"))])


def column_quantiles(df: DataFrame, quantiles: tuple[float, ...]) -> DataFrame:
    """`column, values` of the numeric columns that hold values: the exact quantiles, in the given order."""
    numbers = _as_doubles(df)
    found = {}
    if numbers:
        counts = checkpointed(_value_counts(df, numbers))
        found = exact_quartiles(counts, _cuts(df, numbers, quantiles), quantiles=quantiles)
    rows = [(numeric_columns(df)[i], list(values)) for i, values in found.items()]
    return df.sparkSession.createDataFrame(rows, "column string, values array<double>")


def outlier_counts(df: DataFrame) -> DataFrame:
    """`column, outlier_count`: values beyond 1.5 quartile spans of the middle half."""
    return _numeric_stats(df, _as_doubles(df)).select("column", "outlier_count")
