"""Profile and report queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgrid.operators.rules import shape
from quillgrid.plans import profile, report
from quillgrid.suite import GAPPY, gappy_events, query, table

LINEITEM_NUMBERS = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
    "l_discount", "l_tax",
]
LINEITEM_COLUMNS = LINEITEM_NUMBERS + ["l_returnflag", "l_linestatus", "l_shipdate"]
EVENT_COLUMNS = ["event_id", "ts", "user_id", "event_type", "value", "props"]
NUMBERS = LINEITEM_NUMBERS + ["event_id", "user_id", "value", "o_totalprice"]


def union(parts: list[str]) -> str:
    return "\nUNION ALL ".join(parts)


def missing_sql(source: str, columns: list[str], prefix: str = "") -> str:
    return prefix + union(
        [
            f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS missing_count,"
            f" round_even(100.0 * (count(*) - count({c})) / greatest(count(*), 1), 2)"
            f" AS missing_percentage FROM {source}"
            for c in columns
        ]
    )


def distinct_sql(source: str, columns: list[str], prefix: str = "") -> str:
    return prefix + union(
        [
            f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS unique_count FROM {source}"
            for c in columns
        ]
    )


def quartile(column: str, p: float) -> str:
    return f"quantile_cont(CAST({column} AS DOUBLE), CAST({p} AS DOUBLE))"


def numeric_sql(source: str, columns: list[str], items: str, prefix: str = "") -> str:
    """Aggregates over `x`, each column read as a double, with its quartiles at hand."""
    return prefix + union(
        [
            f"""SELECT '{c}' AS "column", {items} FROM
            (SELECT CAST({c} AS DOUBLE) AS x, q1, q2, q3 FROM {source},
             (SELECT {quartile(c, 0.25)} AS q1, {quartile(c, 0.5)} AS q2,
                     {quartile(c, 0.75)} AS q3 FROM {source}))"""
            for c in columns
        ]
    )


OUTLIERS = "count(*) FILTER (x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1))"


@query("profile_shape", "SELECT count(*) AS rows, CAST(11 AS BIGINT) AS columns FROM lineitem")
def profile_shape(spark, sf):
    return shape(table(spark, sf, "lineitem"))


@query("profile_missing", missing_sql("g", EVENT_COLUMNS, f"WITH {GAPPY} "))
def profile_missing(spark, sf):
    return profile.missing_values(gappy_events(spark, sf))


@query("profile_distinct", distinct_sql("lineitem", LINEITEM_COLUMNS))
def profile_distinct(spark, sf):
    return profile.distinct_counts(table(spark, sf, "lineitem"))


@query("profile_distinct_gaps", distinct_sql("g", EVENT_COLUMNS, f"WITH {GAPPY} "))
def profile_distinct_gaps(spark, sf):
    return profile.distinct_counts(gappy_events(spark, sf))


@query(
    "profile_distinct_texts",
    distinct_sql("documents", ["doc_id", "text", "lang", "source", "n_chars"]),
)
def profile_distinct_texts(spark, sf):
    return profile.distinct_counts(table(spark, sf, "documents"))


@query("profile_means", numeric_sql("lineitem", LINEITEM_NUMBERS, "round_even(avg(x), 4) AS mean"))
def profile_means(spark, sf):
    return profile.column_means(table(spark, sf, "lineitem"))


@query(
    "profile_quartiles",
    numeric_sql("lineitem", LINEITEM_NUMBERS, "max(q1) AS q1, max(q2) AS median, max(q3) AS q3"),
)
def profile_quartiles(spark, sf):
    return profile.column_quartiles(table(spark, sf, "lineitem"))


@query("profile_outliers", numeric_sql("lineitem", LINEITEM_NUMBERS, f"{OUTLIERS} AS outlier_count"))
def profile_outliers(spark, sf):
    return profile.outlier_counts(table(spark, sf, "lineitem"))


@query(
    "profile_outliers_gaps",
    numeric_sql(
        "g", ["event_id", "user_id", "value"], f"{OUTLIERS} AS outlier_count", f"WITH {GAPPY} "
    ),
)
def profile_outliers_gaps(spark, sf):
    return profile.outlier_counts(gappy_events(spark, sf))


def duplicates_sql(columns: str, source: str) -> str:
    return f"""SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicate_rows
               FROM (SELECT count(*) AS n FROM {source} GROUP BY {columns})"""


@query("profile_duplicates_narrow", duplicates_sql("event_type, user_id", "events"))
def profile_duplicates_narrow(spark, sf):
    return profile.duplicate_rows(table(spark, sf, "events").select("event_type", "user_id"))


@query(
    "profile_duplicates_wide",
    duplicates_sql(
        "l_quantity, l_discount, l_tax, l_returnflag, l_linestatus, l_linenumber", "lineitem"
    ),
)
def profile_duplicates_wide(spark, sf):
    return profile.duplicate_rows(
        table(spark, sf, "lineitem").select(
            "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_linenumber"
        )
    )


@query("profile_duplicates_none", duplicates_sql(", ".join(LINEITEM_COLUMNS), "lineitem"))
def profile_duplicates_none(spark, sf):
    return profile.duplicate_rows(table(spark, sf, "lineitem"))


@query("profile_duplicate_texts", duplicates_sql("text, lang", "documents"))
def profile_duplicate_texts(spark, sf):
    return profile.duplicate_rows(table(spark, sf, "documents").select("text", "lang"))


def summary_sql(source: str, columns: list[str], prefix: str = "") -> str:
    missing = " + ".join(f"count(*) - count({c})" for c in columns)
    cells = f"greatest(rows * {len(columns)}, 1)"
    return f"""{prefix}SELECT rows, CAST({len(columns)} AS BIGINT) AS columns, duplicate_rows,
        missing_cells, round_even(missing_cells / {cells} * 100, 2) AS missing_percentage,
        CAST(greatest(0, round_even(100 - missing_cells / {cells} * 60
             - duplicate_rows / greatest(rows, 1) * 40, 0)) AS INTEGER) AS quality_score
        FROM (SELECT count(*) AS rows, {missing} AS missing_cells FROM {source}),
             ({duplicates_sql(", ".join(columns), source)})"""


NARROW = ["event_type", "value", "user_id"]


@query("profile_summary", summary_sql("g", NARROW, f"WITH {GAPPY} "))
def profile_summary(spark, sf):
    return profile.summary(gappy_events(spark, sf).select(*NARROW))


@query("profile_summary_lineitem", summary_sql("lineitem", LINEITEM_COLUMNS))
def profile_summary_lineitem(spark, sf):
    return profile.summary(table(spark, sf, "lineitem"))


SPARSE_SQL = f"""WITH {GAPPY}, s AS (
    SELECT event_type, CASE WHEN value >= 50 THEN value END AS value, user_id FROM g)"""


def sparse_events(spark, sf):
    return gappy_events(spark, sf).select(
        "event_type", F.when(F.col("value") >= 50, F.col("value")).alias("value"), "user_id"
    )


def suggestions_sql() -> str:
    advice = "Review column ''{c}'' because more than 20% of its values are missing."
    rows = [
        f"""SELECT {i} AS position, '{advice.format(c=c)}' AS suggestion FROM s
            HAVING round_even(100.0 * (count(*) - count({c})) / count(*), 2) > 20"""
        for i, c in enumerate(NARROW)
    ]
    repeated = f"""SELECT -1 AS position, 'Remove duplicate rows.' AS suggestion
                   FROM ({duplicates_sql(", ".join(NARROW), "s")}) WHERE duplicate_rows > 0"""
    return union([repeated, *rows])


@query("profile_suggestions", SPARSE_SQL + suggestions_sql())
def profile_suggestions(spark, sf):
    return profile.suggestions_for(sparse_events(spark, sf))


def correlation_sql(source: str, columns: list[str], prefix: str = "") -> str:
    def one(a: str, b: str) -> str:
        both = f"{a} IS NOT NULL AND {b} IS NOT NULL"
        flat = f"stddev_pop({a}) FILTER ({both}) * stddev_pop({b}) FILTER ({both}) = 0"
        return (
            f"SELECT '{a}' AS column_a, '{b}' AS column_b, CASE WHEN {flat} THEN NULL"
            f" ELSE round_even(covar_pop({a}, {b}) / (stddev_pop({a}) FILTER ({both})"
            f" * stddev_pop({b}) FILTER ({both})), 4) END AS correlation FROM {source}"
        )

    return prefix + union([one(a, b) for a in columns for b in columns])


@query("profile_correlations", correlation_sql("lineitem", LINEITEM_NUMBERS))
def profile_correlations(spark, sf):
    return profile.correlations(table(spark, sf, "lineitem"))


@query(
    "profile_correlations_gaps",
    correlation_sql(
        "c",
        ["user_id", "value", "flat"],
        f"""WITH {GAPPY}, c AS (SELECT CASE WHEN event_type <> 'view' THEN user_id END AS user_id,
            value, 1 AS flat FROM g) """,
    ),
)
def profile_correlations_gaps(spark, sf):
    events = gappy_events(spark, sf).select(
        F.when(F.col("event_type") != "view", F.col("user_id")).alias("user_id"),
        "value",
        F.lit(1).alias("flat"),
    )
    return profile.correlations(events)


@query(
    "profile_correlation_limit",
    f"""SELECT *, CAST(3 AS BIGINT) AS columns_analyzed, CAST(5 AS BIGINT) AS columns_truncated
        FROM ({correlation_sql("lineitem", LINEITEM_NUMBERS[:3])})""",
)
def profile_correlation_limit(spark, sf):
    items = table(spark, sf, "lineitem")
    width = profile.correlation_width(items, limit=3).first()
    return profile.correlations(items, limit=3).withColumns(
        {c: F.lit(width[c]).cast("bigint") for c in ("columns_analyzed", "columns_truncated")}
    )


LINEITEM_TYPES = ["bigint"] * 3 + ["int"] + ["double"] * 4 + ["string"] * 2 + ["timestamp_ntz"]
EVENT_TYPES = ["bigint", "timestamp_ntz", "bigint", "string", "double", "string"]


def schema_sql(columns: list[str], types: list[str]) -> str:
    return union(
        [
            f"SELECT {i} AS position, '{c}' AS \"column\", '{t}' AS type"
            for i, (c, t) in enumerate(zip(columns, types))
        ]
    )


@query(
    "profile_schema",
    f"""SELECT position, "column", type, missing_count
        FROM ({schema_sql(EVENT_COLUMNS, EVENT_TYPES)})
        JOIN ({missing_sql("g", EVENT_COLUMNS, f"WITH {GAPPY} ")}) USING ("column")""",
)
def profile_schema(spark, sf):
    """The schema listing beside the missing cells of each column."""
    events = gappy_events(spark, sf)
    missing = profile.missing_values(events).drop("missing_percentage")
    return profile.schema_listing(events).join(missing, "column")


def columns_sql(source: str, columns: list[str], types: list[str], prefix: str = "") -> str:
    numbers = [c for c in columns if c in NUMBERS]
    stats = numeric_sql(
        source,
        numbers,
        f"{OUTLIERS} AS outlier_count, round_even(avg(x), 4) AS mean,"
        " round_even(max(q2), 4) AS median",
    )
    start = prefix or "WITH "
    return f"""{start}sc AS ({schema_sql(columns, types)}),
        mi AS ({missing_sql(source, columns)}), di AS ({distinct_sql(source, columns)}),
        st AS ({stats})
        SELECT sc.position, sc."column", sc.type, missing_count, missing_percentage,
               unique_count, outlier_count, mean, median
        FROM sc JOIN mi USING ("column") JOIN di USING ("column") LEFT JOIN st USING ("column")"""


@query("profile_columns", columns_sql("lineitem", LINEITEM_COLUMNS, LINEITEM_TYPES))
def profile_columns(spark, sf):
    return profile.column_profile(table(spark, sf, "lineitem"))


@query("profile_columns_gaps", columns_sql("g", EVENT_COLUMNS, EVENT_TYPES, f"WITH {GAPPY}, "))
def profile_columns_gaps(spark, sf):
    return profile.column_profile(gappy_events(spark, sf))


@query("profile_columns_approximate")
def profile_columns_approximate(spark, sf):
    return profile.column_profile(table(spark, sf, "lineitem"), exact=False)


def sketch_sql() -> str:
    """Every figure of the sketch is close to the exact one; columns without numbers have none."""
    rows = [
        f"""SELECT '{c}' AS "column", count(*) >= 0 AS missing_equal, count(*) >= 0 AS unique_close,
                   {"count(*) >= 0" if c in NUMBERS else "CAST(NULL AS BOOLEAN)"} AS mean_close,
                   {"count(*) >= 0" if c in NUMBERS else "CAST(NULL AS BOOLEAN)"} AS median_close
            FROM lineitem"""
        for c in LINEITEM_COLUMNS
    ]
    return union(rows)


@query("profile_sketch_is_close", sketch_sql())
def profile_sketch_is_close(spark, sf):
    """Distinct counts within a fifth, means to the rounding, medians within 2 % of the ranks."""
    items = table(spark, sf, "lineitem")
    exact = profile.column_profile(items)
    sketch = profile.column_profile(items, exact=False).select(
        "column", *[F.col(c).alias(f"s_{c}") for c in ("missing_count", "unique_count", "mean", "median")]
    )
    bounds = profile.column_quantiles(items.select(*LINEITEM_NUMBERS), (0.48, 0.52))
    around = bounds.withColumnRenamed("values", "b")
    joined = exact.join(sketch, "column").join(around, "column", "left")
    return joined.select(
        "column",
        (F.col("missing_count") == F.col("s_missing_count")).alias("missing_equal"),
        (F.abs(F.col("unique_count") - F.col("s_unique_count")) <= 0.2 * F.col("unique_count")).alias(
            "unique_close"
        ),
        (F.abs(F.col("mean") - F.col("s_mean")) < 0.001).alias("mean_close"),
        F.col("s_median").between(F.col("b")[0] - 0.0001, F.col("b")[1] + 0.0001).alias("median_close"),
    )


def whole_sql() -> str:
    """All figures of all parts of the profile of the gappy events."""
    summary = summary_sql("g", EVENT_COLUMNS, f"WITH {GAPPY} ")
    columns = columns_sql("g", EVENT_COLUMNS, EVENT_TYPES, f"WITH {GAPPY}, ")
    numbers = ["event_id", "user_id", "value"]
    pairs = correlation_sql("g", numbers, f"WITH {GAPPY} ")
    figures = ["rows", "columns", "duplicate_rows", "missing_cells", "missing_percentage", "quality_score"]
    parts = [f"SELECT 'summary' AS part, '{f}' AS name, CAST({f} AS DOUBLE) AS value FROM s" for f in figures]
    stats = ["missing_count", "unique_count", "outlier_count", "mean", "median"]
    parts += [f"""SELECT 'columns', "column" || '.{f}', CAST({f} AS DOUBLE) FROM c""" for f in stats]
    parts += ["SELECT 'correlations', column_a || '.' || column_b, correlation FROM r"]
    parts += ["SELECT 'suggestions', \"column\", 1.0 FROM c WHERE missing_percentage > 20"]
    parts += ["SELECT 'suggestions', 'duplicates', 1.0 FROM s WHERE duplicate_rows > 0"]
    return f"WITH s AS ({summary}), c AS ({columns}), r AS ({pairs}) " + union(parts)


@query("profile_whole_figures", whole_sql())
def profile_whole_figures(spark, sf):
    """Every figure of a whole profile as `part, name, value`."""
    whole = profile.profile(gappy_events(spark, sf))

    def figures(part, names, prefix=None):
        entries = [
            F.struct(
                (F.concat(prefix, F.lit(f".{n}")) if prefix is not None else F.lit(n)).alias("name"),
                F.col(n).cast("double").alias("value"),
            )
            for n in names
        ]
        return part.select(F.inline(F.array(*entries)))

    summary = ["rows", "columns", "duplicate_rows", "missing_cells", "missing_percentage", "quality_score"]
    stats = ["missing_count", "unique_count", "outlier_count", "mean", "median"]
    advice = F.regexp_extract("suggestion", "column '([^']+)'", 1)
    parts = {
        "summary": figures(whole.summary, summary),
        "columns": figures(whole.columns, stats, F.col("column")),
        "correlations": whole.correlations.select(
            F.concat_ws(".", "column_a", "column_b").alias("name"), F.col("correlation").alias("value")
        ),
        "suggestions": whole.suggestions.select(
            F.when(advice == "", "duplicates").otherwise(advice).alias("name"), F.lit(1.0).alias("value")
        ),
    }
    result = None
    for name, part in parts.items():
        one = part.select(F.lit(name).alias("part"), "name", "value")
        result = one if result is None else result.unionByName(one)
    return result


@query("profile_whole")
def profile_whole(spark, sf):
    """All parts of a profile as one listing of `part, item`."""
    whole = profile.profile(gappy_events(spark, sf))
    parts = {
        "summary": whole.summary,
        "columns": whole.columns,
        "correlations": whole.correlations,
        "suggestions": whole.suggestions,
    }
    result = None
    for name, part in parts.items():
        one = part.select(F.lit(name).alias("part"), F.to_json(F.struct("*")).alias("item"))
        result = one if result is None else result.unionByName(one)
    return result


@query(
    "profile_penalty_score",
    """WITH d AS (SELECT lang, CASE WHEN lang = 'fr' THEN '' ELSE source END AS source
                  FROM documents)
       SELECT duplicate_rows AS duplicate_count, missing_count,
              greatest(0, 100 - duplicate_rows * 5 - missing_count * 3) AS score
       FROM (SELECT count(*) FILTER (lang = '') + count(*) FILTER (source = '') AS missing_count
             FROM d),
            (SELECT CAST(sum(n - 1) AS BIGINT) AS duplicate_rows
             FROM (SELECT count(*) AS n FROM d GROUP BY lang, source))""",
)
def profile_penalty_score(spark, sf):
    documents = table(spark, sf, "documents").select(
        "lang", F.when(F.col("lang") == "fr", "").otherwise(F.col("source")).alias("source")
    )
    return profile.penalty_score(documents)


@query(
    "report_summary",
    f"""WITH {GAPPY}, p AS ({summary_sql("g", NARROW)})
        SELECT 0 AS position, 'Rows' AS metric, CAST(rows AS VARCHAR) AS value FROM p
        UNION ALL SELECT 1, 'Columns', CAST(columns AS VARCHAR) FROM p
        UNION ALL SELECT 2, 'Duplicates', CAST(duplicate_rows AS VARCHAR) FROM p
        UNION ALL SELECT 3, 'Missing data', CAST(missing_percentage AS VARCHAR) || '%' FROM p""",
)
def report_summary(spark, sf):
    return report.executive_summary(gappy_events(spark, sf).select(*NARROW))


@query(
    "report_columns",
    f"""SELECT position, "column", type, missing_percentage, unique_count,
               coalesce(outlier_count, 0) AS outliers
        FROM ({columns_sql("lineitem", LINEITEM_COLUMNS, LINEITEM_TYPES)})""",
)
def report_columns(spark, sf):
    return report.column_quality(table(spark, sf, "lineitem"))


@query(
    "report_recommendations",
    f"SELECT position, '- ' || suggestion AS line FROM ({SPARSE_SQL + suggestions_sql()})",
)
def report_recommendations(spark, sf):
    return report.recommendations(sparse_events(spark, sf))
