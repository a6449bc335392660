"""Reading CSV, JSON and Parquet into DataFrames with one rule for missing values."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgrid.functions.columns import col, nan_to_null
from quillgrid.functions.scalars import NUMBER_PATTERN, as_number
from quillgrid.operators.filters import rules_condition
from quillgrid.sources.records import FIRST, Quotes, csv_ranges, csv_records, json_records

# Text cells that mean "missing" in a CSV file.
MISSING_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# The spellings of a boolean cell.
TRUE_TOKENS = ["True", "TRUE", "true"]
FALSE_TOKENS = ["False", "FALSE", "false"]

INTEGER_PATTERN = r"^[+-]?[0-9]+$"
INFINITY_PATTERN = r"(?i)^[+-]?inf(inity)?$"

# The file suffixes that can be read.
FORMATS = {".csv": "csv", ".json": "json", ".jsonl": "jsonl", ".parquet": "parquet"}


def load_dataset(
    spark: SparkSession, path: str, fmt: str | None = None, where: dict | None = None, **options
) -> DataFrame:
    """Read a dataset, choosing the reader by `fmt` or by the suffix of the path.

    `where` takes filter rules for any format; Parquet also skips row groups by them. Other options
    are those of the reader, such as `schema`.
    """
    if fmt is None:
        suffix = "." + path.rstrip("/").rsplit(".", 1)[-1].lower()
        if suffix not in FORMATS:
            raise ValueError(f"No reader for files ending in {suffix}")
        fmt = FORMATS[suffix]
    if fmt == "parquet":
        return read_parquet(spark, path, where, **options)
    if fmt == "csv":
        df = read_csv(spark, path, **options)
    elif fmt in ("json", "jsonl"):
        df = read_json(spark, path, lines=fmt == "jsonl", **options)
    else:
        raise ValueError(f"No reader for the format {fmt}")
    return df.filter(rules_condition(df, where)) if where else df


def read_parquet(spark: SparkSession, path: str, where: dict | None = None) -> DataFrame:
    """Scan Parquet with NaN read as NULL.

    `where` takes filter rules. They are tested on the stored columns, so that Parquet
    row groups can be skipped by their statistics, and again after NaN became NULL.
    """
    raw = spark.read.parquet(path)
    if not where:
        return nan_to_null(raw)
    clean = nan_to_null(raw.filter(rules_condition(raw, where)))
    return clean.filter(rules_condition(clean, where))


def read_json(
    spark: SparkSession, path: str, lines: bool = False, timestamps: list[str] | None = None,
    schema: T.StructType | None = None,
) -> DataFrame:
    """Read an array of records, or one record per line with `lines=True`.

    One array is read by as many tasks as Spark deals its file to. Without a `schema` the records
    are read once more to find the types. Text is never guessed to be a time: name such columns in
    `timestamps`.
    """
    if lines:
        reader = spark.read.schema(schema) if schema is not None else spark.read
        df = reader.json(path)
    else:
        records = json_records(spark, path)
        if schema is not None:
            df = records.select(F.from_json("record", schema).alias("r")).select("r.*")
        else:
            df = _inferred_json(spark, records)
    return nan_to_null(df).withColumns({c: col(c).cast("timestamp") for c in timestamps or []})


def _inferred_json(spark: SparkSession, records: DataFrame) -> DataFrame:
    """Spark's own JSON reader over a column of texts, which stay in the JVM."""
    texts = getattr(records._jdf, "as")(spark._jvm.org.apache.spark.sql.Encoders.STRING())
    return DataFrame(spark.read._jreader.json(texts), spark)


def _names(cells: list[str | None]) -> list[str]:
    """Column names from the cells of the header. Repeated names get a counter, as in `a`, `a.1`."""
    names: list[str] = []
    for position, cell in enumerate(cells):
        base = cell if cell else f"Unnamed: {position}"
        name, counter = base, 0
        while name in names:
            counter += 1
            name = f"{base}.{counter}"
        names.append(name)
    return names


@F.pandas_udf(T.BooleanType())
def _never_ends(lines: pd.Series) -> pd.Series:
    """Whether a quoted cell of the line is still open at its end."""
    quotes = Quotes(blanks=False)
    return lines.map(lambda line: quotes.after(line, False))


def _check_lines(spark: SparkSession, path: str) -> None:
    """Refuse files with a line that ends inside quotes."""
    quoted = spark.read.text(path).where(F.contains("value", F.lit('"')))
    broken = quoted.filter(_never_ends("value")).select(F.col("_metadata.file_path").alias("file"))
    found = broken.first()
    if found:
        raise ValueError(f"A quoted field never ends in {found.file}.")


BROKEN = "_broken_record"


def _cells(
    spark: SparkSession, path: str, multiline: bool, check_quotes: bool, options: dict,
    names: list[str] | None = None,
) -> tuple[list[str], DataFrame]:
    """The column names and all cells as text, and BROKEN: the record, where it has more cells than
    the header. Every file must begin with the same header, which must hold `names` if given.

    Where no record spans lines, Spark's own reader parses the lines. Else the records are put
    together first, range by range of each file, so that one file is read by many tasks.
    """
    spans = False
    if multiline:
        lines, ranges, quotes = csv_ranges(spark, path, "ignoreLeadingWhiteSpace" in options)
        unended = [f for f, state in ranges.final.items() if state[0]]
        if unended and check_quotes:
            raise ValueError(f"A quoted field never ends in {ranges.files.get(unended[0], path)}.")
        spans = ranges.spanning
    elif check_quotes:
        _check_lines(spark, path)
    if not spans:
        first = spark.read.csv(path, header=False, **options).first()
        header = list(first) if first is not None else None
        if header is not None and _names(header) == header:
            return header, _plain_cells(spark, path, header, names, options)
        if not multiline:
            lines, ranges, quotes = csv_ranges(spark, path, "ignoreLeadingWhiteSpace" in options)
    records = csv_records(lines, ranges, quotes)
    first = records.where(F.col("kind") == FIRST).first()
    if first is None:
        raise ValueError("The file has no header, as it is empty.")
    options = {k: str(v) for k, v in options.items()} | {"multiLine": "true"}
    parsed = lambda record, n: F.from_csv(record, ", ".join(f"c{i} string" for i in range(n)), options)
    width = _width(first["record"])
    cells = spark.range(1).select(parsed(F.lit(first["record"]), width).alias("cells")).first()["cells"]
    found = _names(list(cells))
    if names is not None and names != found:
        raise ValueError(f"The header is {found}, not {names}.")
    other = F.raise_error(F.concat(F.lit("Another header than in the first file: "), F.col("record")))
    is_row = (
        F.when(F.col("kind") != FIRST, F.trim("record") != "")
        .when(F.col("record") == first["record"], False)
        .otherwise(other.cast("boolean"))
    )
    rows = records.where(is_row).select("record", parsed(F.col("record"), width + 1).alias("c"))
    surplus = F.when(F.col(f"c.c{width}").isNotNull(), F.col("record")).alias(BROKEN)
    return found, rows.select(*[F.col(f"c.c{i}").alias(n) for i, n in enumerate(found)], surplus)


def _width(record: str) -> int:
    """The number of cells of a record."""
    quotes = Quotes(blanks=True)
    cells, inside = 0, False
    for part in record.split(","):
        inside = quotes.after(part, inside)
        cells += not inside
    return cells


def _plain_cells(
    spark: SparkSession, path: str, header: list[str], names: list[str] | None, options: dict
) -> DataFrame:
    """Cells of files in which every line is a record."""
    if names is not None and names != header:
        raise ValueError(f"The header is {header}, not {names}.")
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*header, BROKEN]])
    raw = spark.read.schema(schema).csv(
        path, header=True, enforceSchema=False, columnNameOfCorruptRecord=BROKEN, **options
    )
    cells = ", ".join(f"c{i} string" for i in range(len(header) + 1))
    parsed = F.from_csv(F.col(BROKEN), F.lit(cells), {"quote": '"', "escape": '"'})
    surplus = F.when(parsed[f"c{len(header)}"].isNotNull(), F.col(BROKEN))
    return raw.withColumn(BROKEN, surplus)


def _refuse_surplus(record: str | None) -> None:
    if record is not None:
        raise ValueError(f"A record has more cells than the header: {record[:200]}")


CSV_OPTIONS = {"quote": '"', "escape": '"', "mode": "PERMISSIVE"}


def _kind(text: Column) -> Column:
    """0 boolean, 1 integer, 2 double, 3 text; NULL for a missing cell."""
    return (
        F.when(text.isNull(), None)
        .when(text.isin(TRUE_TOKENS + FALSE_TOKENS), F.lit(0))
        .when(
            F.trim(text).rlike(INTEGER_PATTERN) & F.trim(text).try_cast("bigint").isNotNull(),
            F.lit(1),
        )
        .when(F.trim(text).rlike(NUMBER_PATTERN) | F.trim(text).rlike(INFINITY_PATTERN), F.lit(2))
        .otherwise(F.lit(3))
    )


def read_csv(
    spark: SparkSession, path: str, multiline: bool = True, check_quotes: bool = True,
    schema: T.StructType | None = None,
) -> DataFrame:
    """Read CSV with a header; one aggregate over the cells decides each column's type.

    Missing-value tokens become NULL and date-looking text stays text. Records end with a line feed,
    with or without a carriage return. Records with more cells than the header and files with
    another header are refused; missing cells at the end of a record are NULL. Quoted cells may hold
    line breaks: a first pass over the lines with quotes finds out where records begin. With
    `multiline=False` there are none, and that pass only looks for quotes that never end, unless
    `check_quotes` is false. With a `schema` no pass is needed for the types: its names must be those
    of the header, and cells are cast to its types (one that cannot be fails the job).
    """
    if schema is not None:
        _, raw = _cells(spark, path, multiline, check_quotes, CSV_OPTIONS, schema.names)
        refused = F.raise_error(F.concat(F.lit("More cells than the header: "), F.col(BROKEN)))
        return raw.select(
            *[
                F.when(F.col(BROKEN).isNotNull(), refused.cast(f.dataType))
                .when(~col(f.name).isin(MISSING_TOKENS), col(f.name).cast(f.dataType))
                .alias(f.name)
                for f in schema.fields
            ]
        )
    names, raw = _cells(spark, path, multiline, check_quotes, CSV_OPTIONS)
    raw = raw.select(
        *[F.when(~col(n).isin(MISSING_TOKENS), col(n)).alias(n) for n in names], BROKEN
    )
    kinds = raw.agg(
        *[
            F.struct(F.min(_kind(col(n))).alias("low"), F.max(_kind(col(n))).alias("high")).alias(
                str(i)
            )
            for i, n in enumerate(names)
        ],
        F.max(BROKEN).alias(BROKEN),
    ).first()
    _refuse_surplus(kinds[BROKEN])

    def typed(name: str, low: int | None, high: int | None) -> Column:
        text = F.trim(col(name))
        if low is None:
            return F.lit(None).cast("double")
        if high == 0:
            return col(name).isin(TRUE_TOKENS)
        if low == 0 or high == 3:
            return col(name)
        return text.try_cast("bigint" if high == 1 else "double")

    return raw.select(*[typed(n, *kinds[str(i)]).alias(n) for i, n in enumerate(names)])


def read_lenient_csv(
    spark: SparkSession, path: str, multiline: bool = True
) -> DataFrame:
    """Read CSV forgivingly: cells trimmed, blank records dropped, empty cells NULL.

    A column turns numeric only if every cell in it reads as a number. A file without
    data rows is an error, and so is a record with more cells than the header. All rows are
    read; for the first ones by some keys see `ranking.head`.
    """
    trimmed = {"ignoreLeadingWhiteSpace": True, "ignoreTrailingWhiteSpace": True}
    names, raw = _cells(spark, path, multiline, False, CSV_OPTIONS | trimmed)
    raw = raw.select(
        *[F.when(F.trim(col(n)) != "", F.trim(col(n))).alias(n) for n in names], BROKEN
    )
    raw = raw.na.drop(how="all")
    facts = raw.agg(
        F.count(F.lit(1)).alias("rows"),
        *[
            F.coalesce(F.bool_and(as_number(col(n)).isNotNull() | col(n).isNull()), F.lit(False))
            .alias(str(i))
            for i, n in enumerate(names)
        ],
        *[F.count(col(n)).alias(f"n{i}") for i, n in enumerate(names)],
        F.max(BROKEN).alias(BROKEN),
    ).first()
    _refuse_surplus(facts[BROKEN])
    if facts["rows"] == 0:
        raise ValueError("There are no data rows below the header.")
    return raw.select(
        *[
            (as_number(col(n)) if facts[str(i)] and facts[f"n{i}"] else col(n)).alias(n)
            for i, n in enumerate(names)
        ]
    )
