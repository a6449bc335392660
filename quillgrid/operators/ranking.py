"""Pages, samples, listings and the latest record per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgrid.functions.columns import col
from quillgrid.operators.columns import PREVIEW_COLUMNS

# The largest page, and the largest batch a retention run may remove.
MAX_PAGE_SIZE = 100
MAX_BATCH = 10_000

#: Rows of a piece of a ranked table.
PIECE_ROWS = 1_000_000
#: Rows of a folder, which one task ranks and writes; pieces with fewer rows share one.
FOLDER_ROWS = 250_000
#: Places inside a task in the numbers of `monotonically_increasing_id`.
PLACE_BITS = 33


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """Page `number` (from 1) of `size` rows, in the order of the given keys.

    All rows up to the page are ranked; a table written by `write_ranked` has pages that are not.
    """
    if number < 1 or not 1 <= size <= MAX_PAGE_SIZE:
        raise ValueError(f"Pages start at 1 and hold 1 to {MAX_PAGE_SIZE} rows.")
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def write_ranked(df: DataFrame, order: list[Column], path: str, piece_rows: int = PIECE_ROWS) -> None:
    """Write a table in pieces of some `piece_rows` rows that follow each other in the given order,
    and beside them an index with the number of rows before each piece.

    Small pieces follow each other in a folder, `_pieces`, where Parquet's statistics of `_piece` tell
    them apart; so tasks and files become no more than the rows ask for, however small the pieces.
    The order should be total, or rows that tie may be on either side of a page's border.
    """
    spark = df.sparkSession
    folders = max(1, -(-df.count() // max(piece_rows, FOLDER_ROWS)))
    dealt = df.repartitionByRange(folders, *order).withColumn("_pieces", F.spark_partition_id())
    ranked = dealt.sortWithinPartitions("_pieces", *order).withColumn("_place", F.monotonically_increasing_id())
    inside = F.col("_place").bitwiseAND((1 << PLACE_BITS) - 1)
    piece = F.col("_place") - inside + F.floor(inside / piece_rows)
    ranked.withColumn("_piece", piece).drop("_place").write.partitionBy("_pieces").parquet(f"{path}/rows")
    sizes = spark.read.parquet(f"{path}/rows").groupBy("_pieces", "_piece").agg(F.count(F.lit(1)).alias("rows"))
    # One row per piece.
    before = F.sum("rows").over(Window.orderBy("_piece")) - F.col("rows")
    sizes.withColumn("before", before).coalesce(1).write.parquet(f"{path}/index")


def ranked_page(
    spark: SparkSession, path: str, order: list[Column], number: int, size: int
) -> DataFrame:
    """Page `number` of a table that `write_ranked` wrote in this order: only the pieces that hold the
    page are ranked, one or two of them unless pieces are smaller than pages, and little beside them is
    read."""
    if number < 1 or not 1 <= size <= MAX_PAGE_SIZE:
        raise ValueError(f"Pages start at 1 and hold 1 to {MAX_PAGE_SIZE} rows.")
    start = (number - 1) * size
    holds = (F.col("before") < start + size) & (F.col("before") + F.col("rows") > start)
    index = spark.read.parquet(f"{path}/index").where(holds).collect()
    rows = spark.read.parquet(f"{path}/rows").where(
        F.col("_pieces").isin(sorted({r["_pieces"] for r in index})) & F.col("_piece").isin([r["_piece"] for r in index])
    )
    skipped = start - min((r["before"] for r in index), default=start)
    return rows.drop("_piece", "_pieces").orderBy(*order).offset(skipped).limit(size)


def head(df: DataFrame, order: list[Column] | None, rows: int) -> DataFrame:
    """The first rows by the given keys; without keys, any rows."""
    return (df.orderBy(*order) if order else df).limit(rows)


def newest_first(df: DataFrame, moment: str, key: str) -> DataFrame:
    return df.orderBy(col(moment).desc(), col(key).asc())


def page_facts(df: DataFrame, number: int, size: int, width: int = PREVIEW_COLUMNS) -> DataFrame:
    """One row beside a page: total rows and columns, hidden columns, page and page size."""
    columns = len(df.columns)
    return df.agg(F.count(F.lit(1)).alias("total_rows")).select(
        "total_rows",
        F.lit(columns).alias("total_columns"),
        F.lit(max(0, columns - width)).alias("columns_truncated"),
        F.lit(number).alias("page"),
        F.lit(size).alias("page_size"),
    )


def page_after(df: DataFrame, keys: list[str], last: tuple, size: int) -> DataFrame:
    """The `size` rows behind the row whose ascending keys are `last`.

    However far the page, only rows behind it are ranked, and none are skipped over.
    """
    behind = F.lit(False)
    for i in reversed(range(len(keys))):
        key = col(keys[i])
        behind = (key > F.lit(last[i])) | ((key == F.lit(last[i])) & behind)
    return df.filter(behind).orderBy(*[col(k).asc() for k in keys]).limit(size)


def oldest_batch(
    df: DataFrame, condition: Column, moment: str, key: str, batch: int,
    maximum: int | None = MAX_BATCH,
) -> DataFrame:
    """The oldest matching rows, at least one and never more than the maximum.

    A larger `batch` is cut to the maximum; None lifts it.
    """
    size = max(batch, 1) if maximum is None else min(max(batch, 1), maximum)
    return df.filter(condition).orderBy(col(moment).asc(), col(key).asc()).limit(size)


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the greatest by the order columns, which must be unique per key.

    A maximum over a struct, not a ranking window: each task first reduces its own rows, so
    a key that holds a large share of the table is never sorted in one place.
    """
    rest = [c for c in df.columns if c not in keys and c not in order]
    best = F.max(F.struct(*[col(c) for c in order + rest]))
    grouped = df.groupBy(*[col(k) for k in keys]).agg(best.alias("_best"))
    return grouped.select(
        *[col(c) if c in keys else F.col("_best")[c].alias(c) for c in df.columns]
    )
