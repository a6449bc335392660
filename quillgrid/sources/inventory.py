"""Facts about stored files, read without their content."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrid.sources.ranges import RangedFile

# Fixed value: how many leading bytes of a text file are looked at.
SNIFF_BYTES = 1024


def file_inventory(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """`path, size, modified` of every file below a folder; the content is not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob)
    return files.option("recursiveFileLookup", "true").load(path).select(
        "path", F.col("length").alias("size"), F.col("modificationTime").alias("modified")
    )


def sizes_of(references: DataFrame, inventory: DataFrame, path: str = "path") -> DataFrame:
    """Add `size` to referenced paths; a missing file counts as 0 bytes."""
    sizes = inventory.select(F.col("path").alias(path), "size")
    joined = references.join(sizes, path, "left")
    return joined.withColumn("size", F.coalesce("size", F.lit(0).cast("bigint")))


def text_sniff(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """`path, valid_text`: a NUL byte near the start marks a file as no text.

    Spark lists the files; a task reads the first bytes of each of its files and no more. See
    `ranges.located` for the file systems that tasks can reach.
    """

    def sniff(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = batch.column("path").to_pylist()
            yield pa.record_batch([pa.array(paths, pa.string()), pa.array(map(is_text, paths), pa.bool_())],
                                  ["path", "valid_text"])

    listed = file_inventory(spark, path, glob).select("path")
    return listed.mapInArrow(sniff, "path string, valid_text boolean")


def is_text(path: str) -> bool:
    with RangedFile(path) as file:
        return b"\0" not in file.read(0, SNIFF_BYTES)
