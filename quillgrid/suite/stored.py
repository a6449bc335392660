"""Source and sink queries: whole tables are written to a shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgrid.session import work_folder
from quillgrid.sources import inventory, readers, writers
from quillgrid.suite import GAPPY, gappy_events, query, table


def texts(df):
    """Times as text, the form a text file keeps them in."""
    times = [f.name for f in df.schema.fields if "timestamp" in f.dataType.typeName()]
    return df.withColumns({name: F.col(name).cast("string") for name in times})


@query(
    "source_csv",
    """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice,
              strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate, o_orderpriority
       FROM orders""",
)
def source_csv(spark, sf):
    path = work_folder(spark, "csv")
    writers.write_csv(texts(table(spark, sf, "orders")), path)
    return readers.load_dataset(spark, path, "csv")


@query(
    "source_csv_missing_tokens",
    f"""WITH {GAPPY} SELECT event_id, event_type, value,
        user_id > 75 AS late FROM g""",
)
def source_csv_missing_tokens(spark, sf):
    """Missing cells are written as different tokens and all read back as missing."""
    path = work_folder(spark, "csv")
    events = gappy_events(spark, sf).select(
        "event_id",
        F.coalesce("event_type", F.lit("N/A")).alias("event_type"),
        F.coalesce(F.col("value").cast("string"), F.lit("null")).alias("value"),
        F.when(F.col("user_id") > 75, "True").otherwise("False").alias("late"),
    )
    writers.write_csv(events, path, quote_all=True)
    return readers.read_csv(spark, path)


@query(
    "source_csv_documents",
    "SELECT doc_id, trim(text, chr(32)) AS text, lang, source, n_chars FROM documents",
)
def source_csv_documents(spark, sf):
    """Line breaks, commas and quotes inside cells survive."""
    path = work_folder(spark, "csv")
    documents = table(spark, sf, "documents").withColumn("text", F.trim("text"))
    writers.write_csv(documents, path, quote_all=True)
    return readers.read_csv(spark, path, check_quotes=False)


@query(
    "source_csv_lenient",
    """SELECT p_partkey::DOUBLE AS p_partkey, p_name,
              CASE WHEN p_size > 10 THEN p_brand END AS p_brand, p_type,
              p_size::DOUBLE AS p_size, p_retailprice FROM part""",
)
def source_csv_lenient(spark, sf):
    path = work_folder(spark, "csv")
    parts = table(spark, sf, "part").withColumns(
        {
            "p_name": F.concat(F.lit("  "), F.col("p_name"), F.lit(" ")),
            "p_brand": F.when(F.col("p_size") > 10, F.col("p_brand")),
        }
    )
    parts.write.csv(path, header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return readers.read_lenient_csv(spark, path)


@query(
    "source_csv_filtered",
    "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 250000 AND o_orderstatus = 'F'",
)
def source_csv_filtered(spark, sf):
    """Filter rules hold for text formats too; the cells hold stray quotes."""
    path = work_folder(spark, "csv")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    lines = orders.select(
        F.concat_ws(",", "o_orderkey", "o_totalprice", "o_orderstatus", F.lit('5" pipe')).alias("value")
    )
    header = "o_orderkey,o_totalprice,o_orderstatus,note"
    lines.mapInArrow(header_first(header), "value string").write.text(path)
    rules = {"o_totalprice": {"gte": 250_000}, "o_orderstatus": {"eq": "F"}}
    return readers.load_dataset(spark, path, "csv", rules).select("o_orderkey", "o_totalprice")


def header_first(header: str):
    """Put a header line before the lines of each file."""

    def run(batches):
        import pyarrow as pa

        first = True
        for batch in batches:
            if first:
                yield pa.RecordBatch.from_arrays([pa.array([header])], schema=batch.schema)
            first = False
            yield batch

    return run


@query("source_json", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def source_json(spark, sf):
    path = work_folder(spark, "json")
    writers.write_json(table(spark, sf, "customer"), path)
    customers = readers.load_dataset(spark, path, "jsonl")
    return customers.withColumn("c_nationkey", F.col("c_nationkey").cast("int"))


@query(
    "source_json_missing",
    f"WITH {GAPPY} SELECT event_id, event_type, value, user_id, ts FROM g",
)
def source_json_missing(spark, sf):
    """Missing fields are written as null; times are text until they are cast."""
    path = work_folder(spark, "json")
    events = gappy_events(spark, sf).select("event_id", "event_type", "value", "user_id", "ts")
    writers.write_json(texts(events), path)
    back = readers.read_json(spark, path, lines=True, timestamps=["ts"])
    return back.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query(
    "source_json_array_files",
    """SELECT doc_id, text, lang, source, n_chars FROM documents""",
)
def source_json_array_files(spark, sf):
    """Every file is one array, with records in any number of lines; each is read by many tasks."""
    path = work_folder(spark, "json")
    documents = table(spark, sf, "documents")
    size = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    documents = documents.repartition(max(2, -(-size // ARRAY_FILE_BYTES)))
    records = documents.select(F.to_json(F.struct(*documents.columns), {"pretty": "true"}).alias("value"))
    records.mapInArrow(one_array, "value string").write.text(path)
    schema = documents.schema
    return readers.load_dataset(spark, path, "json", schema=schema)


#: Bytes of texts in a file of one array, which one task writes and several read.
ARRAY_FILE_BYTES = 256 << 20


def one_array(batches):
    """The lines of one array of all records of a task."""
    import pyarrow as pa

    before = "["
    for batch in batches:
        for text in batch.column("value").to_pylist():
            yield pa.RecordBatch.from_arrays([pa.array([before + text])], schema=batch.schema)
            before = ","
    yield pa.record_batch([pa.array(["]" if before == "," else "[]"])], ["value"])


@query("source_json_arrays", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def source_json_arrays(spark, sf):
    """Every line holds an array of at most a hundred records."""
    path = work_folder(spark, "json")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    packs = orders.groupBy(F.floor(F.col("o_orderkey") / 100).alias("pack")).agg(
        F.to_json(F.collect_list(F.struct(*orders.columns))).alias("value")
    )
    packs.select("value").write.text(path)
    return readers.read_json(spark, path, lines=True)


@query(
    "source_parquet",
    f"WITH {GAPPY} SELECT event_id, event_type, value FROM g",
)
def source_parquet(spark, sf):
    """Missing numbers are stored as NaN and read back as missing."""
    path = work_folder(spark, "parquet")
    events = gappy_events(spark, sf).select(
        "event_id", "event_type", F.coalesce("value", F.lit(float("nan"))).alias("value")
    )
    writers.write_parquet(events, path)
    return readers.load_dataset(spark, path, "parquet")


@query(
    "source_parquet_pushed_filter",
    f"WITH {GAPPY} SELECT event_id, value FROM g WHERE value >= 100",
)
def source_parquet_pushed_filter(spark, sf):
    path = work_folder(spark, "parquet")
    events = gappy_events(spark, sf).select(
        "event_id", F.coalesce("value", F.lit(float("nan"))).alias("value")
    )
    writers.write_dataset(events, path, "parquet")
    return readers.load_dataset(spark, path, "parquet", where={"value": {"gte": 100}})


def by_segment(spark, sf, fmt):
    """Customers in a folder per market segment and one of eight parts of it, each one file."""
    path = work_folder(spark, fmt)
    customers = table(spark, sf, "customer").withColumn("part", F.col("c_custkey") % 8)
    dealt = customers.repartition("c_mktsegment", "part")
    dealt.write.partitionBy("c_mktsegment", "part").format(fmt).save(path)
    return path


@query(
    "file_inventory",
    """SELECT c_mktsegment AS segment, count(DISTINCT c_custkey % 8) AS files, true AS sized
       FROM customer GROUP BY c_mktsegment""",
)
def file_inventory(spark, sf):
    files = inventory.file_inventory(spark, by_segment(spark, sf, "parquet"), "*.parquet")
    segment = F.regexp_extract("path", "c_mktsegment=([^/]+)/", 1)
    return files.groupBy(segment.alias("segment")).agg(
        F.count(F.lit(1)).alias("files"),
        F.bool_and((F.col("size") > 0) & (F.col("modified") <= F.now())).alias("sized"),
    )


@query(
    "file_text_sniff",
    "SELECT c_mktsegment AS segment, c_mktsegment <> 'MACHINERY' AS valid_text FROM customer"
    " GROUP BY c_mktsegment",
)
def file_text_sniff(spark, sf):
    """One segment's file starts with a NUL character."""
    path = work_folder(spark, "text")
    customers = table(spark, sf, "customer")
    broken = F.when(F.col("c_mktsegment") == "MACHINERY", F.unhex(F.lit("00")).cast("string"))
    customers.select(
        "c_mktsegment", F.concat(F.coalesce(broken, F.lit("")), F.col("c_name")).alias("value")
    ).write.partitionBy("c_mktsegment").text(path)
    segment = F.regexp_extract("path", "c_mktsegment=([^/]+)/", 1)
    return inventory.text_sniff(spark, path, "*.txt").select(segment.alias("segment"), "valid_text")
