import json
import os
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgrid.session import work_folder
from quillgrid.sources import inventory, readers, writers


@pytest.fixture
def put(tmp_path):
    def write(text, name="data.csv"):
        path = tmp_path / name
        path.write_bytes(text if isinstance(text, bytes) else text.encode())
        return str(path)

    return write


def test_csv_types(spark, put, rows):
    path = put(
        "order_id,order_date,customer,total,flag,blank\n"
        "1001,2026-01-03,Ada,240.5,True,\n1002,2026-01-04,NA,,false,\n1003,2026-01-05,Cem,3e2,,\n"
    )
    df = readers.load_dataset(spark, path)
    assert df.dtypes == [
        ("order_id", "bigint"), ("order_date", "string"), ("customer", "string"),
        ("total", "double"), ("flag", "boolean"), ("blank", "double"),
    ]
    assert rows(df)[1] == (1002, "2026-01-04", None, None, False, None)


def test_csv_repeated_and_empty_headers(spark, put):
    df = readers.read_csv(spark, put("a,a,,a.1\n1,2,3,4\n"))
    assert df.columns == ["a", "a.1", "Unnamed: 2", "a.1.1"]
    assert tuple(df.first()) == (1, 2, 3, 4)


def test_csv_number_lookalikes_stay_text(spark, put):
    df = readers.read_csv(spark, put("a,b,c\n1d,1_0,0x10\n2,3,4\n"))
    assert [t for _, t in df.dtypes] == ["string", "string", "string"]


def test_csv_quotes(spark, put, rows):
    path = put('customer,note\n"Doe, Jane","said ""hi""\nand left"\nBob,plain\n')
    assert rows(readers.read_csv(spark, path)) == [
        ("Doe, Jane", 'said "hi"\nand left'), ("Bob", "plain")
    ]


@pytest.mark.parametrize("text", ['"unterminated', 'a,b\n"x,1\n', 'a,b\nx,"1\n'])
def test_csv_quote_that_never_ends(spark, put, text):
    with pytest.raises(ValueError, match="never ends"):
        readers.read_csv(spark, put(text))


@pytest.mark.parametrize("multiline", [True, False])
def test_csv_stray_quotes_are_text(spark, put, rows, multiline):
    path = put('a,b\n5" pipe,x\n"""q"" z",""\n"a, b",7" x 9"\n')
    assert rows(readers.read_csv(spark, path, multiline=multiline)) == [
        ('5" pipe', "x"), ('"q" z', None), ("a, b", '7" x 9"'),
    ]


def test_csv_surplus_cells_are_refused(spark, put, rows):
    for read in (readers.read_csv, readers.read_lenient_csv):
        with pytest.raises(ValueError, match="more cells than the header: 3,4,5"):
            read(spark, put("a,b\n1,2\n3,4,5\n"))
    assert rows(readers.read_csv(spark, put("a,b,c\n1,2,3\n4\n"))) == [(1, 2, 3), (4, None, None)]


def test_csv_files_with_other_headers_are_refused(spark, tmp_path):
    (tmp_path / "one.csv").write_text("a,b\n1,2\n")
    (tmp_path / "two.csv").write_text("b,a\n3,4\n")
    with pytest.raises(Exception, match="header"):
        readers.read_csv(spark, str(tmp_path))


def test_csv_with_a_schema(spark, put, rows):
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("d", T.DateType())])
    df = readers.read_csv(spark, put("a,d\n1,2024-01-02\nNA,\n"), check_quotes=False, schema=schema)
    assert df.schema.simpleString() == "struct<a:int,d:date>"
    assert [str(r) for r in rows(df)] == ["(1, datetime.date(2024, 1, 2))", "(None, None)"]
    with pytest.raises(Exception, match="More cells"):
        readers.read_csv(spark, put("a,d\n1,2024-01-02,9\n"), schema=schema).collect()


def test_filters_of_text_formats(spark, put, rows):
    rules = {"a": {"gte": 2}}
    assert rows(readers.load_dataset(spark, put("a,b\n1,x\n2,y\n"), where=rules)) == [(2, "y")]
    path = put('{"a": 1, "b": "x"}\n{"a": 2, "b": "y"}\n', "d.jsonl")
    assert rows(readers.load_dataset(spark, path, where=rules)) == [(2, "y")]


def test_lenient_csv(spark, put, rows):
    path = put('customer,product,total\r\n "Doe, Jane" , Desk ,75\r\n,,\r\n\r\nBob,"a ""b""",\r\n')
    df = readers.read_lenient_csv(spark, path)
    assert rows(df) == [("Doe, Jane", "Desk", 75.0), ("Bob", 'a "b"', None)]
    with pytest.raises(ValueError, match="data rows"):
        readers.read_lenient_csv(spark, put("a,b\n", "header.csv"))
    many = put("v\n" + "\n".join(map(str, range(250))) + "\n", "many.csv")
    assert readers.read_lenient_csv(spark, many).count() == 250


def test_lenient_csv_mixed_column_stays_text(spark, put, rows):
    df = readers.read_lenient_csv(spark, put("v\n1\nx\n"))
    assert rows(df) == [("1",), ("x",)]


def test_json(spark, put, rows):
    path = put('[{"a": 1, "created_at": "2024-01-02"},\n {"a": null, "created_at": null}]', "d.json")
    df = readers.load_dataset(spark, path)
    assert rows(df) == [(1, "2024-01-02"), (None, None)]
    typed = readers.read_json(spark, path, timestamps=["created_at"])
    assert dict(typed.dtypes)["created_at"] == "timestamp"


def test_unknown_suffix(spark):
    with pytest.raises(ValueError, match="No reader"):
        readers.load_dataset(spark, "/tmp/data.xml")
    with pytest.raises(ValueError, match="No writer"):
        writers.write_dataset(spark.range(1), "/tmp/never", "xml")


@pytest.mark.parametrize("fmt", ["csv", "json", "parquet"])
def test_round_trip(spark, fmt):
    df = spark.createDataFrame([("A", 1.5), ("B", 2.5), ("Ü,\"", None)], "category string, amount double")
    path = work_folder(spark, "test")
    writers.write_dataset(df, path, fmt)
    back = readers.load_dataset(spark, path, "jsonl" if fmt == "json" else fmt)
    back = back.select("category", "amount")
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
    with pytest.raises(Exception, match="already exists"):
        writers.write_dataset(df, path, fmt)


def test_json_keeps_missing_fields(spark):
    path = work_folder(spark, "test")
    writers.write_json(spark.createDataFrame([(None, "é")], "a int, b string").coalesce(1), path)
    assert spark.read.text(path).first()[0] == '{"a":null,"b":"é"}'


def test_parquet_nan_and_pushdown(spark, rows):
    path = work_folder(spark, "test")
    spark.createDataFrame([(float("nan"),), (1.0,), (9.0,)], "v double").write.parquet(path)
    assert sorted(rows(readers.read_parquet(spark, path)), key=str) == [(1.0,), (9.0,), (None,)]
    found = readers.read_parquet(spark, path, {"v": {"gte": 5}})
    assert rows(found) == [(9.0,)]
    plan = found._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(v), GreaterThanOrEqual(v,5.0)]" in plan


def test_text_sniff(spark, tmp_path):
    (tmp_path / "good.csv").write_bytes(b"a,b\n\x10\x01,2\n")
    (tmp_path / "bad.csv").write_bytes(b"a\x00b")
    (tmp_path / "late.csv").write_bytes(b"x" * 1024 + b"\x00")
    found = inventory.text_sniff(spark, str(tmp_path), "*.csv").collect()
    assert {os.path.basename(r.path): r.valid_text for r in found} == {
        "good.csv": True, "bad.csv": False, "late.csv": True
    }


def test_inventory_and_missing_files(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"12345")
    files = inventory.file_inventory(spark, str(tmp_path))
    assert [(os.path.basename(r.path), r.size) for r in files.collect()] == [("a.bin", 5)]
    names = files.select(F.regexp_extract("path", "[^/]+$", 0).alias("path"), "size")
    references = spark.createDataFrame([("a.bin",), ("gone.bin",)], "path string")
    sized = inventory.sizes_of(references, names)
    assert {r.path: r.size for r in sized.collect()} == {"a.bin": 5, "gone.bin": 0}


def test_work_folder_follows_the_session():
    class Session:
        conf = {"spark.checkpoint.dir": "/tmp/shared-folder/"}

        class sparkContext:
            master = "local[2]"

    assert work_folder(Session, "x").startswith("/tmp/shared-folder/quillgrid-x-")
    Session.conf = {}
    assert "quillgrid-x-" in work_folder(Session, "x")
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]"):
        Session.sparkContext.master = master
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            work_folder(Session, "x")


@pytest.fixture
def small_ranges(spark):
    """Files are read in ranges of some bytes, so that records begin and end in other ranges."""

    def use(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", str(size))

    yield use
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def csv_text(cells, newline="\n"):
    quoted = [["" if c is None else '"' + c.replace('"', '""') + '"' if set(c) & set(',"\n\r ') else c for c in r] for r in cells]
    return newline.join(",".join(r) for r in quoted) + newline


@pytest.mark.parametrize("newline", ["\n", "\r\n"])
@pytest.mark.parametrize("size", [7, 40, 333, 10_000_000])
def test_csv_records_over_many_ranges(spark, tmp_path, small_ranges, newline, size):
    rng = random.Random(size)
    parts = ["a", "x,y", 'say "hi"', "\n", "\n\n", "5\" pipe", "\r\n", "é", '"', ",", " ", "long " * 9]
    count = 12 if size == 7 else 60
    folder = tmp_path / "csv"
    folder.mkdir()
    expected = []
    for name in ("one", "two"):
        rows = [[f"k{name}{i}", "".join(rng.choice(parts) for _ in range(rng.randrange(5))) or "z", rng.choice(["p", None])] for i in range(count)]
        expected += [tuple(r) for r in rows]
        (folder / f"{name}.csv").write_bytes(csv_text([["k", "text\nname", "a"], *rows], newline).encode())
    small_ranges(size)
    df = readers.read_csv(spark, str(folder))
    assert df.columns == ["k", "text\nname", "a"]
    assert sorted(map(tuple, df.collect())) == sorted(expected)
    if size < 1_000:
        assert df.rdd.getNumPartitions() > 4
    schema = T.StructType([T.StructField(n, T.StringType()) for n in df.columns])
    assert sorted(map(tuple, readers.load_dataset(spark, str(folder), "csv", schema=schema).collect())) == sorted(expected)


def test_csv_headers_of_every_file_are_compared(spark, tmp_path):
    (tmp_path / "one.csv").write_text("a,a\n1,2\n")
    (tmp_path / "two.csv").write_text("b,c\n3,4\n")
    with pytest.raises(Exception, match="header"):
        readers.read_csv(spark, str(tmp_path)).collect()
    (tmp_path / "two.csv").write_text('a,a\n3,"4\n5"\n')
    assert sorted(map(tuple, readers.read_csv(spark, str(tmp_path)).collect())) == [(1, "2"), (3, "4\n5")]


def test_csv_quote_that_never_ends_over_many_ranges(spark, put, small_ranges):
    small_ranges(20)
    text = 'a,b\n' + "x,y\n" * 30 + 'x,"1\n' + "x,y\n" * 30
    with pytest.raises(ValueError, match="never ends"):
        readers.read_csv(spark, put(text))
    assert readers.read_csv(spark, put(text), check_quotes=False).count() == 31


@pytest.mark.parametrize("size", [9, 64, 10_000_000])
def test_json_arrays_over_many_ranges(spark, tmp_path, small_ranges, size):
    rng = random.Random(size)
    texts = ["", "}", "{", "[{", '"', "\\", '\\"}', "]", "a\n}", "é", "x" * 30]
    records = [
        {"id": i, "t": "".join(rng.choice(texts) for _ in range(rng.randrange(4))), "s": {"u": [{"v": rng.choice(texts)}] * rng.randrange(3)}}
        for i in range(12 if size == 9 else 80)
    ]
    (tmp_path / "one.json").write_text(json.dumps(records[::2]))
    (tmp_path / "two.json").write_text(json.dumps(records[1::2], indent=2, ensure_ascii=False) + "\n")
    (tmp_path / "none.json").write_text(" [ ]\n")
    (tmp_path / "single.json").write_text('{"id": -1, "t": "}"}')
    small_ranges(size)
    df = readers.load_dataset(spark, str(tmp_path), "json")
    assert dict(df.dtypes) == {"id": "bigint", "s": "struct<u:array<struct<v:string>>>", "t": "string"}
    got = {r.id: r for r in df.collect()}
    assert len(got) == len(records) + 1 and got.pop(-1).t == "}"
    for r in records:
        assert got[r["id"]].t == r["t"] and [x.v for x in got[r["id"]].s.u] == [x["v"] for x in r["s"]["u"]]
    if size < 100:
        assert df.rdd.getNumPartitions() > 4
    slim = readers.load_dataset(spark, str(tmp_path), "json", schema=T.StructType([T.StructField("id", T.IntegerType())]))
    assert sorted(r.id for r in slim.collect()) == sorted([-1, *got])


@pytest.mark.parametrize("text", ['[{"a": 1}, {"a": ', '[{"a": "}', '[{"a": 1}, 5]', '[1, 2]', '[{"a": 1}'])
def test_broken_json_arrays_are_refused(spark, put, text):
    with pytest.raises(Exception, match="never end|Something else"):
        readers.read_json(spark, put(text, "d.json")).collect()


def test_array_files_are_bounded(spark, tmp_path, monkeypatch):
    """The documents are dealt to as many files as their bytes ask for, also if all ids are missing."""
    from quillgrid.suite import QUERIES, load_all, stored

    load_all()
    made = []
    monkeypatch.setattr(stored, "work_folder", lambda *_: made.append(str(tmp_path / f"out{len(made)}")) or made[-1])
    monkeypatch.setattr(stored, "ARRAY_FILE_BYTES", 20_000, raising=False)
    schema = "doc_id bigint, text string, lang string, source string, n_chars int"
    for n, files in ((3, 2), (400, 20)):
        folder = tmp_path / f"in{n}"
        df = spark.createDataFrame([(None, "x}\"{é\n" * 166, "en", None, i) for i in range(n)] + [(1, None, "de", "s", 0)], schema)
        df.write.parquet(str(folder / "documents.parquet"))
        got = QUERIES["source_json_array_files"](spark, str(folder))
        assert sorted(map(str, got.collect())) == sorted(map(str, df.collect()))
        sizes = [f.stat().st_size for f in (tmp_path / made[-1]).glob("part-*")]
        assert len(sizes) >= files and max(sizes) < 40_000
