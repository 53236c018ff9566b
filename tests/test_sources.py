import zipfile

import pytest
from pyspark.sql import functions as F

from insight_spark.plans.office_samples import word_file, workbook_file
from insight_spark.session import fresh_path, shared_dir
from insight_spark.sources import chunk_store, csv_records, files, ingest, sinks, tables


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "sales.csv").write_text('Month,Revenue,Note\nJan,450000,"a, ""b"""\nFeb,,"two\nlines"\n')
    (tmp_path / "notes.txt").write_bytes("Grüße an alle.".encode() + b"\xff" + " Ende".encode())
    (tmp_path / "plan.docx").write_bytes(word_file(["Title", "", "Body & more"], [[["k", "v"], ["a", "1"]]]))
    (tmp_path / "book.xlsx").write_bytes(workbook_file({"Data": [["ID", "Name", "Price"], [1, "one", 1.5], [2, None, 2.5]], "Other": [["x"], ["y"]]}))
    (tmp_path / "broken.docx").write_bytes(b"not a zip")
    (tmp_path / "image.png").write_bytes(b"png")
    return tmp_path


def test_csv(spark, folder):
    df = files.scan_csv(spark, str(folder / "sales.csv"))
    assert sorted(map(tuple, df.collect()), reverse=True) == [("Jan", 450000, 'a, "b"'), ("Feb", None, "two\nlines")]
    typed = files.scan_csv(spark, str(folder / "sales.csv"), "Month string, Revenue double, Note string")
    assert typed.schema["Revenue"].dataType.simpleString() == "double"


def test_text_with_bad_bytes(spark, folder):
    row = files.scan_text(files.binary_files(spark, str(folder), "*.txt")).first()
    assert row["text"] == "Grüße an alle.� Ende" and row["source"] == "notes.txt"


def test_docx(spark, folder):
    rows = files.scan_docx(files.binary_files(spark, str(folder), "plan.docx")).collect()
    texts = {(r["type"], r["position"]): r["text"] for r in rows}
    assert texts == {
        ("docx_summary", None): "Word Document: plan.docx\nParagraphs: 2\nTables: 1",
        ("docx_paragraph", 0): "From plan.docx, Paragraph 0:\nTitle", ("docx_paragraph", 2): "From plan.docx, Paragraph 2:\nBody & more",
        ("docx_table", 0): "From plan.docx, Table 0:\nk | v\na | 1",
    }


def test_workbook(spark, folder):
    found = files.binary_files(spark, str(folder), "*.xlsx")
    rows = files.scan_workbook(found).orderBy("row").collect()
    assert [(r["ID"], r["Name"], r["Price"]) for r in rows] == [("1", "one", "1.5"), ("2", None, "2.5")]
    chunks = files.workbook_chunks(found).collect()
    assert {r["sheet"] for r in chunks} == {"Data", "Other"}
    assert "From book.xlsx, Sheet 'Data', Row 1:\nID: 2, Name: nan, Price: 2.5" in {r["text"] for r in chunks}
    assert any(r["text"].startswith("Excel File: book.xlsx, Sheet: Data\nColumns: ID, Name, Price\nTotal Rows: 2") for r in chunks)


def test_ingest(spark, folder):
    paths = [str(folder / n) for n in ("sales.csv", "notes.txt", "plan.docx", "book.xlsx", "broken.docx", "image.png", "missing.txt")]
    chunks, status = ingest.ingest_paths(spark, paths, "0123456789", fresh_path(spark, "tables"))
    got = {r["filename"]: (r["type"], r["status"], r["sql_table"]) for r in status.collect()}
    assert got == {
        "sales.csv": ("hybrid", "ready", "upload_01234567_sales"), "notes.txt": ("document", "ready", None),
        "plan.docx": ("document", "ready", None), "book.xlsx": ("hybrid", "ready", "upload_01234567_book"),
        "broken.docx": ("document", "error", None), "image.png": (None, "skipped", None),
    }
    assert dict(spark.table("upload_01234567_book").dtypes) == {"ID": "bigint", "Name": "string", "Price": "double"}
    assert spark.table("upload_01234567_sales").count() == 2
    rows = chunks.collect()
    assert {(r["source"], r["chunk_type"]) for r in rows} >= {
        ("sales.csv", "row_narrative"), ("sales.csv", "dataset_overview"), ("book.xlsx", "row_narrative"), ("plan.docx", "docx_table"), ("notes.txt", "txt"),
    }
    assert 'Jan — Revenue: $450,000. Note: a, "b".' in {r["text"].split(" ", 1)[1] for r in rows if r["source"] == "sales.csv"}
    assert all(r["columns"] == ["Month", "Revenue", "Note"] for r in rows if r["source"] == "sales.csv")


def test_ingest_without_tables(spark, folder):
    listing = files.binary_files(spark, str(folder)).select("path", "content")
    chunks, status = ingest.ingest_files(listing, "0123456789")
    got = {r["filename"]: (r["type"], r["status"], r["chunks"]) for r in status.collect()}
    assert got == {
        "sales.csv": ("hybrid", "ready", 2), "notes.txt": ("document", "ready", 1), "plan.docx": ("document", "ready", 4),
        "book.xlsx": ("hybrid", "ready", 5), "broken.docx": ("document", "error", 0), "image.png": (None, "skipped", 0),
    }
    texts = {r["text"] for r in chunks.filter("source = 'sales.csv'").collect()}
    assert texts == {
        'From sales.csv, Row 0:\nMonth: Jan, Revenue: 450000, Note: a, "b"', "From sales.csv, Row 1:\nMonth: Feb, Revenue: nan, Note: two\nlines",
    }


def test_missing_files(spark, folder):
    with pytest.raises(FileNotFoundError):
        ingest.ingest_paths(spark, [str(folder / "missing.txt")], "x")


def test_pages(spark):
    pages = spark.createDataFrame(
        [(1, "<html><script>var a='</p>';</script><p>Hi&nbsp;<b>you</b> &amp; me</p><!-- no --></html>"), (2, "<p> </p>"), (3, "x &lt; y")], "id int, html string"
    )
    rows = files.pages_to_documents(pages, F.lit("site"), "id").orderBy("page").collect()
    assert [(r["page"], r["text"]) for r in rows] == [
        (None, "Document: site\nTotal Pages: 3"), (1, "From site, Page 1:\nHi you & me"), (3, "From site, Page 3:\nx < y"),
    ]


def test_jdbc_options():
    options = tables.jdbc_options("postgresql", "sales", "u", "p", "id", 0, 1000, 8, host="h", port=5432, database="d")
    assert options["url"] == "jdbc:postgresql://h:5432/d" and options["numPartitions"] == "8" and options["upperBound"] == "1000"
    assert tables.jdbc_options("sqlite", "t", path="/x.db")["url"] == "jdbc:sqlite:/x.db"
    with pytest.raises(ValueError):
        tables.jdbc_options("oracle", "t")
    with pytest.raises(ValueError):
        tables.jdbc_options("mysql", "t", partition_column="id", host="h", port=1, database="d")


def test_tables(spark):
    df = spark.createDataFrame([(1, "a")], "id int, name string")
    mine = tables.upload_table_name("aaaaaaaa-1", "my file.csv")
    other = tables.upload_table_name("bbbbbbbb-1", "my file.csv")
    for name in (mine, other):
        tables.write_table(df, name, fresh_path(spark, "table"))
    assert [r[0] for r in tables.list_tables(spark, "aaaaaaaa-1").collect()] == [mine]
    assert tables.drop_session_tables(spark, "aaaaaaaa-1") == [mine]
    assert tables.drop_session_tables(spark) == [other] or other not in [r[0] for r in tables.list_tables(spark).collect()]
    schema = tables.table_schema(spark, {"t": df})
    assert tables.schema_text(schema).first()["text"] == "Table: t\nColumns:\n  - id (int) NULL\n  - name (string) NULL"


def test_chunk_store(spark):
    path = fresh_path(spark, "store")
    rows = [(str(i), "hot" if i % 3 else "cold", f"text {i}", [0.5, 0.25]) for i in range(30)]
    df = spark.createDataFrame(rows, "chunk_id string, conversation_id string, text string, embedding array<float>")
    chunk_store.write_chunks(df, path)
    assert chunk_store.read_chunks(spark, path, "cold").count() == 10
    # Writing one conversation again leaves the other alone.
    chunk_store.write_chunks(df.filter("chunk_id = '0'"), path)
    assert chunk_store.read_chunks(spark, path, "cold").count() == 1
    assert chunk_store.read_chunks(spark, path, "hot").count() == 20
    assert chunk_store.delete_chunks(spark, path, "hot")
    assert {r["conversation_id"] for r in chunk_store.read_chunks(spark, path).collect()} == {"cold"}
    plan = chunk_store.read_chunks(spark, path, "cold")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(conversation_id" in plan


def test_shared_dir_needs_setting_on_a_cluster(spark, monkeypatch):
    assert shared_dir(spark) == shared_dir(spark)


def test_csv_splits_unless_quoted_breaks_need_it(spark, tmp_path):
    (tmp_path / "plain.csv").write_text("a,b\n" + "\n".join(f'{i},"x, {i}"' for i in range(60_000)))
    (tmp_path / "broken.csv").write_text('a,b\n1,"x\ny"\n')
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        df = files.scan_csv(spark, str(tmp_path / "plain.csv"))
        assert df.rdd.getNumPartitions() > 1 and df.count() == 60_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [tuple(r) for r in files.scan_csv(spark, str(tmp_path / "broken.csv")).collect()] == [(1, "x\ny")]


def test_csv_records_with_long_fields(spark):
    long = "word, " * 20_000
    text = f'id,note\n1,"{long}""q"" end"\n2,"two\nlines"\n3,\n4,""\n'
    listing = spark.createDataFrame([("/in/a.csv", bytearray(text.encode()))], "path string, content binary")
    rows = {r["row"]: r["text"].split("\n", 1)[1] for r in ingest.csv_row_chunks(csv_records.records(csv_records.content_lines(listing))).collect()}
    assert rows == {0: f'id: 1, note: {long}"q" end', 1: "id: 2, note: two\nlines", 2: "id: 3, note: nan", 3: "id: 4, note: nan"}


def test_ingest_keeps_every_chunk(spark):
    text = "\n\n".join(f"paragraph {i} " + "x" * 900 for i in range(5200))
    listing = spark.createDataFrame([("/in/a.txt", bytearray(text.encode()))], "path string, content binary")
    chunks, status = ingest.ingest_files(listing, "c")
    assert chunks.count() == status.first()["chunks"] == 5200
    assert ingest.ingest_files(listing, "c", cap=100)[0].count() == 100


def test_streamed_chunks_can_be_deleted(spark):
    path = fresh_path(spark, "store")
    df = spark.createDataFrame([("1", "a", "x"), ("2", "b", "y")], "chunk_id string, conversation_id string, text string")
    chunk_store.write_chunks(df, f"{path}/batch=0")
    assert chunk_store.delete_chunks(spark, path, "a") and not chunk_store.delete_chunks(spark, path, "c")
    assert [r["chunk_id"] for r in chunk_store.read_chunks(spark, path).collect()] == ["2"]


def test_pages_without_a_host_or_number(spark):
    pages = spark.createDataFrame([(1, None, "a"), (2, None, "b"), (None, "h", "c")], "id int, host string, html string")
    rows = files.pages_to_documents(pages, F.col("host"), "id").filter("type = 'page'").collect()
    assert sorted((str(r["source"]), r["page"], r["total_pages"]) for r in rows) == [("None", 1, 2), ("None", 2, 2), ("h", 1, 1)]


def test_report(spark):
    path = fresh_path(spark, "report")
    sinks.write_report("R", {"a": spark.createDataFrame([(1, "x")], "n int, s string")}, path)
    assert "n: 1, s: x" in [r[0] for r in spark.read.text(path).collect()]
