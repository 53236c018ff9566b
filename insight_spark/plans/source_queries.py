"""Sources, sinks, catalog, chunk store, ingest and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from insight_spark.operators import evaluation as ev
from insight_spark.operators.retrieval import split_recursive
from insight_spark.operators.scale import spread_small
from insight_spark.plans.office_samples import word_files, workbooks
from insight_spark.plans.question_queries import ROUTE_SQL, messages, route_questions
from insight_spark.plans.registry import Tables, query
from insight_spark.session import fresh_path
from insight_spark.sources import chunk_store, files, ingest, sinks, tables
from insight_spark.streaming import jobs, rollup

CUSTOMER_SQL = "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer"


@query("scan_csv", "SELECT c_custkey, c_name, c_nationkey::BIGINT AS c_nationkey, c_acctbal, c_mktsegment FROM customer")
def scan_csv(t: Tables) -> DataFrame:
    """Customers written as CSV and read back with inferred types."""
    path = fresh_path(t.spark, "csv")
    t.customer.write.option("header", True).csv(path)
    found = files.scan_csv(t.spark, path)
    return found.select(
        F.col("c_custkey").cast("bigint"), "c_name", F.col("c_nationkey").cast("bigint"), "c_acctbal", "c_mktsegment"
    )


def text_files(t: Tables) -> DataFrame:
    """(path, content): every document as a UTF-8 file."""
    return t.documents.select(
        F.concat(F.lit("/in/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"),
        F.encode("text", "UTF-8").alias("content"),
    )


@query("scan_text", "SELECT '/in/' || doc_id || '.txt' AS path, doc_id || '.txt' AS source, 'txt' AS type, text FROM documents")
def scan_text(t: Tables) -> DataFrame:
    return files.scan_text(text_files(t))


WORD_SQL = """
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS i FROM documents),
paras AS (SELECT doc_id, i, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS line FROM lines WHERE regexp_matches(line, '\\S'))"""


@query("scan_docx", f"""
WITH {WORD_SQL}
SELECT doc_id || '.docx' AS source, 'docx_paragraph' AS type, i::INTEGER AS position, 'From ' || doc_id || '.docx, Paragraph ' || i || ':' || chr(10) || line AS text FROM paras
UNION ALL SELECT doc_id || '.docx', 'docx_table', 0, 'From ' || doc_id || '.docx, Table 0:' || chr(10) || 'doc | ' || doc_id || chr(10) || 'letters | ' || length(text) FROM documents
UNION ALL SELECT d.doc_id || '.docx', 'docx_summary', NULL, 'Word Document: ' || d.doc_id || '.docx' || chr(10) || 'Paragraphs: '
 || (SELECT count(*) FROM paras p WHERE p.doc_id = d.doc_id) || chr(10) || 'Tables: 1' FROM documents d""")
def scan_docx(t: Tables) -> DataFrame:
    """Every document as a Word file, read back as chunks."""
    made = word_files(spread_small(t.documents.select("doc_id", "text")))
    return files.scan_docx(made).drop("path")


@query("scan_workbook", """
SELECT '/in/book' || (p_partkey // 500) || '.xlsx' AS path, (p_partkey % 500)::INTEGER AS row, CAST(p_partkey AS VARCHAR) AS p_partkey, p_name,
 p_brand, p_type, CAST(p_size AS VARCHAR) AS p_size, CAST(p_retailprice AS VARCHAR) AS p_retailprice FROM part""")
def scan_workbook(t: Tables) -> DataFrame:
    """Parts as workbooks of 500 rows, read back from their first sheet."""
    return files.scan_workbook(workbooks(t.part, "p_partkey"), t.part.columns)


BOOK_ROW_SQL = (
    "'p_partkey: ' || p_partkey || ', p_name: ' || p_name || ', p_brand: ' || p_brand || ', p_type: ' || p_type"
    " || ', p_size: ' || p_size || ', p_retailprice: ' || p_retailprice"
)


@query("workbook_chunks", f"""
WITH b AS (SELECT 'book' || (p_partkey // 500) || '.xlsx' AS book, p_partkey % 500 AS i, {BOOK_ROW_SQL} AS line FROM part)
SELECT '/in/' || book AS path, 'Data' AS sheet, 'excel_row' AS type, i::INTEGER AS row, 'From ' || book || ', Sheet ''Data'', Row ' || i || ':' || chr(10) || line AS text FROM b
UNION ALL SELECT '/in/' || book, 'Data', 'excel', NULL, 'Excel File: ' || book || ', Sheet: Data' || chr(10)
 || 'Columns: p_partkey, p_name, p_brand, p_type, p_size, p_retailprice' || chr(10) || 'Total Rows: ' || count(*) || chr(10) || chr(10)
 || 'Sample:' || chr(10) || string_agg(line, chr(10) ORDER BY i) FILTER (i < 3) FROM b GROUP BY book
UNION ALL SELECT DISTINCT '/in/' || book, 'Notes', 'excel_row', 0, 'From ' || book || ', Sheet ''Notes'', Row 0:' || chr(10) || 'note: file ' || replace(replace(book, 'book', ''), '.xlsx', '') FROM b
UNION ALL SELECT DISTINCT '/in/' || book, 'Notes', 'excel', NULL::INTEGER, 'Excel File: ' || book || ', Sheet: Notes' || chr(10) || 'Columns: note' || chr(10)
 || 'Total Rows: 1' || chr(10) || chr(10) || 'Sample:' || chr(10) || 'note: file ' || replace(replace(book, 'book', ''), '.xlsx', '') FROM b""")
def workbook_chunks(t: Tables) -> DataFrame:
    return files.workbook_chunks(workbooks(t.part, "p_partkey"))


def _strip_sql(text: str) -> str:
    for pattern, options in (("<!--.*?-->", "gs"), ("<script\\b.*?</script>", "gis"), ("<style\\b.*?</style>", "gis"), ("<[^>]*>", "gs")):
        text = f"regexp_replace({text}, '{pattern}', ' ', '{options}')"
    for entity, character in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        text = f"replace({text}, '{entity}', '{character}')"
    return f"trim(regexp_replace({text}, '[\\s\\x{{00A0}}]+', ' ', 'g'))"


HOST_SQL = "regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)"


@query("pages_to_documents", f"""
WITH p AS (SELECT {HOST_SQL} AS source, page_id, {_strip_sql('html')} AS txt FROM pages),
n AS (SELECT source, CAST(row_number() OVER (PARTITION BY source ORDER BY page_id) AS INTEGER) AS page, CAST(count(*) OVER (PARTITION BY source) AS INTEGER) AS total_pages, txt FROM p)
SELECT source, 'page' AS type, page, total_pages, 'From ' || source || ', Page ' || page || ':' || chr(10) || txt AS text FROM n WHERE txt <> ''
UNION ALL SELECT source, 'page_summary', NULL, any_value(total_pages), 'Document: ' || source || chr(10) || 'Total Pages: ' || any_value(total_pages) FROM n GROUP BY source""")
def pages_to_documents(t: Tables) -> DataFrame:
    """Pages of a host as one document, numbered by page id."""
    host = F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1)
    return files.pages_to_documents(t.pages, host, "page_id")


# --- Catalog ----------------------------------------------------------------

def import_tables(t: Tables, conversation: str) -> list[str]:
    """Customers and suppliers as uploaded tables of one conversation."""
    names = []
    for source in ("customer", "supplier"):
        name = tables.upload_table_name(conversation, f"{source}.csv")
        names.append(tables.write_table(getattr(t, source), name, fresh_path(t.spark, "table")))
    return names


@query("write_table", CUSTOMER_SQL)
def write_table(t: Tables) -> DataFrame:
    """Customers imported as a table twice; the second import replaces the first."""
    name = tables.upload_table_name("5b1c0a7e-write", "customer.csv")
    tables.write_table(t.customer.limit(1), name, fresh_path(t.spark, "table"))
    tables.write_table(t.customer, name, fresh_path(t.spark, "table"))
    return t.spark.table(f"`{name}`")


@query("list_tables")
def list_tables(t: Tables) -> DataFrame:
    import_tables(t, "7d20e9f4-list")
    listed = tables.list_tables(t.spark, "7d20e9f4-list")
    return listed


@query("drop_session_tables")
def drop_session_tables(t: Tables) -> DataFrame:
    """Names dropped for one conversation; another conversation keeps its tables."""
    import_tables(t, "9e83b6c2-drop")
    gone = tables.drop_session_tables(t.spark, "9e83b6c2-drop")
    left = tables.list_tables(t.spark, "9e83b6c2-drop").count()
    return t.spark.createDataFrame([(name, left) for name in gone], "table_name string, left bigint")


@query("table_schema")
def table_schema(t: Tables) -> DataFrame:
    return tables.table_schema(t.spark, {name: getattr(t, name) for name in ("customer", "orders", "lineitem", "part", "events", "documents")})


@query("table_schema_text")
def table_schema_text(t: Tables) -> DataFrame:
    return tables.schema_text(table_schema(t))


@query("agg_metadata_shape", """
SELECT count(*) AS row_count, 6 AS column_count, 'o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority' AS columns FROM orders""")
def agg_metadata_shape(t: Tables) -> DataFrame:
    """Rows and columns of the metadata; types and file size have other names in DuckDB."""
    return agg_metadata(t).select("row_count", "column_count", "columns")


@query("agg_metadata")
def agg_metadata(t: Tables) -> DataFrame:
    listing = t.spark.read.format("binaryFile").load(f"{t.sf_dir}/orders.parquet").select("length")
    return tables.table_metadata(t.orders, listing)


# --- Chunk store ------------------------------------------------------------

def document_chunks(t: Tables) -> DataFrame:
    """Chunks of the documents; every source is one conversation."""
    docs = spread_small(t.documents.select("doc_id", "source", "text"))
    return split_recursive(docs).select(
        F.concat_ws("-", "doc_id", "chunk_no").alias("chunk_id"), F.col("source").alias("conversation_id"), "source",
        F.lit("document").alias("source_type"), F.lit("txt").alias("chunk_type"), F.col("chunk").alias("text"),
    )


@query("chunk_store_write", "SELECT DISTINCT source AS conversation_id FROM documents WHERE regexp_matches(text, '\\S')")
def chunk_store_write(t: Tables) -> DataFrame:
    path = fresh_path(t.spark, "chunks")
    chunk_store.write_chunks(document_chunks(t), path)
    return chunk_store.read_chunks(t.spark, path).select("conversation_id").distinct()


@query("chunk_store_read")
def chunk_store_read(t: Tables) -> DataFrame:
    """Everything that was stored, read back."""
    path = fresh_path(t.spark, "chunks")
    chunk_store.write_chunks(document_chunks(t), path)
    return chunk_store.read_chunks(t.spark, path).select("conversation_id", "chunk_id", "text")


@query("chunk_store_delete", "SELECT DISTINCT source AS conversation_id FROM documents WHERE regexp_matches(text, '\\S') AND source <> 'src1'")
def chunk_store_delete(t: Tables) -> DataFrame:
    """Conversations left in the store after one was deleted."""
    path = fresh_path(t.spark, "chunks")
    chunk_store.write_chunks(document_chunks(t), path)
    chunk_store.delete_chunks(t.spark, path, "src1")
    return chunk_store.read_chunks(t.spark, path).select("conversation_id").distinct()


def whole_chunks(t: Tables) -> DataFrame:
    """Every document as one chunk of the conversation named by its source."""
    return t.documents.select(
        F.col("doc_id").cast("string").alias("chunk_id"), F.col("source").alias("conversation_id"), "source",
        F.lit("document").alias("source_type"), F.lit("txt").alias("chunk_type"), "text",
    )


@query("chunk_store_rows", "SELECT source AS conversation_id, CAST(doc_id AS VARCHAR) AS chunk_id, text FROM documents")
def chunk_store_rows(t: Tables) -> DataFrame:
    """Chunks stored twice, the second time in place of the first, and read back whole."""
    path = fresh_path(t.spark, "chunks")
    chunk_store.write_chunks(whole_chunks(t).withColumn("text", F.lit("old")), path)
    chunk_store.write_chunks(whole_chunks(t), path)
    return chunk_store.read_chunks(t.spark, path).select("conversation_id", "chunk_id", "text")


@query("chunk_store_rows_left", """
SELECT source AS conversation_id, CAST(doc_id AS VARCHAR) AS chunk_id, text, copies FROM documents, (SELECT unnest([1, 2]) AS copies) WHERE source <> 'src1'""")
def chunk_store_rows_left(t: Tables) -> DataFrame:
    """Chunks appended once more, and one conversation deleted: the others twice, chunk by chunk."""
    path = fresh_path(t.spark, "chunks")
    chunk_store.write_chunks(whole_chunks(t), path)
    chunk_store.write_chunks(whole_chunks(t), path, append=True)
    chunk_store.delete_chunks(t.spark, path, "src1")
    stored = chunk_store.read_chunks(t.spark, path).groupBy("conversation_id", "chunk_id", "text").agg(F.count("*").cast("int").alias("n"))
    return stored.select("conversation_id", "chunk_id", "text", F.explode(F.sequence(F.lit(1), "n")).alias("copies"))


# --- Ingest and sinks -------------------------------------------------------

def upload(t: Tables) -> DataFrame:
    """(path, content) of text, Word, Excel, CSV, broken and unsupported files."""
    line = F.concat_ws(",", "s_suppkey", F.concat(F.lit('"'), "s_name", F.lit(', Ltd"')), "s_acctbal")
    # A hundred suppliers per file, so that a file's text is bounded.
    sheets = t.supplier.groupBy(F.floor(F.col("s_suppkey") / 100).alias("f")).agg(
        F.concat(F.lit("SupplierID,Name,Balance\n"), F.array_join(F.array_sort(F.collect_list(line)), "\n")).alias("text")
    )
    csv = sheets.select(F.concat(F.lit("/in/suppliers"), F.col("f").cast("string"), F.lit(".csv")).alias("path"), F.encode("text", "UTF-8").alias("content"))
    page = F.concat(F.lit("/in/page"), F.col("page_id").cast("string"))
    pages = t.pages.select(F.concat(page, F.lit(".html")).alias("path"), F.encode("html", "UTF-8").alias("content"))
    broken = t.pages.select(F.concat(page, F.lit(".docx")).alias("path"), F.encode("html", "UTF-8").alias("content"))
    docs = spread_small(t.documents.select("doc_id", "text"))
    return (
        text_files(t).unionByName(word_files(docs)).unionByName(workbooks(t.part, "p_partkey"))
        .unionByName(csv).unionByName(pages).unionByName(broken)
    )


@query("ingest_files", """
SELECT doc_id || '.txt' AS filename, 'txt' AS format, 'document' AS type, 'ready' AS status FROM documents
UNION ALL SELECT doc_id || '.docx', 'docx', 'document', 'ready' FROM documents
UNION ALL SELECT DISTINCT 'book' || (p_partkey // 500) || '.xlsx', 'xlsx', 'hybrid', 'ready' FROM part
UNION ALL SELECT DISTINCT 'suppliers' || (s_suppkey // 100) || '.csv', 'csv', 'hybrid', 'ready' FROM supplier
UNION ALL SELECT 'page' || page_id || '.html', 'html', NULL, 'skipped' FROM pages
UNION ALL SELECT 'page' || page_id || '.docx', 'docx', 'document', 'error' FROM pages""")
def ingest_files(t: Tables) -> DataFrame:
    """Status of every uploaded file."""
    return ingest.ingest_files(upload(t), "upload-0001")[1].select("filename", "format", "type", "status")


@query("ingest_row_chunks", f"""
WITH b AS (SELECT 'book' || (p_partkey // 500) || '.xlsx' AS source, p_partkey % 500 AS i, {BOOK_ROW_SQL} AS line FROM part),
c AS (SELECT 'suppliers' || (s_suppkey // 100) || '.csv' AS source,
 row_number() OVER (PARTITION BY s_suppkey // 100 ORDER BY s_suppkey || ',') - 1 AS i, s_suppkey, s_name, s_acctbal FROM supplier)
SELECT source, 'excel_row' AS chunk_type, 'From ' || source || ', Sheet ''Data'', Row ' || i || ':' || chr(10) || line AS text FROM b
UNION ALL SELECT DISTINCT source, 'excel_row', 'From ' || source || ', Sheet ''Notes'', Row 0:' || chr(10) || 'note: file ' || replace(replace(source, 'book', ''), '.xlsx', '') FROM b
UNION ALL SELECT source, 'csv_row', 'From ' || source || ', Row ' || i || ':' || chr(10) || 'SupplierID: ' || s_suppkey || ', Name: ' || s_name || ', Ltd, Balance: ' || s_acctbal FROM c""")
def ingest_row_chunks(t: Tables) -> DataFrame:
    """All chunks of an upload that stand for one row of a table file."""
    chunks = ingest.ingest_files(upload(t), "upload-0001")[0]
    return chunks.filter(F.col("chunk_type").isin("excel_row", "csv_row")).select("source", "chunk_type", "text")


@query("ingest_document_chunks", """
SELECT doc_id || '.txt' AS source, 'txt' AS chunk_type, true AS within_size, true AS in_text FROM documents WHERE regexp_matches(text, '\\S')""")
def ingest_document_chunks(t: Tables) -> DataFrame:
    """Per text file of an upload: no chunk is too long, and every chunk is a part of the text."""
    chunks = ingest.ingest_files(text_files(t), "upload-0001")[0]
    whole = files.scan_text(text_files(t)).select("source", F.col("text").alias("whole"))
    return chunks.join(whole, "source").groupBy("source", "chunk_type").agg(
        (F.max(F.length("text")) <= 1000).alias("within_size"), F.bool_and(F.contains("whole", "text")).alias("in_text")
    )


@query("scan_csv_breaks", """
SELECT c_custkey, 'first line' || chr(10) || '"' || c_name || '", second' AS note, c_nationkey::BIGINT AS c_nationkey, c_acctbal FROM customer""")
def scan_csv_breaks(t: Tables) -> DataFrame:
    """Customers with a quoted line break in every row, written as CSV and read back in splits."""
    path = fresh_path(t.spark, "csv")
    note = F.concat(F.lit('first line\n"'), "c_name", F.lit('", second'))
    t.customer.select("c_custkey", note.alias("note"), "c_nationkey", "c_acctbal").write.option("header", True).option("escape", '"').csv(path)
    found = files.scan_csv(t.spark, path)
    return found.select(F.col("c_custkey").cast("bigint"), "note", F.col("c_nationkey").cast("bigint"), "c_acctbal")


@query("ingest_folder_rows", """
SELECT 'c_custkey: ' || c_custkey || ', note: two' || chr(10) || 'lines, of "' || c_name || '", c_mktsegment: ' || c_mktsegment AS line,
 'hybrid' AS type, 'ready' AS status FROM customer""")
def ingest_folder_rows(t: Tables) -> DataFrame:
    """A folder of CSV files with quoted line breaks, ingested by name: every row as a chunk, with its file's status."""
    path = fresh_path(t.spark, "upload")
    note = F.concat(F.lit('two\nlines, of "'), "c_name", F.lit('"'))
    t.customer.select("c_custkey", note.alias("note"), "c_mktsegment").write.option("header", True).option("escape", '"').csv(path)
    chunks, status = ingest.ingest_folder(t.spark, path, "upload-0003")
    rows = chunks.filter("chunk_type = 'csv_row'").join(status.withColumnRenamed("filename", "source").select("source", "type", "status"), "source")
    return rows.select(F.regexp_extract("text", r"(?s)^From [^\n]*\n(.*)$", 1).alias("line"), "type", "status")


@query("ingest_chunks")
def ingest_chunks(t: Tables) -> DataFrame:
    """All chunks of an upload."""
    return ingest.ingest_files(upload(t), "upload-0001")[0].select("chunk_id", "source", "source_type", "chunk_type", "text")


@query("results_sink", """
WITH s AS (SELECT count(*) FILTER (quality = 1 - toxic) AS correct, count(*) AS total, count(DISTINCT 1 - toxic) AS languages FROM labels)
SELECT unnest([repeat('=', 70), 'EVALUATION REPORT', repeat('=', 70), 'LABELS', repeat('-', 70), 'accuracy_pct: '
 || round(correct * 100.0 / total::DOUBLE, 1) || ', correct: ' || correct || ', languages: ' || languages || ', total: ' || total]) AS value FROM s""")
def results_sink(t: Tables) -> DataFrame:
    """Evaluation results written as JSON and as a report; the report's lines."""
    path = fresh_path(t.spark, "results")
    log = t.labels.select(F.col("quality").cast("string").alias("expected"), (1 - F.col("toxic")).cast("string").alias("detected"))
    scores = ev.eval_language(log)
    sinks.write_json(scores, f"{path}/json")
    sinks.write_report("EVALUATION REPORT", {"labels": t.spark.read.json(f"{path}/json")}, f"{path}/report")
    return t.spark.read.text(f"{path}/report").filter(F.col("value") != "")


# --- Streams ----------------------------------------------------------------

@query("stream_conversation_rollup", """
SELECT conv_id AS conversation_id, count(*) AS message_count, strftime(max(TIMESTAMP '2024-01-01' + to_seconds(conv_id * 3600 + turn * 60)), '%Y-%m-%d %H:%M:%S') AS updated_at,
 substring(arg_min(text, turn), 1, 50) AS title FROM conversations GROUP BY conv_id""")
def stream_conversation_rollup(t: Tables) -> DataFrame:
    """All turns as a message stream in which every message arrives twice."""
    path = fresh_path(t.spark, "rollup")
    log = messages(t).select(
        "message_id", "conversation_id", "content",
        F.timestamp_seconds(F.col("created_at") + 1704067200).alias("created_at"),
    )
    log.unionByName(log).write.parquet(f"{path}/in")
    stream = t.spark.readStream.schema(log.schema).parquet(f"{path}/in")
    rollup.start_rollup(stream, f"{path}/out", f"{path}/checkpoint", "10 days").awaitTermination()
    state = rollup.read_rollup(t.spark, f"{path}/out")
    return state.withColumn("updated_at", F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss"))


@query("stream_ingest_files")
def stream_ingest_files(t: Tables) -> DataFrame:
    """Documents dropped as text files into a watched folder; the status of each file."""
    path = fresh_path(t.spark, "ingest")
    spread_small(t.documents.select("text")).write.text(f"{path}/in")
    query_ = jobs.stream_ingest_files(
        t.spark, f"{path}/in", "stream-0001", f"{path}/chunks", f"{path}/status", f"{path}/checkpoint"
    )
    query_.awaitTermination()
    return jobs.read_status(t.spark, f"{path}/status").select("filename", "format", "type", "chunks", "status")


@query("stream_ingest_states", """
SELECT DISTINCT 'txt' AS format, 'document' AS type, 'processing,ready' AS states, true AS chunked FROM documents""")
def stream_ingest_states(t: Tables) -> DataFrame:
    """The states that the files of a watched folder go through, in order, each once per file."""
    path = fresh_path(t.spark, "ingest")
    spread_small(t.documents.select("text")).write.text(f"{path}/in")
    jobs.stream_ingest_files(
        t.spark, f"{path}/in", "stream-0002", f"{path}/chunks", f"{path}/status", f"{path}/checkpoint", files_per_batch=3
    ).awaitTermination()
    steps = t.spark.read.parquet(f"{path}/status")
    each = steps.groupBy("path").agg(
        F.max("format").alias("format"), F.max("type").alias("type"), F.max("chunks").alias("chunks"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("step", "status"))), lambda s: s["status"]), ",").alias("states"),
    )
    stored = t.spark.read.parquet(f"{path}/chunks").groupBy("source").agg(F.count("*").alias("stored"))
    return (
        each.withColumn("source", F.regexp_extract("path", r"([^/]*)$", 1)).join(stored, "source", "left")
        .select("format", "type", "states", (F.coalesce("stored", F.lit(0)) == F.col("chunks")).alias("chunked")).distinct()
    )


STREAM_ROUTE_SQL = ROUTE_SQL.replace(
    "CASE WHEN p_size > 40 THEN 'tie' WHEN p_size > 25 THEN 'document' WHEN p_size > 5 THEN 'csv' END AS hint", "NULL::VARCHAR AS hint"
)


@query("stream_classify_route", f"WITH {STREAM_ROUTE_SQL} SELECT question_id, route FROM routed")
def stream_classify_route(t: Tables) -> DataFrame:
    path = fresh_path(t.spark, "classify")
    asked = route_questions(t).select("question_id", "question", "has_docs", "has_csv", "files")
    asked.write.parquet(f"{path}/in")
    stream = jobs.classify_stream(t.spark.readStream.schema(asked.schema).parquet(f"{path}/in"))
    (
        stream.select("question_id", "route").writeStream.format("parquet").option("path", f"{path}/out")
        .option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    )
    return t.spark.read.parquet(f"{path}/out")
