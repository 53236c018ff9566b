"""Column roles, readable texts, value index and literal resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from insight_spark.functions import fixed_values as fv
from insight_spark.operators import profile as prof, resolve as res
from insight_spark.plans.registry import Tables, query
from insight_spark.plans.text_queries import (
    LOGGED_SQL,
    NORMAL_SQL,
    abbreviated_names,
    logged_sql,
    map_sql,
    month_text,
)


SEGMENT_SQL = "SELECT DISTINCT lower(c_mktsegment) AS seg FROM customer"


@query("fuzzy_match_known", f"""
SELECT substring(seg, 1, length(seg) - 1) AS probe, seg AS value, round(2.0 * (length(seg) - 1) / (2 * length(seg) - 1), 6)::DOUBLE AS ratio FROM ({SEGMENT_SQL})""")
def fuzzy_match_known(t: Tables) -> DataFrame:
    """Every market segment without its last letter finds the whole one."""
    known = t.customer.select(F.lit("customer").alias("table"), F.lower("c_mktsegment").alias("value")).distinct()
    typed = known.select("table", F.expr("substring(value, 1, length(value) - 1)").alias("probe"))
    return res.fuzzy_match(typed, known, 0.75).select("probe", "value", "ratio")


@query("resolve_values_known", """
SELECT DISTINCT p_name AS literal, p_name AS resolved, 'exact' AS method FROM part
UNION ALL SELECT DISTINCT upper(p_name), p_name, 'canonical' FROM part""")
def resolve_values_known(t: Tables) -> DataFrame:
    """Part names as stored and in capitals, resolved to the stored ones."""
    names = t.part.select(F.explode(F.array("p_name", F.upper("p_name"))).alias("literal"))
    asked = names.select(F.lit("part").alias("table"), "literal", F.lit(None).cast("string").alias("hint"))
    return res.resolve_values(asked, res.value_forms(t.part, "part", ["p_name"])).select("literal", "resolved", "method")


def two(x: str) -> str:
    """SQL text of a plain number."""
    return f"CASE WHEN {x} = floor({x}) THEN CAST(CAST({x} AS BIGINT) AS VARCHAR) ELSE format('{{:.2f}}', {x}) END"


def money(x: str) -> str:
    return f"CASE WHEN {x} >= 100 THEN '$' || format('{{:,.0f}}', {x}) ELSE '$' || format('{{:.2f}}', {x}) END"


def _open_sql(table: str, columns: dict[str, int]) -> str:
    """Roles of text columns: categorical with at most 20 values or 10% of the rows."""
    return " UNION ALL ".join(
        f"SELECT {pos} AS pos, '{c}' AS \"column\", CASE WHEN count(DISTINCT {c}) <= 20 OR count(DISTINCT {c}) <= 0.1 * count(*) "
        f"THEN 'categorical' ELSE 'text' END AS role, '{table}' AS \"table\" FROM {table}"
        for c, pos in columns.items()
    )


def _fixed_sql(table: str, columns: list[tuple[int, str, str]]) -> str:
    return " UNION ALL ".join(f"SELECT {pos}, '{c}', '{role}', '{table}'" for pos, c, role in columns)


ROLES_SQL = " UNION ALL ".join([
    _open_sql("customer", {"c_name": 1, "c_mktsegment": 4}),
    _fixed_sql("customer", [(0, "c_custkey", "id"), (2, "c_nationkey", "id"), (3, "c_acctbal", "numeric")]),
    _open_sql("part", {"p_name": 1, "p_brand": 2, "p_type": 3}),
    _fixed_sql("part", [(0, "p_partkey", "id"), (4, "p_size", "numeric"), (5, "p_retailprice", "numeric")]),
    _open_sql("orders", {"o_orderstatus": 2, "o_orderpriority": 5}),
    _fixed_sql("orders", [(0, "o_orderkey", "id"), (1, "o_custkey", "id"), (3, "o_totalprice", "numeric"), (4, "o_orderdate", "date")]),
    _open_sql("documents", {"text": 1, "lang": 2, "source": 3}),
    _fixed_sql("documents", [(0, "doc_id", "id"), (4, "n_chars", "numeric")]),
])


@query("column_roles", ROLES_SQL)
def column_roles(t: Tables) -> DataFrame:
    out = None
    for name in ("customer", "part", "orders", "documents"):
        one = prof.column_roles(getattr(t, name)).withColumn("table", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


# The second rule set goes by type and name; DuckDB's types under Spark's names.
SCHEMA_ROLES_SQL = """
WITH c AS (SELECT table_name, column_name, ordinal_position - 1 AS pos, data_type FROM (
 SELECT 'customer' AS table_name, column_name, row_number() OVER () AS ordinal_position, column_type AS data_type FROM (DESCRIBE customer)
 UNION ALL SELECT 'part', column_name, row_number() OVER (), column_type FROM (DESCRIBE part)
 UNION ALL SELECT 'orders', column_name, row_number() OVER (), column_type FROM (DESCRIBE orders)))
SELECT pos::INTEGER AS pos, column_name AS "column", table_name AS "table",
 CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double' WHEN 'VARCHAR' THEN 'string' ELSE 'timestamp_ntz' END AS type,
 CASE data_type WHEN 'VARCHAR' THEN 'categorical' WHEN 'BIGINT' THEN 'numeric' WHEN 'INTEGER' THEN 'numeric' WHEN 'DOUBLE' THEN 'numeric' ELSE 'date' END AS role
FROM c"""


@query("schema_roles", SCHEMA_ROLES_SQL)
def schema_roles(t: Tables) -> DataFrame:
    out = None
    for name, key in (("customer", "c_custkey"), ("part", "p_partkey"), ("orders", "o_orderkey")):
        one = prof.schema_roles(getattr(t, name), [key]).withColumn("table", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


@query("row_narratives", f"""
SELECT CAST(c_custkey AS VARCHAR) AS record_id, 'row_narrative' AS chunk_type, 'customer.csv' AS source, 'csv' AS source_type,
 'c_custkey ' || c_custkey || ' — ' || concat_ws('. ', 'c name: ' || c_name, 'c nationkey: ' || c_nationkey,
 'c acctbal: ' || {two('c_acctbal')}, 'c mktsegment: ' || c_mktsegment) || '.' AS text FROM customer""")
def row_narratives(t: Tables) -> DataFrame:
    return prof.row_narratives(t.customer, prof.role_map(t.customer), "customer.csv")


def _group_sql(column: str, label: str, details: str) -> str:
    return f"""
SELECT '{column}' AS group_col, {column} AS group_val, count(*) AS n,
 {column} || ' {label} — ' || count(*) || ' p_partkeys:' || chr(10)
 || string_agg('  - ' || p_partkey || ': ' || {details}, chr(10) ORDER BY p_partkey) FILTER (i <= 15)
 || CASE WHEN count(*) > 15 THEN chr(10) || '  ... and ' || (count(*) - 15) || ' more.' ELSE '' END
 || chr(10) || 'Averages — Average p size: ' || {two('avg(p_size)')} || '. Average p retailprice: ' || {money('avg(p_retailprice)')} || '.' AS text
FROM (SELECT *, row_number() OVER (PARTITION BY {column} ORDER BY p_partkey) AS i FROM part)
WHERE (SELECT count(DISTINCT {column}) FROM part) <= 20 GROUP BY {column} HAVING count(*) >= 2"""


PRICE = money("p_retailprice")
GROUPS_SQL = " UNION ALL ".join([
    _group_sql("p_name", "p name", f"p_brand || ', ' || p_type || ', ' || p_size || ', ' || {PRICE}"),
    _group_sql("p_brand", "p brand", f"p_name || ', ' || p_type || ', ' || p_size || ', ' || {PRICE}"),
    _group_sql("p_type", "p type", f"p_name || ', ' || p_brand || ', ' || p_size || ', ' || {PRICE}"),
])


@query("group_summaries", f"SELECT group_col, group_val, text FROM ({GROUPS_SQL})")
def group_summaries(t: Tables) -> DataFrame:
    texts = prof.group_summaries(t.part, prof.role_map(t.part), "part.csv", ["p_partkey"])
    return texts.select("group_col", "group_val", "text")


def _breakdown_sql(column: str, label: str) -> str:
    """Breakdown line of a column, empty when its role is text: more than twenty
    values and more than a tenth of the rows."""
    return f"""CASE WHEN count(DISTINCT {column}) <= 20 OR count(DISTINCT {column}) <= 0.1 * count(*) THEN
 (SELECT '{label} breakdown: ' || string_agg(v || ' (' || n || ')', ', ' ORDER BY n DESC, v) || '.' FROM
 (SELECT {column} AS v, count(*) AS n FROM part GROUP BY v ORDER BY n DESC, v LIMIT 8)) || chr(10) ELSE '' END"""


@query("dataset_overview", f"""
SELECT 'dataset_overview' AS chunk_type, 'part.csv' AS source, 'csv' AS source_type, 'Dataset overview — part.csv' || chr(10) || 'Contains ' || count(*)
 || ' p_partkeys with 6 attributes.' || chr(10) || {_breakdown_sql('p_name', 'p name')} || {_breakdown_sql('p_brand', 'p brand')}
 || {_breakdown_sql('p_type', 'p type')} || 'p size: ranges ' || min(p_size) || '–' || max(p_size) || ', average ' || {two('avg(p_size)')}
 || '.' || chr(10) || 'p retailprice: ranges ' || {money('min(p_retailprice)')} || '–' || {money('max(p_retailprice)')} || ', average ' || {money('avg(p_retailprice)')} || '.' AS text FROM part""")
def dataset_overview(t: Tables) -> DataFrame:
    return prof.dataset_overview(t.part, prof.role_map(t.part), "part.csv")


@query("set_union_chunks", f"""
SELECT 'row_narrative' AS chunk_type, count(*) AS chunks FROM part UNION ALL SELECT 'group_summary', count(*) FROM ({GROUPS_SQL})
UNION ALL SELECT 'dataset_overview', 1""")
def set_union_chunks(t: Tables) -> DataFrame:
    chunks = prof.table_chunks(t.part, "part.csv", ["p_partkey"])
    return chunks.groupBy("chunk_type").agg(F.count("*").alias("chunks"))


CELLS_SQL = """'c_custkey: ' || c_custkey || ', c_name: ' || c_name || ', c_nationkey: ' || c_nationkey || ', c_acctbal: ' || c_acctbal || ', c_mktsegment: ' || c_mktsegment"""


@query("plain_row_chunks", f"""
SELECT 'customer.csv' AS source, 'csv_row' AS type, row_number() OVER (ORDER BY c_custkey) - 1 AS row,
 'From customer.csv, Row ' || (row_number() OVER (ORDER BY c_custkey) - 1) || ':' || chr(10) || {CELLS_SQL} AS text FROM customer
UNION ALL SELECT 'customer.csv', 'csv_summary', NULL, 'CSV File: customer.csv' || chr(10) || 'Columns: c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment'
 || chr(10) || 'Total Rows: ' || (SELECT count(*) FROM customer) || chr(10) || chr(10) || 'Sample Data:' || chr(10) || string_agg(cells, chr(10) ORDER BY c_custkey)
 FROM (SELECT c_custkey, {CELLS_SQL} AS cells FROM customer ORDER BY c_custkey LIMIT 5)""")
def plain_row_chunks(t: Tables) -> DataFrame:
    return prof.plain_row_chunks(t.customer, "customer.csv", ["c_custkey"])


# --- Value index ------------------------------------------------------------

def order_words(t: Tables) -> DataFrame:
    """Orders with their month in words, as an uploaded table would hold it."""
    return t.orders.select(
        F.date_format("o_orderdate", "MMM").alias("order_month"), F.col("o_orderpriority").alias("priority"), "o_orderstatus"
    )


@query("value_index_build", f"""
WITH v AS (SELECT DISTINCT 'order_month' AS col, 0 AS pos, strftime(o_orderdate, '%b') AS actual, lower(strftime(o_orderdate, '%B')) AS month FROM orders
 UNION ALL SELECT DISTINCT 'priority', 1, o_orderpriority, NULL FROM orders UNION ALL SELECT DISTINCT 'o_orderstatus', 2, o_orderstatus, NULL FROM orders),
n AS (SELECT *, {NORMAL_SQL.format('actual')} AS plain FROM v),
f AS (SELECT col, pos, actual, plain AS form FROM n
 UNION ALL SELECT col, pos, actual, array_to_string([coalesce({map_sql(fv.ABBREVIATIONS, 'w')}, w) for w in string_split(plain, ' ')], ' ') FROM n
 UNION ALL SELECT col, pos, actual, substring(month, 1, CAST(i AS INTEGER)) FROM n, range(3, 10) r(i) WHERE month IS NOT NULL AND i <= length(month))
SELECT 'orders' AS "table", col AS "column", pos, form, max(actual) AS actual FROM f GROUP BY ALL""")
def value_index_build(t: Tables) -> DataFrame:
    return res.value_forms(order_words(t), "orders")


@query("index_dump", """
SELECT DISTINCT 'part' AS "table", 'p_brand' AS "column", p_brand AS actual FROM part""")
def index_dump(t: Tables) -> DataFrame:
    return res.actual_values(res.value_forms(t.part, "part"), "part", "p_brand")


def misspelt(t: Tables) -> DataFrame:
    """Literals as people type them: (table, literal, hint)."""
    kind = F.col("p_size") % 5
    literal = (
        F.when(kind == 0, F.col("p_name"))
        .when(kind == 1, F.upper("p_name"))
        .when(kind == 2, F.replace(F.col("p_name"), F.lit(" "), F.lit("_")))
        .when(kind == 3, F.concat(F.substring("p_name", 1, 2), F.substring("p_name", 4, 99)))
        .otherwise(F.concat(F.lit("no such "), F.lower("p_brand")))
    )
    return t.part.select(F.lit("part").alias("table"), literal.alias("literal"), F.lit(None).cast("string").alias("hint")).distinct()


@query("join_resolve_values")
def join_resolve_values(t: Tables) -> DataFrame:
    return res.resolve_values(misspelt(t), res.value_forms(t.part, "part"))


@query("resolve_months", """
SELECT DISTINCT CASE WHEN o_orderkey % 7 < 6 THEN strftime(o_orderdate, '%b') ELSE o_orderpriority END AS resolved,
 CASE o_orderkey % 7 WHEN 0 THEN strftime(o_orderdate, '%b') WHEN 1 THEN strftime(o_orderdate, '%B')
 WHEN 2 THEN strftime(o_orderdate, '%m') WHEN 3 THEN strftime(o_orderdate, '%Y-%m') WHEN 4 THEN strftime(o_orderdate, '%m/%Y')
 WHEN 5 THEN strftime(o_orderdate, '%b %Y') ELSE o_orderpriority END AS literal FROM orders""")
def resolve_months(t: Tables) -> DataFrame:
    """Months written in six ways, resolved to the three-letter form that is stored."""
    literals = t.orders.select(
        F.lit("orders").alias("table"), month_text().alias("literal"), F.lit("order_month").alias("hint")
    ).distinct()
    return res.resolve_values(literals, res.value_forms(order_words(t), "orders")).select("literal", "resolved")


@query("fuzzy_match")
def fuzzy_match(t: Tables) -> DataFrame:
    """Part names with a dropped letter against the names that exist."""
    names = t.part.select(F.lit("part").alias("table"), F.col("p_name").alias("value")).distinct()
    probes = names.select("table", F.concat(F.substring("value", 1, 2), F.substring("value", 4, 99)).alias("probe")).distinct()
    return res.fuzzy_match(probes, names, fv.VALUE_CUTOFF)


@query("resolve_column")
def resolve_column(t: Tables) -> DataFrame:
    """What people call a column of the part table, built from its rows."""
    asked = abbreviated_names(t).select("name").unionByName(
        t.part.select(F.concat(F.lit("p "), F.lower("p_type"), F.lit(" retail price")).alias("name"))
    ).unionByName(t.part.select(F.concat(F.lit("retailprices "), F.substring("p_type", 1, 1)).alias("name")))
    names = t.spark.createDataFrame([("part", c, i) for i, c in enumerate(t.part.columns)], "table string, column string, pos int")
    return res.resolve_column(asked.select(F.lit("part").alias("table"), F.col("name").alias("asked")).distinct(), res.column_forms(names))


@query("rewrite_literals", f"""
WITH p AS (SELECT l.*, p.p_name, p.p_type FROM {LOGGED_SQL} l JOIN part p ON p.p_partkey = l.sql_id)
SELECT sql_id, 'part' AS "table", CASE kind WHEN 0 THEN '```sql' || chr(10) || 'SELECT MAX p_retailprice FROM part WHERE p_name = ''' || p_name || ''';' || chr(10) || '```'
 WHEN 1 THEN 'SELECT AVG(p_size) -- the mean' || chr(10) || 'FROM upload_ab12cd34_parts WHERE p_type = ''' || p_type || ''' AND p_size < ''' || p_size || ''''
 ELSE 'SELECT p_brand /* brand */ FROM `part` JOIN orders ON 1 = 1 WHERE p_name IN (''' || p_name || ''', ''unknown thing'');' END AS rewritten FROM p""")
def rewrite_literals(t: Tables) -> DataFrame:
    statements = logged_sql(t).withColumn("table", F.lit("part"))
    return res.rewrite_literals(statements, res.value_forms(t.part, "part")).drop("sql")
