"""Filters, joins, aggregates, windows and sorts on the business tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from insight_spark.operators import relational as rel
from insight_spark.operators.scale import top_n_per_group, value_at_index
from insight_spark.plans.registry import Tables, query


# --- Projection and filters -------------------------------------------------

@query("project_named", """
SELECT c_name AS customer, round(c_acctbal / 3, 2) AS third_of_balance, c_mktsegment AS segment FROM customer""")
def project_named(t: Tables) -> DataFrame:
    return rel.project_named(
        t.customer,
        {"customer": F.col("c_name"), "third_of_balance": F.col("c_acctbal") / 3, "segment": F.col("c_mktsegment")},
    )


@query("filter_eq_in", """
SELECT o_orderkey, o_custkey, o_totalprice FROM orders
WHERE o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_totalprice >= 400000""")
def filter_eq_in(t: Tables) -> DataFrame:
    return t.orders.filter(
        (F.col("o_orderstatus") == "F")
        & F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
        & (F.col("o_totalprice") >= 400000)
    ).select("o_orderkey", "o_custkey", "o_totalprice")


@query("filter_max_row", """
SELECT o_orderkey, o_custkey, o_totalprice FROM orders
WHERE o_totalprice = (SELECT max(o_totalprice) FROM orders)""")
def filter_max_row(t: Tables) -> DataFrame:
    return rel.filter_max_row(t.orders, "o_totalprice").select("o_orderkey", "o_custkey", "o_totalprice")


SIZE_BANDS = [(35, "large (35+)"), (15, "medium (15-34)")]


def size_band():
    return rel.bucket(F.col("p_size"), SIZE_BANDS, "small (<15)")


SIZE_BAND_SQL = """CASE WHEN p_size >= 35 THEN 'large (35+)' WHEN p_size >= 15 THEN 'medium (15-34)'
ELSE 'small (<15)' END"""


@query("bucket_case", f"SELECT p_partkey, {SIZE_BAND_SQL} AS band FROM part")
def bucket_case(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", size_band().alias("band"))


@query("filter_contains_ci", "SELECT conv_id, turn FROM conversations WHERE text ILIKE '%THE%'")
def filter_contains_ci(t: Tables) -> DataFrame:
    return rel.filter_contains_ci(t.conversations, "text", "THE").select("conv_id", "turn")


@query("filter_not_null", """
SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
WHERE l.quality IS NOT NULL AND d.source IS NOT NULL""")
def filter_not_null(t: Tables) -> DataFrame:
    joined = t.documents.select("doc_id", "source").join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    return joined.dropna(subset=["quality", "source"]).select("doc_id", "quality")


@query("coerce_numeric", """
SELECT p_partkey, try_cast(replace(p_brand, 'Brand#', '') AS DOUBLE) AS brand_no,
       try_cast(p_name AS DOUBLE) AS name_no FROM part""")
def coerce_numeric(t: Tables) -> DataFrame:
    brand = F.replace(F.col("p_brand"), F.lit("Brand#"), F.lit(""))
    return t.part.select(
        "p_partkey", rel.coerce_numeric(brand).alias("brand_no"), rel.coerce_numeric(F.col("p_name")).alias("name_no")
    )


@query("coerce_date", """
SELECT o_orderkey, strftime(try_cast(CASE WHEN o_orderstatus = 'P' THEN 'pending'
  ELSE strftime(o_orderdate, '%Y-%m-%d') END AS TIMESTAMP), '%Y-%m-%d') AS order_day FROM orders""")
def coerce_date(t: Tables) -> DataFrame:
    shown = F.when(F.col("o_orderstatus") == "P", F.lit("pending")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return t.orders.select("o_orderkey", F.date_format(rel.coerce_date(shown), "yyyy-MM-dd").alias("order_day"))


@query("guard_empty_or_sentinel", """
WITH c AS (SELECT count(*) AS n FROM conversations),
f AS (SELECT lower(concat_ws(' ', conv_id, turn, role, text)) AS cells FROM conversations ORDER BY conv_id, turn LIMIT 1),
g AS (SELECT n, coalesce((SELECT contains(cells, 'not available in the uploaded') OR contains(cells, 'information is not available')
  OR contains(cells, 'no data found') OR contains(cells, 'no results') FROM f), true) AS flag FROM c)
SELECT n AS row_count, flag AS not_available,
  CASE WHEN flag THEN 'This information is not available in the uploaded data.' END AS answer FROM g""")
def guard_empty_or_sentinel(t: Tables) -> DataFrame:
    return rel.guard_empty_or_sentinel(t.conversations, ["conv_id", "turn"])


@query("filter_allowed_tables", """
SELECT DISTINCT source AS table_name FROM documents
WHERE source IN (SELECT d.source FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE l.toxic = 1)""")
def filter_allowed_tables(t: Tables) -> DataFrame:
    tables = t.documents.select(F.col("source").alias("table_name")).distinct()
    toxic = t.labels.filter(F.col("toxic") == 1)
    allowed = t.documents.select("doc_id", F.col("source").alias("table_name")).join(toxic, "doc_id", "left_semi")
    return rel.filter_allowed_tables(tables, allowed)


# --- Joins ------------------------------------------------------------------

@query("join_left_count", """
SELECT c.c_custkey, c.c_name, c.c_acctbal, count(o.o_orderkey) AS order_count
FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey
GROUP BY ALL ORDER BY c.c_acctbal DESC, c.c_custkey LIMIT 20""")
def join_left_count(t: Tables) -> DataFrame:
    return rel.join_left_count(
        t.customer.select("c_custkey", "c_name", "c_acctbal"), t.orders.select("o_custkey"),
        "c_custkey", "o_custkey", [F.desc("c_acctbal"), F.col("c_custkey")], 20, "order_count",
    )


@query("join_semi_distinct", """
SELECT DISTINCT c.c_custkey, c.c_name FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey
WHERE o.o_totalprice > 450000""")
def join_semi_distinct(t: Tables) -> DataFrame:
    big = t.orders.filter(F.col("o_totalprice") > 450000).select("o_custkey")
    return rel.join_semi_distinct(t.customer.select("c_custkey", "c_name"), big, "c_custkey", "o_custkey")


@query("join_inner_count", """
SELECT count(*) AS order_count FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
WHERE c.c_mktsegment = 'MACHINERY'""")
def join_inner_count(t: Tables) -> DataFrame:
    who = t.customer.filter(F.col("c_mktsegment") == "MACHINERY").select("c_custkey")
    return t.orders.join(who, F.col("o_custkey") == F.col("c_custkey")).agg(F.count("*").alias("order_count"))


@query("join_inner_group", """
SELECT o.o_orderstatus, count(*) AS order_count FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
WHERE c.c_mktsegment = 'MACHINERY' AND o.o_orderstatus IS NOT NULL GROUP BY o.o_orderstatus""")
def join_inner_group(t: Tables) -> DataFrame:
    who = t.customer.filter(F.col("c_mktsegment") == "MACHINERY")
    return rel.join_inner_group(who, t.orders, "c_custkey", "o_custkey", "o_orderstatus", "order_count")


@query("join_star", """
SELECT p.p_type, n.n_name, count(*) AS sales, round(sum(l.l_quantity), 2) AS quantity,
       round(sum(l.l_extendedprice), 2) AS amount
FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey JOIN supplier s ON l.l_suppkey = s.s_suppkey
JOIN nation n ON s.s_nationkey = n.n_nationkey GROUP BY p.p_type, n.n_name""")
def join_star(t: Tables) -> DataFrame:
    fact = t.lineitem.select("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    star = rel.join_star(
        fact,
        [
            (t.part.select("p_partkey", "p_type"), "l_partkey", "p_partkey"),
            (t.supplier.select("s_suppkey", "s_nationkey"), "l_suppkey", "s_suppkey"),
            (t.nation.select("n_nationkey", "n_name"), "s_nationkey", "n_nationkey"),
        ],
    )
    return star.groupBy("p_type", "n_name").agg(
        F.count("*").alias("sales"),
        F.round(F.sum("l_quantity"), 2).alias("quantity"),
        F.round(F.sum("l_extendedprice"), 2).alias("amount"),
    )


@query("join_anti_seen", """
SELECT DISTINCT l_partkey, l_suppkey FROM lineitem a WHERE l_returnflag = 'R' AND NOT EXISTS (
  SELECT 1 FROM lineitem b WHERE b.l_returnflag = 'A' AND a.l_partkey = b.l_partkey AND a.l_suppkey = b.l_suppkey)""")
def join_anti_seen(t: Tables) -> DataFrame:
    pairs = t.lineitem.select("l_partkey", "l_suppkey", "l_returnflag")
    new = pairs.filter(F.col("l_returnflag") == "R").drop("l_returnflag").distinct()
    seen = pairs.filter(F.col("l_returnflag") == "A").drop("l_returnflag")
    return new.join(seen, ["l_partkey", "l_suppkey"], "left_anti")


# --- Aggregates -------------------------------------------------------------

@query("agg_basic", """
SELECT l_returnflag, l_linestatus, count(*) AS row_count, round(sum(l_extendedprice), 2) AS total,
  round(avg(l_extendedprice), 2) AS average, min(l_extendedprice) AS smallest, max(l_extendedprice) AS largest
FROM lineitem GROUP BY l_returnflag, l_linestatus""")
def agg_basic(t: Tables) -> DataFrame:
    return rel.agg_basic(t.lineitem, "l_extendedprice", ["l_returnflag", "l_linestatus"])


@query("agg_basic_global", """
SELECT count(*) AS row_count, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 2) AS average,
  min(o_totalprice) AS smallest, max(o_totalprice) AS largest FROM orders""")
def agg_basic_global(t: Tables) -> DataFrame:
    return rel.agg_basic(t.orders, "o_totalprice")


@query("agg_top_avg_group", """
SELECT p_brand, round(avg(p_retailprice), 2) AS average FROM part GROUP BY p_brand
ORDER BY average DESC, p_brand LIMIT 1""")
def agg_top_avg_group(t: Tables) -> DataFrame:
    return rel.agg_top_group(t.part, "p_brand", "p_retailprice", "avg")


@query("agg_lowest_avg_group", """
SELECT p_brand, round(avg(p_retailprice), 2) AS average FROM part GROUP BY p_brand
ORDER BY average ASC, p_brand LIMIT 1""")
def agg_lowest_avg_group(t: Tables) -> DataFrame:
    return rel.agg_top_group(t.part, "p_brand", "p_retailprice", "avg", lowest=True)


@query("agg_top_total_group", """
SELECT n.n_name, round(sum(l.l_extendedprice), 2) AS total
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey
JOIN nation n ON c.c_nationkey = n.n_nationkey GROUP BY n.n_name ORDER BY total DESC, n.n_name LIMIT 1""")
def agg_top_total_group(t: Tables) -> DataFrame:
    """Nation whose customers bring the largest revenue.

    The fact is added up per order before the joins, so the shuffle to the
    customers carries one row per order and side.
    """
    per_order = t.lineitem.groupBy("l_orderkey").agg(F.sum("l_extendedprice").alias("amount"))
    joined = rel.join_star(
        per_order,
        [
            (t.orders.select("o_orderkey", "o_custkey"), "l_orderkey", "o_orderkey"),
            (t.customer.select("c_custkey", "c_nationkey"), "o_custkey", "c_custkey"),
            (t.nation.select("n_nationkey", "n_name"), "c_nationkey", "n_nationkey"),
        ],
    )
    return rel.agg_top_group(joined, "n_name", "amount", "sum")


@query("agg_rate", f"""
SELECT {SIZE_BAND_SQL} AS band, round(100.0 * sum(CASE WHEN p_type = 'PROMO' THEN 1 ELSE 0 END) / count(*)::DOUBLE, 1) AS rate_pct,
  count(*) AS row_count FROM part GROUP BY band ORDER BY min(p_size) DESC""")
def agg_rate(t: Tables) -> DataFrame:
    return rel.agg_rate(t.part, size_band(), F.col("p_type") == "PROMO", "p_size")


@query("agg_bucket_mean", f"""
SELECT {SIZE_BAND_SQL} AS band, round(avg(p_retailprice), 2) AS average, count(*) AS row_count FROM part GROUP BY band""")
def agg_bucket_mean(t: Tables) -> DataFrame:
    return rel.agg_bucket_mean(t.part, size_band(), "p_retailprice")


@query("agg_by_month", """
SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS row_count, round(sum(o_totalprice), 2) AS total
FROM orders GROUP BY month""")
def agg_by_month(t: Tables) -> DataFrame:
    return rel.agg_by_month(t.orders, "o_orderdate", "o_totalprice")


@query("agg_distinct_values", """
WITH v AS (UNPIVOT (SELECT p_name, p_brand, p_type FROM part) ON p_name, p_brand, p_type INTO NAME "column" VALUE "value"),
d AS (SELECT DISTINCT "column", "value" FROM v WHERE "value" IS NOT NULL)
SELECT "column", "value", CAST(row_number() OVER (PARTITION BY "column" ORDER BY "value") AS INTEGER) AS value_no FROM d
QUALIFY value_no <= 20""")
def agg_distinct_values(t: Tables) -> DataFrame:
    return rel.agg_distinct_values(t.part)


@query("agg_nunique", """
WITH a AS (SELECT count(*) AS n, count(DISTINCT o_custkey) AS o_custkey, count(DISTINCT o_orderstatus) AS o_orderstatus,
  count(DISTINCT o_orderpriority) AS o_orderpriority, count(DISTINCT o_orderdate) AS o_orderdate FROM orders),
u AS (UNPIVOT a ON o_custkey, o_orderstatus, o_orderpriority, o_orderdate INTO NAME "column" VALUE n_unique)
SELECT "column", n_unique, round(n_unique / n::DOUBLE, 6) AS ratio FROM u""")
def agg_nunique(t: Tables) -> DataFrame:
    return rel.agg_nunique(t.orders, ["o_custkey", "o_orderstatus", "o_orderpriority", "o_orderdate"])


@query("agg_value_counts", """
WITH v AS (UNPIVOT (SELECT p_name, p_brand, p_type FROM part) ON p_name, p_brand, p_type INTO NAME "column" VALUE "value"),
c AS (SELECT "column", "value", count(*) AS n FROM v GROUP BY ALL)
SELECT "column", "value", n, CAST(row_number() OVER (PARTITION BY "column" ORDER BY n DESC, "value") AS INTEGER) AS position
FROM c QUALIFY position <= 8""")
def agg_value_counts(t: Tables) -> DataFrame:
    return rel.agg_value_counts(t.part, ["p_name", "p_brand", "p_type"])


@query("agg_min_max_mean", """
WITH v AS (UNPIVOT (SELECT l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem)
  ON l_quantity, l_extendedprice, l_discount, l_tax INTO NAME "column" VALUE "value")
SELECT "column", min("value") AS smallest, max("value") AS largest, round(avg("value"), 6) AS average FROM v GROUP BY "column" """)
def agg_min_max_mean(t: Tables) -> DataFrame:
    out = rel.agg_min_max_mean(t.lineitem, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    return out.withColumn("average", F.round("average", 6))


@query("agg_group_mean", """
SELECT p_type AS group_value, count(*) AS row_count, round(avg(p_size), 4) AS avg_p_size,
  round(avg(p_retailprice), 4) AS avg_p_retailprice FROM part WHERE p_type IS NOT NULL
  AND (SELECT count(DISTINCT p_type) FROM part) <= 20 GROUP BY p_type HAVING count(*) >= 2""")
def agg_group_mean(t: Tables) -> DataFrame:
    return rel.agg_group_mean(t.part, "p_type", ["p_size", "p_retailprice"])


@query("agg_parse_ratio", """
WITH s AS (SELECT strftime(o_orderdate, '%Y-%m-%d') AS day_text, o_orderpriority AS priority,
  CAST(o_custkey AS VARCHAR) AS customer FROM orders),
v AS (UNPIVOT s ON day_text, priority, customer INTO NAME "column" VALUE "value")
SELECT "column",
  round(sum(CASE WHEN (regexp_full_match("value", '[0-9]{4}-[0-9]{2}-[0-9]{2}') AND try_cast("value" AS TIMESTAMP) IS NOT NULL)
    OR (regexp_full_match("value", '[0-9]{4}') AND "value" BETWEEN '1678' AND '2261') THEN 1 ELSE 0 END) / count(*)::DOUBLE, 6) AS date_ratio,
  round(sum(CASE WHEN try_cast("value" AS DOUBLE) IS NOT NULL THEN 1 ELSE 0 END) / count(*)::DOUBLE, 6) AS number_ratio
FROM v GROUP BY "column" """)
def agg_parse_ratio(t: Tables) -> DataFrame:
    texts = t.orders.select(
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("day_text"), F.col("o_orderpriority").alias("priority"),
        F.concat(F.col("o_custkey").cast("string"), F.lit("")).alias("customer"),
    )
    return rel.agg_parse_ratio(texts, ["day_text", "priority", "customer"])


@query("agg_p95_index", """
WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS i,
  count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL),
p AS (SELECT event_type, value AS p95 FROM r WHERE i = floor(0.95 * n) + 1)
SELECT e.event_type, round(avg(e.value), 4) AS mean_value, any_value(p.p95) AS p95 FROM events e JOIN p USING (event_type)
GROUP BY e.event_type""")
def agg_p95_index(t: Tables) -> DataFrame:
    events = t.events.select("event_type", "value")
    p95 = value_at_index(events, ["event_type"], "value", 0.95, "p95")
    means = events.groupBy("event_type").agg(F.round(F.avg("value"), 4).alias("mean_value"))
    return means.join(p95, "event_type")


@query("agg_total_cells", """
WITH p AS (SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 10)
SELECT CAST(trunc(sum(o_orderkey + o_custkey + o_totalprice)) AS BIGINT) AS total FROM p""")
def agg_total_cells(t: Tables) -> DataFrame:
    result = t.orders.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
    return rel.agg_total_cells(result, ["o_orderkey"])


@query("agg_dominant", """
WITH r AS (SELECT source, lang, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rank FROM documents),
c AS (SELECT source, lang, count(*) AS n, min(rank) AS first FROM r WHERE rank <= 3 GROUP BY source, lang),
b AS (SELECT source, n, lang, row_number() OVER (PARTITION BY source ORDER BY n DESC, first) AS i FROM c)
SELECT source, CASE WHEN n >= 2 THEN lang ELSE 'mixed' END AS dominant FROM b WHERE i = 1""")
def agg_dominant(t: Tables) -> DataFrame:
    ranked = top_n_per_group(t.documents.select("source", "lang", "doc_id"), ["source"], [F.col("doc_id")], 3)
    return rel.agg_dominant(ranked, "source", "lang", "rank")


@query("agg_text_block", """
WITH h AS (SELECT p_brand, p_partkey, '  - ' || p_partkey || ': ' || p_name AS line,
  row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS i FROM part)
SELECT p_brand, string_agg(line, chr(10) ORDER BY p_partkey) AS text_block FROM h WHERE i <= 15 GROUP BY p_brand""")
def agg_text_block(t: Tables) -> DataFrame:
    lines = top_n_per_group(t.part, ["p_brand"], [F.col("p_partkey")], 15).withColumn(
        "line", F.concat(F.lit("  - "), F.col("p_partkey").cast("string"), F.lit(": "), "p_name")
    )
    return rel.agg_text_block(lines, ["p_brand"], "line", "p_partkey")


@query("agg_accuracy", """
SELECT d.lang, sum(CASE WHEN l.quality = 1 - l.toxic THEN 1 ELSE 0 END)::BIGINT AS correct, count(*) AS total,
  round(sum(CASE WHEN l.quality = 1 - l.toxic THEN 1 ELSE 0 END) * 100.0 / count(*)::DOUBLE, 1) AS accuracy_pct
FROM labels l JOIN documents d ON l.doc_id = d.doc_id GROUP BY d.lang""")
def agg_accuracy(t: Tables) -> DataFrame:
    """How often "not toxic" predicts "good quality", per language."""
    log = t.labels.withColumn("predicted", 1 - F.col("toxic")).join(t.documents.select("doc_id", "lang"), "doc_id")
    return rel.agg_accuracy(log, "quality", "predicted", "lang")


@query("agg_accuracy_overall", """
SELECT sum(CASE WHEN quality = 1 - toxic THEN 1 ELSE 0 END)::BIGINT AS correct, count(*) AS total,
  round(sum(CASE WHEN quality = 1 - toxic THEN 1 ELSE 0 END) * 100.0 / count(*)::DOUBLE, 1) AS accuracy_pct FROM labels""")
def agg_accuracy_overall(t: Tables) -> DataFrame:
    return rel.agg_accuracy(t.labels.withColumn("predicted", 1 - F.col("toxic")), "quality", "predicted")


@query("agg_confusion", """
SELECT quality AS expected, sum(CASE WHEN 1 - toxic = 0 THEN 1 ELSE 0 END)::BIGINT AS "0",
  sum(CASE WHEN 1 - toxic = 1 THEN 1 ELSE 0 END)::BIGINT AS "1" FROM labels GROUP BY quality""")
def agg_confusion(t: Tables) -> DataFrame:
    return rel.agg_confusion(t.labels.withColumn("predicted", 1 - F.col("toxic")), "quality", "predicted", [0, 1])


# --- Windows ----------------------------------------------------------------

@query("win_head_per_group", """
SELECT p_brand, p_partkey, CAST(row_number() OVER w AS INTEGER) AS line_no,
  greatest(count(*) OVER (PARTITION BY p_brand) - 15, 0) AS more FROM part
QUALIFY line_no <= 15 WINDOW w AS (PARTITION BY p_brand ORDER BY p_partkey)""".replace(
    "QUALIFY line_no <= 15 WINDOW w AS (PARTITION BY p_brand ORDER BY p_partkey)",
    "WINDOW w AS (PARTITION BY p_brand ORDER BY p_partkey) QUALIFY line_no <= 15"))
def win_head_per_group(t: Tables) -> DataFrame:
    return rel.head_per_group(t.part.select("p_brand", "p_partkey"), "p_brand", ["p_partkey"])


@query("win_topk_per_query", """
SELECT user_id, event_id, value, CAST(row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS INTEGER) AS rank
FROM events QUALIFY rank <= 3""")
def win_topk_per_query(t: Tables) -> DataFrame:
    return top_n_per_group(
        t.events.select("user_id", "event_id", "value"), ["user_id"], [F.desc("value"), F.col("event_id")], 3
    )


@query("win_latest_n", """
SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS INTEGER) AS from_end
FROM events QUALIFY from_end <= 100""")
def win_latest_n(t: Tables) -> DataFrame:
    latest = rel.latest_n(t.events.select("user_id", "event_id", "ts"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 100)
    return latest.drop("ts")


@query("win_dedupe_prefix", """
SELECT min(doc_id) AS doc_id, substring(text, 1, 100) AS prefix FROM documents GROUP BY prefix""")
def win_dedupe_prefix(t: Tables) -> DataFrame:
    from insight_spark.operators.retrieval import dedupe_prefix

    docs = t.documents.select("doc_id", F.substring("text", 1, 100).alias("prefix"), F.col("doc_id").alias("rank"))
    return dedupe_prefix(docs, [], "prefix", "rank").select("doc_id", "prefix")


@query("win_first_per_day", """
SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, arg_min(value, (ts, event_id)) AS value FROM events GROUP BY ALL""")
def win_first_per_day(t: Tables) -> DataFrame:
    first = rel.first_per_day(t.events, ["event_type"], "ts", "event_id", "value")
    return first.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("win_holdout_split", """
WITH d AS (SELECT event_type, date_trunc('day', ts) AS ds, sum(value) AS y FROM events GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ds DESC) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM d)
SELECT event_type, strftime(ds, '%Y-%m-%d') AS day, CASE WHEN i <= greatest(2, least(6, floor(n * 0.2))) THEN 'test' ELSE 'train' END AS part
FROM r""")
def win_holdout_split(t: Tables) -> DataFrame:
    daily = t.events.groupBy("event_type", F.date_trunc("day", "ts").alias("ds")).agg(F.sum("value").alias("y"))
    split = rel.holdout_split(daily.withColumn("tie", F.lit(0)), ["event_type"], "ds", "tie")
    return split.select("event_type", F.date_format("ds", "yyyy-MM-dd").alias("day"), "part")


@query("win_chunk_cap", """
SELECT l_returnflag, l_orderkey, l_linenumber, l_partkey, CAST(row_number() OVER
 (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS INTEGER) AS chunk_rank
FROM lineitem QUALIFY chunk_rank <= 5000""")
def win_chunk_cap(t: Tables) -> DataFrame:
    """The chunk cap on a table with three hot groups: first 5000 rows of each."""
    from insight_spark.operators.retrieval import cap_chunks

    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    rows = t.lineitem.select("l_returnflag", *order)
    return cap_chunks(rows, ["l_returnflag"], order, 5000).drop("l_suppkey", "l_extendedprice")


# --- Sorts, limits, sets ----------------------------------------------------

@query("sort_topn", """
SELECT l_suppkey, round(sum(l_extendedprice), 2) AS total FROM lineitem GROUP BY l_suppkey
ORDER BY total DESC, l_suppkey LIMIT 50""")
def sort_topn(t: Tables) -> DataFrame:
    return rel.sort_topn(t.lineitem, ["l_suppkey"], F.round(F.sum("l_extendedprice"), 2), "total")


@query("sort_recent", """
SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 20""")
def sort_recent(t: Tables) -> DataFrame:
    return t.orders.orderBy(F.desc("o_orderdate"), "o_orderkey").limit(20).select("o_orderkey", "o_totalprice")


@query("sort_month_names", """
SELECT strftime(o_orderdate, '%B') AS order_month, count(*) AS orders FROM orders GROUP BY order_month""")
def sort_month_names(t: Tables) -> DataFrame:
    """Orders per month name, in calendar order."""
    months = t.orders.groupBy(F.date_format("o_orderdate", "MMMM").alias("order_month")).agg(F.count("*").alias("orders"))
    return rel.sort_month_names(months, ["order_month"])


@query("limit_preview", """
SELECT o_orderkey, o_totalprice, row_no, row_no <= 10 AS in_preview FROM (
 SELECT o_orderkey, o_totalprice, CAST(row_number() OVER (ORDER BY o_orderkey) AS INTEGER) AS row_no FROM orders) WHERE row_no <= 100""")
def limit_preview(t: Tables) -> DataFrame:
    return rel.limit_preview(t.orders.select("o_orderkey", "o_totalprice"), ["o_orderkey"])[0]


@query("limit_preview_summary", """
SELECT count(*) AS row_count, 'o_orderkey, o_totalprice' AS "columns", least(count(*), 100) AS data_rows,
 least(count(*), 10) AS preview_rows, count(*) > 100 AS truncated FROM orders""")
def limit_preview_summary(t: Tables) -> DataFrame:
    return rel.limit_preview(t.orders.select("o_orderkey", "o_totalprice"), ["o_orderkey"])[1]


@query("limit_chart_points", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 50")
def limit_chart_points(t: Tables) -> DataFrame:
    from insight_spark.operators.charts import chart_points

    return chart_points(t.orders.select("o_orderkey", "o_totalprice"), ["o_orderkey"])


@query("set_distinct_columns", """
WITH f AS (SELECT o_custkey, o_orderpriority, min(o_orderkey) AS first FROM orders GROUP BY ALL)
SELECT o_custkey, string_agg(o_orderpriority, '|' ORDER BY first) AS columns FROM f GROUP BY o_custkey""")
def set_distinct_columns(t: Tables) -> DataFrame:
    """Distinct priorities of each customer in first-seen order."""
    names = rel.distinct_columns(t.orders, ["o_custkey"], "o_orderpriority", "o_orderkey")
    return names.withColumn("columns", F.array_join("columns", "|"))


@query("table_sample", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 5")
def table_sample(t: Tables) -> DataFrame:
    from insight_spark.sources.tables import table_sample as sample

    return sample(t.orders.select("o_orderkey", "o_custkey", "o_totalprice"), ["o_orderkey"])


@query("table_info", """
SELECT 'orders' AS table_name, count(*) AS row_count, 6 AS column_count,
 'o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority' AS columns FROM orders""")
def table_info(t: Tables) -> DataFrame:
    from insight_spark.sources.tables import table_info as info

    return info(t.orders, "orders")


@query("result_text", """
WITH p AS (SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice = (SELECT max(o_totalprice) FROM orders)),
s AS (SELECT * FROM p ORDER BY o_orderkey LIMIT 10)
SELECT 'Found ' || (SELECT count(*) FROM p) || ' result(s):' || chr(10) || chr(10) ||
 string_agg('• o_orderkey: ' || o_orderkey || ', o_custkey_text: ' || 'key ' || o_orderkey || chr(10), '' ORDER BY o_orderkey) AS text FROM s""")
def result_text(t: Tables) -> DataFrame:
    best = rel.filter_max_row(t.orders, "o_totalprice").select(
        "o_orderkey", F.concat(F.lit("key "), F.col("o_orderkey").cast("string")).alias("o_custkey_text")
    )
    return rel.result_text(best, ["o_orderkey"])


@query("state_upsert", """
WITH latest AS (SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS last_order FROM orders GROUP BY o_custkey)
SELECT c.c_custkey, coalesce('order ' || l.last_order, c.c_mktsegment) AS state
FROM customer c LEFT JOIN latest l ON c.c_custkey = l.o_custkey
UNION ALL SELECT o_custkey, 'order ' || last_order FROM latest WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)""")
def state_upsert(t: Tables) -> DataFrame:
    """Customer state: the segment at first, replaced by the newest order."""
    start = F.lit("1990-01-01 00:00:00").cast("timestamp_ntz")
    current = t.customer.select("c_custkey", F.col("c_mktsegment").alias("state"), start.alias("updated_at"), F.lit(-1).cast("bigint").alias("version"))
    newest = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max(F.struct("o_orderdate", "o_orderkey")).alias("n"))
    changes = newest.select(
        "c_custkey", F.concat(F.lit("order "), F.col("n.o_orderkey").cast("string")).alias("state"),
        F.col("n.o_orderdate").alias("updated_at"), F.col("n.o_orderkey").alias("version"),
    )
    return rel.state_upsert(current, changes, "c_custkey", "updated_at").select("c_custkey", "state")
