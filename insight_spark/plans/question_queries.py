"""Routing, charts, the conversation log and its evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from insight_spark.functions import fixed_values as fv
from insight_spark.functions import language as lang
from insight_spark.functions import logs
from insight_spark.operators import charts, conversations as conv, evaluation as ev, relational as rel, routing
from insight_spark.operators.scale import spread_small
from insight_spark.plans.registry import Tables, query, sql_any
from insight_spark.plans.text_queries import (
    QUESTION_SQL,
    _language_sql,
    map_sql,
    questions_on_parts,
)

# --- Routing ----------------------------------------------------------------

def route_questions(t: Tables) -> DataFrame:
    """Questions with the state of their session: files, kinds, vocabulary hint."""
    on_parts = questions_on_parts(t)
    turns = t.conversations.filter(F.col("role") == "user").select(
        (-(F.col("conv_id") * 1000 + F.col("turn")) - 1).alias("question_id"),
        F.pmod("conv_id", F.lit(50)).cast("int").alias("p_size"),
        F.col("text").alias("question"),
    )
    kind = F.col("p_size") % 5
    return on_parts.unionByName(turns).select(
        "question_id", "question",
        (kind != 0).alias("has_docs"), (kind > 1).alias("has_csv"),
        F.when(kind == 2, F.array(F.lit("a.csv"))).otherwise(F.array(F.lit("a.csv"), F.lit("notes.txt"))).alias("files"),
        F.when(F.col("p_size") > 40, F.lit("tie")).when(F.col("p_size") > 25, F.lit("document")).when(F.col("p_size") > 5, F.lit("csv")).alias("hint"),
        F.when(F.col("p_size") > 46, F.lit("csv")).when(F.col("p_size") > 43, F.lit("document")).otherwise(F.lit("mixed")).alias("dominant"),
    )


def _general_sql(strict: bool = False) -> str:
    patterns = "|".join(f"(?:{p})" if p.endswith(r"\b") else f"(?:{p}\\b)" for p in fv.GENERAL_PATTERNS)
    starts = " OR ".join(f"starts_with(trim(q), '{s}')" for s in fv.GENERAL_STARTERS)
    return (
        f"(regexp_matches(trim(q), '{patterns}') OR {sql_any('trim(q)', fv.GENERAL_TOPICS)} "
        f"OR (({starts}) AND NOT {sql_any('trim(q)', fv.DATA_SIGNALS)}))"
    )


ROUTE_INPUT_SQL = f"""
base AS (SELECT question_id, p_size, question FROM {QUESTION_SQL}
 UNION ALL SELECT -(conv_id * 1000 + turn) - 1, (conv_id % 50)::INTEGER, text FROM conversations WHERE role = 'user'),
asked AS (SELECT question_id, question, lower(question) AS q, p_size % 5 <> 0 AS has_docs, p_size % 5 > 1 AS has_csv,
 p_size % 5 <> 2 AS other_files,
 CASE WHEN p_size > 40 THEN 'tie' WHEN p_size > 25 THEN 'document' WHEN p_size > 5 THEN 'csv' END AS hint,
 CASE WHEN p_size > 46 THEN 'csv' WHEN p_size > 43 THEN 'document' ELSE 'mixed' END AS dominant FROM base)"""
ROUTE_SQL = f"""
{ROUTE_INPUT_SQL},
routed AS (SELECT question_id, question, CASE WHEN {_general_sql()} THEN 'GENERAL'
 WHEN has_csv AND NOT {sql_any('q', fv.HISTORICAL_SIGNALS)} AND {sql_any('q', fv.FORECAST_WORDS)} THEN 'FORECAST'
 WHEN NOT has_docs AND NOT has_csv THEN 'GENERAL' WHEN has_docs AND NOT has_csv THEN 'DOCUMENT'
 WHEN has_csv AND regexp_matches(q, '\\b(?:{'|'.join(fv.CHART_WORDS)})s?\\b') THEN 'SQL'
 WHEN other_files AND hint = 'csv' THEN CASE WHEN {sql_any('q', fv.TABLE_COMPARISON_WORDS)} THEN 'HYBRID' ELSE 'SQL' END
 WHEN other_files AND hint = 'document' THEN CASE WHEN {sql_any('q', fv.CROSS_SOURCE_WORDS)} THEN 'HYBRID' ELSE 'DOCUMENT' END
 WHEN other_files AND hint = 'tie' THEN CASE dominant WHEN 'csv' THEN 'SQL' WHEN 'document' THEN 'DOCUMENT' ELSE 'HYBRID' END
 WHEN {sql_any('q', fv.HYBRID_WORDS)} THEN 'HYBRID'
 WHEN {sql_any('q', fv.DEFINITION_WORDS)} AND {sql_any('q', fv.DATA_REQUEST_WORDS)} AND NOT {sql_any('q', fv.PURE_METRIC_WORDS)} THEN 'HYBRID'
 ELSE 'SQL' END AS route FROM asked)"""


def routed(t: Tables) -> DataFrame:
    route = routing.classify_route(
        F.col("question"), F.col("has_docs"), F.col("has_csv"), F.col("files"), F.col("hint"), F.col("dominant")
    )
    return route_questions(t).withColumn("route", route)


@query("classify_route", f"WITH {ROUTE_SQL} SELECT question_id, route FROM routed")
def classify_route(t: Tables) -> DataFrame:
    return routed(t).select("question_id", "route")


@query("csv_route", f"""
WITH {ROUTE_INPUT_SQL} SELECT question_id, CASE WHEN length(trim(question)) < 3 THEN 'SQL' WHEN NOT has_csv THEN 'RAG'
 WHEN regexp_matches(trim(question), '(?i){fv.CHART_QUESTION_PATTERN}') THEN 'SQL'
 WHEN regexp_matches(trim(question), '(?i){fv.TABLE_QUESTION_PATTERN}') THEN 'SQL' END AS route FROM asked""")
def csv_route(t: Tables) -> DataFrame:
    return route_questions(t).select("question_id", routing.csv_route(F.col("question"), F.col("has_csv")).alias("route"))


@query("route_reason", f"WITH {ROUTE_SQL} SELECT question_id, {map_sql(fv.ROUTE_REASONS, 'route')} AS reason FROM routed")
def route_reason(t: Tables) -> DataFrame:
    return routed(t).select("question_id", logs.route_reason(F.col("route")).alias("reason"))


@query("combine_hybrid", """
WITH a AS (SELECT p_partkey AS id, CASE p_size % 4 WHEN 0 THEN 'This information is not available in the uploaded data.' ELSE 'The price is ' || p_type END AS tt,
 CASE WHEN p_size % 4 = 1 THEN 0 ELSE 1 END AS rc, ' On ' || p_name || ' ' AS dt, p_size % 3 = 0 AS nf FROM part),
f AS (SELECT *, contains(lower(tt), 'not available') OR rc = 0 AS no_t FROM a)
SELECT id, CASE WHEN no_t AND nf THEN 'none' WHEN no_t THEN 'document' WHEN nf THEN 'table' ELSE 'both' END AS used,
 CASE WHEN no_t AND nf THEN 'This information is not available in the uploaded files.' WHEN no_t THEN trim(dt) WHEN nf THEN trim(tt)
 ELSE '**Data Analysis:**' || chr(10) || trim(tt) || chr(10) || chr(10) || '**Document Context:**' || chr(10) || trim(dt) END AS answer FROM f""")
def combine_hybrid(t: Tables) -> DataFrame:
    by_table = t.part.select(
        F.col("p_partkey").alias("id"),
        F.when(F.col("p_size") % 4 == 0, F.lit(fv.NOT_AVAILABLE_TABLE_ANSWER)).otherwise(F.concat(F.lit("The price is "), "p_type")).alias("table_text"),
        F.when(F.col("p_size") % 4 == 1, 0).otherwise(1).alias("row_count"),
    )
    by_document = t.part.select(
        F.col("p_partkey").alias("id"), F.concat(F.lit(" On "), "p_name", F.lit(" ")).alias("document_text"),
        (F.col("p_size") % 3 == 0).alias("not_found"),
    )
    return routing.combine_hybrid(by_table, by_document, "id")


@query("chart_spec", """
WITH m AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY month),
p AS (SELECT * FROM m ORDER BY month LIMIT 50)
SELECT 'line' AS type, string_agg(month, '|' ORDER BY month) AS x, count(total) AS points, round(sum(total), 2) AS y_sum,
 'month' AS x_label, 'total' AS y_label, 'total by month' AS title, (SELECT count(*) FROM m) > 50 AS truncated FROM p""")
def chart_spec(t: Tables) -> DataFrame:
    months = rel.agg_by_month(t.orders, "o_orderdate", "o_totalprice").select("month", "total")
    spec = charts.chart_spec(months, "show revenue", ["month"])
    return spec.select(
        "type", F.array_join("x", "|").alias("x"), F.size("y").cast("bigint").alias("points"),
        F.round(F.aggregate("y", F.lit(0.0), lambda a, b: a + b), 2).alias("y_sum"), "x_label", "y_label", "title", "truncated",
    )


# --- Conversation log -------------------------------------------------------

LOG_SQL = """
msgs AS (SELECT conv_id * 1000 + turn AS message_id, conv_id AS conversation_id, role, text AS content,
 CASE WHEN role = 'assistant' THEN CASE turn % 3 WHEN 0 THEN 'sql' WHEN 1 THEN 'document' ELSE 'hybrid' END END AS routing,
 conv_id * 3600 + turn * 60 AS created_at FROM conversations),
convs AS (SELECT conversation_id, 'user' || (conversation_id % 7) AS user_id, 'New Chat' AS title, min(created_at) AS created_at,
 max(created_at) AS updated_at FROM msgs GROUP BY conversation_id)"""


def messages(t: Tables) -> DataFrame:
    kind = F.col("turn") % 3
    return t.conversations.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("message_id"),
        F.col("conv_id").alias("conversation_id"), "role", F.col("text").alias("content"),
        F.when(F.col("role") == "assistant", F.when(kind == 0, "sql").when(kind == 1, "document").otherwise("hybrid")).alias("routing"),
        (F.col("conv_id") * 3600 + F.col("turn") * 60).alias("created_at"),
    )


def chats(t: Tables) -> DataFrame:
    return messages(t).groupBy("conversation_id").agg(
        F.min("created_at").alias("created_at"), F.max("created_at").alias("updated_at")
    ).select(
        "conversation_id", F.concat(F.lit("user"), (F.col("conversation_id") % 7).cast("string")).alias("user_id"),
        F.lit("New Chat").alias("title"), "created_at", "updated_at",
    )


@query("conversation_list", f"""
WITH {LOG_SQL} SELECT c.conversation_id, c.user_id, c.title, c.created_at, c.updated_at, count(m.message_id) AS message_count
FROM convs c LEFT JOIN msgs m ON c.conversation_id = m.conversation_id WHERE c.user_id = 'user3'
GROUP BY ALL ORDER BY c.updated_at DESC, c.conversation_id LIMIT 20""")
def conversation_list(t: Tables) -> DataFrame:
    return conv.conversation_list(chats(t), messages(t), "user3")


@query("conversation_get", f"""
WITH {LOG_SQL} SELECT c.conversation_id, c.title, m.message_id, m.role, CAST(row_number() OVER
 (PARTITION BY c.conversation_id ORDER BY m.created_at, m.message_id) AS INTEGER) AS message_no FROM convs c JOIN msgs m USING (conversation_id) QUALIFY message_no <= 50""")
def conversation_get(t: Tables) -> DataFrame:
    found = conv.conversation_get(
        chats(t).select("conversation_id", "title"),
        messages(t).select("conversation_id", "message_id", "role", "created_at"), ["created_at", "message_id"],
    )
    return found.drop("created_at")


@query("conversation_search", f"""
WITH {LOG_SQL} SELECT DISTINCT c.conversation_id, c.title, c.updated_at FROM convs c JOIN msgs m USING (conversation_id)
WHERE m.content ILIKE '%NICHT%' ORDER BY c.updated_at DESC, c.conversation_id LIMIT 20""")
def conversation_search(t: Tables) -> DataFrame:
    return conv.conversation_search(chats(t), messages(t), "NICHT")


@query("conversation_create", """
SELECT c_custkey AS conversation_id, 'user' || c_nationkey AS user_id, 'New Chat' AS title, c_custkey * 60 AS created_at, c_custkey * 60 AS updated_at FROM customer""")
def conversation_create(t: Tables) -> DataFrame:
    """One new conversation per customer."""
    asked = t.customer.select(
        F.col("c_custkey").alias("conversation_id"),
        F.concat(F.lit("user"), F.col("c_nationkey").cast("string")).alias("user_id"),
        F.lit(None).cast("string").alias("title"), (F.col("c_custkey") * 60).alias("created_at"),
    )
    return conv.conversation_create(asked)


@query("message_append", f"""
WITH {LOG_SQL}, last AS (SELECT conversation_id, max(message_id) AS message_id FROM msgs WHERE role = 'user' GROUP BY conversation_id),
new AS (SELECT m.conversation_id, m.content, m.created_at FROM msgs m JOIN last USING (message_id))
SELECT c.conversation_id, CASE WHEN n.content IS NULL THEN c.title ELSE substring(n.content, 1, 50) END AS title,
 greatest(c.created_at, coalesce(n.created_at, c.created_at)) AS updated_at FROM convs c LEFT JOIN new n USING (conversation_id)""")
def message_append(t: Tables) -> DataFrame:
    """Append each conversation's last user turn to the state at its creation."""
    log = messages(t)
    last = log.filter(F.col("role") == "user").groupBy("conversation_id").agg(F.max("message_id").alias("message_id"))
    new = log.join(last.select("message_id"), "message_id", "left_semi")
    old = log.join(last.select("message_id"), "message_id", "left_anti")
    start = chats(t).withColumn("updated_at", F.col("created_at"))
    return conv.message_append(start, old, new.select(*old.columns))[0].select("conversation_id", "title", "updated_at")


@query("conversation_delete", f"""
WITH {LOG_SQL} SELECT message_id, conversation_id FROM msgs WHERE conversation_id NOT IN (SELECT conversation_id FROM msgs WHERE role = 'system')""")
def conversation_delete(t: Tables) -> DataFrame:
    log = messages(t)
    gone = log.filter(F.col("role") == "system")
    return conv.conversation_delete(chats(t), log, gone)[1].select("message_id", "conversation_id")


@query("agg_user_analytics", f"""
WITH {LOG_SQL} SELECT c.user_id, count(DISTINCT c.conversation_id) AS total_conversations, count(m.message_id) AS total_messages
FROM convs c LEFT JOIN msgs m USING (conversation_id) GROUP BY c.user_id""")
def agg_user_analytics(t: Tables) -> DataFrame:
    return conv.user_analytics(chats(t), messages(t))


@query("agg_routing_breakdown", f"""
WITH {LOG_SQL} SELECT c.user_id, m.routing, count(*) AS messages FROM msgs m JOIN convs c USING (conversation_id)
WHERE m.routing IS NOT NULL GROUP BY ALL""")
def agg_routing_breakdown(t: Tables) -> DataFrame:
    return conv.routing_breakdown(chats(t), messages(t))


def session_chunks(t: Tables) -> DataFrame:
    """Turns that are not the user's, as chunks of a file named after the role; system turns as tables."""
    return t.conversations.filter(F.col("role") != "user").select(
        F.col("conv_id").alias("conversation_id"), F.col("role").alias("source"),
        F.when(F.col("role") == "system", "csv").otherwise("document").alias("source_type"),
    )


def status(t: Tables) -> DataFrame:
    chunks = session_chunks(t)
    tables = chunks.filter(F.col("source_type") == "csv").select("conversation_id")
    return conv.session_status(chats(t).select("conversation_id"), chunks, tables)


STATUS_SQL = f"""
{LOG_SQL}, st AS (SELECT c.conversation_id, count(DISTINCT m.role) AS total_documents, count(m.message_id) AS total_vectors,
 coalesce(bool_or(m.role = 'system'), false) AS has_csv,
 (SELECT count(*) FROM msgs s WHERE s.conversation_id = c.conversation_id AND s.role = 'system') AS csv_tables,
 CASE WHEN count(m.message_id) > 0 THEN 'active' ELSE 'idle' END AS status, count(m.message_id) > 0 AS vectorstore_ready
 FROM convs c LEFT JOIN msgs m ON m.conversation_id = c.conversation_id AND m.role <> 'user' GROUP BY c.conversation_id)"""


@query("session_status", f"WITH {STATUS_SQL} SELECT * FROM st")
def session_status(t: Tables) -> DataFrame:
    return status(t)


@query("agg_session_stats", f"""
WITH {STATUS_SQL} SELECT count(*) AS total_sessions, count(*) FILTER (status = 'active') AS active_sessions,
 sum(total_vectors)::BIGINT AS total_vectors FROM st""")
def agg_session_stats(t: Tables) -> DataFrame:
    return conv.session_stats(status(t))


# --- Evaluation -------------------------------------------------------------

EXPECTED = {"ECONOMY": "sql", "STANDARD": "sql", "PROMO": "hybrid", "MEDIUM": "forecast", "LARGE": "document", "SMALL": "general"}


def routing_log(t: Tables) -> DataFrame:
    expected = t.part.select(
        F.col("p_partkey").alias("question_id"),
        F.coalesce(*[F.when(F.col("p_type") == k, F.lit(v)) for k, v in EXPECTED.items()]).alias("expected"),
    )
    return routed(t).select("question_id", F.lower("route").alias("predicted")).join(expected, "question_id")


ROUTING_LOG_SQL = f"""
{ROUTE_SQL}, log AS (SELECT question_id, {map_sql(EXPECTED, 'p_type')} AS expected, lower(route) AS predicted
 FROM routed JOIN part ON p_partkey = question_id)"""


@query("eval_routing", f"""
WITH {ROUTING_LOG_SQL} SELECT expected, count(*) FILTER (expected = predicted) AS correct, count(*) AS total,
 round(count(*) FILTER (expected = predicted) * 100.0 / count(*)::DOUBLE, 1) AS accuracy_pct FROM log GROUP BY expected""")
def eval_routing(t: Tables) -> DataFrame:
    return ev.eval_routing(routing_log(t))["per_category"]


@query("eval_routing_confusion", f"""
WITH {ROUTING_LOG_SQL} SELECT expected, {', '.join(f"count(*) FILTER (predicted = '{r}') AS {r}" for r in ev.ROUTES)} FROM log GROUP BY expected""")
def eval_routing_confusion(t: Tables) -> DataFrame:
    return ev.eval_routing(routing_log(t))["confusion"]


@query("eval_routing_failures", f"WITH {ROUTING_LOG_SQL} SELECT question_id, expected, predicted FROM log WHERE expected <> predicted")
def eval_routing_failures(t: Tables) -> DataFrame:
    return ev.eval_routing(routing_log(t))["failures"].select("question_id", "expected", "predicted")


@query("eval_retrieval_misses", """
SELECT conv_id, turn, ['nicht', role] AS keywords FROM conversations WHERE NOT contains(lower(text), 'nicht') AND NOT contains(lower(text), role)""")
def eval_retrieval_misses(t: Tables) -> DataFrame:
    """Answers without any of their keywords."""
    log = t.conversations.select("conv_id", "turn", F.col("text").alias("answer"), F.array(F.lit("nicht"), F.col("role")).alias("keywords"))
    return ev.retrieval_misses(log).select("conv_id", "turn", "keywords")


@query("eval_guard_slippages", f"""
SELECT conv_id, turn, substring(lower(text), 1, 100) AS snippet FROM conversations WHERE role = 'assistant'
 AND NOT contains(lower(text), 'rate limit') AND NOT contains(text, '429')
 AND NOT ({sql_any('lower(text)', fv.REFUSAL_PHRASES)} OR length(trim(lower(text))) < 30)""")
def eval_guard_slippages(t: Tables) -> DataFrame:
    """Answers that should have been refused and were not."""
    return ev.guard_slippages(t.conversations.filter(F.col("role") == "assistant"), "text").select("conv_id", "turn", "snippet")


@query("eval_retrieval", """
WITH a AS (SELECT contains(lower(c.text), 'nicht') OR contains(lower(c.text), c.role) AS hit FROM conversations c)
SELECT count(*) FILTER (hit) AS hits, count(*) AS total, round(count(*) FILTER (hit) * 100.0 / count(*)::DOUBLE, 1) AS hit_rate_pct FROM a""")
def eval_retrieval(t: Tables) -> DataFrame:
    log = t.conversations.select(F.col("text").alias("answer"), F.array(F.lit("nicht"), F.col("role")).alias("keywords"))
    return ev.eval_retrieval(log)


@query("eval_latency", """
WITH m AS (SELECT user_id, event_type, avg(value) AS mean_s FROM events GROUP BY ALL),
a AS (SELECT event_type AS class, mean_s FROM m UNION ALL SELECT 'overall', mean_s FROM m),
r AS (SELECT class, mean_s, row_number() OVER (PARTITION BY class ORDER BY mean_s) AS i, count(*) OVER (PARTITION BY class) AS n FROM a)
SELECT class, count(*) AS questions, round(avg(mean_s), 3) AS avg_s, round(max(mean_s) FILTER (i = floor(0.95 * n) + 1), 3) AS p95_s FROM r GROUP BY class""")
def eval_latency(t: Tables) -> DataFrame:
    """Event values as a timing log: user = question, event type = class."""
    return ev.eval_latency(t.events, "user_id", "event_type", "value")


@query("eval_guard", f"""
WITH a AS (SELECT {sql_any('lower(text)', fv.REFUSAL_PHRASES)} OR length(trim(lower(text))) < 30 AS guarded FROM conversations
 WHERE role = 'assistant' AND NOT contains(lower(text), 'rate limit') AND NOT contains(text, '429'))
SELECT count(*) FILTER (guarded) AS guarded, count(*) AS total, round(count(*) FILTER (guarded) * 100.0 / count(*)::DOUBLE, 1) AS guard_rate_pct FROM a""")
def eval_guard(t: Tables) -> DataFrame:
    return ev.eval_guard(t.conversations.filter(F.col("role") == "assistant"), "text")


@query("eval_language", f"""
WITH src AS (SELECT lang, text FROM documents), {_language_sql('text')}
SELECT count(*) FILTER (lang = detected) AS correct, count(*) AS total,
 round(count(*) FILTER (lang = detected) * 100.0 / count(*)::DOUBLE, 1) AS accuracy_pct, count(DISTINCT detected) AS languages FROM d""")
def eval_language(t: Tables) -> DataFrame:
    docs = spread_small(t.documents.select("lang", "text"))
    return ev.eval_language(docs.withColumn("detected", lang.detect_language(F.col("text"))), "lang", "detected")


@query("eval_overall", """
WITH s AS (SELECT d.source, l.quality * 100.0::DOUBLE AS score FROM labels l JOIN documents d USING (doc_id)),
m AS (SELECT source, avg(score) AS mean FROM s GROUP BY source)
SELECT source, round(mean, 1) AS overall, CASE WHEN mean >= 90 THEN 'A+ Excellent' WHEN mean >= 80 THEN 'A Good' WHEN mean >= 70 THEN 'B Fair'
 ELSE 'C Needs Improvement' END AS grade FROM m""")
def eval_overall(t: Tables) -> DataFrame:
    scores = t.labels.join(t.documents.select("doc_id", "source"), "doc_id").withColumn("score", F.col("quality") * 100.0)
    return ev.eval_overall(scores, "score", ["source"])
