"""Column functions over real names, texts, logs and JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from insight_spark.functions import fixed_values as fv
from insight_spark.functions import language as lang
from insight_spark.functions import logs
from insight_spark.functions import text as tx
from insight_spark.operators.scale import spread_small
from insight_spark.plans.registry import Tables, query, sql_any, sql_list

# Words of a text as the library counts them, in SQL without look-around.
WORDS_SQL = (
    "[w for w in regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}_]+') if regexp_full_match(w, '[a-z]{{3,}}')]"
)
TOKENS_SQL = (
    "[w for w in regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}_]+') if regexp_full_match(w, '[a-z]{{3,}}') "
    "AND NOT list_contains(" + sql_list(fv.STOP_WORDS) + ", w)]"
)
NORMAL_SQL = (
    "trim(regexp_replace(regexp_replace(regexp_replace(lower({0}), '[_\\-/\\\\|]', ' ', 'g'), "
    "'[^\\p{{L}}\\p{{N}}_\\s]', '', 'g'), '\\s+', ' ', 'g'))"
)


def map_sql(entries: dict, key: str) -> str:
    cases = " ".join(f"WHEN '{k}' THEN " + (f"'{v}'" if isinstance(v, str) else str(v)) for k, v in entries.items())
    return f"CASE {key} {cases} END"


@query("normalize_token", f"SELECT page_id, {NORMAL_SQL.format('url')} AS token FROM pages")
def normalize_token(t: Tables) -> DataFrame:
    return t.pages.select("page_id", tx.normalize_token(F.col("url")).alias("token"))


def abbreviated_names(t: Tables) -> DataFrame:
    """Invented column names built from the part table: 'avg small_qty' and the like."""
    short = F.when(F.col("p_size") % 3 == 0, F.lit("avg ")).when(F.col("p_size") % 3 == 1, F.lit("max ")).otherwise(F.lit("ytd "))
    return t.part.select("p_partkey", F.concat(short, F.col("p_name"), F.lit(" qty")).alias("name"))


ABBREVIATED_SQL = """(SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'avg ' WHEN 1 THEN 'max ' ELSE 'ytd ' END || p_name || ' qty' AS name FROM part)"""


@query("expand_abbreviations", f"""
SELECT p_partkey, array_to_string([coalesce({map_sql(fv.ABBREVIATIONS, 'w')}, w) for w in string_split({NORMAL_SQL.format('name')}, ' ')], ' ') AS name
FROM {ABBREVIATED_SQL}""")
def expand_abbreviations(t: Tables) -> DataFrame:
    return abbreviated_names(t).select(
        "p_partkey", tx.expand_abbreviations(tx.normalize_token(F.col("name"))).alias("name")
    )


MONTH_TEXT_SQL = """CASE o_orderkey % 7 WHEN 0 THEN strftime(o_orderdate, '%b') WHEN 1 THEN strftime(o_orderdate, '%B')
 WHEN 2 THEN strftime(o_orderdate, '%m') WHEN 3 THEN strftime(o_orderdate, '%Y-%m') WHEN 4 THEN strftime(o_orderdate, '%m/%Y')
 WHEN 5 THEN strftime(o_orderdate, '%b %Y') ELSE o_orderpriority END"""


def month_text():
    """Order dates written in seven ways, one of them no month at all."""
    d = F.col("o_orderdate")
    ways = [F.date_format(d, f) for f in ("MMM", "MMMM", "MM", "yyyy-MM", "MM/yyyy", "MMM yyyy")]
    chain = F.when(F.col("o_orderkey") % 7 == 0, ways[0])
    for i, way in enumerate(ways[1:], start=1):
        chain = chain.when(F.col("o_orderkey") % 7 == i, way)
    return chain.otherwise(F.col("o_orderpriority"))


@query("parse_month", """
SELECT o_orderkey, CASE WHEN o_orderkey % 7 < 6 THEN strftime(o_orderdate, '%B') END AS month FROM orders""")
def parse_month(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", tx.parse_month(month_text()).alias("month"))


@query("month_number", """
SELECT o_orderkey, CASE WHEN o_orderkey % 7 < 3 THEN CAST(month(o_orderdate) AS INTEGER) END AS month_no FROM orders""")
def month_number(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", tx.month_number(month_text()).alias("month_no"))


CAMEL_SQL = "replace(upper(p_type[1]) || lower(p_type[2:]) || 'Price_' || p_brand, '#', '')"


def camel_name():
    """'PromoPrice_Brand7': a column name as people write it."""
    return F.replace(F.concat(F.initcap("p_type"), F.lit("Price_"), "p_brand"), F.lit("#"), F.lit(""))


@query("humanize_column", f"""
SELECT p_partkey, trim(replace(regexp_replace({CAMEL_SQL}, '([a-z])([A-Z])', '\\1 \\2', 'g'), '_', ' ')) AS label FROM part""")
def humanize_column(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", tx.humanize_column(camel_name()).alias("label"))


@query("format_value", """
SELECT l_orderkey, l_partkey, l_linenumber,
 CASE WHEN l_extendedprice >= 100 THEN '$' || format('{:,.0f}', l_extendedprice) ELSE '$' || format('{:.2f}', l_extendedprice) END AS price,
 format('{:,.1f}', l_extendedprice / 7) || ' LPA' AS salary_lpa, format('{:.1f}', l_discount * 37) || '%' AS rate,
 CASE WHEN l_quantity = floor(l_quantity) THEN CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) ELSE format('{:.2f}', l_quantity) END AS quantity,
 format('{:.2f}', l_tax / 7 + 0.001) AS share, l_returnflag AS flag FROM lineitem""")
def format_value(t: Tables) -> DataFrame:
    return t.lineitem.select(
        "l_orderkey", "l_partkey", "l_linenumber",
        tx.format_value("price", F.col("l_extendedprice"), "numeric").alias("price"),
        tx.format_value("salary_lpa", F.col("l_extendedprice") / 7, "numeric").alias("salary_lpa"),
        tx.format_value("rate", F.col("l_discount") * 37, "numeric").alias("rate"),
        tx.format_value("quantity", F.col("l_quantity"), "numeric").alias("quantity"),
        tx.format_value("share", F.col("l_tax") / 7 + 0.001, "numeric").alias("share"),
        tx.format_value("flag", F.col("l_returnflag"), "categorical").alias("flag"),
    )


ID_NAME_SQL = """CASE p_size % 4 WHEN 0 THEN p_type || 'ID' WHEN 1 THEN p_name || ' Code' WHEN 2 THEN p_name || ' Number' ELSE 'id' END"""


@query("record_type", f"""
WITH n AS (SELECT p_partkey, {ID_NAME_SQL} AS name FROM part),
s AS (SELECT p_partkey, trim(regexp_replace(name, '([Ii][Dd]|[Cc]ode|[Nn]o|[Nn]um(ber)?)$', '')) AS stem FROM n)
SELECT p_partkey, CASE WHEN stem = '' THEN 'Record' ELSE stem END AS kind FROM s""")
def record_type(t: Tables) -> DataFrame:
    part = F.col("p_size") % 4
    name = (
        F.when(part == 0, F.concat("p_type", F.lit("ID"))).when(part == 1, F.concat("p_name", F.lit(" Code")))
        .when(part == 2, F.concat("p_name", F.lit(" Number"))).otherwise(F.lit("id"))
    )
    return t.part.select("p_partkey", tx.record_type(name).alias("kind"))


def logged_sql(t: Tables) -> DataFrame:
    """SQL statements as a model would log them, one per part."""
    kind = F.col("p_size") % 3
    name = F.concat(F.lit("'"), F.initcap("p_name"), F.lit("'"))
    text = (
        F.when(kind == 0, F.concat(F.lit("```sql\nSELECT MAX p_retailprice FROM part WHERE p_name = "), name, F.lit(";\n```")))
        .when(kind == 1, F.concat(F.lit("SELECT AVG(p_size) -- the mean\nFROM upload_ab12cd34_parts WHERE p_type = '"), F.lower("p_type"), F.lit("' AND p_size < '"), F.col("p_size").cast("string"), F.lit("'")))
        .otherwise(F.concat(F.lit("SELECT p_brand /* brand */ FROM `part` JOIN orders ON 1 = 1 WHERE p_name IN ("), name, F.lit(", 'unknown thing');")))
    )
    return t.part.select(F.col("p_partkey").alias("sql_id"), text.alias("sql"))


LOGGED_SQL = """(SELECT p_partkey AS sql_id, p_size % 3 AS kind, lower(p_type) AS low_type, p_size,
 array_to_string([upper(w[1]) || lower(w[2:]) for w in string_split(p_name, ' ')], ' ') AS title FROM part)"""


@query("clean_sql_text", f"""
SELECT sql_id, CASE kind WHEN 0 THEN 'SELECT MAX(p_retailprice) FROM part WHERE p_name = ''' || title || ''''
 WHEN 1 THEN 'SELECT AVG(p_size) ' || chr(10) || 'FROM upload_ab12cd34_parts WHERE p_type = ''' || low_type || ''' AND p_size < ''' || p_size || ''''
 ELSE 'SELECT p_brand  FROM `part` JOIN orders ON 1 = 1 WHERE p_name IN (''' || title || ''', ''unknown thing'')' END AS sql FROM {LOGGED_SQL}""")
def clean_sql_text(t: Tables) -> DataFrame:
    return logged_sql(t).select("sql_id", logs.clean_sql_text(F.col("sql")).alias("sql"))


@query("primary_table", f"""
SELECT sql_id, CASE kind WHEN 1 THEN 'upload_ab12cd34_parts' ELSE 'part' END AS table_name FROM {LOGGED_SQL}""")
def primary_table(t: Tables) -> DataFrame:
    return logged_sql(t).select("sql_id", logs.primary_table(F.col("sql")).alias("table_name"))


def _script_sql(text: str) -> str:
    total = f"greatest(length(replace({text}, ' ', '')), 1)::DOUBLE"
    rules = " ".join(
        f"WHEN len(regexp_extract_all({text}, '{pattern}')) / {total} > {share} THEN '{code}'"
        for code, pattern, share in fv.SCRIPTS
    )
    return f"CASE {rules} END"


# Texts of several scripts: whole documents with foreign words put in front, as many as a tenth of their letters or more.
SCRIPT_SAMPLES = {"en": "총수익은", "fr": "ここで何人", "de": "كم عدد", "es": "यहाँ कितने"}
SCRIPT_TEXT_SQL = f"(repeat({map_sql(SCRIPT_SAMPLES, 'lang')} || ' ', CAST(1 + n_chars // 40 * (n_chars % 3) AS BIGINT)) || text)"


@query("script_language", f"""
WITH s AS (SELECT doc_id, {SCRIPT_TEXT_SQL} AS text FROM documents)
SELECT doc_id, {_script_sql('text')} AS script FROM s""")
def script_language(t: Tables) -> DataFrame:
    sample = F.try_element_at(tx.literal_map(SCRIPT_SAMPLES), F.col("lang"))
    times = 1 + F.floor(F.col("n_chars") / 40) * (F.col("n_chars") % 3)
    text = F.concat(F.repeat(F.concat(sample, F.lit(" ")), times.cast("int")), F.col("text"))
    return t.documents.select("doc_id", lang.script_language(text).alias("script"))


def _language_sql(text: str) -> str:
    score = {
        code: f"len([w for w in words if list_contains({sql_list(words.split())}, w)])"
        + (
            f" + CASE WHEN regexp_matches(lower({text}), '[{lang.MARKER_LETTERS[code]}]') THEN 2 ELSE 0 END"
            if code in lang.MARKER_LETTERS else ""
        )
        for code, words in lang.COMMON_WORDS.items()
    }
    scores = ", ".join(f"{sql} AS s_{code}" for code, sql in score.items())
    best = f"greatest({', '.join('s_' + code for code in score)})"
    pick = " ".join(f"WHEN s_{code} = {best} THEN '{code}'" for code in score)
    total = f"greatest(length(replace({text}, ' ', '')), 1)::DOUBLE"
    alphabets = " ".join(
        f"WHEN len(regexp_extract_all({text}, '{pattern}')) / {total} > {lang.ALPHABET_SHARE} THEN '{code}'"
        for code, pattern in lang.ALPHABETS.items()
    )
    return f"""
w AS (SELECT *, regexp_extract_all(lower({text}), '\\p{{L}}+') AS words FROM src),
s AS (SELECT *, {scores} FROM w),
l AS (SELECT *, CASE WHEN {best} = 0 THEN NULL {pick} END AS latin FROM s),
d AS (SELECT *, coalesce({_script_sql(text)}, CASE {alphabets} END,
 CASE WHEN latin = 'ca' AND {sql_any(f'lower({text})', fv.PORTUGUESE_MARKERS)} THEN 'pt' ELSE latin END, 'en') AS detected FROM l)"""


@query("detect_language", f"""
WITH src AS (SELECT doc_id, lang, text FROM documents), {_language_sql('text')}
SELECT doc_id, lang, detected FROM d""")
def detect_language(t: Tables) -> DataFrame:
    docs = spread_small(t.documents.select("doc_id", "lang", "text"))
    return docs.select("doc_id", "lang", lang.detect_language(F.col("text")).alias("detected"))


@query("detect_language_profiles", """
SELECT DISTINCT lang, length, true AS accurate FROM documents, (SELECT unnest(['whole', 'short']) AS length) WHERE lang IS NOT NULL""")
def detect_language_profiles(t: Tables) -> DataFrame:
    """Profiles learned from half of the documents tell the language of at least 19 in 20, of whole texts and of six words."""
    learned = t.documents.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0)
    profiles = lang.learn_profiles(learned)
    docs = spread_small(t.documents.filter("lang IS NOT NULL").select("doc_id", "lang", "text"))
    six = F.array_join(F.slice(F.split("text", r"\\s+"), 1, 6), " ")
    kinds = docs.select("doc_id", "lang", F.explode(F.array(
        F.struct(F.lit("whole").alias("length"), F.col("text").alias("part")), F.struct(F.lit("short").alias("length"), six.alias("part")),
    )).alias("k")).select("lang", "k.*")
    right = (lang.detect_by_profiles(F.col("part"), profiles) == F.col("lang")).cast("int")
    return kinds.groupBy("lang", "length").agg((F.avg(right) >= 0.95).alias("accurate"))


@query("short_query_guard", f"""
WITH src AS (SELECT conv_id, turn, text FROM conversations), {_language_sql('text')}
SELECT conv_id, turn, CASE WHEN len(regexp_extract_all(text, '\\S+')) < 4
 AND coalesce({_script_sql('text')}, '') NOT IN ('ja', 'ko', 'zh-cn') THEN 'en' ELSE detected END AS language FROM d""")
def short_query_guard(t: Tables) -> DataFrame:
    turns = spread_small(t.conversations.select("conv_id", "turn", "text"))
    return turns.select("conv_id", "turn", lang.short_query_guard(F.col("text")).alias("language"))


@query("language_name", f"""
SELECT doc_id, coalesce({map_sql(fv.LANGUAGE_NAMES, 'lang')}, upper(lang)) AS name,
 lang IN ({', '.join("'" + c + "'" for c in fv.LANGUAGE_NAMES)}) AS supported FROM documents""")
def language_name(t: Tables) -> DataFrame:
    return t.documents.select(
        "doc_id", lang.language_name(F.col("lang")).alias("name"), lang.is_supported(F.col("lang")).alias("supported")
    )


@query("title_from_first_message", """
SELECT conv_id, turn, CASE WHEN role = 'user' THEN substring(text, 1, 50) ELSE role END AS title FROM conversations""")
def title_from_first_message(t: Tables) -> DataFrame:
    title = F.when(F.col("role") == "user", F.lit("New Chat")).otherwise(F.col("role"))
    return t.conversations.select("conv_id", "turn", tx.title_from_first_message(title, F.col("text")).alias("title"))


@query("tokenize_words", f"""
WITH w AS (SELECT doc_id, {TOKENS_SQL.format('text')} AS words FROM documents)
SELECT doc_id, array_to_string(words, ' ') AS words, len(words)::INTEGER AS n FROM w""")
def tokenize_words(t: Tables) -> DataFrame:
    docs = spread_small(t.documents.select("doc_id", "text"))
    words = docs.select("doc_id", tx.tokenize_words(F.col("text")).alias("w"))
    return words.select("doc_id", F.array_join("w", " ").alias("words"), F.size("w").alias("n"))


@query("preview_text", "SELECT doc_id, substring(text, 1, 150) || '...' AS preview FROM documents")
def preview_text(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", tx.preview_text(F.col("text")).alias("preview"))


@query("extract_periods", """
WITH q AS (SELECT p_partkey, CASE p_type WHEN 'PROMO' THEN 'forecast ' || p_name || ' for the next ' || p_size || ' months'
 WHEN 'LARGE' THEN p_name || ' in ' || p_size || ' Quarters' ELSE 'what about ' || p_name || ' ' || p_size END AS question FROM part)
SELECT p_partkey, CASE WHEN regexp_matches(lower(question), '[0-9]+\\s*(month|week|quarter|year|period)')
 THEN least(36, greatest(1, CAST(regexp_extract(lower(question), '([0-9]+)\\s*(month|week|quarter|year|period)', 1) AS INTEGER)))
 ELSE 6 END AS periods FROM q""")
def extract_periods(t: Tables) -> DataFrame:
    size = F.col("p_size").cast("string")
    question = (
        F.when(F.col("p_type") == "PROMO", F.concat(F.lit("forecast "), "p_name", F.lit(" for the next "), size, F.lit(" months")))
        .when(F.col("p_type") == "LARGE", F.concat("p_name", F.lit(" in "), size, F.lit(" Quarters")))
        .otherwise(F.concat(F.lit("what about "), "p_name", F.lit(" "), size))
    )
    return t.part.select("p_partkey", logs.extract_periods(question).alias("periods"))


@query("pct_change_trend", """
SELECT c_custkey, round(pct, 4) AS pct_change, CASE WHEN pct > 2 THEN 'upward' WHEN pct < -2 THEN 'downward' ELSE 'stable' END AS trend
FROM (SELECT c_custkey, coalesce((c_acctbal * 1.5 - 2500.0::DOUBLE - c_acctbal) * 100 / nullif(c_acctbal, 0), 0) AS pct FROM customer)""")
def pct_change_trend(t: Tables) -> DataFrame:
    percent = logs.percent_change(F.col("c_acctbal"), F.col("c_acctbal") * 1.5 - 2500.0)
    return t.customer.select("c_custkey", F.round(percent, 4).alias("pct_change"), logs.trend_label(percent).alias("trend"))


@query("is_numeric_string", """
SELECT o_orderkey, try_cast(CASE o_orderstatus WHEN 'F' THEN CAST(o_custkey AS VARCHAR) ELSE o_orderpriority END AS DOUBLE) IS NOT NULL AS is_number FROM orders""")
def is_numeric_string(t: Tables) -> DataFrame:
    value = F.when(F.col("o_orderstatus") == "F", F.col("o_custkey").cast("string")).otherwise(F.col("o_orderpriority"))
    return t.orders.select("o_orderkey", tx.is_numeric_string(value).alias("is_number"))


@query("json_fields", """
SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
 '{"routing":"' || event_type || '","user":' || user_id || '}' AS metadata FROM events""")
def json_fields(t: Tables) -> DataFrame:
    return t.events.select(
        "event_id", tx.json_field(F.col("props"), "$.k").try_cast("int").alias("k"),
        F.to_json(F.struct(F.col("event_type").alias("routing"), F.col("user_id").alias("user"))).alias("metadata"),
    )


QUESTION_SQL = """(SELECT p_partkey AS question_id, p_size, CASE p_type
 WHEN 'ECONOMY' THEN 'How many ' || p_name || ' orders are there' WHEN 'STANDARD' THEN 'Plot a pie chart of ' || p_name || ' by customer'
 WHEN 'PROMO' THEN 'Why did ' || p_name || ' revenue drop? Compare with the report' WHEN 'MEDIUM' THEN 'Forecast ' || p_name || ' for the next 6 months'
 WHEN 'LARGE' THEN 'Summarize the paragraph on ' || p_name || ' distribution' ELSE 'Hello, tell me about ' || p_name END AS question FROM part)"""
# Fixed texts of the generated questions, by part type.
QUESTION_PARTS = {
    "ECONOMY": ("How many ", " orders are there"),
    "STANDARD": ("Plot a pie chart of ", " by customer"),
    "PROMO": ("Why did ", " revenue drop? Compare with the report"),
    "MEDIUM": ("Forecast ", " for the next 6 months"),
    "LARGE": ("Summarize the paragraph on ", " distribution"),
}


def questions_on_parts(t: Tables) -> DataFrame:
    """One question per part: (question_id, p_size, question)."""
    text = F.when(F.lit(False), F.lit(""))
    for kind, (before, after) in QUESTION_PARTS.items():
        text = text.when(F.col("p_type") == kind, F.concat(F.lit(before), "p_name", F.lit(after)))
    text = text.otherwise(F.concat(F.lit("Hello, tell me about "), "p_name"))
    return t.part.select(F.col("p_partkey").alias("question_id"), "p_size", text.alias("question"))


@query("entity_from_question", f"""
SELECT question_id, coalesce(CASE {' '.join(f"WHEN contains(lower(question), '{k}') THEN '{v}'" for k, v in fv.ENTITIES.items())} END,
 'p retailprice') AS entity FROM {QUESTION_SQL}""")
def entity_from_question(t: Tables) -> DataFrame:
    return questions_on_parts(t).select(
        "question_id", logs.entity_from_question(F.col("question"), F.lit("SUM(p_retailprice)")).alias("entity")
    )


@query("is_aggregation_question", f"""
SELECT question_id, regexp_matches(question, '(?i)\\b(how many|count of|number of|sum of|overall total)\\b') AS is_aggregation FROM {QUESTION_SQL}""")
def is_aggregation_question(t: Tables) -> DataFrame:
    return questions_on_parts(t).select("question_id", logs.is_aggregation_question(F.col("question")).alias("is_aggregation"))


@query("answer_style", f"""
SELECT question_id, CASE {' '.join(
    f"WHEN {sql_any('lower(question)', words)}" + (" AND p_size > 25" if style == "numeric" else "") + f" THEN '{style}'"
    for style, words in fv.ANSWER_STYLES)} ELSE 'concise' END AS style FROM {QUESTION_SQL}""")
def answer_style(t: Tables) -> DataFrame:
    return questions_on_parts(t).select(
        "question_id", logs.answer_style(F.col("question"), F.col("p_size") > 25).alias("style")
    )


@query("refusal_flag", f"""
SELECT conv_id, turn, {sql_any('lower(text)', fv.REFUSAL_PHRASES)} OR length(trim(text)) < 30 AS refused FROM conversations WHERE role = 'assistant'""")
def refusal_flag(t: Tables) -> DataFrame:
    answers = t.conversations.filter(F.col("role") == "assistant")
    return answers.select("conv_id", "turn", logs.refusal_flag(F.col("text")).alias("refused"))


@query("keyword_hit", """
SELECT conv_id, turn, contains(lower(text), 'nicht') OR contains(lower(text), 'que') AS hit FROM conversations""")
def keyword_hit(t: Tables) -> DataFrame:
    words = F.array(F.lit("nicht"), F.lit("que"))
    return t.conversations.select("conv_id", "turn", logs.keyword_hit(F.col("text"), words).alias("hit"))


@query("needs_chart", f"""
SELECT question_id, regexp_matches(lower(question), '\\b(?:{'|'.join(fv.PLOT_WORDS)})s?\\b') AS needs_chart FROM {QUESTION_SQL}""")
def needs_chart(t: Tables) -> DataFrame:
    return questions_on_parts(t).select("question_id", logs.needs_chart(F.col("question")).alias("needs_chart"))


@query("chart_type", f"""
SELECT question_id, CASE {' '.join(
    f"WHEN regexp_matches(lower(question), '\\b(?:{'|'.join(words)})s?\\b') THEN '{kind}'" for kind, words in fv.CHART_TYPES.items())}
 WHEN {sql_any('lower(question)', fv.SHARE_WORDS)} THEN 'pie' WHEN p_size > 25 THEN 'line' ELSE 'bar' END AS chart FROM {QUESTION_SQL}""")
def chart_type(t: Tables) -> DataFrame:
    x = F.when(F.col("p_size") > 25, F.lit("order_month")).otherwise(F.lit("p_brand"))
    return questions_on_parts(t).select("question_id", logs.chart_type(F.col("question"), x).alias("chart"))


@query("table_name_for", """
SELECT page_id, substring('upload_' || substring(md5(url), 1, 8) || '_' || lower(regexp_replace(
 regexp_replace(regexp_extract(url || '.csv', '([^/]*)$', 1), '(.)\\.[^.]*$', '\\1'), '[^a-zA-Z0-9_]', '_', 'g')), 1, 63) AS table_name FROM pages""")
def table_name_for(t: Tables) -> DataFrame:
    """Table names for files that are called like the last part of a page address."""
    return t.pages.select("page_id", tx.table_name_for(F.md5("url"), F.concat("url", F.lit(".csv"))).alias("table_name"))


@query("forecast_summary_text", """
SELECT c_custkey, 'Forecast for **balance** over the next 6 periods. Last actual value: **' || format('{:.2f}', c_acctbal) || '**.'
 || CASE WHEN c_nationkey > 5 THEN ' Next period forecast: **' || format('{:.2f}', c_acctbal * 2) || '**.' ELSE '' END
 || CASE WHEN c_nationkey > 0 THEN ' **' || c_nationkey || ' anomaly/anomalies** detected outside the 95% confidence interval.'
 ELSE ' No anomalies detected — data is within expected bounds.' END AS text FROM customer""")
def forecast_summary_text(t: Tables) -> DataFrame:
    next_one = F.when(F.col("c_nationkey") > 5, F.col("c_acctbal") * 2)
    return t.customer.select(
        "c_custkey",
        logs.forecast_summary_text(F.lit("balance"), F.lit(6), F.col("c_acctbal"), next_one, F.col("c_nationkey")).alias("text"),
    )
