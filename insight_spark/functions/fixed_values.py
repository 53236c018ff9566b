"""Word lists, patterns, thresholds that decide results.

They are data, not logic. Every list is kept in the order in which it is tried.
"""

# --- Fixed values: abbreviations and their expansion ------------------------
ABBREVIATIONS = {
    "avg": "average", "min": "minute", "max": "maximum",
    "std": "standard deviation", "var": "variance",
    "cnt": "count", "num": "number", "pct": "percent",
    "qty": "quantity", "amt": "amount", "rev": "revenue",
    "emp": "employee", "dept": "department", "mgr": "manager",
    "cust": "customer", "prod": "product", "trans": "transaction",
    "acct": "account", "addr": "address", "desc": "description",
    "yr": "year", "mo": "month", "wk": "week", "dy": "day",
    "hr": "hour", "sec": "second",
    "q1": "quarter 1", "q2": "quarter 2", "q3": "quarter 3", "q4": "quarter 4",
    "fy": "fiscal year", "ytd": "year to date", "mtd": "month to date",
}

# --- Fixed values: calendar -------------------------------------------------
MONTH_NAMES = [
    "January", "February", "March", "April", "May", "June", "July",
    "August", "September", "October", "November", "December",
]

# --- Fixed values: vocabulary stop words ------------------------------------
STOP_WORDS = [
    "the", "a", "an", "is", "in", "of", "to", "and", "or", "for", "with", "from", "at", "by",
    "on", "are", "was", "be", "this", "that", "it", "as", "we", "our", "has", "have", "had",
    "not", "but", "if", "so", "its", "can", "all", "any", "one", "two", "per", "will", "been",
    "more", "also", "than", "when", "what", "how", "which", "who", "they", "them", "their",
    "there", "here", "each", "both", "some", "into", "over", "after", "about", "up", "out",
    "do", "did", "were", "would", "could", "should", "may", "might", "shall", "row", "file",
    "column", "data", "value", "table", "page", "source", "type", "total", "number", "name",
    "date", "time",
]

# --- Fixed values: question words that carry intent, not content ------------
INTENT_WORDS = [
    "chart", "plot", "graph", "pie", "bar", "line", "show", "give", "display", "visualize",
    "grouped", "group", "number", "count", "total", "average", "sum", "list", "tell", "what",
    "how", "many", "much", "all", "get",
]

# --- Fixed values: language codes and names ---------------------------------
LANGUAGE_NAMES = {
    "en": "English", "es": "Spanish", "fr": "French", "de": "German",
    "it": "Italian", "pt": "Portuguese", "ru": "Russian", "zh-cn": "Chinese",
    "ja": "Japanese", "ko": "Korean", "ar": "Arabic", "hi": "Hindi",
    "bn": "Bengali", "ur": "Urdu", "pa": "Punjabi", "nl": "Dutch",
    "tr": "Turkish", "vi": "Vietnamese", "th": "Thai", "pl": "Polish",
}

# Script ranges in the order they are tested: code, character class, minimum share.
SCRIPTS = [
    ("ko", r"[\x{AC00}-\x{D7A3}\x{3130}-\x{318F}]", 0.15),
    ("ja", r"[\x{3040}-\x{30FF}\x{31F0}-\x{31FF}]", 0.15),
    ("ar", r"[\x{0600}-\x{06FF}]", 0.15),
    ("hi", r"[\x{0900}-\x{097F}]", 0.10),
    ("zh-cn", r"[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}]", 0.15),
]

# Portuguese markers that settle a Portuguese/Catalan doubt.
PORTUGUESE_MARKERS = ["ão", "ões", "ção", "ções", "qual", "são", "não", "é a", "é o"]

# --- Fixed values: routing --------------------------------------------------
GENERAL_PATTERNS = [
    r"^(hi|hello|hey|greetings|howdy)",
    r"^(how are you)\b",
    r"^hello.*how are you",
    r"^(what can you do|what do you do|what are your capabilities)",
    r"^(who are you|what are you|tell me about yourself)",
    r"^(thanks?|thank you|thx|cheers|bye|goodbye)",
    r"^(can you help|how does this work|how do i use this)",
]
GENERAL_TOPICS = [
    "machine learning", "artificial intelligence", "deep learning",
    "neural network", "what is nlp", "what is ai", "what is gpt",
    "what is llm", "what is rag", "what is python", "what is sql",
    "large language model",
]
GENERAL_STARTERS = [
    "explain what ", "explain how ", "what is a ", "what is an ",
    "how does ", "describe what ",
]
DATA_SIGNALS = [
    "total", "average", "count", "sum", "top", "max", "min",
    "revenue", "sales", "chart", "plot", "forecast", "trend",
    "data", "dataset", "csv", "column", "row", "table", "report",
]
HISTORICAL_SIGNALS = [
    "last year", "last quarter", "previous", "past year",
    "unaudited", "internal projection", "historical", "prior year", " ago",
]
FORECAST_WORDS = [
    "forecast", "predict", "next month", "next quarter", "next year",
    "next 3", "next 6", "next 12", "trend ahead", "upcoming periods",
    "anomaly", "anomalies", "outlier", "detect anomal", "time series",
    "projection",
]
CHART_WORDS = [
    "chart", "plot", "graph", "pie", "bar chart",
    "line chart", "histogram", "visualize", "visualization",
]
TABLE_COMPARISON_WORDS = ["compare", "why", "explain", "causes", "factors"]
CROSS_SOURCE_WORDS = [
    "compare", "match", "vs", "versus", "based on", "at risk",
    "most likely", "which employees", "who are", "actual", "real data",
    "from the data", "in the data", "cross", "combined", "together", "both",
]
HYBRID_WORDS = [
    "compare", "correlation", "relationship", "why", "causes",
    "factors", "difference between", "what led to", "how come",
]
DEFINITION_WORDS = ["explain what", "what does", "what is", "define", "meaning of"]
DATA_REQUEST_WORDS = ["show", "list", "top", "count", "calculate", "numbers", "data"]
PURE_METRIC_WORDS = [
    "maximum", "minimum", "average", "total", "sum", "count",
    "max value", "min value", "how many", "how much",
    "highest value", "lowest value",
]
TABLE_QUESTION_PATTERN = (
    r"\b(how many|top \d+|bottom \d+|count|sum of|total|average .{1,20} by|"
    r"group by|filter by|sort by|list all|show all|give me all)\b"
)
CHART_QUESTION_PATTERN = (
    r"\b(bar chart|pie chart|line chart|histogram|scatter|plot|graph|"
    r"visualize|visualization)\b"
)
AGGREGATION_PATTERN = r"\b(how many|count of|number of|sum of|overall total)\b"
TABLE_FILE_TYPES = ["csv", "xlsx", "xls"]

ROUTE_REASONS = {
    "SQL": "Calculation on uploaded CSV",
    "DOCUMENT": "Document/semantic query",
    "HYBRID": "Needs both calculation and context",
    "GENERAL": "Conversational or general knowledge query",
    "FORECAST": "Time series forecast",
}
TABLE_ROUTE_REASONS = {
    "SQL": "Requires precise calculations or aggregations from the CSV.",
    "RAG": "Requires semantic understanding or pattern interpretation.",
    "HYBRID": "Requires both precise calculations and contextual explanation.",
}

# --- Fixed values: answers, charts ------------------------------------------
NOT_AVAILABLE_PHRASES = [
    "not available in the uploaded",
    "information is not available",
    "no data found",
    "no results",
]
NOT_AVAILABLE_TABLE_ANSWER = "This information is not available in the uploaded data."
NOT_AVAILABLE_DOCUMENT_ANSWER = "This information is not available in the uploaded documents."
NOT_AVAILABLE_FILES_ANSWER = "This information is not available in the uploaded files."
NO_TABLE_ANSWER = "Please upload a CSV or Excel file to run data queries."

REFUSAL_PHRASES = [
    "not found", "not available", "don't have", "do not have", "cannot find",
    "no information", "not in", "unable to find", "not present", "no data",
    "not contain", "outside", "don't know", "i don't", "i cannot",
    "not uploaded", "not provided",
]
ENTITIES = {
    "repo": "repositories", "repository": "repositories",
    "customer": "customers", "employee": "employees",
    "department": "departments", "sale": "sales",
    "issue": "issues", "user": "users", "order": "orders",
    "product": "products", "transaction": "transactions",
    "patient": "patients", "visit": "visits", "record": "records",
    "file": "files", "document": "documents",
}
PLOT_WORDS = [
    "chart", "plot", "graph", "visualize", "show", "trend", "over time",
    "breakdown", "distribution", "compare", "comparison",
]
CHART_TYPES = {
    "bar": ["bar chart", "bar graph", "bar"],
    "line": ["line chart", "line graph", "line", "trend"],
    "pie": ["pie chart", "pie graph", "pie", "donut"],
}
SHARE_WORDS = ["distribution", "breakdown", "share", "proportion"]
TIME_AXIS_WORDS = ["month", "year", "quarter", "date", "time", "week", "day"]
ANSWER_STYLES = [
    ("direct", ["when is", "when does", "who is", "where is"]),
    ("numeric", ["how many", "count", "total", "average", "top"]),
    ("overview", ["overview", "summary", "summarize", "tell me about"]),
    ("causal", ["why", "how", "what caused"]),
    ("list", ["list", "what are", "show me"]),
]

# --- Fixed values: column names that reveal a role or a unit ----------------
DATE_NAME_PARTS = ["date", "time", "dt", "day", "month", "year"]
ID_NAME_ENDINGS = ["id", "code", "no", "num", "number", "key"]
CURRENCY_NAME_PARTS = [
    "cost", "salary", "revenue", "price", "income", "spend", "budget",
    "usd", "amount", "fee", "pay", "lpa",
]
PERCENT_NAME_PARTS = ["pct", "percent", "rate", "ratio"]
SCHEMA_DATE_WORDS = [
    "date", "time", "month", "year", "week", "day", "created", "updated",
    "period", "timestamp", "dt",
]
SCHEMA_ID_WORDS = [
    "id", "key", "code", "uuid", "ref", "index", "no", "num", "number", "serial",
]
SERIES_DATE_HINTS = ["date", "month", "week", "year", "time", "day", "period", "quarter"]
SERIES_VALUE_HINTS = ["total", "revenue", "sales", "amount", "price", "quantity", "value"]

# --- Fixed values: limits ---------------------------------------------------
PREVIEW_ROWS, DATA_ROWS = 10, 100
MAX_GROUPS, MIN_GROUP_ROWS = 20, 2
GROUP_LINES, GROUP_DETAILS, GROUP_MEANS = 15, 5, 6
OVERVIEW_CATEGORIES, OVERVIEW_VALUES, OVERVIEW_NUMBERS = 4, 8, 6
PROSE_CHUNK, PROSE_OVERLAP = 1000, 200
TABLE_CHUNK, TABLE_OVERLAP = 10000, 50
CANDIDATES, RERANKED = 10, 3
LEXICAL_WEIGHT, VECTOR_WEIGHT, FUSION_CONSTANT = 0.5, 0.5, 60
GUARD_THRESHOLD, GUARD_STEP, GUARD_MAX = -10.0, 0.5, 2.0
EXPANSION_TRIGGER = -8.0
DEDUPE_PREFIX, PREVIEW_CHARS = 100, 150
VALUE_CUTOFF, COLUMN_CUTOFF = 0.75, 0.7
SHOWN_VALUES = 20
CHART_POINTS, CHART_MIN_ROWS = 50, 2
# A number in plain decimal notation.
NUMBER = r"^\s*[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\s*$"
DEFAULT_PERIODS, MAX_PERIODS, MIN_SERIES_ROWS = 6, 36, 3
TREND_PERCENT = 2.0
LISTED_CONVERSATIONS, LISTED_MESSAGES, CACHED_MESSAGES = 20, 50, 100
TITLE_CHARS = 50
TABLE_NAME_CHARS, TABLE_ID_CHARS = 63, 8
TABLE_PREFIX = "upload_"
BM25_K1, BM25_B = 1.5, 0.75

# --- Fixed values: patterns over logged SQL and names ------------------------
SQL_FENCE = r"(?i)```(?:sql)?\s*"
SQL_LINE_COMMENT = r"(?m)--.*$"
SQL_BLOCK_COMMENT = r"(?s)/\*.*?\*/"
SQL_SEMICOLONS = r";+$"
SQL_BARE_AGGREGATE = r'(?i)\b(MAX|MIN|AVG|SUM|COUNT|TOTAL)\s+(?!\()([a-zA-Z_][a-zA-Z0-9_."]*)'
SQL_TABLE = r'(?i)\b(?:FROM|JOIN|UPDATE|INTO)\s+[`"\[]?(\w+)[`"\]]?'
CAMEL_CASE = r"([a-z])([A-Z])"
RECORD_ENDING = r"(?:[Ii][Dd]|[Cc]ode|[Nn]o|[Nn]um(?:ber)?)$"
PERIODS_ASKED = r"([0-9]+)\s*(?:month|week|quarter|year|period)"

# --- Fixed values: grades by lowest score -------------------------------------
GRADES = [(90, "A+ Excellent"), (80, "A Good"), (70, "B Fair")]
LOWEST_GRADE = "C Needs Improvement"
