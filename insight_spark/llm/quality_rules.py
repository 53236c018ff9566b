"""Quality rules: a threshold table compiled into one Spark projection.

Every measure is a built-in expression over the row's own text, so a document
never leaves its row: there is no shuffle and no Python.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame

# Common function words of English, French, German and Spanish.
STOP_WORDS = [
    "the", "of", "and", "to", "in", "is", "that", "it", "for", "was", "with", "on", "as", "are", "be", "this", "a",
    "de", "la", "le", "et", "les", "des", "un", "une", "que", "du", "qui", "dans", "pour", "est", "au",
    "der", "die", "und", "das", "ist", "ein", "zu", "nicht", "den", "mit", "von", "sich", "dem", "auf", "eine",
    "el", "los", "en", "y", "del", "las", "por", "con", "no", "su", "se", "al",
]
# Spark's SQL has no escape for the form feed: it would read \f as the letter f.
BLANKS = r"' \t\n\u000B\u000C\r'"


class Rule(NamedTuple):
    """``low <= 100 * top / bottom <= high``; a limit that is None does not bind.

    ``top`` and ``bottom`` are SQL expressions over ``MEASURES``.
    """

    name: str
    top: str
    bottom: str
    low: int | None
    high: int | None


MEASURES = [
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_lines",
]
RULES = [
    Rule("short_words", "word_chars", "n_words", 150, None),
    Rule("long_words", "word_chars", "n_words", None, 2000),
    Rule("symbols", "n_symbols", "n_words", None, 15),
    # One stop word is granted, so that a short text without any is not rejected for that alone.
    Rule("stop_words", "(n_stop_words + 1)", "n_words", 2, None),
    Rule("repeated_lines", "n_dup_lines", "n_lines", None, 30),
]


def condition(rule: Rule) -> str:
    """The rule as SQL over integer columns; it holds where the denominator is zero."""
    parts = [f"{rule.bottom} = 0"] if rule.low is not None or rule.high is not None else ["true"]
    bounds = []
    if rule.low is not None:
        bounds.append(f"100 * {rule.top} >= {rule.low} * {rule.bottom}")
    if rule.high is not None:
        bounds.append(f"100 * {rule.top} <= {rule.high} * {rule.bottom}")
    return "(" + " OR ".join([*parts, " AND ".join(bounds)] if bounds else parts) + ")"


def base_condition(min_words: int = 10, max_repeat_percent: int = 20) -> str:
    return f"(n_words < {min_words} OR 100 * n_repeat_words > {max_repeat_percent} * n_words)"


def measure(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 5) -> DataFrame:
    """``id_col`` and the measures of ``MEASURES`` (long) of each row's whole text.

    A ``let`` in the form of a one-element transform keeps a value that a later
    lambda looks into from being computed again for each element.
    """
    shifts = ", ".join(f"h[i + {k}]" for k in range(window))
    stop = ", ".join(f"'{form}'" for word in dict.fromkeys(STOP_WORDS) for form in (word, word.capitalize()))
    split = (
        df.selectExpr(f"`{id_col}` AS _id", f"coalesce(cast(`{text_col}` AS string), '') AS _text")
        .selectExpr("_id", "_text", rf"split(trim(BOTH {BLANKS} FROM _text), '[\\x20\\x09-\\x0D]+') AS _split")
        .selectExpr("_id", "_text", "filter(_split, w -> w <> '') AS _words")
    )
    counted = split.selectExpr(
        "_id", "_words", "cast(size(_words) AS bigint) AS n_words",
        "cast(aggregate(_words, 0, (n, w) -> n + length(w)) AS bigint) AS word_chars",
        "cast(regexp_count(_text, '[#*$%&|<>]') AS bigint) AS n_symbols",
        f"cast(size(filter(_words, w -> w IN ({stop}))) AS bigint) AS n_stop_words",
        rf"filter(split(_text, '\n'), l -> trim(BOTH {BLANKS} FROM l) <> '') AS _lines",
        f"""transform(array(transform(_words, w -> xxhash64(w))), h ->
            IF(size(h) < {window}, array(),
               transform(sequence(0, size(h) - {window}), i -> xxhash64({shifts}))))[0] AS _windows""",
    )
    repeated = f"""
        aggregate(
          transform(array(array_sort(transform(
            transform(array(array_sort(transform(_windows, (x, i) -> named_struct('x', x, 'i', i)))), s ->
              filter(s, (e, k) -> (k > 0 AND s[k - 1].x = e.x) OR (k + 1 < size(s) AND s[k + 1].x = e.x)))[0],
            e -> e.i))), p ->
            zip_with(p, slice(p, 2, size(p)), (a, b) -> coalesce(least({window}, b - a), {window})))[0],
          0, (n, step) -> n + step)"""
    return counted.selectExpr(
        f"_id AS `{id_col}`", "n_words", "word_chars", "n_symbols", "n_stop_words",
        "cast(size(_lines) AS bigint) AS n_lines",
        "cast(size(_lines) - size(array_distinct(_lines)) AS bigint) AS n_dup_lines",
        f"cast(IF(size(array_distinct(_windows)) = size(_windows), 0, {repeated}) AS bigint) AS n_repeat_words",
    )


def judge(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: list[Rule] = RULES) -> DataFrame:
    """Per row: id, measures, base_failed, ``failed`` (names of the broken rules) and kept.

    A null text counts as empty; it has no word and fails. Rows are judged one
    by one: repeated rows and null ids stay, an empty table gives no rows, and
    columns besides the two named ones are not read. A ratio whose denominator
    is zero breaks no rule.
    """
    named = ", ".join(f"IF({condition(rule)}, NULL, '{rule.name}')" for rule in rules)
    measured = measure(df, id_col, text_col)
    return measured.selectExpr(
        "*", f"{base_condition()} AS base_failed",
        f"array_compact(array({named}))" + " AS failed" if rules else "cast(array() AS array<string>) AS failed",
    ).selectExpr("*", "NOT base_failed AND size(failed) = 0 AS kept")


def oracle(rules: list[Rule] = RULES) -> str:
    """The query op9 in DuckDB."""
    stop = ", ".join(f"'{form}'" for word in dict.fromkeys(STOP_WORDS) for form in (word, word.capitalize()))
    holds = " AND ".join(condition(rule) for rule in rules) or "true"
    word = r"[^\x20\x09-\x0D]"
    return f"""
    WITH d AS (
      SELECT doc_id, coalesce(text, '') AS t FROM documents
    ), w AS (
      SELECT doc_id, t, regexp_extract_all(t, '{word}+') AS ws,
             list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '{word}')) AS ls FROM d
    ), placed AS (
      SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS win
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)
    ), rep AS (
      SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM placed) WHERE n > 1
    ), cov AS (
      SELECT doc_id, sum(least(5, coalesce(nxt - i, 5))) AS n_repeat_words
      FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM rep) GROUP BY doc_id
    ), m AS (
      SELECT w.doc_id, len(ws)::BIGINT AS n_words,
             length(array_to_string(ws, ''))::BIGINT AS word_chars,
             len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
             (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
             coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
             len(list_filter(ws, lambda x: x IN ({stop})))::BIGINT AS n_stop_words, len(ls)::BIGINT AS n_lines
      FROM w LEFT JOIN cov USING (doc_id)
    )
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
           {base_condition()} AS base_failed, NOT {base_condition()} AND {holds} AS kept
    FROM m
    """
