"""Column functions on names, values and words. All of them stay in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from insight_spark.functions import fixed_values as fv


def literal_map(entries: dict) -> Column:
    """A constant map column; Catalyst folds it into one literal."""
    return F.create_map(*[F.lit(part) for pair in entries.items() for part in pair])


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once per row, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def contains_any(text: Column, words: list[str]) -> Column:
    """True when any of the given literal substrings occurs.

    One alternation scans the text once; a chain of ``contains`` would read (and
    lower-case) it once per word.
    """
    return text.rlike("|".join(re.escape(word) for word in words))


def contains_word(text: Column, words: list[str]) -> Column:
    """Like :func:`contains_any`, but only on whole words (a plural s is allowed)."""
    return text.rlike(r"\b(?:" + "|".join(words) + r")s?\b")


def starts_with_any(text: Column, words: list[str]) -> Column:
    return text.rlike("^(?:" + "|".join(re.escape(word) for word in words) + ")")


def normalize_token(value: Column) -> Column:
    """Canonical spelling: lower case, separators to spaces, no punctuation."""
    spaced = F.regexp_replace(F.lower(value), r"[_\-/\\|]", " ")
    plain = F.regexp_replace(spaced, r"[^\p{L}\p{N}_\s]", "")
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


def expand_abbreviations(token: Column) -> Column:
    """Replace every known abbreviation in a normalised value, word by word."""
    lookup = literal_map(fv.ABBREVIATIONS)
    words = F.split(token, " ")
    return F.array_join(
        F.transform(words, lambda word: F.coalesce(F.try_element_at(lookup, word), word)), " "
    )


_MONTH_BY_WORD = {name[:3].lower(): i + 1 for i, name in enumerate(fv.MONTH_NAMES)} | {
    name.lower(): i + 1 for i, name in enumerate(fv.MONTH_NAMES)
}
_MONTH_WORDS = "|".join(sorted(_MONTH_BY_WORD, key=len, reverse=True))


def parse_month(value: Column) -> Column:
    """Full month name of 'Jan', 'january', '1', '01', '2024-01', '01/2024',
    'Jan 2024' or 'January 2024'; null for anything else."""
    v = F.lower(F.trim(value))
    number = F.coalesce(
        F.nullif(F.regexp_extract(v, r"^(0?[1-9]|1[0-2])$", 1), F.lit("")),
        F.nullif(F.regexp_extract(v, r"^[0-9]{4}-(0?[1-9]|1[0-2])$", 1), F.lit("")),
        F.nullif(F.regexp_extract(v, r"^(0?[1-9]|1[0-2])/[0-9]{4}$", 1), F.lit("")),
    ).try_cast("int")
    word = F.regexp_extract(v, rf"^({_MONTH_WORDS})(?:\s+[0-9]{{4}})?$", 1)
    month = F.coalesce(number, F.try_element_at(literal_map(_MONTH_BY_WORD), word))
    names = F.array(*[F.lit(name) for name in fv.MONTH_NAMES])
    return F.try_element_at(names, month)


def month_number(value: Column) -> Column:
    """1..12 for a month word or number, else null."""
    numbers = {str(i): i for i in range(1, 13)} | {f"{i:02d}": i for i in range(1, 13)}
    return F.try_element_at(literal_map(_MONTH_BY_WORD | numbers), F.lower(F.trim(value)))


def humanize_column(name: Column) -> Column:
    """'TreatmentCost_USD' to 'Treatment Cost USD'."""
    split = F.regexp_replace(name, fv.CAMEL_CASE, "$1 $2")
    return F.trim(F.replace(split, F.lit("_"), F.lit(" ")))


def record_type(name: Column) -> Column:
    """What one row is about, read from its subject column: 'PatientID' to 'Patient'."""
    stem = F.trim(F.regexp_replace(name, fv.RECORD_ENDING, ""))
    return F.when(stem == "", F.lit("Record")).otherwise(stem)


def _pattern(value: Column, pattern: str) -> Column:
    return F.call_function("format_number", value, F.lit(pattern))


def format_value(column_name: str, value: Column, role: str) -> Column:
    """A cell as text, with unit hints taken from the column name.

    ``format_number`` rounds half-even on the exact binary value.
    """
    name = column_name.lower()
    if role != "numeric":
        return F.coalesce(value.cast("string"), F.lit("N/A"))
    number = value.try_cast("double")
    if "lpa" in name:
        shown = F.concat(_pattern(number, "#,##0.0"), F.lit(" LPA"))
    elif any(part in name for part in fv.CURRENCY_NAME_PARTS):
        shown = F.concat(
            F.lit("$"),
            F.when(number >= 100, _pattern(number, "#,##0")).otherwise(_pattern(number, "0.00")),
        )
    elif any(part in name for part in fv.PERCENT_NAME_PARTS):
        shown = F.concat(_pattern(number, "0.0"), F.lit("%"))
    else:
        shown = F.when(
            number == F.rint(number), number.cast("decimal(38,0)").cast("string")
        ).otherwise(_pattern(number, "0.00"))
    return (
        F.when(value.isNull(), F.lit("N/A"))
        .when(number.isNull(), value.cast("string"))
        .otherwise(shown)
    )


def table_name_for(conversation_id: Column, file_name: Column) -> Column:
    """Name of the table an uploaded file becomes."""
    stem = F.regexp_replace(F.regexp_extract(file_name, r"([^/]*)$", 1), r"(.)\.[^.]*$", "$1")
    clean = F.lower(F.regexp_replace(stem, r"[^a-zA-Z0-9_]", "_"))
    full = F.concat(
        F.lit(fv.TABLE_PREFIX),
        F.substring(conversation_id, 1, fv.TABLE_ID_CHARS),
        F.lit("_"),
        clean,
    )
    return F.substring(full, 1, fv.TABLE_NAME_CHARS)


def words_of(text: Column) -> Column:
    """Lower-case words of at least three ASCII letters, in order, with repeats.

    A word counts only when it is not glued to other letters, digits or
    underscores of any alphabet.
    """
    return F.regexp_extract_all(
        F.lower(text), F.lit(r"(?<![\p{L}\p{N}_])([a-z]{3,})(?![\p{L}\p{N}_])"), F.lit(1)
    )


def tokenize_words(text: Column) -> Column:
    """:func:`words_of` without the vocabulary stop words; repeats are kept."""
    return F.filter(words_of(text), lambda word: ~word.isin(*fv.STOP_WORDS))


def name_tokens(name: Column) -> Column:
    """Letter runs of at least three in a column name."""
    return F.regexp_extract_all(F.lower(name), F.lit("([a-z]{3,})"), F.lit(1))


def preview_text(text: Column) -> Column:
    return F.concat(F.substring(text, 1, fv.PREVIEW_CHARS), F.lit("..."))


def title_from_first_message(title: Column, content: Column) -> Column:
    return F.when(title == "New Chat", F.substring(content, 1, fv.TITLE_CHARS)).otherwise(title)


def is_numeric_string(value: Column) -> Column:
    """True when the text reads as a number; null counts as not numeric."""
    return F.coalesce(F.trim(value).rlike(fv.NUMBER), F.lit(False))


def json_field(json: Column, path: str) -> Column:
    return F.get_json_object(json, path)


def file_extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)
