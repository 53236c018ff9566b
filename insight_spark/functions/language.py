"""Language detection as Column expressions."""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from insight_spark.functions import fixed_values as fv
from insight_spark.functions.text import contains_any, let, literal_map
from insight_spark.operators.scale import top_n_per_group

# Frequent short words per language (own selection), tried in this order; a tie
# goes to the earlier language.
COMMON_WORDS = {
    "en": "the of and to in is that it for was on are with as be at by this what how who "
          "which where when many much not from or have show me all total list",
    "es": "el los las que y del se por con una para es su al lo como más pero sus le ya "
          "cuál cuántos cuántas cuánto qué quién dónde aquí cuáles muestra",
    "fr": "le les des et est un une du dans qui que pour sur pas avec au ce par il sont "
          "quel quelle combien où ici aux plus cette",
    "de": "der die das und ist nicht ein eine den dem zu mit von auf für im sich des auch "
          "wie viele was war wo hier werden wird",
    "pt": "o os as um uma não em do da dos das no na com que é ao mais foi qual quantos "
          "quantas aqui são seu sua",
    "it": "il gli che di è per un una non sono con del della nel quanti quale quanto dove "
          "qui come più",
    "nl": "het een van en is dat op te zijn met voor niet aan er om hoeveel wat hier waar "
          "deze",
    "ca": "els les amb per què és una dels més aquest aquesta quants quin on",
    "pl": "i w nie na się z do jest to że ile jak gdzie co tutaj",
    "tr": "ve bir bu için ile ne kaç burada nerede olan çok",
    "vi": "và của là có không bao nhiêu ở đây những được",
}
# Letters that hardly occur outside one language.
MARKER_LETTERS = {
    "es": "ñ¿¡", "de": "äöüß", "pt": "ãõ", "fr": "êèœûç", "pl": "łąęśżź",
    "tr": "ğşı", "vi": "ăđơư",
}
# Alphabets that point to one language, after the script rules.
ALPHABETS = {
    "ru": r"[\x{0400}-\x{04FF}]",
    "th": r"[\x{0E00}-\x{0E7F}]",
    "bn": r"[\x{0980}-\x{09FF}]",
    "pa": r"[\x{0A00}-\x{0A7F}]",
}
ALPHABET_SHARE = 0.15


def _share(text: Column, character_class: str) -> Column:
    visible = F.greatest(F.length(F.replace(text, F.lit(" "), F.lit(""))), F.lit(1))
    return F.regexp_count(text, F.lit(character_class)) / visible


def script_language(text: Column) -> Column:
    """Language decided by the share of its script, else null."""
    found = reduce(
        lambda chain, rule: chain.when(_share(text, rule[1]) > rule[2], F.lit(rule[0])),
        fv.SCRIPTS[1:],
        F.when(_share(text, fv.SCRIPTS[0][1]) > fv.SCRIPTS[0][2], F.lit(fv.SCRIPTS[0][0])),
    )
    return F.when(_occurs(text, [rule[1] for rule in fv.SCRIPTS]), found)


def _occurs(text: Column, character_classes: list[str]) -> Column:
    """True when a character of any of the classes occurs.

    Nearly all texts have none: a pass over one range, from the first character of the classes on, tells most of them.
    """
    inside = "".join(characters.strip("[]") for characters in character_classes)
    least = min(re.findall(r"\\x\{([0-9A-F]+)\}", inside), key=lambda point: int(point, 16))
    return text.rlike(rf"[\x{{{least}}}-\x{{10FFFF}}]") & text.rlike(f"[{inside}]")


def word_profile_language(text: Column) -> Column:
    """Language with the most frequent-word and marker-letter hits; null without any."""
    codes = list(COMMON_WORDS)
    listed = {code: words.split() for code, words in COMMON_WORDS.items()}
    known = sorted({word for words in listed.values() for word in words})

    def marked(code: str, letters: Column) -> Column:
        if code not in MARKER_LETTERS:
            return F.lit(0)
        return F.when(letters.rlike(f"[{MARKER_LETTERS[code]}]"), 2).otherwise(0)

    def scores(lower: Column) -> Column:
        words = F.filter(F.regexp_extract_all(lower, F.lit(r"(\p{L}+)"), F.lit(1)), lambda word: word.isin(*known))
        return let(
            # All marker letters lie beyond ASCII, so they are looked for in the few letters that do.
            F.struct(words.alias("words"), F.regexp_replace(lower, r"[\x00-\x7F]++", "").alias("letters")),
            lambda found: F.array(
                *[F.size(F.filter(found["words"], _listed_in(listed[code]))) + marked(code, found["letters"]) for code in codes]
            ),
        )

    names = F.array(*[F.lit(code) for code in codes])
    return let(
        let(F.lower(text), scores),
        lambda s: F.when(
            F.array_max(s) > 0, F.element_at(names, F.array_position(s, F.array_max(s)).cast("int"))
        ),
    )


def _listed_in(words: list[str]):
    return lambda word: word.isin(*words)


def alphabet_language(text: Column) -> Column:
    codes = list(ALPHABETS)
    found = reduce(
        lambda chain, code: chain.when(_share(text, ALPHABETS[code]) > ALPHABET_SHARE, F.lit(code)),
        codes[1:],
        F.when(_share(text, ALPHABETS[codes[0]]) > ALPHABET_SHARE, F.lit(codes[0])),
    )
    return F.when(_occurs(text, list(ALPHABETS.values())), found)


def detect_language(text: Column) -> Column:
    """Script first, then other alphabets, then word profiles; default 'en'."""
    portuguese = contains_any(F.lower(text), fv.PORTUGUESE_MARKERS)
    settled = let(
        word_profile_language(text),
        lambda latin: F.when((latin == "ca") & portuguese, F.lit("pt")).otherwise(latin),
    )
    return F.coalesce(script_language(text), alphabet_language(text), settled, F.lit("en"))


def is_cjk_text(text: Column) -> Column:
    return F.coalesce(script_language(text).isin("ja", "ko", "zh-cn"), F.lit(False))


def short_query_guard(text: Column) -> Column:
    """Language of a question; fewer than four words and no CJK script mean 'en'."""
    words = F.size(F.filter(F.split(F.trim(text), r"\s+"), lambda word: word != ""))
    return F.when((words < 4) & ~is_cjk_text(text), F.lit("en")).otherwise(detect_language(text))


def language_name(code: Column) -> Column:
    return F.coalesce(F.try_element_at(literal_map(fv.LANGUAGE_NAMES), code), F.upper(code))


def is_supported(code: Column) -> Column:
    return code.isin(*fv.LANGUAGE_NAMES)


# --- Profiles learned from texts ---------------------------------------------

# Ranks of a profile and the letters of its longest entries.
PROFILE_SIZE, PROFILE_LETTERS = 300, 3
# Texts, and characters of them, that are compared with the profiles at once.
PROFILE_TEXTS, PROFILE_CHARACTERS = 256, 1 << 20


def _padded_words(text: Column) -> Column:
    """The words of a text in lower case with a blank on either side of each."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(\p{L}+)"), F.lit(1))
    return F.concat(F.lit(" "), F.array_join(words, "  "), F.lit(" "))


def learn_profiles(
    texts: DataFrame, text: str = "text", language: str = "lang", size: int = PROFILE_SIZE, letters: int = PROFILE_LETTERS
) -> dict[str, list[str]]:
    """The ``size`` most frequent letter sequences of each language, in order.

    Distinct words are counted before they are cut, so the work after that grows with the
    vocabulary. What comes to the driver is ``size`` sequences per language.
    """
    words = texts.select(
        F.col(language).alias("lang"), F.explode(F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"(\p{L}+)"), F.lit(1))).alias("word")
    ).dropna()
    counted = words.groupBy("lang", "word").agg(F.count("*").alias("n"))
    padded = F.concat(F.lit(" "), F.col("word"), F.lit(" "))

    def pieces(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(padded) - (n - 1)))
        return F.transform(starts, lambda i: F.substring(padded, i, F.lit(n)))

    cut = F.flatten(F.array(*[pieces(n) for n in range(1, letters + 1)]))
    grams = (
        counted.select("lang", "n", F.explode(cut).alias("gram")).filter(F.trim("gram") != "")
        .groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    )
    ranked = top_n_per_group(grams, ["lang"], [F.desc("n"), F.col("gram")], size)
    found: dict[str, list[str]] = {}
    for row in ranked.orderBy("lang", "rank").collect():
        found.setdefault(row["lang"], []).append(row["gram"])
    return found


def profile_distances(text: Column, profiles: dict[str, list[str]]) -> Column:
    """Out-of-place distance of the text's own profile to each language's, in the order of the languages' names.

    The text's sequences are ranked by how often they occur. One that a language does not list
    is as far out of place as its profile is long. Null for a text without any of them.

    All sequences are looked for at once, in one pass over the texts for each of their lengths.
    """
    codes = sorted(profiles)
    grams = sorted({gram for listed in profiles.values() for gram in listed})
    size = max(map(len, profiles.values()))
    place = {code: {gram: i for i, gram in enumerate(profiles[code])} for code in codes}
    places = np.array([[place[code].get(gram, -1) for gram in grams] for code in codes], np.int32).reshape(len(codes), len(grams))
    tree = _gram_tree(grams)

    @F.pandas_udf("array<int>")
    def distances(texts: pd.Series) -> pd.Series:
        found: list = []
        held, letters = [], 0
        for i, one in enumerate(texts, start=1):
            held.append(one)
            letters += len(one)
            if letters >= PROFILE_CHARACTERS or len(held) == PROFILE_TEXTS or i == len(texts):
                found += _out_of_place(_gram_counts(held, grams, tree), places, size)
                held, letters = [], 0
        return pd.Series(found, dtype=object)

    return distances(_padded_words(text))


def _gram_tree(grams: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(letter of a code point, next node of node and letter, sequence that ends in a node or -1); 0 leads nowhere, 1 is the root."""
    alphabet = {c: i + 1 for i, c in enumerate(sorted(set("".join(grams))))}
    letters = np.zeros(0x110000, np.int32)
    letters[[ord(c) for c in alphabet]] = list(alphabet.values())
    prefixes = sorted({gram[:n] for gram in grams for n in range(1, len(gram) + 1)})
    node = {"": 1} | {prefix: i + 2 for i, prefix in enumerate(prefixes)}
    after, ends = np.zeros((len(node) + 1, len(alphabet) + 1), np.int32), np.full(len(node) + 1, -1, np.int32)
    for prefix in prefixes:
        after[node[prefix[:-1]], alphabet[prefix[-1]]] = node[prefix]
    for i, gram in enumerate(grams):
        ends[node[gram]] = i
    return letters, after, ends


def _gram_counts(texts: list[str], grams: list[str], tree: tuple) -> np.ndarray:
    """(texts x sequences): how often each sequence occurs in each text, without overlap."""
    letters, after, ends = tree
    sizes = np.array([len(text) + 1 for text in texts])
    points = np.frombuffer("".join(text + "\0" for text in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    row = np.repeat(np.arange(len(texts)), sizes)
    letter = letters[points]
    counts = np.zeros(len(texts) * len(grams), np.int64)
    at, node = np.arange(len(letter)), np.ones(len(letter), np.int32)
    for n in range(1, max(map(len, grams), default=0) + 1):
        alive = at + n <= len(letter)
        at, node = at[alive], after[node[alive], letter[at[alive] + n - 1]]
        at, node = at[node > 0], node[node > 0]
        found = ends[node]
        hit = found >= 0
        where, gram = _apart(at[hit], found[hit], n, grams)
        counts += np.bincount(row[where] * len(grams) + gram, minlength=len(counts))
    return counts.reshape(len(texts), len(grams))


def _apart(at: np.ndarray, gram: np.ndarray, n: int, grams: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Occurrences of sequences of ``n`` letters without those that overlap the one before that counts."""
    overlaps = np.array([any(g[i:] == g[:-i] for i in range(1, len(g))) for g in grams], bool)
    some = np.flatnonzero(overlaps[gram])
    some = some[np.lexsort((at[some], gram[some]))]
    place = at[some]
    hidden: set[int] = set()
    for i in (np.flatnonzero((np.diff(place) < n) & (np.diff(gram[some]) == 0)) + 1).tolist():
        before = i - 1
        while before in hidden:
            before -= 1
        if place[i] - place[before] < n:
            hidden.add(i)
    keep = np.ones(len(at), bool)
    keep[some[list(hidden)]] = False
    return at[keep], gram[keep]


def _out_of_place(counts: np.ndarray, places: np.ndarray, size: int) -> list:
    """Per text the distance to every profile, or None where nothing occurs."""
    order = np.argsort(-counts, axis=1, kind="stable")[:, :size]
    present = np.take_along_axis(counts, order, 1) > 0
    rank = np.arange(order.shape[1])
    found = np.stack(
        [np.where(present, np.where(p[order] < 0, size, np.abs(p[order] - rank)), 0).sum(axis=1) for p in places], axis=1
    )
    return [row if some else None for row, some in zip(found.tolist(), present.any(axis=1))]


def profile_language(text: Column, profiles: dict[str, list[str]]) -> Column:
    """The language of the least distance, ties to the first by name; null without a letter sequence of any."""
    names = F.array(*[F.lit(code) for code in sorted(profiles)])
    return let(
        profile_distances(text, profiles),
        lambda d: F.when(d.isNotNull(), F.get(names, F.array_position(d, F.array_min(d)).cast("int") - 1)),
    )


def detect_by_profiles(text: Column, profiles: dict[str, list[str]]) -> Column:
    """:func:`detect_language` with learned profiles in place of the word lists."""
    return F.coalesce(script_language(text), alphabet_language(text), profile_language(text, profiles), F.lit("en"))
