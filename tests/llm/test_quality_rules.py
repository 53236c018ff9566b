import random
import re

import pytest

from insight_spark.llm import quality_rules as rules


def measures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    windows = {}
    for i in range(len(words) - 4):
        windows.setdefault(tuple(words[i : i + 5]), []).append(i)
    covered = {j for places in windows.values() if len(places) > 1 for i in places for j in range(i, i + 5)}
    stop = {form for word in rules.STOP_WORDS for form in (word, word.capitalize())}
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered),
        "n_stop_words": sum(w in stop for w in words), "n_lines": len(lines),
    }


TEXTS = [
    None, "", " \n\t ", "a b c d e", "a b c d e a b c d e", "a a a a a a a a a", "the $ | x\nthe $ | x\n\n the $ | x",
    "é ü 中文   nbsp em", "x\x0by\x0cz\rq", "\n".join(["line one"] * 5), "the of and to " * 30,
]


def texts():
    rng = random.Random(4)
    more = [
        "".join(rng.choice(["a", "b", "the", " ", " ", "\n", "#", "é", "  ", "\t", "|"]) for _ in range(rng.randint(0, 120)))
        for _ in range(300)
    ]
    return [*TEXTS, *more, " ".join(rng.choice("ab") for _ in range(6000))]


def test_measures_and_verdict(spark):
    rows = [(i, t, -1, [1]) for i, t in enumerate(texts())] + [(None, "the end", 0, [2]), (0, None, 0, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, n_words int, h array<int>")
    got = rules.judge(frame).collect()
    assert len(got) == len(rows)
    by_id = dict(enumerate(texts()))
    for row in got:
        want = measures("the end" if row["doc_id"] is None else by_id[row["doc_id"]])
        assert {k: row[k] for k in want} == want
        base = want["n_words"] < 10 or 100 * want["n_repeat_words"] > 20 * want["n_words"]
        broken = []
        for rule in rules.RULES:
            top, bottom = eval(rule.top, {}, want), eval(rule.bottom, {}, want)
            if bottom and not (
                (rule.low is None or 100 * top >= rule.low * bottom) and (rule.high is None or 100 * top <= rule.high * bottom)
            ):
                broken.append(rule.name)
        assert row["base_failed"] == base and row["failed"] == broken and row["kept"] == (not base and not broken)
    assert rules.judge(frame.limit(0)).count() == 0


def test_letter_f_is_a_word_and_the_form_feed_is_blank(spark):
    given = [
        "for a roof", "f", "fff", "f f", "if f\nf\nf\nof", "f\nf", "\x0c", "\x0cfor a roof\x0c", "\x0c\n\x0c", "f\x0cf",
        "a\n\x0c\nb\n\x0c\nff\nff", "\x0c f \x0c", "five of half a loaf if " * 3 + "f",
    ]
    frame = spark.createDataFrame(list(enumerate(given)), "doc_id long, text string")
    got = {r["doc_id"]: r.asDict() for r in rules.judge(frame).collect()}
    for i, text in enumerate(given):
        want = measures(text)
        assert {k: got[i][k] for k in want} == want, repr(text)


def test_no_rules_leave_the_base(spark):
    frame = spark.createDataFrame([(1, "one two three four five six seven eight nine ten")], "doc_id long, text string")
    assert rules.judge(frame, rules=[]).first()["kept"]


def test_plan_has_no_python_and_no_shuffle(spark, small):
    plan = rules.judge(spark.read.parquet(f"{small}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Exchange", plan)


def test_clean_prose_is_kept_and_junk_is_not(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    labels = spark.read.parquet(f"{small}/labels.parquet")
    got = rules.judge(docs).join(labels, "doc_id").filter("n_words >= 10").groupBy("quality", "kept").count().collect()
    counts = {(r["quality"], r["kept"]): r["count"] for r in got}
    assert counts[1, True] >= 0.99 * (counts[1, True] + counts.get((1, False), 0))
    assert counts.get((0, False), 0) >= 0.8 * (counts.get((0, False), 0) + counts.get((0, True), 0))


@pytest.mark.parametrize("rule", rules.RULES)
def test_conditions_are_readable_sql(spark, rule):
    assert spark.sql(f"SELECT {rules.condition(rule)} FROM VALUES (1,1,1,1,1,1,1) AS t({', '.join(rules.MEASURES)})").count() == 1
