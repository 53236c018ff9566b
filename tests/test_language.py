from pyspark.sql import functions as F

from insight_spark.functions import language as lang

# Labelled questions.
CASES = [
    ("How many employees work here?", "en"), ("¿Cuántos empleados trabajan aquí?", "es"), ("¿Cuál es el salario promedio?", "es"),
    ("Combien d'employés travaillent ici?", "fr"), ("Quel est le salaire moyen?", "fr"), ("Wie viele Mitarbeiter arbeiten hier?", "de"),
    ("यहाँ कितने कर्मचारी काम करते हैं?", "hi"), ("这里有多少员工?", "zh-cn"), ("ここで働いている従業員は何人ですか?", "ja"),
    ("كم عدد الموظفين الذين يعملون هنا؟", "ar"), ("Quantos funcionários trabalham aqui?", "pt"),
    ("what is the total revenue", "en"), ("¿cuál es el ingreso total?", "es"), ("quel est le revenu total?", "fr"),
    ("was ist der gesamtumsatz?", "de"), ("qual é a receita total?", "pt"), ("मुझे कुल राजस्व बताएं", "hi"), ("総収益はいくらですか", "ja"),
    ("총 수익은 얼마입니까", "ko"), ("ما هو إجمالي الإيرادات", "ar"), ("сколько сотрудников здесь работает", "ru"), ("12345", "en"),
]


def detect(spark, values, fn):
    df = spark.createDataFrame(list(enumerate(values)), "i int, s string")
    return [r["x"] for r in df.select("i", fn(F.col("s")).alias("x")).orderBy("i").collect()]


def test_labelled_questions(spark):
    assert detect(spark, [c[0] for c in CASES], lang.detect_language) == [c[1] for c in CASES]


def test_script_limits(spark):
    # Shares of exactly the limit are not enough.
    values = ["한" * 3 + "a" * 17, "한" * 4 + "a" * 16, "ह" * 2 + "a" * 18, "ह" * 3 + "a" * 17, "漢" * 4 + "か" * 4 + "a" * 12, ""]
    assert detect(spark, values, lang.script_language) == [None, "ko", None, "hi", "ja", None]


def test_short_question_guard(spark):
    values = ["total patients", "総収益は", "¿Cuántos empleados?", "كم عدد", "quel est le salaire"]
    assert detect(spark, values, lang.short_query_guard) == ["en", "ja", "en", "en", "fr"]


def test_names(spark):
    assert detect(spark, ["de", "xx"], lang.language_name) == ["German", "XX"]


def test_accuracy_on_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    share = docs.select(F.avg((lang.detect_language(F.col("text")) == F.col("lang")).cast("int"))).first()[0]
    assert share > 0.9


def test_learned_profiles_are_the_counted_ranks(spark):
    from collections import Counter

    rows = [("aa", "abab abc"), ("aa", "ab"), ("bb", "xyz xyx"), (None, "lost")]
    got = lang.learn_profiles(spark.createDataFrame(rows, "lang string, text string"), size=7)
    for code, words in (("aa", ["abab", "abc", "ab"]), ("bb", ["xyz", "xyx"])):
        grams = Counter()
        for word in words:
            padded = f" {word} "
            grams.update(padded[i : i + n] for n in (1, 2, 3) for i in range(len(padded) - n + 1) if padded[i : i + n].strip())
        assert got[code] == [g for g, _ in sorted(grams.items(), key=lambda x: (-x[1], x[0]))[:7]]


def test_out_of_place_distance_by_hand(spark):
    profiles = {"aa": ["a", "b", "ab"], "bb": ["b", "x", "ab"]}
    df = spark.createDataFrame([("a b a",), ("ab ab xb",), ("123",), (None,)], "s string")
    rows = df.select(lang.profile_distances(F.col("s"), profiles).alias("d"), lang.profile_language(F.col("s"), profiles).alias("l")).collect()
    # "a b a": a, b; "ab ab xb": b (3), then a and ab (2 each, in the order of the sequences), x.
    assert rows[0]["d"] == [0, 3 + 1] and rows[0]["l"] == "aa"
    assert rows[1]["d"] == [1 + 1 + 0, 0 + 3 + 0] and rows[1]["l"] == "aa"
    assert rows[2]["d"] is None and rows[3]["l"] is None


def test_distance_of_sequences_that_overlap_themselves(spark):
    profiles = {"aa": ["aa", "aba", " a"], "bb": ["z", "aa", "a "]}
    texts = ["aaaa", "ababa aaaaa", "", "É", "aa " * 300 + "aba"]
    expected = []
    for text in texts:
        whole = " " + "  ".join(text.lower().split()) + " "
        grams = sorted({g for listed in profiles.values() for g in listed})
        seen = sorted((-whole.count(g), i) for i, g in enumerate(grams) if g in whole)
        out = lambda listed: sum(abs(listed.index(grams[i]) - r) if grams[i] in listed else 3 for r, (_, i) in enumerate(seen[:3]))
        expected.append([out(profiles["aa"]), out(profiles["bb"])] if seen else None)
    assert detect(spark, texts, lambda c: lang.profile_distances(c, profiles)) == expected


def test_sequences_are_counted_in_one_pass(spark):
    # Once every sequence searched the whole text on its own, with an expression for each.
    profiles = {"aa": ["ab", "b"], "bb": ["b", "x"]}
    df = spark.createDataFrame([("ab xb",)], "s string").select(lang.profile_distances(F.col("s"), profiles).alias("d"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "replace(" not in plan


def test_the_batch_counts_each_text_alone():
    grams = ["aa", "aba", " a", "é", "\U0001f600"]
    texts = [" aaa ", "", " ababa  aaaaa ", " éa  \U0001f600 ", " aa "]
    counts = lang._gram_counts(texts, grams, lang._gram_tree(grams))
    assert counts.tolist() == [[text.count(gram) for gram in grams] for text in texts]


def test_learned_profiles_tell_the_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").filter("lang IS NOT NULL")
    profiles = lang.learn_profiles(docs.filter("doc_id % 2 = 0"))
    unseen = docs.filter("doc_id % 2 = 1").select("lang", lang.detect_by_profiles(F.col("text"), profiles).alias("found"))
    right = {r["lang"]: r["share"] for r in unseen.groupBy("lang").agg(F.avg((F.col("lang") == F.col("found")).cast("int")).alias("share")).collect()}
    assert len(right) == 4 and min(right.values()) >= 0.95


def test_marker_letters_and_scripts_among_other_signs(spark):
    rows = [
        ("STRASSE \u00dc \u2013 x", "de"), ("\u0131", "tr"), ("ANO \u00d1", "es"), ("\u00e7", "fr"), ("\u2013 \u20ac \U0001f600", "en"), ("", "en"), (None, "en"),
        ("\u0627\u0628\u062a \u2013", "ar"), ("\u043f\u0440\u0438 \u0432\u0435\u0442", "ru"), ("the " * 40 + "\u0627 \u0434", "en"),
    ]
    found = spark.createDataFrame(rows, "text string, want string").withColumn("found", lang.detect_language(F.col("text")))
    assert [r for r in found.collect() if r["found"] != r["want"]] == []


def test_a_text_is_searched_for_rare_letters_once(spark):
    # Each pass over a whole text is a search in the text or in its lower case; there was one per language.
    plan = spark.range(1).select(lang.word_profile_language(F.col("id").cast("string")).alias("x"))._jdf.queryExecution().analyzed().toString()
    assert "RLIKE(lower(" not in plan and plan.count("lower(") == 1, plan
