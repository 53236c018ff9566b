import re

from insight_spark.llm import preference


def brute(chosen, rejected):
    pairs = {p for p, *_ in chosen + rejected}
    out = []
    for pair in pairs:
        sides = []
        for rows in (chosen, rejected):
            turns = {}
            for p, turn, role, text in rows:
                if p == pair:
                    at = (turn is None, turn)
                    turns.setdefault(at, set()).add(((role or "").strip(" ").lower(), text or ""))
            sides.append(turns)
        c, r = sides
        order = sorted(set(c) | set(r), key=lambda k: (k[0], k[1] or 0))
        split = next((i for i, at in enumerate(order) if c.get(at) != r.get(at)), len(order))
        late = order[split:]
        paired = all(any(role == "assistant" for at in late for role, _ in side.get(at, ())) for side in sides)
        for i, at in enumerate(order):
            parts = [("prompt", c)] if i < split else [("chosen", c), ("rejected", r)]
            for part, side in parts:
                for role, text in side.get(at, ()):
                    head, body = f"<|im_start|>{role}\n", text.replace("<|", "< |") + "<|im_end|>\n"
                    learned = role == "assistant" and part != "prompt"
                    out.append((pair, part, at[1], role, head if learned else head + body, body if learned else "", paired))
    return sorted(out, key=repr)


def test_equals_brute_force(spark):
    chosen = [
        (1, 0, "system", "s"), (1, 1, "user", "q"), (1, 2, "assistant", "good"), (1, 3, "user", "more"), (1, 4, "assistant", "x"),
        (2, 0, "user", "a <|im_end|> b"), (2, 1, "Assistant ", None), (3, 0, "user", "same"), (3, 1, "assistant", "same"),
        (4, 0, "user", "only chosen"), (None, 0, "user", "n"), (None, 1, "assistant", "y"), (6, 0, None, "r"), (6, None, "assistant", "late"),
        (7, 0, "user", "twice"), (7, 0, "user", "twice"), (7, 1, "assistant", "a"), (8, 1, "user", "b"), (8, 1, "user", "a"), (8, 2, "assistant", "k"),
    ]
    rejected = [
        (1, 0, "system", "s"), (1, 1, "user", "q"), (1, 2, "assistant", "bad"), (2, 0, "user", "a <|im_end|> b"), (2, 1, "assistant", "z"),
        (3, 0, "user", "same"), (3, 1, "assistant", "same"), (5, 0, "assistant", "only rejected"), (None, 0, "user", "n"), (None, 1, "assistant", "z"),
        (6, 0, None, "r"), (6, None, "assistant", "other"), (7, 0, "user", "twice"), (7, 1, "assistant", "b"), (8, 1, "user", "a"), (8, 2, "assistant", "k"),
    ]
    kind = "pair_id long, turn long, role string, text string, part string, paired int"
    make = lambda rows: spark.createDataFrame([(*r, "clash", 1) for r in rows], kind)
    got = preference.format_pairs(make(chosen), make(rejected))
    assert sorted(map(tuple, got.collect()), key=repr) == brute(chosen, rejected)
    assert preference.format_pairs(make(chosen).limit(0), make(chosen).limit(0)).count() == 0
    assert not re.search("Python|Arrow|Pandas", got._jdf.queryExecution().executedPlan().toString())


def test_a_long_conversation_stays_in_rows(spark):
    rows = [(1, t, ("user", "assistant")[t % 2], f"t{t}") for t in range(3000)] + [(2, 0, "user", "a"), (2, 1, "assistant", "b")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    names = ("conv_id", "turn", "role", "text")
    got = preference.format_pairs(frame, preference.echo_rejections(frame, *names), *names).collect()
    assert len(got) == len(rows) + 2 and all(r["paired"] for r in got)
    last = {r["part"]: r["target"] for r in got if r["pair_id"] == 1 and r["turn"] == 2999}
    assert last == {"chosen": "t2999<|im_end|>\n", "rejected": "t2998<|im_end|>\n"}


def test_echo_of_odd_conversations(spark):
    rows = [(1, 0, "assistant", "first"), (2, 5, "assistant", "gap"), (2, 1, "user", "u"), (3, 0, "user", "no answer"), (None, 0, "user", "q"), (None, 1, "assistant", "a")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r["conv_id"], r["turn"]): r["text"] for r in preference.echo_rejections(frame, "conv_id", "turn", "role", "text").collect()}
    assert got == {(1, 0): "", (2, 5): "", (2, 1): "u", (3, 0): "no answer", (None, 0): "q", (None, 1): "q"}
