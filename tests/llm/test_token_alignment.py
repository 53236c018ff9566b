import hashlib
import random
from collections import Counter

import public_tokenizers
import pyarrow as pa
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from insight_spark.llm import queries, token_alignment

PATHS = (public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
FIRST = Tokenizer.from_file(PATHS[0])
FIRST.encode_special_tokens = True
SECOND = SentencePieceProcessor(model_file=PATHS[1])


def byte_of_letter():
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    letters, extra = {}, 0
    for b in range(256):
        if b in plain:
            letters[chr(b)] = b
        else:
            letters[chr(256 + extra)] = b
            extra += 1
    return letters


LETTERS = byte_of_letter()


def groups_of(text):
    """Groups of the whole text by comparing sets of ends; None without tokens."""
    if not text:
        return None
    a, b = FIRST.encode(" " + text, add_special_tokens=False).ids, SECOND.encode(text)
    first = [bytes(LETTERS[c] for c in FIRST.id_to_token(i)) for i in a]
    second = []
    for i in b:
        piece = SECOND.id_to_piece(i)
        second.append(bytes([int(piece[3:5], 16)]) if SECOND.is_byte(i) else piece.replace("▁", " ").encode())
    whole = (" " + text).encode()
    if b"".join(first) != whole or b"".join(second) != whole:
        return None
    ends = []
    for parts in (first, second):
        at, found = 0, []
        for part in parts:
            at += len(part)
            found.append(at)
        ends.append(found)
    common = sorted(set(ends[0]) & set(ends[1]))
    groups, low = [], 0
    for high in common:
        groups.append(([i for i, e in zip(a, ends[0]) if low < e <= high], [i for i, e in zip(b, ends[1]) if low < e <= high]))
        low = high
    return groups


def brute(rows):
    made = [groups_of(text) for _, text in rows]
    links = [Counter((i, j) for x, y in g or [] for i in x for j in y) for g in made]
    counts = Counter(pair for found in links for pair in found)
    top = {}
    for (i, _), n in counts.items():
        top[i] = max(top.get(i, 0), n)
    out = []
    for (doc_id, _), g, found in zip(rows, made, links):
        written = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in g or [])
        out.append((
            doc_id, sum(len(x) for x, _ in g or []), sum(len(y) for _, y in g or []), len(g or []), sum(found.values()),
            sum(t for p, t in found.items() if counts[p] == top[p[0]]), sum(t * counts[p] for p, t in found.items()),
            hashlib.sha256(written.encode()).hexdigest() if g else "",
        ))
    return sorted(out, key=repr)


ODD = [
    None, "", " ", "  ", "a", " a", "a ", "a  b", "\n", "a\nb\nc", "a\n\nb", "x \n y", "word.\nNext one\nand 3\n4", "tab\tand\rreturn\r\n",
    "nul\x00here and there", "piece ▁sign", "▁", "<|endoftext|> <s>x</s> <0x41>", "don't we'll I'd", "中文 and 日本語のテキスト", "👍🏽👩‍👩‍👧 ok",
    "e\u0301 é ﬁ Ａ", "\u00a0hard\u00a0space \u2003 em", "aaaaaaaaaaaaaaaaaaaaaaaaa" * 40, "0000000000123456789" * 30, "-----=====-----" * 20,
    "the the the the", "\u0085next\x1cline", "𝔘𝔫𝔦𝔠𝔬𝔡𝔢 \U0001F9FF\uFFFD", "a\u2028b c", "İstanbul ı", "x" * 3000 + " " + "é" * 500,
]


@pytest.mark.parametrize("frequent", [token_alignment.FREQUENT, 40, 0])
def test_odd_texts_equal_brute_force(spark, frequent):
    rng = random.Random(3)
    rows = list(enumerate(ODD)) + [(None, "the the the the"), (7, "a\nb\nc"), (7, "a\nb\nc")]
    signs = "ab é\n\t.'7中👍 "
    rows += [(100 + i, "".join(rng.choice(signs) for _ in range(rng.randint(1, 60)))) for i in range(150)]
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, id int, text_key string").repartition(3)
    got = token_alignment.align(frame, *PATHS, frequent=frequent)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)


def test_query_equals_brute_force(spark, small):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    got = queries.QUERIES["op12_token_alignment"](spark, small)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)


def test_memory_starts_anew_and_hot_texts(spark, monkeypatch):
    monkeypatch.setattr(token_alignment, "REMEMBERED", 3)
    aligner = token_alignment.Aligner(*PATHS)
    texts = [t for t in ODD if t]
    for _ in range(2):
        sizes, written, *_ = aligner.align(pa.array(texts))
        want = [groups_of(t) or [] for t in texts]
        assert sizes[:, 2].tolist() == [len(g) for g in want]
        assert [len([p for p in w.split(b";") if p]) for w in written] == [len(g) for g in want]
    rows = [(i, "same text for a third") for i in range(300)] + [(1000 + i, f"other {i}") for i in range(600)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, token_alignment.align(frame, *PATHS).collect()), key=repr) == brute(rows)


def test_empty_table(spark):
    frame = spark.createDataFrame([], "doc_id long, text string")
    assert token_alignment.align(frame, *PATHS).count() == 0
