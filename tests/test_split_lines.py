import random
import re

import pytest
from pyspark.sql import functions as F

from insight_spark.functions import fixed_values as fv
from insight_spark.operators import retrieval as ret
from insight_spark.session import fresh_path
from insight_spark.sources import files, ingest
from insight_spark.streaming import jobs


def whole_split(text, size, overlap, separators):
    """The rule on a text in one piece, written out plainly."""
    present = next((i for i, s in enumerate(separators) if s == "" or s in text), len(separators) - 1)
    sep, finer, chunks, window = separators[present], separators[present + 1 :], [], []

    def flush():
        joined = "".join(window).strip()
        return [joined] if joined else []

    edges = [0, *[m.start() for m in re.finditer(re.escape(sep), text)], len(text)] if sep else range(len(text) + 1)
    for piece in (text[a:b] for a, b in zip(edges, edges[1:]) if b > a):
        if len(piece) >= size:
            chunks += flush()
            window.clear()
            chunks += whole_split(piece, size, overlap, finer) if finer else [piece]
            continue
        if window and sum(map(len, window)) + len(piece) > size:
            chunks += flush()
            while window and (sum(map(len, window)) > overlap or sum(map(len, window)) + len(piece) > size):
                window.pop(0)
        window.append(piece)
    return chunks + flush()


def odd_texts():
    rng = random.Random(7)
    fixed = ["", "\n", "\n\n", "\n\n\n", "a", "a\n", "\na", "a\n\n", "\ufeffab\n\ncd", "\ufeff\nx\n", "a\r\nb\r\n", "x" * 50, "é. " * 30]
    return fixed + ["".join(rng.choice(["\n", "\n\n", ". ", " ", "word", "é", "\U0001f600", "longer"]) for _ in range(rng.randrange(200))) for _ in range(40)]


def test_blocks_split_like_the_whole():
    rng = random.Random(1)
    for text in odd_texts():
        want = whole_split(text, 40, 10, ret.PROSE_SEPARATORS)
        assert list(ret.split_text(text, 40, 10, ret.PROSE_SEPARATORS)) == want
        level = next(i for i, s in enumerate(ret.PROSE_SEPARATORS) if s in text)
        cuts = sorted(rng.randrange(len(text) + 1) for _ in range(9))
        blocks = [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)])]
        assert list(ret.split_blocks(blocks, 40, 10, ret.PROSE_SEPARATORS[level:])) == want


@pytest.mark.parametrize("separators", [ret.PROSE_SEPARATORS, ret.TABLE_SEPARATORS])
def test_lines_split_like_the_whole(spark, tmp_path, separators):
    texts = odd_texts()
    for i, text in enumerate(texts):
        (tmp_path / f"a b+c[{i}].txt").write_bytes(text.encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50")  # many splits of a file
    try:
        rows = ret.split_lines(files.text_lines(spark, str(tmp_path)), 40, 10, separators).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    got = {}
    for row in sorted(rows, key=lambda r: (r["path"], r["chunk_no"])):
        got.setdefault(int(re.search(r"a b\+c\[(\d+)\]", row["path"]).group(1)), []).append(row["chunk"])
    assert got == {i: want for i, text in enumerate(texts) if (want := whole_split(text, 40, 10, separators))}


def test_a_stream_reads_text_files_in_splits(spark, tmp_path, monkeypatch):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a b+1.txt").write_text("one two\n\n" * 500)
    (folder / "bad.docx").write_bytes(b"no archive")
    (folder / "page.html").write_text("<p>x</p>")
    held = []

    def watched(files, *rest, **named):
        held.append(sorted(r["path"].rsplit("/", 1)[1] for r in files.collect()))
        return ingest.ingest_files(files, *rest, **named)

    monkeypatch.setattr(jobs, "ingest_files", watched)
    path = fresh_path(spark, "ingest")
    jobs.stream_ingest_files(spark, str(folder), "c1", f"{path}/chunks", f"{path}/status", f"{path}/cp").awaitTermination()
    assert held == [["bad.docx", "page.html"]]
    got = {r["filename"]: (r["chunks"], r["status"]) for r in jobs.read_status(spark, f"{path}/status").collect()}
    want = len(whole_split("one two\n\n" * 500, 1000, 200, ret.PROSE_SEPARATORS))
    assert got == {"a b+1.txt": (want, "ready"), "bad.docx": (0, "error"), "page.html": (0, "skipped")}


def test_texts_go_to_python_in_small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    ret.split_structured(spark.range(1).select(F.lit("x").alias("text")))
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 256


def test_only_texts_of_the_size_and_longer_go_to_python(spark):
    class Never:
        def __iter__(self):
            raise AssertionError("a short text was split in Python")

    assert set(ret.SPACES) == {c for c in map(chr, range(0x110000)) if c.isspace()}
    texts = [None, "", " \x1c　", "a", "\x85  a \n\n b\x1f\n", "x. y" * 249, " " + "é" * 998, "​ a"]
    given = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    found = ret.split_recursive(given, separators=Never()).orderBy("i", "chunk_no").collect()
    assert [tuple(r) for r in found] == [(i, 0, t.strip()) for i, t in enumerate(texts) if t and t.strip()]
    long = [t * n for t in ("ab", "a b\n", " \n\n", "a. ") for n in (250, 333, 500, 2000)] + [" " * 999 + "x", "y" * 1000]
    given = spark.createDataFrame(list(enumerate(long)), "i int, text string")
    for split, sizes in ((ret.split_recursive, (1000, 200, ret.PROSE_SEPARATORS)), (ret.split_structured, (fv.TABLE_CHUNK, fv.TABLE_OVERLAP, ret.TABLE_SEPARATORS))):
        found = split(given).orderBy("i", "chunk_no").collect()
        assert [tuple(r) for r in found] == [(i, n, c) for i, t in enumerate(long) for n, c in enumerate(ret.split_text(t, *sizes))]
