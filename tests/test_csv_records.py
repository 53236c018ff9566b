"""CSV records cut by splits against Python's csv reader on the whole text."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from insight_spark.sources import csv_records, files


def plain(text):
    """Records of the whole text by Python's reader, without empty lines."""
    return [r for r in csv.reader(io.StringIO(text, newline="")) if r]


def parsed(record):
    return next(csv.reader(io.StringIO(record, newline="")))


def written(rng, rows):
    out = io.StringIO(newline="")
    writer = csv.writer(out, lineterminator="\n")
    pieces = ["a", "b c", 'q"q', "x,y", "l\nm", "\n\n", '"', "", "end", "é" * 30, '","', "long " * 40]
    for _ in range(rows):
        writer.writerow([rng.choice(pieces) + rng.choice(pieces) for _ in range(3)])
        if rng.random() < 0.05:
            out.write("\n")
    return out.getvalue()


def rows_of(frame):
    found = {}
    for r in frame.orderBy("path", "row").collect():
        found.setdefault(r["path"].rsplit("/", 1)[-1], []).append((r["row"], r["record"]))
    return found


@pytest.mark.parametrize("block", [100, 4096, 1 << 20])
def test_records_across_splits(spark, tmp_path, block):
    rng = random.Random(block)
    texts = {f"f{i}.csv": written(rng, 40 if block == 100 else 200) for i in range(2)}
    # One field over many splits, and one that is never closed.
    texts["wide.csv"] = "a,b\n1,\"" + "line\n" * (60 if block == 100 else 3000) + "\",2\n3,4\n"
    texts["open.csv"] = 'a,b\n1,2\n3,"never closed\nline\n\nlast'
    texts["empty.csv"] = ""
    for name, text in texts.items():
        (tmp_path / name).write_text(text, newline="")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(block))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        lines = csv_records.csv_lines(spark, str(tmp_path))
        got = rows_of(csv_records.records(lines))
        tasks = lines.rdd.getNumPartitions()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    assert tasks > (20 if block == 100 else 4 if block == 4096 else 0)
    for name in ("f0.csv", "f1.csv", "wide.csv"):
        want = plain(texts[name])
        assert [parsed(r) for _, r in got[name]] == want
        assert [n for n, _ in got[name]] == list(range(len(want)))
    assert [r for _, r in got["open.csv"]] == ["a,b", "1,2", '3,"never closed\nline\n\nlast']
    assert "empty.csv" not in got


def test_effects_compose():
    rng = random.Random(3)
    for _ in range(300):
        lines = ["".join(rng.choice('a",\n ') for _ in range(rng.randrange(9))).replace("\n", "") for _ in range(6)]
        for start in (False, True):
            state = start
            for line in lines:
                state = csv_records.open_after(line, state)
            reader = csv_records._Reader()
            for line in lines:
                reader.add(line)
            assert bool(reader.effect().open[int(start)]) == state


def test_quotes_inside_a_plain_field_are_letters(spark, tmp_path):
    (tmp_path / "inch.csv").write_text('size,name\n5" pipe,x\n6" pipe,"a\nb"\n')
    got = files.scan_csv(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == [('5" pipe', "x"), ('6" pipe', "a\nb")]


def test_types_and_schema(spark, tmp_path):
    text = 'n,big,x,d,t,b,s,none\n1,5000000000,1.5,2024-01-31,2024-01-31 10:00:00,true,"a\nb",\n-2,1,2,2024-02-01,2024-02-01 00:00:00,false,7,\n'
    (tmp_path / "t.csv").write_text(text)
    df = files.scan_csv(spark, str(tmp_path))
    assert [t for _, t in df.dtypes] == ["int", "bigint", "double", "date", "timestamp", "boolean", "string", "string"]
    assert [(r["n"], r["s"], r["none"]) for r in df.orderBy("n").collect()] == [(-2, "7", None), (1, "a\nb", None)]
    given = files.scan_csv(spark, str(tmp_path), "n long, big long, x double, d string, t string, b string, s string, none string")
    assert given.schema["n"].dataType.simpleString() == "bigint" and given.agg(F.sum("n")).first()[0] == -1


@pytest.mark.parametrize("text, breaks", [('a,b\n1,2\n', False), ('a,b\n"x, y","z ""q"""\n', False), ('a,b\n1,"x\ny"\n', True), ('a\n5" pipe\n', False), ("", False)])
def test_breaks_are_seen(spark, tmp_path, text, breaks):
    (tmp_path / "x.csv").write_text(text)
    assert csv_records.any_break(csv_records.csv_lines(spark, str(tmp_path))) == breaks
