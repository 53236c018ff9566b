"""Workbooks read sheet by sheet, in bounded memory."""

import io
import tracemalloc
import zipfile

import pyarrow as pa

from insight_spark.plans.office_samples import word_file
from insight_spark.sources import files, office

HEAD = '<?xml version="1.0"?>'
NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def workbook(path, sheets, shared=()):
    """``sheets`` is [(name, iterator of row xml)]."""
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
        names = "".join(f'<sheet name="{n}" sheetId="{i + 1}" r:id="r{i}"/>' for i, (n, _) in enumerate(sheets))
        archive.writestr("xl/workbook.xml", f'{HEAD}<workbook {NS} xmlns:r="{rel}"><sheets>{names}</sheets></workbook>')
        links = "".join(f'<Relationship Id="r{i}" Target="worksheets/sheet{i}.xml"/>' for i in range(len(sheets)))
        archive.writestr("xl/_rels/workbook.xml.rels", f"{HEAD}<Relationships>{links}</Relationships>")
        if shared:
            archive.writestr("xl/sharedStrings.xml", f"{HEAD}<sst {NS}>{''.join(f'<si><t>{s}</t></si>' for s in shared)}</sst>")
        for i, (_, rows) in enumerate(sheets):
            with archive.open(f"xl/worksheets/sheet{i}.xml", "w") as out:
                out.write(f"{HEAD}<worksheet {NS}><sheetData>".encode())
                for row in rows:
                    out.write(row.encode())
                out.write(b"</sheetData></worksheet>")


def numbered(count):
    yield '<row r="1"><c t="s"><v>0</v></c><c t="s"><v>1</v></c><c t="s"><v>2</v></c></row>'
    for i in range(count):
        yield f'<row r="{i + 2}"><c><v>{i}</v></c><c t="s"><v>{3 + i % 2}</v></c><c t="inlineStr"><is><t>x{i}</t></is></c></row>'


SHARED = ("id", "kind", "note", "even", "odd")


def test_memory_does_not_grow_with_the_rows(tmp_path):
    peaks = []
    for count in (20_000, 100_000):
        path = tmp_path / f"{count}.xlsx"
        workbook(path, [("big", numbered(count))], SHARED)
        tracemalloc.start()
        with office.open_stored(str(path)) as stream, zipfile.ZipFile(stream) as archive:
            shared = office.SharedStrings(archive)
            rows = 0
            for kind, number, header, cells in office.table_rows(office.sheet_rows(archive, office.sheets(archive)[0], shared), 3):
                rows += kind == "row"
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert rows == count and (kind, number, header) == ("sheet", count, ["id", "kind", "note"])
    assert peaks[1] < 1.5 * peaks[0] and peaks[1] < 20 << 20


def test_sheets_are_read_by_their_own_tasks(spark, tmp_path):
    workbook(tmp_path / "a.xlsx", [("one", numbered(12_000)), ("two", numbered(7)), ("none", iter(()))], SHARED)
    workbook(tmp_path / "B.XLSX", [("one", numbered(3))], SHARED)
    (tmp_path / "broken.xlsx").write_bytes(b"no zip")
    (tmp_path / "other.txt").write_text("text")
    listed = files.list_sheets(spark, str(tmp_path)).collect()
    assert sorted((r["path"].rsplit("/", 1)[1], r["sheet"]) for r in listed if r["error"] is None) == [("B.XLSX", "one"), ("a.xlsx", "none"), ("a.xlsx", "one"), ("a.xlsx", "two")]
    cells = files.stored_sheets(spark, str(tmp_path))
    counts = {(r["path"].rsplit("/", 1)[1], r["sheet"], r["kind"]): r["count"] for r in cells.groupBy("path", "sheet", "kind").count().collect()}
    assert counts == {
        ("a.xlsx", "one", "row"): 12_000, ("a.xlsx", "one", "sheet"): 1, ("a.xlsx", "two", "row"): 7, ("a.xlsx", "two", "sheet"): 1,
        ("B.XLSX", "one", "row"): 3, ("B.XLSX", "one", "sheet"): 1, ("broken.xlsx", None, "error"): 1,
    }
    # The same rows as from whole contents.
    whole = files.workbook_cells(files.binary_files(spark, str(tmp_path), "*.[xX][lL][sS][xX]").select("path", "content"))
    columns = ["path", "sheet_no", "sheet", "kind", "row", "names", "cells"]
    assert cells.filter("error IS NULL").select(columns).exceptAll(whole.filter("error IS NULL").select(columns)).count() == 0


def test_only_wanted_columns(spark, tmp_path):
    workbook(tmp_path / "a.xlsx", [("one", numbered(4)), ("two", numbered(2))], SHARED)
    got = files.stored_sheets(spark, str(tmp_path), ["note", "missing", "id"], sheet_no=1).filter("kind = 'row'").orderBy("row")
    assert [r["cells"] for r in got.collect()] == [["x0", None, "0"], ["x1", None, "1"]]


def test_a_sheet_that_breaks_off_is_an_error_row(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "good.xlsx", "w") as archive:
        archive.writestr("x", "y")
    workbook(tmp_path / "bad.xlsx", [("ok", numbered(2)), ("bad", iter(["<row><c><v>1</v></row>"]))], SHARED)
    rows = files.stored_sheets(spark, str(tmp_path)).select("path", "sheet", "kind").collect()
    kinds = sorted((r["path"].rsplit("/", 1)[1], r["sheet"], r["kind"]) for r in rows if r["kind"] == "error" and r["sheet"])
    assert kinds == [("bad.xlsx", "bad", "error")] and sum(r["kind"] == "row" for r in rows) == 2


def test_word_blocks_inside_tables_belong_to_them():
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    body = p("one") + f"<w:tbl><w:tr><w:tc>{p('a')}{p('b')}</w:tc><w:tc>{p('c')}</w:tc></w:tr></w:tbl>" + p("") + p("two")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        archive.writestr("word/document.xml", f"{HEAD}<w:document {ns}><w:body>{body}</w:body></w:document>")
    out.seek(0)
    assert list(office.word_blocks(out)) == [("paragraph", 0, "one"), ("table", 0, "a\nb | c"), ("paragraph", 1, ""), ("paragraph", 2, "two")]


def test_small_files_are_handed_on_together():
    rows = [(f"/in/{i}.docx", word_file([f"line {i}"]) if i != 7 else b"broken") for i in range(50)]
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.binary())], names=["path", "content"])
    columns = {"path": pa.string(), "kind": pa.string(), "position": pa.int32(), "text": pa.string(), "error": pa.string()}
    out = list(files._each_file(files._word_rows, columns, ("error", None, None))([batch]))
    assert len(out) == 1 and out[0].num_rows == 2 * 49 + 1
    assert [r["path"] for r in out[0].to_pylist() if r["error"]] == ["/in/7.docx"]


def _word(body, after=""):
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        archive.writestr("word/document.xml", f"{HEAD}<w:document {ns}><w:body>{body}</w:body>{after}</w:document>")
    return out


def test_a_small_word_text_is_parsed_at_once_like_a_large_one(monkeypatch):
    body = (
        "<w:p><w:r><w:t>a</w:t><w:br/><w:t> b </w:t><w:tab/></w:r></w:p><w:sect><w:p><w:t>not the body's own</w:t></w:p></w:sect>"
        "<w:tbl><w:tr><w:tc><w:p><w:t>x</w:t></w:p><w:tbl/></w:tc></w:tr></w:tbl><w:p><!-- c --><w:hyperlink><w:t>l</w:t></w:hyperlink></w:p>"
    )
    made = [_word(body), _word(body, after="<w:note><w:p/></w:note>"), _word("")]
    monkeypatch.setattr(office, "WHOLE_BYTES", -1)
    slow = [list(office.word_blocks(f)) for f in made]
    assert slow[0] == [("paragraph", 0, "a\n b"), ("table", 0, "x"), ("paragraph", 1, "l")] == slow[1]
    monkeypatch.undo()

    def never(*_):
        raise AssertionError("parsed event by event")

    monkeypatch.setattr(office.ElementTree, "iterparse", never)
    assert [list(office.word_blocks(f)) for f in made] == slow
