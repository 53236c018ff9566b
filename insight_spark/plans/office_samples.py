"""Word and Excel files made from table rows, to have such files to read."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from insight_spark.operators.scale import small_batches

WORD = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
SHEET = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006/relationships"


def _zip(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=1) as archive:
        for name, body in parts.items():
            archive.writestr(name, '<?xml version="1.0" encoding="UTF-8"?>' + body)
    return out.getvalue()


def word_file(paragraphs: list[str], tables: list[list[list[str]]] | None = None) -> bytes:
    def paragraph(text: str) -> str:
        return f'<w:p><w:r><w:t xml:space="preserve">{escape(text)}</w:t></w:r></w:p>'

    body = "".join(paragraph(p) for p in paragraphs)
    for table in tables or []:
        rows = "".join(
            "<w:tr>" + "".join(f"<w:tc>{paragraph(c)}</w:tc>" for c in row) + "</w:tr>" for row in table
        )
        body += f"<w:tbl>{rows}</w:tbl>"
    return _zip({"word/document.xml": f'<w:document xmlns:w="{WORD}"><w:body>{body}</w:body></w:document>'})


def workbook_file(sheets: dict[str, list[list]]) -> bytes:
    strings: dict[str, int] = {}

    def cell(value, row: int, column: int) -> str:
        place = f'r="{chr(65 + column)}{row}"'
        if value is None:
            return ""
        if isinstance(value, str):
            return f'<c {place} t="s"><v>{strings.setdefault(value, len(strings))}</v></c>'
        return f"<c {place}><v>{value}</v></c>"

    parts, entries, links = {}, "", ""
    for number, (name, rows) in enumerate(sheets.items(), start=1):
        body = "".join(
            f'<row r="{i}">' + "".join(cell(v, i, j) for j, v in enumerate(row)) + "</row>"
            for i, row in enumerate(rows, start=1)
        )
        parts[f"xl/worksheets/sheet{number}.xml"] = f'<worksheet xmlns="{SHEET}"><sheetData>{body}</sheetData></worksheet>'
        entries += f'<sheet name="{escape(name)}" sheetId="{number}" r:id="rId{number}"/>'
        links += f'<Relationship Id="rId{number}" Type="{REL}/worksheet" Target="worksheets/sheet{number}.xml"/>'
    items = "".join(f"<si><t>{escape(s)}</t></si>" for s in strings)
    return _zip({
        "xl/workbook.xml": f'<workbook xmlns="{SHEET}" xmlns:r="{REL}"><sheets>{entries}</sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{PACKAGE}">{links}</Relationships>',
        "xl/sharedStrings.xml": f'<sst xmlns="{SHEET}">{items}</sst>',
        **parts,
    })


def word_files(docs: DataFrame) -> DataFrame:
    """(path, content): one Word file per document, a paragraph per line, ids in a table."""
    def run(batches):
        for batch in batches:
            content = [
                word_file(text.split("\n"), [[["doc", str(i)], ["letters", str(len(text))]]])
                for i, text in zip(batch["doc_id"], batch["text"])
            ]
            yield pd.DataFrame({"path": [f"/in/{i}.docx" for i in batch["doc_id"]], "content": content})

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInPandas(run, "path string, content binary")


def workbooks(df: DataFrame, key: str, rows_per_file: int = 500) -> DataFrame:
    """(path, content): one workbook per ``rows_per_file`` keys, so no group grows with the data."""
    names = df.columns

    def run(group: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values(key)[names].astype(object).values.tolist()
        rows = [[v if isinstance(v, str) else v for v in row] for row in rows]
        book = workbook_file({"Data": [names, *rows], "Notes": [["note"], [f"file {group[0]}"]]})
        return pd.DataFrame({"path": [f"/in/book{group[0]}.xlsx"], "content": [book]})

    numbered = df.withColumn("_file", F.floor(F.col(key) / rows_per_file))
    return numbered.groupBy("_file").applyInPandas(run, "path string, content binary")
