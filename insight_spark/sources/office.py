"""Incremental readers of Excel and Word files: a part is parsed while it is unpacked and forgotten once it is read."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from typing import IO, NamedTuple
from xml.etree import ElementTree

import pyarrow as pa

WORD_NS = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
SHEET_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
REL_NS = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
# Parts of a Word paragraph that stand for text, and their text; that of TEXT is its own.
TEXT = f"{WORD_NS}t"
INLINE = {TEXT: "", f"{WORD_NS}br": "\n", f"{WORD_NS}cr": "\n", f"{WORD_NS}tab": "\t"}
# Shared strings put into one Arrow array at a time.
STRINGS = 50_000
# Bytes up to which a Word text is parsed at once, which is faster than event by event.
WHOLE_BYTES = 1 << 17


class Sheet(NamedTuple):
    number: int
    name: str
    part: str  # its place in the file


def open_stored(path: str) -> IO[bytes]:
    """A seekable stream of a file on any store that Arrow knows; a plain path or a file: URI is local."""
    from pyarrow import fs

    uri = path if "://" in path else re.sub(r"^file:/*", "/", path)
    system, place = fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)
    return system.open_input_file(place)


def _elements(archive: zipfile.ZipFile, part: str, tag: str) -> Iterator[ElementTree.Element]:
    """Every element of a name in a part, taken out of its parent once it was used."""
    with archive.open(part) as stream:
        parents: list[ElementTree.Element] = []
        for event, node in ElementTree.iterparse(stream, ("start", "end")):
            if event == "start":
                parents.append(node)
                continue
            parents.pop()
            if node.tag == tag:
                yield node
                node.clear()
                if parents:
                    parents[-1].remove(node)


def sheets(archive: zipfile.ZipFile) -> list[Sheet]:
    links = {link.get("Id"): link.get("Target") for link in ElementTree.fromstring(archive.read("xl/_rels/workbook.xml.rels"))}
    found = []
    for number, sheet in enumerate(ElementTree.fromstring(archive.read("xl/workbook.xml")).iter(f"{SHEET_NS}sheet")):
        target = links[sheet.get(f"{REL_NS}id")].lstrip("/")
        found.append(Sheet(number, sheet.get("name"), target if target.startswith("xl/") else f"xl/{target}"))
    return found


class SharedStrings:
    """The texts that cells name by number, held as Arrow arrays."""

    def __init__(self, archive: zipfile.ZipFile):
        self.arrays: list[pa.Array] = []
        if "xl/sharedStrings.xml" not in archive.namelist():
            return
        held: list[str] = []
        for item in _elements(archive, "xl/sharedStrings.xml", f"{SHEET_NS}si"):
            held.append("".join(t.text or "" for t in item.iter(f"{SHEET_NS}t")))
            if len(held) == STRINGS:
                self.arrays.append(pa.array(held, pa.string()))
                held = []
        self.arrays.append(pa.array(held, pa.string()))

    def __getitem__(self, number: int) -> str:
        if number < 0:
            raise IndexError(number)
        return self.arrays[number // STRINGS][number % STRINGS].as_py()


def _column(reference: str) -> int:
    number = 0
    for letter in re.match(r"[A-Z]+", reference).group():
        number = number * 26 + ord(letter) - 64
    return number - 1


def sheet_rows(archive: zipfile.ZipFile, sheet: Sheet, shared: SharedStrings) -> Iterator[tuple[int, list[str | None]]]:
    """(row number from 0, cells up to the last filled one) of every row that the sheet has, one by one."""
    for index, row in enumerate(_elements(archive, sheet.part, f"{SHEET_NS}row")):
        cells: dict[int, str] = {}
        for place, cell in enumerate(row.findall(f"{SHEET_NS}c")):
            column = _column(cell.get("r")) if cell.get("r") else place
            value = cell.find(f"{SHEET_NS}v")
            if cell.get("t") == "s" and value is not None:
                cells[column] = shared[int(value.text)]
            elif cell.get("t") == "inlineStr":
                cells[column] = "".join(t.text or "" for t in cell.iter(f"{SHEET_NS}t"))
            elif value is not None:
                cells[column] = value.text
        number = int(row.get("r")) - 1 if row.get("r") else index
        yield number, [cells.get(i) for i in range(max(cells, default=-1) + 1)]


def table_rows(rows: Iterator[tuple[int, list[str | None]]], sample: int) -> Iterator[tuple[str, int, list[str], list[str | None]]]:
    """("row", number below the header, header, cells) of a sheet, and last ("sheet", number of rows, header, sample
    lines); nothing of a sheet without a row."""
    first, header, count, lines = None, [], 0, []
    for number, cells in rows:
        if first is None:
            first, header = number, [name or f"Unnamed: {i}" for i, name in enumerate(cells)]
            continue
        if count < sample:
            filled = cells + [None] * len(header)
            lines.append(", ".join(f"{n}: {'nan' if c is None else c}" for n, c in zip(header, filled)))
        count += 1
        yield "row", number - 1 - first, header, cells
    if first is not None:
        yield "sheet", count, header, lines


def _inline_text(node: ElementTree.Element) -> str:
    return "".join([(t.text or "") if t.tag == TEXT else INLINE[t.tag] for t in node.iter() if t.tag in INLINE])


def _children_at_once(content: bytes) -> Iterator[ElementTree.Element]:
    body = next(ElementTree.fromstring(content).iter(f"{WORD_NS}body"), None)
    if body is None:
        raise ValueError("no document body")
    yield from body


def _children_one_by_one(stream: IO[bytes]) -> Iterator[ElementTree.Element]:
    """The body's own blocks, each taken out once it was used."""
    depth, body, ended = 0, None, False
    for event, node in ElementTree.iterparse(stream, ("start", "end")):
        if event == "start":
            depth += 1
            if node.tag == f"{WORD_NS}body" and body is None:
                body = (depth, node)
            continue
        depth -= 1
        if body is None or ended or depth > body[0]:
            continue
        if node is body[1]:
            ended = True
            continue
        yield node
        node.clear()
        body[1].remove(node)
    if body is None:
        raise ValueError("no document body")


def _body_children(archive: zipfile.ZipFile) -> Iterator[ElementTree.Element]:
    part = archive.getinfo("word/document.xml")
    if part.file_size <= WHOLE_BYTES:
        try:
            yield from _children_at_once(archive.read(part))
            return
        except ElementTree.ParseError:  # raised before the first block: read on as far as the file goes
            pass
    with archive.open(part) as stream:
        yield from _children_one_by_one(stream)


def word_blocks(source: IO[bytes]) -> Iterator[tuple[str, int, str]]:
    """("paragraph" or "table", number of its kind, text) in the order of the file; blocks inside a table belong to it."""
    paragraph, table = f"{WORD_NS}p", f"{WORD_NS}tbl"
    numbers = {paragraph: 0, table: 0}
    with zipfile.ZipFile(source) as archive:
        for node in _body_children(archive):
            if node.tag == paragraph:
                yield "paragraph", numbers[paragraph], _inline_text(node).strip()
            elif node.tag == table:
                yield "table", numbers[table], "\n".join(
                    " | ".join(
                        "\n".join(_inline_text(p) for p in cell.findall(paragraph)).strip() for cell in row.findall(f"{WORD_NS}tc")
                    )
                    for row in node.findall(f"{WORD_NS}tr")
                )
            if node.tag in numbers:
                numbers[node.tag] += 1


def archive_of(content: bytes) -> zipfile.ZipFile:
    return zipfile.ZipFile(io.BytesIO(content))
