"""A Spark data source for workbooks: spark.read.format("workbook") gives the cells of .xlsx files.

Rows are doc, sheet (order from 0), sheet_name, row, col (from 0), value, vtype (str, num, bool, formula) and
n_merged, the merged ranges of the sheet. Formulas are not evaluated. Files over max_bytes are read without
merged ranges (null); of each file the first max_sheets sheets are read. A file is a partition.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

MAX_BYTES, MAX_SHEETS = 40 << 20, 40
SCHEMA = "doc string, sheet int, sheet_name string, row int, col int, value string, vtype string, n_merged int"
_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _column(letters: str) -> int:
    n = 0
    for c in letters:
        n = n * 26 + ord(c) - 64
    return n - 1


def _text(node) -> str:
    return "".join(t.text or "" for t in node.iter(f"{_NS}t"))


def read_cells(name: str, content: bytes, max_bytes: int = MAX_BYTES, max_sheets: int = MAX_SHEETS) -> Iterator[tuple]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        strings = [_text(si) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in z.namelist() else []
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        sheets = ElementTree.fromstring(z.read("xl/workbook.xml")).find(f"{_NS}sheets")
        for i, sheet in enumerate(list(sheets)[:max_sheets]):
            target = targets[sheet.get(_REL)]
            root = ElementTree.fromstring(z.read(target.lstrip("/") if target.startswith("/") else posixpath.join("xl", target)))
            merged = None if len(content) > max_bytes else len(root.findall(f"{_NS}mergeCells/{_NS}mergeCell"))
            for c in root.iter(f"{_NS}c"):
                letters, row = re.fullmatch(r"([A-Z]+)(\d+)", c.get("r")).groups()
                v, f, kind = c.find(f"{_NS}v"), c.find(f"{_NS}f"), c.get("t", "n")
                if f is not None:
                    value, vtype = f"={f.text or ''}", "formula"
                elif kind == "inlineStr":
                    value, vtype = _text(c), "str"
                elif v is None or v.text is None:
                    continue
                elif kind == "s":
                    value, vtype = strings[int(v.text)], "str"
                else:
                    value, vtype = v.text, {"b": "bool", "n": "num"}.get(kind, "str")
                if value.strip():
                    yield name, i, sheet.get("name"), int(row) - 1, _column(letters), value, vtype, merged


class _File(InputPartition):
    def __init__(self, path: str, content: bytes):
        self.path, self.content = path, content


class WorkbookReader(DataSourceReader):
    def __init__(self, options):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        """The files under path that end in .xlsx: a folder of files on the driver's own file system."""
        from pathlib import Path

        path = Path(self.options["path"].removeprefix("file://"))
        found = sorted(path.glob("*.xlsx")) if path.is_dir() else [path]
        return [_File(p.name, p.read_bytes()) for p in found] or [_File("", b"")]

    def read(self, partition: _File) -> Iterator[tuple]:
        if partition.content:
            yield from read_cells(partition.path, partition.content, int(self.options.get("maxBytes", MAX_BYTES)), int(self.options.get("maxSheets", MAX_SHEETS)))


class WorkbookSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WorkbookReader(self.options)


def cells_of(files, max_bytes: int = MAX_BYTES, max_sheets: int = MAX_SHEETS):
    """The same cells from binaryFile rows (path, content): for any store that Spark reads, and many files."""

    def run(batches):
        import pandas as pd

        columns = [c.split(" ")[0] for c in SCHEMA.split(", ")]
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                yield pd.DataFrame(list(read_cells(posixpath.basename(path), content, max_bytes, max_sheets)), columns=columns)

    return files.select("path", "content").mapInPandas(run, SCHEMA)
