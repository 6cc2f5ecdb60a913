"""Spreadsheets without a library: a Spark data source that reads the first sheet of .xlsx files, and a small writer.

Registered as ``xlsx``: spark.dataSource.register(XlsxDataSource); spark.read.format("xlsx").load(path). Each file is a partition. Columns are
text, by the header row; dates stay serial numbers. A workbook without rows has no columns and is refused.
"""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator
from glob import glob
from io import BytesIO
from pathlib import Path
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .. import constants as K

_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}


def _column(ref: str) -> int:
    n = 0
    for ch in re.match("[A-Z]+", ref).group():
        n = 26 * n + ord(ch) - 64
    return n - 1


def read_rows(data: bytes) -> Iterator[list[str | None]]:
    """The rows of the first sheet, cells as text."""
    with zipfile.ZipFile(BytesIO(data)) as z:
        names = z.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", _NS)]
        sheet = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n).group()))[0]
        for row in ET.fromstring(z.read(sheet)).iterfind("m:sheetData/m:row", _NS):
            out: list[str | None] = []
            for c in row.findall("m:c", _NS):
                at = _column(c.get("r")) if c.get("r") else len(out)
                out += [None] * (at - len(out))
                kind, v = c.get("t"), c.find("m:v", _NS)
                if kind == "inlineStr":
                    value = "".join(t.text or "" for t in c.iter(f"{{{_NS['m']}}}t"))
                elif v is None:
                    value = None
                elif kind == "s":
                    value = shared[int(v.text)]
                else:
                    value = v.text
                    if kind is None and value is not None and re.fullmatch(r"-?\d+\.0+", value):
                        value = value.split(".")[0]
                out.append(value)
            yield out


def canonical(header: str | None, at: int) -> str:
    """A header's name: trimmed, lower case, blanks as underscores, known spellings by their common name."""
    clean = re.sub(" ", "_", (header or "").strip().lower()) or f"column_{at}"
    return next((name for name, spellings in K.HEADERS.items() if clean in spellings), clean)


def canonical_headers(headers: list[str | None]) -> list[str]:
    names = [canonical(h, i) for i, h in enumerate(headers)]
    if twice := {n for n in names if names.count(n) > 1}:
        raise ValueError(f"several columns are named {', '.join(sorted(twice))}")
    return names


class _File(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class XlsxReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType) -> None:
        self.options, self.schema = options, schema

    def partitions(self) -> list[_File]:
        return [_File(p) for p in _files(self.options["path"])]

    def read(self, partition: _File) -> Iterator[tuple]:
        rows = read_rows(Path(partition.path).read_bytes())
        names = canonical_headers(next(rows, []))
        wanted = [names.index(f.name) if f.name in names else None for f in self.schema.fields[1:]]
        for i, row in enumerate(rows):
            yield (i, *(row[w] if w is not None and w < len(row) else None for w in wanted))


def _files(path: str) -> list[str]:
    path = path.removeprefix("file://")
    found = sorted(glob(f"{path}/*.xlsx")) if Path(path).is_dir() else sorted(glob(path))
    if not found:
        raise FileNotFoundError(path)
    return found


class XlsxDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "xlsx"

    def schema(self) -> StructType:
        names = canonical_headers(next(read_rows(Path(_files(self.options["path"])[0]).read_bytes()), []))
        if not names:
            raise ValueError("the sheet has no header row")
        return StructType([StructField("row_idx", LongType()), *(StructField(n, StringType()) for n in names)])

    def reader(self, schema: StructType) -> XlsxReader:
        return XlsxReader(dict(self.options), schema)


_CONTENT = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'


def _letters(i: int) -> str:
    out = ""
    i += 1
    while i:
        i, r = divmod(i - 1, 26)
        out = chr(65 + r) + out
    return out


def write_xlsx(path: str | Path, sheets: dict[str, tuple[list[str], list[tuple]]], fills: dict[str, list[list[str | None]]] | None = None, widths: dict[str, list[int]] | None = None) -> Path:
    """Sheets by name, each with its titles and rows; ``fills`` gives cells a background by hex code. For results of a size to be read by people."""
    fills, widths = fills or {}, widths or {}
    codes = sorted({c for rows in fills.values() for row in rows for c in row if c})
    style = {c: i + 1 for i, c in enumerate(codes)}

    def cell(ref: str, value, code: str | None) -> str:
        s = f' s="{style[code]}"' if code in style else ""
        if value is None:
            return f'<c r="{ref}"{s}/>'
        if isinstance(value, bool) or not isinstance(value, (int, float)):
            return f'<c r="{ref}" t="inlineStr"{s}><is><t xml:space="preserve">{escape(str(value))}</t></is></c>'
        return f'<c r="{ref}"{s}><v>{value}</v></c>'

    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{i + 1}.xml" ContentType="{kind}.worksheet+xml"/>' for i in range(len(sheets)))
        z.writestr("[Content_Types].xml", f'{_CONTENT}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="{kind}.styles+xml"/>{parts}</Types>')
        rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
        z.writestr("_rels/.rels", f'{_CONTENT}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'{_CONTENT}<workbook xmlns="{_NS["m"]}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{escape(n[:31])}" sheetId="{i + 1}" r:id="rId{i + 1}"/>' for i, n in enumerate(sheets)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", f'{_CONTENT}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="rId{i + 1}" Type="{rel}/worksheet" Target="worksheets/sheet{i + 1}.xml"/>' for i in range(len(sheets))) + f'<Relationship Id="rId{len(sheets) + 1}" Type="{rel}/styles" Target="styles.xml"/></Relationships>')
        filled = "".join(f'<fill><patternFill patternType="solid"><fgColor rgb="FF{c.lstrip("#")}"/></patternFill></fill>' for c in codes)
        z.writestr("xl/styles.xml", f'{_CONTENT}<styleSheet xmlns="{_NS["m"]}"><fonts count="1"><font/></fonts><fills count="{len(codes) + 2}"><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill>{filled}</fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="{len(codes) + 1}"><xf/>' + "".join(f'<xf fillId="{i + 2}" applyFill="1"/>' for i in range(len(codes))) + "</cellXfs></styleSheet>")
        for i, (name, (titles, rows)) in enumerate(sheets.items()):
            own = fills.get(name, [])
            cols = "".join(f'<col min="{j + 1}" max="{j + 1}" width="{w}" customWidth="1"/>' for j, w in enumerate(widths.get(name, [])))
            body = [f'<row r="1">{"".join(cell(f"{_letters(j)}1", t, None) for j, t in enumerate(titles))}</row>']
            for r, row in enumerate(rows):
                body.append(f'<row r="{r + 2}">{"".join(cell(f"{_letters(j)}{r + 2}", v, own[r][j] if r < len(own) and j < len(own[r]) else None) for j, v in enumerate(row))}</row>')
            z.writestr(f"xl/worksheets/sheet{i + 1}.xml", f'{_CONTENT}<worksheet xmlns="{_NS["m"]}">{f"<cols>{cols}</cols>" if cols else ""}<sheetData>{"".join(body)}</sheetData></worksheet>')
    return Path(path)
