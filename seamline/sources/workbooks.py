"""Workbooks (XLSX): zip archives of XML, written and read without another library, many files in parallel."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .sinks import sheet_text

#: rows of a sheet below its header, at most, and of a workbook that a task writes
MOST_ROWS, FILE_ROWS = 1_048_575, 100_000
# fixed values: fill colours of the statuses of an evaluated row
STATUS_FILLS = {"TP": "C6EFCE", "FP": "FFC7CE", "FN": "FFEB9C", "TN": "E7E6E6"}

_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_RELS = "http://schemas.openxmlformats.org/package/2006/relationships"
_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_KIND = "application/vnd.openxmlformats-officedocument.spreadsheetml"


def column_name(k: int) -> str:
    """A, B, ... Z, AA, ..."""
    out = ""
    k += 1
    while k:
        k, r = divmod(k - 1, 26)
        out = chr(65 + r) + out
    return out


def _column(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]*", ref)[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


def _cell(value, ref: str, style: int) -> str:
    if value is None or isinstance(value, float) and value != value:
        return f'<c r="{ref}" s="{style}"/>' if style else ""
    s = f' s="{style}"' if style else ""
    if isinstance(value, bool):
        return f'<c r="{ref}"{s} t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float)):
        return f'<c r="{ref}"{s}><v>{value!r}</v></c>'
    text = escape(str(value)).replace("\r", "&#13;")
    return f'<c r="{ref}"{s} t="inlineStr"><is><t xml:space="preserve">{text}</t></is></c>'


def write_xlsx(columns: list[str], rows, fill_by: str | None = None, fills: dict[str, str] = STATUS_FILLS, sheet: str = "Sheet1") -> bytes:
    """A workbook of one sheet; cells of the column ``fill_by`` have the colour of their value. Too many rows are an
    error, never cut."""
    rows = list(rows)
    if len(rows) > MOST_ROWS:
        raise ValueError(f"{len(rows)} rows don't fit a sheet")
    styles = {v: k + 1 for k, v in enumerate(fills)} if fill_by else {}
    at = columns.index(fill_by) if fill_by else -1
    body = ["".join(_cell(c, f"{column_name(k)}1", 0) for k, c in enumerate(columns))]
    for n, row in enumerate(rows, 2):
        body.append("".join(_cell(v, f"{column_name(k)}{n}", styles.get(v, 0) if k == at else 0) for k, v in enumerate(row)))
    colours = "".join(f'<fill><patternFill patternType="solid"><fgColor rgb="FF{c}"/></patternFill></fill>' for c in fills.values())
    xfs = "".join(f'<xf fillId="{k}" applyFill="1"/>' for k in (0, *range(2, len(fills) + 2)))
    parts = {
        "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>'
        f'<Override PartName="/xl/workbook.xml" ContentType="{_KIND}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{_KIND}.worksheet+xml"/><Override PartName="/xl/styles.xml" ContentType="{_KIND}.styles+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{_RELS}"><Relationship Id="rId1" Type="{_OFFICE}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{_MAIN}" xmlns:r="{_OFFICE}"><sheets><sheet name="{escape(sheet, {chr(34): "&quot;"})}" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{_RELS}"><Relationship Id="rId1" Type="{_OFFICE}/worksheet" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Type="{_OFFICE}/styles" Target="styles.xml"/></Relationships>',
        "xl/styles.xml": f'<styleSheet xmlns="{_MAIN}"><fonts count="1"><font/></fonts><fills count="{len(fills) + 2}"><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill>{colours}</fills><borders count="1"><border/></borders>'
        f'<cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="{len(fills) + 1}">{xfs}</cellXfs></styleSheet>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{_MAIN}"><sheetData>' + "".join(f'<row r="{n}">{r}</row>' for n, r in enumerate(body, 1)) + "</sheetData></worksheet>",
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>' + text)
    return out.getvalue()


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _text(e) -> str:
    """All text of a string item, its runs joined, without phonetic hints."""
    return "".join((t.text or "") for r in e if _local(r.tag) in ("t", "r") for t in ([r] if _local(r.tag) == "t" else r) if _local(t.tag) == "t")


def read_xlsx(content: bytes, sheet: str | int = 0) -> list[list[tuple[str | None, str | None]]]:
    """The rows of a sheet (by name or number) as (value, fill colour) of each cell; formulas give their stored
    values, missing cells (None, None)."""
    book = zipfile.ZipFile(io.BytesIO(content))
    names = set(book.namelist())
    root = ElementTree.fromstring(book.read("xl/workbook.xml"))
    sheets = [(e.get("name"), next(v for k, v in e.attrib.items() if _local(k) == "id")) for e in root.iter() if _local(e.tag) == "sheet"]
    wanted = sheets[sheet][1] if isinstance(sheet, int) else dict(sheets)[sheet]
    target = next(e.get("Target") for e in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels")) if e.get("Id") == wanted)
    path = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
    shared = [_text(e) for e in ElementTree.fromstring(book.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
    fill_of: list[str | None] = []
    if "xl/styles.xml" in names:
        tree = ElementTree.fromstring(book.read("xl/styles.xml"))
        part = {_local(e.tag): e for e in tree}
        colours = [next((c.get("rgb", "")[-6:] for c in f.iter() if _local(c.tag) == "fgColor"), None) for f in part.get("fills", ())]
        fill_of = [colours[int(x.get("fillId", 0))] if colours else None for x in part.get("cellXfs", ())]
    out = []
    with book.open(path) as f:
        for _, row in ElementTree.iterparse(f):
            if _local(row.tag) != "row":
                continue
            cells: list[tuple[str | None, str | None]] = []
            for c in row:
                at = _column(c.get("r")) if c.get("r") else len(cells)
                cells += [(None, None)] * (at + 1 - len(cells))
                kids = {_local(e.tag): e for e in c}
                kind, v = c.get("t", "n"), kids["v"].text if "v" in kids else None
                if kind == "s" and v is not None:
                    v = shared[int(v)]
                elif kind == "inlineStr" and "is" in kids:
                    v = _text(kids["is"])
                elif kind == "b" and v is not None:
                    v = "TRUE" if v == "1" else "FALSE"
                style = int(c.get("s", 0))
                cells[at] = v, fill_of[style] if style < len(fill_of) else None
            out.append(cells)
            row.clear()
    return out


def as_workbooks(df: DataFrame, name: str = "part", fill_by: str | None = None, rows: int = FILE_ROWS) -> DataFrame:
    """(path, content): the rows of ``df`` as workbooks of up to ``rows`` rows, each written by the task that has
    them; strings lose their control characters."""
    columns = df.columns

    def run(batches):
        held, n = [], 0
        stamp = None

        def out(pdf):
            values = pdf.astype(object).where(pdf.notna(), None)
            cells = ([v.item() if hasattr(v, "item") else v for v in r] for r in values.itertuples(index=False, name=None))
            return pd.DataFrame({"path": [f"{name}-{stamp}-{n}.xlsx"], "content": [write_xlsx(columns, cells, fill_by)]})

        for pdf in batches:
            from pyspark import TaskContext

            stamp = TaskContext.get().partitionId()
            held.append(pdf)
            while sum(map(len, held)) >= rows:
                whole = pd.concat(held, ignore_index=True)
                held = [whole.iloc[rows:]]
                yield out(whole.iloc[:rows])
                n += 1
        if sum(map(len, held)):
            yield out(pd.concat(held, ignore_index=True))

    return sheet_text(df).mapInPandas(run, "path string, content binary")


def sheet_rows(files: DataFrame, columns: list[str], sheet: str | int = 0, fills: bool = False) -> DataFrame:
    """(path, row, the columns as strings) of a sheet of each workbook (path, content), whose stripped headers name the
    columns; a column that a workbook lacks is null. ``fills``: a further column ``fills`` of the colours."""
    fields = [T.StructField("path", T.StringType()), T.StructField("row", T.IntegerType()), *[T.StructField(c, T.StringType()) for c in columns]]
    if fills:
        fields.append(T.StructField("fills", T.ArrayType(T.StringType())))

    def run(batches):
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                head, *rows = read_xlsx(content, sheet) or [[]]
                where = {}
                for k, (v, _) in enumerate(head):
                    if v is not None:
                        where.setdefault(v.strip(), k)
                out = []
                for n, r in enumerate(rows, 1):
                    r = r + [(None, None)] * (len(head) - len(r))
                    cells = [r[where[c]] if c in where else (None, None) for c in columns]
                    out.append((path, n, *(v for v, _ in cells), *([[f for _, f in cells]] if fills else [])))
                yield pd.DataFrame(out, columns=[f.name for f in fields], dtype=object)

    return files.select("path", "content").mapInPandas(run, T.StructType(fields))


def read_workbooks(spark: SparkSession, path: str, columns: list[str], sheet: str | int = 0) -> DataFrame:
    return sheet_rows(spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.xlsx").load(path), columns, sheet)


def write_files(files: DataFrame, folder: str) -> int:
    """Writes (path, content) rows as files of a folder that driver and executors share, each under another name until
    it is whole; gives how many."""

    def run(batches):
        import os
        import uuid

        from pyarrow import fs

        n = 0
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                system, root = (fs.LocalFileSystem(), "/" + folder.split(":", 1)[1].lstrip("/")) if folder.startswith("file:") else fs.FileSystem.from_uri(folder)
                whole = f"{root.rstrip('/')}/{path}"
                system.create_dir(os.path.dirname(whole), recursive=True)
                temp = f"{whole}.{uuid.uuid4().hex}.tmp"
                with system.open_output_stream(temp) as f:
                    f.write(content)
                system.move(temp, whole)
                n += 1
        yield pd.DataFrame({"n": [n]})

    return files.select("path", "content").mapInPandas(run, "n long").agg(F.sum("n")).head()[0] or 0
