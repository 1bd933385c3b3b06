"""Workbooks and word-processor documents as DataFrames, and the workbook sink. Standard library only."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from datetime import datetime, timedelta
from itertools import chain, islice
from typing import NamedTuple
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROW_SCHEMA = "file_idx long, path string, kind string, sheet_idx int, sheet string, row_idx int, style string, values array<string>"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_DATE_FORMATS = {*range(14, 23), *range(45, 48)}


def clean(text: str) -> str:
    return re.sub(r"\s+", " ", text.replace("\xa0", " ").replace("​", "")).strip()


def _xml(z: zipfile.ZipFile, name: str) -> ET.Element | None:
    return ET.fromstring(z.read(name)) if name in z.namelist() else None


def _column(ref: str) -> int:
    n = 0
    for c in ref:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n - 1


def _date_styles(z: zipfile.ZipFile) -> set[int]:
    styles = _xml(z, "xl/styles.xml")
    if styles is None:
        return set()
    bare = lambda code: re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", code)
    dates = _DATE_FORMATS | {int(f.get("numFmtId")) for f in styles.iter(f"{_S}numFmt") if re.search("[ymdhs]", bare(f.get("formatCode", "")), re.I)}
    formats = styles.find(f"{_S}cellXfs")
    return {i for i, x in enumerate(formats if formats is not None else []) if int(x.get("numFmtId", 0)) in dates}


def _number(raw: str, is_date: bool) -> str:
    if is_date:
        return str(datetime(1899, 12, 30) + timedelta(seconds=round(float(raw) * 86400)))
    return str(float(raw)) if re.search("[.eE]", raw) else raw


def workbook_rows(content: bytes) -> Iterator[tuple[int, str, int, list[str]]]:
    """(sheet number, sheet name, row number from 0, cell texts) of every row up to the last one, blank rows too."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = _xml(z, "xl/sharedStrings.xml")
        strings = ["".join(t.text or "" for t in si.iter(f"{_S}t")) for si in shared.iter(f"{_S}si")] if shared is not None else []
        dates = _date_styles(z)
        rels = {r.get("Id"): r.get("Target") for r in _xml(z, "xl/_rels/workbook.xml.rels")}
        for number, sheet in enumerate(_xml(z, "xl/workbook.xml").iter(f"{_S}sheet")):
            target = rels[sheet.get(f"{_R}id")]
            root = _xml(z, target.lstrip("/") if target.startswith("/") else f"xl/{target}")
            at = 0
            for row in root.iter(f"{_S}row"):
                here = int(row.get("r", at + 1)) - 1
                for blank in range(at, here):
                    yield number, sheet.get("name"), blank, []
                cells: list[str] = []
                for c in row.iter(f"{_S}c"):
                    place = _column(c.get("r", "")) if c.get("r") else len(cells)
                    cells += [""] * (place - len(cells))
                    value, kind = c.find(f"{_S}v"), c.get("t", "n")
                    raw = value.text if value is not None and value.text else ""
                    if kind == "inlineStr":
                        raw = "".join(t.text or "" for t in c.iter(f"{_S}t"))
                    elif kind == "s" and raw:
                        raw = strings[int(raw)]
                    elif kind == "b" and raw:
                        raw = str(raw == "1")
                    elif kind == "n" and raw:
                        raw = _number(raw, int(c.get("s", 0)) in dates)
                    cells.append(clean(raw))
                yield number, sheet.get("name"), here, cells
                at = here + 1


def _paragraph(p: ET.Element) -> str:
    part = {f"{_W}t": lambda x: x.text or "", f"{_W}tab": lambda _: "\t", f"{_W}br": lambda _: "\n", f"{_W}cr": lambda _: "\n"}
    return "".join(part[x.tag](x) for r in p.iter(f"{_W}r") for x in r if x.tag in part)


def document_rows(content: bytes) -> Iterator[tuple[str, int, int, str, list[str]]]:
    """(`paragraph` or `table`, table number, number from 0, style name, texts). A cell that spans columns is given once for
    each of them; one that goes on from the row above repeats that text."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        styles = _xml(z, "word/styles.xml")
        names, default = {}, "Normal"
        for s in styles.iter(f"{_W}style") if styles is not None else []:
            name = s.find(f"{_W}name").get(f"{_W}val")
            name = re.sub("^heading ", "Heading ", name)
            names[s.get(f"{_W}styleId")] = name
            if s.get(f"{_W}type") == "paragraph" and s.get(f"{_W}default") == "1":
                default = name
        n = tables = 0
        for x in _xml(z, "word/document.xml").find(f"{_W}body"):
            if x.tag == f"{_W}p":
                style = x.find(f"{_W}pPr/{_W}pStyle")
                yield "paragraph", 0, n, names.get(style.get(f"{_W}val"), default) if style is not None else default, [clean(_paragraph(x))]
                n += 1
            elif x.tag == f"{_W}tbl":
                above: list[str] = []
                for i, tr in enumerate(x.findall(f"{_W}tr")):
                    row: list[str] = []
                    for tc in tr.findall(f"{_W}tc"):
                        span, merge = tc.find(f"{_W}tcPr/{_W}gridSpan"), tc.find(f"{_W}tcPr/{_W}vMerge")
                        goes_on = merge is not None and merge.get(f"{_W}val", "continue") == "continue" and len(above) > len(row)
                        text = above[len(row)] if goes_on else clean("\n".join(_paragraph(p) for p in tc.findall(f"{_W}p")))
                        row += [text] * (int(span.get(f"{_W}val")) if span is not None else 1)
                    yield "table", tables, i, "", row
                    above = row
                tables += 1


def _decode(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for file_idx, path, content in zip(pdf["file_idx"], pdf["path"], pdf["content"], strict=True):
            ext = re.sub(r"^.*(\.[^.\/]*)$", r"\1", path).lower() if "." in path.rsplit("/", 1)[-1] else ""
            rows: list[tuple] = []
            try:
                if ext in (".xlsx", ".xls"):
                    rows = [("row", s, name, r, "", v) for s, name, r, v in workbook_rows(content)]
                elif ext == ".docx":
                    rows = [(k, t, "", r, style, v) for k, t, r, style, v in document_rows(content)]
                else:
                    rows = [("error", 0, "", 0, "", [f"Format non reconnu: {ext}"])]
            except Exception as e:  # one broken file must not stop the others
                rows = [("error", 0, "", 0, "", [f"Fichier illisible: {path.rsplit('/', 1)[-1]} ({type(e).__name__})"])]
            yield pd.DataFrame([(file_idx, path, *r) for r in rows], columns=["file_idx", "path", "kind", "sheet_idx", "sheet", "row_idx", "style", "values"])


def read_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """All rows, paragraphs and tables of workbooks (.xlsx) and documents (.docx), in the order of paths, whatever characters their
    names have; an unreadable, unknown or missing file gives one `error` row. Each file is decoded by one task."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    known = []
    for given in paths:
        path = jvm.org.apache.hadoop.fs.Path(given)
        fs = path.getFileSystem(conf)
        known.append((fs.makeQualified(path).toString(), fs.exists(path)))
    order = spark.createDataFrame([(i, p) for i, (p, _) in enumerate(known)], "file_idx long, path string")
    there = sorted({p for p, found in known if found})
    missing = [(i, p, "error", 0, "", 0, "", [f"Fichier introuvable: {p.rsplit('/', 1)[-1]}"]) for i, (p, found) in enumerate(known) if not found]
    lost = spark.createDataFrame(missing, ROW_SCHEMA)
    if not there:
        return lost
    files = spark.read.format("binaryFile").load([re.sub(r"([\\{}\[\]*?])", r"\\\1", p) for p in there]).select("path", "content")
    return files.join(F.broadcast(order), "path").select("file_idx", "path", "content").mapInPandas(_decode, ROW_SCHEMA).unionByName(lost)


# Fills of the printed directory, bounds of its column widths, how many rows they follow from, the width of the journal.
FILLS = {"header": "2F5496", "soft": "FFF2CC", "conflict": "FFE699", "inferred": "DEEBF7", "phonetic": "E7E6E6", "fuzzy": "E7E6E6"}
NARROWEST, WIDEST, WIDTH_ROWS, JOURNAL_WIDTH = 8, 40, 49, 100
#: Styles of a cell without fill, besides the fills' own.
PLAIN, BODY = "", "body"
_STYLES = [PLAIN, BODY, *FILLS]
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'


class Sheet(NamedTuple):
    """rows: lists of cells (text, style) or (text, style, comment). frozen: rows and columns that stay in view. filter_row: the row
    with filters on its cells, from 1. width: of all columns; else each follows from its first rows."""

    name: str
    rows: Iterable[list[tuple]]
    frozen: int = 0
    frozen_columns: int = 0
    filter_row: int = 0
    width: int | None = None


def _letters(i: int) -> str:
    return (_letters(i // 26 - 1) if i >= 26 else "") + chr(65 + i % 26)


def column_widths(rows: list[list[tuple]]) -> list[int]:
    """The longest line of each column's texts, some room added, within bounds."""
    n = max(map(len, rows), default=0)
    longest = [max((len(line) for r in rows if i < len(r) for line in r[i][0].split("\n")), default=0) for i in range(n)]
    return [min(max(x + 2, NARROWEST), WIDEST) for x in longest]


def _sheet(out, sheet: Sheet) -> list[tuple[int, int, str]]:
    """Writes a sheet's rows as they come; returns (row, column, text) of its comments."""
    rows = iter(sheet.rows)
    first = list(islice(rows, WIDTH_ROWS))
    widths = column_widths(first) if sheet.width is None else [sheet.width] * max(map(len, first), default=0)
    corner = f"{_letters(sheet.frozen_columns)}{sheet.frozen + 1}"
    split = (f' xSplit="{sheet.frozen_columns}"' if sheet.frozen_columns else "") + (f' ySplit="{sheet.frozen}"' if sheet.frozen else "")
    pane = f'<pane{split} topLeftCell="{corner}" activePane="{"bottomRight" if sheet.frozen_columns else "bottomLeft"}" state="frozen"/>' if split else ""
    columns = "".join(f'<col min="{i}" max="{i}" width="{w}" customWidth="1"/>' for i, w in enumerate(widths, 1))
    out.write(f'{_HEAD}<worksheet xmlns="{_MAIN}" xmlns:r="{_OFFICE}"><sheetViews><sheetView workbookViewId="0">{pane}</sheetView></sheetViews>{f"<cols>{columns}</cols>" if columns else ""}<sheetData>'.encode())
    comments, n, wide = [], 0, 0
    for n, row in enumerate(chain(first, rows), 1):
        cells = ""
        for i, (text, style, *more) in enumerate(row):
            if text or style in FILLS:
                cells += f'<c r="{_letters(i)}{n}" t="inlineStr" s="{_STYLES.index(style)}"><is><t xml:space="preserve">{escape(text)}</t></is></c>'
            comments += [(n, i, c) for c in more if c]
        wide = max(wide, len(row))
        out.write(f'<row r="{n}">{cells}</row>'.encode())
    filters = f'<autoFilter ref="A{sheet.filter_row}:{_letters(wide - 1)}{n}"/>' if sheet.filter_row and n > sheet.filter_row else ""
    out.write(f'</sheetData>{filters}{"<legacyDrawing r:id=" + chr(34) + "rId1" + chr(34) + "/>" if comments else ""}</worksheet>'.encode())
    return comments


def _write_comments(z: zipfile.ZipFile, number: int, comments: list[tuple[int, int, str]]) -> None:
    listed = "".join(f'<comment ref="{_letters(c)}{r}" authorId="0"><text><t xml:space="preserve">{escape(t)}</t></text></comment>' for r, c, t in comments)
    z.writestr(f"xl/comments{number}.xml", f'{_HEAD}<comments xmlns="{_MAIN}"><authors><author>Annuaire</author></authors><commentList>{listed}</commentList></comments>')
    box = lambda r, c: f'<v:shape id="c{r}_{c}" type="#note" style="visibility:hidden"><x:ClientData ObjectType="Note"><x:Row>{r - 1}</x:Row><x:Column>{c}</x:Column></x:ClientData></v:shape>'
    boxes = "".join(box(r, c) for r, c, _ in comments)
    z.writestr(f"xl/drawings/vmlDrawing{number}.vml", f'<xml xmlns:v="urn:schemas-microsoft-com:vml" xmlns:x="urn:schemas-microsoft-com:office:excel"><v:shapetype id="note" coordsize="21600,21600" path="m,l,21600r21600,l21600,xe"/>{boxes}</xml>')
    z.writestr(f"xl/worksheets/_rels/sheet{number}.xml.rels", f'{_HEAD}<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_OFFICE}/vmlDrawing" Target="../drawings/vmlDrawing{number}.vml"/><Relationship Id="rId2" Type="{_OFFICE}/comments" Target="../comments{number}.xml"/></Relationships>')


def _styles() -> str:
    solid = "".join(f'<fill><patternFill patternType="solid"><fgColor rgb="FF{c}"/></patternFill></fill>' for c in FILLS.values())
    line = lambda side: f'<{side} style="thin"><color rgb="FFD9D9D9"/></{side}>'
    top = '<alignment vertical="top" wrapText="1"/>'
    middle = '<alignment horizontal="center" vertical="center" wrapText="1"/>'
    xf = lambda font, fill, border, alignment: f'<xf numFmtId="49" fontId="{font}" fillId="{fill}" borderId="{border}" xfId="0" applyAlignment="1">{alignment}</xf>'
    formats = xf(0, 0, 0, "") + xf(0, 0, 1, top) + "".join(xf(1, i, 0, middle) if f == "header" else xf(0, i, 1, top) for i, f in enumerate(FILLS, 2))
    fonts = '<fonts count="2"><font><sz val="10"/><name val="Calibri"/></font><font><b/><sz val="11"/><color rgb="FFFFFFFF"/><name val="Calibri"/></font></fonts>'
    fills = f'<fills count="{len(FILLS) + 2}"><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill>{solid}</fills>'
    borders = f'<borders count="2"><border/><border>{"".join(map(line, ("left", "right", "top", "bottom")))}</border></borders>'
    return f'{_HEAD}<styleSheet xmlns="{_MAIN}">{fonts}{fills}{borders}<cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="{len(_STYLES)}">{formats}</cellXfs></styleSheet>'


@contextmanager
def _open(path: str):
    """A file to write, by a path or by the address of a file in any store that pyarrow knows."""
    if "://" not in path:
        with open(path, "wb") as out:
            yield out
    else:
        from pyarrow import fs

        store, place = fs.FileSystem.from_uri(path)
        store.create_dir(place.rsplit("/", 1)[0], recursive=True)
        with store.open_output_stream(place) as out:
            yield out


def write_workbook(path: str, sheets: Iterable[tuple]) -> None:
    """One workbook of Sheets (or tuples of their fields). Rows are streamed; comments are held until their sheet ends."""
    names, noted = [], []
    with _open(path) as file, zipfile.ZipFile(file, "w", zipfile.ZIP_DEFLATED) as z:
        for number, fields in enumerate(sheets, 1):
            sheet = Sheet(*fields)
            names.append(sheet.name)
            with z.open(f"xl/worksheets/sheet{number}.xml", "w", force_zip64=True) as out:
                comments = _sheet(out, sheet)
            if comments:
                noted.append(number)
                _write_comments(z, number, comments)
        numbers = range(1, len(names) + 1)
        z.writestr("xl/styles.xml", _styles())
        listed = "".join(f'<sheet name="{escape(n)}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(names, 1))
        z.writestr("xl/workbook.xml", f'{_HEAD}<workbook xmlns="{_MAIN}" xmlns:r="{_OFFICE}"><sheets>{listed}</sheets></workbook>')
        links = "".join(f'<Relationship Id="rId{i}" Type="{_OFFICE}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in numbers)
        z.writestr("xl/_rels/workbook.xml.rels", f'{_HEAD}<Relationships xmlns="{_PACKAGE}/relationships">{links}<Relationship Id="rId{len(names) + 1}" Type="{_OFFICE}/styles" Target="styles.xml"/></Relationships>')
        z.writestr("_rels/.rels", f'{_HEAD}<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_OFFICE}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{kind}.worksheet+xml"/>' for i in numbers) + "".join(f'<Override PartName="/xl/comments{i}.xml" ContentType="{kind}.comments+xml"/>' for i in noted)
        z.writestr("[Content_Types].xml", f'{_HEAD}<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="vml" ContentType="application/vnd.openxmlformats-officedocument.vmlDrawing"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="{kind}.styles+xml"/>{parts}</Types>')
