"""A workbook sink (K03): spark writes rows of named sheets as one .xlsx package.

rows_of() turns a frame into rows of a sheet; their union, written with format("workbook"), is the package. Tasks write their rows as parts beside the target, in order within a
task; the commit joins the parts, sheet by sheet, into a package under another name and moves it over the target, so that a reader sees the old one or the whole new one. A part is
copied in pieces, whatever its size. An aborted write leaves nothing.
"""

from __future__ import annotations

import io
import uuid
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.sax.saxutils import escape, quoteattr

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from .pixels import _system

NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")
PIECE = 1 << 20
# The parts of an OOXML package.
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_RELS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'


def _text(value: Column) -> Column:
    """Escaped, without characters that XML can't hold."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        value = F.replace(value, F.lit(a), F.lit(b))
    return F.regexp_replace(value, "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\uFFFE\\uFFFF]", "")


def _cell(df: DataFrame, name: str) -> Column:
    c = F.col("`" + name.replace("`", "``") + "`")
    text = lambda v: F.concat(F.lit('<c t="inlineStr"><is><t xml:space="preserve">'), _text(v), F.lit("</t></is></c>"))
    kind = df.schema[name].dataType.simpleString()
    if kind == "boolean":
        return F.coalesce(F.concat(F.lit('<c t="b"><v>'), c.cast("int").cast("string"), F.lit("</v></c>")), F.lit("<c/>"))
    if kind.startswith(NUMBERS):
        plain = F.concat(F.lit("<c><v>"), c.cast("string"), F.lit("</v></c>"))
        whole = F.when(F.isnan(c) | (F.abs(c) == float("inf")), text(c.cast("string"))).otherwise(plain) if kind in ("float", "double") else plain
        return F.coalesce(whole, F.lit("<c/>"))
    return F.coalesce(text(c.cast("string")), F.lit("<c/>"))


def rows_of(df: DataFrame, sheet: str, number: int, order: list[str]) -> DataFrame:
    """number, sheet, place, xml of a header row and the rows of df by `order`. Places are counted within ranges of the order, so no task numbers all rows."""
    spark = df.sparkSession
    head = "<row>" + "".join(f'<c t="inlineStr"><is><t xml:space="preserve">{escape(c)}</t></is></c>' for c in df.columns) + "</row>"
    body = df.orderBy(*order).select(F.monotonically_increasing_id().alias("place"), F.concat(F.lit("<row>"), *[_cell(df, c) for c in df.columns], F.lit("</row>")).alias("xml"))
    first = spark.range(1).select(F.lit(-1).cast("long").alias("place"), F.lit(head).alias("xml"))
    return first.unionByName(body).select(F.lit(number).alias("number"), F.lit(sheet).alias("sheet"), "place", "xml")


@dataclass
class Parts(WriterCommitMessage):
    """What a task wrote: (sheet number, sheet, first place, file) of each part."""

    parts: list[tuple[int, str, int, str]]


class WorkbookWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite
        self.work = f"{path}.{uuid.uuid4().hex}.parts"

    def write(self, iterator: Iterator[Row]) -> Parts:
        system, base = _system(self.work)
        system.create_dir(base, recursive=True)
        parts: list[tuple[int, str, int, str]] = []
        out, last = None, None
        try:
            for number, sheet, place, xml in iterator:
                if out is None or last is None or number != last[0] or place < last[1]:
                    if out is not None:
                        out.close()
                    name = f"{base}/{uuid.uuid4().hex}"
                    out = system.open_output_stream(name)
                    parts.append((number, sheet, place, name))
                out.write(xml.encode())
                last = (number, place)
        finally:
            if out is not None:
                out.close()
        return Parts(parts)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, target = _system(self.path)
        _, base = _system(self.work)
        if not self.overwrite and system.get_file_info(target).type != fs.FileType.NotFound:
            self.abort(messages)
            raise FileExistsError(self.path)
        parts = sorted(p for m in messages if m for p in m.parts)
        sheets = sorted({p[:2] for p in parts})
        system.create_dir(base, recursive=True)
        made = f"{base}/package"
        with system.open_output_stream(made) as raw, zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("[Content_Types].xml", _HEAD + f'<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(sheets) + 1)) + "</Types>")
            z.writestr("_rels/.rels", _HEAD + f'<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_RELS}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
            z.writestr("xl/workbook.xml", _HEAD + f'<workbook xmlns="{_MAIN}" xmlns:r="{_RELS}"><sheets>' + "".join(f'<sheet name={quoteattr(name)} sheetId="{i}" r:id="rId{i}"/>' for i, (_, name) in enumerate(sheets, 1)) + "</sheets></workbook>")
            z.writestr("xl/_rels/workbook.xml.rels", _HEAD + f'<Relationships xmlns="{_PACKAGE}/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="{_RELS}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1)) + "</Relationships>")
            for i, sheet in enumerate(sheets, 1):
                with z.open(f"xl/worksheets/sheet{i}.xml", "w", force_zip64=True) as out:
                    out.write((_HEAD + f'<worksheet xmlns="{_MAIN}"><sheetData>').encode())
                    for p in parts:
                        if p[:2] == sheet:
                            with system.open_input_stream(p[3]) as part:
                                while piece := part.read(PIECE):
                                    out.write(piece)
                    out.write(b"</sheetData></worksheet>")
        system.move(made, target)
        system.delete_dir(base)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        system, base = _system(self.work)
        if system.get_file_info(base).type == fs.FileType.Directory:
            system.delete_dir(base)


class Workbook(DataSource):
    """Sheets of rows: number, sheet, place, xml, as rows_of() makes them."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return "number int, sheet string, place long, xml string"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return WorkbookWriter(self.options["path"], overwrite)


def write_workbook(sheets: dict[str, tuple[DataFrame, list[str]]], path: str) -> None:
    """One .xlsx of named sheets, each a frame and the columns that order its rows."""
    every: DataFrame | None = None
    for i, (name, (df, order)) in enumerate(sheets.items(), 1):
        one = rows_of(df, name, i, order)
        every = one if every is None else every.unionByName(one)
    spark: SparkSession = every.sparkSession
    spark.dataSource.register(Workbook)
    every.write.format("workbook").mode("overwrite").save(path)


def read_workbook(spark: SparkSession, path: str) -> DataFrame:
    """sheet, row (from 1), cells (as text) of the packages at a path. A package is parsed as a stream, row by row."""

    def run(batches):
        for b in batches:
            for raw in b["content"]:
                with zipfile.ZipFile(io.BytesIO(raw)) as z:
                    names = [s.get("name") for s in ET.fromstring(z.read("xl/workbook.xml")).find(f"{{{_MAIN}}}sheets")]
                    for i, name in enumerate(names, 1):
                        with z.open(f"xl/worksheets/sheet{i}.xml") as f:
                            held, n = [], 0
                            for _, e in ET.iterparse(f):
                                if e.tag == f"{{{_MAIN}}}row":
                                    n += 1
                                    held.append((name, n, [c.findtext(f"{{{_MAIN}}}is/{{{_MAIN}}}t") if c.get("t") == "inlineStr" else c.findtext(f"{{{_MAIN}}}v") for c in e]))
                                    e.clear()
                                    if len(held) == 4096:
                                        yield pd.DataFrame(held, columns=["sheet", "row", "cells"])
                                        held = []
                            if held:
                                yield pd.DataFrame(held, columns=["sheet", "row", "cells"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "sheet string, row long, cells array<string>")
