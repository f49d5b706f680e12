"""Workbooks and archives with the standard library alone."""

from __future__ import annotations

import io
import re
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions.numeric import safe_numeric
from gleanery.functions.text import text

_NUMBER = re.compile(r"-?(0|[1-9]\d*)(\.\d+)?")
_STAMP = (1980, 1, 1, 0, 0, 0)


def column_width(column: str) -> Column:
    """Aggregate: the longest value and two, between 8 and 60."""
    return F.least(F.lit(60), F.greatest(F.lit(8), F.coalesce(F.max(F.length(text(f"`{column}`"))), F.lit(0)) + 2))


def column_widths(df: DataFrame) -> DataFrame:
    """column, width of each column; the header counts as a value."""
    long = df.select(F.posexplode(F.array(*(F.length(text(f"`{c}`")) for c in df.columns))).alias("i", "n")).groupBy("i").agg(F.max("n").alias("n"))
    names = F.array(*(F.lit(c) for c in df.columns))
    return long.select(F.element_at(names, F.col("i") + 1).alias("column"), F.least(F.lit(60), F.greatest(F.lit(8), F.greatest("n", F.length(F.element_at(names, F.col("i") + 1))) + 2)).alias("width"))


def letters(i: int) -> str:
    out = ""
    while i >= 0:
        out, i = chr(65 + i % 26) + out, i // 26 - 1
    return out


def letters_of(i: Column) -> Column:
    """The letters of a 0-based column number of up to three letters."""
    at = lambda n: F.substr(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (n + 1).cast("int"), F.lit(1))
    one, two = i % 26, F.floor(i / 26) - 1
    return F.concat(F.when(i >= 702, at(F.floor(two / 26) - 1)).otherwise(""), F.when(i >= 26, at(two % 26)).otherwise(""), at(one))


def xlsx_cells(df: DataFrame, order: str, typed: bool = False) -> DataFrame:
    """row, column (0-based), xml of each cell of a sheet whose first row is the header; `order` is the 0-based place of a row."""
    columns = [c for c in df.columns if c != order]
    long = df.select((F.col(order) + 2).cast("long").alias("row"), F.posexplode(F.array(*(text(f"`{c}`") for c in columns))).alias("column", "value"))
    head = df.sparkSession.createDataFrame([(1, i, c) for i, c in enumerate(columns)], "row long, column int, value string")
    cells = long.unionByName(head)
    ref = F.concat(letters_of(F.col("column")), F.col("row").cast("string"))
    shown = F.regexp_replace("value", r"[\x00-\x08\x0b\x0c\x0e-\x1f\x{FFFE}\x{FFFF}]", "")
    for c, as_ in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        shown = F.replace(shown, F.lit(c), F.lit(as_))
    inline = F.concat(F.lit('<c r="'), ref, F.lit('" t="inlineStr"><is><t xml:space="preserve">'), shown, F.lit("</t></is></c>"))
    if typed:
        inline = F.when((F.col("row") > 1) & safe_numeric("value"), F.concat(F.lit('<c r="'), ref, F.lit('"><v>'), F.col("value"), F.lit("</v></c>"))).otherwise(inline)
    return cells.select("row", "column", inline.alias("xml"))


def cell(ref: str, value: str, typed: bool) -> str:
    if typed and _NUMBER.fullmatch(value) and len(re.sub(r"\D", "", value)) <= 15:
        return f'<c r="{ref}"><v>{value}</v></c>'
    clean = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]", "", value)
    return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(clean)}</t></is></c>'


def workbook(columns: list[str], rows: list[list[str]], freeze: bool = True, auto_filter: bool = True, widths: bool = True, typed: bool = False) -> bytes:
    """One sheet of rows that the caller has bounded; cells are text, or numbers where that loses nothing."""
    lines = [[str(c) for c in columns], *[[("" if v is None else str(v)) for v in r] for r in rows]]
    last = f"{letters(max(len(columns) - 1, 0))}{len(lines)}"
    sheet = ['<?xml version="1.0" encoding="UTF-8" standalone="yes"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main">']
    if freeze:
        sheet.append('<sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" activePane="bottomLeft" state="frozen"/></sheetView></sheetViews>')
    if widths and columns:
        sheet.append("<cols>" + "".join(f'<col min="{i + 1}" max="{i + 1}" width="{min(60, max(8, max(len(r[i]) for r in lines) + 2))}" customWidth="1"/>' for i in range(len(columns))) + "</cols>")
    sheet.append("<sheetData>" + "".join(f'<row r="{k}">' + "".join(cell(f"{letters(i)}{k}", v, typed and k > 1) for i, v in enumerate(r)) + "</row>" for k, r in enumerate(lines, 1)) + "</sheetData>")
    if auto_filter and columns:
        sheet.append(f'<autoFilter ref="A1:{last}"/>')
    sheet.append("</worksheet>")
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    office, package = "http://schemas.openxmlformats.org/officeDocument/2006/relationships", "http://schemas.openxmlformats.org/package/2006"
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    return archive(
        {
            "[Content_Types].xml": f'{head}<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{kind}.worksheet+xml"/></Types>',
            "_rels/.rels": f'{head}<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
            "xl/workbook.xml": f'{head}<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="{office}"><sheets><sheet name="Data" sheetId="1" r:id="rId1"/></sheets></workbook>',
            "xl/_rels/workbook.xml.rels": f'{head}<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{office}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
            "xl/worksheets/sheet1.xml": "".join(sheet),
        }
    )


def archive(files: dict[str, str | bytes]) -> bytes:
    """A ZIP of stored entries."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for name, data in files.items():
            z.writestr(zipfile.ZipInfo(name, _STAMP), data)
    return out.getvalue()


# Part names and namespaces above are the file format; where an export can go.
DESTINATIONS = {"download": True, "clipboard": True, "google-sheets": False}  # whether it can be used
