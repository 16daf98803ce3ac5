"""Minimal XLSX workbooks written inside tasks, as input for the workbook reader."""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Iterator, Mapping
from datetime import date, datetime
from xml.sax.saxutils import escape, quoteattr

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Day number of 1 January 1970.
_DAYS_TO_1970 = 25_569
# Namespaces and content types of the workbook format.
_TYPES = (
    '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types">'
    '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
    '<Default Extension="xml" ContentType="application/xml"/></Types>'
)
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def workbook(rows: list[list], sheet: str = "data", shared: bool = True, formats: Mapping[int, str | int] | None = None,
             from_1904: bool = False) -> bytes:
    """One sheet; numbers stay numbers, dates become day numbers, None leaves the cell out.

    ``formats`` gives columns a number format: a code, or the number of a built-in one.
    """
    strings: dict[str, int] = {}
    formats = dict(formats or {})
    styles = {column: n for n, column in enumerate(formats, start=1)}
    lines = []
    for r, row in enumerate(rows, start=1):
        cells = []
        for c, value in enumerate(row):
            ref = f'{_letters(c)}{r}"' + (f' s="{styles[c]}"' if c in styles else "")
            if value is None:
                continue
            if isinstance(value, bool):
                cells.append(f'<c r="{ref} t="b"><v>{int(value)}</v></c>')
            elif isinstance(value, (date, datetime)):
                cells.append(f'<c r="{ref}><v>{_day_number(value, from_1904)}</v></c>')
            elif isinstance(value, (int, float)):
                cells.append(f'<c r="{ref}><v>{value}</v></c>')
            elif shared:
                cells.append(f'<c r="{ref} t="s"><v>{strings.setdefault(str(value), len(strings))}</v></c>')
            else:
                cells.append(f'<c r="{ref} t="inlineStr"><is><t>{escape(str(value))}</t></is></c>')
        lines.append(f'<row r="{r}">{"".join(cells)}</row>')
    return _packed("".join(lines).encode(), [escape(s) for s in strings], sheet, formats, from_1904)


def _packed(rows: bytes, strings: list[str], sheet: str, formats: Mapping[int, str | int], from_1904: bool = False) -> bytes:
    """The parts of a workbook as one archive; strings come escaped."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=1) as book:
        book.writestr("[Content_Types].xml", _TYPES)
        book.writestr(
            "xl/workbook.xml",
            f'<workbook xmlns="{_MAIN}" xmlns:r="{_REL}"><workbookPr date1904="{int(from_1904)}"/>'
            f'<sheets><sheet name="{sheet}" sheetId="1" r:id="rId1"/></sheets></workbook>',
        )
        book.writestr(
            "xl/_rels/workbook.xml.rels",
            '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
            f'<Relationship Id="rId1" Type="{_REL}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        )
        own = {code: 164 + n for n, code in enumerate(code for code in formats.values() if isinstance(code, str))}
        codes = "".join(f"<numFmt numFmtId=\"{n}\" formatCode={quoteattr(code)}/>" for code, n in own.items())
        used = "".join(f'<xf numFmtId="{own.get(code, code)}"/>' for code in (0, *formats.values()))
        book.writestr("xl/styles.xml", f'<styleSheet xmlns="{_MAIN}"><numFmts>{codes}</numFmts><cellXfs>{used}</cellXfs></styleSheet>')
        items = "".join(f"<si><t>{s}</t></si>" for s in strings)
        book.writestr("xl/sharedStrings.xml", f'<sst xmlns="{_MAIN}">{items}</sst>')
        book.writestr("xl/worksheets/sheet1.xml", b'<worksheet xmlns="%b"><sheetData>%b</sheetData></worksheet>' % (_MAIN.encode(), rows))
    return out.getvalue()


def _day_number(value: date, from_1904: bool) -> float:
    moment = value if isinstance(value, datetime) else datetime(value.year, value.month, value.day)
    days = (moment - (datetime(1904, 1, 1) if from_1904 else datetime(1899, 12, 30))).total_seconds() / 86400
    return int(days) if days == int(days) else days


def _letters(index: int) -> str:
    name = ""
    index += 1
    while index:
        index, rest = divmod(index - 1, 26)
        name = chr(65 + rest) + name
    return name


def batch_workbook(batch: pa.RecordBatch, sheet: str = "data", formats: Mapping[int, str | int] | None = None) -> bytes:
    """The workbook that ``workbook`` makes of a batch's names and rows, made a column at a time."""
    formats = dict(formats or {})
    styles = {column: f' s="{n}"' for n, column in enumerate(formats, start=1)}
    numbers = pa.array(np.arange(2, batch.num_rows + 2)).cast(pa.string())
    strings = [escape(name) for name in batch.schema.names]
    names = "".join(f'<c r="{_letters(c)}1"{styles.get(c, "")} t="s"><v>{c}</v></c>' for c in range(batch.num_columns))
    cells = []
    for c, column in enumerate(batch.columns):
        values, kind = _cell_values(column, strings)
        pieces = [f'<c r="{_letters(c)}', numbers, f'"{styles.get(c, "")}{kind}><v>', values, "</v></c>", ""]
        cells.append(pc.binary_join_element_wise(*pieces))
    lines = pc.binary_join_element_wise('<row r="', numbers, '">', *cells, "</row>", "", null_handling="replace", null_replacement="")
    ends = np.frombuffer(lines.buffers()[1], np.int32)
    body = memoryview(lines.buffers()[2] or b"")[ends[lines.offset] : ends[lines.offset + len(lines)]]
    return _packed(b'<row r="1">%b</row>%b' % (names.encode(), body), strings, sheet, formats)


def _cell_values(column: pa.Array, strings: list[str]) -> tuple[pa.Array, str]:
    """What stands in the cells of a column, and their type; texts are added to ``strings``."""
    kind = column.type
    if pa.types.is_boolean(kind):
        return column.cast(pa.int8()).cast(pa.string()), ' t="b"'
    if pa.types.is_integer(kind):
        return column.cast(pa.string()), ""
    if pa.types.is_floating(kind):
        column = column.cast(pa.float64())
        return pc.if_else(pc.is_nan(column), None, column).cast(pa.string()), ""
    if pa.types.is_date32(kind):
        return pc.add(column.cast(pa.int32()).cast(pa.int64()), _DAYS_TO_1970).cast(pa.string()), ""
    if pa.types.is_timestamp(kind):
        local = (pc.local_timestamp(column) if kind.tz else column).cast(pa.timestamp("us")).cast(pa.int64())
        seconds = pc.divide(pc.add(local, _DAYS_TO_1970 * 86_400_000_000).cast(pa.float64()), 1e6)
        return pc.divide(seconds, 86_400.0).cast(pa.string()), ""
    if not pa.types.is_string(kind):
        column = pa.array([None if v is None else str(v) for v in column.to_pylist()], pa.string())
    found = column.dictionary_encode()
    before, texts = len(strings), found.dictionary
    for sign, entity in (("&", "&amp;"), (">", "&gt;"), ("<", "&lt;")):
        texts = pc.replace_substring(texts, sign, entity)
    strings.extend(texts.to_pylist())
    return pc.add(found.indices.cast(pa.int64()), before).cast(pa.string()), ' t="s"'


def write_workbooks(df: DataFrame, folder: str, sheet: str = "data", formats: Mapping[str, str | int] | None = None) -> None:
    """Each batch of rows of each partition as one workbook with a header row below the folder, written by the tasks.

    A file appears under its name when it is whole; a task that runs again replaces its files.
    """
    names = list(df.columns)
    columns = {names.index(c): code for c, code in (formats or {}).items()}
    uri = folder if "://" in folder else f"file://{folder.removeprefix('file:')}"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = pyarrow.fs.FileSystem.from_uri(uri)
        system.create_dir(base, recursive=True)
        for n, batch in enumerate(batches):
            if not batch.num_rows:
                continue
            part = batch.column("_part")[0].as_py()
            path = f"{base}/book-{part:05d}-{n:03d}.xlsx"
            unfinished = f"{base}/_{uuid.uuid4().hex}"
            with system.open_output_stream(unfinished) as out:
                out.write(batch_workbook(batch.select(names), sheet, columns))
            system.move(unfinished, path)
            yield pa.RecordBatch.from_pydict({"path": [path]})

    df.withColumn("_part", F.spark_partition_id()).mapInArrow(write, "path string").write.format("noop").mode("overwrite").save()
