"""What workbook cells show, and sheets cut into stretches."""

import io
import random
import zipfile
from datetime import date, datetime
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from crosstally.sources import cellformats, files, sheets
from crosstally.sources.cellformats import BUILT_IN, compiled, compiled_many
from crosstally.sources.files import FileTable, parse_workbooks, read_file_table, workbook_columns
from crosstally.sources.sheets import stretch_columns, stretch_rows
from workloads import queries
from workloads.workbooks import batch_workbook, workbook

ACCOUNTING = '_("$"* #,##0.00_);_("$"* (#,##0.00);_("$"* "-"??_);_(@_)'

SHOWN = [
    ("General", 10.0, "10"), ("General", 0.1 + 0.2, "0.3"), ("General", 123456789.123456, "123456789.1"), ("General", 1e15, "1E+15"),
    ("General", -1.5, "-1.5"), ("General", 1e-11, "1E-11"), ("General", 0.0, "0"), ("@", 2.5, "2.5"), ("General", 12345678901.0, "12345678901"),
    ("0", 2.5, "3"), ("0", -0.4, "0"), ("0.00", -1.005, "-1.01"), ("#,##0", 1234567, "1,234,567"), ("#,##0", 12, "12"),
    ("#,##0.00", -1234.5, "-1,234.50"), ("0000", 12, "0012"), ("#", 0, ""), ("0.##", 5, "5."), (".00", 3.5, "3.50"), ("0.0?", 1.2, "1.2 "),
    ("0%", 0.256, "26%"), ("0.00%", -0.25678, "-25.68%"), ("#,##0,", 1234567, "1,235"), ('0.0,,"M"', 1234567, "1.2M"),
    ("000-00-0000", 123456789, "123-45-6789"), ('0" kg"', 3, "3 kg"), ("\\x0", 3, "x3"), ("0.5", 3, "3.5"),
    ("0.00E+00", 12345.678, "1.23E+04"), ("0.00E-00", 12345.678, "1.23E04"), ("##0.0E+0", 12345.678, "12.3E+3"), ("0E+0", 9.9, "1E+1"),
    ("0.0E+00", 0.00012, "1.2E-04"), ("0.00E+00", 0, "0.00E+00"),
    ("# ?/?", 1.5, "1 1/2"), ("# ??/??", -3.14159, "-3 14/99"), ("?/8", 0.6, "5/8"), ("# ?/?", 4, "4"), ("?/?", 2.5, "5/2"), ("# ?/?", 0.99, "1"),
    ("# ?/4", 2.25, "2 1/4"),
    ("#,##0_);(#,##0)", -1234, "(1,234)"), ("0.0;[Red]0.0", -2, "2.0"), ("0;;", -4, ""), ('0;-0;"none"', 0, "none"), ("0;-0", -7, "-7"),
    (ACCOUNTING, 1234.5, "$1,234.50"), (ACCOUNTING, -5.5, "$(5.50)"), (ACCOUNTING, 0, "$-  "), ("[$€-407]#,##0.00", 5, "€5.00"),
    ("[>=100]0.0;[<0]0;0.000", 150, "150.0"), ("[>=100]0.0;[<0]0;0.000", 3, "3.000"), ("[=1]\"one\";0", 1, "one"), ('"a;b"0', 1, "a;b1"),
    ("m/d/yy", 45000, "3/15/23"), ("d-mmm-yy", 45000.5, "15-Mar-23"), ("yyyy-mm-dd hh:mm:ss", 45000.123456, "2023-03-15 02:57:46"),
    ("dddd, mmmm dd", 45000, "Wednesday, March 15"), ("ddd mmmmm", 45000, "Wed M"), ("h:mm AM/PM", 0.75, "6:00 PM"), ("h:mm A/P", 0, "12:00 A"),
    ("[h]:mm:ss", 1.5, "36:00:00"), ("[mm]:ss", 0.5, "720:00"), ("mm:ss.0", 0.0012345, "01:46.6"), ("h:mm", 0.9999999999, "0:00"),
    ("yyyymmdd", 59, "19000228"), ("m/d/yyyy", 60, "2/29/1900"), ("m/d/yyyy", 61, "3/1/1900"), ("[$-409]d\\-m;@", 45000, "15-3"),
    ("m/d/yy", -1, "########"), ("hh:mm:ss", 45000 + 1 / 86400, "00:00:01"), ("yyyy/mm", 1e9, "########"),
]


@pytest.mark.parametrize("code, value, text", SHOWN)
def test_what_a_format_shows(code, value, text):
    assert compiled(code)(float(value)) == text


def test_days_from_1904():
    assert compiled("yyyy-mm-dd", True)(43538.0) == "2023-03-15" == compiled("yyyy-mm-dd")(45000.0)


@pytest.mark.parametrize("from_1904", [False, True])
def test_formats_of_a_workbook(spark, from_1904):
    at = datetime(2024, 2, 29, 13, 5)
    content = workbook([["id", "day", "share", "paid", "note"], ["a", at, 0.125, -1234.5, "x"], ["b", at.date(), 1, 10, None]],
                       formats={1: "yyyy-mm-dd hh:mm", 2: 9, 3: 40}, from_1904=from_1904)
    books = spark.createDataFrame([(content,)], "content binary")
    columns = workbook_columns(books)
    rows = sorted(map(tuple, parse_workbooks(books, columns).collect()))
    assert rows == [("a", "2024-02-29 13:05", "13%", "(1,234.50)", "x"), ("b", "2024-02-29 00:00", "100%", "10.00", None)]


def _sheet(xml: bytes, **more: bytes) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(workbook([["a"]]))) as old, zipfile.ZipFile(out, "w") as new:
        for name in old.namelist():
            new.writestr(name, xml if name.endswith("sheet1.xml") else more.get(name.split("/")[-1].split(".")[0], old.read(name)))
    return out.getvalue()


ODD = (
    '<?xml version="1.0"?><x:worksheet xmlns:x="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:q="urn:q"><x:cols/>'
    '<x:sheetData><x:row r="1"><x:c t="inlineStr"><x:is><x:t>id</x:t></x:is></x:c><x:c t="inlineStr"><x:is><x:t>v</x:t></x:is></x:c></x:row>'
    '<x:row r="2"/><x:row r="3"><x:c r="B3" t="str"><x:v><![CDATA[</x:row>&<]]></x:v></x:c></x:row>'
    '<x:row r="4"><x:c r="A4" t="s"><x:v>0</x:v></x:c><x:c r="B4"><x:f>1+1</x:f><x:v>2</x:v></x:c></x:row>'
    '<x:row r="5"><x:c r="A5" t="e"><x:v>#N/A</x:v></x:c><x:c r="C5"><x:v>7</x:v></x:c></x:row></x:sheetData><x:p>a</x:p></x:worksheet>')
STRINGS = b'<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><r><t>ri</t></r><r><t>ch</t></r><rPh><t>no</t></rPh></si></sst>'


@pytest.mark.parametrize("size", [1, 7, 60, 1 << 22])
@pytest.mark.parametrize("encoding", ["utf-8", "utf-16"])
def test_stretches_of_any_size_give_the_same_rows(spark, monkeypatch, size, encoding):
    monkeypatch.setattr(files, "_STRETCH_BYTES", size if encoding == "utf-8" else size + 1)
    content = _sheet(ODD.encode(encoding), sharedStrings=STRINGS)
    cut = files._cut(None)([__import__("pandas").DataFrame({"content": [content]})])
    rows, firsts = [], []
    for s in (s for frame in cut for s in frame.itertuples()):
        rows += files._stretch_rows(s.head, s.rows, s.strings, s.formats, s.from_1904)
        firsts.append(s.first)
    assert firsts == [True] + [False] * (len(firsts) - 1) and (len(firsts) > 2 or size > 60)
    assert [r for r in rows if r] == [["id", "v"], [None, "</x:row>&<"], ["rich", "1+1"], ["#N/A", None, "7"]]


def test_empty_sheets_and_wrong_files(spark, tmp_path):
    empty = b'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData/></worksheet>'
    (tmp_path / "a.xlsx").write_bytes(_sheet(empty))
    with pytest.raises(Exception, match="no header row"):
        read_file_table(spark, FileTable("b", str(tmp_path), ".*[.]xlsx", table="b"))
    (tmp_path / "a.xlsx").write_bytes(workbook([["id", "v"], ["1", 2]]))
    (tmp_path / "b.xlsx").write_bytes(_sheet(empty))
    assert [tuple(r) for r in read_file_table(spark, FileTable("b", str(tmp_path), ".*[.]xlsx", table="b")).collect()] == [("1", "2")]
    assert read_file_table(spark, FileTable("b", str(tmp_path), ".*[.]xlsx", table="b", header=False)).columns == ["COL1", "COL2"]
    (tmp_path / "c.xlsx").write_bytes(b"\xd0\xcf\x11\xe0")
    with pytest.raises(Exception, match="older binary XLS"):
        read_file_table(spark, FileTable("b", str(tmp_path), ".*[.]xlsx", table="b")).count()


def test_a_large_sheet_is_parsed_by_several_tasks(spark, tmp_path):
    rows = 500_000
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(workbook([["id", "v"]], shared=False))) as old, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as new:
        for name in old.namelist():
            if not name.endswith("sheet1.xml"):
                new.writestr(name, old.read(name))
        with new.open("xl/worksheets/sheet1.xml", "w") as sheet:
            head, tail = old.read("xl/worksheets/sheet1.xml").split(b"</sheetData>")
            sheet.write(head)
            for start in range(0, rows, 50_000):
                sheet.write("".join(f'<row r="{i + 2}"><c r="A{i + 2}"><v>{i}</v></c><c r="B{i + 2}"><v>{i % 7}.5</v></c></row>'
                                    for i in range(start, start + 50_000)).encode())
            sheet.write(b"</sheetData>" + tail)
    (tmp_path / "large.xlsx").write_bytes(out.getvalue())
    table = read_file_table(spark, FileTable("large", str(tmp_path), ".*[.]xlsx", table="large"))
    by_task = table.groupBy(F.spark_partition_id().alias("task")).agg(
        F.count("*").alias("n"), F.sum(F.col("id").cast("long")).alias("ids"), F.sum(F.col("v").cast("double")).alias("v")).collect()
    assert len(by_task) == 4 and max(r.n for r in by_task) < 0.45 * rows
    assert sum(r.n for r in by_task) == rows and sum(r.ids for r in by_task) == rows * (rows - 1) // 2
    assert sum(r.v for r in by_task) == sum(i % 7 + 0.5 for i in range(rows))


def _odd_numbers() -> list[float]:
    rng = random.Random(4)
    ties = [(2 * rng.randrange(10**6) + 1) * 5 / 10 ** rng.randrange(9) for _ in range(150)]
    beside = [float(np.nextafter(t, t + side)) for t in ties for side in (-1, 1)]
    moments = [rng.randrange(70_000) + rng.randrange(86_400_000) / rng.choice([86_400_000, 86_400, 1440]) for _ in range(150)]
    sizes = [rng.uniform(-1, 1) * 10 ** rng.randrange(-20, 20) for _ in range(150)]
    parts = [rng.randrange(10**5) / rng.choice([8, 48, 7, 18, 99]) for _ in range(150)]
    edges = [0.0, -0.0, 1.0, 58.9999999999, 59.5, 60.0, 60.9999999999, 61.0, 2958464.5, 2958465.0, 2958466.0, 9.995, 999.9995, 99999.5, 1e11, 1e-10, 1e14, 1e15]
    return [*ties, *beside, *moments, *sizes, *parts, *edges, *(-v for v in edges), *(-t for t in ties)]


@pytest.mark.parametrize("code", sorted({code for code, _, _ in SHOWN} | set(BUILT_IN.values()) | {
    "0.0##", "#,##000.0", "0,000", "0.00,,", "#%", "ss.00", "mm/dd", "[s].000", '"9x"0;0', "0.000E-0", "#,##0.00;;", "# ???/???"}))
def test_whole_columns_show_what_single_numbers_show(code):
    numbers = _odd_numbers()
    for from_1904 in (False, True):
        one = compiled(code, from_1904)
        assert compiled_many(code, from_1904)(np.array(numbers)).to_pylist() == [one(v) for v in numbers]
    assert compiled_many(code)(np.array([])).to_pylist() == []


MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
CELLS = [
    "<v>{}</v>", "<v>{}</v>", "<v>{}</v>", "<v></v>", "", "<f>A1+1</f><v>{}</v>", "<v>{}</v><f/>", "<v> {} </v>", '<v xml:space="preserve">{}</v>',
    "<is><t>in &lt;line</t></is>", "<is><r><t>ri</t></r><r><t>ch</t></r><rPh><t>no</t></rPh></is>", "<v><!-- note -->{}</v>", "<v><![CDATA[{}]]></v>"]


def _any_sheet(rng: random.Random, prefix: str, named: str, comments: bool) -> str:
    """Rows as different programs write them: with and without references, empty cells and rows, formulas, texts of all kinds."""
    lines = []
    for r in range(1, 14):
        cells = []
        for c in sorted(rng.sample(range(30), rng.randrange(6))):
            attributes = [f' r="{chr(65 + c) if c < 26 else "A" + chr(39 + c)}{r}"'] * (named == "all" or named == "some" and rng.random() < 0.5)
            kind = rng.choice(["n", "n", "", "", "", "s", "b", "str", "e", "inlineStr"])
            attributes += [f' t="{kind}"'] * bool(kind) + [f' s="{rng.randrange(5)}"'] * (rng.random() < 0.6) + [' cm="1"'] * (rng.random() < 0.05)
            rng.shuffle(attributes)
            inner = rng.choice(CELLS[: len(CELLS) if comments else -2]) if kind != "s" else "<v>{}</v>"
            text = {"s": str(rng.randrange(3)), "b": rng.choice("01"), "str": rng.choice(["a &amp; b", "x > y", "\u3000", "\x85", "é", "two\r\nlines", '"q"'])}
            value = text.get(kind, rng.choice(["0", "45000.25", "-3", "1E+3", "0.125"]) if kind in ("n", "") else "#N/A")
            cells.append(f"<c{''.join(attributes)}/>" if rng.random() < 0.1 else f"<c{''.join(attributes)}>{inner.format(value)}</c>")
        lines.append(f'<row r="{r}" spans="1:9">{chr(10).join(cells)}</row>' if cells or rng.random() < 0.5 else f'<row r="{r}"/>')
    return "".join(lines).replace("</", f"</{prefix}").replace("<c", f"<{prefix}c").replace("<row", f"<{prefix}row").replace(
        "<v", f"<{prefix}v").replace("<f", f"<{prefix}f").replace("<is", f"<{prefix}is").replace("<t", f"<{prefix}t").replace("<r>", f"<{prefix}r>").replace("<rPh", f"<{prefix}rPh")


@pytest.mark.parametrize("prefix", ["", "x:"])
@pytest.mark.parametrize("named", ["all", "none", "some"])
@pytest.mark.parametrize("comments", [False, True])
@pytest.mark.parametrize("block", [1 << 20, 300, 1])
def test_columns_are_what_rows_show(prefix, named, comments, block, monkeypatch):
    monkeypatch.setattr(sheets, "_BLOCK_BYTES", block)
    head = f"<{prefix}worksheet {MAIN if not prefix else MAIN.replace('xmlns', 'xmlns:x')}>".encode()
    strings, formats = ["shared", " ", "é"], {0: "General", 1: "yyyy-mm-dd", 2: "0.0%", 3: "# ?/?", 4: "0;;"}
    for seed in range(40):
        rows = _any_sheet(random.Random(seed), prefix, named, comments).encode()
        for width, skip in ((30, 0), (4, 1)):
            padded = [(row + [None] * width)[:width] for row in stretch_rows(head, rows, strings, formats, False)][skip:]
            kept = [[c if c and sheets._VISIBLE.search(c) else None for c in row] for row in padded if any(c is not None and c.strip() for c in row)]
            found = stretch_columns(head, rows, strings, formats, False, width, skip)
            assert [list(row) for row in zip(*(column.to_pylist() for column in found))] == kept


@pytest.mark.parametrize("rows", [
    '<row><c r="A1"><v>1</c></v></row>', '<row><c r="A1"><v>1</v></row></c>', "<row><c r=A1><v>1</v></c></row>", '<row><c r="A1" r="B1"><v>1</v></c></row>',
    '<row><c r="A1"><v>&no;</v></c></row>', '<row><c r="A1" t="str"><v>\x01</v></c></row>', '<row><c r="A1"><v>1x</v></c></row>', '<row><c r="A1" t="s"><v>9</v></c></row>'])
def test_broken_sheets_fail(rows):
    with pytest.raises(Exception):
        stretch_columns(f"<worksheet {MAIN}>".encode(), rows.encode(), ["a"], {}, False, 2)


@pytest.mark.parametrize("items", [
    "<si><t>a</t></si><si><t xml:space=\"preserve\"> b </t></si>", "<si><t>a &amp; &#233;</t></si><si><t></t></si>", "<si/><si><t>a</t></si>",
    "<si><t/></si><si><t>b</t></si>", "<si><r><t>ri</t></r><r><t>ch</t></r></si>", "<!-- <si><t>no</t></si> --><si><t>a</t></si>", "<si><t>a\r\nb</t></si>", ""])
def test_shared_strings_of_all_kinds(items, monkeypatch):
    xml = f"<sst {MAIN}>{items}</sst>"
    found = {}
    for text, encoding in ((xml, "utf-8"), (xml.replace("<", "<x:").replace("<x:/", "</x:").replace("xmlns", "xmlns:x").replace("<x:!", "<!"), "utf-8"), (xml, "utf-16")):
        with zipfile.ZipFile(io.BytesIO(_sheet(b"", sharedStrings=text.encode(encoding)))) as book:
            found[len(found)] = files._shared_strings(book)
            monkeypatch.setattr(files, "_plain_strings", lambda xml: None)
            assert found[len(found) - 1] == files._shared_strings(book) == found[0]
            monkeypatch.undo()


def test_no_number_of_a_plain_sheet_is_shown_by_itself(monkeypatch):
    calls = []
    monkeypatch.setattr(cellformats, "compiled", lambda code, from_1904=False: calls.append)
    monkeypatch.setattr(sheets, "compiled", lambda code, from_1904=False: calls.append)
    compiled_many.cache_clear()
    codes = ["yyyy-mm-dd hh:mm:ss", 10, 40, "# ?/?", "0.000E+00", "[h]:mm", "0"]
    book = workbook([[i + 0.125 * (i % 9) for _ in codes] for i in range(61, 5000)], formats=dict(enumerate(codes)))
    found = [stretch_columns(head, rows, strings, dict(enumerate(used)), old, len(codes)) for head, rows, _, old, strings, used in files._opened(book, None)]
    compiled_many.cache_clear()
    assert sum(len(columns[0]) for columns in found) == 4939 and not calls


def test_workbooks_over_and_under_the_size_give_the_same_rows(spark, monkeypatch):
    books = spark.createDataFrame([(workbook([["id"], [n], [n + 0.5]]),) for n in range(6)], "content binary")
    found = parse_workbooks(books, ["id"]).collect()
    assert sorted(float(r.id) for r in found) == [n + half for n in range(6) for half in (0, 0.5)]
    monkeypatch.setattr(files, "_WHOLE_BYTES", 1)
    assert sorted(map(tuple, found)) == sorted(map(tuple, parse_workbooks(books, ["id"]).collect()))


def test_batches_become_the_workbooks_of_their_rows():
    values = {
        "name": pa.array(["x", None, "y&<z", "x"]), "flag": pa.array([True, None, False, True]), "whole": pa.array([1, None, 3, -4], pa.int64()),
        "real": pa.array([1.5, None, 1e-20, 12345678.125]), "short": pa.array([0.1, None, 2, 3], pa.float32()),
        "day": pa.array([date(2024, 2, 29), None, date(1901, 1, 1), date(1999, 12, 31)]),
        "at": pa.array([datetime(2024, 2, 29, 13, 5, 1), None, datetime(1999, 1, 1), datetime(2001, 2, 3, 4, 5, 6, 789123)], pa.timestamp("us")),
        "paid": pa.array([Decimal("1.50"), None, Decimal("-2.00"), None]), "none": pa.array([None] * 4, pa.string())}
    formats = {5: "yyyy-mm-dd", 6: "yyyy-mm-dd hh:mm:ss.000"}
    batch = pa.RecordBatch.from_pydict(values)
    rows = [list(values), *map(list, zip(*(column.to_pylist() if name != "short" else [np.float32(v).item() if v is not None else None for v in column.to_pylist()]
                                           for name, column in values.items())))]
    shown = [[(head, list(stretch_rows(head, xml, strings, dict(enumerate(codes)), False))) for head, xml, _, _, strings, codes in files._opened(book, None)]
             for book in (batch_workbook(batch, formats=formats), workbook(rows, formats=formats))]
    assert shown[0] == shown[1]


def test_workbooks_of_formats_are_written_by_all_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(queries, "shared_dir", lambda spark: str(tmp_path / "books"))
    spark.sql("""
      SELECT id AS l_orderkey, 7 * id AS l_partkey, id % 100 AS l_suppkey, CAST(id % 7 + 1 AS INT) AS l_linenumber, CAST(id % 50 AS DOUBLE) AS l_quantity,
             id * 10.25D AS l_extendedprice, 0.04D AS l_discount, 0.025D AS l_tax, TIMESTAMP_NTZ '1996-09-13 00:00:00' AS l_shipdate
      FROM range(1, 401, 1, 1)""").createOrReplaceTempView("lineitem")
    found = {r.migration_key: r for r in queries.extract_xlsx_formats(spark).collect()}
    parts = {path.name.split("-")[1] for path in (tmp_path / "books").glob("book-*.xlsx")}
    assert len(found) == 400 and len(parts) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert tuple(found["13-7"])[1:] == ("1996-09-13", "9/20/96", "13.09.1996 13:31:13", "45:30", "4.00%", "2.5%", "-", "13,000 pcs", "1 5/8", "9.100E+01")


def test_rows_are_dealt_unless_they_lie_evenly(spark):
    rows = spark.range(0, 4000, 1, 4)
    assert queries.spread(rows, rows) is rows
    uneven = rows.where("id < 1100 OR id = 3000")
    sizes = [r["count"] for r in queries.spread(uneven, uneven).groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == int(spark.conf.get("spark.sql.shuffle.partitions")) and max(sizes) < 500 and sum(sizes) == 1101
    assert queries.spread(rows.limit(0), rows.limit(0)).count() == 0
