"""CSV with line breaks in quotes, read in blocks."""

import csv
import io
import random

import pytest
from conftest import rows

from tillwise.sources import quoted_csv, readers

HEADER = ["id", "note", "end"]


def written(folder, name, records, line_end="\n", header=HEADER):
    out = io.StringIO()
    writer = csv.writer(out, lineterminator=line_end)
    writer.writerow(header)
    writer.writerows(records)
    (folder / name).write_bytes(out.getvalue().encode())


def odd_records(seed, n):
    rng = random.Random(seed)
    parts = ["plain", "two\nlines", 'a "quoted" word', "comma, here", '"', '""\n""', "\n\n", " blanks ", "é漢", "long " * 40, "\n" * 30, ""]
    return [[str(seed * 10**6 + k), "".join(rng.choice(parts) for _ in range(rng.randrange(4))), rng.choice(["x", 'y"', "last\nline"])] for k in range(n)]


@pytest.fixture
def small_blocks(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {k: spark.conf.get(k) for k in names}
    for k, v in zip(names, ("300", "1")):
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def expected(records):
    return sorted((a, b or None, c) for a, b, c in records)


def test_one_file_is_read_by_many_tasks(spark, tmp_path, small_blocks):
    records = odd_records(1, 400)
    written(tmp_path, "a.csv", records)
    got = quoted_csv.read_quoted_csv(spark, str(tmp_path / "a.csv"))
    assert got.columns == HEADER
    assert sorted(rows(got)) == expected(records)
    assert quoted_csv._lines(spark, str(tmp_path / "a.csv")).rdd.getNumPartitions() > 20
    blocks = quoted_csv._blocks(quoted_csv._lines(spark, str(tmp_path / "a.csv")))
    assert blocks.where("odd").count() > 3 and blocks.where("not odd").count() > 3


def test_several_files_with_both_line_ends(spark, tmp_path, small_blocks):
    records = []
    for k, end in enumerate(["\n", "\r\n", "\n"]):
        mine = odd_records(k + 2, 60 + k)
        written(tmp_path, f"{k}.csv", mine, end)
        records += mine
    assert sorted(rows(quoted_csv.read_quoted_csv(spark, str(tmp_path)))) == expected(records)


def test_the_same_rows_as_one_task_per_file(spark, tmp_path, small_blocks):
    written(tmp_path, "a.csv", odd_records(9, 200))
    options = {"header": True, "quote": '"', "escape": '"', "multiLine": True, "mode": "FAILFAST"}
    whole = spark.read.options(**options).csv(str(tmp_path))
    got = readers.read_table(spark, str(tmp_path / "a.csv"), multi_line=True)
    assert sorted(rows(got), key=str) == sorted(rows(whole), key=str)


def test_a_header_over_lines_and_blocks(spark, tmp_path, small_blocks):
    header = ["id", "a\nname " + "x" * 700, 'b "c"']
    written(tmp_path, "a.csv", [["1", "2", "3"], ["4", "5\n6", "7"]], header=header)
    got = quoted_csv.read_quoted_csv(spark, str(tmp_path / "a.csv"))
    assert got.columns == header and sorted(rows(got)) == [("1", "2", "3"), ("4", "5\n6", "7")]


def test_a_field_over_many_blocks_and_empty_files(spark, tmp_path, small_blocks):
    records = [["1", "line\n" * 500, "x"], ["2", "", ""], ["3", '"' * 50, "y"]]
    written(tmp_path, "a.csv", records)
    written(tmp_path, "b.csv", [])
    got = sorted(rows(quoted_csv.read_quoted_csv(spark, str(tmp_path))))
    assert got == [("1", "line\n" * 500, "x"), ("2", None, None), ("3", '"' * 50, "y")]


def test_open_quotes_and_records_that_do_not_fit_are_errors(spark, tmp_path):
    (tmp_path / "open.csv").write_text('a,b\n1,"2\n3,4\n')
    with pytest.raises(ValueError, match="not closed"):
        quoted_csv.read_quoted_csv(spark, str(tmp_path / "open.csv"))
    (tmp_path / "wide.csv").write_text('a,b\n1,2\n3,4,5\n')
    with pytest.raises(Exception, match="MALFORMED|Malformed"):
        quoted_csv.read_quoted_csv(spark, str(tmp_path / "wide.csv")).collect()


def test_tabs_and_blank_lines(spark, tmp_path):
    (tmp_path / "a.tsv").write_text('a\tb\n\n1\t"x\ty"\n\n2\t"p\n\nq"\n')
    assert sorted(rows(readers.read_table(spark, str(tmp_path / "a.tsv"), multi_line=True))) == [("1", "x\ty"), ("2", "p\n\nq")]


# --- workbooks ----------------------------------------------------------------------


def book(tmp_path, name, sheet, strings="", styles="", workbook_pr=""):
    import zipfile

    with zipfile.ZipFile(tmp_path / name, "w") as out:
        main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
        out.writestr(
            "xl/workbook.xml",
            f'<workbook xmlns="{main}" xmlns:r="urn:r">{workbook_pr}<sheets><sheet name="First" sheetId="1" r:id="a"/>'
            '<sheet name="Second" sheetId="2" r:id="b"/></sheets></workbook>',
        )
        out.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="b" Target="/xl/worksheets/two.xml"/><Relationship Id="a" Target="worksheets/one.xml"/></Relationships>')
        out.writestr("xl/worksheets/one.xml", f'<worksheet xmlns="{main}"><sheetData>{sheet}</sheetData></worksheet>')
        out.writestr("xl/worksheets/two.xml", f'<worksheet xmlns="{main}"><sheetData><row><c t="str"><v>x</v></c></row><row><c><v>7</v></c></row></sheetData></worksheet>')
        if strings:
            out.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}">{strings}</sst>')
        if styles:
            out.writestr("xl/styles.xml", f'<styleSheet xmlns="{main}">{styles}</styleSheet>')
    return str(tmp_path / name)


STYLES = """<numFmts><numFmt numFmtId="170" formatCode="[Red]&quot;days&quot; 0.0"/><numFmt numFmtId="171" formatCode="yyyy\\-mm\\-dd"/></numFmts>
<cellXfs><xf numFmtId="0"/><xf numFmtId="22"/><xf numFmtId="170"/><xf numFmtId="171"/></cellXfs>"""


def test_cells_of_all_kinds(spark, tmp_path):
    strings = "<si><t>name</t></si><si><r><t>rich </t></r><r><t>text</t></r><rPh><t>aid</t></rPh></si><si><t>two\nlines &amp; more</t></si>"
    sheet = """<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>when</t></is></c><c r="D1" t="s"><v>0</v></c></row>
<row r="2"><c r="A2" t="s"><v>1</v></c><c r="B2" s="1"><v>40513.351388888892</v></c><c r="C2"><v>2.5499999999999998</v></c><c r="D2"><v>17850</v></c></row>
<row r="3"/>
<row r="4"><c r="A4" t="s"><v>2</v></c><c r="B4" s="3"><v>40513</v></c><c r="C4" s="2"><v>3.0</v></c><c r="D4" t="e"><v>#N/A</v></c><c r="E4"><v>9</v></c></row>
<row r="5"><c r="B5" t="b"><v>1</v></c><c r="C5" t="str"><f>A1</f><v>made</v></c><c r="D5" t="d"><v>2011-01-02T03:04:05</v></c></row>"""
    path = book(tmp_path, "a.xlsx", sheet, strings, STYLES)
    df = readers.read_table(spark, path)
    assert df.columns == ["name", "when", "Unnamed: 2", "name.1"]
    assert rows(df) == [
        ("rich text", "2010-12-01 08:26:00", "2.55", "17850"),
        ("two\nlines & more", "2010-12-01 00:00:00", "3", None),
        (None, "true", "made", "2011-01-02 03:04:05"),
    ]
    assert rows(readers.read_table(spark, path, sheet="Second")) == [("7",)] == rows(readers.read_table(spark, path, sheet=1))


def test_the_later_epoch_and_several_workbooks(spark, tmp_path):
    one = '<row><c t="str"><v>a</v></c><c t="str"><v>b</v></c></row><row><c s="1"><v>1.5</v></c><c><v>1</v></c></row>'
    two = '<row><c t="str"><v>b</v></c><c t="str"><v>a</v></c></row><row><c><v>2</v></c><c t="str"><v>x</v></c></row>'
    book(tmp_path, "a.xlsx", one, styles=STYLES, workbook_pr='<workbookPr date1904="1"/>')
    book(tmp_path, "b.xlsx", two)
    assert sorted(rows(readers.read_table(spark, str(tmp_path), kind="xlsx").select("a", "b"))) == [("1904-01-02 12:00:00", "1"), ("x", "2")]


def test_what_is_no_workbook_is_an_error(spark, tmp_path):
    (tmp_path / "a.xlsx").write_text("a,b")
    with pytest.raises(Exception, match="Not a workbook"):
        readers.read_table(spark, str(tmp_path / "a.xlsx"))
    with pytest.raises(ValueError, match="Binary workbooks"):
        readers.read_table(spark, str(tmp_path / "a.xls"))
    path = book(tmp_path, "b.xlsx", "<row><c><v>1</v></c></row>")
    with pytest.raises(Exception, match="no sheet"):
        readers.read_table(spark, path, sheet="Third")


def test_a_workbook_gives_the_rows_of_the_same_csv(spark, tmp_path):
    import query_catalog
    from tillwise.sources import star_schema as star, workbook

    df = star.online_retail(spark, "/root/testdata/sf0.001")
    csv_path = readers.write_table(df, str(tmp_path / "lines.csv"), "csv")
    from_csv = readers.load_online_retail(spark, csv_path)
    books = query_catalog.packed_workbooks(df.repartition(3))
    assert books.count() >= 3
    from tillwise.operators.clean import normalize_online_retail

    assert sorted(rows(normalize_online_retail(workbook.sheet_table(books, "Lines"))), key=str) == sorted(rows(from_csv), key=str)


# --- file order ---------------------------------------------------------------------


def lines_in_files(tmp_path, kind, spark):
    """Orders in shuffled order over several files; the lines as plain lists in file order."""
    rng = random.Random(5)
    lines = [(f"o{rng.randrange(40)}", f"i{rng.randrange(12)}") for _ in range(900)]
    files = [lines[:250], lines[250:260], lines[260:]]
    folder = tmp_path / kind
    folder.mkdir()
    for k, part in enumerate(files):
        if kind == "csv":
            written(folder, f"{k}.csv", part, header=["order_id", "product"])
        else:
            import pyarrow as pa
            import pyarrow.parquet as pq

            pq.write_table(pa.table({"order_id": [a for a, _ in part], "product": [b for _, b in part]}), folder / f"{k}.parquet", row_group_size=50)
    return str(folder), lines


def first_in_file(lines, max_orders, max_items, least):
    """The rule in plain Python: the first orders to appear, and the first items of each."""
    from collections import Counter
    from itertools import combinations

    orders = {}
    for order, item in lines:
        orders.setdefault(order, {}).setdefault(item)
    counts = Counter()
    for order in list(orders)[:max_orders]:
        counts.update(combinations(sorted(list(orders[order])[:max_items]), 2))
    return sorted(((a, b, n) for (a, b), n in counts.items() if n >= least), key=lambda r: (-r[2], r[:2]))


@pytest.mark.parametrize("kind", ["csv", "parquet"])
def test_first_orders_and_items_in_file_order(spark, tmp_path, small_blocks, kind):
    from tillwise.operators import baskets

    folder, lines = lines_in_files(tmp_path, kind, spark)
    df = readers.read_table(spark, folder, kind, file_order=True)
    assert [tuple(r) for r in df.orderBy("file_order").select("order_id", "product").collect()] == lines
    got = baskets.basket_pairs(df, min_pair_count=2, max_orders=15, max_items_per_order=4, order_by="file_order")
    assert [tuple(r) for r in got.collect()] == first_in_file(lines, 15, 4, 2)
    with pytest.raises(ValueError):
        readers.read_table(spark, folder, "csv", multi_line=True, file_order=True)


def test_last_label_in_file_order(spark, tmp_path, small_blocks):
    from tillwise.operators.recency import latest_customer_label

    folder, lines = lines_in_files(tmp_path, "csv", spark)
    df = readers.read_table(spark, folder, "csv", file_order=True)
    got = latest_customer_label(df, "product", "order_id", order_by=["file_order"])
    assert dict(rows(got)) == dict(lines)


def test_values_that_come_again_are_read_once():
    from query_catalog import packed_workbook
    from tillwise.sources.workbook import Workbook

    lines = [(f"i{k}", "2010-12-01 08:26:00", None if k % 7 else "5.5") for k in range(20_000)]
    book = Workbook(packed_workbook(["a", "b", "c"], lines))
    got = list(book.rows("Lines"))
    assert got[0] == ["a", "b", "c"] and [tuple(r) for r in got[1:]] == lines
    assert book.shown.cache_info().misses < 21_000


def test_plain_cells_are_not_looked_at_one_by_one():
    from query_catalog import packed_workbook
    from tillwise.sources.workbook import Workbook

    lines = [(f"i{k}", f"2010-12-0{k % 9 + 1} 08:26:00", f"{k}", f"{k + 0.25}") for k in range(10_000)]
    book = Workbook(packed_workbook(["a", "b", "c", "d"], lines))
    assert [tuple(r) for r in book.rows("Lines")][1:] == lines
    looked_at = book.shown.cache_info()
    assert looked_at.hits + looked_at.misses < 1_000


def cell_of(rng, place):
    """A cell of some kind, rarely an odd one."""
    number = rng.choice([rng.randrange(10), rng.random(), rng.random() * 10.0 ** rng.randrange(-8, 20), -rng.randrange(9), 1e15, 1e-4, 40513.25, 40513.351388888892])
    value = rng.choice([f"<v>{number!r}</v>"] * 8 + ["<v/>", "<v></v>", "", f"<v >{number!r}</v>"])
    kinds = ["", ' s="0"', ' s="2"'] * 4 + [' t="n"', ' t="b"', ' t="e"']
    kind = rng.choice(kinds)
    cells = [f"<c{place}{kind}>{value}</c>"] * 6 + [f"<c{place}/>", f'<c{place} t="s"><v>{rng.randrange(3)}</v></c>', f'<c{place} t="str"><v>x &amp; &#65;y</v></c>', f'<c{place} s="1"><v>{rng.random() * 50_000}</v></c>', f'<c{place} t="str"><v></v></c>']
    return rng.choice(cells)


@pytest.mark.parametrize("places", [False, True])
def test_plain_parts_give_what_the_parser_gives(tmp_path, monkeypatch, places):
    """Sheets read as bytes, in parts of all sizes, against the same sheets behind a comment, which the parser reads."""
    from tillwise.sources import workbook

    rng = random.Random(11)
    plain, parts = workbook.Workbook._plain, []
    monkeypatch.setattr(workbook.Workbook, "_plain", lambda self, data: parts.append(plain(self, data)) or parts[-1])
    strings = "<si><t>name</t></si><si><t></t></si><si><t>two\nlines</t></si>"
    for size in (200, 1_000, 1 << 20):
        monkeypatch.setattr(workbook, "PART_BYTES", size)
        for odd in ("", '<row><c t="inlineStr"><is><t>in</t></is></c></row>', "<!-- -->", "<row><c><f>A1</f><v>3</v></c></row>"):
            lines = []
            for k in range(60):
                columns = sorted(rng.sample(range(30), rng.randrange(6))) if places else range(rng.randrange(6))
                names = [f' r="{"A" * (c // 26)}{chr(65 + c % 26)}{k + 1}"' if places else "" for c in columns]
                lines.append(rng.choice(['<row r="9">', "<row>"]) + "".join(cell_of(rng, name) for name in names) + rng.choice(["</row>", "</row>\n"]))
            lines[50] += odd + "<row/>"
            sheet = "".join(lines)
            found = [list(workbook.Workbook(open(book(tmp_path, "a.xlsx", before + sheet, strings, STYLES), "rb").read()).rows()) for before in ("", "<!-- -->")]
            assert found[0] == found[1] and len(found[0]) > 20
    assert sum(p is not None for p in parts) > 60


def test_a_sheet_cut_short_is_an_error():
    from tillwise.sources import workbook
    import io

    class Cut(workbook.Workbook):
        def __init__(self, text):
            self.sheets, self.strings, self.dates = {"a": "a"}, [], []
            self.zip = type("Zip", (), {"open": lambda _, path: io.BytesIO(text)})()

    whole = b"<worksheet><sheetData><row><c><v>1</v></c></row></sheetData></worksheet>"
    assert list(Cut(whole).rows()) == [["1"]]
    for text in (whole[:-5], whole[:60], whole.replace(b"</c>", b"")):
        with pytest.raises(Exception):
            list(Cut(text).rows())
