"""Spreadsheets as tables of text: the rows of one sheet of each workbook.

A workbook is a zip of XML parts. Spark loads the files, wherever they lie, and each is streamed
by one task: its sheet is read a part at a time, so a task holds the packed file, its shared strings
and a part's rows. A sheet has 1,048,576 rows at most, which bounds a task's work; many
workbooks are read by many tasks.

Parts that are nothing but rows of plain cells are read as arrays of bytes, and each different value
is looked at once. From the first part on that has more (formulas, inline texts, prefixes, comments
and the like), a sheet goes through an XML parser.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from datetime import datetime, timedelta
from functools import cached_property, lru_cache
from itertools import chain, zip_longest
from xml.etree import ElementTree

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

BATCH_BYTES = str(64 << 20)
#: Bytes of a sheet that are parsed at once, and those before its rows that are kept to look for them.
PART_BYTES = 1 << 20
HEAD_BYTES = 1 << 20
#: Cells of a block, with those that are not there, unless a single row has more.
BLOCK_CELLS = 1 << 20
# Number formats without a text of their own that show dates or times.
DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}
# Days from which dates may have more than four digits of a year.
LAST_DAY = 2_950_000
EPOCHS = {False: datetime(1899, 12, 30), True: datetime(1904, 1, 1)}
# Tags of plain rows, and those that may follow each; whatever follows other tags is not plain.
ROW, ROW_END, ROW_EMPTY, CELL, CELL_END, CELL_EMPTY, VALUE, VALUE_END, VALUE_EMPTY = range(1, 10)
FOLLOWS = np.zeros((10, 10), bool)
for _tag, _next in {
    ROW: (CELL, CELL_EMPTY, ROW_END),
    CELL: (VALUE, VALUE_EMPTY, CELL_END),
    VALUE: (VALUE_END,),
    VALUE_END: (CELL_END,),
    VALUE_EMPTY: (CELL_END,),
    CELL_END: (CELL, CELL_EMPTY, ROW_END),
    CELL_EMPTY: (CELL, CELL_EMPTY, ROW_END),
    ROW_END: (ROW, ROW_EMPTY),
    ROW_EMPTY: (ROW, ROW_EMPTY),
}.items():
    FOLLOWS[_tag, list(_next)] = True

#: Rows as columns of text, all as long as the longest row, and the length of each row.
Block = tuple[list[pa.Array], np.ndarray]


@lru_cache(maxsize=1024)
def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _shows_dates(code: str) -> bool:
    """Whether a number format has parts of a date or time, apart from quoted text, escapes and colours."""
    plain = re.sub(r'"[^"]*"|\\.|_.|\*.|\[(?![hms]+\])[^\]]*\]', "", code.lower())
    return bool(re.search("[ymdhs]", plain)) and "general" not in plain


def _place(reference: str) -> int:
    """The number of a cell's column, from 0: AB7 is in column 27."""
    number = 0
    for letter in reference:
        if not letter.isalpha():
            break
        number = number * 26 + ord(letter.upper()) - 64
    return number - 1


class Workbook:
    """A workbook's bytes, opened."""

    def __init__(self, data: bytes):
        try:
            self.zip = zipfile.ZipFile(io.BytesIO(data))
        except zipfile.BadZipFile:
            raise ValueError("Not a workbook of zipped XML; older binary workbooks are not read.") from None
        names = set(self.zip.namelist())
        book = ElementTree.fromstring(self.zip.read("xl/workbook.xml"))
        relations = ElementTree.fromstring(self.zip.read("xl/_rels/workbook.xml.rels"))
        target = {r.get("Id"): r.get("Target") for r in relations}
        self.sheets: dict[str, str] = {}
        self.epoch = EPOCHS[False]
        for element in book.iter():
            if _local(element.tag) == "workbookPr":
                self.epoch = EPOCHS[element.get("date1904") in ("1", "true")]
            elif _local(element.tag) == "sheet":
                found = next(v for k, v in element.attrib.items() if _local(k) == "id")
                path = target[found]
                self.sheets[element.get("name")] = path.lstrip("/") if path.startswith("/") else f"xl/{path}"
        self.strings = list(self._shared_strings()) if "xl/sharedStrings.xml" in names else []
        self.dates = self._date_styles() if "xl/styles.xml" in names else []
        # Values come again and again in a column; a bounded number of them is kept.
        self.shown = lru_cache(maxsize=1 << 14)(self._shown)

    def _shared_strings(self) -> Iterator[str]:
        with self.zip.open("xl/sharedStrings.xml") as part:
            for _, element in ElementTree.iterparse(part):
                if _local(element.tag) == "si":
                    yield self._text(element)
                    element.clear()

    @staticmethod
    def _text(element: ElementTree.Element) -> str:
        """All runs of a string, without its reading aids."""
        aids = {t for e in element if _local(e.tag) == "rPh" for t in e.iter()}
        return "".join(t.text or "" for t in element.iter() if _local(t.tag) == "t" and t not in aids)

    def _date_styles(self) -> list[bool]:
        styles = ElementTree.fromstring(self.zip.read("xl/styles.xml"))
        own, dates = {}, []
        for element in styles.iter():
            if _local(element.tag) == "numFmt":
                own[int(element.get("numFmtId"))] = _shows_dates(element.get("formatCode") or "")
            elif _local(element.tag) == "cellXfs":
                for style in element:
                    number = int(style.get("numFmtId") or 0)
                    dates.append(own.get(number, number in DATE_FORMATS))
        return dates

    def sheet_path(self, sheet: str | int) -> str:
        paths = list(self.sheets.values())
        if isinstance(sheet, int):
            if not 0 <= sheet < len(paths):
                raise ValueError(f"There is no sheet number {sheet}.")
            return paths[sheet]
        if sheet not in self.sheets:
            raise ValueError(f"There is no sheet {sheet!r}; there are {list(self.sheets)}.")
        return self.sheets[sheet]

    def _value(self, cell: ElementTree.Element) -> str | None:
        value, inline = None, None
        for part in cell:
            name = _local(part.tag)
            if name == "v":
                value = part.text
            elif name == "is":
                inline = self._text(part)
        kind = cell.get("t") or "n"
        return inline if kind == "inlineStr" else self.shown(kind, value, cell.get("s"))

    def _shown(self, kind: str, value: str | None, style: str | None) -> str | None:
        """The text of a stored value."""
        if value is None or kind == "e":
            return None
        if kind == "s":
            return self.strings[int(value)]
        if kind == "b":
            return "true" if value == "1" else "false"
        if kind != "n":
            return value.replace("T", " ") if kind == "d" else value
        number, place = float(value), int(style or 0)
        if place < len(self.dates) and self.dates[place]:
            moment = self.epoch + timedelta(milliseconds=round(number * 86_400_000))
            return moment.isoformat(" ", "milliseconds" if moment.microsecond else "seconds")
        return str(int(number)) if number.is_integer() and abs(number) < 1e15 else repr(number)

    def _all_shown(self, kind: str, values: pa.Array, style: str | None) -> pa.Array:
        """The texts of stored values of one kind and style; what is not as usual goes one by one."""
        try:
            if kind == "s":
                return self.all_strings.take(values.cast(pa.int64()))
            if kind == "n":
                return self._numbers(values, int(style or 0))
        except (pa.ArrowInvalid, IndexError):
            pass
        found = values.dictionary_encode()
        texts = [None if kind == "inlineStr" else self.shown(kind, v, style) for v in found.dictionary.to_pylist()]
        return pa.array(texts, pa.string()).take(found.indices)

    @cached_property
    def all_strings(self) -> pa.Array:
        return pa.array(self.strings, pa.string())

    def _numbers(self, values: pa.Array, style: int) -> pa.Array:
        """What ``_shown`` gives for numbers."""
        x = values.cast(pa.float64()).to_numpy()
        if style < len(self.dates) and self.dates[style]:
            if not ((x >= 0) & (x < LAST_DAY)).all():
                raise pa.ArrowInvalid("A date out of range.")
            milliseconds = np.rint(x * 86_400_000).astype(np.int64) + (self.epoch - datetime(1970, 1, 1)) // timedelta(milliseconds=1)
            kinds = [milliseconds % 1000 == 0]
            texts = [
                pa.array(milliseconds[kinds[0]] // 1000, pa.timestamp("s")).cast(pa.string()),
                pa.array(milliseconds[~kinds[0]], pa.timestamp("ms")).cast(pa.string()),
            ]
        else:
            size = np.abs(x)
            whole = (np.floor(x) == x) & (size < 1e15)
            # Where the shortest form has no exponent.
            kinds = [whole, ~whole & (size >= 1e-4) & (size < 1e9)]
            texts = [pa.array(x[whole].astype(np.int64)).cast(pa.string()), pa.array(x[kinds[1]]).cast(pa.string())]
            texts.append(pa.array([self.shown("n", repr(float(v)), str(style)) for v in x[~kinds[0] & ~kinds[1]]], pa.string()))
        order = np.argsort(np.concatenate([*map(np.flatnonzero, kinds), np.flatnonzero(~np.any(kinds, axis=0))]))
        return pa.concat_arrays(texts).take(pa.array(order))

    def rows(self, sheet: str | int = 0) -> Iterator[list[str | None]]:
        """The rows of a sheet that hold something, each as long as its last cell reaches."""
        for columns, lengths in self.blocks(sheet):
            for row, length in zip(zip(*[c.to_pylist() for c in columns]), lengths.tolist()):
                yield list(row[:length])

    def blocks(self, sheet: str | int = 0) -> Iterator[Block]:
        """The rows of a sheet that hold something, a part of the sheet at a time."""
        parser = _Rows()
        # What goes to the parser is the sheet without the rows that are read as bytes, so it is checked as a whole.
        with self.zip.open(self.sheet_path(sheet)) as part:
            data, plain = self._head(part)
            if plain:
                parser.feed(data)
                data = b""
            while plain and (more := part.read(PART_BYTES)):
                data += more
                end = data.rfind(b"</row>") + len(b"</row>")
                if end >= len(b"</row>"):
                    block = self._plain(data[:end])
                    if block is None:
                        break
                    data = data[end:]
                    if len(block[1]):
                        yield block
                plain = b"</sheetData" not in data
            while True:
                parser.feed(data)
                # The last row may go on in the next part.
                yield from self._parsed(parser.complete(1))
                if not (data := part.read(PART_BYTES)):
                    break
            parser.close()
            yield from self._parsed(parser.complete(0))

    @staticmethod
    def _head(part: io.BufferedIOBase) -> tuple[bytes, bool]:
        """A sheet up to its rows, and whether these may be plain ones; else any beginning of it."""
        data = b""
        while len(data) < HEAD_BYTES and (more := part.read(1 << 13)):
            data += more
            found = re.search(rb"<sheetData(\s[^<>]*)?>", data)
            if found is None:
                continue
            head = data[: found.end()]
            named = re.match(rb"<\?xml[^>]*encoding\s*=\s*[\"']([^\"']*)", head)
            if b"<!" in head or head.endswith(b"/>") or (named and named[1].lower() not in (b"utf-8", b"utf8")):
                return data, False
            part.seek(len(head))
            return head, True
        return data, False

    def _parsed(self, elements: Iterator[ElementTree.Element]) -> Iterator[Block]:
        """The rows of row elements in blocks."""
        rows, held = [], 0
        for element in elements:
            row: list[str | None] = []
            for cell in element:
                reference = cell.get("r")
                at = _place(reference) if reference else len(row)
                row += [None] * (at + 1 - len(row))
                row[at] = self._value(cell)
            if any(v is not None and v != "" for v in row):
                rows.append(row)
                held += len(row)
            if held >= BLOCK_CELLS:
                yield _block(rows)
                rows, held = [], 0
        if rows:
            yield _block(rows)

    def _plain(self, data: bytes) -> Block | None:
        """The rows of a part of a sheet that is nothing but rows of plain cells; else None."""
        text = np.frombuffer(data, np.uint8)
        opens, closes = np.flatnonzero(text == ord("<")), np.flatnonzero(text == ord(">"))
        if b"\r" in data or len(opens) != len(closes) or (opens > closes).any() or (closes[:-1] > opens[1:]).any():
            return None
        tags = _tags(text, opens, closes)
        if tags[0] not in (ROW, ROW_EMPTY) or not FOLLOWS[tags[:-1], tags[1:]].all():
            return None
        cells = np.flatnonzero((tags == CELL) | (tags == CELL_EMPTY))
        row = np.cumsum((tags == ROW) | (tags == ROW_EMPTY))[cells] - 1
        rows = int(((tags == ROW) | (tags == ROW_EMPTY)).sum())
        names = _between(data, opens[cells] + 2, closes[cells] - (tags[cells] == CELL_EMPTY))
        if pc.any(pc.match_substring_regex(names, r"\sr\s*=")).as_py():
            places = pc.extract_regex(names, r"^ r=\"(?P<column>[A-Za-z]{1,3})[0-9]+\"")
            if places.null_count:
                return None
            places = places.field("column").dictionary_encode()
            at = np.array([_place(p) for p in places.dictionary.to_pylist()])[places.indices.to_numpy()]
            names = pc.replace_substring_regex(names, r"^ r=\"[A-Za-z]{1,3}[0-9]+\"", "")
        else:
            first = np.searchsorted(row, np.arange(rows))
            at = np.arange(len(cells)) - first[row]
        lengths = np.zeros(rows, np.int64)
        np.maximum.at(lengths, row, at + 1)
        if rows * lengths.max(initial=0) > BLOCK_CELLS:
            return None
        names = names.dictionary_encode()
        try:
            attributes = [ElementTree.fromstring(f"<c{name}/>").attrib for name in names.dictionary.to_pylist()]
        except ElementTree.ParseError:
            return None
        if any("r" in a for a in attributes):
            return None
        # Only cells with a text between the tags of their value hold anything.
        held = np.flatnonzero(np.append(tags[1:], 0)[cells] == VALUE)
        starts, ends = closes[cells[held] + 1] + 1, opens[cells[held] + 2]
        full = ends > starts
        held, values = held[full], _between(data, starts[full], ends[full])
        if b"&" in data:
            values = pa.array([ElementTree.fromstring(f"<v>{v}</v>").text if "&" in v else v for v in values.to_pylist()], pa.string())
        # Cells with the same attributes are read at once.
        of, place, shown, count = names.indices.to_numpy()[held], np.full(len(cells), -1), [], 0
        for k, a in enumerate(attributes):
            mine = np.flatnonzero(of == k)
            if len(mine):
                shown.append(self._all_shown(a.get("t") or "n", values.take(pa.array(mine)), a.get("s")))
                place[held[mine]] = np.arange(count, count + len(mine))
                count += len(mine)
        shown = pa.concat_arrays([pa.array([], pa.string()), *shown])
        where = np.full((rows, int(lengths.max(initial=0))), -1)
        where[row, at] = place
        columns = [shown.take(pa.array(where[:, k], mask=where[:, k] < 0)) for k in range(where.shape[1])]
        holds = np.zeros(rows, bool)
        for column in columns:
            holds |= pc.fill_null(pc.not_equal(column, ""), False).to_numpy(zero_copy_only=False)
        if holds.all():
            return columns, lengths
        return [column.filter(pa.array(holds)) for column in columns], lengths[holds]


def _block(rows: list[list[str | None]]) -> Block:
    return [pa.array(c, pa.string()) for c in zip_longest(*rows)], np.array([len(row) for row in rows])


class _Rows:
    """A parser of sheets whose row elements are taken as soon as they are complete: no step in Python for each element's events."""

    def __init__(self):
        builder = ElementTree.TreeBuilder()
        # Around the sheet's own root, so that what is complete can be seen while the rest is parsed.
        self.root = builder.start("sheet", {})
        self.parser = ElementTree.XMLParser(target=builder)
        self.feed, self.close = self.parser.feed, self.parser.close

    def complete(self, keep: int) -> Iterator[ElementTree.Element]:
        """The rows so far but the last ``keep``, which are dropped from the tree."""
        for parent in [e for top in self.root for e in top if _local(e.tag) == "sheetData"]:
            done = parent[: max(len(parent) - keep, 0)]
            yield from (e for e in done if _local(e.tag) == "row")
            del parent[: len(done)]


def _codes(*tags: tuple[str, int]) -> np.ndarray:
    """Per two bytes at the beginning of a tag, as a number, what tag it may be."""
    table = np.zeros(1 << 16, np.int8)
    for begins, tag in tags:
        table[int.from_bytes(begins.encode(), "little")] = tag
    return table


BEGINS = _codes(("ro", ROW), ("/r", ROW_END), *((f"c{e}", CELL) for e in " >"), ("/c", CELL_END), *((f"v{e}", VALUE) for e in " >"), ("/v", VALUE_END))
BEGINS_EMPTY = _codes(("ro", ROW_EMPTY), *((f"c{e}", CELL_EMPTY) for e in " /"), *((f"v{e}", VALUE_EMPTY) for e in " /"))


def _tags(text: np.ndarray, opens: np.ndarray, closes: np.ndarray) -> np.ndarray:
    """What tag each is, 0 for those that are not of plain rows."""
    codes = np.ndarray((len(text) - 1,), "<u2", text, 0, (1,))[opens + 1]
    tags = np.where(text[closes - 1] == ord("/"), BEGINS_EMPTY[codes], BEGINS[codes])
    tags[((tags == CELL_END) | (tags == VALUE_END)) & (closes - opens != 3)] = 0
    ends = np.flatnonzero(tags == ROW_END)
    tags[ends[(closes[ends] - opens[ends] != 5) | (text[opens[ends] + 3] != ord("o")) | (text[opens[ends] + 4] != ord("w"))]] = 0
    rows = np.flatnonzero((tags == ROW) | (tags == ROW_EMPTY))
    tags[rows[(text[opens[rows] + 3] != ord("w")) | ~np.isin(text[opens[rows] + 4], [ord(e) for e in " >/"])]] = 0
    return tags


def _between(data: bytes, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The texts of ``data`` between places that rise."""
    if not len(starts):
        return pa.array([], pa.string())
    bounds = np.stack([starts, ends], axis=1).ravel().astype(np.int32)
    all_ = pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(data)])
    return all_.take(pa.array(np.arange(0, len(bounds) - 1, 2))).cast(pa.string())


def _header(names: list[str | None]) -> list[str]:
    """Column names from the first row; nameless ones by their number, repeated ones counted on."""
    out: list[str] = []
    for k, name in enumerate(names):
        name = name if name else f"Unnamed: {k}"
        plain, again = name, 0
        while name in out:
            again += 1
            name = f"{plain}.{again}"
        out.append(name)
    return out


def _reader(sheet: str | int, columns: list[str] | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of text in the order of ``columns``; without these, each workbook's own header."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                blocks = Workbook(content.as_py()).blocks(sheet)
                cells, lengths = next(blocks, ([], np.zeros(1, int)))
                names = _header([c[0].as_py() for c in cells[: lengths[0]]])
                if columns is None:
                    yield pa.RecordBatch.from_arrays([pa.array([names], pa.list_(pa.string()))], names=["names"])
                    continue
                missing = [c for c in columns if c not in names]
                if names and missing:
                    raise ValueError(f"A workbook lacks the columns {missing}.")
                at = [names.index(c) for c in columns] if names else []
                for part in chain([[c.slice(1) for c in cells]], (part for part, _ in blocks)):
                    if part:
                        found = [part[k] if k < len(part) else pa.nulls(len(part[0]), pa.string()) for k in at]
                        yield pa.RecordBatch.from_arrays(found, names=[f"c{k}" for k in range(len(found))])

    return read


def sheet_table(contents: DataFrame, sheet: str | int = 0) -> DataFrame:
    """The rows of ``sheet``, by name or number, of the workbooks in the column ``content``.

    All columns are text, named by the first row of the first workbook read; the others must
    have the same columns, in any order. Numbers are written in their shortest form, dates as
    ``2010-12-01 08:26:00``; cells with errors and rows without a value are left out. Texts keep
    their line breaks. Without a workbook it is an error.
    """
    conf = contents.sparkSession.conf
    # A batch holds whole files, so it must not take as many as there are rows in ordinary ones.
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    found = contents.select("content")
    first = found.limit(1).mapInArrow(_reader(sheet, None), "names array<string>").first()
    if first is None:
        raise ValueError("There is no workbook.")
    columns = list(first.names)
    schema = ", ".join(f"c{k} string" for k in range(len(columns)))
    read = found.mapInArrow(_reader(sheet, columns), schema)
    return read.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(columns)])


def read_workbook(spark: SparkSession, path: str, sheet: str | int = 0) -> DataFrame:
    """``sheet_table`` of the workbooks at ``path``: a file, a folder or a pattern."""
    return sheet_table(spark.read.format("binaryFile").load(path).select("content"), sheet)
