"""Workbooks in the Office Open XML format, read and written with nothing but zip and XML: a table a sheet, headers in its first row."""

from __future__ import annotations

import datetime as dt
import re
import zipfile
from collections.abc import Iterable, Iterator
from decimal import Decimal
from pathlib import Path
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

#: What a sheet holds (fixed values of the format).
MOST_ROWS, MOST_COLUMNS, MOST_CHARACTERS, MOST_NAME = 1_048_576, 16_384, 32_767, 31

_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_TYPE = "application/vnd.openxmlformats-officedocument.spreadsheetml"
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'

#: Numbers of built-in formats that show a date or a time (fixed values of the format).
_DATE_FORMATS = frozenset([*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)])

_ILLEGAL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]|_(?=x[0-9A-Fa-f]{4}_)")


def letters(column: int) -> str:
    """The name of a column, from 0: A, B, ..., Z, AA."""
    out = ""
    column += 1
    while column:
        column, rest = divmod(column - 1, 26)
        out = chr(65 + rest) + out
    return out


def _number(name: str) -> int:
    n = 0
    for c in name:
        n = 26 * n + ord(c) - 64
    return n - 1


def _cell(value: object, place: str) -> str:
    if value is None:
        return ""
    if isinstance(value, bool):
        return f'<c r="{place}" t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float, Decimal)) and (isinstance(value, float) and abs(value) < float("inf") or not isinstance(value, float) and abs(value) < 10**15):
        return f'<c r="{place}"><v>{value!r}</v></c>' if not isinstance(value, Decimal) else f'<c r="{place}"><v>{value}</v></c>'
    text = str(value)
    if len(text) > MOST_CHARACTERS:
        raise ValueError(f"a cell of a workbook holds {MOST_CHARACTERS} characters, not {len(text)}; write CSV or Parquet instead")
    text = _ILLEGAL.sub(lambda m: f"_x{ord(m[0]):04X}_", text)
    return f'<c r="{place}" t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'


def write_workbook(path: str | Path, sheets: Iterable[tuple[str, list[str], Iterable]]) -> Path:
    """Writes (name, headers, rows) as sheets, a row at a time. What is beyond a sheet's rows goes on in another, name (2) and so on."""
    path, names = Path(path), []
    path.parent.mkdir(parents=True, exist_ok=True)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED, allowZip64=True) as book:
        for name, headers, rows in sheets:
            if len(headers) > MOST_COLUMNS:
                raise ValueError(f"a sheet holds {MOST_COLUMNS} columns, not {len(headers)}")
            rows, part, more = iter(rows), 0, True
            while more:
                part += 1
                names.append(_sheet_name(name, part, names))
                with book.open(f"xl/worksheets/sheet{len(names)}.xml", "w", force_zip64=True) as f:
                    f.write(f'{_HEAD}<worksheet xmlns="{_MAIN}"><sheetData>'.encode())
                    f.write(_row(1, headers))
                    at, more = 1, False
                    for row in rows:
                        at += 1
                        f.write(_row(at, row))
                        if at == MOST_ROWS:
                            more = True
                            break
                    f.write(b"</sheetData></worksheet>")
        sheets_xml = "".join(f'<sheet name={quoteattr(n)} sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(names, 1))
        book.writestr("xl/workbook.xml", f'{_HEAD}<workbook xmlns="{_MAIN}" xmlns:r="{_OFFICE}"><sheets>{sheets_xml}</sheets></workbook>')
        links = "".join(f'<Relationship Id="rId{i}" Type="{_OFFICE}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(names) + 1))
        book.writestr("xl/_rels/workbook.xml.rels", f'{_HEAD}<Relationships xmlns="{_PACKAGE}/relationships">{links}</Relationships>')
        book.writestr("_rels/.rels", f'{_HEAD}<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_OFFICE}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{_TYPE}.worksheet+xml"/>' for i in range(1, len(names) + 1))
        book.writestr("[Content_Types].xml", f'{_HEAD}<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{_TYPE}.sheet.main+xml"/>{parts}</Types>')
    return path


def _sheet_name(name: str, part: int, taken: list[str]) -> str:
    mark = f" ({part})" if part > 1 else ""
    plain = re.sub(r"[\[\]:*?/\\]", "_", name).strip("'") or "sheet"
    plain = plain[: MOST_NAME - len(mark)] + mark
    if plain.lower() in (t.lower() for t in taken):
        raise ValueError(f"two sheets are named {plain!r}")
    return plain


def _row(number: int, values: Iterable) -> bytes:
    return f'<row r="{number}">{"".join(_cell(v, f"{letters(i)}{number}") for i, v in enumerate(values))}</row>'.encode()


def _text(node: ElementTree.Element) -> str:
    """The text of a string: of its runs, but not of what is written above them to be read aloud."""
    found = "".join([t.text or "" for run in node if run.tag in (f"{{{_MAIN}}}t", f"{{{_MAIN}}}r") for t in ([run] if run.tag == f"{{{_MAIN}}}t" else run.iter(f"{{{_MAIN}}}t"))])
    return re.sub(r"_x([0-9A-Fa-f]{4})_", lambda m: chr(int(m[1], 16)), found)


def _dates(book: zipfile.ZipFile) -> list[bool]:
    """For each cell style, whether it shows a date."""
    if "xl/styles.xml" not in book.namelist():
        return []
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    own = {}
    for f in root.iter(f"{{{_MAIN}}}numFmt"):
        shown = re.sub(r'"[^"]*"|\\.|\[(?!h|m|s)[^\]]*\]', "", f.get("formatCode", "").lower())
        own[int(f.get("numFmtId"))] = bool(re.search("[ymdhs]", shown))
    styles = root.find(f"{{{_MAIN}}}cellXfs")
    return [own.get(n := int(x.get("numFmtId", 0)), n in _DATE_FORMATS) for x in (styles if styles is not None else ())]


def sheet_names(path: str | Path) -> list[str]:
    with zipfile.ZipFile(path) as book:
        return list(_sheets(book))


def _sheets(book: zipfile.ZipFile) -> dict[str, str]:
    """The parts of a workbook's sheets by name, in order."""
    links = {x.get("Id"): x.get("Target") for x in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    found = {}
    for s in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{{{_MAIN}}}sheet"):
        target = links[s.get(f"{{{_OFFICE}}}id")]
        found[s.get("name")] = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
    return found


def read_sheet(path: str | Path, sheet: int | str = 0) -> Iterator[list]:
    """The rows of a sheet, headers first, as lists of numbers, booleans, texts, dates and None; rows without cells, or below the headers with none but empty texts, are left out."""
    if not zipfile.is_zipfile(path):
        raise ValueError(f"{path} is no workbook in the Office Open XML format; save an older one as .xlsx or CSV")
    with zipfile.ZipFile(path) as book:
        sheets = _sheets(book)
        if sheet not in (sheets if isinstance(sheet, str) else range(len(sheets))):
            raise ValueError(f"{path} has no sheet {sheet!r}, but {', '.join(sheets)}")
        part = sheets[sheet] if isinstance(sheet, str) else list(sheets.values())[sheet]
        shared = []
        if "xl/sharedStrings.xml" in book.namelist():
            shared = [_text(x) for x in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{{{_MAIN}}}si")]
        dates = _dates(book)
        late = 'date1904="1"' in book.read("xl/workbook.xml").decode("utf-8", "replace") or 'date1904="true"' in book.read("xl/workbook.xml").decode("utf-8", "replace")
        began = dt.datetime(1904, 1, 1) if late else dt.datetime(1899, 12, 30)
        begun = False
        with book.open(part) as f:
            for _, node in ElementTree.iterparse(f):
                if node.tag != f"{{{_MAIN}}}row":
                    continue
                row: list = []
                for c in node.iter(f"{{{_MAIN}}}c"):
                    at = _number(re.match("[A-Z]+", c.get("r"))[0]) if c.get("r") else len(row)
                    row += [None] * (at - len(row))
                    row.append(_value(c, shared, dates, began))
                node.clear()
                if any(v is not None and (v != "" or not begun) for v in row):
                    begun = True
                    yield row


def _value(c: ElementTree.Element, shared: list[str], dates: list[bool], began: dt.datetime) -> object:
    kind, held = c.get("t", "n"), c.find(f"{{{_MAIN}}}v")
    if kind == "inlineStr":
        inner = c.find(f"{{{_MAIN}}}is")
        return _text(inner) if inner is not None else None
    if held is None or held.text is None:
        return None
    if kind == "s":
        return shared[int(held.text)]
    if kind == "b":
        return held.text.strip() in ("1", "true")
    if kind == "str":
        return held.text
    if kind == "e":
        return None  # an error, such as #N/A
    if kind == "d":
        return dt.datetime.fromisoformat(held.text)
    style, number = int(c.get("s", 0)), float(held.text)
    if style < len(dates) and dates[style]:
        return began + dt.timedelta(milliseconds=round(number * 86_400_000))
    return int(held.text) if re.fullmatch(r"[+-]?\d{1,18}", held.text) else number


def table_of(rows: Iterable[list]) -> tuple[list[str], list[str], list[tuple]]:
    """(names, types, rows) of a sheet's rows: each column in the one type that its values have, else as text.

    Headers that are missing or repeated are told apart as Column 3 and name.1.
    """
    rows = iter(rows)
    head, body = next(rows, []), list(rows)
    width = max([len(head), *map(len, body)], default=0)
    names: list[str] = []
    for i in range(width):
        name = str(head[i]) if i < len(head) and head[i] is not None else f"Column {i + 1}"
        alike = sum(n == name or re.fullmatch(re.escape(name) + r"\.\d+", n) is not None for n in names)
        names.append(f"{name}.{alike}" if alike else name)
    columns = [[r[i] if i < len(r) else None for r in body] for i in range(width)]
    kinds = [_kind([v for v in c if v is not None]) for c in columns]
    turn = {"string": str, "double": float, "bigint": int, "boolean": bool, "date": lambda v: v.date(), "timestamp": lambda v: v}
    shaped = [[None if v is None else turn[k](v) for v in c] for k, c in zip(kinds, columns)]
    return names, kinds, list(zip(*shaped)) if shaped else []


def _kind(values: list) -> str:
    kinds = {type(v) for v in values}
    if not kinds or str in kinds:
        return "string"
    if kinds == {bool}:
        return "boolean"
    if kinds == {dt.datetime}:
        return "date" if all(v.time() == dt.time() for v in values) else "timestamp"
    if kinds <= {int, float}:
        return "bigint" if all(float(v).is_integer() and abs(v) < 2**63 for v in values) else "double"
    return "string"
