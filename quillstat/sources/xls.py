"""The first sheet of an .xls workbook (the binary format of 1997 to 2003), with the standard library only.

The file is a small file system: sectors chained by an allocation table, a directory, and a stream of sectors for what is
small. The workbook is one of its streams, a sequence of records, of which those that hold cells, shared texts, number
formats and the calendar are read. As with .xlsx one task reads a workbook, which holds 65,536 rows at most, and numbers in a
date format become dates as text.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

from quillstat.sources.xlsx import DATE_FORMATS, as_date

#: The magic number, the ends of chains, and the records that are read.
MAGIC = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"
LAST_SECTOR, WORKSHEET, BIFF8 = 0xFFFFFFFA, 0, 0x0600
BOF, EOF, CONTINUE, BOUNDSHEET, DATEMODE, FILEPASS = 0x0809, 0x000A, 0x003C, 0x0085, 0x0022, 0x002F
FORMAT, XF, SST = 0x041E, 0x00E0, 0x00FC
LABELSST, LABEL, NUMBER, RK, MULRK, BOOLERR, FORMULA, STRING = 0x00FD, 0x0204, 0x0203, 0x027E, 0x00BD, 0x0205, 0x0006, 0x0207


class Compound:
    """The streams of a compound file."""

    def __init__(self, content: bytes):
        if content[:8] != MAGIC:
            raise ValueError("not a binary workbook")
        self.content = content
        self.shift, self.small_shift = struct.unpack_from("<HH", content, 30)
        first_entry, _, self.cutoff, first_small, _, extra, _ = struct.unpack_from("<7I", content, 48)
        tables = list(struct.unpack_from("<109I", content, 76))
        seen = 0
        while extra < LAST_SECTOR and seen <= len(content) >> self.shift:  # more places of tables, chained by their last number
            more = struct.unpack(f"<{(1 << self.shift) // 4}I", self._sector(extra))
            tables, extra, seen = tables + list(more[:-1]), more[-1], seen + 1
        self.next = self._numbers(t for t in tables if t < LAST_SECTOR)
        entries = self._chain(first_entry)
        self.entries = {}
        for k in range(0, len(entries) - 127, 128):
            size, kind = struct.unpack_from("<HB", entries, k + 64)
            name = entries[k : k + max(size - 2, 0)].decode("utf-16-le", "replace")
            start, length = struct.unpack_from("<II", entries, k + 116)
            if kind in (2, 5):
                self.entries.setdefault("" if kind == 5 else name, (start, length))
        self.small_next = self._numbers(self._places(first_small)) if first_small < LAST_SECTOR else []
        self.small = self._chain(self.entries[""][0]) if "" in self.entries and self.entries[""][0] < LAST_SECTOR else b""

    def _sector(self, n: int) -> bytes:
        return self.content[(n + 1) << self.shift : (n + 2) << self.shift]

    def _numbers(self, sectors) -> list[int]:
        raw = b"".join(map(self._sector, sectors))
        return list(struct.unpack(f"<{len(raw) // 4}I", raw[: len(raw) // 4 * 4]))

    def _places(self, start: int, table: list[int] | None = None) -> list[int]:
        table, out = self.next if table is None else table, []
        while start < LAST_SECTOR:
            if start >= len(table) or len(out) > len(table):
                raise ValueError("a chain of sectors is broken")
            out.append(start)
            start = table[start]
        return out

    def _chain(self, start: int) -> bytes:
        return b"".join(map(self._sector, self._places(start)))

    def stream(self, *names: str) -> bytes:
        found = next((self.entries[n] for n in names if n in self.entries), None)
        if found is None:
            raise ValueError("the file holds no workbook")
        start, length = found
        if length >= self.cutoff:
            return self._chain(start)[:length]
        width = 1 << self.small_shift
        return b"".join(self.small[k * width : (k + 1) * width] for k in self._places(start, self.small_next))[:length]


def cell_records(book: bytes, at: int = 0) -> Iterator[tuple[int, list[bytes]]]:
    """(type, parts) up to the end of a section; parts beyond the first are continuations."""
    kind, parts = None, []
    while at + 4 <= len(book):
        new, size = struct.unpack_from("<HH", book, at)
        body = book[at + 4 : at + 4 + size]
        at += 4 + size
        if new == CONTINUE:
            parts.append(body)
            continue
        if kind is not None:
            yield kind, parts
        if new == EOF:
            return
        kind, parts = new, [body]


class Texts:
    """Texts one after another in the parts of a record: a text that goes on in the next part has its width anew there."""

    def __init__(self, parts: list[bytes], at: int):
        self.parts, self.part, self.at = parts, 0, at

    def take(self, n: int) -> bytes:
        out = b""
        while len(out) < n and self.part < len(self.parts):
            got = self.parts[self.part][self.at : self.at + n - len(out)]
            out, self.at = out + got, self.at + len(got)
            if len(out) < n:
                self.part, self.at = self.part + 1, 0
        return out

    def text(self, wide_count: bool = True) -> str:
        left = struct.unpack("<H", self.take(2))[0] if wide_count else self.take(1)[0]
        flags = self.take(1)[0]
        runs = struct.unpack("<H", self.take(2))[0] if flags & 8 else 0
        extra = struct.unpack("<I", self.take(4))[0] if flags & 4 else 0
        out = []
        while left:
            width = 2 if flags & 1 else 1
            here = min(left, (len(self.parts[self.part]) - self.at) // width)
            out.append(self.take(here * width).decode("utf-16-le" if width == 2 else "latin-1", "replace"))
            left -= here
            if left:
                self.part, self.at = self.part + 1, 0
                if self.part >= len(self.parts):
                    raise ValueError("a text declares more characters than there are")
                flags = self.take(1)[0]
        self.take(4 * runs + extra)
        return "".join(out)


def packed_number(raw: int) -> float:
    value = float(raw >> 2 if raw < 1 << 31 else (raw >> 2) - (1 << 30)) if raw & 2 else struct.unpack("<d", struct.pack("<Q", (raw & 0xFFFFFFFC) << 32))[0]
    return value / 100 if raw & 1 else value


def sheet_rows(content: bytes) -> Iterator[list[str | None]]:
    book = Compound(content).stream("Workbook", "Book")
    texts, formats, styles, since_1904, sheet = [], set(DATE_FORMATS), [], False, None
    for kind, parts in cell_records(book):
        body = parts[0]
        if kind == BOF and struct.unpack_from("<H", body)[0] != BIFF8:
            raise ValueError("workbooks before 1997 are not read")
        if kind == FILEPASS:
            raise ValueError("the workbook is encrypted")
        if kind == DATEMODE:
            since_1904 = struct.unpack("<H", body[:2])[0] == 1
        elif kind == FORMAT:
            code = re.sub(r'"[^"]*"|\\.|\[[^\]]*\]', "", Texts([body], 2).text()).lower()
            if "y" in code or ("d" in code and "m" in code):
                formats.add(struct.unpack_from("<H", body)[0])
        elif kind == XF:
            styles.append(struct.unpack_from("<H", body, 2)[0])
        elif kind == SST:
            reader = Texts(parts, 8)
            texts = [reader.text() for _ in range(struct.unpack_from("<I", body, 4)[0])]
        elif kind == BOUNDSHEET and sheet is None and body[5] == WORKSHEET:
            sheet = struct.unpack_from("<I", body)[0]
    if sheet is None:
        return
    rows: dict[int, dict[int, str]] = {}

    def put(row: int, column: int, style: int, value: float) -> None:
        text = str(int(value)) if value == int(value) and abs(value) < 1e15 else repr(value)
        dated = style < len(styles) and styles[style] in formats
        rows.setdefault(row, {})[column] = as_date(text, since_1904) if dated else text

    waits: tuple[int, int] | None = None
    for kind, parts in cell_records(book, sheet):
        body = parts[0]
        if kind == STRING and waits:
            rows.setdefault(waits[0], {})[waits[1]] = Texts(parts, 0).text()
            waits = None
        if kind not in (LABELSST, LABEL, NUMBER, RK, MULRK, BOOLERR, FORMULA):
            continue
        row, column, style = struct.unpack_from("<HHH", body)
        if kind == LABELSST:
            rows.setdefault(row, {})[column] = texts[struct.unpack_from("<I", body, 6)[0]]
        elif kind == LABEL:
            rows.setdefault(row, {})[column] = Texts(parts, 6).text()
        elif kind == NUMBER:
            put(row, column, style, struct.unpack_from("<d", body, 6)[0])
        elif kind == RK:
            put(row, column, style, packed_number(struct.unpack_from("<I", body, 6)[0]))
        elif kind == MULRK:
            for k in range((len(body) - 6) // 6):
                own, raw = struct.unpack_from("<HI", body, 4 + 6 * k)
                put(row, column + k, own, packed_number(raw))
        elif kind == BOOLERR and not body[7]:
            rows.setdefault(row, {})[column] = "true" if body[6] else "false"
        elif kind == FORMULA:
            if body[12:14] != b"\xff\xff":
                put(row, column, style, struct.unpack_from("<d", body, 6)[0])
            elif body[6] == 0:
                waits = (row, column)
            elif body[6] == 1:
                rows.setdefault(row, {})[column] = "true" if body[8] else "false"
    for row in sorted(rows):
        yield [rows[row].get(k) for k in range(max(rows[row]) + 1)]
