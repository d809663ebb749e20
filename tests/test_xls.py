"""Hand-made binary workbooks, with their texts broken between records and their streams in small sectors or large ones."""

import struct

import pytest

from quillstat.sources.ingest import read_frame, validate_upload
from quillstat.sources.xls import sheet_rows

FREE, END, TABLE = 0xFFFFFFFF, 0xFFFFFFFE, 0xFFFFFFFD


def compound(stream):
    """A compound file of one stream: under 4096 bytes it lies in small sectors."""
    pad = lambda b, n: b + b"\0" * (-len(b) % n)
    small = len(stream) < 4096
    data = pad(stream, 64 if small else 512)
    table, sectors = [TABLE, END], []  # the allocation table, the directory
    small_table = b""
    if small:
        n = len(data) // 64
        small_table = pad(b"".join(struct.pack("<I", k + 1 if k + 1 < n else END) for k in range(n)), 512).replace(b"\0\0\0\0" * 1, b"\0\0\0\0")
        table.append(END)
        sectors.append(small_table)
        data = pad(data, 512)
    first = len(table)
    count = len(data) // 512
    table += [first + k + 1 if k + 1 < count else END for k in range(count)]
    assert len(table) <= 128

    def entry(name, kind, start, size):
        raw = (name + "\0").encode("utf-16-le")
        return raw.ljust(64, b"\0") + struct.pack("<HBB", len(raw), kind, 1) + struct.pack("<III", FREE, FREE, 1 if kind == 5 else FREE) + b"\0" * 36 + struct.pack("<IQ", start, size)

    root = entry("Root Entry", 5, first if small else END, count * 512 if small else 0)
    book = entry("Workbook", 2, 0 if small else first, len(stream))
    head = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" + b"\0" * 16 + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + b"\0" * 10 + struct.pack("<I", 1)
    head += struct.pack("<IIIIIII", 1, 0, 4096, 2 if small else END, int(small), END, 0) + struct.pack("<109I", 0, *[FREE] * 108)
    return head + pad(b"".join(struct.pack("<I", t) for t in table), 512) + pad(root + book, 512) + b"".join(sectors) + data


def record(kind, body=b""):
    return struct.pack("<HH", kind, len(body)) + body


def text(t, wide=False):
    return struct.pack("<HB", len(t), int(wide)) + (t.encode("utf-16-le") if wide else t.encode("latin-1"))


def workbook(since_1904=False, filler=0):
    """Names, texts, numbers, packed numbers, dates, booleans, formulas; the second shared text goes over two records."""
    broken = "brøken text over two records"
    shared = struct.pack("<II", 4, 4) + text("name") + struct.pack("<HB", len(broken), 0) + broken[:8].encode("latin-1")
    rest = b"\x01" + broken[8:].encode("utf-16-le") + struct.pack("<HBH", 4, 8, 1) + b"rich" + b"\0" * 4 + text("日本", True)
    top = record(0x0809, struct.pack("<HH", 0x0600, 5) + b"\0" * 12) + record(0x0022, struct.pack("<H", since_1904))
    top += record(0x041E, struct.pack("<H", 170) + text("yyyy\\-mm\\-dd")) + record(0x041E, struct.pack("<H", 171) + text('0.00 "days"'))
    top += b"".join(record(0x00E0, struct.pack("<HH", 0, f) + b"\0" * 16) for f in (0, 14, 170, 171))
    top += record(0x00FC, shared) + record(0x003C, rest) + record(0x00FE, b"x" * filler)
    sheet_at = len(top) + len(record(0x0085, b"\0" * 6 + b"\x01\x00s")) + 4
    top += record(0x0085, struct.pack("<IBB", sheet_at, 0, 0) + b"\x01\x00s") + record(0x000A)
    cell = lambda kind, r, c, xf, body: record(kind, struct.pack("<HHH", r, c, xf) + body)
    sheet = record(0x0809, struct.pack("<HH", 0x0600, 16) + b"\0" * 12)
    sheet += cell(0x00FD, 0, 0, 0, struct.pack("<I", 0)) + cell(0x0204, 0, 1, 0, text("n")) + cell(0x0204, 0, 2, 0, text("day")) + cell(0x0204, 0, 3, 0, text("calc"))
    sheet += cell(0x00FD, 1, 0, 0, struct.pack("<I", 1)) + cell(0x0203, 1, 1, 0, struct.pack("<d", 2.5)) + cell(0x0203, 1, 2, 1, struct.pack("<d", 45352.5)) + cell(0x0006, 1, 3, 0, struct.pack("<d", 8.0) + b"\0" * 8)
    sheet += cell(0x00FD, 2, 0, 0, struct.pack("<I", 2)) + cell(0x027E, 2, 1, 0, struct.pack("<I", (12345 << 2) | 3)) + cell(0x0203, 2, 2, 2, struct.pack("<d", 45352)) + cell(0x0006, 2, 3, 0, b"\0" * 6 + b"\xff\xff" + b"\0" * 8) + record(0x0207, text("said"))
    sheet += cell(0x00FD, 3, 0, 0, struct.pack("<I", 3)) + record(0x00BD, struct.pack("<HH", 3, 1) + struct.pack("<HI", 0, ((-7 << 2) | 2) & 0xFFFFFFFF) + struct.pack("<HI", 3, (44 << 2) | 2) + struct.pack("<H", 2)) + cell(0x0205, 3, 3, 0, b"\x01\x00")
    return top + sheet + record(0x000A)


WANT = [["name", "n", "day", "calc"], ["brøken text over two records", "2.5", "2024-03-01 12:00:00", "8"], ["rich", "123.45", "2024-03-01", "said"], ["日本", "-7", "44", "true"]]


@pytest.mark.parametrize("filler", [0, 6000])
def test_cells_of_a_hand_made_file(filler):
    assert list(sheet_rows(compound(workbook(filler=filler)))) == WANT


def test_the_other_calendar_and_faults():
    rows = list(sheet_rows(compound(workbook(since_1904=True))))
    assert rows[1][2] == "2028-03-02 12:00:00"
    with pytest.raises(ValueError, match="not a binary workbook"):
        list(sheet_rows(b"PK" + b"\0" * 600))
    with pytest.raises(ValueError, match="before 1997"):
        list(sheet_rows(compound(workbook().replace(struct.pack("<HHHH", 0x0809, 16, 0x0600, 5), struct.pack("<HHHH", 0x0809, 16, 0x0500, 5)))))


def test_through_spark(spark, tmp_path):
    (tmp_path / "t.xls").write_bytes(compound(workbook()))
    got = read_frame(spark, str(tmp_path / "t.xls"))
    assert validate_upload("t.xls", 10) is None
    assert dict(got.dtypes)["n"] == "double" and sorted(r["n"] for r in got.collect()) == [-7, 2.5, 123.45]


def test_rows_keep_their_order(spark, tmp_path):
    for k in range(2):
        (tmp_path / f"p{k}.csv").write_text("n,t\n" + "".join(f'{1000 * k + j},"a\n{j}"\n' for j in range(300)))
    got = [r["n"] for r in read_frame(spark, str(tmp_path / "p*.csv")).orderBy("_rid").collect()]
    assert got == [1000 * k + j for k in range(2) for j in range(300)]
