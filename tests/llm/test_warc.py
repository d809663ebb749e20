import hashlib

import pytest

from quillstat.llm.warc import arc_opening, arc_record, convert_arc, mark_revisits, op5_warc, pages_to_arc, parse_arc, parse_warc, read_warc, write_warc

SCHEMA = "page_id bigint, url string, html string, record_type string"


def brute(rows):
    large = {}
    for i, _, html in rows:
        body = (html or "").encode()
        if len(body) >= 1000:
            large[body] = max(large.get(body, i), i)
    out = {}
    for i, _, html in rows:
        body = (html or "").encode()
        lead = large.get(body)
        again = lead is not None and lead != i
        out[i] = (len(body), hashlib.sha1(body).hexdigest(), "revisit" if again else "response", lead if again else None)
    return out


def through(spark, folder, rows):
    pages = spark.createDataFrame([(*r, "theirs") for r in rows], SCHEMA)
    write_warc(mark_revisits(convert_arc(pages_to_arc(pages))), folder)
    return read_warc(spark, folder).collect()


ROWS = [
    (1, "http://a/", None), (2, None, ""), (3, "http://b/ c\n", "x" * 999), (4, "http://c/", "x" * 999), (5, "http://d/", "y" * 1000), (6, "http://e/", "y" * 1000),
    (7, "http://f/", "é" * 500), (8, "http://g/", "é" * 500), (9, "http://h/", "a\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n"), (10, "", "z\n" * 200_000), (11, "http://i/", "HTTP/1.1 fake"),
    (12, "http://j/", "y" * 1000), (13, "http://k/", "\r\n\r\n"), (14, "http://ü/", "日本" * 400),
]


def test_round_trip_of_edges(spark, tmp_path):
    got = through(spark, str(tmp_path / "w"), ROWS)
    want = brute(ROWS)
    pages = {r["page_id"]: r for r in got if r["record_type"] in ("response", "revisit")}
    by_id = {r["record_id"]: r["page_id"] for r in got}
    assert len(by_id) == len(got)
    for i, _, html in ROWS:
        r = pages[i]
        assert (r["payload_bytes"], r["payload_sha1"], r["record_type"], by_id.get(r["refers_to_id"])) == want[i]
        assert r["declared_sha1"] == r["payload_sha1"]
        if r["record_type"] == "response":
            assert bytes(r["block"]).split(b"\r\n\r\n", 1)[1] == (html or "").encode()
    assert pages[2]["target_uri"] == "-" and pages[3]["target_uri"] == "http://b/%20c%0A"


def test_query_on_whole_pages(spark, sf_dir):
    rows = [(r["page_id"], r["url"], r["html"]) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    got = {r["page_id"]: (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in op5_warc(spark, sf_dir).collect()}
    assert got == brute(rows)


@pytest.mark.parametrize("version", [1, 2])
def test_arc_versions(version):
    body = b"HTTP/1.1 200 OK\r\n\r\nhello\n"
    content = arc_opening(version, "one.arc", "20200102030405") + arc_record(version, "http://x/", "20200102030405", "text/html", body, 99, "one.arc")
    (_, head, _), (_, second, got) = parse_arc(content)
    assert head["URL"] == "filedesc://one.arc" and second["URL"] == "http://x/" and got == body
    assert ("Checksum" in second) == (version == 2)


def test_arc_faults_are_errors():
    good = arc_opening(1, "a", "20200102030405")
    with pytest.raises(ValueError, match="declares"):
        list(parse_arc(good + b"http://x/ 0.0.0.0 20200102030405 text/html 50\nshort\n"))
    with pytest.raises(ValueError, match="fields"):
        list(parse_arc(good + b"http://x/ 20200102030405 5\nshort\n"))


def test_conversion_is_the_same_each_time(spark):
    archives = pages_to_arc(spark.createDataFrame([(k, f"http://{k}/", "t", "x") for k in range(5)], SCHEMA).coalesce(1))
    first, again = (sorted(tuple(r) for r in convert_arc(archives).collect()) for _ in range(2))
    assert first == again
    kinds = [r["record_type"] for r in convert_arc(archives).collect()]
    assert kinds.count("warcinfo") == 1 and kinds.count("response") == 5
    assert all(r["record_date"].startswith("2024-01-01T") for r in convert_arc(archives).collect())


def test_empty_and_foreign(spark, tmp_path):
    assert [r for r in through(spark, str(tmp_path / "none"), []) if r["record_type"] != "warcinfo"] == []
    other = b"WARC/1.0\r\nWARC-Type: metadata\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    assert list(parse_warc(other)) == [({"warc-type": "metadata", "content-length": "3"}, b"abc")]
    with pytest.raises(ValueError, match="more bytes"):
        list(parse_warc(other.replace(b": 3", b": 30")))


def test_null_ids_read_back(spark, tmp_path):
    got = through(spark, str(tmp_path / "n"), [(None, "http://a/", "t"), (-4, "http://b/", "t"), (-4, "http://b/", "t")])
    assert sorted(str(r["page_id"]) for r in got if r["record_type"] == "response") == ["-4", "-4", "None"]


def test_any_bytes_survive(spark, tmp_path):
    """From an ARC file, plain or compressed as a whole or by records, to a WARC file and back."""
    body = b"HTTP/1.1 200 OK\r\nX-Own: \xe9\xff\r\n\r\n" + bytes(range(256)) * 8
    parts = [arc_opening(1, "one.arc", "20200102030405")]
    parts += [arc_record(1, f"http://x/{k}", "20200102030405", "image/png", body + bytes([k]) * 3) for k in range(3)]
    parts += [arc_record(1, "http://big/", "20200102030405", "image/png", b"HTTP/1.1 200 OK\r\n\r\n" + bytes(range(256)) * 70_000)]
    whole = b"".join(parts)
    forms = {"plain": whole, "one": member_of(whole), "many": b"".join(map(member_of, parts))}
    for name, content in forms.items():
        assert [(at, head["URL"], got) for at, head, got in parse_arc(content)] == [(at, head["URL"], got) for at, head, got in parse_arc(whole)], name
    archives = spark.createDataFrame([("a", bytearray(forms["many"]))], "path string, content binary")
    folder = str(tmp_path / "bytes")
    write_warc(mark_revisits(convert_arc(archives)), folder)
    got = {r["target_uri"]: r for r in read_warc(spark, folder).collect() if r["record_type"] == "response"}
    for k in range(3):
        r = got[f"http://x/{k}"]
        assert bytes(r["block"]) == body + bytes([k]) * 3
        assert r["payload_sha1"] == r["declared_sha1"] == hashlib.sha1(bytes(range(256)) * 8 + bytes([k]) * 3).hexdigest()
    assert got["http://big/"]["payload_bytes"] == 256 * 70_000 and got["http://big/"]["payload_sha1"] == got["http://big/"]["declared_sha1"]


def member_of(raw):
    import gzip

    return gzip.compress(raw)


def test_a_gzip_member_a_record_and_files_by_bytes(spark, tmp_path, monkeypatch):
    import gzip
    import zlib
    from pathlib import Path

    from quillstat.llm import warc

    pages = spark.createDataFrame([(k, f"http://{k}/", f"{k} " * 400, "x") for k in range(40)], SCHEMA).coalesce(1)
    folder = tmp_path / "files"
    monkeypatch.setattr(warc, "FILE_BYTES", 10_000)
    write_warc(mark_revisits(convert_arc(pages_to_arc(pages))), str(folder))
    files, records = list(folder.glob("volume=*/part-*")), 0
    assert len(files) > 3
    for f in files:
        rest = f.read_bytes()
        assert len(gzip.decompress(rest)) < 12_000
        while rest:
            one = zlib.decompressobj(31)
            raw = one.decompress(rest)
            assert one.eof and raw.startswith(b"WARC/1.1\r\n") and raw.endswith(b"\r\n\r\n") and raw.count(b"WARC-Type:") == 1
            rest, records = one.unused_data, records + 1
    assert records == 41 and read_warc(spark, str(folder)).count() == 41
