"""Archives of other writers: dates of their own, plain line ends, records that are no HTTP responses."""

import hashlib

from broadsheet.llm import archives


def line(url, date, mime, block):
    return f"{url} 1.2.3.4 {date} {mime} {len(block)}\n".encode() + block + b"\n"


def page(number, body, end=b"\r\n"):
    return end.join([b"HTTP/1.1 200 OK", f"X-Page-Id: {number}".encode(), b"", body])


def test_revisits_name_the_response_with_its_own_date(spark, tmp_path):
    same, small = b"x" * 1500, b"short\n\nbody"
    folder = tmp_path / "arc"
    folder.mkdir()
    (folder / "a.arc").write_bytes(
        line("http://a/", "20040102030405", "text/html", page(1, same)) + line("dns:a.example", "20040102030405", "text/dns", b"a. 60 IN A 1.2.3.4")
        + line("http://b/", "200502030405", "text/html", page(2, same)))
    (folder / "b.arc").write_bytes(
        line("http://c/", "20030101", "text/html", page(3, small, b"\n")) + line("http://d/", "20060101000000", "text/html", page(4, same, b"\n")))
    archives.write_warcs(archives.arc_records(spark, str(folder)), str(tmp_path / "warc"))
    rows = archives.warc_records(spark, str(tmp_path / "warc")).collect()
    by_page = {r.page_id: r for r in rows}
    assert [by_page[p].record_type for p in (1, 2, 3, 4)] == ["revisit", "revisit", "response", "response"]
    assert [by_page[p].refers_to for p in (1, 2, 3, 4)] == [4, 4, None, None]
    assert by_page[1].refers_id == by_page[2].refers_id == by_page[4].record_id
    assert [by_page[p].date for p in (1, 2, 3, 4)] == [
        "2004-01-02T03:04:05Z", "2005-02-03T04:05:00Z", "2003-01-01T00:00:00Z", "2006-01-01T00:00:00Z"]
    assert (by_page[3].payload_bytes, by_page[3].payload_digest) == (len(small), hashlib.sha1(small).hexdigest())
    dns = by_page[None]
    assert (dns.record_type, dns.payload_bytes, dns.uri) == ("resource", 18, "dns:a.example")


def test_referred_dates_stand_in_the_record():
    row = {"uri": "http://a/", "date": "20040102030405", "digest": "ab" * 20, "page_id": 1, "payload_bytes": 1500, "mime": "text/html",
           "block": page(1, b"x" * 1500), "refers_page": 4, "refers_uri": "http://d/", "refers_date": "20060101000000"}
    (fields, block), = archives.parse_warc(archives.warc_record(row) + archives.END.encode())
    assert fields["WARC-Refers-To-Date"] == "2006-01-01T00:00:00Z" and fields["WARC-Date"] == "2004-01-02T03:04:05Z"
    assert fields["WARC-Refers-To"] == archives.record_id("http://d/", "20060101000000", "ab" * 20, 4)
    assert block.endswith(b"\r\n\r\n") and "X-Refers-To-Page" not in fields
