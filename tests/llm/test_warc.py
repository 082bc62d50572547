import gzip
import hashlib
import io
import time
import uuid
from base64 import b32encode
from html.parser import HTMLParser

import pytest

from lexaudit.llm import pages as html_pages
from lexaudit.llm import queries, warc

PAGES = [
    (1, "http://a.example/x", '<html lang="en"><head><title>A &amp; B</title><style>p{}</style></head><body><p>One<br>two <b>three</b></p><script>var t="</p>";</script><a href="/l?a=1&amp;b=2">link</a><!-- gone --></body></html>'),
    (2, None, "<p>no url"),
    (3, "http://b.example/", None),
    (4, "http://c.example/", ""),
    (5, "http://d.example/", "<p>" + "é\U0001f600 " * 200_000),
    (None, "http://e.example/", "plain < text &lt;b&gt;"),
    (1, "http://a.example/x", "<p>again</p>"),
    (1, "http://a.example/x", "<p>again</p>"),
]


def digest(data):
    return "sha1:" + b32encode(hashlib.sha1(data).digest()).decode()


def one(record):
    (fields, block), = warc.parse(io.BytesIO(record))
    return dict(fields), block


def test_records_of_a_page_table(spark):
    pages = spark.createDataFrame([(*p, "y", 1, "z") for p in PAGES], "page_id long, url string, html string, block string, row int, record_type string")
    rows = [r.asDict() for r in warc.derive(warc.responses(pages)).collect()]
    assert len(rows) == 2 * len(PAGES)
    for r in rows:
        head, block = one(warc.serialize(r))
        assert block.decode() == r["block"] and head["WARC-Refers-To"] == r["refers_to"] and head["WARC-Type"] == r["record_type"]
        assert head["WARC-Block-Digest"] == digest(block) and head.get("WARC-Target-URI") == r["target_uri"]
        assert head["WARC-Source-Payload-Digest"] == r["payload_digest"] and int(head["Content-Length"]) == r["content_length"] == len(block)
    by_page = {(r["page_id"], r["record_type"], r["payload_digest"]): r for r in rows}
    first = [r for r in rows if r["payload_digest"] == digest(PAGES[0][2].encode())]
    meta, text = sorted(first, key=lambda r: r["record_type"], reverse=True)
    assert text["block"] == "A & B\nOne\ntwo three\nlink"
    assert meta["block"] == (
        f"title: A & B\r\nlanguage: en\r\nsource-digest: {meta['payload_digest']}\r\nsource-header-Content-Type: text/html; charset=utf-8\r\nsource-header-Server: crawl\r\noutlink: /l?a=1&b=2\r\n"
    )
    assert meta["refers_to"] == text["refers_to"] != meta["record_id"] != text["record_id"]
    assert by_page[3, "conversion", digest(b"")]["block"] == ""
    assert any(r["block"] == "plain < text <b>" for r in rows)
    assert warc.derive(warc.responses(pages.limit(0))).count() == 0


def response(i, http, body, extra=()):
    block = "\r\n".join(["HTTP/1.1 200 OK", *(f"{k}: {v}" for k, v in http)]).encode() + b"\r\n\r\n" + body
    fields = [("WARC-Type", "response"), ("WARC-Record-ID", f"<urn:uuid:{uuid.UUID(int=i)}>"), ("warc-date", "2021-05-06T07:08:09Z"), ("WARC-Target-URI", f"http://s{i}.example/"), *extra, ("Content-Length", len(block))]
    return b"WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def test_files_keep_ids_headers_and_digests(spark, tmp_path):
    given = [
        (1, [("content-type", "text/html"), ("ETag", '"x"'), ("Set-Cookie", "a=1"), ("Set-Cookie", "b=2"), ("X-Odd", "p: q")], b"<title>T</title>x", [("WARC-Payload-Digest", "sha1:GIVEN")]),
        (2, [("Content-Type", "text/html; charset=ISO-8859-1")], "caf\u00e9".encode("latin-1"), []),
        (3, [], b"", []),
    ]
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    records = [info, *(response(*g) for g in given)]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(map(gzip.compress, records)))
    (tmp_path / "b.warc").write_bytes(response(9, [], b"plain"))
    found = warc.read(spark, str(tmp_path))
    rows = {r["record_id"]: r for r in found.collect()}
    assert len(rows) == 4
    for i, http, body, extra in given:
        r = rows[f"<urn:uuid:{uuid.UUID(int=i)}>"]
        assert [(h["name"], h["value"]) for h in r["http_headers"]] == http and r["date"] == "2021-05-06T07:08:09Z" and r["url"] == f"http://s{i}.example/"
        assert r["payload_digest"] == (extra[0][1] if extra else digest(body))
    assert rows[f"<urn:uuid:{uuid.UUID(int=2)}>"]["payload"] == "caf\u00e9"
    made = warc.derive(found)
    back = {(r["refers_to"], r["record_type"]): r for r in made.collect()}
    assert len(back) == 8 and {k[0] for k in back} == set(rows)
    block = back[f"<urn:uuid:{uuid.UUID(int=1)}>", "metadata"]["block"]
    assert [x for x in block.split("\r\n") if x.startswith("source-")] == ["source-digest: sha1:GIVEN", *(f"source-header-{k}: {v}" for k, v in given[0][1])]
    written = warc.write(made, f"{tmp_path}/out").collect()
    assert sum(r["n_records"] for r in written) == 8
    again = [one_ for r in written for one_ in warc.parse(warc.opened(r["path"]))]
    assert sorted(dict(f)["WARC-Record-ID"] for f, _ in again) == sorted(r["record_id"] for r in back.values())
    assert all(digest(block) == dict(f)["WARC-Block-Digest"] for f, block in again)


class Plain(HTMLParser):
    """Title, language and links by another parser."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.title, self.lang, self.links, self.inside, self.done = "", "", [], False, False
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        attrs = dict(reversed(attrs))
        if tag == "title" and not self.done:
            self.inside = True
        if tag == "html" and not self.lang:
            self.lang = attrs.get("lang") or ""
        if tag == "a" and attrs.get("href"):
            self.links.append(" ".join(attrs["href"].split()))

    def handle_endtag(self, tag):
        if tag == "title":
            self.done, self.inside = True, False

    def handle_data(self, data):
        self.title += data if self.inside else ""


def test_query_against_brute_force(spark):
    """Every field of both records of every page; texts are checked in test_rows."""
    sf = "/root/testdata/sf0.01"
    source = {r["page_id"]: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = {(r["page_id"], r["record_type"]): r for r in queries.op1_warc_derivatives(spark, sf).collect()}
    assert len(rows) == 2 * len(source)
    for i, page in source.items():
        meta, text = rows[i, "metadata"], rows[i, "conversion"]
        known = digest((page["html"] or "").encode())
        name = uuid.uuid5(warc.SPACE, chr(0).join(("response", str(i), page["url"] or "", known)))
        seen = Plain(page["html"] or "")
        want = [("title", " ".join(seen.title.split())), ("language", seen.lang), ("source-digest", known), ("source-header-Content-Type", "text/html; charset=utf-8"), ("source-header-Server", "crawl"), *(("outlink", x) for x in seen.links)]
        assert meta["block"] == "".join(f"{k}: {v}\r\n" for k, v in want if v), i
        for r in (meta, text):
            assert r["refers_to"] == f"<urn:uuid:{name}>" and r["record_id"] == f"<urn:uuid:{uuid.uuid5(warc.SPACE, r['record_type'] + chr(0) + r['refers_to'])}>"
            assert (r["payload_digest"], r["block_digest"], r["content_length"], r["target_uri"]) == (known, digest(r["block"].encode()), len(r["block"].encode()), page["url"])


@pytest.mark.parametrize("piece", ["<a ", "<title>", "<script>", "<!--", "<", "</", "<a href=x ", "<a b>", "&#9", "&", "<svg/>", "a='", "<p <"])
def test_a_page_takes_time_by_its_length(piece):
    page = piece * (1_000_000 // len(piece))
    began = time.perf_counter()
    html_pages.read(page)
    html_pages.read(f"<a {page}>")
    assert time.perf_counter() - began < 8


def test_numbers_beyond_unicode():
    assert html_pages.read("a&#" + "9" * 6000 + ";b&#x41;&#00000065;")[0] == "a\ufffdbAA"
