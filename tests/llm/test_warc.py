import base64
import glob
import gzip
import hashlib
import random
import re

import pytest

from geotrail.llm import warc

CRLF = "\r\n"
PAGE = (
    '<html lang="de"><head><title> A &amp;\n B </title><script>var x="</p><a href=no>";</script>'
    "</head><body><!-- <p>gone</p> --><h1>Über &#8364;&#x20ac; &lt;b&gt;</h1>"
    '<p>one  two<br>three</p><style>p{}</style><a class="x" href="/u?a=1">link</a></body></html>'
)
DATE = "2024-01-01T00:00:00Z"


@pytest.fixture(scope="module")
def pages(spark):
    rows = [
        (1, "http://a.example/", PAGE),
        (2, "http://b.example/", None),
        (3, None, ""),
        (4, "http://d.example/", "plain &unknown; <b"),
        (4, "http://d.example/", "plain &unknown; <b"),
        (5, "http://e.example/", "<p>" + "long " * 50_000 + "</p>"),
    ]
    return spark.createDataFrame(
        [(*r, "x", 1) for r in rows], "page_id long, url string, html string, block string, _at int"
    )


@pytest.fixture(scope="module")
def made(pages):
    return warc.derivatives(warc.responses(pages, DATE)).collect()


def of(made, page, kind):
    return next(r for r in made if r.page_id == page and r.warc_type == kind)


def sha1(text):
    return "sha1:" + base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()


def test_two_linked_records_for_each_response(pages, made):
    sent = {r.page_id: r for r in warc.responses(pages, DATE).collect()}
    assert len(made) == 12
    for r in made:
        source = sent[r.page_id]
        assert (r.refers_to, r.target_uri, r.date) == (source.record_id, source.target_uri, DATE)
        assert r.source_block_digest == sha1(source.block)
        assert r.source_payload_digest == sha1(source.block.split(CRLF * 2, 1)[1])
        assert r.block_digest == sha1(r.block) and r.content_length == len(r.block.encode())
    assert len({r.record_id for r in made} | {r.record_id for r in sent.values()}) == 15


def test_metadata(made):
    lines = of(made, 1, "metadata").block.split(CRLF)
    assert lines[0] == "http-status: 200"
    assert "http-header: Content-Type: text/html; charset=utf-8" in lines
    assert f"http-header: Content-Length: {len(PAGE.encode())}" in lines
    assert "title: A & B" in lines and "language: de" in lines and "outlink: /u?a=1" in lines
    assert sum(line.startswith("outlink") for line in lines) == 1


def test_plain_text(made):
    assert of(made, 1, "conversion").block == "Über €€ <b>\none two\nthree\nlink"
    assert of(made, 2, "conversion").block == of(made, 3, "conversion").block == ""
    assert of(made, 4, "conversion").block == "plain &unknown; <b"
    assert len(of(made, 5, "conversion").block) == 50_000 * 5 - 1


def test_files(spark, made, tmp_path):
    path = str(tmp_path / "warc")
    frame = spark.createDataFrame(made)
    warc.write_files(frame.coalesce(1), path)
    (name,) = glob.glob(f"{path}/part-*.gz")
    data = gzip.open(name).read()
    # Read by hand: version, headers, as many bytes as they say, two line ends.
    count = 0
    while data:
        head, _, rest = data.partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.decode().split(CRLF)[1:])
        assert head.startswith(b"WARC/1.1\r\n")
        n = int(fields["Content-Length"])
        assert rest[n : n + 4] == b"\r\n\r\n"
        assert sha1(rest[:n].decode()) == fields["WARC-Block-Digest"]
        data, count = rest[n + 4 :], count + 1
    assert count == 12
    back = warc.read_files(spark, path)
    columns = [c for c in back.columns if c != "complete"]
    assert back.where("complete").count() == 12
    want = sorted(repr(tuple(r[c] for c in columns)) for r in made)
    assert sorted(repr(tuple(r)) for r in back.select(*columns).collect()) == want


def test_blocks_without_a_body(spark):
    rows = [(1, "<urn:uuid:1>", "u", DATE, "HTTP/1.1 404 Not Found"), (2, "<urn:uuid:2>", "u", DATE, None)]
    records = spark.createDataFrame(
        rows, "page_id long, record_id string, target_uri string, date string, block string"
    )
    made = warc.derivatives(records).collect()
    assert of(made, 1, "metadata").block.startswith(f"http-status: 404{CRLF}")
    assert of(made, 2, "conversion").block == ""


def test_empty_table(pages):
    assert warc.derivatives(warc.responses(pages.limit(0), DATE)).count() == 0


def entity(found):
    number = found[0][2:-1]
    code = int(number[1:], 16) if number[0] in "xX" else int(number)
    bad = code == 0 or code > 0x10FFFF or 0xD800 <= code <= 0xDFFF
    return "\ufffd" if bad else chr(code)


def unescaped(text):
    text = re.sub(r"&#(?:[0-9]{1,6}|[xX][0-9a-fA-F]{1,5});", entity, text)
    for name, char in warc.ENTITIES.items():
        text = text.replace(f"&{name};", char)
    return text


def readable(body):
    """One step after the other, over the whole text each time."""
    text = re.sub(rf"(?is)(?:{warc.UNREAD})", " ", body)
    text = re.sub(r"(?s)<!--.*?-->", " ", text)
    text = re.sub(warc.BREAKS, "\n", text)
    text = unescaped(re.sub(r"<[^>]*>", "", text))
    text = re.sub(r"[ \t\r\f\x0B]+", " ", text)
    return re.sub(r" ?\n[ \n]*", "\n", text).strip(" \n")


PIECES = (
    "<script>", "</script >", "<SCRIPT a>", "</Scripts>", "<scripty>", "<style", "</style>",
    "<noscript>", "</noscript>", "<head>", "</HEAD>", "<header>", "</header>", "<!--", "-->", "<br>",
    "<BR/>", "<brown>", "<hr a=1>", "</p>", "</pre>", "</H3>", "</h7>", "</table x>", "<a href=", "<",
    ">", "/", "&", ";", "&amp;", "&amp;lt;", "&#38;lt;", "&#x26;#65;", "&lt;", "&nbsp;", "&#0;",
    "&#xD800;", "&#128512;", "&Amp;", " ", "  ", "\t", "\r", "\n", "\r\n\r\n", "\f", "\x0b", "é", "€", "😀",
    "word", "two words",
)


def test_quicker_steps_give_the_same_text(spark):
    """Forms that pass over less of a text, against the plain ones over all of it."""
    draw = random.Random(3)
    bodies = ["".join(draw.choices(PIECES, k=draw.randint(0, 30))) for _ in range(3000)]
    rows = [(i, f"<urn:uuid:{i}>", "u", DATE, f"HTTP/1.1 200 OK{CRLF * 2}{b}") for i, b in enumerate(bodies)]
    records = spark.createDataFrame(
        rows, "page_id long, record_id string, target_uri string, date string, block string"
    )
    made = warc.derivatives(records).where("warc_type = 'conversion'").collect()
    found = {r.page_id: (r.block, r.source_payload_digest) for r in made}
    assert found == {i: (readable(b), sha1(b)) for i, b in enumerate(bodies)}
    frame = spark.createDataFrame([*enumerate(bodies), (-1, None)], "id long, t string")
    found = {r.id: r.t for r in warc.with_unescaped(frame, "t").collect()}
    assert found == {-1: None, **{i: unescaped(b) for i, b in enumerate(bodies)}}


def test_entities_are_looked_for_behind_an_ampersand(spark):
    """Not in the whole text, nor in the whole title."""
    frame = spark.range(1).selectExpr("id", "concat('plain ', id) as block")
    records = frame.selectExpr("id page_id", "'r' record_id", "'u' target_uri", "'d' date", "block")
    plan = warc.derivatives(records)._jdf.queryExecution().optimizedPlan().toString()
    assert set(re.findall(r"(?i)contains\((\w+)#\d+L?, &#\)", plan)) == {"_rest"}
