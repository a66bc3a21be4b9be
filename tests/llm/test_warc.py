import base64
import hashlib

from rasterweave.llm import warc

SCHEMA = "url string, html string, i string, d string, h string, block string"
HTML = '<html><head><title>A &amp; b</title><script>x<p></script></head><body><h1>Hi</h1><!-- c --><p>one <b>two</b>&nbsp;three<br>four</p><a href="/x?a=1&amp;b=2">l</a></body></html>'


def test_records(spark):
    rows = [("http://a/", HTML, "<urn:uuid:1>", "2024-01-02T03:04:05Z", '{"status":"200"}', "x"), (None, None, None, None, None, None), ("http://b/", "", "<urn:uuid:2>", None, None, ""), ("http://b/", "", "<urn:uuid:2>", None, None, "")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = warc.records(df, record_id="i", date="d", headers="h").collect()
    assert len(got) == 8
    meta, conv = [r for r in got if r.refers_to == "<urn:uuid:1>"]
    assert conv.block == "A & b\nHi\none two three\nfour\nl" and conv.record_type == "conversion"
    want = "sha1:" + base64.b32encode(hashlib.sha1(HTML.encode()).digest()).decode()
    assert meta.payload_digest == conv.payload_digest == want
    assert conv.block_digest == warc.sha1(conv.block.encode()) and '"url":"/x?a=1&b=2"' in meta.block and meta.source_headers == '{"status":"200"}'
    members = {r.record_id: bytes(r.warc) for r in warc.members(warc.records(df, record_id="i", date="d", headers="h")).collect()}
    back = list(warc.parsed(members[meta.record_id] + members[conv.record_id]))
    assert [b.decode() for _, b in back] == [meta.block, conv.block]
    assert back[1][0]["WARC-Refers-To"] == "<urn:uuid:1>" and back[1][0]["WARC-Date"] == "2024-01-02T03:04:05Z"
    again = warc.records(df, record_id="i", date="d", headers="h").collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert warc.records(df.limit(0)).count() == 0


def test_long_page():
    text = "<p>" + "w " * 200_000
    assert len(warc.plain_text(text)) == 399_999


def test_closed_and_unclosed_elements():
    for one in ('<svg class="i"/>', "<iframe/>", "<template/>", "<svg><path d='a'/>x</svg>"):
        assert warc.plain_text(f"<p>a</p>{one}<p>rest</p>") == "a\nrest"
    assert warc.plain_text("<div><p>a</p><svg><g>x</div><p>rest</p><svg>y</svg>") == "a\nrest"
    assert warc.plain_text("<p>a</p><script>b<p>c") == "a"
    page = '<!-- <a href="/no"> --><script src="/s.js">"<a href=/no>"</script><iframe src="/f"></iframe><svg/><a href="/l">l</a>'
    got = warc.json.loads(warc.described(page, {}, None, "", 0))["links"]
    assert [(x["path"], x["url"]) for x in got] == [("script", "/s.js"), ("iframe", "/f"), ("a", "/l")]


def test_from_responses(spark, tmp_path):
    rows = [("http://a/", HTML, "x"), ("http://a/", HTML, "x"), (None, None, None), ("http://b/", "", "")]
    pages = spark.createDataFrame(rows, "url string, html string, `x.y` string").repartition(2)
    made = warc.responses(pages)
    got = warc.derivatives(made).collect()
    assert len(got) == len({r.record_id for r in got}) == 8 and all(r.date == warc.DATE for r in got)
    raw = b"".join(bytes(r.warc) for r in made.collect())
    heads = [h for h, _ in warc.parsed(raw)]
    assert {h["WARC-Record-ID"] for h in heads} == {r.refers_to for r in got} and len(heads) == 4
    for r in got:
        source = warc.json.loads(r.source_headers)
        assert source["status"] == "200" and source["content-type"] == "text/html; charset=utf-8" and source["content-length"].isdecimal()
    joined = spark.createDataFrame([(bytearray(b"noise " + warc.gzip.compress(raw)[:0] + raw + b"WARC/1.1\r\nbroken\r\n\r\n"),)], "warc binary")
    assert sorted(r.block for r in warc.derivatives(joined).collect()) == sorted(r.block for r in got)
    names = warc.written(warc.derivatives(made), f"file://{tmp_path}/out")
    back = [x for n in names for x in warc.parsed((tmp_path / "out" / n).read_bytes())]
    assert sorted(h["WARC-Record-ID"] for h, _ in back) == sorted(r.record_id for r in got)
    assert {h["WARC-Refers-To"] for h, _ in back} == {r.refers_to for r in got}
    assert warc.derivatives(made.limit(0)).count() == 0


def test_bytes_and_headers_that_are_malformed(spark):
    df = spark.sql("select cast(X'61FF62' as string) as url, cast(X'3C703E61FF623C2F703E' as string) as html, 'no json' as h, '[1]' as g")
    meta, conv = warc.records(df, headers="h").collect()
    assert conv.block == "a\ufffdb" and conv.payload_digest == warc.sha1(bytes.fromhex("3C703E61FF623C2F703E")) and meta.source_headers == '{"malformed":"no json"}'
    assert warc.records(df, headers="g").first().source_headers == '{"malformed":"[1]"}'
    assert warc.derivatives(warc.responses(df)).where("record_type = 'conversion'").first().block == "a\ufffdb"
    source, payload = warc.exchanged(b"HTTP/1.1 404 Not Found\r\nno colon\r\nX: 1\r\nx: 2\r\n\r\nbody")
    assert source == {"status": "404", "malformed": "no colon", "x": "1, 2"} and payload == b"body"
    assert warc.decoded("é".encode("latin-1"), {"content-type": "text/html; charset=ISO-8859-1"}) == "é" and warc.decoded(b"a", {"content-type": "x; charset=nonsense"}) == "a"
