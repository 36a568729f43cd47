"""Operators 6 and 9."""

import base64
import hashlib
import random
import re
import uuid
from html.parser import HTMLParser

from hypothesis import given, settings
from hypothesis import strategies as st

from tesserae.llm import url_filters, warc
from tesserae.llm.queries import oracle_sql, queries
from tests.compare import DATA, bag, connection


def test_url_query_equals_sql(spark):
    found, wanted = queries()["op6_url_filters"](spark, DATA).toPandas(), connection().sql(oracle_sql()["op6_url_filters"]).df()
    assert bag(found) == bag(wanted)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.text("ab.*?", max_size=5), st.text("/ab*?", max_size=6)), max_size=40), st.lists(st.tuples(st.text("ab.", max_size=6), st.text("/ab", max_size=6)), min_size=1, max_size=10))
def test_automaton_equals_expressions(globs, urls):
    rules = [url_filters.Rule("block", h, p) for h, p in globs]
    glob = lambda g: "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in g)
    found = url_filters.Automaton(rules).matches([h.encode() + b"\0" + p.encode() for h, p in urls])
    want = [[bool(re.fullmatch(glob(h), host, re.S) and re.fullmatch(glob(p), path, re.S)) for h, p in globs] for host, path in urls]
    assert found.tolist() == want


def test_odd_urls(spark):
    rows = [(1, None), (2, ""), (3, "no scheme"), (4, "HTTP://A.Example.COM/en/7?x=/de/"), (5, "http://example.net"), (6, "x://net/de/8#"), (7, "http://com?/en/"), (8, "http://a/" + "b" * 5000 + ".exe"), (1, None), (9, "http://Éxample.com/en/é"), (10, "http://badcom/en/1")]
    df = spark.createDataFrame([(i, u, "h", "r") for i, u in rows], "page_id long, url string, host string, rule string")
    out = {r["page_id"]: (r["host"], r["rule"], r["verdict"]) for r in url_filters.filtered(df).collect()}
    assert out[1] == out[2] == out[3] == ("", None, "allow")
    assert out[4] == ("a.example.com", "example.com/en/7", "allow") and out[5] == ("example.net", None, "allow") and out[6] == ("net", "net/de/", "block")
    assert out[7] == ("com", None, "allow") and out[8][2] == "block" and out[9] == ("Éxample.com", "com/en/", "block") and out[10] == ("badcom", None, "allow")
    assert url_filters.filtered(df).count() == len(rows) and url_filters.filtered(df.limit(0)).count() == 0


def test_rules_of_any_urls(spark):
    draw = random.Random(6)
    part = lambda pool, n: "".join(draw.choice(pool) for _ in range(draw.randrange(n)))
    host = lambda: part(["\0", "\n", "é", "\x7f", "%", ".", "a", "\U0001f600", " ", "@", ":"], 4) + draw.choice(["", ".", "\0."]) + draw.choice(["com", "Example.com", "net", "example.NET", "org", "com\0", "\0com"])
    urls = [part(["h", ":", "\0"], 3) + "://" + host() + draw.choice(["/en/", "/en/7", "/de/", "/de/8", "/es/", "/\0en/", "\0/en/"]) + part(["\0", "\n", "?", "#", "x", "/", "é"], 5) for _ in range(3000)]
    rules = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("block", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
    out = {r["page_id"]: r for r in url_filters.filtered(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()}
    for i, url in enumerate(urls):
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        fits = [(len(h + p), v, h + p) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert (out[i]["host"], out[i]["path"], out[i]["rule"]) == (host, path, max(fits)[2] if fits else None), url
        assert not fits or out[i]["verdict"] == max(fits)[1]


def test_many_rules_equal_expressions(spark):
    """A table of thousands of rules, more than one automaton holds, against one expression a rule."""
    import random

    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(1, 4)))
    rows = [(rng.choice(["allow", "block"]), f"*.{word()}.{word()}", f"/{word()}*{word()}", f"r{i}", i % 50) for i in range(2000)]
    rows += [("block", None, "/", "x", 1)]
    rules = url_filters.rules_of(spark.createDataFrame(rows, "verdict string, host string, path string, name string, weight int"))
    assert len(rules) == 2000 and len(url_filters.parted(rules)) > 3
    urls = [f"http://{word()}.{word()}.{word()}/{word()}{word()}" for _ in range(300)]
    out = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filters.filtered(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules).collect()}
    glob = lambda g: re.compile("".join(".*" if c == "*" else re.escape(c) for c in g), re.S)
    compiled = [(r, glob(r.host), glob(r.path)) for r in sorted(rules, key=lambda r: -r.weight)]
    for i, url in enumerate(urls):
        host, path = "." + url[7:].partition("/")[0], "/" + url[7:].partition("/")[2]
        won = next((r for r, h, p in compiled if h.fullmatch(host) and p.fullmatch(path)), None)
        assert out[i] == ((won.name, won.verdict) if won else (None, "allow"))


PAGE = """<!DOCTYPE html><html><head><title>A &amp; B</title><style>p{x:1}</style></head><body><!-- no --><script>var t="</p>";</script>
<p>One <b>two</b>&nbsp;three</p><div>four<br>five</div><a class=x href="/a?b=1&amp;c=2">l</a> <a href='/z'>m</a>"""


def test_plain_text_and_fields():
    assert warc.plain_text(PAGE) == "One two three\nfour\nfive\nl m"
    assert warc.fields(PAGE) == "title: A & B\r\noutlink: /a?b=1&c=2 L a/@href\r\noutlink: /z L a/@href\r\n"
    assert warc.plain_text("") == warc.fields("") == "" and warc.plain_text("<script>open") == ""


class Reader(HTMLParser):
    """Text and links of a page by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.text, self.links, self.title, self.skipped, self.titled = "", [], None, 0, False

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "template", "noscript"):
            self.skipped += 1
        elif tag == "title":
            self.titled = True
        elif tag not in warc._INLINE:
            self.text += "\n"
        if tag in ("a", "area") and "href" in dict(attrs) and not self.skipped:
            self.links.append(" ".join((dict(attrs)["href"] or "").split()))

    def handle_endtag(self, tag):
        if tag in ("script", "style", "template", "noscript"):
            self.skipped -= 1
        elif tag == "title":
            self.titled = False
        elif tag not in warc._INLINE:
            self.text += "\n"

    def handle_data(self, data):
        if self.titled:
            self.title = (self.title or "") + data
        elif not self.skipped:
            self.text += data


def read(source):
    reader = Reader()
    reader.feed(source)
    reader.close()
    lines = [" ".join(re.split(r"[ \t\r\f\v\xa0]+", line)).strip(" ") for line in reader.text.split("\n")]
    fields = ([f"title: {' '.join(reader.title.split())}"] if reader.title is not None else []) + [f"outlink: {x} L a/@href" for x in reader.links]
    return "\n".join(x for x in lines if x), "".join(f + "\r\n" for f in fields)


def test_derivatives_equal_a_parser(spark):
    """Every record of the given pages and of invented ones: all columns, from a parser of its own and plain hashes."""
    rng = random.Random(3)
    tags = ["<p>", "</p>", "<b>", "</b>", "<div class='x y'>", "</div>", "<br/>", "<a href='/r?a=1&amp;b=2'>", "<a href=''>", "<a href=\" x  y \">", "<A HREF=up.html>", "</a>", "<script>if (a) { b() }</script>", "<style>p {}</style>", "<!-- c -->", "&amp;", "&lt;x&gt;", "&nbsp;", " word ", "é😀", "\n", "\t", "<li>", "<a name=n>"]
    invented = [(1000 + i, f"http://h/{i}", "<html><head><title>T &amp; " + str(i) + "</title></head><body>" + "".join(rng.choice(tags) for _ in range(rng.randint(0, 60))) + "</body></html>") for i in range(60)]
    pages = spark.read.parquet(f"{DATA}/pages.parquet").select("page_id", "url", "html").unionByName(spark.createDataFrame(invented, "page_id long, url string, html string"))
    out = {(r["page_id"], r["warc_type"]): r.asDict() for r in warc.derivatives(warc.responses(pages)).collect()}
    rows = pages.collect()
    assert len(out) == 2 * len(rows)
    sha1 = lambda data: "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()
    named = lambda *parts: f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(chr(0).join(parts).encode()).digest()[:16], version=4)}>"
    for page, url, body in rows:
        payload, date = body.encode(), "1970-01-01T00:00:00Z"
        head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
        source = named("response", str(page), url, date, sha1(payload))
        text, fields = read(body)
        told = fields + f"source-record: {source}\r\nsource-payload-digest: {sha1(payload)}\r\nsource-block-digest: {sha1(head.encode() + payload)}\r\n" + "".join(f"source-http: {x}\r\n" for x in head.split("\r\n") if x)
        for kind, block, content in (("metadata", told, "application/warc-fields"), ("conversion", text, "text/plain; charset=utf-8")):
            own = sha1(block.encode())
            wanted = (page, kind, named(kind, source, own), source, url, date, head, content, len(block.encode()), own, own, sha1(payload), block)
            assert tuple(out[page, kind].values()) == wanted


def test_derivatives_are_linked_and_round_trip(spark, tmp_path):
    rows = [(1, "http://a/", PAGE), (2, None, "x"), (3, "http://b/", None), (4, "http://c/", ""), (1, "http://a/", PAGE), (5, "http://d/", "é\r\n\r\nWARC/1.1 😀" + "long " * 20000)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, block string")
    sources = warc.responses(pages)
    made = warc.derivatives(sources)
    by_id = {r["record_id"]: r for r in sources.collect()}
    out = made.collect()
    assert len(out) == 2 * len(rows) and {r["warc_type"] for r in out} == {"metadata", "conversion"}
    for r in out:
        source = by_id[r["refers_to"]]
        assert (r["target_uri"], r["warc_date"], r["http_headers"], r["source_payload_digest"]) == (source["target_uri"], source["warc_date"], source["http_headers"], source["payload_digest"])
        assert r["block_digest"] == warc.digest(r["block"].encode()) and r["content_length"] == len(r["block"].encode())
        if r["warc_type"] == "metadata":
            assert source["payload_digest"] in r["block"] and source["record_id"] in r["block"]
    both = sources.unionByName(made)
    warc.write_warc(both, str(tmp_path / "w"))
    again = warc.read_warc(spark, str(tmp_path / "w"))
    assert again.columns == both.columns and sorted(map(str, again.collect())) == sorted(map(str, both.collect()))
    assert warc.derivatives(warc.responses(pages.limit(0))).count() == 0


def test_warc_files_with_odd_records(spark, tmp_path):
    """Blocks that hold the end of a record and a version line, records cut short or without a length, and other bytes."""
    inner = b"WARC/1.1\r\nWARC-Type: resource\r\nContent-Length: 2\r\n\r\nok\r\n\r\nWARC/1.0\r\nWARC-Type: x\r\nContent-Length: 1\r\n\r\ny"
    good = lambda kind, block, more=b"": b"WARC/1.1\r\nWARC-Type: " + kind + b"\r\n" + more + b"Content-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"
    whole = good(b"resource", inner) + good(b"metadata", b"") + b"WARC/1.1\r\nWARC-Type: resource\r\n\r\nno length\r\n\r\n" + good(b"resource", b"\xff\xfe", b"X-Page-Id: 7\r\n")
    short = good(b"resource", b"fine") + b"WARC/1.1\r\nWARC-Type: resource\r\nContent-Length: 50\r\n\r\ncut off"
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "a.warc").write_bytes(whole)
    (tmp_path / "w" / "b.warc").write_bytes(short)
    out = sorted((r["warc_type"], r["block"], r["page_id"]) for r in warc.read_warc(spark, str(tmp_path / "w")).where("warc_type <> 'malformed'").collect())
    assert out == sorted([("resource", inner.decode(), None), ("metadata", "", None), ("resource", "\ufffd\ufffd", 7), ("resource", "fine", None)], key=str)
    bad = [r["block"] for r in warc.read_warc(spark, str(tmp_path / "w")).where("warc_type = 'malformed'").collect()]
    assert len(bad) == 2 and any("no length" in b for b in bad) and any("cut off" in b for b in bad)
