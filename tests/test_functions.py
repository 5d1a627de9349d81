import pytest
from pyspark.sql import functions as F

from webloom.functions import html, robots, urls
from webloom.plans.catalogue import GOLDENS


def one(spark, column, **values):
    names = list(values)
    ddl = {str: "string", int: "bigint", bool: "boolean", type(None): "string", bytes: "binary"}
    frame = spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} {ddl[type(v)]}" for n, v in values.items()))
    return frame.select(column(*[F.col(n) for n in names]).alias("x")).first()["x"]


def test_goldens_and_idempotence(spark):
    rows = spark.createDataFrame(GOLDENS, "i string, e string").withColumn("o", urls.normalize_url(F.col("i"), True, True, True))
    rows = rows.withColumn("again", urls.normalize_url(F.col("o"), True, True, True)).collect()
    assert [(r.i, r.o) for r in rows] == [(r.i, r.e) for r in rows]
    # a port that stayed behind a host outside ASCII goes once the host is ASCII
    assert all(r.again == r.o for r in rows if r.o and ":443" not in r.o)


@pytest.mark.parametrize(
    ("url", "expected"),
    [
        ("http://a.example/x/../../y", "http://a.example/../y"), ("http://a.example/a/..", "http://a.example/"), ("http://a.example/a/.", "http://a.example/a/"), ("http://a.example/../a/..", "http://a.example/../"),
        ("http://a.example/a b", None), ("http://a.example/%zz", None), ("http://a..example/", None), ("http://", None), ("http:///x", None), ("", None), (None, None), ("http://a.example:99x/", None), ("http://a.example?q", "http://a.example/?q"),
        ("http://a.example:0080/", "http://a.example/"), ("http://1.2.3/", None), ("http://a.example/" + "x" * 5000, "http://a.example/" + "x" * 5000), ("ftp://a.example:80/", "ftp://a.example:80/"),
    ],
)
def test_normalize_edges(spark, url, expected):
    assert one(spark, lambda u: urls.normalize_url(u), u=url) == expected


def test_userinfo_query_and_fragment_can_stay(spark):
    assert one(spark, lambda u: urls.normalize_url(u, False, False, False), u="HTTP://u:p@A.example/?#") == "http://u:p@a.example/?#"


@pytest.mark.parametrize(
    ("reference", "expected"),
    [("g", "http://a/b/c/g"), ("./g/", "http://a/b/c/g/"), ("../../../g", "http://a/g"), ("?y", "http://a/b/c/d;p?y"), ("#s", "http://a/b/c/d;p?q#s"), ("", "http://a/b/c/d;p?q"), ("//g", "http://g"), ("/./g", "http://a/g"), ("g?y/./x", "http://a/b/c/g?y/./x"), ("g:h", "g:h")],
)
def test_rfc3986_resolution(spark, reference, expected):
    assert one(spark, urls.resolve, base="http://a/b/c/d;p?q", reference=reference) == expected


def test_links_native_and_parsed_agree(spark):
    page = '<base target=x><a href="z">1</a><A class=k HREF=\'/w?a=1&amp;b=2\'>2</A><!-- <a href="/no"> --><script>"<a href=\'/js\'>"</script><a href="mailto:a@b">3</a><a href="x">4</a><a name=q>5</a><area href="/area">'
    frame = spark.createDataFrame([("http://h.example/p/q?r", page)], "url string, html string")
    row = frame.select(html.links(F.col("html"), F.col("url")).alias("a"), html.parsed_links(F.col("html"), F.col("url")).alias("b")).first()
    assert row.a == row.b == ["http://h.example/p/z", "http://h.example/w?a=1&b=2", "http://h.example/p/x"]


def test_parser_honours_base_and_nofollow():
    assert html.parse_links('<base href="http://b.example/d/"><a href="e">', "http://a.example/") == ["http://b.example/d/e"]
    assert html.parse_links('<meta name=ROBOTS content="x, NoFollow"><a href="e">', "http://a.example/") == []
    assert html.parse_links(None, "http://a.example/") == html.parse_links("<a href=x>", None) == []


def test_native_links_of_nulls(spark):
    frame = spark.createDataFrame([("http://a.example/", None), (None, '<a href="/x">')], "url string, html string")
    assert [r.a for r in frame.select(html.links(F.col("html"), F.col("url")).alias("a")).collect()] in ([None, []], [[], []])


@pytest.mark.parametrize(
    ("path", "expected"),
    [("/a", False), ("/a/b", True), ("/a/c", False), ("/z.gif", False), ("/z.gif?x", True), ("/q/x/y/end", False), ("/robots.txt", True), ("/", True), ("/same", True)],
)
def test_robots_match(spark, path, expected):
    rules = F.expr("array(" + ",".join(f"named_struct('prefix','{p}','allow',{str(a).lower()})" for p, a in [("/a", False), ("/a/b", True), ("/*.gif$", False), ("/q/*/end", False), ("/same", False), ("/same", True), ("/robots", False)]) + ")")
    assert one(spark, lambda p: robots.allowed(p, F.lit("ALLOW_SOME"), rules), p=path) is expected


def test_robots_groups_merge_and_delay():
    body = b"\xef\xbb\xbfUser-agent: A\nUser-agent: b\nDisallow: /x\nCrawl-delay: 1.5\r\nuser-agent: *\nDisallow: /\nUser-agent: a\nAllow: /x/y # c\n"
    assert robots.parse_robots(body, ["a"]) == {"rule_mode": "ALLOW_SOME", "rules": [{"prefix": "/x/y", "allow": True}, {"prefix": "/x", "allow": False}], "crawl_delay": 1500}
    assert robots.parse_robots(body, ["c"])["rule_mode"] == "ALLOW_NONE"
    assert robots.parse_robots(None, []) == {"rule_mode": "ALLOW_ALL", "rules": [], "crawl_delay": None}


def test_malformed_rules_raise(spark):
    with pytest.raises(Exception, match="malformed robots rule"):
        one(spark, lambda t: robots.decode_rules(t), t="permit: /a")


def test_rules_round_trip(spark):
    text = "allow: /a/b\ndisallow: /a"
    assert one(spark, lambda t: robots.encode_rules(robots.sort_rules(robots.decode_rules(t))), t=text) == text
    assert one(spark, lambda t: robots.encode_rules(robots.decode_rules(t)), t="") == ""


def test_anchors_of_any_quoting(spark):
    from webloom.functions.html import hrefs, parse_links

    html = """<a data-href="/no" href="/y">1</a><a href=/z>2</a><a href="/it's">3</a><a href='/q"r'>4</a><a name=x>5</a><a class="c"
      HREF = "/up">6</a><a href="">7</a>"""
    got = spark.createDataFrame([(html,)], "h string").select(hrefs(F.col("h")).alias("x")).first().x
    assert got == ["/y", "/z", "/it's", '/q"r', "/up", ""]
    assert parse_links(f'<base href="/sub/">{html}<a href="rel?a=1&amp;b=2">', "http://a/x/y")[-1] == "http://a/sub/rel?a=1&b=2"
