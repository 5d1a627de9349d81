"""Links and robots directives of HTML documents: native expressions for tidy markup, an Arrow function for any."""

from __future__ import annotations

from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .urls import resolve

# the value, quoted by either sign or not at all, is one group: what it may hold follows from the character before it
ANCHOR = r"""(?i)<a\s(?:[^>]*?\s)?href\s*=\s*["']?((?<=")[^"]*|(?<=')[^']*|(?<=[=\s])[^\s"'>][^\s>]*)"""
UNREAD = r"(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>"


def decode_body(body: Column) -> Column:
    """Always UTF-8, whatever charset is declared."""
    return F.decode(body, "UTF-8")


def hrefs(html: Column) -> Column:
    """Distinct href values of the anchors, quoted or not, in order. Markup in comments, scripts and styles doesn't count."""
    clean = F.when(html.rlike(r"(?i)<!--|<script|<style"), F.regexp_replace(html, UNREAD, "")).otherwise(html)
    return F.array_distinct(F.transform(F.regexp_extract_all(clean, F.lit(ANCHOR), F.lit(1)), lambda h: F.replace(F.trim(h), F.lit("&amp;"), F.lit("&"))))


def is_http(url: Column) -> Column:
    """The first four characters are "http", in any case; shorter strings are not."""
    return F.lower(F.substring(url, 1, 4)) == "http"


def links(html: Column, url: Column) -> Column:
    """Distinct absolute http links of a page; none where a robots meta tag says nofollow."""
    found = F.filter(F.array_distinct(F.transform(hrefs(html), lambda h: resolve(url, h))), lambda u: u.isNotNull() & is_http(u))
    return F.when(meta_nofollow(html), F.array().cast("array<string>")).otherwise(found)


def has_nofollow(values: Column) -> Column:
    """Any of the comma-separated tokens of the values (an array) is nofollow, in any case."""
    return F.exists(F.flatten(F.transform(values, lambda v: F.split(v, ","))), lambda t: F.lower(F.trim(t)) == "nofollow")


def header_nofollow(headers: Column) -> Column:
    """An X-Robots-Tag header says nofollow ("none" and directives for a named robot don't count)."""
    return F.coalesce(has_nofollow(F.transform(F.filter(headers, lambda h: F.lower(h["name"]) == "x-robots-tag"), lambda h: h["value"])), F.lit(False))


def meta_nofollow(html: Column) -> Column:
    """A meta tag named robots says nofollow."""
    tags = F.regexp_extract_all(html, F.lit(r"""(?i)(<meta\s[^>]*>)"""), F.lit(1))
    robots = F.filter(tags, lambda t: t.rlike(r"""(?i)\sname\s*=\s*["']?robots["']?[\s/>]"""))
    content = F.transform(robots, lambda t: F.regexp_extract(t, r"""(?i)\scontent\s*=\s*["']([^"']*)["']""", 1))
    return F.coalesce(has_nofollow(content), F.lit(False))


class Anchors(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.hrefs: list[str] = []
        self.base: str | None = None
        self.nofollow = False

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        values = {k: v or "" for k, v in reversed(attrs)}
        if tag == "a" and "href" in values:
            self.hrefs.append(values["href"].strip())
        elif tag == "base" and self.base is None and values.get("href"):
            self.base = values["href"].strip()
        elif tag == "meta" and values.get("name", "").lower() == "robots":
            self.nofollow |= any(t.strip().lower() == "nofollow" for t in values.get("content", "").split(","))


def parse_links(html: str | None, url: str | None) -> list[str]:
    """As links(), by a tolerant parser, with <base href> and all character references."""
    if not html or not url:
        return []
    anchors = Anchors()
    anchors.feed(html)
    anchors.close()
    if anchors.nofollow:
        return []
    found: dict[str, None] = {}
    for href in anchors.hrefs:
        try:
            absolute = urljoin(urljoin(url, anchors.base) if anchors.base else url, href)
        except ValueError:
            continue
        if absolute[:4].lower() == "http":
            found[absolute] = None
    return list(found)


@F.arrow_udf(T.ArrayType(T.StringType()))
def parsed_links(html: pa.Array, url: pa.Array) -> pa.Array:
    return pa.array([parse_links(h, u) for h, u in zip(html.to_pylist(), url.to_pylist())], pa.list_(pa.string()))
