"""URL algebra as column expressions: parsing, normalization, resolution. All of it runs in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

URI = r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
# what a path, a query or a fragment can't hold; one character at a time, as alternatives under a star exhaust the stack on long URLs
ODD = r"\x00-\x20\"<>\\^`{|}\x7F-\xA0\p{Zs}\p{Zl}\p{Zp}"
BAD_PATH = rf"[{ODD}\[\]]|%(?![0-9A-Fa-f]{{2}})"
BAD_QUERY = rf"[{ODD}#]|%(?![0-9A-Fa-f]{{2}})"
LONGEST_AUTHORITY = 1000  # a host has 255 characters at most, so that only user information could make a valid one longer
SCHEME_OK = r"\A[A-Za-z][A-Za-z0-9+.\-]*\z"
LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?"
TOP = r"[A-Za-z](?:[A-Za-z0-9\-]*[A-Za-z0-9])?"
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
HOST_OK = rf"(?:(?:{OCTET}\.){{3}}{OCTET}|(?:{LABEL}\.)*{TOP}\.?|\[[0-9A-Fa-f:.]+(?:%[A-Za-z0-9_]+)?\])"
USERINFO = rf"[^@/?#\[\]{ODD}]*"
SERVER = rf"\A(?:({USERINFO})@)?({HOST_OK})(?::([0-9]*))?\z"
DOTS = r"(?:^|/)\.{1,2}(?:/|$)|//"


def part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, URI, group)


def has(url: Column, pattern: str) -> Column:
    return url.rlike(pattern)


def fold_segments(path: Column, keep_leading: bool) -> Column:
    """An absolute path without "." and ".." segments. keep_leading: a ".." that has nothing to remove stays (and empty segments
    go); without it such a ".." goes as well."""
    raw = F.split(path, "/")
    segments = F.filter(raw, lambda s: (s != "") & (s != "."))
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(False).alias("removed"))

    def take(state: Column, s: Column) -> Column:
        kept = state["kept"]
        size = F.size(kept)
        up = (s == "..") & (size > 0) & (F.coalesce(F.try_element_at(kept, F.lit(-1)), F.lit("")) != "..")
        gone = F.struct(F.slice(kept, F.lit(1), F.greatest(size - 1, F.lit(0))).alias("kept"), F.lit(True).alias("removed"))
        if not keep_leading:
            return F.when(s == "..", gone).otherwise(F.struct(F.concat(kept, F.array(s)).alias("kept"), F.lit(False).alias("removed")))
        return F.when(up, gone).otherwise(F.struct(F.concat(kept, F.array(s)).alias("kept"), F.lit(False).alias("removed")))

    done = F.aggregate(segments, start, take)
    last = F.element_at(raw, -1)
    slash = (F.size(done["kept"]) > 0) & ((last == "") | (last == ".") | ((last == "..") & done["removed"]))
    return F.concat(F.lit("/"), F.array_join(done["kept"], "/"), F.when(slash, "/").otherwise(""))


def normalize_path(path: Column) -> Column:
    return F.when(path == "", "/").when(~path.rlike(DOTS), path).otherwise(fold_segments(path, True))


def ascii_host(host: Column) -> Column:
    """Punycode of a host, lower-cased; null where it has none."""
    return F.lower(F.when(host.rlike(r"\A[\x00-\x7F]*\z"), host).otherwise(F.try_reflect(F.lit("java.net.IDN"), F.lit("toASCII"), host, F.lit(1))))


def normalize_url(url: Column, remove_userinfo: bool = True, remove_query: bool = False, remove_fragment: bool = True) -> Column:
    """The normalized URL, or null where it has none: scheme and host lower-cased, the host in ASCII, user information, default
    and empty ports, query and fragment removed as set, dot and empty segments folded, percent escapes untouched. URLs that are
    relative, opaque, without authority or not well-formed have none. Where an authority doesn't parse (such as a host outside
    ASCII) what follows its last "@" is the host, port and all, so that a default port then stays. URLs whose authority has more
    than LONGEST_AUTHORITY characters have none."""
    scheme, authority, path = F.lower(part(url, 1)), part(url, 2), part(url, 3)
    query, fragment = part(url, 4), part(url, 5)
    parsed = F.when(F.length(authority) <= LONGEST_AUTHORITY, authority.rlike(SERVER)).otherwise(False)
    userinfo = F.when(parsed, F.regexp_extract(authority, SERVER, 1)).otherwise("")
    host = F.when(parsed, F.regexp_extract(authority, SERVER, 2)).otherwise(F.regexp_extract(authority, r"([^@]*)@*$", 1))
    port = F.when(parsed, F.regexp_extract(authority, SERVER, 3)).otherwise("")
    default = ((scheme == "http") & (port.cast("int") == 80)) | ((scheme == "https") & (port.cast("int") == 443))
    kept_port = F.when((port == "") | F.coalesce(default, F.lit(False)), "").otherwise(F.concat(F.lit(":"), F.regexp_replace(port, r"^0+(?=[0-9])", "")))
    kept_user = F.lit("") if remove_userinfo else F.when(authority.contains("@") & parsed, F.concat(userinfo, F.lit("@"))).otherwise("")
    server = F.concat(kept_user, ascii_host(host), kept_port)
    kept_query = F.lit("") if remove_query else F.when(url.rlike(r"^[^?#]*\?"), F.concat(F.lit("?"), query)).otherwise("")
    kept_fragment = F.lit("") if remove_fragment else F.when(url.contains("#"), F.concat(F.lit("#"), fragment)).otherwise("")
    ok = scheme.rlike(SCHEME_OK) & (authority != "") & (F.length(authority) <= LONGEST_AUTHORITY) & url.rlike(r"^[^:/?#]+://") & ~path.rlike(BAD_PATH) & ~query.rlike(BAD_QUERY) & ~fragment.rlike(BAD_QUERY) & ~server.rlike(r"%(?![0-9A-Fa-f]{2})") & server.rlike(SERVER) & ~server.rlike(r"[^.@:\[\]]{64}")
    return F.when(ok, F.concat(scheme, F.lit("://"), server, normalize_path(path), kept_query, kept_fragment))


def scheme_and_authority(url: Column) -> Column:
    """scheme://authority as it stands in the URL, the host's key; null where the URL has no authority."""
    return F.when(url.rlike(r"^[^:/?#]+://[^/?#]"), F.regexp_extract(url, r"^([^:/?#]+://[^/?#]*)", 1))


def path_and_query(url: Column) -> Column:
    """What robots rules are matched against."""
    found = F.regexp_extract(url, r"^[^:/?#]+://[^/?#]*([^#]*)", 1)
    return F.when(found == "", "/").when(found.startswith("?"), F.concat(F.lit("/"), found)).otherwise(found)


def resolve(base: Column, reference: Column, root: Column | None = None) -> Column:
    """reference against base by RFC 3986, section 5.2; null where base has no authority. root: scheme_and_authority(base), if at hand."""
    root = scheme_and_authority(base) if root is None else root
    base_path = F.when(part(base, 3) == "", "/").otherwise(part(base, 3))
    tail = F.regexp_extract(reference, r"^[^?#]*(.*)$", 1)
    head = F.regexp_extract(reference, r"^([^?#]*)", 1)
    folder = F.regexp_extract(base_path, r"^(.*/)", 1)
    fold = lambda p: F.when(p.rlike(r"(?:^|/)\.{1,2}(?:/|$)"), fold_segments(p, False)).otherwise(p)
    base_query = F.when(base.rlike(r"^[^?#]*\?"), F.concat(F.lit("?"), part(base, 4))).otherwise("")
    return (
        F.when(reference.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), reference)
        .when(root.isNull(), F.lit(None))
        .when(reference.startswith("//"), F.concat(part(base, 1), F.lit(":"), reference))
        .when(head.startswith("/"), F.concat(root, fold(head), tail))
        .when((head == "") & tail.startswith("?"), F.concat(root, base_path, tail))
        .when(head == "", F.concat(root, base_path, base_query, tail))
        .otherwise(F.concat(root, fold(F.concat(folder, head)), tail))
    )


def redirect_url(url: Column, location: Column) -> Column:
    """Where a redirect leads: an absolute Location as it is, a relative one resolved, its fragment replaced by that of url. Null without Location."""
    absolute = location.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:")
    fragment = F.when(url.contains("#"), F.concat(F.lit("#"), part(url, 5))).otherwise("")
    return F.when(absolute, location).otherwise(F.concat(F.regexp_replace(resolve(url, location), r"#.*$", ""), fragment))
