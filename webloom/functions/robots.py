"""Robots exclusion: parsing, text encoding, rule choice, delays and lifetimes."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import ALLOW_ALL, ALLOW_NONE, ALLOW_SOME, RULES

PARSED = pa.struct([("rule_mode", pa.string()), ("rules", pa.list_(pa.struct([("prefix", pa.string()), ("allow", pa.bool_())]))), ("crawl_delay", pa.int64())])
PARSED_DDL = f"struct<rule_mode:string,rules:{RULES},crawl_delay:bigint>"


def parse_robots(body: bytes | None, agents: list[str]) -> dict:
    """Rules for the first that applies of: all groups that name one of agents (product tokens, lower case), all groups for "*",
    none. rules are sorted, the most specific first; crawl_delay is in milliseconds, null where unset."""
    text = (body or b"").decode("utf-8", "replace").removeprefix("﻿")
    groups: list[tuple[set[str], list[tuple[str, bool]], list[float]]] = []
    open_names = False
    for line in re.split(r"\r\n|\r|\n", text):
        line = line.split("#", 1)[0].strip()
        name, colon, value = line.partition(":")
        if not colon:
            continue
        name, value = name.strip().lower(), value.strip()
        if name == "user-agent":
            if not open_names:
                groups.append((set(), [], []))
                open_names = True
            groups[-1][0].add(value.lower())
        elif name in ("allow", "disallow", "crawl-delay"):
            open_names = False
            if not groups:
                continue
            if name == "crawl-delay":
                try:
                    groups[-1][2].append(float(value))
                except ValueError:
                    pass
            elif value:
                groups[-1][1].append((value, name == "allow"))
    token = lambda a: re.match(r"[a-z_\-]*", a).group()
    mine = [g for g in groups if any(a in agents or (token(a) and token(a) in agents) for a in g[0])]
    mine = mine or [g for g in groups if "*" in g[0]]
    rules = sorted({r for g in mine for r in g[1]}, key=lambda r: (-len(r[0]), not r[1], r[0]))
    delays = [d for g in mine for d in g[2]]
    return {"rule_mode": infer_mode(rules), "rules": [{"prefix": p, "allow": a} for p, a in rules], "crawl_delay": round(delays[-1] * 1000) if delays else None}


def infer_mode(rules: list[tuple[str, bool]]) -> str:
    if not any(not allow for _, allow in rules):
        return ALLOW_ALL
    return ALLOW_NONE if rules == [("/", False)] else ALLOW_SOME


def parse(body: Column, agents: tuple[str, ...] = ()) -> Column:
    names = [a.lower() for a in agents]

    def run(bodies: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in bodies:
            yield pa.array([parse_robots(b, names) for b in batch.to_pylist()], PARSED)

    run.__annotations__ = {"bodies": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, PARSED_DDL)(body)


def truncate(body: Column, limit: int = 512_000) -> Column:
    return F.substring(body, 1, limit)


def sort_rules(rules: Column) -> Column:
    """Most specific first: the longer pattern, then allow, then the pattern itself."""
    keyed = F.transform(rules, lambda r: F.struct((-F.length(r["prefix"])).alias("n"), (~r["allow"]).alias("d"), r["prefix"].alias("prefix"), r["allow"].alias("allow")))
    return F.transform(F.array_sort(keyed), lambda r: F.struct(r["prefix"].alias("prefix"), r["allow"].alias("allow")))


def encode_rules(rules: Column) -> Column:
    return F.array_join(F.transform(rules, lambda r: F.concat(F.when(r["allow"], "allow: ").otherwise("disallow: "), r["prefix"])), "\n")


def decode_rules(text: Column) -> Column:
    """Inverse of encode_rules(); no text means no rules, and a line of another form raises."""
    line = r"^(allow|disallow): (.*)$"

    def one(s: Column) -> Column:
        fine = F.when(s.rlike(line), s).otherwise(F.raise_error(F.concat(F.lit("malformed robots rule: "), s)))
        return F.struct(F.regexp_extract(fine, line, 2).alias("prefix"), (F.regexp_extract(fine, line, 1) == "allow").alias("allow"))

    return F.transform(F.filter(F.split(text, "\n"), lambda s: s != ""), one)


def rule_mode(rules: Column) -> Column:
    """ALLOW_ALL without disallow rules, ALLOW_NONE for the sole rule "disallow: /", else ALLOW_SOME."""
    only = (F.size(rules) == 1) & F.exists(rules, lambda r: (r["prefix"] == "/") & ~r["allow"])
    return F.when(~F.exists(rules, lambda r: ~r["allow"]), ALLOW_ALL).when(only, ALLOW_NONE).otherwise(ALLOW_SOME)


def pattern(prefix: Column) -> Column:
    """The regular expression of a rule with "*" or a final "$"."""
    quoted = F.regexp_replace(F.regexp_replace(prefix, r"\$$", ""), r"([\\.\[\]{}()+\-^$?|])", r"\\$1")
    return F.concat(F.lit("^"), F.regexp_replace(quoted, r"\*", ".*"), F.when(prefix.endswith("$"), "$").otherwise(""))


def matches(path: Column, prefix: Column) -> Column:
    return F.when(prefix.rlike(r"\*|\$$"), F.rlike(path, pattern(prefix))).otherwise(path.startswith(prefix))


def allowed(path: Column, mode: Column, rules: Column) -> Column:
    """The longest matching rule decides, allow wins ties, no match allows; rules need not be sorted. /robots.txt is always allowed."""
    met = F.filter(rules, lambda r: matches(path, r["prefix"]))
    best = F.array_max(F.transform(met, lambda r: F.struct(F.length(r["prefix"]).alias("n"), r["allow"].alias("allow"))))
    return F.when((path == "/robots.txt") | (mode == ALLOW_ALL), True).when(mode == ALLOW_NONE, False).otherwise(F.coalesce(best["allow"], F.lit(True)))


def crawl_delay(parsed_ms: Column, default: int = 1000, least: int = 0, most: int = 20_000) -> Column:
    """An unset or negative delay is the default; then it is kept within least and most."""
    return F.least(F.greatest(F.when(parsed_ms >= 0, parsed_ms).otherwise(F.lit(default)), F.lit(least)), F.lit(most)).cast("bigint")


def expired(valid_until: Column, as_of: Column) -> Column:
    return as_of > valid_until


def later(as_of: Column, milliseconds: Column | int) -> Column:
    ms = F.lit(milliseconds) if isinstance(milliseconds, int) else milliseconds
    return F.timestamp_micros(F.unix_micros(as_of) + ms.cast("bigint") * 1000)
