"""Explicit schemas of all relations; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

DISALLOWED, DISCOVERED, PROCESSED = "Disallowed", "Discovered", "Processed"
STATUSES = (DISALLOWED, DISCOVERED, PROCESSED)
ALLOW_ALL, ALLOW_NONE, ALLOW_SOME = "ALLOW_ALL", "ALLOW_NONE", "ALLOW_SOME"

RULES = "array<struct<prefix:string,allow:boolean>>"
HEADERS = "array<struct<name:string,value:string>>"

_TYPES = {"string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(), "timestamp": T.TimestampType(), "binary": T.BinaryType(), "boolean": T.BooleanType()}
_HEADERS = T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("value", T.StringType())]))


def columns(**kinds: str | T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, _TYPES[kind] if isinstance(kind, str) else kind) for name, kind in kinds.items()])


CANDIDATE = columns(url="string", crawl_depth="int")
PAGE = columns(url="string", status="string", crawl_depth="int", crawl_priority="bigint")
PAGE_EVENT = T.StructType([*PAGE, *columns(attempts="int", seq="bigint")])
HOST = columns(scheme_and_authority="string", rule_mode="string", robot_rules="string", crawl_delay="bigint", valid_until="timestamp")
HOST_EVENT = T.StructType([*HOST, *columns(next_eligible_at="timestamp", seq="bigint")])
RESPONSE = columns(url="string", status="int", content_type="string", headers=_HEADERS, protocol="string", body="binary", failed="boolean")
METRIC = columns(name="string", attrs=T.MapType(T.StringType(), T.StringType()), value="bigint")
EDGE = columns(src_url="string", dst_url="string", depth="int")
