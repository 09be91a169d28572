"""Codecs and JSON on columns.  What cannot be decoded is null, never an error."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def to_base64(text: Column) -> Column:
    """In one line."""
    return F.regexp_replace(F.base64(F.encode(text, "UTF-8")), "[\r\n]", "")


def from_base64(text: Column) -> Column:
    """Strict: null where text is not base64 with its padding, or not of UTF-8."""
    sound = F.rlike(text, F.lit("^(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?$"))
    return F.when(sound, F.try_validate_utf8(F.try_to_binary(text, F.lit("base64")).cast("string")))


def url_encoded(text: Column) -> Column:
    """RFC 3986: a space is %20, and all but letters, digits and -._~ is encoded."""
    out = F.url_encode(text)
    for a, b in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def url_decoded(text: Column) -> Column:
    """A plus sign is itself; null where a percent sign has no two digits after it."""
    sound = ~F.rlike(text, F.lit("%(?![0-9A-Fa-f]{2})"))
    return F.when(sound, F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))))


def json_minified(text: Column) -> Column:
    return F.to_json(F.try_parse_json(text))


def json_status(text: Column) -> Column:
    return F.when(F.try_parse_json(text).isNull(), "error").otherwise("ok")


def json_pretty(text: Column) -> Column:
    """Two spaces a level, members in the order of their names; null where text is no JSON."""

    @F.pandas_udf("string")
    def pretty(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: None if x is None else json.dumps(json.loads(x), indent=2, sort_keys=True, ensure_ascii=False))

    return pretty(json_minified(text))
