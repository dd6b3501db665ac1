"""Bytes of unknown encoding."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

# Encodings tried, in order of preference.
ENCODINGS = ("utf-8-sig", "utf-16", "cp1251", "cp866")


def score(text: str) -> float:
    """Letters, digits and marks for, controls, box drawing and odd case against."""
    bad = sum(c == "�" or ord(c) < 32 and c not in "\t\r\n" or 0x2500 <= ord(c) < 0x25A0 for c in text)
    common = sum(c in "оеаинтсрвлкмдпу " for c in text.lower())
    mixed = sum(a.islower() and b.isupper() for a, b in zip(text, text[1:]))
    return sum(c.isalnum() for c in text) + common - 8 * bad - 2 * mixed


def best(content: bytes | None) -> tuple[str | None, str | None]:
    if content is None:
        return None, None
    try:
        return content.decode("utf-8-sig"), "utf-8"
    except UnicodeDecodeError:
        pass
    found = []
    for e in ENCODINGS[1:]:
        if e == "utf-16" and content[:2] not in (b"\xff\xfe", b"\xfe\xff"):
            continue
        text = content.decode(e, "replace")
        found.append((score(text), text, e))
    _, text, name = max(found, key=lambda x: x[0])
    return text, name


@F.pandas_udf(StructType([StructField("text", StringType()), StructField("encoding", StringType())]))
def decode_best(content: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([best(c) for c in content], columns=["text", "encoding"])


def line_ends(content: Column) -> Column:
    """struct: a byte order mark, CRLF, lone LF and CR, and whether the bytes are UTF-8."""
    text = F.decode(content, "ISO-8859-1")
    return F.struct(text.startswith("ï»¿").alias("bom"), F.regexp_count(text, F.lit("\r\n")).alias("crlf"), F.regexp_count(text, F.lit("(?<!\r)\n")).alias("lf"), F.regexp_count(text, F.lit("\r(?!\n)")).alias("cr"), F.is_valid_utf8(content.cast("string")).alias("utf8"))
