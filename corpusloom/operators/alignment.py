"""What two documents' matched sections and blocks tell: reasons, confidence, section-wise changes, details of tables and texts."""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from corpusloom.functions.grouped import Group, apply_sorted
from corpusloom.operators.similarity import WORD, ZONE_CODE, block_changes, redline, unified_diff, zone_codes

# Why two sections are taken for the same, and how sure that is.
NO_PAIR = ("раздел без пары", "нет пары")
REASONS = {
    "title+code": "совпал заголовок и код зоны: ",
    "base+code": "совпала основа заголовка и код зоны: ",
    "bag+code": "совпал код зоны и набор слов заголовка: ",
    "title": "совпал заголовок",
    "bag": "совпал набор слов заголовка",
    "near+code": "совпал код зоны и близкий заголовок: ",
    "high": "высокая похожесть содержимого",
    "middle": "средняя похожесть содержимого",
    "low": "низкая похожесть содержимого",
}
SURE, CHECK, DOUBT = "уверенно", "проверить", "сомнительно"


def _fold(s: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(F.lower(F.coalesce(s, F.lit(""))), "ё", "е"), r"(?U)\s+", " "))


def _base(s: Column) -> Column:
    """A title without its zone codes."""
    return _fold(F.regexp_replace(F.coalesce(s, F.lit("")), ZONE_CODE, " "))


def _bag(s: Column) -> Column:
    return F.sort_array(F.regexp_extract_all(_base(s), F.lit(WORD), F.lit(0)))


@F.pandas_udf(DoubleType())
def ratios(a: pd.Series, b: pd.Series) -> pd.Series:
    """difflib's ratio of each pair of texts."""
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b)])


def identity(matches: DataFrame) -> DataFrame:
    """matches(a_title, b_title, similarity, ...; a title null where there is no section) with `reason` and `confidence`."""
    a, b = F.col("a_title"), F.col("b_title")
    shared = F.sort_array(F.array_intersect(zone_codes(F.coalesce(a, F.lit(""))), zone_codes(F.coalesce(b, F.lit("")))))
    coded, codes = F.size(shared) > 0, F.array_join(shared, ", ")
    title = (_fold(a) != "") & (_fold(a) == _fold(b))
    base = (_base(a) != "") & (_base(a) == _base(b))
    bag = (F.size(_bag(a)) > 0) & (_bag(a) == _bag(b))
    say = lambda kind: F.concat(F.lit(REASONS[kind]), codes)
    s = F.col("similarity")
    # only coded titles that agree in nothing else are compared letter by letter
    near = F.when(coded & ~(base | bag), ratios(_base(a), _base(b)) >= 0.75).otherwise(F.lit(False))
    kind = (
        F.when(a.isNull() | b.isNull(), F.lit(NO_PAIR[0])).when(title & coded, say("title+code")).when(base & coded, say("base+code")).when(bag & coded, say("bag+code"))
        .when(title, REASONS["title"]).when(bag, REASONS["bag"]).when(near, say("near+code")).when(s >= 0.80, REASONS["high"]).when(s >= 0.55, REASONS["middle"]).otherwise(REASONS["low"])
    )
    told = F.col("reason").startswith("совпал")
    out = matches.withColumn("reason", kind)
    return out.withColumn("confidence", F.when(a.isNull() | b.isNull(), NO_PAIR[1]).when(told | (s >= 0.80), SURE).when(s >= 0.55, CHECK).otherwise(DOUBT))


def section_changes(a: DataFrame, b: DataFrame, matches: DataFrame, pair: list[str]) -> DataFrame:
    """a, b(*pair, section, ordinal, key) and matches(*pair, a_section, b_section; null without a match) -> *pair, a_section, b_section, change, a_ordinal, b_ordinal.

    Matched sections are compared block by block; blocks of the others are deleted or inserted as a whole.
    """
    number = matches.select(*pair, "a_section", "b_section", F.xxhash64(*pair, "a_section", "b_section").alias("__m"))
    side = lambda df, own, n: df.withColumnRenamed("section", own).join(number, [*pair, own]).select(*pair, "a_section", "b_section", "__m", F.lit(n).alias("side"), "ordinal", "key")
    rows = side(a, "a_section", 0).unionByName(side(b, "b_section", 1))
    keys = [*pair, "__m"]

    def run(key: tuple, group: Group) -> Iterator[tuple]:
        x, y = group.where("side", 0), group.where("side", 1)
        a_at, b_at, ends = x.ordinal, y.ordinal, (group.a_section[0], group.b_section[0])
        for t, i, j in block_changes(x.key, y.key):
            yield *key[:-1], *ends, t, None if i is None else a_at[i], None if j is None else b_at[j]

    kinds = ", ".join(f"{p} {a.schema[p].dataType.simpleString()}" for p in pair)
    return apply_sorted(rows, keys, ["side", "ordinal"], run, f"{kinds}, a_section int, b_section int, change string, a_ordinal int, b_ordinal int")


def table_details(a: list[list[str]], b: list[list[str]], most: int = 8) -> tuple[int, int, int, list[str]]:
    """Rows changed, inserted and deleted between two tables, and the first examples."""
    x, y = ([" | ".join(r) for r in t] for t in (a, b))
    changed = inserted = deleted = 0
    examples: list[str] = []
    short = lambda s, n: s if len(s) <= n else s[: n - 3] + "..."
    for tag, i1, i2, j1, j2 in difflib.SequenceMatcher(None, x, y).get_opcodes():
        if tag == "replace":
            changed += max(i2 - i1, j2 - j1)
            examples += [f"{short(old, 160)} -> {short(new, 160)}" for old, new in zip(x[i1:i2], y[j1:j2])]
        elif tag == "delete":
            deleted += i2 - i1
            examples += [f"- {short(r, 220)}" for r in x[i1:i2]]
        elif tag == "insert":
            inserted += j2 - j1
            examples += [f"+ {short(r, 220)}" for r in y[j1:j2]]
    return changed, inserted, deleted, examples[:most]


@F.pandas_udf(StructType([*(StructField(n, IntegerType()) for n in ("changed", "inserted", "deleted")), StructField("examples", ArrayType(StringType()))]))
def table_change(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """table_details of two columns of rows; examples are cut to eight, as the report lists them."""
    rows = lambda t: [[c or "" for c in r] for r in t] if t is not None else []
    return pd.DataFrame([table_details(rows(x), rows(y)) for x, y in zip(a, b)], columns=["changed", "inserted", "deleted", "examples"])


@F.pandas_udf(ArrayType(StructType([StructField("op", StringType()), StructField("text", StringType())])))
def redlines(a: pd.Series, b: pd.Series) -> pd.Series:
    """Segments (equal, delete, insert) between two texts."""
    return pd.Series([[{"op": o, "text": t} for o, t in redline(x, y)] for x, y in zip(a, b)])


@F.pandas_udf(ArrayType(StringType()))
def unified(a: pd.Series, b: pd.Series) -> pd.Series:
    """Lines of a unified diff, as many as a report lists."""
    return pd.Series([unified_diff(x, y) for x, y in zip(a, b)])


def text_of_codes(title: str) -> list[str]:
    """Zone codes of one title, as the columns have them."""
    out = [x + y for x, y in re.findall(ZONE_CODE[4:], (title or "").upper().replace("Ё", "Е"))]
    return list(dict.fromkeys(out))
