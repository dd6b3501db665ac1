"""Classifying paragraphs and gating tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions.normalize import norm_space
from corpusloom.functions.patterns import to_java
from corpusloom.operators.structure import order

# What each kind of paragraph looks like, tried in this order.
KINDS = (
    ("table-caption", r"^\s*(таблица|table)\s+[\dIVXLCDM]+(?:[\.\-–]\d+)*\b"),
    ("figure-caption", r"^\s*(рисунок|рис\.?|figure|fig\.?)\s+[\dIVXLCDM]+(?:[\.\-–]\d+)*\b"),
    ("toc-title", r"^\s*(содержание|оглавление|contents|table\s+of\s+contents)\s*$"),
    ("appendix", r"^\s*приложение\s+[\dIVXLCDMА-ЯA-Z]+(?:[\.\-–—][\dIVXLCDMА-ЯA-Z]+)*\.?(?:\s*[-–—]\s*.*|\s+.*)?$"),
    ("chapter", r"^\s*глава\s+\d+\.?\s+(.+)"),
    ("numbered-heading", r"^\s*(\d+(?:\.\d+){1,5})\.?\s+(.+)"),
    ("list-dash", r"^\s*[-–—]\s+\S"),
    ("list-bullet", r"^\s*[•·●]\s+\S"),
    ("list-number", r"^\s*(?:\d+|(?-i:[IVXLCDM]+|[ivxlcdm]+))[\.)]\s+\S"),  # in one case: "Mil." is a word
    ("list-letter", r"^\s*[A-Za-zА-Яа-яЁё][\.)]\s+\S"),
)
# Fixed value: what is a measured value and no heading.
VALUE = r"^\s*[\d\s.,]+(?:г\.?|год(?:а|ов)?|кв\.?\s*м|км|тонн(?:ы)?|тыс\.?|млн|мест(?:а)?|человек|объект(?:а|ов)?)\s*$"


def kind(text: Column, style_name: Column | None = None) -> Column:
    """The kind of a paragraph, null for plain text; lines in a table of contents are left alone; a measured value isn't a heading."""
    value = text.rlike(to_java(VALUE, True))
    # a chapter's or a number's rest must be long enough and hold a letter
    named = {"chapter": 1, "numbered-heading": 2}
    long_tail = lambda p, group: (F.length(norm_space(F.regexp_extract(text, to_java(p, True), group))) >= 8) & F.regexp_extract(text, to_java(p, True), group).rlike("[A-Za-zА-Яа-яЁё]")
    out = F.when(F.lower(style_name).contains("toc"), None) if style_name is not None else F.when(text.isNull(), None)
    for name, p in KINDS:
        hit = text.rlike(to_java(p, True))
        if name == "chapter":
            hit = hit & long_tail(p, named[name])
        if name == "numbered-heading":  # a number with less isn't anything else either
            out = out.when(hit & (value | ~long_tail(p, named[name])), F.lit(None))
        out = out.when(hit, name)
    return out


def heading_depth(text: Column) -> Column:
    """1 to 6, from the dots of its number."""
    num = F.regexp_extract(text, to_java(KINDS[5][1], True), 1)
    return F.when(num != "", F.least(F.size(F.split(num, r"\.")), F.lit(6)))


def style_is(name: Column, what: str) -> Column:
    words = {"heading": ("heading", "заголовок"), "caption": ("caption", "название"), "toc": ("toc", "оглавлен", "содержан"), "appendix": ("appendix", "приложен"), "list": ("list", "спис")}[what]
    low, out = F.lower(F.coalesce(name, F.lit(""))), F.lit(False)
    for w in words:
        out = out | low.contains(w)
    return out


def caption_nearby(items: DataFrame) -> DataFrame:
    """Whether a table has a caption among the two paragraphs before it, a picture beside it: items with `captioned`."""
    w = order()
    k = F.col("__k")
    near = lambda kind_, *places: F.coalesce(*[F.when(F.lag(k, p).over(w) == kind_, True) if p > 0 else F.when(F.lead(k, -p).over(w) == kind_, True) for p in places], F.lit(False))
    rows = items.withColumn("__k", kind(F.col("text")))
    return rows.withColumn("captioned", F.when(F.col("kind") == "table", near("table-caption", 1, 2)).when(F.col("drawings") > 0, near("figure-caption", 1, -1))).drop("__k")


def fit_gate(page: Column, width: Column, height: Column, headers: Column, data_rows: Column, few_columns: int = 0) -> Column:
    """`ok`, or why a table's widths are left alone."""
    gate = F.when(page <= 2, "skip_first_two_pages")
    if few_columns > 0:
        gate = gate.when(width <= few_columns, "too_few_columns")
    return gate.when(height <= headers + 1, "too_few_rows").when(data_rows < 2, "too_few_data_rows").otherwise("ok")


def profile_changes(sections: DataFrame, value: str) -> DataFrame:
    """sections(doc, section, value) whose value differs from the document's usual one (the first seen on ties)."""
    votes = sections.groupBy("doc", value).agg(F.count("*").alias("n"), F.min("section").alias("first"))
    usual = votes.groupBy("doc").agg(F.max_by(value, F.struct("n", -F.col("first"))).alias("usual"))
    return sections.join(usual, "doc").filter(~F.col(value).eqNullSafe(F.col("usual")))


def page_restarts(sections: DataFrame) -> DataFrame:
    """sections(doc, section, page_start): numbering that a first section doesn't begin at 1, or a later one begins anew."""
    first = F.row_number().over(Window.partitionBy("doc").orderBy("section")) == 1
    issue = F.when(F.col("page_start").isNull(), None).when(first & (F.col("page_start") != 1), "page-number-first-section-start").when(~first, "page-number-section-restart")
    return sections.withColumn("class_id", issue).filter("class_id is not null")
