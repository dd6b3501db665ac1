"""Restyling by a book of styles: what each paragraph is, and captions numbered throughout with the references to them."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions.grouped import Group, apply_sorted


@dataclass(frozen=True)
class Heading:
    """Texts that are headings of a level: equal to a value, beginning with one, or matched by a pattern; if `under` is given, only below the heading of that text."""

    level: int
    values: tuple[str, ...] = ()
    match: str = "exact"
    under: str | None = None
    numbering: str | None = None  # None: as the style has it, "0": none, "id:level": that list's

    def fits(self, text: str) -> bool:
        tests = {"exact": lambda v: text == v, "prefix": text.startswith, "regex": lambda v: re.match(v, text) is not None}
        return any(map(tests[self.match], self.values))


@dataclass(frozen=True)
class Book:
    text: str
    heading_styles: dict[int, str] = field(default_factory=dict)
    headings: tuple[Heading, ...] = ()
    caption_number: str | None = None
    caption_title: str | None = None
    caption_pattern: str = r"^Таблица\s*\d+(\.\d+)*\s*$"
    title_caps: bool = True
    bullet: str | None = None


def _caps(text: str, least: int) -> bool:
    letters = [c for c in text if c.isalpha()]
    return len(letters) >= least and sum(c.isupper() for c in letters) >= 0.85 * len(letters)


class _Reader:
    """Goes through a document's paragraphs and tells what each is from what came before."""

    def __init__(self, book: Book) -> None:
        self.book = book
        self.order = sorted(book.headings, key=lambda h: h.under is None)  # what stands below a certain heading goes first
        self.above: dict[int, str] = {}
        self.table()
        self.leave_list()

    def table(self) -> None:
        self.wants_title, self.title_at = False, None

    def leave_list(self, opened: bool = False) -> None:
        self.listing, self.after_item = opened, False

    def tell(self, at: int, text: str) -> tuple[str, str | None, int | None, str | None]:
        """role, style, level, numbering."""
        book = self.book
        if not text:
            return "blank", book.text, None, None
        if h := next((h for h in self.order if (not h.under or h.under in self.above.values()) and h.fits(text)), None):
            self.above = {k: v for k, v in self.above.items() if k < h.level} | {h.level: text}
            self.table()
            self.leave_list()
            return "heading", book.heading_styles.get(h.level), h.level, h.numbering
        if book.caption_number and re.match(book.caption_pattern, text):
            self.wants_title, self.title_at = True, None
            self.leave_list()
            return "caption_number", book.caption_number, None, None
        if self.wants_title and book.caption_title and (not book.title_caps or _caps(text, 8 if self.title_at is None else 3)):
            if self.title_at is not None and self.title_at + 1 == at:
                self.title_at = at
                return "title_goes_on", None, None, None
            self.title_at = at
            self.leave_list()
            return "caption_title", book.caption_title, None, None
        self.title_at = None
        if book.bullet and self.is_item(text):
            self.listing, self.after_item = (False, False) if text[-1] == "." else (self.listing or text[-1] in ";:", True)
            return "list", book.bullet, None, None
        self.leave_list(opened=text[-1] == ":")
        return "text", book.text, None, None

    def is_item(self, text: str) -> bool:
        """A dash or a small letter begins an item; within a list so does what ends in a semicolon, and what ends it by a full stop."""
        if text[0] in "-–—•" or text[0].islower():
            return True
        return self.listing and (text[-1] == ";" or self.after_item and text[-1] == "." and not _caps(text, 8))


def assign(items: DataFrame, book: Book) -> DataFrame:
    """items(file, idx, kind, text) of a body -> file, idx, role, style, level, numbering of its paragraphs. One exchange by document; a document fits into a task."""

    def run(key: tuple, rows: Group) -> list[tuple]:
        reader, out = _Reader(book), []
        for at, kind, text in zip(rows.idx, rows.kind, rows.text):
            if kind == "table":
                reader.table()
            else:
                out.append((*key, at, *reader.tell(at, " ".join((text or "").split()))))
        return out

    rows = items.filter(F.col("kind").isin("paragraph", "table")).select("file", "idx", "kind", "text")
    return apply_sorted(rows, ["file"], ["idx"], run, f"file {rows.schema['file'].dataType.simpleString()}, idx int, role string, style string, level int, numbering string")


def renumbered(fields: DataFrame, caption_style: str, label: str = "Таблица") -> DataFrame:
    """fields of ooxml.fields -> new results: captions with a counter are numbered through the document, and references to their bookmarks told so.

    file, paragraph, field, kind (caption or reference), result. A bookmark that stands in several captions has the last one's number.
    """
    counts = (F.col("style") == caption_style) & F.col("instr").contains("SEQ")
    mark = F.regexp_extract("instr", r"REF\s+(\S+)", 1)
    rows = fields.filter("ok").repartition("file").withColumn("counts", F.coalesce(counts, F.lit(False)))  # one exchange serves both windows
    rows = rows.withColumn("number", F.when(F.col("counts"), F.dense_rank().over(Window.partitionBy("file", "counts").orderBy("paragraph"))))
    event = lambda mark, kind, number: F.struct(mark.cast("string").alias("mark"), F.lit(kind).alias("kind"), number.cast("int").alias("number"))
    none = F.array().cast("array<struct<mark:string,kind:string,number:int>>")
    of_caption = F.when(F.col("counts"), F.concat(F.array(event(F.lit(None), "caption", F.col("number"))), F.transform("bookmarks", lambda b: event(b, "mark", F.col("number"))))).otherwise(none)
    of_reference = F.when(~F.col("instr").contains("STYLEREF") & (mark != ""), F.array(event(mark, "reference", F.lit(None)))).otherwise(none)
    events = rows.select("file", "paragraph", "field", F.inline(F.concat(of_caption, of_reference)))
    told = F.when(F.col("kind") == "caption", F.col("number").cast("string")).otherwise(F.concat(F.lit(label + " "), F.col("known").cast("string")))
    known = events.withColumn("known", F.max("number").over(Window.partitionBy("file", "mark")))
    return known.filter("kind != 'mark'").select("file", "paragraph", "field", "kind", told.alias("result")).filter("result IS NOT NULL")
