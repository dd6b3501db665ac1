"""The structural inspector: each check is a DataFrame of findings (file, class_id, severity, idx, evidence); their union is the report."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions.normalize import norm_key
from corpusloom.functions.patterns import to_java
from corpusloom.operators import structure
from corpusloom.operators.findings import capped
from corpusloom.operators.tables import looks_numeric
from corpusloom.plans.session import checkpoints


def _finding(rows: DataFrame, class_id: Column | str, severity: str, evidence: Column, idx: str | None = "idx") -> DataFrame:
    return rows.select(F.col("file"), (F.lit(class_id) if isinstance(class_id, str) else class_id).alias("class_id"), F.lit(severity).alias("severity"), (F.col(idx).cast("long") if idx else F.lit(None).cast("long")).alias("idx"), evidence.cast("string").alias("evidence"))


def _when(on: Column, class_id: str, severity: str, evidence: Column) -> Column:
    return F.when(on, F.struct(F.lit(class_id).alias("class_id"), F.lit(severity).alias("severity"), evidence.cast("string").alias("evidence")))


def _told(tables_: DataFrame, found: list[Column]) -> DataFrame:
    """What is found on each table, in one pass."""
    rows = tables_.select("file", F.col("table_index").cast("long").alias("idx"), F.explode(F.array_compact(F.array(*found))).alias("f"))
    return rows.select("file", "f.class_id", "f.severity", "idx", "f.evidence")


def _captions(items: DataFrame) -> DataFrame:
    c = items.filter("kind = 'paragraph'").withColumn("c", structure.caption(F.col("text"))).filter("c is not null")
    return c.select("file", "idx", F.col("c.kind").alias("of"), F.col("c.num").alias("num"), F.col("c.dots").alias("dots"), "text")


def captions(items: DataFrame) -> DataFrame:
    """Numbers that repeat, run backwards or leave gaps, and dots after them."""
    c = _captions(items)
    seq = structure.number_sequence(c, ["file", "of"]).filter("issue <> 'duplicate'")
    first = c.groupBy("file", "of", "num").agg(F.min("idx").alias("first"), F.count("*").alias("n")).filter("n > 1")
    again = c.join(first, ["file", "of", "num"]).filter("idx > first")
    name = lambda what: F.concat(F.lit("caption-"), F.col("of"), F.lit(what))
    return reduce(DataFrame.unionByName, [
        _finding(again, name("-duplicate-number"), "warning", F.col("num")),
        _finding(seq.filter("issue = 'reverse'"), name("-reverse-number"), "warning", F.col("num")),
        _finding(seq.filter("issue = 'gap'"), name("-number-gap"), "warning", F.col("num")),
        _finding(c.filter("dots <> ''"), name("-dot-format"), "info", F.col("text")),
    ])


def caption_places(items: DataFrame) -> DataFrame:
    """Tables and figures without a caption near by, with one too far, or on another side than most."""
    c, out = _captions(items), []
    for of, objects in (("table", items.filter("kind = 'table'")), ("figure", items.filter("kind = 'paragraph' and drawings > 0"))):
        o = objects.select("file", "idx")
        near = structure.nearest(o, c.filter(F.col("of") == of), ["file"])
        missing = o.join(near.select("file", "idx"), ["file", "idx"], "left_anti")
        out += [_finding(missing, f"{of}-caption-missing", "warning", F.lit("")), _finding(near.filter("distance > 2"), f"{of}-caption-far", "info", F.col("distance"))]
        out.append(_finding(structure.off_side(near, "file"), f"{of}-caption-side-inconsistent", "info", F.col("side")))
    return reduce(DataFrame.unionByName, out)


def spacing(items: DataFrame) -> DataFrame:
    """Runs of empty paragraphs, and headings that nothing follows."""
    empty = (F.col("kind") == "paragraph") & (F.trim("text") == "") & (F.col("drawings") == 0)
    blank = structure.runs(items, empty, 2, "file")
    is_heading = (F.col("kind") == "paragraph") & (structure.heading(F.col("text"), F.lower(F.coalesce("style_name", F.lit(""))).rlike("heading|заголовок")).isNotNull())
    content = (F.col("kind") == "table") | (F.trim("text") != "") | (F.col("drawings") > 0)
    bare = structure.heading_without_content(items.withColumnRenamed("file", "doc"), is_heading, content).withColumnRenamed("doc", "file")
    return _finding(blank, "duplicated-empty-paragraphs", "info", F.col("n"), "first").unionByName(_finding(bare, "heading-without-following-content", "warning", F.col("text")))


def lists(items: DataFrame) -> DataFrame:
    """Lists numbered or bulleted by hand, and the first flaw in the numbers of each file."""
    n = items.filter("kind = 'paragraph' and num_id is null").withColumn("num", F.regexp_extract("text", to_java(structure.MANUAL_NUMBER), 1))
    numbers = n.filter("num <> ''")
    bullets = items.filter("kind = 'paragraph' and num_id is null").filter(F.col("text").rlike(to_java(structure.MANUAL_BULLET)))
    count = lambda rows, least: rows.groupBy("file").agg(F.min("idx").alias("idx"), F.count("*").alias("n")).filter(F.col("n") >= least)
    flaw = structure.first_violation(numbers, ["file"])
    named = F.when(F.col("issue") == "orphan", "manual-list-orphan-subpoint").when(F.col("issue") == "duplicate", "manual-list-duplicate-number").when(F.col("issue") == "gap", "manual-list-number-gap").otherwise("manual-list-number-reverse")
    return reduce(DataFrame.unionByName, [_finding(count(numbers, 2), "manual-numbered-list", "info", F.col("n")), _finding(count(bullets, 3), "manual-bulleted-list", "info", F.col("n")), _finding(flaw, named, "warning", F.col("num"))])


def fields(marks: DataFrame, items: DataFrame) -> DataFrame:
    """Bookmarks without an end or start or of one name, links and references without a bookmark, fields broken in the text."""
    start, end = marks.filter("kind = 'start'"), marks.filter("kind = 'end'")
    half = structure.unpaired(start, end, ["file", "id"])
    twice = start.groupBy("file", "name").agg(F.min("idx").alias("idx"), F.count("*").alias("n")).filter("n > 1")
    names = start.select("file", "name").distinct()
    link = marks.filter("kind = 'link' and name is not null").join(names, ["file", "name"], "left_anti")
    ref = marks.filter("kind = 'field'").withColumn("name", F.regexp_extract("name", to_java(structure.FIELD_REF, True), 1)).filter("name <> ''").join(names, ["file", "name"], "left_anti")
    broken = items.filter(F.col("text").rlike(to_java(structure.BROKEN_FIELD, True)))
    toc = marks.filter("kind = 'field'").filter(F.upper("name").contains("TOC")).groupBy("file").agg(F.min("idx").alias("idx"))
    bare = toc.join(_entries(items).select("file").distinct(), "file", "left_anti")
    return reduce(DataFrame.unionByName, [
        _finding(twice, "bookmark-duplicate-name", "warning", F.col("name")), _finding(half, F.concat(F.lit("bookmark-"), F.col("issue")), "warning", F.col("id"), None),
        _finding(link, "hyperlink-missing-anchor", "warning", F.col("name")), _finding(ref, "field-ref-missing-bookmark", "warning", F.col("name")), _finding(broken, "field-broken-visible-result", "critical", F.col("text")),
        _finding(bare, "toc-field-without-parsed-entries", "info", F.lit("")),
    ])


def _entries(items: DataFrame) -> DataFrame:
    return items.filter(F.lower(F.coalesce("style_name", F.lit(""))).rlike(r"\btoc|оглавлен|содержан") & (F.trim("text") != ""))


def contents(items: DataFrame) -> DataFrame:
    """Headings that the table of contents doesn't name, its entries that no heading has, and a contents field without entries."""
    entry = _entries(items).withColumn("key", norm_key(F.regexp_replace("text", r"(?U)[\s.…]*\d+\s*$", "")))
    heads = items.filter(F.lower(F.coalesce("style_name", F.lit(""))).rlike("heading|заголовок") & (F.trim("text") != "")).withColumn("key", norm_key(F.col("text")))
    blob = entry.groupBy("file").agg(F.array_join(F.collect_list("key"), "\n").alias("blob"))
    missing = heads.join(blob, "file").filter(~F.col("blob").contains(F.col("key")))
    stale = entry.join(heads.select("file").distinct(), "file", "left_semi").join(heads.select("file", F.col("key").alias("k2")), (F.col("k2").contains(F.col("key")) | F.col("key").contains(F.col("k2"))) & (entry["file"] == heads["file"]), "left_anti")
    return _finding(missing, "toc-heading-missing", "warning", F.col("text")).unionByName(_finding(stale, "toc-entry-stale", "info", F.col("text")))


def tables(grids: DataFrame, page_cm: float = 17.0) -> DataFrame:
    """Tables wider than the text, with empty rows or columns, cells merged in the body, or very dense cells."""
    filled = lambda x: F.trim(F.coalesce(x, F.lit(""))) != ""
    t = grids.withColumns({
        "over": F.aggregate("col_widths", F.lit(0), lambda a, x: a + x) / 1440 * 2.54 - page_cm,
        "empty_rows": F.size(F.filter("grid", lambda r: ~F.exists(r, filled))),
        "empty_columns": F.size(F.filter(F.sequence(F.lit(0), F.greatest(F.col("width") - 1, F.lit(0))), lambda i: ~F.exists("grid", lambda r: filled(F.get(r, i))))),
        "merges": F.size(F.filter("origins", lambda o: (o["row"] > 0) & ((o["rowspan"] > 1) | (o["colspan"] > 1)))),
        "lengths": F.filter(F.flatten(F.transform("grid", lambda r: F.transform(r, lambda x: F.length(F.coalesce(x, F.lit("")))))), lambda n: n > 0),
    })
    avg = F.aggregate("lengths", F.lit(0), lambda a, x: a + x) / F.greatest(F.size("lengths"), F.lit(1))
    return _told(t, [
        _when((F.col("over") > 0.3) & (F.col("over") < 0.8), "table-width-over-margins", "warning", F.round("over", 2)), _when(F.col("over") >= 0.8, "table-width-over-margins", "critical", F.round("over", 2)),
        _when((F.col("empty_rows") > 0) & (F.col("height") > 0), "table-empty-rows", "info", F.col("empty_rows")), _when((F.col("empty_columns") > 0) & (F.col("width") > 0), "table-empty-columns", "info", F.col("empty_columns")),
        _when(F.col("merges").between(1, 4), "table-suspicious-body-merge", "info", F.col("merges")),
        _when((F.col("width") >= 8) & ((avg >= 28) | (F.array_max("lengths") >= 140)), "table-dense-cells", "info", F.round(avg, 1)),
        _when((F.col("height") >= 25), "table-header-not-repeated", "info", F.col("height")),
    ])


WIDE_CM = 20.0


def layout(sections: DataFrame) -> DataFrame:
    """Sections that are turned or have other margins without a wide table, other headers or footers, or numbers that start anew."""
    s = sections.withColumn("idx", F.col("section"))
    narrow = F.col("widest") <= WIDE_CM
    usual = structure.majority(s, ["file"], "margins", "section").select("file", F.col("margins").alias("usual"))
    out = [
        _finding(s.filter(F.col("landscape") & narrow), "landscape-section-without-wide-table", "warning", F.col("widest")),
        _finding(s.join(usual, "file").filter(narrow & (F.col("margins") != F.col("usual"))), "section-margin-profile-differs", "warning", F.array_join(F.col("margins").cast("array<string>"), " ")),
    ]
    starts = F.when(F.col("page_start").isNull(), None).when((F.col("section") == 0) & (F.col("page_start") != "1"), "page-number-first-section-start").when(F.col("section") > 0, "page-number-section-restart")
    out.append(_finding(s.filter(starts.isNotNull()), starts, "warning", F.col("page_start")))
    for kind in ("header", "footer"):
        told = s.filter(F.col(kind) != "")
        common = structure.majority(told, ["file"], kind, "section").select("file", F.col(kind).alias("usual"))
        other = told.join(common, "file").filter(F.col(kind) != F.col("usual"))
        # those after a section with wide tables too, up to the first without
        w = Window.partitionBy("file").orderBy("section").rowsBetween(Window.unboundedPreceding, -1)
        other = other.withColumn("__ended", F.coalesce(F.bool_or(narrow).over(w), F.lit(False))).filter("not __ended")
        out.append(_finding(other, "header-footer-profile-differs", "warning", F.col(kind)))
    return reduce(DataFrame.unionByName, out)


def table_looks(formats: DataFrame) -> DataFrame:
    """Tables of fixed row heights, mixed borders, cell margins, fonts or sizes, or that couldn't be read."""
    fixed = F.col("exact_rows") > 0
    return _told(formats, [
        _when(fixed & (F.col("no_wrap") > 0), "table-fixed-row-height", "critical", F.col("exact_rows")), _when(fixed & (F.col("no_wrap") == 0), "table-fixed-row-height", "warning", F.col("exact_rows")),
        _when(F.col("borders") > 2, "table-border-mixed", "warning", F.col("borders")), _when(F.col("margins") > 2, "table-cell-margins-mixed", "warning", F.col("margins")),
        _when((F.col("fonts") > 3) | (F.col("size_range") >= 3), "table-fonts-mixed", "warning", F.col("fonts")), _when(F.col("failed").isNotNull(), "table-model-failed", "warning", F.col("failed")),
    ])


CHECKS: dict[str, Callable] = {"captions": captions, "caption_places": caption_places, "spacing": spacing, "lists": lists, "contents": contents}


#: What the checks read of items and marks.
ITEM = ("file", "idx", "kind", "text", "style_name", "num_id", "drawings", "ok", "error")
MARK = ("file", "idx", "kind", "id", "name")


def _held(rows: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """The rows in a checkpoint: a score of branches reads them, and packages would be parsed anew for each."""
    checkpoints(rows.sparkSession)
    return rows.select(*[c for c in rows.columns if c in columns]).checkpoint()


def inspect(items: DataFrame, marks: DataFrame | None = None, grids: DataFrame | None = None, skip: tuple[str, ...] = (), most: int = 300, sections: DataFrame | None = None, formats: DataFrame | None = None) -> DataFrame:
    """All checks but the skipped; files that couldn't be opened are critical findings; beyond `most` a file a row says so (the report's limit)."""
    items, marks = _held(items, ITEM), marks if marks is None else _held(marks.filter("ok"), MARK)
    good = items.filter("ok")
    out = [f(good) for name, f in CHECKS.items() if name not in skip]
    out += [fields(marks, good)] if marks is not None and "fields" not in skip else []
    out += [tables(grids.filter("ok"))] if grids is not None and "tables" not in skip else []
    out += [layout(sections.filter("ok"))] if sections is not None and "layout" not in skip else []
    out += [table_looks(formats.filter("ok"))] if formats is not None and "tables" not in skip else []
    out.append(_finding(items.filter("not ok").dropDuplicates(["file"]), "docx-open-failed", "critical", F.col("error"), None))
    return capped(reduce(DataFrame.unionByName, out), ["file"], ["class_id", "idx"], most)


def summary(findings: DataFrame) -> DataFrame:
    return findings.groupingSets([["severity", "class_id"], ["severity"], []], "severity", "class_id").agg(F.count("*").alias("n"))


def numeric_share(grid: Column) -> Column:
    """Of a grid's filled cells."""
    flat = F.filter(F.flatten(grid), lambda x: F.trim(F.coalesce(x, F.lit(""))) != "")
    return F.size(F.filter(flat, looks_numeric)) / F.greatest(F.size(flat), F.lit(1))


def running_counts(items: DataFrame) -> DataFrame:
    """Page (from 1, by breaks), section and heading of every item."""
    w = Window.partitionBy("file").orderBy("idx")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    return items.withColumns({
        "page": F.coalesce(F.sum("page_breaks").over(before), F.lit(0)) + 1, "section": F.coalesce(F.sum(F.col("section_break").cast("int")).over(before), F.lit(0)) + 1,
        "heading": F.last(F.when(structure.heading(F.col("text")).isNotNull(), F.col("text")), ignorenulls=True).over(w),
    })
