"""Checks on ordered items: runs, headings, captions, lists, profiles. One exchange by document serves them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions.patterns import to_java
from corpusloom.plans.session import checkpoints

# What headings, captions and list items look like.
DOTTED_HEADING = r"^\s*(\d+\.\d+(?:\.\d+){0,4})\.?\s*(\S.+)$"
SINGLE_HEADING = r"^\s*(\d+)\.\s+(\S.+)$"
APPENDIX_HEADING = r"^\s*(Приложение\s+[А-ЯA-Z0-9]+)\.?\s*(.*)$"
CAPTIONS = {"table": r"^\s*(?:таблица|табл\.)\s*\.?\s*(\d+(?:\.\d+)*)(\.{0,2})(?=\s|$|[-–—:])", "figure": r"^\s*(?:рисунок|рис\.)\s*\.?\s*(\d+(?:\.\d+)*)(\.{0,2})(?=\s|$|[-–—:])"}
MANUAL_NUMBER = r"^\s*(\d+(?:\.\d+){0,5})[\.)]\s+\S"
MANUAL_BULLET = r"^\s*[-–—•·●]\s+\S"
FIELD_REF = r"\b(?:REF|PAGEREF|NOTEREF)\s+([A-Za-zА-Яа-яЁё_][\wА-Яа-яЁё.-]*)"
BROKEN_FIELD = r"(?:Error!\s*(?:Reference source not found|Bookmark not defined)|Ошибка!\s*(?:Источник ссылки не найден|Закладка не определена))"


def order(by: str = "doc", idx: str = "idx"):
    return Window.partitionBy(by).orderBy(idx)


def number(text: Column) -> Column:
    """'2.1.3' as [2, 1, 3]; arrays compare as Python's tuples do."""
    return F.transform(F.filter(F.split(text, r"\."), lambda x: x != ""), lambda x: x.cast("int"))


def runs(items: DataFrame, member: Column, least: int = 1, by: str = "doc") -> DataFrame:
    """Islands of consecutive members: doc, first, last, n."""
    rows = items.withColumn("__in", F.coalesce(member, F.lit(False))).withColumn("__rank", F.row_number().over(order(by)))
    rows = rows.filter("__in").withColumn("__island", F.col("__rank") - F.row_number().over(order(by)))
    return rows.groupBy(by, "__island").agg(F.min("idx").alias("first"), F.max("idx").alias("last"), F.count("*").alias("n")).filter(F.col("n") >= least).drop("__island")


def collapse(items: DataFrame, removable: Column, by: str = "doc") -> DataFrame:
    """Items without the removable ones that follow a removable one."""
    before = F.lag("__r").over(order(by))
    return items.withColumn("__r", removable).withColumn("__drop", F.col("__r") & F.coalesce(before, F.lit(False))).filter("not __drop").drop("__r", "__drop")


def heading(text: Column, styled: Column | None = None) -> Column:
    """struct(kind, num, title) of a heading, else null: dotted, single (12 characters or more from a capital, or styled), appendix."""
    make = lambda kind, p: F.struct(F.lit(kind).alias("kind"), F.regexp_extract(text, p, 1).alias("num"), F.substring(F.trim(F.regexp_extract(text, p, 2)), 1, 180).alias("title"))
    dotted, single, appendix = to_java(DOTTED_HEADING), to_java(SINGLE_HEADING), to_java(APPENDIX_HEADING, True)
    title = F.regexp_extract(text, single, 2)
    good = (F.length(title) >= 12) & title.rlike(r"^\p{Lu}") | (F.lit(False) if styled is None else styled)
    return F.when(text.rlike(dotted), make("dotted", dotted)).when(text.rlike(single) & good, make("single", single)).when(text.rlike(appendix), make("appendix", appendix))


def caption(text: Column) -> Column:
    """struct(kind, num, dots) of a caption, else null."""
    out = None
    for kind, p in CAPTIONS.items():
        j = to_java(p, True)
        x = F.struct(F.lit(kind).alias("kind"), F.regexp_extract(text, j, 1).alias("num"), F.regexp_extract(text, j, 2).alias("dots"))
        out = F.when(text.rlike(j), x) if out is None else out.when(text.rlike(j), x)
    return out


def heading_without_content(items: DataFrame, is_heading: Column, has_content: Column) -> DataFrame:
    """Headings after which no content comes before the next heading or the end."""
    after = order().rowsBetween(1, Window.unboundedFollowing)
    rows = items.withColumns({"__h": F.coalesce(is_heading, F.lit(False)), "__c": F.coalesce(has_content, F.lit(False))})
    rows = rows.withColumns({"__next_h": F.min(F.when(F.col("__h"), F.col("idx"))).over(after), "__next_c": F.min(F.when(F.col("__c") & ~F.col("__h"), F.col("idx"))).over(after)})
    return rows.filter(F.col("__h") & (F.col("__next_c").isNull() | (F.col("__next_h") < F.col("__next_c")))).drop("__h", "__c", "__next_h", "__next_c")


def number_sequence(items: DataFrame, by: list[str], idx: str = "idx", num: str = "num") -> DataFrame:
    """Findings on numbers in order: reverse (less than the one before), gap (same parent, more than one further), duplicate."""
    w = Window.partitionBy(*by).orderBy(idx)
    n, prev = F.col("__n"), F.col("__p")
    rows = items.withColumn("__n", number(F.col(num))).filter(F.size("__n") > 0).withColumn("__p", F.lag("__n").over(w))
    parent = lambda x: F.slice(x, 1, F.size(x) - 1)
    same = (F.size(n) == F.size(prev)) & F.when(F.size(n) > 1, parent(n) == parent(prev)).otherwise(True)
    issue = F.when(prev.isNull(), None).when(n < prev, "reverse").when(n == prev, "duplicate").when(same & (F.element_at(n, -1) - F.element_at(prev, -1) > 1), "gap")
    return rows.withColumn("issue", issue).filter("issue is not null").drop("__n", "__p")


def duplicates(items: DataFrame, by: list[str], idx: str = "idx") -> DataFrame:
    """Values that stand more than once: first place and count."""
    return items.groupBy(*by).agg(F.min(idx).alias("first"), F.count("*").alias("n")).filter("n > 1")


def first_violation(items: DataFrame, by: list[str], num: str = "num", idx: str = "idx", least: int = 2) -> DataFrame:
    """Of each list of at least `least` numbers the first of: orphan subpoint, duplicate, gap, reverse."""
    w = Window.partitionBy(*by).orderBy(idx)
    seen = w.rowsBetween(Window.unboundedPreceding, -1)
    rows = items.withColumn("__n", number(F.col(num))).filter(F.size("__n") > 0)
    rows = rows.withColumns({"__all": F.count("*").over(Window.partitionBy(*by)), "__p": F.lag("__n").over(w), "__t": F.array_join("__n", "."), "__before": F.collect_set(F.array_join("__n", ".")).over(seen)})
    parent = F.array_join(F.slice("__n", 1, F.size("__n") - 1), ".")
    n, prev = F.col("__n"), F.col("__p")
    same = (F.size(n) == F.size(prev)) & (F.size(n) == 1) | (F.size(n) == F.size(prev)) & (parent == F.array_join(F.slice(prev, 1, F.size(prev) - 1), "."))
    issue = (
        F.when((F.size(n) > 1) & ~F.array_contains("__before", parent), "orphan").when(F.array_contains("__before", F.col("__t")), "duplicate")
        .when(prev.isNotNull() & (n < prev), "reverse").when(same & (F.element_at(n, -1) - F.element_at(prev, -1) > 1), "gap")
    )
    found = rows.filter(F.col("__all") >= least).withColumn("issue", issue).filter("issue is not null")
    return found.groupBy(*by).agg(F.min(idx).alias("idx"), F.min_by("issue", idx).alias("issue"), F.min_by("__t", idx).alias("num"))


def nearest(objects: DataFrame, marks: DataFrame, by: list[str], most: int = 4, idx: str = "idx") -> DataFrame:
    """To each object the nearest mark within `most` places (the earlier one on a tie): mark_idx, distance, side.

    A band of places makes the range an equality: a mark lies in the object's band or one beside it.
    """
    width = most + 1
    o = objects.withColumn("__band", F.explode(F.array(*[F.floor(F.col(idx) / width) + d for d in (-1, 0, 1)])))
    m = marks.select(*by, F.col(idx).alias("mark_idx"), F.floor(F.col(idx) / width).alias("__band"))
    d = F.abs(F.col("mark_idx") - F.col(idx))
    j = o.join(m, [*by, "__band"]).withColumn("distance", d).filter((d <= most) & (F.col("mark_idx") != F.col(idx)))
    best = j.groupBy(*by, idx).agg(F.min(F.struct("distance", "mark_idx")).alias("m"))
    return best.select(*by, idx, F.col("m.mark_idx").alias("mark_idx"), F.col("m.distance").alias("distance"), F.when(F.col("m.mark_idx") < F.col(idx), "before").otherwise("after").alias("side"))


def majority(rows: DataFrame, by: list[str], value: str, first: str, weight: Column | None = None) -> DataFrame:
    """The most frequent (or heaviest) value of each group, the first seen on ties: value, votes, total."""
    votes = rows.groupBy(*by, value).agg(F.sum(F.lit(1) if weight is None else weight).alias("votes"), F.min(first).alias("__first"))
    return votes.groupBy(*by).agg(F.max_by(value, F.struct("votes", -F.col("__first"))).alias(value), F.max("votes").alias("votes"), F.sum("votes").alias("total"))


def joined_paragraphs(items: DataFrame) -> DataFrame:
    """Paragraphs cut off without an end mark joined with what follows from a small letter (not `где`): doc, first, n, text."""
    w = order()
    prev = F.lag("text").over(w)
    goes_on = prev.isNotNull() & (F.trim(prev) != "") & ~F.trim(prev).rlike(r"[.!?:;…]$") & F.col("text").rlike(r"^\s*\p{Ll}") & ~F.col("text").rlike(r"(?iuU)^\s*где\b")
    rows = items.withColumn("__new", (~F.coalesce(goes_on, F.lit(False))).cast("int")).withColumn("__g", F.sum("__new").over(w))
    held = rows.groupBy("doc", "__g").agg(F.min("idx").alias("first"), F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("idx", "text"))).alias("__t"))
    return held.select("doc", "first", "n", F.array_join(F.transform("__t", lambda x: F.trim(x["text"])), " ").alias("text"))


def sections(items: DataFrame, key: Column) -> DataFrame:
    """Runs of equal keys: doc, section, key, first, n."""
    rows = items.withColumn("__k", key).withColumn("__new", (~F.col("__k").eqNullSafe(F.lag("__k").over(order())) | F.lag("idx").over(order()).isNull()).cast("int"))
    return rows.withColumn("section", F.sum("__new").over(order())).groupBy("doc", "section").agg(F.min("__k").alias("key"), F.min("idx").alias("first"), F.count("*").alias("n"))


def counters(items: DataFrame, breaks: dict[str, Column]) -> DataFrame:
    """Running numbers from 1 that grow after each break: pages, sections."""
    before = order().rowsBetween(Window.unboundedPreceding, -1)
    return items.withColumns({name: (F.coalesce(F.sum(b.cast("int")).over(before), F.lit(0)) + 1).cast("long") for name, b in breaks.items()})


def unpaired(starts: DataFrame, ends: DataFrame, on: list[str]) -> DataFrame:
    """Ids with only a start or only an end."""
    s, e = starts.select(*on).distinct().withColumn("s", F.lit(1)), ends.select(*on).distinct().withColumn("e", F.lit(1))
    return s.join(e, on, "full_outer").filter("s is null or e is null").select(*on, F.when(F.col("e").isNull(), "start-without-end").otherwise("end-without-start").alias("issue"))


def closure(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """All ids reachable from nodes(id) over edges(src, dst), themselves included: a round for each step of the longest chain, whatever its length."""
    checkpoints(nodes.sparkSession)
    seen = front = nodes.select("id").distinct().checkpoint()
    while not front.isEmpty():
        front = front.join(edges, front["id"] == edges["src"]).select(F.col("dst").alias("id")).distinct().join(seen, "id", "left_anti").checkpoint()
        seen = seen.unionByName(front).checkpoint()
    return seen


def off_side(near: DataFrame, by: str) -> DataFrame:
    """near(by, idx, side) that lie on another side than most of their group (two votes at least; the first seen on ties)."""
    usual = majority(near, [by], "side", "idx").filter("votes >= 2").select(by, F.col("side").alias("usual"))
    return near.join(usual, by).filter("side <> usual")


def numbered_sections(items: DataFrame, top: str = r"^\s*\d+\.?\s+\p{Lu}") -> DataFrame:
    """items(doc, idx, text, is_heading) -> doc, section (from 1), first, n, basis: by heading styles where there are any, else by two or more numbered lines, else one section."""
    w, doc = order(), Window.partitionBy("doc")
    rows = items.withColumn("__top", F.col("text").rlike(top)).withColumns({"__heads": F.count_if("is_heading").over(doc), "__tops": F.count_if("__top").over(doc)})
    basis = F.when(F.col("__heads") > 0, "heading-style").when(F.col("__tops") >= 2, "numbered-text").otherwise("single-section")
    starts = F.when(F.col("__heads") > 0, F.col("is_heading")).when(F.col("__tops") >= 2, F.col("__top")).otherwise(F.lit(False))
    rows = rows.withColumns({"basis": basis, "__new": (starts | (F.row_number().over(w) == 1)).cast("int")}).withColumn("section", F.sum("__new").over(w))
    return rows.groupBy("doc", "section", "basis").agg(F.min("idx").alias("first"), F.count("*").alias("n"))
