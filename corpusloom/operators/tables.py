"""Tables of documents: headers, density, column widths, stitching, grouping, Markdown."""

from __future__ import annotations

import difflib
import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions.grouped import Group, apply_sorted
from corpusloom.functions.normalize import norm_space

# Fixed value: what reads as a number.
NUMERIC = r"^\s*[-+]?\d[\d\s\u00A0]*(?:[.,]\d+)?\s*%?\s*$"


def looks_numeric(s: Column) -> Column:
    return F.coalesce(s, F.lit("")).rlike(NUMERIC)


def looks_record_number(s: Column) -> Column:
    return F.coalesce(s, F.lit("")).rlike(r"^\s*\d+(?:\.\d+)*\.?\s*$")


def looks_index(s: Column) -> Column:
    return F.replace(norm_space(s), F.lit(" "), F.lit("")).rlike(r"^\d+(?:[.\-]\d+)*\.?$")


def header_rows(grid: Column, most: int = 4) -> Column:
    """Header rows among the first four: up to a blank row, one that opens with a number, or one half numeric."""
    def is_body(row: Column) -> Column:
        filled = F.filter(row, lambda x: F.trim(F.coalesce(x, F.lit(""))) != "")
        return (F.size(filled) == 0) | looks_numeric(F.get(row, F.lit(0))) | (F.size(F.filter(filled, looks_numeric)) >= 0.5 * F.size(filled))

    flags = F.transform(F.slice(grid, 1, most), is_body)
    return F.when(F.array_position(flags, F.lit(True)) > 0, F.array_position(flags, F.lit(True)) - 1).otherwise(F.size(flags)).cast("int")


def preheader_rows(grid: Column, headers: Column) -> Column:
    """Leading header rows with exactly one filled cell that isn't a number; never all of the header."""
    def alone(row: Column) -> Column:
        filled = F.filter(row, lambda x: F.trim(F.coalesce(x, F.lit(""))) != "")
        return (F.size(filled) == 1) & ~looks_record_number(F.get(filled, F.lit(0)))

    flags = F.transform(F.slice(grid, 1, F.greatest(headers - 1, F.lit(0))), alone)
    return F.when(F.array_position(flags, F.lit(False)) > 0, F.array_position(flags, F.lit(False)) - 1).otherwise(F.size(flags)).cast("int")


def section_row(row: Column) -> Column:
    return (F.trim(F.coalesce(F.get(row, F.lit(0)), F.lit(""))) != "") & (F.size(F.filter(F.slice(row, 2, F.greatest(F.size(row), F.lit(1))), lambda x: F.trim(F.coalesce(x, F.lit(""))) != "")) == 0)


def dense_reasons(width: Column, data_rows: Column, chars: Column, filled: Column, columns_per_cm: Column) -> Column:
    reasons = (("columns", width >= 7), ("rows", data_rows >= 25), ("characters", chars >= 3000), ("long cells", (filled >= 20) & (chars / filled >= 70)), ("narrow columns", columns_per_cm >= 0.42))
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in reasons]))


def column_scores(cells: DataFrame, by: list[str]) -> DataFrame:
    """cells(*by, value): per column fill, average, p60, p85, numeric and long shares, and a width score from them."""
    n = F.length(F.coalesce("value", F.lit("")))
    filled = F.trim(F.coalesce("value", F.lit(""))) != ""
    share = lambda c: F.avg(c.cast("double"))
    stats = cells.groupBy(*by).agg(
        F.max(n).cast("long").alias("longest"), F.avg(n).alias("average"), F.percentile(n, 0.6).alias("p60"), F.percentile(n, 0.85).alias("p85"),
        share(filled).alias("fill"), share(filled & looks_numeric(F.col("value"))).alias("numeric"), share(n >= 40).alias("long_share"),
    )
    score = F.col("p85") * 0.5 + F.col("average") * 0.3 + F.col("p60") * 0.2
    return stats.withColumn("score", F.greatest(score * (1 + F.col("long_share")) * F.when(F.col("numeric") > 0.6, 0.7).otherwise(1.0), F.lit(1.0)))


def widths(scores: DataFrame, by: list[str], total: float, least: float) -> DataFrame:
    """Column widths in proportion to the scores, none under `least`."""
    w = Window.partitionBy(*by)
    free = F.lit(total) - least * F.count("*").over(w)
    return scores.withColumn("width", F.lit(least) + F.greatest(free, F.lit(0.0)) * F.col("score") / F.sum("score").over(w))


@functools.lru_cache(maxsize=4096, typed=True)
def _cell_key(x: object) -> str:
    return " ".join(str(x or "").replace("\u00a0", " ").split()).lower()


def _key(row: list) -> tuple:
    return tuple(map(_cell_key, row))


@functools.lru_cache(maxsize=4096)
def _head_ratio(a: str, b: str) -> float:
    """difflib's ratio of two headers; documents repeat theirs."""
    return 1.0 if a == b else difflib.SequenceMatcher(None, a, b).ratio()


def stitch(tables: list[dict], tolerance: int = 5000, probe: int = 16) -> list[dict]:
    """Chains of tables with only blank paragraphs between, equal in width, style and total width within the tolerance:
    rows concatenated, a continuation's rows that repeat the chain's first ones dropped."""
    out: list[dict] = []
    for t in sorted(tables, key=lambda x: x["table_index"]):
        last = out[-1] if out else None
        joins = last and not t["text_before"] and t["width"] == last["width"] and t["style"] == last["style"] and abs(t["total"] - last["total"]) <= tolerance
        if not joins:
            out.append({**t, "rows": list(t["rows"]), "members": [t["table_index"]], "dropped": 0})
            continue
        n = 0
        while n < min(probe, len(t["rows"]), len(last["rows"])) and _key(t["rows"][n]) == _key(last["rows"][n]):
            n += 1
        last["rows"] += t["rows"][n:]
        last["members"].append(t["table_index"])
        last["dropped"] += n
    return out


def stitch_tables(tables: DataFrame) -> DataFrame:
    """tables(doc, table_index, width, style, total, text_before, rows) -> doc, first, members, n_rows, dropped."""

    def run(key: tuple, group: Group) -> list[tuple]:
        got = stitch(group.records())
        return [(key[0], g["members"][0], g["members"], len(g["rows"]), g["dropped"]) for g in got]

    return apply_sorted(tables, ["doc"], ["table_index"], run, f"doc {tables.schema['doc'].dataType.simpleString()}, first int, members array<int>, n_rows int, dropped int")


def group_tables(tables: list[dict], mode: str = "safe") -> list[list[int]]:
    """Runs of tables compatible with the first of their run: equal width, and headers as similar as the mode asks."""
    least = {"safe": 0.82, "balanced": 0.65, "width": 0.0}[mode]
    groups: list[list[dict]] = []
    for t in tables:
        anchor = groups[-1][0] if groups else None
        head = lambda x: " ".join(_key(x["rows"][0])) if x["rows"] else ""
        if anchor and anchor["width"] == t["width"] and _head_ratio(head(anchor), head(t)) >= least:
            groups[-1].append(t)
        else:
            groups.append([t])
    return [[t["table_index"] for t in g] for g in groups]


def grouped_tables(tables: DataFrame, mode: str = "safe") -> DataFrame:
    """tables(doc, table_index, width, rows) -> doc, first, members: group_tables of each document."""

    def run(key: tuple, group: Group) -> list[tuple]:
        return [(key[0], g[0], g) for g in group_tables(group.records(), mode)]

    return apply_sorted(tables, ["doc"], ["table_index"], run, f"doc {tables.schema['doc'].dataType.simpleString()}, first int, members array<int>")


def running_tables(tables: DataFrame, separate: bool = False) -> DataFrame:
    """tables(doc, table_index, width, style, total, text_before, rows) -> doc, first, members, rows, dropped: stitch_running of each document."""

    def run(key: tuple, group: Group) -> list[tuple]:
        got = stitch_running(group.records(), separate=separate)
        return [(key[0], g["members"][0], g["members"], g["rows"], g["dropped"]) for g in got]

    return apply_sorted(tables, ["doc"], ["table_index"], run, f"doc {tables.schema['doc'].dataType.simpleString()}, first int, members array<int>, rows array<array<string>>, dropped int")


def markdown_rows(lines: DataFrame) -> DataFrame:
    """lines(doc, idx, text) -> rows of pipe tables: doc, table, row (0 is the header), cells. A table is a run of piped
    lines whose second one is the separator; rows are padded or cut to the header's width."""
    w = Window.partitionBy("doc").orderBy("idx")
    piped = F.trim("text").rlike(r"^\|.*\|$")
    rows = lines.withColumn("p", piped).withColumn("r", F.row_number().over(w)).filter("p").withColumn("island", F.col("r") - F.row_number().over(w))
    g = Window.partitionBy("doc", "island").orderBy("idx")
    body = F.regexp_replace(F.trim("text"), r"^\||\|$", "")
    cells = F.transform(F.split(body, r"(?<!\\)\|"), lambda x: F.replace(F.trim(x), F.lit("\\|"), F.lit("|")))
    rows = rows.withColumns({"n": F.row_number().over(g), "cells": cells, "sep": F.trim("text").rlike(r"^\|(\s*:?-{3,}:?\s*\|)+$")})
    whole = Window.partitionBy("doc", "island")
    rows = rows.withColumns({"ok": F.max(F.when(F.col("n") == 2, F.col("sep"))).over(whole), "width": F.max(F.when(F.col("n") == 1, F.size("cells"))).over(whole), "start": F.min("idx").over(whole)})
    rows = rows.filter("ok and n != 2")
    fitted = F.transform(F.sequence(F.lit(0), F.col("width") - 1), lambda i: F.coalesce(F.get("cells", i), F.lit("")))
    return rows.select("doc", F.col("start").alias("table"), F.when(F.col("n") == 1, 0).otherwise(F.col("n") - 2).cast("int").alias("row"), fitted.alias("cells"))


def markdown_outline(lines: DataFrame) -> DataFrame:
    """Pipe tables with their enclosing second- and third-level headings: doc, start, end, n_rows, h2, h3."""
    w = Window.partitionBy("doc").orderBy("idx")
    text = norm_space(F.col("text"))
    h2, h3 = F.when(text.rlike("^## "), F.substr(text, F.lit(4))), F.when(text.rlike("^### "), F.substr(text, F.lit(5)))
    rows = lines.withColumns({"h2": F.last(h2, ignorenulls=True).over(w), "__h3": F.last(F.when(text.rlike("^###? "), F.coalesce(h3, F.lit(""))), ignorenulls=True).over(w)})
    rows = rows.withColumns({"p": text.rlike(r"^\|.*\|$"), "r": F.row_number().over(w)}).filter("p").withColumn("island", F.col("r") - F.row_number().over(w))
    return rows.groupBy("doc", "island").agg(F.min("idx").alias("start"), F.max("idx").alias("end"), F.count("*").alias("n_rows"), F.min_by("h2", "idx").alias("h2"), F.min_by(F.nullif(F.col("__h3"), F.lit("")), "idx").alias("h3")).drop("island")


def top_overlap(anchor: list, rows: list, probe: int = 20) -> tuple[int, int]:
    """(rows, offset) of the longest run of the anchor's first rows that the next table begins with."""
    best = (0, 0)
    for offset in range(min(len(anchor), probe)):
        n = 0
        while n < min(probe, len(rows)) and offset + n < min(len(anchor), probe) and _key(anchor[offset + n]) == _key(rows[n]):
            n += 1
        if n > best[0]:
            best = (n, offset)
    return best


def stitch_running(tables: list[dict], tolerance: int = 5000, separate: bool = False) -> list[dict]:
    """Like stitch, for continuations that repeat only the rows below a preheader: those repeated rows are dropped wherever
    they stand in the first table. With `separate` the preheader becomes a table of its own. A continuation without any
    overlap keeps all its rows."""
    out: list[dict] = []
    for t in sorted(tables, key=lambda x: x["table_index"]):
        last = out[-1] if out else None
        if not (last and not t["text_before"] and t["width"] == last["width"] and t["style"] == last["style"] and abs(t["total"] - last["total"]) <= tolerance):
            out.append({**t, "rows": list(t["rows"]), "first_rows": list(t["rows"]), "members": [t["table_index"]], "dropped": 0, "preheader": 0})
            continue
        n, offset = top_overlap(last["first_rows"], t["rows"])
        if n and offset:
            last["preheader"] = min(last["preheader"] or offset, offset)
        last["rows"] += t["rows"][n:]
        last["members"].append(t["table_index"])
        last["dropped"] += n
    if not separate:
        return out
    split = []
    for t in out:
        if t["preheader"]:
            split.append({**t, "rows": t["rows"][: t["preheader"]], "members": t["members"][:1], "dropped": 0})
        split.append({**t, "rows": t["rows"][t["preheader"] :]})
    return split
