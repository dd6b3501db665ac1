"""Reconciling two tables by key, and two workbooks by cell."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions.normalize import norm_key, norm_space

# Names tried as keys, in this order, first whole and then as part of a header.
KEY_NAMES = ("id", "key", "code", "number", "номер", "код", "кадастровый номер", "name", "наименование")


def auto_key(left: list[str], right: list[str], names: tuple[str, ...] = KEY_NAMES) -> list[str]:
    """The common header to compare by: an exact name, else one that starts with or holds a name, else the first."""
    fold = lambda s: " ".join(s.split()).replace("ё", "е").lower()
    other = {fold(c) for c in right}
    common = [c for c in left if fold(c) in other]
    for test in (lambda c, n: fold(c) == n, lambda c, n: fold(c).startswith(n), lambda c, n: n in fold(c)):
        for n in names:
            for c in common:
                if test(c, n):
                    return [c]
    return common[:1]


def _side(df: DataFrame, keys: list[str], fields: list[str], order: list[str]) -> DataFrame:
    """A row of each key, the first by `order`, with how many there were. Rows whose key parts are all empty are dropped."""
    key = F.struct(*[norm_key(F.when(F.col(k).cast("string").isin("0", "0.0", "false"), F.lit("")).otherwise(F.col(k).cast("string"))).alias(f"k{i}") for i, k in enumerate(keys)])
    rows = df.withColumn("__key", key).filter(reduce(lambda a, b: a | b, [F.col(f"__key.k{i}") != "" for i in range(len(keys))]))
    values = F.struct(*[norm_space(F.col(f)).alias(f) for f in fields])
    return rows.groupBy("__key").agg(F.min_by(values, F.struct(*order)).alias("v"), F.count("*").alias("n"))


def reconcile(a: DataFrame, b: DataFrame, keys: list[str], fields: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """One row per key: key, status (exact, mismatched, only_a, only_b), diffs (field, a, b), n_a, n_b."""
    fields = fields or sorted((set(a.columns) | set(b.columns)) - set(keys))
    a = a.withColumns({f: F.lit(None).cast("string") for f in fields if f not in a.columns})
    b = b.withColumns({f: F.lit(None).cast("string") for f in fields if f not in b.columns})
    x = _side(a, keys, fields, order or [*keys, *fields]).select("__key", F.col("v").alias("va"), F.col("n").alias("n_a"))
    y = _side(b, keys, fields, order or [*keys, *fields]).select("__key", F.col("v").alias("vb"), F.col("n").alias("n_b"))
    both = x.join(y, "__key", "full_outer")
    diff = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"va.{f}").alias("a"), F.col(f"vb.{f}").alias("b")) for f in fields])
    diffs = F.when(F.col("va").isNotNull() & F.col("vb").isNotNull(), F.filter(diff, lambda d: d["a"] != d["b"]))
    status = F.when(F.col("vb").isNull(), "only_a").when(F.col("va").isNull(), "only_b").when(F.size(diffs) > 0, "mismatched").otherwise("exact")
    return both.select(F.array_join(F.array(*[F.col(f"__key.k{i}") for i in range(len(keys))]), " | ").alias("key"), status.alias("status"), diffs.alias("diffs"), "n_a", "n_b")


def melt(df: DataFrame, book: str, row: str, columns: list[str]) -> DataFrame:
    """A table as cells: book, row, col (from 1), value."""
    cells = F.array(*[F.struct(F.lit(i + 1).alias("col"), F.col(c).cast("string").alias("value")) for i, c in enumerate(columns)])
    return df.select(F.lit(book).alias("book"), F.col(row).cast("long").alias("row"), F.explode(cells).alias("c")).select("book", "row", "c.col", "c.value")


def diff_cells(a: DataFrame, b: DataFrame, on: list[str] | None = None) -> DataFrame:
    """Cells that differ; null and '' are different values, a missing cell counts as null."""
    on = on or ["row", "col"]
    j = a.select(*on, F.col("value").alias("value_a")).join(b.select(*on, F.col("value").alias("value_b")), on, "full_outer")
    return j.filter(~F.col("value_a").eqNullSafe(F.col("value_b")))


def sheet_sets(a: DataFrame, b: DataFrame, sheet: str = "sheet") -> DataFrame:
    """sheet, side: `both`, `only_a` or `only_b`."""
    x, y = a.select(sheet).distinct().withColumn("a", F.lit(True)), b.select(sheet).distinct().withColumn("b", F.lit(True))
    return x.join(y, sheet, "full_outer").select(sheet, F.when(F.col("b").isNull(), "only_a").when(F.col("a").isNull(), "only_b").otherwise("both").alias("side"))


def drop_empty_rows(cells: DataFrame, by: list[str]) -> DataFrame:
    """Rows with some meaningful cell, renumbered without gaps; zero and false are meaningful."""
    rows = cells.groupBy(*by, "row").agg(F.bool_or(F.coalesce(F.trim("value") != "", F.lit(False))).alias("full"), F.count("*").alias("cells"))
    return rows.filter("full").withColumn("new_row", F.row_number().over(Window.partitionBy(*by).orderBy("row")).cast("long")).select(*by, "row", "new_row", "cells")


def sheet_sides(a: DataFrame, b: DataFrame, by: str = "file") -> DataFrame:
    """The sheets of two cell tables, file by file: whether both have them, or only one."""
    sides = lambda df, side: df.select(by, "sheet").distinct().withColumn(side, F.lit(True))
    status = F.when(F.col("in_a") & F.col("in_b"), "both").when(F.col("in_a"), "only_a").otherwise("only_b")
    return sides(a, "in_a").join(sides(b, "in_b"), [by, "sheet"], "full").select(by, "sheet", status.alias("status"))
