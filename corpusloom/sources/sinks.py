"""Reports of findings as data: a JSON summary with a JSON row a file, and a Markdown text a file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.normalize import md_escape


def by_file(found: DataFrame, class_col: str = "class_id", by: str = "file") -> DataFrame:
    """A row a file: its number of findings, those of each class (sorted by it), and the findings."""
    rest = [c for c in found.columns if c != by]
    n = found.groupBy(by, class_col).agg(F.count("*").alias("n"), F.collect_list(F.struct(*rest)).alias("x"))
    classes = F.array_sort(F.collect_list(F.struct(F.col(class_col).alias("class_id"), "n"))).alias("classes")
    return n.groupBy(by).agg(F.sum("n").alias("n_findings"), classes, F.array_sort(F.flatten(F.collect_list("x"))).alias("findings"))


def summary(found: DataFrame, tool: str, version: str, class_col: str = "class_id", by: str = "file") -> DataFrame:
    """The one row that heads a report: tool, version, summary (files and findings in all, findings of each class; a null class is told as an empty one)."""
    n = found.groupBy(F.coalesce(F.col(class_col), F.lit("")).alias(class_col)).agg(F.count("*").alias("n"))
    classes = n.agg(F.sum("n").alias("findings"), F.map_from_entries(F.array_sort(F.collect_list(F.struct(class_col, "n")))).alias("classes"))
    files = found.agg(F.countDistinct(by).alias("files"))
    return files.crossJoin(classes).select(F.lit(tool).alias("tool"), F.lit(version).alias("version"), F.struct("files", F.coalesce("findings", F.lit(0)).alias("findings"), "classes").alias("summary"))  # of one row each


def markdown(found: DataFrame, columns: list[str], order: list[str], by: str = "file") -> DataFrame:
    """by, report: a heading and a table of a file's findings."""
    cells = F.concat(F.lit("| "), F.concat_ws(" | ", *[md_escape(F.col(c).cast("string")) for c in columns]), F.lit(" |"))
    rows = found.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(*order, cells.alias("line")))).alias("x"))
    head = f"| {' | '.join(columns)} |\n|{'---|' * len(columns)}\n"
    return rows.select(by, F.concat(F.lit("## "), md_escape(F.col(by).cast("string")), F.lit("\n\n" + head), F.array_join(F.transform("x", lambda r: r["line"]), "\n")).alias("report"))


def write(found: DataFrame, tool: str, version: str, target: str, class_col: str = "class_id") -> None:
    """The report below a folder of any store: `summary` (one JSON row) and `files` (JSON rows)."""
    summary(found, tool, version, class_col).write.mode("overwrite").json(f"{target}/summary")
    by_file(found, class_col).write.mode("overwrite").json(f"{target}/files")
