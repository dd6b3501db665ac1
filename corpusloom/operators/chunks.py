"""Cutting ordered items into chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.grouped import Group, apply_sorted


def weighted(weights: list[int], groups: int) -> list[int]:
    """The group of each item: a group closes at the target weight, or when as few items are left as groups; the rest joins the last."""
    target, out, group, held = sum(weights) / max(groups, 1), [], 0, 0
    for i, w in enumerate(weights):
        out.append(group)
        held += w
        if group < groups - 1 and (held >= target or len(weights) - i - 1 <= groups - 1 - group):
            group, held = group + 1, 0
    return out


def plan(items: DataFrame, groups: int, by: str = "doc", weight: str = "weight") -> DataFrame:
    """items(doc, idx, weight) -> doc, chunk, first, last, weight."""

    def run(key: tuple, group: Group) -> list[tuple]:
        out: list[list] = []
        weights = getattr(group, weight)
        for idx, w, c in zip(group.idx, weights, weighted(weights, groups)):
            if not out or out[-1][1] != c:
                out.append([key[0], c, idx, idx, 0])
            out[-1][3], out[-1][4] = idx, out[-1][4] + w
        return [tuple(x) for x in out]

    return apply_sorted(items.select(by, "idx", weight), [by], ["idx"], run, f"{by} {items.schema[by].dataType.simpleString()}, chunk int, first int, last int, weight long")


def even_ranges(totals: DataFrame, n: str, chunks: int) -> DataFrame:
    """totals(..., n) -> ranges chunk, start, end (end exclusive) of nearly equal size, borders rounded half to even."""
    edge = lambda k: F.bround(k * F.col(n) / F.lit(chunks)).cast("long")
    return totals.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))).withColumns({"start": edge(F.col("chunk")), "end": edge(F.col("chunk") + 1)}).filter(F.col("end") > F.col("start"))
