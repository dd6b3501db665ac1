"""Cross-site boilerplate lines, removed by how many distinct sites a line is spread over.

Each line's sites are sketched with HyperLogLog and merged by aggregation. Lines whose estimate is near the
threshold get an exact distinct count; lines far above it are boilerplate, lines far below are not.

A line is compared trimmed and with A-Z lowered, by a 64-bit hash (two lines of a billion share one by chance with odds
of 1 in 37); blank lines are never removed. Exact copies of a text count once for the spread (with the smallest of their
sites), so that a widely copied document doesn't lose its own lines. A null site is one site of its own. Null text: no
lines, stays null. Repeated rows change nothing. Empty input: no rows. Other columns pass as they are, whatever their
names; remove_boilerplate's two counts replace columns of their names, clean() adds none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import ascii_lower, col, cut, free

#: Up to this many boilerplate lines (8 bytes each) go with the plan; beyond, the set is joined by a shuffle.
SENT_LINES = 20_000
#: Up to so many lines near the threshold (8 bytes each) are broadcast; beyond, they are joined by a shuffle.
SENT_UNSURE = 1_000_000


def _line_key(line):
    return F.xxhash64(ascii_lower(F.trim(line)))


def _line_keys(text):
    return F.array_distinct(F.transform(F.filter(F.split(text, "\n"), lambda x: F.trim(x) != ""), _line_key))


def boilerplate_lines(docs: DataFrame, min_sites: int = 10, near: float = 0.3, lg_k: int = 10) -> DataFrame:
    """docs(text, site) -> the hashes `line` spread over at least min_sites distinct sites."""
    texts = docs.filter(F.col("text").isNotNull()).select(
        F.xxhash64("text").alias("h"), F.coalesce("site", F.lit("\x00")).alias("site"), _line_keys(F.col("text")).alias("keys")
    )  # from here on lines are 8 bytes each
    owner = docs.filter(F.col("text").isNotNull()).groupBy(F.xxhash64("text").alias("h")).agg(F.min(F.coalesce("site", F.lit("\x00"))).alias("owner"))
    held = cut(texts.join(owner, "h").filter(F.col("site") == F.col("owner")).select("site", "keys"))
    lines = held.select("site", F.explode("keys").alias("line"))
    spread = lines.groupBy("line").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(lg_k))).alias("sites"))
    spread = cut(spread.filter(F.col("sites") >= min_sites * (1 - near)))
    sure = spread.filter(F.col("sites") > min_sites * (1 + near)).select("line")
    unsure = spread.filter(F.col("sites") <= min_sites * (1 + near)).select("line")
    # a common line must not be dealt by itself before its sites are merged: the few asked for are picked where the lines
    # are, or each task's lines and sites are made distinct first
    if unsure.count() <= SENT_UNSURE:
        asked = lines.join(F.broadcast(unsure), "line", "left_semi").distinct()
    else:
        asked = lines.distinct().join(unsure, "line", "left_semi")
    counted = asked.groupBy("line").count().filter(F.col("count") >= min_sites).select("line")
    return sure.unionByName(counted)


def _kept(docs: DataFrame, text_col: str, site_col: str, min_sites: int, near: float) -> tuple[DataFrame, Column, Column]:
    """docs with what its plan needs, the lines kept where any are removed (else null), and all lines."""
    found = cut(boilerplate_lines(docs.select(col(text_col).alias("text"), col(site_col).alias("site")), min_sites, near))
    text = col(text_col)
    lines = F.split(text, "\n")
    if found.count() <= SENT_LINES:
        sent = [r[0] for r in found.collect()]
        kept = F.filter(lines, lambda x: (F.trim(x) == "") | ~_line_key(x).isin(sent))
        return docs, F.when(F.size(kept) < F.size(lines), kept), lines
    key, drop = free(docs.columns, "text_key", "drop")
    marks = docs.filter(text.isNotNull()).select(F.xxhash64(text).alias("k"), F.explode(_line_keys(text)).alias("line")).distinct()
    hits = marks.join(found, "line", "left_semi").groupBy(F.col("k").alias(key)).agg(F.collect_set("line").alias(drop))
    out = docs.withColumn(key, F.xxhash64(text)).join(hits, key, "left")
    kept = F.filter(lines, lambda x: (F.trim(x) == "") | ~F.array_contains(F.col(drop), _line_key(x)))
    return out, F.when(F.col(drop).isNotNull() & text.isNotNull(), kept), lines


def clean(docs: DataFrame, text_col: str = "text", site_col: str = "source", min_sites: int = 10, near: float = 0.3) -> DataFrame:
    """docs, its columns as they are, with the texts cleaned. Where nothing is removed, the text is unchanged."""
    rows, kept, _ = _kept(docs, text_col, site_col, min_sites, near)
    return rows.select(*[F.coalesce(F.array_join(kept, "\n"), col(c)).alias(c) if c == text_col else col(c) for c in docs.columns])


def remove_boilerplate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = 10, near: float = 0.3) -> DataFrame:
    """All columns of docs with the text cleaned, and n_lines, n_removed (bigint). Where nothing is removed, the text is unchanged."""
    rows, kept, lines = _kept(docs, text_col, site_col, min_sites, near)
    others = [c for c in docs.columns if c.lower() not in ("n_lines", "n_removed")]
    return rows.select(
        *[F.coalesce(F.array_join(kept, "\n"), col(c)).alias(c) if c == text_col else col(c) for c in others],
        F.when(col(text_col).isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.when(kept.isNull(), 0).otherwise(F.size(lines) - F.size(kept)).cast("long").alias("n_removed"),
    )
