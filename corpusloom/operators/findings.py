"""Findings of several producers as one deduplicated result, statuses, summaries and gates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions.normalize import stable_hash
from corpusloom.plans.session import checkpoints
from corpusloom.sources import ooxml


def unify(streams: list[DataFrame]) -> DataFrame:
    """Findings (owner, file, node, start, end, class_id, before, after) as one table: ids in order, the status
    (duplicates of an equal issue are suppressed) and overlap groups (a target with entries of two owners or more)."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), streams)
    target = F.concat_ws("|", "file", F.col("node").cast("string"), F.col("start").cast("string"), F.col("end").cast("string"))
    # equal issues have one target, so one exchange by it serves all; nothing is written but that
    rows = rows.withColumn("target", stable_hash(target)).repartition("target")
    rows = rows.withColumns({"issue": stable_hash(F.concat_ws("|", target, "class_id", F.coalesce("before", F.lit("")), F.coalesce("after", F.lit("")))), "key": F.concat_ws("|", target, "class_id", "owner")})
    of_target = Window.partitionBy("target")
    first = F.min("key").over(Window.partitionBy("target", "issue"))
    two_owners = F.min("owner").over(of_target) < F.max("owner").over(of_target)
    return rows.select(*rows.columns, F.when(F.col("key") == first, "active").otherwise("duplicate").alias("status"), F.when(two_owners, F.col("target")).alias("overlap_group"))


def numbered(rows: DataFrame, order: list[str], prefix: str = "U", digits: int = 5, partition: list[str] | None = None) -> DataFrame:
    """Ids such as U00001 in order, within each partition; without one, over all rows, which are sorted by ranges."""
    if not partition:
        checkpoints(rows.sparkSession)
        sorted_rows = rows.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()).checkpoint()
        part = F.shiftright("__at", 33)
        before = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
        base = sorted_rows.groupBy(part.alias("p")).count().select("p", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__base"))  # a row a partition
        number = F.col("__base") + F.col("__at").bitwiseAND((1 << 33) - 1) + 1
        return sorted_rows.join(F.broadcast(base), part == F.col("p")).withColumn("id", F.format_string(f"{prefix}%0{digits}d", number)).drop("__at", "__base", "p")
    return rows.withColumn("id", F.format_string(f"{prefix}%0{digits}d", F.row_number().over(Window.partitionBy(*partition).orderBy(*order))))


def capped(rows: DataFrame, by: list[str], order: list[str], most: int = 300) -> DataFrame:
    """The first `most` findings of each file and, beyond, a row that says how many more there are (a report's limit)."""
    w = Window.partitionBy(*by)
    ranked = rows.withColumns({"__n": F.row_number().over(w.orderBy(*order)), "__all": F.count("*").over(w)})
    cut = ranked.filter((F.col("__n") == 1) & (F.col("__all") > most)).select(*by, F.lit("findings-truncated").alias("class_id"), (F.col("__all") - most).alias("more"))
    return ranked.filter(F.col("__n") <= most).drop("__n", "__all").withColumn("more", F.lit(None).cast("long")).unionByName(cut, allowMissingColumns=True)


def audit_status(rows: DataFrame, by: list[str]) -> DataFrame:
    """rows(*by, action FIX/PLAN/SUGGEST) -> PASS, FIXED, PARTIAL or FAIL."""
    n = rows.groupBy(*by).agg(F.count_if(F.col("action") == "FIX").alias("fixes"), F.count_if(F.col("action") != "FIX").alias("open"))
    return n.withColumn("status", F.when((F.col("fixes") == 0) & (F.col("open") == 0), "PASS").when(F.col("open") == 0, "FIXED").when(F.col("fixes") > 0, "PARTIAL").otherwise("FAIL"))


def keep_best(rows: DataFrame, key: str, order: list) -> DataFrame:
    """One row per key, the first in order: a partial aggregate, whatever share of the rows one key has."""
    return rows.groupBy(key).agg(F.min_by(F.struct(*rows.columns), F.struct(*order)).alias("best")).select("best.*")


#: What a gate counts in an HTML or XML part.
METRICS = {"tags": "<[a-zA-Z]", "bold": "<b>|<b ", "scripts": "<script", "styles": "style=", "comments": "<!--", "links": "<a ", "insertions": "<ins[ >]", "deletions": "<del[ >]"}


def package_gate(files: DataFrame, stage: str) -> DataFrame:
    """files(path, content) -> stage, file, the thirteen metrics, status: of each package and, with file null, in total. FAIL where any metric isn't 0 or the package can't be opened."""
    counted = ooxml.gates(files)
    out = counted.rollup("file").agg(*[F.sum(m).alias(m) for m in ooxml.GATE], F.count_if(~F.col("ok")).alias("unread"))
    bad = reduce(lambda a, b: a | b, [F.col(m) > 0 for m in (*ooxml.GATE, "unread")])
    return out.select(F.lit(stage).alias("stage"), "file", *ooxml.GATE, F.when(bad, "FAIL").otherwise("PASS").alias("status"))


def gate(parts: DataFrame, file: str, content: str, hard: tuple[str, ...] = ("scripts", "comments", "insertions", "deletions")) -> DataFrame:
    """Metrics per file and, with file null, in total; FAIL where a hard metric isn't 0."""
    counted = parts.select(F.col(file).alias("file"), *[F.regexp_count(F.coalesce(F.col(content), F.lit("")), F.lit(p)).cast("long").alias(m) for m, p in METRICS.items()])
    out = counted.rollup("file").agg(*[F.sum(m).alias(m) for m in METRICS])
    return out.withColumn("status", F.when(reduce(lambda a, b: a | b, [F.col(m) > 0 for m in hard]), "FAIL").otherwise("PASS"))
