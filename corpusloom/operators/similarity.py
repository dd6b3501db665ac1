"""Exact and near duplicates of documents, section matching and diffs."""

from __future__ import annotations

import difflib
import functools
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions.grouped import Group, apply_sorted
from corpusloom.functions.normalize import fold_yo, norm_space

# Fixed value: what a word is.
WORD = "[0-9A-Za-zА-Яа-яЁё_]+"
# Fixed value: zone codes such as (Ж-1).
ZONE_CODE = "(?U)\\(\\s*([А-ЯA-Z]{1,4})\\s*[-–—]?\\s*(\\d+(?:\\.\\d+)*)\\s*\\)"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def _grams(w: Column, k: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.array_join(F.slice(w, i + 1, k), " "))


def crc(s: Column) -> Column:
    return F.crc32(s.cast("binary"))


def section_shingles(w: Column, k: int = 5) -> Column:
    """Hashes of a section's shingles; of each word where there are fewer than k; none of no words."""
    return F.when(F.size(w) == 0, F.array().cast("array<bigint>")).when(F.size(w) < k, F.array_distinct(F.transform(w, crc))).otherwise(F.array_distinct(F.transform(_grams(w, k), crc)))


def sketch(w: Column, k: int = 5, bottom: int = 6000) -> Column:
    """The distinct ones among a document's `bottom` smallest shingle hashes; short documents hash as a whole."""
    few = F.array(crc(F.array_join(w, " ")))
    return F.when(F.size(w) < k, few).otherwise(F.array_distinct(F.slice(F.sort_array(F.transform(_grams(w, k), crc)), 1, bottom)))


def jaccard(a: Column, b: Column, empty: float = 1.0) -> Column:
    """Of two sets; `empty` if both are, 0 if one is."""
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(empty)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def zone_codes(text: Column) -> Column:
    up = fold_yo(F.upper(text))
    return F.array_distinct(F.zip_with(F.regexp_extract_all(up, F.lit(ZONE_CODE), F.lit(1)), F.regexp_extract_all(up, F.lit(ZONE_CODE), F.lit(2)), lambda a, b: F.concat(a, b)))


def exact_groups(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """sha256, n, first_id of texts that stand more than once."""
    return docs.groupBy(F.sha2(F.col(text_col).cast("binary"), 256).alias("sha256")).agg(F.count("*").alias("n"), F.min(id_col).alias("first_id")).filter("n > 1")


def similar_pairs(docs: DataFrame, threshold: float, id_col: str = "doc_id", text_col: str = "text", k: int = 5) -> DataFrame:
    """Pairs a < b of class representatives (the smallest ids of equal shingle sets) with shared, similarity.

    Exact, by prefix filtering: with shingles ordered from the rarest, two sets as similar as the threshold share one
    among the first n - ceil(threshold * n) + 1 of each, so only those are indexed; the counts are then made on the sets.
    """
    sets = docs.select(F.col(id_col).alias("id"), words(F.col(text_col)).alias("w")).filter(F.size("w") >= k).select("id", F.array_sort(F.array_distinct(F.transform(_grams(F.col("w"), k), lambda x: F.xxhash64(x)))).alias("s"))
    classes = sets.groupBy(F.xxhash64("s").alias("h"), F.size("s").alias("n")).agg(F.min("id").alias("id"), F.min_by("s", "id").alias("s"))
    items = classes.select("id", "n", F.explode("s").alias("x"))
    common = items.groupBy("x").agg(F.count("*").alias("df")).filter("df > 1")
    shared = items.join(common, "x")
    rare_first = Window.partitionBy("id").orderBy("df", "x")
    # shingles of one set alone come first in the order and never match: their number only shortens the prefix
    held = shared.withColumn("total", F.count("*").over(Window.partitionBy("id"))).withColumn("place", F.row_number().over(rare_first) + F.col("n") - F.col("total"))
    prefix = held.filter(F.col("place") <= F.col("n") - F.ceil(F.lit(threshold) * F.col("n")) + 1).select("id", "n", "x")
    a, b = prefix.alias("a"), prefix.alias("b")
    fits = (F.col("a.id") < F.col("b.id")) & (F.least("a.n", "b.n") >= threshold * F.greatest("a.n", "b.n"))
    candidates = a.join(b, (F.col("a.x") == F.col("b.x")) & fits).select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).distinct()
    sa, sb = classes.select(F.col("id").alias("a"), F.col("s").alias("sa")), classes.select(F.col("id").alias("b"), F.col("s").alias("sb"))
    scored = candidates.join(sa, "a").join(sb, "b").withColumn("shared", F.size(F.array_intersect("sa", "sb")).cast("long"))
    return scored.withColumn("similarity", F.col("shared") / (F.size("sa") + F.size("sb") - F.col("shared"))).filter(F.col("similarity") >= threshold).select("a", "b", "shared", "similarity")


def ratio(a: str, b: str, cap: int = 20_000) -> float:
    """difflib's ratio of the first `cap` characters, its junk heuristic on."""
    return difflib.SequenceMatcher(None, (a or "")[:cap], (b or "")[:cap]).ratio()


@functools.lru_cache(maxsize=100_000)
def title_similarity(a: str, b: str) -> float:
    import re

    fold = lambda s: " ".join((s or "").lower().replace("ё", "е").split())
    bag = lambda s: sorted(re.findall(WORD, fold(re.sub(ZONE_CODE[4:], "", s or ""))))
    x, y = fold(a), fold(b)
    if x and x == y or x and y and bag(a) and bag(a) == bag(b):
        return 1.0
    return ratio(x, y)


def _set_jaccard(a: set, b: set) -> float:
    return 1.0 if not a and not b else 0.0 if not a or not b else len(a & b) / len(a | b)


def match_sections(a: Group, b: Group, least: float = 0.3) -> list[tuple[int | None, int | None, float, str]]:
    """Greedy one-to-one matching of sections (ordinal, title, shingles): best scores first, then order."""
    scores = []
    sets = lambda df: [(o, t, set(s)) for o, t, s in zip(df.ordinal, df.title, df.shingles)]
    right = sets(b)
    for i, title_a, x in sets(a):
        for j, title_b, y in right:
            content, title = _set_jaccard(x, y), title_similarity(title_a, title_b)
            score = title if not x or not y else max(content, 0.7 * content + 0.3 * title)
            if score >= least:
                scores.append((-score, i, j))
    left, right, out = dict(zip(a.ordinal, a.title)), dict(zip(b.ordinal, b.title)), []
    for s, i, j in sorted(scores):
        if i in left and j in right:
            renamed = " ".join(left[i].lower().split()) != " ".join(right[j].lower().split())
            out.append((i, j, -s, {(0, 0): "matched", (0, 1): "renamed", (1, 0): "moved", (1, 1): "moved/renamed"}[int(i != j), int(renamed)]))
            del left[i], right[j]
    out.sort()
    return out + [(i, None, 0.0, "deleted") for i in sorted(left)] + [(None, j, 0.0, "inserted") for j in sorted(right)]


def section_alignment(a: DataFrame, b: DataFrame, pair: list[str], least: float = 0.3) -> DataFrame:
    """a, b(*pair, ordinal, title, shingles) -> the matches of each pair of documents."""

    columns = [*pair, "ordinal", "title", "shingles"]
    sided = a.select(*columns, F.lit(0).alias("side")).unionByName(b.select(*columns, F.lit(1).alias("side")))

    def run(key: tuple, group: Group) -> list[tuple]:
        return [(*key, *m) for m in match_sections(group.where("side", 0), group.where("side", 1), least)]

    kinds = ", ".join(f"{p} {a.schema[p].dataType.simpleString()}" for p in pair)
    return apply_sorted(sided, pair, ["side", "ordinal"], run, f"{kinds}, a_ordinal int, b_ordinal int, similarity double, status string")


def structural_similarity(matches: DataFrame, pair: list[str], weight_a: str = "words_a", weight_b: str = "words_b") -> DataFrame:
    """Similarities weighted by words (one at least); what has no match weighs in with 0; nothing at all is 1."""
    w = F.greatest(F.coalesce(F.col(weight_a), F.lit(0)), F.coalesce(F.col(weight_b), F.lit(0)), F.lit(1))
    return matches.groupBy(*pair).agg(F.coalesce(F.sum(F.col("similarity") * w) / F.sum(w), F.lit(1.0)).alias("structural"))


def recommendation(content: Column, structural: Column, reliable: Column, check: Column, doubtful: Column, rows: Column) -> Column:
    share = F.when(rows > 0, reliable / rows).otherwise(0.0)
    return (
        F.when(content >= 0.995, "normalised duplicate").when((share >= 0.8) & (doubtful <= 2), "linked versions").when((share >= 0.5) | (structural >= 0.55), "similar candidate")
        .when((check > 0) | (doubtful > 0), "weak candidate").otherwise("overall similarity")
    )


def block_changes(a: list[str], b: list[str]) -> list[tuple[str, int | None, int | None]]:
    """Changes between two sequences of block keys; replaced blocks pair by position."""
    out = []
    for tag, i1, i2, j1, j2 in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
        if tag == "equal":
            continue
        n = min(i2 - i1, j2 - j1)
        out += [("changed", i1 + x, j1 + x) for x in range(n)] + [("deleted", i, None) for i in range(i1 + n, i2)] + [("inserted", None, j) for j in range(j1 + n, j2)]
    return out


def sequence_diff(a: DataFrame, b: DataFrame, pair: list[str]) -> DataFrame:
    """a, b(*pair, ordinal, key): only keys travel, not texts."""

    sided = a.select(*pair, "ordinal", "key", F.lit(0).alias("side")).unionByName(b.select(*pair, "ordinal", "key", F.lit(1).alias("side")))

    def run(key: tuple, group: Group) -> Iterator[tuple]:
        x, y = group.where("side", 0), group.where("side", 1)
        a_at, b_at = x.ordinal, y.ordinal
        for t, i, j in block_changes(x.key, y.key):
            yield *key, t, None if i is None else a_at[i], None if j is None else b_at[j]

    kinds = ", ".join(f"{p} {a.schema[p].dataType.simpleString()}" for p in pair)
    return apply_sorted(sided, pair, ["side", "ordinal"], run, f"{kinds}, change string, a_ordinal int, b_ordinal int")


def redline(a: str, b: str) -> list[tuple[str, str]]:
    """Segments (equal, delete, insert) between two texts by words, blanks and marks."""
    import re

    x, y = (re.findall(r"\s+|\w+|[^\w\s]", s or "") for s in (a, b))
    out = []
    for tag, i1, i2, j1, j2 in difflib.SequenceMatcher(None, x, y, autojunk=False).get_opcodes():
        if tag == "equal":
            out.append(("equal", "".join(x[i1:i2])))
        else:
            out += [(t, s) for t, s in (("delete", "".join(x[i1:i2])), ("insert", "".join(y[j1:j2]))) if s]
    return out


def unified_diff(a: str, b: str, context: int = 3, most: int = 3000) -> list[str]:
    return list(difflib.unified_diff((a or "").splitlines(), (b or "").splitlines(), "a", "b", n=context, lineterm=""))[:most]


def table_changes(a: list[list[str]], b: list[list[str]]) -> tuple[int, int, int]:
    """Rows changed, inserted and deleted between two tables."""
    found = [c for c, _, _ in block_changes(["\x1f".join(r) for r in a], ["\x1f".join(r) for r in b])]
    return found.count("changed"), found.count("inserted"), found.count("deleted")


def normal_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc, idx, text: a document's lines as its items."""
    return docs.select(F.col(id_col).alias("doc"), F.posexplode(F.split(text_col, "\n")).alias("idx", "text"))


def line_sections(lines: DataFrame) -> DataFrame:
    """Consecutive lines that begin with the same capital as sections: doc, ordinal, title, n_lines, shingles."""
    w = Window.partitionBy("doc").orderBy("idx")
    key = F.substring(norm_space(F.col("text")), 1, 1)
    s = lines.withColumn("key", key).withColumn("new", (~F.col("key").eqNullSafe(F.lag("key").over(w))).cast("int")).withColumn("ordinal", F.sum("new").over(w).cast("int"))
    return s.groupBy("doc", "ordinal").agg(F.min("key").alias("title"), F.count("*").alias("n_lines"), section_shingles(words(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda x: x["text"]), " "))).alias("shingles"))
