"""SimHash near-duplicates: fingerprints, pigeonring candidates, components.

Two fingerprints within 2 differing bits agree on one of 3 segments of the word (pigeonhole), and - the pigeonring
condition - from some agreeing segment on, the differences summed over consecutive segments around the ring stay
within the proportional budgets 0, 1, 2. Buckets of one segment value give the candidates, the chain prunes them
and the full Hamming distance decides.

A bucket with many fingerprints isn't paired: fingerprints within 2 bits of each other share a value one flip away
from both, so each is joined to the smallest fingerprint around every such value (at most 65 stand around one).
That is exact too and linear, whatever the group's size. Equal fingerprints are one node throughout.

Null and wordless texts have fingerprint zero. Fewer words than a shingle: the whole sequence is the shingle.
Null ids stay, and never are a component's id unless nothing else is. Repeated rows stay. Empty input: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.llm.common import LOWER_TABLE, cut, small_batches, sub_batches
from corpusloom.llm.graph import components

#: First bit and width of each segment, in ring order.
SEGMENTS = ((0, 21), (21, 21), (42, 22))
BUDGET = 2
#: Buckets with more fingerprints than this are linked through shared neighbours instead of pairs.
PAIRED = 64


def shingle_hashes(text: str | None, k: int, seed: int) -> np.ndarray:
    from xxhash import xxh64_intdigest

    words = b"" if text is None else text.encode("utf-8", "replace").translate(LOWER_TABLE)
    words = words.split()
    if len(words) <= k:
        return np.array([xxh64_intdigest(b" ".join(words), seed)] if words else [], dtype=np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[: -k] + 1).tolist()]
    return np.fromiter((xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts, ends[k - 1 :].tolist())), np.uint64, len(starts))


def simhash(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes, as a signed 64-bit integer."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = np.ascontiguousarray(hashes[at : at + (1 << 15)]).view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, fp (bigint)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sub_batches(batches, "text"):
            fp = [simhash(shingle_hashes(t, shingle, seed)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.int64())], names=["doc_id", "fp"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return small_batches(rows).mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp bigint")


def _part(c, first: int, width: int):
    return F.shiftrightunsigned(c, first).bitwiseAND(F.lit((1 << width) - 1))


def close_fingerprints(nodes: DataFrame) -> DataFrame:
    """nodes(fp), distinct -> edges a, b that connect whatever lies within the budget."""
    keyed = nodes.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("seg"), _part(F.col("fp"), *s).alias("val")) for i, s in enumerate(SEGMENTS)])).alias("k")).select("fp", "k.*")
    keyed = cut(keyed)
    sizes = keyed.groupBy("seg", "val").count()
    few = keyed.join(sizes.filter(f"count between 2 and {PAIRED}"), ["seg", "val"], "left_semi")
    diff = F.col("a").bitwiseXOR(F.col("b"))
    following = F.coalesce(*[F.when(F.col("seg") == i, F.bit_count(_part(diff, *SEGMENTS[(i + 1) % len(SEGMENTS)]))) for i in range(len(SEGMENTS))])
    chain = following <= BUDGET * 2 // len(SEGMENTS)
    paired = (
        few.select("seg", "val", F.col("fp").alias("a"))
        .join(few.select("seg", "val", F.col("fp").alias("b")), ["seg", "val"])
        .filter(F.col("a") < F.col("b"))
        .filter(chain)
        .filter(F.bit_count(diff) <= BUDGET)
        .select("a", "b")
    )
    many = keyed.join(sizes.filter(f"count > {PAIRED}"), ["seg", "val"], "left_semi")
    signed = lambda k: F.lit((1 << k) - (1 << 64) * (k == 63)).cast("long")
    flips = F.coalesce(*[F.when(F.col("seg") == i, F.array(F.lit(0).cast("long"), *[signed(k) for k in range(64) if not s[0] <= k < sum(s)])) for i, s in enumerate(SEGMENTS)])
    around = many.withColumn("flip", F.explode(flips)).select("seg", "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("mid"))
    around = around.select(F.col("fp").alias("a"), F.min("fp").over(Window.partitionBy("seg", "mid")).alias("b")).filter("a != b")
    return paired.unionByName(around).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the smallest id reachable)."""
    rows = cut(fingerprints(docs, id_col, text_col, shingle, seed))
    nodes = rows.groupBy("fp").agg(F.min("doc_id").alias("low"))
    found = components(close_fingerprints(nodes.select("fp")))
    placed = nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lowest = placed.groupBy("root").agg(F.min("low").alias("component_id"))
    named = placed.join(lowest, "root").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, seed: int = 42) -> DataFrame:
    """docs without near-duplicates: of each component the row of the smallest id stays (rows of a repeated id stay together)."""
    found = near_duplicates(docs, id_col, text_col, shingle, seed)
    keep = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("__keep")).distinct()
    return docs.join(keep, docs[id_col].eqNullSafe(keep["__keep"]), "left_semi")
