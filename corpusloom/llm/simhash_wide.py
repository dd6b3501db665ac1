"""SimHash groups: fingerprints within two bits by pigeonring, and further texts down to a similarity of word shingles (0.8 by default).

Texts whose 64-bit fingerprints (those of `simhash`, of three words) differ in two bits at most are linked as there: segments of
the fingerprints meet by pigeonring, and all links count. What follows adds to them and takes none away.

A near copy at the similarity differs in far more than two bits of 64, and after an edit of a block (a text cut short,
an added section) in more word bits than after scattered edits, so further candidates come from the shingles themselves: under
one order of all shingles, two texts at the threshold share one of the first n - ceil(similarity * n) + 1 of their n
distinct shingles, whatever the edit and however many texts there are. Any one order is exact; here shingles that are
frequent in a sample of the texts come last, so that a common passage makes no bucket as long as the rest of a text
suffices. Shingles that the same texts hold make one bucket.

Candidates are told apart on a fingerprint of 640 bits over the shingles, whose differing share estimates the angle and
so the similarity. Pairs clearly above the threshold (by two standard deviations) are linked on it. In a bucket texts
are compared outward from one text after another: each search only takes in what is not linked yet, so a bucket of many
copies costs about its size and yields a spanning forest, not its pairs.

A bucket beyond `bucket_rows` is dealt over groups of that size, each with the same few pivots, which link what is alike
over the groups. Then all its texts outside of its largest linked set so far are compared with all of the bucket, in
blocks of bounded size and between different sets only; so no pair is left out. Where pivots link nearly all, that costs
little more than the bucket's size; a large bucket of texts that aren't alike costs its square.

Last, the texts that are within the estimate's error of the threshold to one of another set get their shingles back (a bitmap of
their rows goes to where the texts stand, so that only those shingles travel), and
the Jaccard similarity of the shingle sets decides. So links are exact but for what the estimate puts that far off.
Shingles are compared by 32 bits there, which a text of a thousand words may confuse once in four thousand texts. What is emitted is always a forest or one row a text and bucket, never pairs.

Equal texts are one node; texts and shingles are told by 64-bit hashes. Null text: empty. Fewer words than a shingle: the
whole sequence is one shingle; texts without words share one. Repeated rows share a group. Empty input: no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from corpusloom.llm.common import LOWER_TABLE, col, cut, forget, join_texts, mix64, small_batches, span_hash, sub_batches, tidy, word_spans
from corpusloom.llm.graph import components
from corpusloom.llm.simhash import close_fingerprints, shingle_hashes, simhash

#: Words of a shingle and seed of the fingerprints that meet by pigeonring, as in op5.
RING_SHINGLE, RING_SEED = 3, 42
WIDE = 10  # 64-bit words of the shingle fingerprint
#: Texts of the sample that tells frequent shingles, how many of them make a shingle frequent, and the most that are told.
SAMPLE_TEXTS, FREQUENT, MOST_FREQUENT = 5000, 5, 200_000
#: Of a large bucket, about so many texts stand in each of its groups.
PIVOTS = 8
#: Standard deviations of the fingerprints' differing bits, below and above the threshold, within which the shingles decide; rows of a bucket that are then compared at once.
SLACK, DECIDED_ROWS = (2.0, 3.0), 4000
#: Bits of the bitmap of texts in doubt: for each of them, and the power of two at which it ends (32 MB; beyond, more are picked by chance).
MARKED, MOST_BITS = 32, 28
MET = ("val", "a", "b", "side", "text_key", "root", "wide")


def wide_simhash(h: np.ndarray, words: int) -> np.ndarray:
    """words 64-bit simhashes of 64-bit hashes, each from hashes mixed with another salt."""
    out = np.zeros(words, np.uint64)
    for i in range(words if len(h) else 0):
        counts = np.zeros(64, np.int64)
        salted = mix64(h + np.uint64(0x9E3779B97F4A7C15 * (i + 1) % (1 << 64)))
        for at in range(0, len(h), 1 << 15):
            counts += np.unpackbits(salted[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out[i] = np.packbits(counts * 2 > len(h), bitorder="little").view(np.uint64)[0]
    return out


def _shingles(texts: list, shingle: int) -> Iterator[np.ndarray]:
    """Of each text the hashes of its distinct shingles, ascending; never none."""
    raw, ends = join_texts(texts, LOWER_TABLE)
    buf = np.frombuffer(raw, np.uint8)
    s, e = word_spans(buf)
    h = span_hash(buf, s, e)
    first = np.searchsorted(s, np.concatenate(([0], ends)))
    for lo, hi in zip(first[:-1], first[1:]):
        own = h[lo:hi]
        mixed = np.zeros(max(len(own) - shingle + 1, 1), np.uint64)
        for i in range(min(shingle, len(own))):
            mixed = mix64(mixed + own[i : i + len(mixed)])
        yield np.unique(mixed)


def prefix(hashes: np.ndarray, frequent: np.ndarray, similarity: float) -> np.ndarray:
    """The first shingles of a text, one of which every text of that similarity has among its own first ones.

    hashes ascend; the order is by hash, after which come the frequent ones as listed.
    """
    n = len(hashes) - math.ceil(similarity * len(hashes) - 1e-9) + 1
    known = np.isin(hashes, frequent)
    out = hashes[~known][:n]
    return out if len(out) == n else np.concatenate((out, frequent[np.isin(frequent, hashes[known])][: n - len(out)]))


def link_bucket(ids: np.ndarray, wides: np.ndarray, most: int) -> list[tuple[int, int]]:
    """A spanning forest of the bucket's texts that differ in at most so many bits."""
    order = np.argsort(ids)
    ids, wides = ids[order], wides[order]
    left, edges = np.arange(len(ids)), []
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            x = front.pop(0)
            near = np.bitwise_count(wides[left] ^ wides[x]).sum(1) <= most
            edges += [(int(ids[x]), int(ids[y])) for y in left[near]]
            front += left[near].tolist()
            left = left[~near]
    return edges


def _cuts(rows: pa.Table, n_keys: int) -> np.ndarray:
    """Where the first n_keys columns change, both ends included."""
    key = np.stack([rows.column(i).to_numpy() for i in range(n_keys)], axis=1)
    return np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]).any(1), [True])))


def _wides(rows: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(rows.column("wide").to_pylist()), np.uint64).reshape(rows.num_rows, WIDE)


def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*pairs) if pairs else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _linked(rows: pa.Table, n_keys: int, most: int) -> pa.RecordBatch:
    """Edges of whole buckets; those of two texts are taken all at once."""
    ids, wides, cuts = rows.column("text_key").to_numpy(), _wides(rows), _cuts(rows, n_keys)
    size = np.diff(cuts)
    one = cuts[:-1][size == 2]
    one = one[np.bitwise_count(wides[one] ^ wides[one + 1]).sum(1) <= most]
    edges = list(zip(ids[one].tolist(), ids[one + 1].tolist()))
    for lo, n in zip(cuts[:-1][size > 2].tolist(), size[size > 2].tolist()):
        edges += link_bucket(ids[lo : lo + n], wides[lo : lo + n], most)
    return _edges(edges)


def _across(rows: pa.Table, n_keys: int, most: int) -> pa.RecordBatch:
    """Edges between the texts of side 0 and those of side 1 in each bucket, as many as join their sets (`root`)."""
    ids, roots, side, wides, cuts = *(rows.column(c).to_numpy() for c in ("text_key", "root", "side")), _wides(rows), _cuts(rows, n_keys)
    edges = []
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        own, label = slice(lo, hi), roots[lo:hi].copy()
        others = np.flatnonzero(side[own] == 1)
        for x in np.flatnonzero(side[own] == 0):
            apart = others[label[others] != label[x]]
            near = apart[np.bitwise_count(wides[own][apart] ^ wides[lo + x]).sum(1) <= most]
            if len(near):
                sets, at = np.unique(label[near], return_index=True)
                edges += [(int(ids[lo + x]), int(ids[lo + y])) for y in near[at]]
                label[np.isin(label, sets)] = label[x]
    return _edges(edges)


def _in_doubt(rows: pa.Table, n_keys: int, most: int) -> pa.RecordBatch:
    """The rows that are within `most` bits of one of another set in their bucket. Side 2 stands on both sides."""
    roots, side, wides, cuts = rows.column("root").to_numpy(), rows.column("side").to_numpy(), _wides(rows), _cuts(rows, n_keys)
    doubt = np.zeros(rows.num_rows, bool)
    first = cuts[:-1]
    differ = np.flatnonzero(np.minimum.reduceat(roots, first) != np.maximum.reduceat(roots, first)) if len(first) else first
    two = first[differ[np.diff(cuts)[differ] == 2]]
    two = two[np.bitwise_count(wides[two] ^ wides[two + 1]).sum(1) <= most]
    doubt[two] = doubt[two + 1] = True
    for i in differ[np.diff(cuts)[differ] > 2].tolist():
        lo, hi = int(cuts[i]), int(cuts[i + 1])
        right = lo + np.flatnonzero(side[lo:hi] != 0)
        for x in (lo + np.flatnonzero(side[lo:hi] != 1)).tolist():
            apart = right[roots[right] != roots[x]]
            near = apart[np.bitwise_count(wides[apart] ^ wides[x]).sum(1) <= most]
            doubt[near] = True
            doubt[x] |= len(near) > 0
    found = rows.filter(pa.array(doubt)).combine_chunks().to_batches()
    return found[0] if found else pa.RecordBatch.from_pylist([], schema=rows.schema)


def _decided(rows: pa.Table, n_keys: int, most: int, similarity: float) -> pa.RecordBatch:
    """Edges between texts of different sets whose shingle sets are as similar as asked, as many as join the sets."""
    ids, roots, side, wides, cuts = *(rows.column(c).to_numpy() for c in ("text_key", "root", "side")), _wides(rows), _cuts(rows, n_keys)
    sets = [np.frombuffer(x, np.uint32) for x in rows.column("shingles").to_pylist()]
    size, edges = np.array([len(x) for x in sets]), []
    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        label = roots[lo:hi].copy()
        right = lo + np.flatnonzero(side[lo:hi] != 0)
        for x in (lo + np.flatnonzero(side[lo:hi] != 1)).tolist():
            near = right[np.bitwise_count(wides[right] ^ wides[x]).sum(1) <= most]
            near = near[np.minimum(size[near], size[x]) >= similarity * np.maximum(size[near], size[x]) - 1e-9]
            for y in near.tolist():
                if label[y - lo] != label[x - lo]:
                    shared = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                    if shared >= similarity * (size[x] + size[y] - shared) - 1e-9:
                        edges.append((int(ids[x]), int(ids[y])))
                        label[label == label[y - lo]] = label[x - lo]
    return _edges(edges)


def _by_bucket(rows: DataFrame, keys: list[str], of_buckets, schema: str | StructType = "a bigint, b bigint") -> DataFrame:
    """of_buckets(rows of whole buckets, number of key columns), by default edges(a, b); the keys are the first columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by bucket; a bucket may go on over the end of a batch."""
        held: list[pa.RecordBatch] = []
        for b in batches:
            if b.num_rows:
                held.append(b)
                change = _cuts(pa.Table.from_batches([b]), len(keys))[1:-1]
                first = held[-2].slice(held[-2].num_rows - 1) if len(held) > 1 else None
                if first is not None and any(first.column(i)[0] != b.column(i)[0] for i in range(len(keys))):
                    change = np.concatenate(([0], change))
                if len(change):
                    stop = int(change[-1])
                    yield of_buckets(pa.Table.from_batches([*held[:-1], b.slice(0, stop)]), len(keys))
                    held = [b.slice(stop)]
        if held:
            yield of_buckets(pa.Table.from_batches(held), len(keys))
        held.clear()
        tidy()

    # by a hash of its own: were it the partitioning of a join below, adaptive execution could drop this exchange and read that one piecemeal
    return rows.repartition(F.xxhash64(F.lit(3), *keys)).sortWithinPartitions(*keys).mapInArrow(run, schema)


def _frequent(keyed: DataFrame, n_texts: int, shingle: int) -> np.ndarray:
    """Hashes of the shingles that are frequent in a sample of the texts, the rarer first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sub_batches(batches, "text"):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(list(_shingles(b.column(0).to_pylist(), shingle))).view(np.int64))], names=["h"])

    share = max(1, n_texts // SAMPLE_TEXTS)
    sample = keyed.filter(F.pmod(F.xxhash64(F.lit(5), "text_key"), F.lit(share)) == 0).dropDuplicates(["text_key"]).select("text")
    counts = small_batches(sample).mapInArrow(run, "h bigint").groupBy("h").count().filter(F.col("count") >= FREQUENT)
    found = [r[0] for r in counts.orderBy(F.desc("count"), "h").limit(MOST_FREQUENT).collect()]
    return np.array(found[::-1], np.int64).view(np.uint64)


def _dealt(seed: int, groups: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), "text_key"), groups).cast("int")


def _blocked(rows: DataFrame, room: int) -> DataFrame:
    """rows(val, n, text_key, root, wide) of large buckets -> those outside a bucket's largest set (side 0) met with all of it (side 1), in blocks a, b."""
    sets = rows.groupBy("val", "root").count()
    rest = sets.groupBy("val").agg(F.max_by("root", F.struct("count", "root")).alias("top"), (F.sum("count") - F.max("count")).alias("n_rest")).filter("n_rest > 0")
    block = max(1, room // 2)
    n_a, n_b = F.ceil(F.col("n_rest") / block).cast("int"), F.ceil(F.col("n") / block).cast("int")
    rows = rows.join(rest, "val")
    left = rows.filter("root != top").withColumns({"side": F.lit(0), "a": _dealt(17, n_a), "b": F.explode(F.sequence(F.lit(0), n_b - 1))}).select(*MET)
    right = rows.withColumns({"side": F.lit(1), "b": _dealt(19, n_b), "a": F.explode(F.sequence(F.lit(0), n_a - 1))}).select(*MET)
    return left.unionByName(right)


def _rooted(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """rows(..., text_key, ...) with the root of each text's set."""
    return rows.join(components(edges).withColumnRenamed("node", "text_key"), "text_key", "left").withColumn("root", F.coalesce("root", "text_key"))


def _large_buckets(few: DataFrame, large: DataFrame, bucket_rows: int, most: int) -> DataFrame:
    """The edges `few` and those of large(val, n, text_key, wide), no group of more than about bucket_rows rows in one task."""
    groups = F.ceil(F.col("n") / bucket_rows).cast("int")
    pivots = large.filter(_dealt(13, F.col("n")) < PIVOTS).withColumn("salt", F.explode(F.sequence(F.lit(0), groups - 1)))
    dealt = large.withColumn("salt", _dealt(11, groups)).unionByName(pivots).select("val", "salt", "text_key", "wide")
    edges = cut(few.unionByName(_by_bucket(dealt, ["val", "salt"], lambda rows, n_keys: _linked(rows, n_keys, most))))
    met = _blocked(cut(_rooted(large, edges)), bucket_rows)
    return edges.unionByName(_by_bucket(met, ["val", "a", "b"], lambda rows, n_keys: _across(rows, n_keys, most)))


def _smallest_ids(keyed: DataFrame) -> DataFrame:
    """text_key, doc_id: of each text the smallest id of its rows; null only where there is no other."""
    return keyed.groupBy("text_key").agg(F.min("doc_id").alias("doc_id"))


def _row_key() -> Column:
    return F.xxhash64("doc_id", "text_key")


def _marks(keys: DataFrame, n: int) -> np.ndarray:
    """A bitmap of n keys(key), hashes, at about MARKED bits each: so texts are picked where they stand, and only what is picked travels."""
    bits = min(1 << MOST_BITS, max(1 << 15, 1 << (MARKED * n).bit_length()))
    bit = F.col("key").bitwiseAND(F.lit(bits - 1)) + 1
    found = keys.groupBy(F.bitmap_bucket_number(bit).alias("at")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bitmap")).collect()
    out = np.zeros((bits >> 15, 1 << 12), np.uint8)
    for r in found:
        out[r["at"] - 1] = np.frombuffer(bytes(r["bitmap"]), np.uint8)
    return out.ravel()


def marked(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of the keys (bigint) are marked: all that the bitmap was made of, and others by chance."""
    bit = keys & np.int64(8 * len(bitmap) - 1)
    return (bitmap[bit >> 3] >> (bit & 7).astype(np.uint8) & 1).astype(bool)


def _decisions(rows_of: DataFrame, edges: DataFrame, keyed: DataFrame, shingle: int, similarity: float, room: int, most: int) -> DataFrame:
    """Further edges, by the shingles of the texts that are in doubt."""
    rows = cut(_rooted(rows_of, edges))
    few = rows.filter(F.col("n") <= room).withColumns({"side": F.lit(2), "a": F.lit(0), "b": F.lit(0)}).select(*MET)
    met = few.unionByName(_blocked(rows.filter(F.col("n") > room), room))
    doubt = cut(_by_bucket(met, ["val", "a", "b"], lambda rows, n_keys: _in_doubt(rows, n_keys, most), met.schema))
    # one row stands for all copies of a text, so that they don't meet in one task
    texts = doubt.select("text_key").distinct()
    one = _smallest_ids(keyed).join(texts, "text_key", "left_semi")
    sent = keyed.sparkSession.sparkContext.broadcast(_marks(one.select(_row_key().alias("key")), texts.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The shingles of marked rows; the few that are marked by chance are copies, or not asked for below."""
        for b in sub_batches(batches, "text"):
            b = b.filter(pa.array(marked(sent.value, b.column(2).to_numpy())))
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array([np.unique((h >> np.uint64(32)).astype(np.uint32)).tobytes() for h in _shingles(b.column(0).to_pylist(), shingle)], pa.binary())], names=["text_key", "shingles"])

    asked = small_batches(keyed.select("text", "text_key", _row_key().alias("row_key"))).mapInArrow(run, "text_key bigint, shingles binary").dropDuplicates(["text_key"])
    held = doubt.join(asked, "text_key").select(*MET, "shingles")
    return _by_bucket(held, ["val", "a", "b"], lambda rows, n_keys: _decided(rows, n_keys, most, similarity))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(col(id_col).alias("doc_id"), col(text_col).cast("string").alias("text")).withColumn("text_key", F.xxhash64(F.coalesce("text", F.lit(""))))


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, bucket_rows: int = 20_000) -> DataFrame:
    """doc_id, text_key, group: rows of one group are linked by fingerprints within two bits or texts of at least that similarity (a long of its own, not an id)."""
    keyed = _keyed(docs, id_col, text_col)
    found = _text_groups(keyed, shingle, similarity, bucket_rows)
    return keyed.select("doc_id", "text_key").join(found, "text_key", "left").select("doc_id", "text_key", F.coalesce("root", "text_key").alias("group"))


def _ring_links(nodes: DataFrame) -> DataFrame:
    """nodes(text_key, fp) -> edges between texts whose fingerprints are linked by pigeonring; those of a fingerprint hang on its smallest text."""
    lowest = cut(nodes.groupBy("fp").agg(F.min("text_key").alias("low")))
    same = nodes.join(lowest, "fp").filter("text_key != low").select(F.col("text_key").alias("a"), F.col("low").alias("b"))
    close = close_fingerprints(lowest.select("fp"))
    named = lambda c: lowest.select(F.col("fp").alias(c), F.col("low").alias(f"{c}_key"))
    return same.unionByName(close.join(named("a"), "a").join(named("b"), "b").select(F.col("a_key").alias("a"), F.col("b_key").alias("b")))


def _text_groups(keyed: DataFrame, shingle: int, similarity: float, bucket_rows: int) -> DataFrame:
    """text_key, root: the set of each text that is linked to another."""
    n_texts = keyed.select("text_key").distinct().count()
    sent = keyed.sparkSession.sparkContext.broadcast(_frequent(keyed, n_texts, shingle))
    bits, apart = 64 * WIDE, math.acos(2 * similarity / (1 + similarity)) / math.pi  # differing share at the threshold, for sets of equal size
    deviation = math.sqrt(bits * apart * (1 - apart))
    sure, most = int(bits * apart - SLACK[0] * deviation), int(bits * apart + SLACK[1] * deviation)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each text's first shingles (val), and one row with its two fingerprints (that of 64 bits as val); copies that a task meets again add none."""
        seen: set[int] = set()
        for b in sub_batches(batches, "text"):
            keys = b.column(1).to_pylist()
            new = [i for i, k in enumerate(keys) if k not in seen and not seen.add(k)]
            first, wide, owner = [], [], []
            texts = b.column(0).take(pa.array(new, pa.int64())).to_pylist()
            for k, text, own in zip((keys[i] for i in new), texts, _shingles(texts, shingle)):
                first += [prefix(own, sent.value, similarity).view(np.int64), np.array([simhash(shingle_hashes(text, RING_SHINGLE, RING_SEED))], np.int64)]
                owner.append(np.full(len(first[-2]) + 1, k, np.int64))
                wide += [*[None] * len(first[-2]), wide_simhash(own, WIDE).tobytes()]
            if new:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(first)), pa.array(np.concatenate(owner)), pa.array(wide, pa.binary())], names=["val", "text_key", "wide"])

    # all by one exchange; shingles of the same texts are told by a hash of the set of their texts
    by_val = Window.partitionBy("val", "prints")
    all_rows = small_batches(keyed.select("text", "text_key")).mapInArrow(run, "val bigint, text_key bigint, wide binary").withColumn("prints", F.col("wide").isNotNull())
    all_rows = all_rows.repartition("val").dropDuplicates(["val", "prints", "text_key"])
    counted = all_rows.withColumns({"n": F.count("*").over(by_val), "x": F.bit_xor(F.xxhash64("text_key")).over(by_val)})
    held = cut(counted.filter("prints or n > 1"))
    nodes = held.filter("prints").select("text_key", "wide", F.col("val").alias("fp")).dropDuplicates(["text_key"])
    met = held.filter("not prints").select("val", "n", "x", "text_key")
    buckets = cut(met.groupBy("n", "x").agg(F.min("val").alias("val")).select("val", "n"))
    rows_of = cut(met.join(buckets.select("val"), "val", "left_semi").join(nodes, "text_key").select("val", "n", "text_key", "wide"))
    ring = _ring_links(nodes.select("text_key", "fp"))
    edges = ring.unionByName(_by_bucket(rows_of.filter(F.col("n") <= bucket_rows).drop("n"), ["val"], lambda rows, n_keys: _linked(rows, n_keys, sure)))
    if not buckets.filter(F.col("n") > bucket_rows).isEmpty():
        edges = _large_buckets(cut(edges), rows_of.filter(F.col("n") > bucket_rows), bucket_rows, sure)
    edges = cut(edges)
    del all_rows, counted, held, nodes, met, buckets, ring
    forget(keyed.sparkSession)
    found = components(edges.unionByName(_decisions(rows_of, edges, keyed, shingle, similarity, min(bucket_rows, DECIDED_ROWS), most)))
    return found.withColumnRenamed("node", "text_key")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, bucket_rows: int = 20_000) -> DataFrame:
    """docs with one row of each group: that of the smallest id (a null id only where there is no other); rows of a repeated id stay together."""
    keyed = _keyed(docs, id_col, text_col)
    texts = cut(_smallest_ids(keyed).join(_text_groups(keyed, shingle, similarity, bucket_rows), "text_key", "left"))
    keep = texts.groupBy(F.coalesce("root", "text_key").alias("group")).agg(F.min("doc_id").alias("__keep")).select("__keep")
    return docs.join(keep, docs[id_col].eqNullSafe(keep["__keep"]), "left_semi")
