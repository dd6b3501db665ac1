"""Packing documents into sequences of a fixed number of tokens by a linear grouping scheme.

Documents become token ids with an end id; only longer ones are cut into full pieces. The plan is made on the
histogram of piece lengths, which has at most one entry a length however many documents there are:

1. large lengths are sorted, cut into groups of equal cardinality and rounded up to their group's largest;
2. with so few sizes, configurations of a sequence are optimised by column generation (a knapsack prices them);
3. the actual pieces take the places of the rounded ones; what the rounding down of the solution leaves, and the
   small pieces, go by decreasing length to where they fit best.

Pieces, sequences and places stay in runs (length, ranks, sequences), so the plan's size depends on the number of
lengths alone. Each piece looks up its place by its length and its rank among the pieces of that length: the task that
cuts pieces numbers its own by length, and the tasks' counts, added up, tell where each task's ranks start. So token
ids are shuffled once, to their sequence: sequences() gives the packed ids, and pack() tells of the pieces from those.

Column generation ends at the optimum, or after `rounds` columns with a plan that is as valid but may need a few
sequences more.

Null text: an empty document, which is its end id alone. Repeated rows are packed each. Empty input: no rows.
"""

from __future__ import annotations

import functools
import re
import unicodedata
import uuid
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.llm.common import cut, ensure_checkpoint_dir, small_batches, span_hash, sub_batches, word_spans
from corpusloom.llm.fst_tokens import byte_letters

# --- token ids ---

_SIMPLE = "".join(map(chr, range(0x250)))  # here NFC changes nothing and lower-casing is by character
_LETTERS = "".join(c for c in _SIMPLE if unicodedata.category(c)[0] == "L")
_DIGITS = "".join(c for c in _SIMPLE if unicodedata.category(c)[0] == "N")
_BLANKS = "\t\n\x0b\x0c\r \x85\xa0"
_WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_DIGITS}]|[^{_BLANKS}{_LETTERS}{_DIGITS}]+")
_BEYOND = re.compile("[\x01\x1c-\x1f\u0250-\U0010ffff]")


class WordIds:
    """Ids of whole texts as the library gives them.

    The tokenizer lower-cases, drops white space and splits into words before its merges, so a text's ids are those of
    its chunks between white space, and a chunk's those of its words, in order; a batch's distinct chunks are encoded
    once. The merges run in a rank encoder over the same vocabulary, where a control byte stands for a word's end.
    Texts with that byte, separator controls or characters beyond Latin, or a special token's opening, go to the
    library whole.
    """

    def __init__(self, path: str, end_id: int = 0) -> None:
        import json

        import tiktoken

        self.path, self.end = path, end_id
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        letters, vocab = byte_letters(), model["vocab"]
        printed = {b: c for c, b in letters.items()}
        names = [c + w for w in ("", "</w>") for c in (printed[b] for b in range(256))] + ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        names = list(dict.fromkeys(names))  # single bytes, with and without a word's end, then the merges in order
        ranks = {}
        for n in names:
            core = n.removesuffix("</w>")
            ranks[bytes(letters[c] for c in core) + (b"\x01" if core != n else b"")] = len(ranks)
        self.encoder = tiktoken.Encoding("words", pat_str="[^ ]+", mergeable_ranks=ranks, special_tokens={})
        self.ids = np.array([vocab[n] for n in names], np.uint32)
        self.closes = np.array([n.endswith("</w>") for n in names])

    @functools.cached_property
    def library(self):  # few texts need it
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def __call__(self, texts: list) -> Iterator[np.ndarray]:
        """Of each text its unsigned 32-bit ids, the end id last."""
        texts = [t or "" for t in texts]
        odd = {i for i, t in enumerate(texts) if "<|" in t or _BEYOND.search(t)}
        parts = [t.replace("\x85", " ").replace("\xa0", " ").lower().encode() for t in texts]
        for i in odd:
            parts[i] = b""
        raw = b"\n".join(parts) + b"\n"
        buf = np.frombuffer(raw, np.uint8)
        s, e = word_spans(buf)
        first = np.searchsorted(s, np.cumsum([0, *(len(p) + 1 for p in parts)]))
        _, at, chunk = np.unique(span_hash(buf, s, e), return_index=True, return_inverse=True)
        chunks = [raw[a:b].decode() for a, b in zip(s[at].tolist(), e[at].tolist())]
        words = [[c] if c.isalpha() else _WORDS.findall(c) for c in chunks]
        got = np.array(self.encoder.encode_ordinary("".join(w + "\x01 " for ws in words for w in ws)), np.int64)
        stops = np.flatnonzero(self.closes[got]) + 1
        n_words = np.fromiter(map(len, words), np.int64, len(words))
        if len(stops) != n_words.sum():
            raise ValueError("the tokenizer's words don't end in one closing token each")
        stop = stops[np.cumsum(n_words) - 1] if len(words) else stops
        start = np.concatenate(([0], stop[:-1])).astype(np.int64)
        n = (stop - start)[chunk]
        total = np.concatenate(([0], np.cumsum(n)))
        ids = self.ids[got[np.repeat(start[chunk] - total[:-1], n) + np.arange(total[-1])]]
        for i in range(len(texts)):
            own = np.array(self.library.encode(texts[i], add_special_tokens=False).ids, np.uint32) if i in odd else ids[total[first[i]] : total[first[i + 1]]]
            yield np.append(own, np.uint32(self.end))


_LOADED: dict[tuple[str, int], WordIds] = {}  # of a worker, over its tasks
#: Up to so many tasks' starts are broadcast (16 KB each at most); beyond, pieces are joined to them by a shuffle.
SENT_TASKS = 2048


def cut_pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids (little-endian, 2 bytes each where all of the piece fit, else 4), chunk (the task), own (rank among its pieces of that length)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a core a task
        if (tokenizer_path, end_id) not in _LOADED:
            _LOADED[tokenizer_path, end_id] = WordIds(tokenizer_path, end_id)
        ids_of = _LOADED[tokenizer_path, end_id]
        task, seen = TaskContext.get().partitionId(), [0] * (capacity + 1)
        for b in sub_batches(batches, "text"):
            row, piece, start, length, held, own = [], [], [], [], [], []
            for i, ids in enumerate(ids_of(b.column(1).to_pylist())):
                for p, at in enumerate(range(0, len(ids), capacity)):
                    part = ids[at : at + capacity]
                    row.append(i)
                    piece.append(p)
                    start.append(at)
                    length.append(len(part))
                    own.append(seen[len(part)])
                    seen[len(part)] += 1
                    held.append(part.astype("<u2" if part.max() < 1 << 16 else "<u4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(held, pa.binary()), pa.array(np.full(len(row), task, np.int32)), pa.array(own, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids", "chunk", "own"],
            )

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return small_batches(rows).mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, piece int, start bigint, length bigint, ids binary, chunk int, own bigint")


# --- the plan ---


def best_configuration(sizes: list[int], value: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of sizes that fits: a knapsack over all capacities."""
    best = np.zeros(capacity + 1)
    took = np.full(capacity + 1, -1)
    for i, s in enumerate(sizes):
        if value[i] <= 1e-12:
            continue
        for _ in range(capacity // s):
            with_it = best[:-s] + value[i]
            better = with_it > best[s:] + 1e-12
            if not better.any():
                break
            best[s:][better] = with_it[better]
            took[s:][better] = i
    counts, room = np.zeros(len(sizes)), capacity
    while room > 0 and took[room] >= 0:
        counts[took[room]] += 1
        room -= sizes[took[room]]
    return float(counts @ value), counts


def configurations(sizes: list[int], demand: list[int], capacity: int, rounds: int = 1500) -> list[tuple[np.ndarray, float]]:
    """Sequences by configuration that cover the demand with nearly the fewest sequences (fractional)."""
    k = len(sizes)
    basis = np.diag([float(capacity // s) for s in sizes])
    inverse, x = np.diag(1 / np.diag(basis)), np.array(demand, float) / np.diag(basis)
    for _ in range(rounds):
        price = inverse.sum(0)
        worth, entering = best_configuration(sizes, price, capacity)
        if worth <= 1 + 1e-7:
            break
        step = inverse @ entering
        ratio = np.where(step > 1e-10, x / np.where(step > 1e-10, step, 1), np.inf)
        out = int(np.argmin(ratio))
        x = x - ratio[out] * step
        x[out] = ratio[out]
        x = np.maximum(x, 0)
        basis[:, out] = entering
        row = inverse[out] / step[out]
        inverse = inverse - np.outer(step, row)
        inverse[out] = row
    return [(basis[:, i], float(x[i])) for i in range(k) if x[i] > 1e-9]


@dataclass
class Plan:
    """places: (length, first rank, pieces, first sequence, pieces a sequence, offset)."""

    capacity: int
    left: dict[int, int]  # pieces of each length that have no place yet
    places: list[tuple[int, int, int, int, int, int]] = field(default_factory=list)
    sequences: int = 0
    rank: dict[int, int] = field(default_factory=dict)
    rooms: list[int] = field(default_factory=list)  # ascending, of open
    open: dict[int, list[tuple[int, int]]] = field(default_factory=dict)  # by room left: runs (first sequence, sequences)

    def put(self, length: int, pieces: int, first: int, each: int, offset: int) -> None:
        at = self.rank.get(length, 0)
        self.places.append((length, at, pieces, first, each, offset))
        self.rank[length] = at + pieces
        self.left[length] -= pieces

    def keep(self, room: int, first: int, n: int) -> None:
        if n and room:
            if room not in self.open:
                self.open[room] = []
                insort(self.rooms, room)
            self.open[room].append((first, n))

    def fill(self, length: int) -> None:
        """All pieces of this length, each where the least room stays."""
        while n := self.left.get(length, 0):
            i = bisect_left(self.rooms, length)
            if i == len(self.rooms):
                each = self.capacity // length
                room, (first, count) = self.capacity, (self.sequences, -(-n // each))
                self.sequences += count
            else:
                room = self.rooms[i]
                first, count = self.open[room].pop()
                if not self.open[room]:
                    del self.open[room], self.rooms[i]
            each = room // length
            offset = self.capacity - room
            whole = min(count, n // each)
            if whole:
                self.put(length, whole * each, first, each, offset)
                self.keep(room - each * length, first, whole)
                first, count, n = first + whole, count - whole, n - whole * each
            if count and 0 < n < each:
                self.put(length, n, first, n, offset)
                self.keep(room - n * length, first, 1)
                first, count = first + 1, count - 1
            self.keep(room, first, count)

    def substitute(self, config: dict[int, int], groups: list[list[int]], n: int) -> None:
        """n sequences of a configuration {group: pieces}, with actual pieces of each group, the longest first."""
        runs = [(self.sequences, n, 0)]
        self.sequences += n
        for g in sorted(config):
            for _ in range(config[g]):
                then = []
                for first, count, used in runs:
                    while count:
                        length = next(x for x in groups[g] if self.quota[g][x])
                        m = min(count, self.quota[g][length])
                        self.quota[g][length] -= m
                        self.put(length, m, first, 1, used)
                        then.append((first, m, used + length))
                        first, count = first + m, count - m
                runs = then
        for first, count, used in runs:
            self.keep(self.capacity - used, first, count)


def make_plan(histogram: dict[int, int], capacity: int, n_groups: int = 48, small: float = 0.08) -> Plan:
    plan = Plan(capacity, dict(histogram))
    if full := histogram.get(capacity, 0):
        plan.put(capacity, full, 0, 1, 0)
        plan.sequences = full
    large = sorted((x for x in histogram if capacity * small < x < capacity and histogram[x]), reverse=True)
    total = sum(histogram[x] for x in large)
    if total:
        per = -(-total // n_groups)
        groups, plan.quota, room = [], [], 0
        for x in large:  # a length may stand in several groups
            n = histogram[x]
            while n:
                if not room:
                    groups.append([])
                    plan.quota.append({})
                    room = per
                m = min(n, room)
                groups[-1].append(x)
                plan.quota[-1][x] = m
                n, room = n - m, room - m
        sizes, demand = [max(g) for g in groups], [sum(q.values()) for q in plan.quota]
        for counts, x in configurations(sizes, demand, capacity):
            config = {g: int(c) for g, c in enumerate(counts) if c}
            n = min([int(x + 1e-6), *(sum(plan.quota[g].values()) // c for g, c in config.items())])
            if n > 0:
                plan.substitute(config, groups, n)
    for length in sorted(histogram, reverse=True):
        plan.fill(length)
    return plan


def sequences(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """One row per packed sequence: sequence_id, length, ids, pieces (offset, doc_id, piece, start, length) in their order."""
    ensure_checkpoint_dir(docs.sparkSession)
    path = f"{docs.sparkSession.sparkContext._jsc.sc().getCheckpointDir().get()}/pieces-{uuid.uuid4().hex}"
    pieces = cut_pieces(docs, tokenizer_path, id_col, text_col, capacity, end_id)
    pieces.write.option("compression", "zstd").parquet(path)  # ids take less room there than in a checkpoint
    pieces = docs.sparkSession.read.schema(pieces.schema).parquet(path)
    histogram = {int(r[0]): int(r[1]) for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    plan = min((make_plan(histogram, capacity, g) for g in (24, 48, 96)), key=lambda p: p.sequences)
    schema = "p_length bigint, p_rank bigint, p_n bigint, p_first bigint, p_each bigint, p_offset bigint"
    places = docs.sparkSession.createDataFrame(plan.places, schema)
    counts = cut(pieces.groupBy("chunk", "length").count())
    before = Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("chunk", "length", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    # a task's starts as two arrays, of `capacity` numbers at most
    table = base.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("length", "base"))).alias("b")).select("chunk", F.col("b.length").alias("lengths"), F.col("b.base").alias("bases"))
    if counts.agg(F.count_distinct("chunk")).first()[0] <= SENT_TASKS:
        table = F.broadcast(table)
    ranked = pieces.join(table, "chunk").withColumn("rank", F.get("bases", (F.array_position("lengths", F.col("length")) - 1).cast("int")) + F.col("own"))
    on = (F.col("length") == F.col("p_length")) & (F.col("rank") >= F.col("p_rank")) & (F.col("rank") < F.col("p_rank") + F.col("p_n"))
    j = F.col("rank") - F.col("p_rank")
    placed = ranked.join(F.broadcast(places), on).select(
        (F.col("p_first") + F.floor(j / F.col("p_each"))).cast("long").alias("sequence_id"),
        F.struct((F.col("p_offset") + (j % F.col("p_each")) * F.col("length")).cast("long").alias("offset"), "doc_id", "piece", "start", "length", "ids").alias("held"),
    )
    held = placed.repartition("sequence_id").groupBy("sequence_id").agg(F.sort_array(F.collect_list("held")).alias("held"))
    names = ["offset", "doc_id", "piece", "start", "length"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = dict(zip([f.name for f in b.column(1).type.value_type], b.column(1).flatten().flatten()))
            counts = np.diff(np.asarray(b.column(1).offsets))
            n = np.asarray(own["length"])
            ids = [np.frombuffer(x, "<u2" if len(x) == 2 * m else "<u4").astype(np.int32) for x, m in zip(own["ids"].to_pylist(), n.tolist())]
            first = np.concatenate(([0], np.cumsum(counts)))
            ends = np.concatenate(([0], np.cumsum(n)))[first]
            pieces = pa.StructArray.from_arrays([own[c] for c in names], names=names)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(np.diff(ends), pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.empty(0, np.int32), *ids]))), pa.ListArray.from_arrays(pa.array(first, pa.int32()), pieces)],
                names=["sequence_id", "length", "ids", "pieces"],
            )

    id_type = docs.schema[id_col].dataType.simpleString()
    return small_batches(held).mapInArrow(run, f"sequence_id bigint, length bigint, ids array<int>, pieces array<struct<offset:bigint,doc_id:{id_type},piece:int,start:bigint,length:bigint>>")


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """One row per piece, told from the packed sequences: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    packed = sequences(docs, tokenizer_path, id_col, text_col, capacity, end_id)
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seq, ids, pieces = b.columns
            own = dict(zip([f.name for f in pieces.type.value_type], pieces.flatten().flatten()))
            starts, flat = np.asarray(ids.offsets), np.asarray(ids.values).astype("<u4")
            row = np.repeat(np.arange(b.num_rows), np.diff(np.asarray(pieces.offsets)))
            at = starts[row] + np.asarray(own["offset"])
            crc = [zlib.crc32(flat[x:y]) for x, y in zip(at.tolist(), (at + np.asarray(own["length"])).tolist())]
            own |= {"ids_crc32": pa.array(crc, pa.int64()), "sequence_id": seq.take(pa.array(row))}
            yield pa.RecordBatch.from_arrays([own[c] for c in names], names=names)

    id_type = docs.schema[id_col].dataType.simpleString()
    return small_batches(packed.select("sequence_id", "ids", "pieces")).mapInArrow(run, f"doc_id {id_type}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")
