"""Benchmark decontamination with a generalised suffix automaton over the items' words.

Words: A-Z lowered, runs of letters and digits of ASCII and of everything beyond it. A window is 13 consecutive
words of an item; a shorter item is one window. Documents stream through the automaton, which gives for every word
the longest match that ends there; where it reaches a window's length, the window's words are hit.

The items are meant to be few: beyond about max_item_words words they are dealt into blocks by a hash, the driver holds
one block at a time, and the documents pass once per block, so that what is sent to the executors stays bounded. A
worker keeps the automaton of its last block over its tasks.

Null or wordless text: no words, not contaminated. Null or wordless items match nothing. Repeated items count once
an id. Items with a null id hit words, count as one item together and are left out of the digest of ids. Words are
looked up by 64-bit hashes. Other columns of the documents pass as they are, whatever their names. Empty tables: no
hits, or no rows.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import WORD_TABLE, col, free, join_texts, map_whole, small_batches, span_hash, sub_batches, word_spans


_NONE: frozenset = frozenset()


class SuffixAutomaton:
    """Of several word sequences; each state knows the items that hold its words."""

    def __init__(self, window: int) -> None:
        self.window, self.next, self.link, self.length, self.items, self.whole = window, [{}], [-1], [0], [_NONE], {}

    def _state(self, length: int, copy: int | None = None) -> int:
        self.length.append(length)
        self.next.append(dict(self.next[copy]) if copy is not None else {})
        self.link.append(self.link[copy] if copy is not None else 0)
        self.items.append(set(self.items[copy]) if copy is not None and self.items[copy] else _NONE)
        return len(self.link) - 1

    def _split(self, p: int, q: int, word: int) -> int:
        """The state for p's longest string and word, cut out of q if q holds longer ones."""
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._state(self.length[p] + 1, q)
        self.link[q] = clone
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, word: int) -> int:
        if word in self.next[last]:
            return self._split(last, self.next[last][word], word)
        new, p = self._state(self.length[last] + 1), last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        self.link[new] = 0 if p < 0 else self._split(p, self.next[p][word], word)
        return new

    def add(self, words: list[int]) -> None:
        last = 0
        for w in words:
            last = self._extend(last, w)

    def own(self, item: str, words: list[int]) -> None:
        """After all add(): note the item along its words' states; a short item as a whole only."""
        at = 0
        for w in words:
            at = self.next[at][w]
            s = at
            while len(words) >= self.window and s > 0 and item not in self.items[s]:
                self.items[s] = {item} if not self.items[s] else self.items[s] | {item}
                s = self.link[s]
        if 0 < len(words) < self.window:
            self.whole.setdefault(at, (len(words), set()))[1].add(item)

    def finish(self) -> None:
        """For each state the nearest one up its links (itself included) that is a whole short item."""
        self.short = [-1] * len(self.link)
        for s in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            self.short[s] = s if s in self.whole else self.short[self.link[s]]

    def stream(self, words: list[int]) -> Iterator[tuple[int, int, set[str]]]:
        """(end, length, items) of each window that occurs in words; end is exclusive."""
        at = n = 0
        nxt, link, length, k = self.next, self.link, self.length, self.window
        for i, w in enumerate(words):
            while at and w not in nxt[at]:
                at = link[at]
                n = length[at]
            if w in nxt[at]:
                at = nxt[at][w]
                n += 1
            if n >= k:
                s = at
                while length[link[s]] >= k:
                    s = link[s]
                yield i + 1, k, self.items[s]
            s = self.short[at]
            while s > 0:
                size, items = self.whole[s]
                if size <= n:
                    yield i + 1, size, items
                s = self.short[link[s]]


class Matcher:
    def __init__(self, items: list[tuple[str, str | None]], window: int) -> None:
        words, ids = [], {}
        for item, text in items:
            own = [] if text is None else text.encode("utf-8", "replace").translate(WORD_TABLE).split()
            words.append((item, [ids.setdefault(w, len(ids)) for w in own]))
        self.auto = SuffixAutomaton(window)
        for _, w in words:
            self.auto.add(w)
        for item, w in words:
            self.auto.own(item, w)
        self.auto.finish()
        self.least = min([min(len(w), window) for _, w in words if w], default=0)
        buf = np.frombuffer(b" ".join(ids) + b" ", np.uint8)
        hashes = span_hash(buf, *word_spans(buf)) if ids else np.empty(0, np.uint64)
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]

    def batch(self, texts: list) -> Iterator[tuple[int, np.ndarray, list[set[str]], np.ndarray, int]]:
        """For each text: number of words, hit flags (None without hits), item ids, byte starts and ends of its words."""
        raw, ends = join_texts(texts, WORD_TABLE)
        buf = np.frombuffer(raw, np.uint8)
        s, e = word_spans(buf)
        first = np.searchsorted(s, np.concatenate(([0], ends)))  # each text's first word
        known = np.full(len(s), -1, np.int64)
        if len(self.hashes) and len(s):
            h = span_hash(buf, s, e)
            at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            known = np.where(self.hashes[at] == h, self.order[at], -1)
        # runs of known words within a text that are long enough to hold a window
        mark = np.zeros(len(s) + 2, np.int8)
        mark[1:-1] = known >= 0
        edge = np.diff(mark)
        a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        hits: dict[int, tuple[np.ndarray, set[str]]] = {}
        for x, y in zip(a[b - a >= self.least].tolist(), b[b - a >= self.least].tolist()) if self.least else ():
            d = int(np.searchsorted(first, x, "right")) - 1
            while x < y:  # a run may go on over the end of a text
                stop = min(y, int(first[d + 1]))
                for end, size, items in self.auto.stream(known[x:stop].tolist()):
                    if d not in hits:
                        hits[d] = (np.zeros(int(first[d + 1] - first[d]), bool), set())
                    hits[d][0][x + end - size - first[d] : x + end - first[d]] = True
                    hits[d][1].update(items)
                x, d = stop, d + 1
        begin = np.concatenate(([0], ends[:-1] + 1))
        for d in range(len(texts)):
            lo, hi = int(first[d]), int(first[d + 1])
            yield hi - lo, *hits.get(d, (None, set())), s[lo:hi] - begin[d], e[lo:hi] - begin[d]


def _blocks(items: DataFrame, item_id: str, item_text: str, max_item_words: int) -> Iterator[list[tuple[str | None, str | None]]]:
    """The items in blocks of about max_item_words words, one at a time."""
    rows = items.select(col(item_id).cast("string").alias("id"), col(item_text).cast("string").alias("text")).distinct()
    words = rows.agg(F.sum(F.coalesce(F.length("text"), F.lit(0)) / 2 + 1)).first()[0] or 0  # at most
    n = max(1, -(-int(words) // max_item_words))
    for i in range(n):
        own = rows if n == 1 else rows.filter(F.pmod(F.xxhash64(F.lit(7), "id", "text"), F.lit(n)) == i)
        yield [(r[0], r[1]) for r in own.collect()]


_KEPT: dict[str, Matcher] = {}  # of a worker, the last block's


def _matcher(name: str, block: list, window: int) -> Matcher:
    if name not in _KEPT:
        _KEPT.clear()
        _KEPT[name] = Matcher(block, window)
    return _KEPT[name]


def _mapped(rows: DataFrame, text_at: int, block: list, window: int, schema, emit) -> DataFrame:
    """emit(matcher, batch) over rows whose column text_at is the text."""
    sent, name = rows.sparkSession.sparkContext.broadcast(block), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _matcher(name, sent.value, window)
        for b in sub_batches(batches, text_at):
            yield emit(matcher, b)

    return small_batches(rows).mapInArrow(run, schema) if isinstance(schema, str) else map_whole(small_batches(rows), run, schema)


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 13, max_item_words: int = 500_000) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated (hit words are 5 % or more)."""
    rows = docs.select(col(id_col).alias("doc_id"), col(text_col).cast("string").alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def digest(ids: set) -> str:
        return hashlib.sha256(",".join(sorted(x for x in ids if x is not None)).encode()).hexdigest()

    def emit(matcher: Matcher, b: pa.RecordBatch) -> pa.RecordBatch:
        n, h, k, sha = [], [], [], []
        for words, flags, ids, _, _ in matcher.batch(b.column(1).to_pylist()):
            n.append(words)
            h.append(0 if flags is None else int(flags.sum()))
            k.append(len(ids))
            sha.append(digest(ids))
        bad = [x > 0 and 20 * x >= y for x, y in zip(h, n)]
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(h, pa.int64()), pa.array(k, pa.int64()), pa.array(sha), pa.array(bad)], names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    blocks = _blocks(items, item_id, item_text, max_item_words)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        return _mapped(rows, 1, first, window, f"doc_id {id_type}, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean", emit)

    def emit_part(matcher: Matcher, b: pa.RecordBatch) -> pa.RecordBatch:
        found = [(n, [] if f is None else np.flatnonzero(f).tolist(), list(ids)) for n, f, ids, _, _ in matcher.batch(b.column(1).to_pylist())]
        n, at, ids = zip(*found)
        return pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n, pa.int64()), pa.array(at, pa.list_(pa.int32())), pa.array(ids, pa.list_(pa.string()))], names=["doc_id", "key", "n_words", "at", "ids"])

    rows = rows.withColumn("key", F.xxhash64("text"))
    parts = [_mapped(rows, 1, x, window, f"doc_id {id_type}, key bigint, n_words bigint, at array<int>, ids array<string>", emit_part).groupBy("doc_id", "key").agg(F.count("*").alias("copies"), F.first("n_words").alias("n_words"), F.first("at").alias("at"), F.first("ids").alias("ids")) for x in itertools.chain((first, second), blocks)]
    out = parts[0]
    for p in parts[1:]:
        p = p.select(F.col("doc_id").alias("d"), F.col("key").alias("k"), F.col("at").alias("at2"), F.col("ids").alias("ids2"))
        out = out.join(p, out["doc_id"].eqNullSafe(p["d"]) & out["key"].eqNullSafe(p["k"])).select("doc_id", "key", "copies", "n_words", F.array_union("at", "at2").alias("at"), F.array_union("ids", "ids2").alias("ids"))
    out = out.withColumn("copies", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    n_hit = F.size("at").cast("long")
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("ids").cast("long").alias("n_items"), F.sha2(F.array_join(F.sort_array("ids"), ","), 256).alias("items_sha256"), ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"))


def _cut_out(text: str, spans: np.ndarray) -> str:
    """text without the bytes of the ascending spans (start, end)."""
    raw, out, last = text.encode("utf-8", "replace"), [], 0
    for x, y in spans:
        out.append(raw[last:x])
        last = int(y)
    return b"".join([*out, raw[last:]]).decode("utf-8", "replace")


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First words of the runs of hit words, and the words after their last."""
    edge = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def remove_hits(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 13, max_coverage: float = 0.5, max_item_words: int = 500_000) -> DataFrame:
    """docs with the hit spans cut from their texts; documents of which over max_coverage of the words is hit go.

    With several blocks of items each passes over the texts as they are; the hits of all are joined by text, then
    cut and judged once, so the result doesn't depend on the blocks.
    """
    names, blocks = docs.columns, _blocks(items, item_id, item_text, max_item_words)
    first, second = next(blocks), next(blocks, None)
    pos, text = names.index(text_col), col(text_col).cast("string")
    as_text, key_name, own_key, runs_name = free(names, "as_text", "key", "own_key", "runs")

    def emit(matcher: Matcher, b: pa.RecordBatch) -> pa.RecordBatch:
        texts, keep = b.column(len(names)).to_pylist(), []
        for i, (n, flags, _, s, e) in enumerate(matcher.batch(texts)):
            keep.append(flags is None or flags.sum() <= max_coverage * n)
            if flags is not None and keep[-1]:
                x, y = _runs(flags)
                texts[i] = _cut_out(texts[i], np.stack([s[x], e[y - 1]], axis=1))
        cols = [pa.array(texts, pa.string()) if j == pos else b.column(j) for j in range(len(names))]
        return pa.RecordBatch.from_arrays(cols, names=names).filter(pa.array(keep, pa.bool_()))

    if second is None:  # the text goes along once more as a string, last
        return _mapped(docs.select(*map(col, names), text.alias(as_text)), len(names), first, window, docs.schema, emit)

    def emit_runs(matcher: Matcher, b: pa.RecordBatch) -> pa.RecordBatch:
        """Of each text with hits its runs of hit words as first and last word."""
        key, first, last = [], [], []
        for k, (_, flags, _, _, _) in zip(b.column(1).to_pylist(), matcher.batch(b.column(0).to_pylist())):
            if flags is not None:
                x, y = _runs(flags)
                key.append(k)
                first.append(x.tolist())
                last.append((y - 1).tolist())
        return pa.RecordBatch.from_arrays([pa.array(key, pa.binary()), pa.array(first, pa.list_(pa.int32())), pa.array(last, pa.list_(pa.int32()))], names=["key", "first", "last"])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sub_batches(batches, len(names)):
            texts, keep = b.column(len(names)).to_pylist(), [True] * b.num_rows
            found = b.column(len(names) + 1).to_pylist()
            for i in (i for i, f in enumerate(found) if f):
                raw, _ = join_texts([texts[i]], WORD_TABLE)
                s, e = word_spans(np.frombuffer(raw, np.uint8))
                flags = np.zeros(len(s), bool)
                for run in found[i]:
                    for x, y in zip(run["first"], run["last"]):
                        flags[x : y + 1] = True
                keep[i] = bool(flags.sum() <= max_coverage * len(s))
                if keep[i]:
                    x, y = _runs(flags)
                    texts[i] = _cut_out(texts[i], np.stack([s[x], e[y - 1]], axis=1))
            cols = [pa.array(texts, pa.string()) if j == pos else b.column(j) for j in range(len(names))]
            yield pa.RecordBatch.from_arrays(cols, names=names).filter(pa.array(keep, pa.bool_()))

    key = F.unhex(F.sha2(text.cast("binary"), 256))
    rows = docs.select(text.alias("text"), key.alias("key"))
    found = [_mapped(rows, 0, x, window, "key binary, first array<int>, last array<int>", emit_runs).dropDuplicates(["key"]) for x in itertools.chain((first, second), blocks)]
    hits = functools.reduce(DataFrame.unionByName, found).groupBy(F.col("key").alias(key_name)).agg(F.collect_list(F.struct("first", "last")).alias(runs_name))
    wide = docs.withColumns({as_text: text, own_key: key})
    wide = wide.join(hits, wide[own_key] == hits[key_name], "left").select(*map(col, names), as_text, runs_name)
    return map_whole(small_batches(wide), apply, docs.schema)
