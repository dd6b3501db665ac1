"""Language-model scores from a hierarchical Pitman-Yor model of word triples.

The restaurant of two preceding words sends its tables as customers to that of the nearer word, whose tables go to the
parent all share, over a uniform base of the training vocabulary and one unknown word. Table counts are drawn by Gibbs
sweeps in several chains; a text's probability uses the predictive probabilities averaged over chains and sweeps.

In each sweep every dish's tables are drawn anew from their exact conditional given its customers, the restaurant's other
tables and the parent's probability, however many customers it has (with over PEAKED tables: as a normal draw at its peak). Within a sweep the parents' probabilities
stand still while their children's tables are drawn, as in approximate distributed Gibbs sampling: children of one parent
aren't drawn one after another. Discounts are estimated from the kinds seen once and twice, strengths of the two lower
levels are drawn between the passes (from the contexts that one part holds whole).

There are two passes over the counts. In the first, parts burn their chains in on their own share of the parents'
customers; in the second, chains go on from there with what the parents have told: half of those sweeps settle them, and
each of the others predicts.

Work is dealt by the nearer word: a part holds all triples around its words with their counts, so both lower levels are
local. A word with more than its share of all tokens is split over several parts by the farther word; its restaurant then
stands, dish by dish, where the parent's dish does. Parents are dealt by word: parts send each word's (and each split
word's dishes') customers there and get probabilities back; only totals go through the driver.

Texts stay in their blocks: a block sends each part its distinct triples with counts once, and gets their
probabilities back (rare words' training counts with them; those of the FREQUENT words are known to all), so what travels is linear in the input: a message holds the triples of one nearer word at
least, so there are never more messages than distinct words in the blocks. Words travel as short numbers where
they are among the FREQUENT most common ones, else as their 64-bit hashes; words, contexts and triples are told by 64-bit hashes.

Words are runs without ASCII white space with A-Z lowered, then one end of text. Training texts are those whose
crc32 of the id modulo 5 isn't 1. Null text: empty, its end alone. Null ids are kept. Repeated rows count each.
Empty input: no rows. No training tokens: base and model are uniform.
"""

from __future__ import annotations

import functools
import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import LOWER_TABLE, col, crc_bucket, cut, join_texts, mix64, small_batches, span_hash, sub_batches, word_spans

END, BEGIN = np.uint64(1), np.uint64(2)
#: Customers of a dish up to which the ways to seat them are tabled; beyond, they are carried on from there.
EXACT = 1024
#: Tables of a dish beyond EXACT up to which its conditional is enumerated.
PEAKED = 256
#: Customers of a dish up to which its conditional is multiplied out, and the rate of new tables up to which that stays in range.
SMALL, CALM = 64, 1000.0
#: Customers of a dish that seating one by one moves in a sweep (see Seats; the model doesn't).
RESEATED = 16
#: Words at most that travel as numbers (two to three bytes); broadcast.
FREQUENT = 400_000


def _own(part: int) -> int:
    return part


def _pack(*x) -> bytes:
    raw = pickle.dumps(x, protocol=5)
    return b"z" + zstandard.ZstdCompressor(level=1).compress(raw) if len(raw) > 512 else b"p" + raw


def _unpack(b: bytes):
    return pickle.loads(zstandard.ZstdDecompressor().decompress(b[1:]) if b[:1] == b"z" else b[1:])


def _small(a: np.ndarray) -> bytes:
    """Whole numbers in as few bytes as hold them, the width first; of more than two bytes all lowest ones, then the next."""
    kind = np.min_scalar_type(int(a.max()) if len(a) else 0)
    own = a.astype(kind)
    return bytes([kind.itemsize]) + (own.view(np.uint8).reshape(-1, kind.itemsize).T.tobytes() if kind.itemsize > 2 else own.tobytes())


def _large(b: bytes) -> np.ndarray:
    if b[0] <= 2:
        return np.frombuffer(b, f"<u{b[0]}", offset=1)
    return np.ascontiguousarray(np.frombuffer(b, np.uint8, offset=1).reshape(b[0], -1).T).view(f"<u{b[0]}").ravel()


#: Parts of a unit of the logarithms that travel back: an error of a millionth a token at most.
FINE = 1 << 19


def _named(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One 64-bit name for each pair of names, in order."""
    return mix64(mix64(a) + b * np.uint64(0x9E3779B97F4A7C15))


def tokens(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes with each text's end, and where each text begins (with the total last)."""
    raw, ends = join_texts(texts, LOWER_TABLE)
    buf = np.frombuffer(raw, np.uint8)
    s, e = word_spans(buf)
    h = span_hash(buf, s, e)
    h[h <= BEGIN] += np.uint64(3)
    first = np.searchsorted(s, np.concatenate(([0], ends)))
    return np.insert(h, first[1:], END), first + np.arange(len(first))


@dataclass
class Layout:
    parts: int
    frequent: np.ndarray  # hashes of common words, sorted
    counts: np.ndarray  # their training tokens
    hot: np.ndarray  # hashes of nearer words with more than their share, sorted
    salts: np.ndarray  # over how many parts each is spread
    tokens: int  # in training texts
    words: int

    def is_hot(self, u: np.ndarray) -> np.ndarray:
        return self.hot[np.minimum(np.searchsorted(self.hot, u), len(self.hot) - 1)] == u if len(self.hot) else np.zeros(len(u), bool)

    def part_of(self, u: np.ndarray, a: np.ndarray) -> np.ndarray:
        salt, hot = np.zeros(len(u), np.uint64), self.is_hot(u)
        if hot.any():
            salt[hot] = mix64(a[hot]) % self.salts[np.searchsorted(self.hot, u[hot])].astype(np.uint64) + np.uint64(1)
        return (mix64(u + salt * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(self.parts)).astype(np.int64)

    def base(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + 0.5) / (self.tokens + 0.5 * (self.words + 1)))


def word_counts(rows: DataFrame) -> DataFrame:
    """word (hash), n: tokens of all texts, train: of training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sub_batches(batches, "text", 4 << 20):
            w, first = tokens(b.column(b.schema.get_field_index("text")).to_pylist())
            word, at, n = np.unique(w, return_inverse=True, return_counts=True)
            learned = np.repeat(b.column(b.schema.get_field_index("train")).to_numpy(zero_copy_only=False), np.diff(first))
            yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n), pa.array(np.bincount(at, learned, len(word)).astype(np.int64))], names=["word", "n", "train"])

    return rows.select("text", "train").mapInArrow(run, "word bigint, n bigint, train bigint").groupBy("word").agg(F.sum("n").alias("n"), F.sum("train").alias("train"))


# --- from blocks of texts to parts ---


def split_block(texts: list, train: np.ndarray, layout: Layout) -> tuple[tuple, Iterator[tuple[int, bytes]]]:
    """What stays with the block, and (part, message) of its distinct triples, which are numbered in the order of parts and messages.

    What stays: where texts begin, sums of the base and of known tokens over each text's frequent words, the number of
    each token's triple, and which triples are of rare words.
    """
    w, first = tokens(texts)
    vocab, word = np.unique(w, return_inverse=True)
    names, size = np.append(vocab, BEGIN), len(vocab) + 1
    near, far = np.empty_like(word), np.empty_like(word)
    near[1:], far[2:] = word[:-1], word[:-2]
    near[first[:-1]] = far[first[:-1]] = size - 1
    second = first[:-1][np.diff(first) > 1] + 1
    far[second] = size - 1
    pairs, context = np.unique(near * size + far, return_inverse=True)
    part = layout.part_of(names[pairs // size], names[pairs % size])
    order = np.argsort(part, kind="stable")
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    pairs, part = pairs[order], part[order]
    triples, number = np.unique(rank[context] * size + word, return_inverse=True)
    counts = np.bincount(number, train[np.repeat(np.arange(len(texts)), np.diff(first))], len(triples)).astype(np.int64)
    of, dish = np.divmod(triples, size)
    k = len(layout.frequent)
    code = np.minimum(np.searchsorted(layout.frequent, names), max(k - 1, 0))
    rare = (layout.frequent[code] != names) if k else np.ones(size, bool)
    common = np.where(rare[:-1], 0, layout.counts[code[:-1]] if k else 0)
    base, known = np.where(rare[:-1], 0.0, layout.base(common)), (common > 0).astype(np.int64)
    stays = first, np.add.reduceat(base[word], first[:-1]), np.add.reduceat(known[word], first[:-1]), _small(number), _small(np.flatnonzero(rare[dish]))

    def messages() -> Iterator[tuple[int, bytes]]:
        cuts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1], [True])))
        at = np.searchsorted(of, cuts)
        local = code.copy()
        for i in range(len(cuts) - 1):
            lo, hi, x, y = cuts[i], cuts[i + 1], at[i], at[i + 1]
            u, a = np.divmod(pairs[lo:hi], size)
            used = np.concatenate((u, a, dish[x:y]))
            own = np.unique(used[rare[used]])
            local[own] = k + np.arange(len(own))
            per = np.bincount(of[x:y] - lo, minlength=hi - lo)
            yield int(part[lo]), _pack(names[own].tobytes(), _small(local[u]), _small(local[a]), _small(per), _small(local[dish[x:y]]), _small(counts[x:y]))

    return stays, messages()


def _deal(rows: DataFrame, sent, block_bytes: int) -> DataFrame:
    """part, block, kind, blob: each block's triples by part, and what is left of the block itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        for b in sub_batches(batches, "text", block_bytes):
            train = b.column(2).to_numpy(zero_copy_only=False)
            stays, found = split_block(b.column(1).to_pylist(), train, sent.value)
            out, blobs, kind = [_home_of(block, sent.value.parts)], [_pack(b.column(0).to_pylist(), train, *stays)], [BLOCK]
            for p, blob in found:
                out.append(p)
                blobs.append(blob)
                kind.append(TRIPLES)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int32()), pa.array([block] * len(out), pa.int64()), pa.array(kind, pa.int32()), pa.array(blobs, pa.binary())], names=["part", "block", "kind", "blob"])
            block += 1

    return rows.mapInArrow(run, "part int, block bigint, kind int, blob binary")


class Part:
    """Distinct triples of a part's nearer words, with the pairs and words above them, and the messages they came in."""

    def __init__(self, items: list[tuple[int, bytes]], layout: Layout) -> None:
        k = len(layout.frequent)
        got = [(block, *_unpack(blob)) for block, blob in items]
        # the part's own numbers of words: frequent ones that occur, then rare ones
        rare_names = [np.frombuffer(x[1], np.uint64) for x in got]
        rare, rare_at = np.unique(np.concatenate(rare_names or [np.empty(0, np.uint64)]), return_inverse=True)
        used, at, coded = np.zeros(k, bool), 0, []
        for x, own in zip(got, rare_names):
            code = [_large(y).astype(np.int64) for y in (x[2], x[3], x[5])]
            for c in code:
                used[c[c < k]] = True
            coded.append((code, rare_at[at : at + len(own)]))
            at += len(own)
        number = np.cumsum(used) - 1
        names = np.concatenate((layout.frequent[used], rare))
        n_used, w = int(used.sum()), len(names)
        keys, n, self.blocks, is_rare = [], [], [], []
        for x, (code, own) in zip(got, coded):
            local = np.concatenate((number, n_used + own)) if len(own) else number
            u, a, dish = (local[c] for c in code)
            context = (u * w * w + a).repeat(_large(x[4]))
            keys.append(context + dish * w)  # by nearer word, dish, farther word
            n.append(_large(x[6]).astype(np.int64))
            is_rare.append(code[2] >= k)
            self.blocks.append((x[0], len(dish)))
        none = np.empty(0, np.int64)
        self.rare = np.concatenate([none.astype(bool), *is_rare])
        key, self.triple_of = np.unique(np.concatenate([none, *keys]), return_inverse=True)
        self.c = np.bincount(self.triple_of, np.concatenate([none, *n]), len(key)).astype(np.int64)
        pair_key, a = np.divmod(key, max(w, 1))
        new = np.concatenate(([True], pair_key[1:] != pair_key[:-1])) if len(key) else np.empty(0, bool)
        self.pair = np.cumsum(new) - 1
        u, dish = np.divmod(pair_key[new], max(w, 1))
        contexts, self.context = np.unique(u[self.pair] * w + a, return_inverse=True)
        self.n_contexts = len(contexts)
        self.nears, self.near = np.unique(u, return_inverse=True)
        served = np.zeros(w, bool)
        served[dish] = True
        self.words, self.word = names[served], (np.cumsum(served) - 1)[dish]
        self.far_pairs = np.flatnonzero(layout.is_hot(names[u]))  # their restaurant stands with the parents
        self.far_keys = names[u][self.far_pairs], names[dish][self.far_pairs]
        self.local = np.ones(len(u), bool)
        self.local[self.far_pairs] = False
        self.count = np.bincount(self.word[self.pair], self.c, len(self.words)).astype(np.int64)
        # what can move in a sweep: triples of two customers and more, the pairs above them, pairs that may have as many
        self.busy = np.flatnonzero(self.c >= 2)
        self.above, self.above_at = np.unique(self.pair[self.busy], return_inverse=True)
        self.single = np.bincount(self.pair, self.c == 1, len(u))[self.above].astype(np.int64)
        self.many = np.flatnonzero(np.bincount(self.pair, self.c, len(u)) >= 2)
        far_at = np.minimum(np.searchsorted(self.far_pairs, self.above), max(len(self.far_pairs) - 1, 0))
        far = np.flatnonzero(self.far_pairs[far_at] == self.above) if len(self.far_pairs) else np.empty(0, np.int64)
        self.above_far = far, far_at[far]


# --- seating ---


def log_tables(limit: int, d: float) -> np.ndarray:
    """Logarithms of the generalised Stirling numbers: ways to seat c customers at t tables."""
    out = np.full((limit + 1, limit + 1), -np.inf)
    out[0, 0] = 0
    with np.errstate(divide="ignore"):
        for c in range(limit):
            t = np.arange(1, c + 2)
            out[c + 1, 1 : c + 2] = np.logaddexp(out[c, : c + 1], out[c, 1 : c + 2] + np.log(np.maximum(c - d * t, 0)))
    return out


class Ways:
    """Logarithms of the ways to seat any number of customers at t tables: a table up to EXACT, rows carried on from there beyond.

    Rows come from the ratios of neighbours, S(c, t) / S(c, t - 1), which stay in range for any c; up to t tables they need none of
    more tables. From STRIDES customers on, the recurrence is followed by Runge-Kutta steps of many customers at a time, as a step
    each would make a dish of millions one task's work; that puts ratios off by up to 5e-5 at a discount of 0.3, by 3e-7 at 0.84.
    Ratios on the way are kept at nodes, from the last of which any number of customers is one such step away, or a few of one
    customer; so the way is gone once, not once a sweep. The last rows are kept too, as counts of triples don't change.
    """

    #: Cells of the rows that are held at once; customers from which steps are of many; least customers between nodes where they aren't.
    HELD, STRIDES, NODES = 1 << 19, 1024, 16

    def __init__(self, d: float) -> None:
        self.d, self.table = d, log_tables(EXACT, d)
        self._kept: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self._nodes: dict[int, list[tuple[int, int, np.ndarray]]] = {}  # wide -> customers, the step of many from there or 0, ratios

    def rows(self, c: np.ndarray, wide: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(customers, a row each of the logarithms for 1 to `wide` tables, up to a constant) of ascending distinct c beyond EXACT."""
        step = max(1, self.HELD // wide)
        for lo in range(0, len(c), step):
            some = c[lo : lo + step]
            out = np.zeros((len(some), wide))
            known, kept = self._kept.get(wide, (some[:0], out[:0]))
            at = np.searchsorted(known, some)
            old = np.flatnonzero(known[np.minimum(at, len(known) - 1)] == some) if len(known) else at[:0]
            new = np.delete(np.arange(len(some)), old)
            out[old] = kept[at[old]]
            if len(new):
                with np.errstate(divide="ignore"):
                    out[new, 1:] = np.cumsum(np.log(self._ratios(some[new], wide)), axis=1)
            if len(c) <= step:
                self._kept[wide] = some, out
            yield some, out

    def _ratios(self, c: np.ndarray, wide: int) -> np.ndarray:
        """Ratios of 2 tables to 1, 3 to 2 and so on, a row for each of ascending c."""
        nodes = self._reach(int(c[-1]), wide)
        at = np.searchsorted([n for n, _, _ in nodes], c, "right") - 1
        out, n = np.array([nodes[i][2] for i in at]), np.array([nodes[i][0] for i in at])
        many = np.array([nodes[i][1] > 0 for i in at]) & (c > n)
        if many.any():
            out[many] = self._stride(out[many], n[many, None], (c - n)[many, None])
        few = np.flatnonzero(~many)
        few = few[np.argsort(n[few] - c[few], kind="stable")]  # those with most steps first
        left, ratio, done = (c - n)[few], out[few], 0
        for stop in np.unique(left).tolist():
            k = int(np.searchsorted(-left, -stop, "right"))
            self._ones(ratio[:k], n[few[:k], None] + done, stop - done)
            done = stop
        out[few] = ratio
        return out

    def _reach(self, c: int, wide: int) -> list[tuple[int, int, np.ndarray]]:
        """Nodes up to c customers at least, where the next one lies beyond."""
        if wide not in self._nodes:
            top, ratio = min(wide, EXACT), np.zeros(wide - 1)  # none beyond as many tables as customers
            ratio[: top - 1] = np.exp(np.diff(self.table[EXACT, 1 : top + 1]))
            self._nodes[wide] = [(EXACT, self._step(ratio, EXACT), ratio)]
        nodes = self._nodes[wide]
        while (n := nodes[-1][0]) + (apart := nodes[-1][1] or max(self.NODES, n >> 6)) <= c:
            ratio = nodes[-1][2][None]
            if nodes[-1][1]:
                ratio = self._stride(ratio, np.array([[n]]), apart)
            else:
                ratio = ratio.copy()
                self._ones(ratio, n, apart)
            nodes.append((n + apart, self._step(ratio[0], n + apart), ratio[0]))
        return nodes

    def _step(self, ratio: np.ndarray, n: int) -> int:
        stride = int(n * min(0.05, 0.5 / (1 + 1 / ratio[-1]))) if n >= self.STRIDES and len(ratio) and ratio[-1] > 0 else 0
        return stride if stride >= 8 else 0

    def _ones(self, ratio: np.ndarray, n: np.ndarray | int, steps: int) -> None:
        """Puts so many customers more than n, one after another, into the ratios, a row each."""
        room, fewer = n - self.d * np.arange(2, ratio.shape[1] + 2), np.zeros(ratio.shape)
        with np.errstate(divide="ignore"):
            for _ in range(steps):
                np.divide(1.0, ratio[:, :-1], out=fewer[:, 1:])
                ratio *= room
                ratio += 1
                ratio /= fewer + (room + self.d)
                room += 1

    def _stride(self, ratio: np.ndarray, n: np.ndarray, stride: np.ndarray | int) -> np.ndarray:
        """The ratios for `stride` more customers than n, a row each: the logarithms' increments as a derivative at the middle of each unit, over the logarithm of n."""
        taken = self.d * np.arange(1, ratio.shape[1] + 1)

        def slope(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            at, opens = np.exp(x), np.exp(-y)
            fewer = np.zeros(y.shape)
            fewer[:, 1:] = opens[:, :-1]
            return at * np.log1p((opens - fewer - self.d) / (fewer + (at - 0.5) - taken))

        x, y = np.log(n + 0.5), np.log(ratio)
        h = np.log(n + stride + 0.5) - x
        a = slope(x, y)
        b = slope(x + h / 2, y + h / 2 * a)
        c = slope(x + h / 2, y + h / 2 * b)
        return np.exp(y + h / 6 * (a + 2 * b + 2 * c + slope(x + h, y + h * c)))


def peaked(c: np.ndarray, prior: np.ndarray, others: np.ndarray, d: float, theta: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of dishes with many of them: a normal draw at the conditional's peak.

    The ways to seat c customers at t tables are c!/t! times a coefficient of ((1 - (1 - x)^d) / d)^t, whose saddle point 1 - x = y
    tells the derivative of their logarithm by t.
    """

    def slope(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        y = 1 / (1 + np.exp(-z))
        closed = 1 - y**d
        t = c * closed / ((1 - y) * d * y ** (d - 1))
        return t, np.log(closed / d) - np.log(t) + np.log(prior) + np.log(theta + d * (others + t))

    lo, hi = np.full(len(c), -60.0), np.full(len(c), 20.0)
    for _ in range(50):
        mid = (lo + hi) / 2
        rises = slope(mid)[1] > 0
        lo, hi = np.where(rises, mid, lo), np.where(rises, hi, mid)
    (t, _), (t1, g1), (t2, g2) = slope(lo), slope(lo - 0.02), slope(lo + 0.02)
    return np.clip(np.rint(t + rng.standard_normal(len(c)) * np.sqrt(np.maximum((t2 - t1) / np.maximum(g1 - g2, 1e-12), 0))), 1, c).astype(np.int64)


class Seats:
    """The tables' sizes of dishes with more customers than a table of ways holds, a row a dish: Gibbs sampling one customer at a time, by which the draws from `Ways` can be checked."""

    def __init__(self, dishes: np.ndarray, size: np.ndarray) -> None:
        self.dishes, self.size = dishes, size
        self._count()

    def _count(self) -> None:
        self.c, self.t = self.size.sum(1), (self.size > 0).sum(1)

    @staticmethod
    def start(dishes: np.ndarray, c: np.ndarray, prior: np.ndarray, others: np.ndarray, d: float, theta: float, rng: np.random.Generator) -> Seats:
        """A first seating, of an eighth more customers at a time; any start will do."""
        size, seated = np.ones((len(c), 1), np.int64), np.ones(len(c), np.int64)
        while (more := seated < c).any():
            step = np.where(more, np.minimum(np.maximum(seated // 8, 1), c - seated), 0)
            t = (size > 0).sum(1)
            new = (theta + d * (others + t)) * prior
            opened = rng.binomial(step, new / (new + seated - d * t))
            room = np.maximum(size - d * (size > 0), 0)
            size = size + rng.multinomial(step - opened, room / room.sum(1, keepdims=True))
            wide = int((t + opened).max())
            if wide > size.shape[1]:
                size = np.concatenate((size, np.zeros((len(c), wide - size.shape[1]), np.int64)), axis=1)
            place = np.arange(size.shape[1])
            size[(place >= t[:, None]) & (place < (t + opened)[:, None])] = 1
            seated = seated + step
        return Seats(dishes, size)

    def _leave(self, at: np.ndarray, rng: np.random.Generator) -> None:
        table = (np.cumsum(self.size[at], axis=1) <= (rng.random(len(at)) * self.c[at])[:, None]).sum(1)
        self.size[at, table] -= 1
        self.c[at] -= 1
        self.t[at] -= self.size[at, table] == 0

    def _enter(self, at: np.ndarray, prior: np.ndarray, others: np.ndarray, d: float, theta: float, rng: np.random.Generator) -> None:
        new, stay = (theta + d * (others[at] + self.t[at])) * prior[at], self.c[at] - d * self.t[at]
        opens = rng.random(len(at)) * (new + stay) < new
        if (opens & (self.t[at] == self.size.shape[1])).any():
            self.size = np.concatenate((self.size, np.zeros((len(self.size), 8), np.int64)), axis=1)
        room = np.cumsum(np.maximum(self.size[at] - d * (self.size[at] > 0), 0), axis=1)
        joined = np.minimum((room <= (rng.random(len(at)) * room[:, -1])[:, None]).sum(1), self.size.shape[1] - 1)
        table = np.where(opens, np.argmin(self.size[at] > 0, axis=1), joined)
        self.size[at, table] += 1
        self.c[at] += 1
        self.t[at] += opens

    def guests(self, c: np.ndarray, prior: np.ndarray, others: np.ndarray, d: float, theta: float, rng: np.random.Generator) -> None:
        """As many customers as there are now: random ones leave, or new ones sit down."""
        while len(at := np.flatnonzero(self.c > c)):
            self._leave(at, rng)
        while len(at := np.flatnonzero(self.c < c)):
            self._enter(at, prior, others, d, theta, rng)

    def sweep(self, prior: np.ndarray, others: np.ndarray, d: float, theta: float, rng: np.random.Generator, customers: int) -> None:
        """Random customers of each dish leave and sit down again, one after another."""
        every = np.arange(len(self.c))
        for _ in range(customers):
            self._leave(every, rng)
            self._enter(every, prior, others, d, theta, rng)

    def dump(self) -> tuple[bytes, bytes, bytes]:
        return _small(self.dishes), _small(self.t), _small(self.size[self.size > 0])

    @staticmethod
    def load(dumped: tuple[bytes, bytes, bytes]) -> Seats:
        dishes, t, flat = (_large(x).astype(np.int64) for x in dumped)
        size = np.zeros((len(t), int(t.max()) if len(t) else 1), np.int64)
        size[np.arange(size.shape[1]) < t[:, None]] = flat
        return Seats(dishes, size)


class Level:
    """The restaurants of one level in a part: dishes with customers c in restaurants `of`, and their tables in one chain."""

    def __init__(self, c: np.ndarray, of: np.ndarray, n: int, tables: np.ndarray | None = None) -> None:
        self.of, self.n = of, n
        self.t = np.minimum(c, 1) if tables is None else tables
        self.seats = Seats(np.empty(0, np.int64), np.zeros((0, 1), np.int64))
        self.guests(c)

    def guests(self, c: np.ndarray, at: np.ndarray | None = None) -> None:
        """Takes numbers of customers: all, or those of the dishes `at`."""
        if at is not None:
            t = np.minimum(np.maximum(self.t[at], np.minimum(c, 1)), c)
            self._moved(self.total, at, t - self.t[at])
            self._moved(self.customers, at, c - self.c[at])
            self.c[at], self.t[at] = c, t
            return
        self.c = c
        self.t = np.minimum(np.maximum(self.t, np.minimum(c, 1)), c)
        self.total = np.bincount(self.of, self.t, self.n)
        self.customers = np.bincount(self.of, c, self.n)

    def _moved(self, sums: np.ndarray, at: np.ndarray, more: np.ndarray) -> None:
        """Adds to the restaurants' sums what the dishes `at` have more."""
        on = np.flatnonzero(more)
        np.add.at(sums, self.of[at[on]], more[on].astype(sums.dtype))

    def predict(self, prior: np.ndarray, d: float, theta: float, at: np.ndarray | None = None) -> np.ndarray:
        if at is not None:
            of = self.of[at]
            return (np.maximum(self.c[at] - d * self.t[at], 0) + (theta + d * self.total[of]) * prior) / (theta + self.customers[of])
        return (np.maximum(self.c - d * self.t, 0) + (theta + d * self.total[self.of]) * prior) / (theta + self.customers[self.of])

    def sweep(self, prior: np.ndarray, d: float, theta: float, ways: np.ndarray | Ways, rng: np.random.Generator, reseated: int = RESEATED, at: np.ndarray | None = None) -> None:
        """Draws all tables anew, or those of the dishes `at` (prior: theirs); with a mere table of ways, dishes beyond it only move by so many reseated customers."""
        table = ways.table if isinstance(ways, Ways) else ways
        every = np.arange(len(self.c)) if at is None else at
        c, old = self.c[every], self.t[every]
        others, t = self.total[self.of[every]] - old, np.minimum(c, 1)
        two, few, many = np.flatnonzero(c == 2), np.flatnonzero((c > 2) & (c < len(table))), np.flatnonzero(c >= len(table))
        calm = (c[few] <= SMALL) & (prior[few] * (theta + d * (others[few] + SMALL)) <= CALM)
        small, few = few[calm], few[~calm]
        odds = prior[two] * (theta + d * (others[two] + 1)) / (1 - d)
        t[two] = 1 + (rng.random(len(two)) * (1 + odds) < odds)
        for own in np.split(small, range(1 << 16, len(small), 1 << 16)) if len(small) else ():
            t[own] = self._multiplied(c[own], prior[own], others[own], d, theta, table, rng)
        for own in np.split(few, np.flatnonzero(np.diff(np.cumsum(c[few]) >> 20)) + 1) if len(few) else ():  # of about a million cells
            t[own] = self._exact(c[own], prior[own], others[own], d, theta, table, rng)
        if len(many) and isinstance(ways, Ways):
            t[many] = self._beyond(c[many], old[many], prior[many], others[many], d, theta, ways, rng)
        elif len(many):
            self._seat(every[many], prior[many], others[many], d, theta, rng)
            self.seats.sweep(prior[many], others[many], d, theta, rng, reseated)
            t[many] = self.seats.t
        self.t[every] = t
        if at is None:
            self.total = np.bincount(self.of, self.t, self.n)
        else:
            self._moved(self.total, at, t - old)

    def _seat(self, many: np.ndarray, prior: np.ndarray, others: np.ndarray, d: float, theta: float, rng: np.random.Generator) -> None:
        """The seats of those dishes, kept where they were, with as many customers as there are now."""
        old = np.isin(many, self.seats.dishes)
        kept = self.seats.size[np.searchsorted(self.seats.dishes, many[old])]
        new = Seats.start(many[~old], self.c[many[~old]], prior[~old], others[~old], d, theta, rng).size
        size = np.zeros((len(many), max(kept.shape[1], new.shape[1])), np.int64)
        size[old, : kept.shape[1]], size[~old, : new.shape[1]] = kept, new
        self.seats = Seats(many, size)
        self.seats.guests(self.c[many], prior, others, d, theta, rng)

    @staticmethod
    def _multiplied(c: np.ndarray, prior: np.ndarray, others: np.ndarray, d: float, theta: float, ways: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        """The same draw as `_exact` for dishes of few customers: the odds of one table more are multiplied, those with most customers in front."""
        most = int(c.max())
        order = np.argsort((most - c).astype(np.uint8), kind="stable")
        c, prior, rate = c[order], prior[order], theta + d * others[order]
        more = np.zeros((most + 1, most + 1))
        for k in range(2, most + 1):
            more[2 : k + 1, k] = np.exp(np.diff(ways[k, 1 : k + 1]))
        weight, total = np.ones(len(c)), np.ones(len(c))
        mass, long = [total.copy()], len(c) - np.cumsum(np.bincount(c, minlength=most + 1))
        for t in range(2, most + 1):
            k = int(long[t - 1])  # of t customers at least
            weight = weight[:k] * prior[:k] * (rate[:k] + d * (t - 1)) * more[t][c[:k]]
            total[:k] += weight
            mass.append(total[:k].copy())
        drawn, at = np.ones(len(c), np.int64), rng.random(len(c)) * total
        for x in mass:
            drawn[: len(x)] += x <= at[: len(x)]
        out = np.empty_like(drawn)
        out[order] = np.minimum(drawn, c)
        return out

    @staticmethod
    def _exact(c: np.ndarray, prior: np.ndarray, others: np.ndarray, d: float, theta: float, ways: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        start = np.cumsum(c) - c
        one = np.arange(int(c.sum())) - np.repeat(start, c)
        grow = np.cumsum(np.log(theta + d * (np.repeat(others, c) + one)) + np.repeat(np.log(prior), c))
        weight = ways[np.repeat(c, c), one + 1] + grow - np.repeat(grow[start], c)
        weight -= np.repeat(np.maximum.reduceat(weight, start), c)
        mass = np.cumsum(np.exp(weight))
        before = np.concatenate(([0], mass))[start]
        drawn = before + rng.random(len(c)) * (mass[start + c - 1] - before)
        return np.minimum(np.searchsorted(mass, drawn, "right") - start, c - 1) + 1

    @staticmethod
    def _beyond(c: np.ndarray, old: np.ndarray, prior: np.ndarray, others: np.ndarray, d: float, theta: float, ways: Ways, rng: np.random.Generator) -> np.ndarray:
        """The same draw for more than EXACT customers, at up to `wide` tables (about twice the old ones); where any mass is left beyond them, again with more, and beyond PEAKED by its peak."""
        drawn, wide, left = np.zeros(len(c), np.int64), 32, np.argsort(c, kind="stable")
        need = 2 * old
        while len(left):
            if wide > PEAKED:
                drawn[left] = peaked(c[left], prior[left], others[left], d, theta, rng)
                break
            now = left[need[left] <= wide]
            for some, rows in ways.rows(np.unique(c[now]), wide) if len(now) else ():
                lo, hi = np.searchsorted(c[now], (some[0], some[-1] + 1))
                for i in range(lo, hi, step := max(1, Ways.HELD // wide)):
                    own = now[i : min(i + step, hi)]
                    weight = np.cumsum(np.log(theta + d * (others[own, None] + np.arange(wide))) + np.log(prior[own])[:, None], axis=1)
                    weight += rows[np.searchsorted(some, c[own])]
                    weight -= weight.max(1, keepdims=True)
                    mass = np.cumsum(np.exp(weight), axis=1)
                    drawn[own] = (mass <= (rng.random(len(own)) * mass[:, -1])[:, None]).sum(1) + 1
                    need[own] = np.where(weight[:, -1] > -40, 2 * wide, 0)
            left, wide = left[need[left] > wide], 2 * wide
        return drawn

    def strength(self, d: float, theta: float, rng: np.random.Generator) -> tuple[float, float]:
        """What a draw of theta needs of this level: sums of the auxiliary successes and logarithms."""
        on = self.total >= 2
        t, c = self.total[on].astype(np.int64), self.customers[on]
        i = np.arange(int((t - 1).sum())) - np.repeat(np.cumsum(t - 1) - (t - 1), t - 1) + 1
        return float((rng.random(len(i)) < theta / (theta + d * i)).sum()), float(np.log(np.maximum(rng.beta(theta + 1, np.maximum(c - 1, 1e-9)), 1e-300)).sum())


@dataclass
class Settings:
    chains: int = 2
    burn_in: int = 10  # sweeps on a part's own estimate of the parents
    sweeps: int = 6  # sweeps on what the parents told; the later half predict
    home_sweeps: int = 5  # sweeps at the parents
    theta: tuple[float, float] = (1.0, 1.0)  # of two words' and one word's restaurants, at first
    root_theta: float = 1.0
    learn_theta: bool = True
    seed: int = 29


@dataclass
class Totals:
    """Sums over all parts and homes, by chain where the chains differ."""

    tokens: int
    words: int
    discounts: tuple[float, float, float]
    theta: list[tuple[float, float]]
    customers: list[int] = field(default_factory=list)
    tables: list[int] = field(default_factory=list)
    hot: list[dict[int, tuple[int, int]]] = field(default_factory=list)  # split word -> customers, tables


def discount(once: float, twice: float) -> float:
    return min(0.95, max(0.05, once / (once + 2 * twice))) if once + twice else 0.5


def kinds(c: np.ndarray) -> list[int]:
    return [int((c == 1).sum()), int((c == 2).sum())]


class Chain:
    """One chain's state in a part."""

    def __init__(self, part: Part) -> None:
        self.part = part
        self.low = Level(part.c, part.context, part.n_contexts)
        self.high = Level(self._sent(), part.near, len(part.nears))

    def dump(self) -> tuple[bytes, bytes]:
        return _small(self.low.t[self.part.busy]), _small(self.high.t[self.part.many])

    @staticmethod
    def load(part: Part, dumped: tuple[bytes, bytes]) -> Chain:
        chain, (low, high) = Chain(part), (_large(x).astype(np.int64) for x in dumped)
        chain.low.t[part.busy] = low
        chain.low.guests(part.c)
        chain.high.t[part.many] = high
        chain.high.guests(chain._sent())
        return chain

    def _sent(self) -> np.ndarray:
        return np.bincount(self.part.pair, self.low.t, len(self.part.word)).astype(np.int64)

    def priors(self, root: np.ndarray, far: np.ndarray, d: tuple, theta: tuple) -> np.ndarray:
        """Each pair's probability: here, or as told by the parents."""
        p = self.high.predict(root[self.part.word], d[1], theta[1])
        p[self.part.far_pairs] = far
        return p

    def sweep(self, root: np.ndarray, far: np.ndarray, d: tuple, theta: tuple, ways: tuple[Ways, ...], rng: np.random.Generator) -> None:
        part = self.part
        p, (own, told) = self.high.predict(root[part.word[part.above]], d[1], theta[1], part.above), part.above_far
        p[own] = far[told]
        self.low.sweep(p[part.above_at], d[0], theta[0], ways[0], rng, at=part.busy)
        self.high.guests(part.single + np.bincount(part.above_at, self.low.t[part.busy], len(part.above)).astype(np.int64), part.above)
        self.high.sweep(root[part.word[part.many]], d[1], theta[1], ways[1], rng, at=part.many)

    def up(self) -> tuple[np.ndarray, np.ndarray]:
        """The parents' customers: by word, and those of the split words' dishes."""
        part = self.part
        return np.bincount(part.word, self.high.t * part.local, len(part.words)).astype(np.int64), self.high.c[part.far_pairs]

    def predict(self, root: np.ndarray, far: np.ndarray, d: tuple, theta: tuple) -> np.ndarray:
        return self.low.predict(self.priors(root, far, d, theta)[self.part.pair], d[0], theta[0])


@functools.lru_cache(maxsize=4)
def _ways(d: float, limit: int) -> Ways:
    return Ways(d)


def burnt_in(part: Part, number: int, i: int, s: Settings) -> tuple[Chain, np.random.Generator, tuple]:
    """A chain after its first sweeps, with what the part itself tells of the parents and discounts: contexts are dealt by a hash, so it holds a fair share of both."""
    rng, chain = np.random.default_rng([s.seed, i, number]), Chain(part)
    d = discount(*kinds(part.c)), discount(*kinds(chain.high.c))
    ways = tuple(_ways(x, EXACT) for x in d)
    for _ in range(s.burn_in):
        r = np.bincount(part.word, chain.high.t, len(part.words))
        root = (np.maximum(r - 0.5, 0) + (s.root_theta + 0.5 * (r > 0).sum()) / (len(r) + 1)) / (s.root_theta + r.sum())
        far = chain.high.predict(root[part.word], d[1], s.theta[1])[part.far_pairs]
        chain.sweep(root, far, d, s.theta, ways, rng)
    return chain, rng, d


# --- parents ---


def _dealt(part: Part, homes: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(home, the part's words there, the split words' dishes there)."""
    home_of = lambda w: (mix64(w ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(homes)).astype(np.int64)
    word, dish = home_of(part.words), home_of(part.far_keys[1])
    order, dishes = np.argsort(word, kind="stable"), np.argsort(dish, kind="stable")
    cut = lambda x, h: slice(*np.searchsorted(x, (h, h + 1)))
    for h in np.unique(word).tolist():
        yield h, order[cut(word[order], h)], dishes[cut(dish[dishes], h)]


def _ask(part: Part, number: int, homes: int, s: Settings) -> Iterator[tuple[int, bytes]]:
    """To each home of parents: the part's words there with training counts and each chain's customers, and the split words' dishes; the part's scalars to one, with its chains, which come back with the answers."""
    ups, learned, own, seats = [], [], [], []
    for i in range(s.chains):
        chain, rng, d = burnt_in(part, number, i, s)
        ups.append(chain.up())
        learned.append([*chain.low.strength(d[0], s.theta[0], rng), *chain.high.strength(d[1], s.theta[1], rng)])
        own = [*kinds(part.c), *kinds(chain.high.c[part.local])]
        seats.append(chain.dump())
    scalars = (learned, own, seats)
    for h, at, far in _dealt(part, homes):
        yield h, _pack(number, part.words[at].tobytes(), _small(part.count[at]), [_small(x[at]) for x, _ in ups], [x[far].tobytes() for x in part.far_keys], [_small(x[far]) for _, x in ups], scalars)
        scalars = None


class Home:
    """The parents' dishes that stand here, with their customers in each chain."""

    def __init__(self, items: list[bytes], number: int, homes: int) -> None:
        self.number, self.homes, self.asked = number, homes, sorted((_unpack(b) for b in items), key=lambda x: x[0])
        names = [np.frombuffer(x[1], np.uint64) for x in self.asked]
        self.words, self.at = np.unique(np.concatenate(names), return_inverse=True)
        self.sizes = np.cumsum([0, *map(len, names)])
        add = lambda xs, at, n: np.bincount(at, np.concatenate(xs), n).astype(np.int64)
        self.count = add([_large(x[2]) for x in self.asked], self.at, len(self.words))
        chains = range(len(self.asked[0][3]))
        self.r = [add([_large(x[3][i]) for x in self.asked], self.at, len(self.words)) for i in chains]
        u, w = (np.concatenate([np.frombuffer(x[4][i], np.uint64) for x in self.asked]) for i in (0, 1))
        _, rep, self.dish_at = np.unique(_named(u, w), return_index=True, return_inverse=True)
        self.dish = np.searchsorted(self.words, w[rep])
        self.dish_sizes = np.cumsum([0, *(len(x[4][0]) // 8 for x in self.asked)])
        self.c = [add([_large(x[5][i]) for x in self.asked], self.dish_at, len(rep)) for i in chains]
        self.nears, self.of = np.unique(u[rep], return_inverse=True)

    def counts(self) -> dict:
        """What tells the discounts and strengths."""
        r = self.r[0] + np.bincount(self.dish, np.minimum(self.c[0], 1), len(self.words)).astype(np.int64)
        told = [x[6] for x in self.asked if x[6]]
        return {"root": kinds(r), "high": np.add(kinds(self.c[0]), np.sum([x[1][2:] for x in told], axis=0) if told else 0), "low": np.sum([x[1][:2] for x in told], axis=0) if told else np.zeros(2), "learned": np.sum([x[0] for x in told], axis=0) if told else 0}

    def seat(self, s: Settings, t: Totals) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Of each chain: tables of the split words' dishes, customers and tables of the words. Other homes hold as much as this one."""
        out, ways = [], tuple(_ways(x, EXACT) for x in t.discounts)
        for i, (r, c) in enumerate(zip(self.r, self.c)):
            rng = np.random.default_rng([s.seed, i, self.number, 7])
            base = np.full(len(r), 1 / (t.words + 1))
            level = Level(c, self.of, len(self.nears))
            root = Level(r + np.bincount(self.dish, level.t, len(r)).astype(np.int64), np.zeros(len(r), np.int64), 1)
            for x in (root, level):
                x.total, x.customers = x.total * self.homes, x.customers * self.homes
            for _ in range(s.home_sweeps):
                if len(c):
                    level.sweep(root.predict(base, t.discounts[2], s.root_theta)[self.dish], t.discounts[1], t.theta[i][1], ways[1], rng)
                    root.guests(r + np.bincount(self.dish, level.t, len(r)).astype(np.int64))
                    root.total = root.total * self.homes
                    level.total = level.total * self.homes
                root.sweep(base, t.discounts[2], s.root_theta, ways[2], rng)
                root.total = root.total * self.homes
            out.append((level.t, root.c, root.t))
        return out

    def scalars(self, seated: list) -> dict:
        return {
            "customers": [int(r.sum()) for _, r, _ in seated], "tables": [int(k.sum()) for _, _, k in seated],
            "hot": [list(zip(self.nears.tolist(), np.bincount(self.of, c, len(self.nears)).astype(int).tolist(), np.bincount(self.of, far, len(self.nears)).astype(int).tolist())) for c, (far, _, _) in zip(self.c, seated)],
        }

    def answers(self, seated: list) -> Iterator[tuple[int, bytes]]:
        """To each part: its words' training counts, and by chain their customers and tables and those of the split words' dishes."""
        for j, x in enumerate(self.asked):
            at, dish = self.at[self.sizes[j] : self.sizes[j + 1]], self.dish_at[self.dish_sizes[j] : self.dish_sizes[j + 1]]
            yield x[0], _pack(self.number, _small(self.count[at]), [(_small(r[at]), _small(k[at]), _small(c[dish]), _small(far[dish])) for (far, r, k), c in zip(seated, self.c)], x[6] and x[6][2])


def _told(part: Part, blobs: list[bytes], homes: int, s: Settings, t: Totals) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray], list[Chain]]:
    """Training counts of the part's words, and by chain the words' and the split words' dishes' probabilities, and the chains as they were."""
    got = {h: rest for h, *rest in map(_unpack, blobs)}
    d, u = t.discounts, part.far_keys[0]
    count, root, far = np.zeros(len(part.words), np.int64), [np.empty(len(part.words)) for _ in range(s.chains)], [np.empty(len(part.far_pairs)) for _ in range(s.chains)]
    for h, at, dish in _dealt(part, homes):
        n, chains, seats = got[h]
        if seats:
            back = [Chain.load(part, x) for x in seats]
        count[at] = _large(n)
        for i, (r, k, c, tables) in enumerate(chains):
            r, k, c, tables = (_large(x).astype(np.float64) for x in (r, k, c, tables))
            root[i][at] = (np.maximum(r - d[2] * k, 0) + (s.root_theta + d[2] * t.tables[i]) / (t.words + 1)) / (s.root_theta + t.customers[i])
            c_u, t_u = (np.array([t.hot[i][x][j] for x in u[dish].tolist()], np.float64) for j in (0, 1))
            theta = t.theta[i][1]
            far[i][dish] = (np.maximum(c - d[1] * tables, 0) + (theta + d[1] * t_u) * root[i][part.word[part.far_pairs[dish]]]) / (theta + c_u)
    return count, root, far, back


# --- all together ---

BLOCK, TRIPLES, TOLD = 1, 0, 2  # kinds of messages to parts
OUT = "doc_id {}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def _home_of(block: int, parts: int) -> int:
    return int(mix64(np.array([block], np.uint64))[0] % np.uint64(parts))



def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings | None = None, part_tokens: int = 1_500_000, block_bytes: int = 4 << 20) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    s, spark = settings or Settings(), docs.sparkSession
    rows = small_batches(docs).select(col(id_col).alias("doc_id"), col(text_col).cast("string").alias("text")).withColumn("train", crc_bucket("doc_id") != 1)
    id_type = rows.schema["doc_id"].dataType.simpleString()
    counts = cut(word_counts(rows))
    total = counts.agg(F.sum("n")).first()[0] or 0
    parts = max(1, -(-total // part_tokens))
    limit = max(1, total // (4 * parts))
    # words of at least such a power of two, as many as go into FREQUENT
    trained = counts.agg(F.sum("train"), F.count_if(F.col("train") > 0)).first()
    powers = sorted(((r[0], r[1]) for r in counts.groupBy(F.floor(F.log2("n")).alias("p")).count().collect()), reverse=True)
    held, least = 0, 64
    for power, k in powers:
        if held + k > FREQUENT:
            break
        held, least = held + k, power
    common = counts.filter(F.floor(F.log2("n")) >= least).select("word", "train").toPandas()
    frequent = common["word"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(frequent)
    found = sorted((np.int64(r[0]).view(np.uint64), -(-r[1] // limit)) for r in counts.filter(F.col("n") > limit).collect()) if parts > 1 else []  # at most 4 a part
    layout = Layout(parts, frequent[order], common["train"].to_numpy(np.int64)[order], np.array([w for w, _ in found], np.uint64), np.array([k for _, k in found], np.int64), trained[0] or 0, trained[1])
    sent = spark.sparkContext.broadcast(layout)  # bounded by FREQUENT and four words a part
    dealt = _deal(rows, sent, block_bytes).rdd.map(lambda r: (r[0], (r[1], r[2], bytes(r[3])))).partitionBy(parts, _own)
    homes = max(1, min(parts, -(-parts * min(counts.count(), part_tokens // 4) // 4_000_000)))  # of about 4 million (part, word) pairs each

    def load(items: Iterator) -> tuple[Part, list[bytes]]:
        triples, told = [], []
        for _, (block, kind, blob) in items:
            if kind != BLOCK:
                (triples if kind == TRIPLES else told).append((block, blob))
        return Part(sorted(triples), sent.value), [b for _, b in told]

    def ask(number: int, items: Iterator) -> Iterator:
        part, _ = load(items)
        yield from _ask(part, number, homes, s) if len(part.c) else ()

    asked = dealt.mapPartitionsWithIndex(ask).partitionBy(homes, _own)

    def at_homes(run):
        def on(number: int, items: Iterator) -> Iterator:
            got = [b for _, b in items]
            if got:
                yield from run(Home(got, number, homes))

        return asked.mapPartitionsWithIndex(on)

    sums = at_homes(lambda home: [home.counts()]).collect()  # a few numbers a home
    add = lambda k: sum(x[k] for x in sums)
    if not sums:
        return spark.createDataFrame([], OUT.format(id_type))
    theta = [s.theta] * s.chains
    if s.learn_theta:
        rng = np.random.default_rng([s.seed, 3])
        theta = [tuple(float(rng.gamma(1 + x[2 * j], 1 / (1 - x[2 * j + 1]))) + 1e-3 for j in (0, 1)) for x in add("learned")]
    t = Totals(layout.tokens, layout.words, tuple(discount(*sum(np.asarray(x[k]) for x in sums)) for k in ("low", "high", "root")), theta)
    before = Totals(t.tokens, t.words, t.discounts, t.theta)

    def settle(home: Home) -> Iterator:
        seats = home.seat(s, before)
        yield -1, home.scalars(seats)
        yield from home.answers(seats)

    settled = at_homes(settle).persist(StorageLevel.DISK_ONLY)  # if it is lost, the same seed seats them again
    seated = settled.filter(lambda x: x[0] < 0).values().collect()  # a few numbers a home and split word
    t.customers, t.tables = ([sum(x[k][i] for x in seated) for i in range(s.chains)] for k in ("customers", "tables"))
    for i in range(s.chains):
        at: dict[int, tuple[int, int]] = {}
        for x in seated:
            for u, c, k in x["hot"][i]:
                at[u] = (at.get(u, (0, 0))[0] + c, at.get(u, (0, 0))[1] + k)
        t.hot.append(at)
    answers = settled.filter(lambda x: x[0] >= 0).mapValues(lambda b: (0, TOLD, b)).partitionBy(parts, _own)

    def predict(number: int, items: Iterator) -> Iterator:
        part, blobs = load(items)
        if not len(part.c):
            return
        count, root, far, chains = _told(part, blobs, homes, s, t)
        ways, average = tuple(_ways(x, EXACT) for x in t.discounts), np.zeros(len(part.c))
        for i, chain in enumerate(chains):
            rng = np.random.default_rng([s.seed, i, number, 1])
            for k in range(s.sweeps):
                chain.sweep(root[i], far[i], t.discounts, t.theta[i], ways, rng)
                if k >= s.sweeps // 2:
                    average += chain.predict(root[i], far[i], t.discounts, t.theta[i])
            if not s.sweeps:
                average += chain.predict(root[i], far[i], t.discounts, t.theta[i])
        logp = np.rint(-np.log10(average / (s.chains * max(s.sweeps - s.sweeps // 2, 1))) * FINE).astype(np.int64)
        of_word, at = count[part.word[part.pair]], 0
        for block, size in part.blocks:
            own, rare = part.triple_of[at : at + size], part.rare[at : at + size]
            at += size
            yield _home_of(block, parts), (block, (number,), _pack(_small(logp[own]), _small(of_word[own[rare]])))

    answered = dealt.union(answers).mapPartitionsWithIndex(predict).partitionBy(parts, _own)

    def score(items: Iterator) -> Iterator[tuple]:
        blocks: dict[int, list] = {}
        for _, (block, kind, blob) in items:
            if kind == BLOCK or isinstance(kind, tuple):
                blocks.setdefault(block, []).append((-1 if kind == BLOCK else kind[0], blob))
        for block in sorted(blocks):
            got = sorted(blocks[block])
            ids, train, begin, base, known, number, rare = _unpack(got[0][1])
            found = [_unpack(b) for _, b in got[1:]]
            logp = np.concatenate([_large(x[0]) for x in found]).astype(np.float64) / -FINE
            told, number, rare = np.concatenate([_large(x[1]) for x in found]).astype(np.int64), _large(number), _large(rare)
            rare_base, rare_known = np.zeros(len(logp)), np.zeros(len(logp), np.int64)
            rare_base[rare], rare_known[rare] = sent.value.base(told), told > 0
            sums = [np.add.reduceat(x[number], begin[:-1]) for x in (logp, rare_base, rare_known)]
            for row in zip(ids, (~train).tolist(), np.diff(begin).tolist(), (known + sums[2]).tolist(), (base + sums[1]).tolist(), sums[0].tolist()):
                yield (*row[:4], t.tokens, *row[4:])

    return spark.createDataFrame(dealt.union(answered).mapPartitions(score), OUT.format(id_type), verifySchema=False)
