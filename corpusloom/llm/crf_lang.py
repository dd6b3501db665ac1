"""Language identification of code-switched text by a linear-chain conditional random field over words.

A word's features are its byte trigrams (blanks at its ends included), its three-byte prefix and suffix, and itself
(the lexicon), each hashed into a table of weights a label. Transitions between labels are learned with them, by
gradient steps on the log-likelihood of sequences made of two stretches of the sample's texts, often of different
languages. Prediction is forward-backward over all words of a text: the label with the largest mean posterior.

Long texts are cut into chunks whose transfer matrices are multiplied in order, so that one long text doesn't
hold up a batch; the posteriors are those of the whole text.

The fit uses a bounded sample of the labelled rows (sample_rows a label). Null text, or none of its characters a
letter: `und` with score 0. Null labels aren't learned. No labelled rows at all: every text is `und`.
Repeated rows are labelled alike. Other columns pass as they are, whatever their names. Empty input: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import LOWER_TABLE, col, crc_bucket, free, join_texts, map_whole, small_batches, span_hash, sub_batches, word_spans

#: Hashed weights of each kind of feature, words of a chunk.
ROOM, CHUNK = 1 << 18, 32
_BLANK_TABLE = bytes(32 if b in b"\t\n\x0b\x0c\r " else b for b in LOWER_TABLE)


@dataclass
class Words:
    """A batch's words and where their features stand in the table."""

    first: np.ndarray  # each text's first word, and the end
    lengths: np.ndarray
    grams: np.ndarray  # by byte of all words
    whole: np.ndarray  # words x 3: prefix, suffix, lexicon


def featurise(texts: list) -> Words:
    raw, ends = join_texts(texts, _BLANK_TABLE)
    buf = np.frombuffer(b"  " + raw + b"   ", np.uint8)
    s, e = word_spans(buf)
    first = np.searchsorted(s, np.concatenate(([0], ends + 2)))
    b = buf.astype(np.uint32)
    tri = b[:-2] << 16 | b[1:-1] << 8 | b[2:]  # at i: bytes i, i+1, i+2
    spread = lambda x, salt: ((x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt)) >> np.uint64(46)).astype(np.int64)
    inside = np.repeat(s - np.concatenate(([0], np.cumsum(e - s)[:-1])), e - s) + np.arange(int((e - s).sum()))
    whole = np.stack((spread(tri[s], 1) + ROOM, spread(tri[np.maximum(e - 3, 0)], 2) + 2 * ROOM, (span_hash(buf, s, e) >> np.uint64(46)).astype(np.int64) + 3 * ROOM), axis=1) if len(s) else np.empty((0, 3), np.int64)
    return Words(first, e - s, spread(tri[inside - 1], 3), whole)


def emissions(weights: np.ndarray, w: Words) -> np.ndarray:
    if not len(w.lengths):
        return np.empty((0, weights.shape[1]), np.float32)
    at = np.concatenate(([0], np.cumsum(w.lengths)[:-1]))
    return np.add.reduceat(weights[w.grams], at, axis=0) + weights[w.whole].sum(1)


def _scaled(e: np.ndarray) -> np.ndarray:
    return np.exp(e - e.max(1, keepdims=True)).astype(np.float64)


def posteriors(e: np.ndarray, first: np.ndarray, transition: np.ndarray) -> np.ndarray:
    """Posterior label probabilities of each word; texts are words first[i]..first[i+1]."""
    n, k = e.shape
    if not n:
        return e.astype(np.float64)
    t, pot = np.exp(transition), _scaled(e)
    counts = np.diff(first)
    chunks = -(-counts // CHUNK)
    lane_text = np.repeat(np.arange(len(counts)), chunks)
    lane_rank = np.arange(len(lane_text)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
    at = (first[:-1][lane_text] + lane_rank * CHUNK)[:, None] + np.arange(CHUNK)
    real = at < first[1:][lane_text][:, None]
    at = np.where(real, at, 0)
    lanes = len(lane_text)
    norm = lambda a: a / a.sum(tuple(range(1, a.ndim)), keepdims=True)
    through = np.broadcast_to(np.eye(k), (lanes, k, k)).copy()
    for i in range(CHUNK):
        on = real[:, i]
        through[on] = norm((through[on] @ t) * pot[at[on, i]][:, None, :])
    enter, leave = np.full((lanes, k), 1 / k), np.full((lanes, k), 1 / k)
    for r in range(1, int(chunks.max())):
        x = np.flatnonzero(lane_rank == r)
        enter[x] = norm(np.einsum("lk,lkj->lj", enter[x - 1], through[x - 1]))
    for r in range(int(chunks.max()) - 1, 0, -1):
        x = np.flatnonzero(lane_rank == r)
        leave[x - 1] = norm(np.einsum("lkj,lj->lk", through[x], leave[x]))
    ahead = np.empty((CHUNK, lanes, k))
    a = enter
    for i in range(CHUNK):
        a = np.where(real[:, i, None], norm((a @ t) * pot[at[:, i]]), a)
        ahead[i] = a
    out = np.empty((n, k))
    b = leave
    for i in range(CHUNK - 1, -1, -1):
        on = real[:, i]
        out[at[on, i]] = norm(ahead[i][on] * b[on])
        b = np.where(on[:, None], norm((pot[at[:, i]] * b) @ t.T), b)
    return out


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray
    transition: np.ndarray

    def predict(self, texts: list) -> tuple[list[str], list[float]]:
        import regex

        letter = regex.compile(r"\p{L}")
        w = featurise(texts)
        p = posteriors(emissions(self.weights, w), w.first, self.transition)
        label, score = [], []
        for i, text in enumerate(texts):
            lo, hi = int(w.first[i]), int(w.first[i + 1])
            if not self.labels or text is None or hi == lo or not letter.search(text):
                label.append("und")
                score.append(0.0)
            else:
                mean = p[lo:hi].mean(0)
                best = int(mean.argmax())
                label.append(self.labels[best])
                score.append(float(min(1.0, mean[best])))
        return label, score


def fit(texts: list[str], labels: list[str], epochs: int = 6, rate: float = 0.25, decay: float = 1e-5, seed: int = 5) -> Model:
    names = sorted(set(labels))
    k, half = len(names), CHUNK // 2
    weights, transition = np.zeros((4 * ROOM, k), np.float32), np.zeros((k, k))
    model = Model(names, weights, transition)
    if k < 2:
        return model
    w = featurise(texts)
    gold_of = np.array([names.index(x) for x in labels])
    starts = np.concatenate([np.arange(lo, hi - half + 1, half) for lo, hi in zip(w.first[:-1], w.first[1:])] + [np.empty(0, np.int64)]).astype(np.int64)
    if not len(starts):  # only very short texts: each word by itself
        starts, half = np.arange(len(w.lengths)), 1
    text_of = np.searchsorted(w.first, starts, "right") - 1
    byte_at = np.concatenate(([0], np.cumsum(w.lengths)))
    rng, squares, t_squares = np.random.default_rng(seed), np.full((4 * ROOM, k), 1e-3, np.float32), np.full((k, k), 1e-3)
    for _ in range(epochs):
        left, right = rng.permutation(len(starts)), rng.permutation(len(starts))
        for lo in range(0, len(starts), 256):
            pair = np.stack((left[lo : lo + 256], right[lo : lo + 256]), axis=1)  # a stretch and another: switched text
            seq = (starts[pair][:, :, None] + np.arange(half)).reshape(len(pair), -1)
            gold = np.repeat(gold_of[text_of[pair]], half, axis=1)
            flat = seq.ravel()
            size = w.lengths[flat]
            grams = w.grams[np.repeat(byte_at[flat] - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(int(size.sum()))]
            part = Words(np.arange(len(pair) + 1) * seq.shape[1], size, grams, w.whole[flat])
            e = emissions(weights, part)
            pot, t = _scaled(e).reshape(len(pair), -1, k), np.exp(transition)
            norm = lambda a: a / a.sum(1, keepdims=True)
            ahead = [norm(np.full((len(pair), k), 1 / k) @ t * pot[:, 0])]
            for i in range(1, pot.shape[1]):
                ahead.append(norm((ahead[-1] @ t) * pot[:, i]))
            back, expect, slope = np.full((len(pair), k), 1 / k), np.zeros((k, k)), np.empty((len(pair), pot.shape[1], k))
            for i in range(pot.shape[1] - 1, -1, -1):
                slope[:, i] = -norm(ahead[i] * back)
                if i:
                    both = ahead[i - 1][:, :, None] * t * (pot[:, i] * back)[:, None, :]
                    expect += (both / both.sum((1, 2), keepdims=True)).sum(0)
                back = norm((pot[:, i] * back) @ t.T)
            rows, cols = np.meshgrid(np.arange(len(pair)), np.arange(pot.shape[1]), indexing="ij")
            slope[rows, cols, gold] += 1
            true = np.zeros((k, k))
            np.add.at(true, (gold[:, :-1].ravel(), gold[:, 1:].ravel()), 1)
            g = (slope.reshape(-1, k) / len(pair)).astype(np.float32)
            index = np.concatenate((np.repeat(np.arange(len(flat)), size), np.repeat(np.arange(len(flat)), 3)))
            feature = np.concatenate((grams, part.whole.ravel()))
            used, inverse = np.unique(feature, return_inverse=True)
            total = np.stack([np.bincount(inverse, g[index, c], len(used)) for c in range(k)], axis=1).astype(np.float32)
            total -= decay * weights[used]
            squares[used] += total**2
            weights[used] += rate * total / np.sqrt(squares[used])
            gt = (true - expect) / len(pair)
            t_squares += gt**2
            transition += rate * gt / np.sqrt(t_squares)
    return model


def train(docs: DataFrame, text_col: str = "text", label_col: str = "lang", sample_rows: int = 300, max_chars: int = 100_000, seed: int = 11) -> Model:
    """Fit on about sample_rows texts of each label, drawn by a hash of the text; copies count once, texts over max_chars aren't drawn."""
    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.col(label_col).cast("string").alias("lang")).filter("lang is not null and text is not null")
    counts = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return Model([], np.zeros((4 * ROOM, 1), np.float32), np.zeros((1, 1)))
    share = F.coalesce(*[F.when(F.col("lang") == k, F.lit(min(1.0, 1.5 * sample_rows / n))) for k, n in counts.items()])
    draw = F.pmod(F.xxhash64(F.lit(seed), "text"), F.lit(1 << 30)) / float(1 << 30)
    drawn = rows.filter((draw < share) & (F.length("text") <= max_chars)).distinct()
    by = {}
    for r in drawn.collect():
        by.setdefault(r.lang, []).append(r.text)
    sample = [(t, k) for k in sorted(by) for t in sorted(by[k], key=lambda x: hash_key(x))[:sample_rows]]
    return fit([t for t, _ in sample], [k for _, k in sample])


def hash_key(text: str) -> int:
    import zlib

    return zlib.crc32(text.encode("utf-8", "replace"))


def label_documents(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns `keep` (default: all) and the two `names`, which must not be among them."""
    keep = docs.columns if keep is None else keep
    if clash := {c.lower() for c in keep} & {n.lower() for n in names}:
        raise ValueError(f"columns {sorted(clash)} are taken: choose other names")
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 4 * ROOM weights a label, whatever the input's size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sub_batches(batches, len(keep), 1 << 20):
            label, score = sent.value.predict(b.column(len(keep)).to_pylist())
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(len(keep))], pa.array(label, pa.string()), pa.array(score, pa.float64())], names=[*keep, *names])

    rows = docs.select(*map(col, keep), col(text_col).cast("string").alias(free(keep, "as_text")[0]))
    schema = docs.select(*map(col, keep)).schema.add(names[0], "string").add(names[1], "double")
    return map_whole(small_batches(rows), run, schema)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", sample_rows: int = 300) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learned from rows whose crc32(id) mod 5 is not 0."""
    rows = docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text"), col(label_col).alias("lang")).withColumn("held_out", crc_bucket("doc_id") == 0)
    model = train(rows.filter(~F.col("held_out")), sample_rows=sample_rows)
    return label_documents(rows, model, keep=["doc_id", "held_out"])
