"""The training-data operators against brute force, with nulls, ties, empty and long texts, repeats and empty tables."""

import collections
import hashlib
import random
import re
import subprocess
import sys
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from corpusloom.llm import common, crf_lang, decontam, fst_tokens, graph, hpylm, linespread, packing, queries, sharding, simhash, simhash_wide, urlfilter, vamana
from tests.conftest import SF, same_rows

R = random.Random(7)
VOCAB = ["the", "of", "and", "eau", "über", "niño", "Data", "x1", "don't", "a,b", "end."] + ["".join(R.choice("abcdefghio") for _ in range(R.randint(2, 9))) for _ in range(300)]


def prose(n, rng=R):
    return " ".join(rng.choice(VOCAB) for _ in range(n))


LONG = prose(6000)
TEXTS = [None, "", " \n\t ", "!!!", "one", "one two", LONG, LONG, "A  b\nc", *[prose(R.randint(1, 200)) for _ in range(25)]]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, fp string, slot int"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 2 else None, f"s{i % 4}" if i % 5 else None, None, None, None, None) for i, t in enumerate(TEXTS)]
    rows += [(None, "null id", None, None, None, None, None, None), rows[9], rows[9]]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracle(spark, name):
    same_rows(queries.queries()[name](spark, SF), queries.oracle_sql()[name])


# --- 1 ---


def brute_hits(text, items, k=13):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(str.maketrans(common.UPPER, common.LOWER)))
    w, hit, found = words(text), set(), set()
    for item, t in items:
        own = words(t)
        for i in range(max(1, len(own) - k + 1) if own else 0):
            gram = own[i : i + k]
            for j in range(len(w) - len(gram) + 1):
                if w[j : j + len(gram)] == gram:
                    hit |= set(range(j, j + len(gram)))
                    found.add(str(item))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()


@pytest.mark.parametrize("room", [2_000_000, 60])
def test_contamination(spark, docs, none, room):
    items = [(1, TEXTS[20]), (2, "one two"), (3, " ".join(LONG.split()[100:140])), (4, None), (5, "..."), (6, TEXTS[20]), (7, "Über Niño the")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.contamination(docs, bench, max_item_words=room).collect()
    assert len(got) == docs.count()
    by = dict(enumerate(TEXTS)) | {None: "null id"}
    for r in got:
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256) == brute_hits(by[r.doc_id], items)
        assert r.contaminated == (r.n_hit > 0 and 20 * r.n_hit >= r.n_words)
    assert decontam.contamination(none, bench).count() == 0 and decontam.contamination(docs, bench.limit(0)).filter("n_hit > 0").count() == 0
    clean = decontam.remove_hits(docs, bench, max_item_words=room)
    assert clean.columns == docs.columns and decontam.contamination(clean.filter("doc_id = 6"), bench).filter("n_hit >= 13").count() == 0
    assert not {20} & {r.doc_id for r in clean.collect()}


def test_blocks_of_items_change_nothing(spark):
    """Coverage over the hits of all blocks; a window over words that another block hits; no window across a cut."""
    w = [f"w{i}" for i in range(200)]
    items = [(1, w[10:40]), (2, w[60:90]), (3, w[35:55]), (4, w[100:106] + w[120:127]), (5, w[106:120])]
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in items], "item_id long, text string")
    texts = [" ".join(t) for t in (w[:100], w[5:60] + [f"o{i}" for i in range(100)], w[95:135] + [f"o{i}" for i in range(60)], w[130:])] + [None, ""]
    rows = spark.createDataFrame([*enumerate(texts), (1, texts[1])], "doc_id long, text string").repartition(2)
    whole, split = (sorted(map(tuple, decontam.remove_hits(rows, bench, max_item_words=n).collect()), key=str) for n in (2_000_000, 20))
    kept = " ".join([*w[5:10], "", *w[55:60], *(f"o{i}" for i in range(100))]), " ".join([*w[95:106], "", *w[120:135], *(f"o{i}" for i in range(60))])
    want = [(1, kept[0]), (1, kept[0]), (2, kept[1]), (3, texts[3]), (4, None), (5, "")]
    assert whole == split == sorted(want, key=str)


# --- 2 ---


def plain_score(texts, train):
    """log10 probabilities of whole texts by dictionaries, one table a dish: restaurants of two words, of one, of none."""
    toks = [[w.translate(str.maketrans(common.UPPER, common.LOWER)) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")] + ["</s>"] for t in texts]
    triples = lambda t: zip(["<s>", "<s>", *t], ["<s>", *t], t)
    low = collections.Counter(x for t, on in zip(toks, train) if on for x in triples(t))
    high = collections.Counter((u, w) for _, u, w in low)
    root = collections.Counter(w for _, w in high)
    words = {w for t, on in zip(toks, train) if on for w in t}
    d = [hpylm.discount(sum(x == 1 for x in c.values()), sum(x == 2 for x in c.values())) for c in (low, high, root)]

    def totals(c, ctx):
        n, k = collections.Counter(), collections.Counter()
        for x, m in c.items():
            n[ctx(x)] += m
            k[ctx(x)] += 1
        return n, k

    (n2, k2), (n1, k1) = totals(low, lambda x: x[:2]), totals(high, lambda x: x[0])
    base = 1 / (len(words) + 1)
    p0 = lambda w: (max(root[w] - d[2] * (root[w] > 0), 0) + (1 + d[2] * len(root)) * base) / (1 + sum(root.values()))
    p1 = lambda u, w: (max(high[u, w] - d[1] * (high[u, w] > 0), 0) + (1 + d[1] * k1[u]) * p0(w)) / (1 + n1[u])
    p2 = lambda a, u, w: (max(low[a, u, w] - d[0] * (low[a, u, w] > 0), 0) + (1 + d[0] * k2[a, u]) * p1(u, w)) / (1 + n2[a, u])
    assert all(abs(sum(p2(a, u, w) for w in words) + (1 + d[0] * k2[a, u]) / (1 + n2[a, u]) * (1 + d[1] * k1[u]) / (1 + n1[u]) * (1 + d[2] * len(root)) * base / (1 + sum(root.values())) - 1) < 1e-9 for a, u, _ in list(low)[:20])
    return [sum(np.log10(p2(*x)) for x in triples(t)) for t in toks]


FIXED = hpylm.Settings(burn_in=0, sweeps=0, home_sweeps=0, learn_theta=False)


@pytest.mark.parametrize("part_tokens", [1_500_000, 700])
def test_language_model_with_fixed_seats(spark, docs, part_tokens, monkeypatch):
    """One table a dish: the scores are those of a plain program, in one part or in many with split words and several homes."""
    rows = docs.filter("doc_id is not null").dropDuplicates(["doc_id"])
    monkeypatch.setattr(hpylm, "FREQUENT", 100)
    train = [zlib.crc32(str(i).encode()) % 5 != 1 for i in range(len(TEXTS))]
    want = plain_score(TEXTS, train)
    got = hpylm.score_documents(rows, settings=FIXED, part_tokens=part_tokens, block_bytes=8 << 10).collect()
    assert len(got) == len(TEXTS)
    for r in got:
        assert r.score == pytest.approx(want[r.doc_id], rel=1e-6, abs=1e-4)


def test_language_model(spark, docs, none):
    rows = docs.filter("doc_id is not null").dropDuplicates(["doc_id"])
    small = hpylm.score_documents(rows, part_tokens=700, block_bytes=8 << 10).collect()
    whole = {r.doc_id: r for r in hpylm.score_documents(rows).collect()}
    assert len(small) == len(whole) == rows.count() and hpylm.score_documents(none).count() == 0
    toks = {i: [w.translate(str.maketrans(common.UPPER, common.LOWER)) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")] + [None] for i, t in enumerate(TEXTS)}
    train = collections.Counter(t for i, ts in toks.items() if zlib.crc32(str(i).encode()) % 5 != 1 for t in ts)
    n, v = sum(train.values()), len(train)
    for r in small:
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(toks[r.doc_id]), sum(train[t] > 0 for t in toks[r.doc_id]), n, zlib.crc32(str(r.doc_id).encode()) % 5 == 1)
        assert r.base_score == pytest.approx(sum(np.log10((train[t] + 0.5) / (n + 0.5 * (v + 1))) for t in toks[r.doc_id]), rel=1e-9)
        assert r.score == pytest.approx(whole[r.doc_id].score, rel=0.2)  # other seats, nearly the same model
    assert sum(r.score for r in small) > sum(r.base_score for r in small)
    repeated = docs.filter("doc_id is null or doc_id = 9")
    assert hpylm.score_documents(repeated).count() == repeated.count() > 1


@pytest.mark.parametrize("limit", [40, 4])
def test_seating_follows_the_conditional(limit):
    """Tables drawn exactly, and seat by seat beyond the limit, against the enumerated conditional."""
    rng, d, theta, c, prior, others = np.random.default_rng(1), 0.6, 1.0, 20, 0.05, 7
    t = np.arange(1, c + 1)
    weight = hpylm.log_tables(c, d)[c, 1:] + np.cumsum(np.log(prior) + np.log(theta + d * (others + t - 1)))
    want = np.exp(weight - weight.max())
    want /= want.sum()
    n = 4000
    level = hpylm.Level(np.full(n, c), np.arange(n), n)
    counts = np.zeros(c)
    for _ in range(1 if limit == 40 else 30):
        level.total = level.t + others
        level.sweep(np.full(n, prior), d, theta, hpylm.log_tables(limit, d), rng, reseated=40)
    counts = np.bincount(level.t, minlength=c + 1)[1:] / n
    assert np.abs(counts - want).max() < 0.03 and abs((counts * t).sum() - (want * t).sum()) < 0.1
    if limit == 4:  # fewer and more customers keep the rest of the seats
        level.guests(np.full(n, 15))
        level.sweep(np.full(n, prior), d, theta, hpylm.log_tables(limit, d), rng)
        assert (level.seats.c == 15).all() and (level.seats.size.sum(1) == 15).all() and (level.t == (level.seats.size > 0).sum(1)).all()
    assert np.exp(hpylm.log_tables(3, d)[3, 1:]) == pytest.approx([(1 - d) * (2 - d), 3 * (1 - d), 1])


def test_the_same_draws_beyond_the_table(monkeypatch):
    """Dishes with more customers than the table of ways holds: one draw, against the enumerated conditional, and rows against the whole table."""
    monkeypatch.setattr(hpylm, "EXACT", 8)
    rng, d, theta, prior, others = np.random.default_rng(1), 0.6, 1.0, 0.05, 7
    c = np.repeat([20, 33, 60], 4000)
    level = hpylm.Level(c, np.arange(len(c)), len(c))
    level.total = level.t + others
    level.sweep(np.full(len(c), prior), d, theta, hpylm.Ways(d), rng)
    whole = hpylm.log_tables(60, d)
    for n in (20, 33, 60):
        t = np.arange(1, n + 1)
        weight = whole[n, 1 : n + 1] + np.cumsum(np.log(prior) + np.log(theta + d * (others + t - 1)))
        want = np.exp(weight - weight.max())
        want /= want.sum()
        assert np.abs(np.bincount(level.t[c == n], minlength=n + 1)[1:] / 4000 - want).max() < 0.03
        for wide in (3, 8, 40):
            ((_, rows),) = hpylm.Ways(d).rows(np.array([9, n]), wide)
            assert rows[1, : min(n, wide)] == pytest.approx(whole[n, 1 : min(n, wide) + 1] - whole[n, 1], abs=1e-9) and np.isneginf(rows[0, 9:]).all()


def test_the_way_to_rows_is_gone_once(monkeypatch):
    """Rows of other customers start from the nodes of those before, and are the same as from the beginning, step by step or by many."""
    steps, stride = [], hpylm.Ways._stride
    monkeypatch.setattr(hpylm.Ways, "_stride", lambda *x: steps.append(1) or stride(*x))
    for d, wide in ((0.3, 32), (0.84, 256)):
        ways, c = hpylm.Ways(d), np.array([1100, 5000, 40_000])
        list(ways.rows(c, wide))
        first = len(steps)
        ((_, again),) = ways.rows(c + 7, wide)
        assert first > 20 and len(steps) - first <= 1
        steps.clear()
        monkeypatch.setattr(hpylm.Ways, "STRIDES", 1 << 40)
        ((_, single),) = hpylm.Ways(d).rows(c + 7, wide)
        monkeypatch.undo()
        monkeypatch.setattr(hpylm.Ways, "_stride", lambda *x: steps.append(1) or stride(*x))
        assert np.diff(again) == pytest.approx(np.diff(single), abs=5e-5)
        assert np.array_equal(next(ways.rows(np.array([1107, 2000]), wide))[1][0], again[0])  # kept rows beside new ones


def test_draws_of_few_customers():
    """Multiplied out, the draws are those by logarithms; where that leaves the range of numbers, logarithms are used."""
    d, theta, n = 0.84, 1.0, 3000
    table, rng = hpylm.log_tables(64, d), np.random.default_rng(5)
    for c in (2, 3, 10, 64):
        prior, others = rng.random(n) ** 4, rng.integers(0, 900, n)
        x = np.full(n, c), prior, others, d, theta, table
        assert np.array_equal(hpylm.Level._multiplied(*x, np.random.default_rng(6)), hpylm.Level._exact(*x, np.random.default_rng(6)))
    c = rng.integers(3, 65, n)  # of mixed sizes: each draw has its own dish's mean
    got = np.mean([hpylm.Level._multiplied(c, np.full(n, 0.02), np.full(n, 40), d, theta, table, rng) for _ in range(200)], axis=0)
    want = np.mean([hpylm.Level._exact(c, np.full(n, 0.02), np.full(n, 40), d, theta, table, rng) for _ in range(200)], axis=0)
    assert np.abs(got - want).max() < 1 and got.sum() == pytest.approx(want.sum(), rel=3e-3)
    level = hpylm.Level(np.full(4, 64), np.zeros(4, np.int64), 1)
    level.total = level.total + 1e15
    level.sweep(np.full(4, 0.9), d, theta, hpylm.Ways(d), rng)
    assert (level.t == 64).all()


def test_draws_of_many_tables():
    """Beyond PEAKED tables the draws have the conditional's mean and spread."""
    d, theta, prior, others, n = 0.84, 1.0, 0.05, 20_000, 4000
    ((_, rows),) = hpylm.Ways(d).rows(np.array([5000]), 4096)
    t = np.arange(1, 4097)
    weight = rows[0] + np.cumsum(np.log(prior) + np.log(theta + d * (others + t - 1)))
    want = np.exp(weight - weight.max())
    want /= want.sum()
    mean = (want * t).sum()
    got = hpylm.Level._beyond(np.full(n, 5000), np.ones(n, np.int64), np.full(n, prior), np.full(n, float(others)), d, theta, hpylm.Ways(d), np.random.default_rng(1))
    assert mean > hpylm.PEAKED and got.mean() == pytest.approx(mean, rel=5e-3) and got.std() == pytest.approx(np.sqrt((want * (t - mean) ** 2).sum()), rel=0.05)


def test_default_sweeps_are_enough(spark):
    """The probabilities of the default settings are those of chains that go on for long."""
    rng = random.Random(3)
    words = [f"w{int(rng.paretovariate(0.7)) % 300}" for _ in range(30_000)]
    rows = spark.createDataFrame([(i, " ".join(words[100 * i : 100 * i + 100])) for i in range(300)], "doc_id long, text string")
    score = lambda s: np.array([r.score for r in hpylm.score_documents(rows, settings=s, part_tokens=8000).orderBy("doc_id").collect()])
    long = score(hpylm.Settings(chains=6, burn_in=30, sweeps=60, home_sweeps=30, seed=5))
    assert np.abs(score(None) - long).mean() < 0.4  # log10 a text of 100 words


# --- 3 ---

WORDS = public_tokenizers.path("word_bpe_49k.json")


def test_packing(docs, none):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(WORDS)
    got = packing.pack(docs, WORDS).collect()
    by = dict(enumerate(TEXTS)) | {None: "null id"}
    held, pieces = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        ids = [*lib.encode(by[r.doc_id] or "", add_special_tokens=False).ids, 0]
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) and r.start == 2048 * r.piece
        held[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append((r.piece, r.length, len(ids)))
    for x in held.values():
        at = 0
        for offset, length in sorted(x):
            assert offset == at
            at += length
        assert at <= 2048
    for k, x in pieces.items():
        copies = x.count(x[0])
        assert sum(n for _, n, _ in x) == copies * x[0][2]
    assert set(pieces) == set(by) and packing.pack(none, WORDS).count() == 0


def test_sequences_hold_their_ids(docs, none):
    from tokenizers import Tokenizer

    lib, by = Tokenizer.from_file(WORDS), dict(enumerate(TEXTS)) | {None: "null id"}
    seen = collections.Counter()
    got = packing.sequences(docs, WORDS).collect()
    for r in got:
        assert r["length"] == len(r.ids) == sum(p.length for p in r.pieces) <= 2048
        for p in r.pieces:
            ids = [*lib.encode(by[p.doc_id] or "", add_special_tokens=False).ids, 0]
            assert r.ids[p.offset : p.offset + p.length] == ids[p.start : p.start + p.length]
            seen[p.doc_id, p.piece] += 1
    told = collections.Counter((r.doc_id, r.piece) for r in packing.pack(docs, WORDS).collect())
    assert seen == told and len({r.sequence_id for r in got}) == len(got) and packing.sequences(none, WORDS).count() == 0


def test_pipeline_ends_in_token_ids(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(20)
    got = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert got and all(len(r.ids) == r["length"] for r in got)


@pytest.mark.parametrize("seed", range(4))
def test_plan(seed):
    rng = np.random.default_rng(seed)
    lengths = np.clip(rng.lognormal(5 + seed / 2, 1, 4000).astype(int), 1, 2048)
    h = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True))))
    plan = packing.make_plan(h, 2048)
    fill, seen = np.zeros(plan.sequences, int), collections.Counter()
    for length, rank, n, first, each, offset in sorted(plan.places, key=lambda p: p[5]):
        assert rank >= 0
        for j in range(n):
            assert fill[first + j // each] == offset + j % each * length
            fill[first + j // each] += length
        seen[length] += n
    assert seen == h and fill.max() <= 2048 and plan.sequences <= 1.03 * lengths.sum() / 2048 + 2


def test_word_ids():
    from tokenizers import Tokenizer

    lib, ids = Tokenizer.from_file(WORDS), packing.WordIds(WORDS)
    texts = [None, "", "A<|endoftext|>b", "İstanbul don't 're 12½ ''s", "Ünï ΣΑΣ", "\x1c a\x85b\xa0c _x_ ²\x01", "日本", *TEXTS[5:]]
    assert [x.tolist() for x in ids(texts)] == [[*lib.encode(t or "", add_special_tokens=False).ids, 0] for t in texts]


# --- 4 ---

BYTES = public_tokenizers.path("byte_bpe_50k.json")


def test_token_counts(docs, none):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(BYTES)
    by = dict(enumerate(TEXTS)) | {None: "null id"}
    got = fst_tokens.count_tokens(docs, BYTES).collect()
    assert len(got) == docs.count() and fst_tokens.count_tokens(none, BYTES).count() == 0
    for r in got:
        n = len(lib.encode(by[r.doc_id] or "", add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((by[r.doc_id] or "").encode()), n, n > 512)


def test_transducer(monkeypatch):
    from tokenizers import Tokenizer

    lib, machine = Tokenizer.from_file(BYTES), fst_tokens.Transducer(BYTES)
    alphabet = " \n\t'srevlmdtaA1²  ,.é日 <|>x𝒳"
    texts = ["".join(R.choice(alphabet) for _ in range(R.randint(0, 40))) for _ in range(1500)]
    texts += ["a" * 3000, " " * 3000 + "x", "\n'll 'r", "A<|endoftext|>b<|endoftext|>", "'" * 600, "日本語" * 400, None, ""]
    texts += ["".join(chr(R.choice([R.randrange(0x4E00, 0x9FFF), R.randrange(0x400, 0x500), 0x3000, 0x1F600 + R.randrange(50), 0x27, 0x660 + R.randrange(10), 0x2014])) for _ in range(R.randint(1, 60))) for _ in range(400)]
    want = [len(lib.encode(t or "", add_special_tokens=False).ids) for t in texts]
    assert machine.count(texts).tolist() == want
    monkeypatch.setattr(fst_tokens, "CHUNK", 7)
    monkeypatch.setattr(fst_tokens, "DIRECT", 20)  # the others are read by bytes
    monkeypatch.setattr(fst_tokens, "NEIGHBOURS", 500)
    monkeypatch.setattr(fst_tokens, "TABLE_ENTRIES", 60_000)  # starts anew again and again
    machine = fst_tokens.Transducer(BYTES)
    assert [n for i in range(0, len(texts), 100) for n in machine.count(texts[i : i + 100]).tolist()] == want


# --- 5 ---


def brute_simhash(text, k=3):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans(common.UPPER, common.LOWER)).encode())
    grams = [b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(values):
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(values):
        for j in range(i):
            if (a ^ values[j]).bit_count() <= 2:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(values))]


def test_simhash(docs, none):
    rows = docs.filter("doc_id is not null").dropDuplicates(["doc_id"])
    got = {r.doc_id: r for r in simhash.near_duplicates(rows).collect()}
    prints = [brute_simhash(t) for t in TEXTS]
    assert [got[i].fingerprint for i in range(len(TEXTS))] == [f"{x:016x}" for x in prints]
    assert [got[i].component_id for i in range(len(TEXTS))] == brute_components(prints)
    assert simhash.near_duplicates(none).count() == 0 and simhash.near_duplicates(docs).count() == docs.count()
    assert {r.doc_id for r in simhash.keep_one(rows, shingle=3).collect()} == set(brute_components(prints))


@pytest.mark.parametrize("paired", [64, 2])
def test_links(spark, monkeypatch, paired):
    monkeypatch.setattr(simhash, "PAIRED", paired)  # buckets beyond it go through shared neighbours
    rng = random.Random(3)
    values = {rng.getrandbits(64) for _ in range(60)}
    for v in list(values)[:20]:
        for _ in range(6):
            v ^= 1 << rng.randrange(64)
            values.add(v ^ (1 << rng.randrange(64)) * rng.randrange(2))
    values = sorted(values)
    signed = lambda x: x - (1 << 64) * (x >> 63)
    edges = simhash.close_fingerprints(spark.createDataFrame([(signed(v),) for v in values], "fp long"))
    roots = {r.node: r.root for r in graph.components(edges).collect()}
    want = brute_components(values)
    groups = lambda f: {frozenset(i for i in range(len(values)) if f(i) == g) for g in {f(i) for i in range(len(values))}}
    assert groups(lambda i: roots.get(signed(values[i]), signed(values[i]))) == groups(lambda i: want[i])


def test_similar_groups(spark, none):
    base = [prose(220) for _ in range(12)]
    rows, near = [], []
    for g, t in enumerate(base):
        words = t.split()
        for c in range(4):
            own = list(words)
            for _ in range(min(c, 2)):  # clear of the threshold, at which the estimate has its error
                own[R.randrange(len(own))] = "changed"
            rows.append((len(rows), " ".join(own)))
            near.append(g)
    rows += [(100, None), (101, ""), (102, "one"), (103, "one"), (None, "one")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id): r.group for r in simhash_wide.similar_groups(df).collect()}
    assert all((got[i] == got[j]) == (near[i] == near[j]) for i in range(48) for j in range(48))
    kept = {r.doc_id for r in simhash_wide.keep_one(df).collect()}
    assert kept == {*range(0, 48, 4), 100, 102} and simhash_wide.keep_one(none).count() == 0


def test_near_dedup_links_by_pigeonring(spark):
    """Texts whose fingerprints are within two bits are one group, as op5 has it, though their shingle sets are less than 0.8 alike."""
    rng, rows = random.Random(8), []
    for g in range(20):
        again = " ".join(f"r{rng.randrange(10_000)}" for _ in range(7))
        for _ in range(3):
            rows.append((len(rows), f"{again} " * 120 + " ".join(f"u{rng.randrange(10_000)}" for _ in range(8))))
    rows += [(len(rows), None), (len(rows) + 1, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = {r.doc_id: r.component_id for r in simhash.near_duplicates(df).collect()}
    assert len(set(want.values())) < 30
    own = [set(h.tolist()) for h in simhash_wide._shingles([t for _, t in rows], 5)]
    assert any(want[i] == want[j] and len(own[i] & own[j]) < 0.8 * len(own[i] | own[j]) for i in range(60) for j in range(i))
    got = {r.doc_id: r.group for r in simhash_wide.similar_groups(df).collect()}
    assert all(got[i] == got[want[i]] for i in got)
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, df, "").collect()} <= set(want.values())


def test_texts_in_doubt_are_picked_where_they_stand(spark):
    """No row that is asked for is lost to the bitmap, and few others are picked."""
    keys = spark.range(5000).select(F.xxhash64("id").alias("key"))
    bitmap = simhash_wide._marks(keys, 5000)
    asked, others = (np.array([r.key for r in spark.range(*x).select(F.xxhash64("id").alias("key")).collect()]) for x in ((0, 5000), (5000, 25_000)))
    assert simhash_wide.marked(bitmap, asked).all() and simhash_wide.marked(bitmap, others).mean() < 0.05
    assert not simhash_wide.marked(simhash_wide._marks(keys.limit(0), 0), asked).any()


def test_rounds_of_components_write_few_files(spark, monkeypatch):
    """However many partitions a shuffle has: each file of a checkpoint costs the executor two processes."""
    rounds, cut = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: rounds.append(cut(df)) or rounds[-1])
    held = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        found = {r.node: r.root for r in graph.components(spark.createDataFrame([(i, i + 1) for i in range(50)], "a long, b long")).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert found == dict.fromkeys(range(51), 0) and len(rounds) > 2
    assert max(df.rdd.getNumPartitions() for df in rounds[1:]) <= spark.sparkContext.defaultParallelism


def test_workers_give_memory_back():
    """A worker that has gone through its batches keeps little of what it took: idle workers stand beside the next stage's."""
    code = """
import re
import numpy as np, pyarrow as pa
from corpusloom.llm.common import sub_batches
held = lambda: int(re.search(r"Anonymous:\\s+(\\d+)", open("/proc/self/smaps_rollup").read())[1]) / 1024
before, last = held(), []
for b in sub_batches(iter([pa.RecordBatch.from_pydict({"text": ["x"]})]), "text"):
    taken = [np.ones(100_000, np.uint8) for _ in range(2000)]
    last.append(np.ones(100_000, np.uint8))
    most = held()
    del taken
print(most - before, held() - before)
"""
    most, after = map(float, subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout.split())
    assert most > 150 and after < 50


@pytest.mark.parametrize("n_others", [0, 3000, 30_000])
def test_similar_groups_of_block_edits(spark, n_others):
    """Texts cut short, added to or with a block replaced: each meets its like, however many others there are."""
    rng = random.Random(5)
    words = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    shingles = lambda t: {tuple(t[i : i + 5]) for i in range(len(t) - 4)}
    pairs = []
    for g in range(120):
        t = words(300)
        n = rng.randrange(30, 55)
        pairs.append((t, [t[:-n], t + words(n), t[:100] + words(n // 2) + t[100 + n // 2 :]][g % 3]))
    jaccard = [len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b)) for a, b in pairs]
    assert 0.8 <= min(jaccard) < max(jaccard) <= 0.92
    rows = [(2 * g + i, " ".join(t)) for g, p in enumerate(pairs) for i, t in enumerate(p)] + [(1000 + i, " ".join(words(60))) for i in range(n_others)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for a, b in pairs:  # exact, before any estimate
        first = [simhash_wide.prefix(next(simhash_wide._shingles([" ".join(t)], 5)), np.empty(0, np.uint64), 0.8) for t in (a, b)]
        assert np.isin(*first).any()
    got = {r.doc_id: r.group for r in simhash_wide.similar_groups(df).collect()}
    assert sum(got[2 * g] == got[2 * g + 1] for g in range(120)) >= 0.99 * 120  # the shingles decide near the threshold
    assert len({got[r[0]] for r in rows[240:]}) == n_others


@pytest.mark.parametrize("room", [20_000, 20, 6])
def test_large_buckets_lose_nothing(spark, room):
    """Variants of one template, many near each other and some only to one other, against all pairs."""
    rng = random.Random(11)
    words = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    template, texts = words(200), []
    for g in range(40):
        own = list(template)
        own[130:200] = words(rng.randrange(0, 70))  # the farther ones aren't near the template
        for _ in range(1 + g % 4):
            at = rng.randrange(120)
            texts.append(" ".join([*own[:at], *words(rng.randrange(1, 5)), *own[at + 3 :]]))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    own, root = [set(h.tolist()) for h in simhash_wide._shingles(texts, 5)], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(own[i] & own[j]) >= 0.8 * len(own[i] | own[j]):
                root = [root[i] if r == root[j] else r for r in root]
    assert 5 < len(set(root)) < 40 and max(collections.Counter(root).values()) > 30
    got = {r.doc_id: r.group for r in simhash_wide.similar_groups(df, bucket_rows=room).collect()}
    assert all((got[i] == got[j]) == (root[i] == root[j]) for i in range(len(texts)) for j in range(i))


@pytest.mark.parametrize("room", [20_000, 1])
def test_families_at_the_threshold(spark, room):
    """60 families of 4 texts of 400 words, 4 changed in each: two of a family are 0.82 alike."""
    rng = random.Random(2)
    words = lambda n: [f"w{rng.randrange(20_000)}" for _ in range(n)]
    rows = []
    for g in range(60):
        t = words(400)
        for c in range(4):
            own = list(t)
            for at in rng.sample(range(5, 395), 4):
                own[at] = f"x{rng.randrange(20_000)}"
            rows.append((4 * g + c, " ".join(own)))
    got = {r.doc_id: r.group for r in simhash_wide.similar_groups(spark.createDataFrame(rows, "doc_id long, text string"), bucket_rows=room).collect()}
    assert len(set(got.values())) == 60 and all(got[i] == got[i - i % 4] for i in got)


# --- 6 ---


def test_sharding(spark, docs, none, tmp_path):
    got = sharding.assign_shards(docs, n_shards=3, bucket_bytes=20_000).collect()
    assert len(got) == docs.count() and sharding.assign_shards(none).count() == 0
    by = dict(enumerate(TEXTS)) | {None: "null id"}
    for r in got:
        raw = (by[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law) == (len(raw) + 1, zlib.crc32(raw), "key") and r.grown_shard in (r.shard, 3)
    for s in range(3):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    grown = {r.doc_id: r.shard for r in sharding.assign_shards(docs, n_shards=4).collect()}
    assert all(grown[r.doc_id] == r.grown_shard for r in got)
    again = sharding.assign_shards(docs.repartition(5), n_shards=3, bucket_bytes=20_000).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    sharding.write_shards(docs, str(tmp_path / "s"), n_shards=3)
    assert spark.read.parquet(str(tmp_path / "s")).count() == docs.count()


def test_shards_are_written(spark, docs, tmp_path):
    """Whole rows are permuted and written, a bucket a file, and what op6 tells stands in the files."""
    import glob

    import pyarrow.parquet as pq

    path = str(tmp_path / "s")
    told = sharding.assign_shards(docs, n_shards=3, bucket_bytes=4_000, path=path).collect()
    per_shard, rows, moved = sharding.bucket_count(sum(len((t or "").encode()) + 1 for t in (r.text for r in docs.collect())), 3, 4_000), [], 0
    assert per_shard > 3
    files = glob.glob(f"{path}/__shard=*/*.parquet")
    buckets = []
    for f in files:
        got = pq.ParquetFile(f).read().to_pylist()
        shard = int(f.split("__shard=")[1].split("/")[0])
        assert [r["__place"] for r in got] == list(range(len(got))) and len({r["__bucket"] for r in got}) == 1
        buckets.append((shard, got[0]["__bucket"]))
        key = [(r["doc_id"] is not None, r["doc_id"] or 0) for r in got]
        moved += key != sorted(key)
        rows += [(shard, r) for r in got]
    assert len(set(buckets)) == len(files) and moved
    whole = lambda r: str([r[c] for c in docs.columns])
    assert sorted(whole(r) for _, r in rows) == sorted(whole(r) for r in docs.collect())
    base, want = collections.Counter(), []
    for b in sorted(buckets):
        own = [r for s, r in rows if (s, r["__bucket"]) == b]
        want += [(str(r["doc_id"]), zlib.crc32((r["text"] or "").encode()), b[0], base[b[0]] + r["__place"]) for r in own]
        base[b[0]] += len(own)
    assert sorted((str(r.doc_id), r.text_crc32, r.shard, r.slot) for r in told) == sorted(want)


# --- 7 ---


def test_language_id(spark, none):
    sample = {"en": "the cat sat on the mat and they were here with this thing", "fr": "le chat est dans la maison avec nous pour toujours cette fois", "de": "der hund ist nicht in dem haus und wir sind auch noch hier"}
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(sample[k].split()) for _ in range(30)), k) for i, k in enumerate(rng.choice("en fr de".split()) for _ in range(240))]
    rows += [(1000, None, "en"), (1001, "123 !!", "en"), (1002, "", None), (1003, "the cat " * 9000, None), (None, "le chat est dans", None)]
    got = {r.doc_id: r for r in crf_lang.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert len(got) == len(rows) and [got[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3
    held = [(got[i].lang_pred, k) for i, _, k in rows[:240] if got[i].held_out]
    assert sum(a == b for a, b in held) >= 0.95 * len(held) and got[1003].lang_pred == "en" and got[None].lang_pred == "fr"
    assert all(0 <= r.score <= 1 for r in got.values()) and all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in range(240))
    assert crf_lang.identify(none).count() == 0


def test_posteriors():
    rng = np.random.default_rng(0)
    w = crf_lang.featurise(["a b c d e " * 30, "", "xy zz", None])
    e, t = crf_lang.emissions(rng.normal(size=(4 * crf_lang.ROOM, 3)).astype("f4"), w), rng.normal(size=(3, 3))
    p = crf_lang.posteriors(e, w.first, t)
    for lo, hi in zip(w.first[:-1], w.first[1:]):
        ahead, back = [], np.ones(3)
        for i in range(lo, hi):
            ahead.append(((ahead[-1] / ahead[-1].sum()) if ahead else np.full(3, 1 / 3)) @ np.exp(t) * np.exp(e[i]))
        for i in range(hi - 1, lo - 1, -1):
            own = ahead[i - lo] * back
            assert np.allclose(own / own.sum(), p[i], atol=1e-6)
            back = np.exp(t) @ (np.exp(e[i]) * back)
            back /= back.sum()


# --- 8 ---


def test_nearest(spark, none):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1500, 16)).astype(np.float32)
    x[700:760] = x[5]  # many equal vectors
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] * 16), (2003, [None] * 16), (2004, [float("inf")] * 16), (2005, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = vamana.nearest(df, df.filter("vec_id % 20 = 0"), shard_bytes=170_000, block_queries=16, task_queries=30).collect()
    by = collections.defaultdict(list)
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        by[r.query_id].append((r.vec_id, r.score))
    assert set(by) == set(range(0, 1500, 20))
    exact, hit = x.astype(float) @ x.astype(float).T, 0
    for q, found in by.items():
        best = sorted((i for i in range(1500) if i != q), key=lambda i: (-exact[q, i], i))[:20]
        hit += len({v for v, _ in found} & set(best))
        assert len(found) == 20 and q not in {v for v, _ in found}
        assert found == sorted(found, key=lambda f: (-f[1], f[0])) and all(s == pytest.approx(exact[q, v], abs=1e-9) for v, s in found)
    assert hit >= 0.95 * 20 * len(by)
    equal = [5, *range(700, 760)]
    for q in (700, 720, 740):  # of equal vectors the smallest ids, in order
        mine = [v for v, _ in by[q] if v in equal]
        assert mine and mine == [v for v in equal if v != q][: len(mine)]
    assert vamana.nearest(df.limit(0), df).count() == 0


# --- 9 ---


def test_lines(spark, docs, none, monkeypatch):
    rows = [(i, f"own line {i}\nShared  by all\n\n shared BY few{i % 2}\n", f"s{i % 12}") for i in range(60)] + [(99, "copy\nof many", f"s{i % 12}") for i in range(40)] + [(200, None, "s1"), (201, "", None), (202, "Shared  by all", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("n_lines", F.lit("taken"))
    got = linespread.remove_boilerplate(df, min_sites=8).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id < 60:
            assert r.text == f"own line {r.doc_id}\n\n shared BY few{r.doc_id % 2}\n" and (r.n_lines, r.n_removed) == (5, 1)
    assert {r.text for r in got if r.doc_id == 99} == {"copy\nof many"}
    assert {r.doc_id: r.text for r in got if r.doc_id >= 200} == {200: None, 201: "", 202: ""}
    monkeypatch.setattr(linespread, "SENT_LINES", 0)  # the set joined by a shuffle gives the same
    monkeypatch.setattr(linespread, "SENT_UNSURE", -1)
    other = linespread.remove_boilerplate(df, min_sites=8).collect()
    assert sorted(map(str, other)) == sorted(map(str, got))
    assert linespread.remove_boilerplate(none).count() == 0 and linespread.remove_boilerplate(docs.select("doc_id", "text", "source")).count() == docs.count()


# --- 10 ---


def test_urls(spark):
    urls = [None, "", "nothing", "http://a.net/x", "http://NET", "http://x.example.net/en/a?b", "HTTP://example.com/de/", "http://notexample.com/de/", "https://w.org/fr/#x", "http://a.net?x/", "http://example.com/de", "http://net/", "http://a.net/x"]
    rules = list(urlfilter.DEFAULT_RULES)
    got = urlfilter.filter_urls(spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string"), spark.createDataFrame(rules, "host string, path string, action string")).collect()
    assert len(got) == len(urls)
    for r in got:
        rest = (urls[r.page_id] or "").partition("://")[2]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = host.lower()
        fit = [(len(h + p), h + p, a) for h, p, a in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, *(max(fit)[1:] if fit else (None, "allow")))
    assert urlfilter.filter_urls(spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string"), spark.createDataFrame([], "host string, path string, action string")).first().verdict == "allow"


def test_span_hash_is_free_of_place():
    texts = ["alpha beta", "gamma alpha", " beta  alpha"]
    seen = {}
    for pad in (b"", b"x" * 3, b"word " * 300_000):
        raw = pad + b" " + " ".join(texts).encode() + b" "
        buf = np.frombuffer(raw, np.uint8)
        s, e = common.word_spans(buf)
        for a, b, h in zip(s[-6:], e[-6:], common.span_hash(buf, s, e)[-6:]):
            assert seen.setdefault(raw[a:b], h) == h
    assert len(set(seen.values())) == len(seen) == 3


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = docs
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before, got = got, stage(spark, got, SF).cache()
        if i < 4:
            assert got.columns == docs.columns and 0.5 * before.count() <= got.count() <= before.count()
            assert not got.filter("n_chars <> length(text)").count()
    assert got.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 2048").count() == 0
