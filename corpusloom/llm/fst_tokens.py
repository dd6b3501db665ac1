"""Token counts of byte-level BPE by a deterministic transducer.

The tokenizer (the pattern that splits texts and the merges inside a word) is compiled into a transducer over
characters whose transitions carry the change of the token count; a text's tokens are the sum along its path.

Inside a word the state follows from two facts about merges by rank: two neighbouring tokens stand in an encoding
if they are the encoding of their two strings joined, and every prefix has exactly one last token. So a state holds,
for each place from which a token may still come to an end, its trie node, the last token before the place and the
count there relative to now. States are determinised as texts need them and kept by the worker; a full table is
started anew. The lookahead for white space is a character held back in the state.

Characters beyond the first DIRECT ones that a worker meets are read byte by byte: the first byte carries the
character's kind, the others go on with it. So the alphabet is bounded and no text leaves the method.

Texts are joined and cut into chunks of equal size. A chunk's map from entry state to exit state and counts is held by
its values at the entries asked of it, first the start state, for all chunks side by side. Then neighbouring maps are
composed pairwise, in as many rounds as the number of chunks has binary digits, all pairs of a round at once (a parallel
scan): the right map is asked at the left one's exit, by running from there until the path meets the known one, from
where on both values agree. After the last round each chunk is known from its true entry, and counts are sums over
each text's stretch.

Null text: empty, no tokens. A special token's string in a text is one token, as the library's default has it.
Repeated rows are counted each. Empty input: no rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import small_batches, sub_batches

START, LETTER, DIGIT, OTHER, BLANK, QUOTE, QUOTE_HELD, GOES_ON = range(8)
#: Entries of the transition table a worker keeps (5 bytes each), characters with a symbol of their own, symbols of a chunk, neighbours of tokens kept.
TABLE_ENTRIES, DIRECT, CHUNK, NEIGHBOURS = 40_000_000, 1024, 512, 2_000_000


def byte_letters() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: a printable byte is itself, others follow from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merges:
    """Encoding of a word's bytes by ranks, and which tokens may be neighbours."""

    def __init__(self, spec: dict) -> None:
        letters = byte_letters()
        vocab = {bytes(letters[c] for c in t): i for t, i in spec["model"]["vocab"].items() if all(c in letters for c in t)}
        self.bytes = {i: t for t, i in vocab.items()}
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        as_bytes = lambda t: bytes(letters[c] for c in t)
        self.rank = {(vocab[as_bytes(a)], vocab[as_bytes(b)]): (r, vocab[as_bytes(a + b)]) for r, (a, b) in enumerate(pairs)}
        self.single = [vocab[bytes([b])] for b in range(256)]
        self.child: dict[int, int] = {}  # node * 256 + byte -> node
        self.token = [-1]
        for t, i in vocab.items():
            node = 0
            for b in t:
                key = node << 8 | b
                if key not in self.child:
                    self.child[key] = len(self.token)
                    self.token.append(-1)
                node = self.child[key]
            self.token[node] = i
        self.inner = {k >> 8 for k in self.child}  # nodes that go on
        self.known: dict[tuple[int, int], bool] = {}

    def encode(self, word: bytes) -> list[int]:
        out = [self.single[b] for b in word]
        while len(out) > 1:
            best = min((self.rank.get(p, (1 << 60, 0)) + (i,) for i, p in enumerate(zip(out, out[1:]))), key=lambda x: (x[0], x[2]))
            if best[0] == 1 << 60:
                break
            out[best[2] : best[2] + 2] = [best[1]]
        return out

    def neighbours(self, a: int, b: int) -> bool:
        """May token b follow a? a is -1 at a word's start."""
        if (a, b) not in self.known:
            if len(self.known) >= NEIGHBOURS:
                self.known.clear()
            self.known[a, b] = self.encode(self.bytes[b]) == [b] if a < 0 else self.encode(self.bytes[a] + self.bytes[b]) == [a, b]
        return self.known[a, b]


class Transducer:
    def __init__(self, path: str) -> None:
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.merges = Merges(spec)
        self.patterns = [(LETTER, regex.compile(r"\p{L}")), (DIGIT, regex.compile(r"\p{N}")), (BLANK, regex.compile(r"\p{White_Space}"))]
        self.direct = 0  # characters with a symbol of their own
        self.symbol = np.zeros(0x110000, np.int32)  # of a character; 0: none yet, -1: read by bytes
        # of each symbol: the character (-1: end of text, -2: a part of one), its bytes, its kind; symbol 1 ends a text
        self.chars, self.bytes, self.kinds = [-1, -1], [b"", b""], [START, START]
        self.parts: dict[tuple[int, int], int] = {}  # (kind, byte) -> symbol
        self._clear(64)

    def _clear(self, width: int) -> None:
        self.width = width
        self.room = TABLE_ENTRIES // width
        rows = min(4096, self.room)
        self.next, self.weight = np.full(rows * width, -1, np.int32), np.zeros(rows * width, np.int8)
        self.words: dict[tuple, int] = {}  # states inside a word
        self.word_states: list[tuple] = []
        self.word_steps: dict[tuple[int, bytes], tuple[int, int]] = {}
        self.ids: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.fresh = self._word(((0, -1, 0),))
        self._state((START, self.fresh, -1))

    def _word(self, key: tuple) -> int:
        if key not in self.words:
            self.words[key] = len(self.word_states)
            self.word_states.append(key)
        return self.words[key]

    def _state(self, key: tuple) -> int:
        if key not in self.ids:
            self.ids[key] = len(self.states)
            self.states.append(key)
            if len(self.states) * self.width > len(self.next):
                more = max(len(self.next) // 4 // self.width, 1) * self.width
                self.next = np.concatenate((self.next, np.full(more, -1, np.int32)))
                self.weight = np.concatenate((self.weight, np.zeros(more, np.int8)))
        return self.ids[key]

    def _step(self, word: int, data: bytes) -> tuple[int, int]:
        """Inside a word: the state after some bytes, and how the count changes."""
        if (word, data) not in self.word_steps:
            m, places, change = self.merges, self.word_states[word], 0
            for b in data:
                last = delta = None
                on = []
                for node, before, count in places:
                    node = m.child.get(node << 8 | b, -1)
                    if node < 0:
                        continue
                    if last is None and m.token[node] >= 0 and m.neighbours(before, m.token[node]):
                        last, delta = m.token[node], count + 1
                    if node in m.inner:
                        on.append((node, before, count))
                places = (*((n, t, c - delta) for n, t, c in on), (0, last, 0))
                change += delta
            self.word_steps[word, data] = self._word(places), change
        return self.word_steps[word, data]

    def _begin(self, char: int, data: bytes, kind: int) -> tuple[tuple, int]:
        """A word's first character."""
        if kind == BLANK:
            return (BLANK, self.fresh, char), 0
        word, change = self._step(self.fresh, data)
        return (QUOTE if char == 0x27 else kind, word, -1), change

    def _follow(self, state: tuple, char: int, data: bytes, kind: int) -> tuple[tuple, int]:
        at, word, held = state
        if kind == GOES_ON:  # a byte of the character before: the state after its first one is inside a word
            word, change = self._step(word, data)
            return (at, word, held), change
        if at == START:
            return ((START, self.fresh, -1), 0) if char == -1 else self._begin(char, data, kind)
        if at == BLANK:
            if char == -1 or kind == BLANK:  # the blank held back belongs to the run
                word, change = self._step(word, chr(held).encode())
                return ((START, self.fresh, -1) if char == -1 else (BLANK, word, char)), change
            word, change = self._step(self.fresh, chr(held).encode())
            if held == 0x20:
                word, more = self._step(word, data)
                return (kind, word, -1), change + more
            then, more = self._begin(char, data, kind)
            return then, change + more
        if at == QUOTE_HELD:
            if (held, char) in ((0x72, 0x65), (0x76, 0x65), (0x6C, 0x6C)):  # 're 've 'll
                word, change = self._step(word, chr(held).encode())
                _, more = self._step(word, data)
                return (START, self.fresh, -1), change + more
            then, change = self._begin(held, chr(held).encode(), LETTER)
            then, more = self._follow(then, char, data, kind)
            return then, change + more
        if char == -1:
            return (START, self.fresh, -1), 0
        if at == QUOTE:
            if char > 0 and chr(char) in "stmd":
                return (START, self.fresh, -1), self._step(word, data)[1]
            if char > 0 and chr(char) in "rvl":
                return (QUOTE_HELD, word, char), 0
            at = OTHER
        if at == kind:
            word, change = self._step(word, data)
            return (at, word, -1), change
        return self._begin(char, data, kind)

    def _compile(self, cells: np.ndarray) -> None:
        for cell in np.unique(cells).tolist():
            s, c = divmod(cell, self.width)
            then, change = self._follow(self.states[s], self.chars[c], self.bytes[c], self.kinds[c])
            to = self._state(then)
            self.next[cell], self.weight[cell] = to, change

    def _add(self, char: int, data: bytes, kind: int) -> int:
        self.chars.append(char)
        self.bytes.append(data)
        self.kinds.append(kind)
        return len(self.chars) - 1

    def _part(self, kind: int, byte: int) -> int:
        if (kind, byte) not in self.parts:
            self.parts[kind, byte] = self._add(-2, bytes([byte]), kind)
        return self.parts[kind, byte]

    def _symbols(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The characters' symbols, and where each character's stand."""
        found = self.symbol[points]
        kind_of = lambda c: next((k for k, r in self.patterns if r.match(c)), OTHER)
        for p in np.unique(points[found == 0]).tolist():
            c = chr(p)
            kind = kind_of(c)
            if self.direct < DIRECT or kind == BLANK or p < 128:
                self.symbol[p] = self._add(p, c.encode(), kind)
                self.direct += 1
            else:
                self.symbol[p] = -1
        found = self.symbol[points]
        size = np.ones(len(points), np.int64)
        rare = np.flatnonzero(found < 0)
        if len(rare):
            kinds, place = np.unique(points[rare], return_inverse=True)
            coded = [chr(p).encode() for p in kinds.tolist()]
            width = np.array([len(c) for c in coded])
            table = np.zeros((len(coded), 4), np.int32)
            for i, (p, c) in enumerate(zip(kinds.tolist(), coded)):
                table[i, : len(c)] = [self._part(kind_of(chr(p)) if j == 0 else GOES_ON, b) for j, b in enumerate(c)]
            size[rare] = width[place]
        at = np.cumsum(size) - size
        out = np.zeros(int(size.sum()), np.int32)
        out[at] = found
        for j in range(4 if len(rare) else 0):
            own = size[rare] > j
            out[at[rare[own]] + j] = table[place[own], j]
        if len(self.chars) > self.width:
            self._clear(len(self.chars) + 64)
        return out, at

    def _walk(self, symbols: np.ndarray, state: np.ndarray, path: np.ndarray, weight: np.ndarray) -> None:
        for i in range(len(symbols)):
            cell = state * self.width + symbols[i]
            state = self.next[cell]
            if state.min() < 0:
                self._compile(cell[state < 0])
                state = self.next[cell]
            path[i], weight[i] = state, self.weight[cell]

    def _rerun(self, lanes: np.ndarray, lane: np.ndarray, state: np.ndarray, path: np.ndarray, weight: np.ndarray) -> None:
        """The chunks from other entries, until their paths meet the known ones."""
        for i in range(CHUNK if len(lane) else 0):
            cell = state * self.width + lanes[i, lane]
            state = self.next[cell]
            if (state < 0).any():
                self._compile(cell[state < 0])
                state = self.next[cell]
            weight[i, lane] = self.weight[cell]
            apart = path[i, lane] != state
            path[i, lane] = state
            lane, state = lane[apart], state[apart]
            if not len(lane):
                break

    def _counts(self, symbols: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Tokens of each stretch symbols[..end]."""
        if len(self.states) > self.room:
            self._clear(self.width)
        n = -(-len(symbols) // CHUNK)
        lanes = np.ones((n, CHUNK), np.int32)
        lanes.ravel()[: len(symbols)] = symbols
        lanes = np.ascontiguousarray(lanes.T)
        path, weight = np.empty(lanes.shape, np.int32), np.empty(lanes.shape, np.int8)
        self._walk(lanes, np.zeros(n, np.int32), path, weight)
        entry = np.zeros(n, np.int32)  # the start state, at which all maps are known
        width = 1  # chunks of a map
        while width < n:
            # the right one of each pair is asked at the left one's exit; where a chunk's exit changes, so is the next
            lane = np.arange(width, n, 2 * width)
            stop = np.minimum(lane + width, n)
            while len(lane):
                true = path[-1, lane - 1]
                apart = true != entry[lane]
                lane, stop, true = lane[apart], stop[apart], true[apart]
                entry[lane] = true
                before = path[-1, lane]
                self._rerun(lanes, lane, true, path, weight)
                on = (path[-1, lane] != before) & (lane + 1 < stop)
                lane, stop = lane[on] + 1, stop[on]
            width *= 2
        flat = weight.T.ravel()[: len(symbols)]
        return np.add.reduceat(flat, np.concatenate(([0], ends[:-1] + 1)), dtype=np.int64)

    def count(self, texts: list) -> np.ndarray:
        texts = [t or "" for t in texts]
        extra = np.zeros(len(texts), np.int64)
        parts, owner = [], []
        for i, t in enumerate(texts):
            pieces = [t]
            for s in self.special:
                if s in t:
                    pieces = [y for x in pieces for y in x.split(s)]
            extra[i] = len(pieces) - 1
            parts += pieces
            owner += [i] * len(pieces)
        points = np.frombuffer("\0".join(parts).encode("utf-32-le", "replace"), np.uint32)
        ends = np.cumsum(np.array([len(p) + 1 for p in parts])) - 1
        symbols, at = self._symbols(points)
        ends = np.append(at[ends[:-1]], len(symbols)).astype(np.int64)  # the last text has no separator yet
        symbols = np.append(symbols, np.int32(1))
        symbols[ends] = 1
        found = self._counts(symbols, ends)
        np.add.at(extra, np.array(owner), found)
        return extra


_LOADED: dict[str, Transducer] = {}  # of a worker, over its tasks


def count_tokens(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _LOADED.get(tokenizer_path) or _LOADED.setdefault(tokenizer_path, Transducer(tokenizer_path))
        for b in sub_batches(batches, "text"):
            n = machine.count(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n)], names=["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    return small_batches(rows).mapInArrow(run, f"doc_id {id_type}, n_bytes bigint, n_tokens bigint").withColumn("over_limit", F.col("n_tokens") > limit)
