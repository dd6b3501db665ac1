"""Phrase replacement by lemma with inflection, and sentence bounds, over a pluggable lexicon (form, lemma, grammemes)."""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile("[А-Яа-яЁё]+")
# Abbreviations whose dot doesn't end a sentence.
ABBREVIATIONS = set("абз вл г гг д др им кв корп куб млн млрд п пп подп пос пр рис с см ст стр табл т тыс ул ч".split())
#: What is dropped from the wanted grammar, step by step, until the lexicon has a form.
RELAX = ((), ("anim", "inan"), ("masc", "femn", "neut"), ("sing", "plur"))


def fold(word: str) -> str:
    return word.lower().replace("ё", "е")


@dataclass
class Lexicon:
    entries: list[tuple[str, str, tuple[str, ...]]]

    def __post_init__(self) -> None:
        self.by_form: dict[str, tuple[str, frozenset]] = {}
        self.by_lemma: dict[str, list[tuple[str, frozenset]]] = {}
        for form, lemma, grammemes in self.entries:
            self.by_form.setdefault(fold(form), (fold(lemma), frozenset(grammemes)))
            self.by_lemma.setdefault(fold(lemma), []).append((form, frozenset(grammemes)))

    def lemma(self, word: str) -> str:
        return self.by_form.get(fold(word), (fold(word), frozenset()))[0]

    def inflect(self, word: str, like: str) -> str:
        """The word in the grammar of `like`, wants given up step by step; in the word's own case of letters."""
        wanted = self.by_form.get(fold(like), ("", frozenset()))[1]
        forms = self.by_lemma.get(self.lemma(word), [])
        drop: set[str] = set()
        for step in RELAX:
            drop |= set(step)
            for form, has in forms:
                if wanted and wanted - drop <= has | drop:
                    return form.upper() if word.isupper() and len(word) > 1 else form[:1].upper() + form[1:] if word[:1].isupper() else form
        return word


def phrase_spans(text: str, find: list[str], phrase: str, lexicon: Lexicon, mode: str = "replace", separator: str = ", ") -> list[tuple[int, int, str]]:
    """(start, end, new) of every run of words with the lemmas `find`, which the phrase, inflected as the run's last word, replaces or follows; none where it is there."""
    words, out, i = list(WORD.finditer(text)), [], 0
    lemmas = [lexicon.lemma(w[0]) for w in words]
    same = lambda a, b: fold(a) == fold(b)
    while i + len(find) <= len(words):
        if lemmas[i : i + len(find)] != find:
            i += 1
            continue
        start, end = words[i].start(), words[i + len(find) - 1].end()
        new = WORD.sub(lambda m: lexicon.inflect(m[0], words[i + len(find) - 1][0]), phrase)
        if mode == "replace" and text[start].isupper():
            new = new[:1].upper() + new[1:]
        done = same(text[max(0, end - len(new)) : end], new) or mode == "append" and same(text[end : end + len(separator + new)], separator + new)
        if not done:
            out.append((start, end, text[start:end] + separator + new if mode == "append" else new))
        i += len(find)
    return out


def replace_phrase(text: str, find: list[str], phrase: str, lexicon: Lexicon, mode: str = "replace", separator: str = ", ") -> tuple[str, int]:
    """The text with its phrase_spans put in, and their number."""
    spans, out, at = phrase_spans(text, find, phrase, lexicon, mode, separator), [], 0
    for start, end, new in spans:
        out += [text[at:start], new]
        at = end
    return "".join([*out, text[at:]]), len(spans)


def gathered(lexicon: DataFrame, max_forms: int = 2_000_000) -> Lexicon:
    """The lexicon in the driver, if it has no more forms than that."""
    rows = lexicon.limit(max_forms + 1).collect()
    if len(rows) > max_forms:
        raise ValueError(f"the lexicon has over {max_forms} forms")
    return Lexicon([(r[0], r[1], tuple(r[2])) for r in rows])


def replace_in(nodes: DataFrame, find: str, phrase: str, lexicon: DataFrame, text_col: str = "text", mode: str = "replace", separator: str = ", ", max_forms: int = 2_000_000) -> DataFrame:
    """nodes with `after` and `hits`. The lexicon is sent to the executors; its size is checked first."""
    lex = gathered(lexicon, max_forms)
    wanted = [lex.lemma(w) for w in WORD.findall(find)]
    sent = nodes.sparkSession.sparkContext.broadcast(lex)

    @F.pandas_udf("after string, hits int")
    def run(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(None, 0) if t is None else replace_phrase(t, wanted, phrase, sent.value, mode, separator) for t in text], columns=["after", "hits"])

    return nodes.withColumn("__m", run(F.col(text_col))).select(*nodes.columns, "__m.after", "__m.hits")


def ends_sentence(text: str, dot: int) -> bool:
    before, after = text[:dot].rstrip(), text[dot + 1 :].lstrip()
    if before[-1:].isdigit() and after[:1].isdigit():
        return False
    word = re.search("[A-Za-zА-Яа-яЁё]*$", text[:dot])[0]
    return not (fold(word) in ABBREVIATIONS or len(word) == 1 and word.isupper() or after[:1].islower())


def sentence_bounds(text: str, start: int, end: int) -> tuple[int, int]:
    """Of the sentence around text[start:end]."""
    dots = [m.start() for m in re.finditer(r"\.", text)]
    left = max((d + 1 for d in dots if d < start and ends_sentence(text, d)), default=0)
    while left < len(text) and text[left].isspace():
        left += 1
    return left, min((d + 1 for d in dots if d >= max(start, end) and ends_sentence(text, d)), default=len(text))


def put_in_runs(runs: list[str], spans: list[tuple[int, int, str]]) -> list[str]:
    """Replacements in a text of several runs: new text goes to the run where the span begins."""
    out, edges = list(runs), [0]
    for r in runs:
        edges.append(edges[-1] + len(r))
    for start, end, new in sorted(spans, reverse=True):
        for i in range(len(runs) - 1, -1, -1):
            lo, hi = max(start, edges[i]), min(end, edges[i + 1])
            if lo < hi:
                put = new if edges[i] <= start < edges[i + 1] else ""
                out[i] = out[i][: lo - edges[i]] + put + out[i][hi - edges[i] :]
    return out
