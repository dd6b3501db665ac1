"""Operators on texts without SQL, against plain Python over whole tables."""

import re

from pyspark.sql import functions as F

from corpusloom.operators import chunks, hygiene, similarity, structure
from corpusloom.plans import catalogue
from tests.conftest import SF


def fixed(text):
    """Spaces squeezed, none before punctuation, one after it and after a dot, as the checks say."""
    text = re.sub(" {2,}", " ", text)
    text = re.sub("(?<![,;:]) +([,.;:!?])", r"\1", text)
    out = []
    for i, c in enumerate(text):
        after = text[i + 1 : i + 2]
        out.append(c)
        if c in ",;:!?" and after and not after.isspace() and after not in "])}>\"'”’»,.;:!?…":
            digits = c in ",;:" and after.isdigit() and (i == 0 or text[i - 1].isdigit())
            if not digits and not (c == ":" and after in "/\\"):
                out.append(" ")
    return "".join(out)


def test_hygiene_fix_on_documents(spark):
    rows = catalogue.dirty(spark, SF).withColumn("fixed", hygiene.fix(F.col("text"))).collect()
    assert len(rows) > 100
    for r in rows:
        assert r.fixed == (None if r.text is None else fixed(r.text)), r.doc_id


def test_chunk_plan_on_documents(spark):
    items = catalogue.lines(spark, SF).withColumn("weight", F.size(similarity.words(F.col("text"))).cast("long"))
    by = {}
    for r in items.collect():
        by.setdefault(r.doc, []).append((r.idx, r.weight))
    got = {}
    for r in chunks.plan(items, 4).collect():
        got.setdefault(r.doc, []).append((r.chunk, r.first, r.last, r.weight))
    assert set(got) == set(by)
    for doc, lines in by.items():
        lines.sort()
        target, at, held, want = sum(w for _, w in lines) / 4, 0, [], []
        for n, (idx, w) in enumerate(lines):
            held.append((idx, w))
            left = len(lines) - n - 1
            if at < 3 and (sum(x for _, x in held) >= target or left <= 3 - at):
                want.append((at, held[0][0], held[-1][0], sum(x for _, x in held)))
                at, held = at + 1, []
        if held:
            want.append((at, held[0][0], held[-1][0], sum(x for _, x in held)))
        assert sorted(got[doc]) == want, doc


def test_sketches_on_documents(spark):
    import zlib

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.select("text", similarity.sketch(similarity.words(F.col("text")), 5, 64).alias("s")).collect()
    for r in rows:
        w = re.findall("[0-9A-Za-zА-Яа-яЁё_]+", r.text or "")
        grams = [" ".join(w[i : i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else [" ".join(w)]
        assert set(r.s) == set(sorted(zlib.crc32(g.encode()) for g in grams)[:64])


def test_similar_pairs_on_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: frozenset(" ".join(w[i : i + 5]) for i in range(len(w) - 4)) for r in docs.collect() for w in [re.findall("[0-9A-Za-zА-Яа-яЁё_]+", r.text or "")] if len(w) >= 5}
    least = {}
    for i in sorted(texts, reverse=True):
        least[texts[i]] = i
    ids = sorted(least.values())
    want = {(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if len(texts[a] & texts[b]) >= 0.5 * len(texts[a] | texts[b])}
    assert {(r.a, r.b) for r in similarity.similar_pairs(docs, 0.5).collect()} == want


def test_long_chain_of_styles(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(80)], "src long, dst long")
    assert structure.closure(spark.createDataFrame([(0,)], "id long"), edges).count() == 81


def test_near_dupe_pairs_are_found_once(spark):
    """Pairs and their documents' sections are held; what judges them reads no documents anew."""
    from corpusloom.plans import catalogue
    from tests.conftest import SF

    plan = catalogue.queries()["near_dupe_pairs"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Scan ExistingRDD" in plan and "FileScan" not in plan
