import difflib

import pandas as pd
from pyspark.sql import functions as F

from corpusloom import registry
from corpusloom.operators import address, chunks, findings, inspector, morph, paragraphs, reconcile, similarity, structure, tables


def test_reconcile_quirks(spark):
    a = spark.createDataFrame([("К 1", "x"), ("к 1", "y"), ("", "z"), (None, "z"), ("2", "Ё")], "id string, v string")
    b = spark.createDataFrame([("К  1", "x"), ("2", "Е"), ("3", None)], "id string, v string")
    got = {(r.key, r.status, r.n_a, r.n_b) for r in reconcile.reconcile(a, b, ["id"], ["v"], ["v"]).collect()}
    assert got == {("к 1", "exact", 2, 1), ("2", "mismatched", 1, 1), ("3", "only_b", None, 1)}
    assert reconcile.auto_key(["Имя", "Код объекта"], ["код объекта", "имя"]) == ["Код объекта"] and reconcile.auto_key(["a"], ["b"]) == []


def test_similarity(spark):
    import re
    import zlib

    texts = ["раз два три четыре пять шесть", "раз два", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").orderBy("i").withColumn("w", similarity.words(F.col("text")))
    got = [(sorted(r.a), sorted(r.b)) for r in df.select(similarity.section_shingles(F.col("w")).alias("a"), similarity.sketch(F.col("w"), 5, 1).alias("b")).collect()]
    crc = lambda s: zlib.crc32(s.encode())
    w = re.findall(r"\w+", texts[0])
    grams = sorted(crc(" ".join(w[i : i + 5])) for i in range(2))
    assert got == [(grams, grams[:1]), (sorted(map(crc, ["раз", "два"])), [crc("раз два")]), ([], [0]), ([], [0])]
    assert [r[0] for r in spark.range(1).select(similarity.zone_codes(F.lit("зоны (ж-1), (Ж – 1) и (од 2.1)"))).collect()] == [["Ж1", "ОД2.1"]]


def test_sections_and_diffs():
    a = pd.DataFrame({"ordinal": [1, 2, 3], "title": ["Общие", "Нормы", "Старое"], "shingles": [[1, 2], [3, 4], [9]]})
    b = pd.DataFrame({"ordinal": [1, 2, 3], "title": ["Нормы", "Общие", "Новое"], "shingles": [[3, 4], [1, 2], [7]]})
    got = similarity.match_sections(a, b, 0.5)
    assert got[0][:2] == (1, 2) and got[1][:2] == (2, 1) and got[0][3] == "moved" and [m[3] for m in got[2:]] in (["deleted", "inserted"], ["matched"], ["renamed"])
    assert similarity.block_changes(list("abc"), list("axcd")) == [("changed", 1, 1), ("inserted", None, 3)]
    assert similarity.redline("один два", "один три") == [("equal", "один "), ("delete", "два"), ("insert", "три")]
    assert similarity.ratio("abcd", "abxd") == difflib.SequenceMatcher(None, "abcd", "abxd").ratio()
    assert similarity.table_changes([["a"], ["b"]], [["a"], ["c"], ["d"]]) == (1, 1, 0) and similarity.unified_diff("a\nb", "a\nc")[-2:] == ["-b", "+c"]


def test_structure(spark):
    rows = [(1, i, t) for i, t in enumerate(["1.1. Первое", "Приложение А Схема", "2. Раздел длинный очень", "5. м", "Таблица 2.1. Итог", "Рис. 3 - вид", "просто"])]
    df = spark.createDataFrame(rows, "doc int, idx int, text string").orderBy("idx")
    got = df.select(structure.heading(F.col("text")).alias("h"), structure.caption(F.col("text")).alias("c")).collect()
    assert [r.h and r.h.kind for r in got] == ["dotted", "appendix", "single", None, None, None, None]
    assert [r.c and (r.c.kind, r.c.num, r.c.dots) for r in got][4:6] == [("table", "2.1", "."), ("figure", "3", "")]
    n = spark.createDataFrame([(1, i, x) for i, x in enumerate(["1", "2", "2.1", "2.3", "2.2", "2.2", "10"])], "doc int, idx int, num string")
    assert {(r.num, r.issue) for r in structure.number_sequence(n, ["doc"]).collect()} == {("2.3", "gap"), ("2.2", "reverse"), ("2.2", "duplicate")}
    joined = structure.joined_paragraphs(spark.createDataFrame([(1, 0, "Начало"), (1, 1, "продолжение."), (1, 2, "где а - б"), (1, 3, "Новое")], "doc int, idx int, text string"))
    assert sorted(r.text for r in joined.collect()) == ["Начало продолжение.", "Новое", "где а - б"]


def test_paragraph_kinds(spark):
    texts = ["Таблица 1 - x", "Рис. 2", "Содержание", "Приложение 1", "Глава 2. Общие нормы", "1.2 Общие нормы", "1.5 га", "- x", "• x", "3) x", "а) x", "текст", None, "Глава 2. О", "1.2 Общие", "1.2 12345678"]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").orderBy("i").select(paragraphs.kind(F.col("text"))).collect()]
    assert got[:6] == ["table-caption", "figure-caption", "toc-title", "appendix", "chapter", "numbered-heading"] and got[7:] == ["list-dash", "list-bullet", "list-number", "list-letter", None, None, None, None, None]


def test_tables(spark):
    grid = [["Отчет", "", ""], ["№", "Имя", "Сумма"], ["1", "a", "5"], ["2", "b", "6"]]
    r = spark.createDataFrame([(grid,)], "g array<array<string>>").select(tables.header_rows(F.col("g")).alias("h"), tables.preheader_rows(F.col("g"), tables.header_rows(F.col("g"))).alias("p")).first()
    assert (r.h, r.p) == (2, 1)
    t = {"width": 2, "style": "", "total": 100, "text_before": False}
    got = tables.stitch([{**t, "table_index": 0, "rows": [["h", "i"], ["1", "2"]]}, {**t, "table_index": 1, "rows": [["H", "i"], ["3", "4"]]}, {**t, "table_index": 2, "width": 3, "rows": [["x"]]}])
    assert [(g["members"], len(g["rows"]), g["dropped"]) for g in got] == [([0, 1], 3, 1), ([2], 1, 0)]
    assert tables.group_tables([{"table_index": i, "width": 2, "rows": [[h]]} for i, h in enumerate(["имя", "имя", "совсем другое"])]) == [[0, 1], [2]]
    md = spark.createDataFrame([(1, i, x) for i, x in enumerate(["| a | b |", "|---|---|", "| 1 | 2 | 3 |", "| x \\| y |", "text", "| no | table |"])], "doc int, idx int, text string")
    assert [r.cells for r in tables.markdown_rows(md).orderBy("row").collect()] == [["a", "b"], ["1", "2"], ["x | y", ""]]


def test_chunks_and_findings(spark):
    assert chunks.weighted([5, 1, 1, 1], 2) == [0, 1, 1, 1] and chunks.weighted([1, 1, 1], 3) == [0, 1, 2] and chunks.weighted([], 2) == []
    f = spark.createDataFrame([("a", "f", 1, 0, 3, "c"), ("b", "f", 1, 0, 3, "c"), ("b", "f", 2, 0, 1, "d")], "owner string, file string, node int, start int, end int, class_id string").withColumns({"before": F.lit("x"), "after": F.lit("y")})
    got = {(r.owner, r.node, r.status, r.overlap_group is not None) for r in findings.unify([f]).collect()}
    assert got == {("a", 1, "active", True), ("b", 1, "duplicate", True), ("b", 2, "active", False)}
    assert [r.class_id for r in findings.capped(f, ["file"], ["node", "owner"], 2).collect()].count("findings-truncated") == 1


def test_morph():
    lex = morph.Lexicon([("жилой", "жилой", ("nomn",)), ("жилого", "жилой", ("gent",)), ("дом", "дом", ("nomn",)), ("дома", "дом", ("gent",)), ("здание", "здание", ("nomn",)), ("здания", "здание", ("gent",))])
    assert morph.replace_phrase("У жилого дома. Жилой дом.", ["жилой", "дом"], "здание", lex) == ("У здания. Здание.", 2)
    assert morph.replace_phrase("дом, здание", ["дом"], "здание", lex, "append") == ("дом, здание", 0)
    text = "Это г. Тюмень. Вторая фраза. Третья"
    assert text[slice(*morph.sentence_bounds(text, 18, 20))] == "Вторая фраза."
    assert morph.put_in_runs(["аб", "вг", "д"], [(1, 4, "X")]) == ["аX", "", "д"]


def test_address(spark):
    key = lambda s: address.compact_key(address.parse(s))
    assert key("г Тюмень, ул. Ленина, 5/2") == key("город Тюмень, ул Ленина, дом 5 корпус 2") != key("г. Тюмень, ул. Ленина, д. 5")
    assert address.writing("город Тюмень, улица Ленина, дом 5, корпус 2") == "г. Тюмень, ул. Ленина, д. 5, корп. 2"
    assert address.writing("ул. Ленина, д. 3/1") == "ул. Ленина, д. 3/1" and address.parse(None)["house"] == ""
    names = spark.createDataFrame([("т", "ленина ул")], "block string, name string")
    known = spark.createDataFrame([("т", "ул ленина"), ("т", "мира"), ("х", "ул ленина")], "block string, name string")
    assert [(r.candidate, r.rank) for r in address.fuzzy_candidates(names, known, "block", "name").collect()] == [("ул ленина", 1)]


def test_registry():
    for name in registry.OPERATIONS:
        assert callable(registry.resolve(name))
    assert not set(registry.OPERATIONS) & set(registry.OUT_OF_SCOPE)


def test_streaming(spark, tmp_path):
    from corpusloom import streaming

    rows = [("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:01:00"), ("b  c", "2024-01-01 00:02:00")]
    spark.createDataFrame(rows, "text string, t string").withColumn("t", F.to_timestamp("t")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("text string, t timestamp").parquet(str(tmp_path / "in"))
    for n, (df, mode) in enumerate(((streaming.new_texts(stream, "text", "t"), "append"), (streaming.hygiene_counts(stream, "text", "t"), "complete"))):
        q = df.writeStream.format("memory").queryName(f"out{n}").outputMode(mode).option("checkpointLocation", str(tmp_path / f"c{n}")).trigger(availableNow=True).start()
        q.awaitTermination(60)
    assert sorted(r.text for r in spark.table("out0").collect()) == ["a", "b  c"]
    assert spark.table("out1").first().double_space == 1


def test_running_header():
    t = {"width": 1, "style": "", "total": 100, "text_before": False}
    got = tables.stitch_running([{**t, "table_index": 0, "rows": [["preheader"], ["head"], ["1"]]}, {**t, "table_index": 1, "rows": [["Head"], ["2"]]}, {**t, "table_index": 2, "rows": [["3"]]}], separate=True)
    assert [g["rows"] for g in got] == [[["preheader"]], [["head"], ["1"], ["2"], ["3"]]]


def test_inspect_reads_items_and_marks_once(spark):
    """Packages aren't parsed anew for each of the checks."""
    read = spark.sparkContext.accumulator(0)

    def once(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    items = spark.range(40).selectExpr("cast(id % 8 as string) AS file", "cast(id AS int) AS idx", "'paragraph' AS kind", "'' AS text", "'' AS style_name", "cast(null AS string) AS num_id", "0 AS drawings", "true AS ok", "cast(null AS string) AS error")
    marks = spark.range(8).selectExpr("cast(id AS string) AS file", "0 AS idx", "'start' AS kind", "'1' AS id", "'b' AS name", "true AS ok")
    again = lambda df: df.mapInArrow(once, df.schema)
    found = inspector.inspect(again(items), again(marks)).groupBy("class_id").count().collect()
    assert dict(found) == {"duplicated-empty-paragraphs": 8, "bookmark-start-without-end": 8}
    assert read.value == 48


def test_ordered_groups_with_a_null_key_stay_whole(spark):
    from corpusloom.functions.grouped import apply_sorted

    rows = spark.createDataFrame([(None, 2), (None, 1), ("a", 3)], "doc string, idx int")
    got = apply_sorted(rows, ["doc"], ["idx"], lambda key, g: [(key[0], g.idx)], "doc string, found array<int>").collect()
    assert sorted((r.doc or "", r.found) for r in got) == [("", [1, 2]), ("a", [3])]


def test_arrow_lists_are_read_as_arrow_tells_them():
    import pyarrow as pa

    from corpusloom.functions.batches import pylist

    nested = pa.array([[["a", None], []], None, [], [None, ["b"]]], pa.list_(pa.list_(pa.string())))
    structs = pa.array([{"x": 1, "y": [1, 2]}, None, {"x": None, "y": None}], pa.struct([("x", pa.int32()), ("y", pa.list_(pa.int64()))]))
    for a in (nested, structs, pa.array([1, None, 3]), pa.array([True, False]), pa.array([1.5, None]), pa.array([b"a", None])):
        for part in (a, a.slice(1), a.slice(1, 1), a.slice(0, 0)):
            assert repr(pylist(part)) == repr(part.to_pylist())
    assert tables._key([1, True, 1.0, None, " A b "]) == ("1", "true", "1.0", "", "a b")
    tables.group_tables([{"table_index": i, "width": 2, "rows": [["имя", "сумма" if i % 2 else "сумма "]]} for i in range(50)])
    assert tables._head_ratio.cache_info().misses <= 8  # equal headers are compared once


def test_words_of_roman_letters_are_no_list_numbers(spark):
    texts = {"Llci. | asción": None, "Mil. слов": None, "IV. пункт": "list-number", "iv) пункт": "list-number", "7. пункт": "list-number"}
    got = spark.createDataFrame([(t,) for t in texts], "text string").select("text", paragraphs.kind(F.col("text")).alias("kind"))
    assert dict(got.collect()) == texts
