"""Restyling, fields, replacement in runs and loaders, on small cases told by hand."""

import pytest

from corpusloom.operators import hygiene, morph, restyle
from corpusloom.plans.office import _run, docx
from corpusloom.sources import ooxml, rewrite, sinks


def packages(spark, *bodies):
    return spark.createDataFrame([(str(i), bytearray(b)) for i, b in enumerate(bodies)], "path string, content binary")


def test_nested_tables_and_merged_cells_are_told_once(spark):
    inner = f"<w:tbl><w:tr><w:tc><w:p>{_run('in')}</w:p></w:tc></w:tr></w:tbl>"
    body = f'<w:tbl><w:tr><w:tc><w:tcPr><w:gridSpan w:val="2"/></w:tcPr><w:p>{_run("a")}</w:p>{inner}</w:tc><w:tc><w:tcPr><w:vMerge w:val="restart"/></w:tcPr><w:p>{_run("b")}</w:p></w:tc></w:tr><w:tr><w:tc><w:p/></w:tc><w:tc><w:p/></w:tc><w:tc><w:tcPr><w:vMerge/></w:tcPr><w:p>{_run("no")}</w:p></w:tc></w:tr></w:tbl><w:p>{_run("p")}</w:p>'
    rows = ooxml.targets(packages(spark, docx(body))).orderBy("target").collect()
    assert [(r.table_path, r.row, r.cell, r.text) for r in rows] == [(None, None, None, "p"), ("1", 1, 1, "a"), ("1.1.1.1", 1, 1, "in"), ("1", 1, 3, "b"), ("1", 2, 1, ""), ("1", 2, 2, "")]


def test_nested_and_open_fields(spark):
    mark = lambda k: f'<w:r><w:fldChar w:fldCharType="{k}"/></w:r>'
    instr = lambda t: f"<w:r><w:instrText>{t}</w:instrText></w:r>"
    inner = f"{mark('begin')}{instr('SEQ x')}{mark('separate')}{_run('1')}{mark('end')}"
    body = f"<w:p>{mark('begin')}{instr('IF ')}{inner}{instr(' y')}{mark('separate')}{_run('z')}{mark('end')}{mark('begin')}{instr('REF never')}</w:p>"
    rows = ooxml.fields(packages(spark, docx(body))).orderBy("field").collect()
    assert [(r.instr, r.result) for r in rows] == [("IF  y", "z"), ("SEQ x", "1")]


def test_bad_packages_and_documents_without_changes_keep_their_bytes(spark):
    good = docx(f"<w:p>{_run('дом')}</w:p>")
    files = packages(spark, good, b"no package")
    assert [(r.path, bytes(r.content), r.changes, r.ok) for r in rewrite.edit_texts(files, lambda t: []).orderBy("path").collect()] == [("0", good, 0, True), ("1", b"no package", 0, False)]
    for out in (rewrite.set_fields(files, restyle.renumbered(ooxml.fields(files), "Cap")),):
        assert {r.path: bytes(r.content) for r in out.collect()} == {"0": good, "1": b"no package"}


def test_headings_under_a_parent_and_titles(spark):
    book = restyle.Book("T", {1: "A", 2: "B"}, (restyle.Heading(1, (r"\d+ .*",), "regex"), restyle.Heading(2, ("x",), under="1 One")), "N", "C", bullet="L")
    texts = ["x", "1 One", "x", "2 Two", "x", "Таблица 1", "", "НАЗВАНИЕ ТАБЛИЦЫ", "", "ЕЩЕ", "<tbl>", "обычный", "Слова:", "Один;", "ДВА И ЕЩЕ ПЯТЬ.", None]
    rows = spark.createDataFrame([("f", i, "table" if t == "<tbl>" else "paragraph", t) for i, t in enumerate(texts)], "file string, idx int, kind string, text string")
    got = [r.role for r in restyle.assign(rows, book).orderBy("idx").collect()]
    # a title after a blank paragraph is another title; a small letter makes an item; a table ends the wait for a title, capitals don't end a list
    assert got == ["list", "heading", "heading", "heading", "list", "caption_number", "blank", "caption_title", "blank", "caption_title", "list", "text", "list", "text", "blank"]
    assert restyle.assign(rows.limit(0), book).count() == 0


def test_unique_paths_and_reports(spark):
    rows = spark.createDataFrame([("d.x/a", 1), ("d.x/a", 2), ("b.docx", 1), ("b.docx", 1)], "path string, n int")
    assert sorted(r.path for r in rewrite.unique_paths(rows).collect()) == ["b.docx", "b_2.docx", "d.x/a", "d.x/a_2"]
    with pytest.raises(Exception, match="too many files"):
        rewrite.unique_paths(rows, 1).collect()
    none = spark.createDataFrame([], "file string, class_id string")
    assert sinks.summary(none, "t", "1").first().summary.files == 0 and sinks.by_file(none).count() == 0
    assert sinks.summary(spark.createDataFrame([("a", None)], none.schema), "t", "1").first().summary.classes == {"": 1}


def test_report_is_written(spark, tmp_path):
    found = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "y")], "file string, class_id string")
    sinks.write(found, "t", "1", str(tmp_path))
    assert spark.read.json(f"{tmp_path}/summary").first().summary.findings == 3
    assert {r.file: r.n_findings for r in spark.read.json(f"{tmp_path}/files").collect()} == {"a": 2, "b": 1}


def test_lock_files_are_told(spark, tmp_path):
    for n in ("~$a.docx", "a.docx", "~$b.txt"):
        (tmp_path / n).write_bytes(b"1")
    assert [r.path.rsplit("/", 1)[1] for r in ooxml.lock_files(spark, str(tmp_path)).collect()] == ["~$a.docx"]


def test_keep_words(tmp_path):
    for name, text in (("a.json", '{"keep_words": ["x", " y "]}'), ("a.yaml", "words: [x, y]"), ("a.txt", "x, y\n# no\n"), ("b.json", '["x", "y", ""]')):
        (tmp_path / name).write_text(text)
        assert hygiene.load_keep_words(str(tmp_path / name)) == {"x", "y"}
    assert hygiene.load_keep_words("x, y,") == {"x", "y"} and hygiene.load_keep_words(" ") == set()


def test_phrase_spans_are_the_replaced_phrase():
    lex = morph.Lexicon([("дом", "дом", ("nomn",)), ("дома", "дом", ("gent",)), ("здание", "здание", ("nomn",)), ("здания", "здание", ("gent",))])
    text = "Дом у дома. Здание"
    assert morph.phrase_spans(text, ["дом"], "здание", lex) == [(0, 3, "Здание"), (6, 10, "здания")]
    assert morph.replace_phrase(text, ["дом"], "здание", lex) == ("Здание у здания. Здание", 2)
    assert morph.put_in_runs(["До", "м у", " дома"], [(0, 3, "Здание")]) == ["Здание", " у", " дома"]
