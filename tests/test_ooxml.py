import io
import zipfile

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import inspector
from corpusloom.sources import decode, ooxml, rewrite

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def package(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n, d in parts.items():
            z.writestr(n, d)
    return out.getvalue()


def docx(body, **more):
    styles = f'<w:styles {W}><w:style w:styleId="H1"><w:name w:val="heading 1"/></w:style></w:styles>'
    return package({"word/document.xml": f'<w:document {W}><w:body>{body}</w:body></w:document>', "word/styles.xml": styles, "word/media/image1.png": "png", **more})


def p(text, style="", props="", run=""):
    s = f'<w:pStyle w:val="{style}"/>' if style else ""
    return f'<w:p w:rsidR="1"><w:pPr>{s}{props}</w:pPr><w:r>{run}<w:t xml:space="preserve">{text}</w:t></w:r></w:p>'


CELL = "<w:tc><w:tcPr>{0}</w:tcPr><w:p><w:r><w:t>{1}</w:t></w:r></w:p></w:tc>"
TABLE = "<w:tbl><w:tblPr/><w:tblGrid><w:gridCol w:w='6000'/><w:gridCol w:w='6000'/></w:tblGrid><w:tr>" + CELL.format("<w:gridSpan w:val='2'/>", "head") + "</w:tr><w:tr>" + CELL.format("<w:vMerge w:val='restart'/>", "a") + CELL.format("", "b") + "</w:tr><w:tr>" + CELL.format("<w:vMerge/>", "") + CELL.format("", "c") + "</w:tr></w:tbl>"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("office")
    body = p("Глава", "H1") + p("") + p("") + p("Текст  один") + p("Таблица 1 - Итог") + TABLE + p("Таблица 3 - Итог") + '<w:p><w:bookmarkStart w:id="1" w:name="x"/><w:r><w:instrText>REF y</w:instrText></w:r></w:p>'
    (d / "a.docx").write_bytes(docx(body))
    changes = '<w:p><w:ins w:id="2"><w:r><w:t>new</w:t></w:r></w:ins><w:del w:id="3"><w:r><w:delText>old</w:delText></w:r></w:del><w:commentRangeStart w:id="0"/><w:r><w:rPr><w:strike/></w:rPr><w:t>gone</w:t></w:r><w:r><w:rPr><w:color w:val="FF0000"/></w:rPr><w:t>so­ft</w:t></w:r></w:p>'
    (d / "b.docx").write_bytes(docx(changes, **{"word/comments.xml": "<x/>"}))
    (d / "bad.docx").write_bytes(b"not a zip")
    (d / "~$a.docx").write_bytes(b"lock")
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    (d / "s.xlsx").write_bytes(package({
        "xl/workbook.xml": f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="One" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>', "xl/sharedStrings.xml": f"<sst {ns}><si><t>Имя</t></si></sst>",
        "xl/worksheets/sheet1.xml": f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>N</t></is></c></row><row r="2"><c r="A2"><v></v></c></row><row r="3"><c r="A3"><v>1.5</v></c><c r="B3" t="b"><v>1</v></c></row></sheetData></worksheet>',
    }))
    (d / "t.csv").write_bytes("﻿Имя  поля,b\n1,2\n".encode())
    return str(d)


@pytest.fixture(scope="module")
def files(spark, folder):
    return ooxml.discover(spark, folder).cache()


def name(df):
    return df.withColumn("file", F.element_at(F.split("file", "/"), -1))


def test_discovery_and_errors(files):
    assert {r.path.rsplit("/", 1)[1] for r in files.collect()} == {"a.docx", "b.docx", "bad.docx"}
    rows = name(ooxml.text_nodes(files)).filter("not ok").collect()
    assert [(r.file, r.error[:10]) for r in rows] == [("bad.docx", "BadZipFile")]


def test_blocks_tables_media(files):
    b = name(ooxml.blocks(files)).filter("file = 'a.docx'").orderBy("ordinal").collect()
    assert [(x.kind, x.text if x.kind != "table" else x.rows[0][0]) for x in b][:4] == [("heading", "Глава"), ("paragraph", "Текст один"), ("paragraph", "Таблица 1 - Итог"), ("table", "head")]
    assert b[1].path == ["Глава"] and b[3].anchor == "Таблица 1 - Итог"
    t = name(ooxml.tables(files)).filter("file = 'a.docx'").first()
    assert t.grid == [["head", "head"], ["a", "b"], ["a", "c"]] and t.title == "Таблица 1 - Итог"
    assert [(o.text, o.rowspan, o.colspan) for o in t.origins] == [("head", 1, 2), ("a", 2, 1), ("b", 1, 1), ("c", 1, 1)]
    assert {(r.part, r.size) for r in name(ooxml.media(files)).filter("ok and file = 'a.docx'").collect()} == {("word/media/image1.png", 3)}


def test_cells_and_loaders(spark, folder):
    c = ooxml.cells(ooxml.discover(spark, folder, ("xlsx",)))
    assert {(r.row, r.col, r.value, r.value_type) for r in c.collect()} == {(1, 1, "Имя", "string"), (1, 2, "N", "string"), (3, 1, "1.5", "float"), (3, 2, "True", "bool")}
    assert ooxml.load_any(spark, f"{folder}/s.xlsx").first()["values"] == {"Имя": "1.5", "N": "True"}
    assert ooxml.load_any(spark, f"{folder}/t.csv").columns == ["Имя поля", "b"]
    assert [r["values"] for r in ooxml.load_any(spark, f"{folder}/a.docx", 9).orderBy("row").collect()] == [{"head": "a"}, {"head": "a"}]
    with pytest.raises(ValueError):
        ooxml.load_any(spark, f"{folder}/x.odt")


def test_transforms(spark, files, folder, tmp_path):
    out = rewrite.transform(files, rewrite.FINALIZE).cache()
    by = {r.path.rsplit("/", 1)[1]: r for r in out.collect()}
    parts = ooxml.unpack(bytes(by["b.docx"].content))
    text = parts["word/document.xml"].decode()
    assert "new" in text and "old" not in text and "gone" not in text and "soft" in text and "comment" not in text and "word/comments.xml" not in parts
    assert by["a.docx"].changes == 0 and not by["bad.docx"].ok
    tidy = rewrite.rewrite(bytes(by["a.docx"].content), ("tidy", "blank_paragraphs", "cell_margins", "page_margins"))[0]
    xml = ooxml.unpack(tidy)["word/document.xml"].decode()
    assert "rsid" not in xml and "tblCellMar" in xml and "Текст  один" in xml
    rewrite.write_files(out.filter("ok"), f"file:{folder}", str(tmp_path / "out"))
    assert sorted(x.name for x in (tmp_path / "out").iterdir()) == ["a.docx", "b.docx"]
    kept = ooxml.unpack(rewrite.keep_body(bytes(by["a.docx"].content), [(0, 0)]))["word/document.xml"].decode()
    assert "Глава" in kept and "Итог" not in kept
    small, n = rewrite.drop_empty_rows((tmp_path.parent and open(f"{folder}/s.xlsx", "rb").read()))
    assert n == 1 and b'r="A2"' in ooxml.unpack(small)["xl/worksheets/sheet1.xml"]


def test_inspector(files):
    found = name(inspector.inspect(ooxml.body_items(files), ooxml.marks(files), ooxml.tables(files)))
    got = {(r.file, r.class_id) for r in found.collect()}
    for want in ("caption-table-number-gap", "duplicated-empty-paragraphs", "field-ref-missing-bookmark", "bookmark-start-without-end", "table-width-over-margins"):
        assert ("a.docx", want) in got, got
    assert ("bad.docx", "docx-open-failed") in got and not any(f == "b.docx" for f, _ in got)


def test_decode(spark):
    raw = ["Привет".encode(), "Привет, это обычный текст".encode("cp1251"), "Привет, это обычный текст".encode("cp866"), "Привет".encode("utf-16"), None]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(raw)], "i int, c binary").orderBy("i").select(decode.decode_best("c").alias("d"), decode.line_ends(F.col("c")).alias("e")).collect()
    assert [r.d.text and r.d.text[:6] for r in rows] == ["Привет"] * 4 + [None]
    assert rows[0].e.utf8 and not rows[1].e.utf8


def test_layout_and_table_looks(spark):
    sect = lambda more, size='w:w="11906" w:h="16838"', mar="1134": f'<w:sectPr><w:pgSz {size}/><w:pgMar w:top="{mar}" w:right="850" w:bottom="850" w:left="850"/>{more}</w:sectPr>'
    r = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    body = "".join(f"<w:p><w:pPr>{s}</w:pPr></w:p>" for s in (
        sect('<w:pgNumType w:start="3"/><w:headerReference w:type="default" r:id="h1"/>'), sect(""), sect('<w:pgNumType w:start="1"/>', 'w:w="16838" w:h="11906"'), sect('<w:headerReference w:type="default" r:id="h2"/>', mar="2000"),
    )) + TABLE.replace("<w:tblPr/>", '<w:tblPr><w:tblBorders><w:top w:val="single" w:sz="4"/><w:left w:val="single" w:sz="8"/><w:right w:val="double"/></w:tblBorders><w:tblCellMar><w:left w:w="1"/></w:tblCellMar></w:tblPr>').replace(
        "<w:tr><w:tc><w:tcPr><w:vMerge w:val='restart'/>", '<w:tr><w:trPr><w:trHeight w:hRule="exact"/></w:trPr><w:tc><w:tcPr><w:noWrap/><w:tcMar><w:left w:w="2"/></w:tcMar><w:vMerge w:val="restart"/>'
    ).replace("<w:r><w:t>c", '<w:r><w:rPr><w:rFonts w:ascii="A" w:hAnsi="B" w:cs="C" w:eastAsia="D"/><w:sz w:val="20"/></w:rPr><w:t>c').replace("<w:r><w:t>b", '<w:r><w:rPr><w:sz w:val="28"/></w:rPr><w:t>b').replace("<w:tcPr></w:tcPr>", '<w:tcPr><w:tcMar><w:left w:w="3"/></w:tcMar></w:tcPr>') + "<w:tbl><w:tr><w:tc><w:tcPr><w:gridSpan w:val='x'/></w:tcPr></w:tc></w:tr></w:tbl>"
    doc = f"<w:document {W} {r}><w:body>{body}</w:body></w:document>"
    rels = '<Relationships><Relationship Id="h1" Target="header1.xml"/><Relationship Id="h2" Target="header2.xml"/></Relationships>'
    head = lambda t: f"<w:hdr {W}>{p(t)}</w:hdr>"
    files = spark.createDataFrame([("a", bytearray(package({"word/document.xml": doc, "word/_rels/document.xml.rels": rels, "word/header1.xml": head("one"), "word/header2.xml": head("two")})))], "path string, content binary")
    sections = ooxml.sections(files)
    assert [(x.section, x.landscape, x.page_start, x.header) for x in sections.orderBy("section").collect()] == [(0, False, "3", "one"), (1, False, None, "one"), (2, True, "1", "one"), (3, False, None, "two")]
    got = {(x.class_id, x.idx) for x in inspector.layout(sections).collect()}
    assert got == {("page-number-first-section-start", 0), ("page-number-section-restart", 2), ("landscape-section-without-wide-table", 2), ("section-margin-profile-differs", 3), ("header-footer-profile-differs", 3)}
    looks = {(x.class_id, x.severity, x.idx) for x in inspector.table_looks(ooxml.table_formats(files)).collect()}
    assert looks == {("table-fixed-row-height", "critical", 0), ("table-border-mixed", "warning", 0), ("table-cell-margins-mixed", "warning", 0), ("table-fonts-mixed", "warning", 0), ("table-model-failed", "warning", 1)}


def test_blank_paragraphs_that_anchor_something_stay():
    body = "<w:p/><w:p/>" + "".join(f"<w:p><w:{t}/></w:p>" for t in ("commentRangeStart", "hyperlink", "lastRenderedPageBreak", "instrText", "commentRangeEnd")) + "<w:p/><w:p><w:r><w:tab/></w:r></w:p>"
    out, n = rewrite.rewrite(docx(body), ("blank_paragraphs",))
    assert n == 2 and ooxml.unpack(out)["word/document.xml"].decode().count("<w:p") == 7


def test_packages_are_made_and_read_by_all_cores(spark):
    """Rows of a few bytes make packages that cost much: none of the steps before or after may leave them in one task."""
    from corpusloom.plans import office, restyled
    from tests.conftest import SF

    cores = spark.sparkContext.defaultParallelism
    for files in (office.packages(spark, SF), restyled._sectioned(spark, SF)):
        tasks = files.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
        assert len(tasks) >= cores and max(tasks) < sum(tasks) / 2


def test_rows_of_many_packages_share_a_batch(spark, monkeypatch):
    """A batch of each package costs more than its parsing; what a batch holds is bounded."""
    from pyspark.sql.classic.dataframe import DataFrame

    content = docx("".join(p(f"t{i}") for i in range(30)))
    files = spark.createDataFrame([(f"f{i:03}", content) for i in range(300)], "path string, content binary").coalesce(1)
    mapped, seen = DataFrame.mapInArrow, spark.sparkContext.accumulator(0)

    def counting(df, run, schema):
        def over(batches):
            for b in run(batches):
                seen.add(1)
                assert b.num_rows <= 4096
                yield b

        return mapped(df, over, schema)

    monkeypatch.setattr(DataFrame, "mapInArrow", counting)
    assert ooxml.text_nodes(files).count() == 9000
    assert 1 <= seen.value <= 4


def test_nested_changes_are_unwrapped_once():
    from xml.etree import ElementTree as ET

    root = ET.fromstring(f"<w:p {W}><w:ins><w:r/><w:ins><w:t/></w:ins></w:ins><w:moveTo><w:x/></w:moveTo></w:p>")
    assert rewrite._unwrap(root, {ooxml.W + "ins", ooxml.W + "moveTo"}) == 3
    assert [x.tag.split("}")[1] for x in root] == ["r", "t", "x"]
