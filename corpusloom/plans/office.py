"""Registered queries of the Office operators: packages are made of the tables' rows, read back, and told by SQL on the rows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.batches import map_rows
from corpusloom.operators import findings, inspector, paragraphs, structure
from corpusloom.plans.registered import query, read, spread
from corpusloom.sources import decode, ooxml, rewrite

_W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
_S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
_R = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def _run(text: str, props: str = "") -> str:
    return f'<w:r>{f"<w:rPr>{props}</w:rPr>" if props else ""}<w:t xml:space="preserve">{text}</w:t></w:r>'


def _cell(text: str, props: str = "") -> str:
    return f"<w:tc><w:tcPr>{props}</w:tcPr><w:p>{_run(text)}</w:p></w:tc>"


def docx(body: str, more: dict[str, bytes] | None = None, root: str = "") -> bytes:
    styles = f'<w:styles {_W}><w:style w:styleId="H1"><w:name w:val="heading 1"/><w:rPr><w:color w:val="00FF00"/></w:rPr></w:style><w:style w:styleId="T1"><w:name w:val="toc 1"/></w:style></w:styles>'
    return ooxml.pack({"word/document.xml": f"<w:document {_W} {root}><w:body>{body}</w:body></w:document>".encode(), "word/styles.xml": styles.encode(), **(more or {})})


def xlsx(rows: list[list]) -> bytes:
    cell = lambda r, c, v: "" if v is None else f'<c r="{chr(65 + c)}{r}" t="inlineStr"><is><t>{v}</t></is></c>' if isinstance(v, str) and v else f'<c r="{chr(65 + c)}{r}"><v>{v}</v></c>'
    sheet = "".join(f'<row r="{i}">{"".join(cell(i, c, v) for c, v in enumerate(row))}</row>' for i, row in enumerate(rows, 1))
    return ooxml.pack({
        "xl/workbook.xml": f'<workbook {_S} {_R}><sheets><sheet name="One" r:id="r1"/></sheets></workbook>'.encode(),
        "xl/_rels/workbook.xml.rels": b'<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f"<worksheet {_S}><sheetData>{sheet}</sheetData></worksheet>".encode(),
    })


def customer_docx(k: int, name: str, segment: str, nation: int, orders: list[tuple[int, str]]) -> bytes:
    """A heading, a changed and commented text, blank paragraphs, a captioned table of orders with merged cells, a reference."""
    end = "" if k % 3 == 0 else f'<w:bookmarkEnd w:id="{k}"/>'
    body = f'<w:p><w:pPr><w:pStyle w:val="H1"/></w:pPr><w:bookmarkStart w:id="{k}" w:name="b{nation}"/>{_run(name)}{end}</w:p>'
    body += f'<w:p w:rsidR="1"><w:commentRangeStart w:id="0"/>{_run(segment, "<w:color w:val=%sFF0000%s/><w:highlight w:val=%syellow%s/>" % (("%c" % 34,) * 4))}<w:commentRangeEnd w:id="0"/><w:ins w:id="1">{_run(" new")}</w:ins><w:del w:id="2"><w:r><w:delText> old</w:delText></w:r></w:del>{_run(" gone", "<w:strike/>") if k % 2 else ""}</w:p>'
    body += "<w:p/>" * (2 + k % 2)
    body += f"<w:p>{_run(f'Таблица {nation + 1} - {segment}')}</w:p>"
    rows = f'<w:tr>{_cell("orders", "<w:gridSpan w:val=%s2%s/>" % (("%c" % 34,) * 2))}</w:tr>'
    for i, (o, status) in enumerate(orders):
        merge = '<w:vMerge w:val="restart"/>' if i == 0 else "<w:vMerge/>"
        rows += f"<w:tr>{_cell(str(o))}{_cell(status, merge)}</w:tr>"
    body += f"<w:tbl><w:tblPr/><w:tblGrid><w:gridCol w:w='3000'/><w:gridCol w:w='3000'/></w:tblGrid>{rows}</w:tbl>"
    body += f"<w:p><w:r><w:instrText>REF b{(nation + k % 2) % 25}</w:instrText></w:r></w:p>"
    more = {"word/media/image1.png": name.encode(), "word/comments.xml": f"<w:comments {_W}><w:comment w:id='0'/></w:comments>".encode()}
    return docx(body, more, 'xmlns:s="http://purl.oclc.org/ooxml/"' if k % 5 == 0 else "")


def packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path (the customer's key), content: a package of every customer that has orders."""
    orders = spread(read(spark, sf_dir, "orders"), "o_custkey").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s")))).alias("orders"))
    rows = orders.join(read(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    rows = rows.select("c_custkey", "c_name", "c_mktsegment", "c_nationkey", F.col("orders.k").alias("keys"), F.col("orders.s").alias("statuses"))
    return map_rows(rows, lambda k, name, segment, nation, keys, statuses: [(str(k), customer_docx(k, name, segment, nation, list(zip(keys, statuses))))], "path string, content binary")


_C = "c AS (SELECT c_custkey AS k, c_name AS name, c_mktsegment AS seg, c_nationkey AS nation, n, ks, ss FROM customer JOIN (SELECT o_custkey, count(*) AS n, list(o_orderkey ORDER BY o_orderkey, o_orderstatus) AS ks, list(o_orderstatus ORDER BY o_orderkey, o_orderstatus) AS ss FROM orders GROUP BY 1) ON c_custkey = o_custkey)"


@query(f"""WITH {_C}, t AS (SELECT k, [name, seg, ' new'] || CASE WHEN k % 2 = 1 THEN [' gone'] ELSE [] END || ['Таблица ' || (nation + 1) || ' - ' || seg, 'orders'] || flatten(list_transform(range(1, n + 1), lambda i: [CAST(ks[i] AS VARCHAR), ss[i]])) AS ts FROM c)
SELECT CAST(k AS VARCHAR) AS file, 'word/document.xml' AS part, (i - 1)::INT AS node_idx, ts[i] AS text, 'preserve' AS xml_space FROM (SELECT k, ts, unnest(range(1, len(ts) + 1)) AS i FROM t)""")
def docx_text_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ooxml.text_nodes(packages(spark, sf_dir)).select("file", "part", "node_idx", "text", "xml_space")


@query(f"""WITH {_C}, p AS (SELECT k, 'heading' AS kind, 1 AS ordinal, 1 AS kind_ordinal, name AS text, [name] AS path, 0 AS body_index FROM c
UNION ALL SELECT k, 'paragraph', 2, 1, seg || ' new' || CASE WHEN k % 2 = 1 THEN ' gone' ELSE '' END, [name], 1 FROM c
UNION ALL SELECT k, 'paragraph', 3, 2, 'Таблица ' || (nation + 1) || ' - ' || seg, [name], (4 + k % 2)::INT FROM c
UNION ALL SELECT k, 'table', 4, 1, 'orders' || array_to_string(list_transform(range(1, n + 1), lambda i: chr(10) || ks[i] || ' | ' || ss[i]), ''), [name], (5 + k % 2)::INT FROM c)
SELECT CAST(k AS VARCHAR) AS file, ordinal, kind, kind_ordinal, path, text, body_index FROM p""")
def docx_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ooxml.blocks(packages(spark, sf_dir)).select("file", "ordinal", "kind", "kind_ordinal", "path", "text", "body_index")


@query(f"""WITH {_C}, i AS (SELECT k, 0 AS idx, 'paragraph' AS kind, name AS text, 'heading 1' AS style_name FROM c UNION ALL SELECT k, 1, 'paragraph', seg || ' new' || CASE WHEN k % 2 = 1 THEN ' gone' ELSE '' END, '' FROM c
UNION ALL SELECT k, unnest(range(2, 4 + k % 2))::INT, 'paragraph', '', '' FROM c UNION ALL SELECT k, (4 + k % 2)::INT, 'paragraph', 'Таблица ' || (nation + 1) || ' - ' || seg, '' FROM c
UNION ALL SELECT k, (5 + k % 2)::INT, 'table', 'orders' || array_to_string(list_transform(range(1, n + 1), lambda j: ks[j] || ss[j]), ''), '' FROM c UNION ALL SELECT k, (6 + k % 2)::INT, 'paragraph', '', '' FROM c)
SELECT CAST(k AS VARCHAR) AS file, idx, kind, text, style_name, CASE WHEN kind = 'table' THEN true WHEN kind = 'paragraph' THEN NULL END AS captioned FROM i""")
def docx_body_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items, and whether their tables have a caption among the two paragraphs before."""
    items = ooxml.body_items(packages(spark, sf_dir)).withColumnRenamed("file", "doc")
    return paragraphs.caption_nearby(items).select(F.col("doc").alias("file"), "idx", "kind", "text", "style_name", "captioned")


@query(f"""WITH {_C} SELECT CAST(k AS VARCHAR) AS file, 0 AS table_index, 'Таблица ' || (nation + 1) || ' - ' || seg AS title, 2 AS width, (n + 1)::INT AS height,
[['orders', 'orders']] || list_transform(range(1, n + 1), lambda i: [CAST(ks[i] AS VARCHAR), ss[1]]) AS grid, (n + 2)::INT AS n_origins, n::INT AS rowspan, [3000, 3000] AS col_widths FROM c""")
def docx_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grids with merged cells resolved; the status cell spans all orders."""
    t = ooxml.tables(packages(spark, sf_dir))
    return t.select("file", "table_index", "title", "width", "height", "grid", F.size("origins").alias("n_origins"), F.array_max(F.transform("origins", lambda o: o["rowspan"])).alias("rowspan"), "col_widths")


@query(f"WITH {_C} SELECT CAST(k AS VARCHAR) AS file, 1 AS number, 'word/media/image1.png' AS part, len(name)::BIGINT AS size, sha256(name) AS sha256 FROM c")
def docx_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ooxml.media(packages(spark, sf_dir)).select("file", "number", "part", "size", "sha256")


@query(f"WITH {_C} SELECT CAST(k AS VARCHAR) AS file, k % 5 = 0 AS strict FROM c")
def docx_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ooxml.strict(packages(spark, sf_dir)).select("file", "strict")


@query(f"WITH {_C} SELECT CAST(k AS VARCHAR) AS file, 4 AS parts, n::INT + 3 AS kept FROM c")
def docx_package_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of each package, and rows and paragraphs left when all but the heading and the table are cut from its body."""
    files = packages(spark, sf_dir)

    def kept(path: str, content: bytes) -> list[tuple]:
        from xml.etree import ElementTree as ET

        at = 5 + int(path) % 2
        root = ET.fromstring(ooxml.unpack(rewrite.keep_body(content, [(0, 0), (at, at)]))["word/document.xml"])
        body = root.find(f"{ooxml.W}body")
        return [(path, len(body) + sum(1 for _ in body.iter(f"{ooxml.W}tr")))]

    n = ooxml.package(files).groupBy("file").agg(F.count("*").cast("int").alias("parts"))
    return n.join(map_rows(files, kept, "file string, kept int"), "file")


def _after(spark: SparkSession, sf_dir: str, steps: tuple[str, ...]) -> DataFrame:
    """file, node_idx, text of the packages after the steps."""
    return ooxml.text_nodes(rewrite.transform(packages(spark, sf_dir), steps)).filter("ok and node_idx < 4").select("file", "node_idx", "text")


_FIRST = "SELECT CAST(k AS VARCHAR) AS file, (i - 1)::INT AS node_idx, ts[i] AS text FROM (SELECT k, ts, unnest(range(1, 5)) AS i FROM t)"


@query(f"WITH {_C}, t AS (SELECT k, [name, seg, ' new'] || CASE WHEN k % 2 = 1 THEN [' gone'] ELSE ['Таблица ' || (nation + 1) || ' - ' || seg] END AS ts FROM c) {_FIRST}")
def docx_accept_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with insertions kept and deletions dropped."""
    return _after(spark, sf_dir, ("accept_changes",))


@query(f"WITH {_C}, t AS (SELECT k, [name, seg, ' new', 'Таблица ' || (nation + 1) || ' - ' || seg] AS ts FROM c) {_FIRST}")
def docx_finalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts after the one-click finish: struck-out runs are gone too."""
    return _after(spark, sf_dir, rewrite.FINALIZE)


_GATE = """m AS (SELECT CAST(k AS VARCHAR) AS file, 1 AS nonblack, 1 AS style_nonblack, 1 AS highlight, 1 AS comments, k % 2 AS strike, 1 AS ins, 1 AS del FROM c)"""


@query(f"""WITH {_C}, {_GATE}, g AS (SELECT 'before' AS stage, file, sum(nonblack) AS nonblack, sum(style_nonblack) AS style_nonblack, sum(highlight) AS highlight, 0 AS style_highlight, 0 AS shading, 0 AS style_shading, sum(comments) AS comments, sum(strike) AS strike, 0 AS style_strike, sum(ins) AS ins, sum(del) AS del, 0 AS moveFrom, 0 AS moveTo FROM m GROUP BY ROLLUP(file)
UNION ALL SELECT 'after', file, 0, sum(style_nonblack), 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0 FROM m GROUP BY ROLLUP(file)) SELECT stage, file, {", ".join(f"{m}::BIGINT AS {m}" for m in ooxml.GATE)}, 'FAIL' AS status FROM g""")
def ooxml_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The thirteen metrics of every package and in total, before and after the one-click finish (which leaves styles alone)."""
    files = packages(spark, sf_dir)
    return findings.package_gate(files, "before").unionByName(findings.package_gate(rewrite.transform(files, rewrite.FINALIZE), "after"))


@query(f"""WITH {_C}, m AS (SELECT CAST(k AS VARCHAR) AS file, k, 'bookmark-start-without-end' AS class_id FROM c WHERE k % 3 = 0 UNION ALL SELECT CAST(k AS VARCHAR), k, 'field-ref-missing-bookmark' FROM c WHERE k % 2 = 1
UNION ALL SELECT CAST(k AS VARCHAR), k, 'duplicated-empty-paragraphs' FROM c) SELECT file, class_id, count(*) AS n FROM m GROUP BY ALL""")
def docx_inspection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inspector over the packages: marks without their other half, references without a mark, blank paragraphs."""
    files = packages(spark, sf_dir)
    found = inspector.inspect(ooxml.body_items(files), ooxml.marks(files), ooxml.tables(files), most=1_000_000)
    return found.filter("class_id not like 'table-%'").groupBy("file", "class_id").agg(F.count("*").alias("n"))


# --- workbooks ---


def workbooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path (the nation's key), content: a sheet of each nation's suppliers, every fourth row empty."""
    rows = read(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.array_sort(F.collect_list(F.struct("s_suppkey", "s_name"))).alias("rows"))

    @F.pandas_udf("binary")
    def make(rows: pd.Series) -> pd.Series:
        return pd.Series([xlsx([["Key  no", "Name"], *([None, None] if r["s_suppkey"] % 4 == 0 else [int(r["s_suppkey"]), r["s_name"]] for r in rs)]) for rs in rows])

    return rows.select(F.col("s_nationkey").cast("string").alias("path"), make("rows").alias("content"))


_B = "b AS (SELECT CAST(s_nationkey AS VARCHAR) AS file, s_suppkey AS k, s_name AS name, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey, s_name) + 1 AS r FROM supplier)"


@query(f"""WITH {_B}, x AS (SELECT file, r AS row, 1 AS col, CAST(k AS VARCHAR) AS value, 'int' AS value_type FROM b WHERE k % 4 <> 0 UNION ALL SELECT file, r, 2, name, 'string' FROM b WHERE k % 4 <> 0
UNION ALL SELECT DISTINCT file, 1, 1, 'Key  no', 'string' FROM b UNION ALL SELECT DISTINCT file, 1, 2, 'Name', 'string' FROM b) SELECT file, 'One' AS sheet, 0 AS sheet_pos, row::INT AS row, col, value, value_type FROM x""")
def xlsx_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ooxml.cells(workbooks(spark, sf_dir)).select("file", "sheet", "sheet_pos", "row", "col", "value", "value_type")


@query(f"WITH {_B} SELECT file, r::INT AS row, CAST(k AS VARCHAR) AS key_no, name FROM b WHERE k % 4 <> 0")
def xlsx_header_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows under a header whose spaces are squeezed."""
    t = ooxml.header_table(ooxml.cells(workbooks(spark, sf_dir)))
    return t.select("file", "row", F.col("values")["Key no"].alias("key_no"), F.col("values")["Name"].alias("name"))


@query(f"WITH {_B}, f AS (SELECT file, k, name, row_number() OVER (PARTITION BY file ORDER BY r) + 1 AS row FROM b WHERE k % 4 <> 0) SELECT file, row::INT AS row, CAST(k AS VARCHAR) AS key_no, name FROM f")
def xlsx_without_empty_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same after empty rows are dropped from the workbooks, the rest renumbered."""

    @F.pandas_udf("binary")
    def drop(content: pd.Series) -> pd.Series:
        return pd.Series([rewrite.drop_empty_rows(bytes(c))[0] for c in content])

    t = ooxml.header_table(ooxml.cells(workbooks(spark, sf_dir).withColumn("content", drop("content"))))
    return t.select("file", "row", F.col("values")["Key no"].alias("key_no"), F.col("values")["Name"].alias("name"))


@query("SELECT c_custkey, 'Заказчик ' || c_name || ', сегмент рынка' AS text FROM customer")
def decoded_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts written in one of four encodings each, told by their bytes alone."""
    c = read(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("Заказчик "), "c_name", F.lit(", сегмент рынка")).alias("t"))

    @F.pandas_udf("binary")
    def encode(k: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series([x.encode(("utf-8", "utf-16", "cp866", "cp1251")[i % 4]) for i, x in zip(k, t)])

    return c.select("c_custkey", decode.decode_best(encode("c_custkey", "t"))["text"].alias("text"))


# --- the inspector's codes on made items ---

_ITEMS = "w AS (SELECT DISTINCT o_custkey AS file FROM orders)"


@query("""WITH w AS (SELECT DISTINCT o_custkey AS file FROM orders) SELECT file, class_id, CASE WHEN class_id = 'toc-heading-missing' THEN 2 ELSE 1 END::BIGINT AS n FROM w, (VALUES ('caption-table-duplicate-number'), ('caption-table-reverse-number'), ('caption-table-number-gap'), ('caption-figure-dot-format'), ('caption-figure-number-gap'),
('manual-numbered-list'), ('manual-list-orphan-subpoint'), ('manual-bulleted-list'), ('heading-without-following-content'), ('duplicated-empty-paragraphs'), ('toc-heading-missing'), ('toc-entry-stale'), ('field-broken-visible-result'), ('table-caption-missing'), ('figure-caption-missing'), ('toc-field-without-parsed-entries')) t(class_id)
WHERE NOT (class_id = 'toc-field-without-parsed-entries' AND file % 2 = 0) AND NOT (class_id IN ('toc-heading-missing', 'toc-entry-stale') AND file % 2 = 1)""")
def inspect_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer with orders as a document that sets off each check on items; half of them have a contents field without entries."""
    rows = [
        ("Оглавление", "", 0, 0), ("Старый раздел 3", "toc 1", 0, 0), ("Первый раздел", "heading 1", 0, 0), ("Таблица 2 - a", "", 0, 0), ("Таблица 2 - b", "", 0, 0), ("Таблица 1 - c", "", 0, 0),
        ("Таблица 5 - d", "", 0, 0), ("x", "", 0, 0), ("Рисунок 1. e", "", 0, 0), ("Рисунок 3 - f", "", 0, 0), ("1) один", "", 0, 0), ("4.1) два", "", 0, 0), ("- а", "", 0, 0), ("- б", "", 0, 0), ("- в", "", 0, 0),
        ("", "", 0, 0), ("", "", 0, 0), ("Ошибка! Источник ссылки не найден", "", 0, 0), ("y", "", 0, 0), ("z", "", 0, 0), ("u", "", 0, 0), ("v", "", 0, 0), ("", "", 1, 0), ("t", "", 0, 0), ("s", "", 0, 0), ("r", "", 0, 0), ("q", "", 0, 0), ("", "", 0, 1), ("9. Последний раздел", "heading 1", 0, 0),
    ]
    made = F.array(*[F.struct(F.lit(i).alias("idx"), F.lit("table" if table else "paragraph").alias("kind"), F.lit(t).alias("text"), F.lit(s).alias("style_name"), F.lit(d).alias("drawings")) for i, (t, s, d, table) in enumerate(rows)])
    docs = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("file")).distinct()
    items = docs.select("file", F.explode(made).alias("i")).select("file", "i.*", F.lit(None).cast("string").alias("num_id"), F.lit(True).alias("ok"), F.lit(None).cast("string").alias("error"))
    items = items.withColumn("style_name", F.when((F.col("style_name") == "toc 1") & (F.col("file") % 2 == 1), "").otherwise(F.col("style_name")))
    marks = docs.select("file", F.lit(0).alias("idx"), F.lit("field").alias("kind"), F.lit(None).cast("string").alias("id"), F.lit('TOC \\o "1-3"').alias("name"), F.lit(True).alias("ok"))
    return inspector.inspect(items, marks, most=1_000_000).groupBy("file", "class_id").agg(F.count("*").alias("n"))


@query("""WITH o AS (SELECT o_custkey AS doc, o_orderkey AS idx, o_orderstatus AS s FROM orders), m AS (SELECT *, lead(s) OVER w AS nxt, lag(s) OVER w AS prv FROM o WINDOW w AS (PARTITION BY doc ORDER BY idx))
SELECT doc, idx, CASE s WHEN 'F' THEN 'dotted' WHEN 'O' THEN 'single' ELSE 'appendix' END AS kind, CASE s WHEN 'F' THEN '2.' || (idx % 9 + 1) WHEN 'O' THEN CAST(idx % 9 + 1 AS VARCHAR) ELSE 'Приложение ' || (idx % 9 + 1) END AS num, 'Заголовок номер ' || idx AS title FROM m""")
def headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings of three kinds told from their texts."""
    o = read(spark, sf_dir, "orders")
    n, title = (F.col("o_orderkey") % 9 + 1).cast("string"), F.concat(F.lit("Заголовок номер "), F.col("o_orderkey").cast("string"))
    text = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("2."), n, F.lit(". "), title)).when(F.col("o_orderstatus") == "O", F.concat(n, F.lit(". "), title)).otherwise(F.concat(F.lit("Приложение "), n, F.lit(". "), title))
    return o.select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("idx"), structure.heading(text).alias("h")).select("doc", "idx", "h.kind", "h.num", "h.title")


@query("""SELECT o_orderkey, o_orderpriority LIKE '1%' AS heading, o_orderpriority LIKE '2%' AS caption, o_orderpriority LIKE '3%' AS toc, o_orderpriority LIKE '4%' AS appendix, o_orderpriority LIKE '5%' AS list FROM orders""")
def style_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a style's name says."""
    names = F.array(*map(F.lit, ("Heading 2", "Название объекта", "TOC 1", "Приложение А", "List Bullet")))
    s = F.get(names, F.substring("o_orderpriority", 1, 1).cast("int") - 1)
    return read(spark, sf_dir, "orders").select("o_orderkey", *[paragraphs.style_is(s, k).alias(k) for k in ("heading", "caption", "toc", "appendix", "list")])


@query("""WITH e AS (SELECT user_id AS file, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS idx, event_type FROM events),
j AS (SELECT o.file, o.idx, m.idx AS mark_idx, row_number() OVER (PARTITION BY o.file, o.idx ORDER BY abs(o.idx - m.idx), m.idx) AS r FROM e o JOIN e m ON o.file = m.file AND o.event_type = 'purchase' AND m.event_type = 'view' AND abs(o.idx - m.idx) BETWEEN 1 AND 4),
s AS (SELECT file, idx, CASE WHEN mark_idx < idx THEN 'before' ELSE 'after' END AS side FROM j WHERE r = 1), v AS (SELECT file, side, count(*) AS n, min(idx) AS f FROM s GROUP BY 1, 2),
u AS (SELECT file, side AS usual FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY n DESC, f) AS r FROM v) WHERE r = 1 AND n >= 2) SELECT s.file, s.idx::INT AS idx, s.side FROM s JOIN u ON s.file = u.file AND s.side <> u.usual""")
def caption_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects whose mark stands on another side than most of their file's."""
    from pyspark.sql.window import Window

    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("file"), "event_type", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("idx"))
    near = structure.nearest(e.filter("event_type = 'purchase'").select("file", "idx"), e.filter("event_type = 'view'"), ["file"])
    return structure.off_side(near, "file").select("file", "idx", "side")
