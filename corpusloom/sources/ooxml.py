"""Office packages as tables: parts, text nodes, blocks, body items, tables, cells, media. Standard library only.

Files come through Spark's binaryFile reader, so they may lie in any store Spark reads; one package is parsed at a time.
A package that can't be opened gives a row with ok false and the error, never a failed job.
"""

from __future__ import annotations

import hashlib
import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree as ET

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.batches import map_rows

# Namespaces of the formats.
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
XML_SPACE = "{http://www.w3.org/XML/1998/namespace}space"
STRICT = b"http://purl.oclc.org/ooxml/"
CONTENT = re.compile(r"word/(document|header\d*|footer\d*|footnotes|endnotes)\.xml")


def discover(spark: SparkSession, path: str, suffixes: tuple[str, ...] = ("docx",)) -> DataFrame:
    """path, content of the files below a folder (or of one file), without Office's lock files, in no order."""
    glob = "*.{" + ",".join(suffixes) + "}"
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path).filter(~F.element_at(F.split("path", "/"), -1).startswith("~$")).select("path", "content")


def unpack(content: bytes) -> dict[str, bytes]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        return {n: z.read(n) for n in z.namelist()}


def pack(parts: dict[str, bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in parts.items():
            z.writestr(name, data)
    return out.getvalue()


def content_parts(parts: dict[str, bytes]) -> list[str]:
    return sorted(n for n in parts if CONTENT.fullmatch(n))


def _rows(files: DataFrame, schema: str, read: Callable[[dict[str, bytes]], Iterator[tuple]]) -> DataFrame:
    """files(path, content) -> file, the columns of `schema`, ok, error."""

    names = [c.split()[0] for c in schema.split(", ")]

    def rows_of(path: str, content: bytes) -> list[tuple]:
        try:
            return [(path, *r, True, None) for r in read(unpack(content))]
        except (zipfile.BadZipFile, ET.ParseError, KeyError, EOFError, ValueError) as e:
            return [(path, *[None] * len(names), False, f"{type(e).__name__}: {e}")]

    return map_rows(files.select("path", "content"), rows_of, f"file string, {schema}, ok boolean, error string")


def text_of(element: ET.Element) -> str:
    return "".join((x.text or "") if x.tag == f"{W}t" else "\t" if x.tag == f"{W}tab" else "\n" if x.tag in (f"{W}br", f"{W}cr") else "" for x in element.iter())


def package(files: DataFrame) -> DataFrame:
    return _rows(files, "part string, content binary", lambda p: ((n, d) for n, d in p.items()))


def text_nodes(files: DataFrame) -> DataFrame:
    def read(parts: dict[str, bytes]) -> Iterator[tuple]:
        for part in content_parts(parts):
            for i, t in enumerate(ET.fromstring(parts[part]).iter(f"{W}t")):
                if t.text:
                    yield part, i, t.text, t.get(XML_SPACE)

    return _rows(files, "part string, node_idx int, text string, xml_space string", read)


def _styles(parts: dict[str, bytes]) -> dict[str, str]:
    if "word/styles.xml" not in parts:
        return {}
    return {s.get(f"{W}styleId"): (s.find(f"{W}name").get(f"{W}val") if s.find(f"{W}name") is not None else "") for s in ET.fromstring(parts["word/styles.xml"]).iter(f"{W}style")}


def _body(parts: dict[str, bytes]) -> ET.Element:
    return ET.fromstring(parts["word/document.xml"]).find(f"{W}body")


def _style(p: ET.Element) -> str:
    s = p.find(f"{W}pPr/{W}pStyle")
    return s.get(f"{W}val") if s is not None else ""


def _heading_level(name: str) -> int:
    m = re.search(r"(?i)(?:heading|заголовок)\s*(\d)", name)
    return int(m[1]) if m else 0


def blocks(files: DataFrame) -> DataFrame:
    """Ordered headings, paragraphs and tables with the path of headings above them; tables of contents are skipped."""

    def read(parts: dict[str, bytes]) -> Iterator[tuple]:
        styles, path, n, last = _styles(parts), [], {}, ""
        for body_index, x in enumerate(_body(parts)):
            if x.tag == f"{W}p":
                text, name = " ".join(text_of(x).split()), styles.get(_style(x), _style(x))
                if not text or re.search(r"(?i)\btoc\b|оглавлен", name):
                    continue
                level = _heading_level(name)
                kind = "heading" if level else "paragraph"
                if level:
                    path = [*path[: level - 1], text]
                rows = None
            elif x.tag == f"{W}tbl":
                kind, rows = "table", [[" ".join(text_of(c).split()) for c in r.findall(f"{W}tc")] for r in x.findall(f"{W}tr")]
                text = "\n".join(" | ".join(r) for r in rows)
            else:
                continue
            n[kind] = n.get(kind, 0) + 1
            key = f"{kind}:{hashlib.sha256(text.lower().encode()).hexdigest()}"
            yield sum(n.values()), kind, n[kind], list(path), text, rows, last[:120], body_index, key
            last = text if kind != "table" else last

    return _rows(files, "ordinal int, kind string, kind_ordinal int, path array<string>, text string, rows array<array<string>>, anchor string, body_index int, key string", read)


def body_items(files: DataFrame) -> DataFrame:
    """The body's items with what windows count pages, sections and figures by."""

    def read(parts: dict[str, bytes]) -> Iterator[tuple]:
        styles = _styles(parts)
        for i, x in enumerate(_body(parts)):
            kind = {f"{W}p": "paragraph", f"{W}tbl": "table"}.get(x.tag)
            if kind:
                sid = _style(x) if kind == "paragraph" else ""
                breaks = sum(b.get(f"{W}type") == "page" for b in x.iter(f"{W}br")) + sum(1 for _ in x.iter(f"{W}lastRenderedPageBreak"))
                num = x.find(f"{W}pPr/{W}numPr/{W}numId")
                yield i, kind, text_of(x), sid, styles.get(sid, sid), num.get(f"{W}val") if num is not None else None, sum(1 for _ in x.iter(f"{W}drawing")), breaks, x.find(f"{W}pPr/{W}sectPr") is not None

    return _rows(files, "idx int, kind string, text string, style_id string, style_name string, num_id string, drawings int, page_breaks int, section_break boolean", read)


def table_grid(tbl: ET.Element) -> tuple[list[list[str]], list[tuple]]:
    """The display grid of a table and its merged cells' origins (id, row, col, text, rowspan, colspan)."""
    grid, origins, open_ = [], [], {}
    for r, tr in enumerate(tbl.findall(f"{W}tr")):
        row, c = [], 0
        skip = tr.find(f"{W}trPr/{W}gridBefore")
        if skip is not None:
            c = int(skip.get(f"{W}val") or 0)
            row += [""] * c
        for tc in tr.findall(f"{W}tc"):
            span, merge = tc.find(f"{W}tcPr/{W}gridSpan"), tc.find(f"{W}tcPr/{W}vMerge")
            width = int(span.get(f"{W}val") or 1) if span is not None else 1
            goes_on = merge is not None and merge.get(f"{W}val") != "restart" and c in open_
            if goes_on:
                at = open_[c]
                origins[at] = (*origins[at][:4], origins[at][4] + 1, origins[at][5])
            else:
                at = len(origins)
                origins.append((at, r, c, " ".join(text_of(tc).split()), 1, width))
                open_.pop(c, None)
                if merge is not None:
                    open_[c] = at
            row += [origins[at][3]] * width
            c += width
        grid.append(row)
    width = max(map(len, grid), default=0)
    return [r + [""] * (width - len(r)) for r in grid], origins


def tables(files: DataFrame) -> DataFrame:
    def read(parts: dict[str, bytes]) -> Iterator[tuple]:
        title, i = "", 0
        for x in _body(parts):
            if x.tag == f"{W}p":
                title = " ".join(text_of(x).split()) or title
            elif x.tag == f"{W}tbl":
                grid, origins = table_grid(x)
                widths = [int(g.get(f"{W}w") or 0) for g in x.findall(f"{W}tblGrid/{W}gridCol")]
                style = x.find(f"{W}tblPr/{W}tblStyle")
                yield i, title, len(grid[0]) if grid else 0, len(grid), grid, [dict(zip(("id", "row", "col", "text", "rowspan", "colspan"), o)) for o in origins], widths, style.get(f"{W}val") if style is not None else ""
                i += 1

    return _rows(files, "table_index int, title string, width int, height int, grid array<array<string>>, origins array<struct<id:int,row:int,col:int,text:string,rowspan:int,colspan:int>>, col_widths array<int>, style string", read)


def marks(files: DataFrame) -> DataFrame:
    """Bookmark starts and ends, hyperlink anchors and field instructions: idx, kind, id, name."""

    def read(parts: dict[str, bytes]) -> Iterator[tuple]:
        kinds = {f"{W}bookmarkStart": "start", f"{W}bookmarkEnd": "end", f"{W}hyperlink": "link", f"{W}instrText": "field", f"{W}fldSimple": "field"}
        for i, x in enumerate(ET.fromstring(parts["word/document.xml"]).iter()):
            if kind := kinds.get(x.tag):
                yield i, kind, x.get(f"{W}id"), x.get(f"{W}name") or x.get(f"{W}anchor") or x.get(f"{W}instr") or x.text

    return _rows(files, "idx int, kind string, id string, name string", read)


#: What a gate counts in a package's content parts, and in its styles.
GATE = ("nonblack", "style_nonblack", "highlight", "style_highlight", "shading", "style_shading", "comments", "strike", "style_strike", "ins", "del", "moveFrom", "moveTo")
STYLE_PARTS = ("word/styles.xml", "word/stylesWithEffects.xml", "word/numbering.xml")


def _val(x: ET.Element, name: str = "val") -> str | None:
    v = x.get(f"{W}{name}")
    return v.strip().lower() if v is not None else None


def switched_on(x: ET.Element | None) -> bool:
    return x is not None and _val(x) not in ("0", "false", "off", "none")


def gate_metrics(parts: dict[str, bytes]) -> dict[str, int]:
    """Colours that aren't black, highlights, shadings and strikes in the content and in the styles, comment parts, tracked changes."""
    n = dict.fromkeys(GATE, 0)
    for prefix, names in (("", content_parts(parts)), ("style_", [p for p in STYLE_PARTS if p in parts])):
        for name in names:
            root = ET.fromstring(parts[name])
            for props in root.iter(f"{W}rPr"):
                for c in props.findall(f"{W}color"):
                    v, theme = _val(c), prefix and _val(c, "themeColor")
                    n[prefix + "nonblack"] += bool(theme and v != "000000" or v and v not in ("000000", "auto"))
                n[prefix + "strike"] += any(switched_on(x) for t in ("strike", "dstrike") for x in props.findall(f"{W}{t}"))
            n[prefix + "highlight"] += sum(_val(x) != "none" for x in root.iter(f"{W}highlight"))
            n[prefix + "shading"] += sum((_val(x, "fill") or "auto") not in ("auto", "ffffff") for x in root.iter(f"{W}shd"))
            if not prefix:
                for t in ("ins", "del", "moveFrom", "moveTo"):
                    n[t] += sum(1 for _ in root.iter(f"{W}{t}"))
    n["comments"] = int(any(re.fullmatch(r"word/comments\w*\.xml", p) for p in parts))
    return n


def gates(files: DataFrame) -> DataFrame:
    """The gate's thirteen metrics of each package."""
    return _rows(files, ", ".join(f"{g} bigint" for g in GATE), lambda p: iter([tuple(gate_metrics(p).values())]))


def sections(files: DataFrame) -> DataFrame:
    """A document's sections: section (from 0), landscape, margins in millimetres (top, right, bottom, left), page_start, header, footer, widest table in cm."""
    mm = lambda v: round(int(v or 0) / 1440 * 25.4)

    def read(parts: dict[str, bytes]) -> Iterator[tuple]:
        rels = {r.get("Id"): r.get("Target") for r in ET.fromstring(parts["word/_rels/document.xml.rels"])} if "word/_rels/document.xml.rels" in parts else {}
        at, widest, last = 0, 0.0, {"header": "", "footer": ""}

        def told(sect: ET.Element) -> tuple:
            size, mar, num = (sect.find(f"{W}{t}") for t in ("pgSz", "pgMar", "pgNumType"))
            w, h = (int(size.get(f"{W}{t}") or 0) if size is not None else 0 for t in "wh")
            for kind in last:  # a section without its own goes on with the one before
                for ref in sect.findall(f"{W}{kind}Reference"):
                    name = f"word/{rels.get(ref.get(f'{R}id'), '')}"
                    if ref.get(f"{W}type", "default") == "default" and name in parts:
                        last[kind] = " ".join(text_of(ET.fromstring(parts[name])).split())
            return at, w > h, [mm(mar.get(f"{W}{t}")) if mar is not None else 0 for t in ("top", "right", "bottom", "left")], num.get(f"{W}start") if num is not None else None, last["header"], last["footer"], round(widest, 2)

        for x in _body(parts):
            if x.tag == f"{W}tbl":
                widest = max(widest, sum(int(g.get(f"{W}w") or 0) for g in x.findall(f"{W}tblGrid/{W}gridCol")) / 1440 * 2.54)
            sect = x if x.tag == f"{W}sectPr" else x.find(f"{W}pPr/{W}sectPr")
            if sect is not None:
                yield told(sect)
                at, widest = at + 1, 0.0

    return _rows(files, "section int, landscape boolean, margins array<int>, page_start string, header string, footer string, widest double", read)


def table_formats(files: DataFrame) -> DataFrame:
    """Each table's direct formatting: exact row heights, no-wrap cells, kinds of borders and of cell margins, fonts, range of sizes in points, and whether its grid could be read."""

    def read(parts: dict[str, bytes]) -> Iterator[tuple]:
        name = lambda x: x.tag.rsplit("}", 1)[-1]
        for i, t in enumerate(x for x in _body(parts) if x.tag == f"{W}tbl"):
            exact = sum(_val(h, "hRule") == "exact" for h in t.iter(f"{W}trHeight"))
            borders = {(x.get(f"{W}val") or "none", x.get(f"{W}sz") or "", (x.get(f"{W}color") or "").lower()) for k in ("tblBorders", "tcBorders") for b in t.iter(f"{W}{k}") for x in b if name(x) in ("top", "left", "bottom", "right", "insideH", "insideV", "start", "end")}
            margins = {tuple(sorted((name(x), x.get(f"{W}w") or "") for x in m if name(x) in ("top", "bottom", "left", "right", "start", "end"))) for k in ("tblCellMar", "tcMar") for m in t.iter(f"{W}{k}")} - {()}
            fonts = {f.get(f"{W}{k}") for f in t.iter(f"{W}rFonts") for k in ("ascii", "hAnsi", "cs", "eastAsia")} - {None, ""}
            sizes = []
            for props in t.iter(f"{W}rPr"):
                s = props.find(f"{W}sz") if props.find(f"{W}sz") is not None else props.find(f"{W}szCs")
                if s is not None and re.fullmatch(r"\d+(?:\.\d+)?", s.get(f"{W}val") or ""):
                    sizes.append(float(s.get(f"{W}val")) / 2)
            try:
                table_grid(t)
                failed = None
            except ValueError as e:
                failed = str(e)
            yield i, exact, sum(1 for _ in t.iter(f"{W}noWrap")), len(borders), len(margins), len(fonts), max(sizes) - min(sizes) if sizes else 0.0, failed

    return _rows(files, "table_index int, exact_rows int, no_wrap int, borders int, margins int, fonts int, size_range double, failed string", read)


def run_text(run: ET.Element) -> str:
    return "".join(t.text or "" for t in run.findall(f"{W}t"))


def target_paragraphs(body: ET.Element) -> Iterator[tuple[dict, ET.Element]]:
    """Where text may be replaced: the body's paragraphs, then those of its tables' cells, nested tables after their cell's own.

    A cell is named by its first grid column; what goes on a cell above it is no cell. Places count from 1, nested tables
    are named by the cells that hold them (table.row.cell.table)."""

    def of_table(tbl: ET.Element, name: str) -> Iterator[tuple[dict, ET.Element]]:
        for r, tr in enumerate(tbl.findall(f"{W}tr"), 1):
            at = 1
            for tc in tr.findall(f"{W}tc"):
                span, merge = tc.find(f"{W}tcPr/{W}gridSpan"), tc.find(f"{W}tcPr/{W}vMerge")
                if merge is None or merge.get(f"{W}val") == "restart":
                    for i, p in enumerate(tc.findall(f"{W}p"), 1):
                        yield {"kind": "table_cell", "table": name, "row": r, "cell": at, "paragraph": i}, p
                    for i, inner in enumerate(tc.findall(f"{W}tbl"), 1):
                        yield from of_table(inner, f"{name}.{r}.{at}.{i}")
                at += int(span.get(f"{W}val") or 1) if span is not None else 1

    for i, p in enumerate(body.findall(f"{W}p"), 1):
        yield {"kind": "paragraph", "table": None, "row": None, "cell": None, "paragraph": i}, p
    for i, tbl in enumerate(body.findall(f"{W}tbl"), 1):
        yield from of_table(tbl, str(i))


def targets(files: DataFrame) -> DataFrame:
    """The paragraphs of `target_paragraphs`, numbered, with the text of their runs."""

    def read(parts: dict[str, bytes]) -> Iterator[tuple]:
        for i, (place, p) in enumerate(target_paragraphs(_body(parts))):
            yield i, *place.values(), "".join(map(run_text, p.findall(f"{W}r")))

    return _rows(files, "target int, kind string, table_path string, row int, cell int, paragraph int, text string", read)


def paragraph_fields(p: ET.Element) -> list[dict]:
    """A paragraph's fields in the order they begin: instruction, all runs, and the runs of the shown result."""
    found, open_ = [], []
    for run in p.findall(f"{W}r"):
        mark = run.find(f"{W}fldChar")
        kind = mark.get(f"{W}fldCharType") if mark is not None else None
        if kind == "begin":
            open_.append({"instr": "", "runs": [], "shown": [], "result": False, "closed": False})
            found.append(open_[-1])
        for f in open_:
            f["runs"].append(run)
        if open_ and kind == "separate":
            open_[-1]["result"] = True
        elif open_ and kind == "end":
            open_.pop()["closed"] = True
        elif open_ and kind is None:
            instr = run.find(f"{W}instrText")
            if instr is not None:
                open_[-1]["instr"] += instr.text or ""
            elif open_[-1]["result"]:
                open_[-1]["shown"].append(run)
    return [f for f in found if f["closed"]]


def fields(files: DataFrame) -> DataFrame:
    """Fields made of runs: paragraph (of all the body's, tables included), its style and bookmarks, field (of the paragraph), instr, result."""

    def read(parts: dict[str, bytes]) -> Iterator[tuple]:
        for i, p in enumerate(_body(parts).iter(f"{W}p")):
            names = [b.get(f"{W}name") for b in p.findall(f"{W}bookmarkStart")]
            for j, f in enumerate(paragraph_fields(p)):
                yield i, _style(p), names, j, f["instr"], "".join(map(run_text, f["shown"]))

    return _rows(files, "paragraph int, style string, bookmarks array<string>, field int, instr string, result string", read)


def lock_files(spark: SparkSession, path: str) -> DataFrame:
    """Paths and sizes of the lock files that Office leaves behind; they are told, never deleted."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "~$*.{docx,xlsx,pptx,doc,xls,ppt}").load(path)
    return found.select("path", F.col("length").alias("size"))


def media(files: DataFrame) -> DataFrame:
    def read(parts: dict[str, bytes]) -> Iterator[tuple]:
        for i, n in enumerate(sorted(n for n in parts if re.match(r"(?:word|ppt|xl)/media/", n)), 1):
            yield i, n, len(parts[n]), hashlib.sha256(parts[n]).hexdigest(), parts[n]

    return _rows(files, "number int, part string, size bigint, sha256 string, content binary", read)


def column_number(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", ref)[0]:
        n = 26 * n + ord(c) - 64
    return n


def cells(files: DataFrame) -> DataFrame:
    """All sheets' cells: sheet, sheet_pos, row, col, value (as Python would print it), value_type."""

    def read(parts: dict[str, bytes]) -> Iterator[tuple]:
        shared = ["".join(t.text or "" for t in si.iter(f"{S}t")) for si in ET.fromstring(parts["xl/sharedStrings.xml"])] if "xl/sharedStrings.xml" in parts else []
        targets = {r.get("Id"): r.get("Target") for r in ET.fromstring(parts["xl/_rels/workbook.xml.rels"])}
        for pos, sheet in enumerate(ET.fromstring(parts["xl/workbook.xml"]).iter(f"{S}sheet")):
            target = targets[sheet.get(f"{R}id")]
            data = parts[target.lstrip("/") if target.startswith("/") else f"xl/{target}"]
            for _, row in ET.iterparse(io.BytesIO(data)):
                if row.tag != f"{S}row":
                    continue
                for i, c in enumerate(row.findall(f"{S}c")):
                    kind, v = c.get("t", "n"), c.find(f"{S}v")
                    if kind == "inlineStr":
                        value, kind = "".join(t.text or "" for t in c.iter(f"{S}t")), "string"
                    elif v is None or v.text is None:
                        continue
                    elif kind == "s":
                        value, kind = shared[int(v.text)], "string"
                    elif kind == "b":
                        value, kind = str(v.text == "1"), "bool"
                    elif kind == "n":
                        x = float(v.text)
                        value, kind = (str(int(x)), "int") if x == int(x) and "." not in v.text and "E" not in v.text.upper() else (repr(x), "float")
                    else:
                        value, kind = v.text, "string"
                    ref = c.get("r")
                    yield sheet.get("name"), pos, int(row.get("r")), column_number(ref) if ref else i + 1, value.replace("\r\n", "\n").replace("\r", "\n") if kind == "string" else value, kind
                row.clear()

    return _rows(files, "sheet string, sheet_pos int, row int, col int, value string, value_type string", read)


def header_table(cells_: DataFrame, sheet_pos: int = 0) -> DataFrame:
    """A sheet's rows under its header row: file, row, values (map of header to value); blank headers are dropped."""
    c = cells_.filter((F.col("sheet_pos") == sheet_pos) & F.col("ok"))
    heads = c.filter("row = 1").select(F.col("file").alias("f"), F.col("col").alias("k"), F.trim(F.regexp_replace("value", r"(?U)\s+", " ")).alias("head")).filter("head != ''")
    j = c.filter("row > 1").join(heads, (F.col("file") == F.col("f")) & (F.col("col") == F.col("k")))
    return j.groupBy("file", "row").agg(F.map_from_entries(F.collect_list(F.struct("head", "value"))).alias("values"))


def strict(files: DataFrame) -> DataFrame:
    """Whether a package is of the strict kind: its namespace within the document's first 64 KiB."""
    return _rows(files, "strict boolean", lambda p: iter([(STRICT in p.get("word/document.xml", b"")[:65536],)]))


def csv_table(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header, all strings, a byte order mark dropped, headers' spaces squeezed."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return df.toDF(*[" ".join(c.replace("﻿", "").split()) for c in df.columns])


def load_any(spark: SparkSession, path: str, table: int = 0) -> DataFrame:
    """Rows by suffix: CSV as columns, XLSX as maps, DOCX as the rows of a table (a bad index takes the first)."""
    suffix = path.rsplit(".", 1)[-1].lower()
    if suffix == "csv":
        return csv_table(spark, path)
    if suffix not in ("xlsx", "docx"):
        raise ValueError(f"no reader for .{suffix}")
    files = discover(spark, path, (suffix,))
    if suffix == "xlsx":
        return header_table(cells(files))
    t = tables(files).filter("ok")
    n = t.groupBy("file").agg(F.max("table_index").alias("last"))
    t = t.join(n, "file").filter(F.col("table_index") == F.when(F.col("last") >= table, table).otherwise(0))
    heads = F.transform(F.col("grid")[0], lambda h: F.trim(F.regexp_replace(h, r"(?U)\s+", " ")))
    return t.select("file", heads.alias("heads"), F.posexplode(F.slice("grid", 2, 1_000_000)).alias("row", "cells")).select("file", "row", F.map_from_entries(F.filter(F.zip_with("heads", "cells", lambda h, c: F.struct(h.alias("head"), c.alias("value"))), lambda x, i: F.array_position("heads", x["head"]) == i + 1)).alias("values"))
