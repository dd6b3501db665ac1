"""Transforms of Office packages, one package at a time, and their writer."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree as ET

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions.batches import map_rows
from corpusloom.operators.morph import put_in_runs
from corpusloom.sources.ooxml import S, W, XML_SPACE, content_parts, pack, paragraph_fields, run_text, target_paragraphs, text_of, unpack


def parse(data: bytes) -> ET.Element:
    """The tree, with every prefix of the source kept for writing."""
    found = ET.iterparse(io.BytesIO(data), events=["start-ns"])
    for _, (prefix, uri) in found:
        if not re.fullmatch(r"ns\d+", prefix):
            ET.register_namespace(prefix, uri)
    return found.root


def dump(root: ET.Element) -> bytes:
    return ET.tostring(root, encoding="UTF-8", xml_declaration=True)


def _parents(root: ET.Element) -> dict[ET.Element, ET.Element]:
    return {c: p for p in root.iter() for c in p}


def _unwrap(root: ET.Element, tags: set[str]) -> int:
    n = 0
    for p in [p for p in root.iter() if p is root or p.tag not in tags]:
        i = 0
        while i < len(p):
            if p[i].tag in tags:
                p[i : i + 1] = list(p[i])  # its children stand in its place, and are looked at in their turn
                n += 1
            else:
                i += 1
    return n


def _drop(root: ET.Element, tags: set[str]) -> int:
    n = 0
    for p in list(root.iter()):
        for c in [c for c in p if c.tag in tags]:
            p.remove(c)
            n += 1
    return n


def accept_changes(root: ET.Element) -> int:
    """Insertions stay, deletions and moved-away text go, property changes are forgotten."""
    n = _drop(root, {W + t for t in ("del", "moveFrom", "moveFromRangeStart", "moveFromRangeEnd", "moveToRangeStart", "moveToRangeEnd", "rPrChange", "pPrChange", "tblPrChange", "tcPrChange", "trPrChange", "sectPrChange", "numberingChange")})
    return n + _unwrap(root, {W + "ins", W + "moveTo"})


def strip_comment_marks(root: ET.Element) -> int:
    return _drop(root, {W + t for t in ("commentRangeStart", "commentRangeEnd", "commentReference")})


def make_black(root: ET.Element, delete_struck: bool = True) -> int:
    """Struck-out runs deleted, highlight and shading dropped, colours automatic."""
    parents, n = _parents(root), 0
    for run in list(root.iter(W + "r")):
        props = run.find(W + "rPr")
        if props is None:
            continue
        struck = [x for t in ("strike", "dstrike") if (x := props.find(W + t)) is not None and x.get(W + "val") not in ("0", "false")]
        if struck and delete_struck:
            parents[run].remove(run)
            n += 1
    n += _drop(root, {W + "highlight", W + "shd"})
    for c in root.iter(W + "color"):
        if c.get(W + "val") not in ("auto", "000000"):
            c.attrib.clear()
            c.set(W + "val", "auto")
            n += 1
    return n


def drop_soft_hyphens(root: ET.Element) -> int:
    n = _drop(root, {W + "softHyphen"})
    for t in root.iter(W + "t"):
        if t.text and "­" in t.text:
            n += t.text.count("­")
            t.text = t.text.replace("­", "")
    return n


def tidy(root: ET.Element) -> int:
    """Revision ids and empty properties dropped, neighbouring runs of equal properties merged, spaces kept."""
    n = 0
    for x in root.iter():
        for k in [k for k in x.attrib if k.startswith(W + "rsid")]:
            del x.attrib[k]
            n += 1
    _drop(root, {W + "proofErr", W + "lastRenderedPageBreak"})
    for p in list(root.iter()):
        for c in [c for c in p if c.tag in (W + "rPr", W + "pPr") and not len(c) and not c.attrib]:
            p.remove(c)
            n += 1
    props = lambda r: ET.tostring(r.find(W + "rPr")) if r.find(W + "rPr") is not None else b""
    plain = lambda r: r.tag == W + "r" and [x.tag for x in r if x.tag != W + "rPr"] == [W + "t"]
    for p in root.iter(W + "p"):
        last = None
        for r in list(p):
            if last is not None and plain(r) and plain(last) and props(r) == props(last):
                t = last.find(W + "t")
                t.text = (t.text or "") + (r.find(W + "t").text or "")
                t.set(XML_SPACE, "preserve")
                p.remove(r)
                n += 1
            else:
                last = r
    return n


def collapse_blank_paragraphs(root: ET.Element) -> int:
    """Of neighbouring paragraphs without any content the first stays."""
    body, n, before = root.find(W + "body"), 0, False
    # What a blank paragraph may hold that keeps it.
    blocked = {W + t for t in ("sectPr", "br", "lastRenderedPageBreak", "drawing", "pict", "bookmarkStart", "bookmarkEnd", "fldChar", "instrText", "hyperlink", "commentRangeStart", "commentRangeEnd")}
    for p in list(body if body is not None else ()):
        blank = p.tag == W + "p" and not text_of(p).strip() and not any(x.tag in blocked for x in p.iter())
        if blank and before:
            body.remove(p)
            n += 1
        else:
            before = blank
    return n


def cell_margins(root: ET.Element, twips: int = 57) -> int:
    """One cell margin for every table; single cells' own margins dropped."""
    n = _drop(root, {W + "tcMar"})
    for tbl in root.iter(W + "tbl"):
        props = tbl.find(W + "tblPr")
        if props is None:
            props = ET.Element(W + "tblPr")
            tbl.insert(0, props)
        old = props.find(W + "tblCellMar")
        if old is not None:
            props.remove(old)
        mar = ET.SubElement(props, W + "tblCellMar")
        for side in ("left", "right"):
            ET.SubElement(mar, W + side, {W + "w": str(twips), W + "type": "dxa"})
        n += 1
    return n


def relax_tables(root: ET.Element) -> int:
    """Exact row heights and no-wrap cells dropped."""
    n = _drop(root, {W + "noWrap"})
    for p in list(root.iter(W + "trPr")):
        for h in [h for h in p.findall(W + "trHeight") if h.get(W + "hRule") == "exact"]:
            p.remove(h)
            n += 1
    return n


def page_margins(root: ET.Element, left: int = 1134, other: int = 850) -> int:
    """Section margins of the house standard; A4 landscape turns with its binding edge on top, A3 doesn't."""
    n = 0
    for sect in root.iter(W + "sectPr"):
        size, mar = sect.find(W + "pgSz"), sect.find(W + "pgMar")
        if mar is None:
            mar = ET.SubElement(sect, W + "pgMar")
        turned = size is not None and size.get(W + "orient") == "landscape" and max(int(size.get(W + "w") or 0), int(size.get(W + "h") or 0)) < 20000
        for side in ("top", "right", "bottom", "left"):
            mar.set(W + side, str(left if side == ("top" if turned else "left") else other))
        n += 1
    return n


STEPS: dict[str, Callable[[ET.Element], int]] = {
    "accept_changes": accept_changes, "strip_comments": strip_comment_marks, "black": make_black, "soft_hyphens": drop_soft_hyphens, "tidy": tidy,
    "blank_paragraphs": collapse_blank_paragraphs, "cell_margins": cell_margins, "relax_tables": relax_tables, "page_margins": page_margins,
}
#: The one-click finish, in its order.
FINALIZE = ("strip_comments", "accept_changes", "black", "soft_hyphens")


def rewrite(content: bytes, steps: tuple[str, ...]) -> tuple[bytes, int]:
    """A package after the steps, and how much changed; the original bytes where nothing did."""
    parts, n = unpack(content), 0
    for name in content_parts(parts):
        root = parse(parts[name])
        k = sum(STEPS[s](root) for s in steps)
        if k:
            parts[name] = dump(root)
            n += k
    if "strip_comments" in steps:
        for name in [x for x in parts if re.fullmatch(r"word/comments\w*\.xml", x)]:
            del parts[name]
            n += 1
            for holder in ("[Content_Types].xml", "word/_rels/document.xml.rels"):
                if holder in parts:
                    root = parse(parts[holder])
                    for x in [x for x in root if name.rsplit("/", 1)[1] in (x.get("PartName", "") + " " + x.get("Target", ""))]:
                        root.remove(x)
                    parts[holder] = dump(root)
    if "accept_changes" in steps and "word/settings.xml" in parts:
        root = parse(parts["word/settings.xml"])
        if _drop(root, {W + "trackRevisions"}):
            parts["word/settings.xml"] = dump(root)
            n += 1
    return (pack(parts), n) if n else (content, 0)


def keep_body(content: bytes, ranges: list[tuple[int, int]]) -> bytes:
    """A package with only the body's children in the ranges (both ends in), and its last section."""
    parts = unpack(content)
    root = parse(parts["word/document.xml"])
    body = root.find(W + "body")
    for i, x in enumerate(list(body)):
        if x.tag != W + "sectPr" and not any(a <= i <= b for a, b in ranges):
            body.remove(x)
    parts["word/document.xml"] = dump(root)
    return pack(parts)


def drop_empty_rows(content: bytes) -> tuple[bytes, int]:
    """A workbook without rows that hold nothing, the rest renumbered."""
    parts, n = unpack(content), 0
    for name in [x for x in parts if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", x)]:
        root, k = parse(parts[name]), 0
        data = root.find(S + "sheetData")
        for row in list(data):
            if not any((c.find(S + "v") is not None and (c.find(S + "v").text or "").strip()) or c.find(S + "is") is not None for c in row):
                data.remove(row)
                k += 1
        for i, row in enumerate(data, 1):
            row.set("r", str(i))
            for c in row:
                if c.get("r"):
                    c.set("r", re.sub(r"\d+", str(i), c.get("r")))
        if k:
            parts[name] = dump(root)
            n += k
    return (pack(parts), n) if n else (content, 0)


def put_text(runs: list[ET.Element], text: str) -> bool:
    """The text in the first of the runs' text elements, the others emptied; False where there is none."""
    found = [t for r in runs for t in r.findall(W + "t")]
    for t in found:
        t.text, text = text, ""
        t.set(XML_SPACE, "preserve")
    return bool(found)


def _changed(files: DataFrame, change: Callable[[ET.Element, object], int], by: DataFrame | None = None) -> DataFrame:
    """path, content, changes, ok, error: change(document root, the file's row of `by`(path, plan)) on each package; what changes nothing keeps its bytes."""
    planned = by is not None

    def run(path: str, content: bytes, plan: object = None) -> list[tuple]:
        try:
            parts = unpack(content)
            root = parse(parts["word/document.xml"])
            n = change(root, plan)
            if n:
                parts["word/document.xml"] = dump(root)
            return [(path, pack(parts) if n else content, n, True, None)]
        except (zipfile.BadZipFile, ET.ParseError, KeyError) as e:
            return [(path, content, 0, False, f"{type(e).__name__}: {e}")]

    rows = files.select("path", "content")
    if planned:
        rows = rows.join(by, "path", "left").select("path", "content", "plan")
    return map_rows(rows, run, "path string, content binary, changes long, ok boolean, error string")


def edit_texts(files: DataFrame, spans: Callable[[str], list[tuple[int, int, str]]]) -> DataFrame:
    """Packages with spans(text) -> (start, end, new) put into the runs of every target paragraph."""

    def change(root: ET.Element, _: object) -> int:
        n = 0
        for _, p in target_paragraphs(root.find(W + "body")):
            runs = p.findall(W + "r")
            old = list(map(run_text, runs))
            found = spans("".join(old))
            for r, before, after in zip(runs, old, put_in_runs(old, found) if found else old):
                if before != after:
                    put_text([r], after)
            n += len(found)
        return n

    return _changed(files, change)


def set_fields(files: DataFrame, changes: DataFrame) -> DataFrame:
    """Packages with the results of `restyle.renumbered`; in captions the chapter's field, its dot and the counter's restart go."""
    plan = changes.groupBy(F.col("file").alias("path")).agg(F.collect_list(F.struct("paragraph", "field", "kind", "result")).alias("plan"))

    def change(root: ET.Element, plan: object) -> int:
        paragraphs, n = list(root.find(W + "body").iter(W + "p")), 0
        found: dict[int, list[dict]] = {}
        for c in [] if plan is None else plan:
            p = paragraphs[c["paragraph"]]
            f = found.setdefault(c["paragraph"], paragraph_fields(p))[c["field"]]
            n += put_text(f["shown"], c["result"])
            if c["kind"] == "caption":
                for t in (t for r in f["runs"] for t in r.findall(W + "instrText")):
                    t.text = re.sub(r"\s*\\s\s*\d+\s*", " ", t.text or "")
        for i in {c["paragraph"] for c in ([] if plan is None else plan) if c["kind"] == "caption"}:
            p = paragraphs[i]
            for f in (f for f in found[i] if "STYLEREF" in f["instr"]):
                rest = list(p)[list(p).index(f["runs"][-1]) + 1 :]
                for r in [*f["runs"], *(r for r in rest[:1] if r.tag == W + "r" and run_text(r).strip() == ".")]:
                    p.remove(r)
        return n

    return _changed(files, change, plan)


def set_styles(files: DataFrame, styled: DataFrame) -> DataFrame:
    """Packages with the styles, numberings and texts of `restyle.assign` on the body's items; what goes on a title is joined to it."""
    plan = styled.groupBy(F.col("file").alias("path")).agg(F.collect_list(F.struct("idx", "role", "style", "numbering")).alias("plan"))

    def change(root: ET.Element, plan: object) -> int:
        body = root.find(W + "body")
        items, n, title = list(body), 0, None
        for c in [] if plan is None else sorted(plan, key=lambda c: c["idx"]):
            p = items[c["idx"]]
            if c["role"] == "title_goes_on":
                ET.SubElement(ET.SubElement(title, W + "r"), W + "t", {XML_SPACE: "preserve"}).text = " "
                for r in [x for x in p if x.tag in (W + "r", W + "hyperlink")]:
                    title.append(r)
                body.remove(p)
                n += 1
                continue
            title = p if c["role"] == "caption_title" else title
            if c["role"] == "list":
                first = next((t for t in p.iter(W + "t") if re.match(r"\s*[-–—•]", t.text or "")), None)
                if first is not None:
                    first.text = re.sub(r"^\s*[-–—•]\s*", "", first.text)
            props = p.find(W + "pPr")
            if props is None:
                props = ET.Element(W + "pPr")
                p.insert(0, props)
            for tag, value in (("pStyle", c["style"]), ("numPr", c["numbering"])):
                old = props.find(W + tag)
                if value is None:
                    continue
                if old is not None:
                    props.remove(old)
                new = ET.Element(W + tag)
                props.insert(0 if tag == "pStyle" else 1, new)
                if tag == "pStyle":
                    new.set(W + "val", value)
                else:
                    num, level = (value.split(":") + ["0"])[:2]
                    ET.SubElement(new, W + "ilvl", {W + "val": level})
                    ET.SubElement(new, W + "numId", {W + "val": num})
            n += 1
        return n

    return _changed(files, change, plan)


def unique_paths(files: DataFrame, most: int = 999) -> DataFrame:
    """files whose repeated paths get _2, _3 and so on before the suffix; more than `most` of a name is an error."""
    n = F.row_number().over(Window.partitionBy("path").orderBy(F.xxhash64(*[c for c in files.columns if c != "path"])))
    named = F.when(F.col("__n") == 1, F.col("path")).when(F.col("__n") <= most, F.regexp_replace("path", r"(\.[^./]*)?$", "")).otherwise(F.raise_error(F.concat(F.lit("too many files named "), F.col("path"))))
    suffix = F.when(F.col("__n") > 1, F.concat(F.lit("_"), F.col("__n").cast("string"), F.regexp_extract("path", r"(\.[^./]*)$", 1))).otherwise("")
    return files.withColumn("__n", n).withColumn("path", F.concat(named, suffix)).drop("__n")


def transform(files: DataFrame, steps: tuple[str, ...]) -> DataFrame:
    """files(path, content) -> path, content, changes, ok, error."""

    def run(path: str, content: bytes) -> list[tuple]:
        try:
            return [(path, *rewrite(content, steps), True, None)]
        except (zipfile.BadZipFile, ET.ParseError, KeyError) as e:
            return [(path, content, 0, False, f"{type(e).__name__}: {e}")]

    return map_rows(files.select("path", "content"), run, "path string, content binary, changes long, ok boolean, error string")


def write_files(files: DataFrame, source: str, target: str) -> None:
    """path, content to files below `target` (a folder all executors share), in the places they have below `source`."""

    bare = lambda path: re.sub(r"^\w+:/*", "/", path)  # noqa: E731  without the store's name

    def run(rows: Iterator) -> None:
        import os

        for r in rows:
            place = bare(r.path).removeprefix(bare(source).rstrip("/")).lstrip("/")
            out = os.path.join(target, place)
            os.makedirs(os.path.dirname(out), exist_ok=True)
            with open(out + ".part", "wb") as f:
                f.write(r.content)
            os.replace(out + ".part", out)  # a task that runs twice writes the same file

    files.select("path", "content").foreachPartition(run)
