"""Word, Excel and PowerPoint files (MD7 to MD10), read as zipped XML trees."""

from __future__ import annotations

import io
import posixpath
import re
import xml.etree.ElementTree as ET
import zipfile

from .table import markdown_table


def local(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2]


def attribute(e: ET.Element, name: str) -> str:
    return next((v for k, v in e.attrib.items() if k.rpartition("}")[2] == name), "")


def inline(text: str, bold: bool, italic: bool) -> str:
    mark = "*" * (2 * bold + italic)
    return f"{mark}{text}{mark}" if text else text


def _run_text(run: ET.Element) -> str:
    """All character data of a run, breaks as line feeds."""
    parts = [run.text or ""]
    for e in run:
        parts += ["\n" if local(e) == "br" else "", _run_text(e), e.tail or ""]
    return "".join(parts)


def _on(run: ET.Element, flag: str) -> bool:
    return any(local(p) == "rPr" and any(local(f) == flag and attribute(f, "val") != "0" for f in p.iter()) for p in run)


def _descend(e: ET.Element, stop: set[str]):
    """Elements of these names, the outermost ones, in order."""
    for child in e:
        if local(child) in stop:
            yield child
        else:
            yield from _descend(child, stop)


def _table(tbl: ET.Element, cell_text) -> list[list[str]]:
    return [[cell_text(c).strip() for c in _descend(r, {"tc"})] for r in _descend(tbl, {"tr"})]


def docx(content: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        if "word/document.xml" not in z.namelist():
            raise ValueError("word/document.xml not found")
        root = ET.fromstring(z.read("word/document.xml"))
    out = []
    for block in _descend(root, {"p", "tbl"}):
        if local(block) == "tbl":
            out.append(markdown_table(_table(block, lambda c: "".join(c.itertext()))) + "\n")
            continue
        text = "".join(inline(_run_text(r), _on(r, "b"), _on(r, "i")) for r in _descend(block, {"r"})).strip()
        if not text:
            continue
        props = [x for p in block if local(p) == "pPr" for x in p.iter()]
        style = next((attribute(x, "val") for x in props if local(x) == "pStyle"), "")
        if m := re.fullmatch(r"Heading([1-6])", style):
            out.append("#" * int(m[1]) + f" {text}\n\n")
        elif any(local(x) == "numPr" for x in props):
            level = next((attribute(x, "val") for x in props if local(x) == "ilvl"), "0")
            out.append("  " * (int(level) if re.fullmatch(r"\d+", level) else 0) + f"- {text}\n")
        else:
            out.append(f"{text}\n\n")
    return "".join(out)


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]*", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def xlsx(content: bytes) -> str:
    """``## sheet`` and a table for each sheet with rows; legacy binary workbooks aren't zip files and raise."""
    if not zipfile.is_zipfile(io.BytesIO(content)):
        raise ValueError("not a zipped workbook")
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        shared: list[str] = []
        if "xl/sharedStrings.xml" in names:
            for si in ET.fromstring(z.read("xl/sharedStrings.xml")):
                shared.append("".join(t.text or "" for t in si.iter() if local(t) == "t"))
        links = {attribute(r, "Id"): attribute(r, "Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))} if "xl/_rels/workbook.xml.rels" in names else {}
        out = []
        sheets = [e for e in ET.fromstring(z.read("xl/workbook.xml")).iter() if local(e) == "sheet"]
        for k, sheet in enumerate(sheets):
            rid = next((v for a, v in sheet.attrib.items() if a.endswith("}id")), "")
            target = links.get(rid, f"worksheets/sheet{k + 1}.xml")
            path = target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join("xl", target))
            rows: list[list[str]] = []
            for row in (e for e in ET.fromstring(z.read(path)).iter() if local(e) == "row"):
                number = int(attribute(row, "r") or len(rows) + 1)
                while len(rows) < number:
                    rows.append([])
                for c in (e for e in row if local(e) == "c"):
                    at = _column(attribute(c, "r")) if attribute(c, "r") else len(rows[number - 1])
                    kind = attribute(c, "t")
                    value = next((v.text or "" for v in c if local(v) == "v"), "")
                    if kind == "s":
                        value = shared[int(value)]
                    elif kind == "inlineStr":
                        value = "".join(t.text or "" for t in c.iter() if local(t) == "t")
                    elif kind == "b":
                        value = "TRUE" if value == "1" else "FALSE"
                    rows[number - 1] += [""] * (at + 1 - len(rows[number - 1]))
                    rows[number - 1][at] = value
            while rows and not any(rows[-1]):
                rows.pop()
            if rows:
                out.append(f"## {attribute(sheet, 'name')}\n\n{markdown_table(rows)}\n")
    return "".join(out)


_SLIDE = re.compile(r"ppt/slides/slide(\d+)\.xml")


def _paragraphs(body: ET.Element):
    for p in _descend(body, {"p"}):
        level = next((attribute(x, "lvl") for x in p if local(x) == "pPr"), "")
        parts = []
        for e in p:
            if local(e) == "r":
                props = next((x for x in e if local(x) == "rPr"), None)
                flag = lambda k: props is not None and attribute(props, k) == "1"  # noqa: B023, E731
                parts.append(inline("".join(e.itertext()), flag("b"), flag("i")))
            elif local(e) == "br":
                parts.append("\n")
        text = "".join(parts).strip()
        if text:
            yield "  " * (int(level) - 1) + f"- {text}" if re.fullmatch(r"[1-9]\d*", level) else text


def slide(xml: bytes) -> str:
    titles, body = [], []
    for shape in _descend(ET.fromstring(xml), {"sp", "tbl"}):
        if local(shape) == "tbl":
            cell = lambda c: "".join(inline("".join(r.itertext()), any(local(x) == "rPr" and attribute(x, "b") == "1" for x in r), any(local(x) == "rPr" and attribute(x, "i") == "1" for x in r)) for r in _descend(c, {"r"}))
            body.append(markdown_table(_table(shape, cell)))
            continue
        title = any(local(x) == "ph" and attribute(x, "type") in ("title", "ctrTitle") for x in shape.iter())
        for text_body in _descend(shape, {"txBody"}):
            (titles if title else body).extend(_paragraphs(text_body))
    return "".join([*(f"## {t}\n\n" for t in titles), *(f"{b}\n\n" for b in body)]).rstrip("\n")


def image_ids(xml: bytes) -> list[str]:
    """MD10: relationship ids of a slide's images."""
    return [v for e in ET.fromstring(xml).iter() if local(e) == "blip" for k, v in e.attrib.items() if k.endswith("}embed")]


def relation_targets(rels: bytes) -> dict[str, str]:
    return {attribute(r, "Id"): attribute(r, "Target") for r in ET.fromstring(rels)}


def image_path(target: str, base: str = "ppt/slides") -> str:
    """The zip member that a relative target names."""
    return target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join(base, target))


def pptx(content: bytes, ocr=None) -> str:
    """Slides by number, titles first. ``ocr(name, bytes)`` may give the text of an image; without it images are left out."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        found = sorted((int(m[1]), n) for n in z.namelist() if (m := _SLIDE.fullmatch(n)))
        if not found:
            raise ValueError("no slides found")
        parts = []
        for k, name in found:
            xml = z.read(name)
            text = slide(xml)
            rels = f"ppt/slides/_rels/slide{k}.xml.rels"
            if ocr and rels in z.namelist():
                targets = relation_targets(z.read(rels))
                paths = [image_path(targets[i]) for i in image_ids(xml) if i in targets]
                said = [t for p in paths if p in z.namelist() and (t := ocr(p, z.read(p)))]
                text = "\n\n".join(x for x in (text, *said) if x)
            if text.strip():
                parts.append(text)
    return "\n---\n\n".join(parts) + "\n" if parts else ""
