import io
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from spindle.functions import convert
from spindle.functions.convert import formats, office
from spindle.functions.convert.pdf import pages
from spindle.functions.convert.table import markdown_table


def zipped(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name.replace("__", "/"), text)
    return out.getvalue()


W = 'xmlns:w="urn:w"'
A = 'xmlns:a="urn:a" xmlns:p="urn:p" xmlns:r="urn:r"'


def el(tag, *inner, **attrs):
    """An element; prefixes are the first letter, as in ``w_p``."""
    name = lambda k: k.strip("_").replace("_", ":", 1)
    said = "".join(f' {name(k)}="{v}"' for k, v in attrs.items())
    return f"<{name(tag)}{said}>{''.join(inner)}</{name(tag)}>"


def docx(body):
    return zipped(**{"word/document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>"})


def par(text, props="", run=""):
    return el("w_p", el("w_pPr", props), el("w_r", el("w_rPr", run), el("w_t", text)))


def test_table():
    assert markdown_table([["Name", "A|B"], ["é"]]) == "| Name | A\\|B |\n| ---- | ---- |\n| é   |      |\n"
    assert markdown_table([]) == "" and markdown_table([[]]) == ""


def test_csv():
    run = lambda s: convert.convert("a.csv", s.encode())
    assert run("Name,Age\nAda,36\n\n\"x,\"\"y\",1\n") == "| Name | Age |\n| ---- | --- |\n| Ada  | 36  |\n| x,\"y | 1   |\n"
    assert run("") == "" and run("a|b\n").startswith("| a\\|b |")
    for bad in ("a,b\n1\n", 'a"b,c\n', '"open', '"a"b\n'):
        assert run(bad) == f"```csv\n{bad}\n```"


def test_json():
    run = lambda s: convert.convert("a.json", s.encode())
    assert run('{"b": 1, "a": [1.5, "<&>", null, true], "c": {}, "d": []}') == '```json\n{\n  "a": [\n    1.5,\n    "\\u003c\\u0026\\u003e",\n    null,\n    true\n  ],\n  "b": 1,\n  "c": {},\n  "d": []\n}\n```'
    assert run("{bad") == "```json\n{bad\n```" and run("1e21") == "```json\n1e+21\n```"
    assert run("NaN") == "```json\nNaN\n```"


def test_plain_formats():
    assert convert.convert("a.xml", b"<a/>") == "```xml\n<a/>\n```" and convert.convert("a.TXT", b"x") == "x" and convert.convert("a.md", b"# y") == "# y"
    md = convert.convert("a.html", b"<h1>T <b>b</b></h1><p>one<br>two <a href='u'>l</a></p><ul><li>a<li>b<ol><li>c</ol></ul><script>x</script><pre>k\n v</pre><table><tr><th>h<th>i<tr><td>1<td>2</table><blockquote>q</blockquote>")
    assert md == "# T **b**\n\none  \ntwo [l](u)\n\n- a\n- b\n  1. c\n\n```\nk\n v\n```\n\n| h   | i   |\n| --- | --- |\n| 1   | 2   |\n\n> q"


def test_docx():
    table = el("w_tbl", el("w_tr", el("w_tc", par("a"), par("b")), el("w_tc", el("w_p"))))
    body = par("Head", '<w:pStyle w:val="Heading2"/>') + par("bold", "", "<w:b/>") + par("both", "", '<w:b/><w:i/>') + par("off", "", '<w:b w:val="0"/>') + par("item", el("w_numPr", el("w_ilvl", w_val=1))) + par(" ") + table
    assert convert.convert("a.docx", docx(body)) == "## Head\n\n**bold**\n\n***both***\n\noff\n\n  - item\n| ab  |     |\n| --- | --- |\n\n"
    with pytest.raises(ValueError):
        office.docx(zipped(x="y"))


def test_xlsx():
    book = '<workbook xmlns:r="urn:r"><sheets><sheet name="One" r:id="rId1"/><sheet name="Empty" r:id="rId2"/></sheets></workbook>'
    rels = '<Relationships><Relationship Id="rId1" Target="worksheets/s1.xml"/><Relationship Id="rId2" Target="/xl/worksheets/s2.xml"/></Relationships>'
    sheet = '<worksheet><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>in</t></is></c></row><row r="3"><c r="B3"><v>2.5</v></c></row></sheetData></worksheet>'
    data = zipped(**{"xl/workbook.xml": book, "xl/_rels/workbook.xml.rels": rels, "xl/sharedStrings.xml": "<sst><si><t>sha</t><t>red</t></si></sst>", "xl/worksheets/s1.xml": sheet, "xl/worksheets/s2.xml": "<worksheet/>"})
    assert convert.convert("a.xlsx", data) == "## One\n\n| shared |     | in  |\n| ------ | --- | --- |\n|        |     |     |\n|        | 2.5 |     |\n\n"
    with pytest.raises(ValueError):
        office.xlsx(b"\xd0\xcf\x11\xe0")


def slide(title, body, extra=""):
    shape = lambda kind, paras: el("p_sp", el("p_nvSpPr", el("p_nvPr", el("p_ph", type=kind))), el("p_txBody", paras))
    return f"<p:sld {A}>" + el("p_cSld", el("p_spTree", shape("body", body), shape("title", title), extra)) + "</p:sld>"


def test_pptx():
    p = lambda t, props="", run="": el("a_p", props, el("a_r", f"<a:rPr {run}/>", el("a_t", t)))
    blip = el("p_pic", el("a_blip", r_embed="rId2"))
    files = {
        "ppt/slides/slide10.xml": slide(p("Last"), ""),
        "ppt/slides/slide2.xml": slide(p("First"), p("text", "", 'b="1"') + p("sub", '<a:pPr lvl="2"/>'), blip),
        "ppt/slides/_rels/slide2.xml.rels": '<Relationships><Relationship Id="rId2" Target="../media/i.png"/></Relationships>', "ppt/media/i.png": "img",
    }
    data = zipped(**files)
    assert convert.convert("a.pptx", data) == "## First\n\n**text**\n\n  - sub\n---\n\n## Last\n"
    assert "seen img" in office.pptx(data, ocr=lambda name, b: "seen " + b.decode())
    assert office.image_ids(files["ppt/slides/slide2.xml"].encode()) == ["rId2"] and office.image_path("../media/i.png") == "ppt/media/i.png"
    with pytest.raises(ValueError):
        office.pptx(zipped(x="y"))


def pdf(*texts, deflate=False):
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [" + b" ".join(b"%d 0 R" % (3 + 2 * i) for i in range(len(texts))) + b"] /Count 1 >>"]
    for i, t in enumerate(texts):
        data = b"BT /F1 12 Tf (" + t.encode() + b") Tj ET"
        head = b"/Filter /FlateDecode " if deflate else b""
        data = zlib.compress(data) if deflate else data
        objects += [b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % (4 + 2 * i), b"<< " + head + b"/Length %d >>\nstream\n" % len(data) + data + b"\nendstream"]
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (k + 1, o) for k, o in enumerate(objects)) + b"%%EOF"


def test_pdf():
    assert [x.strip() for x in pages(pdf("Hello \\(you\\)", "Two"))] == ["Hello (you)", "Two"]
    assert convert.convert("a.pdf", pdf("One", "Two", deflate=True)) == "One\n\n---\n\nTwo"
    with pytest.raises(ValueError):
        pages(b"no")


def test_limits_and_dispatch():
    assert convert.can_convert("x.DOCX") and not convert.can_convert("x.zip") and ".csv" in convert.supported_formats()
    with pytest.raises(ValueError):
        convert.convert("a.txt", b"xx", formats.Config(max_bytes=1))
    assert convert.convert("a.txt", b"x", formats.Config(max_bytes=1)) == "x"
    with pytest.raises(ValueError):
        convert.convert("a.png", b"x")
    assert formats.Config.from_env({"CONVERT_MAX_BYTES": "9", "CONVERT_IMAGES": "Yes"}) == formats.Config(9, True) and formats.Config.from_env({"CONVERT_MAX_BYTES": "-1"}) == formats.Config()


def test_udf(spark):
    df = spark.createDataFrame([("a.txt", b"x"), ("a.zip", b""), (None, None)], "p string, c binary")
    rows = [tuple(r) for r in df.select(convert.converted(F.col("p"), F.col("c")).alias("r")).select("r.*").collect()]
    assert rows[0] == ("x", None) and rows[1][0] is None and "unsupported" in rows[1][1] and rows[2][1]
