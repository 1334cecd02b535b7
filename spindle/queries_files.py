"""More registered queries: extractors, logs and converters over files made of the tables, and writes to stores.

Every row of a table becomes a file whose names carry the row's key, so the SQL of the expected records is a list of
(what, name) for each key.
"""

from __future__ import annotations

import io
import json
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions import logs, strings
from .functions.convert import converted
from .functions.extract.languages import callee
from .functions.extract.registry import format_of
from .plans import pattern
from .plans.testgraph import WITH
from .sources import files
from .session import spread
from .store import Store
from .streaming import log_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

_KEY = "lpad(CAST(p_partkey AS {text}), 8, '0')"


def add(name: str, query: Query, sql: str | None) -> None:
    QUERIES[name] = query
    if sql is not None:
        ORACLES[name] = sql


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def filled(template: str) -> Column:
    """A template with the key of the row for ``{k}``."""
    return F.replace(F.lit(template), F.lit("{k}"), F.expr(_KEY.format(text="STRING")))


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def values_sql(rows: list[tuple[str, ...]], names: str, keep: str = "k") -> str:
    """Each row of a list, with the key for ``{k}``, for every part."""
    columns = names.split(", ")
    said = ", ".join("(" + ", ".join(map(quoted, r)) + ")" for r in rows)
    return f"SELECT {keep}, {', '.join(f'replace(v.{c}, {quoted(chr(123) + chr(107) + chr(125))}, k) AS {c}' for c in columns)} FROM (SELECT {_KEY.format(text='VARCHAR')} AS k FROM part), (VALUES {said}) v({names})"


def file_rows(spark: SparkSession, sf_dir: str, path: str, text: str) -> DataFrame:
    return spread(read(spark, sf_dir, "part").select("p_partkey"), "p_partkey").select(F.expr(_KEY.format(text="STRING")).alias("k"), filled(path).alias("rel_path"), filled(text).cast("binary").alias("content"))


# ---------------------------------------------------------------- extractors


def extractor(name: str, path: str, text: str, found: dict[str, list[str]], calls: list[tuple[str, str]] = ()) -> None:
    """Entities, relations and calls of one file for each part; ``found`` lists names by type, ``calls`` (caller, callee)."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        x = files.extracted_files(file_rows(spark, sf_dir, path, text))
        said = lambda what, name: F.struct(what.alias("what"), name.alias("name"))
        entities = F.transform("x.entities", lambda e: said(e["type"], e["name"]))
        relations = F.array_distinct(F.transform("x.relations", lambda r: said(r["rel_type"], r["to_id"])))  # as the loader takes them; all are from the file
        calls = F.transform("x.calls", lambda c: said(F.lit("call"), F.concat_ws(" ", F.element_at(F.split(c["from_id"], ":"), -1), c["callee_name"])))
        return x.select(F.regexp_extract("rel_path", r"(\d{8})", 1).alias("k"), F.inline(F.concat(entities, relations, calls)))

    kinds = {"function": "CONTAINS", "type": "CONTAINS", "topic": "CONTAINS", "import": "IMPORTS", "package": "BELONGS_TO"}
    rows = [("file", path)]
    for kind, names in found.items():
        for n in names:
            rows.append((kind, n))
            rows.append((kinds[kind], f"{kind}:{n}" if kind in ("import", "package") else f"{kind}:{path}:{n}"))
    rows += [("call", f"{a} {b}") for a, b in calls]
    add(name, run, values_sql(rows, "what, name"))


extractor("ex2_go", "d/{k}.go", 'package pkg{k}\n\nimport "fmt"\nimport alias "net/http"\n\n// Gone()\nfunc Exported{k}(a int) error {\n\thelper.Do(1)\n\treturn Other(a)\n}\nfunc (t *T) Method{k}() {}\nfunc hidden() { Do() }\ntype Kind{k} struct{ A int }\ntype private struct{}\n',
          {"package": ["pkg{k}"], "import": ["fmt", "net/http"], "function": ["Exported{k}", "Method{k}"], "type": ["Kind{k}"]}, [("Exported{k}", "Do"), ("Exported{k}", "Other")])
extractor("ex1_python_walk", "d/{k}.py", "import os\nfrom a.b import c\n\nclass K{k}:\n    def run{k}(self):\n        helper{k}(1)\n        self.go()\n\ndef _hidden():\n    pass\n\ndef helper{k}(x):\n    return os.getcwd()\n",
          {"import": ["os", "a.b"], "type": ["K{k}"], "function": ["run{k}", "helper{k}"]}, [("run{k}", "helper{k}"), ("run{k}", "go"), ("helper{k}", "getcwd")])
extractor("ex4_java", "d/{k}.java", "package x.y;\nimport java.util.List;\npublic class A{k} implements B {\n  public A{k}(int x) { go(); }\n  private static List<String> items{k}(int n) { return make(n); }\n}\ninterface F{k} { void m{k}(); }\nenum E{k} { X }\n",
          {"package": ["x.y"], "import": ["java.util.List"], "type": ["A{k}", "F{k}", "E{k}"], "function": ["A{k}", "items{k}", "m{k}"]}, [("A{k}", "go"), ("items{k}", "make")])
extractor("ex5_kotlin", "d/{k}.kt", "package p\nimport a.b.C as D\nclass K{k} {\n  fun run{k}() {\n    helper(1)\n    launch { work() }\n  }\n}\nobject O{k}\n",
          {"package": ["p"], "import": ["a.b.C"], "type": ["K{k}", "O{k}"], "function": ["run{k}"]}, [("run{k}", "helper"), ("run{k}", "launch"), ("run{k}", "work")])
extractor("ex6_cpp", "d/{k}.cpp", '#include <vector>\n#include "my{k}.h"\nclass Foo{k} { };\nstruct Bar{k} { int x; };\nint Foo{k}::go{k}(int a) {\n  return run(a);\n}\n', {"import": ["vector", "my{k}.h"], "type": ["Foo{k}", "Bar{k}"], "function": ["Foo{k}::go{k}"]})
extractor("ex6_c", "d/{k}.c", "#include <stdio.h>\nstruct S{k} { int a; };\nstatic int add{k}(int a, int b) {\n  return a + b;\n}\n", {"import": ["stdio.h"], "type": ["S{k}"], "function": ["add{k}"]})
extractor("ex7_rust", "d/{k}.rs", 'use std::io;\npub struct P{k} { x: i32 }\ntrait T{k} { fn m{k}(&self); }\nenum E{k} { A }\nfn main{k}() { println!("fn no"); }\n', {"import": ["std::io"], "type": ["P{k}", "T{k}", "E{k}"], "function": ["m{k}", "main{k}"]})
extractor("ex8_scala", "d/{k}.scala", "package a.b\nimport x.y.{A, B => C, _}\nclass S{k} { def run{k}() = { helper{k}(); xs.map(i => other(i)) }\n def helper{k}() = 1 }\nobject O{k}\n",
          {"package": ["a.b"], "import": ["x.y.A", "x.y.B", "x.y._"], "type": ["S{k}", "O{k}"], "function": ["run{k}", "helper{k}"]}, [("run{k}", "helper{k}"), ("run{k}", "map"), ("run{k}", "other")])
extractor("ex9_swift", "d/{k}.swift", "import Foundation\nclass A{k}: B { func go{k}(x: Int) { run() } }\nstruct S{k} { }\nprotocol P{k} { }\n", {"import": ["Foundation"], "type": ["A{k}", "S{k}", "P{k}"], "function": ["go{k}"]})
extractor("ex10_ruby", "d/{k}.rb", "require 'json'\nmodule M{k}\n  class K{k}\n    def run{k}\n    end\n    def self.make{k}\n    end\n  end\nend\n", {"import": ["json"], "type": ["M{k}", "K{k}"], "function": ["run{k}", "make{k}"]})
extractor("ex11_csharp", "d/{k}.cs", "using System.Text;\npublic class K{k} {\n  public K{k}(int a) { }\n  public int Run{k}(string s) { return 1; }\n}\ninterface I{k} { }\n", {"import": ["System.Text"], "type": ["K{k}", "I{k}"], "function": ["K{k}", "Run{k}"]})
extractor("ex12_typescript", "d/{k}.ts", "import { x } from './x{k}';\ninterface I{k} { a: string }\ntype T{k} = string;\nclass K{k} { run{k}(a: number): void { go(); } }\nfunction f{k}() { return g(1); }\n",
          {"import": ["./x{k}"], "type": ["I{k}", "T{k}", "K{k}"], "function": ["run{k}", "f{k}"]}, [("run{k}", "go"), ("f{k}", "g")])
extractor("ex12_jsx", "d/{k}.jsx", "import R from 'react';\nconst App{k} = (p) => { return go(p); };\nfunction f{k}() {}\n", {"import": ["react"], "function": ["App{k}", "f{k}"]}, [("App{k}", "go")])
extractor("ex13_bash", "d/{k}.sh", "source ./lib{k}.sh\nfunction one{k} {\n :\n}\ntwo{k}() {\n :\n}\n", {"import": ["./lib{k}.sh"], "function": ["one{k}", "two{k}"]})
extractor("ex14_groovy", "d/{k}.groovy", "package g\nimport a.B\nclass K{k} {\n  def run{k}(x) { go() }\n}\n", {"package": ["g"], "import": ["a.B"], "type": ["K{k}"], "function": ["run{k}"]})
extractor("ex14_css", "d/{k}.css", "/* x { } */ .a{k}, .b { color: red }\n@media print { #c{k} { x: y } }\n", {"type": [".a{k}, .b", "#c{k}"]})
extractor("ex16_markdown", "d/{k}.md", "# One {k} #\n## Two two\n### Three\n#### Four\n# 12\n```go\n# not\n```\n```mermaid\ngraph TD\nA[Web {k}] --> B((Store)) --> C{Is it?}\n```\n", {"topic": ["One {k}", "Two two", "Three"], "type": ["Web {k}", "Store", "Is it?"]})
extractor("ex29_mermaid_labels", "d/{k}.markdown", "```mermaid\nA[Web {k}] --> B((Store)) --> C{Is it?} --> D[[Sub proc]] --> E([Base {k}]) --> F[http://x]\n```\n", {"type": ["Web {k}", "Store", "Is it?", "Sub proc", "Base {k}"]})
extractor("ex17_html", "d/{k}.html", '<title>My App {k}</title><h1>Welcome <b>x</b> more</h1><h2><i>in</i>About {k}</h2><h4>no</h4><div id="main-{k}"></div><p id=bare></p><h3>  </h3>', {"topic": ["My App {k}", "Welcome", "About {k}"], "type": ["main-{k}"]})
extractor("ex18_yaml", "d/{k}.yaml", 'apiVersion: v1\nkind: Deployment\nmetadata:\n  name: app-{k}\nspec:\n  image: "img:1"\n  on: true\n---\nother: {name: flow}\n', {"type": ["apiVersion", "kind", "Deployment", "metadata", "spec", "other", "app-{k}", "img:1"]})
extractor("ex21_graphql", "d/{k}.graphql", "type Query {\n  user{k}(id: ID): User\n  _all: [X] # {\n}\nextend type Mutation {\n  add{k}(x: In): X\n}\ntype User{k} {\n  name: String\n}\ndirective @auth{k} on FIELD\nenum __Type { A }\nunion U{k} = A | B\n",
          {"type": ["Query", "Mutation", "User{k}", "@auth{k}", "U{k}"], "function": ["user{k}", "_all", "add{k}"]})
extractor("ex23_cmake", "d/{k}.cmake", "project(Mine{k} VERSION 1)\nadd_library(lib{k} STATIC a.c)\nFIND_PACKAGE(Boost REQUIRED)\n# include(no)\ninclude(mod{k})\nadd_executable(\n x)\n", {"type": ["Mine{k}", "lib{k}"], "import": ["Boost", "mod{k}"]})
extractor("ex24_assembly", "d/{k}.asm", '* comment\nSTART{k}: LDA #1 ; x\nLIMIT .EQ 5\nMYMAC MAC\nINNER NOP\n <<<\n PUT "other{k}.s"\nLAST RTS\n', {"function": ["START{k}", "MYMAC", "LAST"], "type": ["LIMIT"], "import": ["other{k}.s"]})

_PDF = "%PDF-1.4\n1 0 obj\n<< /Type /Catalog /Pages 2 0 R >>\nendobj\n2 0 obj\n<< /Type /Pages /Kids [3 0 R] /Count 1 >>\nendobj\n3 0 obj\n<< /Type /Page /Parent 2 0 R /Contents 4 0 R >>\nendobj\n4 0 obj\n<< /Length 75 >>\nstream\nBT /F1 12 Tf (A page of the part {k}, which is long enough to keep) Tj ET\nendstream\nendobj\n%%EOF"
add(
    "ex25_pdf_observations", lambda spark, sf_dir: files.extract_files(file_rows(spark, sf_dir, "d/{k}.pdf", _PDF)).observations.select("entity_id", "content"),
    values_sql([("pdf:d/{k}.pdf", "A page of the part {k}, which is long enough to keep")], "entity_id, content", "").replace("SELECT , ", "SELECT "),
)
add(
    "ex15_callee", lambda spark, sf_dir: read(spark, sf_dir, "part").select("p_partkey", _mapped(callee, F.concat(F.lit("a."), F.element_at(F.array(F.lit("b.c"), F.lit("b[0]"), F.lit("run_x")), (F.col("p_partkey") % 3 + 1).cast("int")))).alias("callee")),
    "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'c' WHEN 2 THEN 'run_x' END AS callee FROM part",
)


def _mapped(f: Callable[[str], str | None], c: Column) -> Column:
    return F.arrow_udf(lambda a: pa.array([None if x is None else f(x) for x in a.to_pylist()], pa.string()), T.StringType())(c)


_PATHS = ["d/{k}.py", "d/{k}.S", "d/Makefile", "x.{k}.schema.json", "CMakeLists.txt", "d/{k}.MD", "d/{k}.html", "d/{k}.unknown", "noext{k}"]
_FORMATS = ["python", "assembly", "makefile", "json_schema", "cmake", "markdown", "html", "", ""]


def _paths(spark: SparkSession, sf_dir: str, paths: list[str]) -> DataFrame:
    return read(spark, sf_dir, "part").select(F.expr(_KEY.format(text="STRING")).alias("k"), F.explode(F.array(*map(filled, paths))).alias("path"))


add("src7_format_of", lambda spark, sf_dir: _paths(spark, sf_dir, _PATHS).select("k", "path", _mapped(lambda p: format_of(p) or "", F.col("path")).alias("format")), values_sql(list(zip(_PATHS, _FORMATS)), "path, format"))
_RULES = files.IgnoreRules.parse("*.log\n!keep.log\n/top.txt\nbuild/\n", "a/**/z\n")
_IGNORED = [("x{k}.log", "y"), ("d/x.log", "y"), ("keep.log", "n"), ("top.txt", "y"), ("d/top.txt", "n"), ("build/{k}", "y"), ("build", "n"), ("a/b/{k}/z", "y"), ("a/y", "n")]
add("src3_ignore_rules", lambda spark, sf_dir: _paths(spark, sf_dir, [p for p, _ in _IGNORED]).select("k", "path", F.when(_RULES.predicate(F.col("path")), "y").otherwise("n").alias("ignored")), values_sql(_IGNORED, "path, ignored"))
_MODULES = files.Scope("m", include=("src/**/*",), include_modules=("A", "B"))
_INSIDE = [("modules/A/{k}", "y"), ("modules/C/{k}", "n"), ("src/{k}.c", "y"), ("other/{k}.c", "n"), ("modules/B", "y")]
add("src5_modules", lambda spark, sf_dir: _paths(spark, sf_dir, [p for p, _ in _INSIDE]).select("k", "path", F.when(_MODULES.predicate(F.col("path")), "y").otherwise("n").alias("inside")), values_sql(_INSIDE, "path, inside"))

# ---------------------------------------------------------------- logs

_EXEC = "Tool: Read(a.go, 1)\n🔧 Tool: Read(b{k}.go) 🔧 Tool: Bash(x)\nTurn 3 (inactive: 1)\ncumulative:50\n🔧 Tool: Edit(c.go)\n"
_META = '{"role": "dev", "status": "done", "description": "part {k}"}'
_EXEC_SAID = [("role: dev",), ("status: done",), ("task: part {k}",), ("turns: 3",), ("total_tokens: 50",), ("tool_calls: Edit:1, Read:1",), ("files_touched: b{k}.go, c.go",)]


def _exec_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spread(read(spark, sf_dir, "part").select("p_partkey"), "p_partkey").select(F.expr(_KEY.format(text="STRING")).alias("k"), files.exec_lines(filled(_EXEC), filled(_META)).alias("x"))
    return rows.select("k", F.explode("x").alias("content"))


def _log_query(name: str, path: str, text: str, rows: list[tuple[str, str]], counts: tuple[int, int, int], year: int = 2024) -> None:
    """Entities with their observations, and lines, errors and warnings, of one log for each part."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = file_rows(spark, sf_dir, path, text).select(F.col("rel_path").alias("path"), F.col("content").cast("string").alias("log_text"))
        r = files.parse_logs(df, year).withColumn("k", F.regexp_extract("path", r"(\d{8})", 1))
        row = lambda entity, said: F.struct(entity.alias("entity"), said.alias("said"))
        said = F.flatten(F.transform("entities", lambda e: F.transform(e["observations"], lambda o: row(e["name"], o))))
        return r.select("k", F.inline(F.concat(said, F.array(row(F.lit(""), F.concat_ws(" ", "lines", "errors", "warnings"))))))

    add(name, run, values_sql([*rows, ("", " ".join(map(str, counts)))], "entity, said"))


_BOOT = "2024-01-15 10:30:45.123  INFO 1 --- [main] a.B : hi\n2024-01-15 10:31:00.000 ERROR 1 --- [w-1] a.C : x.Foo{k}Exception: bad\n\tat a.B.run(B.java:12)\n2024-01-15 10:32:00.000 ERROR 1 --- [w] a.C : x.Foo{k}Exception: again\n2024-01-15 10:33:00.000  WARN 1 --- [w] a.C : w\n"
_log_query(
    "ex31_registry_and_ex35_observations", "l/{k}/app.log", _BOOT,
    [("error:x.Foo{k}Exception:2024-01-15", s) for s in ("source: l/{k}/app.log", "severity: error", "timestamp: 2024-01-15T10:31:00Z", "message: x.Foo{k}Exception: bad", "exception_type: x.Foo{k}Exception", "file: app.log", "logger: a.C", "thread: w-1")], (5, 2, 1),
)
add("ex30_exec_observations", _exec_observations, values_sql(_EXEC_SAID, "content"))
add(
    "ex33_logcat",
    lambda spark, sf_dir: files.parse_logs(
        file_rows(spark, sf_dir, "l/{k}-android.txt", "01-15 10:30:45.123  12  34 E AndroidRuntime: FATAL EXCEPTION: main{k}\n01-15 10:30:45.124  12  34 E AndroidRuntime: java.lang.Bad{k}Error: oops\n  at a.B.go(B.kt:3)\nend\n01-15 10:31:45.124  12  34 W T: w\n").select(F.col("rel_path").alias("path"), F.col("content").cast("string").alias("log_text")), 2023
    ).select(F.explode("entities.name").alias("name"), "format", "errors", "warnings").select(F.regexp_extract("name", r"(\d{8})", 1).alias("k"), "name", F.concat_ws(" ", "errors", "warnings").alias("said")),
    values_sql([("crash:main{k}:2023-01-15-10:30", "2 1"), ("error:java.lang.Bad{k}Error:2023-01-15", "2 1")], "name, said"),
)
add(
    "ex34_crash_report",
    lambda spark, sf_dir: files.parse_logs(
        file_rows(spark, sf_dir, "l/{k}.crash", "Incident Identifier: ID-{k}\nException Type:  EXC_BAD\nException Codes: 0x1\nException Subtype: sub\nDate/Time:  2024-01-02 03:04:05.60 +0200\nThread 0 Crashed:\n0   App  0x00a1 Foo.bar(x) + 12\n").select(F.col("rel_path").alias("path"), F.col("content").cast("string").alias("log_text")), 2024
    ).select(F.explode("entities").alias("e")).select(F.regexp_extract("e.name", r"(\d{8})", 1).alias("k"), "e.name", F.col("e.message").alias("message")),
    values_sql([("crash:ID-{k}", "0x1 | sub")], "name, message"),
)

# ---------------------------------------------------------------- conversion


def conversion(name: str, path: str, text: str, markdown: str) -> None:
    add(name, lambda spark, sf_dir: file_rows(spark, sf_dir, path, text).select("k", converted(F.col("rel_path"), F.col("content")).alias("c")).select("k", "c.markdown"), values_sql([(markdown,)], "markdown"))


conversion("md2_html_markup", "d/{k}.html", "<h1>T <b>{k}</b></h1><p>one<br>two <a href='u'>l</a></p><ul><li>a<li>b<ol><li>c</ol></ul><script>x</script><pre>k\n v</pre><table><tr><th>h<th>i<tr><td>1<td>2</table><blockquote>q</blockquote>",
           "# T **{k}**\n\none  \ntwo [l](u)\n\n- a\n- b\n  1. c\n\n```\nk\n v\n```\n\n| h   | i   |\n| --- | --- |\n| 1   | 2   |\n\n> q")
conversion("md4_json_pretty", "d/{k}.json", '{"b": "{k}", "a": [1.5, "<&>", null, true], "c": {}, "d": []}', '```json\n{\n  "a": [\n    1.5,\n    "\\u003c\\u0026\\u003e",\n    null,\n    true\n  ],\n  "b": "{k}",\n  "c": {},\n  "d": []\n}\n```')
conversion("md5_xml_fence", "d/{k}.xml", "<a>{k}</a>", "```xml\n<a>{k}</a>\n```")
conversion("md6_table", "d/{k}.csv", 'Name,A|B\n"x,""y",{k}\n', '| Name | A\\|B     |\n| ---- | -------- |\n| x,"y | {k} |\n')
conversion("md11_pdf_pages", "d/{k}.pdf", _PDF, "A page of the part {k}, which is long enough to keep")


def _zipped(**parts: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def office(name: str, extension: str, parts: Callable[[str], dict[str, str]], markdown: str) -> None:
    """A file of its own for every part, zipped in Arrow batches."""

    def made(keys: pa.Array) -> pa.Array:
        return pa.array([_zipped(**parts(k)) for k in keys.to_pylist()], pa.binary())

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = spread(read(spark, sf_dir, "part").select("p_partkey"), "p_partkey").select(F.expr(_KEY.format(text="STRING")).alias("k"))
        return rows.select("k", converted(F.lit("f." + extension), F.arrow_udf(made, T.BinaryType())("k")).alias("c")).select("k", "c.markdown")

    add(name, run, values_sql([(markdown,)], "markdown"))


def _docx(k: str) -> dict[str, str]:
    par = lambda text, props="", run="": f"<w:p><w:pPr>{props}</w:pPr><w:r><w:rPr>{run}</w:rPr><w:t>{text}</w:t></w:r></w:p>"
    body = par(f"Head {k}", '<w:pStyle w:val="Heading2"/>') + par("bold", "", "<w:b/>") + par("item", '<w:numPr><w:ilvl w:val="1"/></w:numPr>')
    return {"word/document.xml": f'<w:document xmlns:w="urn:w"><w:body>{body}</w:body></w:document>'}


def _xlsx(k: str) -> dict[str, str]:
    book = '<workbook xmlns:r="urn:r"><sheets><sheet name="One" r:id="rId1"/></sheets></workbook>'
    rels = '<Relationships><Relationship Id="rId1" Target="worksheets/s1.xml"/></Relationships>'
    sheet = '<worksheet><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>in</t></is></c></row><row r="2"><c r="B2"><v>2.5</v></c></row></sheetData></worksheet>'
    return {"xl/workbook.xml": book, "xl/_rels/workbook.xml.rels": rels, "xl/sharedStrings.xml": f"<sst><si><t>{k}</t></si></sst>", "xl/worksheets/s1.xml": sheet}


def _pptx(k: str) -> dict[str, str]:
    shape = lambda kind, text: f'<p:sp><p:nvSpPr><p:nvPr><p:ph type="{kind}"/></p:nvPr></p:nvSpPr><p:txBody><a:p><a:r><a:rPr/><a:t>{text}</a:t></a:r></a:p></p:txBody></p:sp>'
    slide = lambda title, body: f'<p:sld xmlns:a="urn:a" xmlns:p="urn:p"><p:cSld><p:spTree>{shape("title", title)}{shape("body", body)}</p:spTree></p:cSld></p:sld>'
    return {"ppt/slides/slide10.xml": slide("Last", "end"), "ppt/slides/slide2.xml": slide(f"First {k}", "text")}


office("md7_docx", "docx", _docx, "## Head {k}\n\n**bold**\n\n  - item\n")
office("md8_xlsx", "xlsx", _xlsx, "## One\n\n| {k} | in  |\n| -------- | --- |\n|          | 2.5 |\n\n")
office("md9_pptx", "pptx", _pptx, "## First {k}\n\ntext\n---\n\n## Last\n\nend\n")

# ---------------------------------------------------------------- scalars

add("sc11_first_argument", lambda spark, sf_dir: read(spark, sf_dir, "part").select("p_partkey", strings.first_argument(F.concat(F.lit("  "), "p_name", F.lit(";x"))).alias("t")), "SELECT p_partkey, regexp_extract(trim(concat('  ', p_name, ';x')), '^[^ ;]*') AS t FROM part")
add(
    "sc18_change", lambda spark, sf_dir: read(spark, sf_dir, "part").select("p_partkey", strings.change(F.lit(4.0) * (F.col("p_partkey") % 2), F.lit(5.0)).alias("t")),
    "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN '(no baseline)' ELSE '+25.0%' END AS t FROM part",
)
add(
    "ex26_whitespace_of_documents", lambda spark, sf_dir: read(spark, sf_dir, "documents").select("doc_id", F.md5(strings.normalise_whitespace(F.concat(F.col("text"), F.lit(" \t\n\n\n\n\n\n"), F.col("text"), F.lit("  \r\n"))).cast("binary")).alias("h")),
    r"SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(t, '[ \t\r]+(\n|$)', '\1', 'g'), '\n{4,}', e'\n\n\n', 'g'), '^\s+|\s+$', '', 'g')) AS h FROM (SELECT doc_id, concat(text, e' \t\n\n\n\n\n\n', text, e'  \r\n') AS t FROM documents WHERE text IS NOT NULL) UNION ALL SELECT doc_id, NULL FROM documents WHERE text IS NULL",
)
add(
    "ex28_significant_words", lambda spark, sf_dir: read(spark, sf_dir, "documents").select("doc_id", F.size(F.filter(F.split("text", " "), lambda w: strings.significant(w))).cast("long").alias("n")),
    "SELECT doc_id, coalesce(len(list_filter(string_split(text, ' '), lambda w: strlen(w) >= 3 AND NOT regexp_full_match(w, '[0-9]+'))), -1) AS n FROM documents",
)
add(
    "ex27_chunks", lambda spark, sf_dir: read(spark, sf_dir, "documents").select("doc_id", _chunk_facts("text").alias("c")).select("doc_id", "c.numbered", "c.bound"),
    "SELECT doc_id, strlen(text) > 2000 AS numbered, true AS bound FROM documents",
)


def _chunk_facts(column: str) -> Column:
    """Whether the first of several chunks carries its number, and none is over the limit by more than that, or loses a word."""
    from .functions.extract.documents import CHUNK_BYTES, chunk_text

    def run(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts.to_pylist():
            own = t or ""
            parts = chunk_text(own)
            bare = [p.split("] ", 1)[1] if p.startswith("[PDF chunk ") else p for p in parts]
            whole = "".join("".join(bare).split()) == "".join(own.split())
            out.append({"numbered": parts[0].startswith("[PDF chunk 1] ") if parts else False, "bound": whole and all(len(p.encode()) <= CHUNK_BYTES for p in bare)})
        return pa.array(out, pa.struct([("numbered", pa.bool_()), ("bound", pa.bool_())]))

    return F.arrow_udf(run, T.StructType([T.StructField("numbered", T.BooleanType()), T.StructField("bound", T.BooleanType())]))(column)


add("st2_hourly_counts", lambda spark, sf_dir: _available(spark, log_stream.hourly_counts(log_stream.read_events(spark, sf_dir), "3650 days"), "complete"), "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY ALL")


def _shared(spark: SparkSession, label: str) -> Path:
    """A folder of our own in the shared one, seen as a mounted file system."""
    base = (spark.conf.get("spark.checkpoint.dir", None) or "/tmp/spindle-checkpoints").removeprefix("file://").rstrip("/")
    folder = Path(base) / f"{label}-{uuid.uuid4().hex}"
    folder.mkdir(parents=True)
    return folder


def _available(spark: SparkSession, stream: DataFrame, mode: str) -> DataFrame:
    """The whole result of a streaming aggregation after what is there now, from its memory table."""
    name = f"m{uuid.uuid4().hex}"
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(_shared(spark, "stream"))).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


# ---------------------------------------------------------------- trees of files, one a nation


def _tree(spark: SparkSession, sf_dir: str, files_of: Callable[[int, str], dict[str, str]]) -> Path:
    """Files below a folder of the shared one; nations are a fixed handful."""
    root = _shared(spark, "tree")
    for r in read(spark, sf_dir, "nation").select("n_nationkey", "n_name").collect():
        for name, text in files_of(int(r["n_nationkey"]), r["n_name"]).items():
            path = root / name
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_text(text)
    return root


def _sources(k: int, name: str) -> dict[str, str]:
    return {f"src/{k}/a.py": f"def f{k}(): pass\n", f"node_modules/{k}.js": "x", f"d/{k}/.git/c.py": "x", f"log/{k}.log": name, f"{k}.MD": f"# {name}\n"}


def _source_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = _tree(spark, sf_dir, _sources)
    return files.source_files(spark, str(root), ignore=files.IgnoreRules.parse("*.log")).select("rel_path", "ext", "size", F.col("content").cast("string").alias("content"))


_NATIONS = "SELECT n_nationkey AS k, n_name AS name FROM nation"
for _name in ("src1_walk", "src2_skipped_folders"):
    add(
        _name, _source_tree,
        f"SELECT concat('src/', k, '/a.py') AS rel_path, '.py' AS ext, strlen(c) AS size, c AS content FROM (SELECT k, concat('def f', k, '(): pass', chr(10)) AS c FROM ({_NATIONS})) "
        f"UNION ALL SELECT concat(k, '.MD'), '.md', strlen(name) + 3, concat('# ', name, chr(10)) FROM ({_NATIONS})",
    )
add(
    "src11_exec_logs", lambda spark, sf_dir: files.exec_logs(spark, str(_tree(spark, sf_dir, lambda k, n: {f"t{k}/execution.log": f"Turn {k} (inactive: 1)\n", f"t{k}/00-metadata.json": json.dumps({"role": n})}))).select("task", "entity_name", "content"),
    f"SELECT concat('t', k) AS task, concat('exec:t', k) AS entity_name, concat('role: ', name) AS content FROM ({_NATIONS}) UNION ALL SELECT concat('t', k), concat('exec:t', k), concat('turns: ', k) FROM ({_NATIONS})",
)
add(
    "src12_app_logs", lambda spark, sf_dir: files.app_logs(spark, str(_tree(spark, sf_dir, lambda k, n: {f"logs/{k}/app.log": _BOOT.replace("{k}", str(k)), f"node_modules/{k}/app.log": _BOOT, f"notes/{k}.txt": n})), 2024).select("path", "format", "lines", "errors", "warnings"),
    f"SELECT concat('logs/', k, '/app.log') AS path, 'spring-boot' AS format, CAST(5 AS BIGINT) AS lines, CAST(2 AS BIGINT) AS errors, CAST(1 AS BIGINT) AS warnings FROM ({_NATIONS})",
)
add(
    "src13_metrics", lambda spark, sf_dir: files.metrics(spark, str(_tree(spark, sf_dir, lambda k, n: {f"t{k}/metrics.json": json.dumps({"kg_preflight_bytes": k, "turns": 2 * k, "total_tokens": 10, "duration_ms": 4, "exploration_ratio": 0.5, "has_errors": k % 2 == 0}) if k else "{"}))),
    f"SELECT CAST(k AS BIGINT) AS preflight_bytes, CAST(2 * k AS BIGINT) AS turns, CAST(10 AS BIGINT) AS total_tokens, CAST(4 AS BIGINT) AS duration_ms, CAST(0.5 AS DOUBLE) AS exploration_ratio, k % 2 = 0 AS has_errors FROM ({_NATIONS}) WHERE k > 0",
)

# ---------------------------------------------------------------- stores


def on_store(act: Callable[[Store, SparkSession, str], DataFrame]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        with Store(spark, str(_shared(spark, "store")), width=2) as s:
            return act(s, spark, sf_dir)

    return run


def _loaded(s: Store, spark: SparkSession, sf_dir: str) -> Store:
    """Customers as entities, an edge from each to its nation, and an observation on each."""
    customers, nations = read(spark, sf_dir, "customer"), read(spark, sf_dir, "nation")
    stamp = F.timestamp_seconds(F.lit(0))
    shape = lambda rows, kind: rows.select(F.concat(F.lit(kind + ":"), "k").alias("id"), "name", F.lit(kind).alias("type"), F.lit("p").alias("project_id"), stamp.alias("created_at"), stamp.alias("updated_at"))
    entities = shape(customers.select(F.col("c_custkey").cast("string").alias("k"), F.col("c_name").alias("name")), "customer").unionByName(shape(nations.select(F.col("n_nationkey").cast("string").alias("k"), F.col("n_name").alias("name")), "nation"))
    edges = customers.select(F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("from_id"), F.concat(F.lit("nation:"), F.col("c_nationkey").cast("string")).alias("to_id"), F.lit("BELONGS_TO").alias("rel_type"), F.lit(0).cast("long").alias("seq"))
    said = customers.select(F.concat(F.lit("o:"), F.col("c_custkey").cast("string")).alias("id"), F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("entity_id"), F.col("c_mktsegment").alias("content"), stamp.alias("created_at"), F.lit(True).alias("linked"))
    empty = lambda t, rows: s.spark.createDataFrame([], s.table(t).schema).unionByName(rows, allowMissingColumns=True)
    s.replace({"entity": empty("entity", entities), "relation": empty("relation", edges), "observation": empty("observation", said)})
    return s


def _facts(s: Store) -> DataFrame:
    g = s.graph()
    return (
        g.entity.select(F.lit("entity").alias("what"), F.concat_ws(" ", "id", "name").alias("said"))
        .unionByName(g.relation.select(F.lit("relation").alias("what"), F.concat_ws(" ", "from_id", "to_id", "rel_type").alias("said")))
        .unionByName(g.observation.select(F.lit("observation").alias("what"), F.concat_ws(" ", "id", "entity_id", "content", F.col("linked").cast("string")).alias("said")))
    )


_ENTITY_SQL = "SELECT 'entity' AS what, concat('customer:', c_custkey, ' ', c_name) AS said FROM customer{c} UNION ALL SELECT 'entity', concat('nation:', n_nationkey, ' ', n_name) FROM nation{n}"
_EDGE_SQL = "SELECT 'relation' AS what, concat('customer:', c_custkey, ' nation:', c_nationkey, ' BELONGS_TO') AS said FROM customer{c}"
_SAID_SQL = "SELECT 'observation' AS what, concat('o:', c_custkey, ' customer:', c_custkey, ' ', c_mktsegment, ' true') AS said FROM customer{c}"


def facts_sql(entity: str = "", nation: str = "", edge: str = "", said: str = "", more: str = "") -> str:
    return " UNION ALL ".join([_ENTITY_SQL.format(c=entity, n=nation), _EDGE_SQL.format(c=edge), _SAID_SQL.format(c=said)]) + more


def changed(act: Callable[[Store], object]) -> Query:
    def run(s: Store, spark: SparkSession, sf_dir: str) -> DataFrame:
        act(_loaded(s, spark, sf_dir))
        return _facts(s)

    return on_store(run)


_PLUS = " UNION ALL SELECT 'relation', 'customer:1 nation:2 RELATED_TO'"
for _name in ("src8_bulk_entities", "src10_bulk_observations", "src15_schema"):
    add(_name, changed(lambda s: None), facts_sql())
add("src14_read_only_store", on_store(lambda s, spark, sf_dir: _facts(Store(spark, str(_loaded(s, spark, sf_dir).folder), read_only=True))), facts_sql())
add("crud5_delete_entity", changed(lambda s: s.delete_entity("customer:1", "p")), facts_sql(" WHERE c_custkey <> 1", "", " WHERE c_custkey <> 1", " WHERE c_custkey <> 1", " UNION ALL SELECT 'observation', concat('o:1 customer:1 ', c_mktsegment, ' false') FROM customer WHERE c_custkey = 1"))
add("crud8_delete_observation", changed(lambda s: s.delete_observation("o:2", "customer:2", "p")), facts_sql(said=" WHERE c_custkey <> 2"))
add("crud11_delete_relation", changed(lambda s: s.delete_relation("customer:1", s.table("relation").where("from_id = 'customer:1'").head()["to_id"], "BELONGS_TO", "p")), facts_sql(edge=" WHERE c_custkey <> 1"))


def _made(s: Store, spark: SparkSession, sf_dir: str) -> DataFrame:
    """What CRUD1, CRUD6, CRUD9 and CRUD13 make, by names, since ids are random."""
    a, b = s.create_entity("A", "file", "p"), s.create_entity("B", "file", "p")
    s.create_observation(a, "can't \"fail\"", "p")
    for _ in range(2):
        s.create_relation(a, b, "CALLS", "p")
    s.create_relation(a, "missing", "CALLS", "p")
    refused = 0
    try:
        s.create_relation(a, b, "LIKES", "p")
    except ValueError:
        refused = 1
    g = s.graph()
    names = g.entity.select("id", "name")
    out = g.entity.select(F.lit("entity").alias("what"), F.concat_ws(" ", "name", "type", "project_id").alias("said"))
    out = out.unionByName(g.observation.join(names.toDF("entity_id", "n"), "entity_id").select(F.lit("observation").alias("what"), F.concat_ws(" ", "n", "content").alias("said")))
    edges = g.relation.join(names.toDF("from_id", "x"), "from_id").join(names.toDF("to_id", "y"), "to_id")
    return out.unionByName(edges.select(F.lit("relation").alias("what"), F.concat_ws(" ", "x", "rel_type", "y").alias("said"))).unionByName(spark.range(refused).select(F.lit("refused").alias("what"), F.lit("LIKES").alias("said")))


_MADE_SQL = "SELECT * FROM (VALUES ('entity', 'A file p'), ('entity', 'B file p'), ('observation', 'A can''t \"fail\"'), ('relation', 'A CALLS B'), ('relation', 'A CALLS B'), ('refused', 'LIKES')) v(what, said)"
for _name in ("crud1_create_entity", "crud6_create_observation", "crud9_create_relation", "crud13_relation_types"):
    add(_name, on_store(_made), _MADE_SQL)


def _embedded(s: Store, spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _loaded(s, spark, sf_dir)
    s.set_embedding("entity", "customer:1", [1.0, 2.0])
    return s.unembedded("entity").select("id", "text")


_TODO = "SELECT concat('customer:', c_custkey) AS id, concat('customer: ', c_name) AS text FROM customer WHERE c_custkey <> 1 UNION ALL SELECT concat('nation:', n_nationkey), concat('nation: ', n_name) FROM nation"
add("crud14_set_embedding", on_store(_embedded), _TODO)
add("crud15_unembedded_rows", on_store(_embedded), _TODO)


def _all_embedded(s: Store, spark: SparkSession, sf_dir: str) -> DataFrame:
    import pandas as pd

    s = _loaded(s, spark, sf_dir)
    s.embed_all("entity", lambda x: pd.Series([[float(len(t)), 0.0] for t in x]))
    return s.table("entity").select("id", F.col("embedding")[0].cast("long").alias("n"))


add("r14_embed_all", on_store(_all_embedded), "SELECT concat('customer:', c_custkey) AS id, length(c_name) + 10 AS n FROM customer UNION ALL SELECT concat('nation:', n_nationkey), length(n_name) + 8 FROM nation")


def _again(s: Store, spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _loaded(s, spark, sf_dir)
    g = s.graph()
    s.reindex("p", g.entity.where("type = 'nation'"), g.relation.limit(0), g.observation.limit(0))
    return _facts(s).where("what = 'entity'")


add("src17_reindex", on_store(_again), "SELECT 'entity' AS what, concat('nation:', n_nationkey, ' ', n_name) AS said FROM nation")

# ---------------------------------------------------------------- patterns

_GUARDED = ["MATCH (n) RETURN n", "CREATE (n)", "MATCH (n) set n.x = 1", "RETURN 'please delete'", "MATCH (n) RETURN n.created", "match (n) DETACH delete n"]


def _allowed(text: str) -> str:
    try:
        pattern.guard(text)
        return "y"
    except pattern.QueryError:
        return "n"


add("p11_guard", lambda spark, sf_dir: _paths(spark, sf_dir, _GUARDED).select("k", "path", _mapped(_allowed, F.col("path")).alias("allowed")), values_sql(list(zip(_GUARDED, "ynnnyn")), "path, allowed"))


def cypher(text: str, **params) -> Query:
    from .plans import testgraph

    return lambda spark, sf_dir: pattern.query(testgraph.load(spark, sf_dir), text, params)


add("p9_not_pattern_rows", cypher("MATCH (n:Entity) WHERE n.type = 'nation' AND NOT (n)<-[:BELONGS_TO]-(:supplier) RETURN n.id AS id"), WITH + "SELECT id FROM entity e WHERE type = 'nation' AND NOT EXISTS (SELECT 1 FROM relation r JOIN entity s ON s.id = r.from_id AND s.type = 'supplier' WHERE r.to_id = e.id AND r.rel_type = 'BELONGS_TO')")
add("p9_not_pattern_orders", cypher("MATCH (c:customer) WHERE NOT (c)-[:PLACED]->(:order) RETURN c.id AS id"), WITH + "SELECT id FROM entity e WHERE type = 'customer' AND NOT EXISTS (SELECT 1 FROM relation r JOIN entity s ON s.id = r.to_id AND s.type = 'order' WHERE r.from_id = e.id AND r.rel_type = 'PLACED')")
add("crud16_parameters", cypher("MATCH (n:Entity) WHERE n.name = $x RETURN n.id AS id", x="ASIA' OR '1'='1"), WITH + "SELECT id FROM entity WHERE name = 'ASIA'' OR ''1''=''1'")

# ---------------------------------------------------------------- state, sessions and the driver's small rules


def _appended(make: Callable[[DataFrame], DataFrame], label: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return log_stream.run_available(make(log_stream.read_events(spark, sf_dir)), f"file://{_shared(spark, label)}")

    return run


add(
    "w7_error_streaks", _appended(log_stream.error_streaks, "streaks"),
    "WITH e AS (SELECT user_id, event_type = 'error' AS err, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM events), "
    "g AS (SELECT *, r - row_number() OVER (PARTITION BY user_id, err ORDER BY r) AS island FROM e), "
    "s AS (SELECT user_id, min(r) AS first, max(r) AS last, any_value(n) AS n, count(*) AS errors FROM g WHERE err GROUP BY user_id, island) "
    "SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY first) - 1 AS ordinal, errors FROM s WHERE last < n",
)
add(
    "st3_crash_sessions", _appended(log_stream.crash_sessions, "sessions"),
    "WITH e AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), "
    "s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e), "
    "g AS (SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS \"end\", count(*) AS events, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS errors FROM s GROUP BY user_id, k) "
    "SELECT * FROM g WHERE \"end\" <= (SELECT max(ts) - INTERVAL 30 MINUTE FROM events)",
)
add(
    "a13_exec_counts", lambda spark, sf_dir: _exec_observations(spark, sf_dir).where(F.col("content").rlike("^(turns|total_tokens|tool_calls|files_touched): ")),
    values_sql([r for r in _EXEC_SAID if r[0].split(":")[0] in ("turns", "total_tokens", "tool_calls", "files_touched")], "content"),
)


def _truthy(text: str) -> str:
    from .api import truthy

    return "y" if truthy(text) else "n"


_SAID = [("1", "y"), ("0", "n"), ("off", "n"), ("No", "n"), ("FALSE", "n"), (" yes ", "y"), ("", "n"), ("{k}", "y")]
add("sc23_truthy", lambda spark, sf_dir: _paths(spark, sf_dir, [p for p, _ in _SAID]).select("k", "path", _mapped(_truthy, F.col("path")).alias("truth")), values_sql(_SAID, "path, truth"))


def _service_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .queries import _logs

    return files.parse_logs(_logs(spark, sf_dir), 2024).select("path", "start", "end")


add("sc13_log_times", _service_times, "SELECT concat('logs/', user_id, '.log') AS path, min(date_trunc('millisecond', ts)) AS start, max(date_trunc('millisecond', ts)) AS \"end\" FROM events GROUP BY user_id")
