import pytest

from spindle.functions.extract import documents as d
from spindle.functions.extract import extract, format_of
from spindle.functions.extract.languages import callee


def run(path, text):
    r = extract(path, text.encode())
    assert r.error is None
    named = {}
    for name, kind in r.entities.values():
        named.setdefault(kind, []).append(name)
    return r, named


LANGUAGES = [
    ("a.go", "package mypkg\n\nimport \"fmt\"\n\n// Gone()\nfunc ExportedFunc() { helper.Do(1); s := `x(1)` }\nfunc (t *T) Method(x int) error { return nil }\nfunc unexported() {}\ntype ExportedType struct{ A int }\ntype Face interface{}\n",
     {"function": ["ExportedFunc", "Method"], "type": ["ExportedType", "Face"], "import": ["fmt"], "package": ["mypkg"]}),
    ("a.py", "import os\nfrom a.b import c\nclass K:\n    def run(self):\n        helper(1)\n        self.go()\ndef _hidden():\n    pass\ndef helper(x):\n    pass\n", {"function": ["run", "helper"], "type": ["K"], "import": ["os", "a.b"]}),
    ("A.java", "package x.y;\nimport java.util.List;\npublic class A implements B {\n  public A(int x) { go(); }\n  private static List<String> items(int n) { return make(n); }\n}\ninterface B { void m(); }\nenum C { X }\n", {"function": ["A", "items", "m"], "type": ["A", "B", "C"], "import": ["java.util.List"], "package": ["x.y"]}),
    ("a.kt", "package p\nimport a.b.C as D\nclass K {\n  fun run() {\n    helper(1)\n    launch { work() }\n    val f = ::handle\n  }\n}\nobject O\n", {"function": ["run"], "type": ["K", "O"], "import": ["a.b.C"], "package": ["p"]}),
    ("a.cpp", "#include <vector>\n#include \"my.h\"\nclass Foo { };\nstruct Bar { int x; };\nint Foo::go(int a) {\n  return run(a);\n}\n", {"function": ["Foo::go"], "type": ["Foo", "Bar"], "import": ["vector", "my.h"]}),
    ("a.c", "#include <stdio.h>\nstruct S { int a; };\nstatic int add(int a, int b) {\n  return a + b;\n}\n", {"function": ["add"], "type": ["S"], "import": ["stdio.h"]}),
    ("a.rs", "use std::io;\npub struct P { x: i32 }\ntrait T { fn m(&self); }\nenum E { A }\nfn main() { println!(\"fn no\"); }\n", {"function": ["m", "main"], "type": ["P", "T", "E"], "import": ["std::io"]}),
    ("a.scala", "package a.b\nimport x.y.{A, B => C, _}\nimport q.r._\nclass S { def run() = { helper(); xs.map(i => other(i)) }\n def helper() = 1 }\nobject S\n", {"function": ["run", "helper"], "type": ["S"], "import": ["x.y.A", "x.y.B", "x.y._", "q.r._"], "package": ["a.b"]}),
    ("a.swift", "import Foundation\nclass A: B { func go(x: Int) { run() } }\nstruct S { }\nprotocol P { }\n", {"function": ["go"], "type": ["A", "S", "P"], "import": ["Foundation"]}),
    ("a.rb", "require 'json'\nmodule M\n  class K\n    def run\n    end\n    def self.make\n    end\n  end\nend\n", {"function": ["run", "make"], "type": ["M", "K"], "import": ["json"]}),
    ("a.cs", "using System.Text;\npublic class K {\n  public K(int a) { }\n  public int Run(string s) { return 1; }\n}\ninterface I { }\n", {"function": ["K", "Run"], "type": ["K", "I"], "import": ["System.Text"]}),
    ("a.ts", "import { x } from './x';\ninterface I { a: string }\ntype T = string;\nclass K { run(a: number): void { go(); } }\nfunction f() { return g(1); }\n", {"function": ["run", "f"], "type": ["I", "T", "K"], "import": ["./x"]}),
    ("a.jsx", "import R from 'react';\nconst App = (p) => { return go(p); };\nfunction f() {}\n", {"function": ["App", "f"], "import": ["react"]}),
    ("a.sh", "source ./lib.sh\nfunction one {\n :\n}\ntwo() {\n :\n}\n", {"function": ["one", "two"], "import": ["./lib.sh"]}),
    ("a.groovy", "package g\nimport a.B\nclass K {\n  def run(x) { go() }\n}\n", {"function": ["run"], "type": ["K"], "import": ["a.B"], "package": ["g"]}),
    ("a.css", "/* x { } */ .a, .b { color: red }\n@media print { #c { x: y } }\n", {"type": [".a, .b", "#c"]}),
]


@pytest.mark.parametrize("path,text,expected", LANGUAGES, ids=[x[0] for x in LANGUAGES])
def test_languages(path, text, expected):
    r, named = run(path, text)
    assert named.pop("file") == [path]
    assert {k: sorted(v) for k, v in named.items()} == {k: sorted(v) for k, v in expected.items()}
    kinds = {t for _, _, t in r.relations}
    assert kinds <= {"CONTAINS", "IMPORTS", "BELONGS_TO"}


def test_calls():
    calls = lambda p, t: {(f.rsplit(":", 1)[1], c) for f, c in run(p, t)[0].calls}
    by = {p: t for p, t, _ in LANGUAGES}
    assert calls("a.go", by["a.go"]) == {("ExportedFunc", "Do")}
    assert calls("a.py", by["a.py"]) == {("run", "helper"), ("run", "go")}
    assert calls("A.java", by["A.java"]) == {("A", "go"), ("items", "make")}
    assert calls("a.kt", by["a.kt"]) == {("run", "helper"), ("run", "launch"), ("run", "work")}
    assert calls("a.scala", by["a.scala"]) == {("run", "helper"), ("run", "map"), ("run", "other")}
    assert calls("a.ts", by["a.ts"]) == {("run", "go"), ("f", "g")} and calls("a.jsx", by["a.jsx"]) == {("App", "go")}
    assert callee("a.b.c") == "c" and callee("a.b[0]") is None


def test_markdown():
    _, n = run("a.md", "# One #\n## Two two\n### Three\n#### Four\n# 12\n```go\n# not\n```\n```Mermaid\nA[Web App] --> B((Store)) --> C{Is it?} --> D[[Sub proc]] --> E([Base]) --> F[http://x]\n```\n")
    assert n["topic"] == ["One", "Two two", "Three"] and n["type"] == ["Web App", "Store", "Is it?", "Sub proc", "Base"]


def test_html():
    _, n = run("a.html", "<title>My App</title><h1>Welcome <b>x</b> more</h1><h2><i>in</i>About us</h2><h4>no</h4><div id=\"main-header\"></div><p id=bare></p><h3>  </h3>")
    assert n["topic"] == ["My App", "Welcome", "About us"] and n["type"] == ["main-header"]


def test_yaml():
    _, n = run("a.yaml", "apiVersion: v1\nkind: Deployment\nmetadata:\n  name: my-app\nspec:\n  image: \"img:1\"\n  on: true\nversion: 3\nvolumes: []\n---\nother: {name: flow}\n")
    assert n["type"] == ["apiVersion", "kind", "Deployment", "metadata", "spec", "other", "my-app", "img:1"] or set(n["type"]) == {"apiVersion", "kind", "Deployment", "metadata", "spec", "other", "my-app", "img:1"}
    assert extract("b.yml", b"a: [").error


def test_schema():
    assert run("x.schema.json", '{"title": " T ", "$defs": {"B": {}, "A": {}}, "definitions": {"C": 1}}')[1]["type"] == ["T", "A", "B", "C"]
    assert run("d/e.json", '{"$schema": "s", "$id": "http://x/y/thing.v1.json#frag"}')[1]["type"] == ["thing.v1"]
    assert run("d/e.schema.json", "{}")[1]["type"] == ["e"] and run("schema.json", "[1]")[0].entities == {}
    assert extract("plain.json", b'{"a": 1}') is None


def test_graphql():
    text = "type Query {\n  user(id: ID): User\n  _all: [X] # {\n}\nextend type Mutation {\n  add(x: In): X\n}\ntype User {\n  name: String\n}\ndirective @auth on FIELD\nenum __Type { A }\nunion U = A | B\n"
    _, n = run("a.graphql", text)
    assert n["type"] == ["Query", "Mutation", "User", "@auth", "U"] and n["function"] == ["user", "_all", "add"]


def test_build_files():
    _, n = run("Makefile", "# c: x\nCC := gcc\nall:\nbuild: dep\n\tgcc x: y\nX ::= y\nV ?= 1\n.PHONY: a\n")
    assert n["function"] == ["build", "X"] and n["type"] == ["CC", "V"]
    _, n = run("CMakeLists.txt", "project(Mine VERSION 1)\nadd_library(lib STATIC a.c)\nFIND_PACKAGE(Boost REQUIRED)\n# include(no)\ninclude(mod)\nadd_executable(\n x)\n")
    assert n["type"] == ["Mine", "lib"] and n["import"] == ["Boost", "mod"]


def test_assembly():
    text = "* comment\nSTART: LDA #1 ; x\nLIMIT .EQ 5\nMYMAC MAC\nINNER NOP\n <<<\n .MA SECOND\nLOC NOP\n .EM\n PUT \"other.s\"\n.1 NOP\nAB NOP\nLAST RTS\n"
    _, n = run("a.S.txt", text)
    assert n["function"] == ["START", "MYMAC", "SECOND", "LAST"] and n["type"] == ["LIMIT"] and n["import"] == ["other.s"]


def test_text_chunks():
    assert d.normalise_whitespace("a  \n\n\n\n\nb\r\n\n") == "a\n\n\nb"
    assert d.chunk_text("short") == ["short"]
    parts = d.chunk_text("a" * 40 + "\n" + "b" * 70, 100)
    assert len(parts) == 2 and parts[0] == "[PDF chunk 1] " + ("a" * 40 + "\n" + "b" * 59) and parts[1] == "b" * 11
    assert all(p.encode().decode() for p in d.chunk_text("あ" * 100, 100)) and d.chunk_text("x" * 60 + "\n" + "y" * 60, 100)[0].endswith("x")


def test_formats():
    assert [format_of(p) for p in ("a.S", "x/y.mk", "MAKE.TXT", "a.cmake", "b.unknown", "noext")] == ["assembly", "makefile", "makefile", "cmake", None, None]


def test_udf(spark):
    from spindle.sources.files import extract_files

    rows = [("a.py", b"def run():\n    helper()\ndef helper():\n    pass\n"), ("b.bin", b"x"), ("c.yaml", b"a: ["), ("d.md", None)]
    x = extract_files(spark.createDataFrame(rows, "rel_path string, content binary"))
    assert {r["id"] for r in x.entities.collect()} >= {"function:a.py:run", "file:d.md"} and x.calls.count() == 1
    assert [r["rel_path"] for r in x.errors.collect()] == ["c.yaml"]


def test_yaml_parsers_make_the_same_records(monkeypatch):
    """The parser in C is asked where both agree; what it can't read, and what only one of them reads, is as the one in Python has it."""
    import yaml

    texts = [
        "kind: Deployment\nname: app\nitems:\n- {name: flow, k: [a, b]}\n- image: 'img:1'\n", "a: |\n  kind: no\nname: >-\n  folded\n---\nother: yes\n", "one: 1\n--- {\n", "name: |# x", "a: &x\n  name: far\nb: *x\n", "name: h\u00e9 there\n", "kind:\t@tab\n",
        "", "name: [\n", "job:\n - stage: first stage\n - stage: 'second: stage'\n",
    ]
    got = [d.yaml("d/a.yaml", t).row() for t in texts]
    monkeypatch.setattr(yaml, "SafeLoader", None)  # from here on a text for it alone can't be read
    assert d.yaml("d/a.yaml", texts[0]).row() == got[0]
    monkeypatch.undo()
    monkeypatch.delattr(yaml, "CSafeLoader", raising=False)
    assert got == [d.yaml("d/a.yaml", t).row() for t in texts]


#: Queries that make a file of each row of a table which is small on disk.
ONCE = [
    "ex18_yaml",
    "ex12_jsx",
    "ex11_csharp",
    "ex2_go",
    "ex10_ruby",
    "ex21_graphql",
    "ex18_yaml_names",
    "md8_xlsx",
    "ex1_python_walk",
    "ex16_markdown",
    "ex4_java",
    "ex8_scala",
    "ex33_logcat",
    "ex12_typescript",
    "ex17_html",
    "md7_docx",
    "ex5_kotlin",
    "ex3_python_source",
    "ex31_registry_and_ex35_observations",
    "ex6_cpp",
    "ex23_cmake",
]


@pytest.fixture(scope="module")
def many_parts(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("parts")
    rows = spark.range(3000).selectExpr("id AS p_partkey", "concat('name ', id) AS p_name", "'b' AS p_brand", "'t' AS p_type", "CAST(1 AS INT) AS p_size")
    rows.coalesce(1).write.parquet(str(folder / "part.parquet"))
    return str(folder)


@pytest.mark.parametrize("name", ONCE)
def test_a_file_is_read_once_and_in_all_tasks(spark, many_parts, name):
    import __spark_entry__

    df = __spark_entry__.queries()[name](spark, many_parts)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == (2 if name.startswith("md") else 1)  # office files are made before they are read
    assert df.rdd.getNumPartitions() == 4
