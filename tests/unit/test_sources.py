import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from spindle.functions import logs
from spindle.operators import perf
from spindle.sources import files

GLOBS = [
    ("**/*", "a/b.c", True), ("modules/**/*", "modules/x/y.swift", True), ("modules/**/*", "modules2/x", False), ("modules/**/*", "modules", True), ("**/go.mod", "a/b/go.mod", True),
    ("**/*.go", "a/x.go", True), ("**/*.go", "a/x.py", False), ("*.md", "a.md", True), ("*.md", "a/b.md", False), ("src/?.c", "src/a.c", True), ("[ab].c", "b.c", True),
]


def test_globs(spark):
    for g, p, hit in GLOBS:
        assert files.matches(g, p) == hit, (g, p)
    scopes = [files.Scope("s", include=("**/*",), exclude=("vendor/**/*", "**/*.md")), files.Scope("m", include=("src/**/*",), include_modules=("A",)), files.Scope("g", include=tuple(g for g, *_ in GLOBS[1:6]))]
    paths = ["a.py", "vendor/x", "b/c.md", "modules/A/x", "modules/B/x", "modules/", "src/q", "other", "x/go.mod", "d/e.go"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    for s in scopes:
        assert {r["p"]: r["k"] for r in df.select("p", s.predicate(F.col("p")).alias("k")).collect()} == {p: s.includes(p) for p in paths}
    assert [p for p in paths if scopes[1].includes(p)] == ["modules/A/x", "src/q"]


def test_ignore_rules():
    r = files.IgnoreRules.parse("*.log\n!keep.log\n/top.txt\nbuild/\n# c\n", "a/**/z\n")
    assert [r.ignored(p) for p in ("x.log", "d/x.log", "keep.log", "top.txt", "d/top.txt", "build/x", "d/build/y", "build", "a/z", "a/b/c/z", "a/y")] == [True, True, False, True, False, True, True, False, True, True, False]


def test_scope_store(tmp_path):
    (tmp_path / "scope").mkdir()
    for n in ("one", "two"):
        (tmp_path / "scope" / f"{n}.json").write_text(json.dumps({"name": n, "includeModules": ["A"]}))
    s = files.ScopeStore(tmp_path)
    assert s.names() == ["one", "two"] and s.read("one").include == ("**/*",) and s.to_index() == ["one", "two"]
    s.set_default("two")
    assert s.default() == "two" and s.to_index() == ["two"] and s.to_index(scope="one") == ["one"] and s.to_index(every=True) == ["one", "two"]
    with pytest.raises(LookupError):
        s.set_default("none")


def test_walk(spark, tmp_path):
    for p, t in {"src/a.py": "def f(): pass", "node_modules/x.js": "x", "a/.git/c": "x", "b.MD": "# Hi there", "tmp/x.log": "l"}.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(t)
    rows = files.source_files(spark, str(tmp_path), ignore=files.IgnoreRules.parse("*.log")).orderBy("rel_path").collect()
    assert [(r["rel_path"], r["ext"], r["size"]) for r in rows] == [("b.MD", ".md", 10), ("src/a.py", ".py", 13)]


EXEC = "🔧 Tool: Read(a.go, 1) 🔧 Tool: Bash(x)\nTurn 3 (inactive: 1)\nTurn 2 (inactive: 1)\ncumulative:50\ncumulative:40\n🔧 Tool: Edit(b c.go)\nif err != nil error\n"


def test_exec_logs(spark, tmp_path):
    meta = json.dumps({"role": "dev", "status": "done", "description": "x" * 301 + "\nmore", "spawned_at": "2024-01-02T03:04:05+02:00"})
    want = ["role: dev", "status: done", "task: " + "x" * 300 + "…", "started: 2024-01-02T03:04:05Z", "turns: 3", "total_tokens: 40", "tool_calls: Edit:1, Read:1", "files_touched: a.go"]
    assert logs.exec_observations(EXEC, meta) == want
    assert logs.exec_observations("an Error here\n", "{bad") == ["turns: 0", "had_errors: true"] and logs.exec_observations("❌ no", None) == ["turns: 0"]
    (tmp_path / "t1").mkdir()
    (tmp_path / "t1" / "execution.log").write_text(EXEC)
    assert [r["content"] for r in files.exec_logs(spark, str(tmp_path)).orderBy("ordinal").collect()] == want[4:]


BOOT = "2024-01-15 10:30:45.123  INFO 1 --- [main] a.B : hi\n2024-01-15 10:31:00.000 ERROR 1 --- [w-1] a.C : x.FooException: bad\n\tat a.B.run(B.java:12)\n2024-01-15 10:32:00.000 ERROR 1 --- [w] a.C : x.FooException: again\n2024-01-15 10:33:00.000  WARN 1 --- [w] a.C : w\n"


def test_service_logs():
    reg = logs.default_registry(2024)
    r = reg.parse("app.log", BOOT)
    assert reg.find("app.log", BOOT[:100]).name == "spring-boot" and (r.lines, r.errors, r.warnings, r.affected) == (5, 2, 1, ["B.java"])
    (e,) = r.entities
    assert e.name == "error:x.FooException:2024-01-15" and e.stack == [] and r.start == datetime(2024, 1, 15, 10, 30, 45, 123000)
    assert logs.entity_observations(e, "app.log") == ["source: app.log", "severity: error", "timestamp: 2024-01-15T10:31:00Z", "message: x.FooException: bad", "exception_type: x.FooException", "file: app.log", "logger: a.C", "thread: w-1"]
    assert logs.default_registry(2024, keep_stack=True).parse("app.log", BOOT).entities[0].stack == ["a.B.run(B.java:12)"]
    assert reg.find("notes.txt", "org.springframework") is None and reg.find("nginx.log", "GET /") is None


def test_logcat():
    text = "01-15 10:30:45.123  12  34 E AndroidRuntime: FATAL EXCEPTION: main\n01-15 10:30:45.124  12  34 E AndroidRuntime: java.lang.BadError: oops\n  at a.B.go(B.kt:3)\nend\n01-15 10:31:45.124  12  34 W T: w\n"
    r = logs.default_registry(2023).parse("my-android.txt", text)
    assert [e.name for e in r.entities] == ["crash:main:2023-01-15-10:30", "error:java.lang.BadError:2023-01-15"] and (r.errors, r.warnings) == (2, 1)


def test_crash_report():
    text = "Incident Identifier: ID-1\nException Type:  EXC_BAD\nException Codes: 0x1\nException Subtype: sub\nDate/Time:  2024-01-02 03:04:05.60 +0200\nThread 0 name:  q\nThread 0 Crashed:\n0   App  0x00a1 Foo.bar(x) + 12\n1   Lib  0x00b2 -[X y] + 4\n\nThread 1:\n0   Lib 0x00c3 other + 1\n"
    (e,) = logs.default_registry(2024).parse("x.crash", text).entities
    assert e.name == "crash:ID-1" and e.message == "0x1 | sub" and e.metadata["crashed_thread"] == "0" and e.stack == ["other in Lib"]  # once a thread has crashed, frames of later threads replace it
    assert logs.entity_observations(e, "x")[2] == "timestamp: 2024-01-02T03:04:05+02:00"


def test_log_tables(spark):
    df = spark.createDataFrame([("app.log", BOOT), ("none.log", "x"), ("empty.log", None)], "path string, log_text string")
    (r,) = files.parse_logs(df, 2024).collect()
    assert r["format"] == "spring-boot" and r["entities"][0]["name"].startswith("error:") and r["errors"] == 2


def test_perf(spark, tmp_path):
    for i, m in enumerate([{"kg_preflight_bytes": 5, "turns": 2, "total_tokens": 10, "duration_ms": 4, "exploration_ratio": -1, "has_errors": True}, {"kg_preflight_bytes": 9, "turns": 4, "total_tokens": 20, "duration_ms": 4, "exploration_ratio": -1.0, "has_errors": False}]):
        (tmp_path / f"t{i}").mkdir()
        (tmp_path / f"t{i}" / "metrics.json").write_text(json.dumps(m))
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "metrics.json").write_text("{")
    got = {r["enabled"]: r for r in perf.summary(files.metrics(spark, str(tmp_path))).collect()}
    assert got[True]["turns"] == 3 and got[True]["exploration"] is None and got[True]["error_rate"] == 0.5
    assert got[False]["runs"] == 0 and got[False]["exploration"] == 0.0
    assert all(r["delta_pct"] is None for r in perf.delta(perf.summary(files.metrics(spark, str(tmp_path)))).collect())


def test_fetch():
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    class H(BaseHTTPRequestHandler):
        def do_GET(self):
            self.send_response(404 if "no" in self.path else 200)
            if "html" in self.path:
                self.send_header("Content-Type", "text/html; charset=x")
            elif "csv" in self.path:
                self.send_header("Content-Type", "text/csv")
            self.end_headers()
            self.wfile.write(b"x")

        def log_message(self, *a):
            pass

    s = HTTPServer(("127.0.0.1", 0), H)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{s.server_port}"
    assert files.fetch(f"{at}/html") == (".html", b"x") and files.fetch(f"{at}/plain")[0] == ".html" and files.fetch(f"{at}/a.csv")[0] == ".csv"
    with pytest.raises(ValueError):
        files.fetch(f"{at}/no")
    with pytest.raises(PermissionError):
        files.fetch(f"{at}/x", allowed=lambda h: False)
    with pytest.raises(ValueError):
        files.fetch("ftp://x/y")
    s.shutdown()
