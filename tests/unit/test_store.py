import json

import pandas as pd
import pytest

from spindle import api
from spindle.operators import graph_ops as ops
from spindle.store import Store, StoreError


def test_changes(spark, tmp_path):
    with Store(spark, str(tmp_path / "s"), width=2) as s:
        a, b = s.create_entity("A", "file", "p"), s.create_entity("B", "file", "p")
        o = s.create_observation(a, "can't \"fail\"", "p")
        s.create_relation(a, b, "CALLS", "p")
        s.create_relation(a, b, "CALLS", "p")
        s.create_relation(a, "missing", "CALLS", "p")
        assert {r["what"]: r["n"] for r in ops.stats(s.graph(), "p").collect()} == {"entities": 2, "relations": 2, "observations": 1}
        with pytest.raises(ValueError):
            s.create_relation(a, b, "LIKES", "p")
        with pytest.raises(LookupError):
            s.create_observation("none", "x", "p")
        with pytest.raises(ValueError):
            s.set_embedding("entity", a, [1.0])
        s.set_embedding("entity", a, [1.0, 2.0])
        assert [r["text"] for r in s.unembedded("entity").collect()] == ["file: B"]
        with pytest.raises(StoreError):
            Store(spark, str(tmp_path / "s"))
        reader = Store(spark, str(tmp_path / "s"), read_only=True)
        with pytest.raises(StoreError):
            reader.create_entity("x", "y", "p")
        s.compact()
        assert s.graph().relation.count() == 2
        s.delete_relation(a, b, "CALLS", "p")
        assert s.graph().relation.count() == 0
        s.create_relation(b, a, "TESTS", "p")
        s.delete_observation("none", a, "p")
        s.delete_entity(a, "p")
        g = s.graph()
        assert g.entity.count() == 1 and g.relation.count() == 0 and g.observation.first()["linked"] is False and g.observation.first()["id"] == o
        s.embed_all("entity", lambda x: pd.Series([[float(len(t)), 0.0] for t in x]))
        assert s.unembedded("entity").count() == 0
    with pytest.raises(StoreError):
        Store(spark, str(tmp_path / "none"), read_only=True)


def test_index_and_tools(spark, tmp_path):
    root = tmp_path / "proj"
    (root / "src").mkdir(parents=True)
    (root / "src" / "a.py").write_text("import os\ndef run():\n    helper()\n")
    (root / "src" / "b.py").write_text("def helper():\n    pass\n")
    (root / "app.log").write_text("2024-01-15 10:30:00.000  INFO 1 --- [w-1] a.C : org.springframework\n2024-01-15 10:31:00.000 ERROR 1 --- [w-1] a.C : x.FooException: bad\n")
    (root / "bad.yaml").write_text("a: [")
    with Store(spark, str(tmp_path / "g")) as s, Store(spark, str(tmp_path / "me")) as me:
        t = api.Tools(spark, s, "p", str(root), me)
        manual = s.create_entity("by hand", "concept", "p")
        counts = t.index_project()
        assert counts["resolved"] == 1 and counts["failed_files"] == 1 and counts["entities"] == 7
        assert {(r["from_id"], r["to_id"]) for r in s.graph().relation.where("rel_type = 'CALLS'").collect()} == {("function:src/a.py:run", "function:src/b.py:helper")}
        assert t.index_project() == counts and s.graph().entity.where(f"id = '{manual}'").count() == 0
        assert [(r["to_id"], r["rel_type"]) for r in t.get_file_context("src/a.py")] == [("function:src/a.py:run", "CONTAINS"), ("import:os", "IMPORTS")]
        assert "FooException" in t.search_knowledge("fooexception")
        call = lambda name, **args: api.handle(t, {"method": "tools/call", "params": {"arguments": args, "name": name}, "id": 1})
        text = lambda r: r["result"]["content"][0]["text"]
        assert json.loads(text(call("query_graph", cypher="MATCH (f:function) RETURN f.name ORDER BY f.name"))) == [["helper"], ["run"]]
        assert call("query_graph", cypher="CREATE (n)")["result"]["isError"] and call("search_knowledge")["result"]["isError"]
        assert call("nothing")["error"]["code"] == -32601 and api.handle(t, {"id": 1})["error"]["code"] == -32600 and api.handle(t, {"method": "x"}) is None
        eid = text(call("add_personal_knowledge", title="T", content="prefer tabs", user_request="save that"))
        assert "T" in text(call("search_personal_knowledge", query="tabs"))
        assert [o.split(" ")[0] for o in api.Tools(spark, me, "personal").show_entity(eid)["observations"]] == ["prefer", "[VIA:mcp]"]
        for bad in ({"title": "", "content": "x", "user_request": "y"}, {"title": "T", "content": "x" * 9000, "user_request": "y"}, {"title": "T", "content": "x", "user_request": " "}, {"title": "T", "content": "x", "user_request": "x"}):
            assert call("add_personal_knowledge", **bad)["result"]["isError"]
        t.forget_personal(eid)
        assert me.graph().observation.count() == 0
        out = []
        api.serve(t, [json.dumps({"method": "tools/list", "id": 5}), "\n", "no json\n"], out.append)
        assert len(json.loads(out[0])["result"]["tools"]) == len(api.TOOLS) + 2 and json.loads(out[1])["error"]["code"] == -32600
        (root / "t.csv").write_text("a,b\n1,2\n")
        assert call("convert_to_markdown", uri=(root / "t.csv").as_uri())["result"]["content"][0]["text"].startswith("| a")
        assert call("convert_to_markdown", uri="data:x")["result"]["isError"]


def test_truth():
    assert [api.truthy(x) for x in (None, "", "0", "No", "off", "1", "x")] == [False] * 5 + [True] * 2


def test_index_heeds_ignore_files_scopes_and_execution_logs(spark, tmp_path):
    root = tmp_path / "proj"
    for name, text in {"src/a.py": "def run(): pass\n", "gen/b.py": "def made(): pass\n", "lib/c.py": "def lib(): pass\n", ".gitignore": "gen/\n", ".claudeignore": "!gen/\n*.tmp\n", ".ai/tasks/t1/execution.log": "Turn 3 (inactive: 1)\n"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    (root / ".gitignore").write_text("gen/\n")
    (root / ".claudeignore").write_text("*.tmp\n")
    with Store(spark, str(tmp_path / "g")) as s:
        t = api.Tools(spark, s, "p", str(root))
        counts = t.index_project()
        names = {r["name"] for r in s.graph().entity.collect()}
        assert {"run", "lib", "exec:t1"} <= names and "made" not in names and counts["files"] == 2
        assert [r["content"] for r in ops.get_observations(s.graph(), "exec:t1", "p").collect()] == ["turns: 3"]
        (root / ".ai" / "scope").mkdir()
        for n, g in (("one", "src/**/*"), ("two", "lib/**/*")):
            (root / ".ai" / "scope" / f"{n}.json").write_text(json.dumps({"name": n, "include": [g]}))
        both = t.index_project()
        assert set(both) == {"one", "two"} and both["one"]["files"] == 1
        assert t.index_project(scope="two")["files"] == 1
        eid = t.add_entity("by hand", "concept", "a summary")
        assert t.show_entity(eid)["observations"] == ["a summary"]
        assert not list((tmp_path / "g" / "scratch").glob("*")) if (tmp_path / "g" / "scratch").exists() else True
