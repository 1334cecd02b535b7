"""Tools over stores and documents: calls by name, a line-based JSON-RPC loop, and the command line."""

from __future__ import annotations

import argparse
import json
import os
import sys
import warnings
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import convert
from .operators import graph_ops, perf, search
from .plans import pattern
from .sources import files
from .store import Store

PERSONAL_BYTES = 8 * 1024
MARKER = "[VIA:mcp]"


def truthy(value: str | None) -> bool:
    """SC23: anything but an empty string, 0, false, no and off."""
    return (value or "").strip().lower() not in ("off", "no", "false", "0", "")


def as_text(hits: DataFrame) -> str:
    """SNK1: one line per hit, in the order given."""
    return "\n".join(f"{r['id']}\t{r['type']}\t{r['name']}" for r in hits.select("id", "type", "name").collect())


def index_project(spark: SparkSession, store: Store, root: str, project: str, scope: files.Scope | None = None, year: int | None = None, ignore: files.IgnoreRules | None = None) -> dict:
    """CMD2, EX1, EX20: sources, execution logs and service logs: extract once, resolve calls, load, in one swap.

    Ignore files at the root are heeded unless ``ignore`` says otherwise. Problems of single files are counted, not raised,
    and those of logs only warned of.
    """
    now = datetime.now(timezone.utc).replace(microsecond=0)
    ignore = files.ignore_rules(root) if ignore is None else ignore
    rows = files.source_files(spark, root, scope, ignore)
    written = store.scratch(files.extracted_files(rows))  # five tables and some counts come of it
    x = files.split_extracted(written)
    entities = graph_ops.first_seen(x.entities.select("id", "name", "type", "rel_path", "ordinal"))
    functions = entities.where(F.col("type") == "function").select("id", "name", "rel_path")
    resolved = graph_ops.resolve_calls(functions, x.calls)
    calls = resolved.where(F.col("outcome") == "resolved").select("from_id", "to_id", F.lit("CALLS").alias("rel_type"))
    relations = graph_ops.load_relations(entities, x.relations.unionByName(calls)).withColumn("seq", F.lit(0).cast("long"))
    stamp = F.lit(now).cast("timestamp")
    none = F.lit(None).cast("array<float>")
    observations = x.observations
    rows = entities.select("id", "name", "type")
    for logs in _logs(spark, root, year or now.year, scope):
        rows = rows.unionByName(logs.select("id", "name", "type").dropDuplicates(["id"]))
        observations = observations.unionByName(logs.select(F.col("id").alias("entity_id"), F.explode("observations").alias("content")))
    entity = rows.select("id", "name", "type", F.lit(project).alias("project_id"), stamp.alias("created_at"), stamp.alias("updated_at"), none.alias("embedding"), F.lit("").alias("layer"))
    oid = F.sha2(F.concat_ws("\0", "entity_id", "content"), 256).alias("id")
    observation = observations.select(oid, "entity_id", "content", stamp.alias("created_at"), none.alias("embedding"), F.lit(True).alias("linked"))
    store.reindex(project, entity, relations, observation)
    g = store.graph()
    counts = {r["what"]: r["n"] for r in graph_ops.stats(g, project).collect()}
    counts |= graph_ops.call_counts(resolved).first().asDict() | {"files": written.count(), "failed_files": x.errors.count()}
    store.drop_scratch()
    return counts


def _logs(spark: SparkSession, root: str, year: int, scope: files.Scope | None) -> list[DataFrame]:
    """SRC11, SRC12: id, name, type and observations of what logs tell; a kind of logs that can't be read is warned of."""
    out = []
    try:
        app = files.app_logs(spark, root, year, scope).select("path", F.inline("entities"))
        out.append(app.select(F.sha2(F.concat_ws("\0", "path", "name"), 256).alias("id"), "name", "type", "observations"))
    except Exception as e:
        warnings.warn(f"service logs aren't indexed: {e}", stacklevel=2)
    tasks = Path(root) / ".ai" / "tasks"
    if any(tasks.glob("*/execution.log")):
        try:
            said = files.exec_logs(spark, tasks.as_uri()).groupBy("entity_name").agg(F.array_sort(F.collect_list(F.struct("ordinal", "content"))).alias("o"))  # some ten lines a log
            out.append(said.select(F.col("entity_name").alias("id"), F.col("entity_name").alias("name"), F.lit("execution").alias("type"), F.col("o.content").alias("observations")))
        except Exception as e:
            warnings.warn(f"execution logs aren't indexed: {e}", stacklevel=2)
    return out


@dataclass
class Tools:
    """The tools of one project, and, if it has one, of a personal store."""

    spark: SparkSession
    store: Store
    project: str = "default"
    root: str = "."
    personal: Store | None = None
    layers: tuple[tuple[str, Store], ...] = ()

    def _now(self) -> datetime:
        return datetime.now(timezone.utc)

    def _layers(self) -> list[search.Layer]:
        return search.scope_layers(self.store.graph(), [(n, s.graph()) for n, s in self.layers], self.personal.graph() if self.personal else None)

    def get_preflight_context(self, task: str) -> str:
        return search.preflight_context(self.store.graph(), self.project, task)

    def search_knowledge(self, query: str, limit: int = 12) -> str:
        if self.layers or self.personal:
            return as_text(search.federated_keyword(self._layers(), self.project, query, limit, self._now()))
        return as_text(search.keyword_hits(self.store.graph(), self.project, query, limit))

    def add_entity(self, name: str, type: str, summary: str = "") -> str:  # noqa: A002
        """CMD5: with a first observation, if there is a summary."""
        eid = self.store.create_entity(name, type, self.project)
        if summary:
            self.store.create_observation(eid, summary, self.project)
        return eid

    def add_observation(self, entity_id: str, content: str) -> str:
        return self.store.create_observation(entity_id, content, self.project)

    def link_entities(self, from_id: str, relation: str, to_id: str) -> str:
        self.store.create_relation(from_id, to_id, relation, self.project)
        return f"{from_id} {relation} {to_id}"

    def get_file_context(self, file: str) -> list[dict]:
        """What a file contains, imports and belongs to."""
        kinds = ("CONTAINS", "IMPORTS", "BELONGS_TO")
        rows = graph_ops.get_relations(self.store.graph(), f"file:{file}", self.project).where(F.col("rel_type").isin(*kinds)).orderBy("rel_type", "to_id")
        return [r.asDict() for r in rows.collect()]

    def query_graph(self, cypher: str) -> list[list]:
        return [list(r) for r in pattern.query(self.store.graph(), cypher).collect()]

    def index_project(self, scope: str = "", every: bool = False) -> dict:
        """CMD1, CMD2: the scopes that are asked for, the default one, or all there are; without any, the whole tree.

        Each scope is a project of the store, named as the scope.
        """
        known = files.ScopeStore(Path(self.root) / ".ai")
        names = known.to_index(every, scope)
        if not names:
            return index_project(self.spark, self.store, self.root, self.project)
        done = {n: index_project(self.spark, self.store, self.root, n, known.read(n)) for n in names}
        return done[names[0]] if len(names) == 1 else done

    def show_entity(self, entity_id: str) -> dict:
        """CMD3."""
        g = self.store.graph()
        e = self.store.get_entity(entity_id, self.project)
        said = graph_ops.get_observations(g, entity_id, self.project).orderBy("created_at", "id").collect()
        edges = graph_ops.get_relations(g, entity_id, self.project).orderBy("rel_type", "to_id").collect()
        return {"entity": {k: e[k] for k in ("id", "name", "type")}, "observations": [o["content"] for o in said], "relations": [r.asDict() for r in edges]}

    def stats(self) -> dict:
        return {r["what"]: r["n"] for r in graph_ops.stats(self.store.graph(), self.project).collect()}

    def search_personal_knowledge(self, query: str, limit: int = 12) -> str:
        return as_text(search.keyword_hits(self._personal().graph(), "personal", query, limit))

    def _personal(self) -> Store:
        if self.personal is None:
            raise ValueError("there is no personal store")
        return self.personal

    def add_personal_knowledge(self, title: str, content: str, user_request: str, type: str = "note") -> str:  # noqa: A002
        """Only on the user's own words, which are recorded with the entry."""
        title, content, user_request, kind = title.strip(), content.strip(), user_request.strip(), type.strip() or "note"
        if not title or not content:
            raise ValueError("a title and a content are needed")
        if len(content.encode()) > PERSONAL_BYTES:
            raise ValueError(f"the content has {len(content.encode())} bytes, at most {PERSONAL_BYTES}")
        if not user_request:
            raise ValueError("user_request must quote what the user asked for")
        if user_request == content:
            raise ValueError("user_request must not repeat the content")
        p = self._personal()
        eid = p.create_entity(title, kind, "personal")
        p.create_observation(eid, content, "personal")
        p.create_observation(eid, f"{MARKER} [REQUEST] {json.dumps(user_request, ensure_ascii=False)}", "personal")
        return eid

    def personal_command(self, action: str = "path", *args: str):
        """CMD8: path, search QUERY, show ID, stats, add TITLE CONTENT, forget ID."""
        mine = Tools(self.spark, self._personal(), "personal", self.root)
        if action == "add":
            eid = mine.add_entity(args[0], "note", args[1] if len(args) > 1 else "")
            return eid
        known = {"path": lambda: str(self._personal().folder), "search": self.search_personal_knowledge, "show": mine.show_entity, "stats": mine.stats, "forget": self.forget_personal}
        if action not in known:
            raise ValueError(f"personal: {', '.join([*known, 'add'])}")
        return known[action](*args)

    def forget_personal(self, entity_id: str) -> None:
        """CMD8."""
        self._personal().delete_entity(entity_id, "personal", cascade=True)

    # -- documents
    def convert_to_markdown(self, uri: str) -> str:
        if uri.startswith(("http://", "https://")):
            ext, content = files.fetch(uri)
            return convert.convert("page" + ext, content)
        if uri.startswith("file:"):
            from urllib.parse import unquote, urlsplit

            return self.convert_file_to_markdown(unquote(urlsplit(uri).path))
        if uri.startswith("data:"):
            raise ValueError("data: addresses aren't supported")
        return self.convert_file_to_markdown(uri)

    def convert_file_to_markdown(self, filePath: str) -> str:  # noqa: N803
        return convert.convert(filePath, Path(filePath).read_bytes())

    def get_conversion_info(self) -> dict:
        return {"formats": convert.supported_formats()}

    def perf_report(self, tasks: str) -> list[dict]:
        """A8, A9 over the runs of a project."""
        return [r.asDict() for r in perf.delta(perf.summary(files.metrics(self.spark, tasks))).collect()]


#: Tools that are offered by name, with the arguments that they need.
TOOLS: dict[str, tuple[str, ...]] = {
    "get_preflight_context": ("task",), "search_knowledge": ("query",), "add_entity": ("name", "type"), "add_observation": ("entity_id", "content"),
    "link_entities": ("from_id", "relation", "to_id"), "get_file_context": ("file",), "query_graph": ("cypher",), "index_project": (), "show_entity": ("entity_id",), "stats": (),
    "convert_to_markdown": ("uri",), "convert_file_to_markdown": ("filePath",), "get_conversion_info": (),
}
PERSONAL_TOOLS: dict[str, tuple[str, ...]] = {"search_personal_knowledge": ("query",), "add_personal_knowledge": ("title", "content", "user_request")}


def handle(tools: Tools, request: dict) -> dict | None:
    """SNK2: the answer to one request; None to a notification."""
    rid, method = request.get("id"), request.get("method")
    answer = lambda **x: {"jsonrpc": "2.0", "id": rid} | x
    offered = TOOLS | (PERSONAL_TOOLS if tools.personal else {})
    if not isinstance(method, str):
        return answer(error={"code": -32600, "message": "invalid request"})
    if rid is None:
        return None
    if method == "initialize":
        return answer(result={"protocolVersion": "2024-11-05", "capabilities": {"tools": {}}, "serverInfo": {"name": "spindle", "version": "1"}})
    if method == "ping":
        return answer(result={})
    if method == "tools/list":
        shape = lambda need: {"type": "object", "properties": {n: {"type": "string"} for n in need}, "required": list(need)}
        return answer(result={"tools": [{"name": n, "inputSchema": shape(need)} for n, need in offered.items()]})
    if method != "tools/call":
        return answer(error={"code": -32601, "message": f"unknown method: {method}"})
    params = request.get("params") or {}
    name, args = params.get("name"), params.get("arguments") or {}
    if name not in offered:
        return answer(error={"code": -32601, "message": f"unknown tool: {name}"})
    try:
        missing = [n for n in offered[name] if n not in args]
        if missing:
            raise ValueError(f"missing argument: {missing[0]}")
        result, failed = getattr(tools, name)(**args), False
    except Exception as e:  # told to the caller as content
        result, failed = str(e), True
    text = result if isinstance(result, str) else json.dumps(result, ensure_ascii=False, default=str)
    part = {"text": text, "type": "text"}
    return answer(result={"isError": failed, "content": [part]})


def serve(tools: Tools, lines=sys.stdin, write: Callable[[str], object] = sys.stdout.write) -> None:
    for line in lines:
        if not line.strip():
            continue
        try:
            request = json.loads(line)
            out = handle(tools, request if isinstance(request, dict) else {})
        except ValueError:
            out = {"jsonrpc": "2.0", "id": None, "error": {"code": -32600, "message": "not JSON"}}
        if out is not None:
            write(json.dumps(out, ensure_ascii=False) + "\n")


def main(argv: list[str] | None = None) -> int:
    """The command line: index, search, stats, show, add, observe, link, query, config, perf, personal, convert, server, version."""
    p = argparse.ArgumentParser(prog="spindle")
    p.add_argument("--root", default=".")
    p.add_argument("--store", default=os.environ.get("SPINDLE_STORE", ""))
    p.add_argument("--personal", default=os.environ.get("SPINDLE_PERSONAL", ""))
    p.add_argument("--project", default="default")
    p.add_argument("--scope", default="")
    p.add_argument("--all", action="store_true")
    p.add_argument("--layer", action="append", default=[], help="NAME=STORE, more to search in")
    p.add_argument("command", choices=("index", "search", "stats", "show", "add", "observe", "link", "query", "config", "perf", "personal", "convert", "server", "version"))
    p.add_argument("args", nargs="*")
    a = p.parse_args(argv)
    if a.command == "version":
        print("spindle 1")
        return 0
    root = files.project_root(a.root)
    if a.command == "config":
        scopes = files.ScopeStore(root / ".ai")
        if a.args[:1] == ["set-default-scope"]:
            scopes.set_default(a.args[1] if len(a.args) > 1 else "")
        else:
            print("\n".join(scopes.names()))
        return 0
    if a.command == "convert":
        text = convert.convert(a.args[0], Path(a.args[0]).read_bytes(), convert.formats.Config.from_env(os.environ))
        if len(a.args) > 1:
            Path(a.args[1]).write_text(text)
        else:
            print(text)
        return 0
    from .session import get_session

    spark = get_session("spindle-cli")
    with Store(spark, a.store or str(root / ".ai" / "graph")) as store:
        personal = Store(spark, a.personal) if a.personal else None
        layers = tuple((n, Store(spark, at, read_only=True)) for n, at in (x.split("=", 1) for x in a.layer))
        scope = a.scope or files.ScopeStore(root / ".ai").default()
        tools = Tools(spark, store, scope if scope and a.project == "default" and a.command != "index" else a.project, str(root), personal, layers)
        call = {
            "index": lambda: tools.index_project(a.scope, a.all), "search": tools.search_knowledge, "stats": tools.stats, "show": tools.show_entity, "add": tools.add_entity, "observe": tools.add_observation, "link": tools.link_entities, "query": tools.query_graph,
            "perf": lambda: tools.perf_report(str(root / ".ai" / "tasks")), "personal": tools.personal_command, "server": lambda: serve(tools),
        }[a.command]
        out = call(*a.args)
        if out is not None:
            print(out if isinstance(out, str) else json.dumps(out, ensure_ascii=False, default=str, indent=2))
        if personal:
            personal.close()
    return 0


if __name__ == "__main__":
    sys.exit(main())
