"""A read-only graph pattern language, compiled to DataFrame joins.

``MATCH``, ``OPTIONAL MATCH``, ``WHERE``, ``WITH``, ``UNWIND``, ``RETURN [DISTINCT]``, ``ORDER BY``, ``SKIP`` and ``LIMIT``, with node
and edge patterns in either or no direction, several edge types, bounded path lengths, ``EXISTS { ... }`` and patterns as
predicates. One edge may serve several places of a pattern (joins are homomorphisms). The planner attaches predicates
to frames as soon as their variables are bound; Catalyst does the rest.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import Graph

# ---------------------------------------------------------------- guard

WRITE_WORDS = tuple("CALL CREATE DELETE DETACH DROP FOREACH LOAD MERGE REMOVE SET".split())
_GUARD = re.compile(rf"(?-i:(?<![0-9A-Za-z_]))(?:{'|'.join(WRITE_WORDS)})(?-i:(?![0-9A-Za-z_]))", re.IGNORECASE)


class QueryError(ValueError):
    pass


def guard(text: str) -> None:
    """Reject a text that holds a write word anywhere, even within a literal."""
    m = _GUARD.search(text)
    if m:
        raise QueryError(f"only reading is allowed: {m[0].upper()}")


# ---------------------------------------------------------------- syntax

_LEX = re.compile(
    r"\s+|//[^\n]*|(?P<number>\d+\.\d+|\d+)|(?P<string>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<param>\$\w+)"
    r"|(?P<name>[^\W\d]\w*|`[^`]+`)|(?P<op>\.\.|<>|<=|>=|=~|[-+*/%=<>(){}\[\],.:|!])"
)


@dataclass
class Node:
    var: str | None
    labels: list[str]
    props: dict[str, tuple]


@dataclass
class Edge:
    var: str | None
    types: list[str]
    direction: str  # out, in, any
    hops: tuple[int, int] | None


@dataclass
class Path:
    nodes: list[Node]
    edges: list[Edge]


@dataclass
class Clause:
    kind: str
    paths: list[Path] = field(default_factory=list)
    where: tuple | None = None
    items: list[tuple[tuple, str]] = field(default_factory=list)
    distinct: bool = False
    order: list[tuple[tuple, bool]] = field(default_factory=list)
    skip: tuple | None = None
    limit: tuple | None = None
    star: bool = False


class Parser:
    """Recursive descent over the tokens; expressions become nested tuples (operator, operands...)."""

    def __init__(self, text: str) -> None:
        self.tokens: list[tuple[str, str, int]] = []
        at = 0
        while at < len(text):
            m = _LEX.match(text, at)
            if not m:
                raise QueryError(f"unexpected {text[at]!r} at {at}")
            if m.lastgroup:
                self.tokens.append((m.lastgroup, m[m.lastgroup], at))
            at = m.end()
        self.text, self.i = text, 0

    def peek(self, k: int = 0) -> str:
        return self.tokens[self.i + k][1] if self.i + k < len(self.tokens) else ""

    def kind(self) -> str:
        return self.tokens[self.i][0] if self.i < len(self.tokens) else "end"

    def word(self, *words: str) -> bool:
        """Take these key words, if they come next."""
        for k, w in enumerate(words):
            if self.i + k >= len(self.tokens) or self.tokens[self.i + k][0] != "name" or self.peek(k).upper() != w:
                return False
        self.i += len(words)
        return True

    def sign(self, s: str) -> bool:
        if self.peek() == s and self.kind() == "op":
            self.i += 1
            return True
        return False

    def need(self, s: str) -> None:
        if not self.sign(s):
            raise QueryError(f"expected {s!r}, found {self.peek()!r}")

    def name(self) -> str:
        if self.kind() != "name":
            raise QueryError(f"expected a name, found {self.peek()!r}")
        self.i += 1
        return self.tokens[self.i - 1][1].strip("`")

    def parse(self) -> list[Clause]:
        out: list[Clause] = []
        while self.i < len(self.tokens):
            if self.word("OPTIONAL", "MATCH"):
                out.append(self._match("optional"))
            elif self.word("MATCH"):
                out.append(self._match("match"))
            elif self.word("UNWIND"):
                e = self.expr()
                if not self.word("AS"):
                    raise QueryError("expected AS")
                out.append(Clause("unwind", items=[(e, self.name())]))
            elif self.word("WITH"):
                out.append(self._items("with"))
            elif self.word("RETURN"):
                out.append(self._items("return"))
            else:
                raise QueryError(f"unexpected {self.peek()!r}")
        if not out or out[-1].kind != "return":
            raise QueryError("a query ends with RETURN")
        return out

    def _match(self, kind: str) -> Clause:
        c = Clause(kind, [self.path()])
        while self.sign(","):
            c.paths.append(self.path())
        if self.word("WHERE"):
            c.where = self.expr()
        return c

    def _items(self, kind: str) -> Clause:
        c = Clause(kind, distinct=self.word("DISTINCT"))
        if self.sign("*"):
            c.star = True
        else:
            while True:
                begin = self.tokens[self.i][2] if self.i < len(self.tokens) else len(self.text)
                e = self.expr()
                end = self.tokens[self.i][2] if self.i < len(self.tokens) else len(self.text)
                c.items.append((e, self.name() if self.word("AS") else self.text[begin:end].strip()))
                if not self.sign(","):
                    break
        if self.word("ORDER", "BY"):
            while True:
                e = self.expr()
                down = self.word("DESC") or self.word("DESCENDING")
                if not down:
                    self.word("ASC") or self.word("ASCENDING")
                c.order.append((e, down))
                if not self.sign(","):
                    break
        if self.word("SKIP"):
            c.skip = self.expr()
        if self.word("LIMIT"):
            c.limit = self.expr()
        if kind == "with" and self.word("WHERE"):
            c.where = self.expr()
        return c

    def node(self) -> Node:
        self.need("(")
        var = self.name() if self.kind() == "name" else None
        labels, props = [], {}
        while self.sign(":"):
            labels.append(self.name())
            while self.sign("|"):
                self.sign(":")
                labels.append(self.name())
        if self.sign("{"):
            while not self.sign("}"):
                k = self.name()
                self.need(":")
                props[k] = self.expr()
                self.sign(",")
        self.need(")")
        return Node(var, labels, props)

    def edge(self) -> Edge:
        back = self.sign("<")
        self.need("-")
        var, types, hops = None, [], None
        if self.sign("["):
            var = self.name() if self.kind() == "name" else None
            if self.sign(":"):
                types.append(self.name())
                while self.sign("|"):
                    self.sign(":")
                    types.append(self.name())
            if self.sign("*"):
                lo, hi = 1, MAX_HOPS
                if self.kind() == "number":
                    lo = hi = int(self.peek())
                    self.i += 1
                if self.sign(".."):
                    hi = MAX_HOPS
                    if self.kind() == "number":
                        hi = int(self.peek())
                        self.i += 1
                if hi > MAX_HOPS or lo > hi or lo < 1:
                    raise QueryError(f"path lengths go from 1 to {MAX_HOPS}")
                hops = (lo, hi)
            self.need("]")
        self.need("-")
        ahead = self.sign(">")
        return Edge(var, types, "any" if back == ahead else "in" if back else "out", hops)

    def path(self) -> Path:
        p = Path([self.node()], [])
        while self.peek() in ("-", "<") and self.kind() == "op":
            p.edges.append(self.edge())
            p.nodes.append(self.node())
        return p

    # expressions, from the loosest binding on
    def expr(self) -> tuple:
        left = self._and()
        while self.word("OR"):
            left = ("or", left, self._and())
        return left

    def _and(self) -> tuple:
        left = self._not()
        while self.word("AND"):
            left = ("and", left, self._not())
        return left

    def _not(self) -> tuple:
        return ("not", self._not()) if self.word("NOT") else self._compare()

    def _compare(self) -> tuple:
        left = self._sum()
        while True:
            if self.word("IS", "NOT", "NULL"):
                left = ("not", ("null", left))
            elif self.word("IS", "NULL"):
                left = ("null", left)
            elif self.word("STARTS", "WITH"):
                left = ("starts", left, self._sum())
            elif self.word("ENDS", "WITH"):
                left = ("ends", left, self._sum())
            elif self.word("CONTAINS"):
                left = ("contains", left, self._sum())
            elif self.word("IN"):
                left = ("in", left, self._sum())
            elif self.kind() == "op" and self.peek() in ("=", "<>", "<", ">", "<=", ">=", "=~"):
                op = self.peek()
                self.i += 1
                left = (op, left, self._sum())
            else:
                return left

    def _sum(self) -> tuple:
        left = self._product()
        while self.kind() == "op" and self.peek() in ("+", "-"):
            op = self.peek()
            self.i += 1
            left = (op, left, self._product())
        return left

    def _product(self) -> tuple:
        left = self._atom()
        while self.kind() == "op" and self.peek() in ("*", "/", "%"):
            op = self.peek()
            self.i += 1
            left = (op, left, self._atom())
        return left

    def _atom(self) -> tuple:
        kind, value = self.kind(), self.peek()
        if kind == "number":
            self.i += 1
            return ("lit", float(value) if "." in value else int(value))
        if kind == "string":
            self.i += 1
            return ("lit", re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), value[1:-1]))
        if kind == "param":
            self.i += 1
            return ("param", value[1:])
        if self.sign("-"):
            return ("neg", self._atom())
        if self.sign("["):
            items = []
            while not self.sign("]"):
                items.append(self.expr())
                self.sign(",")
            return ("list", *items)
        if value == "(":
            here = self.i
            try:
                p = self.path()
                if p.edges:
                    return ("exists", Clause("match", [p]))
            except QueryError:
                pass
            self.i = here
            self.need("(")
            e = self.expr()
            self.need(")")
            return e
        if self.word("TRUE"):
            return ("lit", True)
        if self.word("FALSE"):
            return ("lit", False)
        if self.word("NULL"):
            return ("lit", None)
        if kind == "name" and value.upper() == "EXISTS" and self.peek(1) == "{":
            self.i += 1
            self.need("{")
            if not self.word("MATCH"):
                raise QueryError("expected MATCH")
            c = self._match("match")
            self.need("}")
            return ("exists", c)
        var = self.name()
        if self.sign("("):
            distinct, args = self.word("DISTINCT"), []
            if self.sign("*"):
                args.append(("star",))
            while not self.sign(")"):
                args.append(self.expr())
                self.sign(",")
            return ("call", var.lower(), distinct, *args)
        if self.sign("."):
            return ("prop", var, self.name())
        return ("var", var)


MAX_HOPS = 10

# ---------------------------------------------------------------- plans

_ENTITY = ("id", "name", "type", "project_id", "created_at", "updated_at")
_OBSERVATION = ("id", "content", "created_at")
_AGGREGATES = ("count", "sum", "avg", "min", "max", "collect")


class Planner:
    def __init__(self, g: Graph, params: dict | None = None) -> None:
        self.g, self.params = g, params or {}
        self.kinds: dict[str, str] = {}  # variable: entity, observation, edge or value
        self.frame: DataFrame | None = None
        self._n = 0

    def fresh(self) -> str:
        self._n += 1
        return f"_v{self._n}"

    def fields(self, var: str) -> list[str]:
        own = {"entity": _ENTITY, "observation": _OBSERVATION, "edge": ("type", "from", "to")}.get(self.kinds[var])
        return [f"{var}__{x}" for x in own] if own else [var]

    # -- scans
    def _scan(self, node: Node, var: str, kind: str) -> DataFrame:
        if kind == "observation":
            rows = self.g.observation
            rows = rows.select(*(F.col(c).alias(f"{var}__{c}") for c in _OBSERVATION))
        else:
            rows = self.g.entity
            sugar = [x for x in node.labels if x.lower() != "entity"]
            if sugar:
                rows = rows.where(F.col("type").isin([x for s in sugar for x in {s, s.lower()}]))
            rows = rows.select(*(F.col(c).alias(f"{var}__{c}") for c in _ENTITY))
        for k, e in node.props.items():
            if f"{var}__{k}" not in rows.columns:
                raise QueryError(f"no property {k}")
            rows = rows.where(F.col(f"{var}__{k}") == self.column(e))
        return rows

    def _edges(self, e: Edge, var: str) -> DataFrame:
        """Columns var__from, var__to, var__type."""
        named = {t.upper() for t in e.types}
        parts = []
        if not named or named - {"HAS_OBSERVATION"}:
            rows = self.g.relation
            if named:
                rows = rows.where(F.col("rel_type").isin(*e.types))
            parts.append(rows.select(F.col("from_id").alias(f"{var}__from"), F.col("to_id").alias(f"{var}__to"), F.col("rel_type").alias(f"{var}__type")))
        if "HAS_OBSERVATION" in named:
            said = self.g.linked()
            parts.append(said.select(F.col("entity_id").alias(f"{var}__from"), F.col("id").alias(f"{var}__to"), F.lit("HAS_OBSERVATION").alias(f"{var}__type")))
        rows = reduce(DataFrame.unionByName, parts)
        if e.direction == "in":
            rows = rows.select(F.col(f"{var}__to").alias(f"{var}__from"), F.col(f"{var}__from").alias(f"{var}__to"), f"{var}__type")
        elif e.direction == "any":
            back = rows.select(F.col(f"{var}__to").alias(f"{var}__from"), F.col(f"{var}__from").alias(f"{var}__to"), f"{var}__type")
            rows = rows.unionByName(back.where(F.col(f"{var}__from") != F.col(f"{var}__to")))
        if e.hops:
            lo, hi = e.hops
            step = rows.select(F.col(f"{var}__from").alias("_a"), F.col(f"{var}__to").alias("_b"))
            walk, kept = step, []
            for k in range(1, hi + 1):
                if k >= lo:
                    kept.append(walk)
                if k < hi:
                    walk = walk.join(step.toDF("_b", "_c"), "_b").select("_a", F.col("_c").alias("_b"))
            rows = reduce(DataFrame.union, kept).select(F.col("_a").alias(f"{var}__from"), F.col("_b").alias(f"{var}__to"), F.lit("|".join(e.types)).alias(f"{var}__type"))
        return rows

    def _kind(self, node: Node, e: Edge | None, end: bool) -> str:
        if any(x.lower() == "observation" for x in node.labels):
            return "observation"
        out = e is not None and (e.direction == "out") == end or e is not None and e.direction == "any" and end
        return "observation" if e is not None and [t.upper() for t in e.types] == ["HAS_OBSERVATION"] and out and not node.labels else "entity"

    def _path(self, frame: DataFrame | None, path: Path) -> DataFrame:
        last = None
        for i, node in enumerate(path.nodes):
            e = path.edges[i - 1] if i else None
            var = node.var or self.fresh()
            known = var in self.kinds
            if not known:
                self.kinds[var] = self._kind(node, e or (path.edges[0] if path.edges else None), bool(i))
            if not i:
                if not known:
                    rows = self._scan(node, var, self.kinds[var])
                    frame = rows if frame is None else frame.crossJoin(rows)
                elif node.props or node.labels:
                    frame = self._narrow(frame, node, var)
            else:
                name = e.var or self.fresh()
                self.kinds[name] = "edge"
                edges = self._edges(e, name)
                on = F.col(f"{last}__id") == F.col(f"{name}__from")
                if known:
                    frame = frame.join(edges, on & (F.col(f"{var}__id") == F.col(f"{name}__to")))
                    frame = self._narrow(frame, node, var)
                else:
                    rows = self._scan(node, var, self.kinds[var])
                    frame = frame.join(edges, on).join(rows, F.col(f"{name}__to") == F.col(f"{var}__id"))
            last = var
        return frame

    def _narrow(self, frame: DataFrame, node: Node, var: str) -> DataFrame:
        for k, e in node.props.items():
            frame = frame.where(F.col(f"{var}__{k}") == self.column(e))
        sugar = [x for x in node.labels if x.lower() not in ("entity", "observation")]
        return frame.where(F.col(f"{var}__type").isin([x for s in sugar for x in {s, s.lower()}])) if sugar else frame

    # -- clauses
    def run(self, clauses: list[Clause]) -> DataFrame:
        for c in clauses:
            if c.kind == "match":
                for p in self._ordered(c.paths):
                    self.frame = self._path(self.frame, p)
                if c.where:
                    self.frame = self._where(self.frame, c.where)
            elif c.kind == "optional":
                self._optional(c)
            elif c.kind == "unwind":
                e, alias = c.items[0]
                base = self.frame if self.frame is not None else self.g.spark.range(1).select()
                self.frame = base.withColumn(alias, F.explode(self.column(e)))
                self.kinds[alias] = "value"
            else:
                self._project(c)
        return self.frame

    def _ordered(self, paths: list[Path]) -> list[Path]:
        """Paths that share a variable with what is bound come first, so that few are crossed."""
        left, out, known = list(paths), [], set(self.kinds)
        while left:
            k = next((i for i, p in enumerate(left) if any(n.var in known for n in p.nodes)), 0)
            p = left.pop(k)
            if p.nodes[0].var not in known and p.nodes[-1].var in known:
                turn = {"out": "in", "in": "out", "any": "any"}
                p = Path(p.nodes[::-1], [Edge(e.var, e.types, turn[e.direction], e.hops) for e in p.edges[::-1]])
            known |= {n.var for n in p.nodes if n.var}
            out.append(p)
        return out

    def _optional(self, c: Clause) -> None:
        before = dict(self.kinds)
        inner = Planner(self.g, self.params)
        inner._n = self._n + 1000
        for p in c.paths:
            inner.frame = inner._path(inner.frame, p)
        if c.where:
            inner.frame = inner._where(inner.frame, c.where)
        shared = [v for v in inner.kinds if v in before]
        right = inner.frame
        keys = []
        for v in shared:
            right = right.withColumn(f"_k_{v}", F.col(f"{v}__id")).drop(*inner.fields(v))
            keys.append(F.col(f"{v}__id") == F.col(f"_k_{v}"))
        if not keys:
            raise QueryError("OPTIONAL MATCH needs a bound variable")
        self.frame = self.frame.join(right, reduce(lambda a, b: a & b, keys), "left").drop(*(f"_k_{v}" for v in shared))
        self.kinds |= {v: k for v, k in inner.kinds.items() if v not in before}

    def _where(self, frame: DataFrame, e: tuple) -> DataFrame:
        if e[0] == "and":
            return self._where(self._where(frame, e[1]), e[2])
        if e[0] == "exists":
            return self._semi(frame, e[1], "left_semi")
        if e[0] == "not" and e[1][0] == "exists":
            return self._semi(frame, e[1][1], "left_anti")
        frame, e = self._flagged(frame, e)
        return frame.where(self.column(e))

    def _sub(self, c: Clause) -> tuple[DataFrame, list[str]]:
        """The bound variables of a sub-pattern, with the ids for which it holds."""
        inner = Planner(self.g, self.params)
        inner._n = self._n + 1000
        for p in c.paths:
            inner.frame = inner._path(inner.frame, p)
        if c.where:
            inner.frame = inner._where(inner.frame, c.where)
        shared = [v for v in inner.kinds if self.kinds.get(v) in ("entity", "observation")]
        if not shared:
            raise QueryError("a pattern predicate needs a bound variable")
        return inner.frame.select(*(F.col(f"{v}__id").alias(f"_k_{v}") for v in shared)).distinct(), shared

    def _semi(self, frame: DataFrame, c: Clause, how: str) -> DataFrame:
        ids, shared = self._sub(c)
        return frame.join(ids, reduce(lambda a, b: a & b, (F.col(f"{v}__id") == F.col(f"_k_{v}") for v in shared)), how)

    def _flagged(self, frame: DataFrame, e: tuple) -> tuple[DataFrame, tuple]:
        """Pattern predicates below OR become a flag each, from a left join with distinct ids."""
        if e[0] == "exists":
            ids, shared = self._sub(e[1])
            flag = self.fresh()
            on = reduce(lambda a, b: a & b, (F.col(f"{v}__id") == F.col(f"_k_{v}") for v in shared))
            frame = frame.join(ids.withColumn(flag, F.lit(True)), on, "left").drop(*(f"_k_{v}" for v in shared))
            self.kinds[flag] = "value"
            return frame, ("call", "coalesce", False, ("var", flag), ("lit", False))
        if e[0] in ("and", "or", "not"):
            out = [e[0]]
            for x in e[1:]:
                frame, x = self._flagged(frame, x)
                out.append(x)
            return frame, tuple(out)
        return frame, e

    def _project(self, c: Clause) -> None:
        frame = self.frame if self.frame is not None else self.g.spark.range(1)
        items = [(("var", v), v) for v in self.kinds if not v.startswith("_v")] if c.star else c.items
        last = c.kind == "return"
        grouped = any(_aggregated(e) for e, _ in items)
        if grouped:
            frame, columns, kinds = self._group(frame, items, last)
        else:
            columns, kinds = [], {}
            for e, alias in items:
                if e[0] == "var" and self.kinds.get(e[1]) in ("entity", "observation", "edge"):
                    if last:
                        columns.append(F.struct(*(F.col(f).alias(f.split("__", 1)[1]) for f in self.fields(e[1]))).alias(alias))
                    else:
                        columns += [F.col(f).alias(f"{alias}__{f.split('__', 1)[1]}") for f in self.fields(e[1])]
                        kinds[alias] = self.kinds[e[1]]
                        continue
                else:
                    columns.append(self.column(e).alias(alias))
                kinds[alias] = "value"
        if c.distinct or grouped or not c.order:
            frame = frame.select(*columns)
            self.kinds = kinds
            if c.distinct:
                frame = frame.distinct()
            frame = self._sorted(frame, c, {repr(e): a for e, a in items})
        else:  # the order may use what the projection leaves out
            keys = []
            aliases = {a: e for e, a in items}
            for k, (e, down) in enumerate(c.order):
                e = aliases.get(e[1], e) if e[0] == "var" else e
                frame = frame.withColumn(f"_o{k}", self.column(e))
                keys.append(F.col(f"_o{k}").desc_nulls_last() if down else F.col(f"_o{k}").asc_nulls_first())
            frame = self._cut(frame.orderBy(*keys), c).select(*columns)
            self.kinds = kinds
        self.frame = self._where(frame, c.where) if c.where else frame

    def _sorted(self, frame: DataFrame, c: Clause, named: dict[str, str]) -> DataFrame:
        keys = []
        for e, down in c.order:
            k = F.col(f"`{named[repr(e)]}`") if repr(e) in named else self.column(e)
            keys.append(k.desc_nulls_last() if down else k.asc_nulls_first())
        return self._cut(frame.orderBy(*keys) if keys else frame, c)

    def _cut(self, frame: DataFrame, c: Clause) -> DataFrame:
        if c.skip:
            frame = frame.offset(int(self._value(c.skip)))
        return frame.limit(int(self._value(c.limit))) if c.limit else frame

    def _value(self, e: tuple):
        if e[0] == "lit":
            return e[1]
        if e[0] == "param":
            return self.params[e[1]]
        raise QueryError("expected a number or a parameter")

    def _group(self, frame: DataFrame, items: list, last: bool):
        """Items without an aggregate are the keys."""
        keys, aggs, columns, kinds = [], [], [], {}
        for e, alias in items:
            if _aggregated(e):
                aggs.append(self.column(e).alias(alias))
                columns.append(F.col(f"`{alias}`"))
                kinds[alias] = "value"
            elif e[0] == "var" and self.kinds.get(e[1]) in ("entity", "observation"):
                names = [f.split("__", 1)[1] for f in self.fields(e[1])]
                keys += [F.col(f"{e[1]}__{n}").alias(f"{alias}__{n}") for n in names]
                if last:
                    columns.append(F.struct(*(F.col(f"{alias}__{n}").alias(n) for n in names)).alias(alias))
                    kinds[alias] = "value"
                else:
                    columns += [F.col(f"{alias}__{n}") for n in names]
                    kinds[alias] = self.kinds[e[1]]
            else:
                keys.append(self.column(e).alias(alias))
                columns.append(F.col(f"`{alias}`"))
                kinds[alias] = "value"
        return (frame.groupBy(*keys).agg(*aggs) if keys else frame.agg(*aggs)), columns, kinds

    # -- expressions
    def column(self, e: tuple) -> Column:
        op, args = e[0], e[1:]
        if op == "lit":
            return F.lit(args[0])
        if op == "param":
            if args[0] not in self.params:
                raise QueryError(f"no parameter {args[0]}")
            v = self.params[args[0]]
            return F.array(*map(F.lit, v)) if isinstance(v, (list, tuple)) else F.lit(v)
        if op == "list":
            return F.array(*map(self.column, args))
        if op == "var":
            kind = self.kinds.get(args[0])
            if kind is None:
                raise QueryError(f"unknown variable {args[0]}")
            if kind == "edge":
                return F.col(f"{args[0]}__type")
            return F.col(f"`{args[0]}`") if kind == "value" else F.col(f"{args[0]}__id")
        if op == "prop":
            var, name = args
            if var not in self.kinds:
                raise QueryError(f"unknown variable {var}")
            if f"{var}__{name}" not in self.fields(var):
                raise QueryError(f"no property {name} of {var}")
            return F.col(f"{var}__{name}")
        if op == "call":
            return self._call(*args)
        if op == "in":
            if args[1][0] == "param" and len(self.params.get(args[1][1], ())) == 0:
                return F.lit(False)
            return F.array_contains(self.column(args[1]), self.column(args[0])) if args[1][0] not in ("list", "param") else self.column(args[0]).isin(*(
                [self.column(x) for x in args[1][1:]] if args[1][0] == "list" else list(self.params[args[1][1]])
            ))
        cols = [self.column(x) for x in args]
        table = {
            "and": lambda a, b: a & b, "or": lambda a, b: a | b, "not": lambda a: ~a, "null": lambda a: a.isNull(), "neg": lambda a: -a,
            "=": lambda a, b: a == b, "<>": lambda a, b: a != b, "<": lambda a, b: a < b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b,
            "starts": lambda a, b: F.startswith(a, b), "ends": lambda a, b: F.endswith(a, b), "contains": lambda a, b: F.contains(a, b), "=~": lambda a, b: F.rlike(a, F.concat(F.lit("^(?:"), b, F.lit(")\\z"))),
            "+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": lambda a, b: a / b, "%": lambda a, b: a % b,
        }
        return table[op](*cols)

    def _call(self, name: str, distinct: bool, *args: tuple) -> Column:
        if name == "count":
            if args[0] == ("star",):
                return F.count(F.lit(1))
            c = self.column(args[0])
            return F.count_distinct(c) if distinct else F.count(c)
        cols = [self.column(a) for a in args]
        if name == "collect":
            return F.array_sort(F.collect_set(cols[0]) if distinct else F.collect_list(cols[0]))
        plain = {
            "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "lower": F.lower, "tolower": F.lower, "upper": F.upper, "toupper": F.upper, "label": lambda c: c, "type": lambda c: c,
            "size": F.size, "length": F.length, "coalesce": F.coalesce, "id": lambda c: c, "abs": F.abs, "trim": F.trim, "tostring": lambda c: c.cast("string"),
        }
        if name not in plain:
            raise QueryError(f"unknown function {name}")
        if name in ("label", "type") and self.kinds.get(args[0][1]) != "edge":
            return F.lit({"entity": "Entity", "observation": "Observation"}.get(self.kinds.get(args[0][1]), ""))
        return plain[name](*cols)


def _aggregated(e) -> bool:
    return isinstance(e, tuple) and len(e) > 0 and (e[0] == "call" and e[1] in _AGGREGATES or any(_aggregated(x) for x in e[1:] if isinstance(x, tuple)))


def query(g: Graph, text: str, params: dict | None = None) -> DataFrame:
    """The result of a query; a text with a write word, or one that the grammar doesn't know, raises :class:`QueryError`."""
    guard(text)
    return Planner(g, params).run(Parser(text).parse())
