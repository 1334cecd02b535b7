"""Source trees, logs and metrics as DataFrames (SRC1 to SRC7, SRC11 to SRC13, SRC18, SRC20)."""

from __future__ import annotations

import json
import os
import re
import subprocess
import warnings
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import logs
from ..functions.extract.registry import extracted

#: Directories that are never walked into, at any depth.
SKIPPED = tuple(sorted({"node_modules", "vendor", "target", "coverage", "dist", "build", "__pycache__", *(f".{d}" for d in ("ai", "build", "claude", "git", "mypy_cache", "next", "nuxt", "pytest_cache"))}))
LOG_SKIPPED = tuple(sorted({"node_modules", "vendor", "dist", "build", "__pycache__", *(f".{d}" for d in ("ai", "git", "gradle", "idea", "pytest_cache", "vscode"))}))
MAX_LOG_BYTES = 100 * 1024 * 1024


# ---------------------------------------------------------------- globs and scopes (SRC3 to SRC6, SRC19)


def segment_regex(glob: str) -> str:
    """A glob whose ``*`` and ``?`` stay within a path segment, as a regular expression."""
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "[" and "]" in glob[i + 2 :]:
            end = glob.index("]", i + 2)
            out.append("[" + glob[i + 1 : end].replace("\\", "\\\\") + "]")
            i = end
        else:
            out.append(re.escape(c))
        i += 1
    return "".join(out)


def glob_regex(glob: str) -> str:
    """SRC6: ``**/*`` is everything, ``prefix/**/*`` a subtree, ``**/suffix`` a base name or any path above it; else one path."""
    if glob == "**/*":
        return r"[\s\S]*"
    whole = segment_regex(glob)
    if glob.endswith("/**/*") and len(glob) > 5:
        return f"{whole}|{re.escape(glob[:-5])}(?:/[\\s\\S]*)?"
    if glob.startswith("**/") and len(glob) > 3:
        tail = segment_regex(glob[3:])
        return f"{whole}|(?:[\\s\\S]*/)?{tail}|{tail}/[\\s\\S]*" if "/" not in glob[3:] else f"{whole}|{tail}(?:/[\\s\\S]*)?"
    return whole


def matches(glob: str, path: str) -> bool:
    if glob.startswith("**/") and len(glob) > 3 and "/" not in glob[3:]:
        base = path.rsplit("/", 1)[-1]
        first = path.split("/", 1)[0]
        tail = segment_regex(glob[3:])
        return bool(re.fullmatch(tail, base) or re.fullmatch(tail, first) or re.fullmatch(segment_regex(glob), path))
    return bool(re.fullmatch(glob_regex(glob), path))


@dataclass(frozen=True)
class Scope:
    """Which paths belong to a graph. Modules named by ``include_modules`` decide first, then excludes, then includes."""

    name: str
    database: str = ""
    layers: tuple[str, ...] = ()
    include: tuple[str, ...] = ("**/*",)
    exclude: tuple[str, ...] = ()
    include_modules: tuple[str, ...] = ()

    def includes(self, path: str) -> bool:
        if self.include_modules and path.startswith("modules/") and len(path) > len("modules/"):
            return path.split("/")[1] in self.include_modules
        return not any(matches(g, path) for g in self.exclude) and any(matches(g, path) for g in self.include)

    def predicate(self, path: Column) -> Column:
        """SRC4, SRC5: the same as a Column."""

        def hit(globs: tuple[str, ...]) -> Column:
            out = F.lit(False)
            for g in globs:
                if g.startswith("**/") and len(g) > 3 and "/" not in g[3:]:
                    tail = segment_regex(g[3:])
                    out = out | F.element_at(F.split(path, "/"), -1).rlike(rf"\A(?:{tail})\z") | F.split(path, "/")[0].rlike(rf"\A(?:{tail})\z") | path.rlike(rf"\A(?:{segment_regex(g)})\z")
                else:
                    out = out | path.rlike(rf"\A(?:{glob_regex(g)})\z")
            return out

        plain = ~hit(self.exclude) & hit(self.include)
        if not self.include_modules:
            return plain
        return F.when(path.startswith("modules/") & (F.length(path) > 8), F.split(path, "/")[1].isin(*self.include_modules)).otherwise(plain)

    @staticmethod
    def from_json(text: str) -> Scope:
        d = json.loads(text)
        if not isinstance(d, dict) or not d.get("name"):
            raise ValueError("a scope needs a name")
        many = lambda k, default=(): tuple(d.get(k) or default)
        return Scope(d["name"], d.get("database", ""), many("layers"), many("include", ("**/*",)), many("exclude"), many("includeModules"))


@dataclass
class ScopeStore:
    """SRC19, CMD1, CMD7: scope files and the default scope, under a project's settings folder."""

    folder: Path

    def names(self) -> list[str]:
        return sorted(p.stem for p in (self.folder / "scope").glob("*.json"))

    def read(self, name: str) -> Scope:
        return Scope.from_json((self.folder / "scope" / f"{name}.json").read_text())

    def _config(self) -> dict:
        path = self.folder / "config.json"
        return json.loads(path.read_text()) if path.exists() else {}

    def default(self) -> str:
        return self._config().get("defaultScope", "")

    def set_default(self, name: str) -> None:
        if name and name not in self.names():
            raise LookupError(f"no such scope: {name}")
        config = {k: v for k, v in self._config().items() if k != "defaultScope"} | ({"defaultScope": name} if name else {})
        (self.folder / "config.json").write_text(json.dumps(config, indent=2))

    def to_index(self, every: bool = False, scope: str = "") -> list[str]:
        """The scopes that an index run covers; none of any kind gives none, which means the whole project."""
        names = self.names()
        if not names or every:
            return names
        if scope or self.default():
            return [scope or self.default()]
        return names


@dataclass
class IgnoreRules:
    """SRC3: lines of ignore files, the last that matches wins, ``!`` takes back; directories prune what is below."""

    rules: list[tuple[str, bool, bool]] = field(default_factory=list)

    @staticmethod
    def parse(*texts: str) -> IgnoreRules:
        out = IgnoreRules()
        for line in (x.rstrip("\r\n") for t in texts for x in t.split("\n")):
            line = line.rstrip(" ")
            if not line or line.startswith("#"):
                continue
            keep, line = line.startswith("!"), line.removeprefix("!")
            folder, line = line.endswith("/"), line.rstrip("/")
            anchored = "/" in line
            parts = [r"(?:[^/]+/)*" if p == "**" else segment_regex(p) + "/" for p in line.lstrip("/").split("/")]
            body = "".join(parts).removesuffix("/") if not line.endswith("**") else "".join(parts[:-1]) + r"[\s\S]+"
            out.rules.append((("" if anchored else r"(?:[^/]+/)*") + body, folder, keep))
        return out

    def predicate(self, path: Column) -> Column:
        """Whether a path is ignored; rules are ordered and the last wins, which no built-in says, so in Arrow batches."""
        return F.arrow_udf(lambda paths: pa.array([self.ignored(p or "") for p in paths.to_pylist()], pa.bool_()), T.BooleanType())(path)

    def ignored(self, path: str) -> bool:
        parts = path.split("/")
        for k in range(1, len(parts) + 1):
            own, is_folder, hit = "/".join(parts[:k]), k < len(parts), False
            for rule, folder, keep in self.rules:
                if (is_folder or not folder) and re.fullmatch(rule, own):
                    hit = not keep
            if hit:
                return True
        return False


# ---------------------------------------------------------------- reading


def _below(root: str) -> Column:
    """The path of a file relative to the root that it was found under."""
    base = re.escape("/" + re.sub(r"^file:/+", "", root.rstrip("/")).lstrip("/")) + "/"
    return F.regexp_replace(F.regexp_replace("path", r"^file:/+", "/"), "^" + base, "")


def _outside(path: Column, skipped: tuple[str, ...]) -> Column:
    """Whether none of the directories above a path is to be skipped."""
    parts = F.split(path, "/")
    return ~F.arrays_overlap(F.slice(parts, F.lit(1), F.size(parts) - 1), F.array(*map(F.lit, skipped)))


def _kept_files(spark: SparkSession, root: str, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Path, content and length of the files that ``keep`` leaves of (path, rel_path, length): others are listed, not read.

    The driver holds the list of paths, as it does for any table of files.
    """
    reader = lambda: spark.read.format("binaryFile")
    listed = reader().option("recursiveFileLookup", "true").load(root.rstrip("/")).select("path", _below(root).alias("rel_path"), "length")
    paths = [r["path"] for r in keep(listed).select("path").collect()]
    if not paths:
        return reader().option("recursiveFileLookup", "true").load(root.rstrip("/")).where(F.lit(False))
    return reader().load(paths)


def source_files(spark: SparkSession, root: str, scope: Scope | None = None, ignore: IgnoreRules | None = None) -> DataFrame:
    """SRC1, SRC2: rel_path, ext, content and size of the files below ``root``; only those kept are read."""

    def keep(rows: DataFrame) -> DataFrame:
        rows = rows.where(_outside(F.col("rel_path"), SKIPPED))
        if scope:
            rows = rows.where(scope.predicate(F.col("rel_path")))
        if ignore and ignore.rules:
            rows = rows.where(~ignore.predicate(F.col("rel_path")))
        return rows

    rows = _kept_files(spark, root, keep).select(_below(root).alias("rel_path"), "content", F.col("length").alias("size"))
    return rows.select("rel_path", F.lower(F.regexp_extract("rel_path", r"(\.[^./]*)$", 1)).alias("ext"), "content", "size")


def ignore_rules(root: str) -> IgnoreRules:
    """SRC3: the rules of the ignore files at the root, those of the second after those of the first."""
    found = [Path(root) / n for n in (".gitignore", ".claudeignore")]
    return IgnoreRules.parse(*(f.read_text(errors="replace") for f in found if f.is_file()))


@dataclass(frozen=True)
class Extraction:
    entities: DataFrame
    relations: DataFrame
    calls: DataFrame
    observations: DataFrame
    errors: DataFrame


def extracted_files(files: DataFrame) -> DataFrame:
    """EX1: rel_path and the records ``x`` of each file that an extractor takes: one call a file."""
    return files.select("rel_path", extracted(F.col("rel_path"), F.col("content")).alias("x")).where(F.col("x").isNotNull())


def split_extracted(rows: DataFrame) -> Extraction:
    """Flat tables of extracted files. Entities still repeat across files (W6 drops that)."""
    part = lambda name: rows.select("rel_path", F.inline(f"x.{name}"))
    return Extraction(
        part("entities"), part("relations").drop("rel_path"), rows.select(F.inline("x.calls")), rows.select(F.inline("x.observations")),
        rows.where(F.col("x.error").isNotNull()).select("rel_path", F.col("x.error").alias("error")),
    )


def extract_files(files: DataFrame) -> Extraction:
    """Both at once; where several of the tables are read, write the extracted files first (:meth:`Store.scratch`)."""
    return split_extracted(extracted_files(files))


def exec_logs(spark: SparkSession, tasks: str) -> DataFrame:
    """SRC11, EX30: task, entity_name and content of the observations on each ``<task>/execution.log`` and its metadata."""
    task = lambda: F.element_at(F.split(F.input_file_name(), "/"), -2)
    read = lambda name: spark.read.text(f"{tasks.rstrip('/')}/*/{name}", wholetext=True)
    log = read("execution.log").select(task().alias("task"), F.col("value").alias("log"))
    try:
        meta = read("00-metadata.json").select(task().alias("task"), F.col("value").alias("meta"))
        log = log.join(meta, "task", "left")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        log = log.withColumn("meta", F.lit(None).cast("string"))
    return log.select("task", F.concat(F.lit("exec:"), F.col("task")).alias("entity_name"), F.posexplode(exec_lines(F.col("log"), F.col("meta"))).alias("ordinal", "content"))


def exec_lines(log: Column, meta: Column) -> Column:
    """EX30: the observations on an execution log and its metadata, in Arrow batches."""
    run = lambda texts, metas: pa.array([logs.exec_observations(t or "", m) for t, m in zip(texts.to_pylist(), metas.to_pylist())], pa.list_(pa.string()))
    return F.arrow_udf(run, T.ArrayType(T.StringType())).asNondeterministic()(log, meta)  # called once, as extractors are


_LOG_ENTITY = T.StructType(
    [
        T.StructField("name", T.StringType()), T.StructField("type", T.StringType()), T.StructField("severity", T.StringType()), T.StructField("timestamp", T.TimestampType()),
        T.StructField("message", T.StringType()), T.StructField("observations", T.ArrayType(T.StringType())),
    ]
)
LOG_RESULT = T.StructType(
    [
        T.StructField("format", T.StringType()), T.StructField("entities", T.ArrayType(_LOG_ENTITY)), T.StructField("lines", T.LongType()), T.StructField("errors", T.LongType()),
        T.StructField("warnings", T.LongType()), T.StructField("start", T.TimestampType()), T.StructField("end", T.TimestampType()), T.StructField("affected", T.ArrayType(T.StringType())),
    ]
)


def _utc(t):
    from datetime import timezone

    return None if t is None else t.replace(tzinfo=t.tzinfo or timezone.utc)


def parse_logs(files: DataFrame, year: int, keep_stack: bool = False, registry: logs.Registry | None = None) -> DataFrame:
    """EX31 to EX35: path and the parsed result of each file (path, log_text) that a format takes."""
    formats = registry or logs.default_registry(year, keep_stack)

    def parse(path: str, text: str):
        fmt = formats.find(path, (text or "").encode()[:1024].decode(errors="ignore"))
        if fmt is None:
            return None
        r = fmt.parse(path, text or "")
        names = _LOG_ENTITY.names
        rows = [dict(zip(names, (e.name, e.type, e.severity, _utc(e.timestamp), e.message, logs.entity_observations(e, path)))) for e in r.entities]
        return dict(zip(LOG_RESULT.names, (fmt.name, rows, r.lines, r.errors, r.warnings, _utc(r.start), _utc(r.end), r.affected)))

    def batch(paths: pa.Array, texts: pa.Array) -> pa.Array:
        from pyspark.sql.pandas.types import to_arrow_type

        return pa.array([parse(p or "", t) for p, t in zip(paths.to_pylist(), texts.to_pylist())], to_arrow_type(LOG_RESULT))

    once = F.arrow_udf(batch, LOG_RESULT).asNondeterministic()  # else each filter and generator above has it called again
    return files.select("path", once("path", "log_text").alias("r")).where(F.col("r").isNotNull()).select("path", "r.*")


def app_logs(spark: SparkSession, root: str, year: int, scope: Scope | None = None, keep_stack: bool = False) -> DataFrame:
    """SRC12: logs anywhere below ``root``, but for skipped directories and files above the size limit."""

    def keep(rows: DataFrame) -> DataFrame:
        rows = rows.where((F.col("length") <= MAX_LOG_BYTES) & _outside(F.col("rel_path"), LOG_SKIPPED))
        return rows.where(scope.predicate(F.col("rel_path"))) if scope else rows

    rows = _kept_files(spark, root, keep).select(_below(root).alias("path"), F.col("content").cast("string").alias("log_text"))
    return parse_logs(rows, year, keep_stack)


def metrics(spark: SparkSession, tasks: str) -> DataFrame:
    """SRC13: the runs of ``<task>/metrics.json``; malformed files are left out, and a warning says how many."""
    schema = T.StructType(
        [
            T.StructField("kg_preflight_bytes", T.LongType()), T.StructField("turns", T.LongType()), T.StructField("total_tokens", T.LongType()), T.StructField("duration_ms", T.LongType()),
            T.StructField("exploration_ratio", T.DoubleType()), T.StructField("has_errors", T.BooleanType()), T.StructField("_bad", T.StringType()),
        ]
    )
    rows = spark.read.schema(schema).json(f"{tasks.rstrip('/')}/*/metrics.json", multiLine=True, mode="PERMISSIVE", columnNameOfCorruptRecord="_bad")
    bad = rows.agg(F.count_if(F.col("_bad").isNotNull()), F.max("turns")).first()[0]
    if bad:
        warnings.warn(f"{bad} malformed metrics files are left out", stacklevel=2)
    return rows.where(F.col("_bad").isNull()).drop("_bad").withColumnRenamed("kg_preflight_bytes", "preflight_bytes")


# ---------------------------------------------------------------- the driver's side


def project_root(start: str) -> Path:
    """SRC20: the nearest folder with settings, else the top of the working tree, else one with a build file, else the start."""
    here = Path(start).resolve()
    up = [here, *here.parents]
    for p in up:
        if (p / ".ai").is_dir():
            return p
    try:
        top = subprocess.run(["git", "-C", str(here), "rev-parse", "--show-toplevel"], capture_output=True, text=True, timeout=10)
        if top.returncode == 0 and top.stdout.strip():
            return Path(top.stdout.strip())
    except (OSError, subprocess.TimeoutExpired):
        pass
    marks = ("go.mod", "package.json", "pyproject.toml", "Cargo.toml", "pom.xml", "build.gradle", "Makefile")
    return next((p for p in up if any((p / m).exists() for m in marks)), here)


def allowed_host(host: str) -> bool:
    """Hosts that SPINDLE_HOSTS lists, with those below them; unset, local ones only."""
    own = [h.strip().lower() for h in os.environ.get("SPINDLE_HOSTS", "localhost,127.0.0.1").split(",") if h.strip()]
    return any(h == "*" or host.lower() == h or host.lower().endswith("." + h) for h in own)


def fetch(url: str, timeout: float = 30.0, allowed: Callable[[str], bool] = allowed_host) -> tuple[str, bytes]:
    """SRC18: extension and content of a page. A status of 400 and above is an error; text/html and no type at all mean HTML."""
    from urllib.error import HTTPError
    from urllib.parse import urlsplit
    from urllib.request import urlopen

    parts = urlsplit(url)
    if parts.scheme not in ("http", "https"):
        raise ValueError(f"unsupported scheme: {parts.scheme or url}")
    if not allowed(parts.hostname or ""):
        raise PermissionError(f"host not allowed: {parts.hostname}")
    try:
        with urlopen(url, timeout=timeout) as r:
            kind = r.headers.get("Content-Type", "") or ""
            return (".html" if not kind or "text/html" in kind else Path(parts.path).suffix.lower() or ".txt"), r.read()
    except HTTPError as e:
        raise ValueError(f"status {e.code}: {url}") from e
