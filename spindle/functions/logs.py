"""Execution logs and application logs (EX30 to EX35), with a registry of log formats."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timezone
from pathlib import PurePosixPath

# ---------------------------------------------------------------- execution logs (EX30, A13)

_TOOL = re.compile(r"🔧 Tool: ([^\W\d]\w*)", re.ASCII)
_TURN = re.compile(r"Turn (\d+) \(inactive:", re.ASCII)
_TOKENS = re.compile(r"cumulative:(\d+)", re.ASCII)
#: Borders as in engines whose word characters are ASCII: a symbol needs word characters beside it, so it rarely counts.
_ERROR = re.compile(r"(?<![0-9A-Za-z_])(?:error|fail|panic)(?![0-9A-Za-z_])|(?<=[0-9A-Za-z_])[❌✗](?=[0-9A-Za-z_])", re.IGNORECASE)
_HARMLESS = ("err != nil", "return err", "error handling", '"error"', "`error`")


@dataclass
class ExecLog:
    turns: int = 0
    tools: dict[str, int] = field(default_factory=dict)
    files: set[str] = field(default_factory=set)
    errors: bool = False
    tokens: int = 0


def parse_exec_log(text: str) -> ExecLog:
    """The largest turn, the last token total, one tool a line, files of the four file tools, and whether a line tells of an error."""
    log = ExecLog()
    for line in text.split("\n"):
        if m := _TOOL.search(line):
            name = m[1]
            log.tools[name] = log.tools.get(name, 0) + 1
            at = line.find(f"🔧 Tool: {name}(")
            if name in ("Read", "Write", "Edit", "MultiEdit") and at >= 0:
                arg = line[at + len(f"🔧 Tool: {name}(") :]
                end = re.search(r"[,)]", arg)
                arg = arg[: end.start()].strip() if end and end.start() else arg
                if "." in arg and " " not in arg:
                    log.files.add(arg)
        if m := _TURN.search(line):
            log.turns = max(log.turns, int(m[1]))
        if m := _TOKENS.search(line):
            log.tokens = int(m[1])
        if not log.errors and _ERROR.search(line) and not any(h in line.lower() for h in _HARMLESS):
            log.errors = True
    return log


def _rfc3339(text: str) -> datetime | None:
    if not re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(?:\.\d+)?(?:Z|[+-]\d\d:\d\d)", text or ""):
        return None
    try:
        return datetime.fromisoformat(text.replace("Z", "+00:00"))
    except ValueError:
        return None


def exec_observations(text: str, metadata: str | None) -> list[str]:
    """What is said of a task, in a fixed order of lines."""
    try:
        meta = json.loads(metadata or "{}")
        meta = meta if isinstance(meta, dict) else {}
    except ValueError:
        meta = {}
    say = lambda k: meta.get(k) if isinstance(meta.get(k), str) else ""
    log = parse_exec_log(text)
    task = say("description").split("\n", 1)[0].strip()
    task = task[:300] + "…" if len(task) > 300 else task
    started = _rfc3339(say("spawned_at"))
    lines = [
        say("role") and "role: " + say("role"), say("status") and "status: " + say("status"), task and "task: " + task,
        started and f"started: {started.replace(tzinfo=None).isoformat(timespec='seconds')}Z", f"turns: {log.turns}", log.tokens > 0 and f"total_tokens: {log.tokens}",
        log.tools and "tool_calls: " + ", ".join(f"{n}:{log.tools[n]}" for n in sorted(log.tools)), log.files and "files_touched: " + ", ".join(sorted(log.files)), log.errors and "had_errors: true",
    ]
    return [x for x in lines if x]


# ---------------------------------------------------------------- application logs


@dataclass
class LogEntity:
    name: str
    type: str
    message: str = ""
    severity: str = "error"
    timestamp: datetime | None = None
    metadata: dict[str, str] = field(default_factory=dict)
    stack: list[str] = field(default_factory=list)
    source_file: str = ""
    source_line: int = 0


@dataclass
class LogResult:
    """Entities, and the summary of a file."""

    entities: list[LogEntity] = field(default_factory=list)
    lines: int = 0
    errors: int = 0
    warnings: int = 0
    start: datetime | None = None
    end: datetime | None = None
    affected: list[str] = field(default_factory=list)

    def seen_at(self, t: datetime | None) -> None:
        if t is not None:
            self.start = t if self.start is None or t < self.start else self.start
            self.end = t if self.end is None or t > self.end else self.end

    def touches(self, name: str) -> None:
        if name not in self.affected:
            self.affected.append(name)


def entity_observations(e: LogEntity, path: str) -> list[str]:
    """EX35: metadata sorted by key."""
    out = [f"source: {path}", f"severity: {e.severity}"]
    if e.timestamp is not None:
        t = e.timestamp if e.timestamp.tzinfo else e.timestamp.replace(tzinfo=timezone.utc)
        out.append("timestamp: " + t.isoformat(timespec="seconds").replace("+00:00", "Z"))
    if e.message:
        out.append(f"message: {e.message}")
    out += [f"{k}: {v}" for k, v in sorted(e.metadata.items())]
    if e.stack:
        out.append("stack_trace:\n" + "\n".join(e.stack))
    if e.source_file:
        out.append(f"source_file: {e.source_file}")
        if e.source_line > 0:
            out.append(f"source_line: {e.source_line}")
    return out


def _when(text: str) -> datetime | None:
    try:
        return datetime.strptime(" ".join(text.split()), "%Y-%m-%d %H:%M:%S.%f")
    except ValueError:
        return None


_CLOCK = r"\s+\d\d(?::\d\d){2}\.\d{3})\s+"
_LEVELLED = re.compile(rf"(?P<when>\d{{4}}(?:-\d\d){{2}}{_CLOCK}(?P<level>{'|'.join(('FATAL', 'ERROR', 'WARN', 'INFO', 'DEBUG', 'TRACE'))})\s+\d+\s+-{{3}}\s+\[(?P<thread>[^\]]+)\]\s+(?P<logger>[^:\s]+)\s*:[ \t]*(?P<text>.+)", re.ASCII)
_LOGCAT = re.compile(rf"(?P<when>\d\d-\d\d{_CLOCK}(?P<pid>\d+)\s+(?P<tid>\d+)\s+(?P<level>[DEFIVW])\s+(?P<tag>[^:]+):\s*(?P<text>.+)", re.ASCII)
_THROWN = re.compile(r"(?P<kind>[\dA-Za-z.]+(?:Exception|Error)):\s*(?P<why>.+)", re.ASCII)
_FRAME = re.compile(r"\s+at\s+(?P<owner>[$\w.]+)\.(?P<method>[<>\w]+)\((?P<file>[^):]+):(?P<row>\d+)\)", re.ASCII)
_FATAL = re.compile(r"FATAL EXCEPTION:\s+(?P<thread>.+)")


def _shown(f: re.Match) -> str:
    return "{owner}.{method}({file}:{row})".format(**f.groupdict())


class SpringBoot:
    """EX32. ``keep_stack`` also attaches stack traces; by default entities are recorded without them."""

    name = "spring-boot"

    def __init__(self, keep_stack: bool = False) -> None:
        self.keep_stack = keep_stack

    def matches(self, path: str, header: str) -> bool:
        if PurePosixPath(path).suffix.lower() not in (".log", ""):
            return False
        return bool(_LEVELLED.fullmatch(header)) or "--- [" in header and " INFO " in header or "org.springframework" in header

    def parse(self, path: str, text: str) -> LogResult:
        out, open_error, seen = LogResult(), None, set()
        for line in _lines(text):
            out.lines += 1
            if m := _LEVELLED.fullmatch(line):
                when, open_error = _when(m["when"]), None
                out.seen_at(when)
                out.warnings += m["level"] == "WARN"
                if m["level"] in ("ERROR", "FATAL"):
                    out.errors += 1
                    x = _THROWN.fullmatch(m["text"])
                    name = x and f"error:{x['kind']}:{when:%Y-%m-%d}" if when else None
                    if name and name not in seen:
                        seen.add(name)
                        meta = {"exception_type": x["kind"], "thread": m["thread"], "logger": m["logger"], "file": PurePosixPath(path).name}
                        open_error = LogEntity(name, "error", f"{x['kind']}: {x['why']}", timestamp=when, metadata=meta)
                        out.entities.append(open_error)
            elif open_error and (f := _FRAME.match(line)):
                out.touches(f["file"])
                if self.keep_stack:
                    open_error.stack.append(_shown(f))
        return out


class AndroidLogcat:
    """EX33. Lines have no year: it is a parameter."""

    name = "android-logcat"

    def __init__(self, year: int, keep_stack: bool = False) -> None:
        self.year, self.keep_stack = year, keep_stack

    def matches(self, path: str, header: str) -> bool:
        base = PurePosixPath(path).name.lower()
        return "logcat" in base or "android" in base or bool(_LOGCAT.fullmatch(header)) or "AndroidRuntime" in header or "FATAL EXCEPTION" in header

    def parse(self, path: str, text: str) -> LogResult:
        out, crash, seen = LogResult(), None, set()
        base = PurePosixPath(path).name

        def record(e: LogEntity) -> None:
            nonlocal crash
            if e.name not in seen:
                seen.add(e.name)
                out.entities.append(e)
                crash = e

        for line in _lines(text):
            out.lines += 1
            if m := _LOGCAT.fullmatch(line):
                when = _when(f"{self.year}-{m['when']}")
                out.seen_at(when)
                out.errors += m["level"] in "EF"
                out.warnings += m["level"] == "W"
                found = {k: m[k] for k in ("pid", "tid", "tag")} | {"file": base}
                stamp = when or datetime(1, 1, 1)
                if f := _FATAL.search(m["text"]):
                    record(LogEntity(f"crash:{f['thread']}:{stamp:%Y-%m-%d-%H:%M}", "crash", f"Fatal exception in thread: {f['thread']}", timestamp=when, metadata=found | {"thread": f["thread"]}))
                if m["level"] == "E" and (x := _THROWN.fullmatch(m["text"])):
                    meta = {k: v for k, v in found.items() if k != "tid"} | {"exception_type": x["kind"]}
                    record(LogEntity(f"error:{x['kind']}:{stamp:%Y-%m-%d}", "error", f"{x['kind']}: {x['why']}", timestamp=when, metadata=meta))
            elif crash:
                if f := _FRAME.match(line):
                    out.touches(f["file"])
                    if self.keep_stack:
                        crash.stack.append(_shown(f))
                elif not line.startswith(("\t", " ")):
                    crash = None
        return out


_THREAD = re.compile(r"Thread\s+(?P<n>\d+)(?:\s*name:\s*(?P<name>.+?)|\s*)(?:\s+Crashed|):", re.ASCII)
_ADDRESS = r"\d+\s+(?P<module>\S+)\s+0x[\da-f]+\s+"
_SWIFT = re.compile(_ADDRESS + r"(?P<symbol>\S+(?:\s+in\s[^+]+|))\s+(?:[+]\s+\d+|)", re.ASCII)
_OBJC = re.compile(_ADDRESS + r"(?P<symbol>.+?)\s+\+\s+\d+", re.ASCII)
_METHOD = re.compile(r"(?P<owner>\w+)\.(?P<method>[<>\w]+)\(.*\)(?:at\s+(?P<file>[^:]+):(?P<row>\d+)|)", re.ASCII)


class IOSCrash:
    """EX34: one entity a file, the last incident; its frames are those of the crashed thread."""

    name = "ios-crash"

    def matches(self, path: str, header: str) -> bool:
        if PurePosixPath(path).suffix.lower() in (".crash", ".ips"):
            return True
        return "Incident Identifier" in header or "Exception Type" in header or "OS Version:" in header and "iOS" in header

    def _frame(self, line: str, out: LogResult) -> str | None:
        m = _SWIFT.match(line)
        s = m and _METHOD.search(m["symbol"])
        if s and s["file"] and s["row"]:
            out.touches(s["file"])
            return "{owner}.{method} at {file}:{row}".format(**s.groupdict())
        if s:
            return f"{s['owner']}.{s['method']} in {m['module']}"
        m = m or _OBJC.match(line)
        return m and f"{m['symbol']} in {m['module']}"

    def parse(self, path: str, text: str) -> LogResult:
        out = LogResult(errors=1)
        crash, frames, inside, crashed = None, None, False, False
        for line in _lines(text):
            out.lines += 1
            key, _, value = line.partition(":")
            value = value.strip() if value[:1].isspace() else ""
            if key == "Incident Identifier" and value:
                crash = LogEntity(f"crash:{value}", "crash", metadata={"incident_id": value, "file": PurePosixPath(path).name})
            if crash is None:
                continue
            if value and key == "Exception Type":
                crash.metadata["exception_type"] = value
            elif value and key in ("Exception Codes", "Exception Subtype", "Exception Message"):
                crash.message = f"{crash.message} | {value}" if crash.message else value
            elif value and key == "Termination Reason":
                crash.metadata["termination_reason"] = value
                crash.message = crash.message or value
            elif value and key == "Date/Time":
                try:
                    crash.timestamp = datetime.strptime(value, "%Y-%m-%d %H:%M:%S.%f %z")
                    out.start = out.end = crash.timestamp
                except ValueError:
                    pass
            if m := _THREAD.match(line):
                inside = True
                if "Crashed" in line:
                    crashed, frames = True, []
                    crash.metadata["crashed_thread"] = f"{m['n']} ({m['name']})" if m["name"] else m["n"]
            elif inside and crashed:
                frame = self._frame(line, out)
                if frame:
                    frames = [*(frames or []), frame]
                elif not line.startswith(" "):
                    inside = False
                    if frames:
                        crash.stack, frames = frames, None
        if crash is not None:
            crash.message = crash.message or "iOS application crashed"
            crash.stack = frames or crash.stack
            out.entities.append(crash)
        return out


def _lines(text: str) -> list[str]:
    lines = [x.removesuffix("\r") for x in text.split("\n")]
    return lines[:-1] if lines and not lines[-1] else lines


@dataclass
class Registry:
    """EX31: the first format that matches a path and its first KiB takes the file."""

    formats: list = field(default_factory=list)

    def register(self, fmt) -> Registry:
        self.formats.append(fmt)
        return self

    def find(self, path: str, header: str):
        return next((f for f in self.formats if f.matches(path, header)), None)

    def parse(self, path: str, text: str) -> LogResult | None:
        fmt = self.find(path, text.encode()[:1024].decode(errors="ignore"))
        return fmt.parse(path, text) if fmt else None


def default_registry(year: int, keep_stack: bool = False) -> Registry:
    return Registry([IOSCrash(), AndroidLogcat(year, keep_stack), SpringBoot(keep_stack)])


LogFormat = Callable[[str, str], LogResult]
