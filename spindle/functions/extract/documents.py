"""Extractors of markup, data and build files (EX16 to EX29)."""

from __future__ import annotations

import json
import re
from html.parser import HTMLParser
from pathlib import PurePosixPath

from .records import Records, significant

# ---------------------------------------------------------------- Markdown (EX16, EX29)

_HEADING = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?[ \t]*$")
_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})[ \t]*([^\s`]*)")
#: The brackets around node labels, longer ones first, and what a label can't hold.
_AROUND = (("[[", "]]", "[]"), ("[", "]", "[]"), ("((", "))", ")"), ("([", "])", "]"), ("{", "}", "}"))
_LABELS = re.compile(r"[^\W\d]\w*(?:" + "|".join(rf"{re.escape(a)}([^{re.escape(no)}]+){re.escape(b)}" for a, b, no in _AROUND) + ")", re.ASCII)


def mermaid_labels(diagram: str) -> list[str]:
    """The distinct node labels of a diagram, in order."""
    found = []
    for m in _LABELS.finditer(diagram):
        label = next(g for g in m.groups() if g).strip()
        if significant(label) and "://" not in label:
            found.append(label)
    return list(dict.fromkeys(found))


def markdown(rel_path: str, text: str) -> Records:
    out = Records(rel_path)
    fence, lang, body = None, "", []
    for line in text.split("\n"):
        line = line.rstrip("\r")
        m = _FENCE.match(line)
        if fence:
            if m and m[1][0] == fence[0] and len(m[1]) >= len(fence) and not line.strip().strip(fence[0]):
                if lang.lower() == "mermaid":
                    for label in mermaid_labels("\n".join(body)):
                        out.member("type", label)
                fence = None
            else:
                body.append(line)
        elif m:
            fence, lang, body = m[1], m[2], []
        else:
            h = _HEADING.match(line)
            if h and len(h[1]) <= 3:
                title = re.sub(r"(?:^|[ \t])#+$", "", h[2] or "").strip()
                if title and significant(title):
                    out.member("topic", title)
    if fence and lang.lower() == "mermaid":
        for label in mermaid_labels("\n".join(body)):
            out.member("type", label)
    return out


# ---------------------------------------------------------------- HTML (EX17)


_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_TITLES = frozenset(("title", "h1", "h2", "h3"))


class _Outline(HTMLParser):
    """Collects what the outline needs; character references stay as written."""

    def __init__(self, out: Records) -> None:
        super().__init__(convert_charrefs=False)
        self.out = out
        self.stack: list[list] = []  # [tag, whether its first direct text has come]
        self.text: str | None = None

    def finish_text(self) -> None:
        name = (self.text or "").strip()
        if name:
            self.stack[-1][1] = True
            if significant(name):
                self.out.member("topic", name)
        self.text = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.finish_text()
        quoted = re.search(r"""(?i)\sid\s*=\s*["']""", self.get_starttag_text() or "")
        for name, value in attrs:
            if quoted and name == "id" and value and significant(value.strip()):
                self.out.member("type", value.strip())
        if tag not in _VOID:
            self.stack.append([tag, False])

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.stack.pop()

    def handle_endtag(self, tag: str) -> None:
        self.finish_text()
        if any(t == tag for t, _ in self.stack):
            while self.stack.pop()[0] != tag:
                pass

    def handle_data(self, data: str) -> None:
        if self.stack and self.stack[-1][0] in _TITLES and not self.stack[-1][1]:
            self.text = (self.text or "") + data

    def handle_entityref(self, name: str) -> None:
        self.handle_data(f"&{name};")

    def handle_charref(self, name: str) -> None:
        self.handle_data(f"&#{name};")


def html(rel_path: str, text: str) -> Records:
    """Title and h1 to h3 by their first direct text, as written; quoted ids."""
    out = Records(rel_path)
    p = _Outline(out)
    p.feed(text)
    p.close()
    p.finish_text()
    return out


# ---------------------------------------------------------------- YAML (EX18)

_YAML_NAMES = frozenset("kind name image module resource service stage job component target plugin extends".split())


def yaml_significant(value: str) -> bool:
    """At least 3 bytes, not a number or truth word, nor anything of at most 8 bytes that starts with v."""
    size = len(value.encode())
    if size < 3 or re.fullmatch(r"[0-9]+", value) or value.lower() in ("null", "on", "off", "yes", "no", "true", "false"):
        return False
    return not (value.startswith("v") and size <= 8)


#: Texts of which the parser in C makes the same nodes as the one in Python, which is many times slower, unless C's stops at an error.
_PLAIN_YAML = re.compile(r"[\n -~]*")
_ODD_YAML = re.compile(r"[!%&*?@`]|[|>]\S*#")


def yaml(rel_path: str, text: str) -> Records:
    import yaml as lib

    loader = getattr(lib, "CSafeLoader", None)
    if loader and _PLAIN_YAML.fullmatch(text) and not _ODD_YAML.search(text):
        out = _yaml(rel_path, text, loader)
        if out.error is None:
            return out
    return _yaml(rel_path, text, lib.SafeLoader)


def _yaml(rel_path: str, text: str, loader) -> Records:
    import yaml as lib

    out = Records(rel_path)

    def emit(value: str) -> None:
        if yaml_significant(value):
            out.member("type", value)

    def scalar(node) -> str:
        return node.value.strip() if isinstance(node, lib.ScalarNode) and not node.tag.endswith((":bool", ":null")) else ""

    def walk(node, root: bool) -> None:
        if isinstance(node, lib.MappingNode):
            if not node.flow_style:
                for k, v in node.value:
                    key, value = scalar(k), scalar(v) if not (isinstance(v, lib.ScalarNode) and v.style in ("|", ">")) else ""
                    if root and key:
                        emit(key)
                    if key.lower() in _YAML_NAMES and value:
                        emit(value)
            for k, v in node.value:
                walk(k, False)
                walk(v, False)
        elif isinstance(node, lib.SequenceNode):
            for v in node.value:
                walk(v, False)

    try:
        for doc in lib.compose_all(text, Loader=loader):
            if doc is not None:
                walk(doc, True)
    except (lib.YAMLError, RecursionError) as e:
        out.error = f"yaml: {str(e).splitlines()[0]}"
    return out


# ---------------------------------------------------------------- JSON schema (EX19, SC12)


def schema_name(root: dict, rel_path: str) -> str:
    title = root.get("title")
    if isinstance(title, str) and title.strip():
        return title.strip()
    own = root.get("$id")
    if isinstance(own, str) and own:
        last = re.split(r"[/\\]", own.split("#", 1)[0])[-1]
        last = last.rpartition(".")[0] if "." in last else last
        if last:
            return last
    base = PurePosixPath(rel_path).name
    for suffix in (".schema.json", ".json"):
        if base.lower().endswith(suffix):
            return base[: -len(suffix)]
    return base


def json_schema(rel_path: str, text: str) -> Records:
    try:
        root = json.loads(text)
    except ValueError:
        root = None
    if not isinstance(root, dict):
        return Records(rel_path, with_file=False)
    out = Records(rel_path)
    names = [schema_name(root, rel_path)]
    for key in ("$defs", "definitions"):
        defs = root.get(key)
        if isinstance(defs, dict):
            names += sorted(defs)
    for name in filter(None, names):
        out.member("type", name)
    return out


# ---------------------------------------------------------------- GraphQL (EX21)

_A = re.ASCII | re.IGNORECASE
_NAME = r"([^\W\d]\w*)"
_EXTEND = r"\s*(?:extend\s+)?"
_GQL_TYPE = re.compile(rf"{_EXTEND}(?:{'|'.join(('enum', 'input', 'interface', 'scalar', 'type', 'union'))})\s+{_NAME}", _A)
_GQL_DIRECTIVE = re.compile(rf"\s*directive\s+@{_NAME}", _A)
_GQL_ROOT = re.compile(rf"{_EXTEND}type\s+(?:Mutation|Query|Subscription)\b", _A)
_GQL_FIELD = re.compile(rf"\s+{_NAME}\s*[(:]", re.ASCII)


def graphql(rel_path: str, text: str) -> Records:
    out = Records(rel_path)
    depth, operations = 0, False
    for line in text.splitlines():
        bare = line.strip()
        if not bare or bare.startswith("#"):
            continue
        before = depth
        for c in line.split("#", 1)[0]:
            depth = depth + 1 if c == "{" else max(0, depth - 1) if c == "}" else depth
        operations = operations and depth > 0
        if not before:
            operations = operations or bool(_GQL_ROOT.match(line))
            if m := _GQL_TYPE.match(line):
                if not m[1].startswith("__"):
                    out.member("type", m[1])
                continue
            if m := _GQL_DIRECTIVE.match(line):
                out.member("type", "@" + m[1])
                continue
        if operations and before == 1 and (m := _GQL_FIELD.match(line)):
            out.member("function", m[1])
    return out


# ---------------------------------------------------------------- Make and CMake (EX22, EX23, SC11)

_TARGET = re.compile(r"([^\W\d_][-./\w]*)\s*:[^=]", re.ASCII)
_VARIABLE = re.compile(rf"{_NAME}\s*(?:[!?]|::?)?=", re.ASCII)
_CMAKE = re.compile(rf"\s*{_NAME}\s*\(([^)]*)\)", re.ASCII)


def makefile(rel_path: str, text: str) -> Records:
    """A target needs a character after its colon, and ``X ::= y`` reads as one, as documented."""
    out = Records(rel_path)
    for line in text.splitlines():
        if line.startswith(("#", "\t")):
            continue
        if m := _TARGET.match(line):
            out.member("function", m[1])
        elif m := _VARIABLE.match(line):
            out.member("type", m[1])
    return out


def first_argument(args: str) -> str:
    return re.split(r"[ \t\n\r;]", args.strip(), maxsplit=1)[0]


def cmake(rel_path: str, text: str) -> Records:
    out = Records(rel_path)
    for line in text.splitlines():
        m = None if line.strip().startswith("#") else _CMAKE.match(line)
        first = first_argument(m[2]) if m else ""
        if not first:
            continue
        command = m[1].lower()
        if command in ("project", "add_executable", "add_library", "add_subdirectory"):
            out.member("type", first)
        elif command in ("find_package", "include"):
            out.imports(first)
    return out


# ---------------------------------------------------------------- assembly (EX24, SC10)

_EQUATES, _MACRO, _MACRO_END, _INCLUDE = {"EQ", "EQU", "=", "SET", "DEFL"}, {"MA", "MAC", "MACRO"}, {"EM", "ENDM", "<<<"}, {"IN", "INB", "PUT", "USE", "INCLUDE", "GET"}


def split_line(line: str) -> tuple[str, str, str]:
    """Label, operation and operand of a line whose comment is gone; only a token in the first column is a label."""
    words = line.split()
    label = ""
    if words and line[0] not in " \t":
        label = words.pop(0).removesuffix(":")
    operation = words[0].removeprefix(".").upper() if words else ""
    return label, operation, words[1] if len(words) > 1 else ""


def uncommented(line: str) -> str:
    return "" if line.startswith("*") else line.split(";", 1)[0].rstrip(" \t\r")


def assembly(rel_path: str, text: str) -> Records:
    out = Records(rel_path)
    good = lambda s: significant(s) and s[0] not in ".]"
    inside = False
    for line in text.split("\n"):
        label, operation, operand = split_line(uncommented(line))
        if operation in _MACRO_END:
            inside = False
        elif inside or not (label or operation):
            continue
        elif operation in _MACRO:
            inside = True
            if good(label or operand):
                out.member("function", label or operand)
        elif operation in _EQUATES:
            if good(label):
                out.member("type", label)
        elif operation in _INCLUDE:
            if path := (operand or label).strip("\"'<>`"):
                out.imports(path)
        elif good(label):
            out.member("function", label)
    return out


# ---------------------------------------------------------------- PDF text (EX25 to EX27)

CHUNK_BYTES, LEAST_CHARS = 2000, 20


def normalise_whitespace(text: str) -> str:
    """At most two blank lines in a row, no trailing blanks, trimmed."""
    lines, blanks = [], 0
    for line in text.split("\n"):
        line = line.rstrip(" \t\r")
        blanks = 0 if line else blanks + 1
        if blanks <= 2:
            lines.append(line)
    return "\n".join(lines).strip()


def chunk_text(text: str, most: int = CHUNK_BYTES) -> list[str]:
    """Pieces of at most ``most`` bytes, cut behind a line feed of the second half where there is one; all but the last carry a number."""
    if len(text.encode()) <= most:
        return [text]
    out: list[str] = []
    left = text.encode()
    while left:
        if len(left) <= most:
            out.append(left.decode())
            break
        part = left[:most].decode(errors="ignore").encode()
        at = part.rfind(b"\n")
        at = len(part) if at < most // 2 else at + 1
        piece = left[:at].decode().strip()
        if piece:
            out.append(f"[PDF chunk {len(out) + 1}] {piece}")
        left = left[at:].decode().strip().encode()
    return out


def pdf(rel_path: str, content: bytes) -> Records:
    from ..convert.pdf import pages

    out = Records(rel_path, with_file=False)
    text = normalise_whitespace("\n".join(pages(content)))
    if len(text) < LEAST_CHARS:
        return out
    eid = out.entity(f"pdf:{rel_path}", rel_path, "file")
    out.observations += [(eid, c) for c in chunk_text(text) if len(c) >= LEAST_CHARS]
    return out
