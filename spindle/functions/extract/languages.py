"""Extractors of programming languages (EX1 to EX15): lexers that blank comments and strings, then declaration patterns.

Each language says how packages, imports, functions and types look, and whether calls are recorded. Calls belong to the
nearest enclosing recorded function, and are dropped outside any.
"""

from __future__ import annotations

import ast
import re
from dataclasses import dataclass, field

from .records import Records

_ID = r"[A-Za-z_$][\w$]*"
_CALL = re.compile(rf"(?<![\w$])({_ID}(?:\s*\??\.\s*{_ID})*)\s*(?:\[[^\[\]()]*\]\s*|<[\w\s,.<>]*>\s*)?\(")
_TRAILING = re.compile(rf"(?<![\w$])({_ID}(?:\.{_ID})*)\s*\{{")
_NOT_CALLS = frozenset(
    "if for while switch catch return func function def fun class new match when else do try await yield throw typeof sizeof in is not and or elif except with super this self synchronized using lock foreach fn "
    "constructor init import package assert defer select case sealed object trait interface enum struct".split()
)


#: Words that a declaration pattern may meet where a name stands.
_NOT_NAMES = frozenset("if for while switch catch return function else do try new throw synchronized using lock foreach super this when await yield".split())
#: Where a member may begin, and what can't be its type.
_BEGIN = r"(?:^|(?<=[{};]))\s*"
_NO_TYPE = r"(?!(?:return|new|else|throw|assert|await|yield|case|goto|import|using|package)\b)"


def callee(text: str) -> str | None:
    """EX15: the last dotted segment, if it is an identifier."""
    last = text.replace("?", "").split(".")[-1].strip()
    return last if re.fullmatch(_ID, last) else None


@dataclass
class Language:
    functions: list[str]
    types: list[str] = field(default_factory=list)
    imports: list[str] = field(default_factory=list)
    package: str | None = None
    calls: bool = False
    trailing: bool = False  # name { ... } is a call with a lambda
    exported: bool = False  # only names that start in upper case
    line: tuple[str, ...] = ("//",)
    block: tuple[tuple[str, str], ...] = (("/*", "*/"),)
    quotes: tuple[str, ...] = ('"', "'")
    bodies: str = "brace"
    strip_import: str = "\"'`"


def blank(text: str, lang: Language) -> str:
    """The text with comments and string contents as spaces; line feeds and lengths stay."""
    marks = sorted([*lang.line, *(b for b, _ in lang.block), *lang.quotes], key=len, reverse=True)
    find = re.compile("|".join(map(re.escape, marks)))
    closing = dict(lang.block)
    out, at = [], 0
    hide = lambda s: re.sub(r"[^\n]", " ", s)
    while m := find.search(text, at):
        out.append(text[at : m.start()])
        mark = m[0]
        if mark in closing:
            end = text.find(closing[mark], m.end())
            end = len(text) if end < 0 else end + len(closing[mark])
            out.append(hide(text[m.start() : end]))
        elif mark in lang.line:
            end = text.find("\n", m.end())
            end = len(text) if end < 0 else end
            out.append(hide(text[m.start() : end]))
        else:
            multi = len(mark) > 1 or mark == "`"
            k = m.end()
            while k < len(text) and not text.startswith(mark, k) and (multi or text[k] != "\n"):
                k += 2 if text[k] == "\\" and not (mark == "`" and lang.exported) else 1
            end = min(len(text), k + (len(mark) if text.startswith(mark, k) else 0))
            out.append(mark + hide(text[m.end() : max(m.end(), end - len(mark))]) + text[max(m.end(), end - len(mark)) : end])
        at = end
    return "".join([*out, text[at:]])


def body_end(text: str, at: int) -> int:
    """Where the declaration that goes on at ``at`` ends: behind its braces, or at the end of an expression or signature."""
    depth = 0
    k = at
    while k < len(text):
        c = text[k]
        if c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
        elif c == "{" and depth <= 0:
            braces = 0
            while k < len(text):
                braces += (text[k] == "{") - (text[k] == "}")
                k += 1
                if not braces:
                    return k
            return k
        elif c == ";" and depth <= 0:
            return k
        elif c == "\n" and depth <= 0 and not re.match(r"\s*(?:[{=.:]|->|throws\b|where\b)", text[k:]) and not re.search(r"(?:=|=>|,|->|:)\s*$", text[at:k]):
            return k
        k += 1
    return k


def scan(rel_path: str, text: str, lang: Language) -> Records:
    out = Records(rel_path)
    plain = blank(text, lang)
    if lang.package and (m := re.search(lang.package, plain, re.MULTILINE)):
        out.package(m[1].strip())
    found: list[tuple[int, str, str, int]] = []
    for kind, patterns in (("import", lang.imports), ("function", lang.functions), ("type", lang.types)):
        for pattern in patterns:
            source = text if kind == "import" else plain
            for m in re.finditer(pattern, source, re.MULTILINE):
                if kind == "import" and plain[m.start() : m.end()].strip() == "":
                    continue  # within a comment
                name = m[1].strip()
                if kind == "import" or name and name not in _NOT_NAMES and not (lang.exported and not name[0].isupper()):
                    found.append((m.start(1), kind, name, m.end()))
    recorded: list[tuple[int, int, str]] = []
    for start, kind, name, end in sorted(found):
        if kind == "import":
            for path in expand_import(name, lang):
                out.imports(path)
        else:
            eid = out.member(kind, name)
            if kind == "function":
                recorded.append((start, body_end(plain, end - (plain[end - 1] in "{;\n")), eid))
    if lang.calls and recorded:
        places = [(m.start(1), m[1]) for m in _CALL.finditer(plain)]
        if lang.trailing:
            places += [(m.start(1), m[1]) for m in _TRAILING.finditer(plain)]
        starts = {s for s, _, _ in recorded} | {s for s, *_ in found}
        for at, name in sorted(places):
            target = callee(name)
            if at in starts or target is None or target in _NOT_CALLS:
                continue
            around = [r for r in recorded if r[0] < at < r[1]]
            if around:
                out.call(max(around)[2], target)
    return out


def expand_import(raw: str, lang: Language) -> list[str]:
    if lang is LANGUAGES["scala"]:
        return scala_imports(raw)
    name = raw.strip().strip(lang.strip_import).strip()
    if lang is LANGUAGES["kotlin"]:
        name = re.sub(r"\s+as\s+\w+$", "", name)
    return [name] if name else []


def scala_imports(raw: str) -> list[str]:
    """One path per selector, renames by their original name, wildcards as ``_``."""
    out = []
    for part in re.split(r",(?![^{]*\})", raw):
        part = part.strip()
        if m := re.fullmatch(r"(.*)\.\{(.*)\}", part, re.DOTALL):
            for s in m[2].split(","):
                s = re.split(r"\s*(?:=>|\bas\b)\s*", s.strip())[0]
                if s:
                    out.append(f"{m[1]}.{'_' if s == '*' else s}")
        elif part:
            part = re.split(r"\s+as\s+", part)[0]
            out.append(re.sub(r"\.\*$", "._", part))
    return out


_C_FUNC = r"^(?:[A-Za-z_][\w\s*&:<>,~]*?[\s*&])([A-Za-z_~][\w:~]*)\s*\([^;{}()]*(?:\([^()]*\)[^;{}()]*)*\)\s*(?:const\s*|noexcept\s*|override\s*)*\{"
_JS = dict(
    functions=[
        rf"\bfunction\s*\*?\s*({_ID})\s*(?:<[^>]*>)?\(", rf"{_BEGIN}(?:(?:async|get|override|private|protected|public|readonly|set|static)\s+)*\*?({_ID})\s*(?:<[^>]*>)?\([^()]*(?:\([^()]*\)[^()]*)*\)\s*(?::[^{{;=]+)?\{{",
    ],
    types=[rf"\bclass\s+({_ID})", rf"\binterface\s+({_ID})"],
    imports=[r"^\s*import\b[^;\n'\"]*?(?:from\s*)?(['\"][^'\"\n]+['\"])", r"^\s*import\s*\{[^}]*\}\s*from\s*(['\"][^'\"\n]+['\"])"],
    calls=True, quotes=('"', "'", "`"),
)
_ARROW = rf"\b(?:const|let|var)\s+({_ID})\s*(?::[^=\n]+)?=\s*(?:async\s*)?(?:\([^()]*(?:\([^()]*\)[^()]*)*\)|{_ID})\s*(?::[^=\n]+)?=>"

LANGUAGES: dict[str, Language] = {
    "go": Language(
        [rf"^func\s+(?:\([^)]*\)\s*)?({_ID})\s*(?:\[[^\]]*\]\s*)?\("], [rf"^type\s+({_ID})\b(?!\s*\()", rf"(?<=\n)\t({_ID})\s+(?:struct|interface)\b"],
        [r"^import\s+(?:[\w.]+\s+)?(\"[^\"\n]+\")", r"^\s+(?:[\w.]+\s+)?(\"[^\"\n]+\")\s*$"], r"^package\s+(\w+)", True, False, True, quotes=('"', "`", "'"),
    ),
    "java": Language(
        [
            rf"{_BEGIN}(?:@\w+(?:\([^)]*\))?\s*)*(?:(?:abstract|default|final|native|private|protected|public|static|synchronized)\s+)*(?:<[^>]+>\s*)?{_NO_TYPE}[\w.$]+(?:<[^(){{}};]*>)?(?:\[\])*\s+({_ID})\s*\([^;{{}}]*\)\s*(?:throws\s+[\w.,\s]+)?[{{;]",
            rf"{_BEGIN}(?:(?:public|private|protected)\s+)?([A-Z]\w*)\s*\([^;{{}}]*\)\s*(?:throws\s+[\w.,\s]+)?\{{",
        ],
        [rf"\b(?:class|interface|enum)\s+({_ID})"], [r"^\s*import\s+(?:static\s+)?([\w.*]+)\s*;"], r"^\s*package\s+([\w.]+)\s*;", True,
    ),
    "kotlin": Language(
        [rf"\bfun\s+(?:<[^>]*>\s*)?(?:[\w.<>?]+\.)?({_ID})\s*\("], [rf"\b(?:class|object|interface)\s+({_ID})"], [r"^\s*import\s+([\w.*]+(?:\s+as\s+\w+)?)"], r"^\s*package\s+([\w.]+)", True, True, quotes=('"""', '"', "'"),
    ),
    "c": Language([_C_FUNC], [rf"\b(?:struct|enum|union)\s+({_ID})\s*\{{"], [r"^\s*#\s*include\s*([<\"][^>\"\n]+[>\"])"], strip_import="<>\"'"),
    "cpp": Language([_C_FUNC], [rf"\b(?:class|struct|enum(?:\s+class)?)\s+({_ID})\s*(?:final\s*)?(?::[^{{;]*)?\{{"], [r"^\s*#\s*include\s*([<\"][^>\"\n]+[>\"])"], strip_import="<>\"'"),
    "rust": Language([rf"\bfn\s+({_ID})"], [rf"\b(?:struct|enum|trait)\s+({_ID})"], [r"^\s*(?:pub\s+)?use\s+([^;]+);"], quotes=('"',)),
    "scala": Language(
        [rf"\bdef\s+({_ID})"], [rf"\b(?:class|object|trait|enum|type)\s+({_ID})"], [r"^\s*import\s+([^\n{]+(?:\{[^}]*\})?[^\n]*)"], r"^\s*package\s+([\w.]+)", True, quotes=('"""', '"'),
    ),
    "swift": Language([rf"\bfunc\s+({_ID})"], [rf"\b(?:class|struct|protocol)\s+({_ID})\s*[:<{{\s]"], [r"^\s*(?:@\w+\s+)?import\s+(?:(?:class|struct|func|enum|protocol)\s+)?([\w.]+)"], quotes=('"""', '"')),
    "ruby": Language(
        [r"^\s*def\s+(?:self\.)?([A-Za-z_]\w*[?!=]?)"], [r"^\s*(?:class|module)\s+([A-Z]\w*(?:::\w+)*)"], [r"^\s*require(?:_relative)?\s*\(?\s*(['\"][^'\"\n]+['\"])"], line=("#",), block=(("=begin", "=end"),),
    ),
    "csharp": Language(
        [
            rf"{_BEGIN}(?:\[[^\]]*\]\s*)*(?:(?:abstract|async|extern|internal|new|override|partial|private|protected|public|sealed|static|unsafe|virtual)\s+)*{_NO_TYPE}[\w.]+(?:<[^(){{}};]*>)?(?:\[\])*\??\s+({_ID})\s*(?:<[^>]*>)?\([^;{{}}]*\)\s*(?:where[^{{]*)?(?:\{{|=>|;)",
            rf"{_BEGIN}(?:(?:internal|private|protected|public|static)\s+)*([A-Z]\w*)\s*\([^;{{}}]*\)\s*(?::\s*(?:base|this)\([^)]*\)\s*)?\{{",
        ],
        [rf"\b(?:class|interface|struct)\s+({_ID})"], [r"^\s*(?:global\s+)?using\s+(?:static\s+)?([\w.]+)\s*;"],
    ),
    "typescript": Language(**(_JS | {"types": [*_JS["types"], rf"\btype\s+({_ID})\s*(?:<[^>]*>)?="]})),
    "tsx": Language(**(_JS | {"functions": [*_JS["functions"], _ARROW]})),
    "javascript": Language(**(_JS | {"functions": [*_JS["functions"], _ARROW]})),
    "bash": Language([r"^\s*(?:function\s+)?([A-Za-z_][\w-]*)\s*\(\s*\)\s*\{?", r"^\s*function\s+([A-Za-z_][\w-]*)\s*\{"], [], [r"^\s*(?:source|\.)\s+([^\s;#]+)"], line=("#",), block=()),
    "groovy": Language(
        [rf"^\s*(?:(?:public|private|protected|static|final)\s+)*(?:def|void|[A-Z][\w<>\[\]]*|int|long|boolean|double)\s+({_ID})\s*\([^;{{}}]*\)\s*\{{"], [rf"\b(?:class|interface|enum|trait)\s+({_ID})"], [r"^\s*import\s+(?:static\s+)?([\w.*]+)"],
        r"^\s*package\s+([\w.]+)",
    ),
}

EXTENSIONS = {
    ".go": "go", ".py": "python", ".java": "java", ".kt": "kotlin", ".kts": "kotlin", ".c": "c", ".h": "c", ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".hpp": "cpp", ".rs": "rust",
    ".scala": "scala", ".sc": "scala", ".swift": "swift", ".rb": "ruby", ".cs": "csharp", ".ts": "typescript", ".tsx": "tsx", ".js": "javascript", ".jsx": "javascript",
    ".sh": "bash", ".bash": "bash", ".groovy": "groovy", ".gradle": "groovy", ".css": "css",
}


def python(rel_path: str, text: str) -> Records:
    """EX3, by the syntax tree; names that start with an underscore are left out."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        lang = Language([r"^\s*(?:async\s+)?def\s+([A-Za-z]\w*)\s*\("], [r"^\s*class\s+([A-Za-z]\w*)"], [r"^\s*import\s+([\w.]+)", r"^\s*from\s+([\w.]+)\s+import"], line=("#",), block=(), quotes=('"""', "'''", '"', "'"))
        return scan(rel_path, text, lang)
    out = Records(rel_path)

    def walk(node: ast.AST, owner: str | None) -> None:
        for child in ast.iter_child_nodes(node):
            inner = owner
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                if not child.name.startswith("_"):
                    inner = out.member("function", child.name)
            elif isinstance(child, ast.ClassDef):
                if not child.name.startswith("_"):
                    out.member("type", child.name)
            elif isinstance(child, ast.Import):
                for a in child.names:
                    out.imports(a.name)
            elif isinstance(child, ast.ImportFrom):
                out.imports("." * child.level + (child.module or ""))
            elif isinstance(child, ast.Call) and owner:
                f = child.func
                name = f.attr if isinstance(f, ast.Attribute) else f.id if isinstance(f, ast.Name) else None
                if name:
                    out.call(owner, name)
            walk(child, inner)

    walk(tree, None)
    return out


def css(rel_path: str, text: str) -> Records:
    """Selectors of rule sets, at any depth, as types."""
    out = Records(rel_path)
    plain = re.sub(r"/\*.*?(?:\*/|\Z)", lambda m: " " * len(m[0]), text, flags=re.DOTALL)
    for m in re.finditer(r"([^{};]+)\{", plain):
        selector = " ".join(m[1].split())
        if selector and not selector.startswith("@"):
            out.member("type", selector)
    return out


def source(rel_path: str, text: str, language: str) -> Records:
    if language == "python":
        return python(rel_path, text)
    return css(rel_path, text) if language == "css" else scan(rel_path, text, LANGUAGES[language])
