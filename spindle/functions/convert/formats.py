"""Dispatch by extension, and the formats that need no archive (MD1 to MD5, MD12 to MD14)."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable
from dataclasses import dataclass
from html.parser import HTMLParser
from pathlib import PurePosixPath

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import office
from .pdf import pages
from .table import markdown_table

# ---------------------------------------------------------------- CSV (MD3)


class CsvError(ValueError):
    pass


def strict_csv(text: str) -> list[list[str]]:
    """RFC 4180 read strictly: equal field counts, no stray quotes; blank lines are skipped."""
    rows: list[list[str]] = []
    at, n = 0, len(text)
    while at < n:
        if text.startswith(("\n", "\r\n"), at):
            at += 1 if text[at] == "\n" else 2
            continue
        row: list[str] = []
        while True:
            if at < n and text[at] == '"':
                parts, at = [], at + 1
                while True:
                    end = text.find('"', at)
                    if end < 0:
                        raise CsvError("quote not closed")
                    parts.append(text[at:end])
                    at = end + 1
                    if at < n and text[at] == '"':
                        parts.append('"')
                        at += 1
                    else:
                        break
                if at < n and text[at] not in ",\n" and not text.startswith("\r\n", at):
                    raise CsvError("text behind a quote")
                row.append("".join(parts).replace("\r\n", "\n"))
            else:
                m = re.compile(r"[^,\n]*").match(text, at)
                value, at = m[0], m.end()
                if '"' in value:
                    raise CsvError("stray quote")
                row.append(value.removesuffix("\r") if at >= n or text[at] == "\n" else value)
            if at < n and text[at] == ",":
                at += 1
                continue
            at += 2 if text.startswith("\r\n", at) else 1
            break
        if rows and len(row) != len(rows[0]):
            raise CsvError("field counts differ")
        rows.append(row)
    return rows


def csv_to_markdown(data: bytes) -> str:
    text = data.decode("utf-8", "replace")
    try:
        return markdown_table(strict_csv(text))
    except CsvError:
        return f"```csv\n{text}\n```"


# ---------------------------------------------------------------- JSON (MD4)


def _number(x: float) -> str:
    """A float as JSON text: shortest digits, exponents only below 1e-6 and from 1e21 on."""
    if x == int(x) and abs(x) < 1e21:
        return ("-" if x < 0 or str(x)[0] == "-" else "") + str(abs(int(x)))
    text = repr(x)
    if abs(x) < 1e-6 or abs(x) >= 1e21:
        mantissa, _, power = f"{text}e0".partition("e")[0], None, int(f"{x:e}".partition("e")[2])
        digits = text.replace("-", "").partition("e")[0].replace(".", "").strip("0")
        mantissa = digits[0] + ("." + digits[1:] if len(digits) > 1 else "")
        return f"{'-' if x < 0 else ''}{mantissa}e{'-' if power < 0 else '+'}{abs(power):02d}"
    return f"{x:.20f}".rstrip("0") if "e" in text else text


def json_to_markdown(data: bytes) -> str:
    """Indented, keys sorted, numbers as 64-bit floats, and <, > and & escaped; what isn't JSON stays as it is."""
    text = data.decode("utf-8", "replace")

    def strict(x: str):
        raise ValueError(x)

    try:
        value = json.loads(text, parse_int=float, parse_constant=strict)
    except (ValueError, RecursionError):
        return f"```json\n{text}\n```"

    def string(s: str) -> str:
        s = json.dumps(s, ensure_ascii=False)
        s = s.replace("<", "\\u003c").replace(">", "\\u003e").replace("&", "\\u0026").replace("\u2028", "\\u2028").replace("\u2029", "\\u2029")
        return s.replace("\x7f", "\x7f")

    def show(v, pad: str) -> str:
        deeper = pad + "  "
        if isinstance(v, dict):
            inner = [f"{deeper}{string(k)}: {show(v[k], deeper)}" for k in sorted(v, key=lambda k: k.encode("utf-8", "surrogatepass"))]
            return "{\n" + ",\n".join(inner) + f"\n{pad}}}" if inner else "{}"
        if isinstance(v, list):
            return "[\n" + ",\n".join(deeper + show(x, deeper) for x in v) + f"\n{pad}]" if v else "[]"
        if isinstance(v, str):
            return string(v)
        return {True: "true", False: "false", None: "null"}[v] if v is None or isinstance(v, bool) else _number(v)

    return f"```json\n{show(value, '')}\n```"


# ---------------------------------------------------------------- HTML (MD2)

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_DROP = frozenset("script style head title template noscript".split())
_BLOCK = frozenset("address article aside blockquote details dd div dl dt figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table ul body html tr td th tbody thead tfoot".split())


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = ("#root", {}, [])
        self.stack = [self.root]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _BLOCK and any(t[0] == "p" for t in self.stack):
            while self.stack[-1][0] != "p":
                self.stack.pop()
            self.stack.pop()
        ends = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "td", "th")}.get(tag, ())
        for k in range(len(self.stack) - 1, 0, -1):
            if not ends or self.stack[k][0] in ("table", "ul", "ol", "dl"):
                break
            if self.stack[k][0] in ends and self.stack[k - 1][0] not in ends:
                del self.stack[k:]
                break
        node = (tag, dict(attrs), [])
        self.stack[-1][2].append(node)
        if tag not in _VOID:
            self.stack.append(node)

    def handle_endtag(self, tag: str) -> None:
        if any(t[0] == tag for t in self.stack[1:]):
            while self.stack.pop()[0] != tag:
                pass

    def handle_data(self, data: str) -> None:
        self.stack[-1][2].append(data)


def _inline(nodes: list) -> str:
    out = []
    for n in nodes:
        if isinstance(n, str):
            out.append(re.sub(r"\s+", " ", re.sub(r"([\\`*_\[\]])", r"\\\1", n)))
            continue
        tag, attrs, inner = n
        if tag in _DROP:
            continue
        text = _inline(inner)
        core = text.strip()
        before, after = text[: len(text) - len(text.lstrip())], text[len(text.rstrip()) :] if core else ""
        if tag in ("b", "strong") and core:
            text = f"{before}**{core}**{after}"
        elif tag in ("i", "em") and core:
            text = f"{before}*{core}*{after}"
        elif tag in ("s", "del", "strike") and core:
            text = f"{before}~~{core}~~{after}"
        elif tag == "code":
            text = "`" + "".join(x for x in inner if isinstance(x, str)).strip() + "`" if inner else ""
        elif tag == "a" and attrs.get("href"):
            text = f"[{core}]({attrs['href']})" if core else ""
        elif tag == "img":
            text = f"![{attrs.get('alt') or ''}]({attrs['src']})" if attrs.get("src") else ""
        elif tag == "br":
            text = "  \n"
        out.append(text)
    return "".join(out)


def _raw(nodes: list) -> str:
    return "".join(n if isinstance(n, str) else _raw(n[2]) for n in nodes)


def _blocks(nodes: list) -> list[str]:
    out, run = [], []

    def flush() -> None:
        text = re.sub(r"[ \t]+", " ", _inline(run).replace("  \n", "\0"))
        text = re.sub(r" *\0 *", "  \n", text.strip(" \0"))
        run.clear()
        if text:
            out.append(text)

    for n in nodes:
        if isinstance(n, str) or n[0] not in _BLOCK:
            if not isinstance(n, str) and n[0] not in _DROP and any(not isinstance(x, str) and x[0] in _BLOCK for x in n[2]):
                flush()
                out += _blocks(n[2])
            elif isinstance(n, str) or n[0] not in _DROP:
                run.append(n)
            continue
        flush()
        tag, _, inner = n
        if re.fullmatch(r"h[1-6]", tag):
            text = " ".join(_inline(inner).split())
            if text:
                out.append("#" * int(tag[1]) + " " + text)
        elif tag == "pre":
            out.append("```\n" + _raw(inner).strip("\n") + "\n```")
        elif tag == "hr":
            out.append("* * *")
        elif tag == "blockquote":
            text = "\n\n".join(_blocks(inner))
            if text:
                out.append("\n".join(("> " + x).rstrip() for x in text.split("\n")))
        elif tag in ("ul", "ol"):
            items = [x for x in inner if not isinstance(x, str) and x[0] == "li"]
            lines = []
            for k, item in enumerate(items):
                mark = f"{k + 1}. " if tag == "ol" else "- "
                parts = _blocks(item[2])
                lines.append(mark + ("\n" + " " * len(mark)).join("\n".join(parts).split("\n")))
            if lines:
                out.append("\n".join(lines))
        elif tag == "table":
            rows = [[" ".join(_inline(c[2]).split()) for c in r[2] if not isinstance(c, str) and c[0] in ("td", "th")] for r in _rows(inner)]
            if any(rows):
                out.append(markdown_table([r for r in rows if r]).rstrip("\n"))
        else:
            out += _blocks(inner)
    flush()
    return out


def _rows(nodes: list):
    for n in nodes:
        if not isinstance(n, str):
            if n[0] == "tr":
                yield n
            else:
                yield from _rows(n[2])


def html_to_markdown(data: bytes) -> str:
    text = data.decode("utf-8", "replace")
    try:
        tree = _Tree()
        tree.feed(text)
        tree.close()
        return "\n\n".join(_blocks(tree.root[2]))
    except (RecursionError, AssertionError):
        return f"```html\n{text}\n```"


# ---------------------------------------------------------------- dispatch (MD1)


def _text(data: bytes) -> str:
    return data.decode("utf-8", "replace")


def _no_vision(_: bytes) -> str:
    raise ValueError("no reader of images is configured")


CONVERTERS: dict[str, Callable[[bytes], str]] = {
    ".html": html_to_markdown, ".htm": html_to_markdown, ".csv": csv_to_markdown, ".json": json_to_markdown,
    ".xml": lambda d: f"```xml\n{_text(d)}\n```", ".txt": _text, ".md": _text, ".docx": office.docx, ".xlsx": office.xlsx, ".xls": office.xlsx, ".pptx": office.pptx,
    ".pdf": lambda d: "\n\n---\n\n".join(x for p in pages(d) if (x := p.strip())), ".png": _no_vision, ".jpg": _no_vision, ".jpeg": _no_vision,
}


def register(ext: str, converter: Callable[[bytes], str]) -> None:
    """MD12: add or replace a format, for instance a reader of images."""
    CONVERTERS[ext.lower()] = converter


def extension(path: str) -> str:
    return PurePosixPath(path).suffix.lower()


def can_convert(path: str) -> bool:
    return extension(path) in CONVERTERS


def supported_formats() -> list[str]:
    return sorted(CONVERTERS)


@dataclass(frozen=True)
class Config:
    """MD13, MD14: the size limit (more fails) and whether images are read, from the environment."""

    max_bytes: int = 50 * 1024 * 1024
    images: bool = False

    @staticmethod
    def from_env(env: dict[str, str] | None = None) -> Config:
        env = dict(os.environ) if env is None else env
        size = env.get("CONVERT_MAX_BYTES", "")
        truth = env.get("CONVERT_IMAGES", "").strip().lower() in ("1", "true", "yes", "on")
        return Config(int(size) if re.fullmatch(r"[1-9]\d*", size) else Config.max_bytes, truth)


def convert(path: str, content: bytes, config: Config | None = None) -> str:
    """Markdown of a document; unknown formats and files over the limit raise."""
    config = config or Config()
    if len(content) > config.max_bytes:
        raise ValueError(f"file too large: {len(content)} bytes, at most {config.max_bytes}")
    f = CONVERTERS.get(extension(path))
    if f is None:
        raise ValueError(f"unsupported format: {extension(path) or path}")
    return f(content)


_RESULT = T.StructType([T.StructField("markdown", T.StringType()), T.StructField("error", T.StringType())])


@F.arrow_udf(_RESULT)
def _converted(paths: pa.Array, contents: pa.Array) -> pa.Array:
    texts, errors = [], []
    for p, c in zip(paths, contents):
        text = error = None
        try:
            text = convert(p.as_py() or "", c.as_py() or b"")
        except Exception as e:  # a file that can't be read is a row with an error
            error = f"{type(e).__name__}: {e}"
        texts.append(text)
        errors.append(error)
    return pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array(errors, pa.string())], ["markdown", "error"])


def converted(path: Column, content: Column) -> Column:
    """A struct of markdown and error for each document."""
    return _converted(path, content)
