"""Text of PDF files (EX25, MD11), from content streams: enough for plain and deflated streams and simple encodings."""

from __future__ import annotations

import re
import zlib

_OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", re.DOTALL)
_STREAM = re.compile(rb"(.*?)\bstream\r?\n(.*?)\r?\n?endstream", re.DOTALL)
_REF = re.compile(rb"(\d+)\s+\d+\s+R")
_SHOW = re.compile(rb"\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)\s*(?:Tj|'|\")|\[(?:[^\[\]\\()]|\((?:\\.|[^\\()])*\))*\]\s*TJ|<[0-9A-Fa-f\s]*>\s*Tj|\bT[dDm*]|\bET\b", re.DOTALL)
_STRING = re.compile(rb"\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|<[0-9A-Fa-f\s]*>", re.DOTALL)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f", b"\n": b"", b"\r": b""}


def _literal(raw: bytes) -> str:
    if raw[:1] == b"<":
        digits = re.sub(rb"\s", b"", raw[1:-1])
        data = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    else:
        data = re.sub(rb"\\([0-7]{1,3}|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else _ESCAPES.get(m[1], m[1]), raw[1:-1], flags=re.DOTALL)
    return data[2:].decode("utf-16-be", "replace") if data[:2] == b"\xfe\xff" else data.decode("cp1252", "replace")


def _text(stream: bytes) -> str:
    out: list[str] = []
    for m in _SHOW.finditer(stream):
        op = m[0]
        if op.endswith((b"Tj", b"TJ", b"'", b'"')):
            out += [_literal(s) for s in _STRING.findall(op)]
        elif out and not out[-1].endswith("\n"):
            out.append("\n")
    return "".join(out)


def _decoded(head: bytes, data: bytes) -> bytes:
    if b"FlateDecode" in head:
        try:
            return zlib.decompressobj().decompress(data)
        except zlib.error as e:
            raise ValueError(f"bad stream: {e}") from e
    return data


def pages(content: bytes) -> list[str]:
    """The plain text of each page, in order."""
    if not content.lstrip()[:5] == b"%PDF-":
        raise ValueError("not a PDF file")
    if re.search(rb"/Encrypt\s+\d+\s+\d+\s+R", content):
        return []
    objects = {int(n): body for n, body in _OBJECT.findall(content)}
    for body in list(objects.values()):  # objects within object streams
        m = _STREAM.match(body)
        if m and b"/ObjStm" in m[1]:
            data = _decoded(m[1], m[2])
            first = int(re.search(rb"/First\s+(\d+)", m[1])[1])
            numbers = list(map(int, data[:first].split()))
            for k in range(0, len(numbers) - 1, 2):
                end = numbers[k + 3] if k + 3 < len(numbers) else len(data) - first
                objects.setdefault(numbers[k], data[first + numbers[k + 1] : first + end])

    def in_order(number: int, seen: set[int]) -> list[int]:
        body = objects.get(number, b"")
        if number in seen:
            return []
        seen.add(number)
        if re.search(rb"/Type\s*/Pages\b", body):
            kids = re.search(rb"/Kids\s*\[(.*?)\]", body, re.DOTALL)
            return [p for k in _REF.findall(kids[1] if kids else b"") for p in in_order(int(k), seen)]
        return [number] if re.search(rb"/Type\s*/Page\b", body) else []

    roots = [n for n, b in objects.items() if re.search(rb"/Type\s*/Pages\b", b) and not re.search(rb"/Parent\b", b)]
    order = [p for r in roots for p in in_order(r, set())] or [n for n, b in sorted(objects.items()) if re.search(rb"/Type\s*/Page\b", b)]
    out = []
    for n in order:
        m = re.search(rb"/Contents\s*(?:\[(.*?)\]|(\d+\s+\d+\s+R))", objects[n], re.DOTALL)
        streams = [_STREAM.match(objects.get(int(r), b"")) for r in _REF.findall((m[1] or m[2]) if m else b"")]
        out.append("\n".join(_text(_decoded(s[1], s[2])) for s in streams if s))
    return out
