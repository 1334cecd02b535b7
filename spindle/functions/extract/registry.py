"""Which extractor a path goes to (SRC7), and the extraction of a table of files as one UDF."""

from __future__ import annotations

import re
from collections.abc import Callable
from pathlib import PurePosixPath

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ...schema import EXTRACTED
from . import documents, languages
from .records import Records

TextExtractor = Callable[[str, str], Records]


def _suffix(*ends: str) -> Callable[[str, bytes], bool]:
    return lambda path, _: path.lower().endswith(ends)


def _base(path: str) -> str:
    return PurePosixPath(path.lower()).name


def _is_schema(path: str, content: bytes) -> bool:
    base = _base(path)
    return base.endswith(".schema.json") or base == "schema.json" or base.endswith(".json") and b'"$schema"' in content[:512]


def _is_makefile(path: str, _: bytes) -> bool:
    base = _base(path)
    return base in ("makefile", "gnumakefile", "bsdmakefile") or base.startswith("make") and base.endswith(".txt") or base.endswith((".mk", ".make"))


#: In order: the first that matches takes the file. Programming languages go before all of them, by extension.
EXTRACTORS: list[tuple[str, Callable[[str, bytes], bool], TextExtractor]] = [
    ("assembly", _suffix(".asm", ".s", ".s.txt", ".asm.txt"), documents.assembly),
    ("markdown", _suffix(".md", ".markdown", ".mdx"), documents.markdown),
    ("yaml", _suffix(".yaml", ".yml"), documents.yaml),
    ("html", _suffix(".html", ".htm"), documents.html),
    ("pdf", _suffix(".pdf"), None),
    ("json_schema", _is_schema, documents.json_schema),
    ("graphql", _suffix(".graphql", ".graphqls", ".gql"), documents.graphql),
    ("makefile", _is_makefile, documents.makefile),
    ("cmake", lambda path, _: _base(path) == "cmakelists.txt" or path.lower().endswith(".cmake"), documents.cmake),
]


def register(name: str, matches: Callable[[str, bytes], bool], extractor: TextExtractor) -> None:
    """Add a format behind the built-in ones."""
    EXTRACTORS.append((name, matches, extractor))


def format_of(rel_path: str, content: bytes = b"") -> str | None:
    m = re.search(r"\.[^./]*$", rel_path.lower())
    language = languages.EXTENSIONS.get(m[0]) if m else None
    if language:
        return language
    return next((name for name, matches, _ in EXTRACTORS if matches(rel_path, content)), None)


def extract(rel_path: str, content: bytes | None) -> Records | None:
    """The records of one file, or None if no extractor takes it; what goes wrong becomes ``error``."""
    content = content or b""
    name = format_of(rel_path, content)
    if name is None:
        return None
    try:
        if name == "pdf":
            return documents.pdf(rel_path, content)
        text = content.decode("utf-8", errors="replace")
        if name in languages.LANGUAGES or name in ("python", "css"):
            return languages.source(rel_path, text, name)
        return next(f for n, _, f in EXTRACTORS if n == name)(rel_path, text)
    except Exception as e:  # one bad file must not end the job: the row says so
        out = Records(rel_path)
        out.error = f"{type(e).__name__}: {e}"
        return out


def _arrow_type():
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(EXTRACTED)


@F.arrow_udf(EXTRACTED)
def _extracted(paths: pa.Array, contents: pa.Array) -> pa.Array:
    rows = []
    for p, c in zip(paths, contents):
        r = extract(p.as_py() or "", c.as_py())
        rows.append(r.row() if r else None)
    return pa.array(rows, _arrow_type())


#: A function that Spark takes for deterministic is called again below each filter and generator that reads its result.
_extracted = _extracted.asNondeterministic()


def extracted(rel_path: Column, content: Column) -> Column:
    """One call per file; null for files that no extractor takes."""
    return _extracted(rel_path, content)
