"""Operator 1: secret scans by dictionary-primed zstandard novelty.

Three base patterns are reported wherever they match. The method adds strings in a sensitive context (a word such as
``secret`` or ``bearer`` shortly before them) whose marginal compressed size, against the surrounding text and a
dictionary of common identifiers, shows that they can't be predicted: they cost about as many bytes as random strings
of their own alphabet and shape do in the same place, names made of known parts far less.
"""

from __future__ import annotations

import random
import re
import string
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from .common import row_type

KINDS = ("assign", "access", "hex", "novel")
#: Least marginal size of a candidate, as a share of that of random strings of its alphabet and shape; and of one that
#: consists of words, whose letters may come from any language.
MIN_NOVELTY = 0.82
MIN_NOVELTY_OF_WORDS = 1.0
#: So many random strings are measured.
STRANGERS = 6
MIN_LENGTH = 16
#: Characters before a candidate in which a sensitive word must stand, and on either side of it that prime the compressor.
CONTEXT = 48
AROUND = 256

_ASSIGN = re.compile(
    r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
    r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_SENSITIVE = re.compile(
    r"password|passwd|passphrase|secret|token|api[\x20_-]?key|access[\x20_-]?key|private[\x20_-]?key|client[\x20_-]?key|bearer|credential|authorization|signature|pwd",
    re.IGNORECASE | re.ASCII,
)
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=.-]{%d,}" % MIN_LENGTH)
#: Letters in words of one case or capitalised, with numbers between; and dates, times, versions and other grouped numbers.
_WORDS = re.compile(r"(?:(?:[A-Z]?[a-z]{3,}|[A-Z]{3,}|[a-z]{1,2}|[0-9]{1,4})(?:[_=./+-]+|(?=[A-Z])|\Z))+")
_NUMBERS = re.compile(r"[vV]?[0-9]{1,4}(?:[-_./][0-9]{1,4}){2,}(?:[T_.-][0-9._-]*)?Z?|[0-9]{8}[T_.-]?[0-9]{4,9}Z?|[0-9]+(?:\.[0-9]+)?")
#: What stands between two lines of one block, and what a last line shorter than a candidate must stand before.
_FOLD = re.compile(r"[\x20\t]*\r?\n[\x20\t]*")
_TAIL = re.compile(r"[\x20\t]*\r?\n[\x20\t]*([A-Za-z0-9+/=]{1,%d})(?=[\x20\t]*\r?\n[\x20\t]*-----END)" % (MIN_LENGTH - 1))
#: Every text with a match of any kind matches this in the vectorised engine; the exact patterns then run on those only.
_ANY = (
    r"(?i:password|passwd|passphrase|secret|token|api[\x20_-]?key|access[\x20_-]?key|private[\x20_-]?key|client[\x20_-]?key|bearer|credential|authorization|signature|pwd)"
    r"|AKIA[A-Z0-9]{16}|[0-9a-f]{24}"
)
_IDENTIFIERS = """
access account action address admin algorithm amount api application argument array async attribute auth authorization
backend base64 batch bearer boolean bucket buffer build byte cache callback certificate channel char class client cloud
cluster code column command commit common config configuration connection constant container content context cookie
count create credential current custom data database date debug default delete deploy description development device
digest directory document domain double download email enable encoding encrypt endpoint engine entity environment error
event example exception execute export expression external factory false field file filter final float folder format
function gateway generate getter github global google group handler hash header host http https identifier image import
index info input instance integer interface internal internet item iterator json kernel keyboard keystore label lambda
language length level library limit list local localhost location lock logger login logout long main manager manifest
memory message metadata method migration mobile model module monitor name namespace network node none null number
object offset operation option order origin output package page parameter parent parse partition password path pattern
payload permission phone placeholder plugin policy pool port position prefix private process production profile project
property protocol provider proxy public publish query queue random range read record redirect reference region register
registry release remote repository request require reset resource response rest result retry return role root route
runtime sample schema scope script search secret security select sequence server service session setting shell signature
simple size socket source stack staging standard start state static status storage stream string struct style subject
submit success suffix system table target task template tenant test text thread timeout timestamp title token tool topic
trace transaction transport true type uniform unique unknown update upload upper user username util utility uuid valid
validate value variable vector version view virtual volume warning webhook widget window worker workspace write xml yaml
changeme dummy example insert-your-key-here your_api_key your_secret_token xxxxxxxxxxxxxxxx 0123456789abcdef
abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ com.example.application.service www.example.com/index.html
""".split()


@lru_cache(1)
def _compressor() -> zstandard.ZstdCompressor:
    """Primed with identifiers as written in snake, camel, constant and kebab case."""
    words = [form for w in _IDENTIFIERS for form in (f"_{w}", w.capitalize(), w.upper(), f"-{w}")]
    primer = zstandard.ZstdCompressionDict(" ".join(words).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(level=9, dict_data=primer, write_content_size=False, write_checksum=False, write_dict_id=False)


@lru_cache(4096)
def _strangers(shape: str) -> list[bytes]:
    """Random strings of a shape: ``d`` digits, ``h`` and ``H`` hexadecimal ones, ``l`` and ``u`` letters, ``m`` and ``n`` any of them; the rest stays."""
    sets = {"d": "0123456789", "h": "0123456789abcdef", "H": "0123456789ABCDEF", "l": string.ascii_lowercase, "u": string.ascii_uppercase}
    sets |= {"L": sets["l"] + sets["d"], "U": sets["u"] + sets["d"], "m": sets["l"] + sets["u"], "n": sets["l"] + sets["u"] + sets["d"]}
    r = random.Random(shape)
    return ["".join(r.choice(sets[c]) if c in sets else c for c in shape).encode() for _ in range(STRANGERS)]


def _shape(candidate: str) -> str:
    """A candidate with each letter and digit replaced by the name of the alphabet that they are all from."""
    seen = set(candidate)
    digit, lower, upper = (bool(seen & set(x)) for x in (string.digits, string.ascii_lowercase, string.ascii_uppercase))
    if lower and upper:
        name = "n" if digit else "m"
    elif lower or upper:
        hexadecimal = digit and not {c for c in seen if c.isalpha()} - set("abcdefABCDEF")
        name = ("h" if lower else "H") if hexadecimal else ("L" if lower else "U") if digit else ("l" if lower else "u")
    else:
        name = "d"
    return "".join(name if c.isalnum() else c for c in candidate)


def novelty(candidate: str, before: str = "", after: str = "") -> float:
    """Marginal compressed bytes of ``candidate``, against its surroundings and the dictionary, over those of random strings of its shape."""
    around = (before + "\n" + after + "\n").encode()
    size = lambda own: len(_compressor().compress(around + own))
    alone = size(b"")
    usual = sum(map(size, _strangers(_shape(candidate)))) / STRANGERS - alone
    return (size(candidate.encode()) - alone) / max(1.0, usual)


def is_novel(candidates: list[str], gains: list[float]) -> bool:
    """Whether a block of candidates can't be predicted, by the mean over its characters; grouped numbers never are."""
    total = sum(map(len, candidates))
    whole = "".join(candidates)
    least = MIN_NOVELTY_OF_WORDS if _WORDS.fullmatch(whole) else MIN_NOVELTY
    return not _NUMBERS.fullmatch(whole) and sum(g * len(c) for g, c in zip(gains, candidates)) >= least * total


def _blocks(text: str, sensitive: list[tuple[int, int]]) -> list[list[tuple[int, int]]]:
    """Candidates, those on adjoining lines together. After a sensitive name and ``=``, only the value is the candidate."""
    out: list = []
    k = 0
    for m in _CANDIDATE.finditer(text):
        start, end = m.span()
        end -= len(m[0]) - len(m[0].rstrip("."))
        if end - start < MIN_LENGTH:
            continue
        while k < len(sensitive) and sensitive[k][1] <= start:
            k += 1
        if k < len(sensitive) and sensitive[k][1] < end:
            at = text.find("=", sensitive[k][1], end)
            while 0 <= at + 1 < end and at >= 0 and text[at] == "=":
                at += 1
            if at >= 0:
                start = at
            if end - start < MIN_LENGTH:
                continue
        if out and start == m.start() and _FOLD.fullmatch(text, out[-1][-1][1], start):
            out[-1].append((start, end))
        else:
            out.append([(start, end)])
    return out


def find_spans(text: str | None) -> list[tuple[str, int, int, float | None]]:
    """All spans of a text as (kind, start, end, novelty), by start and then kind in the order of ``KINDS``; null has none.

    A block of candidates on adjoining lines is in context if its first line in context is, from there on; its lines are
    measured against what surrounds the block, and the mean over them decides.
    """
    if not text:
        return []
    spans: list = [("assign", m.start(), m.end(), None) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    spans += [("access", m.start(), m.end(), None) for m in _ACCESS.finditer(text)]
    spans += [("hex", m.start(), m.end(), None) for m in _HEX.finditer(text)]
    taken = sorted((s[1], s[2]) for s in spans)
    sensitive = [m.span() for m in _SENSITIVE.finditer(text)]
    if sensitive:
        ends = [e for _, e in sensitive]
        k = at = 0
        for block in _blocks(text, sensitive):
            free, context = [], False
            for start, end in block:
                while k < len(ends) and ends[k] < start - CONTEXT:
                    k += 1
                context = context or k < len(ends) and ends[k] <= start
                while at < len(taken) and taken[at][1] <= start:
                    at += 1
                if context and not any(s < end and e > start for s, e in taken[max(0, at - 2) : at + 3]):
                    free.append((start, end))
            if not free:
                continue
            first, last = block[0][0], block[-1][1]
            before, after = text[max(0, first - AROUND) : first], text[last : last + AROUND]
            gains = [novelty(text[s:e], before, after) for s, e in free]
            if is_novel([text[s:e] for s, e in free], gains):
                spans += [("novel", s, e, g) for g, (s, e) in zip(gains, free)]
                if free[-1][1] == last and (tail := _TAIL.match(text, last)):
                    spans.append(("novel", *tail.span(1), novelty(tail[1], before, after)))
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("novelty", pa.float64())]))


def _suspects(texts: pa.Array) -> list[int]:
    return pc.indices_nonzero(pc.fill_null(pc.match_substring_regex(texts, _ANY), False)).to_pylist()


@F.arrow_udf(ArrayType(row_type("kind string, start int, end int, novelty double")))
def spans_of(texts: pa.Array) -> pa.Array:
    """Spans of each text. A vectorised pass finds the few texts that can have any."""
    out: list = [[]] * len(texts)
    for i in _suspects(texts):
        out[i] = [{"kind": k, "start": s, "end": e, "novelty": n} for k, s, e, n in find_spans(texts[i].as_py())]
    return pa.array(out, _TYPE)


@F.arrow_udf(StringType())
def redacted(texts: pa.Array) -> pa.Array:
    """Each text with its spans (overlapping ones merged) replaced by ``<secret>``; null stays null."""
    suspects = _suspects(texts)
    if not suspects:
        return texts
    out = texts.to_pylist()
    for i in suspects:
        text, parts, last = out[i], [], 0
        for _, start, end, _ in find_spans(text):
            if start >= last:
                parts += [text[last:start], "<secret>"]
            last = max(last, end)
        out[i] = "".join([*parts, text[last:]])
    return pa.array(out, pa.string())


def scan_secrets(docs: DataFrame, text: str = "text", into: str = "spans") -> DataFrame:
    """``docs`` with the spans of each whole text in column ``into``, an array of (kind, start, end, novelty).

    Positions are code points, ends exclusive. Null and empty texts give an empty array, an empty table an empty table;
    repeated rows each get their spans; a column named as ``into`` is replaced, every other column is kept. One pass,
    no shuffle, and no row is dropped.
    """
    return docs.withColumn(into, spans_of(F.col(text)))


def redact(docs: DataFrame, text: str = "text", length: str = "n_chars") -> DataFrame:
    """``docs`` with secrets cut out of the texts; ``length``, if there is such a column, follows the text.

    Null texts stay null (and keep their length value); no row is dropped.
    """
    fields = {f.name: f.dataType for f in docs.schema.fields}
    out = docs.withColumn(text, redacted(F.col(text)))
    if length in fields:
        out = out.withColumn(length, F.coalesce(F.length(text).cast(fields[length]), F.col(length)))
    return out


def digest(docs: DataFrame) -> DataFrame:
    """The columns that query op1 returns, derived from the spans."""
    spelled = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != "novel")
    return scan_secrets(docs.select("doc_id", "text")).select(
        "doc_id",
        *(count(k) for k in KINDS[:3]),
        F.sha2(F.array_join(F.transform(base, spelled), ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", spelled), ",").alias("spans"),
        count("novel"),
    )
