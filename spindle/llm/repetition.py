"""Operator 3: quality rules by suffix-array repetition.

Suffix arrays over the words of whole texts, built for many texts at once by prefix doubling, give the longest common
prefixes of neighbouring suffixes. Their intervals are the maximal repeated substrings; the union of the spans of the
long ones gives the covered fraction of a text, the longest prefix its longest repeat.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, groups, row_type, segment_hashes, utf8

#: Words of the windows that the base rule counts.
WINDOW = 5
#: A repeat counts as covering from so many words on; at most this fraction may be covered, and no repeat may be longer.
#: Both limits lie below what the base rule's 20 % catches; clean texts hardly ever have a repeat of 14 words.
MIN_REPEAT = 10
MAX_COVERED = 0.1
MAX_LONGEST = 50
#: Bytes of the texts that share one suffix array; a single longer text has one of its own.
GROUP_BYTES = 500_000

FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered_words", "longest_repeat")


def suffix_lcp(words: np.ndarray, docs: np.ndarray, least: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of texts laid end to end, and the common prefix length of each suffix with its predecessor.

    ``words`` are numbers of words, ``docs`` the (ascending) number of the text each belongs to. Suffixes end with their
    text, and only those of one text share a prefix. Doubling sorts only the suffixes that are still tied. Prefixes
    shorter than ``least`` (a power of two) words count as 0.
    """
    n = len(words)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ends = np.searchsorted(docs, docs, side="right")  # the end of the text of each position
    base = int(words.max()) + 2
    follow = np.append(words[1:] + 1, 0)
    follow[:-1][ends[:-1] == np.arange(1, n)] = 0
    if float(int(docs[-1]) + 1) * base * base < 2**62:
        key, width = (docs * base + words) * base + follow, 2
    else:
        key, width = docs * base + words, 1
    order = np.argsort(key)
    rank = np.empty(n, np.int64)
    new = np.empty(n, bool)
    new[0] = True
    new[1:] = key[order[1:]] != key[order[:-1]]
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    tied = np.flatnonzero(~(new & np.append(new[1:], True)))
    at_least = None
    while True:
        if width == least or at_least is None and not len(tied):
            at_least = new.copy()
        if not len(tied):
            break
        at = order[tied]
        nxt = at + width
        second = np.where(nxt < ends[at], rank[np.minimum(nxt, n - 1)] + 1, 0)
        both = rank[at] * (n + 1) + second
        sort = np.argsort(both)
        at, both = at[sort], both[sort]
        order[tied] = at
        step = np.empty(len(tied), bool)
        step[0] = True
        step[1:] = both[1:] != both[:-1]
        new[tied] |= step
        rank[at] = np.maximum.accumulate(np.where(step, tied, 0))
        tied = tied[~(step & np.append(step[1:], True))]
        width *= 2
    # Neighbours tied at ``least`` words. Along a run of positions whose predecessors follow one another as well, the
    # prefix shrinks by one a step, so only the first of each run is compared: together word by word, then by slices.
    lcp = np.zeros(n, np.int64)
    live = np.flatnonzero(~at_least)
    if not len(live):
        return order, lcp
    a, b = order[live], order[live - 1]
    by = np.argsort(a)
    live, a, b = live[by], a[by], b[by]
    head = np.append(True, (np.diff(a) != 1) | (np.diff(b) != 1))
    first = np.flatnonzero(head)
    x, y = a[first], b[first]
    most = np.minimum(ends[x] - x, ends[y] - y)
    length = np.minimum(least, most)
    done, go = least, np.flatnonzero(most > least)
    while len(go):
        if done >= 64 and len(go) < done:
            for i in go.tolist():
                k, step, u, v, m = done, 64, int(x[i]), int(y[i]), int(most[i])
                while k < m:
                    to = min(m, k + step)
                    differ = np.flatnonzero(words[u + k : u + to] != words[v + k : v + to])
                    if len(differ):
                        k += int(differ[0])
                        break
                    k, step = to, step * 2
                length[i] = k
            break
        go = go[words[x[go] + done] == words[y[go] + done]]
        done += 1
        length[go] = done
        go = go[most[go] > done]
    run = np.cumsum(head) - 1
    lcp[live] = length[run] - (a - x[run])
    return order, lcp


def _covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Which of n positions lie in a span."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + lengths, -1)
    return np.cumsum(change[:n]) > 0


#: Classes of bytes: a space, a byte that continues a code point, a symbol.
_SPACE, _LATER, _SYMBOL = np.zeros((3, 256), bool)
_SPACE[list(SPACES.encode())] = True
_LATER[0x80:0xC0] = True
_SYMBOL[list(b"#*$%&|<>")] = True


def group_features(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Counts and repeats of some texts, as UTF-8 bytes laid end to end. Repeats below ``WINDOW`` words count as none."""
    k = len(offsets) - 1
    total = lambda flags: np.diff(np.append(0, np.cumsum(flags))[offsets])
    space = _SPACE[data]
    edge = np.ones(len(data) + 1, bool)
    edge[1:-1] = space[:-1]
    edge[offsets] = True
    start = edge[:-1] & ~space
    out = {"n_words": total(start), "word_chars": total(~space & ~_LATER[data]), "n_symbols": total(_SYMBOL[data])}
    starts = np.flatnonzero(start)
    n = len(starts)
    docs = np.repeat(np.arange(k), out["n_words"])
    first = int(starts[0]) if n else 0
    hashes = segment_hashes(data[first:], starts - first, space[first:])
    by = np.argsort(hashes)
    words = np.empty(n, np.int64)
    words[by] = np.cumsum(np.append(False, hashes[by[1:]] != hashes[by[:-1]])) if n else 0
    order, lcp = suffix_lcp(words, docs)
    # the longest repeat that starts at each position: the larger prefix shared with either neighbour
    longest = np.zeros(n, np.int64)
    longest[order] = np.maximum(lcp, np.append(lcp[1:], 0)) if n else 0
    for name, least, whole in (("n_repeat_words", WINDOW, False), ("n_covered_words", MIN_REPEAT, True)):
        at = np.flatnonzero(longest >= least)
        inside = _covered(at, longest[at] if whole else np.full(len(at), least), n)
        out[name] = np.bincount(docs[inside], minlength=k)
    out["longest_repeat"] = np.zeros(k, np.int64)
    at = np.flatnonzero(longest >= WINDOW)
    np.maximum.at(out["longest_repeat"], docs[at], longest[at])
    return out


def _dup_lines(text: str | None) -> int:
    if not text or "\n" not in text:
        return 0
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return len(lines) - len(set(lines))


def features(texts: pa.Array) -> dict[str, np.ndarray]:
    data, offsets = utf8(texts)
    parts = [group_features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in groups(offsets, GROUP_BYTES)]
    rows = {"n_dup_lines": np.array([_dup_lines(x) for x in texts.to_pylist()], np.int64)}
    return {k: rows[k] if k in rows else np.concatenate([p[k] for p in parts] or [np.zeros(0, np.int64)]) for k in FEATURES}


@F.arrow_udf(row_type(", ".join(f"{k} long" for k in FEATURES)))
def features_of(texts: pa.Array) -> pa.Array:
    rows = features(texts)
    return pa.StructArray.from_arrays([pa.array(v, pa.int64()) for v in rows.values()], list(rows))


def quality_rules(docs: DataFrame, text: str = "text", into: str = "rules", max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST) -> DataFrame:
    """``docs`` with a struct column ``into``: counts of each whole text, ``base_failed`` and ``kept``.

    ``base_failed``: fewer than 10 words, or over 20% of the words in 5-word windows that the text has twice or more.
    ``kept``: not so, and repeats of at least ``MIN_REPEAT`` words cover at most ``max_covered`` of the words, and none
    is longer than ``max_longest``. Null counts as an empty text, which fails; repeated rows each get their verdict; an
    empty table gives an empty table; a column named as ``into`` is replaced, all others stay. No shuffle.
    """
    raw = docs.withColumn(into, features_of(F.col(text)))
    f = lambda name: F.col(f"{into}.{name}")
    failed = (f("n_words") < 10) | (100 * f("n_repeat_words") > 20 * f("n_words"))
    good = (f("n_covered_words") <= max_covered * f("n_words")) & (f("longest_repeat") <= max_longest)
    return raw.withColumn(into, F.col(into).withField("base_failed", failed).withField("kept", ~failed & good))


def digest(docs: DataFrame) -> DataFrame:
    """The columns that query op3 returns."""
    return quality_rules(docs.select("doc_id", "text")).select(
        "doc_id",
        *(F.col(f"rules.{x}") for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_covered_words", "longest_repeat")),
    )
