"""Byte-level BPE ids, as the tokenizer file of the given path would give them, at several times its library's speed.

Byte-level BPE never merges across the start of a run of spaces. So many texts are cut there together, each distinct
segment is encoded once, and the ids are laid out for all its occurrences; texts with rarer kinds of spaces, or with
special tokens, go through the full pattern whole. Segments are told apart by 64-bit hashes.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken

from .common import groups, segment_hashes, utf8

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes of texts whose distinct words are encoded together.
GROUP_BYTES = 1_000_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of_char() -> dict[str, int]:
    """How byte-level vocabularies spell bytes: printable ones as themselves, the others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@lru_cache(4)
def _ranks(path: str) -> tuple[dict[bytes, int], dict[str, int]]:
    """The vocabulary of a tokenizer file as bytes to id, and its special tokens."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    spelled = _byte_of_char()
    return {bytes(spelled[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}, special


class Encoder:
    def __init__(self, path: str, extra: tuple[str, ...] = ()) -> None:
        ranks, special = _ranks(path)
        top = max([*ranks.values(), *special.values()]) + 1
        self.special = special | {t: top + i for i, t in enumerate(extra)}
        self.full = tiktoken.Encoding("full", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=self.special)
        self.lengths = np.zeros(top + len(extra), np.int64)  # bytes of each token
        for t, i in ranks.items():
            self.lengths[i] = len(t)
        for t, i in self.special.items():
            self.lengths[i] = len(t.encode())
        self._control = re.compile("|".join(map(re.escape, self.special)).encode()) if self.special else None

    def ids(self, text: str | None) -> np.ndarray:
        """Ids of a whole text; strings of special tokens count as those tokens, as in the library."""
        return np.array(self.full.encode(text or "", allowed_special="all"), "<u4")

    def encode_all(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The same for each of many texts (null: empty), in order."""
        data, offsets = utf8(texts)
        for i, j in groups(offsets, GROUP_BYTES):
            yield from self._encode_group(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])

    def _encode_group(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
        k = len(offsets) - 1
        if not len(data):
            yield from (np.zeros(0, "<u4") for _ in range(k))
            return
        raw = data.tobytes()
        odd = np.zeros(k, bool)  # other spaces than U+0020 and U+000A may be there, or special tokens: the full pattern
        after = np.append(data[1:], 0)
        strange = ((data >= 9) & (data <= 13) & (data != 10)) | ((data == 0xC2) & ((after == 0x85) | (after == 0xA0)))
        strange |= ((data == 0xE1) & (after == 0x9A)) | ((data == 0xE2) & ((after == 0x80) | (after == 0x81))) | ((data == 0xE3) & (after == 0x80))
        at = np.flatnonzero(strange).tolist() + [m.start() for m in self._control.finditer(raw)] if self._control else np.flatnonzero(strange).tolist()
        if at:
            odd[np.searchsorted(offsets, at, side="right") - 1] = True
        space = (data == 32) | (data == 10)
        inner = np.zeros(len(data) + 1, bool)
        inner[offsets] = True
        first = inner[:-1].copy()  # a segment is a run of spaces and the run of others after it, and starts with its text
        first[1:] |= space[1:] & ~space[:-1]
        starts = np.flatnonzero(first)
        hashes = segment_hashes(data, starts)
        by = np.argsort(hashes)
        new = np.append(True, hashes[by[1:]] != hashes[by[:-1]])
        kind = np.empty(len(starts), np.int64)
        kind[by] = np.cumsum(new) - 1
        where = by[new]  # a segment of each kind
        begin = starts[where]
        end = np.append(starts, len(data))[where + 1]
        # kinds that start with a space and end without stay themselves when laid end to end; the few others are alone
        regular = space[begin] & ~space[end - 1]
        alone = np.flatnonzero(~regular)
        together = np.flatnonzero(regular)
        text = b"".join([raw[a:b] for a, b in zip(begin[together].tolist(), end[together].tolist())])
        ids = np.array(self.full.encode_ordinary(text.decode()), "<u4")
        token_ends = np.append(0, np.cumsum(self.lengths[ids]))
        cuts = np.searchsorted(token_ends, np.append(0, np.cumsum(end[together] - begin[together])))
        low, count = np.zeros(len(where), np.int64), np.zeros(len(where), np.int64)
        low[together], count[together] = cuts[:-1], np.diff(cuts)
        parts, size = [ids], len(ids)
        for u in alone.tolist():
            own = np.array(self.full.encode_ordinary(raw[begin[u] : end[u]].decode()), "<u4")
            low[u], count[u] = size, len(own)
            parts.append(own)
            size += len(own)
        pool = np.concatenate(parts)
        each = count[kind]
        ends = np.cumsum(each)
        stream = pool[np.repeat(low[kind] - (ends - each), each) + np.arange(int(ends[-1]))]
        edges = np.append(0, ends)[np.searchsorted(starts, offsets)]
        for d in range(k):
            if odd[d]:
                yield self.ids(raw[offsets[d] : offsets[d + 1]].decode())
            else:
                yield stream[edges[d] : edges[d + 1]]

    def ids_and_offsets(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of a whole text, and the code points at which each token starts and ends; a token of a part of a code point has that code point."""
        ids = np.array(self.full.encode(text, allowed_special="all"), "<u4")
        ends = np.cumsum(self.lengths[ids])
        data = np.frombuffer(text.encode(), np.uint8)
        point = np.cumsum((data & 0xC0) != 0x80) - 1  # the code point of each byte
        starts = ends - self.lengths[ids]
        return ids, point[starts], point[ends - 1] + 1


@lru_cache(4)
def encoder(path: str, extra: tuple[str, ...] = ()) -> Encoder:
    """One encoder a worker process, made from the path."""
    return Encoder(path, extra)
