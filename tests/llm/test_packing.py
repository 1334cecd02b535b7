import collections
import random
import struct
import zlib

import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from spindle.llm import packing, tokens

LIBRARY = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
TEXTS = [
    None, "", "a", " a", "a ", "a\n", "\n\na", "a\n b", "a  b", "x y", "it's I'll we've 'tis", "<|endoftext|> x", "12 345é ñ", "a\tb\r\nc", "日本語 テスト", "a  b", "😀 😀\n😀", "a\x1cb c", "a\x85b",
    "  \n ", "don't\n'll", "“quoted” — dash", "w " * 3000, "long" * 5000, "　x 　 y",
]


def library_ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def test_ids_equal_the_librarys():
    enc = tokens.encoder(tokens.default_path())
    r = random.Random(0)
    alphabet = ["ab", "the", " ", " ", "\n", "é", "1", "!", "'s", " ", "\t", "ß", "<|", "|>"]
    texts = TEXTS + ["".join(r.choice(alphabet) for _ in range(r.randint(0, 60))) for _ in range(500)]
    for t, ids in zip(texts, enc.encode_all(pa.array(texts, pa.string()))):
        assert ids.tolist() == library_ids(t), t


def test_offsets_cover_the_text():
    enc = tokens.encoder(tokens.default_path())
    for t in filter(None, TEXTS):
        ids, starts, ends = enc.ids_and_offsets(t)
        want = LIBRARY.encode(t, add_special_tokens=False)
        assert ids.tolist() == want.ids
        assert starts[0] == 0 and ends[-1] == len(t) and (starts[1:] <= ends[:-1]).all() and (starts[1:] >= ends[:-1] - 1).all()


def test_cut():
    assert packing.cut(1) == [(0, 1)] and packing.cut(1024) == [(0, 1024)] and packing.cut(1025) == [(0, 1), (1, 1024)]
    assert packing.cut(2048) == [(0, 1024), (1024, 1024)]


def test_plan_uses_every_piece_once_and_wastes_little():
    r = random.Random(5)
    for _ in range(5):
        counts = collections.Counter(min(1024, 1 + int(r.expovariate(1 / 300))) for _ in range(20_000))
        made = packing.plan(dict(counts))
        used = collections.Counter()
        for p, n in made:
            assert sum(p) <= 1024 and n > 0
            for k in p:
                used[k] += n
        assert used == counts
        assert sum(n for _, n in made) <= 1.02 * sum(k * v for k, v in counts.items()) / 1024 + 2
    assert packing.plan({}) == [] and packing.plan({1024: 3}) == [((1024,), 3)]


def check(rows, texts):
    """Pieces restore the documents, and sequences are gapless."""
    sequences = collections.defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    got = collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows)
    want = collections.Counter()
    for i, t in texts:
        ids = [*library_ids(t), 2]
        for k, (s, n) in enumerate(packing.cut(len(ids))):
            want[i, k, s, n, zlib.crc32(struct.pack(f"<{n}I", *ids[s : s + n]))] += 1
    assert got == want
    return len(sequences)


def test_packed_documents_against_the_library(spark):
    texts = [(i, t) for i, t in enumerate(TEXTS)] + [(3, "same"), (3, "same"), (3, "other"), (None, "none")]
    df = spark.createDataFrame([(i, t, 9) for i, t in texts], "doc_id long, text string, offset int")
    check(packing.pack_documents(df).collect(), texts)
    assert packing.pack_documents(df.limit(0)).count() == 0


def test_hot_length_is_ranked_in_buckets(spark, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET_PIECES", 10)
    texts = [(i, "one two" if i % 3 else "x " * (i % 50)) for i in range(300)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    n = check(packing.pack_documents(df).collect(), texts)
    assert n <= 1.1 * sum(len(library_ids(t)) + 1 for _, t in texts) / 1024 + 1
