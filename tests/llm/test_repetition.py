import collections
import random
import re

import pyarrow as pa

from spindle.llm import repetition as rep

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def longest_at(w):
    out = [0] * len(w)
    for i in range(len(w)):
        for j in range(len(w)):
            k = 0
            while i != j and max(i, j) + k < len(w) and w[i + k] == w[j + k]:
                k += 1
            out[i] = max(out[i], k)
    return out


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    lo = longest_at(w)
    inside = {p for i, k in enumerate(lo) if k >= rep.MIN_REPEAT for p in range(i, i + k)}
    c = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    again = {p for i in range(len(w) - 4) if c[tuple(w[i : i + 5])] > 1 for p in range(i, i + 5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return [len(w), sum(map(len, w)), sum(text.count(x) for x in "#*$%&|<>"), dup, len(again), len(inside), max([0] + [k for k in lo if k >= 5])]


def texts():
    r = random.Random(3)
    out = [None, "", " \n\t", "a", "x" * 300, "a b c d \x1c e\x85f", "ä#ö *| <b>&", "q\nq\nq \n\n q"]
    for _ in range(60):
        words = [r.choice(["a", "bb", "c", "é", "w" * 70 + "x", "w" * 70 + "y"]) for _ in range(r.randint(0, 60))]
        out.append("".join(x + r.choice([" ", "\n", "  ", "\x0b"]) for x in words) + " u v" * r.choice([0, 0, 30]))
    return out


def test_counts_and_repeats_against_brute_force(monkeypatch):
    for size in (50, 1_000_000):
        monkeypatch.setattr(rep, "GROUP_BYTES", size)
        got = rep.features(pa.array(texts(), pa.string()))
        for i, t in enumerate(texts()):
            assert [int(got[k][i]) for k in rep.FEATURES] == brute(t), t


def test_very_long_repeats_are_quick():
    got = rep.features(pa.array(["a " * 200_000 + "b", "x y z " * 50_000]))
    assert got["longest_repeat"].tolist() == [199_999, 149_997]


def test_query_rows(spark):
    r = random.Random(1)
    clean = " ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(300))
    rows = [(1, clean, 0), (2, None, 0), (3, "short text", 0), (4, "spam again and again it goes " * 30, 0), (4, "spam again and again it goes " * 30, 0), (None, clean, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept int")
    got = collections.Counter((r["doc_id"], r["base_failed"], r["kept"]) for r in rep.digest(df).collect())
    assert got == {(1, False, True): 1, (2, True, False): 1, (3, True, False): 1, (4, True, False): 2, (None, False, True): 1}
    assert rep.digest(df.limit(0)).count() == 0
    assert rep.quality_rules(df, into="kept").columns == ["doc_id", "text", "kept"]


def test_long_repeat_that_covers_little_fails_by_length(spark):
    r = random.Random(2)
    words = ["".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(12_000)]
    text = " ".join(words + words[:500])
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = rep.digest(df).first()
    assert not row["base_failed"] and row["longest_repeat"] == 500 and not row["kept"]


def test_each_limit_rejects_texts_of_ordinary_length_that_pass_the_base_rule(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    once = [word() for _ in range(910)]
    covered = [word() for _ in range(1000)]
    for k in range(4):  # four passages of 16 words, twice each: 128 of about 1,060 words, none long
        covered[200 * k + 100 : 200 * k + 100] = covered[200 * k : 200 * k + 16]
    long = [word() for _ in range(2750)]
    rows = [(1, " ".join(once + once[:90])), (2, " ".join(covered)), (3, " ".join(long + long[:250])), (4, " ".join(long + long[:60])), (5, " ".join(once + once[:12]))]
    got = {r["doc_id"]: r for r in rep.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert not any(r["base_failed"] for r in got.values())
    assert {i: r["kept"] for i, r in got.items()} == {1: False, 2: False, 3: False, 4: False, 5: True}
    assert got[2]["longest_repeat"] <= rep.MAX_LONGEST < got[4]["longest_repeat"]
    assert got[4]["n_covered_words"] <= rep.MAX_COVERED * got[4]["n_words"] and got[2]["n_covered_words"] > rep.MAX_COVERED * got[2]["n_words"]
