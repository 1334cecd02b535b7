import collections
import random
import re

import numpy as np

from spindle.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_targets():
    assert mixing.targets([100, 100, 100], [5, 2, 1]) == [187.5, 75.0, 37.5]
    # the first stops at 3 times its size, the rest is shared 2 to 1
    assert mixing.targets([10, 300, 290], [5, 2, 1]) == [30.0, 380.0, 190.0]
    assert mixing.targets([0, 5], [5, 2]) == [0.0, 5.0] and mixing.targets([], []) == [] and mixing.targets([0], [5]) == [0.0]


def test_pivotal_keeps_the_sum_and_the_expectation():
    rng = np.random.default_rng(0)
    size = rng.integers(1, 50, 40)
    total = np.zeros(40)
    for _ in range(3000):
        done, held, p = mixing.pivotal(np.full(40, 0.3), size, rng.random(40))
        assert set(done.tolist()) <= {0, 1}
        left = p * size[held] if held >= 0 else 0
        assert abs((done * size).sum() + left - 0.3 * size.sum()) < 1e-6
        total += done
        if held >= 0:
            total[held] += p
    assert np.abs(total / 3000 - 0.3).max() < 0.05


def rows(n=600):
    r = random.Random(2)
    out = [(i, " ".join("w" for _ in range(r.choice([0, 1, 5, 40, 300]))), r.choice(["a", "a", "a", "b", "c", None, "é", "Z"])) for i in range(n)]
    return out + [(None, None, "a"), (7, "same same", "b"), (7, "same same", "b"), (8, "\x0b x y ", None)]


def collect(spark, data, **kw):
    df = spark.createDataFrame([(*r, 1) for r in data], "doc_id long, text string, source string, copies int")
    return [r.asDict() for r in mixing.digest(df).collect()]


def test_query_against_the_contract(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 20)
    monkeypatch.setattr(mixing, "FAN_IN", 4)
    data = rows()
    got = collect(spark, data)
    size = lambda t: len(WORD.findall(t or ""))
    assert collections.Counter((r["doc_id"], r["size"], r["source"]) for r in got) == collections.Counter((i, size(t), s) for i, t, s in data)
    sizes = collections.Counter()
    for _, t, s in data:
        sizes[s] += size(t)
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    target = dict(zip(names, mixing.targets([sizes[s] for s in names], [(5, 2, 1)[k % 3] for k in range(len(names))])))
    taken = collections.Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - target[r["source"]]) < 1e-6
        assert 0 <= r["taken"] <= 3 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
        taken[r["source"]] += r["taken"]
    for s in names:
        assert abs(taken[s] - target[s]) <= 150.5  # half of the largest document
    key = lambda rs: sorted((str(r["doc_id"]), r["taken"], r["size"], str(r["source"])) for r in rs)
    random.Random(9).shuffle(data)
    assert key(collect(spark, data)) == key(got)  # another layout of the same rows


def test_repeated_documents(spark):
    df = spark.createDataFrame([(*r, 1) for r in rows(200)], "doc_id long, text string, source string, _copies int")
    out = mixing.repeat_documents(df)
    assert out.columns == df.columns
    made = collections.Counter((r["doc_id"], r["source"], r["text"] or "") for r in out.collect())
    texts = {r["k"]: r["text"] or "" for r in df.select(mixing._row_key("text").alias("k"), "text").collect()}
    want = collections.Counter()
    for r in mixing.mix(df).collect():
        want[r["doc_id"], r["source"], texts[r["row_key"]]] += r["copies"]
    assert made == +want


def test_targets_of_many_sources_equal_those_on_one_machine(spark):
    r = random.Random(5)
    for sizes in ([r.choice([0, 1, 3, 10, 400, 100_000]) for _ in range(300)], [7] * 10, [0, 0, 3]):
        names = [f"s{i:03d}" for i in range(len(sizes) - 1)] + [None]
        df = spark.createDataFrame(list(zip(names, sizes)), "source string, size long").repartition(7)
        got = {x["source"]: (x["source_size"], x["target"]) for x in mixing.source_targets(df).collect()}
        want = mixing.targets(sizes, [(5, 2, 1)[i % 3] for i in range(len(sizes))])
        assert {n: s for n, (s, _) in got.items()} == dict(zip(names, sizes))
        assert all(abs(got[n][1] - t) < 1e-6 * max(1, t) for n, t in zip(names, want))


def test_rows_alike_keep_their_other_columns(spark):
    data = [(7, "one two three", "b", k) for k in range(40)] + [(100 + i, "w " * 30, "a", i) for i in range(20)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string, doc_id_2 int")
    times = collections.Counter(r["doc_id_2"] for r in mixing.repeat_documents(df).where("doc_id = 7").collect())
    total = sum(r["copies"] for r in mixing.mix(df).where("doc_id = 7").collect())
    assert sum(times.values()) == total and total % 40 and max(times.values()) - min(times[k] for k in range(40)) <= 1
    long = spark.createDataFrame([(1, "long " * 60_000, "c", 1), (2, "x y", "c", 1), (3, "x " * 40_000, "d", 1)], "doc_id long, text string, source string, doc_id_2 int")
    assert sum(r["copies"] * r["size"] for r in mixing.mix(long).collect()) > 0


def test_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.digest(df).count() == 0 and mixing.repeat_documents(df).count() == 0
    assert collect(spark, [(1, None, None), (2, "", "a")])[0]["taken"] == 0
