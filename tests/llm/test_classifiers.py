import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from spindle.llm import quality, toxicity


def words(r, n):
    return " ".join("".join(r.choice("aeioulnrst") for _ in range(r.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def toxic_corpus():
    r = random.Random(1)
    rows, labels = [], []
    for i in range(900):
        text, toxic = words(r, 60), int(i % 6 == 0)
        if toxic:
            bad = r.choice(["idiot", "Moron!", "grubz" + r.choice(["an", "el", "ix", "or", "ut"]) + r.choice("abc"), "scum,"])
            text = f"{text} {bad} {words(r, 20)}"
        rows.append((i, text, "en", "s", 0.5))
        if i % 10 != 9:
            labels.append((i, 1, toxic))
    return rows, labels


SCHEMA = "doc_id long, text string, lang string, source string, score double"


def test_toxicity_on_the_held_out_fold(spark, toxic_corpus):
    rows, labels = toxic_corpus
    df = spark.createDataFrame([*rows, (None, None, None, None, None), (5000, "", None, None, None), (5000, "", None, None, None), (5001, "idiot " * 40_000, "x", "y", 0.1)], SCHEMA)
    lab = spark.createDataFrame([*labels, (None, 1, 1), (1, None, None)], "doc_id long, quality int, toxic int")
    out = toxicity.digest(df, lab).collect()
    assert len(out) == len(rows) + 4
    truth = {i: int(i % 6 == 0) for i in range(900)}
    for r in out:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
    held = [r for r in out if r["held_out"] and r["doc_id"] < 900]
    assert len(held) > 100 and sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.97 * len(held)
    assert [r["predicted"] for r in out if r["doc_id"] == 5001] == [1] and [r["predicted"] for r in out if r["doc_id"] == 5000] == [0, 0]


def made_votes(seed=3, n=4000):
    """Votes of voters of known accuracy, three of which repeat one another, and the truth."""
    r = np.random.default_rng(seed)
    y = (r.random(n) < 0.2).astype(float)
    cols = []
    for accuracy, heard in ((0.95, 0.3), (0.8, 0.3), (0.9, 0.2)):
        says = r.random(n) < np.where(y == 1, heard, heard * 0.25 * (1 - accuracy) / accuracy)
        cols.append(says)
    noisy = cols[1]
    cols += [noisy & (r.random(n) < 0.95), noisy & (r.random(n) < 0.95)]
    clean = r.random(n) < np.where(y == 0, 0.4, 0.02)
    return np.stack([*cols, clean], axis=1).astype(float), y


def test_label_model_learns_accuracies_without_the_labels_of_documents():
    votes, y = made_votes()
    r = np.random.default_rng(8)
    wrong = np.where(r.random(len(y)) < 0.1, 1 - y, y)  # a tenth of the labels is wrong
    m = toxicity.LabelModel(votes, wrong)
    assert m.toxic_voter.tolist() == [True] * 5 + [False]
    truly = np.where(m.toxic_voter, y @ votes, (1 - y) @ votes) / votes.sum(axis=0)
    assert np.abs(m.accuracy - truly).max() < 0.16
    assert m.correlation[1, 3] > 0.5 > m.correlation[0, 2]
    p = m.posterior(votes)
    heard = votes.sum(axis=1) > 0
    assert ((p >= 0.5) == y)[heard].mean() > ((wrong == y)[heard]).mean() + 0.02  # better than the labels that oriented it
    silent = p[~heard]
    assert np.ptp(silent) < 1e-12 and abs(silent[0] - 1 / (1 + np.exp(-m.prior))) < 1e-9


def test_posteriors_against_the_plain_formula():
    votes, y = made_votes(5, 300)
    m = toxicity.LabelModel(votes, y)
    for row, p in zip(votes, m.posterior(votes)):
        z = m.prior
        for j in np.flatnonzero(row):
            repeated = sum(m.correlation[i, j] for i in np.flatnonzero(row) if m.correlation[i, j] > 0.1)
            z += m.evidence[j] / max(1, repeated)
        assert abs(p - 1 / (1 + np.exp(-z))) < 1e-9


def test_scores_against_the_plain_sum(spark, toxic_corpus):
    rows, labels = toxic_corpus
    df, lab = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.fit(df, lab)
    got = {r["doc_id"]: r["score"] for r in toxicity.digest(df, lab).collect()}
    for i, text, *_ in rows:
        z = model.intercept + sum(w for t, w in model.weights.items() if t in toxicity.terms(text))
        assert abs(got[i] - 1 / (1 + np.exp(-z))) < 1e-9


def test_repeated_ids_teach_once(spark, toxic_corpus):
    rows, labels = toxic_corpus
    df = spark.createDataFrame([*rows[:200], *[(1, f"other {k}", None, None, None) for k in range(50)]], SCHEMA)
    lab = spark.createDataFrame([*labels[:100], (1, 1, 0), (2, 1, 1)], "doc_id long, quality int, toxic int")
    found = toxicity.gathered(df, lab, most=60).collect()
    ids = [r["row"] for r in found]
    assert len(ids) == len(set(ids)) <= 60 and 2 not in {r["row"] for r in toxicity.gathered(df, lab).collect()}


def test_terms():
    got = toxicity.terms("Abcde abcdx ABCDE! £x | a |")
    assert {b"abcde", b"abcdx", b"abcd*", b"abcd**", "£x".encode(), b"@table"} <= got and b"abcde*" not in got
    assert toxicity.terms(None) == toxicity.terms("") == set()


def test_held_out_labels_teach_nothing(spark, toxic_corpus):
    rows, labels = toxic_corpus
    df = spark.createDataFrame(rows, SCHEMA)
    turned = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in labels]
    score = lambda ls: sorted((r["doc_id"], r["score"]) for r in toxicity.digest(df, spark.createDataFrame(ls, "doc_id long, quality int, toxic int")).collect())
    assert score(labels) == score(turned)


def test_toxicity_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    df = spark.createDataFrame([(1, "x", None, None, None)], SCHEMA)
    assert [r["predicted"] for r in toxicity.digest(df, none).collect()] == [0]
    assert toxicity.digest(df.limit(0), none).count() == 0
    assert toxicity.digest(df, spark.createDataFrame([(1, 1, 0), (2, 1, 0)], "doc_id long, quality int, toxic int")).first()["score"] < 0.5


@pytest.fixture(scope="module")
def quality_corpus():
    r = random.Random(2)
    rows, labels = [], []
    for i in range(500):
        good = i % 4 != 0
        text = ". ".join(words(r, 12).capitalize() for _ in range(8)) + "."
        if not good:
            text = r.choice([text.upper().replace(" ", "!! "), " ".join(w + "%%%" for w in text.split()), " ".join(w for w in text.split()[:8] for _ in range(20)), " | ".join(text.split())])
        rows.append((i, text, r.choice(["en", "de", None]), f"s{i % 7}", len(text)))
        if i % 2:
            labels.append((i, int(good), 0)) if i % 4 != 0 else None
        elif i < 300:
            labels.append((i, int(good), 0))
    return rows, labels


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_quality_on_unlabelled_documents(spark, quality_corpus):
    rows, labels = quality_corpus
    df = spark.createDataFrame([*rows, (None, None, None, None, None), (900, "", "en", "s1", 0), (901, "word " * 40_000, None, None, None)], DOCS)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = {r["doc_id"]: r for r in quality.digest(df, lab).collect()}
    assert len(out) == len(rows) + 3 and all(0 <= r["score"] <= 1 for r in out.values())
    known = {i for i, *_ in labels}
    right = [out[i]["kept"] == (i % 4 != 0) for i, *_ in rows if i not in known]
    assert len(right) > 20 and sum(right) >= 0.95 * len(right)
    good = quality.good_documents(df, lab)
    assert good.columns == df.columns and good.count() == sum(r["kept"] for r in out.values())


def test_quality_without_labels_or_rows(spark, quality_corpus):
    df = spark.createDataFrame(quality_corpus[0][:5], DOCS)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert all(r["kept"] for r in quality.digest(df, none).collect())
    assert quality.digest(df.limit(0), none).count() == 0
    bare = df.select("doc_id", "text")
    assert quality.digest(bare, none).count() == 5


def test_scores_against_the_plain_formula(spark, quality_corpus):
    rows, labels = quality_corpus
    df, lab = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = quality.fit(df, lab)
    got = {r["doc_id"]: r["score"] for r in quality.digest(df, lab).collect()}
    sig = lambda z: 1 / (1 + np.exp(-z))
    for i, text, lang, source, n in rows[:60]:
        xs = [quality.content_features(pa.array([text]))[0], model.metadata.features([lang], [source], [n])[0]]
        total = model.mix[-1]
        for view, x, (slope, offset), weight in zip(model.views, xs, model.calibration, model.mix):
            z = [min(6.0, max(-6.0, (v - m) / s)) for v, m, s in zip(x, view.middle, view.scale)]
            z = [*z, *(min(v * v, 20.0) for v in z)]
            logit = sum(a * b for a, b in zip(z, view.w)) + view.w[-1]
            total += weight * (slope * min(20.0, max(-20.0, logit)) + offset)
        assert abs(got[i] - sig(total)) < 1e-9


def test_views_help_each_other_and_each_is_calibrated():
    """Two noisy views of one truth, few labels: co-training beats the content view alone, and shares come out as scored."""
    r = np.random.default_rng(4)
    make = lambda n: (lambda y: (y, [np.stack([y + r.normal(0, 0.55, n), r.normal(0, 1, n)], 1), np.stack([y + r.normal(0, 0.45, n), r.normal(0, 1, n)], 1)]))((r.random(n) < 0.5).astype(float))
    (y, few), (_, pool), (truth, test) = make(120), make(3000), make(4000)
    both, none = quality.co_train(few, y, pool), quality.co_train(few, y, [x[:0] for x in pool])
    right = lambda m: ((m.score(test) >= 0.5) == truth).mean()
    alone = [((both.calibrated(test)[:, v] >= 0) == truth).mean() for v in (0, 1)]
    assert right(both) >= max(alone) + 0.02 and right(both) >= right(none) - 0.01
    for v in (0, 1):
        p = 1 / (1 + np.exp(-both.calibrated(test)[:, v]))
        for lo in (0.0, 0.5):
            some = (p >= lo) & (p < lo + 0.5)
            assert abs(p[some].mean() - truth[some].mean()) < 0.15


def test_pool_has_no_labelled_document_and_rows_may_repeat(spark, quality_corpus, monkeypatch):
    rows, labels = quality_corpus
    seen = []
    real = quality.co_train
    monkeypatch.setattr(quality, "co_train", lambda known, y, pool, *a: seen.append((len(y), len(pool[0]))) or real(known, y, pool, *a))
    df = spark.createDataFrame([(*r, 1.0, "x") for r in [*rows, rows[3], rows[3]]], DOCS + ", score double, row string").withColumnRenamed("row", "_row")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = quality.digest(df, lab)
    assert out.count() == len(rows) + 2 and out.columns == ["doc_id", "score", "kept"]
    assert len({r["score"] for r in out.where("doc_id = 3").collect()}) == 1
    known = {i for i, *_ in labels}
    assert seen[0][1] == sum(i not in known for i, *_ in rows) + 2 * (3 not in known)
    good = quality.good_documents(df, lab)
    assert good.columns == df.columns


def test_metadata_is_of_columns_only():
    m = quality.Metadata(["en"] * 30 + [None] * 25 + ["xx"], ["a"] * 56)
    x = m.features(["en", None, "xx", "new"], ["a", "a", None, "b"], [10, None, 0, -3])
    assert m.lang == {"en": 0, None: 1} and x.shape == (4, 3 + 3 + 2)
    assert x[:, 3:6].argmax(axis=1).tolist() == [0, 1, 2, 2] and x[:, 6:].argmax(axis=1).tolist() == [0, 0, 1, 1]
    assert x[:, 1].tolist() == [0, 1, 0, 0] and x[:, 2].tolist() == [0, 0, 1, 0]


def test_content_features_by_hand():
    x = quality.content_features(pa.array(["AB ab 12\nab ab!", None, "  "]))
    at = {n: i for i, n in enumerate(quality.CONTENT)}
    assert abs(x[0, at["upper"]] - 2 / 11) < 1e-9 and abs(x[0, at["digit"]] - 2 / 11) < 1e-9
    assert x[0, at["same_as_last"]] == 0 and x[0, at["distinct"]] == 4 / 5 and x[1, at["few_words"]] == 1
