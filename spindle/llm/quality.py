"""Operator 5: a quality classifier by co-training.

Two classifiers see each document by different views: one the content of its text, one its page metadata (the columns
source, language and n_chars; nothing read from the text). Over some rounds each labels the unlabelled documents that it
is most sure of for the other. Each is then calibrated by itself on labelled documents held back, and the calibrated
views are combined and score every document.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import groups, packed, segment_hashes, utf8
from .learn import logistic, sample, sigmoid

#: Bounds of the fit: labelled rows, and unlabelled rows that the views label for each other.
MAX_LABELLED = 6000
MAX_POOL = 6000
ROUNDS = 3
#: The most confident share of the pool that a view may label in a round, if it is at least so sure.
SHARE = 0.1
SURE = 0.95

_CLASSES = {"upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "stop": b".", "comma": b",;:", "bang": b"!?", "symbol": b"#*$%&|<>@~^_=+{}[]\\/", "pipe": b"|", "quote": b"\"'"}
_FLAG = {k: np.isin(np.arange(256), list(v)) for k, v in _CLASSES.items()}
_SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_LATER = (np.arange(256) & 0xC0) == 0x80
CONTENT = [*_CLASSES, "wide", "word_length", "same_as_last", "distinct", "pairs_again", "capitals", "few_words", "line_length"]
#: A source or language has a column of its own if so many documents of the fit have it; the others share one.
SEEN = 20


def content_features(texts: pa.Array) -> np.ndarray:
    """The content view of each whole text."""
    data, offsets = utf8(texts)
    parts = [np.zeros((0, len(CONTENT)))]
    for i, j in groups(offsets, 400_000):
        own, edges = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        k = j - i
        total = lambda flags: np.diff(np.append(0, np.cumsum(flags))[edges]).astype(float)
        space = _SPACE[own]
        first = ~space
        cut = np.ones(len(own), bool)
        cut[1:] = space[:-1]
        cut[edges[:-1][edges[:-1] < len(own)]] = True
        first &= cut
        words = total(first)
        points = total(~_LATER[own])
        inked = np.maximum(1, total(~space & ~_LATER[own]))
        x = np.zeros((k, len(CONTENT)))
        for c, name in enumerate(_CLASSES):
            x[:, c] = total(_FLAG[name][own]) / inked
        at = len(_CLASSES)
        x[:, at] = total((own >= 0xC0)) / inked
        x[:, at + 1] = np.minimum(inked / np.maximum(1, words), 40) / 10
        starts = np.flatnonzero(first)
        lead = int(starts[0]) if len(starts) else 0
        h = segment_hashes(own[lead:], starts - lead, space[lead:])
        doc = np.repeat(np.arange(k), words.astype(int))
        if len(h):
            last = np.append(False, (h[1:] == h[:-1]) & (doc[1:] == doc[:-1]))
            x[:, at + 2] = np.bincount(doc[last], minlength=k) / np.maximum(1, words)
            mixed = h + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            by = np.sort(mixed)
            owner = doc[np.argsort(mixed)]
            x[:, at + 3] = np.bincount(owner[np.append(True, by[1:] != by[:-1])], minlength=k) / np.maximum(1, words)
            pair = mixed[:-1] + h[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
            pdoc = doc[:-1]
            inside = pdoc == doc[1:]
            pair, pdoc = pair[inside], pdoc[inside]
            order = np.argsort(pair)
            again = np.append(False, pair[order][1:] == pair[order][:-1]) if len(pair) else np.zeros(0, bool)
            x[:, at + 4] = np.bincount(pdoc[order][again], minlength=k) / np.maximum(1, words)
            x[:, at + 5] = total(first & _FLAG["upper"][own]) / np.maximum(1, words)
        x[:, at + 6] = words < 10
        x[:, at + 7] = np.log1p(points / (total(own == 10) + 1)) / 10
        parts.append(x)
    return np.vstack(parts)


class Metadata:
    """The metadata view: the size that n_chars gives, and which of the known sources and languages a document has."""

    def __init__(self, lang: list[str | None], source: list[str | None]) -> None:
        known = lambda values: {v: i for i, v in enumerate(sorted((v for v, k in Counter(values).items() if k >= SEEN), key=lambda v: (v is None, v or "")))}
        self.lang, self.source = known(lang), known(source)

    def features(self, lang: list[str | None], source: list[str | None], n_chars: list[int | None]) -> np.ndarray:
        langs = len(self.lang)
        x = np.zeros((len(lang), 3 + langs + 1 + len(self.source) + 1))
        for i, (a, b, n) in enumerate(zip(lang, source, n_chars)):
            x[i, 0] = np.log1p(max(n or 0, 0)) / 10
            x[i, 1], x[i, 2] = n is None, n == 0
            x[i, 3 + self.lang.get(a, langs)] = 1
            x[i, 4 + langs + self.source.get(b, len(self.source))] = 1
        return x


def bent(x: np.ndarray, middle: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Standardised features with their squares, both clipped, so that linear models can bound values on two sides."""
    z = np.clip((x - middle) / scale, -6, 6)
    return np.hstack([z, np.minimum(z * z, 20)])


class View:
    def __init__(self, x: np.ndarray) -> None:
        self.middle, self.scale = x.mean(axis=0), x.std(axis=0) + 0.02
        self.w = np.zeros(2 * x.shape[1] + 1)

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
        self.w = logistic(bent(x, self.middle, self.scale), y, 1.0, weight)

    def logit(self, x: np.ndarray) -> np.ndarray:
        return bent(x, self.middle, self.scale) @ self.w[:-1] + self.w[-1]


class Model:
    """Both views, a calibration (slope, intercept) of each, and the weights that combine the calibrated logits."""

    def __init__(self, views: list[View], calibration: list[np.ndarray], mix: np.ndarray, metadata: Metadata | None = None) -> None:
        self.views, self.calibration, self.mix, self.metadata = views, calibration, mix, metadata

    def calibrated(self, xs: list[np.ndarray]) -> np.ndarray:
        """Logits of P(good) by each view alone."""
        return np.stack([np.clip(v.logit(x), -20, 20) * c[0] + c[1] for v, x, c in zip(self.views, xs, self.calibration)], axis=1)

    def score(self, xs: list[np.ndarray]) -> np.ndarray:
        return sigmoid(self.calibrated(xs) @ self.mix[:-1] + self.mix[-1])


def co_train(labelled: list[np.ndarray], y: np.ndarray, pool: list[np.ndarray], rounds: int = ROUNDS) -> Model:
    """Exchange confident pseudo-labels between the views; of the labelled rows held back, half calibrate each view, half combine them."""
    of = np.arange(len(y)) % 8
    parts = [of == 3, of == 7]
    if not all(len(set(y[p].tolist())) == 2 and p.sum() >= 10 for p in parts) or len(set(y[of % 4 != 3].tolist())) < 2:
        parts = [np.ones(len(y), bool)] * 2  # too few rows to hold any back
        fit_on = parts[0]
    else:
        fit_on = of % 4 != 3
    views = [View(np.vstack([a, b])) for a, b in zip(labelled, pool)]
    given: list[dict[int, float]] = [{}, {}]  # pseudo-labels for each view, from the other
    for step in range(rounds + 1):
        for v, view in enumerate(views):
            rows = np.array(sorted(given[v]), int)
            x = np.vstack([labelled[v][fit_on], pool[v][rows]])
            t = np.concatenate([y[fit_on], [given[v][r] for r in rows.tolist()]])
            view.fit(x, t, np.concatenate([np.ones(int(fit_on.sum())), np.full(len(rows), 0.3)]))
        if step < rounds and len(pool[0]):
            for v, view in enumerate(views):
                p = sigmoid(view.logit(pool[v]))
                sure = np.argsort(-np.abs(p - 0.5), kind="stable")[: int(SHARE * len(p))]
                for r in sure[np.maximum(p[sure], 1 - p[sure]) >= SURE].tolist():
                    given[1 - v][r] = float(p[r] >= 0.5)
    calibration = [logistic(np.clip(v.logit(x[parts[0]]), -20, 20)[:, None], y[parts[0]], 0.1) for v, x in zip(views, labelled)]
    model = Model(views, calibration, np.zeros(3))
    model.mix = logistic(model.calibrated([x[parts[1]] for x in labelled]), y[parts[1]], 0.1)
    return model


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def content_of(texts: pa.Array) -> pa.Array:
    x = content_features(texts)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))


_COLUMNS = {"lang": "string", "source": "string", "n_chars": "long"}


def _inputs(docs: DataFrame, text: str):
    """The columns that the views read; a table without one of them has none of its values."""
    own = set(docs.columns)
    return [F.col(text), *(F.col(c).cast(kind) if c in own else F.lit(None).cast(kind) for c, kind in _COLUMNS.items())]


def fit(docs: DataFrame, labels: DataFrame, text: str = "text") -> Model | float:
    """Fit on at most ``MAX_LABELLED`` labelled and ``MAX_POOL`` unlabelled documents; their features, not texts, reach the driver.

    The unlabelled ones are of doc_ids that no row of ``labels`` has. Rows with a null label or doc_id teach nothing.
    Where fewer than two classes are labelled the share of good rows is returned instead of a model (0.5 without labels).
    """
    taught = labels.select(F.col("doc_id").cast("long").alias("row"), F.col("quality").cast("int").alias("quality")).where(F.col("row").isNotNull() & F.col("quality").isin(0, 1))
    few = sample(taught, "row", MAX_LABELLED, 5)
    keyed = docs.select(F.col("doc_id").cast("long").alias("_row"), *(c.alias(f"_{n}") for c, n in zip(_inputs(docs, text), ("text", *_COLUMNS))))
    seen = [content_of("_text").alias("content"), *(F.col(f"_{c}") for c in _COLUMNS)]
    known = keyed.join(F.broadcast(few), F.col("_row") == F.col("row"))  # at most MAX_LABELLED rows of two numbers
    got = known.select("_row", "quality", *seen).orderBy("_row", "quality", "content").limit(MAX_LABELLED).toArrow()
    y = got["quality"].to_numpy().astype(float)
    if len(set(y.tolist())) < 2:
        return float(y.mean()) if len(y) else 0.5
    own = labels.select(F.col("doc_id").cast("long").alias("_row")).where(F.col("_row").isNotNull())
    others = keyed.select("_row").where(F.col("_row").isNotNull()).join(own, "_row", "left_anti").distinct()
    others = others.orderBy(F.xxhash64(F.lit(11), "_row"), "_row").limit(MAX_POOL)
    pool = keyed.join(F.broadcast(others.select(F.col("_row").alias("_p"))), F.col("_row") == F.col("_p"))
    other = pool.select("_row", *seen).orderBy("_row", "content").limit(MAX_POOL).toArrow()
    unpack = lambda t: np.array(t["content"].to_pylist(), float).reshape(t.num_rows, -1) if t.num_rows else np.zeros((0, len(CONTENT)))
    column = lambda t, c: t[f"_{c}"].to_pylist()
    metadata = Metadata(column(got, "lang") + column(other, "lang"), column(got, "source") + column(other, "source"))
    views = [[unpack(t), metadata.features(*(column(t, c) for c in _COLUMNS))] for t in (got, other)]
    model = co_train(views[0], y, views[1])
    model.metadata = metadata
    return model


def score_quality(docs: DataFrame, labels: DataFrame, text: str = "text", into: str = "quality_score") -> DataFrame:
    """``docs`` with the probability in ``into`` that a document is good, from its whole text and its metadata.

    Null counts as an empty text; null languages and sources are values of their own; equal rows get equal scores; a
    column named as ``into`` is replaced, others stay; an empty table gives an empty table. Scoring needs no shuffle.
    """
    return docs.withColumn(into, _scorer(fit(docs, labels, text))(*_inputs(docs, text)))


def _scorer(model: Model | float):
    @F.arrow_udf(T.DoubleType())
    def run(texts: pa.Array, lang: pa.Array, source: pa.Array, n_chars: pa.Array) -> pa.Array:
        if isinstance(model, float):
            return pa.array(np.full(len(texts), model))
        return pa.array(model.score([content_features(texts), model.metadata.features(lang.to_pylist(), source.to_pylist(), n_chars.to_pylist())]))

    return run


def good_documents(docs: DataFrame, labels: DataFrame, text: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that the classifier doesn't reject, with their own columns."""
    return packed(docs, score=_scorer(fit(docs, labels, text))(*_inputs(docs, text))).where(F.col("score") >= least).select("row.*")


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """What query op5 returns: doc_id, score and kept."""
    scored = score_quality(docs, labels, into="score")
    return scored.select("doc_id", "score", (F.col("score") >= 0.5).alias("kept"))
