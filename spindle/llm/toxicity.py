"""Operator 8: toxicity by weak supervision.

Many voters each say "toxic" or "clean" or abstain: words of a lexicon (given, and mined from the training rows), starts
of words, and patterns of whole texts. A generative label model, with the accuracy of every voter and the correlations of the
votes within classes, gives each training document a posterior label from its votes alone: labels
say which class is which (they start the accuracies), but are no evidence on any document. A linear classifier fitted on the
posteriors scores all documents.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .common import materialise, row_type, text_hash
from .learn import logistic, sample, sigmoid

#: Bound of the fit: labelled documents.
MAX_LABELLED = 8000
#: A mined voter's odds for its class are so much higher, and so clearly that of all the words (or starts of words) of the
#: sample about one would look like that by chance.
MIN_ODDS = 8.0
#: What its first accuracy, from the labels, weighs in a voter's later ones, beside that which the posteriors say.
WEIGHT = 1.0
#: Lengths, in bytes, of the starts of words that are voters.
PREFIXES = (4, 5, 6, 8)
#: Words that need no mining: they are voters wherever they occur in the sample.
LEXICON = """
asshole bastard bitch bullshit clown coward creep crap cretin damn despicable dirtbag disgusting dumb dumbass failure filth
filthy fool freak garbage hate hideous horrible idiot idiotic ignorant imbecile jerk kill lame liar loser lunatic moron
moronic nasty obnoxious parasite pathetic pig rat repulsive retard ridiculous rotten rubbish scum shit shut sickening
slut stupid subhuman suck sucks trash ugly useless vermin vile whore worthless wretched
""".split()

#: Patterns of whole texts; labels decide for which class each counts, if for any.
PATTERNS = {
    "@address": rb"(?i)\byou(?:'re| are)? (?:an? |such |so |all )*(?:" + "|".join(LEXICON).encode() + rb")",
    "@dismiss": rb"(?i)\b(?:shut (?:the \w+ )?up|go to hell|get lost|screw you|drop dead)\b",
    "@starred": rb"(?i)\b[a-z]\*{2,}[a-z]*\b",
    "@shout": rb"[A-Z]{4,}[^a-z]{0,6}!",
    "@licence": rb"(?i)licen[cs]ed? under|copyright|all rights reserved",
    "@code": rb"[A-Za-z_]+ ?[=:] ?[\"']|://|[{};]\n",
    "@table": rb"\|[^|\n]+\|",
    "@list": rb"(?m)^[-*] ",
}
_PATTERNS = {name: re.compile(p) for name, p in PATTERNS.items()}
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in range(256))


def terms(text: str | None) -> set[bytes]:
    """What a voter can look for: the distinct words of a text, their starts (marked by ``*``, and ``**`` if
    several words start so) and the patterns it shows (``@``).

    Words are lower-cased in ASCII and end at anything but letters and digits.
    """
    own = (text or "").encode()
    words = set(own.translate(_TABLE).split())
    found = set(words)
    for n in PREFIXES:
        starts = Counter([w[:n] for w in words if len(w) > n])
        found.update([s + b"*" for s in starts])
        found.update([s + b"**" for s, k in starts.items() if k > 1])
    found.update(name.encode() for name, p in _PATTERNS.items() if p.search(own))
    return found


def _sample_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [sorted(terms(x.as_py())) for x in batch.column(1)]
        shown = pa.array([[t.decode("latin-1") for t in f] for f in found], pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays([batch.column(0), shown, batch.column(2), batch.column(3)], names=["row", "terms", "toxic", "hash"])


class LabelModel:
    """The accuracy of every voter, where it doesn't abstain, and how much of its evidence correlated voters repeat.

    A voter that is silent abstains, which is no evidence: most know the words of one language only. ``labels`` orient the
    model: they give the share of the classes, which class a voter is for, and its first accuracy, which goes on
    to count (``WEIGHT``), since voters that are all for one class would else only confirm one another.
    Expectation-maximisation then sees the votes alone.
    """

    def __init__(self, votes: np.ndarray, labels: np.ndarray, rounds: int = 50) -> None:
        one, n = labels.sum(), len(labels)
        self.prior = float(np.log((one + 0.5) / (n - one + 0.5)))
        self.toxic_voter = (labels @ votes + 0.1) / (one + 0.1) > ((1 - labels) @ votes + 0.1) / (n - one + 0.1)
        right = np.where(self.toxic_voter, labels @ votes, (1 - labels) @ votes)
        self.first = (right + 0.5) / (votes.sum(axis=0) + 1)
        p = labels.astype(float)
        for _ in range(rounds):
            self._rates(votes, p)
            new = self.posterior(votes)
            if np.abs(new - p).max() < 1e-6:
                break
            p = new

    def _rates(self, votes: np.ndarray, p: np.ndarray) -> None:
        fired, one = votes.sum(axis=0), p @ votes
        shares = np.where(self.toxic_voter, one, fired - one)
        self.accuracy = (shares + (WEIGHT * fired + 1) * self.first) / (fired + WEIGHT * fired + 1)
        rate1, rate0 = one / max(p.sum(), 1e-9), (fired - one) / max((1 - p).sum(), 1e-9)
        apart = votes - (p[:, None] * rate1 + (1 - p)[:, None] * rate0)
        cov = apart.T @ apart / len(votes)
        spread = np.sqrt(np.maximum(np.diag(cov), 1e-12))
        self.correlation = np.abs(cov / spread[:, None] / spread[None, :])
        gain = np.log(self.accuracy / (1 - self.accuracy)) - np.where(self.toxic_voter, self.prior, -self.prior)
        self.evidence = np.maximum(gain, 0) * np.where(self.toxic_voter, 1, -1)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        together = votes @ np.where(self.correlation > 0.1, self.correlation, 0)  # of each voter with those that spoke here, itself among them
        return sigmoid(self.prior + (votes / np.maximum(1, together)) @ self.evidence)


class Classifier:
    """Weights of terms, and an intercept."""

    def __init__(self, weights: dict[bytes, float], intercept: float) -> None:
        self.weights, self.intercept = weights, intercept
        starts = {t for t in weights if t.endswith(b"*")}
        self.patterns = [(p, weights[name.encode()]) for name, p in _PATTERNS.items() if name.encode() in weights]
        self.words = {t: w for t, w in weights.items() if t not in starts and not t.startswith(b"@")}
        self.starts: dict[int, dict[bytes, tuple[float, float]]] = {}  # by length: the weight of a start, and what it adds to it if several words have it
        for t in starts:
            stem = t.rstrip(b"*")
            self.starts.setdefault(len(stem), {})[stem] = (weights.get(stem + b"*", 0.0), weights.get(stem + b"**", 0.0))

    def score(self, text: str | None) -> float:
        """What :func:`terms` has of the weights, summed up, without making terms that have none."""
        own = (text or "").encode()
        words = set(own.translate(_TABLE).split())
        z = self.intercept + sum(map(self.words.__getitem__, words & self.words.keys()))
        for n, stems in self.starts.items():
            seen: dict[bytes, int] = {}
            for w in words:
                if w[:n] in stems and len(w) > n:
                    seen[w[:n]] = seen.get(w[:n], 0) + 1
            for stem, k in seen.items():
                once, twice = stems[stem]
                z += once + twice if k > 1 else once
        z += sum(w for p, w in self.patterns if p.search(own))
        return float(sigmoid(np.array(z)))


def gathered(docs: DataFrame, labels: DataFrame, text: str = "text", most: int = MAX_LABELLED) -> DataFrame:
    """The terms of at most ``most`` labelled documents outside the held-out fold: row, toxic, terms.

    Of several labels of a doc_id the mean decides (a tie is no label), of several texts the one of the least hash.
    """
    taught = labels.select(F.col("doc_id").cast("long").alias("row"), F.col("toxic").cast("int").alias("toxic"))
    taught = taught.where(F.col("row").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out("row")).groupBy("row").agg(F.avg("toxic").alias("m"))
    taught = taught.where("m <> 0.5").select("row", (F.col("m") > 0.5).cast("int").alias("toxic"))
    taught = materialise(sample(taught, "row", most, 8), "toxic-sample")  # at most `most` rows of two numbers
    rows = docs.select(F.col("doc_id").cast("long").alias("row"), F.col(text).alias("text"), text_hash(text).alias("hash")).join(F.broadcast(taught), "row")
    found = rows.select("row", "text", "toxic", "hash").mapInArrow(_sample_terms, row_type("row long, terms string[], toxic int, hash long"))
    one = found.groupBy("row").agg(F.min("toxic").alias("toxic"), F.min_by("terms", "hash").alias("terms"))
    return materialise(one, "toxic-terms")


def chosen_voters(found: DataFrame, n: int, one: int) -> list[str]:
    """Terms that speak clearly for either class, the clearest first; words of the lexicon and patterns need not be so clear."""
    hits = found.select(F.explode("terms").alias("term"), "toxic").groupBy("term").agg(F.sum("toxic").alias("a"), F.count("*").alias("k"))
    start = F.col("term").endswith("*")
    hits = materialise(hits, "toxic-hits")
    n_words, n_starts = hits.agg(F.sum((~start).cast("long")), F.sum(start.cast("long"))).first()
    share, prior = F.col("a") / F.col("k"), one / n
    odds = (F.col("a") + 0.1) / (F.col("k") - F.col("a") + 0.1) * (n - one) / one
    apart = lambda x, of: F.when(x > 0, x * F.log(x / of)).otherwise(0.0)
    gain = F.col("k") * (apart(share, prior) + apart(1 - share, 1 - prior))  # log likelihood over that of the prior
    clear = gain >= F.when(start, float(np.log(max(n_starts or 1, 1)))).otherwise(float(np.log(max(n_words or 1, 1))))
    given = F.col("term").isin(LEXICON) | F.col("term").startswith("@") & (gain >= 2)
    strong = (odds >= MIN_ODDS) | (odds <= 1 / MIN_ODDS) & (F.col("k") >= 5)
    picked = hits.withColumn("gain", gain).where(strong & (clear | given) | F.col("term").startswith("@") & given)
    return [r["term"] for r in picked.orderBy(F.desc("gain"), F.length("term"), "term").collect()]  # terms of at most MAX_LABELLED texts


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", most: int = MAX_LABELLED) -> Classifier:
    """Fit on at most ``most`` labelled documents outside the held-out fold: crc32 of doc_id as text, mod 5, isn't 0.

    Rows with a null label or doc_id teach nothing. Without training rows every score is 0; with one class only, scores
    are that class's share.
    """
    found = gathered(docs, labels, text, most)
    total = found.agg(F.count("*").alias("n"), F.sum("toxic").alias("one")).first()
    n, one = int(total["n"]), int(total["one"] or 0)
    if not n:
        return Classifier({}, -35.0)
    base = float(np.log((one + 0.5) / (n - one + 0.5)))
    if not one or one == n:
        return Classifier({}, base)
    names = chosen_voters(found, n, one)
    if not names:
        return Classifier({}, base)
    voters, votes, y = _votes(found, names)
    if not voters:
        return Classifier({}, base)
    w = logistic(votes, LabelModel(votes, y).posterior(votes), ridge=0.05)
    return Classifier({v.encode("latin-1"): round(float(x), 6) for v, x in zip(voters, w)}, round(float(w[-1]), 6))


def distinct_voters(votes: np.ndarray, labels: np.ndarray, always: np.ndarray, least: float) -> np.ndarray:
    """Voters that add something to those before them: taken by gain on the rows where no voter of their class has spoken yet.

    Words and their starts say the same many times over, which a label model would take for agreement. ``always`` are taken
    after the others in any case, unless one taken before speaks wherever they do.
    """
    prior = labels.mean()
    toxic = (labels @ votes + 0.1) / (labels.sum() + 0.1) > ((1 - labels) @ votes + 0.1) / ((1 - labels).sum() + 0.1)
    taken: list[int] = []
    for side, own in ((True, labels), (False, 1 - labels)):
        base = prior if side else 1 - prior
        free = np.ones(len(labels))
        left = np.flatnonzero(toxic == side)
        while len(left):
            k, a = free @ votes[:, left], (free * own) @ votes[:, left]
            share = np.clip(a / np.maximum(k, 1e-9), 1e-9, 1 - 1e-9)
            gain = np.where(share > base, k * (share * np.log(share / base) + (1 - share) * np.log((1 - share) / (1 - base))), 0)
            best = int(gain.argmax())
            if gain[best] < least:
                break
            taken.append(int(left[best]))
            free = free * (1 - votes[:, left[best]])
            left = np.delete(left, best)
    for j in np.flatnonzero(always).tolist():
        if j not in taken and not any((votes[:, i] >= votes[:, j]).all() for i in taken):
            taken.append(j)
    return np.array(sorted(taken), int)


def _votes(found: DataFrame, names: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Voters, their votes on each sampled document, and the labels."""
    fired = found.select("row", "toxic", F.array_intersect("terms", F.array(*map(F.lit, names))).alias("v")).orderBy("row").toArrow()  # at most MAX_LABELLED rows
    column = {v: j for j, v in enumerate(names)}
    votes = np.zeros((fired.num_rows, len(names)), np.float32)
    for i, v in enumerate(fired["v"].to_pylist()):
        votes[i, [column[t] for t in v]] = 1
    labels = fired["toxic"].to_numpy().astype(float)
    given = np.array([n in LEXICON or n.startswith("@") for n in names])
    keep = distinct_voters(votes, labels, given, float(np.log(len(names) + 1)) + 2)
    return [names[j] for j in keep.tolist()], votes[:, keep].astype(float), labels


def held_out(column: str):
    return F.crc32(F.col(column).cast("string")) % 5 == 0


def score_documents(docs: DataFrame, labels: DataFrame, text: str = "text", into: str = "toxicity") -> DataFrame:
    """``docs`` with a score from 0 to 1 of each whole text in ``into``; needs doc_id for the join with the labels alone.

    Null and empty texts get the score of a text without any voter; equal texts get equal scores; a column named as
    ``into`` is replaced, others stay; an empty table gives an empty table. Scoring is one pass without a shuffle.
    """
    model = fit(docs, labels, text)

    @F.arrow_udf(DoubleType())
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([model.score(x.as_py()) for x in texts], pa.float64())

    return docs.withColumn(into, run(F.col(text)))


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """What query op8 returns."""
    scored = score_documents(docs.select("doc_id", "text"), labels, into="score")
    return scored.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
