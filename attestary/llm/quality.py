"""Quality classifier: heuristic labellers, a label model over their votes, a hashed linear scorer."""

from __future__ import annotations

import operator
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestary.llm.common import unfolded, whole

BUCKETS = 4096        # features of the linear scorer
SAMPLE = 3000         # documents the linear scorer is fitted on, at most
ROUNDS = 100          # of expectation-maximisation, at most
STEPS = 400           # of gradient descent
CHUNK = 1 << 20       # bytes whose features are hashed at once
AT, VALUE = ">u2", ">f4"  # buckets and weights as sent to the driver: as bytes they sort like the numbers
GOOD, BAD, NONE = "+", "-", "."
# labeller: the statistic it looks at; at most this is good, at least that is bad, between it abstains
LABELLERS = [
    ("upper", 0.15, 0.5),      # capitals among ASCII letters
    ("exclaim", 0.05, 0.3),    # exclamation marks per word
    ("symbols", 0.05, 0.3),    # signs such as # % & * $ per word
    ("bars", 0.05, 0.15),      # | per word
    ("again", 0.05, 0.25),     # words equal to the word before
    ("same", 0.6, 0.8),        # words that stand elsewhere in the text too
    ("open", 0.97, 0.985),     # words not followed by a sentence end
    ("lines", 0.3, 0.6),       # lines that repeat another
    ("length", 8.5, 10.0),     # mean characters per word
]
ON_GOOD, ON_BAD = (0.999, 0.9999), (0.05, 0.6)  # ranges of the accuracies
OFTEN, UNSURE = 0.1, 0.5  # a labeller that accuses more than this share may be right on so few good documents
# sentence ends beyond ASCII: CJK, Indic, Arabic, Ethiopic, Armenian, Khmer, Burmese, Tibetan, ellipsis
ENDS = [c.encode() for c in "。｡！？।॥؟۔።፧։՞។။།…"]
FEW = 20  # words: with fewer, shares of words say nothing


def statistics(raw: bytes) -> tuple[list[float], np.ndarray, int]:
    """The labellers' statistics in order, the byte values, and the number of words."""
    octets = np.frombuffer(raw, dtype=np.uint8)
    counts = np.bincount(octets, minlength=256)
    words = raw.split()
    n, lines = len(words), raw.split(b"\n")
    upper, letters = int(counts[65:91].sum()), int(counts[65:91].sum() + counts[97:123].sum())
    per = 1 / n if n else 0.0
    beyond = int(counts[192:].sum())  # characters beyond ASCII, by their first byte
    chars = int(counts[:128].sum()) + beyond
    ends = int(counts[46] + counts[33] + counts[63]) + (sum(map(raw.count, ENDS)) if beyond else 0)
    length, open_words = chars * per, 1 - min(1.0, ends * per) if n else 0.0
    if beyond > letters and length >= 10.0:  # a script without blanks between words: these two know nothing
        length, open_words = 9.0, 0.98
    stats = [
        upper / letters if letters else 0.0,
        counts[33] * per, (counts[35:39].sum() + counts[42]) * per, counts[124] * per,
        sum(map(operator.eq, words, words[1:])) * per, 1 - len(set(words)) * per if n else 0.0,
        open_words,
        1 - len(set(lines)) / len(lines), length]
    return [float(s) for s in stats], octets, n


def votes_of(stats: list[float], n_words: int) -> str:
    """One sign per labeller. All abstain on a text without words; those on shares of words on few words."""
    out = ""
    for (name, good, bad), value in zip(LABELLERS, stats):
        silent = n_words == 0 or n_words < FEW and name in ("upper", "same", "open", "lines", "length")
        # long texts use a word again as a matter of course
        value = value if name != "same" or n_words < 400 else 0.7 if value < 0.97 else value
        out += NONE if silent else GOOD if value <= good else BAD if value >= bad else NONE
    return out


def hashed_features(stats: list[float], octets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and weights: the shares of the text's byte triples, and each statistic's range."""
    total = np.zeros(BUCKETS, dtype=np.int64)
    for i in range(0, max(0, len(octets) - 2), CHUNK):
        b = octets[i:i + CHUNK + 2].astype(np.uint32)
        triple = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
        total += np.bincount((triple * np.uint32(2654435761)) >> np.uint32(20), minlength=BUCKETS)
    at = np.flatnonzero(total)
    share = np.sqrt(total[at] / max(1, total.sum()))
    ranges = []
    for j, ((_, good, bad), value) in enumerate(zip(LABELLERS, stats)):
        step = 0 if value <= good else 2 if value >= bad else 1
        ranges.append((j * 2654435761 + step * 40503 + 977) % BUCKETS)
    return np.concatenate([at, ranges]), np.concatenate([share, np.full(len(ranges), 0.3)])


class LabelModel:
    """Two classes, labellers independent within a class; accuracies by expectation-maximisation.

    A labeller's accuracies are how often its vote (when it gives one) is right on good and on bad
    documents. Each knows one fault: it seldom accuses a good document and misses most bad ones.
    ``ON_GOOD`` and ``ON_BAD`` hold the estimates to that, so a rare fault is not taken for a habit of
    good documents. One whose votes accuse more than ``OFTEN`` is held to ``UNSURE`` only: the data may show
    that it accuses good documents.
    """

    def __init__(self, patterns: dict[str, int]):
        names = sorted(patterns)
        n = np.array([patterns[p] for p in names], dtype=float)
        says_bad = np.array([[c == BAD for c in p] for p in names], dtype=float).reshape(len(names), len(LABELLERS))
        says_good = np.array([[c == GOOD for c in p] for p in names], dtype=float).reshape(len(names), len(LABELLERS))
        accused, praised = n @ says_bad, n @ says_good
        low = np.where(accused > OFTEN * (accused + praised), UNSURE, ON_GOOD[0])
        self.prior = 0.85
        self.on_good, self.on_bad = np.full(len(LABELLERS), ON_GOOD[0]), np.full(len(LABELLERS), 0.25)
        for _ in range(ROUNDS if len(names) else 0):
            good = self._good(says_good, says_bad)
            before = np.concatenate([self.on_good, self.on_bad])
            w_good, w_bad = n * good, n * (1 - good)
            # one pseudo-vote each way keeps unanimous labellers short of certainty
            self.on_good = (w_good @ says_good + 2) / (w_good @ (says_good + says_bad) + 2.1)
            self.on_bad = (w_bad @ says_bad + 1) / (w_bad @ (says_good + says_bad) + 2)
            self.on_good, self.on_bad = np.clip(self.on_good, low, ON_GOOD[1]), np.clip(self.on_bad, *ON_BAD)
            self.prior = float(np.clip((w_good.sum() + 1) / (n.sum() + 2), 0.05, 0.95))
            if np.abs(np.concatenate([self.on_good, self.on_bad]) - before).max() < 1e-7:
                break
        self.posterior = dict(zip(names, self._good(says_good, says_bad).tolist()))

    def _good(self, says_good: np.ndarray, says_bad: np.ndarray) -> np.ndarray:
        odds = (np.log(self.prior / (1 - self.prior)) + says_good @ np.log(self.on_good / (1 - self.on_bad))
                + says_bad @ np.log((1 - self.on_good) / self.on_bad))
        return 1 / (1 + np.exp(-np.clip(odds, -50, 50)))


def fit_scorer(rows: list[tuple[np.ndarray, np.ndarray]], posterior: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic regression on hashed features with probabilities as labels."""
    x = np.zeros((len(rows), BUCKETS), dtype=np.float32)
    for i, (at, value) in enumerate(rows):
        np.add.at(x[i], at, value.astype(np.float32))
    weights, bias = np.zeros(BUCKETS, dtype=np.float32), 0.0
    if not len(rows):
        return weights, bias
    # both classes weigh the same, so rare rejections are learned
    share = float(np.clip(posterior.mean(), 0.02, 0.98))
    balance = posterior / share + (1 - posterior) / (1 - share)
    speed = np.zeros(BUCKETS, dtype=np.float32), 0.0
    for _ in range(STEPS):
        off = balance * (1 / (1 + np.exp(-(x @ weights + bias))) - posterior) / len(rows)
        speed = 0.9 * speed[0] + x.T @ off.astype(np.float32) + 1e-5 * weights, 0.9 * speed[1] + float(off.sum())
        weights, bias = weights - 2.0 * speed[0], bias - 0.2 * speed[1]
    return weights, bias


class QualityModel:
    """A fitted model: what it needs to label and score any text."""

    def __init__(self, labels: LabelModel, weights: np.ndarray, bias: float):
        self.labels, self.weights, self.bias = labels, weights, bias

    def apply(self, text: Column) -> Column:
        """struct<votes, posterior, score>: the votes, the label model's and the scorer's probability of good."""
        posterior, weights, bias = self.labels.posterior, self.weights, self.bias
        unknown = self.labels.prior

        @F.pandas_udf("votes string, posterior double, score double")
        def run(texts: pd.Series) -> pd.DataFrame:
            out = []
            for t in texts:
                stats, octets, n = statistics((t or "").encode())
                votes = votes_of(stats, n)
                at, value = hashed_features(stats, octets)
                odds = float(weights[at].astype(float) @ value) + bias
                out.append((votes, posterior.get(votes, unknown), 1.0 if n == 0 else 1 / (1 + np.exp(-np.clip(odds, -50, 50)))))
            return pd.DataFrame(out, columns=["votes", "posterior", "score"]).astype({"posterior": float, "score": float})
        return run(text)


@F.pandas_udf(T.StringType())
def votes(texts: pd.Series) -> pd.Series:
    out = []
    for t in texts:
        stats, _, n = statistics((t or "").encode())
        out.append(votes_of(stats, n))
    return pd.Series(out, dtype=object)


def _sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        votes, at, values = [], [], []
        for t in batch.column(0).to_pylist():
            stats, octets, n = statistics((t or "").encode())
            a, v = hashed_features(stats, octets)
            votes.append(votes_of(stats, n))
            at.append(a.astype(AT).tobytes())
            values.append(v.astype(VALUE).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(votes, pa.string()), pa.array(at, pa.binary()),
                                          pa.array(values, pa.binary())], ["votes", "at", "value"])


def fit(docs: DataFrame, sample: int = SAMPLE) -> QualityModel:
    """Votes of all documents are counted by pattern (at most 3^9 patterns reach the driver) for the
    label model; the scorer is fitted on its posteriors for at most ``sample`` documents, those with
    the smallest hashes."""
    counted = docs.select(votes("text").alias("v")).groupBy("v").count().collect()
    labels = LabelModel({r.v: r["count"] for r in counted})
    rank = F.xxhash64("doc_id", "text")
    top = docs.select(rank.alias("h")).orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    rows = []
    if top is not None:
        rows = (docs.where(rank <= top).select("text", rank.alias("h")).limit(sample).select("text")
                .mapInArrow(_sample, "votes string, at binary, value binary").collect())
    rows.sort(key=lambda r: (r.votes, r.at, r.value))  # the sum of floats does not depend on who came first
    posterior = np.array([labels.posterior.get(r.votes, labels.prior) for r in rows])
    weights, bias = fit_scorer([(np.frombuffer(r.at, AT), np.frombuffer(r.value, VALUE)) for r in rows], posterior)
    return QualityModel(labels, weights, bias)


def scored(docs: DataFrame, model: QualityModel | None = None) -> DataFrame:
    """``doc`` (all columns of a document) and ``quality``, struct<votes, posterior, score>.

    Nulls and texts without words get no vote and score 1: nothing speaks against them. Repeated rows
    score alike. A text is hashed in chunks; an empty table gives no rows.
    """
    model = model or fit(docs)
    return docs.select(whole(docs), model.apply(F.col("text")).alias("quality"))


def keep_good(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents, all columns, that the classifier does not reject: those scoring ``threshold`` or more."""
    return unfolded(scored(docs).where(F.col("quality.score") >= threshold), docs)
