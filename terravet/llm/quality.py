"""Quality classifier: Bradley-Terry scores learned from preference pairs.

Each document gets features of its whole text.  A document labelled good is preferred
to one labelled bad; the weights minimise the logistic loss on the feature differences
of such pairs, so only score differences matter.  The cut between good and bad is a
quantile of the training scores (the share of bad labels), and the logistic map to
0..1 is placed so that this quantile is ``CUT_SCORE``.

The fit reads at most ``MAX_LABELLED`` labelled documents (the smallest hashes of
doc_id); everything else covers every row.  Defined results: a null or empty text has
the features of an empty text and a finite score; repeated rows get equal scores; a
doc_id with several labels counts once, with its lowest label; without labels of both
kinds every score is ``CUT_SCORE`` (all documents are kept).  Extra columns do not
matter: only the named ones are read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import own_names, per_text, plain_names, read

MAX_LABELLED = 20_000
PAIRS_PER_BAD = 12
CUT_SCORE = 0.7
KNOTS = (0.05, 0.25, 0.5, 0.75, 0.95)
RIDGE = 1e-3

LOWER, UPPER, DIGIT, SPACE, STOP, SYMBOL, OTHER = range(7)
NAMES = ("lower", "upper", "digit", "space", "stop", "symbol", "other", "symbol_runs", "log_words", "word_length",
         "distinct_words", "repeated_next", "capital_words", "marked_words", "short_lines", "distinct_lines",
         "log_lines", "long_words", "distinct_pairs", "ended_lines")


@lru_cache(maxsize=1)
def char_kinds() -> np.ndarray:
    kinds = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x30000):
        s = chr(c)
        kinds[c] = (LOWER if s.islower() else UPPER if s.isupper() else DIGIT if s.isdigit() else
                    SPACE if s.isspace() else LOWER if s.isalpha() else OTHER)
    for s in ".,;:?!'\"()-":
        kinds[ord(s)] = STOP
    for s in "#$%&*+/<=>@[\\]^_`{|}~":
        kinds[ord(s)] = SYMBOL
    return kinds


def features(text: str) -> list[float]:
    """Features of one whole text, in the order of ``NAMES``."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = char_kinds()[points]
    counts = np.bincount(kinds, minlength=7)
    n = max(len(text), 1)
    marks = kinds == SYMBOL
    runs = float((marks[1:] & marks[:-1]).sum())
    words = text.split()
    m = max(len(words), 1)
    lines = [x for x in text.split("\n") if x]
    k = max(len(lines), 1)
    repeated = sum(map(str.__eq__, words, words[1:]))
    return [*(counts / n), runs / n, float(np.log1p(len(words))), sum(map(len, words)) / m,
            len(set(words)) / m, repeated / m, sum(map(str.isupper, words)) / m,
            1 - sum(map(str.isalpha, words)) / m, sum(len(x) < 20 for x in lines) / k, len(set(lines)) / k,
            float(np.log1p(len(lines))), sum(len(w) > 20 for w in words) / m,
            len(set(zip(words, words[1:]))) / m, sum(x.endswith((".", "!", "?")) for x in lines) / k]


@dataclass
class Model:
    """Weights over standardised features and their hinges at training quantiles."""

    centre: np.ndarray
    scale: np.ndarray
    knots: np.ndarray
    weights: np.ndarray
    cut: float
    slope: float

    def expand(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.centre) / self.scale, -8, 8)
        hinges = np.maximum(z[:, :, None] - self.knots[None], 0).reshape(len(z), -1)
        return np.hstack([z, hinges])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.expand(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        shift = np.log(CUT_SCORE / (1 - CUT_SCORE))
        z = np.clip(self.slope * (self.raw(x) - self.cut) + shift, -35, 35)
        return 1 / (1 + np.exp(-z))


def fit_pairs(x: np.ndarray, y: np.ndarray, seed: int = 7, rounds: int = 25) -> Model | None:
    """Newton steps on the Bradley-Terry loss of (good, bad) pairs; None without both labels."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return None
    centre, scale = x.mean(0), x.std(0)
    scale = np.where(scale < 1e-9, 1.0, scale)
    z = np.clip((x - centre) / scale, -8, 8)
    model = Model(centre, scale, np.quantile(z, KNOTS, axis=0).T, np.zeros(0), 0.0, 1.0)
    wide = model.expand(x)
    rng = np.random.default_rng(seed)
    # Every good row is in some pair, every bad row in at least PAIRS_PER_BAD.
    losers = np.concatenate([np.repeat(bad, PAIRS_PER_BAD), rng.choice(bad, len(good))])
    winners = np.concatenate([rng.choice(good, len(bad) * PAIRS_PER_BAD), good])
    gram, w = None, np.zeros(wide.shape[1])
    for _ in range(rounds):
        gradient, gram = RIDGE * len(winners) * w, RIDGE * len(winners) * np.eye(len(w))
        for low in range(0, len(winners), 20_000):
            d = wide[winners[low:low + 20_000]] - wide[losers[low:low + 20_000]]
            p = 1 / (1 + np.exp(np.clip(d @ w, -35, 35)))
            gradient -= d.T @ p
            gram += (d * (p * (1 - p))[:, None]).T @ d
        step = np.linalg.solve(gram, gradient)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    model.weights = w
    raw = np.sort(wide @ w)
    # The quantile lies between the scores on either side of the share of bad labels.
    at = min(len(bad), len(raw) - 1)
    model.cut = float((raw[at] + raw[max(at - 1, 0)]) / 2)
    spread = float(np.median(wide[good] @ w) - np.median(wide[bad] @ w))
    model.slope = 4.0 / spread if spread > 1e-9 else 1.0
    return model


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def labelled(labels: DataFrame, label: str = "quality", limit: int = MAX_LABELLED) -> list[tuple[int, int]]:
    """At most ``limit`` (doc_id, label) of the training part: the smallest hashes of doc_id."""
    part = (labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id")))
            .groupBy("doc_id").agg(F.min(label).alias("y"))
            .orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit))
    return [(r["doc_id"], int(r["y"])) for r in part.collect()]


def feature_columns(df: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    def make():
        def work(texts: list[str]) -> dict[str, pa.Array]:
            return {"features": pa.array([features(t) for t in texts], pa.list_(pa.float64()))}
        return work
    return per_text(df, keep, text, "features array<double>", make)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", limit: int = MAX_LABELLED) -> Model | None:
    """Fits on at most ``limit`` labelled documents (their ids go out as a bounded broadcast)."""
    known = labelled(labels, label, limit)
    if not known:
        return None
    ids = docs.sparkSession.createDataFrame(known, "doc_id bigint, y int")
    # Of several texts of one doc_id the one of the smallest digest, whatever the partitions.
    text = F.coalesce(F.col("text"), F.lit(""))
    texts = (docs.select("doc_id", text.alias("text")).join(F.broadcast(ids), "doc_id")
             .groupBy("doc_id", "y").agg(F.min_by("text", F.sha2("text", 256)).alias("text")))
    rows = feature_columns(texts, ["doc_id", "y"]).collect()
    if not rows:
        return None
    rows.sort(key=lambda r: r["doc_id"])
    return fit_pairs(np.array([r["features"] for r in rows]), np.array([r["y"] for r in rows]))


def classify(docs: DataFrame, model: Model | None, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """``keep`` (default: all columns but the text), ``score`` and ``predicted``."""
    keep = [c for c in docs.columns if c != text] if keep is None else keep

    def make():
        def work(texts: list[str]) -> dict[str, pa.Array]:
            if model is None:
                made = np.full(len(texts), CUT_SCORE)
            else:
                made = model.score(np.array([features(t) for t in texts]))
            return {"score": pa.array(made, pa.float64()),
                    "predicted": pa.array((made >= CUT_SCORE).astype(np.int32), pa.int32())}
        return work

    return per_text(docs, keep, text, "score double, predicted int", make)


def accepted(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """The rows that the model predicts to be good, with all their columns."""
    plain, new = plain_names(docs)
    return own_names(classify(plain, model, list(new.values()), new[text]).filter("predicted = 1"), new)


def op7_quality_scores(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = train(docs, read(spark, sf_dir, "labels"))
    return (classify(docs, model, ["doc_id"])
            .select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"),
                    "score", "predicted"))
