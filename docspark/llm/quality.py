"""A quality classifier: regularised quadratic discriminant over transformed document statistics.

Each text becomes a vector of statistics, transformed to be nearly normal. Each class has a mean and a covariance, from
sums added up in two levels over the labelled rows, shrunk towards its scaled diagonal. A text's score is the logistic
of the difference of the two log densities, from Mahalanobis distances by the classes' inverse Cholesky factors, which
are computed once and kept with the model.

The statistics are those commonly used to tell prose from what is not: length, shares of upper case, digits, symbols,
sentence marks and white space, words without a letter or digit or that end in other marks than those of sentences,
repeated words and lines, and how many words are distinct, short or one character long.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.llm.common import Scratch, turn

#: Weight of the diagonal in a class covariance, and of the pooled variances' diagonal added to it; observations by which
#: proportions are smoothed. Chosen together by ``cross_validate`` on rows that are not held out.
SHRINK, RIDGE, SMOOTH = 0.05, 0.05, 50.0
#: Labelled rows that a model is fitted on at most, those with the least hashes of their ids.
MOST_LABELLED = 100_000
#: Rows of partial sums that reach the driver at most, for each class.
SUM_GROUPS = 32
LOG_SPAN = 30.0
FEATURES = (
    "log_words", "word_length", "upper", "digit", "symbol", "stop_marks", "no_letters", "bang", "mark_ends", "repeat_next",
    "distinct", "top_word", "line_words", "line_repeat", "single", "short_words", "non_ascii", "space",
)
_UPPER, _DIGIT, _SYMBOL, _BANG = (re.compile(p) for p in ("[A-ZÀ-ÖØ-Þ]", "[0-9]", r"[#$%&*@^~<>{}\[\]\\|_=+/]", "!"))
_ALNUM = re.compile(r"[^\W_]")
_ENDS = re.compile(r"[#$%&*!|@^~]+(?=\s|$)")


def share(n: float, of: float, usual: float = 0.0, weight: float = SMOOTH) -> float:
    """A proportion on the square-root scale, where small counts vary alike, smoothed as if ``weight`` more observations
    had shown the ``usual`` one: a text of a few words says little."""
    return math.sqrt((n + usual * weight) / (of + weight))


def statistics(text: str) -> list[float]:
    """The vector of one whole text; an empty one gives zeros."""
    words = text.split()
    n, chars = len(words), len(text)
    if not n:
        return [0.0] * len(FEATURES)
    letters = sum(map(len, words))
    lines = text.split("\n")
    counts = Counter(words)
    upper, digits = len(_UPPER.findall(text)), len(_DIGIT.findall(text))
    again = sum(map(str.__eq__, words, words[1:]))
    filled = [x for x in lines if x]
    return [
        math.log(n + SMOOTH),
        math.log((letters + 5 * SMOOTH) / (n + SMOOTH)),
        share(upper, letters, 0.03, 5 * SMOOTH),
        share(digits, letters, 0.0, 5 * SMOOTH),
        share(len(_SYMBOL.findall(text)), letters, 0.0, 5 * SMOOTH),
        share(text.count(".") + text.count(","), n, 0.15),
        share(sum(k for w, k in counts.items() if not (w[0].isalnum() or _ALNUM.search(w))), n),
        share(len(_BANG.findall(text)), n),
        share(len(_ENDS.findall(text)), n),
        share(again, n),
        math.log((len(counts) + SMOOTH) / (n + SMOOTH)) / math.log(n + SMOOTH),
        share(max(counts.values()) - 1, n, 0.04),
        math.log((n + SMOOTH) / (len(lines) + SMOOTH / 20)),
        share(len(filled) - len(set(filled)), len(lines), 0.0, 3.0),
        share(sum(len(w) == 1 for w in counts), len(counts)),
        share(sum(len(w) <= 4 for w in words), n, 0.4),
        share(len(text.encode()) - chars, chars, 0.01, 5 * SMOOTH),
        share(chars - letters - n + 1, n),
    ]


@dataclass
class Model:
    """Class means, inverse Cholesky factors and log determinants; ``prior`` is the log odds of label 1."""

    means: np.ndarray
    factors: np.ndarray
    logdets: np.ndarray
    prior: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not len(self.means):
            return np.full(len(x), 1 / (1 + math.exp(-self.prior)))
        density = [-0.5 * (((x - m) @ f.T) ** 2).sum(1) - 0.5 * d for m, f, d in zip(self.means, self.factors, self.logdets, strict=True)]
        return 1 / (1 + np.exp(-np.clip(density[1] - density[0] + self.prior, -LOG_SPAN, LOG_SPAN)))


def fit_sums(n: np.ndarray, sums: np.ndarray, outer: np.ndarray, shrink: float = SHRINK, ridge: float = RIDGE) -> Model:
    """A model from each class's row count, sum of vectors and sum of outer products.

    With fewer than two rows of either class the model is the smoothed share of label 1 alone.
    """
    prior = math.log((n[1] + 0.5) / (n[0] + 0.5))
    if min(n) < 2:
        return Model(np.zeros((0, 0)), np.zeros((0, 0, 0)), np.zeros(0), prior)
    means = sums / n[:, None]
    covs = outer / n[:, None, None] - means[:, :, None] * means[:, None, :]
    pooled = np.maximum(np.diagonal((covs * n[:, None, None]).sum(0) / n.sum()), 1e-9)
    factors, logdets = [], []
    for c in covs:
        c = (1 - shrink) * c + shrink * np.diag(np.maximum(np.diagonal(c), 0)) + ridge * np.diag(pooled)
        low = np.linalg.cholesky(c)
        factors.append(np.linalg.inv(low))
        logdets.append(2 * np.log(np.diagonal(low)).sum())
    return Model(means, np.array(factors), np.array(logdets), prior)


def vectors(texts: list[str | None]) -> np.ndarray:
    """A row a text; null counts as empty. In single precision, as they would be stored."""
    return np.array([statistics(t or "") for t in texts], dtype=np.float32).astype(np.float64).reshape(-1, len(FEATURES))


def cross_validate(x: np.ndarray, y: np.ndarray, fold: np.ndarray, shrink: float, ridge: float) -> tuple[float, int]:
    """Mean log loss and errors over rows that are each judged by the model of the other folds' rows."""
    loss, errors = 0.0, 0
    for f in np.unique(fold):
        own = [x[(fold != f) & (y == c)] for c in (0, 1)]
        model = fit_sums(np.array([len(o) for o in own], float), np.array([o.sum(0) for o in own]), np.array([o.T @ o for o in own]), shrink, ridge)
        p, t = np.clip(model.scores(x[fold == f]), 1e-9, 1 - 1e-9), y[fold == f]
        loss -= float((t * np.log(p) + (1 - t) * np.log(1 - p)).sum())
        errors += int(((p >= 0.5) != t).sum())
    return loss / len(y), errors


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = MOST_LABELLED) -> Model:
    """Fit on the texts of the rows that ``labels`` names and that are not held out, ``most`` of them at most.

    Labels other than 0 and 1, null ids and ids without a text are left out; a label or text that repeats counts each
    time. The labelled rows are few enough to be sent to the scan of texts, so that no text is shuffled.
    """
    d = len(FEATURES)
    y = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col))
    y = y.select(F.col(id_col).alias("labelled"), F.col(label_col).cast("int").alias("label")).orderBy(F.xxhash64("labelled"), "labelled", "label").limit(most)
    y = Scratch(spark, "quality").save(y, "labelled")

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        turn("quality")
        n, s, o = np.zeros(2), np.zeros((2, d)), np.zeros((2, d, d))
        for b in batches:
            own = b.column(0).to_numpy(zero_copy_only=False)
            x = vectors(b.column(1).to_pylist())
            for c in (0, 1):
                m = x[own == c]
                n[c] += len(m)
                s[c] += m.sum(0)
                o[c] += m.T @ m
        if n.any():
            group = TaskContext.get().partitionId() % SUM_GROUPS
            yield pa.RecordBatch.from_pydict({"g": [group] * 2, "label": [0, 1], "sums": [np.concatenate([[n[c]], s[c], o[c].ravel()]).tolist() for c in (0, 1)]})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = 0
        for v in pdf["sums"]:
            total = total + v
        return pd.DataFrame({"g": [pdf["g"].iloc[0]], "label": [pdf["label"].iloc[0]], "sums": [total]})

    kind = "g long, label long, sums array<double>"
    texts = docs.select(F.col(id_col).alias("own"), F.col(text_col).alias("text")).join(F.broadcast(y), F.col("own") == F.col("labelled")).select("label", "text")
    rows = texts.mapInArrow(partial, kind).groupBy("g", "label").applyInPandas(add, kind).collect()  # SUM_GROUPS rows a class
    total = np.zeros((2, 1 + d + d * d))
    for r in rows:
        total[r["label"]] += np.array(r["sums"])
    return fit_sums(total[:, 0], total[:, 1 : 1 + d], total[:, 1 + d :].reshape(2, d, d))


def classify(spark: SparkSession, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, score (0 to 1), predicted (1 if score >= 0.5).

    Labels are learnt only from rows that are not held out, as ``fit`` says. Null and empty texts have the vector of zeros and its
    score. A row without an id is scored and never learnt from; rows that repeat an id are scored each. Without labels
    of both classes every row gets the share of label 1 (0.5 without any). An empty table gives no rows.
    """
    model = fit(spark, docs, labels, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn("quality")
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.scores(vectors(b.column(1).to_pylist())))], ["doc_id", "score"])

    out = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {dict(docs.dtypes)[id_col]}, score double")
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(spark: SparkSession, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, all columns as they are, whatever they are called.

    The model is fitted as in ``classify``; the decision is taken row by row beside the text, without a join.
    """
    model, at = fit(spark, docs, labels, id_col, text_col), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn("quality")
        for b in batches:
            yield b.filter(pa.array(model.scores(vectors(b.column(at).to_pylist())) >= 0.5, pa.bool_()))

    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))  # names with dots do not reach Python
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


def query(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    return classify(spark, docs, labels)
