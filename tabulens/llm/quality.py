"""Text quality by naive Bayes support vectors.

A text is the set of its n-grams: byte n-grams of the whole UTF-8 text and n-grams of word
classes (case, trailing signs, repeated word). Each indicator is scaled by the log-count ratio of
its class counts, and a linear hinge-loss model is fitted by dual coordinate descent. A logistic
curve over held-back margins turns the margin into a score.

The model is fitted in one task on at most ``fit_rows`` labelled rows, those first in hash order,
of which it gets the n-gram sets (SLOTS numbers at most each); scoring covers every whole text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from tabulens.llm.common import documents

FIT_ROWS = 6000
SLOTS = 1 << 18
SMOOTHING = 1.0
COST = 1.0
PASSES = 30
THRESHOLD = 0.3
SEED = 11


def _slot(values: np.ndarray, salt: int) -> np.ndarray:
    """Hash of integers into the slots."""
    mixed = (values.astype(np.uint64) + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(46)).astype(np.int64)


def word_classes(data: bytes) -> np.ndarray:
    """A small number for each word: first and last letter's kind, length, whether it repeats the word before."""
    words = data.split()
    if not words:
        return np.zeros(0, np.uint64)
    first = np.frombuffer(b"".join(w[:1] for w in words), np.uint8)
    last = np.frombuffer(b"".join(w[-1:] for w in words), np.uint8)
    size = np.minimum(np.fromiter(map(len, words), np.int64, len(words)), 15)
    again = np.r_[False, np.fromiter((a == b for a, b in zip(words, words[1:])), bool, len(words) - 1)]
    kind = KIND[first].astype(np.uint64) * 8 + KIND[last]
    return kind * 64 + (size // 4).astype(np.uint64) * 2 + again


KIND = np.full(256, 6, np.uint8)  # other signs
KIND[48:58] = 1
KIND[65:91] = 2
KIND[97:123] = 3
KIND[128:] = 4
KIND[[33, 44, 46, 63]] = 5  # ! , . ?


def features(text: str) -> np.ndarray:
    """Sorted slots of the n-grams of a text; a few for the empty text, which has its edges only."""
    data = b"\x02" + text.encode() + b"\x03"
    hit = np.zeros(SLOTS, bool)
    b = np.frombuffer(data, np.uint8).astype(np.uint32)
    gram = b
    for n in (1, 2, 3):
        if n > 1:
            gram = (gram[:-1] << np.uint32(8)) | b[n - 1 :]
        hit[_slot(gram, n << 40)] = True
    c = word_classes(data)
    gram = c
    for n in (1, 2, 3):
        if n > 1:
            gram = gram[:-1] * np.uint64(1024) + c[n - 1 :]
        hit[_slot(gram, n << 50)] = True
    return np.flatnonzero(hit).astype(np.int32)


def log_count_ratios(rows: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """log of (smoothed share of the indicator in class 1 / in class 0) for each slot."""
    counts = []
    for label in (1, 0):
        own = [r for r, y in zip(rows, labels) if y == label]
        n = np.bincount(np.concatenate(own), minlength=SLOTS) + SMOOTHING if own else np.full(SLOTS, SMOOTHING)
        counts.append(np.log(n / n.sum()))
    return counts[0] - counts[1]


def dual_descent(rows: list[np.ndarray], labels: np.ndarray, scale: np.ndarray, cost: float = COST, passes: int = PASSES) -> tuple[np.ndarray, float]:
    """Weights of the hinge-loss model over rows of scaled indicators, each of length 1; and the bias.

    One dual variable per row, within [0, cost of its class]; a step moves one to its optimum
    while the others stay. The rarer class weighs more by the square root of the imbalance.
    """
    rng = np.random.default_rng(SEED)
    y = np.where(labels == 1, 1.0, -1.0)
    share = np.bincount(labels, minlength=2) / max(1, len(labels))
    upper = cost / np.sqrt(np.maximum(share, 1e-3))[labels]
    values = [scale[r] / max(1e-12, np.sqrt((scale[r] ** 2).sum())) for r in rows]
    alpha, w, bias = np.zeros(len(rows)), np.zeros(SLOTS), 0.0
    for _ in range(passes):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            gradient = y[i] * (w[rows[i]] @ values[i] + bias) - 1.0
            new = min(max(alpha[i] - gradient / 2.0, 0.0), upper[i])  # length 1, and 1 for the bias
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[rows[i]] += step * values[i]
                bias += step
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w, bias


@dataclass
class Model:
    scale: np.ndarray  # log-count ratios
    weight: np.ndarray  # scale times the weight of the linear model
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def margin(self, slots: np.ndarray) -> float:
        length = np.sqrt((self.scale[slots] ** 2).sum())
        return float(self.weight[slots].sum() / max(length, 1e-12) + self.bias)

    def score(self, text: str) -> float:
        return float(1.0 / (1.0 + np.exp(-np.clip(self.slope * self.margin(features(text)) + self.shift, -35, 35))))


def _margin_model(rows, labels) -> Model:
    scale = log_count_ratios(rows, labels)
    w, bias = dual_descent(rows, labels, scale)
    return Model(scale, scale * w, bias)


def logistic_curve(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the curve of smallest log loss, by Newton steps with a small ridge."""
    x, beta = np.column_stack([margins, np.ones(len(margins))]), np.array([1.0, 0.0])
    n1, n0 = labels.sum(), len(labels) - labels.sum()
    target = np.where(labels == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -35, 35)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, x.T @ (p - target) + 1e-3 * (beta - [1.0, 0.0]))
        beta = beta - step
        if np.abs(step).max() < 1e-8:
            break
    return float(max(beta[0], 1e-3)), float(beta[1])


def fit_rows_of(rows: list[np.ndarray], labels: np.ndarray) -> Model:
    """Fit on feature rows in the given order; without both classes every text scores the class share."""
    labels = np.asarray(labels, np.int64)
    if len(set(labels.tolist())) < 2:
        share = float(np.clip(labels.mean() if len(labels) else 0.5, 0.01, 0.99))
        return Model(np.zeros(SLOTS), np.zeros(SLOTS), 0.0, 1.0, float(np.log(share / (1 - share))))
    folds, margins = np.arange(len(rows)) % 3, np.zeros(len(rows))
    for k in range(3):
        inside = np.flatnonzero(folds != k)
        if len(set(labels[inside].tolist())) < 2:
            continue
        part = _margin_model([rows[i] for i in inside], labels[inside])
        for i in np.flatnonzero(folds == k):
            margins[i] = part.margin(rows[i])
    model = _margin_model(rows, labels)
    model.slope, model.shift = logistic_curve(margins, labels)
    return model


@F.pandas_udf(BinaryType())
def _feature_bytes(texts: pd.Series) -> pd.Series:
    return pd.Series([features(t).tobytes() for t in texts], dtype=object)


def fit(
    df: DataFrame,
    labels: DataFrame,
    label_col: str = "quality",
    fit_rows: int = FIT_ROWS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> Model:
    """Fit on the documents of the ``fit_rows`` label rows first in the hash order of their id.

    Labels other than 0 and 1 and labels without a document are not used; contradicting labels of
    one id are used as they stand. The chosen label rows, at most ``fit_rows``, are broadcast.
    """
    key = labels[f"`{id_col}`"].cast("bigint")
    chosen = labels.where(key.isNotNull() & labels[f"`{label_col}`"].isin(0, 1)).select(
        key.alias("doc_id"), labels[f"`{label_col}`"].cast("int").alias("label"), F.xxhash64(key.cast("string")).alias("h")
    ).distinct().orderBy("h", "doc_id", "label").limit(fit_rows)
    rows = documents(df, id_col, text_col).join(F.broadcast(chosen), "doc_id").select(
        "h", "doc_id", "label", _feature_bytes("text").alias("slots"), F.lit(1).alias("all")
    )

    def train(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["h", "doc_id", "label", "slots"])
        m = fit_rows_of([np.frombuffer(x, np.int32) for x in pdf["slots"]], pdf["label"].to_numpy())
        return pd.DataFrame({
            "scale": [m.scale.tobytes()], "weight": [m.weight.tobytes()],
            "bias": [m.bias], "slope": [m.slope], "shift": [m.shift],
        })

    schema = "scale binary, weight binary, bias double, slope double, shift double"
    found = rows.groupBy("all").applyInPandas(train, schema).collect()
    if not found:
        return fit_rows_of([], np.zeros(0, np.int64))
    r = found[0]
    return Model(np.frombuffer(r.scale), np.frombuffer(r.weight), r.bias, r.slope, r.shift)


def score_of(model: Model, text):
    """Column of scores of a text column; NULL counts as empty."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([model.score(t) for t in texts], dtype="float64")

    return score(F.coalesce(text, F.lit("")))


def scored(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score): every whole text; the empty text is scored like any other, from the few
    n-grams of its edges. An empty table gives no rows, repeated rows repeat."""
    return documents(df, id_col, text_col).select("doc_id", score_of(model, F.col("text")).alias("score"))
