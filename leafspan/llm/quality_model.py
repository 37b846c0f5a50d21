"""Quality classifier: ordinal cumulative-link regression on graded ratings.

Grades 0 < 1 < 2 (toxic, poor, good) share one weight for each hashed feature and differ in ordered thresholds: P(grade > j) =
logistic(score - threshold j). The score gives an expected grade and the tail probability of the top grade, by which rows are selected.
Features of a text are its lower-cased words and the shapes of its tokens (AAA!! → A!), each with the square root of its share, and the share
of words that repeat the one before; so a score does not depend on length. The model is fitted on the driver, on a bounded sample of labelled rows; scoring
is one pass over all rows without a shuffle.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

BITS = 18
#: bytes → lower-case letters and everything beyond ASCII, else a space; and bytes → their class.
WORD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
SHAPE = bytes(65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b >= 128 else 48 if 48 <= b <= 57 else 32 if 9 <= b <= 13 else b for b in range(256))
_again = re.compile(rb"(.)\1+", re.S).sub


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and values of a text's features; none without words or other tokens."""
    data = text.encode() if text else b""
    words = data.translate(WORD).split()
    shapes = _again(rb"\1", data.translate(SHAPE)).split()
    found = []
    for mark, tokens in ((0, words), (1, shapes)):
        if tokens:
            counts = Counter(tokens)
            found += [(zlib.crc32(t, mark) & (1 << BITS) - 1, (k / len(tokens)) ** 0.5) for t, k in counts.items()]
            if not mark and (echoes := sum(map(bytes.__eq__, words, words[1:]))):
                found.append((zlib.crc32(b"echoes", 2) & (1 << BITS) - 1, (echoes / len(words)) ** 0.5))
    at, value = zip(*found) if found else ((), ())
    return np.array(at, np.int64), np.array(value, np.float32)


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    thresholds: np.ndarray

    def score(self, text: str | None) -> float:
        at, value = features(text)
        return float(self.weights[at] @ value)

    def tails(self, score: float) -> list[float]:
        """P(grade > j) for each threshold; falling, as thresholds rise."""
        return (1 / (1 + np.exp(np.clip(self.thresholds - score, -50, 50)))).tolist()


def _telling(at: np.ndarray, row: np.ndarray, y: np.ndarray, size: int) -> np.ndarray:
    """For each bucket the chi-squared statistic of its presence against the grades."""
    pair = np.unique(row * np.int64(1 << BITS) + at)
    table = np.zeros((size + 1, 1 << BITS))
    np.add.at(table, (y[pair >> BITS], pair & (1 << BITS) - 1), 1)
    rows = np.bincount(y, minlength=size + 1)[:, None]
    share = table.sum(0) / max(1, len(y))
    expected = rows * share
    spread = np.maximum(expected * (1 - share), 1e-9)
    return np.where(rows > 0, (table - expected) ** 2 / spread, 0).sum(0)


def cuts(free: np.ndarray) -> np.ndarray:
    """Thresholds from the first of them and the logs of the steps to the next, so that they stay ordered."""
    return free[0] + np.concatenate(([0.0], np.cumsum(np.exp(free[1:]))))


def gradient(w: np.ndarray, free: np.ndarray, at: np.ndarray, value: np.ndarray, row: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float) -> np.ndarray:
    """Of the weighted negative log likelihood with the penalty, by weights and then by free. Entry k of at and value is a feature of row[k]."""
    size = len(free)
    score = np.bincount(row, w[at] * value, len(y))
    odds = 1 / (1 + np.exp(np.clip(cuts(free) - score[:, None], -50, 50)))
    above = np.concatenate((np.ones((len(y), 1)), odds, np.zeros((len(y), 1))), 1)
    mine = np.arange(len(y))
    low, high = above[mine, y], above[mine, y + 1]
    likely = np.maximum(low - high, 1e-9)
    d_low, d_high = low * (1 - low) / likely, high * (1 - high) / likely
    d_score = -weight * (d_low - d_high)
    d_cut = np.zeros(size + 2)
    np.add.at(d_cut, y, weight * d_low)
    np.add.at(d_cut, y + 1, -weight * d_high)
    d_cut = d_cut[1:-1]
    d_free = [d_cut.sum(), *(np.exp(free[k]) * d_cut[k:].sum() for k in range(1, size))]
    return np.concatenate((np.bincount(at, d_score[row] * value, len(w)) + penalty * w, d_free))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], grades: list[int], steps: int = 300, rate: float = 0.3, penalty: float = 2e-5, least_chi2: float = 25.0) -> Model:
    """The weights and ordered thresholds that make the grades of some texts' features likely. Grades weigh by the root of their rarity. Features whose
    presence does not differ between grades (chi-squared under least_chi2) get no weight, as they would only learn single rows by heart."""
    size = max(grades)
    y = np.array(grades, np.int64)
    at, value = (np.concatenate([r[k] for r in rows]) for k in range(2))
    row = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    keep = _telling(at, row, y, size) >= least_chi2
    at, value, row = at[keep[at]], value[keep[at]], row[keep[at]]
    used, at = np.unique(at, return_inverse=True)
    weight = np.sqrt(len(y) / np.maximum(1, np.bincount(y, minlength=size + 1)))[y]
    weight = weight / weight.sum()
    w, free = np.zeros(len(used)), np.concatenate(([-1.0], np.zeros(max(1, size) - 1)))
    m, v = np.zeros(len(w) + len(free)), np.zeros(len(w) + len(free))
    for t in range(1, steps + 1) if size else ():
        slope = gradient(w, free, at, value, row, y, weight, penalty)
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, free = w - step[: len(w)], free - step[len(w) :]
    weights = np.zeros(1 << BITS, np.float32)
    weights[used] = w
    return Model(weights, cuts(free))


def grade(quality: Column, toxic: Column) -> Column:
    """0 toxic, 1 poor, 2 good."""
    return F.when(toxic == 1, 0).when(quality == 0, 1).otherwise(2)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_rows: int = 5000, most_texts: int = 10_000, **how) -> Model:
    """Fit on at most most_rows labelled ids, those whose hashes are lowest, and at most most_texts different texts of theirs, in the same order; whole
    texts, of which the driver gets the features only.

    Null ids and labels are left out; an id labelled twice counts with its lowest grade; of rows with the same id and text one is an example. Without
    examples every weight is zero, and rows count as good.
    """
    common.ship(docs.sparkSession)
    known = labels.where(labels[id_col].isNotNull() & labels["quality"].isNotNull() & labels["toxic"].isNotNull())
    known = known.groupBy(known[id_col].alias("label_id")).agg(F.min(grade(F.col("quality"), F.col("toxic"))).alias("grade"))
    known = known.orderBy(F.xxhash64("label_id"), "label_id").limit(most_rows)
    own = common.texts(docs, id_col, text_col).join(F.broadcast(known), F.col("id") == F.col("label_id"))
    chosen = own.select("id", "text", "grade").dropDuplicates().orderBy(F.xxhash64("id"), "id", "text").limit(most_texts)

    def featured(batches):
        for batch in batches:
            for part in common.pieces(batch):
                found = [features(t) for t in part.column(0).to_pylist()]
                yield pa.record_batch([pa.array([a.tobytes() for a, _ in found], pa.binary()), pa.array([v.tobytes() for _, v in found], pa.binary()), part.column(1)], names=["at", "value", "grade"])

    rows = [(np.frombuffer(bytes(r[0]), np.int64), np.frombuffer(bytes(r[1]), np.float32), r[2]) for r in chosen.select("text", "grade").mapInArrow(common.thrifty(featured), "at binary, value binary, grade int").toLocalIterator()]
    return fit([r[:2] for r in rows], [r[2] for r in rows], **how) if rows else Model(np.zeros(1 << BITS, np.float32), np.array([-2.0, -1.0]))


def score(docs: DataFrame, model: Model, carry: Column | str = "doc_id", text_col: str = "text", name: str = "doc_id", least: float = 0.5) -> DataFrame:
    """One row for each row of docs: carry under name, expected_grade, tail (probability of the top grade), kept (tail >= least).

    Whole texts; null is empty and scored as having no features. Repeated rows stay repeated; a null id stays null; other columns are not read;
    an empty table gives an empty one. A text's words are held as one list, so the longest must fit in a worker.
    """
    common.ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast((model.weights, model.thresholds))
    df = docs.select((F.col(common.quoted(carry)) if isinstance(carry, str) else carry).alias("carry"), docs[text_col].alias("text"))

    def scored(batches):
        own = Model(*sent.value)
        for batch in batches:
            for part in common.pieces(batch):
                tails = [own.tails(own.score(t)) for t in part.column(1).to_pylist()]
                yield pa.record_batch([part.column(0), pa.array([sum(t) for t in tails], pa.float64()), pa.array([t[-1] for t in tails], pa.float64()), pa.array([t[-1] >= least for t in tails], pa.bool_())], names=["carry", "expected_grade", "tail", "kept"])

    kind = T.StructType([df.schema["carry"], T.StructField("expected_grade", T.DoubleType()), T.StructField("tail", T.DoubleType()), T.StructField("kept", T.BooleanType())])
    return df.mapInArrow(common.thrifty(scored), kind).withColumnRenamed("carry", name)


def keep_good(docs: DataFrame, model: Model, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """docs, all its columns, without the rows that the model rejects.

    Null and empty texts have no features and are judged by the thresholds alone; repeated rows stay repeated; an empty table stays empty. Columns may
    have any names, dots too, but none that differ by case only, which Spark itself cannot tell apart.
    """
    return score(docs, model, common.whole(docs), text_col, "row", least).where("kept").select("row.*")
