"""Small linear models over texts: features, selection and logistic regression in numpy.

Models are fitted on the driver from at most ``SAMPLE`` labelled documents (the
ones with the least hash of doc_id, so reruns agree) and ship as a closure whose
size is bounded by ``FEATURES``; scoring reads every document whole. Which stems a
fit may choose is found by Spark from sums per stem; only those come to the driver, at most
``FEATURES`` per label and set of folds, however long the labelled texts are.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, whole

SAMPLE, FEATURES, FOLDS = 8000, 384, 5
#: A stem is a feature if it is in so many documents, and its shares in the classes lie so many standard errors apart.
LEAST, APART = 5, 4
#: Measures of form that ``shape`` takes.
SHAPES = 12
#: Punctuation that is cut off a word's ends before it becomes a feature.
EDGE = ".,;:!?#*$%&|<>\"'()[]"
_MARKS = "!?#*$%&|<>@=_"


def shape(text: str) -> tuple[np.ndarray, set[str]]:
    """Measures of form in 0 to 1, and the set of words."""
    words = text.split()
    n, chars = max(1, len(words)), max(1, len(text))
    distinct = set(words)
    lines = [x for x in text.split("\n") if x]
    marks = [text.count(c) for c in _MARKS]
    digits = sum(map(text.count, "0123456789"))
    return (
        np.array(
            [
                min(1.0, np.log1p(len(words)) / 12),
                sum(map(str.isupper, words)) / n,
                min(1.0, sum(marks) / chars * 5),
                min(1.0, marks[0] / n),
                min(1.0, sum(marks[2:7]) / n),
                min(1.0, marks[7] / n * 2),
                min(1.0, digits / chars * 5),
                len(distinct) / n,
                min(1.0, chars / n / 20),
                1 - len(set(lines)) / max(1, len(lines)),
                min(1.0, len(lines) / n * 5),
                min(1.0, sum(map(text.count, ("http", "www", "://"))) / n * 20),
            ]
        ),
        distinct,
    )


def stems(distinct: set[str]) -> set[str]:
    """Lower-case words without edge punctuation, and their first four and five characters, marked as such."""
    plain = {w.strip(EDGE).lower() for w in distinct}
    return plain | {w[:4] + "~" for w in plain if len(w) > 4} | {w[:5] + "~" for w in plain if len(w) > 5}


@dataclass
class Sample:
    """The labelled sample on the driver. ``code`` holds the stems of all documents on end, as places in ``names``."""

    doc_id: np.ndarray
    labels: dict[str, np.ndarray]
    shapes: np.ndarray
    names: pa.Array
    code: np.ndarray
    owner: np.ndarray

    def __len__(self) -> int:
        return len(self.doc_id)


def _candidates(rows: DataFrame, columns: list[str], most: int) -> DataFrame:
    """(stem): those that ``select`` would take for one of the labels on all of ``rows`` (doc_id, labels, fold, stems) or without one fold."""
    sets = [None, *range(FOLDS)]

    def sums(prefix: str) -> list[Column]:
        return [F.sum((F.col("fold") == k).cast("long") * (F.col(c) == 1).cast("long")).alias(f"{prefix}p{i}_{k}") for i, c in enumerate(columns) for k in range(FOLDS)] + [
            F.sum((F.col("fold") == k).cast("long") * (F.col(c) != 1).cast("long")).alias(f"{prefix}n{i}_{k}") for i, c in enumerate(columns) for k in range(FOLDS)]

    total = rows.agg(*sums("t")).first()
    per = rows.select(*columns, "fold", F.explode("stems").alias("stem")).groupBy("stem").agg(*sums("s"))
    scores = []
    for i in range(len(columns)):
        for left_out in sets:
            folds = [k for k in range(FOLDS) if k != left_out]
            pos, neg = (reduce(Column.__add__, [F.col(f"s{w}{i}_{k}") for k in folds]) for w in "pn")
            n1, n0 = (max(1.0, float(sum(total[f"t{w}{i}_{k}"] or 0 for k in folds))) for w in "pn")
            p = F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), (pos + neg) / (n1 + n0)))
            z = F.abs(pos / n1 - neg / n0) / F.sqrt(p * (1 - p) * (1 / n1 + 1 / n0))
            scores.append(F.when((pos + neg >= LEAST) & (z > APART), z))
    found = per.select("stem", F.posexplode(F.array(*scores)).alias("at", "z")).filter("z is not null")
    nth = F.row_number().over(W.partitionBy("at").orderBy(F.desc("z"), "stem"))
    return found.withColumn("nth", nth).filter(F.col("nth") <= most).select("stem").distinct()


def sampled(docs: DataFrame, labels: DataFrame, columns: list[str], sample: int = SAMPLE, most: int = FEATURES) -> Sample:
    """Features and labels of the sample; of their stems, the ones that a fit may choose."""
    scratch = Scratch(docs.sparkSession, "sample")
    chosen = labels.dropna(subset=["doc_id", *columns]).groupBy("doc_id").agg(*(F.max(c).alias(c) for c in columns))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select("doc_id", whole("text").alias("text"))

    @F.pandas_udf("struct<shape: array<double>, stems: array<string>>")
    def featured(text: pd.Series) -> pd.DataFrame:
        rows = [shape(t) for t in text]
        return pd.DataFrame({"shape": [r[0].tolist() for r in rows], "stems": [sorted(stems(r[1])) for r in rows]})

    # At most ``sample`` rows are broadcast. Of rows that share a labelled id one is taken, by its text, before its features are.
    rows = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("mark"), "text")).alias("t"), *(F.first(c).alias(c) for c in columns))
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(FOLDS))
    rows = scratch.keep(rows.select("doc_id", *columns, fold.alias("fold"), featured("t.text").alias("x")).select("doc_id", *columns, "fold", "x.shape", "x.stems"))
    known = scratch.keep(_candidates(rows, columns, most))
    # At most ``most`` stems per label and set of folds are broadcast.
    found = rows.select("doc_id", F.explode("stems").alias("stem")).join(F.broadcast(known), "stem").toArrow().sort_by([("doc_id", "ascending"), ("stem", "ascending")])
    table = rows.select("doc_id", *columns, "shape").toArrow().sort_by("doc_id")
    ids, coded = table["doc_id"].to_numpy(), found["stem"].combine_chunks().dictionary_encode()
    owner = pc.index_in(found["doc_id"], table["doc_id"].combine_chunks()).to_numpy()
    shapes = np.array(table["shape"].to_pylist(), np.float64).reshape(len(table), SHAPES)
    scratch.clear()
    return Sample(ids, {c: table[c].to_numpy() for c in columns}, shapes, coded.dictionary, coded.indices.to_numpy(), owner)


def select(data: Sample, rows: np.ndarray, y: np.ndarray, most: int = FEATURES) -> np.ndarray:
    """Places of the stems whose share differs most between the classes, in standard errors."""
    label = np.full(len(data), -1.0)
    label[rows] = y
    mine = label[data.owner]
    size = len(data.names)
    pos, neg = np.bincount(data.code[mine == 1], minlength=size), np.bincount(data.code[mine == 0], minlength=size)
    n1, n0 = max(1.0, y.sum()), max(1.0, (1 - y).sum())
    p = np.clip((pos + neg) / (n1 + n0), 1e-9, 1 - 1e-9)
    z = np.abs(pos / n1 - neg / n0) / np.sqrt(p * (1 - p) * (1 / n1 + 1 / n0))
    good = np.flatnonzero((pos + neg >= LEAST) & (z > APART))
    return good[np.lexsort((good, -z[good]))[:most]]


@dataclass
class Linear:
    """Logistic regression on [shape, extra, stems in the vocabulary]."""

    vocabulary: dict[str, int]
    weights: np.ndarray
    bias: float

    def matrix(self, shapes: np.ndarray, found: list[set[str]], extra: np.ndarray) -> np.ndarray:
        wide = shapes.shape[1] + extra.shape[1]
        x = np.zeros((len(found), wide + len(self.vocabulary)))
        x[:, : shapes.shape[1]], x[:, shapes.shape[1] : wide] = shapes, extra
        for i, s in enumerate(found):
            x[i, [wide + self.vocabulary[w] for w in self.vocabulary.keys() & s]] = 1.0
        return x

    def logit(self, shapes: np.ndarray, found: list[set[str]], extra: np.ndarray) -> np.ndarray:
        return self.matrix(shapes, found, extra) @ self.weights + self.bias


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(data: Sample, rows: np.ndarray, extra: np.ndarray, y: np.ndarray, ridge: float = 0.1, steps: int = 30) -> tuple[Linear, np.ndarray]:
    """Ridge-penalised maximum likelihood on ``rows`` by Newton's method; also the logits of the whole sample."""
    chosen = select(data, rows, y)
    place = np.full(len(data.names), -1)
    place[chosen] = np.arange(len(chosen))
    wide = data.shapes.shape[1] + extra.shape[1]
    every = np.zeros((len(data), wide + len(chosen) + 1))
    every[:, :wide], every[:, -1] = np.hstack([data.shapes, extra]), 1.0
    at = place[data.code]
    every[data.owner[at >= 0], wide + at[at >= 0]] = 1.0
    x, w = every[rows], np.zeros(every.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6
    if 0 < y.sum() < len(y):
        for _ in range(steps):
            p = sigmoid(x @ w)
            step = np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(penalty), x.T @ (p - y) + penalty * w)
            w -= step
            if np.abs(step).max() < 1e-4:
                break
    elif len(y):
        w[-1] = 5.0 if y.all() else -5.0
    names = data.names.take(pa.array(chosen)).to_pylist()
    return Linear({s: i for i, s in enumerate(names)}, w[:-1], float(w[-1])), every @ w


def fold_of(doc_id: np.ndarray) -> np.ndarray:
    return np.array([zlib.crc32(str(d).encode()) % FOLDS for d in doc_id.tolist()], int)
