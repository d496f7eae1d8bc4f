"""Toxicity by a classifier chain.

The categories are predicted one after the other; the model of each category
also takes the logits of the earlier ones. In training those come from models
fitted on the other folds, so a later model learns how far an earlier one can be
trusted on texts it has not seen; the models that score are fitted on the whole
sample. The label table has two judgements, so the chain runs over them: low
quality first, then toxic.

Defined results: null text counts as empty; labels that are null or have no
document are left out; without labels every probability is that of an
uninformed model (one half); repeated rows are repeated, and one text of a labelled
doc_id that several rows share is learnt from; very long texts are read whole, one at a time; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, whole
from .linear import FOLDS, SAMPLE, Linear, SHAPES, Sample, fit, fold_of, sampled, shape, sigmoid, stems

#: (category, label column, label value that means the category).
CATEGORIES = (("low_quality", "quality", 0), ("toxic", "toxic", 1))


def train_chain(data: Sample, categories: tuple = CATEGORIES) -> list[Linear]:
    """One model per category; each takes the out-of-fold logits of those before it."""
    fold, every = fold_of(data.doc_id), np.arange(len(data))
    extra, chain = np.zeros((len(data), 0)), []
    for i, (_, column, value) in enumerate(categories):
        y = (data.labels[column] == value).astype(np.float64)
        chain.append(fit(data, every, extra, y)[0])
        if i + 1 < len(categories):
            held = np.zeros(len(data))
            for k in range(FOLDS):
                out, rest = fold == k, np.flatnonzero(fold != k)
                if out.any() and len(rest):
                    held[out] = np.clip(fit(data, rest, extra, y[rest])[1][out], -8, 8)
            extra = np.hstack([extra, held[:, None]])
    return chain


def chain_logits(chain: list[Linear], texts: pd.Series) -> np.ndarray:
    """Logits of all categories for each text."""
    rows = [shape(t) for t in texts]
    shapes, found = np.array([r[0] for r in rows]).reshape(len(rows), SHAPES), [stems(r[1]) for r in rows]
    extra = np.zeros((len(rows), 0))
    for model in chain:
        z = model.logit(shapes, found, extra)
        extra = np.hstack([extra, np.clip(z, -8, 8)[:, None]])
    return extra


def toxicity(docs: DataFrame, labels: DataFrame, categories: tuple = CATEGORIES, sample: int = SAMPLE, threshold: float = 0.5) -> DataFrame:
    """Per document: doc_id, p_<category> of each category, and whether it has the last one."""
    arrow_rows(docs.sparkSession)
    rows = sampled(docs, labels, [c for _, c, _ in categories], sample)
    chain = train_chain(rows, categories) if len(rows) else None
    names = [name for name, _, _ in categories]

    @F.pandas_udf(", ".join(f"{n} double" for n in names))
    def scored(text: pd.Series) -> pd.DataFrame:
        z = chain_logits(chain, text) if chain else np.zeros((len(text), len(names)))
        return pd.DataFrame(sigmoid(z), columns=names)

    out = docs.select("doc_id", scored(whole("text")).alias("p"))
    return out.select("doc_id", *(F.col(f"p.{n}").alias(f"p_{n}") for n in names), (F.col(f"p.{names[-1]}") >= threshold).alias(names[-1]))
