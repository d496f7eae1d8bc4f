"""Quality by hierarchical empirical Bayes.

A linear model gives each document's own evidence. Grouped sums of that evidence
give the rates of paths and hosts: a host's rate is shrunk toward the global
rate, a path's toward its host's, with beta priors whose weights come from the
variance between hosts and between the paths of a host (a random-effects
analysis, by moments). A document's posterior log-odds are its own plus its
path's, less the global ones; its own evidence is taken out of its path's sum
first. Sparse sites thus fall back on the global prior.

Defined results: null text counts as empty; null host and path are sites of
their own; without labels everything is kept; repeated rows are repeated; very long
texts are read whole, one at a time; an empty table gives an empty result; other columns
are kept by ``drop_low_quality``, whatever their names, and ignored otherwise.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow_rows, keyed, unkeyed, whole
from .linear import SAMPLE, SHAPES, fit, sampled, shape, sigmoid, stems

#: Weight of a prior where the data show no variance to fit it, and its largest weight.
WEIGHT, MOST = 50.0, 10_000.0
#: A site may shift a document's log-odds by so much.
SHIFT = 2.0


def evidence(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Column:
    """The probability of good quality of the column ``text``, by the document's own evidence."""
    arrow_rows(docs.sparkSession)
    data, model = sampled(docs, labels, ["quality"], sample), None
    if len(data):
        model, _ = fit(data, np.arange(len(data)), np.zeros((len(data), 0)), (data.labels["quality"] == 1).astype(np.float64))

    @F.pandas_udf("double")
    def good(text: pd.Series) -> pd.Series:
        if model is None:
            return pd.Series(np.full(len(text), 0.99))
        parts = [shape(t) for t in text]
        z = model.logit(np.array([p[0] for p in parts]).reshape(len(parts), SHAPES), [stems(p[1]) for p in parts], np.zeros((len(parts), 0)))
        return pd.Series(np.clip(sigmoid(z), 1e-4, 1 - 1e-4))

    return good(whole("text"))


def _weight(groups: DataFrame, centre: str) -> float:
    """Weight of the beta prior around ``centre`` that the spread of the groups (n, s, q) calls for."""
    n, k, inside, off, nn, mean = groups.agg(
        F.sum("n"), F.count(F.lit(1)), F.sum(F.col("q") - F.col("s") * F.col("s") / F.col("n")),
        F.sum(F.col("n") * (F.col("s") / F.col("n") - F.col(centre)) ** 2), F.sum(F.col("n").cast("double") * F.col("n")), F.sum("s") / F.sum("n"),
    ).first()
    if not n or k < 3 or n <= k:
        return WEIGHT
    within = max(inside, 0.0) / (n - k)
    between = (off - (k - 1) * within) / (n - nn / n)
    return min(max(mean * (1 - mean) / between - 1, 1.0), MOST) if between > 0 else MOST


def site_rates(scored: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """host, path, n, s, prior (the shrunk rate of its host), weight, base (the global rate) of ``scored`` (host, path, p)."""
    scratch = scratch or Scratch(scored.sparkSession, "site-rates")
    paths = scratch.keep(scored.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("s"), F.sum(F.col("p") * F.col("p")).alias("q")))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    total = hosts.agg(F.sum("s") / F.sum("n")).first()[0]
    base = float(total if total is not None else 0.5)
    hosts = scratch.keep(hosts.withColumn("base", F.lit(base)))
    w = _weight(hosts, "base")
    hosts = hosts.select(F.col("host").alias("h"), ((F.col("s") + base * w) / (F.col("n") + w)).alias("prior"))
    rates = scratch.keep(paths.join(hosts, paths["host"].eqNullSafe(hosts["h"])).drop("h"))
    return scratch.keep(rates.select("host", "path", "n", "s", "prior", F.lit(_weight(rates, "prior")).alias("weight"), F.lit(base).alias("base")))


def judged(scored: DataFrame, scratch: Scratch, threshold: float) -> DataFrame:
    """``scored`` (host, path, p and others), a written table, with ``posterior`` and ``kept`` added."""
    rates = site_rates(scored, scratch).withColumnsRenamed({"host": "at_host", "path": "at_path"})
    rows = scored.join(rates, scored["host"].eqNullSafe(rates["at_host"]) & scored["path"].eqNullSafe(rates["at_path"]))

    def logit(x: Column) -> Column:
        return F.log(x / (1 - x))

    site = (F.col("s") - F.col("p") + F.col("prior") * F.col("weight")) / (F.col("n") - 1 + F.col("weight"))
    site = F.least(F.greatest(site, F.lit(1e-4)), F.lit(1 - 1e-4))
    base = F.least(F.greatest(F.col("base"), F.lit(1e-4)), F.lit(1 - 1e-4))
    shift = F.least(F.greatest(logit(site) - logit(base), F.lit(-SHIFT)), F.lit(SHIFT))
    odds = logit(F.col("p")) + shift
    return rows.withColumn("posterior", 1 / (1 + F.exp(-odds))).withColumn("kept", F.col("posterior") >= threshold)


def quality_classifier(docs: DataFrame, labels: DataFrame, host: Column | None = None, path: Column | None = None, sample: int = SAMPLE, threshold: float = 0.5) -> DataFrame:
    """Per document: doc_id, p_document, p_quality, kept. The site defaults to ``source`` (host) and ``lang`` (path)."""
    host, path = F.col("source") if host is None else host, F.col("lang") if path is None else path
    scratch = Scratch(docs.sparkSession, "quality")
    scored = scratch.keep(docs.select("doc_id", host.alias("host"), path.alias("path"), evidence(docs, labels, sample).alias("p")))
    return judged(scored, scratch, threshold).select("doc_id", F.col("p").alias("p_document"), F.col("posterior").alias("p_quality"), "kept")


def drop_low_quality(docs: DataFrame, labels: DataFrame, host: Column | None = None, path: Column | None = None, sample: int = SAMPLE, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns. Texts are scored once; the scores are written with them."""
    host, path = F.col("source") if host is None else host, F.col("lang") if path is None else path
    scratch = Scratch(docs.sparkSession, "quality")
    scored = scratch.keep(keyed(docs, host=host, path=path, p=evidence(docs, labels, sample)))
    return unkeyed(judged(scored, scratch, threshold).filter("kept"))
