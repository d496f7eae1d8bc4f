from __future__ import annotations

import math
import random

import numpy as np
import pytest

from lakewarden.llm.common import Scratch
from lakewarden.llm.linear import fit, fold_of, sampled, shape, stems
from lakewarden.llm.quality_classifier import drop_low_quality, judged, quality_classifier, site_rates
from lakewarden.llm.toxicity import toxicity, train_chain

WORDS = [a + b for a in ("tion", "the", "ing", "ou", "er") for b in ("an", "re", "st", "ly", "en", "ha")]


@pytest.fixture(scope="module")
def labelled(spark, documents):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(700):
        words = [rng.choice(WORDS) for _ in range(rng.randrange(20, 80))]
        bad, toxic = rng.random() < 0.2, rng.random() < 0.2
        if toxic:
            words[rng.randrange(len(words))] = "vequ" + rng.choice(WORDS)
        if bad:
            words = [w.upper() + "!!" for w in words]
        rows.append((i, " ".join(words), "junk.example" if bad and rng.random() < 0.5 else f"h{i % 7}"))
        labels.append((i, 0 if bad else 1, int(toxic)))
    return documents(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), labels


def test_toxicity_on_held_out_documents(labelled):
    docs, labels, truth = labelled
    got = {r.doc_id: r.toxic for r in toxicity(docs, labels.filter("doc_id % 3 <> 0")).collect()}
    held = [(i, bool(t)) for i, _, t in truth if i % 3 == 0]
    assert sum(got[i] == t for i, t in held) / len(held) > 0.95


def test_quality_on_held_out_documents(labelled):
    docs, labels, truth = labelled
    got = {r.doc_id: r.kept for r in quality_classifier(docs, labels.filter("doc_id % 3 <> 0")).collect()}
    held = [(i, bool(q)) for i, q, _ in truth if i % 3 == 0]
    assert sum(got[i] == q for i, q in held) / len(held) > 0.97
    out = drop_low_quality(docs, labels)
    assert out.columns == docs.columns and abs(out.count() - sum(q for _, q, _ in truth)) < 15


def test_reruns_agree(labelled):
    docs, labels, _ = labelled
    a, b = (sorted((r.doc_id, round(r.p_toxic, 6)) for r in toxicity(d, labels).collect()) for d in (docs, docs.repartition(5)))
    assert a == b


def test_chain_takes_the_logits_of_models_that_have_not_seen_a_text(labelled):
    """The chain against a plain version: every fold's texts are judged by a model of the other folds."""
    docs, labels, _ = labelled
    data = sampled(docs, labels, ["quality", "toxic"])
    chain = train_chain(data)
    fold, none = fold_of(data.doc_id), np.zeros((len(data), 0))
    bad, toxic = (data.labels["quality"] == 0).astype(float), (data.labels["toxic"] == 1).astype(float)
    held = np.zeros(len(data))
    for i in range(len(data)):
        if not (fold[:i] == fold[i]).any():  # one model for each fold, when its first text comes
            rest = np.flatnonzero(fold != fold[i])
            _, z = fit(data, rest, none, bad[rest])
        else:
            z = seen[fold[i]]
        seen = {**(seen if i else {}), fold[i]: z}
        held[i] = min(8.0, max(-8.0, z[i]))
    first, _ = fit(data, np.arange(len(data)), none, bad)
    second, _ = fit(data, np.arange(len(data)), held[:, None], toxic)
    assert chain[0].vocabulary == first.vocabulary and np.allclose(chain[0].weights, first.weights)
    assert chain[1].vocabulary == second.vocabulary and np.allclose(chain[1].weights, second.weights)


def test_features_are_those_of_all_stems(labelled):
    """What Spark hands to the driver holds every stem that a choice among all stems would take."""
    docs, labels, truth = labelled
    data = sampled(docs, labels, ["quality", "toxic"])
    found = {r.doc_id: stems(shape(r.text)[1]) for r in docs.collect()}
    fold = dict(zip(data.doc_id.tolist(), fold_of(data.doc_id).tolist()))
    for at, column in ((1, "quality"), (2, "toxic")):
        for left_out in (None, 0, 3):
            some = [t for t in truth if fold[t[0]] != left_out]
            n1 = sum(t[at] for t in some)
            n0, want = len(some) - n1, set()
            for stem in set().union(*found.values()):
                pos, neg = (sum(stem in found[t[0]] for t in some if t[at] == k) for k in (1, 0))
                p = min(1 - 1e-9, max(1e-9, (pos + neg) / (n1 + n0)))
                if pos + neg >= 5 and abs(pos / n1 - neg / n0) / math.sqrt(p * (1 - p) * (1 / n1 + 1 / n0)) > 4:
                    want.add(stem)
            assert len(want) < 384
            rows = np.array([i for i, d in enumerate(data.doc_id.tolist()) if fold[d] != left_out])
            model, _ = fit(data, rows, np.zeros((len(data), 0)), data.labels[column][rows].astype(float))
            assert set(model.vocabulary) == want


def test_logits_of_a_text_by_hand(labelled):
    docs, labels, _ = labelled
    chain = train_chain(sampled(docs, labels, ["quality", "toxic"]))
    text = docs.filter("doc_id = 3").first().text
    form, words = shape(text)
    extra: list[float] = []
    for model in chain:
        x = [*form, *extra]
        z = model.bias + sum(w * v for w, v in zip(model.weights, x)) + sum(model.weights[len(x) + i] for s, i in model.vocabulary.items() if s in stems(words))
        extra.append(min(8.0, max(-8.0, z)))
    got = toxicity(docs, labels).filter("doc_id = 3").first()
    assert got.p_low_quality == pytest.approx(1 / (1 + math.exp(-extra[0]))) and got.p_toxic == pytest.approx(1 / (1 + math.exp(-extra[1])))


def plain_posteriors(rows, base_weight=50.0, most=10_000.0, shift=2.0):
    """Posterior of each (host, path, p) with sums over plain lists."""

    def logit(x):
        x = min(1 - 1e-4, max(1e-4, x))
        return math.log(x / (1 - x))

    def weight(groups):
        n, k = sum(len(g) for g, _ in groups), len(groups)
        if not n or k < 3 or n <= k:
            return base_weight
        mean = sum(sum(g) for g, _ in groups) / n
        within = max(0.0, sum(sum(x * x for x in g) - sum(g) ** 2 / len(g) for g, _ in groups)) / (n - k)
        between = (sum(len(g) * (sum(g) / len(g) - c) ** 2 for g, c in groups) - (k - 1) * within) / (n - sum(len(g) ** 2 for g, _ in groups) / n)
        return min(max(mean * (1 - mean) / between - 1, 1.0), most) if between > 0 else most

    hosts, paths = {}, {}
    for h, a, p in rows:
        hosts.setdefault(h, []).append(p)
        paths.setdefault((h, a), []).append(p)
    base = sum(p for _, _, p in rows) / len(rows)
    w = weight([(g, base) for g in hosts.values()])
    prior = {h: (sum(g) + base * w) / (len(g) + w) for h, g in hosts.items()}
    v = weight([(g, prior[h]) for (h, _), g in paths.items()])
    out = []
    for h, a, p in rows:
        g = paths[h, a]
        site = (sum(g) - p + prior[h] * v) / (len(g) - 1 + v)
        out.append(1 / (1 + math.exp(-(math.log(p / (1 - p)) + min(shift, max(-shift, logit(site) - logit(base)))))))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_posteriors_equal_a_plain_version(spark, seed):
    rng = random.Random(seed)
    level = {f"h{k}": rng.uniform(0.1, 0.95) for k in range(2 if seed == 3 else 9)} | {None: 0.5}
    rows = [(h, a, min(0.99, max(0.01, rng.gauss(m, 0.15)))) for h, m in level.items() for a in ("x", "y", None) for _ in range(rng.randrange(1, 30))]
    scratch = Scratch(spark, "t")
    scored = scratch.keep(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, host string, path string, p double"))
    got = [r.posterior for r in judged(scored, scratch, 0.5).orderBy("i").collect()]
    assert got == pytest.approx(plain_posteriors(rows))


def test_a_labelled_id_on_many_rows_is_one_example(spark, documents, labelled):
    _, labels, _ = labelled
    rows = [(5, f"text number {i} " * 4, "s") for i in range(300)] + [(6, "other words", "s")]
    a, b = (sampled(documents(r), labels, ["quality"]) for r in (rows, rows[::-1]))
    assert a.doc_id.tolist() == b.doc_id.tolist() == [5, 6]
    assert (a.shapes == b.shapes).all() and a.names.take(a.code).to_pylist() == b.names.take(b.code).to_pylist()


def test_sparse_sites_fall_back_on_the_global_rate(spark):
    rng = random.Random(1)
    rows = [(f"h{k}", p, min(0.99, max(0.01, rng.gauss(0.95 if k else 0.2, 0.02)))) for k in range(8) for p in ("a", "b") for _ in range(200)] + [("lone", "a", 0.05)]
    rates = {(r.host, r.path): r for r in site_rates(spark.createDataFrame(rows, "host string, path string, p double")).collect()}
    base = rates["lone", "a"].base
    assert rates["h0", "a"].prior < 0.3 and rates["h1", "a"].prior > 0.9
    assert 0.3 < rates["lone", "a"].prior < base


def test_awkward_tables(spark, awkward, nothing, labelled):
    _, labels, _ = labelled
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    odd = spark.createDataFrame([(1, 1, 0), (1, 0, None), (2, None, 1), (77, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for some in (labels, none, odd):
        assert toxicity(awkward, some).count() == awkward.count()
        assert quality_classifier(awkward, some).count() == awkward.count()
    assert toxicity(nothing, labels).count() == 0 and quality_classifier(nothing, labels).count() == 0
    assert drop_low_quality(awkward, none).count() == awkward.count()
