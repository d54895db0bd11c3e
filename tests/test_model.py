"""Bags, models and evaluation against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sliceframe.operators import bags, metrics, model, pooling
from sliceframe.plans import evaluation, reports

D, HEADS = 8, 2


def table(spark, seed=0, n=300):
    """A bag with half of all rows, small ones, one without valid rows, a null one, and rows without embedding."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        bag = "hot" if i % 2 else "none" if i % 50 == 0 else None if i % 31 == 0 else f"b{i % 9}"
        rows.append((i, bag, None if i % 41 == 0 else rng.normal(size=D).tolist(), bag != "none" and i % 7 != 0, int(i % 3)))
    return rows, spark.createDataFrame(rows, "id long, bag string, h array<double>, ok boolean, plane int").repartition(7)


def members(rows, valid=True):
    out = {}
    for _, bag, h, ok, plane in rows:
        if h is not None and (ok or not valid):
            out.setdefault(bag, []).append((np.array(h), plane))
    return out


def layers(rng):
    return {"query": rng.normal(size=(1, D)), "in_proj_weight": rng.normal(size=(3 * D, D)), "in_proj_bias": rng.normal(size=3 * D), "out_proj.weight": rng.normal(size=(D, D)), "out_proj.bias": rng.normal(size=D)}


def attended(x, w):
    """Multi-head attention of one query as it is usually written: keys, values and their weights for each row."""
    q = w["in_proj_weight"][:D] @ w["query"][0] + w["in_proj_bias"][:D]
    k = x @ w["in_proj_weight"][D : 2 * D].T + w["in_proj_bias"][D : 2 * D]
    v = x @ w["in_proj_weight"][2 * D :].T + w["in_proj_bias"][2 * D :]
    out, size = [], D // HEADS
    for h in range(HEADS):
        at = slice(h * size, (h + 1) * size)
        s = k[:, at] @ q[at] / np.sqrt(size)
        a = np.exp(s - s.max())
        out.append((a / a.sum()) @ v[:, at])
    return w["out_proj.weight"] @ np.concatenate(out) + w["out_proj.bias"]


def test_multihead(spark):
    rows, d = table(spark)
    w = layers(np.random.default_rng(1))
    got = {r.bag: (r.n, r.pooled) for r in bags.multihead_pool(d, "bag", "h", w, HEADS, F.col("ok")).collect()}
    want = members(rows)
    assert set(got) == set(want) and None in got and "none" not in got
    for bag, x in want.items():
        assert got[bag][0] == len(x) and np.allclose(got[bag][1], attended(np.array([h for h, _ in x]), w))
    with pytest.raises(ValueError):
        bags.multihead_pool(d, "bag", "h", w, 3)


def test_extreme_scores_merge(spark):
    d = spark.createDataFrame([(i % 2, [float(i)], s) for i, s in enumerate([-1e6, 900.0, 1e6, -900.0, 1e6, None, 5.0, float("nan")])], "bag int, h array<double>, s double").repartition(5)
    got = {r.bag: r.pooled for r in bags.pooled(bags.accumulate(d, "bag", F.col("h"), F.array("s", F.lit(0.0), F.lit(None).cast("double"))), "bag", 3).collect()}
    assert got[0] == [[3.0], [3.0], None] and got[1] == [[1.0], [4.0], None]


def test_models(spark, tmp_path):
    rows, d = table(spark)
    rng = np.random.default_rng(2)
    labels = ["x", "y", "z"]
    shared = {"norm.weight": rng.normal(size=D), "norm.bias": rng.normal(size=D), "classifier.weight": rng.normal(size=(3, D)), "classifier.bias": rng.normal(size=3)}
    ln = lambda x, w, b: (x - x.mean()) / np.sqrt(x.var() + 1e-5) * w + b
    flat = lambda x: shared["classifier.weight"] @ ln(x, shared["norm.weight"], shared["norm.bias"]) + shared["classifier.bias"]
    w = layers(rng)
    own = {"attention_projection.weight": rng.normal(size=(5, D)), "attention_projection.bias": rng.normal(size=5), "query_vectors": rng.normal(size=(3, 5)), "planes": rng.normal(size=(3, D)), "layer_norms.weight": rng.normal(size=(3, D)), "layer_norms.bias": rng.normal(size=(3, D)), "classifiers.weight": rng.normal(size=(3, D)), "classifiers.bias": rng.normal(size=3)}

    def by_label(x):
        h, planes = np.array([r[0] for r in x]), [r[1] for r in x]
        s = np.tanh((h + own["planes"][planes]) @ own["attention_projection.weight"].T + own["attention_projection.bias"]) @ own["query_vectors"].T / 0.5
        a = np.exp(s - s.max(axis=0))
        a /= a.sum(axis=0)
        return [own["classifiers.weight"][k] @ ln(a[:, k] @ h, own["layer_norms.weight"][k], own["layer_norms.bias"][k]) + own["classifiers.bias"][k] for k in range(3)], a

    want = members(rows)
    models = {"mean": (model.Model("mean", labels, shared), lambda x: flat(np.mean([h for h, _ in x], axis=0))), "attention": (model.Model("attention", labels, shared | w, HEADS), lambda x: flat(attended(np.array([h for h, _ in x]), w))), "label_specific_attention": (model.Model("label_specific_attention", labels, own, temperature=0.5), lambda x: by_label(x)[0])}
    for name, (m, plain) in models.items():
        model.save(spark, m, f"{tmp_path}/{name}")
        m = model.load(spark, f"{tmp_path}/{name}")
        done = model.score(d, "bag", "h", m, mask=F.col("ok"), plane=F.col("plane"))
        got = {(r.bag, r.label): (r.score, r.probability) for r in done.logits.collect()}
        assert {b for b, _ in got} == set(want) | ({"none"} if name == "mean" else set())
        for bag, x in want.items():
            logits = plain(x)
            assert np.allclose([got[bag, k][0] for k in labels], logits) and np.allclose([got[bag, k][1] for k in labels], 1 / (1 + np.exp(-np.array(logits))))
        if name == "mean":
            assert np.allclose([got["none", k][0] for k in labels], flat(np.zeros(D)))
        assert (done.attention is not None) == (name == "label_specific_attention")
    weights = {}
    for r in done.attention.collect():
        if r.h is not None:
            weights.setdefault(r.bag, []).append((r.id, r.attention))
    for bag, x in want.items():
        ordered = [a for _, a in sorted(weights[bag])]
        assert np.allclose(ordered, by_label(x)[1]) and np.allclose(np.sum(ordered, axis=0), 1)


def test_model_checks(spark):
    size = {"norm.weight": (384,), "norm.bias": (384,), "classifier.weight": (12, 384), "classifier.bias": (12,)}
    m = model.Model("mean", [f"l{k}" for k in range(12)], {k: np.zeros(s) for k, s in size.items()})
    assert m.n_parameters() < 10_000
    with pytest.raises(ValueError, match="unknown pooling"):
        model.Model("sum", [], {})
    with pytest.raises(ValueError, match="missing: norm.bias"):
        model.Model("mean", [], {k: v for k, v in m.layers.items() if k != "norm.bias"})


def test_own_pooling(spark):
    _, d = table(spark)
    pooling.register_pooling("largest", lambda x: x.max(axis=0), np.maximum, lambda s: s, "array<double>")
    got = {r.bag: r.pooled for r in pooling.pooling_of("largest")(d, "bag", "h").collect()}
    want = {r.bag: [r[f"m{k}"] for k in range(D)] for r in d.where("h is not null").groupBy("bag").agg(*[F.max(F.get("h", F.lit(k))).alias(f"m{k}") for k in range(D)]).collect()}
    assert got == want
    with pytest.raises(ValueError, match="don't merge"):
        pooling.register_pooling("first", lambda x: x[0], lambda a, b: a, lambda s: s, "array<double>")
    with pytest.raises(ValueError, match="already"):
        pooling.register_pooling("mean", lambda x: x.max(axis=0), np.maximum, lambda s: s, "array<double>")


def test_evaluation(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = [(f"u{i}", k, float(rng.normal()), None if rng.random() < 0.3 else float(rng.random() < 0.4)) for i in range(60) for k in "ab"] + [("u1", "one", 0.3, 1.0)]
    logits = spark.createDataFrame([r[:3] for r in rows], "unit string, label string, score double")
    truth = spark.createDataFrame([(r[0], r[1], r[3]) for r in rows[:100] + rows[-1:]], "unit string, label string, y double")
    done = evaluation.evaluate(logits, truth, "unit", dest=f"{tmp_path}/p")
    known = [(k, s, y) for _, k, s, y in rows[:100] + rows[-1:] if y is not None]
    loss = np.mean([(1 - y) * s + np.log1p(np.exp(-abs(s))) + max(-s, 0) for _, s, y in known])
    assert abs(done.loss.first().loss - loss) < 1e-6 and done.predictions.count() == len(rows)
    for r in done.metrics.collect():
        p, n = ([s for k, s, y in known if k == r.label and y == v] for v in (1.0, 0.0))
        assert r.valid == bool(n)
        if n:
            assert abs(r.roc_auc - np.mean([(a > b) + (a == b) / 2 for a in p for b in n])) < 1e-6
    each = {r.unit: r for r in done.decisions(0.6).collect()}
    assert len(each) == 60 and all(each[u].decisions[k] == int(1 / (1 + np.exp(-s)) >= 0.6) for u, k, s, _ in rows)
    assert evaluation.evaluate(logits.limit(0), truth, "unit").loss.first().loss == 0


def test_label_report(spark, tmp_path):
    rows = [(1.0, 0.0, None, "Knee MRI"), (1.0, 1.0, None, "rodilla y KNIE"), (0.0, float("nan"), None, None), (None, None, None, "técnica"), (2.0, 1.0, None, "")]
    d = spark.createDataFrame(rows, "a double, b double, c double, t string")
    r = reports.label_report(d, ["a", "b", "c"], "t").first()
    assert (r.n_studies, r.n_labeled, r.n_unlabeled) == (5, 4, 1)
    assert [(x.label, x.labeled, x.positive, x.negative, x.missing, x.positive_values, x["values"]) for x in r.labels] == [("a", 4, 3, 1, 1, [1.0, 2.0], [0.0, 1.0, 2.0]), ("b", 3, 2, 1, 2, [1.0], [0.0, 1.0]), ("c", 0, 0, 0, 5, [], [])]
    assert [(x.a, x.b, x.jaccard) for x in r.top_pairs] == [("a", "b", 2 / 3), ("a", "c", 0.0), ("b", "c", 0.0)] and [x.joint for x in r.joint_positives] == [2]
    assert [tuple(x) for x in r.positives_per_study] == [(0, 1), (1, 1), (2, 2)]
    assert (r.texts.non_null, r.texts.length_chars.median, r.texts.language_markers.asDict()) == (4, 7.5, {"spanish": 2, "german": 1, "english": 1})
    assert [x.label for x in r.by_prevalence] == ["a", "b", "c"]
    assert reports.label_report(d.limit(0), ["a", "b"], "t").first().n_studies == 0


def test_metrics_unknown_method(spark):
    with pytest.raises(ValueError):
        metrics.class_weights(spark.createDataFrame([("a", 1.0)], "label string, y double"), "other")
