"""Queries over bags of embeddings and predictions, each with its oracle: masked pooling, attention and classifier by label, metric bundle, inference."""

from __future__ import annotations

from pyspark.sql import functions as F

from sliceframe import settings
from sliceframe.operators import bags, metrics, model, pooling
from sliceframe.plans import evaluation
from sliceframe.plans.catalog import PRED, ROC, long, preds, query

#: A small model, as literals on both sides: two hidden units over the first three elements, two labels.
SIZE = 64
PROJECTION = [[0.5, -0.25, 0.0] + [0.0] * (SIZE - 3), [0.0, 0.0, 0.75] + [0.0] * (SIZE - 3)]
OFFSETS = [0.1, -0.2]
QUERIES = {"p": [1.0, -1.0], "q": [0.5, 2.0]}
BIAS = {"p": 0.25, "q": -0.5}
MASK = "vec_id % 7 <> 0 AND label <> 3"
PLANES = "CASE vec_id % 4 WHEN 0 THEN 'Axial' WHEN 1 THEN 'Coronal' WHEN 2 THEN '' END"
LISTED = "CASE WHEN vec_id % 3 = 0 THEN 'Axial' WHEN vec_id % 3 = 1 THEN 'oblique' END"


@query("SELECT label, CAST(i - 1 AS INTEGER) AS i, round(coalesce(avg(CASE WHEN m THEN v END), 0), 6) AS value FROM (SELECT label, " + MASK + " AS m, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY 1, 2")
def masked_mean_pool(t):
    return pooling.masked_mean(t("embeddings"), "label", "embedding", F.expr(MASK))


INDEX = f"CASE coalesce(nullif({PLANES}, ''), nullif({LISTED}, ''), 'Sagittal') WHEN 'Coronal' THEN 1 WHEN 'Axial' THEN 2 ELSE 0 END"


@query(f"SELECT vec_id, {INDEX} AS plane_index FROM embeddings")
def plane_index(t):
    return t("embeddings").select("vec_id", pooling.plane_index(F.expr(PLANES), F.expr(LISTED)).alias("plane_index"))


ATTENDED = f"""g AS (SELECT vec_id, label AS bag, embedding, embedding[1]::DOUBLE + ({INDEX}) / 10.0::DOUBLE AS a, embedding[2]::DOUBLE AS b, embedding[3]::DOUBLE AS c FROM embeddings WHERE {MASK}),
z AS (SELECT bag, embedding, tanh(0.5 * a - 0.25 * b + 0.1) AS z1, tanh(0.75 * c - 0.2) AS z2 FROM g), s AS (SELECT bag, embedding, (z1 - z2) / 2 AS sp, (0.5 * z1 + 2 * z2) / 2 AS sq FROM z),
ex AS (SELECT bag, exp(sp) AS ep, exp(sq) AS eq, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS i FROM s),
po AS (SELECT bag, i, sum(ep * v) / sum(ep) AS vp, sum(eq * v) / sum(eq) AS vq FROM ex GROUP BY 1, 2),
pl AS (SELECT bag, 'p' AS label, CAST(i AS INTEGER) AS i, round(vp, 6) AS value FROM po UNION ALL SELECT bag, 'q', CAST(i AS INTEGER), round(vq, 6) FROM po)"""


def attended(t):
    d = t("embeddings").withColumnRenamed("label", "bag")
    row = pooling.plane_index(F.expr(PLANES), F.expr(LISTED)) / F.lit(10.0)
    added = F.concat(F.array(row), F.array_repeat(F.lit(0.0), SIZE - 1))
    by_label = pooling.label_scores(F.col("embedding"), PROJECTION, OFFSETS, QUERIES, added=added, temperature=2.0)
    return pooling.label_attention_pool(d, "bag", "embedding", by_label, F.expr(MASK.replace("label", "bag")))


@query(f"WITH {ATTENDED} SELECT * FROM pl")
def label_attention_pool(t):
    return attended(t)


@query(f"""WITH {ATTENDED}, pa AS (SELECT *, ((i + CASE label WHEN 'q' THEN 1 ELSE 0 END) % 5 - 2) / 10.0::DOUBLE AS w, 1 + (i % 3) / 10.0::DOUBLE AS g, (i % 2) / 10.0::DOUBLE AS b FROM pl),
mv AS (SELECT bag, label, avg(value) AS m, var_pop(value) AS v FROM pl GROUP BY 1, 2)
SELECT bag, label, round(sum(w * ((value - m) / sqrt(v + 1e-5) * g + b)) + CASE label WHEN 'p' THEN 0.25 ELSE -0.5 END, 5) AS logit FROM pa JOIN mv USING (bag, label) GROUP BY 1, 2""")
def label_classifier(t):
    d = attended(t)
    rows = [(k, i, ((i + n) % 5 - 2) / 10, 1 + (i % 3) / 10, (i % 2) / 10) for n, k in enumerate(QUERIES) for i in range(SIZE)]
    model = d.sparkSession.createDataFrame(rows, "label string, i int, weight double, gamma double, beta double")
    return pooling.label_classifier(d, "bag", model, BIAS, digits=5)


#: Weights by row and column, as both engines read them.
FORMULAS = {"wq": "((a + b) % 3 - 1) / 20.0", "wk": "((3 * a + 5 * b) % 7 - 3) / 50.0", "wv": "((2 * a + b) % 5 - 2) / 20.0", "wo": "((a + 4 * b) % 9 - 4) / 30.0", "query": "(b % 5 - 2) / 10.0", "bq": "(b % 4) / 100.0", "bk": "(b % 3) / 10.0", "bv": "(b % 2) / 10.0", "bo": "(b % 5) / 10.0"}
HEADS = 4


def weights_of(formula, rows):
    import numpy as np

    a, b = np.meshgrid(np.arange(rows), np.arange(SIZE), indexing="ij")
    return eval(formula, {"a": a, "b": b})


def attending():
    import numpy as np

    w = {k: weights_of(v, SIZE if k.startswith("w") else 1) for k, v in FORMULAS.items()}
    return {"query": w["query"], "in_proj_weight": np.concatenate([w["wq"], w["wk"], w["wv"]]), "in_proj_bias": np.concatenate([w["bq"][0], w["bk"][0], w["bv"][0]]), "out_proj.weight": w["wo"], "out_proj.bias": w["bo"][0]}


f = {k: v.replace(".0", ".0::DOUBLE") for k, v in FORMULAS.items()}


@query(f"""WITH r AS (SELECT unnest(range(0, {SIZE})) AS b), ab AS (SELECT x.b AS a, y.b AS b FROM r x, r y),
e AS (SELECT vec_id, label AS bag, unnest(embedding)::DOUBLE AS h, generate_subscripts(embedding, 1) - 1 AS b FROM embeddings WHERE {MASK}),
q AS (SELECT a, sum({f['wq']} * {f['query']}) + {f['bq'].replace('b', 'a', 1)} AS q FROM ab GROUP BY a),
kv AS (SELECT vec_id, bag, a, sum({f['wk']} * h) + {f['bk'].replace('b', 'a', 1)} AS k, sum({f['wv']} * h) + {f['bv'].replace('b', 'a', 1)} AS v FROM e JOIN ab USING (b) GROUP BY vec_id, bag, a),
s AS (SELECT vec_id, bag, a // 16 AS head, sum(q * k) / 4 AS s FROM kv JOIN q USING (a) GROUP BY vec_id, bag, a // 16),
w AS (SELECT *, exp(s - max(s) OVER (PARTITION BY bag, head)) AS e FROM s), o AS (SELECT bag, kv.a, sum(e * v) / sum(e) AS o FROM kv JOIN w USING (vec_id, bag) WHERE w.head = kv.a // 16 GROUP BY bag, kv.a)
SELECT bag, CAST(ab.a AS INTEGER) AS i, round(sum({f['wo']} * o) + {f['bo'].replace('b', 'ab.a', 1)}, 6) AS value FROM o JOIN ab ON o.a = ab.b GROUP BY bag, ab.a""".replace("((a + 4 * b) % 9 - 4)", "((ab.a + 4 * ab.b) % 9 - 4)"))
def multihead_attention_pool(t):
    """One query that attends with four heads over the embeddings of a bag."""
    d = t("embeddings").withColumnRenamed("label", "bag")
    one = bags.multihead_pool(d, "bag", "embedding", attending(), HEADS, F.expr(MASK.replace("label", "bag")))
    return one.select("bag", F.posexplode("pooled").alias("i", "value")).withColumn("value", F.round("value", 6))


def by_label():
    """The model of ``label_attention_pool`` and ``label_classifier`` as layers."""
    import numpy as np

    i, planes = np.arange(SIZE), np.zeros((3, SIZE))
    planes[:, 0] = np.arange(3) / 10
    each = lambda x: np.stack([x for _ in QUERIES])
    layers = {"attention_projection.weight": np.array(PROJECTION), "attention_projection.bias": np.array(OFFSETS), "query_vectors": np.array(list(QUERIES.values())), "planes": planes}
    layers |= {"layer_norms.weight": each(1 + (i % 3) / 10), "layer_norms.bias": each((i % 2) / 10), "classifiers.weight": np.stack([((i + n) % 5 - 2) / 10 for n in range(2)]), "classifiers.bias": np.array(list(BIAS.values()))}
    return model.Model("label_specific_attention", list(QUERIES), layers, temperature=2.0)


def scored_by_label(t):
    d = t("embeddings").withColumnRenamed("label", "bag")
    return model.score(d, "bag", "embedding", by_label(), mask=F.expr(MASK.replace("label", "bag")), plane=pooling.plane_index(F.expr(PLANES), F.expr(LISTED)))


@query(f"""WITH {ATTENDED}, un AS (SELECT bag, 'p' AS label, i, vp AS value FROM po UNION ALL SELECT bag, 'q', i, vq FROM po), pa AS (SELECT *, ((i + CASE label WHEN 'q' THEN 1 ELSE 0 END) % 5 - 2) / 10.0::DOUBLE AS w, 1 + (i % 3) / 10.0::DOUBLE AS g, (i % 2) / 10.0::DOUBLE AS b FROM un),
mv AS (SELECT bag, label, avg(value) AS m, var_pop(value) AS v FROM un GROUP BY 1, 2), lo AS (SELECT bag, label, sum(w * ((value - m) / sqrt(v + 1e-5) * g + b)) + CASE label WHEN 'p' THEN 0.25 ELSE -0.5 END AS z FROM pa JOIN mv USING (bag, label) GROUP BY 1, 2)
SELECT bag, label, round(z, 6) AS logit, round(1 / (1 + exp(-z)), 6) AS probability FROM lo""")
def model_scores_by_label(t):
    """Embeddings to probabilities with attention by label, in one plan."""
    return scored_by_label(t).logits.select("bag", "label", F.round("score", 6).alias("logit"), F.round("probability", 6).alias("probability"))


@query(f"""WITH {ATTENDED.replace("SELECT bag, embedding, tanh", "SELECT bag, vec_id, embedding, tanh").replace("s AS (SELECT bag, embedding, (z1", "s AS (SELECT bag, vec_id, embedding, (z1")} SELECT bag, vec_id, round(exp(sp) / sum(exp(sp)) OVER (PARTITION BY bag), 6) AS p, round(exp(sq) / sum(exp(sq)) OVER (PARTITION BY bag), 6) AS q FROM s""")
def model_attention(t):
    """The weight of each instance for each label."""
    at = F.col("attention")
    return scored_by_label(t).attention.select("bag", "vec_id", *[F.round(F.get(at, F.lit(k)), 6).alias(n) for k, n in enumerate(QUERIES)])


#: Bags of about ten vectors, one of which has no valid row, and two labels.
BAG, VALID = "vec_id % 50", "vec_id % 7 <> 0 AND vec_id % 50 <> 11"
MEAN = f"""e AS (SELECT {BAG} AS bag, {VALID} AS ok, unnest(embedding)::DOUBLE AS h, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings), me AS (SELECT bag, i, coalesce(avg(CASE WHEN ok THEN h END), 0) AS value FROM e GROUP BY 1, 2), mv AS (SELECT bag, avg(value) AS m, var_pop(value) AS v FROM me GROUP BY 1),
lo AS (SELECT bag, label, sum(((i + n) % 5 - 2) / 10.0::DOUBLE * ((value - m) / sqrt(v + 1e-5) * (1 + (i % 3) / 10.0::DOUBLE) + (i % 2) / 10.0::DOUBLE)) + n / 4.0::DOUBLE AS z FROM me JOIN mv USING (bag), (VALUES ('x', 0), ('y', 1)) l(label, n) GROUP BY bag, label, n)"""


def by_mean():
    import numpy as np

    i = np.arange(SIZE)
    return model.Model("mean", ["x", "y"], {"norm.weight": 1 + (i % 3) / 10, "norm.bias": (i % 2) / 10, "classifier.weight": np.stack([((i + n) % 5 - 2) / 10 for n in range(2)]), "classifier.bias": np.array([0.0, 0.25])})


def scored_by_mean(t):
    d = t("embeddings").withColumn("bag", F.expr(BAG))
    return model.score(d, "bag", "embedding", by_mean(), mask=F.expr(VALID))


@query(f"WITH {MEAN} SELECT bag, label, round(z, 6) AS logit, round(1 / (1 + exp(-z)), 6) AS probability FROM lo")
def model_scores(t):
    """Embeddings to probabilities over the mean of a bag, normalisation and a linear layer."""
    return scored_by_mean(t).logits.select("bag", "label", F.round("score", 6).alias("logit"), F.round("probability", 6).alias("probability"))


TRUTH = "CASE WHEN bag % 5 = 0 THEN NULL WHEN bag % 3 = {} THEN 1 ELSE 0 END"


@query(f"""WITH {MEAN}, pr AS (SELECT label, z AS score, CASE label WHEN 'x' THEN {TRUTH.format(0)} ELSE {TRUTH.format(1)} END AS y FROM lo), k AS (SELECT * FROM pr WHERE y IS NOT NULL),
ra AS (SELECT label, score, y, rank() OVER (PARTITION BY label ORDER BY score) AS r, sum(y) OVER (PARTITION BY label ORDER BY score DESC) AS tp, count(*) OVER (PARTITION BY label ORDER BY score DESC) AS al FROM k),
one AS (SELECT label, round((sum(CASE WHEN y = 1 THEN r END) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * sum(1 - y))::DOUBLE, 6) AS roc_auc, round(sum(y * tp / al::DOUBLE) / sum(y), 6) AS pr_auc FROM ra GROUP BY label),
lo2 AS (SELECT count(*) AS n, round(avg((1 - y) * score + (ln(1 + exp(-abs(score))) + greatest(-score, 0))), 6) AS loss FROM k)
SELECT label, roc_auc, pr_auc, true AS valid, round(avg(roc_auc) OVER (), 4) AS macro_roc_auc, round(avg(pr_auc) OVER (), 4) AS macro_pr_auc, n, loss, (SELECT CAST(sum(CASE WHEN 1 / (1 + exp(-score)) >= 0.55 THEN 1 ELSE 0 END) AS BIGINT) FROM pr) AS n_decided FROM one, lo2""")
def batch_evaluation(t):
    """Loss, both areas and decisions from predictions that are made once."""
    truth = t("embeddings").select(F.expr(BAG).alias("bag")).distinct().select("bag", F.inline(F.array(*[F.struct(F.lit(n).alias("label"), F.expr(TRUTH.format(k)).cast("double").alias("y")) for k, n in enumerate("xy")])))
    done = evaluation.evaluate(scored_by_mean(t).logits, truth, "bag")
    decided = done.decisions(0.55).agg(F.sum(F.aggregate(F.map_values("decisions"), F.lit(0), lambda a, x: a + x)).cast("long").alias("n_decided"))
    # Two tables of one row each; means of rounded areas are rounded coarser than these.
    both = done.metrics.join(F.broadcast(done.loss), F.lit(True)).join(F.broadcast(decided), F.lit(True))
    return both.withColumns({k: F.round(k, 4) for k in ("macro_roc_auc", "macro_pr_auc")})


@query(f"""WITH {ROC}, pc AS (SELECT label, p, n, sum(p) OVER w AS tp, sum(p + n) OVER w AS al FROM sc WINDOW w AS (PARTITION BY label ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
ap AS (SELECT label, round(CASE WHEN sum(n) > 0 THEN sum(p * tp / al::DOUBLE) / nullif(sum(p), 0)::DOUBLE END, 6) AS pr_auc FROM pc GROUP BY 1)
SELECT label, roc_auc, pr_auc, roc_auc IS NOT NULL AS valid, round(coalesce(avg(roc_auc) OVER (), 0), 6) AS macro_roc_auc, round(coalesce(avg(pr_auc) OVER (), 0), 6) AS macro_pr_auc FROM roc JOIN ap USING (label)""")
def metric_bundle(t):
    return metrics.metric_bundle(preds(t))


@query(f"""WITH {PRED}, k AS (SELECT label, count(CASE WHEN y > 0 THEN 1 END) AS pos, count(CASE WHEN y = 0 THEN 1 END) AS neg FROM lg GROUP BY 1),
cw AS (SELECT label, round(greatest(0.1::DOUBLE, least(10.0::DOUBLE, CASE WHEN pos = 0 THEN 1.0 ELSE neg / pos::DOUBLE END)), 6) AS weight FROM k)
SELECT count(*) AS n, round(coalesce(avg((1 - y) * score + (1 + (weight - 1) * y) * (ln(1 + exp(-abs(score))) + greatest(-score, 0))), 0), 6) AS loss FROM pr JOIN cw USING (label) WHERE y IS NOT NULL""")
def loss_from_training_labels(t):
    return metrics.loss_for(long(t), preds(t))


P = "1 / (1 + exp(-({})))"
ONE, TWO = "n_chars / 1000.0::DOUBLE - 2", "1 - n_chars / 2000.0::DOUBLE"


@query(f"SELECT doc_id, round({P.format(ONE)}, 6) AS p_quality, round({P.format(TWO)}, 6) AS p_toxic, CAST({P.format(ONE)} >= 0.6 AS INTEGER) AS d_quality, CAST({P.format(TWO)} >= 0.6 AS INTEGER) AS d_toxic FROM documents")
def inference_maps(t):
    x = F.col("n_chars").cast("double")
    rows = F.array(F.struct(F.lit("quality").alias("label"), (x / 1000 - 2).alias("score")), F.struct(F.lit("toxic").alias("label"), (1 - x / 2000).alias("score")))
    done = metrics.inference(t("documents").select("doc_id", F.inline(rows)), "doc_id", 0.6)
    return done.select("doc_id", *[F.col(m)[k].alias(f"{m[0]}_{k}") for m in ("probabilities", "decisions") for k in ("quality", "toxic")])


KEYED = f"""concat('{{"config":"{settings.fingerprint(settings.defaults())}","pipeline_version":"2","series_uid":"S', l_orderkey, '","sops":[', string_agg(concat('"', l_orderkey, '/', l_linenumber, '"'), ',' ORDER BY l_linenumber, l_partkey), ']}}')"""


@query(f"SELECT concat('S', l_orderkey) AS series_id, substr(sha256({KEYED}), 1, 24) AS cache_key FROM lineitem GROUP BY l_orderkey")
def series_cache_keys(t):
    """A key hashes a series' slices in order, so a series meets in one task."""
    slices = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", F.concat_ws("/", "l_orderkey", "l_linenumber").alias("sop"))))
    d = t("lineitem").groupBy("l_orderkey").agg(slices.alias("s"))
    series = F.concat(F.lit("S"), F.col("l_orderkey").cast("string"))
    return d.select(series.alias("series_id"), settings.series_cache_key(settings.defaults(), series, F.col("s.sop")).alias("cache_key"))
