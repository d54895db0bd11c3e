"""Queries over samples: series processing, study outcomes, the sample cache and study batches, each with its oracle.

Line items stand for slices as in ``health``; a slice's pixels are a fixed function
of its keys, of three sizes that fit into the sample's without interpolation.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from sliceframe import settings
from sliceframe.operators import previews
from sliceframe.plans import health, reports, samples, visualize
from sliceframe.plans.catalog import query
from sliceframe.plans.health import COMPONENTS

#: 4 x 6 pixels, to which 2 x 3 is doubled and 4 x 4 padded.
CONFIG = settings.override(settings.defaults(), image_size=[4, 6], resize_interpolation="nearest")
ROWS, COLUMNS = "CASE WHEN l_orderkey % 11 <> 0 AND l_orderkey % 3 = 1 THEN 2 ELSE 4 END", "CASE WHEN l_orderkey % 11 = 0 THEN 6 WHEN l_orderkey % 3 = 1 THEN 3 ELSE 4 END"
#: Of element i, from 0.
PIXEL = "CASE WHEN l_suppkey % 50 = 0 AND {i} = 0 THEN {nan} WHEN l_quantity = 1 THEN 7e0 ELSE CAST((l_partkey * ({i} + 1)) % 251 AS DOUBLE) END"


def decoded(t, photometric="CAST(NULL AS STRING)", *more):
    values = f"transform(sequence(0, ({ROWS}) * ({COLUMNS}) - 1), i -> {PIXEL.format(i='i', nan='double(chr(78) || chr(97) || chr(78))')})"
    good = health.FILE["ok"]
    return t("lineitem").selectExpr(f"{health.FILE['path']} AS path", f"CAST({ROWS} AS INT) AS rows", f"CAST({COLUMNS} AS INT) AS columns", f"CASE WHEN {good} THEN {values} END AS pixels", f"{health.FILE['slope']} AS slope", f"{photometric} AS photometric", *more, f"CASE WHEN NOT ({good}) THEN 'too few pixels' END AS error")


def chosen(t, config=CONFIG):
    """Slots with their outcome, evaluated once, and the slices of the chosen series."""
    slots = samples.kept_once(samples.outcomes(health.info(t), config))
    return samples.slices_of(health.headers(t), slots.where("outcome = 'chosen'")), slots


def stream(t, config=CONFIG):
    slices, slots = chosen(t, config)
    plans = samples.sample_plans(slots.where("outcome = 'chosen'"), slices, config)
    return samples.kept_once(samples.folded(samples.channels(plans, slices, decoded(t)), config)), slots


#: The choice by slot with its outcome, and the slices in stage 2's order.
CHOSEN = f"""{COMPONENTS}, e AS (SELECT DISTINCT study_id, unnest(['Sagittal', 'Coronal', 'Axial']) AS slot FROM i),
best AS (SELECT e.study_id, e.slot, rr.series_id, rr.k, rr.n, CASE WHEN rr.series_id IS NULL THEN 'no_candidate' WHEN rr.n < 3 OR rr.sizes > 1 THEN 'unusable' ELSE 'chosen' END AS outcome FROM e LEFT JOIN rr ON e.study_id = rr.study_id AND e.slot = rr.slot AND rnk = 1),
o AS (SELECT k, path, photometric, slope, CAST(row_number() OVER (PARTITION BY k ORDER BY CASE WHEN spatial2 THEN CASE WHEN axis = 1 THEN -pos ELSE pos END END, path) - 1 AS INTEGER) AS idx FROM q),
ce AS (SELECT *, generate_subscripts(spots, 1) - 1 AS sample, unnest(spots) AS center FROM (SELECT b.*, list_transform(list_filter(range(1, 7), lambda x: x = 1 OR NOT list_contains(list_transform(range(1, x), lambda y: places[y]), places[x])), lambda x: places[x]) AS spots FROM
(SELECT *, list_transform([0.06, 0.236, 0.412, 0.588, 0.764, 0.94], lambda f: CAST(greatest(1, least(n - 2, round_even(f * (n - 1), 0))) AS INTEGER)) AS places FROM best WHERE outcome = 'chosen') b)),
pl AS (SELECT study_id, slot, series_id, k, sample, center, unnest([0, 1, 2]) AS channel, unnest([center - 1, center, center + 1]) AS idx FROM ce WHERE center >= 1 AND center + 1 < n),
ch AS (SELECT pl.*, o.path, o.photometric, o.slope, li.*, {ROWS} AS r, {COLUMNS} AS w FROM pl JOIN o ON pl.k = o.k AND pl.idx = o.idx JOIN lineitem li ON {health.FILE['path']} = o.path),
st AS (SELECT *, CASE WHEN l_partkey % 97 = 0 THEN concat('unreadable slice ', idx) WHEN l_suppkey % 50 = 0 THEN 'invalid_pixels' END AS why, CASE WHEN l_partkey % 97 = 0 THEN concat(path, ': too few pixels') WHEN l_suppkey % 50 = 0 THEN concat(path, ': non-finite pixel values') END AS what FROM ch),
bad AS (SELECT study_id, slot, series_id, sample, center, arg_min(why, channel) FILTER (WHERE why IS NOT NULL) AS reason, arg_min(what, channel) FILTER (WHERE why IS NOT NULL) AS detail FROM st GROUP BY ALL),
px AS (SELECT st.*, unnest(range(0, r * w)) AS i FROM st JOIN bad USING (study_id, slot, series_id, sample) WHERE reason IS NULL),
va AS (SELECT *, {PIXEL.format(i='i', nan="'nan'::DOUBLE")} AS v0 FROM px), vb AS (SELECT *, CASE WHEN photometric = 'MONOCHROME1' THEN max(v0) OVER g - (v0 - min(v0) OVER g) ELSE v0 END AS v FROM va WINDOW g AS (PARTITION BY study_id, slot, sample, channel)),
qs AS (SELECT study_id, slot, series_id, sample, center, channel, idx, any_value(path) AS path, any_value(slope) AS slope, any_value(photometric) = 'MONOCHROME1' AS inverted, max(r) AS r, max(w) AS w, quantile_cont(v, 0.005) AS lo, quantile_cont(v, 0.995) AS hi, list(v) AS vs FROM vb GROUP BY ALL),
sm AS (SELECT *, CASE WHEN hi > lo THEN list_sum(list_transform(vs, lambda v: (greatest(lo, least(hi, v)) - lo) / (hi - lo))) ELSE 0 END * CASE WHEN r = 2 THEN 4 ELSE 1 END / 24.0::DOUBLE AS mean FROM qs)"""
CHOSEN = CHOSEN.replace("GROUP BY ALL),\nsm", "GROUP BY study_id, slot, series_id, sample, center, channel, idx),\nsm").replace("AS detail FROM st GROUP BY ALL", "AS detail FROM st GROUP BY study_id, slot, series_id, sample, center")


@query(f"""WITH {CHOSEN} SELECT study_id, slot, series_id, CAST(sample AS INTEGER) AS sample, CAST(center AS INTEGER) AS center, string_agg(path, ' ' ORDER BY channel) AS paths, string_agg(CAST(idx AS VARCHAR), ' ' ORDER BY channel) AS indices, '3 4 6' AS shape,
round(max(CASE WHEN channel = 0 THEN mean END), 4) AS mean_previous, round(max(CASE WHEN channel = 1 THEN mean END), 4) AS mean_center, round(max(CASE WHEN channel = 2 THEN mean END), 4) AS mean_next, round(min(lo), 4) AS clip_low, round(max(hi), 4) AS clip_high, bool_or(inverted) AS inverted,
max(CASE WHEN r = 2 THEN 2 WHEN w = 4 THEN 1 ELSE 1 END)::DOUBLE AS scale, CAST(max(CASE WHEN w = 4 THEN 1 ELSE 0 END) AS INTEGER) AS pad_left FROM sm GROUP BY study_id, slot, series_id, sample, center""")
def series_samples(t):
    """Three-slice samples of the chosen series, with the figures of their normalisation and resizing."""
    made = samples.samples(stream(t)[0])
    d = made.withColumn("m", channel_means()(F.col("image"), F.col("shape")))
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), " ")
    return d.select(
        *samples.SLOT, "sample", "center", text("paths").alias("paths"), text("slice_indices").alias("indices"), text("shape").alias("shape"), *[F.round(F.get("m", F.lit(k)), 4).alias(f"mean_{r}") for k, r in enumerate(("previous", "center", "next"))],
        F.round(F.array_min("stats.clip_low"), 4).alias("clip_low"), F.round(F.array_max("stats.clip_high"), 4).alias("clip_high"), F.exists("stats", lambda x: x["inverted"]).alias("inverted"), F.array_max("resized.scale").alias("scale"), F.array_max("resized.pad_left").alias("pad_left"))


def channel_means():
    @F.arrow_udf("array<double>")
    def means(images, shapes):
        import numpy as np
        import pyarrow as pa

        return pa.array([np.frombuffer(i.as_py(), dtype="<f4").reshape(s.as_py()).mean(axis=(1, 2), dtype=np.float64).tolist() for i, s in zip(images, shapes)], type=pa.list_(pa.float64()))

    return means


COUNTS = "nn AS (SELECT study_id, slot, count(*) AS planned, count(CASE WHEN reason IS NULL THEN 1 END) AS made FROM bad GROUP BY 1, 2)"


@query(f"""WITH {CHOSEN}, {COUNTS} SELECT b.study_id, b.slot, b.series_id, CASE WHEN outcome <> 'chosen' THEN outcome WHEN coalesce(made, 0) = 0 THEN 'failed' WHEN made < planned THEN 'partial' ELSE 'processed' END AS outcome, coalesce(planned, 0) AS planned, coalesce(made, 0) AS made FROM best b LEFT JOIN nn ON b.study_id = nn.study_id AND b.slot = nn.slot""")
def study_outcomes(t):
    """Each study and slot with exactly one outcome."""
    rows, slots = stream(t)
    return samples.series_outcomes(rows, slots).drop("reason")


@query(f"""WITH {CHOSEN}, {COUNTS} SELECT study_id, slot, series_id, reason, detail FROM bad WHERE reason IS NOT NULL
UNION ALL SELECT b.study_id, b.slot, b.series_id, 'insufficient_samples_for_request', concat(coalesce(planned, 0), ' locations produced ', coalesce(made, 0), ' triplets (requested 6)') FROM best b LEFT JOIN nn ON b.study_id = nn.study_id AND b.slot = nn.slot WHERE outcome = 'chosen' AND coalesce(planned, 0) < 6
UNION ALL SELECT b.study_id, b.slot, b.series_id, 'unusable', NULL FROM best b WHERE outcome = 'unusable'""")
def study_skips(t):
    """What was left out of the samples, and why."""
    rows, slots = stream(t)
    d = samples.skipped(rows, slots, CONFIG)
    return d.withColumn("reason", F.when(F.col("detail").isNull(), "unusable").otherwise(F.col("reason")))


NAMES = [f"l{k}" for k in range(12)]
LABEL = "CASE WHEN c_custkey % {m} = 0 THEN NULL ELSE CAST(c_custkey % {m} = 1 AS INT) END"


@query(f"""WITH {CHOSEN}, ok AS (SELECT study_id, slot, sample, CASE slot WHEN 'Sagittal' THEN 0 WHEN 'Coronal' THEN 2 ELSE 4 END + sample // 4 AS chunk FROM bad WHERE reason IS NULL),
sd AS (SELECT DISTINCT concat('T', c_custkey % 600) AS study_id FROM customer), y AS (SELECT concat('T', c_custkey) AS study_id, [{', '.join(LABEL.format(m=k + 2) for k in range(12))}] AS v FROM customer WHERE c_custkey < 450)
SELECT sd.study_id, CAST(coalesce(chunk, 0) AS INTEGER) AS chunk, CAST(count(chunk) AS INTEGER) AS n_images, coalesce(string_agg(concat(slot, sample), ' ' ORDER BY sample), '') AS samples, list_transform(coalesce(any_value(y.v), list_transform(range(12), lambda x: NULL::INT)), lambda x: coalesce(CAST(x AS VARCHAR), '-')).array_to_string(' ') AS labels
FROM sd LEFT JOIN ok USING (study_id) LEFT JOIN y USING (study_id) GROUP BY sd.study_id, coalesce(chunk, 0)""")
def study_batches(t):
    """Bags of samples in bounded chunks, with twelve labels in order; studies without samples or labels keep their place."""
    made = samples.samples(stream(t)[0])
    studies = t("customer").selectExpr("concat('T', c_custkey % 600) AS study_id")
    labels = t("customer").where("c_custkey < 450").selectExpr("concat('T', c_custkey) AS study_id", *[f"{LABEL.format(m=k + 2)} AS {n}" for k, n in enumerate(NAMES)])
    d = samples.study_batches(studies, made, labels, NAMES, CONFIG, chunk=4)
    names = F.array_join(F.transform("sample_metadata", lambda m: F.concat(m["slot"], m["sample"].cast("string"))), " ")
    return d.select("study_id", "chunk", F.size("images").alias("n_images"), names.alias("samples"), F.array_join(F.transform("labels", lambda x: F.coalesce(x.cast("int").cast("string"), F.lit("-"))), " ").alias("labels"))


#: Six labels of each document, the first two as listed.
SIX = {"quality": "quality", "toxic": "toxic", "m3": "CASE d.doc_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 0 END", "m5": "CASE WHEN d.doc_id % 5 < 2 THEN 1 ELSE 0 END", "m7": "CASE WHEN d.doc_id % 7 = 1 THEN 2 WHEN d.doc_id % 7 > 4 THEN 0 END", "m0": "CAST(NULL AS INT)"}
WORDS = {"a": "(?iu)license|licence", "b": "(?iu)the|der"}
PAIRS = [(a, b) for i, a in enumerate(SIX) for b in list(SIX)[i + 1 :]]


@query(f"""WITH t AS (SELECT text, CASE WHEN d.doc_id % 13 <> 0 THEN quality END AS quality, CASE WHEN d.doc_id % 13 <> 0 THEN toxic END AS toxic, {', '.join(f"CASE WHEN d.doc_id % 13 <> 0 THEN {e} END AS {n}" for n, e in list(SIX.items())[2:])} FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
s AS (SELECT label, count(*) AS total, count(y) AS labeled, count(CASE WHEN y > 0 THEN 1 END) AS positive, count(CASE WHEN y = 0 THEN 1 END) AS negative, list_sort(list(DISTINCT y) FILTER (WHERE y IS NOT NULL)) AS v, place FROM ({' UNION ALL '.join(f"SELECT '{n}' AS label, {n} AS y, {k} AS place FROM t" for k, n in enumerate(SIX))}) GROUP BY label, place),
j AS ({' UNION ALL '.join(f"SELECT '{a}' AS a, '{b}' AS b, {k} AS place, count(CASE WHEN {a} > 0 AND {b} > 0 THEN 1 END) AS joint, count(CASE WHEN {a} > 0 OR {b} > 0 THEN 1 END) AS either FROM t" for k, (a, b) in enumerate(PAIRS))}),
n AS (SELECT count(*) AS n, count(CASE WHEN coalesce({', '.join(SIX)}) IS NOT NULL THEN 1 END) AS m, count(text) AS tx, min(length(text)) AS lo, median(length(text)) AS md, max(length(text)) AS hi, count(CASE WHEN regexp_matches(text, 'license|licence', 'i') THEN 1 END) AS ma, count(CASE WHEN regexp_matches(text, 'the|der', 'i') THEN 1 END) AS mb FROM t),
k AS (SELECT {' + '.join(f'CASE WHEN {n} > 0 THEN 1 ELSE 0 END' for n in SIX)} AS k, count(*) AS c FROM t WHERE coalesce({', '.join(SIX)}) IS NOT NULL GROUP BY 1)
SELECT part, name, CAST(place AS INTEGER) AS place, round(CAST(value AS DOUBLE), 6) AS value FROM (
SELECT 'studies' AS part, 'n_studies' AS name, 0 AS place, n::DOUBLE AS value FROM n UNION ALL SELECT 'studies', 'n_labeled', 0, m FROM n UNION ALL SELECT 'studies', 'n_unlabeled', 0, n - m FROM n UNION ALL SELECT 'texts', 'non_null', 0, tx FROM n
UNION ALL SELECT 'length', 'min', 0, lo FROM n UNION ALL SELECT 'length', 'median', 0, md FROM n UNION ALL SELECT 'length', 'max', 0, hi FROM n UNION ALL SELECT 'markers', 'a', 0, ma FROM n UNION ALL SELECT 'markers', 'b', 0, mb FROM n
UNION ALL SELECT 'labeled', label, 0, labeled FROM s UNION ALL SELECT 'positive', label, 0, positive FROM s UNION ALL SELECT 'negative', label, 0, negative FROM s UNION ALL SELECT 'missing', label, 0, total - labeled FROM s UNION ALL SELECT 'prevalence', label, 0, positive / nullif(labeled, 0)::DOUBLE FROM s
UNION ALL SELECT 'values', label, generate_subscripts(v, 1) - 1, unnest(v) FROM s UNION ALL SELECT 'joint', concat(a, ' | ', b), 0, joint FROM j WHERE joint > 0 UNION ALL SELECT 'positives', CAST(k AS VARCHAR), 0, c FROM k
UNION ALL (SELECT 'top', concat(a, ' | ', b), row_number() OVER (ORDER BY joint / nullif(either, 0)::DOUBLE DESC NULLS LAST, place) - 1, joint / nullif(either, 0)::DOUBLE FROM j QUALIFY row_number() OVER (ORDER BY joint / nullif(either, 0)::DOUBLE DESC NULLS LAST, place) <= 8)
UNION ALL SELECT 'rank', label, row_number() OVER (ORDER BY positive / nullif(labeled, 0)::DOUBLE DESC NULLS LAST, place) - 1, positive / nullif(labeled, 0)::DOUBLE FROM s)""")
def label_report(t):
    """The whole label report in long form."""
    d = t("documents").alias("d").join(t("labels").alias("l"), F.col("d.doc_id") == F.col("l.doc_id"), "left")
    wide = d.select("text", *[F.expr(f"CASE WHEN d.doc_id % 13 <> 0 THEN {e} END").alias(n) for n, e in SIX.items()])
    done = reports.figures(reports.label_report(wide, list(SIX), "text", markers=WORDS))
    return done.withColumn("value", F.round("value", 6))


NORMALS = f"""{health.H}, nv AS (SELECT *, CASE WHEN flip THEN -1e0 ELSE 1e0 END AS sg FROM h), nm AS (SELECT *, CASE WHEN axis IS NOT NULL THEN CASE axis WHEN 2 THEN sg ELSE 0 END END AS x, CASE WHEN axis IS NOT NULL THEN CASE axis WHEN 1 THEN -sg ELSE 0 END END AS y, CASE WHEN axis IS NOT NULL THEN CASE axis WHEN 0 THEN sg ELSE 0 END END AS zz FROM nv),
mn AS (SELECT *, avg(x) OVER s AS mx, avg(y) OVER s AS my, avg(zz) OVER s AS mz FROM nm WINDOW s AS (PARTITION BY series_id)),
od AS (SELECT series_id, count(*) AS n_slices, count(x) AS n_usable, max(sqrt((x - mx) ** 2 + (y - my) ** 2 + (zz - mz) ** 2)) AS spread, avg(x) AS x, avg(y) AS y, avg(zz) AS z, arg_min(CASE WHEN x IS NOT NULL THEN concat(sign(x)::INT, ' ', sign(y)::INT, ' ', sign(zz)::INT) ELSE '' END, path) AS signs FROM mn GROUP BY series_id),
ou AS (SELECT *, CASE WHEN sqrt(x * x + y * y + z * z) > 1e-8 THEN [abs(x), abs(y), abs(z)] END AS a, sqrt(x * x + y * y + z * z) AS m FROM od), ov AS (SELECT *, list_reverse_sort(a)[1] / m AS best, list_reverse_sort(a)[1] / m - list_reverse_sort(a)[2] / m AS apart, ['sagittal', 'coronal', 'axial'][list_position(a, list_reverse_sort(a)[1])] AS axis FROM ou),
ow AS (SELECT ov.*, CASE WHEN n_usable > 0 THEN CASE WHEN coalesce(best >= 0.8 AND apart >= 0.2, false) THEN axis ELSE 'unknown' END END AS derived_plane, a2.plane_csv FROM ov LEFT JOIN a a2 USING (series_id))"""


@query(f"WITH {NORMALS} SELECT series_id, n_slices, n_usable, round(spread, 6) AS spread, axis AS dominant_axis, round(best, 6) AS alignment, round(apart, 6) AS separation, derived_plane, CASE WHEN derived_plane IS NULL THEN 'no usable IOP' WHEN derived_plane = 'unknown' THEN 'oblique or ambiguous normal' END AS reason, plane_csv FROM ow")
def orientation_details(t):
    """The orientation report's series."""
    d = reports.orientation_details(health.headers(t), health.attributes(t))
    return d.select("series_id", "n_slices", "n_usable", *[F.round(c, 6).alias(c) for c in ("spread", "alignment", "separation")], "dominant_axis", "derived_plane", "reason", "plane_csv")


@query(f"""WITH {NORMALS}, b AS (SELECT *, derived_plane IS NOT NULL AND plane_csv IS NOT NULL AS both_, coalesce(lower(plane_csv) = derived_plane, false) AS same FROM ow)
SELECT count(*) AS n_series, count(derived_plane) AS n_derivable, round(count(CASE WHEN same THEN 1 END) / count(CASE WHEN both_ THEN 1 END)::DOUBLE, 6) AS agreement, count(CASE WHEN both_ AND NOT same THEN 1 END) AS n_confusions, count(CASE WHEN derived_plane = 'unknown' THEN 1 END) AS n_unknown, round(count(CASE WHEN spread < 1e-6 THEN 1 END) / count(spread)::DOUBLE, 6) AS constant_rate,
concat('Sagittal ', count(CASE WHEN both_ AND plane_csv = 'Sagittal' THEN 1 END), ' ', count(CASE WHEN same AND plane_csv = 'Sagittal' THEN 1 END), ', Coronal ', count(CASE WHEN both_ AND plane_csv = 'Coronal' THEN 1 END), ' ', count(CASE WHEN same AND plane_csv = 'Coronal' THEN 1 END), ', Axial ', count(CASE WHEN both_ AND plane_csv = 'Axial' THEN 1 END), ' ', count(CASE WHEN same AND plane_csv = 'Axial' THEN 1 END)) AS by_plane,
(SELECT string_agg(concat(signs, ': ', n), ', ' ORDER BY signs) FROM (SELECT signs, count(*) AS n FROM ow WHERE signs <> '' GROUP BY signs)) AS signs FROM b""")
def orientation_summary(t):
    """The orientation report's figures."""
    d = reports.orientation_summary(reports.orientation_details(health.headers(t), health.attributes(t)))
    by = F.array_join(F.transform("by_plane", lambda x: F.concat_ws(" ", x["plane"], x["n"].cast("string"), x["agree"].cast("string"))), ", ")
    each = F.transform("signs", lambda x: F.concat(F.concat_ws(" ", F.get(x["signs"], F.lit(0)), F.get(x["signs"], F.lit(1)), F.get(x["signs"], F.lit(2))), F.lit(": "), x["n_series"].cast("string")))
    return d.select("n_series", "n_derivable", F.round("agreement", 6).alias("agreement"), "n_confusions", "n_unknown", F.round("constant_rate", 6).alias("constant_rate"), by.alias("by_plane"), F.array_join(F.array_sort(each), ", ").alias("signs"))


ORDERED = f"""{NORMALS}, ip AS (SELECT *, CASE WHEN axis IS NOT NULL AND z IS NOT NULL THEN CASE k % 3 WHEN 0 THEN zz * z WHEN 1 THEN y * z ELSE x * z END END AS pos FROM nm),
rf AS (SELECT *, first_value([x, y, zz]) OVER (PARTITION BY series_id ORDER BY x IS NULL, path ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS ref, pos - lag(pos) OVER (PARTITION BY series_id ORDER BY pos NULLS FIRST) AS gap,
CASE WHEN instance IS NOT NULL THEN rank() OVER (PARTITION BY series_id, instance IS NULL ORDER BY instance) + (count(*) OVER (PARTITION BY series_id, instance) - 1) / 2.0::DOUBLE END AS ri, rank() OVER (PARTITION BY series_id ORDER BY pos NULLS FIRST) + (count(*) OVER (PARTITION BY series_id, pos) - 1) / 2.0::DOUBLE AS rp FROM ip),
os AS (SELECT series_id, count(*) AS n_slices, count(DISTINCT instance) = count(instance) AS uniq, count(*) - count(instance) AS n_missing, CASE WHEN count(instance) > 0 THEN min(instance) = 1 AND max(instance) = count(instance) AND count(DISTINCT instance) = count(instance) END AS contiguous, count(pos) AS n_spatial, min(x * ref[1] + y * ref[2] + zz * ref[3]) AS worst,
max(pos) - min(pos) AS span, median(gap) AS med, CASE WHEN avg(gap) > 0 THEN stddev_pop(gap) / avg(gap) END AS cv, count(CASE WHEN gap < 1e-3 THEN 1 END) AS dup, CASE WHEN stddev_pop(ri) > 0 AND stddev_pop(CASE WHEN ri IS NOT NULL THEN rp END) > 0 THEN covar_pop(ri, CASE WHEN ri IS NOT NULL THEN rp END) / (stddev_pop(ri) * stddev_pop(CASE WHEN ri IS NOT NULL THEN rp END)) END AS r FROM rf GROUP BY series_id),
ot AS (SELECT *, n_spatial = n_slices AND n_slices >= 2 AS full_ FROM os), oe AS (SELECT series_id, n_slices, uniq, n_missing, contiguous, n_spatial, CASE WHEN full_ THEN worst > 0.99 END AS consistent, CASE WHEN full_ THEN round(span, 4) END AS span, CASE WHEN full_ THEN round(med, 4) END AS median_gap, CASE WHEN full_ THEN round(cv, 4) END AS gap_cv, CASE WHEN full_ THEN dup END AS n_dup, CASE WHEN full_ THEN round(r, 4) END AS rho, CASE WHEN full_ THEN CASE WHEN round(r, 10) > 0 THEN 'increasing' WHEN r IS NOT NULL THEN 'decreasing' END END AS direction FROM ot)"""


@query(f"WITH {ORDERED} SELECT series_id, n_slices, uniq AS \"unique\", n_missing, contiguous, n_spatial, consistent, span, median_gap, gap_cv, n_dup, rho FROM oe")
def ordering_details(t):
    """The ordering report's series."""
    return reports.ordering_details(health.headers(t)).drop("direction")


@query(f"""WITH {ORDERED} SELECT count(*) AS n_series, count(CASE WHEN n_spatial = n_slices THEN 1 END) AS n_spatial, round(count(CASE WHEN uniq THEN 1 END) / count(*)::DOUBLE, 6) AS unique_rate, CAST(sum(n_missing) AS BIGINT) AS n_missing, round(count(CASE WHEN contiguous THEN 1 END) / count(*)::DOUBLE, 6) AS contiguous_rate, count(rho) AS n_rho, round(avg(rho), 6) AS mean_rho, round(stddev_pop(rho), 6) AS std_rho, min(rho) AS min_rho, max(rho) AS max_rho,
round(count(CASE WHEN abs(rho) >= 0.999 THEN 1 END) / count(rho)::DOUBLE, 6) AS monotone_rate, max(gap_cv) AS max_gap_cv, count(CASE WHEN n_dup > 0 THEN 1 END) AS n_with_duplicates FROM oe""")
def ordering_summary(t):
    """The ordering report's figures."""
    d = reports.ordering_summary(reports.ordering_details(health.headers(t))).drop("n_increasing", "n_decreasing")
    return d.withColumns({k: F.round(k, 6) for k in ("unique_rate", "contiguous_rate", "mean_rho", "std_rho", "monotone_rate")})


#: Headers below folders named by series, and series of another table, some of which are listed in both.
def others(t):
    return health.attributes(t).where("CAST(substring(series_id, 2) AS BIGINT) % 90 = 7 OR CAST(substring(series_id, 2) AS BIGINT) < 4")


HOLD = "listed AS (SELECT * FROM a WHERE k % 97 <> 5), others AS (SELECT * FROM a WHERE k % 90 = 7 OR k < 4), hd AS (SELECT *, concat('S', split_part(path, '/', 1)) AS folder FROM h), ps AS (SELECT study_id, count(*) AS k FROM listed GROUP BY 1), pz AS (SELECT series_id, min(study_id) AS study_id, count(*) AS k FROM hd GROUP BY 1)"
ONE = lambda part, name, sql: f"SELECT '{part}' AS part, '{name}' AS name, ({sql})::DOUBLE AS value"
SHAPE = {"mean": "avg(k)", "std": "stddev_pop(k)", "min": "min(k)", "median": "median(k)", "max": "max(k)"}


@query(f"WITH {health.H}, {HOLD} SELECT part, name, round(value, 6) AS value FROM (" + " UNION ALL ".join([
    ONE("listed", "rows", "SELECT count(*) FROM listed"), ONE("listed", "series", "SELECT count(DISTINCT series_id) FROM listed"), ONE("listed", "studies", "SELECT count(DISTINCT study_id) FROM listed"),
    ONE("found", "files", "SELECT count(*) FROM hd"), ONE("found", "series", "SELECT count(DISTINCT series_id) FROM hd"), ONE("found", "studies", "SELECT count(DISTINCT study_id) FROM hd"), ONE("found", "without_key", "SELECT 0"),
    *[ONE("series_per_study", n, f"SELECT {e} FROM ps") for n, e in SHAPE.items()], *[ONE("slices_per_series", n, f"SELECT {e} FROM pz") for n, e in SHAPE.items()],
    "SELECT 'series_per_study_n', CAST(k AS VARCHAR), count(*)::DOUBLE FROM ps GROUP BY k", "SELECT 'slices_per_series_n', CAST(k AS VARCHAR), count(*)::DOUBLE FROM pz GROUP BY k",
    "SELECT 'planes', coalesce(plane_csv, 'null'), count(*) FROM listed GROUP BY plane_csv", "SELECT 'flags', concat(coalesce(plane_csv, 'null'), '|', coalesce(CAST(fluid AS VARCHAR), 'null')), count(*) FROM listed GROUP BY plane_csv, fluid",
    "SELECT 'sizes', concat(rows, '|', columns), count(*) FROM hd WHERE rows IS NOT NULL AND columns IS NOT NULL GROUP BY rows, columns", ONE("sizes", "non_square", "SELECT count(*) FROM hd WHERE rows <> columns"),
    *[ONE("missing", n, f"SELECT count(*) - count({n}) FROM listed") for n in ("study_id", "series_id", "plane_csv", "fluid")],
    ONE("duplicates", "series", "SELECT count(*) - count(DISTINCT series_id) FROM listed"), ONE("duplicates", "pairs", "SELECT count(*) - count(DISTINCT (study_id, series_id)) FROM listed"), ONE("duplicates", "sop", "SELECT count(*) - count(DISTINCT path) FROM hd"),
    ONE("one_side", "found_series", "SELECT count(*) FROM pz ANTI JOIN listed USING (series_id)"), ONE("one_side", "listed_series", "SELECT count(*) FROM (SELECT DISTINCT series_id FROM listed) ANTI JOIN hd USING (series_id)"),
    ONE("one_side", "found_studies", "SELECT count(*) FROM (SELECT DISTINCT study_id FROM hd) ANTI JOIN listed USING (study_id)"), ONE("one_side", "listed_studies", "SELECT count(*) FROM (SELECT DISTINCT study_id FROM listed) ANTI JOIN hd USING (study_id)"),
    ONE("overlap", "series", "SELECT count(*) FROM (SELECT DISTINCT series_id FROM listed) SEMI JOIN others USING (series_id)"), ONE("overlap", "studies", "SELECT count(*) FROM (SELECT DISTINCT study_id FROM listed) SEMI JOIN others USING (study_id)"),
    ONE("mapping", "matching", "SELECT count(*) FROM pz JOIN listed USING (series_id) WHERE pz.study_id = listed.study_id"), ONE("mapping", "moved", "SELECT count(*) FROM pz JOIN listed USING (series_id) WHERE pz.study_id <> listed.study_id"),
    ONE("partial", "studies", "SELECT count(*) FROM (SELECT study_id, count(DISTINCT series_id) AS n FROM listed GROUP BY 1) JOIN (SELECT study_id, count(DISTINCT series_id) AS m FROM hd GROUP BY 1) USING (study_id) WHERE n <> m"),
    "SELECT 'layout', 'series', count(DISTINCT folder)::DOUBLE FROM hd",
]) + ")")
def structure_figures(t):
    """The whole structure report in long form."""
    headers = health.headers(t).withColumn("path", F.concat(F.lit("S"), F.col("path")))
    listed = health.attributes(t).where("CAST(substring(series_id, 2) AS BIGINT) % 97 != 5")
    return reports.structure_figures(headers, listed, others(t)).withColumn("value", F.round("value", 6))


#: A window that some slices lack, and that has no width on others.
WINDOW = {"window_center": "CAST(CASE WHEN l_linenumber % 3 <> 0 THEN l_linenumber * 30 END AS DOUBLE)", "window_width": "CAST(l_linenumber % 4 * 50 AS DOUBLE)"}


def shades(lines: str, windowed: bool) -> str:
    """Pixels of readable slices in long form, clipped, and between 0 and 1."""
    v = "CASE WHEN wc IS NOT NULL AND ww > 0 AND NOT isnan(v0) THEN least(greatest(v0, wc - ww / 2), wc + ww / 2) ELSE v0 END" if windowed else "v0"
    return f"""s0 AS (SELECT *, {health.FILE['path']} AS path, {health.FILE['photometric']} AS ph, {WINDOW['window_center']} AS wc, {WINDOW['window_width']} AS ww, unnest(range(0, ({ROWS}) * ({COLUMNS}))) AS i FROM (SELECT *, row_number() OVER () AS rn FROM {lines}) WHERE {health.FILE['ok']}),
s1 AS (SELECT *, {v} AS v FROM (SELECT *, {PIXEL.format(i='i', nan="'nan'::DOUBLE")} AS v0 FROM s0)), s2 AS (SELECT *, min(v) FILTER (WHERE NOT isnan(v)) OVER p AS lo, max(v) FILTER (WHERE NOT isnan(v)) OVER p AS hi FROM s1 WINDOW p AS (PARTITION BY rn)),
sh AS (SELECT path, rn, i, CASE WHEN lo = hi THEN 0 WHEN NOT isnan(v) THEN CASE WHEN ph = 'MONOCHROME1' THEN ((hi - (v - lo)) - lo) / (hi - lo) ELSE (v - lo) / (hi - lo) END END AS p FROM s2)"""


@query(f"WITH {shades('lineitem', True)} SELECT path, count(p) AS n, round(sum(p), 6) AS total, round(min(CASE WHEN i = 1 THEN p END), 6) AS second, round(sum(i * p), 6) AS weighted FROM sh GROUP BY path, rn UNION ALL SELECT {health.FILE['path']}, NULL, NULL, NULL, NULL FROM lineitem WHERE NOT ({health.FILE['ok']})")
def previews_windowed(t):
    """Display previews of all slices, clipped to their window where they have one."""
    d = previews.with_preview(decoded(t, health.FILE["photometric"], *[f"{e} AS {n}" for n, e in WINDOW.items()]), windowed=True)
    sum_of = lambda x: F.aggregate(x, F.lit(0.0), lambda a, v: a + F.coalesce(v, F.lit(0.0)))
    p = F.col("preview")
    return d.select("path", F.when(p.isNotNull(), F.size(F.filter(p, lambda v: v.isNotNull()))).cast("long").alias("n"), F.round(sum_of(p), 6).alias("total"), F.round(F.get(p, F.lit(1)), 6).alias("second"), F.round(sum_of(F.transform(p, lambda v, i: v * i)), 6).alias("weighted"))


@query(f"""{health.STAGE1}, w AS (SELECT *, CASE WHEN len(list_filter(codes, lambda v: v IN ('mixed_size', 'mixed_orientation'))) > 0 THEN 'INVALID' WHEN len(codes) > 0 THEN 'WARNING' ELSE 'VALID' END AS status FROM c),
o AS (SELECT k, path, description, CAST(row_number() OVER (PARTITION BY k ORDER BY CASE WHEN spatial THEN CASE WHEN axis = 1 THEN -pos ELSE pos END END, path) - 1 AS INTEGER) AS idx FROM q),
e AS (SELECT w.k, w.n, w.plane, w.status, unnest(CASE WHEN w.n <= 5 THEN range(0, w.n) ELSE list_transform(range(0, 5), lambda i: CAST(round_even(i * ((w.n - 1) / 4.0::DOUBLE), 0) AS BIGINT)) END) AS place FROM w WHERE status <> 'INVALID'),
pk AS (SELECT DISTINCT e.*, o.path FROM e JOIN o ON e.k = o.k AND e.place = o.idx), li AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, min(l_quantity) AS l_quantity FROM lineitem SEMI JOIN pk ON pk.path = {health.FILE['path']} GROUP BY 1, 2, 3, 4), {shades('li', False)},
b AS (SELECT path, CAST(sum(floor(coalesce(p, 0) * 255 + 0.5)) AS BIGINT) AS light FROM sh GROUP BY path), sz AS (SELECT DISTINCT l_orderkey AS k, {ROWS} AS r, {COLUMNS} AS c FROM lineitem),
m AS (SELECT pk.k, any_value(n) AS n, any_value(plane) AS plane, any_value(status) AS status, count(*) AS n_tiles, count(*) - count(light) AS n_errors, CAST(coalesce(sum(light), 0) AS BIGINT) AS light, string_agg(concat('idx ', place, '/', n - 1, ' ', right(pk.path, 10), CASE WHEN light IS NULL THEN ': decode error: too few pixels' ELSE '' END), chr(10) ORDER BY place) AS captions FROM pk LEFT JOIN b ON pk.path = b.path GROUP BY pk.k)
SELECT concat('S', m.k) AS series_id, concat('T', m.k % 500, '_S', m.k, '_', plane, '.png') AS name, concat(o.description, ' | plane=', plane, ' | ', n, ' slices | ', status) AS title, captions, CAST(n_tiles AS INTEGER) AS n_tiles, CAST(n_errors AS INTEGER) AS n_errors,
CAST(n_tiles * (CASE WHEN n_errors = n_tiles THEN 32 ELSE c END + 4) - 4 AS INTEGER) AS width, CAST(CASE WHEN n_errors = n_tiles THEN 32 ELSE r END AS INTEGER) AS height, light + n_errors * 510 * CASE WHEN n_errors = n_tiles THEN 32 ELSE r END AS light FROM m JOIN sz ON m.k = sz.k JOIN o ON m.k = o.k AND o.idx = 0""")
def mosaics_of_series(t):
    """Five slices of each valid series as an image: what it says, its size, and its brightness as read back from it."""
    slices = health.collection.slice_table(health.dicom(t))
    series = health.collection.validated(health.collection.series_table(slices))
    # Some line items share their keys; a path is one file.
    once = t("lineitem").groupBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").agg(F.min("l_quantity").alias("l_quantity"))
    made = visualize.series_mosaics(visualize.picks(visualize.shown(series), slices), decoded(lambda _: once, health.FILE["photometric"]))
    read = brightness()(F.col("image"))
    return made.withColumn("_read", read).select("series_id", "name", "title", F.col("_read.captions").alias("captions"), "n_tiles", "n_errors", "width", "height", F.col("_read.light").alias("light"))


def brightness():
    @F.arrow_udf("light long, captions string")
    def read(images):
        import pyarrow as pa

        rows = [{"light": int(previews.png_bytes(i.as_py()).sum()), "captions": dict(previews.texts(i.as_py()))["Description"]} for i in images]
        return pa.array(rows, type=pa.struct([("light", pa.int64()), ("captions", pa.string())]))

    return read
