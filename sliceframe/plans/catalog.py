"""Query catalogue: one Spark query and its DuckDB oracle per operator.

Roles on the driver's tables: a study is a customer, user or label; a series is
an order or a user's sequence of events; a slice is a line item or an event.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sliceframe import settings
from sliceframe.functions import scalar, vector
from sliceframe.operators import aggregates as A
from sliceframe.operators import metrics, ordering, pooling, quality, ranks, sampling, selection, split

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from sliceframe.plans import encoded, health, imaging, scoring  # noqa: F401  register their queries here

    return QUERIES


def oracle_sql() -> dict[str, str]:
    from sliceframe.plans import encoded, health, imaging, scoring  # noqa: F401

    return ORACLES


def labelled(t, *more: str) -> DataFrame:
    return t("documents").select("doc_id", *more).join(t("labels"), "doc_id", "left")


def seconds(c: str = "ts"):
    return (F.unix_micros(F.col(c).cast("timestamp")) / F.lit(1e6)).cast("double")


WIDE = "w AS (SELECT d.doc_id, d.n_chars, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"
LONG = f"{WIDE}, lg AS (SELECT doc_id, n_chars, 'quality' AS label, quality AS y FROM w UNION ALL SELECT doc_id, n_chars, 'toxic', toxic FROM w)"
STATS = f"""{LONG}, st AS (SELECT label, count(*) AS total, count(y) AS labeled, CAST(count(CASE WHEN y > 0 THEN 1 END) AS BIGINT) AS positive,
  count(CASE WHEN y = 0 THEN 1 END) AS negative, count(*) - count(y) AS missing,
  round(count(CASE WHEN y > 0 THEN 1 END) / CAST(nullif(count(y), 0) AS DOUBLE), 6) AS prevalence FROM lg GROUP BY label)"""


@query(f"WITH {STATS} SELECT * FROM st")
def label_statistics(t):
    return A.label_statistics(labelled(t), ["quality", "toxic"])


JOINT = """j AS (SELECT 'quality' AS a, 'quality' AS b, count(CASE WHEN quality > 0 THEN 1 END) AS joint FROM labels
  UNION ALL SELECT 'quality', 'toxic', count(CASE WHEN quality > 0 AND toxic > 0 THEN 1 END) FROM labels
  UNION ALL SELECT 'toxic', 'quality', count(CASE WHEN quality > 0 AND toxic > 0 THEN 1 END) FROM labels
  UNION ALL SELECT 'toxic', 'toxic', count(CASE WHEN toxic > 0 THEN 1 END) FROM labels)"""


@query(f"WITH {JOINT} SELECT * FROM j")
def label_cooccurrence(t):
    return A.cooccurrence(t("labels"), ["quality", "toxic"])


@query(f"WITH {JOINT} SELECT x.a, x.b, x.joint, round(x.joint / CAST(nullif(p.joint + q.joint - x.joint, 0) AS DOUBLE), 6) AS jaccard FROM j x JOIN j p ON p.a = x.a AND p.b = x.a JOIN j q ON q.a = x.b AND q.b = x.b WHERE x.a < x.b")
def label_jaccard(t):
    return A.jaccard(t("labels"), ["quality", "toxic"])


@query(f"WITH {WIDE} SELECT count(CASE WHEN coalesce(quality, toxic) IS NOT NULL THEN 1 END) AS n_any, count(CASE WHEN coalesce(quality, toxic) IS NULL THEN 1 END) AS n_none FROM w")
def labeled_any_all(t):
    any_ = F.coalesce("quality", "toxic")
    return labelled(t).agg(F.count_if(any_.isNotNull()).alias("n_any"), F.count_if(any_.isNull()).alias("n_none"))


@query("SELECT k, count(*) AS n FROM (SELECT CAST(quality + toxic AS BIGINT) AS k FROM labels) GROUP BY k")
def positives_per_item(t):
    return t("labels").select((F.col("quality") + F.col("toxic")).cast("long").alias("k")).groupBy("k").agg(F.count("*").alias("n"))


@query(f"WITH {STATS} SELECT label, prevalence, row_number() OVER (ORDER BY prevalence DESC NULLS LAST, label) AS rnk FROM st")
def label_ranked(t):
    s = A.label_statistics(labelled(t), ["quality", "toxic"]).select("label", "prevalence")
    return s.withColumn("rnk", F.row_number().over(Window.orderBy(F.desc_nulls_last("prevalence"), "label")).cast("long"))


PER = "p AS (SELECT l_orderkey, count(DISTINCT l_linenumber) AS n_items FROM lineitem GROUP BY l_orderkey)"


@query(f"WITH {PER} SELECT * FROM p")
def items_per_group(t):
    return t("lineitem").groupBy("l_orderkey").agg(F.count_distinct("l_linenumber").alias("n_items"))


@query(f"WITH {PER} SELECT n_items AS k, count(*) AS n FROM p GROUP BY n_items")
def items_per_group_hist(t):
    return A.histogram(t("lineitem"), "l_orderkey", F.count_distinct("l_linenumber"))


@query("""SELECT count(x) AS n, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std, round(min(x), 6) AS min, round(quantile_cont(x, 0.01), 6) AS p1, round(quantile_cont(x, 0.25), 6) AS p25,
round(quantile_cont(x, 0.5), 6) AS median, round(quantile_cont(x, 0.75), 6) AS p75, round(quantile_cont(x, 0.99), 6) AS p99, round(max(x), 6) AS max FROM (SELECT l_extendedprice AS x FROM lineitem)""")
def describe_numeric(t):
    return A.describe(t("lineitem"), "l_extendedprice")


@query("SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderstatus IS NOT NULL GROUP BY 1")
def value_counts(t):
    return A.value_counts(t("orders"), "o_orderstatus")


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY 1, 2")
def value_counts_by(t):
    return A.value_counts(t("lineitem"), "l_returnflag", "l_linestatus")


@query("SELECT p_brand, p_size, p_type, count(*) AS n FROM part GROUP BY 1, 2, 3")
def combo_counts(t):
    return A.value_counts(t("part"), "p_brand", "p_size", "p_type")


@query("SELECT count(*) AS n_rows, count(DISTINCT text) AS n_keys, count(*) - count(DISTINCT text) AS n_duplicates FROM documents")
def duplicate_counts(t):
    return A.duplicate_count(t("documents"), "text")


@query(f"WITH {WIDE}, n AS (SELECT 'quality' AS \"column\", count(*) - count(quality) AS n_null FROM w UNION ALL SELECT 'toxic', count(*) - count(toxic) FROM w UNION ALL SELECT 'doc_id', count(*) - count(doc_id) FROM w) SELECT * FROM n WHERE n_null > 0")
def null_counts(t):
    return A.null_counts(labelled(t), ["quality", "toxic", "doc_id"])


@query("SELECT l_returnflag, round(avg(CASE WHEN l_discount = 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS rate, count(*) AS n FROM lineitem GROUP BY 1")
def boolean_rates(t):
    rate = F.avg(F.coalesce(F.col("l_discount") == 0, F.lit(False)).cast("double"))
    return t("lineitem").groupBy("l_returnflag").agg(F.round(rate, 6).alias("rate"), F.count("*").alias("n"))


@query("SELECT nullif(event_type, 'click') AS k, round(min(value), 6) AS lo, round(max(value), 6) AS hi, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def group_minmaxmean(t):
    e = t("events").withColumn("k", F.nullif("event_type", F.lit("click")))
    return e.groupBy("k").agg(*[F.round(f("value"), 6).alias(n) for f, n in ((F.min, "lo"), (F.max, "hi"), (F.avg, "mean"))])


@query("""WITH c AS (SELECT user_id, upper(trim(event_type)) AS value, count(*) AS n, min((ts, event_id)) AS first FROM events WHERE trim(event_type) <> '' GROUP BY 1, 2)
SELECT user_id, value, n FROM c QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, first) = 1""")
def majority_value(t):
    return A.majority(t("events"), "user_id", F.col("event_type"), [F.col("ts"), F.col("event_id")])


@query("SELECT sha256(text) AS sha256, count(*) AS n, min(doc_id) AS first_key, array_to_string(list_sort(list(doc_id))[1:5], ' ') AS examples FROM documents GROUP BY 1 HAVING count(*) > 1")
def content_hash_dups(t):
    d = A.content_duplicates(t("documents"), F.col("text"), "doc_id")
    return d.withColumn("examples", F.array_join(F.transform("examples", lambda x: x.cast("string")), " "))


@query("SELECT l_orderkey, count(DISTINCT l_returnflag) AS n_values FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) > 1")
def inconsistent_groups(t):
    return A.multi_valued(t("lineitem"), "l_orderkey", "l_returnflag")


@query("SELECT l_partkey, count(DISTINCT l_suppkey) AS n_values FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) > 1")
def multi_parent_keys(t):
    return A.multi_valued(t("lineitem"), "l_partkey", "l_suppkey")


@query("SELECT o_orderkey, o_custkey, c_name, c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def attach_attributes(t):
    c = t("customer").select("c_custkey", "c_name", "c_mktsegment")
    return t("orders").join(c, F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", "o_custkey", "c_name", "c_mktsegment")


@query("""WITH a AS (SELECT o_custkey AS study, count(*) AS n_listed FROM orders GROUP BY 1), b AS (SELECT o_custkey AS study, count(DISTINCT l_orderkey) AS n_found FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_orderkey % 9 <> 0 GROUP BY 1)
SELECT study, n_listed, n_found FROM a JOIN b USING (study) WHERE n_listed <> n_found""")
def count_mismatch(t):
    """Studies whose number of listed series differs from that found."""
    listed = t("orders").groupBy(F.col("o_custkey").alias("study")).agg(F.count("*").alias("n_listed"))
    series = t("lineitem").where(F.col("l_orderkey") % 9 != 0).select("l_orderkey").distinct()
    found = series.join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("o_custkey").alias("study")).agg(F.count("*").alias("n_found"))
    return listed.join(found, "study").where("n_listed != n_found")


@query("""WITH a AS (SELECT o_orderkey, CASE WHEN o_orderkey % 41 = 0 THEN 0 ELSE o_custkey % 25 END AS nation FROM orders)
SELECT nation, bool_and(nation = c_nationkey) AS consistent, count(*) AS n FROM a JOIN orders USING (o_orderkey) JOIN customer ON o_custkey = c_custkey GROUP BY 1""")
def mapping_consistency(t):
    """Whether a mapping from orders to nations agrees with that of the customers, by nation."""
    a = t("orders").select("o_custkey", F.when(F.col("o_orderkey") % 41 == 0, F.lit(0)).otherwise(F.col("o_custkey") % 25).cast("long").alias("nation"))
    j = a.join(t("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    return j.groupBy("nation").agg(F.bool_and(F.col("nation") == F.col("c_nationkey")).alias("consistent"), F.count("*").alias("n"))


@query("SELECT o_orderkey FROM orders ANTI JOIN lineitem ON o_orderkey = l_orderkey")
def orphans_left(t):
    return t("orders").select("o_orderkey").join(t("lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti")


@query("SELECT l_orderkey FROM lineitem ANTI JOIN (SELECT * FROM orders WHERE o_orderkey % 7 <> 0) ON o_orderkey = l_orderkey")
def orphans_right(t):
    return t("lineitem").select("l_orderkey").join(t("orders").where(F.col("o_orderkey") % 7 != 0), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti")


@query("SELECT doc_id, lang, source FROM documents SEMI JOIN labels USING (doc_id)")
def semi_lookup(t):
    return t("documents").select("doc_id", "lang", "source").join(t("labels"), "doc_id", "left_semi")


@query("SELECT d.doc_id, CAST(coalesce(l.quality, -1) AS INTEGER) AS quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def coalesce_lookup(t):
    return labelled(t).select("doc_id", F.coalesce("quality", F.lit(-1)).cast("int").alias("quality"))


@query("SELECT count(*) AS n FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels)")
def overlap_count(t):
    return t("documents").select("doc_id").intersect(t("labels").select("doc_id")).agg(F.count("*").alias("n"))


@query("SELECT DISTINCT lang FROM documents WHERE lang NOT IN ('en', 'de')")
def domain_violation(t):
    return t("documents").select("lang").where(~F.col("lang").isin("en", "de")).distinct()


@query("SELECT (SELECT count(*) FROM (SELECT n_nationkey FROM nation EXCEPT SELECT c_nationkey FROM customer)) + (SELECT count(*) FROM (SELECT c_nationkey FROM customer EXCEPT SELECT n_nationkey FROM nation)) = 0 AS equal")
def set_equality(t):
    a, b = t("nation").select(F.col("n_nationkey").alias("k")).distinct(), t("customer").select(F.col("c_nationkey").alias("k")).distinct()
    sides = a.withColumn("s", F.lit(1)).unionByName(b.withColumn("s", F.lit(2))).groupBy("k").agg(F.count("*").alias("n"))
    return sides.agg((F.count_if(F.col("n") == 1) == 0).alias("equal"))


@query("SELECT 0::INTEGER AS ord, 'view' AS slot, event_id FROM events WHERE event_type = 'view' UNION ALL SELECT 1, 'click', event_id FROM events WHERE event_type = 'click'")
def union_slots(t):
    e = t("events").where(F.col("event_type").isin("view", "click"))
    return e.select(F.when(F.col("event_type") == "view", 0).otherwise(1).alias("ord"), F.col("event_type").alias("slot"), "event_id")


@query("SELECT p_type, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, p_type LIMIT 15")
def top_k_counts(t):
    return A.value_counts(t("part"), "p_type", top=15)


EV = "e AS (SELECT *, epoch_us(ts) / 1e6::DOUBLE AS s FROM events)"


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx FROM events")
def ordered_series(t):
    d = ordering.order_rows(t("events"), ["user_id"], seconds(), F.lit(None).cast("int"), F.col("event_id"))
    return d.select("user_id", "event_id", F.col("idx").cast("long").alias("idx"))


FALLBACK = """f AS (SELECT user_id, event_id, CASE WHEN user_id % 3 = 0 AND value < 5 THEN NULL ELSE value END AS pos, CASE WHEN user_id % 2 = 0 AND value > 95 THEN NULL ELSE event_id % 7 END AS inst FROM events),
m AS (SELECT *, CASE WHEN bool_and(pos IS NOT NULL) OVER (PARTITION BY user_id) THEN 'spatial' WHEN bool_and(inst IS NOT NULL) OVER (PARTITION BY user_id) THEN 'instance_number' ELSE 'sop_instance_uid' END AS method FROM f)"""


@query(f"""WITH {FALLBACK} SELECT user_id, event_id, method, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN method = 'spatial' THEN pos END NULLS FIRST,
CASE WHEN method = 'spatial' THEN coalesce(inst, 0) WHEN method = 'instance_number' THEN inst END NULLS FIRST, event_id) - 1 AS idx FROM m""")
def order_fallback(t):
    pos = F.when(~((F.col("user_id") % 3 == 0) & (F.col("value") < 5)), F.col("value"))
    inst = F.when(~((F.col("user_id") % 2 == 0) & (F.col("value") > 95)), F.col("event_id") % 7)
    d = ordering.order_rows(t("events").withColumn("pos", pos).withColumn("inst", inst), ["user_id"], F.col("pos"), F.col("inst"), F.col("event_id"))
    return d.select("user_id", "event_id", "method", F.col("idx").cast("long").alias("idx"))


GAPS = f"{EV}, g AS (SELECT user_id, s, abs(s - lag(s) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS gap FROM e)"
GAPSTAT = f"""{GAPS}, gs AS (SELECT user_id, count(*) AS n, round(median(gap), 6) AS median_gap, round(CASE WHEN avg(gap) > 0 THEN stddev_pop(gap) / avg(gap) END, 6) AS gap_cv,
count(CASE WHEN gap < 1e-3 THEN 1 END) AS n_dup, round(max(s) - min(s), 6) AS span FROM g GROUP BY 1)"""


@query(f"WITH {GAPSTAT} SELECT * FROM gs")
def gap_statistics(t):
    return ordering.gap_statistics(t("events"), ["user_id"], seconds(), [F.col("ts"), F.col("event_id")])


@query("""WITH r AS (SELECT user_id, rank() OVER (PARTITION BY user_id ORDER BY event_id) + (count(*) OVER (PARTITION BY user_id, event_id) - 1) / 2.0::DOUBLE AS x,
rank() OVER (PARTITION BY user_id ORDER BY value) + (count(*) OVER (PARTITION BY user_id, value) - 1) / 2.0::DOUBLE AS y FROM events WHERE value IS NOT NULL),
c AS (SELECT user_id, count(*) AS n, CASE WHEN stddev_pop(x) > 0 AND stddev_pop(y) > 0 THEN covar_pop(x, y) / (stddev_pop(x) * stddev_pop(y)) END AS rho FROM r GROUP BY 1)
SELECT user_id, n, round(rho, 6) AS rho, CASE WHEN rho > 0 THEN 'up' WHEN rho < 0 THEN 'down' END AS direction FROM c""")
def spearman_order(t):
    return ordering.spearman(t("events"), ["user_id"], F.col("event_id"), F.col("value"), missing_last=True)


@query("""SELECT l_orderkey, count(*) AS n, CAST(min(l_linenumber) AS BIGINT) AS lo, CAST(max(l_linenumber) AS BIGINT) AS hi, count(*) - count(l_linenumber) AS n_missing,
count(DISTINCT l_linenumber) = count(l_linenumber) AS "unique", min(l_linenumber) = 1 AND max(l_linenumber) = count(*) AND count(DISTINCT l_linenumber) = count(*) AS contiguous FROM lineitem GROUP BY 1""")
def contiguity(t):
    return ordering.contiguity(t("lineitem"), ["l_orderkey"], F.col("l_linenumber"))


@query("""WITH o AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT * FROM (SELECT user_id, event_id, idx, CASE WHEN idx = n - 1 THEN 'last' WHEN idx = n // 2 THEN 'middle' WHEN idx = 0 THEN 'first' END AS pick FROM o) WHERE pick IS NOT NULL""")
def first_mid_last(t):
    d = ordering.first_mid_last(t("events"), ["user_id"], [F.col("ts"), F.col("event_id")])
    return d.select("user_id", "event_id", F.col("idx").cast("long").alias("idx"), "pick")


CROSS = """v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
x AS (SELECT vec_id, label, e[2] * e[6] - e[3] * e[5] AS a, e[3] * e[4] - e[1] * e[6] AS b, e[1] * e[5] - e[2] * e[4] AS c FROM v),
u AS (SELECT vec_id, label, a / sqrt(a * a + b * b + c * c) AS a, b / sqrt(a * a + b * b + c * c) AS b, c / sqrt(a * a + b * b + c * c) AS c FROM x WHERE sqrt(a * a + b * b + c * c) >= 1e-8)"""


@query(f"""WITH {CROSS}, s AS (SELECT *, greatest(abs(a), abs(b), abs(c)) AS hi, abs(a) + abs(b) + abs(c) - greatest(abs(a), abs(b), abs(c)) - least(abs(a), abs(b), abs(c)) AS mid FROM u)
SELECT vec_id, CASE WHEN hi >= 0.8 AND hi - mid >= 0.2 THEN CASE WHEN abs(a) = hi THEN 'sagittal' WHEN abs(b) = hi THEN 'coronal' ELSE 'axial' END ELSE 'unknown' END AS plane, round(hi, 6) AS alignment FROM s""")
def plane_from_vector(t):
    n = t("embeddings").select("vec_id", vector.slice_normal(F.transform("embedding", lambda x: x.cast("double"))).alias("n")).where("n is not null")
    return n.select("vec_id", vector.plane_of(F.col("n")).alias("plane"), F.round(F.array_max(F.transform("n", lambda x: F.abs(x))), 6).alias("alignment"))


@query(f"""WITH {CROSS}, m AS (SELECT label, avg(a) AS ma, avg(b) AS mb, avg(c) AS mc FROM u GROUP BY 1)
SELECT label, round(max(sqrt((a - ma) ** 2 + (b - mb) ** 2 + (c - mc) ** 2)), 6) AS spread FROM u JOIN m USING (label) GROUP BY 1""")
def vector_spread(t):
    n = t("embeddings").select("label", vector.slice_normal(F.transform("embedding", lambda x: x.cast("double"))).alias("n")).where("n is not null")
    n = n.select("label", *[F.get("n", F.lit(i)).alias(c) for i, c in enumerate("abc")])
    m = n.groupBy("label").agg(*[F.avg(c).alias("m" + c) for c in "abc"])
    far = F.sqrt(sum((F.pow(F.col(c) - F.col("m" + c), 2) for c in "abc"), F.lit(0.0)))
    return n.join(m, "label").groupBy("label").agg(F.round(F.max(far), 6).alias("spread"))


@query("SELECT CAST(sign(embedding[1]) AS INTEGER) AS sx, CAST(sign(embedding[2]) AS INTEGER) AS sy, CAST(sign(embedding[3]) AS INTEGER) AS sz, count(*) AS n FROM embeddings GROUP BY 1, 2, 3")
def sign_combos(t):
    s = [F.signum(F.get("embedding", F.lit(i)).cast("double")).cast("int").alias(n) for i, n in enumerate(("sx", "sy", "sz"))]
    return t("embeddings").select(*s).groupBy("sx", "sy", "sz").agg(F.count("*").alias("n"))


@query("""WITH h AS (SELECT p_partkey, contains(replace(upper(p_name), ' ', ''), 'RED') AS r, contains(replace(upper(p_name), ' ', ''), 'BLUE') AS b, contains(replace(upper(p_name), ' ', ''), '1') AS o FROM part)
SELECT p_partkey, CASE WHEN r::INT + b::INT + o::INT = 1 THEN CASE WHEN r THEN 'red' WHEN b THEN 'blue' ELSE 'one' END END AS hint FROM h""")
def desc_hint(t):
    return t("part").select("p_partkey", scalar.description_hint(F.col("p_name"), {"red": ("RED",), "blue": ("BLUE",), "one": ("1",)}).alias("hint"))


@query("""SELECT lang, count(CASE WHEN regexp_matches(text, 'license|licence', 'i') THEN 1 END) AS n_license, count(CASE WHEN regexp_matches(text, 'él', 'i') THEN 1 END) AS n_el FROM documents GROUP BY 1""")
def regex_markers(t):
    return t("documents").groupBy("lang").agg(F.count_if(F.col("text").rlike("(?iu)license|licence")).alias("n_license"), F.count_if(F.col("text").rlike("(?iu)él")).alias("n_el"))


@query("SELECT lang, CAST(min(length(text)) AS BIGINT) AS lo, round(median(length(text)), 6) AS median, CAST(max(length(text)) AS BIGINT) AS hi FROM documents GROUP BY 1")
def text_length_stats(t):
    n = F.char_length("text")
    ends = t("documents").groupBy("lang").agg(F.min(n).cast("long").alias("lo"), F.max(n).cast("long").alias("hi"))
    middle = ranks.percentiles(t("documents"), ["lang"], n, [0.5]).select(F.col("lang").alias("_l"), F.round("value", 6).alias("median"))
    return ends.join(middle, F.col("lang").eqNullSafe(F.col("_l")), "left").select("lang", "lo", "median", "hi")


@query("SELECT p_partkey, CAST(p_size AS DOUBLE) AS a, p_retailprice AS b, CAST(NULL AS DOUBLE) AS c FROM part")
def vector_parse(t):
    p = t("part").select("p_partkey", F.concat_ws(";", "p_size", "p_retailprice").alias("v"), F.concat_ws(";", "p_size", "p_name").alias("w"))
    v = scalar.parse_vector(F.col("v"), 2)
    return p.select("p_partkey", F.get(v, F.lit(0)).alias("a"), F.get(v, F.lit(1)).alias("b"), F.get(scalar.parse_vector(F.col("w"), 2), F.lit(0)).alias("c"))


@query("""SELECT event_id, TRY_CAST(nullif(trim(props->>'$.k'), '') AS INTEGER) AS k, TRY_CAST(event_type AS DOUBLE) AS bad FROM events""")
def safe_casts(t):
    return t("events").select("event_id", scalar.blank_to_null(F.get_json_object("props", "$.k")).try_cast("int").alias("k"), F.col("event_type").try_cast("double").alias("bad"))


SERIES = """s AS (SELECT l_orderkey, count(*) AS n, count(DISTINCT l_returnflag) AS n_flag, count(DISTINCT l_linestatus) AS n_status, min(l_quantity) AS lo,
stddev_pop(l_extendedprice) / nullif(avg(l_extendedprice), 0) AS cv, count(*) - count(DISTINCT l_linenumber) AS n_dup FROM lineitem GROUP BY 1),
c AS (SELECT *, list_filter([CASE WHEN n_flag > 1 THEN 'mixed_size' END, CASE WHEN n_status > 1 THEN 'mixed_spacing' END, CASE WHEN n_dup > 0 THEN 'duplicate_positions' END,
CASE WHEN cv > 0.15 THEN 'irregular_gaps' END, CASE WHEN n < 4 THEN 'few_slices' END], lambda x: x IS NOT NULL) AS codes FROM s)"""


@query(f"WITH {SERIES} SELECT l_orderkey, CASE WHEN n_flag > 1 THEN 'INVALID' WHEN len(codes) > 0 THEN 'WARNING' ELSE 'VALID' END AS status, array_to_string(codes, ' | ') AS messages FROM c")
def series_validation(t):
    n = t("lineitem").groupBy("l_orderkey").agg(
        F.count("*").alias("n"), (F.min("l_returnflag") != F.max("l_returnflag")).alias("mixed_flag"), (F.min("l_linestatus") != F.max("l_linestatus")).alias("mixed_status"),
        F.try_divide(F.stddev_pop("l_extendedprice"), F.avg("l_extendedprice")).alias("cv"), (F.count("*") - F.size(F.collect_set("l_linenumber"))).alias("n_dup"),
    )
    rules = [("mixed_size", "INVALID", F.col("mixed_flag")), ("mixed_spacing", "WARNING", F.col("mixed_status")), ("duplicate_positions", "WARNING", F.col("n_dup") > 0), ("irregular_gaps", "WARNING", F.col("cv") > 0.15), ("few_slices", "WARNING", F.col("n") < 4)]
    return quality.apply_rules(n, rules, ok="VALID").select("l_orderkey", "status", F.array_join("codes", " | ").alias("messages"))


@query(f"""WITH {GAPSTAT} SELECT user_id, array_to_string(list_filter([CASE WHEN n < 3 THEN 'insufficient_slices' END, CASE WHEN n_dup > 0 THEN 'duplicate_positions' END, CASE WHEN gap_cv > 0.15 THEN 'inconsistent_spacing' END], lambda x: x IS NOT NULL), ',') AS codes, n >= 3 AS usable FROM gs""")
def series_qc(t):
    g = ordering.gap_statistics(t("events"), ["user_id"], seconds(), [F.col("ts"), F.col("event_id")])
    rules = [("insufficient_slices", "BLOCKING", F.col("n") < 3), ("duplicate_positions", "WARNING", F.col("n_dup") > 0), ("inconsistent_spacing", "WARNING", F.col("gap_cv") > 0.15)]
    return quality.apply_rules(g, rules, ok="OK").select("user_id", F.array_join("codes", ",").alias("codes"), (F.col("status") != "BLOCKING").alias("usable"))


@query("""WITH f AS (SELECT CASE WHEN (SELECT count(*) - count(DISTINCT text) FROM documents) > 0 THEN 'WARNING' ELSE 'INFO' END AS severity
UNION ALL SELECT CASE WHEN (SELECT count(*) FROM documents WHERE lang NOT IN ('en')) > 0 THEN 'WARNING' ELSE 'INFO' END
UNION ALL SELECT CASE WHEN (SELECT count(*) FROM documents WHERE text IS NULL) > 0 THEN 'CRITICAL' ELSE 'INFO' END
UNION ALL SELECT CASE WHEN (SELECT count(*) FROM documents WHERE n_chars = 0) > 0 THEN 'WARNING' ELSE 'INFO' END)
SELECT s.severity, count(f.severity) AS n FROM (VALUES ('CRITICAL'), ('WARNING'), ('INFO')) s(severity) LEFT JOIN f USING (severity) GROUP BY 1""")
def audit_findings(t):
    n = t("documents").agg((F.count("*") - F.count_distinct(F.sha2(F.col("text").cast("binary"), 256))).alias("dups"), F.count_if(F.col("lang") != "en").alias("langs"), F.count_if(F.col("text").isNull()).alias("nulls"), F.count_if(F.col("n_chars") == 0).alias("empty"))
    checks = [("duplicate_images", "WARNING", "INFO", F.col("dups") > 0), ("modality_check", "WARNING", "INFO", F.col("langs") > 0), ("unreadable", "CRITICAL", "INFO", F.col("nulls") > 0), ("constant_or_empty", "WARNING", "INFO", F.col("empty") > 0)]
    return quality.severity_tally(quality.findings(n, checks))


CAND = """b AS (SELECT o_custkey, o_orderkey, o_totalprice, unnest(['F', 'O']) AS slot, o_orderstatus, o_orderpriority FROM orders),
c AS (SELECT o_custkey, slot, o_orderkey, o_totalprice, round(round((o_totalprice / 1e5) / (1 + o_totalprice / 1e5), 6) + 1.5::DOUBLE * CASE WHEN o_orderpriority LIKE '1%' THEN 1 ELSE 0 END, 6) AS score FROM b WHERE o_orderstatus = slot),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY o_custkey, slot ORDER BY score DESC, o_totalprice DESC, o_orderkey) AS INTEGER) AS rnk FROM c)"""


def ranked(t):
    price = F.col("o_totalprice") / 1e5
    parts = {"slices": F.round(scalar.saturating(price), 6), "fluid": F.when(F.col("o_orderpriority").startswith("1"), 1.0).otherwise(0.0)}
    c = selection.per_slot(t("orders"), ["F", "O"], F.col("o_orderstatus") == F.col("slot")).withColumn("score", selection.score(parts, settings.defaults()["ranking_weights"]))
    return selection.rank_candidates(c, ["o_custkey", "slot"], "score", F.col("o_totalprice"), F.col("o_orderkey")).select("o_custkey", "slot", "o_orderkey", "score", "rnk")


@query(f"WITH {CAND} SELECT o_custkey, slot, o_orderkey, score, rnk FROM r")
def rank_candidates(t):
    return ranked(t)


@query(f"WITH {CAND} SELECT o_custkey, slot, o_orderkey, score FROM r WHERE rnk = 1")
def top1_per_slot(t):
    return ranked(t).where("rnk = 1").drop("rnk")


@query("""WITH n AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1),
x AS (SELECT user_id, n, i, CAST(round_even((0.06 + 0.88 * i / 5) * (n - 1), 0) AS INTEGER) AS c FROM n, (SELECT unnest(range(0, 6)) AS i))
SELECT user_id, n, CAST(CASE WHEN n >= 3 THEN greatest(1, least(c, n - 2)) ELSE greatest(0, least(c, n - 1)) END AS INTEGER) AS center_idx FROM x GROUP BY ALL""")
def sample_locations(t):
    n = t("events").groupBy("user_id").agg(F.count("*").alias("n"))
    return n.select("user_id", "n", F.explode(sampling.sample_locations(F.col("n"))).alias("center_idx"))


@query("""SELECT * FROM (SELECT user_id, row_number() OVER w - 1 AS idx, lag(event_id) OVER w AS prev, event_id AS centre, lead(event_id) OVER w AS next FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE prev IS NOT NULL AND next IS NOT NULL""")
def triplets_index(t):
    d = sampling.triplets_by_index(t("events"), ["user_id"], [F.col("ts"), F.col("event_id")], "event_id")
    return d.withColumn("idx", F.col("idx").cast("long"))


@query(f"""WITH {EV}, o AS (SELECT user_id, s, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx FROM e),
st AS (SELECT user_id, median(gap) AS step FROM (SELECT user_id, abs(s - lag(s) OVER (PARTITION BY user_id ORDER BY idx)) AS gap FROM o) GROUP BY 1),
a AS (SELECT c.user_id, c.idx, arg_min(n.idx, (abs(n.s - (c.s - step)), n.idx)) AS prev, arg_min(n.idx, (abs(n.s - (c.s + step)), n.idx)) AS next FROM o c JOIN st USING (user_id) JOIN o n ON n.user_id = c.user_id AND abs(n.idx - c.idx) <= 5 GROUP BY 1, 2)
SELECT user_id, CAST(idx AS INTEGER) AS idx, CAST(prev AS INTEGER) AS prev, CAST(next AS INTEGER) AS next FROM a WHERE prev <> idx AND next <> idx AND prev <> next""")
def triplets_nearest(t):
    e = t("events").withColumn("s", seconds())
    w = Window.partitionBy("user_id")
    gap = e.withColumn("_g", F.abs(F.col("s") - F.lag("s").over(w.orderBy("ts", "event_id")))).groupBy("user_id").agg(F.median("_g").alias("step"))
    d = sampling.triplets_by_distance(e.join(gap, "user_id"), ["user_id"], F.col("s"), [F.col("ts"), F.col("event_id")], step=F.col("step"))
    return d.select("user_id", "idx", "prev", "next")


CLIP = """q AS (SELECT event_type, quantile_cont(value, 0.005) AS lo, quantile_cont(value, 0.995) AS hi FROM events GROUP BY 1), c AS (SELECT event_type, lo, hi, greatest(lo, least(hi, value)) AS x FROM events JOIN q USING (event_type))"""


def clipped(t):
    e = t("events").select("event_type", "value")
    q = ranks.percentiles(e, ["event_type"], F.col("value"), [0.005, 0.995])
    q = q.groupBy("event_type").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    return e.join(q, "event_type").withColumn("x", scalar.clip(F.col("value"), F.col("lo"), F.col("hi")))


@query(f"WITH {CLIP} SELECT event_type, round(avg(CASE WHEN hi > lo THEN (x - lo) / (hi - lo) ELSE 0 END), 6) AS mean FROM c GROUP BY 1")
def clip_normalize(t):
    z = F.when(F.col("hi") > F.col("lo"), (F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.0)
    return clipped(t).groupBy("event_type").agg(F.round(F.avg(z), 6).alias("mean"))


@query(f"WITH {CLIP}, s AS (SELECT event_type, avg(x) AS m, stddev_pop(x) AS sd FROM c GROUP BY 1) SELECT event_type, round(max((x - m) / sd), 6) AS hi, round(min((x - m) / sd), 6) AS lo FROM c JOIN s USING (event_type) GROUP BY 1")
def zscore_normalize(t):
    c = clipped(t).select("event_type", "x")
    s = c.groupBy("event_type").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("sd"))
    z = F.try_divide(F.col("x") - F.col("m"), F.col("sd"))
    return c.join(s, "event_type").groupBy("event_type").agg(F.round(F.max(z), 6).alias("hi"), F.round(F.min(z), 6).alias("lo"))


@query("""WITH o AS (SELECT user_id, value, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 3 AS g FROM events), s AS (SELECT user_id, g, min(value) AS lo, max(value) AS hi FROM o GROUP BY 1, 2)
SELECT user_id, round(avg(CASE WHEN hi > lo THEN (value - lo) / (hi - lo) ELSE 0 END), 6) AS mean FROM o JOIN s USING (user_id, g) GROUP BY 1""")
def group_normalize(t):
    w = Window.partitionBy("user_id")
    o = t("events").withColumn("_i", F.row_number().over(w.orderBy("ts", "event_id")) - 1).withColumn("g", F.expr("_i div 3"))
    tri = Window.partitionBy("user_id", "g")
    lo, hi = F.min("value").over(tri), F.max("value").over(tri)
    o = o.withColumn("lo", lo).withColumn("hi", hi)
    z = F.when(F.col("hi") > F.col("lo"), (F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.0)
    return o.groupBy("user_id").agg(F.round(F.avg(z), 6).alias("mean"))


@query("WITH m AS (SELECT event_type, min(value) AS lo, max(value) AS hi FROM events GROUP BY 1) SELECT event_id, round(hi - (value - lo), 6) AS inverted FROM events JOIN m USING (event_type)")
def invert_values(t):
    m = t("events").groupBy("event_type").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    return t("events").join(m, "event_type").select("event_id", F.round(F.col("hi") - (F.col("value") - F.col("lo")), 6).alias("inverted"))


@query("""WITH a AS (SELECT p_partkey, p_size AS h, p_size + p_partkey % 17 + 1 AS w FROM part), s AS (SELECT *, least(224.0::DOUBLE / h, 224.0::DOUBLE / w) AS k FROM a),
n AS (SELECT *, CAST(greatest(1, round_even(h * k, 0)) AS INTEGER) AS nh, CAST(greatest(1, round_even(w * k, 0)) AS INTEGER) AS nw FROM s)
SELECT p_partkey, round(k, 6) AS scale, nh, nw, (224 - nh) // 2 AS pad_top, 224 - nh - (224 - nh) // 2 AS pad_bottom, (224 - nw) // 2 AS pad_left, 224 - nw - (224 - nw) // 2 AS pad_right FROM n""")
def letterbox_geometry(t):
    from sliceframe.operators.pixels import letterbox_columns

    a = t("part").select("p_partkey", F.col("p_size").alias("h"), (F.col("p_size") + F.col("p_partkey") % 17 + 1).alias("w"))
    return a.select("p_partkey", *letterbox_columns(F.col("h"), F.col("w"), 224, 224))


@query()
def image_normalize_resize(t):
    """Embeddings as 8x8 images, normalised and letterboxed to 16x16; the mean and a digest of each."""
    from sliceframe.operators.pixels import embeddings_as_images

    return embeddings_as_images(t("embeddings"), "vec_id", "embedding", 8, 8, 16)


@query("SELECT c_custkey, count(o_orderkey) AS n_series, count(CASE WHEN o_orderstatus = 'O' THEN 1 END) AS n_valid, round(coalesce(sum(o_totalprice), 0), 2) AS total FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def study_summary(t):
    o = t("orders").groupBy("o_custkey").agg(F.count("*").alias("n_series"), F.count_if(F.col("o_orderstatus") == "O").alias("n_valid"), F.sum("o_totalprice").alias("total"))
    j = t("customer").select("c_custkey").join(o, F.col("c_custkey") == F.col("o_custkey"), "left")
    return j.select("c_custkey", F.coalesce("n_series", F.lit(0)).alias("n_series"), F.coalesce("n_valid", F.lit(0)).alias("n_valid"), F.round(F.coalesce("total", F.lit(0.0)), 2).alias("total"))


@query("SELECT count(*) AS files_seen, count(DISTINCT o_custkey) AS n_studies, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS n_invalid FROM orders")
def scan_stats(t):
    return t("orders").agg(F.count("*").alias("files_seen"), F.count_distinct("o_custkey").alias("n_studies"), F.count_if(F.col("o_orderstatus") == "F").alias("n_invalid"))


@query("""SELECT l_orderkey, count(*) AS n_slices, string_agg(DISTINCT l_returnflag, ' | ' ORDER BY l_returnflag) AS messages, round(min(l_quantity), 6) AS lo, round(max(l_quantity), 6) AS hi FROM lineitem GROUP BY 1""")
def manifest_rows(t):
    return t("lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n_slices"), F.array_join(F.array_sort(F.collect_set("l_returnflag")), " | ").alias("messages"), F.round(F.min("l_quantity"), 6).alias("lo"), F.round(F.max("l_quantity"), 6).alias("hi"))


@query("""SELECT user_id, substr(sha256('{"ids":[' || string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY ts, event_id) || '],"user":' || user_id || ',"version":"2"}'), 1, 24) AS cache_key FROM events GROUP BY user_id""")
def cache_keys(t):
    ids = F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id"))), lambda r: r["event_id"])
    key = F.to_json(F.struct(ids.alias("ids"), F.first("user_id").alias("user"), F.lit("2").alias("version")))
    return t("events").groupBy("user_id").agg(F.substring(F.sha2(key, 256), 1, 24).alias("cache_key"))


WEIGHT = f"{LONG}, k AS (SELECT label, count(CASE WHEN y > 0 THEN 1 END) AS pos, count(CASE WHEN y = 0 THEN 1 END) AS neg FROM lg GROUP BY 1)"


def long(t):
    return A.long_labels(labelled(t, "n_chars"), ["quality", "toxic"], ("doc_id", "n_chars"))


@query(f"WITH {WEIGHT} SELECT label, round(greatest(0.1::DOUBLE, least(10.0::DOUBLE, CASE WHEN pos = 0 THEN 1.0 ELSE neg / pos::DOUBLE END)), 6) AS weight FROM k")
def class_weights_balanced(t):
    return metrics.class_weights(long(t))


@query(f"WITH {WEIGHT}, r AS (SELECT label, (1 - 0.9999::DOUBLE) / greatest(1 - pow(0.9999::DOUBLE, pos), 1e-8::DOUBLE) AS raw FROM k) SELECT label, round(greatest(0.1::DOUBLE, least(10.0::DOUBLE, raw / avg(raw) OVER () * count(*) OVER ())), 6) AS weight FROM r")
def class_weights_effective(t):
    return metrics.class_weights(long(t), "effective_num")


PRED = f"{LONG}, pr AS (SELECT label, y, n_chars / 1000.0::DOUBLE - 2 AS score FROM lg)"


def preds(t):
    return long(t).select("label", "y", (F.col("n_chars") / F.lit(1000.0) - 2).alias("score"))


@query(f"WITH {PRED} SELECT count(*) AS n, round(coalesce(avg((1 - y) * score + (1 + (CASE label WHEN 'quality' THEN 0.5 ELSE 2 END - 1) * y) * (ln(1 + exp(-abs(score))) + greatest(-score, 0))), 0), 6) AS loss FROM pr WHERE y IS NOT NULL")
def bce_loss(t):
    p = preds(t)
    w = p.sparkSession.createDataFrame([("quality", 0.5), ("toxic", 2.0)], "label string, weight double")
    return metrics.bce_loss(p, F.broadcast(w))


@query("SELECT doc_id, round(1 / (1 + exp(-(n_chars / 1000.0::DOUBLE - 2))), 6) AS prob, CAST(1 / (1 + exp(-(n_chars / 1000.0::DOUBLE - 2))) >= 0.5 AS INTEGER) AS decision FROM documents")
def sigmoid_threshold(t):
    p = scalar.sigmoid(F.col("n_chars") / F.lit(1000.0) - 2)
    return t("documents").select("doc_id", F.round(p, 6).alias("prob"), (p >= 0.5).cast("int").alias("decision"))


ROC = f"{PRED}, sc AS (SELECT label, score, CAST(count(CASE WHEN y > 0 THEN 1 END) AS BIGINT) AS p, count(CASE WHEN y = 0 THEN 1 END) AS n FROM pr WHERE y IS NOT NULL GROUP BY 1, 2), cu AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY label ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM sc), roc AS (SELECT label, round(sum(p * (below + n / 2.0::DOUBLE)) / nullif(sum(p) * sum(n), 0)::DOUBLE, 6) AS roc_auc FROM cu GROUP BY 1)"


@query(f"WITH {ROC} SELECT * FROM roc")
def roc_auc_per_label(t):
    return metrics.roc_auc(preds(t))


@query(f"WITH {ROC}, pc AS (SELECT label, p, n, sum(p) OVER w AS tp, sum(p + n) OVER w AS al FROM sc WINDOW w AS (PARTITION BY label ORDER BY score DESC ROWS UNBOUNDED PRECEDING)) SELECT label, round(CASE WHEN sum(n) > 0 THEN sum(p * tp / al::DOUBLE) / nullif(sum(p), 0)::DOUBLE END, 6) AS pr_auc FROM pc GROUP BY 1")
def pr_auc_per_label(t):
    return metrics.average_precision(preds(t))


@query(f"WITH {ROC} SELECT round(coalesce(avg(roc_auc), 0), 6) AS macro_roc_auc, count(roc_auc) AS n_valid FROM roc")
def macro_auc(t):
    return metrics.macro(metrics.roc_auc(preds(t)), "roc_auc")


@query("""WITH u AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS unit FROM events), r AS (SELECT unit, row_number() OVER (ORDER BY md5('42|' || unit), unit) AS rn, count(*) OVER () AS n FROM u) SELECT unit, CASE WHEN rn <= floor(n * 0.8::DOUBLE) THEN 'train' ELSE 'val' END AS split FROM r""")
def split_hash(t):
    return split.split_ids(t("events"), F.col("user_id"))


@query("""WITH u AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS unit FROM events), r AS (SELECT unit, row_number() OVER (ORDER BY md5('42|' || unit), unit) AS rn, count(*) OVER () AS n FROM u)
SELECT count(*) AS n_overlap FROM r WHERE rn <= floor(n * 0.8::DOUBLE) AND CAST(unit AS BIGINT) % 10 = 3""")
def leakage_check(t):
    """Units on both sides of a split, into whose validation side every tenth unit was copied."""
    done = split.split_ids(t("events"), F.col("user_id"))
    return split.leakage(done.unionByName(done.where(F.col("unit").cast("long") % 10 == 3).withColumn("split", F.lit("val")))).agg(F.count("*").alias("n_overlap"))


@query("SELECT label, CAST(i - 1 AS INTEGER) AS i, round(avg(v), 6) AS value FROM (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY 1, 2")
def mean_pool(t):
    return pooling.mean_pool(t("embeddings"), "label", "embedding")


ATT = """a AS (SELECT label, vec_id, embedding, embedding[1]::DOUBLE * 1 + embedding[2]::DOUBLE * -1 + embedding[3]::DOUBLE * 0.5 AS s FROM embeddings), m AS (SELECT label, max(s) AS m FROM a GROUP BY 1),
ex AS (SELECT label, vec_id, embedding, exp(s - m) AS e FROM a JOIN m USING (label)), tt AS (SELECT label, sum(e) AS t FROM ex GROUP BY 1), w AS (SELECT label, vec_id, embedding, e / t AS w FROM ex JOIN tt USING (label))"""
QUERY_VECTOR = [1.0, -1.0, 0.5] + [0.0] * 61


@query(f"WITH {ATT} SELECT label, CAST(i - 1 AS INTEGER) AS i, round(sum(w * v), 6) AS value FROM (SELECT label, w, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM w) GROUP BY 1, 2")
def attention_pool(t):
    return pooling.attention_pool(t("embeddings"), "label", "embedding", pooling.scores(F.col("embedding"), QUERY_VECTOR))


@query(f"WITH {ATT} SELECT label, count(*) AS n, count(CASE WHEN w IS NULL OR isnan(w) THEN 1 END) AS n_bad, abs(sum(w) - 1) < 1e-4 AS sums_to_one FROM w GROUP BY 1")
def attention_checks(t):
    return pooling.attention_checks(pooling.attention(t("embeddings"), "label", pooling.scores(F.col("embedding"), QUERY_VECTOR)), "label")


@query()
def pca_2d(t):
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    v = t("embeddings").select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("v"))
    p = PCA(k=2, inputCol="v", outputCol="p").fit(v).transform(v).select("vec_id", vector_to_array("p").alias("p"))
    return p.select("vec_id", F.get("p", F.lit(0)).alias("x"), F.get("p", F.lit(1)).alias("y"))
