"""Quality rules: an ordered decision list learned by sequential covering, in DataFrame operations only.

Statistics of each text are row-local expressions, so a scan needs no shuffle.
Rules that find low quality are grown condition by condition by FOIL gain on
two thirds of a labelled sample, pruned on the rest, and kept while they are
precise enough there; what a rule covers is removed before the next is grown.
Counts behind every choice come from one small aggregate a step (features times
cut points, whatever the sample's size). The list becomes one conditional
expression.

The classifier may be fitted on a bounded sample: at most ``fit_rows`` labelled
documents, those with the smallest hash of the id. It is scored on all.

Defined results: null text counts as empty (fails the base rule); null labels
are ignored; repeated rows, and rows with a null id, are judged alike; texts of
any length are measured whole; without labels there are no rules and only the
base rule rejects; an empty table gives an empty result; extra columns pass
through, but for one named as the result, which is replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sliceframe.llm.common import SPACE, as_row, durable, let, words

#: Contract: documents with fewer words, or with more than half of them in repeated windows, fail.
MIN_WORDS, REPEAT_PERCENT = 50, 50
FIT_ROWS = 20_000
CUTS = 24
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_shouts", "n_digits")
FEATURES = {
    "mean_word": "word_chars / greatest(n_words, 1)",
    "symbol_share": "n_symbols / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "shout_share": "n_shouts / greatest(n_words, 1)",
    "digit_share": "n_digits / greatest(word_chars, 1)",
    "log_words": "ln(1 + n_words)",
}


def repeat_words(w: Column) -> Column:
    """Words inside 3-word windows that occur at least twice.

    Windows are compared by 64-bit hash. Most texts repeat none, which a distinct
    count shows; else (hash, position) pairs are sorted, and the union of the
    repeated windows is measured in order of position.
    """

    def windows(a: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(a) - 3), lambda i: F.xxhash64(a[i], a[i + 1], a[i + 2]))

    def covered(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return let(pairs, lambda s: let(places(s), union))

    def places(s: Column) -> Column:
        same = lambda j, k: s[j]["h"] == s[k]["h"]
        last = F.size(s) - 1
        hit = F.filter(F.sequence(F.lit(0), last), lambda j: ((j > 0) & same(j, F.greatest(j - 1, F.lit(0)))) | ((j < last) & same(j, F.least(j + 1, last))))
        return F.sort_array(F.transform(hit, lambda j: s[j]["i"]))

    def union(p: Column) -> Column:
        start = F.struct(F.lit(-3).alias("at"), F.lit(0).alias("n"))
        step = lambda acc, x: F.struct(x.alias("at"), (acc["n"] + F.least(F.lit(3), x - acc["at"])).alias("n"))
        return F.aggregate(p, start, step, lambda acc: acc["n"])

    return F.when(
        F.size(w) >= 4,
        let(windows(w), lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(0)),
    ).otherwise(0).cast("long")


def statistics(docs: DataFrame, text: str = "text", out: str = "stats") -> DataFrame:
    """``docs`` with a struct of counts of each text; a column of that name is replaced."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    without = lambda pattern: F.length(F.regexp_replace(t, pattern, ""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    per_words = let(words(t), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeat_words(w).alias("n_repeat_words")))
    per_lines = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    kept = [F.col(f"`{c}`") for c in docs.columns if c != out]
    # A generator of one row keeps the optimizer from copying the counts into every place that reads them.
    return docs.select(
        *kept,
        F.explode(F.array(F.struct(
            per_words.alias("w"),
            per_lines.alias("l"),
            without(SPACE).cast("long").alias("word_chars"),
            without(r"[^#*$%&|<>]+").cast("long").alias("n_symbols"),
            without("[^A-Z]+").cast("long").alias("n_upper"),
            without("[^!?]+").cast("long").alias("n_shouts"),
            without("[^0-9]+").cast("long").alias("n_digits"),
        ))).alias(out),
    )


def flat(stats: str = "stats") -> list[Column]:
    s = F.col(f"`{stats}`")
    return [s["w"]["n_words"].alias("n_words"), s["w"]["n_repeat_words"].alias("n_repeat_words"), s["l"]["n_lines"].alias("n_lines"), s["l"]["n_dup_lines"].alias("n_dup_lines"), *[s[c].alias(c) for c in ("word_chars", "n_symbols", "n_upper", "n_shouts", "n_digits")]]


def learn(labelled: DataFrame, *, features=FEATURES, max_rules: int = 6, max_conditions: int = 3, min_precision: float = 0.95, min_rows: int = 5) -> list[list[tuple[str, str, float]]]:
    """Rules for y = 0 from (features, y, grow): conjunctions of (feature, '>=' or '<', cut).

    ``labelled`` has the counts of :func:`flat`, y and a boolean grow. Each step
    collects one row a feature and cut point at most.
    """
    valued = labelled.select("y", "grow", *[F.expr(e).alias(f) for f, e in features.items()])
    points = valued.agg(*[F.percentile(f, [i / CUTS for i in range(1, CUTS)]).alias(f) for f in features]).first()
    cuts = {f: sorted({float(x) for x in points[f] or ()}) for f in features}
    if not any(cuts.values()):
        return []
    bins = [sum(((F.col(f) >= c).cast("int") for c in cuts[f]), F.lit(0)).alias(f) for f in features]
    data = durable(valued.select("y", "grow", *bins))

    def where(rule) -> Column:
        cond = F.lit(True)
        for f, op, k in rule:
            cond = cond & (F.col(f) > k if op == ">=" else F.col(f) <= k)
        return cond

    def tally(rows: DataFrame) -> dict:
        each = F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).alias("b")) for f in features]))
        got = rows.select("y", each.alias("e")).groupBy("e.f", "e.b").agg(F.count_if(F.col("y") == 0), F.count_if(F.col("y") == 1)).collect()
        return {(r[0], r[1]): (r[2], r[3]) for r in got}

    rules, rest = [], data
    for _ in range(max_rules):
        rule: list[tuple[str, str, int]] = []
        for _ in range(max_conditions):
            counts = tally(rest.where(F.col("grow") & where(rule)))
            p0, n0 = (sum(v[i] for (f, _), v in counts.items() if f == next(iter(features))) for i in (0, 1))
            if p0 < min_rows or n0 == 0:
                break
            best = max(candidates(counts, cuts, p0, n0, min_rows), default=None)
            if best is None or best[0] <= 0:
                break
            rule.append(best[1])
        if not rule:
            break
        tried = rest.where(~F.col("grow")).agg(*[F.count_if((F.col("y") == y) & where(rule[:k])) for k in range(1, len(rule) + 1) for y in (0, 1)]).first()
        worth = [((tried[2 * i] - tried[2 * i + 1]) / max(1, tried[2 * i] + tried[2 * i + 1]), -i) for i in range(len(rule))]
        k = -max(worth)[1]
        p, n = tried[2 * k], tried[2 * k + 1]
        if p < min_rows or p < min_precision * (p + n):
            break
        rule = rule[: k + 1]
        rules.append([(f, op, cuts[f][b]) for f, op, b in rule])
        rest = rest.where(~where(rule))
    return rules


def candidates(counts, cuts, p0, n0, min_rows):
    """(FOIL gain, (feature, operator, index of the cut)) of each possible condition."""
    base = math.log2(p0 / (p0 + n0))
    for f in sorted(cuts):
        for k in range(len(cuts[f])):
            above = [sum(v[i] for (g, b), v in counts.items() if g == f and b > k) for i in (0, 1)]
            for op, (p, n) in ((">=", above), ("<", [p0 - above[0], n0 - above[1]])):
                if p >= min_rows:
                    yield p * (math.log2(p / (p + n)) - base), (f, op, k)


def verdict(rules, features=FEATURES) -> Column:
    """True where no rule applies, as an ordered conditional expression over the counts."""
    out = None
    for rule in rules:
        cond = F.lit(True)
        for f, op, cut in rule:
            x = F.expr(features[f])
            cond = cond & (x >= F.lit(cut) if op == ">=" else x < F.lit(cut))
        out = F.when(cond, F.lit(False)) if out is None else out.when(cond, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def fit(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "quality", fit_rows: int = FIT_ROWS, seed: int = 11, **how) -> list:
    """Learn rules from at most ``fit_rows`` labelled documents that pass the base rule."""
    h = F.xxhash64(F.lit(seed), F.col(key))
    some = labels.where(F.col(label).isNotNull()).select(F.col(key), F.col(label).alias("y")).orderBy(h, key, "y").limit(fit_rows)
    # The sample's bound is its parameter: fit_rows rows of two numbers.
    sample = docs.select(F.col(key), F.col(text).alias("text")).join(F.broadcast(some), key)
    counted = statistics(sample).select(key, "y", *flat())
    return learn(counted.where(~base_failed()).withColumn("grow", F.pmod(F.xxhash64(F.lit(seed + 1), F.col(key)), F.lit(3)) > 0), **how)


def judge(docs: DataFrame, rules, *, text: str = "text", out: str = "quality_rules") -> DataFrame:
    """``docs`` with a struct ``out``: the counts, base_failed and kept."""
    return judged(docs, rules, text).select(*[F.col("row").getField(c).alias(c) for c in docs.columns if c != out], F.col("verdict").alias(out))


def judged(docs: DataFrame, rules, text: str = "text") -> DataFrame:
    """(row, verdict)"""
    counted = statistics(docs.select(as_row(docs).alias("row"), F.col(f"`{text}`").alias("text")))
    failed = base_failed()
    return counted.select("row", *flat()).select("row", F.struct(*COUNTS, failed.alias("base_failed"), (~failed & verdict(rules)).alias("kept")).alias("verdict"))


def stage(spark, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents that the base rule and the learned list keep."""
    return judged(docs, fit(docs, labels)).where("verdict.kept").select("row.*")


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    rules = fit(docs, labels)
    return judge(docs.select("doc_id", "text"), rules).select("doc_id", *[f"quality_rules.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")])
