"""License scan with ordered signature rules, in DataFrame operations only.

A rule has a keyword (a word of each of its matches, so that line breaks don't
matter), a regular expression, a label and a priority, all written
by hand in ``license_signatures``. Only rules whose keyword occurs in the text
run. Their matches become intervals in code points, and a match that
lies inside an interval of the same or a better priority is suppressed. All of
it is row-local: no shuffle, no Python.

Besides, three fixed phrases are counted as runs of words.

Defined results: null text counts as empty; repeated rows are judged alike;
words are kept apart by anything but ASCII letters, digits and non-ASCII
characters; of equal intervals with equal priorities one stays; texts of any
length are scanned whole; rows with a null id are judged like others; an empty
table gives an empty result; extra columns pass through, but for one named as
the result, which is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sliceframe.llm.common import BREAK, WORD, count_between, let
from sliceframe.llm.license_signatures import parsed

#: Phrases of the contract and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

CONFIDENCE = {1: 1.0, 2: 0.9, 3: 0.7, 4: 0.4}


def rules() -> list[tuple[str, str, str, int]]:
    """(keyword in lower case, pattern, label, priority), best first."""
    return parsed()


def matched(text: Column, lower: Column) -> Column:
    """The rules that match, with their matches. Patterns are literals, so each is compiled once; it runs only where its keyword stands."""
    by_keyword: dict = {}
    for kw, pattern, label, prio in rules():
        found = F.regexp_extract_all(text, F.lit("(?i)" + pattern), F.lit(0))
        rule = F.struct(found.alias("found"), F.lit("(?i)" + pattern).alias("re"), F.lit(label).alias("label"), F.lit(prio).alias("prio"))
        by_keyword.setdefault(kw, []).append(rule)
    none = F.expr("cast(array() as array<struct<found:array<string>,re:string,label:string,prio:int>>)")
    words = sorted(k for k in by_keyword if k[0] != "*")
    here = lambda kw, own: F.contains(lower, F.lit(kw[1:])) if kw[0] == "*" else F.array_contains(own, F.lit(kw))

    def run(own: Column, some) -> Column:
        return F.flatten(F.array(*[F.when(here(kw, own), F.array(*by_keyword[kw])).otherwise(none) for kw in some]))

    # One pass over the words tells most texts from those that any rule can match.
    own = F.array_intersect(F.split(lower, "[^a-z0-9]+"), F.array(*map(F.lit, words)))
    by_word = let(own, lambda k: F.when(F.size(k) > 0, run(k, words)).otherwise(none))
    each = F.concat(by_word, run(None, sorted(by_keyword.keys() - set(words))))
    return F.filter(each, lambda r: F.size(r["found"]) > 0)


def intervals(text: Column, rule: Column) -> Column:
    """All matches of a rule with their places: lengths of what stands between matches add up to them."""

    def places(gaps: Column, found: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("out"))

        def step(acc: Column, i: Column) -> Column:
            here = acc["at"] + F.length(gaps[i])
            return F.struct((here + F.length(found[i])).alias("at"), F.array_append(acc["out"], here).alias("out"))

        starts = F.aggregate(F.sequence(F.lit(0), F.size(found) - 1), start, step, lambda acc: acc["out"])
        # An identifier names itself.
        label = lambda m: F.when(rule["label"] == "spdx", F.lower(F.regexp_replace(m, r"^.*:\s*", ""))).otherwise(rule["label"])
        return F.zip_with(starts, found, lambda s, m: F.struct(s.alias("start"), (-(s + F.length(m))).alias("neg_end"), rule["prio"].alias("prio"), label(m).alias("label")))

    return let(F.split(text, rule["re"]), lambda g: places(g, rule["found"]))


def suppressed(hits: Column) -> Column:
    """Sorted intervals without those inside an earlier one of the same or a better priority."""
    far = [f"e{p}" for p in CONFIDENCE]
    start = F.struct(*[F.lit(-1).alias(e) for e in far], F.slice(hits, 1, 0).alias("kept"))

    def step(acc: Column, h: Column) -> Column:
        end = -h["neg_end"]
        reach = F.get(F.array(*[acc[e] for e in far]), h["prio"] - 1)
        ends = [F.when(h["prio"] <= p, F.greatest(acc[f"e{p}"], end)).otherwise(acc[f"e{p}"]).alias(f"e{p}") for p in CONFIDENCE]
        return F.struct(*ends, F.when(reach >= end, acc["kept"]).otherwise(F.array_append(acc["kept"], h)).alias("kept"))

    return F.aggregate(hits, start, step, lambda acc: acc["kept"])


def phrase_pattern() -> str:
    inner = "|".join(f"{BREAK}+".join(p.split()) for p in PHRASES)
    return f"(?i)(?<!{WORD})(?:{inner})(?!{WORD})"


def scan(docs: DataFrame, *, text: str = "text", out: str = "license") -> DataFrame:
    """``docs`` with a struct ``out``: word counts, phrases, detections (start, neg_end, prio, label) and score."""
    kept = [F.col(f"`{c}`") for c in docs.columns if c != out]
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    n_words = count_between(t, BREAK + "+")
    found = F.when(t.rlike("(?i)cc|public|reserved"), F.regexp_extract_all(t, F.lit(phrase_pattern()), F.lit(0))).otherwise(F.expr("cast(array() as array<string>)"))
    lower = F.lower(t)
    hits = let(lower, lambda low: F.flatten(F.transform(matched(t, low), lambda r: intervals(t, r))))
    detections = let(F.sort_array(hits), suppressed)
    return docs.select(*kept, F.explode(F.array(F.struct(n_words.alias("n_words"), found.alias("phrases"), detections.alias("detections")))).alias(out))


def query(docs: DataFrame) -> DataFrame:
    d = scan(docs.select("doc_id", "text"))
    t, phrases = F.coalesce(F.col("text"), F.lit("")), F.col("license.phrases")
    gaps = F.split(t, phrase_pattern())
    words_in = lambda x: count_between(x, BREAK + "+")
    some = F.size(phrases) > 0
    normal = F.transform(phrases, lambda p: F.regexp_replace(F.translate(p, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), BREAK + "+", " "))
    names = F.create_map(*[F.lit(x) for kv in PHRASES.items() for x in kv])
    base = F.array_sort(F.array_distinct(F.transform(normal, lambda p: F.element_at(names, p))))
    labels = F.array_sort(F.array_distinct(F.concat(base, F.transform("license.detections", lambda h: h["label"]))))
    sure = F.create_map(*[F.lit(x) for kv in CONFIDENCE.items() for x in kv])
    score = F.coalesce(F.array_max(F.transform("license.detections", lambda h: F.element_at(sure, h["prio"]))), F.lit(0.0))
    return d.select(
        "doc_id",
        F.col("license.n_words").alias("n_words"),
        F.size(phrases).cast("long").alias("n_base"),
        F.when(some, words_in(F.element_at(gaps, 1))).alias("first_word"),
        F.when(some, F.col("license.n_words") - words_in(F.element_at(gaps, -1)) - words_in(F.element_at(phrases, -1))).alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.greatest(score, F.when(some, 0.7).otherwise(0.0)).alias("score"),
    )
