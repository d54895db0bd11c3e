"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Each source gets a weight; targets share the budget by weight, and a source
whose share exceeds ``epochs`` times its size is held there while the excess is
shared again (water-filling, in closed form over the few rows of the source
table). Documents are shuffled by a digest; a document's virtual finish time is
the source's words up to and including it, divided by the source's target. A
source that is taken more than once starts over in the same order. All copies of
all documents stand in one global order by finish time, and that stream is
truncated where its running sum of words reaches the budget: what ends before is
taken whole, the document that straddles it in part, nothing after it.

Running sums never gather a source, or the stream, in one task: documents are
dealt to prefixes of their digest, only sums of those are accumulated over a
source, and the exact order is a window over (source, prefix). The point of
truncation is found by sums over ever finer intervals of finish time; a window
orders only the last, small one.

Defined results: null text has size 0 and is taken 0 times, as is an empty one;
very long texts count whole; null source is a source of its own, last in order;
equal documents are interchangeable, so repeated rows get their own, consistent
places; an empty table gives an empty result; extra columns of any name pass
through, and result columns replace those of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sliceframe.llm.common import SPACE, as_row, count_between, durable

#: Weights by rank of the source name, repeating.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
EPOCHS = 2


def size_of(text: Column) -> Column:
    """Number of words between ASCII white space."""
    return count_between(F.coalesce(text, F.lit("")), SPACE)


def targets(sources: DataFrame, *, weights=WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """Adds target to a table of src and source_size. It has a row a source, so a single task orders them."""
    name = Window.orderBy(F.col("src").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(name) - 1) % len(weights) + 1).cast("int"))
    cap = F.col("source_size") * F.lit(float(epochs))
    ranked = sources.withColumn("_w", w).withColumn("_r", cap / F.col("_w"))
    by = Window.orderBy(F.col("_r"), F.col("src").asc_nulls_last())
    before, all_ = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    budget = F.sum("source_size").over(all_) * F.lit(float(share))
    left = budget - F.coalesce(F.sum(cap).over(before), F.lit(0.0))
    weight = F.sum("_w").over(all_) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))
    # The level holds from the first source whose cap is not reached.
    level = ranked.withColumn("_level", left / weight)
    first = F.first(F.when(F.col("_level") <= F.col("_r"), F.col("_level")), ignorenulls=True).over(all_)
    return level.withColumn("_first", first).select(*sources.columns, F.least(cap, F.coalesce(F.col("_w") * F.col("_first"), cap)).alias("target"))


#: Intervals of finish time a step, and rows that one window may order.
STEPS, ORDERED_ROWS = 1024, 100_000


def place(copy) -> Column:
    """The global order of copies: by finish time; the rest only makes ties repeat."""
    return F.struct(finish_of(copy).alias("finish"), F.col("s"), F.lit(copy).cast("int").alias("copy"), F.col("queued"))


def finish_of(copy) -> Column:
    return F.try_divide((F.lit(copy) * F.col("source_size") + F.col("queued") + F.col("size")).cast("double"), F.col("target"))


def cut_off(queues: DataFrame, budget: int, epochs: int):
    """Where the stream reaches the budget: (finish, s, copy, queued) of the copy that straddles it and what is left for it."""
    copies = [F.struct(place(k).alias("at"), F.col("size")) for k in range(epochs)]
    rows = queues.where("size > 0 and target > 0").select(F.explode(F.array(*copies)).alias("c")).select("c.at", "c.size")
    low, high = rows.agg(F.min("at.finish"), F.max("at.finish")).first()
    left = budget
    if low is None:
        return None
    while True:
        # The last interval takes its upper end too, as all rows from high on are out of it.
        width = (high - low) / STEPS
        inside = rows.where((F.col("at.finish") >= low) & (F.col("at.finish") <= high))
        step = F.least(F.floor((F.col("at.finish") - low) / width), F.lit(STEPS - 1)) if width > 0 else F.lit(0).cast("long")
        # At most STEPS rows.
        sums = inside.groupBy(step.alias("k")).agg(F.sum("size").alias("w"), F.count("*").alias("n"), F.min("at.finish").alias("low"), F.max("at.finish").alias("high")).orderBy("k").collect()
        crossing = None
        for r in sums:
            if r["w"] > left:
                crossing = r
                break
            left -= r["w"]
        if crossing is None:
            return None
        if crossing["n"] <= ORDERED_ROWS or crossing["low"] == crossing["high"]:
            break
        low, high = crossing["low"], crossing["high"]
    last = rows.where((F.col("at.finish") >= crossing["low"]) & (F.col("at.finish") <= crossing["high"]))
    before = F.coalesce(F.sum("size").over(Window.orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    r = last.withColumn("before", before).where((F.col("before") <= left) & (F.col("before") + F.col("size") > left)).first()
    return r["at"], left - r["before"]


def schedule(docs: DataFrame, *, text: str = "text", source: str = "source", key: str = "doc_id", seed: int = 7, weights=WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, keep: list[str] | None = None) -> DataFrame:
    """(row, s, size, source_size, target, queued, words): the row as it was and its place in the mix.

    ``queued`` counts the source's words before the document, ``words`` is an
    array of what the mix takes of each of its copies; ``keep`` names the columns
    of the row, all by default.
    """
    none = F.lit("")
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{key}`").cast("string"), none), F.lit(":"), F.coalesce(F.col(f"`{text}`"), none)).cast("binary"))
    # A key that is never null, so that the join and the window share one exchange.
    s = F.coalesce(F.concat(F.lit("="), F.col(f"`{source}`")), none)
    base = docs.select(as_row(docs.select(*[f"`{c}`" for c in keep or docs.columns])).alias("row"), size_of(F.col(f"`{text}`")).alias("size"), h.alias("h"), s.alias("s")).withColumn("b", F.substring("h", 1, 3))
    sums = durable(base.groupBy("s", "b").agg(F.sum("size").alias("words")))
    src = F.when(F.col("s") != "", F.expr("substring(s, 2)"))
    sizes = sums.groupBy("s").agg(F.sum("words").alias("source_size")).withColumn("src", src)
    total = sizes.agg(F.sum("source_size")).first()[0] or 0
    plan = targets(sizes, weights=weights, share=share, epochs=epochs)
    run = Window.partitionBy("s").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    starts = durable(sums.withColumn("start", F.coalesce(F.sum("words").over(run), F.lit(0))).drop("words").join(plan.drop("src"), "s"))
    order = Window.partitionBy("s", "b").orderBy("h", "size").rowsBetween(Window.unboundedPreceding, -1)

    def queued(rows: DataFrame) -> DataFrame:
        placed = rows.join(starts, ["s", "b"]).withColumn("queued", F.col("start") + F.coalesce(F.sum("size").over(order), F.lit(0)))
        return placed.drop("b", "start", "h")

    # Sizes alone are ordered first, so that the search for the cut moves no texts.
    cut = cut_off(durable(queued(base.drop("row"))), min(int(share * total), epochs * total), epochs)
    return queued(base).withColumn("words", F.array(*[taken_of(k, cut) for k in range(epochs)]))


def taken_of(copy: int, cut) -> Column:
    """Words that the truncated stream holds of a document's copy."""
    size = F.col("size").cast("long")
    if cut is None:
        return F.when(F.col("target") > 0, size).otherwise(F.lit(0).cast("long"))
    at, room = cut
    limit = F.struct(F.lit(at["finish"]).alias("finish"), F.lit(at["s"]).alias("s"), F.lit(at["copy"]).cast("int").alias("copy"), F.lit(at["queued"]).cast("long").alias("queued"))
    here = place(copy)
    return F.when(here < limit, size).when(here == limit, F.lit(room).cast("long")).otherwise(F.lit(0).cast("long"))


def mix(docs: DataFrame, *, epochs: int = EPOCHS, **how) -> DataFrame:
    """One row for each time a document is taken, globally sorted by virtual finish time.

    Beside the columns of ``docs``: size, source_size, target, taken (of all
    copies), copy (the round), words (taken then) and finish (that copy's).
    """
    done = schedule(docs, epochs=epochs, **how)
    taken = F.aggregate("words", F.lit(0).cast("long"), lambda a, x: a + x)
    each = done.select("row", "size", "source_size", "target", taken.alias("taken"), F.posexplode(F.arrays_zip(F.array(*[finish_of(k) for k in range(epochs)]).alias("finish"), F.col("words"))).alias("copy", "t"))
    new = {"size": "size", "source_size": "source_size", "target": "target", "taken": "taken", "copy": "copy", "words": "t.words", "finish": "t.finish"}
    kept = [F.col("row").getField(c).alias(c) for c in docs.columns if c not in new]
    # Sorted before columns get their names, which may be those of the input.
    return each.where("t.words > 0").orderBy("t.finish").select(*kept, *[F.col(x).alias(c) for c, x in new.items()])


def query(docs: DataFrame) -> DataFrame:
    """A row a document, in order of virtual finish time."""
    done = schedule(docs.select("doc_id", "source", "text"), keep=["doc_id"])
    taken = F.aggregate("words", F.lit(0).cast("long"), lambda a, x: a + x)
    return done.select("row.doc_id", "size", "source_size", "target", taken.alias("taken"), finish_of(0).alias("finish")).orderBy("finish", "doc_id")


def stage(spark, docs: DataFrame) -> DataFrame:
    """The mix: documents' columns with size, source_size, target, taken, copy, words and finish."""
    return mix(docs)


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce('=' || source, '') AS s, source,
    CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS BIGINT) AS size,
    md5('7:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS h FROM documents),
src AS (SELECT s, source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY s, source),
w AS (SELECT *, CAST([3, 1, 2][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INT) + 1] AS DOUBLE) AS w FROM src),
r AS (SELECT *, source_size * 2e0 AS cap, source_size * 2e0 / w AS r FROM w),
lv AS (SELECT *, (sum(source_size) OVER () * 1.5e0 - coalesce(sum(cap) OVER before, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER before, 0)) AS level FROM r
  WINDOW before AS (ORDER BY r, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lvl AS (SELECT arg_min(level, (r, source IS NULL, source)) AS level FROM lv WHERE level <= r),
t AS (SELECT s, source_size, least(cap, coalesce(w * (SELECT level FROM lvl), cap)) AS target FROM lv),
q AS (SELECT d.r, doc_id, s, size, source_size, target, CAST(coalesce(sum(size) OVER (PARTITION BY s ORDER BY h, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS queued FROM d JOIN t USING (s)),
c AS (SELECT r, s, size, queued, k, CAST(k * source_size + queued + size AS DOUBLE) / target AS finish FROM q, (SELECT unnest([0, 1]) AS k) WHERE size > 0 AND target > 0),
run AS (SELECT r, size, coalesce(sum(size) OVER (ORDER BY finish, s, k, queued ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c),
got AS (SELECT r, sum(greatest(0, least(size, (SELECT CAST(floor(1.5e0 * sum(size)) AS BIGINT) FROM d) - before))) AS taken FROM run GROUP BY r)
SELECT doc_id, size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken,
  CASE WHEN target > 0 THEN CAST(queued + size AS DOUBLE) / target END AS finish
FROM q LEFT JOIN got USING (r)
"""
