"""Ranked lexical search: postings, integer scores and a window for the best.

 1. Every document's terms are counted inside its row. Each different term gives
    a posting (bucket, term, document, its number of terms, tf); only postings of
    terms that an item asks for go on (a semi join).
 2. Each task of the scan writes its documents' postings as one segment, sorted by
    the bucket of the term, then the term, so that a segment holds the bucketed
    posting lists of its documents. A frequent term so stands in every segment;
    dealt by term alone it would be one task's.
 3. Item terms join postings by bucket and term, and each match is scored in
    64-bit integers. Postings are dealt by document before that join, so the sum
    by item and document needs no exchange of the matches, which are ten times
    as many.
 4. ``row_number`` by item keeps the best; Spark limits each task's rows before
    it sends them, so a task sends k rows an item.

Defined results: null text and text without a term count nowhere and are never
found; documents are rows, so repeated rows are found each, and rows of one id
too; repeated items count once, other texts under one item id are added to its
terms; a null item id is an item; an item without a term, or none of whose terms
occurs, has no rows; equal scores go by ascending id, null ids first; texts of
any length are counted whole; an empty table gives an empty result; extra
columns of any name are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sliceframe.llm.common import WORD_TABLE, durable, few, written

TOP, BUCKETS = 20, 256
POSTING = "doc_id {}, d long, n long, term string, tf long"


def term_counts(batches):
    """(document id, row number in its task, text) to a row for each different term of the text."""
    from collections import Counter

    import pyarrow as pa

    for batch in batches:
        ids, rows, texts = batch.columns
        texts = texts.cast(pa.binary())
        at, sizes, terms, counts, kept = 0, [], [], [], 0

        def made():
            own = pa.array([i for i, (_, k) in enumerate(sizes, at) for _ in range(k)], type=pa.int64())
            n = pa.array([n for n, k in sizes for _ in range(k)], type=pa.int64())
            return pa.RecordBatch.from_arrays([ids.take(own), rows.take(own), n, pa.array(terms, type=pa.binary()).cast(pa.string()), pa.array(counts, type=pa.int64())], names=["doc_id", "d", "n", "term", "tf"])

        for i in range(len(texts)):
            count = Counter((texts[i].as_py() or b"").translate(WORD_TABLE).split())
            sizes.append((sum(count.values()), len(count)))
            terms.extend(count)
            counts.extend(count.values())
            kept += len(count)
            if kept >= 50_000:
                yield made()
                at, sizes, terms, counts, kept = i + 1, [], [], [], 0
        yield made()


def item_terms(items: DataFrame, item_id: str, item_text: str) -> DataFrame:
    """(item_id, term, qtf) of all items."""
    low = F.translate(F.coalesce(F.col("text"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    texts = items.select(F.col(f"`{item_id}`").alias("item_id"), F.col(f"`{item_text}`").alias("text")).distinct()
    words = texts.select("item_id", F.explode(F.split(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")).alias("term")).where("term != ''")
    return words.groupBy("item_id", "term").agg(F.count("*").alias("qtf"))


def bucket(term: str) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def postings(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", asked: DataFrame | None = None) -> tuple[DataFrame, int, int]:
    """The postings of ``asked`` terms (all, if None), the documents that have a term, and all their terms.

    A row is (bucket, term, doc_id, d, n, tf); ``d`` numbers the documents. The table
    is written to the shared folder, each segment sorted by bucket and term.
    """
    kind = docs.select(F.col(f"`{doc_id}`")).schema[0].dataType.simpleString()
    # The numbers are made once, with the table that holds them.
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.monotonically_increasing_id().alias("d"), F.col(f"`{text}`").alias("text"))
    found = rows.mapInArrow(term_counts, POSTING.format(kind))
    if asked is not None:
        found = found.join(asked.withColumnRenamed("term", "wanted"), F.col("term") == F.col("wanted"), "left_semi")
    index = written(found.withColumn("bucket", bucket("term")).sortWithinPartitions("bucket", "term", "d").select("bucket", "term", "doc_id", "d", "n", "tf"))
    total = docs.select(F.col(f"`{text}`").alias("text")).mapInArrow(term_totals, "docs long, terms long").agg(F.sum("docs"), F.sum("terms")).first()
    return index, total[0] or 0, total[1] or 0


def term_totals(batches):
    """Documents that have a term, and their terms with repeats, of each batch."""
    import pyarrow as pa

    for batch in batches:
        sizes = [len((t.as_py() or b"").translate(WORD_TABLE).split()) for t in batch.columns[0].cast(pa.binary())]
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (sum(n > 0 for n in sizes), sum(sizes))], names=["docs", "terms"])


def search(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", k: int = TOP, broadcast_rows: int = 500_000) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of each item with a score above 0."""
    wanted = item_terms(items, item_id, item_text)
    asked = few(wanted.select("term").distinct(), broadcast_rows)
    index, n_docs, n_terms = postings(docs, doc_id=doc_id, text=text, asked=asked)
    df = index.groupBy("term").agg(F.count("*").alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(float(n_docs)) + 2) / (2 * F.col("df") + 1))).cast("long")
    weighed = durable(wanted.join(df, "term").select("item_id", F.col("term").alias("wanted"), bucket("term").alias("of"), (F.col("qtf") * weight).alias("w")))
    m = F.expr(f"75 + (25 * n * {n_docs}L) div {max(n_terms, 1)}L")
    gain = F.expr("(1000000000L * tf) div (1000 * tf + 12 * m)")
    scored = index.withColumn("m", m).select("bucket", "term", "doc_id", "d", gain.alias("gain")).repartition("d")
    matches = scored.join(few(weighed, broadcast_rows), (F.col("bucket") == F.col("of")) & (F.col("term") == F.col("wanted")))
    sums = matches.groupBy("d", "doc_id", "item_id").agg(F.sum(F.col("w") * F.col("gain")).alias("score")).where("score > 0")
    best = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc("doc_id"))
    return sums.select("item_id", F.row_number().over(best).alias("rank"), "doc_id", "score").where(F.col("rank") <= k)


def query(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return search(docs, benchmark)


ORACLE = r"""
WITH low AS (SELECT row_number() OVER () AS d, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
total AS (SELECT count(*) AS nn, sum(len(w)) AS l FROM low WHERE len(w) > 0),
tf AS (SELECT d, doc_id, len(w) AS n, term, count(*) AS tf FROM (SELECT d, doc_id, w, unnest(w) AS term FROM low) GROUP BY d, doc_id, len(w), term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
item AS (SELECT item_id, unnest(list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark)),
wanted AS (SELECT item_id, term, count(*) AS qtf FROM item GROUP BY item_id, term),
weighed AS (SELECT item_id, term, CAST(qtf * floor(1000 * ln((2.0::DOUBLE * nn + 2) / (2 * df + 1))) AS BIGINT) AS w FROM wanted JOIN df USING (term), total),
sums AS (SELECT item_id, d, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nn) // l)))) AS BIGINT) AS score FROM tf JOIN weighed USING (term), total GROUP BY item_id, d, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST) AS rank FROM sums WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 20
"""
