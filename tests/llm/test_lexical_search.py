"""Ranked lexical search against brute force."""

import math
import random
import re
from collections import Counter

import pytest

from sliceframe.llm import lexical_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k=20):
    count = [(i, Counter(terms(t))) for i, t in docs]
    size = [sum(c.values()) for _, c in count]
    n_docs, total = sum(x > 0 for x in size), sum(size)
    df = Counter(t for _, c in count for t in c)
    wanted = {}
    for i, t in set(items):
        wanted.setdefault(i, Counter()).update(terms(t))
    out = []
    for i, q in wanted.items():
        scores = []
        for (doc_id, c), n in zip(count, size):
            m = 75 + (25 * n * n_docs) // max(total, 1)
            s = sum(r * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t, r in q.items() if c[t])
            if s > 0:
                scores.append((-s, doc_id is not None, doc_id or 0, doc_id))
        out += [(i, r, doc_id, -s) for r, (s, _, _, doc_id) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def cases():
    rng = random.Random(5)
    vocabulary = [f"t{i}" for i in range(60)] + ["Ünï", "a1", "日本"]
    docs = [(i, " ".join(rng.choice(vocabulary) + rng.choice(["", ",", "--"]) for _ in range(rng.randint(1, 60)))) for i in range(120)]
    docs += [(500 + i, docs[3][1]) for i in range(40)]  # copies: ties
    docs += [(900, None), (901, ""), (902, "!!! ..."), (903, "solo T1 " * 9000), (None, "t1 t2 solo"), (904, "ÀB àb"), docs[0], (1, "t5 t5 t6")]
    items = [(0, docs[3][1]), (1, "T1, t1 t1 never"), (2, "never seen"), (3, None), (4, "..."), (0, docs[3][1]), (0, "solo"), (None, "solo Ünï"), (5, "àb")]
    return docs, items


@pytest.mark.parametrize("partitions", [1, 5])
def test_against_brute_force(spark, partitions):
    docs, items = cases()
    d = spark.createDataFrame([(*x, "t", 7) for x in docs], "doc_id long, text string, term string, d int").repartition(partitions)
    b = spark.createDataFrame([(*x, 1, 2) for x in items], "item_id long, text string, score int, rank int")
    got = sorted(map(tuple, lexical_search.query(d, b).select("item_id", "rank", "doc_id", "score").collect()), key=str)
    assert got == brute(docs, items)


def test_joins_that_are_not_broadcast(spark):
    docs, items = cases()
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = lexical_search.search(d, b, k=3, broadcast_rows=0).select("item_id", "rank", "doc_id", "score").collect()
    assert sorted(map(tuple, got), key=str) == brute(docs, items, 3)


def test_empty_tables(spark):
    docs, items = cases()
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert lexical_search.query(d.limit(0), b).count() == 0
    assert lexical_search.query(d, b.limit(0)).count() == 0


def test_all_postings(spark):
    docs, _ = cases()
    index, n_docs, n_terms = lexical_search.postings(spark.createDataFrame(docs, "doc_id long, text string"))
    want = Counter((i, t, c, len(terms(x))) for i, x in docs for t, c in Counter(terms(x)).items())
    assert Counter(map(tuple, index.select("doc_id", "term", "tf", "n").collect())) == want
    assert (n_docs, n_terms) == (sum(bool(terms(x)) for _, x in docs), sum(len(terms(x)) for _, x in docs))
    assert index.selectExpr("count(distinct term, bucket) - count(distinct term)").first()[0] == 0
