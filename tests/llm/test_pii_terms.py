"""Disclosing terms of the sanitiser against a plain count over all distinct texts."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest

from sliceframe.llm import pii

WORD = re.compile("[A-Za-z0-9]+")


def corpus(seed):
    rng = random.Random(seed)
    common = [f"w{i}" for i in range(40)]
    owners = [(f"person{i}@{rng.choice(['one', 'two'])}.example.com", f"nick{i}", rng.choice([0.0, 0.3, 0.9, 1.0])) for i in range(6)]
    texts = []
    for i in range(700):
        words = [rng.choice(common) for _ in range(rng.randint(3, 15))] + [f"u{i}"]
        if rng.random() < 0.1:
            address, nick, often = rng.choice(owners)
            words.insert(rng.randrange(len(words)), address if rng.random() < 0.8 else "8.8.4.4")
            if rng.random() < often:
                words.insert(rng.randrange(len(words)), nick.upper() if rng.random() < 0.2 else nick)
        elif rng.random() < 0.02:
            words.insert(0, rng.choice(owners)[1])
        texts.append(" ".join(words))
    return texts + [t for t in texts[:60] for _ in range(4)]


def verdicts(texts):
    """The definition, word for word: pointwise mutual information over the entity's own information, on distinct texts."""
    once = sorted(set(texts))
    n, of_term, of_entity, both = len(once), Counter(), Counter(), Counter()
    for t in once:
        spans = pii.base_spans(t)
        entities = {f(k, t[a:b]) for k, a, b in spans for f in (pii.entity_of, pii.coarser)}
        rest = "".join(" " if any(a <= i < b for _, a, b in spans) else c for i, c in enumerate(t))
        of_entity.update(entities)
        of_term.update({w.lower() for w in WORD.findall(t)})
        both.update((e, w) for e in entities for w in {w.lower() for w in WORD.findall(rest)})
    out = defaultdict(set)
    for (e, w), k in both.items():
        p = of_entity[e] / n
        if k < 3 or p == 1:
            continue
        r, bits = k / of_term[w], -math.log2(p)
        share = math.log2(r / p) / bits
        evidence = of_term[w] * (r * math.log2(r / p) + ((1 - r) * math.log2((1 - r) / (1 - p)) if r < 1 else 0))
        if share >= 0.8 and (bits >= 6 or evidence >= 18):
            out[w].add("removed" if share >= 0.95 and not e.startswith(("domain:", "ip block:")) else "term")
    return {w: min(how) for w, how in out.items()}  # "removed" is the stricter one


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_terms_and_spans(spark, seed):
    texts = corpus(seed)
    want = verdicts(texts)
    assert {"removed", "term"} & set(want.values())
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    assert {r.term: r.how for r in pii.disclosures(d).collect()} == want
    for r in pii.query(d).collect():
        t = texts[r.doc_id]
        base = pii.base_spans(t)
        more = [(want[m[0].lower()], *m.span()) for m in WORD.finditer(t) if m[0].lower() in want and not any(a < m.end() and m.start() < b for _, a, b in base)]
        assert r.spans == ",".join(":".join(map(str, s)) for s in base + more)
