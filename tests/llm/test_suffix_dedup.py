"""Removal of repeated byte strings against brute force."""

import hashlib
import random
from collections import Counter

import pytest

from sliceframe.llm import suffix_dedup

WINDOW = suffix_dedup.WINDOW


def brute(texts):
    data = [(t or "").encode() for t in texts]
    count = Counter(d[i : i + WINDOW] for d in data for i in range(len(d) - WINDOW + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - WINDOW + 1):
            if count[d[i : i + WINDOW]] > 1:
                gone[i : i + WINDOW] = b"\x01" * WINDOW
        kept = bytes(b for b, x in zip(d, gone) if not x)
        spans = sum(x and not (i and gone[i - 1]) for i, x in enumerate(gone))
        out.append((len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def cases():
    rng = random.Random(11)
    words = ["the", "and", "Ünïcode", "日本語", "plain", "of", "common", "word", "x"]
    prose = lambda n: " ".join(rng.choice(words) + str(rng.randint(0, 9)) for _ in range(n))
    texts = [prose(rng.randint(5, 400)) for _ in range(30)]
    texts += [texts[0], texts[1], texts[1]]
    for t in texts[2:14]:  # near copies: edits, deletions, moves
        at = rng.randrange(len(t))
        texts.append(t[:at] + rng.choice(["", "!", "an edit"]) + t[at + rng.randint(0, 3) :])
    passage = prose(120)
    for k in (398, 399, 400, 401, 402, 700):
        texts.append(prose(30) + passage.encode()[:k].decode(errors="ignore") + prose(40))
    texts += ["a" * 399, "b" * 400, "c" * 401, "d" * 3000, "ab" * 900, "line of text\n" * 200, "prefix " + "line of text\n" * 120]
    texts += [None, "", " ", "e" * 5 + passage[:300], passage * 3]
    return texts


@pytest.mark.parametrize("partitions", [1, 4])
def test_against_brute_force(spark, partitions):
    texts = cases()
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(partitions)
    got = {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.query(d).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()}
    want = brute(texts)
    assert [i for i in range(len(texts)) if got[i] != want[i]] == []
    assert 0 < sum(x[1] > 0 for x in want) < len(want)


def test_pieces_of_long_texts(monkeypatch):
    """Every window has one run, and one anchor wherever a text is cut into pieces."""
    import pyarrow as pa

    texts = cases()
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array([0] * len(texts), type=pa.int32()), pa.array(texts)], names=["h", "g", "text"])

    def windows():
        out = []
        for r in (r for b in suffix_dedup.place_rows(iter([batch])) for r in b.to_pylist()):
            for k in range(r["reps"]):
                out += [(r["h"], r["lo"] + k * r["n"] + j, r["anchor"], r["d"] - j) for j in range(r["n"])]
        return sorted(out)

    whole = windows()
    assert [x[:2] for x in whole] == [(h, i) for h, t in enumerate(texts) for i in range(len((t or "").encode()) - WINDOW + 1)]
    for piece in (1, 333, 5000):
        monkeypatch.setattr(suffix_dedup, "PIECE", piece)
        assert windows() == whole


def test_random_small_alphabets(spark):
    for seed in range(3):
        rng = random.Random(seed)
        base = ["".join(rng.choice("ab") for _ in range(2000)) for _ in range(3)]
        texts = []
        for _ in range(25):
            parts = [(b := rng.choice(base))[(i := rng.randrange(1500)) : i + rng.randint(1, 900)] for _ in range(rng.randint(1, 3))]
            texts.append("".join(parts))
        d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
        got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.query(d).collect()}
        assert [got[i] for i in range(len(texts))] == brute(texts)


def test_joins_that_are_not_broadcast(spark):
    texts = cases()
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["dedup"]["n_removed"] for r in suffix_dedup.dedup(d, broadcast_rows=0).collect()}
    assert [got[i] for i in range(len(texts))] == [x[1] for x in brute(texts)]


def test_clashing_names_nulls_and_empty_tables(spark):
    kind = "doc_id long, text string, row int, h int, g string, cut int, found int, dedup int, anchor int"
    d = spark.createDataFrame([(None, "x" * 500, 1, 2, "g", 3, 4, 5, 6), (None, "x" * 450, 1, 2, "g", 3, 4, 5, 6)], kind)
    out = suffix_dedup.dedup(d)
    assert out.columns == ["doc_id", "text", "row", "h", "g", "cut", "found", "anchor", "dedup"]
    assert {(r["dedup"]["n_removed"], r["dedup"]["kept"], tuple(map(tuple, r["dedup"]["spans"]))) for r in out.collect()} == {(500, b"", ((0, 500),)), (450, b"", ((0, 450),))}
    assert suffix_dedup.query(d.limit(0)).count() == 0 and suffix_dedup.query(d.select("doc_id", F_null(spark).alias("text"))).count() == 2


def F_null(spark):
    from pyspark.sql import functions as F

    return F.lit(None).cast("string")
