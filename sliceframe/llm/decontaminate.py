"""Benchmark decontamination: one Aho-Corasick pass over each text.

All 13-word windows of the normalised benchmark items become patterns of one
automaton, which every worker builds once from a broadcast whose size is
checked. Each document is normalised, scanned once, and hits are mapped back to
words and to code points of the original text. The plan is map-only. A
benchmark beyond ``max_pattern_bytes`` is scanned in several blocks, one pass
and one automaton each, with the hits carried from pass to pass.

Defined results: null or wordless text has no words and no hits; an item
without words matches nothing; an item shorter than a window is one window; a
null item_id counts as the empty id; repeated items count once by id; repeated
rows, and rows with a null id, are judged alike; texts of any length are scanned
whole; empty tables give empty or all-clean results.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sliceframe.llm.common import WORD, WORD_TABLE, as_row, durable, in_slices

WINDOW = 13
RESULT = "n_words long, hits array<int>, items array<string>, spans array<struct<start:int,end:int>>"


class Patterns:
    """Windows of a block of items; the automaton is built on first use in each process."""

    def __init__(self, windows: dict[bytes, tuple[int, set[str]]]):
        self.windows, self._automaton = windows, None

    def automaton(self):
        if self._automaton is None:
            import ahocorasick

            a = ahocorasick.Automaton()
            for k, (n, ids) in self.windows.items():
                a.add_word(k.decode("latin-1"), (len(k), n, tuple(sorted(ids))))
            a.make_automaton()
            self._automaton = a
        return self._automaton

    def __getstate__(self):
        return {"windows": self.windows, "_automaton": None}


def item_windows(items: list[tuple], window: int = WINDOW) -> dict[bytes, tuple[int, set[str]]]:
    out: dict[bytes, tuple[int, set[str]]] = {}
    for item_id, text in items:
        w = (text or "").encode().translate(WORD_TABLE).split()
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            out.setdefault(b" " + b" ".join(w[i : i + n]) + b" ", (n, set()))[1].add("" if item_id is None else str(item_id))
    return out


def blocks_of(windows: dict, max_bytes: int) -> list[dict]:
    blocks, size = [{}], 0
    for k, v in windows.items():
        if size + len(k) > max_bytes and blocks[-1]:
            blocks.append({})
            size = 0
        blocks[-1][k] = v
        size += len(k)
    return blocks


def scan_text(text: bytes | None, patterns: Patterns) -> tuple[int, list[int], list[str]]:
    """Words, indexes of hit words, and ids of items with occurring windows."""
    import numpy as np

    w = (text or b"").translate(WORD_TABLE).split()
    if not w or not patterns.windows:
        return len(w), [], []
    norm = b" " + b" ".join(w) + b" "
    found = list(patterns.automaton().iter(norm.decode("latin-1")))
    if not found:
        return len(w), [], []
    blanks = np.flatnonzero(np.frombuffer(norm, dtype=np.uint8) == 32)
    mark, ids = np.zeros(len(w) + 1, dtype=np.int64), set()
    for end, (size, n, items) in found:
        i = int(np.searchsorted(blanks, end - size + 1))
        mark[i] += 1
        mark[i + n] -= 1
        ids.update(items)
    return len(w), np.flatnonzero(np.cumsum(mark)[:-1] > 0).tolist(), sorted(ids)


def original_spans(text: str, hits: list[int]) -> list[dict]:
    """Runs of hit words as code point spans of the text as it was."""
    if not hits:
        return []
    at, out, last = [m.span() for m in re.finditer(WORD + "+", text)], [], -2
    for i in hits:
        if i == last + 1:
            out[-1]["end"] = at[i][1]
        else:
            out.append({"start": at[i][0], "end": at[i][1]})
        last = i
    return out


def _scanner(shared, last: bool):
    @F.arrow_udf(RESULT)
    def scan(text, hits, items):
        import pyarrow as pa

        def scanned(t, h, k):
            n, own, ids = scan_text(t, shared.value)
            own, ids = sorted({*own, *h}), sorted({*ids, *k})
            return {"n_words": n, "hits": own, "items": ids, "spans": original_spans(t.decode("utf-8", "replace"), own) if own and last else []}

        kind = pa.struct([("n_words", pa.int64()), ("hits", pa.list_(pa.int32())), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])
        return in_slices(lambda *rows: list(map(scanned, *rows)), kind, text.cast(pa.binary()), hits, items)

    # Else a filter on the result would scan each text again, in a second worker.
    return scan.asNondeterministic()


def scan(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", out: str = "decon", window: int = WINDOW, max_pattern_bytes: int = 32 << 20) -> DataFrame:
    """``docs`` with a struct column ``out``: n_words, hits (word indexes), items, spans.

    A column of that name is replaced. The benchmark is a stated query set: it is
    read to the driver row by row and dealt into blocks of at most
    ``max_pattern_bytes`` of patterns, so that no automaton grows with it.
    """
    sc = docs.sparkSession.sparkContext
    windows = item_windows([(r[0], r[1]) for r in benchmark.select(item_id, item_text).toLocalIterator()], window)
    blocks = blocks_of(windows, max_pattern_bytes)
    cols = [F.col(f"`{c}`") for c in docs.columns if c != out]
    hits, items = F.expr("cast(array() as array<int>)"), F.expr("cast(array() as array<string>)")
    df = docs
    for k, block in enumerate(blocks):
        if k:
            df, hits, items = durable(df), F.col(out)["hits"], F.col(out)["items"]
        df = df.select(*cols, _scanner(sc.broadcast(Patterns(block)), k == len(blocks) - 1)(F.col(f"`{text}`"), hits, items).alias(out))
    return df


def contaminated(result: Column) -> Column:
    """At least one word in twenty is inside an occurring window."""
    n = F.size(result["hits"])
    return (n > 0) & (20 * n >= result["n_words"])


def stage(spark, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents that are not contaminated."""
    done = scan(docs.select(as_row(docs).alias("row"), F.col("text")), benchmark)
    return done.where(~contaminated(F.col("decon"))).select("row.*")


ORACLE = r"""
WITH low AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
item AS (SELECT DISTINCT coalesce(CAST(item_id AS VARCHAR), '') AS item, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
sized AS (SELECT item, w, least(13, len(w)) AS n FROM item WHERE len(w) > 0),
win AS (SELECT DISTINCT item, n, array_to_string(w[i : i + n - 1], ' ') AS k FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM sized)),
place AS (SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS k FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM low, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
hit AS (SELECT r, i, n, item FROM place JOIN win USING (n, k)),
word AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hit) GROUP BY r),
ids AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM low LEFT JOIN word USING (r) LEFT JOIN ids USING (r)
"""


def query(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    d = F.col("decon")
    return scan(docs.select("doc_id", "text"), benchmark).select(
        "doc_id",
        d["n_words"].alias("n_words"),
        F.size(d["hits"]).cast("long").alias("n_hit"),
        F.size(d["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(d["items"], ",").cast("binary"), 256).alias("items_sha256"),
        contaminated(d).alias("contaminated"),
    )
