"""Exact removal of repeated passages with suffix automata.

A window is ``WINDOW`` consecutive words; a word goes if a window that covers it
occurs anywhere else. Matching statistics of documents against suffix automata
of reference shards find the windows. The reference is the corpus itself and has
no size bound, so its shards are not broadcast but dealt out: the smallest-hash
8-gram of a window (its anchor) is the same wherever the window occurs, so
windows meet in the shard of their anchor.

 1. Windows in a row with one anchor form a run; a text falls into runs, each
    window in exactly one. Anchors that occur once are dropped (counts are
    aggregated before they are shuffled).
 2. Runs with equal words (by two 64-bit hashes) are counted; what occurs twice
    is repeated as a whole.
 3. Anchors with several different runs get one copy of each: an automaton is
    built over them, and every run is streamed through it; a window whose state
    has two end positions is repeated. An anchor with more than ``SHARD`` runs
    is dealt out further by window, so no automaton grows with the corpus; equal
    windows are compared word by word as they stream by, and only one is held.
 4. Verdicts return to the texts, where covered words are removed.

Texts meet their runs by key; that join broadcasts only tables that a count
shows to be small.

Defined results: null or wordless text has no words and nothing removed; texts
shorter than a window stay; repeated rows are other places, so their windows
are repeated, and a null id makes no difference; texts of any length are judged
whole; an empty table gives an empty result; extra columns of
any name pass through, but for one named as the result, which is replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sliceframe.llm.common import as_row, durable, few

WINDOW, GRAM, SHARD = 35, 8, 256
P = 0x9E3779B97F4A7C15
RUN = "h long, g int, anchor long, seg long, lo int, n int"


def mixed(h, seed: int):
    import numpy as np

    h = h + np.uint64(seed)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h ^ (h >> np.uint64(31))


def runs(words: list[bytes], window: int = WINDOW, gram: int = GRAM):
    """Arrays anchor, seg, first window and number of windows of each run."""
    import numpy as np
    import pandas as pd

    n = len(words)
    if n < window:
        return None
    a = pd.util.hash_array(np.array(words, dtype=object), categorize=False)
    power = np.ones(n + 1, dtype=np.uint64)
    power[1:] = P
    power = np.cumprod(power, dtype=np.uint64)
    back = np.ones(n + 1, dtype=np.uint64)
    back[1:] = pow(P, -1, 1 << 64)
    back = np.cumprod(back, dtype=np.uint64)
    total = np.zeros(n + 1, dtype=np.uint64)
    total[1:] = np.cumsum(a * power[:n], dtype=np.uint64)
    grams = mixed((total[gram:] - total[:-gram]) * back[: n - gram + 1], 1)
    # Smallest hash first, leftmost of equal ones: hash in the upper, position in the lower bits.
    low = (grams & np.uint64(~((1 << 28) - 1) & ((1 << 64) - 1))) | np.arange(len(grams), dtype=np.uint64)
    width, span = window - gram + 1, 1
    while 2 * span <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < width:
        low = np.minimum(low[: span - width], low[width - span :])
    at = (low & np.uint64((1 << 28) - 1)).astype(np.int64)
    lo = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    count = np.diff([*lo, len(at)])
    end = lo + count + window - 1
    seg = (total[end] - total[lo]) * back[lo] + mixed((count * 64 + at[lo] - lo).astype(np.uint64), 2)
    return grams[at[lo]].view(np.int64), mixed(seg, 3).view(np.int64), lo, count


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").split()


def binary_lists(batch):
    import pyarrow as pa

    return [c.cast(pa.binary()).to_pylist() if pa.types.is_string(c.type) or pa.types.is_large_string(c.type) else c.to_pylist() for c in batch.columns]


def anchors_only(batches):
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        got = [r[0] for t in binary_lists(batch)[0] if (r := runs(words_of(t))) is not None]
        for k in range(0, len(got), 2000):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(got[k : k + 2000]))], names=["anchor"])


def all_runs(batches):
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        h, g, texts = binary_lists(batch)
        for k in range(0, len(texts), 1000):
            parts = []
            for x, y, t in zip(h[k : k + 1000], g[k : k + 1000], texts[k : k + 1000]):
                if (r := runs(words_of(t))) is not None:
                    parts.append((np.full(len(r[0]), x), np.full(len(r[0]), y, dtype=np.int32), r[0], r[1], r[2].astype(np.int32), r[3].astype(np.int32)))
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts)], names=["h", "g", "anchor", "seg", "lo", "n"])


class SuffixAutomaton:
    """Of several sequences of words, with the number of end positions of each state."""

    def __init__(self, sequences: list[tuple[list[bytes], int]]):
        self.next, self.link, self.length, self.ends = [{}], [-1], [0], [0]
        for words, weight in sequences:
            last = 0
            for w in words:
                last = self._extend(last, w)
                self.ends[last] += weight
        for v in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            self.ends[self.link[v]] += self.ends[v]

    def _clone(self, p: int, q: int, w: bytes) -> int:
        c = len(self.length)
        self.next.append(self.next[q].copy())
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        self.ends.append(0)
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = c
            p = self.link[p]
        self.link[q] = c
        return c

    def _extend(self, last: int, w: bytes) -> int:
        q = self.next[last].get(w)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, q, w)
        cur = len(self.length)
        self.next.append({})
        self.link.append(0)
        self.length.append(self.length[last] + 1)
        self.ends.append(0)
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._clone(p, q, w)
        return cur

    def repeated(self, words: list[bytes], window: int) -> int:
        """Bits of the windows of a streamed sequence that end in at least two places: matching statistics cut at the window."""
        v = matched = bits = 0
        nxt, link, length, ends = self.next, self.link, self.length, self.ends
        for k, w in enumerate(words):
            while v and w not in nxt[v]:
                v = link[v]
                matched = length[v]
            if w in nxt[v]:
                v = nxt[v][w]
                matched += 1
            while v and length[link[v]] >= window:
                v = link[v]
            matched = min(matched, length[v])
            if matched >= window and ends[v] >= 2:
                bits |= 1 << (k - window + 1)
        return bits


def pieces(batches):
    """(text, runs) to the words of each run, or of each of its windows where an anchor has too many runs."""
    import pyarrow as pa
    import xxhash

    for batch in batches:
        rows = []
        for t, rs in zip(*binary_lists(batch)):
            w = words_of(t)
            for r in rs:
                if r["many"]:
                    for j in range(r["n"]):
                        x = b" ".join(w[r["lo"] + j : r["lo"] + j + WINDOW])
                        rows.append((r["anchor"], xxhash.xxh3_64_intdigest(x) >> 1, r["seg"], r["c"], j, x))
                else:
                    rows.append((r["anchor"], -1, r["seg"], r["c"], 0, b" ".join(w[r["lo"] : r["lo"] + r["n"] + WINDOW - 1])))
                if len(rows) >= 20_000:
                    yield _pieces(pa, rows)
                    rows = []
        yield _pieces(pa, rows)


def _pieces(pa, rows):
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], type=t) for k, t in enumerate(kinds)], names=["anchor", "sub", "seg", "c", "j", "words"])


def match(batches):
    """Shards in order of (anchor, sub) to (anchor, seg, mask of repeated windows)."""
    import pyarrow as pa

    group, rows, texts = None, [], {}

    def close():
        """Verdicts of a shard of runs; one of single windows has given its own as it went."""
        if group is None or group[1] >= 0 or (len(rows) < 2 and not any(r[1] > 1 for r in rows)):
            return []
        split = [(r[0], r[1], r[2], r[3].split(b" ")) for r in rows]
        automaton = SuffixAutomaton([(w, c) for _, c, _, w in split])
        out = [(group[0], seg, automaton.repeated(w, WINDOW) << j) for seg, _, j, w in split]
        return [x for x in out if x[2]]

    def window(seg, c, j, words):
        """Of equal windows only the first is held, until another one comes."""
        first = texts.setdefault(words, [(seg, j)] if c < 2 else [])
        out = [(group[0], seg, 1 << j)] if c > 1 or (seg, j) not in first else []
        if out and first:
            out.append((group[0], first[0][0], 1 << first[0][1]))
            first.clear()
        return out

    def batch_of(out):
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], type=pa.int64()) for k in range(3)], names=["anchor", "seg", "mask"])

    for batch in batches:
        out = []
        for anchor, sub, seg, c, j, words in zip(*(x.to_pylist() for x in batch.columns)):
            if (anchor, sub) != group:
                out += close()
                group, rows, texts = (anchor, sub), [], {}
            if sub >= 0:
                out += window(seg, c, j, words)
            else:
                rows.append((seg, c, j, words))
        yield batch_of(out)
    yield batch_of(close())


def cut(words: list[bytes], found) -> tuple[bytes, int]:
    """The kept words joined by blanks, and how many went."""
    import numpy as np

    if not found:
        return b" ".join(words), 0
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    for r in found:
        for j in range(r["mask"].bit_length()):
            if r["mask"] >> j & 1:
                edge[r["lo"] + j] += 1
                edge[r["lo"] + j + WINDOW] -= 1
    gone = np.cumsum(edge)[:-1] > 0
    return b" ".join([w for w, x in zip(words, gone.tolist()) if not x]), int(gone.sum())


def cutter():
    @F.arrow_udf("n_words long, n_removed long, kept string")
    def apply(texts, found):
        import pyarrow as pa

        rows = []
        for t, f in zip(texts.cast(pa.binary()).to_pylist(), found.to_pylist()):
            w = words_of(t)
            kept, n = cut(w, f)
            rows.append({"n_words": len(w), "n_removed": n, "kept": kept.decode("utf-8", "replace")})
        return pa.array(rows, type=pa.struct([("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())]))

    return apply


def dedup(docs: DataFrame, *, text: str = "text", out: str = "dedup", broadcast_rows: int = 1_000_000) -> DataFrame:
    """``docs`` with a struct ``out``: n_words, n_removed and the kept text. A column of that name is replaced."""
    t = F.col(f"`{text}`")
    h, g = F.xxhash64(t), F.hash(t)
    counts = docs.select(t).mapInArrow(anchors_only, "anchor long").groupBy("anchor").agg(F.count("*").alias("m"))
    twice = durable(counts.where("m > 1").select("anchor"))
    places = docs.select(h.alias("h"), g.alias("g"), t.alias("text")).mapInArrow(all_runs, RUN)
    places = durable(places.join(few(twice, broadcast_rows), "anchor", "left_semi"))
    kinds = durable(places.groupBy("anchor", "seg").agg(F.count("*").alias("c"), F.min(F.struct("h", "g", "lo", "n")).alias("at")))
    several = kinds.groupBy("anchor").agg(F.count("*").alias("m")).where("m > 1")
    one = kinds.join(several, "anchor").select("at.h", "at.g", F.struct("at.lo", "at.n", "anchor", "seg", F.least("c", F.lit(2)).cast("int").alias("c"), (F.col("m") > SHARD).alias("many")).alias("r"))
    one = durable(one)
    lists = one.groupBy("h", "g").agg(F.collect_list("r").alias("runs"))
    lists = F.broadcast(lists) if one.count() <= broadcast_rows else lists
    # A text that several rows share is fetched from each; equal pieces are dropped before they are dealt out.
    fetched = docs.select(h.alias("h"), g.alias("g"), t.alias("text")).join(lists, ["h", "g"]).select("text", "runs").mapInArrow(pieces, "anchor long, sub long, seg long, c int, j int, words binary")
    shards = fetched.dropDuplicates(["anchor", "sub", "seg", "j"]).repartition(F.col("anchor"), F.col("sub")).sortWithinPartitions("anchor", "sub")
    partly = shards.mapInArrow(match, "anchor long, seg long, mask long")
    whole = kinds.where("c > 1").select("anchor", "seg", F.expr("shiftleft(1L, at.n) - 1L").alias("mask"))
    verdicts = durable(whole.unionAll(partly).groupBy("anchor", "seg").agg(F.bit_or("mask").alias("mask")))
    found = places.join(verdicts, ["anchor", "seg"]).groupBy("h", "g").agg(F.collect_set(F.struct("lo", "mask")).alias("found"))
    row = F.col("row")
    joined = docs.select(as_row(docs).alias("row"), h.alias("h"), g.alias("g")).join(found, ["h", "g"], "left")
    return joined.select(*[row.getField(c).alias(c) for c in docs.columns if c != out], cutter()(row.getField(text), F.col("found")).alias(out))


def query(docs: DataFrame) -> DataFrame:
    d = dedup(docs.select("doc_id", "text"))
    return d.select("doc_id", "dedup.n_words", "dedup.n_removed", F.sha2(F.col("dedup.kept").cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35),
k AS (SELECT r, i, sha256(array_to_string(w[i : i + 34], ' ')) AS k FROM s),
rep AS (SELECT k FROM k GROUP BY k HAVING count(*) > 1),
hit AS (SELECT DISTINCT r, i + j AS p FROM (SELECT r, i, unnest(range(0, 35)) AS j FROM k SEMI JOIN rep USING (k))),
gone AS (SELECT r, list(p) AS p FROM hit GROUP BY r),
u AS (SELECT r, w[p] AS x, p FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS p FROM d) ANTI JOIN hit USING (r, p)),
kept AS (SELECT r, string_agg(x, ' ' ORDER BY p) AS t FROM u GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(p), 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN gone USING (r) LEFT JOIN kept USING (r)
"""
