"""Quality classifier by co-training of two views.

One logistic model reads the text (square roots of hashed byte-pair shares), the
other the page's metadata (language, source, length class, hashed). Both start
from the same labelled documents. In each round, either view scores all
unlabelled documents, and those that it is surest of join the other's training
set with their pseudo-labels: the ``add`` best of the whole table, good and bad
ones in the share of the labels. Held-out labels calibrate each view, and a small
logistic model over both calibrated log-odds combines them.

The labelled sample is bounded: at most ``fit_rows`` documents, those with the
smallest hash of the id. A fold is a hash of the id too. Rounds and scoring are
map-only passes over all whole texts; a task passes on ``add`` rows at most, and
the driver gets ``add`` rows a view and round.

Defined results: null text or metadata counts as empty; very long texts count
whole; null labels and null ids are ignored in fitting, rows with a null id are
scored; of several labels or rows of one id the smallest counts; equal views are
one candidate, so copies don't crowd others out; candidates that tie go by hash,
then id; repeated rows are scored alike; without both classes among the labels
every score is the share of good labels (0.5 without any); an empty table gives
an empty result; extra columns of any name pass through, but for one named as
the result, which is replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sliceframe.llm.common import durable, few

TEXT_DIMS, META_DIMS = 512, 128
FIT_ROWS = 4000
ROUNDS, ADD, MARGIN = 4, 400, 1.0
CANDIDATE = "view int, bad boolean, z double, h long, id long, x binary"


def text_view(text: bytes | None):
    import numpy as np

    b = np.frombuffer(text or b"", dtype=np.uint8)
    if len(b) < 2:
        return np.zeros(TEXT_DIMS)
    pairs = (b[:-1].astype(np.uint32) * 256 + b[1:]) * np.uint32(2654435761) >> np.uint32(16)
    return np.sqrt(np.bincount(pairs % TEXT_DIMS, minlength=TEXT_DIMS) / len(pairs))


def meta_view(lang: str | None, source: str | None, size: int):
    import numpy as np
    import xxhash

    x = np.zeros(META_DIMS)
    lang, source = lang or "", source or ""
    for v in (f"lang={lang}", f"source={source}", f"size={size.bit_length()}", f"both={lang},{source}"):
        x[xxhash.xxh32_intdigest(v) % META_DIMS] = 1.0
    return x


def views_of(text: bytes | None, lang: str | None, source: str | None):
    """Both views, in the precision in which they travel."""
    import numpy as np

    return tuple(x.astype("<f4").astype(np.float64) for x in (text_view(text), meta_view(lang, source, len(text or b""))))


def log_odds(x, w) -> float:
    """Of one row: a sum whose order doesn't depend on the batch."""
    return float(x @ w[:-1] + w[-1])


def fit_logistic(x, y, weight=None, ridge: float = 1e-3, steps: int = 25):
    """Weights (bias last) by Newton steps."""
    import numpy as np

    x = np.hstack([x, np.ones((len(x), 1))])
    w, s = np.zeros(x.shape[1]), np.ones(len(x)) if weight is None else weight
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (s * (p - y)) + ridge * len(x) * w
        h = (x * (s * p * (1 - p))[:, None]).T @ x + (ridge * len(x) + 1e-9) * np.eye(len(w))
        d = np.linalg.solve(h, g)
        w = w - d
        if np.abs(d).max() < 1e-6:
            break
    return w


def logit(x, w):
    return x @ w[:-1] + w[-1]


def wanted(add: int, share: float) -> tuple[int, int]:
    """How many bad and good rows a view adds in a round."""
    bad = min(add - 1, max(1, round(add * (1 - share))))
    return bad, add - bad


def first_of(rows: list, k: int) -> list:
    """The surest ``k`` of (z, h, id, x), one for each x."""
    best: dict = {}
    for r in rows:
        if r[3] not in best or (r[1], r[2]) < (best[r[3]][1], best[r[3]][2]):
            best[r[3]] = r
    return sorted(best.values(), key=lambda r: (-abs(r[0]), r[1], r[2], r[3]))[:k]


def surest(shared):
    def emit(batches):
        """(h, id, text, lang, source) to the surest rows of a task, for each view and label."""
        import numpy as np
        import pyarrow as pa

        models, taken, counts, margin = shared.value
        best: dict = {(v, bad): [] for v in (0, 1) for bad in (True, False)}
        for batch in batches:
            columns = [batch.column(k) for k in range(5)]
            for h, i, t, lang, source in zip(*(c.to_pylist() for c in columns[:2]), columns[2].cast(pa.binary()).to_pylist(), *(c.to_pylist() for c in columns[3:])):
                views = views_of(t, lang, source)
                zs = [log_odds(x, w) for x, w in zip(views, models)]
                if max(map(abs, zs)) <= margin:
                    continue
                x = np.concatenate(views).astype("<f4").tobytes()
                if x not in taken:
                    for v, z in enumerate(zs):
                        if abs(z) > margin:
                            best[v, z < 0].append((z, h, i, x))
            for (v, bad), rows in best.items():
                if len(rows) > 4 * counts[not bad]:
                    best[v, bad] = first_of(rows, counts[not bad])
        out = [(v, bad, *r) for (v, bad), rows in best.items() for r in first_of(rows, counts[not bad])]
        kinds = [("view", pa.int32()), ("bad", pa.bool_()), ("z", pa.float64()), ("h", pa.int64()), ("id", pa.int64()), ("x", pa.binary())]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], type=t) for k, (_, t) in enumerate(kinds)], names=[n for n, _ in kinds])

    return emit


def picked(pool: DataFrame, models, taken: set, counts: tuple[int, int], margin: float) -> dict:
    """For each view the rows (x, label) of the whole pool that it is surest of, good and bad ones."""
    sc = pool.sparkSession.sparkContext
    best = durable(pool.mapInArrow(surest(sc.broadcast((models, taken, counts, margin))), CANDIDATE))
    # Equal views of several tasks are one.
    once = best.groupBy("view", "bad", "x").agg(F.min(F.struct("h", "id", "z")).alias("r")).select("view", "bad", "r.z", "r.h", "r.id", "x")
    out: dict = {0: [], 1: []}
    for v in (0, 1):
        for bad in (True, False):
            top = once.where((F.col("view") == v) & (F.col("bad") == bad)).orderBy(F.abs("z").desc(), "h", "id", "x").limit(counts[not bad]).collect()
            out[v] += [(bytes(r["x"]), 0.0 if bad else 1.0) for r in top]
    return out


def combined(models, views, y, held):
    """Calibrations of both views and their combination, from held-out rows."""
    import numpy as np

    check = held if held.any() else ~held
    z = [np.array([log_odds(x, m) for x in v[check]]) for v, m in zip(views, models)]
    platt = [fit_logistic(s[:, None], y[check], ridge=1e-4) for s in z]
    odds = np.stack([s * p[0] + p[1] for s, p in zip(z, platt)], axis=1)
    return models, platt, fit_logistic(odds, y[check], ridge=1e-2)


def fit(docs: DataFrame, labels: DataFrame, *, fit_rows: int = FIT_ROWS, rounds: int = ROUNDS, add: int = ADD, margin: float = MARGIN, seed: int = 5, broadcast_rows: int = 400_000):
    import numpy as np

    def both(x: bytes):
        row = np.frombuffer(x, dtype="<f4").astype(np.float64)
        return row[:TEXT_DIMS], row[TEXT_DIMS:]

    h = F.xxhash64(F.lit(seed), "id")
    docs = docs.select(F.col("doc_id").cast("long").alias("id"), "text", "lang", "source").where("id is not null")
    known = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.min("quality").cast("double").alias("y"))
    known = durable(known)
    some = known.orderBy(h, "id").limit(fit_rows)
    # At most fit_rows rows; an id that stands on several is one.
    one = docs.join(F.broadcast(some), "id").groupBy("id").agg(F.first("y").alias("y"), F.min(F.struct("text", "lang", "source")).alias("r"))
    rows = one.select("id", "y", h.alias("h"), F.pmod(F.xxhash64(F.lit(seed + 1), "id"), F.lit(4)).alias("fold"), "r.text", "r.lang", "r.source").orderBy("h", "id").collect()
    y = np.array([r["y"] for r in rows])
    if len(set(y)) < 2:
        return float(y.mean()) if len(y) else 0.5
    views = [np.stack(v) for v in zip(*(views_of(r["text"].encode() if r["text"] is not None else None, r["lang"], r["source"]) for r in rows))]
    held = np.array([r["fold"] == 3 for r in rows])
    if len(set(y[held])) < 2 or len(set(y[~held])) < 2:
        held = np.zeros(len(y), dtype=bool)
    train = [(v[~held], y[~held]) for v in views]
    pool = docs.join(few(known.select("id"), broadcast_rows), "id", "left_anti").select(h.alias("h"), "id", "text", "lang", "source")
    counts, taken = wanted(add, float(y.mean())), set()
    for _ in range(rounds):
        models = [fit_logistic(*t) for t in train]
        new = picked(pool, models, taken, counts, margin)
        if not any(new.values()):
            break
        for v, found in new.items():
            if found:
                other = 1 - v
                more = np.stack([both(x)[other] for x, _ in found])
                train[other] = (np.vstack([train[other][0], more]), np.concatenate([train[other][1], [k for _, k in found]]))
                taken |= {x for x, _ in found}
    return combined([fit_logistic(*t) for t in train], views, y, held)


def score(docs: DataFrame, model, *, out: str = "quality_score") -> DataFrame:
    """``docs`` (text, lang, source) with a struct ``out``: p_text, p_meta, score."""

    @F.arrow_udf("p_text double, p_meta double, score double")
    def judge(text, lang, source):
        import numpy as np
        import pyarrow as pa

        names = ["p_text", "p_meta", "score"]
        if isinstance(model, float):
            return pa.StructArray.from_arrays([pa.array(np.full(len(text), model))] * 3, names)
        models, platt, both = model
        rows = zip(text.cast(pa.binary()).to_pylist(), lang.to_pylist(), source.to_pylist())
        z = np.array([[log_odds(x, w) for x, w in zip(views_of(*r), models)] for r in rows]).reshape(-1, 2)
        o = [z[:, k] * platt[k][0] + platt[k][1] for k in (0, 1)]
        total = o[0] * both[0] + o[1] * both[1] + both[2]
        return pa.StructArray.from_arrays([pa.array(1 / (1 + np.exp(-np.clip(v, -30, 30)))) for v in (*o, total)], names)

    kept = [F.col(f"`{c}`") for c in docs.columns if c != out]
    return docs.select(*kept, judge("text", "lang", "source").alias(out))


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of all documents; a document is kept unless it is more likely bad than good."""
    d = docs.select("doc_id", "text", "lang", "source")
    q = F.col("quality_score")
    return score(d, fit(d, labels)).select("doc_id", q["p_text"].alias("p_text"), q["p_meta"].alias("p_meta"), q["score"].alias("score"), (q["score"] >= 0.5).alias("kept"))
