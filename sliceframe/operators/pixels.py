"""Pixel operators: numpy inside Arrow batches; geometry as plain columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def letterbox_columns(h: Column, w: Column, height: int, width: int) -> list[Column]:
    """Scale, new size (half to even, at least 1) and pads; odd pads go to the bottom and right."""
    k = F.least(F.lit(float(height)) / h, F.lit(float(width)) / w)
    nh, nw = (F.greatest(F.lit(1), F.bround(x * k, 0).cast("int")) for x in (h, w))
    top, left = F.floor((F.lit(height) - nh) / 2).cast("int"), F.floor((F.lit(width) - nw) / 2).cast("int")
    return [F.round(k, 6).alias("scale"), nh.alias("nh"), nw.alias("nw"), top.alias("pad_top"), (F.lit(height) - nh - top).alias("pad_bottom"), left.alias("pad_left"), (F.lit(width) - nw - left).alias("pad_right")]


def normalize(a, *, low: float = 0.5, high: float = 99.5, method: str = "minmax", invert: bool = False):
    """Percentile clip of finite pixels, then min-max or z-score (population); flat images become zeros. float32."""
    import numpy as np

    if method not in ("minmax", "zscore"):
        raise ValueError(f"unknown normalisation: {method}")
    a = np.asarray(a, dtype=np.float64)
    ok = np.isfinite(a)
    if not ok.any():
        return np.zeros(a.shape, dtype=np.float32)
    if invert:
        a = a[ok].max() - (a - a[ok].min())
    lo, hi = np.percentile(a[ok], [low, high])
    x = np.clip(np.where(ok, a, lo), lo, hi)
    if method == "minmax":
        out = (x - lo) / (hi - lo) if hi > lo else np.zeros_like(x)
    else:
        s = x[ok].std()
        out = (x - x[ok].mean()) / s if s > 0 else np.zeros_like(x)
    return out.astype(np.float32)


def resize(a, nh: int, nw: int, method: str = "bilinear"):
    """Bilinear with half-pixel centres and clamped edges, or nearest."""
    import numpy as np

    if method not in ("bilinear", "nearest"):
        raise ValueError(f"unknown interpolation: {method}")
    h, w = a.shape
    if method == "nearest":
        return a[(np.arange(nh) * h // nh)[:, None], (np.arange(nw) * w // nw)[None, :]]

    def axis(n, m):
        s = np.maximum((np.arange(m) + 0.5) * n / m - 0.5, 0)
        i = np.minimum(s.astype(int), n - 1)
        return i, np.minimum(i + 1, n - 1), s - i

    y0, y1, fy = axis(h, nh)
    x0, x1, fx = axis(w, nw)
    top = a[y0][:, x0] * (1 - fx) + a[y0][:, x1] * fx
    low = a[y1][:, x0] * (1 - fx) + a[y1][:, x1] * fx
    return (top * (1 - fy)[:, None] + low * fy[:, None]).astype(a.dtype)


def letterbox_geometry(h: int, w: int, height: int, width: int) -> tuple[float, int, int, int, int]:
    """Scale and pads (top, bottom, left, right); odd pads go to the bottom and right."""
    k = min(height / h, width / w)
    nh, nw = (max(1, round(x * k)) for x in (h, w))
    top, left = (height - nh) // 2, (width - nw) // 2
    return k, top, height - nh - top, left, width - nw - left


def letterbox(a, height: int, width: int, fill: float = 0.0, method: str = "bilinear"):
    import numpy as np

    _, top, bottom, left, right = letterbox_geometry(*a.shape, height, width)
    out = np.full((height, width), fill, dtype=np.float32)
    nh, nw = height - top - bottom, width - left - right
    out[top : top + nh, left : left + nw] = resize(np.asarray(a, dtype=np.float32), nh, nw, method)
    return out


def prepare_triplet(slices, inverted: list[bool], *, method: str = "percentile", scope: str = "slice", clip=(0.5, 99.5)):
    """Three slices normalised, each by itself or by what all three have together, and the figures it was done by.

    An inverted slice is mirrored within its own range first. Pixels are clipped to the percentiles of the finite
    ones; then ``percentile`` maps the clipped range to 0..1 and ``zscore`` to mean 0, deviation 1; flat ones become zeros.
    """
    import numpy as np

    if method not in ("percentile", "zscore"):
        raise ValueError(f"unknown normalisation: {method}")
    if scope not in ("slice", "triplet"):
        raise ValueError(f"unknown scope: {scope}")
    arrays = []
    for a, turn in zip(slices, inverted, strict=True):
        a = np.array(a, dtype=np.float64)
        ok = a[np.isfinite(a)]
        arrays.append(ok.max() - (a - ok.min()) if turn and ok.size else a)
    together = np.concatenate([a[np.isfinite(a)] for a in arrays])
    outs, stats = [], []
    for a, turn in zip(arrays, inverted):
        ok = together if scope == "triplet" else a[np.isfinite(a)]
        figures = {"method": method, "scope": scope, "clip_low": 0.0, "clip_high": 0.0, "mean": None, "std": None, "inverted": bool(turn)}
        out = np.zeros_like(a)
        if ok.size:
            low, high = (float(x) for x in np.percentile(ok, list(clip)))
            figures |= {"clip_low": low, "clip_high": high}
            x = np.clip(a, low, high)
            if method == "percentile":
                out = (x - low) / (high - low) if high > low else out
            else:
                of = np.clip(ok, low, high)
                mean, std = float(of.mean()), float(of.std())
                figures |= {"mean": mean, "std": std}
                out = (x - mean) / std if std > 0 else out
        outs.append(out.astype(np.float32))
        stats.append(figures)
    return outs, stats


def pixel_statistics(a) -> dict:
    """Of the finite pixels: min, max, mean, population std, p1, p99, and how many there are."""
    import numpy as np

    x = np.asarray(a, dtype=np.float64).ravel()
    ok = x[np.isfinite(x)]
    if not len(ok):
        return {"n": len(x), "n_finite": 0}
    p1, p99 = np.percentile(ok, [1, 99])
    return {"n": len(x), "n_finite": len(ok), "min": ok.min(), "max": ok.max(), "mean": ok.mean(), "std": ok.std(), "p1": p1, "p99": p99}


def embeddings_as_images(df: DataFrame, key: str, column: str, h: int, w: int, size: int) -> DataFrame:
    """Each vector as an image, normalised and letterboxed: key, mean and SHA-256 of the float32 bytes."""

    def work(batches):
        import hashlib

        import numpy as np
        import pyarrow as pa

        for b in batches:
            keys, means, digests = [], [], []
            for k, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                img = letterbox(normalize(np.array(v).reshape(h, w)), size, size)
                keys.append(k)
                means.append(round(float(img.mean()), 6))
                digests.append(hashlib.sha256(img.tobytes()).hexdigest())
            yield pa.RecordBatch.from_arrays([pa.array(keys, type=pa.int64()), pa.array(means, type=pa.float64()), pa.array(digests, type=pa.string())], names=[key, "mean", "sha256"])

    return df.select(F.col(key).cast("long").alias(key), column).mapInArrow(work, f"{key} long, mean double, sha256 string")
