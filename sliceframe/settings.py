"""Settings of the preparation stage: defaults, a YAML file, a fingerprint, and the cache keys made of it.

A setting is one row of a table, its name in flat form and its place in the file;
values are plain JSON values, so the fingerprint needs no conversion.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Name: (place in the file, default). Names, places and defaults are fixed values.
SETTINGS = {
    "image_size": ("image_size", [224, 224]),
    "resize_interpolation": ("resize.interpolation", "bilinear"),
    "resize_fill": ("resize.fill", 0.0),
    "normalization_method": ("normalization.method", "percentile"),
    "normalization_scope": ("normalization.scope", "slice"),
    "clip_percentiles": ("normalization.clip_percentiles", [0.5, 99.5]),
    "planes": ("planes", ["Sagittal", "Coronal", "Axial"]),
    "fluid_preference": ("selection.fluid_preference", {"Sagittal": 1, "Coronal": 1, "Axial": None}),
    "num_samples_per_plane": ("sampling.num_samples_per_plane", 6),
    "sample_positions": ("sampling.sample_positions", None),
    "boundary_margin": ("sampling.boundary_margin", 0.06),
    "neighbor_strategy": ("neighbors.strategy", "index"),
    "neighbor_offsets": ("neighbors.offsets", [-1, 0, 1]),
    "neighbor_target_spacing_mm": ("neighbors.target_spacing_mm", None),
    "neighbor_max_search_slices": ("neighbors.max_search_slices", 5),
    "ranking_weights": ("selection.ranking_weights", {"fluid": 1.5, "slices": 1.0, "resolution": 0.5, "completeness": 1.0, "consistency": 2.0}),
    "min_slices_usable": ("qc.min_slices_usable", 3),
    "duplicate_position_epsilon_mm": ("qc.duplicate_position_epsilon_mm", 0.001),
    "unusual_spacing_cv": ("qc.unusual_spacing_cv", 0.15),
    "orientation_min_alignment": ("qc.orientation_min_alignment", 0.8),
    "mode": ("mode", "permissive"),
    "cache_enabled": ("cache.enabled", True),
    "cache_dir": ("cache.dir", None),
}
#: Part of a cache key (fixed value).
PIPELINE_VERSION = "2"


def defaults() -> dict:
    return json.loads(json.dumps({name: value for name, (_, value) in SETTINGS.items()}))


def like(value, default):
    """``value`` with the number types of ``default``."""
    if isinstance(default, list) and value is not None:
        return [like(v, default[0]) for v in value]
    if value is not None and type(default) in (int, float, str, bool):
        return type(default)(value)
    return value


def load(path: str | os.PathLike | None) -> dict:
    """Defaults where there is no file. A file that names no preference or weights has none."""
    out = defaults()
    if path is None or not os.path.exists(path):
        return out
    import yaml

    with open(path, encoding="utf-8") as f:
        tree = yaml.safe_load(f) or {}
    absent = object()
    for name, (place, default) in SETTINGS.items():
        node = tree
        for step in place.split("."):
            node = node.get(step, absent) if isinstance(node, Mapping) else absent
        if node is not absent:
            out[name] = like(node, default)
        elif name in ("fluid_preference", "ranking_weights"):
            out[name] = {}
    no = lambda v: v in ("none", None)
    out["fluid_preference"] = dict.fromkeys(SETTINGS["planes"][1]) | {k: None if no(v) else int(v) for k, v in out["fluid_preference"].items()}
    out["ranking_weights"] = {k: float(v) for k, v in out["ranking_weights"].items()}
    out["sample_positions"] = [float(v) for v in out["sample_positions"]] if out["sample_positions"] else None
    return out


def override(settings: Mapping, **changes) -> dict:
    if unknown := set(changes) - set(SETTINGS):
        raise TypeError(f"unknown settings: {', '.join(sorted(unknown))}")
    return {**settings, **changes}


def fingerprint(settings: Mapping) -> str:
    text = json.dumps(dict(settings), sort_keys=True, separators=(",", ":"))
    return hashlib.sha256(text.encode()).hexdigest()[:16]


def series_cache_key(settings: Mapping, series: Column, ordered_sops: Column) -> Column:
    """A digest of the settings, the series and its slices in order; keys agree with other engines for ASCII names."""
    made_of = F.struct(F.lit(fingerprint(settings)).alias("config"), F.lit(PIPELINE_VERSION).alias("pipeline_version"), series.alias("series_uid"), ordered_sops.alias("sops"))
    return F.substring(F.sha2(F.to_json(made_of), 256), 1, 24)
