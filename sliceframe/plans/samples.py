"""Stage 2 on pixels: from ordered slices and the choice by slot to 2.5D samples, with skips and provenance.

A study's slots become one row each with an outcome; chosen series become sample
plans (three slices each), plans become a row a slice that is joined to its
decoded pixels, and three of those fold into one ``[3, H, W]`` tensor. No step
holds a series' pixels together: the unit of work is a sample. Samples and notes
are rows of one stream, written once by ``process`` and split where they are read.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sliceframe import settings
from sliceframe.operators import pixels as P
from sliceframe.operators.ordering import order_rows, slice_positions
from sliceframe.operators.sampling import sample_locations
from sliceframe.plans import preparation
from sliceframe.plans.preparation import GROUP
from sliceframe.sources import files

SLOT = ["study_id", "slot", "series_id"]
#: Roles of a sample's slices, in the order of its channels (fixed values).
ROLES = ("previous", "center", "next")
STATS = "array<struct<method:string,scope:string,clip_low:double,clip_high:double,mean:double,std:double,inverted:boolean>>"
RESIZED = "struct<rows:int,columns:int,height:int,width:int,scale:double,pad_top:int,pad_bottom:int,pad_left:int,pad_right:int>"
SAMPLE = (
    "study_id string, slot string, series_id string, sample int, center int, slice_indices array<int>, positions array<double>, sop_uids array<string>, paths array<string>, slopes array<double>, "
    f"stats {STATS}, resized array<{RESIZED}>, shape array<int>, image binary, reason string, detail string"
)


#: Tables of at most so many rows are sent to every task.
SENT = 100_000


def kept_once(df: DataFrame) -> DataFrame:
    """``df``, evaluated now and read from there: in the shared folder, or with the executors where none is set."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None and (folder := df.sparkSession.conf.get("spark.checkpoint.dir", None)):
        sc.setCheckpointDir(folder)
    return df.checkpoint() if sc.getCheckpointDir() else df.localCheckpoint()


def sent(df: DataFrame) -> DataFrame:
    """A broadcast hint for a table that is kept and has few rows; a larger one is joined by shuffle."""
    return F.broadcast(df) if df.limit(SENT + 1).count() <= SENT else df


def slices_of(headers: DataFrame, chosen: DataFrame) -> DataFrame:
    """The ordered slices of chosen series alone; a series that isn't chosen is neither shuffled nor sorted, if few are."""
    return ordered_slices(headers.join(sent(kept_once(chosen.select(*GROUP).distinct())), GROUP, "left_semi"))


def ordered_slices(headers: DataFrame) -> DataFrame:
    """Headers in stage 2's order, from idx 0, with positions where the series is spatially ready."""
    return order_rows(slice_positions(headers, GROUP, absolute=False), GROUP, F.col("position"), F.col("instance"), F.col("sop_uid"), stage=2)


def outcomes(info: DataFrame, config: Mapping) -> DataFrame:
    """A row for each study and slot: outcome is no_candidate, unusable (with its reason) or chosen. In strict mode an unusable choice raises."""
    kept = ("n_slices", "method", "median_gap", "plane", "plane_csv", "usable", "issues")
    slots = preparation.best_candidates(preparation.checked(info, config), config, *kept)
    if config["mode"] == "strict":
        preparation.enforce(slots.where("series_id is not null").select("series_id", "usable", F.col("issues.code").alias("codes")), "strict")
    outcome = F.when(F.col("series_id").isNull(), "no_candidate").when(F.col("usable"), "chosen").otherwise("unusable")
    note = F.concat(F.lit("no candidate series matches plane "), F.col("slot"))
    reason = F.when(outcome == "no_candidate", note).when(outcome == "unusable", F.array_join(F.transform("issues", lambda i: F.concat(i["code"], F.lit(": "), i["detail"])), "; "))
    return slots.select(*SLOT, "n_slices", "method", "median_gap", "plane", "plane_csv", outcome.alias("outcome"), reason.alias("reason"))


def neighbours_by_index(centers: DataFrame, offsets: list[int]) -> DataFrame:
    near = {"prev": F.col("center") + offsets[0], "next": F.col("center") + offsets[2]}
    return centers.withColumns(near).where((F.col("prev") >= 0) & (F.col("next") < F.col("n_slices")))


def neighbours_by_distance(centers: DataFrame, slices: DataFrame, offsets: list[int], step: float | None, reach: int) -> DataFrame:
    """The slices nearest to a step before and after; candidates are the few within ``reach``, so a series is never searched as one."""
    key = [*SLOT, "sample"]
    at = slices.select(*GROUP, F.col("idx").alias("near"), F.col("position").alias("near_position"))
    pace = F.coalesce(F.lit(step or None).cast("double"), F.col("median_gap"), F.lit(1.0))
    lo, hi = F.greatest(F.col("center") - reach, F.lit(0)), F.least(F.col("center") + reach, F.col("n_slices") - 1)
    spread = centers.where("method = 'spatial'").withColumn("pace", pace).withColumn("near", F.explode(F.sequence(lo, hi))).join(at, [*GROUP, "near"])
    own = F.max(F.when(F.col("near") == F.col("center"), F.col("near_position")))
    marked = spread.groupBy(*key).agg(own.alias("own"), F.first("pace").alias("pace"), F.first("center").alias("center"), F.first("n_slices").alias("n_slices"), F.collect_list(F.struct("near", "near_position")).alias("around"))

    def nearest(k: int) -> Column:
        target = F.col("own") + F.lit(offsets[k]) * F.col("pace")
        best = F.array_min(F.transform("around", lambda x: F.struct(F.abs(x["near_position"] - target).alias("far"), x["near"].alias("near"))))["near"]
        return F.when(best != F.col("center"), best)

    found = marked.withColumns({"prev": nearest(0), "next": nearest(2)})
    return found.where("prev is not null and next is not null and prev != next").select(*key, "center", "n_slices", "prev", "next")


def sample_plans(chosen: DataFrame, slices: DataFrame, config: Mapping) -> DataFrame:
    """(study_id, slot, series_id, sample, center, prev, next); places that can't form a full triplet have none."""
    offsets = list(config["neighbor_offsets"])
    if len(offsets) != 3 or not offsets[0] < offsets[1] == 0 < offsets[2]:
        raise ValueError("neighbour offsets must be negative, zero, positive")
    n = F.col("n_slices").cast("int")
    places = sample_locations(n, config["num_samples_per_plane"], config["boundary_margin"], config["sample_positions"])
    centers = chosen.select(*SLOT, n.alias("n_slices"), "method", "median_gap", F.posexplode(places).alias("sample", "center"))
    if config["neighbor_strategy"] == "index":
        plans = neighbours_by_index(centers, offsets)
    elif config["neighbor_strategy"] == "physical_distance":
        plans = neighbours_by_distance(centers, slices, offsets, config["neighbor_target_spacing_mm"], config["neighbor_max_search_slices"])
    else:
        raise ValueError(f"unknown neighbour strategy: {config['neighbor_strategy']}")
    return plans.select(*SLOT, "sample", "center", "prev", "next")


def channels(plans: DataFrame, slices: DataFrame, decoded: DataFrame) -> DataFrame:
    """A row for each channel of each plan, with the slice's provenance and its pixels, if they could be read."""
    each = plans.select(*SLOT, "sample", "center", F.posexplode(F.array("prev", "center", "next")).alias("channel", "idx"))
    # A path is one file: where it stands twice, either row has its pixels. Only paths that a plan names are looked for.
    own = decoded.select("path", F.struct("pixels", "rows", "columns", "slope", F.col("photometric").alias("decoded_photometric"), "error").alias("payload"))
    here = slices.select(*GROUP, "idx", "position", "sop_uid", "path", "photometric")
    # Kept, so that few paths can be sent to the files: else all their pixels would be shuffled to meet them.
    wanted = kept_once(each.join(here, [*GROUP, "idx"], "left"))
    needed = own.join(sent(kept_once(wanted.select("path").distinct())), "path", "left_semi").dropDuplicates(["path"])
    return wanted.join(needed, "path", "left")


def fold(config: Mapping) -> Callable:
    """Three channel rows to one sample row, or to a row with the reason why there is none."""
    config = dict(config)

    def made(table):
        import numpy as np
        import pyarrow as pa

        rows = sorted(table.to_pylist(), key=lambda r: r["channel"])
        first = rows[0]
        out = {k: first[k] for k in (*SLOT, "sample", "center")} | {"slice_indices": [r["idx"] for r in rows], "positions": [r["position"] for r in rows], "sop_uids": [r["sop_uid"] for r in rows], "paths": [r["path"] for r in rows]}
        raw, inverted = [], []
        for r in rows:
            p = r["payload"] or {"error": "no pixels"}
            if p["error"] or p["pixels"] is None:
                out |= {"reason": f"unreadable slice {r['idx']}", "detail": f"{r['sop_uid']}: {p['error'] or 'no pixels'}"}
                break
            a = np.array(p["pixels"], dtype=np.float64)
            if not a.size or not np.isfinite(a).all() or a.size != p["rows"] * p["columns"]:
                what = "empty pixel array" if not a.size else "non-finite pixel values" if not np.isfinite(a).all() else "pixels don't fill the matrix"
                out |= {"reason": "invalid_pixels", "detail": f"{r['sop_uid']}: {what}"}
                break
            raw.append(a.reshape(p["rows"], p["columns"]))
            inverted.append((r["photometric"] or p["decoded_photometric"] or "").strip().upper() == "MONOCHROME1")
        if out.get("reason"):
            if config["mode"] == "strict":
                raise ValueError(f"{out['reason']}: {out['detail']}")
        else:
            height, width = config["image_size"]
            done, stats = P.prepare_triplet(raw, inverted, method=config["normalization_method"], scope=config["normalization_scope"], clip=config["clip_percentiles"])
            image = np.stack([P.letterbox(x, height, width, config["resize_fill"], config["resize_interpolation"]) for x in done])
            geometry = [dict(zip(("rows", "columns", "height", "width", "scale", "pad_top", "pad_bottom", "pad_left", "pad_right"), (*x.shape, height, width, *P.letterbox_geometry(*x.shape, height, width)))) for x in done]
            out |= {"slopes": [r["payload"]["slope"] for r in rows], "stats": stats, "resized": geometry, "shape": list(image.shape), "image": image.astype("<f4").tobytes()}
        return pa.Table.from_pylist([out], schema=sample_schema())

    return made


def sample_schema():
    import pyarrow as pa

    stat = pa.struct([("method", pa.string()), ("scope", pa.string()), ("clip_low", pa.float64()), ("clip_high", pa.float64()), ("mean", pa.float64()), ("std", pa.float64()), ("inverted", pa.bool_())])
    resized = pa.struct([*[(k, pa.int32()) for k in ("rows", "columns", "height", "width")], ("scale", pa.float64()), *[(k, pa.int32()) for k in ("pad_top", "pad_bottom", "pad_left", "pad_right")]])
    text, whole, real = pa.string(), pa.int32(), pa.float64()
    kinds = {"study_id": text, "slot": text, "series_id": text, "sample": whole, "center": whole, "slice_indices": pa.list_(whole), "positions": pa.list_(real), "sop_uids": pa.list_(text), "paths": pa.list_(text), "slopes": pa.list_(real), "stats": pa.list_(stat), "resized": pa.list_(resized), "shape": pa.list_(whole), "image": pa.binary(), "reason": text, "detail": text}
    return pa.schema(list(kinds.items()))


def folded(rows: DataFrame, config: Mapping) -> DataFrame:
    return rows.groupBy(*SLOT, "sample").applyInArrow(fold(config), SAMPLE)


def cache_keys(slices: DataFrame, chosen: DataFrame, config: Mapping) -> DataFrame:
    """Chosen series with the key of their settings and ordered slices."""
    own = slices.join(chosen.select(*GROUP).distinct(), GROUP).groupBy(*GROUP).agg(F.array_sort(F.collect_list(F.struct("idx", "sop_uid"))).alias("s"))
    return chosen.join(own.select(*GROUP, settings.series_cache_key(config, F.col("series_id"), F.col("s.sop_uid")).alias("cache_key")), GROUP)


def process(headers: DataFrame, attributes: DataFrame, decoded: DataFrame, config: Mapping, dest: str) -> None:
    """All studies' samples and outcomes, written under ``dest`` as the tables ``stream`` and ``outcomes``.

    The stream holds samples, and notes where a plan gave none; ``samples``, ``skipped`` and ``series_outcomes``
    read it, so that pixels are decoded, joined and folded once. With a cache folder in the settings, series found
    there whole are taken from it (they have no notes), and those processed without a note are put there.
    """
    spark = headers.sparkSession
    slots = outcomes(preparation.series_info(headers, attributes, epsilon=config["duplicate_position_epsilon_mm"]), config)
    slots.write.mode("overwrite").parquet(f"{dest}/outcomes")
    chosen = spark.read.parquet(f"{dest}/outcomes").where("outcome = 'chosen'")
    slices = slices_of(headers, chosen)
    cache = config["cache_dir"] if config["cache_enabled"] else None
    hits = None
    if cache:
        chosen = cache_keys(slices, chosen, config)
        hits = files.cache_get(spark, cache)
        todo = files.cache_misses(chosen, cache)
    else:
        todo = chosen
    stream = folded(channels(sample_plans(todo, slices, config), slices, decoded), config)
    if hits is not None:
        # Slots of the same series share its entry; the entry's own slot is the one it was made for.
        stream = stream.unionByName(chosen.select("cache_key", *SLOT).join(hits.withColumnsRenamed({c: f"_{c}" for c in SLOT}), "cache_key").select(*stream.columns))
    stream.write.mode("overwrite").parquet(f"{dest}/stream")
    if cache:
        done = spark.read.parquet(f"{dest}/stream").join(todo.select("cache_key", *SLOT), SLOT)
        whole = done.groupBy("cache_key").agg(F.count_if(F.col("reason").isNotNull()).alias("bad")).where("bad = 0").select("cache_key")
        files.cache_put(done.join(whole, "cache_key", "left_semi"), cache)


def samples(stream: DataFrame) -> DataFrame:
    return stream.where("reason is null").drop("reason", "detail")


def skipped(stream: DataFrame, slots: DataFrame, config: Mapping) -> DataFrame:
    """(study_id, slot, series_id, reason, detail): unusable choices, plans without a sample, and series with fewer samples than asked for."""
    unusable = slots.where("outcome = 'unusable'").select(*SLOT, "reason", F.lit(None).cast("string").alias("detail"))
    notes = stream.where("reason is not null").select(*SLOT, "reason", "detail")
    wanted = config["num_samples_per_plane"]
    text = F.format_string(f"%d locations produced %d triplets (requested {wanted})", F.col("planned"), F.col("made"))
    return reduce(DataFrame.unionByName, [unusable, notes, series_counts(stream, slots).where(F.col("planned") < wanted).select(*SLOT, F.lit("insufficient_samples_for_request").alias("reason"), text.alias("detail"))])


def series_counts(stream: DataFrame, slots: DataFrame) -> DataFrame:
    """Chosen series with how many samples were planned and made."""
    n = stream.groupBy(*SLOT).agg(F.count("*").alias("planned"), F.count_if(F.col("reason").isNull()).alias("made"))
    return slots.where("outcome = 'chosen'").join(n, SLOT, "left").na.fill(0, ["planned", "made"])


def series_outcomes(stream: DataFrame, slots: DataFrame) -> DataFrame:
    """A row for each study and slot, in exactly one of no_candidate, unusable, failed (no sample), partial (some plans failed) and processed."""
    counts = series_counts(stream, slots).select(*SLOT, "planned", "made")
    outcome = F.when(F.col("outcome") != "chosen", F.col("outcome")).when(F.col("made") == 0, "failed").when(F.col("made") < F.col("planned"), "partial").otherwise("processed")
    both = slots.join(counts.select("study_id", "slot", "planned", "made"), ["study_id", "slot"], "left")
    return both.select(*SLOT, outcome.alias("outcome"), F.coalesce("planned", F.lit(0)).alias("planned"), F.coalesce("made", F.lit(0)).alias("made"), "reason")


def study_batches(studies: DataFrame, made: DataFrame, labels: DataFrame, names: list[str], config: Mapping, *, chunk: int = 8, mode: str = "inference", transform: Callable | None = None) -> DataFrame:
    """(study_id, chunk, images, sample_metadata, labels): each study's samples in chunks of at most ``chunk`` rows.

    A study's bag is its chunks in order, so that its tensors never meet in one row; one without samples has one empty
    chunk. Labels are floats in the order of ``names``, null where there is none. ``transform`` (an array [3, H, W] to
    another one) runs in mode ``train`` only. A listed study that has no row in ``made`` keeps its place.
    """
    if mode not in ("train", "val", "inference"):
        raise ValueError(f"unknown mode: {mode}")
    order = {p: k for k, p in enumerate(config["planes"])}
    per_slot = -(-max(config["num_samples_per_plane"], len(config["sample_positions"] or [])) // chunk)
    slot = F.element_at(F.create_map(*[F.lit(x) for kv in order.items() for x in kv]), F.col("slot"))
    image = F.col("image")
    if transform is not None and mode == "train":
        image = transformed(transform)(image, F.col("shape"))
    one = F.struct(slot.alias("place"), "sample", image.alias("image"), F.struct(*[c for c in made.columns if c not in ("image", "study_id")]).alias("meta"))
    bags = made.groupBy("study_id", (slot * per_slot + F.expr(f"sample div {chunk}")).cast("int").alias("chunk")).agg(F.sort_array(F.collect_list(one)).alias("s"))
    values = labels.select("study_id", F.array(*[F.col(f"`{n}`").cast("float") for n in names]).alias("labels"))
    d = studies.select("study_id").distinct().join(bags, "study_id", "left").join(values, "study_id", "left")
    none = F.array(*[F.lit(None).cast("float") for _ in names])
    empty = lambda c: F.when(F.col("s").isNull(), F.slice(c, 1, 0)).otherwise(c)
    s = F.coalesce(F.col("s"), F.array(F.lit(None).cast(bags.schema["s"].dataType.elementType)))
    return d.withColumn("all", s).select("study_id", F.coalesce("chunk", F.lit(0)).alias("chunk"), empty(F.col("all.image")).alias("images"), empty(F.col("all.meta")).alias("sample_metadata"), F.coalesce("labels", none).alias("labels"))


def transformed(transform: Callable):
    """A user's function of one tensor, over Arrow batches."""

    @F.arrow_udf("binary")
    def apply(images, shapes):
        import numpy as np
        import pyarrow as pa

        return pa.array([np.asarray(transform(np.frombuffer(i.as_py(), dtype="<f4").reshape(s.as_py())), dtype="<f4").tobytes() for i, s in zip(images, shapes)], type=pa.binary())

    return apply


def metadata_json(config: Mapping) -> Column:
    """A sample's provenance as JSON text, with the roles of its channels and the fingerprint of the settings."""
    fields = ("study_id", "slot", "series_id", "center", "slice_indices", "positions", "sop_uids", "paths", "slopes", "stats", "resized")
    return F.to_json(F.struct(*fields, F.array(*map(F.lit, ROLES)).alias("channel_roles"), F.lit(settings.fingerprint(config)).alias("config_fingerprint")), {"ignoreNullFields": "false"})

