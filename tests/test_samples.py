"""Stage 2: choice by settings, samples, skips, the sample cache and study batches, against cases made by hand."""

import glob
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from sliceframe import settings
from sliceframe.operators import pixels
from sliceframe.plans import preparation, samples
from sliceframe.sources import files

HEADER = "study_id string, series_id string, sop_uid string, path string, instance int, iop array<double>, ipp array<double>, rows int, columns int, modality string, photometric string"
AXIAL, CORONAL = [1.0, 0.0, 0.0, 0.0, 1.0, 0.0], [1.0, 0.0, 0.0, 0.0, 0.0, -1.0]
PIXELS = "path string, rows int, columns int, pixels array<double>, slope double, photometric string, error string"
CONFIG = settings.override(settings.defaults(), image_size=[8, 8], num_samples_per_plane=3)


def series(name, n, *, study="T", iop=AXIAL, flip=None, gaps=None, size=(6, 8), photometric="MONOCHROME2"):
    at, out = 0.0, []
    for i in range(n):
        own = [-x for x in iop[:3]] + iop[3:] if i == flip else iop
        place = [0.0, 0.0, at] if iop is AXIAL else [0.0, at, 0.0]
        out.append((study, name, f"{name}.{i}", f"{name}/{i:02d}", i + 1, own, place, *size, "MR", photometric))
        at += gaps[i] if gaps and i < len(gaps) else 2.0
    return out


def pictures(rows, seed=1):
    rng = np.random.default_rng(seed)
    return {r[3]: rng.integers(0, 900, r[7] * r[8]).astype(float) for r in rows}


def tables(spark, rows, listed, made, bad=()):
    headers = spark.createDataFrame(rows, HEADER)
    attributes = spark.createDataFrame(listed, "study_id string, series_id string, plane_csv string, fluid int")
    size = {r[3]: (r[7], r[8]) for r in rows}
    decoded = spark.createDataFrame([(p, *size[p], None if p in bad else v.tolist(), 1.0, None, "too few pixels" if p in bad else None) for p, v in made.items()], PIXELS)
    return headers, attributes, decoded


def test_flipped_normal(spark):
    rows = series("A", 5, flip=2) + series("B", 5)
    headers, attributes, _ = tables(spark, rows, [("T", "A", "Axial", 0), ("T", "B", "Axial", 1)], pictures(rows))
    got = {r.series_id: (r.method, r.plane) for r in preparation.series_info(headers, attributes).collect()}
    assert got == {"A": ("instance_number", "unknown"), "B": ("spatial", "axial")}


def test_preferences_and_weights(spark):
    rows = series("A", 5) + series("B", 9) + series("C", 9, iop=CORONAL) + series("D", 5, iop=CORONAL)
    headers, attributes, _ = tables(spark, rows, [("T", "A", "Axial", 1), ("T", "B", "Axial", 0), ("T", "C", "Coronal", 0), ("T", "D", "Coronal", 1)], pictures(rows))
    info = preparation.series_info(headers, attributes)

    def winners(**changes):
        report = preparation.selection_report(info, settings.override(settings.defaults(), **changes)).collect()
        assert [r.slot for r in sorted(report, key=lambda r: settings.defaults()["planes"].index(r.slot))] == settings.defaults()["planes"]
        return {r.slot: r.series_id for r in report}

    # Axial slots want neither kind, so the longer series wins; the other slots want fluid-sensitive ones.
    assert winners() == {"Axial": "B", "Coronal": "D", "Sagittal": None}
    assert winners(ranking_weights={"fluid": 0.0, "slices": 1.0}) == {"Axial": "B", "Coronal": "C", "Sagittal": None}
    assert winners(fluid_preference={"Axial": 1, "Coronal": 0}) == {"Axial": "A", "Coronal": "C", "Sagittal": None}
    reasons = {r.series_id: r.reasons for r in preparation.candidates(info, settings.defaults()).collect()}
    assert not any("fluid" in x for x in reasons["A"]) and reasons["C"][0] == "fluid_sensitive=0 != preference 1" and reasons["D"][0] == "fluid_sensitive=1 == preference 1"
    assert reasons["A"][1].startswith("resolution=") and reasons["A"][1].endswith("x w=0.5")


def test_issues_as_sentences_and_listed_series_without_slices(spark):
    rows = series("A", 4, size=(6, 8)) + series("A", 1, size=(4, 4))[:1] + series("B", 2, iop=CORONAL)
    rows[4] = (*rows[4][:2], "A.9", "A/09", 9, AXIAL, [0.0, 0.0, 30.0], *rows[4][7:])
    headers, attributes, _ = tables(spark, rows, [("T", "A", "Axial", 1), ("T", "B", "Axial", None), ("T", "Z", "Sagittal", 1)], {})
    info = preparation.with_unscanned(preparation.series_info(headers, attributes), attributes)
    got = {r.series_id: (r.usable, [tuple(i) for i in r.issues]) for r in preparation.checked(info, CONFIG).collect()}
    assert got["Z"] == (False, [("BLOCKING", "empty_series", "series has no DICOM instances")])
    assert ("BLOCKING", "inconsistent_dimensions", "mixed matrix sizes within series: [(4, 4), (6, 8)]") in got["A"][1]
    assert got["B"] == (False, [("BLOCKING", "insufficient_slices", "2 slices < min 3"), ("WARNING", "plane_mismatch", "CSV plane Axial disagrees with DICOM-derived plane coronal")])
    with pytest.raises(preparation.SeriesQCError):
        samples.outcomes(info, settings.override(CONFIG, mode="strict"))


@pytest.mark.parametrize("scope", ["slice", "triplet"])
@pytest.mark.parametrize("method", ["percentile", "zscore"])
def test_triplet_figures(scope, method):
    rng = np.random.default_rng(3)
    raw = [rng.normal(100 * k, 10 + k, (5, 7)) for k in range(3)]
    outs, stats = pixels.prepare_triplet(raw, [False, True, False], method=method, scope=scope, clip=[5, 95])
    # Mirrored within its own range: the smallest and the largest value change places.
    mirrored = [raw[0], raw[1].max() + raw[1].min() - raw[1], raw[2]]
    for k in range(3):
        of = mirrored[k].ravel() if scope == "slice" else np.concatenate([m.ravel() for m in mirrored])
        ordered = np.sort(of)
        cut = [np.interp(p / 100 * (len(of) - 1), np.arange(len(of)), ordered) for p in (5, 95)]
        x = np.clip(mirrored[k], *cut)
        want = (x - cut[0]) / (cut[1] - cut[0]) if method == "percentile" else (x - np.clip(of, *cut).mean()) / np.clip(of, *cut).std()
        assert np.allclose(outs[k], want, atol=1e-5) and np.allclose([stats[k]["clip_low"], stats[k]["clip_high"]], cut)
        assert stats[k]["inverted"] == (k == 1) and stats[k]["scope"] == scope and (stats[k]["mean"] is None) == (method == "percentile")
    flat, figures = pixels.prepare_triplet([np.full((2, 2), 3.0), np.full((2, 2), np.nan), np.ones((2, 2))], [True, True, False], method=method)
    assert not any(f.any() for f in flat) and figures[1]["clip_high"] == 0
    for wrong in ({"method": "none"}, {"scope": "study"}):
        with pytest.raises(ValueError):
            pixels.prepare_triplet(raw, [False] * 3, **wrong)


def test_neighbours_by_distance(spark):
    gaps = [1.0, 1.0, 5.0, 1.0, 1.0, 0.5, 0.5, 3.0, 1.0, 1.0, 1.0]
    rows = series("A", 12, gaps=gaps)
    headers, attributes, _ = tables(spark, rows, [("T", "A", "Axial", 1)], {})
    slices, at = samples.ordered_slices(headers), np.cumsum([0.0, *gaps])
    for step, reach in ((None, 5), (2.0, 5), (2.0, 1), (40.0, 3)):
        config = settings.override(CONFIG, num_samples_per_plane=12, boundary_margin=0.0, neighbor_strategy="physical_distance", neighbor_target_spacing_mm=step, neighbor_max_search_slices=reach)
        chosen = samples.outcomes(preparation.series_info(headers, attributes), config).where("outcome = 'chosen'")
        got = sorted((r.center, r.prev, r.next) for r in samples.sample_plans(chosen, slices, config).collect())
        want, pace = [], step or float(np.median(gaps))
        for c in range(1, 11):
            near = [i for i in range(12) if abs(i - c) <= reach]
            p, q = (min(near, key=lambda i: (abs(at[i] - at[c] - d), i)) for d in (-pace, pace))
            if len({p, c, q}) == 3:
                want.append((c, p, q))
        assert got == want and want
    with pytest.raises(ValueError):
        samples.sample_plans(chosen, slices, settings.override(CONFIG, neighbor_offsets=[0, 0, 1]))
    with pytest.raises(ValueError):
        samples.sample_plans(chosen, slices, settings.override(CONFIG, neighbor_strategy="other"))


def test_processing_skips_and_cache(spark, tmp_path):
    rows = series("A", 9, photometric="MONOCHROME1") + series("C", 7, iop=CORONAL, size=(8, 4)) + series("S", 5, study="U") + series("E", 3, study="V", size=(1, 1))
    made = pictures(rows)
    made["S/01"][3] = np.nan
    made["E/01"] = np.array([5.0])
    headers, attributes, decoded = tables(spark, rows, [("T", "A", "Axial", 1), ("T", "C", "Coronal", 1), ("U", "S", "Axial", 1), ("V", "E", "Axial", 0)], made, bad=("C/03",))
    config = settings.override(CONFIG, cache_dir=f"{tmp_path}/cache")

    def run(name, config=config, decoded=decoded):
        samples.process(headers, attributes, decoded, config, f"{tmp_path}/{name}")
        stream, slots = spark.read.parquet(f"{tmp_path}/{name}/stream"), spark.read.parquet(f"{tmp_path}/{name}/outcomes")
        return stream, slots, {(r.series_id, r.sample): r for r in samples.samples(stream).collect()}

    stream, slots, got = run("one")
    assert {(r.study_id, r.slot): (r.outcome, r.planned, r.made) for r in samples.series_outcomes(stream, slots).collect() if r.outcome != "no_candidate"} == {("T", "Axial"): ("processed", 3, 3), ("T", "Coronal"): ("partial", 3, 2), ("U", "Axial"): ("partial", 3, 1), ("V", "Axial"): ("processed", 1, 1)}
    notes = sorted((r.series_id, r.reason, r.detail) for r in samples.skipped(stream, slots, config).collect())
    assert notes == [("C", "unreadable slice 3", "C.3: too few pixels"), ("E", "insufficient_samples_for_request", "1 locations produced 1 triplets (requested 3)"), ("S", "invalid_pixels", "S.1: non-finite pixel values"), ("S", "invalid_pixels", "S.1: non-finite pixel values")]
    for (name, _), r in got.items():
        raw = [made[p].reshape(next((x[7], x[8]) for x in rows if x[3] == p)) for p in r.paths]
        outs, stats = pixels.prepare_triplet(raw, [name == "A"] * 3)
        want = np.stack([pixels.letterbox(o, 8, 8) for o in outs])
        assert np.array_equal(np.frombuffer(r.image, dtype="<f4").reshape(r.shape), want) and [s.clip_high for s in r.stats] == [s["clip_high"] for s in stats]
        assert r.slice_indices == [r.center - 1, r.center, r.center + 1] and r.resized[0].pad_top == (1 if name in "AS" else 0)
    record = samples.samples(stream).where("series_id = 'A'").select(samples.metadata_json(config).alias("m")).first().m
    assert '"channel_roles":["previous","center","next"]' in record and settings.fingerprint(config) in record

    # Whole series come from the cache even where pixels are gone; those with notes are made again.
    _, _, again = run("two", decoded=decoded.where("path not like 'A%'"))
    assert {k for k in again if k[0] == "A"} == {k for k in got if k[0] == "A"} and again["A", 1].image == got["A", 1].image
    at = f"{tmp_path}/cache"
    keys = {r.series_id: r.cache_key for r in files.cache_get(spark, at).select("series_id", "cache_key").distinct().collect()}
    assert set(keys) == {"A", "E"}
    # Other settings have other keys.
    _, _, other = run("three", settings.override(config, normalization_scope="triplet"), decoded.where("path not like 'A%'"))
    assert not any(k[0] == "A" for k in other)
    # A dropped entry is a miss until it is stored again.
    files.cache_drop(spark.createDataFrame([(keys["A"],)], "cache_key string"), at)
    assert keys["A"] not in {r.cache_key for r in files.cache_get(spark, at).select("cache_key").collect()}
    _, _, back = run("four")
    assert back["A", 2].image == got["A", 2].image and keys["A"] in {r.cache_key for r in files.cache_get(spark, at).select("cache_key").collect()}
    with pytest.raises(Exception, match="invalid_pixels|unreadable"):
        run("five", settings.override(config, mode="strict"))


def test_damaged_entries(spark, tmp_path, caplog):
    at = f"{tmp_path}/cache"
    rows = spark.createDataFrame([("ab1", 1, "x"), ("ab1", 2, "y"), ("cd2", 3, "z")], "cache_key string, n int, prefix string")
    files.cache_put(rows, at)
    assert sorted(map(tuple, files.cache_get(spark, at).collect())) == [("ab1", 1, "x"), ("ab1", 2, "y"), ("cd2", 3, "z")]
    for f in glob.glob(f"{at}/entries/prefix=cd/*.parquet"):
        with open(f, "r+b") as h:
            h.truncate(os.path.getsize(f) // 2)
        os.remove(os.path.join(os.path.dirname(f), f".{os.path.basename(f)}.crc"))
    spark.read.parquet(f"{at}/entries/prefix=ab").where("row.n = 1").write.mode("append").parquet(f"{at}/entries/prefix=ab")
    with caplog.at_level("WARNING"):
        assert files.cache_get(spark, at).isEmpty()
    assert "1 entries" in caplog.text


def test_study_batches(spark):
    rows = series("A", 9) + series("C", 9, iop=CORONAL)
    made = pictures(rows)
    headers, attributes, decoded = tables(spark, rows, [("T", "A", "Axial", 1), ("T", "C", "Coronal", 1)], made)
    config = settings.override(CONFIG, num_samples_per_plane=5)
    slices = samples.ordered_slices(headers)
    chosen = samples.outcomes(preparation.series_info(headers, attributes), config).where("outcome = 'chosen'")
    done = samples.folded(samples.channels(samples.sample_plans(chosen, slices, config), slices, decoded), config)
    names = [f"l{k}" for k in range(12)]
    labels = spark.createDataFrame([("T", *[None if k % 3 == 0 else float(k % 2) for k in range(12)])], "study_id string, " + ", ".join(f"{n} double" for n in names))
    studies = spark.createDataFrame([("T",), ("W",)], "study_id string")
    both = {}
    for mode in ("train", "val"):
        bags = samples.study_batches(studies, samples.samples(done), labels, names, config, chunk=2, mode=mode, transform=lambda x: x[:, ::-1]).collect()
        whole = [(r.study_id, r.chunk, len(r.images)) for r in sorted(bags)]
        assert whole == [("T", 3, 2), ("T", 4, 2), ("T", 5, 1), ("T", 6, 2), ("T", 7, 2), ("T", 8, 1), ("W", 0, 0)]
        assert all(len(r.labels) == 12 and [x is None for x in r.labels] == [r.study_id == "W" or k % 3 == 0 for k in range(12)] for r in bags)
        both[mode] = [np.frombuffer(i, dtype="<f4").reshape(3, 8, 8) for r in sorted(bags) for i in r.images]
    assert all(np.array_equal(a, b[:, ::-1]) for a, b in zip(both["train"], both["val"]))
    order = [(m.slot, m.sample) for r in sorted(bags) for m in r.sample_metadata]
    assert order == [(s, k) for s in ("Coronal", "Axial") for k in range(5)]
    with pytest.raises(ValueError):
        samples.study_batches(studies, samples.samples(done), labels, names, config, mode="test")


def test_neither_pixels_nor_candidates_are_shuffled(spark):
    rows = series("A", 5) + series("B", 7) + series("C", 7) + series("D", 4, study="U")
    headers, attributes, decoded = tables(spark, rows, [("T", "A", "Axial", 1), ("T", "B", "Axial", 0), ("T", "C", "Axial", 0), ("U", "D", None, 0)], pictures(rows))
    info = preparation.series_info(headers, attributes)
    slots = samples.outcomes(info, CONFIG)
    report = {(r.study_id, r.slot): (r.series_id, r.n_candidates) for r in preparation.selection_report(info, CONFIG).collect()}
    assert {(r.study_id, r.slot): (r.series_id, r.n_candidates) for r in preparation.best_candidates(info, CONFIG).collect()} == report and report["T", "Axial"][1] == 3
    assert {(r.study_id, r.slot): r.series_id for r in slots.collect()} == {k: v[0] for k, v in report.items()}
    # The series' own windows and one scan of the attributes, not one each time they are needed.
    assert slots._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        chosen = slots.where("outcome = 'chosen'")
        slices = samples.ordered_slices(headers)
        read = samples.channels(samples.sample_plans(chosen, slices, CONFIG), slices, decoded)
        plan = read._jdf.queryExecution().executedPlan().toString()
        assert read.count() == 3 * 3 and "BroadcastHashJoin [path" in plan and "LeftSemi" in plan.split("BroadcastHashJoin [path")[1].split("\n")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
