"""Settings, text files and the sample cache."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from sliceframe import settings
from sliceframe.operators import pooling, ranks
from sliceframe.operators.ranks import bucket, percentiles
from sliceframe.sources import files


def test_settings(tmp_path):
    assert settings.load(tmp_path / "none.yaml") == settings.load(None) == settings.defaults()
    p = tmp_path / "s.yaml"
    p.write_text("image_size: [64, 32]\nqc: {min_slices_usable: 5}\nselection: {fluid_preference: {Axial: 1, Coronal: none}}\nnormalization: {clip_percentiles: [1, 99]}\n")
    s = settings.load(p)
    assert (s["image_size"], s["min_slices_usable"], s["clip_percentiles"], s["ranking_weights"]) == ([64, 32], 5, [1.0, 99.0], {})
    assert s["fluid_preference"] == {"Sagittal": None, "Coronal": None, "Axial": 1}
    assert settings.fingerprint(s) != settings.fingerprint(settings.defaults()) == settings.fingerprint(settings.override(s, **settings.defaults()))
    with pytest.raises(TypeError):
        settings.override(s, colour=1)


def test_cache_key(spark):
    s = settings.defaults()
    got = spark.range(1).select(settings.series_cache_key(s, F.lit("S1"), F.array(F.lit("b"), F.lit("a/1"))).alias("k")).first().k
    text = json.dumps({"pipeline_version": "2", "config": settings.fingerprint(s), "series_uid": "S1", "sops": ["b", "a/1"]}, sort_keys=True, separators=(",", ":"))
    assert got == hashlib.sha256(text.encode()).hexdigest()[:24]


def test_tables(spark, tmp_path):
    d = spark.createDataFrame([("001", [1.5, None], 'a "b"\nc, d', 1), ("2", None, None, None), ("3", [], "x", 0), ("4", None, "", 0)], "uid string, v array<double>, t string, n int")
    files.export_csv(d, f"{tmp_path}/h")
    key = lambda r: r.uid
    want = d.withColumn("t", F.nullif("t", F.lit("")))
    assert sorted(files.import_csv(spark, f"{tmp_path}/h", d.schema).collect(), key=key) == sorted(want.collect(), key=key)
    files.write_report(d.select("uid", "n"), f"{tmp_path}/r")
    assert {r.uid: r.n for r in spark.read.json(f"{tmp_path}/r").collect()} == {"001": 1, "2": None, "3": 0, "4": 0}
    split = spark.createDataFrame([("01", "train"), ("02", "val"), ("3", "train")], "unit string, split string")
    files.write_split(split, f"{tmp_path}/s")
    assert sorted(files.read_split(spark, f"{tmp_path}/s").collect()) == sorted(split.collect())


def test_cache(spark, tmp_path):
    at = f"{tmp_path}/cache"
    keys = spark.createDataFrame([("ab1", 1), ("ab2", 2), ("cd1", 3)], "cache_key string, n int")
    assert files.cache_get(spark, at) is None and files.cache_misses(keys, at).count() == 3
    files.cache_put(keys.where("n < 3"), at)
    assert [r.cache_key for r in files.cache_misses(keys, at).collect()] == ["cd1"]
    files.cache_put(files.cache_misses(keys, at), at)
    assert files.cache_misses(keys, at).isEmpty() and files.cache_get(spark, at).count() == 3


def test_buckets_and_percentiles(spark, monkeypatch):
    xs = [float("-inf"), -1e300, -5.0, -1e-9, 0.0, 1e-9, 0.3, 0.30001, 5.0, 1e300, float("inf"), float("nan")]
    got = [r.b for r in spark.createDataFrame([(x,) for x in xs], "x double").select("x", bucket(F.col("x")).alias("b")).orderBy("x").collect()]
    assert got == sorted(got) and len(set(got)) > 6
    d = spark.createDataFrame([(g, float(v)) for g, n in (("a", 5), (None, 2)) for v in range(n)] + [("a", 4.0), ("b", None)], "g string, v double")
    want = {("a", 0.0): 0.0, ("a", 0.5): 2.5, ("a", 1.0): 4.0, (None, 0.0): 0.0, (None, 0.5): 0.5, (None, 1.0): 1.0}
    for sent in (ranks.SENT, 0):
        monkeypatch.setattr(ranks, "SENT", sent)
        assert {(r.g, r.q): r.value for r in percentiles(d, ["g"], F.col("v"), [0.0, 0.5, 1.0]).collect()} == want
    assert percentiles(d.limit(0), [], F.col("v"), [0.5]).isEmpty()


def test_empty_bags(spark):
    d = spark.createDataFrame([("a", True, [1.0, 3.0]), ("a", False, [9.0, 9.0]), ("b", None, [5.0, 5.0])], "bag string, m boolean, e array<double>")
    assert {(r.bag, r.i): r.value for r in pooling.masked_mean(d, "bag", "e", F.col("m")).collect()} == {("a", 0): 1.0, ("a", 1): 3.0, ("b", 0): 0.0, ("b", 1): 0.0}
    one = pooling.label_attention_pool(d, "bag", "e", {"x": F.lit(0.0)}, F.col("m"))
    assert {(r.bag, r.label, r.i): r.value for r in one.collect()} == {("a", "x", 0): 1.0, ("a", "x", 1): 3.0}
    with pytest.raises(ValueError):
        pooling.pooling_of("sum")
