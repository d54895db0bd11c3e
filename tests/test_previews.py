"""Previews, mosaics, the image sink, the visualize command and the header export."""

import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_dicom import image

from sliceframe import cli
from sliceframe.functions.scalar import general, shown_vector
from sliceframe.operators import previews
from sliceframe.plans.collection_catalog import Collection
from sliceframe.sources import dicom
from sliceframe.sources.images import write_images

NAN, INF = float("nan"), float("inf")


def by_hand(pixels, photometric, center, width, windowed):
    a = np.array(pixels, dtype=float)
    if windowed and center is not None and width is not None and width > 0:
        a = np.clip(a, center - width / 2, center + width / 2)
    ok = np.isfinite(a)
    if not ok.any() or a[ok].max() <= a[ok].min():
        return [0.0] * len(a)
    low, high = a[ok].min(), a[ok].max()
    a = high - (a - low) if (photometric or "").upper() == "MONOCHROME1" else a
    return [(v - low) / (high - low) if f else None for v, f in zip(a, ok)]


@pytest.mark.parametrize("windowed", [False, True])
def test_previews(spark, windowed):
    rows = [
        ([0.0, 50.0, 200.0], "MONOCHROME2", 100.0, 80.0), ([0.0, 50.0, 200.0], "monochrome1", 100.0, 80.0), ([0.0, 50.0, 200.0], None, 100.0, 0.0), ([0.0, 50.0, 200.0], "MONOCHROME2", None, 80.0),
        ([NAN, 1.0, 3.0], "MONOCHROME1", None, None), ([NAN, 1.0, 900.0], None, 5.0, 10.0), ([INF, -INF, 1.0, 2.0], None, None, None), ([7.0, 7.0], "MONOCHROME1", 1.0, 2.0), ([NAN, NAN], None, 1.0, 2.0), ([INF, 0.0], None, 1.0, 2.0), ([], None, 1.0, 2.0),
    ]
    d = spark.createDataFrame(rows, "pixels array<double>, photometric string, window_center double, window_width double")
    for r in previews.with_preview(d, windowed=windowed).collect():
        assert r.preview == pytest.approx(by_hand(*r[:4], windowed))
    none = d.limit(1).withColumn("pixels", F.lit(None).cast("array<double>"))
    assert previews.with_preview(none, windowed=windowed).first().preview is None


def test_picked_places(spark):
    for k in (1, 2, 5, 7):
        got = {r.n: r.p for r in spark.range(40).select(F.col("id").cast("int").alias("n")).select("n", previews.picked(F.col("n"), k).alias("p")).collect()}
        assert got == {n: list(range(n)) if n <= k else sorted({round(float(x)) for x in np.linspace(0, n - 1, k)}) for n in range(40)}


def test_image_is_valid():
    a = np.arange(35, dtype=np.uint8).reshape(5, 7)
    made = previews.png(a, {"Title": "Größe | 1", "Description": ""})
    assert (previews.png_bytes(made) == a).all() and dict(previews.texts(made)) == {"Title": "Größe | 1", "Description": ""}
    at, kinds = 8, []
    while at < len(made):
        n, kind = struct.unpack_from(">I4s", made, at)
        assert struct.unpack_from(">I", made, at + 8 + n)[0] == zlib.crc32(made[at + 4 : at + 8 + n])
        kinds.append(kind)
        at += 12 + n
    assert kinds == [b"IHDR", b"iTXt", b"iTXt", b"IDAT", b"IEND"]


def test_tiles_are_placed_by_row_and_column():
    small, wide = {"preview": [1.0] * 4, "rows": 2, "columns": 2}, {"preview": [0.5] * 24, "rows": 4, "columns": 6}
    a = previews.mosaic([small, wide, {"preview": None, "rows": None, "columns": None}], per_row=2)
    assert a.shape == (2 * 4 + previews.GAP, 2 * 6 + previews.GAP)
    assert (a[1:3, 2:4] == 255).all() and a[:4, :6].sum() == 4 * 255
    assert (a[:4, 10:] == 128).all() and set(a[8:, :6].ravel()) == {0, 255} and (a[8:, 10:] == 0).all()
    assert previews.mosaic([]).shape == (32, 32)


def test_python_is_called_for_a_batch_of_series(spark):
    rows = [("T", s, f"{s}.png", s, p, f"idx {p}", None if (s, p) == ("S1", 1) else [0.0, None if p else 0.5, 1.0, NAN], 2, 2, "gone" if (s, p) == ("S1", 1) else None) for s in ("S0", "S1") for p in (1, 0)] + [("T", "S2", "S2.png", None, None, None, None, None, None, None)]
    d = previews.mosaics(spark.createDataFrame(rows, "study_id string, series_id string, name string, title string, place int, caption string, preview array<double>, rows int, columns int, error string"))
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "FlatMapGroups" not in plan
    got = {r.series_id: r for r in d.collect()}
    assert [(r.n_tiles, r.n_errors, r.width, r.height) for r in (got["S0"], got["S1"], got["S2"])] == [(2, 0, 8, 2), (2, 1, 8, 2), (0, 0, 32, 32)]
    assert previews.png_bytes(got["S0"].image).tolist() == [[0, 128, 0, 0, 0, 0, 0, 0], [255, 0, 0, 0, 0, 0, 255, 0]]
    assert dict(previews.texts(got["S1"].image)) == {"Title": "S1", "Description": "idx 0\nidx 1: decode error: gone"}


def test_a_normal_reads_its_orientation_once(spark):
    from sliceframe.functions.vector import slice_normal

    iops = [[0.0, 2.0, 0.0, 0.0, 0.0, -1.0], [1.0, 0.0, 0.0, 1.0, 0.0, 0.0], [1.0] * 5, [1.0, 0.0, 0.0, None, 1.0, 0.0], None]
    d = spark.createDataFrame([(x,) for x in iops], "iop array<double>").select(slice_normal(F.col("iop")).alias("n"))
    assert [r.n for r in d.collect()] == [[-1.0, 0.0, 0.0], None, None, None, None]
    assert d._jdf.queryExecution().optimizedPlan().toString().split("\n")[0].count("iop#") == 1


def test_sink(spark, tmp_path):
    d = spark.range(6).select(F.concat(F.lit("i"), "id", F.lit(".png")).alias("name"), F.encode(F.col("id").cast("string"), "utf-8").alias("image"))
    for folder in (f"{tmp_path}/a b", f"file://{tmp_path}/c"):
        write_images(d.repartition(3), folder)
        write_images(d.where("id < 2"), folder)
    for folder in ("a b", "c"):
        assert {p.name: p.read_text() for p in (tmp_path / folder).iterdir()} == {f"i{n}.png": str(n) for n in range(6)} | {"_SUCCESS": ""}
    with pytest.raises(Exception, match="no slash"):
        write_images(d.withColumn("name", F.lit("../x")), f"{tmp_path}/d")
    assert [p.name for p in (tmp_path / "d").iterdir()] == []


def test_visualize(spark, tmp_path, capsys):
    root, dest = tmp_path / "in", tmp_path / "out"
    for n in range(1, 8):
        image(root / "good[1]" / str(n), series="1.good", number=n, ipp=(-3 * n, 0, 0))
        image(root / "mixed" / str(n), series="1.mixed", number=n, ipp=(-3 * n, 0, 0), rows=8 * (1 + n % 2))
        image(root / "other" / str(n), study="2", series="2.1", number=n, ipp=(-3 * n, 0, 0))
    broken = root / "good[1]" / "4"
    broken.write_bytes(broken.read_bytes()[:-20])
    assert cli.main(["visualize", str(root), "--study", "1", "--dest", str(dest), "--n-slices", "3"]) == 0
    assert json.loads(capsys.readouterr().out) == [f"{dest}/1_1_good_sagittal.png"]
    assert sorted(p.name for p in dest.iterdir()) == ["1_1_good_sagittal.png", "_SUCCESS"]
    made = (dest / "1_1_good_sagittal.png").read_bytes()
    said, a = dict(previews.texts(made)), previews.png_bytes(made)
    assert said["Title"].startswith("PD_SAG | plane=sagittal | 7 slices | ")
    assert said["Description"].split("\n") == ["idx 0/6 1.good.1", "idx 3/6 1.good.4: decode error: too few pixels", "idx 6/6 1.good.7"]
    assert a.shape == (8, 32) and (a[:, :8] == np.floor(np.arange(64).reshape(8, 8) / 63 * 255 + 0.5)).all()
    assert cli.main(["visualize", str(root), "--study", "1", "--dest", str(dest), "--include-invalid"]) == 0
    assert len(json.loads(capsys.readouterr().out)) == 2
    assert cli.main(["visualize", str(root), "--study", "3", "--dest", str(dest)]) == 2


def test_header_export(spark, tmp_path):
    image(tmp_path / "in" / "a" / "1", ipp=(1 / 3, -0.0, 12345678.9), study="007")
    image(tmp_path / "in" / "2", ipp=None)
    (tmp_path / "in" / "bad").write_bytes(b"\0" * 128 + b"DICM" + b"\xff" * 80)
    Collection(spark, str(tmp_path / "in")).export_headers(str(tmp_path / "out"))
    got = {r.path: r for r in dicom.read_header_export(spark, str(tmp_path / "out" / "dicom_headers")).collect()}
    assert len(dicom.EXPORTED) == 34 and len(dicom.CACHED) == 19 and set(dicom.CACHED) < set(dicom.EXPORTED)
    one = got["a/1"]
    assert set(got) == {"a/1", "2"} and (one.StudyInstanceUID, one.Rows, one.PixelSpacing) == ("007", 8, [0.5, 0.5])
    assert one.ImagePositionPatient == [float(f"{1 / 3:.8g}"), 0, 12345679] and got["2"].ImagePositionPatient is None
    report = spark.read.json(str(tmp_path / "out" / "dicom_header_issues"))
    assert report.where("part = 'counts'").select("files_seen", "dicom_valid", "dicom_unreadable", "not_dicom").first() == (3, 2, 1, 0)
    assert [r.path.rsplit("/", 1)[1] for r in report.where("part = 'issue'").collect()] == ["bad"]
    cached = dicom.header_cache(spark, str(tmp_path / "in"), str(tmp_path / "cache"))
    assert cached.count() == 2
    # The cache is read, not scanned again.
    (tmp_path / "in" / "2").unlink()
    assert dicom.header_cache(spark, str(tmp_path / "in"), str(tmp_path / "cache")).count() == 2


def test_numbers_as_text(spark):
    xs = [0.0, -0.0, 1.0, 100.0, 99999999.9, 999999.5, 0.0001, 0.0000999999, 1e-5, 1e8, -0.5, NAN, INF, -INF, 3e-300, 1e300, 0.46875, 123456.75]
    for r in spark.createDataFrame([(x,) for x in xs], "x double").select("x", general(F.col("x"), 8).alias("a"), general(F.col("x"), 6).alias("b")).collect():
        assert (r.a, r.b) == (f"{r.x:.8g}", f"{r.x:.6g}")
    v = spark.range(1).select(shown_vector(F.array(F.lit(0.5), F.lit(1e-7))).alias("v"), general(F.lit(None).cast("double"), 6).alias("n")).first()
    assert (v.v, v.n) == ("[0.5, 1e-07]", None)
