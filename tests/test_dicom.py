"""Header and pixel scans of synthetic files, grouping, ordering, validation, manifests and incremental ingest."""

import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from sliceframe.plans import collection
from sliceframe.sources import dicom
from sliceframe.streaming.ingest import ingest_headers

SAGITTAL = (0, 1, 0, 0, 0, -1)


def element(tag, vr, value):
    raw = value if isinstance(value, bytes) else "\\".join(map(str, value if isinstance(value, tuple) else (value,))).encode()
    raw += b" " * (len(raw) % 2)
    size = struct.pack("<HI", 0, len(raw)) if vr in ("OW", "SQ") else struct.pack("<H", len(raw))
    return struct.pack("<HH", tag >> 16, tag & 0xFFFF) + vr.encode() + size + raw


def image(path, study="1", series="1.1", number=1, ipp=(0, 0, 0), iop=SAGITTAL, rows=8, cols=8, sop=None, rescale=None, spacing=(0.5, 0.5)):
    out = [element(0x00080018, "UI", sop or f"{series}.{number}"), element(0x00080060, "CS", "MR"), element(0x0008103E, "LO", "PD_SAG")]
    # A sequence of undefined length must be stepped over.
    out += [struct.pack("<HH", 0x0008, 0x1140) + b"SQ\0\0" + struct.pack("<I", 0xFFFFFFFF) + struct.pack("<HHI", 0xFFFE, 0xE000, 4) + b"abcd" + struct.pack("<HHI", 0xFFFE, 0xE0DD, 0)]
    out += [element(0x00180088, "DS", 3.0), element(0x0020000D, "UI", study), element(0x0020000E, "UI", series), element(0x00200013, "IS", number)]
    out += [element(0x00200032, "DS", tuple(ipp))] if ipp else []
    out += [element(0x00200037, "DS", tuple(iop))] if iop else []
    out += [element(0x00280010, "US", struct.pack("<H", rows)), element(0x00280011, "US", struct.pack("<H", cols))]
    out += [element(0x00280030, "DS", spacing)] if spacing else []
    out += [element(0x00280100, "US", struct.pack("<H", 16)), element(0x00280103, "US", struct.pack("<H", 0))]
    out += [element(0x00281052, "DS", rescale[1]), element(0x00281053, "DS", rescale[0])] if rescale else []
    out += [element(dicom.PIXELS, "OW", (np.arange(rows * cols, dtype="<u2") + 10 * number).tobytes())]
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(b"\0" * 128 + b"DICM" + element(0x00020010, "UI", "1.2.840.10008.1.2.1") + b"".join(out))


def checked(spark, root):
    return {r.series_id: r for r in collection.validated(collection.series_table(collection.slice_table(dicom.scan_headers(spark, str(root))))).collect()}


def test_junk_files_are_counted_and_never_fail(spark, tmp_path):
    image(tmp_path / "a" / "noext")
    image(tmp_path / ".hidden" / "x")
    image(tmp_path / "venv" / "x")
    (tmp_path / "a" / "readme.txt").write_text("hello")
    (tmp_path / "a" / "tiny").write_bytes(b"abc")
    (tmp_path / "a" / "long.txt").write_text("word " * 100)
    (tmp_path / "a" / "bad.dcm").write_bytes(b"\0" * 128 + b"DICM" + b"\xff" * 80)
    h = dicom.scan_headers(spark, str(tmp_path))
    assert dicom.scan_counts(h).first().asDict() == {"files_seen": 5, "dicom_valid": 1, "dicom_unreadable": 1, "not_dicom": 3}
    assert dicom.issues(h).count() == 1
    row = h.where("kind = 'dicom'").first()
    assert (row.Rows, row.InstanceNumber, row.Modality, row.ImageOrientationPatient) == (8, 1, "MR", [0, 1, 0, 0, 0, -1])


def test_reversed_instances_are_ordered_by_position(spark, tmp_path):
    for n, x in ((1, 20), (2, 10), (3, 0)):
        image(tmp_path / f"{n}.dcm", number=n, ipp=(x, 0, 0))
    rows = collection.slice_table(dicom.scan_headers(spark, str(tmp_path))).orderBy("idx").collect()
    positions = [r.position for r in rows]
    assert {r.method for r in rows} == {"spatial"} and positions == sorted(positions) and len(set(positions)) == 3
    assert checked(spark, tmp_path)["1.1"].plane == "sagittal"


def test_rules_over_series(spark, tmp_path):
    for n in range(1, 5):
        image(tmp_path / "good" / str(n), series="good", number=n, ipp=(3 * n, 0, 0))
        image(tmp_path / "bare" / str(n), series="bare", number=n, ipp=None, iop=None, spacing=None)
        image(tmp_path / "twice" / str(n), series="twice", number=n, ipp=((0, 0, 2, 3)[n - 1], 0, 0))
        image(tmp_path / "mixed" / str(n), series="mixed", number=n, ipp=(3 * n, 0, 0), rows=8 * (1 + n % 2))
    got = checked(spark, tmp_path)
    assert (got["good"].status, got["good"].codes, got["good"].median_gap) == ("VALID", [], 3.0)
    assert got["mixed"].status == "INVALID" and got["mixed"].codes == ["mixed_size"]
    assert got["twice"].status == "WARNING" and "duplicate_positions" in got["twice"].codes
    assert (got["bare"].plane, got["bare"].method) == ("unknown", "instance_number")
    assert {"missing_spacing", "missing_orientation", "missing_position", "ordering_fallback", "positions_unknown", "plane_unknown"} <= set(got["bare"].codes)


def test_pixels_are_rescaled_and_failures_say_why(spark, tmp_path):
    image(tmp_path / "a", rescale=(2.0, 5.0))
    (tmp_path / "b").write_bytes(b"\0" * 128 + b"DICM")
    raw = np.arange(64).reshape(8, 8) + 10
    assert (dicom.pixels((tmp_path / "a").read_bytes()) == raw * 2 + 5).all()
    with pytest.raises(dicom.DicomError):
        dicom.pixels((tmp_path / "b").read_bytes())
    rows = {r.path[-1]: r for r in dicom.pixel_table(dicom.files(spark, str(tmp_path))).collect()}
    assert (rows["a"].ok, rows["a"].min, rows["a"].max) == (True, 25.0, 151.0)
    assert not rows["b"].ok and rows["b"].message


def test_manifests_and_summary(spark, tmp_path):
    root = tmp_path / "in"
    for n in range(1, 5):
        image(root / "s" / str(n), series="a", number=n, ipp=(3 * n, 0, 0))
        image(root / "t" / str(n), series="b", number=n, ipp=(3 * n, 0, 0))
    h = dicom.scan_headers(spark, str(root))
    done = collection.validated(collection.series_table(collection.slice_table(h)))
    collection.write_manifests(done, dicom.issues(h), str(tmp_path / "out"), str(root))
    rows = spark.read.csv(str(tmp_path / "out" / "series_manifest_csv"), header=True).orderBy("series_id").collect()
    # The sagittal normal points to -x, so the slice of the largest x comes first.
    assert [(r.series_id, r.slice_count, r.source_dir, r.example_path, r.pixel_spacing) for r in rows] == [("a", "4", "s", "s/4", "[0.5,0.5]"), ("b", "4", "t", "t/4", "[0.5,0.5]")]
    one = collection.study_summary(done).first()
    assert (one.study_id, one.n_series, one.n_slices) == ("1", 2, 8)
    assert (one.n_valid_series, one.n_warning_series, one.n_invalid_series, one.available_planes, one.validation_warnings) == (2, 0, 0, ["sagittal"], [])
    assert json.loads(one.series)[0]["validation_messages"] == ["all inspected checks passed"] and rows[0].validation_messages == "all inspected checks passed"


def test_sentences(spark, tmp_path):
    for n in range(1, 5):
        image(tmp_path / "m" / str(n), series="m", number=n, ipp=((0, 2, 4, 30)[n - 1], 0, 0), rows=8 * (1 + n % 2), spacing=(0.5, 0.5 * n))
        image(tmp_path / "t" / str(n), series="t", number=n, ipp=None, iop=None)
    h = dicom.scan_headers(spark, str(tmp_path)).withColumns({"NumberOfFrames": F.when(F.col("path").contains("/t/"), F.lit(3)), "read_error": F.when(F.col("path").rlike("/t/[23]"), F.lit("cut off")), "SpacingBetweenSlices": F.lit(9.0)})
    series = collection.series_table(collection.slice_table(h))
    listed = spark.createDataFrame([("1", "m"), ("1", "z"), ("9", "y")], "study_id string, series_id string")
    done = collection.validated(collection.with_unscanned(series, listed))
    got = {r.series_id: (r.status, r.messages) for r in done.collect()}
    assert got["z"] == got["y"] == ("INVALID", ["empty series (no DICOM instances)"])
    assert got["m"][0] == "INVALID" and got["m"][1][:2] == ["inconsistent dimensions rows={8, 16} columns={8}", "inconsistent PixelSpacing values: {(0.5, 0.5), (0.5, 1.0), (0.5, 1.5), (0.5, 2.0)}"]
    assert "unusual slice spacing variation CV=1.131 > 0.15" in got["m"][1] and "SpacingBetweenSlices tag=9 disagrees with median position delta=2" in got["m"][1]
    assert got["t"][1][0] == "2 unreadable instance(s), e.g. cut off" and "multi-frame DICOM detected NumberOfFrames={3} (not expanded in this milestone)" in got["t"][1] and got["t"][0] == "INVALID"
    both = {r.study_id: r for r in collection.study_summary(done).collect()}
    assert (both["1"].n_invalid_series, both["1"].n_series, both["9"].available_planes, both["9"].validation_warnings) == (3, 3, ["unknown"], ["y: empty series (no DICOM instances)"])


def test_ingest_parses_only_new_files(spark, tmp_path):
    at = [str(tmp_path / x) for x in ("in", "headers", "state")]
    image(tmp_path / "in" / "a", number=1)
    ingest_headers(spark, *at).awaitTermination()
    image(tmp_path / "in" / "b", number=2)
    ingest_headers(spark, *at).awaitTermination()
    ingest_headers(spark, *at).awaitTermination()
    assert sorted(r.InstanceNumber for r in spark.read.parquet(at[1]).collect()) == [1, 2]


def test_command_line(spark, tmp_path, capsys):
    from sliceframe.cli import main

    root = str(tmp_path / "in")
    for n in range(1, 5):
        image(tmp_path / "in" / str(n), number=n, ipp=(3 * n, 0, 0))
    assert main(["inspect", root, "--cache", str(tmp_path / "cache"), "--manifest", "--dest", str(tmp_path / "out")]) == 0
    got = json.loads(capsys.readouterr().out)
    assert (got["files_seen"], got["n_studies"], got["n_valid_series"]) == (4, 1, 1)
    assert spark.read.json(str(tmp_path / "out" / "series_manifest_json")).count() == 1
    assert main(["study-summary", root, "--study", "1"]) == 0
    assert json.loads(capsys.readouterr().out)["series"][0]["plane"] == "sagittal"
    assert main(["study-summary", root, "--study", "none"]) == 2
    assert main(["inspect", str(tmp_path / "missing")]) == 2


def test_an_element_costs_no_calls(tmp_path):
    import sys

    image(tmp_path / "1")
    data, calls = (tmp_path / "1").read_bytes(), []
    sys.setprofile(lambda frame, event, arg: calls.append(frame.f_code.co_name) if event == "call" else None)
    try:
        got = dicom.header(data)
    finally:
        sys.setprofile(None)
    # Only the sequence of undefined length is walked by calls.
    assert got["kind"] == "dicom" and got["Rows"] and calls.count("skip") <= 1


def test_a_scan_parses_each_file_once(spark, tmp_path):
    from sliceframe.plans import catalog

    plan = catalog.queries()["dicom_scan"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1
    for n in range(1, 5):
        image(tmp_path / str(n), series=f"1.{n % 2}", study=str(n % 2 or ""), number=n)
    (tmp_path / "x").write_bytes(b"no image")
    (tmp_path / "y").write_bytes(b"\0" * 128 + b"DICM" + b"\xff" * 80)
    assert tuple(collection.scan_summary(dicom.scan_headers(spark, str(tmp_path))).first()) == (6, 4, 1, 1, 2, 2)
    assert tuple(collection.scan_summary(dicom.scan_headers(spark, str(tmp_path)).limit(0)).first()) == (0, 0, 0, 0, 0, 0)


def test_files_share_values_but_no_lists(tmp_path):
    known = {}
    for n in (1, 2, 3):
        image(tmp_path / str(n), number=n, ipp=(n, 0, 0), sop=f"u{n}")
        data = (tmp_path / str(n)).read_bytes()
        assert dicom.header(data, known) == (one := dicom.header(data, known)) == dicom.header(data)
        one["ImageOrientationPatient"].append(7.0)
    assert known and len(dicom.header(data, known)["ImageOrientationPatient"]) == 6
