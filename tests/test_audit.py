"""The audit's sentences and severities where nothing hits, where everything does, and on empty tables."""

from sliceframe.operators import audit

SCHEMA = "path string, series_id string, study_id string, patient_id string, ok boolean, rows int, columns int, min double, max double, std double, digest string, slope double, spacing_tag double, modality string, syntax string, photometric string, description string"


def file(path, series="s", **more):
    row = dict(path=path, series_id=series, study_id="t", patient_id="p", ok=True, rows=8, columns=8, min=0.0, max=9.0, std=1.0, digest=path, slope=None, spacing_tag=3.0, modality="MR", syntax=audit.SYNTAXES[0], photometric="MONOCHROME2", description="PD")
    return tuple((row | more).values())


def findings(spark, rows, issues=None, **limits):
    d = spark.createDataFrame(rows, SCHEMA)
    bad = None if issues is None else spark.createDataFrame([(p,) for p in issues], "path string")
    return {r.code: r for r in audit.audit(d, bad, **limits).collect()}


def test_clean_files(spark):
    got = findings(spark, [file("a"), file("b"), file("c", "s2", study_id="t2", patient_id=None)], [], few=2, many=1)
    assert {k: r.detail for k, r in got.items()} == {
        "pixel_decode": "all 3 files decoded successfully", "non_square_matrices": "0 image(s) have Rows != Columns", "size_consistency": "matrix size constant within every series", "rescale_consistency": "RescaleSlope constant-or-absent within each series",
        "spacing_tag_missing": "SpacingBetweenSlices absent on 0/3 files (geometry still recoverable from IPP)", "slice_count_range": "slices per series: min=1 max=2", "modality_check": "modalities present: ['MR']",
        "transfer_syntax_check": f"transfer syntaxes present: ['{audit.SYNTAXES[0]}']", "photometric_check": "photometric interpretations: ['MONOCHROME2']", "patient_id_reuse": "1 distinct pseudonymized PatientIDs in subset; 0 map to >1 study", "description_consistency": "SeriesDescription constant within every series",
    }
    assert {r.severity for r in got.values()} == {"INFO"} and got["slice_count_range"].evidence == "1,2,1,1"


def test_every_check_hits(spark):
    rows = [file(f"f{n}", ok=False, rows=None, columns=None, max=None, std=None, digest=None) for n in range(7)]
    rows += [file("g1", "x", digest="d", slope=1.0, rows=16), file("g2", "x", digest="d", slope=2.0, description="T2"), file("g3", "y", std=0.0, slope=1.0, study_id="t2"), file("g4", "y", max=0.0, spacing_tag=None, modality="CT", syntax="1.2", photometric="MONOCHROME1")]
    got = findings(spark, rows, ["b2", "b1"])
    assert got.keys() == set(audit.CHECKS)
    assert {k: r.severity for k, r in got.items()} == {k: s for k, (s, _) in audit.CHECKS.items()}
    assert (got["unreadable_pixels"].n, got["unreadable_pixels"].evidence) == (7, "f0,f1,f2,f3,f4")
    assert (got["duplicate_images"].n, got["duplicate_images"].detail) == (2, "2 files share exact pixel content in 1 group(s)")
    assert (got["non_square_matrices"].n, got["non_square_matrices"].evidence) == (1, "16x8")
    assert got["rescale_slope_inconsistent_within_series"].detail == "1 series with multiple slopes, 1 with slope on some slices only"
    assert got["modality_check"].detail == "modalities present: ['CT', 'MR']" and got["modality_check"].evidence == "CT"
    assert got["header_issues"].evidence == "b1,b2"


def test_nothing_described_and_empty(spark):
    got = findings(spark, [file("a", description=None)])["description_consistency"]
    assert (got.severity, got.n, got.detail) == ("WARNING", 0, "no series is described")
    none = findings(spark, [], [])
    assert "header_issues" not in none and (none["slice_count_range"].n, none["slice_count_range"].detail, none["modality_check"].detail) == (0, "no series", "modalities present: []")
    assert none["pixel_decode"].detail == "all 0 files decoded successfully"


def test_overview(spark):
    d = spark.createDataFrame([file("a", min=-3.0, max=4.0), file("b", max=8.0), file("c", "s2", ok=False, min=-99.0, max=99.0)], SCHEMA)
    assert audit.scope(d).first() == (3, 1, 2, 1)
    r = audit.intensity(d).first()
    assert (r.global_min, r.global_max, r.n, r["mean"], r["median"]) == (-3, 8, 2, 6, 6)
    assert {r.severity: r.n for r in audit.severity_counts(audit.audit(d)).collect()}.keys() == {"CRITICAL", "WARNING", "INFO"}
