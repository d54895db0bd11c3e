"""Reports on small tables with figures by hand."""

import pytest
from pyspark.sql import functions as F

from sliceframe.operators import aggregates
from sliceframe.plans import reports

AXIAL, OBLIQUE = [1.0, 0.0, 0.0, 0.0, 1.0, 0.0], [1.0, 0.0, 0.0, 0.0, 0.7071, 0.7071]


@pytest.fixture(scope="module")
def headers(spark):
    rows = [("T", "A", f"A/{i}", n, AXIAL, [0.0, 0.0, z]) for i, (n, z) in enumerate([(1, 9.0), (2, 6.0), (3, 3.0), (4, 0.0)])]
    rows += [("T", "B", f"B/{i}", n, OBLIQUE if i else None, [0.0, 0.0, float(i)]) for i, n in enumerate([1, None, 2])]
    rows += [("U", "C", f"C/{i}", 1, [-1.0, *AXIAL[1:]] if i == 1 else AXIAL, [0.0, 0.0, 2.0]) for i in range(2)]
    rows += [("U", "D", "D/0", 5, None, None)]
    return spark.createDataFrame([(*r, 4, 4, r[2]) for r in rows], "study_id string, series_id string, path string, instance int, iop array<double>, ipp array<double>, rows int, columns int, sop_uid string")


@pytest.fixture(scope="module")
def listed(spark):
    return spark.createDataFrame([("T", "A", "Axial", 1), ("T", "B", "Coronal", None), ("V", "C", "Sagittal", 0), ("V", "Z", None, 0), ("V", "Z", None, 0)], "study_id string, series_id string, plane_csv string, fluid int")


def test_orientation(headers, listed):
    d = reports.orientation_details(headers, listed.dropDuplicates(["series_id"]))
    got = {r.series_id: (r.n_usable, r.derived_plane, r.reason, r.spread is not None and round(r.spread, 3)) for r in d.collect()}
    # C's two normals point against each other: their mean has no direction.
    assert got == {"A": (4, "axial", None, 0.0), "B": (2, "unknown", "oblique or ambiguous normal", 0.0), "C": (2, "unknown", "oblique or ambiguous normal", 1.0), "D": (0, None, "no usable IOP", False)}
    one = reports.orientation_summary(d).first()
    assert (one.n_series, one.n_derivable, one.agreement, one.n_confusions, one.n_unknown, one.constant_rate) == (4, 3, 1 / 3, 2, 2, 2 / 3)
    assert [tuple(x) for x in one.by_plane] == [("Sagittal", 1, 0), ("Coronal", 1, 0), ("Axial", 1, 1)] and [(x.signs, x.n_series) for x in one.signs] == [([0, 0, 1], 2)]


def test_ordering(headers):
    got = {r.series_id: r for r in reports.ordering_details(headers).collect()}
    a, b, c, d = (got[k] for k in "ABCD")
    assert (a.unique, a.contiguous, a.consistent, a.span, a.median_gap, a.gap_cv, a.n_dup, a.rho, a.direction) == (True, True, True, 9.0, 3.0, 0.0, 0, -1.0, "decreasing")
    assert (b.n_missing, b.contiguous, b.n_spatial, b.rho) == (1, True, 2, None)
    assert (c.unique, c.contiguous, c.consistent, c.rho, c.direction) == (False, False, False, None, None)
    assert (d.n_spatial, d.contiguous, d.span) == (0, False, None)
    one = reports.ordering_summary(reports.ordering_details(headers)).first()
    assert (one.n_series, one.n_spatial, one.unique_rate, one.n_missing, one.contiguous_rate, one.mean_rho, one.n_decreasing, one.monotone_rate) == (4, 2, 0.75, 1, 0.5, -1.0, 1, 1.0)


def test_structure(headers, listed):
    got = {(r.part, r.name): r.value for r in reports.structure_figures(headers, listed, listed.where("series_id = 'A'")).collect()}
    assert (got["listed", "rows"], got["listed", "series"], got["found", "files"], got["found", "studies"]) == (5, 4, 10, 2)
    assert (got["duplicates", "series"], got["duplicates", "pairs"], got["duplicates", "sop"]) == (1, 1, 0)
    assert (got["one_side", "found_series"], got["one_side", "listed_series"], got["one_side", "found_studies"], got["one_side", "listed_studies"]) == (1, 1, 1, 1)
    assert (got["mapping", "matching"], got["mapping", "moved"], got["overlap", "series"], got["overlap", "studies"], got["partial", "studies"]) == (2, 1, 1, 1, 0)
    assert (got["planes", "null"], got["flags", "null|0"], got["missing", "fluid"], got["layout", "series"], got["slices_per_series_n", "2"]) == (2, 2, 1, 4, 1)


def test_layout(spark, listed):
    by_study = spark.createDataFrame([("T\\x\\1",), ("V/y/2",), ("A/z/3",)], "path string")
    assert reports.layout(by_study, listed).first().asDict() == {"n_folders": 3, "n_series": 1, "n_studies": 2, "keyed_by": "study"}
    assert reports.layout(by_study.limit(0), listed).first().keyed_by == "series"


def test_duplicates(spark):
    d = spark.createDataFrame([(i, "a" if i < 9 else f"t{i}") for i in range(12)] + [(20, None), (21, None)], "k long, t string").repartition(5)
    assert aggregates.duplicate_count(d, "t").first().asDict() == {"n_rows": 14, "n_keys": 5, "n_duplicates": 9}
    one = aggregates.content_duplicates(d.where("t is not null"), F.col("t"), "k", 3).collect()
    assert [(r.n, r.first_key, r.examples) for r in one] == [(9, 0, [0, 1, 2])]


def test_first_file_is_the_first_by_number(spark):
    from sliceframe.plans import health

    # Files 10 and 2 of series 5 (10 comes first as text), and series 62, whose line 2 has no number.
    lines = [(k, n, 1, s, 5.0) for k, n, s in [(5, 10, 1), (5, 2, 1), (62, 2, 1), (62, 3, 1), (62, 3, 2)]]
    d = spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double")
    assert {r.series_id: (r.path, r.place) for r in health.first_file_of_series(lambda _: d).collect()} == {"S5": ("5/2-1-1", 1), "S62": ("62/3-1-1", 1)}
