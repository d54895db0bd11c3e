import pytest

from sliceframe.operators.aggregates import label_statistics
from sliceframe.sources import tabular as T


def test_train_and_schema_errors(spark, tmp_path):
    head = ",".join(["StudyInstanceUID", *T.LABELS, "Report"])
    lines = [head, "1.20,1,0" + "," * 10 + ',"two\nlines"', "1.3,0,0" + "," * 11, "1.4,1" + "," * 12, "1.5" + "," * 13, "1.6" + "," * 13]
    (tmp_path / "train.csv").write_text("\n".join(lines) + "\n")
    df = T.load_train(spark, str(tmp_path / "train.csv"))
    assert [r[0] for r in df.select("StudyInstanceUID").collect()] == ["1.20", "1.3", "1.4", "1.5", "1.6"]
    s = {r.label: r for r in label_statistics(df, T.LABELS).collect()}
    assert (s["ACL"].labeled, s["ACL"].positive, s["ACL"].negative, s["ACL"].missing) == (3, 2, 1, 2)
    assert s["ACL"].prevalence == pytest.approx(2 / 3, abs=1e-6) and s["MCL"].prevalence == 0 and s["Fracture"].prevalence is None
    (tmp_path / "bad.csv").write_text("StudyInstanceUID\n1\n")
    with pytest.raises(T.TabularSchemaError):
        T.load_train(spark, str(tmp_path / "bad.csv"))
    (tmp_path / "series.csv").write_text("StudyInstanceUID,SeriesInstanceUID,Fluid_Sensitive,Fat_Suppression,Anatomical_Plane\n1,a,1,0,Oblique\n")
    with pytest.raises(T.TabularSchemaError):
        T.load_series(spark, str(tmp_path / "series.csv"))
