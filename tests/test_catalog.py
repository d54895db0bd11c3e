"""Every catalogue query against its DuckDB oracle on the smallest tables, and values fixed by hand."""

import duckdb
import pytest
from pyspark.sql import functions as F

from sliceframe.functions import scalar, vector
from sliceframe.operators import metrics, ordering, pixels, sampling, split
from sliceframe.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def normal(rows):
    return sorted(str([f"{v:.6f}" if isinstance(v, float) else None if v is None else v for v in r]) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = normal(tuple(r) for r in df.select(*cols).collect())
    if name in catalog.ORACLES:
        rel = duck.sql(catalog.ORACLES[name])
        assert sorted(rel.columns) == cols
        assert got == normal(rel.select(*[f'"{c}"' for c in cols]).fetchall())
    else:
        assert got


def test_textbook_auc(spark):
    p = spark.createDataFrame([("a", 0.0, 0.1), ("a", 0.0, 0.4), ("a", 1.0, 0.35), ("a", 1.0, 0.8), ("b", 1.0, 0.5), ("b", None, 0.2)], "label string, y double, score double")
    assert {r.label: r.roc_auc for r in metrics.roc_auc(p).collect()} == {"a": 0.75, "b": None}
    assert {r.label: r.pr_auc for r in metrics.average_precision(p).collect()} == {"a": 0.833333, "b": None}


def test_class_weights(spark):
    rows = [(lab, y) for lab, n in (("x", 30), ("y", 6), ("z", 3)) for y in [1.0] * n + [0.0] * (90 - n)] + [("w", None)] * 7
    w = metrics.class_weights(spark.createDataFrame(rows, "label string, y double"), hi=20.0)
    assert {r.label: r.weight for r in w.collect()} == {"x": 2.0, "y": 14.0, "z": 20.0, "w": 1.0}


def test_sampling(spark):
    one = spark.range(1)
    at = lambda c: one.select(c.alias("v")).first().v
    assert at(sampling.sample_locations(F.lit(40))) == [2, 9, 16, 23, 30, 37]
    assert at(sampling.sample_locations(F.lit(11), fractions=[0, 0.5, 0.5, 1])) == [0, 5, 10]
    with pytest.raises(ValueError):
        sampling.sample_locations(F.lit(5), fractions=[1.5])


def test_order_and_planes(spark):
    h = spark.createDataFrame([("s", f"p{i}", [0.0, 1.0, 0.0, 0.0, 0.0, -1.0], [x, 0.0, 0.0], i, f"u{i}") for i, x in enumerate((30.0, 10.0, 20.0), 1)], "series string, path string, iop array<double>, ipp array<double>, inst int, uid string")
    d = ordering.order_rows(ordering.slice_positions(h, ["series"]), ["series"], F.col("position"), F.col("inst"), F.col("uid"))
    got = {r.inst: (r.idx, r.method, r.plane) for r in d.select("inst", "idx", "method", vector.plane_of(F.col("normal")).alias("plane")).collect()}
    assert {m for _, m, _ in got.values()} == {"spatial"} and {p for _, _, p in got.values()} == {"sagittal"}
    assert [i for i, _ in sorted(got.items(), key=lambda kv: kv[1][0])] in ([2, 3, 1], [1, 3, 2])
    hints = spark.createDataFrame([("PD_SAG",), ("cor ax",), (None,)], "d string").select(scalar.description_hint(F.col("d")).alias("h")).collect()
    assert [r.h for r in hints] == ["sagittal", None, None]


def test_no_correlation_has_no_direction(spark):
    from itertools import islice, permutations

    flat = list(islice((p for p in permutations(range(9)) if 2 * sum((a - b) ** 2 for a, b in enumerate(p)) == 9 * 80 // 3), 300))
    d = spark.createDataFrame([(k, i, float(v)) for k, p in enumerate(flat) for i, v in enumerate(p)] + [(-1, i, float(i // 2)) for i in range(4)], "k int, x int, y double").repartition(5)
    got = {r.k: (r.rho, r.direction) for r in ordering.spearman(d, ["k"], F.col("x"), F.col("y")).collect()}
    assert got.pop(-1) == (0.894427, "up") and set(got.values()) == {(0.0, None)} and len(got) == 300


def test_events_without_id_rank_last(spark, tmp_path):
    rows = [(None if (k * 13 + i * i) % 7 == 0 else i // 2 if k % 3 else i, k, None if i == 4 else float((i * 37 + k * k) % 11)) for k in range(40) for i in range(30)]
    spark.createDataFrame(rows, "event_id long, user_id long, value double").repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    got = catalog.QUERIES["spearman_order"](spark, str(tmp_path)).select("user_id", "n", "rho", "direction").collect()
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = con.sql(f"SELECT user_id, n, rho, direction FROM ({catalog.ORACLES['spearman_order']})").fetchall()
    assert normal(tuple(r) for r in got) == normal(want) and all(r.n == 29 and abs(r.rho) > 1e-6 for r in got)


def test_letterbox_and_normalize():
    import numpy as np

    assert pixels.letterbox(np.ones((60, 180)), 120, 120).sum() == 40 * 120
    assert not pixels.normalize(np.full((3, 5), 3.25)).any()
    ramp = np.arange(16.0).reshape(4, 4)
    assert np.allclose(pixels.normalize(ramp, low=0, high=100) + pixels.normalize(ramp, low=0, high=100, invert=True), 1)


def test_split(spark):
    s = split.split_ids(spark.range(100), F.col("id"))
    assert {r["split"]: r["count"] for r in s.groupBy("split").count().collect()} == {"train": 80, "val": 20}
    split.verify_no_leakage(s)
    with pytest.raises(ValueError):
        split.verify_no_leakage(s.unionByName(s.limit(1).withColumn("split", F.lit("other"))))
