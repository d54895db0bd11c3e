"""Empty tables, nulls, clashing names and very long texts: op4, op5 and the pipeline."""

import hashlib

import pytest
from pyspark.sql import functions as F

from sliceframe.llm import chat, tokens

MODEL = "piece_bpe_32k.model"


def test_chat_with_clashing_names_and_long_texts(spark):
    long = "a|b\\c <|end|>\n" * 40_000
    rows = [(1, 0, "user", long, "x", "y", 5), (1, 1, "assistant", long, "x", "y", 5), (None, None, None, None, None, None, None), (1, 1, "assistant", long, "z", "y", 5)]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string, segments string, _t int")
    got = {r.conv_id: r for r in chat.format_chats(d).select("conv_id", chat.read_back(F.col("formatted")).alias("t"), chat.loss_text(F.col("segments")).alias("loss")).collect()}
    assert [tuple(x) for x in got[1].t] == [("user", long), ("assistant", long), ("assistant", long)] and got[1].loss == long * 2
    assert [tuple(x) for x in got[None].t] == [("", "")] and got[None].loss == ""
    q = {r.conv_id: r for r in chat.query(d).collect()}
    assert q.keys() == {1, None, -7} and (q[1].n_turns, q[1].loss_chars, q[1].loss_sha256) == (3, 2 * len(long), hashlib.sha256((long * 2).encode()).hexdigest())
    assert chat.query(d).columns == chat.query(d.select("conv_id", "turn", "role", "text")).columns


def test_tokens_of_empty_tables_clashing_names_and_long_texts(spark):
    path = pytest.importorskip("public_tokenizers").path(MODEL)
    lib = tokens.prove(path).live()[0]
    long = "Ünï  word <s> 漢字\n" * 30_000 + "x" * 5_000
    schema = "doc_id long, text string, n_tokens string, n_bytes string, whole int"
    rows = [(1, long, "a", "b", 1), (2, None, None, None, None), (2, "", "a", "b", 1), (None, "one two", "a", "b", 1), (None, "one two", "a", "b", 1)]
    d = spark.createDataFrame(rows, schema)
    got = sorted(((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in tokens.query(d, path).collect()))
    n, two = len(lib.encode(long)), len(lib.encode("one two"))
    assert got == sorted([(1, len(long.encode()), n, n > 4096), (2, 0, 0, False), (2, 0, 0, False), (0, 7, two, False), (0, 7, two, False)])
    kept = tokens.count(d, path)
    assert set(kept.columns) == set(d.columns) and dict(kept.dtypes)["n_tokens"] == "bigint"
    assert {(r.n_bytes, r.whole) for r in kept.collect()} == {("b", 1), (None, None)}
    none = spark.createDataFrame([], schema)
    assert tokens.query(none, path).collect() == [] and tokens.query(none, path).columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None), (1, None, "en", None, 0), (1, "", None, "s", 0), (2, "few words here", "en", "s", 14)]], ids=["empty", "nulls"])
def test_pipeline_without_usable_documents(spark, tmp_path, rows):
    import corpus_pipeline as P

    tables = {"documents": (rows, "doc_id long, text string, lang string, source string, n_chars long"), "benchmark": ([(None, None)] if rows else [], "item_id long, text string"), "labels": ([(1, None, None), (None, 1, 0)] if rows else [], "doc_id long, quality int, toxic int")}
    for name, (r, schema) in tables.items():
        spark.createDataFrame(r, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    mixed = P.run(spark, str(tmp_path))
    # A document of fewer than fifty words fails the base rule.
    assert mixed.collect() == [] and {"doc_id", "text", "lang", "source", "n_chars"} <= set(mixed.columns)
