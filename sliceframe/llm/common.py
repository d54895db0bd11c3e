"""Shared pieces of the corpus operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space that separates words, as a Java and Python character class.
SPACE = r"[\x20\x09-\x0D]+"
#: Everything that separates words of letters, digits and non-ASCII characters (before lower-casing).
BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
#: The complement of BREAK.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"

#: Lower-cases A-Z, keeps a-z, 0-9 and bytes of non-ASCII characters, turns all else to blanks.
WORD_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
#: Lower-cases A-Z only.
LOWER_TABLE = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's ``spark.checkpoint.dir`` as it is.

    Only where none is set and all runs in this process (as in tests) a local one is chosen.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.fullmatch(r"local(\[[^]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="ckpt"))
    return sc.getCheckpointDir()


def as_row(docs: DataFrame, *, without: str | None = None) -> Column:
    """All columns as one struct, which travels under a name of its own: columns of any name can't clash with an operator's."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != without])


def delete_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder of intermediate tables by the file system that it is in."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage by a compressed table in the shared folder: less room than a checkpoint, for many rows."""
    path = f"{checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and bind it for ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """Words between ASCII white space; null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def count_between(text: Column, separator: str) -> Column:
    """Number of pieces that are not empty; ``separator`` takes whole runs, so only the first and the last can be."""
    # In lambdas, and in generators, common parts are not evaluated once by themselves.
    ends = lambda p: (F.element_at(p, 1) == "").cast("int") + ((F.size(p) > 1) & (F.element_at(p, -1) == "")).cast("int")
    return let(F.split(text, separator), lambda p: F.size(p) - ends(p)).cast("long")


def count_matches(text: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0)).cast("long")


def few(df: DataFrame, rows: int) -> DataFrame:
    """A broadcast hint, if a count shows at most ``rows`` rows; give it a table that is cheap to read."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def in_slices(make: Callable, kind, *columns, rows: int = 64):
    """An Arrow array of type ``kind`` made of Python values a few rows at a time.

    ``make`` gets a list a column and returns a list. So no whole batch of texts is
    ever held as Python objects, and what a batch took is given back after it.
    """
    import pyarrow as pa

    parts = [pa.array(make(*(c.slice(i, rows).to_pylist() for c in columns)), type=kind) for i in range(0, len(columns[0]), rows)]
    out = pa.concat_arrays(parts) if parts else pa.array([], type=kind)
    parts.clear()
    pa.default_memory_pool().release_unused()
    return out
