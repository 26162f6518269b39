"""Helpers shared by the training-data operators: staged tables, word rules, column clashes."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but the six ASCII white-space characters.
SPACE_CLASS, SPACES = r"[\x20\x09-\x0D]+", " \t\n\x0b\x0c\r"

_own_dir: list[str] = []
_paths: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where that is unset, a fresh temporary
    folder in local mode; elsewhere, where machines do not share one, an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="quillon-"))
    return "file://" + _own_dir[0]


def scratch_path(spark: SparkSession, tag: str) -> str:
    _paths.append(f"{shared_dir(spark)}/quillon-{tag}-{uuid.uuid4().hex}")
    return _paths[-1]


def scratch_mark() -> int:
    """How much this process has staged so far."""
    return len(_paths)


def drop_scratch(spark: SparkSession, since: int = 0, but: int = 0) -> None:
    """Deletes what this process has staged since a mark, but for the last few tables. To be called once the results
    that read from it are written."""
    doomed = _paths[since : len(_paths) - but]
    del _paths[since : len(_paths) - but]
    for name in doomed:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def staged(df: DataFrame, tag: str) -> DataFrame:
    """Writes ``df`` as a Parquet table in the shared folder and returns it reread: lineage is cut, and
    values that depend on the physical plan (partition ids, row numbers) are fixed from here on."""
    path = scratch_path(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def without(df: DataFrame, *names: str) -> DataFrame:
    """Drops input columns that clash, in any letter case, with columns an operator adds."""
    taken = {n.lower() for n in names}
    return df.select(*[quoted(c) for c in df.columns if c.lower() not in taken])


def bounded_sample(keys: DataFrame, most: int, seed: int) -> DataFrame:
    """Rows of ``keys`` (its first column is distinct) whose key's hash is below the share that leaves about ``most``
    of them, all if there are no more. What is sent to the driver is counts: it does not grow with partitions."""
    n, key = keys.count(), keys.columns[0]
    if n <= most:
        return keys
    cut = int((2 * most / n - 1) * 2**63)
    return keys.where(F.xxhash64(F.lit(seed), quoted(key)) < F.lit(max(-(2**63), min(cut, 2**63 - 1))))


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def words_of(text: Column) -> Column:
    """The array of words of a text; null and blank texts give an empty array."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, SPACE_CLASS))


def word_count(text: Column) -> Column:
    """Number of words, without building them."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
