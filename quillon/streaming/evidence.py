"""Evidence that grows batch by batch: K and H of every question as a snapshot and the deltas after it.

K holds the last claim of a question, chunk and source type, H the first of a question, value and source type. Both
are associative, so a batch is reduced to its own K and H first, and only that is written. A batch's delta is a folder
named after it: a batch that runs again writes the same folder again. Reading puts the snapshot and all deltas
together by the same reduction; ``compact`` does so for good. Nothing is lost or counted twice, whatever is interrupted.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: What a claim needs to have: when it arrives is told by ``arrived``, then by its rank and its detector's place.
CLAIM = "question_id string, chunk_id string, source_type string, value int, scope_operator string, evidence string, arrived long, rank int, pos int"
ARRIVAL = ("arrived", "rank", "pos")
_KEPT = ("value", "scope_operator", "evidence", *ARRIVAL)


def _least(arrival: Column, latest: bool) -> Column:
    held = F.struct(*ARRIVAL, *[c for c in (*_KEPT, "chunk_id") if c not in ARRIVAL])
    return (F.max_by if latest else F.min_by)(held, arrival).alias("held")


def latest_evidence(claims: DataFrame) -> DataFrame:
    """K: the last claim to arrive of each question, chunk and source type. Applies to its own results as well."""
    of = claims.groupBy("question_id", "chunk_id", "source_type").agg(_least(F.struct(*ARRIVAL), latest=True))
    return of.select("question_id", "chunk_id", "source_type", *[F.col(f"held.{c}") for c in _KEPT])


def first_hypotheses(claims: DataFrame) -> DataFrame:
    """H: the first claim to arrive of each question, value and source type. Applies to its own results as well."""
    of = claims.groupBy("question_id", "value", "source_type").agg(_least(F.struct(*ARRIVAL), latest=False))
    return of.select("question_id", "value", "source_type", "held.chunk_id", *[F.col(f"held.{c}") for c in _KEPT if c != "value"])


REDUCED = {"K": latest_evidence, "H": first_hypotheses}


class EvidenceStore:
    """K and H under a folder that driver and executors share: ``snapshot=N`` holds all batches up to N, ``batch=N`` one."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._root = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = self._root.getFileSystem(spark._jsc.hadoopConfiguration())

    def add(self, claims: DataFrame, batch: int) -> None:
        """The claims of a batch. The same batch again changes nothing, and one within the snapshot is known already."""
        if batch <= self.snapshot():
            return
        for name, reduced in REDUCED.items():
            reduced(claims).write.mode("overwrite").parquet(f"{self.path}/batch={batch}/{name}")
        self._mark(f"batch={batch}")

    def read(self, name: str) -> DataFrame:
        """K or H after all batches; an error while there is none."""
        if not (parts := self._parts()):
            raise ValueError(f"no evidence in {self.path}")
        tables = [self.spark.read.parquet(f"{self.path}/{part}/{name}") for part in parts]
        return REDUCED[name](reduce(DataFrame.unionByName, tables))

    def compact(self) -> None:
        """Puts the deltas into a new snapshot. Readers before and after see the same."""
        parts = self._parts()
        if len(parts) < 2:
            return
        last = max(self._number(p) for p in parts)
        for name in REDUCED:
            self.read(name).write.mode("overwrite").parquet(f"{self.path}/snapshot={last}/{name}")
        self._mark(f"snapshot={last}")
        for part in parts:
            self._fs.delete(self._path(part), True)

    def snapshot(self) -> int:
        """The batch that the latest snapshot ends with, -1 without one."""
        return max((self._number(p) for p in self._whole() if p.startswith("snapshot=")), default=-1)

    def _parts(self) -> list[str]:
        """The latest snapshot and the whole batches after it: what an interrupted compaction left behind is no part."""
        upto = self.snapshot()
        batches = sorted((p for p in self._whole() if p.startswith("batch=") and self._number(p) > upto), key=self._number)
        return [*([f"snapshot={upto}"] if upto >= 0 else []), *batches]

    def _whole(self) -> list[str]:
        """Folders that have been written to the end."""
        if not self._fs.exists(self._root):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._root) if s.isDirectory()]
        return [n for n in names if "=" in n and self._fs.exists(self._path(f"{n}/_WHOLE"))]

    def _mark(self, name: str) -> None:
        self._fs.create(self._path(f"{name}/_WHOLE"), True).close()

    def _path(self, name: str):  # noqa: ANN202
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    @staticmethod
    def _number(name: str) -> int:
        return int(name.split("=")[1])


def collect_evidence(claims: DataFrame, store: str, checkpoint: str, compact_every: int = 10) -> StreamingQuery:
    """Keeps the evidence of a stream of claims in a store, for what is there now, and ends."""

    def add(batch: DataFrame, number: int) -> None:
        kept = EvidenceStore(batch.sparkSession, store)
        kept.add(batch, number)
        if (number + 1) % compact_every == 0:
            kept.compact()

    return claims.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
