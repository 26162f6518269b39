"""Extractors of one's own, as table functions: any Python function of a chunk's text and kind that gives claims.

    counted = extractor(lambda text, kind: [{"value": text.count("!"), "source_type": "author_anchor", "evidence": text}])
    spark.udtf.register("exclamations", counted)
    spark.sql("SELECT c.chunk_id, x.* FROM chunks c, LATERAL exclamations(c.text, c.kind) x")

``extract_by`` hands the function Arrow batches and makes one of all that it finds in each; as a table function it is called,
and its result converted, row by row. Native detectors are column expressions and need none of this.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, UserDefinedTableFunction

#: A claim: number within its chunk, and the fields that detectors give.
CLAIM = (
    StructType().add("nth", IntegerType()).add("value", IntegerType()).add("source_type", StringType()).add("scope_operator", StringType())
    .add("evidence", StringType()).add("items", ArrayType(StringType()))
)
FIELDS = tuple(CLAIM.names[1:])
Extractor = Callable[[str, str], Iterable[Mapping[str, Any]]]


def extractor(of: Extractor) -> UserDefinedTableFunction:
    """A table function (text, kind) of claims. ``of`` is not asked about null texts; a null kind is prose. Claims without
    a value are none; fields that a claim lacks are null, and unknown ones are an error."""
    fields, schema = FIELDS, CLAIM

    class Extract:
        @staticmethod
        def analyze(text: AnalyzeArgument, kind: AnalyzeArgument) -> AnalyzeResult:
            for name, argument in (("text", text), ("kind", kind)):
                if argument.isTable or argument.dataType.typeName() not in ("string", "void"):
                    raise ValueError(f"{name} is no string")
            return AnalyzeResult(schema)

        def eval(self, text: str | None, kind: str | None) -> Iterator[tuple]:  # noqa: A003
            nth = 0
            for claim in of(text, kind or "prose") if text is not None else ():
                if unknown := set(claim) - set(fields):
                    raise ValueError(f"a claim has no {', '.join(sorted(unknown))}")
                if claim.get("value") is not None:
                    yield (nth, *(claim.get(f) for f in fields))
                    nth += 1

    out = F.udtf(Extract, useArrow=True)
    out.claims_of = Extract().eval
    return out


#: ``CLAIM``, as Arrow has it.
ARROW = (pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()))


def extract_by(chunks: DataFrame, of: UserDefinedTableFunction, pos: int) -> DataFrame:
    """``operators.extract.extract`` by an extractor: a row for each of its claims, whose ``pos`` is its place among the
    detectors of a set. Several claims of one chunk have the same."""
    claims_of = of.claims_of
    kept = [c for c in chunks.columns if c != "text"]
    fields = [StructField(f.name, f.dataType) for f in (*chunks.select(*kept).schema.fields, StructField("pos", IntegerType()), *CLAIM.fields[1:])]

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for k, (text, kind) in enumerate(zip(batch["text"].to_pylist(), batch["kind"].to_pylist())):
                for row in claims_of(text, kind):
                    at.append(k)
                    rows.append(row)
            if rows:
                chosen = batch.select(kept).take(pa.array(at, pa.int64()))
                values = [pa.array(x, t) for x, t in list(zip(zip(*rows), ARROW))[1:]]
                yield pa.RecordBatch.from_arrays([*chosen.columns, pa.array([pos] * len(rows), pa.int32()), *values], names=[f.name for f in fields])

    return chunks.mapInArrow(found, StructType(fields))
