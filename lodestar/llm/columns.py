"""Adds columns that Python computes from one source column, in slices of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.llm.chunktable import SLICE_BYTES, slices


def quoted(name: str) -> Column:
    """The column of exactly this name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def map_column(docs: DataFrame, source: Column, added: list[T.StructField], run: Callable[[pa.Array], list[pa.Array]], most: int = SLICE_BYTES) -> DataFrame:
    """docs with the columns that run gives for each slice of the source column's values, of about `most` bytes.

    All other columns stay as they are, whatever their names; one that is named as an added column is replaced.
    """
    names = {f.name.lower() for f in added}
    kept = [f for f in docs.schema.fields if f.name.lower() not in names]
    fields = [*kept, *added]  # tasks see plain names, whatever the real ones are
    schema = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(fields)])

    def batches_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(batch.num_columns - 1), most):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *run(part.column(part.num_columns - 1))], names=schema.names)

    read = docs.select(*[quoted(f.name).alias(f"c{i}") for i, f in enumerate(kept)], source.alias("source"))
    return read.mapInArrow(batches_of, schema).toDF(*[f.name for f in fields])
