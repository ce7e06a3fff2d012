"""Ordered folds: a state machine over each key's rows, in one streamed pass."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructField, StructType


def scan(df: DataFrame, on: list[str], order: list[str], reads: list[str], step: Callable, adds: list[StructField]) -> DataFrame:
    """``df`` with the columns ``adds``, which ``step`` gives for each row.

    ``step(state, *values)`` takes the state (None for a key's first row) and the row's ``reads`` and returns the new state and a
    tuple of the added values. Rows are dealt by key, sorted within tasks and streamed in Arrow batches; the state is carried from batch
    to batch, so a key's rows are never held at once, and they are passed on as they came, without a join.
    """
    schema = StructType([*df.schema.fields, *adds])
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        types = [to_arrow_type(f.dataType) for f in adds]
        key, state = None, None
        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in on), strict=True)
            values = zip(*(batch.column(c).to_pylist() for c in reads), strict=True)
            out = []
            for now, row in zip(keys, values, strict=True):
                if now != key:
                    key, state = now, None
                state, got = step(state, *row)
                out.append(got)
            new = zip(*out, strict=True) if out else [()] * len(adds)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, t) for c, t in zip(new, types, strict=True))], names=names)

    return df.repartition(*on).sortWithinPartitions(*on, *order).mapInArrow(run, schema)
