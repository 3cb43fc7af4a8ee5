"""Folds over ordered rows of a key: one exchange by key, a sort that spills, and one pass that holds one state."""

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def fold(rows: DataFrame, key: str, order: list[str | Column], uses: list[str], added: str, start: Callable, step: Callable) -> DataFrame:
    """rows with the columns of added (DDL): in order, step(state, *values of uses) -> (state, values to add).

    A key's rows stream through one task, so a key of any number of rows takes constant memory and linear time.
    """
    kinds = to_arrow_schema(StructType.fromDDL(added))

    def run(batches):
        last, state, first = None, None, True
        for batch in batches:
            out = []
            for k, *values in zip(*(batch.column(c).to_pylist() for c in (key, *uses))):
                if first or k != last:
                    last, state, first = k, start(), False
                state, made = step(state, *values)
                out.append(made)
            new = [pa.array([r[i] for r in out], f.type) for i, f in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *kinds.names])

    schema = StructType([*rows.schema.fields, *StructType.fromDDL(added).fields])
    return rows.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)
