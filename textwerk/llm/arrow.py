"""Maps over Arrow batches, cut by the bytes of their texts, so that very long texts don't fill a worker."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

MAX_BYTES = 6 << 20


def pieces(batch: pa.RecordBatch, max_bytes: int = MAX_BYTES) -> Iterator[pa.RecordBatch]:
    if batch.nbytes <= max_bytes or batch.num_rows <= 1:
        yield batch
        return
    half = batch.num_rows // 2
    yield from pieces(batch.slice(0, half), max_bytes)
    yield from pieces(batch.slice(half), max_bytes)


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], dict | None]], schema: str) -> DataFrame:
    """make() is called once for each task and returns what turns a batch into columns (a dict of arrays
    or lists in the order of the schema; None or empty: no rows)."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema) if hasattr(StructType, "fromDDL") else df.sparkSession.createDataFrame([], schema).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            for piece in pieces(batch):
                if piece.num_rows and (out := fn(piece)):
                    cols = [pa.array(out[f.name], type=f.type, from_pandas=True) if not isinstance(out[f.name], pa.Array) else out[f.name].cast(f.type) for f in arrow]
                    if len(cols[0]):
                        yield pa.RecordBatch.from_arrays(cols, schema=arrow)

    return df.mapInArrow(run, schema)
