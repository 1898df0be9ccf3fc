"""Arrow batches in, Arrow batches out: the plumbing shared by the operators that run Python inside tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

# Texts differ in length by orders of magnitude, so work is cut by bytes and not by rows.
CHUNK_BYTES = 4 << 20
# For work that makes many numbers of every byte.
SMALL_CHUNK_BYTES = 1 << 20


def chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts hold at most `limit` bytes, or a single longer text."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for row, size in enumerate(sizes):
        if row > start and held + size > limit:
            yield batch.slice(start, row - start)
            start, held = row, 0
        held += int(size)
    if batch.num_rows > start:
        yield batch.slice(start)


def fresh(df: DataFrame, name: str) -> str:
    """A column name like `name` that the frame doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def map_chunks(df: DataFrame, column: str, schema: str | T.StructType,
               work: Callable[[pa.RecordBatch], dict[str, list]], limit: int = CHUNK_BYTES) -> DataFrame:
    """Apply `work` to every slice of at most `limit` bytes; it returns the output columns by name."""
    kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema

    def run(batches):
        arrow = to_arrow_schema(kind)
        for batch in batches:
            for part in chunks(batch, column, limit):
                made = work(part)
                yield pa.RecordBatch.from_arrays([pa.array(made[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, kind)
