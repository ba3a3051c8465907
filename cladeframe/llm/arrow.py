"""Arrow batches of texts: ids of any type pass through untouched, and memory is bounded by bytes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows and bytes of text that are worked on at once; a longer text is alone.
ROWS, BYTES = 1000, 4 << 20


def pieces(batch: pa.RecordBatch, text: int, rows: int = ROWS, most: int = BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of at most so many rows and bytes of its text column."""
    column = batch.column(text)
    if pa.types.is_string(column.type):
        column = column.cast(pa.large_string())
    ends = memoryview(column.buffers()[1]).cast("q") if len(column) else []
    first, n, skip = 0, len(column), column.offset
    while first < n:
        last = first + 1
        while last < n and last - first < rows and ends[skip + last + 1] - ends[skip + first] <= most:
            last += 1
        yield batch.slice(first, last - first)
        first = last


def map_texts(docs: DataFrame, id_col: str, text_col: str, make: Callable[[], Callable[[list], dict]], fields: dict[str, str], extra: dict | None = None) -> DataFrame:
    """Rows (doc_id, the columns of ``extra``, the ``fields`` with their SQL types), one for each row of ``docs``.

    ``make`` is called once in each task and gives a function from a list of texts, null ones as None, to a
    dict of lists or Arrow arrays. Ids never pass through Python numbers, so all types and all values keep.
    """
    extra = extra or {}
    names = ["doc_id", *extra]
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), *[v.alias(k) for k, v in extra.items()])
    kinds = {k: slim.schema[k].dataType.simpleString() for k in names}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = make()
        for batch in batches:
            for b in pieces(batch, 1):
                got = of(b.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([b.column(0), *b.columns[2:], *[x if isinstance(x, pa.Array) else pa.array(x) for x in got.values()]], [*names, *got])

    return slim.mapInArrow(run, ", ".join(f"`{k}` {v}" for k, v in (kinds | fields).items()))
