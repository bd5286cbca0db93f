"""Row-wise Python work inside tasks: Arrow batches are cut into small runs, so few texts are Python objects at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

ROWS = 256


def runs(batches: Iterable[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def sized_runs(batches: Iterable[pa.RecordBatch], column: int, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts together have about ``most`` bytes, one row at least."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            taken = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, taken + most, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def _each(batches: Iterable[pa.RecordBatch], make: Callable[[], Callable[[str], tuple]], names: list[str], kinds: list[str]) -> Iterator[pa.RecordBatch]:
    work = make()
    types = [pa.type_for_alias(k) for k in kinds]
    for part in runs(batches):
        found = [work(t or "") for t in part.column(part.num_columns - 1).to_pylist()]
        made = [pa.array([row[k] for row in found], kind) for k, kind in enumerate(types)]
        yield pa.RecordBatch.from_arrays([*part.columns[:-1], *made], names=[*part.schema.names[:-1], *names])


def per_text(docs: DataFrame, make: Callable[[], Callable[[str], tuple]], columns: dict[str, str]) -> DataFrame:
    """Replaces the last column, a text (null: empty), by ``columns`` (name to Arrow type) of ``make()(text)``.

    ``make`` runs once in each task and returns the function for single texts.
    """
    sql = {"int64": "long", "string": "string", "double": "double", "bool": "boolean"}
    keep = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields[:-1])
    schema = ", ".join(filter(None, [keep, *(f"{n} {sql[k]}" for n, k in columns.items())]))
    return docs.mapInArrow(partial(_each, make=make, names=list(columns), kinds=list(columns.values())), schema)
