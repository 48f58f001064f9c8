"""Helpers for work inside Arrow batches."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import cloudpickle

# Rows turned into Python objects at a time; texts can be long, so few.
ROWS = 128


def by_value(module: str) -> None:
    """Executors need not have this package: what runs in tasks travels with them."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def slices(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches that share the memory of the large ones."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def bounded(batches: Iterator[pa.RecordBatch], column: str, rows: int, limit: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most so many rows and bytes of a text column, a longer text alone."""
    for batch in slices(batches, rows):
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy()
        ends, start = sizes.cumsum(), 0
        while start < batch.num_rows:
            done = ends[start - 1] if start else 0
            stop = max(int(ends.searchsorted(done + limit, "right")), start + 1)
            yield batch.slice(start, stop - start)
            start = stop


def raw_texts(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a text column."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def fresh(columns: list[str], *names: str) -> list[str]:
    """The names, each made longer until no column has it; columns compare without case, as in Spark."""
    taken, found = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        found.append(name)
    return found


by_value(__name__)
