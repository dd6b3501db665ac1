"""Rows made in Python as Arrow batches of bounded size, without pandas: what a batch costs is shared by many rows."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

#: Rows read from Python's side at a time, and rows and characters or bytes (roughly) after which a batch is given on.
READ_ROWS, MOST_ROWS, MOST_BYTES = 256, 4096, 8 << 20


def arrow_schema(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(StructType.fromDDL(schema))


def _weight(row: tuple) -> int:
    return sum(len(x) for x in row if isinstance(x, (str, bytes))) + 8 * len(row)


def batched(rows: Iterable[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Tuples as record batches."""
    held: list[tuple] = []
    size = 0
    for r in rows:
        held.append(r)
        size += _weight(r)
        if len(held) >= MOST_ROWS or size >= MOST_BYTES:
            yield _batch(held, schema)
            held, size = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def pylist(a: pa.Array) -> list:
    """a.to_pylist(), by whole columns: texts and numbers through numpy, lists cut from their values."""
    t = a.type
    if pa.types.is_list(t) or pa.types.is_large_list(t):
        at = a.offsets.to_numpy().tolist()
        values = pylist(a.values.slice(at[0], at[-1] - at[0])) if len(a) else []
        out: list = [values[i - at[0] : j - at[0]] for i, j in zip(at, at[1:])]
        return [x if ok else None for x, ok in zip(out, a.is_valid().to_pylist())] if a.null_count else out
    if pa.types.is_struct(t):
        names = [t.field(i).name for i in range(t.num_fields)]
        out = [dict(zip(names, row)) for row in zip(*map(pylist, a.flatten()))] if names else a.to_pylist()
        return [x if ok else None for x, ok in zip(out, a.is_valid().to_pylist())] if a.null_count else out
    plain = pa.types.is_string(t) or pa.types.is_binary(t) or pa.types.is_large_string(t) or pa.types.is_large_binary(t)
    if plain or not a.null_count and (pa.types.is_integer(t) or pa.types.is_floating(t) or pa.types.is_boolean(t)):
        return a.to_numpy(zero_copy_only=False).tolist()
    return a.to_pylist()


def columns_of(batches: Iterator[pa.RecordBatch], step: int = READ_ROWS) -> Iterator[list[list]]:
    """The batches' columns as lists, a few rows at a time, so that no batch is held in Python's objects as a whole."""
    for b in batches:
        for at in range(0, b.num_rows, step):
            yield [pylist(c) for c in b.slice(at, step).columns]


def map_rows(df: DataFrame, run: Callable[..., Iterable[tuple]], schema: str) -> DataFrame:
    """The tuples that run(*a row's values) gives for each row of df."""
    arrow = arrow_schema(schema)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return batched((out for columns in columns_of(batches) for row in zip(*columns) for out in run(*row)), arrow)

    return df.mapInArrow(over, schema)
