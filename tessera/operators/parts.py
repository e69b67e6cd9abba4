"""Columns worked out in Python whose answers go back in parts of bounded size, however large the batch that came in."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of answers that a worker holds before it hands them on.
PART = 1 << 23


def parts(answers: Iterator[tuple[object, int]], build: Callable[[list], pa.Array], most: int = PART) -> Iterator[pa.Array]:
    """The answers, each with its bytes, in arrays that end with the answer with which they reach most bytes."""
    held, size = [], 0
    for answer, n in answers:
        held.append(answer)
        size += n
        if size >= most:
            yield build(held)
            held, size = [], 0
    if held:
        yield build(held)


def column_of(work: Callable[..., tuple[object, int]], build: Callable[[list], pa.Array], returns: str, *of: Column | str) -> Column:
    """work's answers, each told with its bytes, on the rows of some columns. Values come out of a batch one row at a time."""

    def answers(batches: Iterator) -> Iterator[tuple[object, int]]:
        for batch in batches:
            for row in zip(*(batch if isinstance(batch, tuple) else (batch,)), strict=True):
                yield work(*(value.as_py() for value in row))

    def one(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return parts(answers(batches), build)

    def several(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        return parts(answers(batches), build)

    return F.arrow_udf(one if len(of) == 1 else several, returns)(*of)


def struct_of(fields: list[tuple[str, pa.DataType]]) -> Callable[[list], pa.Array]:
    """Makes arrays of structs of tuples."""

    def build(rows: list[tuple]) -> pa.Array:
        columns = zip(*rows, strict=True)
        return pa.StructArray.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)], [name for name, _ in fields])

    return build
