"""Helpers for functions that Spark runs on Arrow batches."""

from collections.abc import Callable, Hashable, Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext

#: By name the stage that a worker's table is kept for, and the table.
_TABLES: dict[Hashable, tuple[int, object]] = {}


def _release() -> int:
    """Lets go of tables kept for other stages; workers outlive a stage and share its memory."""
    context = TaskContext.get()
    stage = context.stageId() if context else -1
    for name in [n for n, (owner, _) in _TABLES.items() if owner != stage]:
        del _TABLES[name]
    return stage


def stage_table[T](name: Hashable, make: Callable[[], T]) -> T:
    """A table that all tasks of one stage use in this worker, made by the first."""
    stage = _release()
    if name not in _TABLES:
        _TABLES[name] = (stage, make())
    return _TABLES[name][1]


#: Bytes of a piece of a batch, about; a longer row is a piece by itself.
PIECE_BYTES = 1 << 22


def slices(batches: Iterable[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in short pieces, by rows and bytes, so that a task holds few texts at a time."""
    _release()
    for batch in batches:
        left = [(at, min(rows, batch.num_rows - at)) for at in range(0, batch.num_rows, rows)][::-1]
        while left:
            at, count = left.pop()
            piece = batch.slice(at, count)
            if count > 1 and piece.nbytes > PIECE_BYTES:
                half = count // 2
                left += [(at + half, count - half), (at, half)]
            else:
                yield piece


def column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def record(schema: pa.Schema, *columns) -> pa.RecordBatch:
    arrays = [pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)
