"""Row-wise Python over Arrow batches: the work stays partitioned by Spark, a state is built once a task."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

#: Rows that a state gets at once, so that long texts are not all held in decoded form.
ROWS = 512

#: What a Python worker keeps from one task to the next, by the module whose tasks use it.
_kept: dict[str, dict] = {}


def kept(module: str, key: str, make: Callable[[], object]):
    """What make() gave to an earlier task of the module in this Python worker, else what it gives now."""
    held = _kept.setdefault(module, {})
    if key not in held:
        held[key] = make()
    return held[key]


def release(module: str) -> None:
    """Drops what tasks of other modules left in this Python worker: executors are shared, and only one kind of task needs it."""
    for other in _kept.keys() - {module}:
        del _kept[other]


def map_rows(df: DataFrame, make: Callable[[], Callable[[dict], dict | list]], schema: str, rows: int = ROWS) -> DataFrame:
    """Each task calls make() once; what it returns maps columns {name: list} of up to `rows` rows to columns of `schema`."""
    kind = _parse_datatype_string(schema)
    assert isinstance(kind, StructType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release(make.__module__)
        step, arrow = make(), to_arrow_schema(kind)
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                made = step({n: part.column(i).to_pylist() for i, n in enumerate(batch.schema.names)})
                yield pa.RecordBatch.from_arrays([pa.array(made[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)
