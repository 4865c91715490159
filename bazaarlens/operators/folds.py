"""Ordered folds over keyed runs, for rules whose state no pointer can stand for.

Rows are shuffled by run, sorted inside partitions by Spark (which spills), and streamed through a generator in Arrow
batches. The fold sees the columns it asks for and its answers are appended; all others pass as they are. It keeps only
its own small state, so a long run costs time but never memory, and the hot key of a table is spread over its many runs
before it gets here.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type


def fold_sorted(df: DataFrame, run: list[str], order: list[Column], make_step: Callable[[], Callable],
                used: list[str], out: list[T.StructField]) -> DataFrame:
    """Append columns computed by a fold. `make_step()` starts a run and returns `step(row_values) -> out values`."""
    schema = T.StructType([*df.schema.fields, *out])
    kinds = [to_arrow_type(f.dataType) for f in out]

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, step = object(), None
        for batch in batches:
            keys = zip(*[batch.column(k).to_pylist() for k in run])
            answers = []
            for key, row in zip(keys, zip(*[batch.column(c).to_pylist() for c in used])):
                if key != current:
                    current, step = key, make_step()
                answers.append(step(*row))
            added = [pa.array([a[i] for a in answers], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, *[f.name for f in out]])

    sorted_runs = df.repartition(*run).sortWithinPartitions(*run, *order)
    return sorted_runs.mapInArrow(stream, schema)


def quota_step(limit: int, width: int) -> Callable[[], Callable]:
    """Admits a hit while fewer than `limit` admitted hits lie within the trailing `width`. Answers (admitted, oldest
    admitted time in the window when refused)."""
    def start():
        held: deque = deque()

        def step(at):
            while held and held[0] <= at - width:
                held.popleft()
            if len(held) >= limit:
                return False, held[0]
            held.append(at)
            return True, None
        return step
    return start
