"""A cap per class on a stream: a counter per class as state, batches trimmed to what is left."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout

from .incremental import append_available


def capped_stream(events: DataFrame, by: str, cap: int, order: Sequence[str]) -> DataFrame:
    """At most ``cap`` rows of each class over the whole stream, exactly so many if there are.

    Rows of earlier batches come first; inside a batch the first by ``order``, which should name
    a row. Each task hands on no more than ``cap`` rows per class, so a class that holds most of
    a batch is no burden where its counter is. A null class is a class. The counter is in the
    stream's state: a restart goes on where the last batch ended.
    """
    columns, order = events.columns, list(order)

    def take(key, parts, state) -> Iterator[pd.DataFrame]:
        before = state.get[0] if state.exists else 0
        left, best = cap - before, None
        for part in parts:
            if left > 0:
                best = part if best is None else pd.concat([best, part], ignore_index=True)
                best = best.sort_values(order, kind="stable").head(left)
        if best is not None and len(best):
            state.update((before + len(best),))
            yield best[columns]

    trimmed = events.mapInArrow(_first_rows(by, cap, order), events.schema)
    return trimmed.groupBy(by).applyInPandasWithState(
        take, events.schema, "taken long", "append", GroupStateTimeout.NoTimeout
    )


def append_capped(
    events: DataFrame, by: str, cap: int, order: Sequence[str], path: str, checkpoint: str
) -> StreamingQuery:
    """Write what is new and below the cap, and stop."""
    return append_available(capped_stream(events, by, cap, order), path, checkpoint)


def _first_rows(by: str, cap: int, order: list[str]):
    def first(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, names = None, None
        for batch in batches:
            names = batch.schema.names
            rows = pa.Table.from_batches([batch])
            held = rows if held is None else pa.concat_tables([held, rows])
            held = _trimmed(held, by, cap, order)
        if held is not None:
            yield from held.select(names).combine_chunks().to_batches()

    return first


def _trimmed(rows: pa.Table, by: str, cap: int, order: list[str]) -> pa.Table:
    """The first ``cap`` rows of each class; only keys are sorted."""
    keys = rows.select(list(dict.fromkeys([by, *order])))
    at = pc.sort_indices(keys, sort_keys=[(c, "ascending") for c in dict.fromkeys([by, *order])])
    classes = rows[by].combine_chunks().dictionary_encode(null_encoding="encode").indices.take(at)
    place = pd.Series(classes.to_numpy(zero_copy_only=False)).groupby(classes.to_numpy(zero_copy_only=False)).cumcount()
    return rows.take(at.filter(pa.array(place.to_numpy() < cap)))
