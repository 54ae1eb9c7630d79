"""From jagged events to flat vectors and tokens."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.packing import (
    checked_places, group_slots, kth_value, leading_place, order_key, token_array, topk_places,
)
from ..plans.layout import Section
from ..plans.spec import EventSpec


def vectorize(
    events: DataFrame,
    spec: EventSpec,
    keep: Sequence[str] = (),
    fill: float = 0.0,
    strict_float32: bool = False,
) -> DataFrame:
    """One row per event: the kept columns and the flat vector ``x``. A narrow map.

    What is used more than once (ranking keys, places of the kept objects) gets a
    projection of its own; the slots are then plain, compiled expressions.
    """
    spec.validate(events.schema)
    dtype = "float" if strict_float32 else "double"
    jagged = [g for g in spec.groups if g.topk is not None]
    firsts = {g.columns[0]: f"_key_{g.name}" for g in reversed(jagged)}
    keyed = events.withColumns({key: order_key(c, dtype) for c, key in firsts.items()})
    bounded = keyed.withColumns(
        {
            f"_least_{g.name}": kth_value(F.col(firsts[g.columns[0]]), g.topk)
            for g in jagged
            if g.topk > 1
        }
    )
    placed = bounded.withColumns(
        {
            f"_places_{g.name}": checked_places(
                g,
                leading_place(F.col(firsts[g.columns[0]]))
                if g.topk == 1
                else topk_places(
                    F.col(firsts[g.columns[0]]), F.col(f"_least_{g.name}"), g.topk
                ),
            )
            for g in jagged
        }
    )
    slots = [
        slot
        for g in spec.groups
        for slot in group_slots(g, F.col(f"_places_{g.name}") if g in jagged else None, fill, dtype)
    ]
    return placed.select(*keep, F.array(*slots).alias("x"))


def tokens(vectors: DataFrame, sections: Sequence[Section], keep: Sequence[str]) -> DataFrame:
    """One row per token: position, group, object number and values."""
    return vectors.select(
        *keep, F.posexplode_outer(token_array(F.col("x"), sections)).alias("token", "t")
    ).select(*keep, "token", "t.group", "t.object", "t.values")


def nest_objects(
    facts: DataFrame,
    key: str,
    columns: dict[str, Column],
    k: int,
    tie_break: Sequence[str] = (),
) -> DataFrame:
    """Jagged events from a fact table with one row per object: the k best per key.

    Gives (key, one list per column in descending order of the first column,
    n_objects). Spark applies the rank limit before the shuffle as well, so a key
    that holds a large share of all rows sends at most k rows per task; only the
    kept k are ever collected into a list. The true count is a separate partial
    aggregate.
    """
    names = list(columns)
    work = facts.select(
        F.col(key), *[c.alias(n) for n, c in columns.items()],
        *[F.col(t).alias(f"_tie_{t}") for t in tie_break],
    )
    order = [F.col(names[0]).desc_nulls_last()] + [
        F.col(n) for n in [*names[1:], *[f"_tie_{t}" for t in tie_break]]
    ]
    best = (
        work.withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
        .where(F.col("_rank") <= k)
        .groupBy(key)
        .agg(F.sort_array(F.collect_list(F.struct("_rank", *names))).alias("_objects"))
        .select(key, *[F.col(f"_objects.{n}").alias(n) for n in names])
    )
    counts = facts.groupBy(F.col(key).alias("_counted")).agg(F.count("*").alias("n_objects"))
    # Both are partitioned by the key already; a broadcast would only collect them.
    return best.join(counts.hint("merge"), F.col(key) == F.col("_counted")).drop("_counted")


def label_vectors(events: DataFrame, spec: EventSpec, row_col: str = "row") -> DataFrame:
    """Vectors as the tables of this package hold them: file, row, x, y, split, class_folder."""
    names = ["file", row_col, "label", "split", "class_folder"]
    return vectorize(events, spec, names).select(
        "file",
        F.col(row_col).cast("long").alias("row"),
        F.col("x").cast("array<double>").alias("x"),
        F.col("label").cast("long").alias("y"),
        "split",
        "class_folder",
    )
