"""Top-k packing of jagged lists. Everything stays inside the row: no shuffle."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.layout import Section
from ..plans.spec import ObjectGroup


def object_count(name: str) -> Column:
    """Length of the list as stored, before any truncation."""
    return F.coalesce(F.size(F.col(name)), F.lit(0))


def order_key(name: str, dtype: str = "double") -> Column:
    """The list to rank by. A NaN becomes null, so that it ranks last."""
    values = F.coalesce(F.col(name).cast(f"array<{dtype}>"), F.array().cast(f"array<{dtype}>"))
    nan = F.lit(float("nan")).cast(dtype)
    return F.when(
        F.array_contains(values, nan), F.transform(values, lambda v: F.when(~F.isnan(v), v))
    ).otherwise(values)


def kth_value(key: Column, k: int) -> Column:
    """The k-th largest value; null if there are fewer."""
    return F.try_element_at(F.sort_array(key, asc=False), F.lit(k))


def leading_place(key: Column) -> Column:
    """Zero-based place of the first largest value; negative if there is no object."""
    unranked = F.when(F.size(key) > 0, F.lit(0)).otherwise(F.lit(-1))
    return F.coalesce(F.array_position(key, F.array_max(key)).cast("int") - 1, unranked)


def topk_places(key: Column, least: Column, k: int) -> Column:
    """Places of the k largest values in falling order, earlier ones first among equals.

    ``least`` is the k-th value. Sorting plain numbers to find it is cheap; only the
    few objects at or above it are then put in order as (value, place). Both
    arguments should be columns, since they are looked at for every element.
    """
    size = F.size(key)
    places = F.slice(F.sequence(F.lit(0), size), F.lit(1), size)
    near = F.when(
        least.isNotNull(), F.filter(places, lambda i: F.get(key, i) >= least)
    ).otherwise(places)
    ranked = F.transform(near, lambda i: F.struct(F.get(key, i).alias("key"), (-i).alias("tie")))
    return F.transform(F.slice(F.sort_array(ranked, asc=False), 1, k), lambda o: -o["tie"])


def checked_places(group: ObjectGroup, places: Column) -> Column:
    """The places, or an error if the lists of one event differ in length."""
    if len(group.columns) == 1:
        return places
    size = object_count(group.columns[0])
    same = reduce(lambda a, b: a & b, [object_count(c) == size for c in group.columns[1:]])
    return F.when(same, places).otherwise(
        F.raise_error(F.lit(f"lists of unequal length in group '{group.name}'"))
    )


def group_slots(
    group: ObjectGroup, places: Column | None, fill: float = 0.0, dtype: str = "double"
) -> list[Column]:
    """A group's part of the flat vector, object-major, missing values filled, count last."""

    def filled(value: Column) -> Column:
        return F.coalesce(value.cast(dtype), F.lit(fill).cast(dtype))

    if group.topk is None:
        return [filled(F.col(c)) for c in group.columns]
    at = [places] if group.topk == 1 else [F.get(places, F.lit(i)) for i in range(group.topk)]
    slots = [filled(F.get(F.col(c), i)) for i in at for c in group.columns]
    if group.count:
        n = F.coalesce(F.col(group.count_from), F.lit(0)) if group.count_from else object_count(
            group.columns[0]
        )
        slots.append(n.cast(dtype))
    return slots


def leading_slice(vector: Column, section: Section, n_columns: int | None = None) -> Column:
    """Columns of a group's first object inside a flat vector; the count is left out."""
    return F.slice(vector, section.start + 1, n_columns or len(section.columns))


def first_of_list(column: Column) -> Column:
    return F.try_element_at(column, F.lit(1))


def token_array(vector: Column, sections: Sequence[Section]) -> Column:
    """Cut a flat vector into tokens: one event token with all counts, then every object.

    Gives ``array<struct<group, object, values>>``; without any count the event
    token holds a single zero.
    """
    counts = [F.get(vector, F.lit(s.end - 1)) for s in sections if s.count]
    event = F.struct(
        F.lit("event").alias("group"),
        F.lit(0).alias("object"),
        (F.array(*counts) if counts else F.array(F.lit(0.0))).alias("values"),
    )
    return F.concat(F.array(event), *[_section_tokens(vector, s) for s in sections])


def _section_tokens(vector: Column, section: Section) -> Column:
    n = len(section.columns)
    return F.transform(
        F.sequence(F.lit(0), F.lit(section.slots - 1)),
        lambda i: F.struct(
            F.lit(section.group).alias("group"),
            i.alias("object"),
            F.slice(vector, F.lit(section.start + 1) + i * n, F.lit(n)).alias("values"),
        ),
    )
