"""Positions inside the flat vector, before and after the transforms."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..functions.names import family_of
from .spec import EventSpec, Treatment

LAYOUT_SCHEMA = (
    "position int, group string, start int, end int, columns array<string>, topk int, count boolean"
)


@dataclass(frozen=True)
class Section:
    """One group's half-open range ``[start, end)`` of the vector."""

    group: str
    start: int
    end: int
    columns: tuple[str, ...]
    topk: int | None
    count: bool

    @property
    def slots(self) -> int:
        return 1 if self.topk is None else self.topk


@dataclass(frozen=True)
class Slot:
    """One position of the expanded vector; ``object`` is None for a count."""

    position: int
    group: str
    object: int | None
    column: str
    family: str

    @property
    def block(self) -> str:
        return f"{self.group}.{self.family}"


def _stack(parts) -> list[Section]:
    sections, offset = [], 0
    for group, columns, topk, count in parts:
        size = len(columns) * (1 if topk is None else topk) + int(count)
        sections.append(Section(group, offset, offset + size, tuple(columns), topk, count))
        offset += size
    return sections


def raw_layout(spec: EventSpec) -> list[Section]:
    return _stack((g.name, g.columns, g.topk, g.count) for g in spec.groups)


def expanded_names(column: str, treatment: Treatment) -> list[str]:
    family = family_of(column)
    # The endings of the names.
    kind = treatment.transform_of(family)
    if kind == "trig":
        return [f"{column}_sin", f"{column}_cos"]
    if kind == "onehot":
        return [f"{column}_is_{value}" for value in treatment.categories[family]]
    return [column]


def expanded_layout(sections: Sequence[Section], treatment: Treatment) -> list[Section]:
    return _stack(
        (s.group, [n for c in s.columns for n in expanded_names(c, treatment)], s.topk, s.count)
        for s in sections
    )


def expanded_slots(sections: Sequence[Section], treatment: Treatment) -> list[Slot]:
    """Every position of the expanded vector with the block whose statistics it uses."""
    slots: list[Slot] = []
    for s in sections:
        named = [(n, family_of(c)) for c in s.columns for n in expanded_names(c, treatment)]
        for obj in range(s.slots):
            slots += [Slot(len(slots) + i, s.group, obj, n, f) for i, (n, f) in enumerate(named)]
        if s.count:
            slots.append(Slot(len(slots), s.group, None, f"{s.group}_count", "count"))
    return slots


def width(sections: Sequence[Section]) -> int:
    return sections[-1].end if sections else 0


def check_width(actual: int, sections: Sequence[Section]) -> None:
    if actual != width(sections):
        raise ValueError(f"vector has {actual} features, the layout has {width(sections)}")


# Fixed values in the next two: the keys of the stored forms.
def summary(sections: Sequence[Section]) -> dict[str, dict[str, int]]:
    return {
        s.group: {"start": s.start, "end": s.end, "num_columns": len(s.columns)} for s in sections
    }


def as_feature_map(sections: Sequence[Section]) -> dict[str, dict]:
    """The nested form users keep next to their data: group -> five fields."""
    return {
        s.group: {
            "start": s.start, "end": s.end, "columns": list(s.columns),
            "topk": s.topk, "count": s.count,
        }
        for s in sections
    }


def from_feature_map(fmap: Mapping[str, Mapping]) -> list[Section]:
    return [
        Section(
            g, int(m["start"]), int(m["end"]), tuple(m["columns"]),
            m.get("topk"), bool(m.get("count", False)),
        )
        for g, m in fmap.items()
    ]


def to_dataframe(spark: SparkSession, sections: Sequence[Section]) -> DataFrame:
    rows = [
        (i, s.group, s.start, s.end, list(s.columns), s.topk, s.count)
        for i, s in enumerate(sections)
    ]
    return spark.createDataFrame(rows, LAYOUT_SCHEMA)


def write_layout(spark: SparkSession, sections: Sequence[Section], path: str) -> None:
    to_dataframe(spark, sections).coalesce(1).write.mode("overwrite").json(path)


def read_layout(spark: SparkSession, path: str) -> list[Section]:
    """Layouts have one row per declared group, so they are read to the driver."""
    rows = spark.read.schema(LAYOUT_SCHEMA).json(path).orderBy("position").collect()
    return [
        Section(r["group"], r["start"], r["end"], tuple(r["columns"]), r["topk"], r["count"])
        for r in rows
    ]
