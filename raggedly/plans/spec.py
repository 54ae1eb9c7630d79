"""What the user declares: object groups, classes and the treatment of feature families."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


@dataclass(frozen=True)
class ObjectGroup:
    """Columns that belong together.

    ``topk=None`` marks plain numeric columns. Otherwise the columns are lists of
    one shared length per event, and the ``topk`` objects with the largest value
    in the first column are kept. ``count`` adds the untruncated list length;
    ``count_from`` names a column that holds it when the lists were cut before.
    """

    name: str
    columns: tuple[str, ...]
    topk: int | None
    count: bool = False
    count_from: str | None = None

    def __post_init__(self):
        object.__setattr__(self, "columns", tuple(self.columns))
        if not self.columns:
            raise ValueError(f"group '{self.name}' lists no columns")
        if self.topk is not None and self.topk < 1:
            raise ValueError(f"group '{self.name}': topk must be at least 1")
        if self.topk is None and self.count:
            raise ValueError(f"group '{self.name}': a scalar group has no object count")

    @property
    def slots(self) -> int:
        return 1 if self.topk is None else self.topk

    @property
    def width(self) -> int:
        return len(self.columns) * self.slots + int(self.count)


@dataclass(frozen=True)
class EventSpec:
    groups: tuple[ObjectGroup, ...]

    def __post_init__(self):
        object.__setattr__(self, "groups", tuple(self.groups))
        names = [g.name for g in self.groups]
        if len(set(names)) != len(names):
            raise ValueError("group names must be unique")

    @classmethod
    def from_config(cls, config: Mapping[str, Mapping]) -> EventSpec:
        """Build from ``{group: {cols, topk, count}}``."""
        return cls(
            tuple(
                ObjectGroup(
                    name, tuple(c["cols"]), c["topk"], bool(c.get("count", False)),
                    c.get("count_from"),
                )
                for name, c in config.items()
            )
        )

    @property
    def columns(self) -> list[str]:
        return [c for g in self.groups for c in g.columns]

    @property
    def width(self) -> int:
        return sum(g.width for g in self.groups)

    def validate(self, schema: T.StructType) -> None:
        """Fail before any job starts if a column is missing or has the wrong shape."""
        types = {f.name: f.dataType for f in schema.fields}
        extra = [g.count_from for g in self.groups if g.count_from]
        missing = [c for c in [*self.columns, *extra] if c not in types]
        if missing:
            raise ValueError(f"columns not in the input: {missing}")
        for group in self.groups:
            for column in group.columns:
                kind = types[column]
                if group.topk is None:
                    ok = isinstance(kind, T.NumericType)
                else:
                    ok = isinstance(kind, T.ArrayType) and isinstance(
                        kind.elementType, T.NumericType
                    )
                if not ok:
                    raise ValueError(
                        f"group '{group.name}': column '{column}' is {kind.simpleString()}"
                    )


@dataclass(frozen=True)
class ClassList:
    """Ordered class names; a label is a position in this list."""

    names: tuple[str, ...]
    folders: Mapping[str, str] = field(default_factory=dict)

    def __post_init__(self):
        object.__setattr__(self, "names", tuple(self.names))
        if len(set(self.names)) != len(self.names):
            raise ValueError("class names must be unique")
        unknown = [n for n in self.names if self.folders and n not in self.folders]
        if unknown:
            raise ValueError(f"classes without a folder: {unknown}")

    def folder(self, name: str) -> str:
        return self.folders.get(name, name)

    @property
    def class_folders(self) -> list[str]:
        return [self.folder(n) for n in self.names]

    def dimension(self, spark: SparkSession) -> DataFrame:
        """(class_name, class_folder, label); as long as the declared list, never the data."""
        rows = [(n, self.folder(n), i) for i, n in enumerate(self.names)]
        return spark.createDataFrame(rows, "class_name string, class_folder string, label long")


# ---------------------------------------------------------------------------
# Default treatment of each feature family.
DEFAULT_TRANSFORMS = {
    "pt": "log1p",
    "eta": "identity",
    "phi": "trig",
    "mass": "log1p",
    "pid": "onehot",
    "charge": "onehot",
    "btag": "onehot",
    "puppibtag": "identity",
    "puppiw": "identity",
    "met": "log1p",
    "vertexpt2": "identity",
    "vertexcoord": "identity",
    "EhadOverEem": "identity",
    "isolation": "identity",
    "count": "identity",
    "displacement": "identity",
    "ncharged": "identity",
    "nneutrals": "identity",
    "other": "identity",
}
DEFAULT_NORMALIZERS = {
    "pt": "robust",
    "eta": "robust",
    "phi": "none",
    "mass": "robust",
    "pid": "none",
    "charge": "none",
    "btag": "none",
    "puppibtag": "minmax",
    "puppiw": "robust",
    "met": "robust",
    "vertexpt2": "robust",
    "vertexcoord": "robust",
    "EhadOverEem": "robust",
    "isolation": "robust",
    "count": "minmax",
    "displacement": "robust",
    "ncharged": "robust",
    "nneutrals": "robust",
    "other": "robust",
}
# Category values per one-hot family.
CATEGORIES = {
    "pid": (
        -3334, -3312, -3222, -3112, -2212, -321, -211, -13, -11, 0,
        11, 13, 22, 211, 321, 2212, 3112, 3222, 3312, 3334, 5222,
    ),
    "btag": (0, 1),
    "charge": (-1, 0, 1),
}
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Treatment:
    """Family -> transform and family -> normalizer; what is not listed stays as it is."""

    transforms: Mapping[str, str] = field(default_factory=lambda: dict(DEFAULT_TRANSFORMS))
    normalizers: Mapping[str, str] = field(default_factory=lambda: dict(DEFAULT_NORMALIZERS))
    categories: Mapping[str, Sequence[int]] = field(default_factory=lambda: dict(CATEGORIES))

    def transform_of(self, family: str) -> str:
        return self.transforms.get(family, "identity")

    def normalizer_of(self, family: str) -> str:
        return self.normalizers.get(family, "none")
