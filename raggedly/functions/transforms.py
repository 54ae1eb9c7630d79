"""Per-feature transforms as Column builders. A zero means padding and stays zero."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.layout import Section
from .names import family_of
from ..plans.spec import Treatment

EPSILON = 1e-6  # fixed value, part of the signed log's definition


def nonzero(x: Column, then: Column) -> Column:
    return F.when(x != 0, then).otherwise(F.lit(0.0))


def identity(x: Column) -> Column:
    return x


def log1p_signed(x: Column) -> Column:
    return nonzero(x, F.signum(x) * F.log1p(F.abs(x) + EPSILON))


def trig_phi(x: Column) -> list[Column]:
    """Sine and cosine; padding gives (0, 0), not (0, 1)."""
    return [nonzero(x, F.sin(x)), nonzero(x, F.cos(x))]


def one_hot(x: Column, categories: Sequence[int], strict: bool = True) -> Column:
    """Indicator array over ``categories`` after truncation toward zero.

    The row of the indicator matrix is looked up, not computed per category.
    Strict mode fails on an unknown value; otherwise it gives all zeros.
    """
    size = len(categories)
    rows = F.lit([1.0 if i == j else 0.0 for i in range(size) for j in range(size)])
    value = x.cast("int") if strict else x.try_cast("int")
    place = F.array_position(F.lit([int(c) for c in categories]), value)
    unknown = (
        F.raise_error(F.concat(F.lit("value outside the categories: "), x.cast("string")))
        if strict
        else F.lit([0.0] * size)
    )
    return F.when(place > 0, F.slice(rows, (place - 1).cast("int") * size + 1, size)).otherwise(
        unknown
    )


class TransformRegistry:
    """Name -> builder from a Column to a Column, a list of Columns, or an array Column."""

    def __init__(self):
        self._builders: dict[str, tuple[Callable, bool]] = {}

    def register(self, name: str, builder: Callable, array: bool = False) -> None:
        self._builders[name] = (builder, array)

    @property
    def names(self) -> list[str]:
        return list(self._builders)

    def apply(
        self, name: str, x: Column, family: str, treatment: Treatment, strict: bool = True
    ) -> Column | list[Column]:
        """Single values as a list; an array Column for transforms registered as such."""
        if name not in self._builders:
            raise ValueError(f"unknown transform '{name}'; available: {self.names}")
        builder, array = self._builders[name]
        if name == "onehot":
            if family not in treatment.categories:
                raise ValueError(f"one-hot for family '{family}', which has no category list")
            return builder(x, treatment.categories[family], strict)
        out = builder(x)
        return out if array or isinstance(out, list) else [out]


TRANSFORMS = TransformRegistry()
TRANSFORMS.register("identity", identity)
TRANSFORMS.register("log1p", log1p_signed)
TRANSFORMS.register("trig", trig_phi)
TRANSFORMS.register("onehot", one_hot, array=True)


def expand_vector(
    vector: Column, sections: Sequence[Section], treatment: Treatment, strict: bool = True
) -> Column:
    """Apply every transform to a flat vector, in layout order; counts pass through.

    Every slot is a plain expression, so that the projection is compiled; only
    one-hot slots are arrays, taken from a constant.
    """
    pieces: list[Column] = []
    run: list[Column] = []
    for s in sections:
        n = len(s.columns)
        for place in range(n * s.slots):
            family = family_of(s.columns[place % n])
            out = TRANSFORMS.apply(
                treatment.transform_of(family), F.get(vector, F.lit(s.start + place)),
                family, treatment, strict,
            )
            if isinstance(out, list):
                run += out
            else:
                pieces += ([F.array(*run)] if run else []) + [out]
                run = []
        if s.count:
            run.append(F.get(vector, F.lit(s.end - 1)))
    if run:
        pieces.append(F.array(*run))
    return pieces[0] if len(pieces) == 1 else F.flatten(F.array(*pieces))


def unknown_categories(x: Column, categories: Sequence[int]) -> Column:
    """True where the truncated value is in no category."""
    return ~x.cast("int").isin([int(c) for c in categories])
