"""Fit and apply the transforms and normalizers of a feature layout."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import normalizers as N
from ..functions.names import family_of
from ..functions.transforms import TRANSFORMS, expand_vector
from ..plans.layout import Section, check_width, expanded_layout, expanded_slots, width
from ..plans.spec import Treatment
from ..session import stored
from ..sources.events import first_files
from ..sources.sinks import missing_outputs, pending, read_vectors, write_vectors, written_files
from .prefix import bounded, order_statistics

STATS_SCHEMA = (
    "block string, kind string, mean double, std double, median double, iqr double, "
    "min double, max double, num_examples_fit long, num_features_expanded int"
)
FRACTIONS, LOWER = {"q25": 0.25, "q50": 0.5, "q75": 0.75}, ["q50"]
ZERO_TO_ZERO = ("identity", "log1p", "trig")
MODES = ("fit_only", "fit_and_apply", "apply_only")


def seen_by(look: Observation) -> dict | None:
    """What an observation has seen; None if Spark lost it, as it does where it finds out while
    it runs that a part of the plan gives no rows, and leaves that part out."""
    try:
        return look.get
    except Py4JJavaError:
        return None


class Preprocessor:
    """Estimator: learns one set of parameters per (group, feature family) block."""

    def __init__(
        self, sections: Sequence[Section], treatment: Treatment | None = None, strict: bool = True
    ):
        self.sections = list(sections)
        self.treatment = treatment or Treatment()
        self.strict = strict
        self.expanded = expanded_layout(self.sections, self.treatment)
        self.slots = expanded_slots(self.sections, self.treatment)
        check_width(len(self.slots), self.expanded)
        self.kinds = {
            s.block: N.check_normalizer(self.treatment.normalizer_of(s.family)) for s in self.slots
        }
        self.blocks = sorted(self.kinds)

    def checked(self, vectors: DataFrame) -> DataFrame:
        raw = width(self.sections)
        return vectors.withColumn(
            "x",
            F.when(F.size("x") == raw, F.col("x").cast("array<double>")).otherwise(
                F.raise_error(F.lit(f"vector width differs from the layout's {raw}"))
            ),
        )

    def expand(self, vectors: DataFrame) -> DataFrame:
        """Replace the raw vector ``x`` by the transformed, still unnormalized one."""
        return self.checked(vectors).withColumn(
            "x", expand_vector(F.col("x"), self.sections, self.treatment, self.strict)
        )

    def block_values(self, vectors: DataFrame, kinds: Sequence[str]) -> DataFrame:
        """(block number, value) of every slot whose block uses one of ``kinds``.

        Raw vectors are taken apart first and each value is transformed by its
        position's family, so that the plan does not grow with the layout.
        """
        number = {b: i for i, b in enumerate(self.blocks)}
        block_at, family_at, families = [], [], []
        for s in self.sections:
            places = [family_of(c) for _ in range(s.slots) for c in s.columns]
            for family in places + ["count"] * int(s.count):
                block = f"{s.group}.{family}"
                fitted = self.kinds[block] in kinds
                block_at.append(number[block] if fitted else -1)
                if family not in families:
                    families.append(family)
                family_at.append(families.index(family))
        used = sorted({f for f, b in zip(family_at, block_at) if b >= 0})
        outputs = {
            f: [F.col("value")]
            if families[f] == "count"
            else TRANSFORMS.apply(
                self.treatment.transform_of(families[f]), F.col("value"), families[f],
                self.treatment, self.strict,
            )
            for f in used
        }
        position = F.col("position")
        slots = self.checked(vectors).select(
            F.posexplode_outer("x").alias("position", "value")
        )
        masked = set(kinds) <= {"standard", "robust"}
        if masked and all(
            self.treatment.transform_of(families[f]) in ZERO_TO_ZERO for f in used
        ):
            # Padding plays no part in these fits, and it stays zero: drop it at once.
            slots = slots.where(F.col("value") != 0)
        rows = (
            slots
            .select(
                F.get(F.lit(block_at), position).alias("block"),
                F.get(F.lit(family_at), position).alias("family"),
                "value",
            )
            .where(F.col("block") >= 0)
        )
        single = all(isinstance(o, list) and len(o) == 1 for o in outputs.values())
        value = F.lit(None)
        for f, out in outputs.items():
            if single:
                out = out[0]
            elif isinstance(out, list):
                out = F.array(*out)
            value = F.when(F.col("family") == f, out).otherwise(value)
        return rows.select("block", (value if single else F.explode_outer(value)).alias("value"))

    def fit_stats(self, vectors: DataFrame) -> DataFrame:
        """One row per block. Both aggregations combine before they shuffle.

        NaN and null values take no part in any fit; ``fit`` counts them.
        """
        return self._fit_stats(vectors, lambda values, _: values)

    def _fit_stats(self, vectors: DataFrame, seen) -> DataFrame:
        """``seen(values, name)`` may look on while the values pass."""
        spark = vectors.sparkSession
        declared = spark.createDataFrame(
            [(i, b, self.kinds[b]) for i, b in enumerate(self.blocks)],
            "block int, name string, kind string",
        )
        used = set(self.kinds.values())
        stats = declared
        moments = [k for k in ("standard", "minmax") if k in used]
        if moments:
            v = F.col("value")
            stats = stats.join(
                seen(self.block_values(vectors, moments), "moments")
                .where(v.isNotNull() & ~F.isnan(v))
                .groupBy("block")
                .agg(
                    N.standard_mean(v).alias("mean"),
                    N.standard_std(v).alias("std"),
                    F.min(v).alias("min"),
                    F.max(v).alias("max"),
                    F.count("*").alias("n_values"),
                ),
                "block",
                "left",
            )
        else:
            stats = stats.selectExpr(
                "*", "cast(null as long) n_values",
                *[f"cast(null as double) {c}" for c in ("mean", "std", "min", "max")],
            )
        if "robust" in used:
            # The quantiles look at the values three times, at the vectors once.
            values = stored(
                seen(self.block_values(vectors, ["robust"]), "robust").where(F.col("value") != 0),
                "block-values",
            )
            stats = stats.join(
                order_statistics(
                    values, ["block"], "value", FRACTIONS, lower=LOWER, groups=len(self.blocks)
                ),
                "block",
                "left",
            )
        else:
            stats = stats.selectExpr("*", *[f"cast(null as double) {c}" for c in FRACTIONS])
        return self.stats_rows(stats)

    def stats_rows(self, stats: DataFrame) -> DataFrame:
        """The parameters that each block's kind needs, the others null."""

        def only(kind, column):
            return F.when(F.col("kind") == kind, column)

        return stats.select(
            F.col("name").alias("block"),
            "kind",
            # A block of nothing but padding has no row of its own.
            only("standard", F.coalesce("mean", F.lit(0.0))).alias("mean"),
            only(
                "standard", F.when(F.col("n_values").isNull(), 1.0).otherwise(F.col("std"))
            ).alias("std"),
            only("robust", N.robust_median(F.col("q50"))).alias("median"),
            only("robust", N.robust_iqr(F.col("q25"), F.col("q75"))).alias("iqr"),
            only("minmax", F.col("min")).alias("min"),
            only("minmax", F.col("max")).alias("max"),
        )

    def fit(self, vectors: DataFrame) -> PreprocessModel:
        """Fitted parameters; vectors and left-out values are counted by the jobs that fit."""
        looks = {}

        def seen(values: DataFrame, name: str) -> DataFrame:
            v = F.col("value")
            looks[name] = Observation()
            return values.observe(looks[name], F.count_if(v.isNull() | F.isnan(v)).alias("n"))

        fitted = set(self.kinds.values()) - {"none"}
        counted = Observation()
        rows = vectors.observe(counted, F.count(F.lit(1)).alias("n")) if fitted else vectors
        # One row per block of the layout, so this is as small as the declaration.
        stats = self._fit_stats(rows, seen).collect()
        n = seen_by(counted) if fitted else None
        n = vectors.count() if n is None else n["n"]
        if n == 0:
            raise ValueError("no rows to fit the normalization on")
        left_out = 0
        for name, look in looks.items():
            passed = seen_by(look)
            if passed is None:
                kinds = ["robust"] if name == "robust" else [k for k in fitted if k != "robust"]
                v = F.col("value")
                left_out += self.block_values(vectors, kinds).where(v.isNull() | F.isnan(v)).count()
            else:
                left_out += passed["n"]
        return PreprocessModel(self, {r["block"]: r.asDict() for r in stats}, n, left_out)

    def unknown_values(self) -> Column:
        """Values of ``x`` outside their family's categories, as ``family=value``, of one row."""
        found = []
        for s in self.sections:
            for place in range(len(s.columns) * s.slots):
                family = family_of(s.columns[place % len(s.columns)])
                if self.treatment.transform_of(family) == "onehot":
                    value = F.get("x", F.lit(s.start + place))
                    wrong = value.isNotNull() & ~F.coalesce(
                        value.try_cast("int").isin([int(c) for c in self.treatment.categories[family]]),
                        F.lit(False),
                    )
                    text = F.concat(F.lit(f"{family}="), value.cast("string"))
                    found.append(F.when(wrong, text))
        return F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")

    def load(self, spark: SparkSession, path: str) -> PreprocessModel:
        """Stored statistics; fails if they were fitted for another layout."""
        rows = spark.read.schema(STATS_SCHEMA).json(path).collect()
        if not rows:
            raise ValueError(f"no statistics at {path}")
        check_width(rows[0]["num_features_expanded"], self.expanded)
        return PreprocessModel(
            self, {r["block"]: r.asDict() for r in rows}, rows[0]["num_examples_fit"]
        )


@dataclass
class PreprocessModel:
    plan: Preprocessor
    stats: Mapping[str, Mapping]
    n_fit: int
    n_left_out: int = 0

    def params(self) -> list[N.Affine]:
        per_block = {
            b: N.affine(kind, self.stats.get(b, {})) for b, kind in self.plan.kinds.items()
        }
        return [per_block[s.block] for s in self.plan.slots]

    def transform(self, vectors: DataFrame) -> DataFrame:
        """Transforms and normalization of ``x``: a narrow map with literal parameters."""
        return self.plan.expand(vectors).withColumn("x", N.apply_affine(F.col("x"), self.params()))

    def transform_observed(self, vectors: DataFrame) -> tuple[DataFrame, Observation]:
        """``transform`` that does not end at the first unknown category, and what the job that
        writes its result sees in passing: ``n`` rows, ``n_nan`` of them with a NaN, and the sorted
        list of ``unknown`` categories (``family=value``), all of them."""
        look = Observation()
        x = F.col("x")
        seen = vectors.withColumn("_unknown", self.plan.unknown_values()).observe(
            look,
            F.count(F.lit(1)).alias("n"),
            F.count_if(F.exists(x, lambda v: F.isnan(v))).alias("n_nan"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_set("_unknown")))).alias("unknown"),
        )
        lenient = Preprocessor(self.plan.sections, self.plan.treatment, strict=False)
        model = PreprocessModel(lenient, self.stats, self.n_fit, self.n_left_out)
        return model.transform(seen.drop("_unknown")), look

    def as_dict(self) -> dict:
        """The nested form users keep next to their data."""
        # Its keys.
        return {
            "block_group_stats": {
                b: {p: self.stats[b][p] for p in N.PARAMETERS[self.plan.kinds[b]]}
                for b in self.plan.blocks
            },
            "_meta": {
                "normalization_mode_per_feature_group": dict(self.plan.treatment.normalizers),
                "num_examples_fit": self.n_fit,
                "num_features_expanded": width(self.plan.expanded),
            },
        }

    def save(self, spark: SparkSession, path: str) -> None:
        meta = {"num_examples_fit": self.n_fit, "num_features_expanded": width(self.plan.expanded)}
        names = [f.split()[0] for f in STATS_SCHEMA.split(", ")]
        rows = [
            tuple({**self.stats[b], "block": b, **meta}.get(n) for n in names)
            for b in self.plan.blocks
        ]
        spark.createDataFrame(rows, STATS_SCHEMA).coalesce(1).write.mode("overwrite").json(path)


def fit_sample(
    vectors: DataFrame, class_folders: Sequence[str], n_files: int | None = None
) -> DataFrame:
    """The train split; with ``n_files``, only the first so many files of each class by name."""
    train = vectors.where(
        (F.col("split") == "train") & F.col("class_folder").isin(list(class_folders))
    )
    if n_files is None:
        return train
    files = first_files(train.select("class_folder", "file").distinct(), n_files)
    # At most n_files rows per declared class.
    return train.join(
        bounded(files, n_files * len(class_folders)), ["class_folder", "file"], "left_semi"
    )


def apply_files(
    model: PreprocessModel, vectors: DataFrame, manifest: DataFrame, out_path: str
) -> None:
    """Preprocess the manifest's files that have no output yet, and append them."""
    spark = vectors.sparkSession
    todo = pending(
        manifest.select("class_folder", "split", "file"), written_files(spark, out_path)
    )
    # One row per file; counted, so that it is only broadcast when it is small enough.
    todo = bounded(todo, todo.count())
    rows = vectors.join(todo, ["class_folder", "split", "file"], "left_semi")
    write_vectors(model.transform(rows), out_path)


def run(
    spark: SparkSession,
    plan: Preprocessor,
    vector_path: str,
    out_path: str,
    stats_path: str,
    class_folders: Sequence[str],
    mode: str = "fit_and_apply",
    enabled: bool = True,
    n_files: int | None = None,
    splits: Sequence[str] = ("train", "val", "test"),
) -> PreprocessModel | None:
    """Fit, apply or both. Completion is judged by the outputs, not by the statistics file."""
    if not enabled:
        gaps = missing_outputs(spark, out_path, class_folders, splits).limit(1).collect()
        if gaps:
            raise FileNotFoundError(f"no preprocessed rows for {gaps[0].asDict()}")
        return None
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    vectors = read_vectors(spark, vector_path, class_folders=class_folders)
    if mode == "apply_only":
        model = plan.load(spark, stats_path)
    else:
        model = plan.fit(fit_sample(vectors, class_folders, n_files))
        model.save(spark, stats_path)
    if mode != "fit_only":
        files = vectors.select("class_folder", "split", "file").distinct()
        apply_files(model, vectors, files, out_path)
    return model


def unmasked_moments(vectors: DataFrame) -> DataFrame:
    """Mean and deviation of every vector position, zeros included."""
    return (
        vectors.select(F.posexplode_outer("x").alias("position", "value"))
        .groupBy("position")
        .agg(
            F.avg("value").alias("mean"),
            # A single row has no spread: its squared deviation is zero.
            F.sqrt(F.coalesce(F.var_samp("value"), F.lit(0.0)) + N.EPSILON).alias("std"),
        )
    )


def standardize_positions(vectors: DataFrame, moments: DataFrame, n_positions: int) -> DataFrame:
    """Plain ``(x - mean) / std`` per position, zeros included.

    ``moments`` has one row per vector position, so it is read to the driver. A vector of
    another width ends the job.
    """
    rows = {r["position"]: r for r in moments.collect()}
    wrong = F.raise_error(F.lit(f"vector width differs from {n_positions}"))
    missing = sorted(set(range(n_positions)) - set(rows))
    if missing and rows:
        raise ValueError(f"no moments for positions {missing[:5]}")
    if not rows:  # no vector, so nothing to standardize
        return vectors.withColumn("x", F.when(F.size("x") == n_positions, F.col("x")).otherwise(wrong))
    return vectors.withColumn(
        "x",
        F.when(F.size("x") != n_positions, wrong).otherwise(
            F.array(
            *[
                N.standardize(F.get("x", F.lit(i)), F.lit(rows[i]["mean"]), F.lit(rows[i]["std"]))
                for i in range(n_positions)
            ]
        )),
    )
