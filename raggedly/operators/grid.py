"""ROC curves on a fixed grid of thresholds: dense counts that add up, whatever the scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .metrics import tpr_at_fpr

THRESHOLDS = 200


def grid_counts(
    scored_rows: DataFrame, n: int = THRESHOLDS, by: Sequence[str] = ()
) -> DataFrame:
    """``by..., class, pos, neg``: for each class one array of ``n`` counts of positives and one of
    negatives, by the highest grid threshold ``i / (n - 1)`` that a score reaches.

    Partial sums have at most ``n`` rows per class and task, however many scores differ, and
    counts of parts add up to those of the whole. Rows without a score are left out.
    """
    rows = scored_rows.select(*by, "label", F.posexplode("probs").alias("class", "score")).where(
        F.col("score").isNotNull() & ~F.isnan("score")
    )
    place = F.floor(F.col("score").cast("double") * (n - 1))
    positive = (F.col("label") == F.col("class")).cast("long")
    cells = rows.groupBy(*by, "class", F.greatest(F.lit(0), F.least(F.lit(n - 1), place)).alias("_at")).agg(
        F.sum(positive).alias("_p"), F.sum(1 - positive).alias("_n")
    )
    # At most n cells of a class meet here.
    found = cells.groupBy(*by, "class").agg(
        F.map_from_entries(F.collect_list(F.struct("_at", "_p"))).alias("_pos"),
        F.map_from_entries(F.collect_list(F.struct("_at", "_n"))).alias("_neg"),
    )
    places = F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))

    def dense(cells: str):
        return F.transform(places, lambda i: F.coalesce(F.try_element_at(F.col(cells), i), F.lit(0).cast("long")))

    return found.select(*by, "class", dense("_pos").alias("pos"), dense("_neg").alias("neg"))


def merged_counts(counts: DataFrame, *others: DataFrame) -> DataFrame:
    """Counts of all parts: arrays are added place by place."""
    for other in others:
        counts = counts.unionByName(other)
    cells = counts.select("class", F.posexplode(F.arrays_zip("pos", "neg")).alias("_at", "c"))
    sums = cells.groupBy("class", "_at").agg(F.sum("c.pos").alias("pos"), F.sum("c.neg").alias("neg"))
    ordered = sums.groupBy("class").agg(F.sort_array(F.collect_list(F.struct("_at", "pos", "neg"))).alias("c"))
    return ordered.select("class", F.col("c.pos").alias("pos"), F.col("c.neg").alias("neg"))


def grid_roc(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``by..., class, threshold, tp, fp, fpr, tpr`` at each threshold of the grid: what scores at
    least that much. Rates of a class without negatives (positives) are null."""

    def upto(name: str):
        # Sums from each place on; arrays are as long as the grid.
        places = F.sequence(F.lit(1), F.size(name))
        return F.transform(
            places,
            lambda i: F.aggregate(
                F.slice(name, i, F.size(name)), F.lit(0).cast("long"), lambda a, x: a + x
            ),
        )

    curves = counts.select(
        *by, "class", F.size("pos").alias("_size"), upto("pos").alias("tp"), upto("neg").alias("fp")
    )
    points = curves.select(
        *by, "class", "_size", F.col("tp")[0].alias("_p"), F.col("fp")[0].alias("_n"),
        F.posexplode(F.arrays_zip("tp", "fp")).alias("_at", "c"),
    )
    return points.select(
        *by,
        "class",
        (F.col("_at") / (F.col("_size") - 1)).alias("threshold"),
        F.col("c.tp").alias("tp"),
        F.col("c.fp").alias("fp"),
        F.try_divide(F.col("c.fp").cast("double"), F.col("_n")).alias("fpr"),
        F.try_divide(F.col("c.tp").cast("double"), F.col("_p")).alias("tpr"),
    )


def grid_auroc(counts: DataFrame, empty: float | None = None) -> DataFrame:
    """``class, auroc`` by trapezes between the points of the grid: scores of one place are ties.

    A class without positives or without negatives gives ``empty``.
    """

    def total(name: str):
        return F.aggregate(F.col(name), F.lit(0).cast("long"), lambda a, x: a + x)

    def step(a, c):
        pairs = a["pairs"] + c["pos"] * (a["below"] + c["neg"] / F.lit(2.0))
        return F.struct(pairs.alias("pairs"), (a["below"] + c["neg"]).alias("below"))

    start = F.struct(F.lit(0.0).alias("pairs"), F.lit(0).cast("long").alias("below"))
    pairs = F.aggregate(F.arrays_zip("pos", "neg"), start, step)["pairs"]
    all_ = total("pos").cast("double") * total("neg").cast("double")
    return counts.select(
        "class", F.when(all_ > 0, pairs / all_).otherwise(F.lit(empty).cast("double")).alias("auroc")
    )


def batch_tpr_at_fpr(
    scored_rows: DataFrame, batch: str, target: float = 0.01, n: int = THRESHOLDS
) -> DataFrame:
    """``batch, macro_tpr``: the mean over classes of the TPR at a false-positive rate, for each
    batch by itself. Classes without positives or negatives in a batch play no part there."""
    curve = grid_roc(grid_counts(scored_rows, n, [batch]), [batch])
    curve = curve.where(F.col("fpr").isNotNull() & F.col("tpr").isNotNull())
    return tpr_at_fpr(curve, target, [batch, "class"]).groupBy(batch).agg(F.avg("tpr").alias("macro_tpr"))
