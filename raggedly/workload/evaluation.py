"""Queries on predictions and training runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scoring import argmax, cross_entropy, softmax
from ..operators import grid as G
from ..operators import metrics as M
from ..operators import runs as R
from ..session import fresh_folder
from ..sources.sinks import write_predictions
from .registry import query
from .tables import N_CLASSES, N_COMPONENTS, history, predictions, table

SUMS = ", ".join(
    " + ".join(f"embedding[{i + 1}]::DOUBLE" for i in range(c, N_COMPONENTS, N_CLASSES))
    for c in range(N_CLASSES)
)
LOGITS = f"""
z AS (SELECT vec_id, label, unnest(range({N_CLASSES})) AS class, unnest([{SUMS}]) AS z FROM embeddings),
p AS (SELECT *, exp(z - max(z) OVER w) / sum(exp(z - m)) OVER w AS prob
      FROM (SELECT *, max(z) OVER (PARTITION BY vec_id) AS m FROM z) WINDOW w AS (PARTITION BY vec_id)),
best AS (SELECT vec_id, any_value(label) AS label,
                min(class) FILTER (WHERE z = m) AS prediction,
                max(prob) AS top,
                any_value(m) + ln(sum(exp(z - m))) - max(z) FILTER (WHERE class = label) AS loss
         FROM (SELECT *, max(z) OVER (PARTITION BY vec_id) AS m FROM p) GROUP BY vec_id)
"""
CURVE = f"""{LOGITS},
counts AS (SELECT class, prob::FLOAT AS score, count(*) FILTER (WHERE label = class) AS pos,
                  count(*) FILTER (WHERE label <> class) AS neg FROM p GROUP BY ALL),
sums AS (SELECT class, sum(pos) AS n_pos, sum(neg) AS n_neg FROM counts GROUP BY 1),
curve AS (SELECT class, score, pos, neg, n_pos, n_neg,
                 sum(pos) OVER w AS tp, sum(neg) OVER w AS fp
          FROM counts JOIN sums USING (class) WINDOW w AS (PARTITION BY class ORDER BY score DESC)),
points AS (SELECT class, score AS threshold, fp / n_neg AS fpr, tp / n_pos AS tpr FROM curve
           UNION ALL SELECT class, 1::FLOAT, 0, 0 FROM sums),
auc AS (SELECT class, sum(pos * (n_neg - fp + neg / 2.0::DOUBLE)) / (any_value(n_pos)::DOUBLE * any_value(n_neg)) AS auroc
        FROM curve GROUP BY 1),
lo AS (SELECT class, arg_max(fpr, (fpr, tpr)) AS f, arg_max(tpr, (fpr, tpr)) AS t
       FROM points WHERE fpr <= 0.01::DOUBLE GROUP BY 1),
hi AS (SELECT class, arg_min(fpr, (fpr, tpr)) AS f, arg_min(tpr, (fpr, tpr)) AS t
       FROM points WHERE fpr > 0.01::DOUBLE GROUP BY 1),
at_fpr AS (SELECT class, lo.t + coalesce((hi.t - lo.t) / (hi.f - lo.f) * (0.01::DOUBLE - lo.f), 0) AS tpr
           FROM lo LEFT JOIN hi USING (class))
"""
F1 = """cells AS (SELECT label, prediction, count(*) AS n FROM best GROUP BY ALL),
    f1s AS (SELECT c AS class, 2.0::DOUBLE * coalesce(sum(n) FILTER (WHERE label = c AND prediction = c), 0)
            / (coalesce(sum(n) FILTER (WHERE label = c), 0) + coalesce(sum(n) FILTER (WHERE prediction = c), 0)) AS f1
     FROM (SELECT label AS c FROM cells UNION SELECT prediction FROM cells), cells
     WHERE label = c OR prediction = c GROUP BY c)"""
CLASS_NAMES = [f"class{i}" for i in range(N_CLASSES)]


def scored(spark, sf_dir):
    return M.scored(predictions(spark, sf_dir))


@query(
    "softmax_argmax",
    f"WITH {LOGITS} SELECT vec_id, prediction::INTEGER AS prediction, round(top, 6) AS top_probability FROM best",
)
def softmax_argmax(spark, sf_dir):
    return predictions(spark, sf_dir).select(
        "vec_id", argmax(F.col("logits")).alias("prediction"),
        F.round(F.array_max(softmax(F.col("logits"))), 6).alias("top_probability"),
    )


@query("cross_entropy", f"WITH {LOGITS} SELECT vec_id, round(loss, 6) AS loss FROM best")
def cross_entropy_query(spark, sf_dir):
    return predictions(spark, sf_dir).select(
        "vec_id", F.round(cross_entropy(F.col("logits"), F.col("label")), 6).alias("loss")
    )


@query("mean_loss", f"WITH {LOGITS} SELECT round(avg(loss), 6) AS loss, count(*) AS n FROM best")
def mean_loss(spark, sf_dir):
    return M.mean_loss(predictions(spark, sf_dir)).withColumn("loss", F.round("loss", 6))


@query(
    "accuracy",
    f"""WITH {LOGITS} SELECT round(avg((label = prediction)::INTEGER), 6) AS accuracy, count(*) AS n
        FROM best""",
)
def accuracy(spark, sf_dir):
    return M.accuracy(scored(spark, sf_dir)).withColumn("accuracy", F.round("accuracy", 6))


@query(
    "confusion",
    f"""WITH {LOGITS} SELECT label, prediction::INTEGER AS prediction, count(*) AS n FROM best GROUP BY ALL""",
)
def confusion(spark, sf_dir):
    return M.confusion(scored(spark, sf_dir))


@query("macro_f1", f"WITH {LOGITS}, {F1} SELECT round(avg(f1), 6) AS macro_f1 FROM f1s")
def macro_f1(spark, sf_dir):
    return M.macro_f1(scored(spark, sf_dir)).withColumn("macro_f1", F.round("macro_f1", 6))


@query(
    "auroc_per_class",
    f"""WITH {CURVE} SELECT class::INTEGER AS class, 'class' || class AS class_name, round(auroc, 6) AS auroc
        FROM auc""",
)
def auroc_per_class(spark, sf_dir):
    return M.named(M.auroc(scored(spark, sf_dir)), CLASS_NAMES).withColumn(
        "auroc", F.round("auroc", 6)
    )


@query("mean_auroc", f"WITH {CURVE} SELECT round(avg(auroc), 6) AS mean_auroc FROM auc")
def mean_auroc(spark, sf_dir):
    return M.mean_auroc(scored(spark, sf_dir)).withColumn("mean_auroc", F.round("mean_auroc", 6))


@query(
    "roc_curve",
    f"""WITH {CURVE} SELECT class::INTEGER AS class, round(threshold::DOUBLE, 5) AS threshold,
        round(fpr, 6) AS fpr, round(tpr, 6) AS tpr FROM points""",
)
def roc_curve(spark, sf_dir):
    curve = M.with_start(M.roc(scored(spark, sf_dir)))
    return curve.select(
        "class", F.round(F.col("threshold").cast("double"), 5).alias("threshold"),
        F.round("fpr", 6).alias("fpr"), F.round("tpr", 6).alias("tpr"),
    )


@query("tpr_at_fpr", f"WITH {CURVE} SELECT class::INTEGER AS class, round(tpr, 6) AS tpr FROM at_fpr")
def tpr_at_fpr(spark, sf_dir):
    return M.tpr_at_fpr(M.roc(scored(spark, sf_dir))).withColumn("tpr", F.round("tpr", 6))


@query(
    "macro_tpr_at_fpr", f"WITH {CURVE} SELECT round(avg(tpr), 6) AS macro_tpr FROM at_fpr"
)
def macro_tpr_at_fpr(spark, sf_dir):
    out = M.macro_tpr_at_fpr(M.roc(scored(spark, sf_dir)))
    return out.withColumn("macro_tpr", F.round("macro_tpr", 6))


BATCH = 100


def grid_sql(by: str = "") -> str:
    """Counts at every threshold of the grid, from scores as they are."""
    n = G.THRESHOLDS - 1
    return f"""{LOGITS},
      placed AS (SELECT {by} class, floor(prob::FLOAT::DOUBLE * {n})::INTEGER AS place, label = class AS hit FROM p),
      grid AS (
        SELECT {by} class, i, i / {n}::DOUBLE AS threshold,
               count(*) FILTER (WHERE hit AND place >= i) AS tp, count(*) FILTER (WHERE NOT hit AND place >= i) AS fp,
               count(*) FILTER (WHERE hit) AS n_pos, count(*) FILTER (WHERE NOT hit) AS n_neg
        FROM placed, range({n + 1}) r(i) GROUP BY ALL)"""


@query(
    "roc_grid",
    f"""WITH {grid_sql()} SELECT class::INTEGER AS class, round(threshold, 6) AS threshold, tp, fp,
        round(fp / nullif(n_neg, 0)::DOUBLE, 6) AS fpr, round(tp / nullif(n_pos, 0)::DOUBLE, 6) AS tpr FROM grid""",
)
def roc_grid(spark, sf_dir):
    """ROC points on a fixed grid, from counts of two halves of the rows that are added up."""
    rows = predictions(spark, sf_dir)
    half = F.col("vec_id") % 2 == 0
    parts = [G.grid_counts(M.scored(rows.where(h))) for h in (half, ~half)]
    curve = G.grid_roc(G.merged_counts(*parts))
    return curve.select("class", *[
        F.round(c, 6).alias(c) if c in ("threshold", "fpr", "tpr") else F.col(c) for c in curve.columns[1:]
    ])


@query(
    "auroc_grid",
    f"""WITH {grid_sql()}, steps AS (
          SELECT *, tp - coalesce(lead(tp) OVER w, 0) AS pos, fp - coalesce(lead(fp) OVER w, 0) AS neg FROM grid
          WINDOW w AS (PARTITION BY class ORDER BY i))
        SELECT class::INTEGER AS class,
          round(sum(pos * (n_neg - fp + neg / 2.0::DOUBLE)) / (any_value(n_pos)::DOUBLE * any_value(n_neg)), 6) AS auroc
        FROM steps GROUP BY class""",
)
def auroc_grid(spark, sf_dir):
    return G.grid_auroc(G.grid_counts(scored(spark, sf_dir))).withColumn("auroc", F.round("auroc", 6))


@query(
    "batch_tpr_at_fpr",
    f"""WITH {grid_sql("vec_id // " + str(BATCH) + " AS batch,").replace("SELECT vec_id // 100 AS batch, class, i", "SELECT batch, class, i")},
        points AS (SELECT batch, class, fp / n_neg::DOUBLE AS fpr, tp / n_pos::DOUBLE AS tpr FROM grid
                   WHERE n_pos > 0 AND n_neg > 0),
        ends AS (SELECT batch, class, max((fpr, tpr)) FILTER (WHERE fpr <= 0.01::DOUBLE) AS lo,
                        min((fpr, tpr)) FILTER (WHERE fpr > 0.01::DOUBLE) AS hi FROM points GROUP BY ALL),
        at_ends AS (SELECT batch, coalesce(lo[1], 0) AS lf, coalesce(lo[2], 0) AS lt, hi[1] AS hf, hi[2] AS ht FROM ends)
        SELECT batch, round(avg(lt + coalesce((ht - lt) / (hf - lf) * (0.01::DOUBLE - lf), 0)), 6) AS macro_tpr
        FROM at_ends GROUP BY batch""",
)
def batch_tpr_at_fpr(spark, sf_dir):
    """The metric of each batch by itself, as a training loop averages it."""
    rows = predictions(spark, sf_dir).where(F.col("logits").isNotNull())
    batch = F.floor(F.col("vec_id") / BATCH).alias("batch")
    out = rows.select(
        batch, F.col("label").cast("int").alias("label"), softmax(F.col("logits")).cast("array<float>").alias("probs")
    )
    return G.batch_tpr_at_fpr(out, "batch").withColumn("macro_tpr", F.round("macro_tpr", 6))


METRICS = """metrics AS (
  SELECT 'class_class' || class || '_auc' AS name, auroc AS value FROM auc
  UNION ALL SELECT 'loss', avg(loss) FROM best
  UNION ALL SELECT 'acc', avg((label = prediction)::INTEGER) FROM best
  UNION ALL SELECT 'f1', avg(f1) FROM f1s
  UNION ALL SELECT 'mean_auc', avg(auroc) FROM auc
  UNION ALL SELECT 'tpr_macro', avg(tpr) FROM at_fpr)"""


@query(
    "metric_summary",
    f"WITH {CURVE}, {F1}, {METRICS} SELECT name, round(value, 6) AS value FROM metrics",
)
def metric_summary(spark, sf_dir):
    out = M.Evaluator(predictions(spark, sf_dir), CLASS_NAMES).summary()
    return out.withColumn("value", F.round("value", 6))


@query(
    "single_metric",
    f"WITH {CURVE}, {F1}, {METRICS} SELECT name, round(value, 6) AS value FROM metrics WHERE name = 'mean_auc'",
)
def single_metric(spark, sf_dir):
    summary = M.Evaluator(predictions(spark, sf_dir), CLASS_NAMES).summary()
    value = M.metric(summary, "mean_auc")
    return spark.range(1).select(F.lit("mean_auc").alias("name"), F.round(F.lit(value), 6).alias("value"))


@query(
    "predictions_export",
    f"""WITH {LOGITS} SELECT label::BIGINT AS label, 'class' || label AS class_name,
        prediction::INTEGER AS prediction, count(*) AS n, round(sum(loss), 5) AS loss
        FROM best WHERE vec_id % 7 <> 0 GROUP BY ALL""",
)
def predictions_export(spark, sf_dir):
    """Export and read back predictions of which a seventh has no logits."""
    some = predictions(spark, sf_dir).withColumn(
        "logits", F.when(F.col("vec_id") % 7 != 0, F.col("logits"))
    )
    path = fresh_folder(spark, "predictions")
    write_predictions(some, path, CLASS_NAMES)
    back = spark.read.parquet(path).select(
        "label", F.get("class_names", F.col("label").cast("int")).alias("class_name"),
        argmax(F.col("logits")).alias("prediction"),
        cross_entropy(F.col("logits"), F.col("label")).alias("loss"),
    )
    return back.groupBy("label", "class_name", "prediction").agg(
        F.count("*").alias("n"), F.round(F.sum("loss"), 5).alias("loss")
    )


@query(
    "accuracy_with_gaps",
    f"""WITH {LOGITS} SELECT round(avg((label = prediction)::INTEGER), 6) AS accuracy, count(*) AS n
        FROM best WHERE vec_id % 7 <> 0""",
)
def accuracy_with_gaps(spark, sf_dir):
    """Rows without logits take no part."""
    some = predictions(spark, sf_dir).withColumn(
        "logits", F.when(F.col("vec_id") % 7 != 0, F.col("logits"))
    )
    return M.accuracy(M.scored(some)).withColumn("accuracy", F.round("accuracy", 6))


@query(
    "merged_metrics",
    """WITH a AS (SELECT event_type AS name, max(value) AS value FROM events
                  WHERE ts < TIMESTAMP '2024-01-15' GROUP BY 1),
            b AS (SELECT event_type AS name, max(value) AS value FROM events
                  WHERE ts >= TIMESTAMP '2024-01-15' AND event_type <> 'error' GROUP BY 1)
       SELECT name, coalesce(b.value, a.value) AS value FROM a FULL JOIN b USING (name)""",
)
def merged_metrics(spark, sf_dir):
    cut = F.lit("2024-01-15").cast("timestamp")
    runs = history(spark, sf_dir)

    def best(rows):
        return rows.groupBy(F.col("run_name").alias("name")).agg(F.max("val_acc").alias("value"))

    late = runs.where((F.col("ts") >= cut) & (F.col("run_name") != "error"))
    return R.merged_metrics(best(runs.where(F.col("ts") < cut)), best(late))


@query(
    "pivot_max",
    """SELECT user_id % 10 AS lr,
              max(value) FILTER (WHERE event_type = 'error') AS error,
              max(value) FILTER (WHERE event_type = 'click') AS click,
              max(value) FILTER (WHERE event_type = 'view') AS "view",
              max(value) FILTER (WHERE event_type = 'purchase') AS purchase,
              max(value) FILTER (WHERE event_type = 'signup') AS signup
       FROM events GROUP BY 1""",
)
def pivot_max(spark, sf_dir):
    runs = table(spark, sf_dir, "events").select(
        (F.col("user_id") % 10).alias("lr"), F.col("event_type").alias("wd"), "value"
    )
    return R.pivot_max(runs, "lr", "wd", "value", ["error", "click", "view", "purchase", "signup"])


@query(
    "group_best",
    """SELECT *, row_number() OVER (ORDER BY val_acc DESC, run_name) AS rank
       FROM (SELECT event_type AS run_name, max(value) AS val_acc FROM events GROUP BY 1)""",
)
def group_best(spark, sf_dir):
    return R.group_best(history(spark, sf_dir), "run_name", "val_acc")


def hours(ts):
    """Buckets that follow the time order without a look at the data."""
    return F.floor(F.unix_micros(ts.cast("timestamp")) / 3_600_000_000)


@query(
    "epoch_index",
    """SELECT event_type AS run_name, ts, event_id, value AS val_acc,
              row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS epoch FROM events""",
)
def epoch_index(spark, sf_dir):
    return R.epoch_index(history(spark, sf_dir), "run_name", ["ts", "event_id"], hours(F.col("ts")))


@query(
    "running_best",
    """SELECT event_type AS run_name, ts, event_id, value AS val_acc,
              max(value) OVER (PARTITION BY event_type ORDER BY ts, event_id
                               ROWS UNBOUNDED PRECEDING) AS best FROM events""",
)
def running_best(spark, sf_dir):
    runs = history(spark, sf_dir)
    return R.running_best(runs, "run_name", ["ts", "event_id"], "val_acc", hours(F.col("ts")))


@query(
    "last_epoch",
    """SELECT event_type AS run_name, arg_max(event_id, (ts, event_id)) AS event_id,
              arg_max(value, (ts, event_id)) AS val_acc FROM events GROUP BY 1""",
)
def last_epoch(spark, sf_dir):
    return R.last_epoch(
        history(spark, sf_dir), "run_name", F.struct("ts", "event_id"), ["event_id", "val_acc"]
    )


@query(
    "best_epoch",
    """SELECT event_type AS run_name, arg_min(event_id, (-value, ts, event_id)) AS event_id,
              max(value) AS val_acc FROM events GROUP BY 1""",
)
def best_epoch(spark, sf_dir):
    return R.best_epoch(
        history(spark, sf_dir), "run_name", "val_acc", F.struct("ts", "event_id"),
        ["event_id", "val_acc"],
    )


TRIALS = "SELECT user_id AS number, event_type AS layers, max(value) AS value FROM events GROUP BY ALL"


def trials(spark, sf_dir):
    return (
        table(spark, sf_dir, "events")
        .groupBy(F.col("user_id").alias("number"), F.col("event_type").alias("layers"))
        .agg(F.max("value").alias("value"))
    )


@query(
    "trials_by_value",
    f"SELECT *, row_number() OVER (ORDER BY value DESC, number, layers) AS rank FROM ({TRIALS})",
)
def trials_by_value(spark, sf_dir):
    return R.trials_by_value(trials(spark, sf_dir), ["number", "layers"])


@query(
    "best_trial",
    f"""SELECT arg_max(number, (value, number, layers)) AS number,
               arg_max(layers, (value, number, layers)) AS layers, max(value) AS value FROM ({TRIALS})""",
)
def best_trial(spark, sf_dir):
    return R.best_trial(trials(spark, sf_dir), ["number", "layers"])


@query(
    "labelled_runs",
    """SELECT event_type AS run_name, CASE event_type WHEN 'click' THEN 'Clicks' WHEN 'view' THEN 'Views' END
              AS label, count(*) AS n FROM events GROUP BY ALL""",
)
def labelled_runs(spark, sf_dir):
    runs = R.labelled(history(spark, sf_dir), {"click": "Clicks", "view": "Views"})
    return runs.groupBy("run_name", "label").agg(F.count("*").alias("n"))


@query(
    "run_filters",
    """SELECT event_id, event_type, CASE WHEN event_type IN ('click', 'view') THEN 'top' ELSE 'bottom' END
              AS part FROM events WHERE event_type LIKE '%i%'""",
)
def run_filters(spark, sf_dir):
    runs = R.name_like(table(spark, sf_dir, "events"), "%i%", "event_type")
    top = F.col("event_type").isin("click", "view")
    return (
        runs.where(top).select("event_id", "event_type", F.lit("top").alias("part"))
        .unionByName(
            runs.where(~top).select("event_id", "event_type", F.lit("bottom").alias("part"))
        )
    )


@query(
    "finished_runs",
    """SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'""",
)
def finished_runs(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_orderstatus", "status")
    return R.finished(orders, "F").select("o_orderkey", "o_custkey", "o_totalprice")
