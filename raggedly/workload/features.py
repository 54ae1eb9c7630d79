"""Queries on transforms, fits and normalization."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import normalizers as N
from ..functions.packing import first_of_list
from ..functions.transforms import log1p_signed, one_hot, trig_phi, unknown_categories
from ..operators.catalog import file_table
from ..operators.prefix import bounded, order_statistics
from ..operators.fitstate import FitState
from ..operators.preprocess import Preprocessor, fit_sample, standardize_positions, unmasked_moments
from ..operators.profile import distinct_values, histogram, long_features
from ..operators.splits import greedy_split
from ..operators.vectorize import vectorize
from ..plans.layout import expanded_slots, raw_layout
from ..plans.spec import Treatment
from ..session import fresh_folder, stored
from .files import SEED, SPLIT, TARGETS
from .registry import query
from .tables import CLASSES, ORDER_SPEC, charge, item_features, order_events, table, wide, word_events
from .vectors import LINES, RAW_SLOTS, WORDS, slot_list

DIGITS = 6
ID = "l_orderkey, l_linenumber, l_partkey"
PHI = "(l_discount * 20 - 1)"


def lines(spark, sf_dir, *columns):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", *columns)


@query(
    "log1p_signed",
    f"""SELECT {ID}, round(CASE WHEN {PHI} <> 0 THEN sign({PHI}) * ln(1 + abs({PHI}) + 1e-6) ELSE 0 END, 6)
        AS y FROM lineitem""",
)
def log1p_query(spark, sf_dir):
    x = F.col("l_discount") * 20 - 1
    return lines(spark, sf_dir, F.round(log1p_signed(x), DIGITS).alias("y"))


@query(
    "trig_phi",
    f"""SELECT {ID}, round(CASE WHEN {PHI} <> 0 THEN sin({PHI}) ELSE 0 END, 6) AS y_sin,
        round(CASE WHEN {PHI} <> 0 THEN cos({PHI}) ELSE 0 END, 6) AS y_cos FROM lineitem""",
)
def trig_query(spark, sf_dir):
    sin, cos = trig_phi(F.col("l_discount") * 20 - 1)
    return lines(
        spark, sf_dir, F.round(sin, DIGITS).alias("y_sin"), F.round(cos, DIGITS).alias("y_cos")
    )


CHARGE = "CASE l_returnflag WHEN 'A' THEN -1 WHEN 'N' THEN 0 ELSE 1 END"


@query(
    "one_hot",
    f"SELECT {ID}, "
    + ", ".join(f"(({CHARGE}) = {c})::INTEGER::DOUBLE AS is_{i}" for i, c in enumerate((-1, 0, 1)))
    + " FROM lineitem",
)
def one_hot_query(spark, sf_dir):
    hot = one_hot(charge(), Treatment().categories["charge"])
    return lines(spark, sf_dir, hot.alias("h")).select(
        "l_orderkey", "l_linenumber", "l_partkey",
        *[F.get("h", F.lit(i)).alias(f"is_{i}") for i in range(3)],
    )


@query(
    "unknown_categories",
    """SELECT trunc(l_quantity / 4)::INTEGER AS value, count(*) AS n FROM lineitem
       WHERE trunc(l_quantity / 4) NOT IN (-1, 0, 1) GROUP BY 1""",
)
def unknown_query(spark, sf_dir):
    x = F.col("l_quantity") / 4
    rows = table(spark, sf_dir, "lineitem").where(
        unknown_categories(x, Treatment().categories["charge"])
    )
    return rows.groupBy(x.cast("int").alias("value")).agg(F.count("*").alias("n"))


FEATURES = """
feats AS (
  SELECT 'Sim_Item_PT' AS feature, l_extendedprice AS value FROM lineitem
  UNION ALL SELECT 'Sim_Item_Eta', l_quantity - 25 FROM lineitem
  UNION ALL SELECT 'Sim_Item_Phi', l_discount * 20 - 1 FROM lineitem
  UNION ALL SELECT 'Sim_Item_Mass', l_tax FROM lineitem)
"""
STANDARD = """standard AS (SELECT feature, avg(value) AS mean, stddev_samp(value) + 1e-6 AS std
    FROM feats WHERE value <> 0 GROUP BY 1)"""
ROBUST = """robust AS (SELECT feature, quantile_disc(value, 0.5) AS median,
    greatest(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 1e-6) AS iqr
    FROM feats WHERE value <> 0 GROUP BY 1)"""
MINMAX = "minmax AS (SELECT feature, min(value) AS low, max(value) AS high FROM feats GROUP BY 1)"


def item_values(spark, sf_dir):
    features = {k: v for k, v in item_features().items() if k != "Sim_Item_Charge"}
    return long_features(table(spark, sf_dir, "lineitem"), features)


def rounded(df, keep, columns):
    return df.select(*keep, *[F.round(c, DIGITS).alias(c) for c in columns])


def standard_stats(spark, sf_dir):
    v = F.col("value")
    return item_values(spark, sf_dir).groupBy("feature").agg(
        N.standard_mean(v).alias("mean"), N.standard_std(v).alias("std")
    )


def robust_stats(spark, sf_dir):
    q = order_statistics(
        item_values(spark, sf_dir).where("value <> 0"), ["feature"], "value",
        {"q25": 0.25, "q50": 0.5, "q75": 0.75}, lower=["q50"], groups=len(item_features()),
    )
    return q.select(
        "feature",
        N.robust_median(F.col("q50")).alias("median"),
        N.robust_iqr(F.col("q25"), F.col("q75")).alias("iqr"),
    )


def minmax_stats(spark, sf_dir):
    return item_values(spark, sf_dir).groupBy("feature").agg(
        F.min("value").alias("low"), F.max("value").alias("high")
    )


@query(
    "fit_standard",
    f"WITH {FEATURES}, {STANDARD} SELECT feature, round(mean, 6) AS mean, round(std, 6) AS std FROM standard",
)
def fit_standard(spark, sf_dir):
    return rounded(standard_stats(spark, sf_dir), ["feature"], ["mean", "std"])


@query(
    "fit_robust",
    f"WITH {FEATURES}, {ROBUST} SELECT feature, round(median, 6) AS median, round(iqr, 6) AS iqr FROM robust",
)
def fit_robust(spark, sf_dir):
    return rounded(robust_stats(spark, sf_dir), ["feature"], ["median", "iqr"])


@query("fit_minmax", f"WITH {FEATURES}, {MINMAX} SELECT * FROM minmax")
def fit_minmax(spark, sf_dir):
    return minmax_stats(spark, sf_dir)


def applied(spark, sf_dir, stats, formula):
    """Join statistics (one row per declared feature) to the long values and apply them."""
    values = item_values(spark, sf_dir)
    y = formula(F.col("value"))
    stats = bounded(stats, len(item_features()))
    return values.join(stats, "feature").select("feature", "value", F.round(y, DIGITS).alias("y"))


@query(
    "apply_standard",
    f"""WITH {FEATURES}, {STANDARD} SELECT feature, value,
        round(CASE WHEN value <> 0 THEN (value - mean) / std ELSE 0 END, 6) AS y
        FROM feats JOIN standard USING (feature)""",
)
def apply_standard(spark, sf_dir):
    return applied(
        spark, sf_dir, standard_stats(spark, sf_dir),
        lambda x: N.standard(x, F.col("mean"), F.col("std")),
    )


@query(
    "apply_robust",
    f"""WITH {FEATURES}, {ROBUST} SELECT feature, value,
        round(CASE WHEN value <> 0 THEN (value - median) / iqr ELSE 0 END, 6) AS y
        FROM feats JOIN robust USING (feature)""",
)
def apply_robust(spark, sf_dir):
    return applied(
        spark, sf_dir, robust_stats(spark, sf_dir),
        lambda x: N.robust(x, F.col("median"), F.col("iqr")),
    )


@query(
    "apply_minmax",
    f"""WITH {FEATURES}, {MINMAX} SELECT feature, value,
        round((value - low) / (high - low + 1e-6), 6) AS y
        FROM feats JOIN minmax USING (feature)""",
)
def apply_minmax(spark, sf_dir):
    return applied(
        spark, sf_dir, minmax_stats(spark, sf_dir),
        lambda x: N.minmax(x, F.col("low"), F.col("high")),
    )


@query(
    "mean_std_unmasked",
    """WITH v AS (SELECT unnest(embedding)::DOUBLE AS value, generate_subscripts(embedding, 1) - 1 AS p
                  FROM embeddings)
       SELECT p::INTEGER AS "position", round(avg(value), 6) AS mean,
              round(sqrt(coalesce(var_samp(value), 0) + 1e-6), 6) AS std FROM v GROUP BY 1""",
)
def mean_std_unmasked(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select(
        F.col("embedding").cast("array<double>").alias("x")
    )
    return rounded(unmasked_moments(vectors), ["position"], ["mean", "std"])


@query(
    "standardized_vectors",
    """WITH v AS (SELECT vec_id, unnest(embedding)::DOUBLE AS e, generate_subscripts(embedding, 1) - 1 AS p
                  FROM embeddings),
            m AS (SELECT p, avg(e) AS mean, sqrt(coalesce(var_samp(e), 0) + 1e-6) AS std FROM v GROUP BY 1)
       SELECT vec_id, p::INTEGER AS "position", round((e - mean) / std, 6) AS value FROM v JOIN m USING (p)""",
)
def standardized_vectors(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("x")
    )
    out = standardize_positions(vectors, unmasked_moments(vectors), 64)
    return out.select("vec_id", F.posexplode_outer("x").alias("position", "value")).select(
        "vec_id", "position", F.round("value", DIGITS).alias("value")
    )


# The whole treatment of an order's vector, written out in SQL from the slot list.
SECTIONS = raw_layout(ORDER_SPEC)
TREATMENT = Treatment()
RAW = f"""{LINES}, raw AS (
  SELECT o_orderkey, any_value(o_orderpriority) AS class_folder, 'f' || (o_orderkey // 256) AS file,
         {slot_list(RAW_SLOTS)}
  FROM orders LEFT JOIN lines ON k = o_orderkey GROUP BY o_orderkey)
"""


def _log(x):
    return f"CASE WHEN {x} <> 0 THEN sign({x}) * ln(1 + abs({x}) + 1e-6) ELSE 0 END"


EXPANDED_SLOTS: list[str] = []
for _i in range(3):
    _pt, _eta, _phi, _mass, _charge = (f"x_{5 * _i + _j:02d}" for _j in range(5))
    EXPANDED_SLOTS += [
        _log(_pt), _eta,
        f"CASE WHEN {_phi} <> 0 THEN sin({_phi}) ELSE 0 END",
        f"CASE WHEN {_phi} <> 0 THEN cos({_phi}) ELSE 0 END",
        _log(_mass),
        *[f"(trunc({_charge})::INTEGER = {c})::INTEGER::DOUBLE" for c in (-1, 0, 1)],
    ]
EXPANDED_SLOTS += ["x_15", _log("x_16"), "x_17", _log("x_18"), "x_19"]
EXPANDED = f"""{RAW}, expanded AS (
  SELECT o_orderkey, class_folder, file,
         {", ".join(f"{s} AS e_{i:02d}" for i, s in enumerate(EXPANDED_SLOTS))} FROM raw)
"""
# block -> (normalizer, positions in the expanded vector)
BLOCKS = {
    "items.pt": ("robust", (0, 8, 16)),
    "items.eta": ("robust", (1, 9, 17)),
    "items.mass": ("robust", (4, 12, 20)),
    "items.count": ("minmax", (24,)),
    "lead.pt": ("robust", (25,)),
    "lead.eta": ("robust", (26,)),
    "totals.met": ("robust", (27,)),
    "totals.vertexcoord": ("robust", (28,)),
}


def stats_sql(source: str) -> str:
    values = " UNION ALL ".join(
        f"SELECT '{b}' AS block, e_{p:02d} AS v FROM {source}"
        for b, (_, places) in BLOCKS.items() for p in places
    )
    kinds = ", ".join(f"('{b}', '{k}')" for b, (k, _) in BLOCKS.items())
    return f"""pool AS ({values}), kinds AS (SELECT * FROM (VALUES {kinds}) t(block, kind)),
    stats AS (
      SELECT block, kind,
             CASE WHEN kind = 'robust' THEN coalesce(quantile_disc(v, 0.5) FILTER (WHERE v <> 0), 0) END AS median,
             CASE WHEN kind = 'robust' THEN coalesce(greatest(
               quantile_cont(v, 0.75) FILTER (WHERE v <> 0) - quantile_cont(v, 0.25) FILTER (WHERE v <> 0),
               1e-6), 1) END AS iqr,
             CASE WHEN kind = 'minmax' THEN min(v) END AS min,
             CASE WHEN kind = 'minmax' THEN max(v) END AS max
      FROM pool JOIN kinds USING (block) GROUP BY block, kind)"""


STATS_OUT = """SELECT block, kind, round(median, 6) AS median, round(iqr, 6) AS iqr,
    round(min, 6) AS min, round(max, 6) AS max FROM stats"""


def order_vectors(spark, sf_dir):
    return vectorize(
        order_events(spark, sf_dir), ORDER_SPEC, ["o_orderkey", "class_folder", "file"]
    )


def stored_vectors(spark, sf_dir):
    """Vectors as a table: a fit looks at them several times."""
    return stored(order_vectors(spark, sf_dir), "vectors")


def _stats_rows(stats):
    fitted = stats.where(F.col("kind") != "none")
    return rounded(fitted, ["block", "kind"], ["median", "iqr", "min", "max"])


@query(
    "expanded_vector",
    f"WITH {EXPANDED} SELECT o_orderkey, "
    + ", ".join(f"round(e_{i:02d}, 6) AS x_{i:02d}" for i in range(len(EXPANDED_SLOTS)))
    + " FROM expanded",
)
def expanded_vector(spark, sf_dir):
    plan = Preprocessor(SECTIONS, TREATMENT)
    return wide(plan.expand(order_vectors(spark, sf_dir)), len(plan.slots), ["o_orderkey"], DIGITS)


@query("block_stats", f"WITH {EXPANDED}, {stats_sql('expanded')} {STATS_OUT}")
def block_stats(spark, sf_dir):
    return _stats_rows(Preprocessor(SECTIONS, TREATMENT).fit_stats(stored_vectors(spark, sf_dir)))


@query("merged_block_stats", f"WITH {EXPANDED}, {stats_sql('expanded')} {STATS_OUT}")
def merged_block_stats(spark, sf_dir):
    """The fit of two halves of the files, one stored and extended by the other, made exact."""
    plan, vectors = Preprocessor(SECTIONS, TREATMENT), stored_vectors(spark, sf_dir)
    half = F.pmod(F.xxhash64("class_folder", "file"), F.lit(2)) == 0
    path = fresh_folder(spark, "fit-state")
    FitState.of(plan, vectors.where(half)).save(path)
    state = FitState.load(spark, plan, path).merged(FitState.of(plan, vectors.where(~half)))
    return _stats_rows(state.stats(exact_from=vectors))


@query(
    "sample_block_stats",
    f"""WITH {SPLIT}, {EXPANDED}, sample_files AS (
          SELECT class_folder, file FROM (
            SELECT *, row_number() OVER (PARTITION BY class_folder ORDER BY file) AS r
            FROM manifest WHERE split = 'train') WHERE r <= 5),
        picked AS (SELECT e.* FROM expanded e JOIN sample_files USING (class_folder, file)),
        {stats_sql('picked')} {STATS_OUT}""",
)
def sample_block_stats(spark, sf_dir):
    """Statistics from the first files of each class's train split, as a fit does it."""
    vectors = stored_vectors(spark, sf_dir)
    files = stored(file_table(vectors), "files")
    manifest = stored(greedy_split(files, TARGETS, SEED, len(CLASSES.names)), "manifest")
    placed = vectors.join(manifest.select("class_folder", "file", "split"), ["class_folder", "file"])
    picked = stored(fit_sample(placed, CLASSES.class_folders, n_files=5), "sample")
    return _stats_rows(Preprocessor(SECTIONS, TREATMENT).fit_stats(picked))


def normalized_sql() -> str:
    parts = []
    place = {p: (b, k) for b, (k, ps) in BLOCKS.items() for p in ps}
    for i in range(len(EXPANDED_SLOTS)):
        e = f"e_{i:02d}"
        if i not in place:
            parts.append(f"round({e}, 6) AS x_{i:02d}")
            continue
        block, kind = place[i]
        s = block.replace(".", "_")
        if kind == "minmax":
            y = f"({e} - {s}.min) / ({s}.max - {s}.min + 1e-6)"
        else:
            y = f"CASE WHEN {e} <> 0 THEN ({e} - {s}.median) / {s}.iqr ELSE 0 END"
        parts.append(f"round({y}, 6) AS x_{i:02d}")
    joins = " ".join(
        f"JOIN (SELECT * FROM stats WHERE block = '{b}') {b.replace('.', '_')} ON true" for b in BLOCKS
    )
    return f"SELECT o_orderkey, {', '.join(parts)} FROM expanded {joins}"


@query("preprocessed_vector", f"WITH {EXPANDED}, {stats_sql('expanded')} {normalized_sql()}")
def preprocessed_vector(spark, sf_dir):
    """Pack, transform, fit and normalize: raw events to model input."""
    vectors = stored_vectors(spark, sf_dir)
    plan = Preprocessor(SECTIONS, TREATMENT)
    model = plan.fit(vectors)
    return wide(model.transform(vectors), len(plan.slots), ["o_orderkey"], DIGITS)


HIST_VALUES = """hv AS (
  SELECT 'price' AS feature, l_extendedprice AS value, l_returnflag AS flag FROM lineitem
  UNION ALL SELECT 'tax', l_tax, l_returnflag FROM lineitem
  UNION ALL SELECT 'constant', 1.0::DOUBLE, l_returnflag FROM lineitem)"""


@query(
    "histogram",
    f"""WITH {HIST_VALUES}, mm AS (
          SELECT feature, flag, min(value) AS a, max(value) AS b FROM hv GROUP BY ALL),
        r AS (SELECT feature, flag, CASE WHEN a = b THEN a - 0.5 ELSE a END AS lo,
                     CASE WHEN a = b THEN b + 0.5 ELSE b END AS hi FROM mm)
        SELECT flag, feature, least(floor((value - lo) / (hi - lo) * 50), 49)::INTEGER AS bin,
               round(lo + least(floor((value - lo) / (hi - lo) * 50), 49)::INTEGER * ((hi - lo) / 50), 6) AS left_edge,
               count(*) AS n
        FROM hv JOIN r USING (feature, flag) GROUP BY ALL""",
)
def histogram_query(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").withColumn("flag", F.col("l_returnflag"))
    values = long_features(
        items, {"price": F.col("l_extendedprice"), "tax": F.col("l_tax"), "constant": F.lit(1.0)},
        by=["flag"],
    )
    out = histogram(values, 50, ("flag", "feature"))
    return out.withColumn("left_edge", F.round("left_edge", DIGITS))


@query(
    "leading_histogram",
    f"""WITH {WORDS}, hv AS (SELECT 'length' AS feature, pt AS value FROM words WHERE i = 1
          UNION ALL SELECT 'place', d0 FROM words WHERE i = 1),
        r AS (SELECT feature, min(value) AS lo, max(value) AS hi FROM hv GROUP BY 1)
        SELECT feature, least(floor((value - lo) / (hi - lo) * 100), 99)::INTEGER AS bin,
               round(lo + least(floor((value - lo) / (hi - lo) * 100), 99)::INTEGER * ((hi - lo) / 100), 6) AS left_edge,
               count(*) AS n
        FROM hv JOIN r USING (feature) GROUP BY ALL""",
)
def leading_histogram(spark, sf_dir):
    """Histogram of the first object of each list."""
    events = word_events(table(spark, sf_dir, "documents"))
    values = long_features(
        events,
        {
            "length": first_of_list(F.col("Doc_Word_PT")),
            "place": first_of_list(F.col("Doc_Word_D0")),
        },
    )
    out = histogram(values, 100, groups=2)
    return out.withColumn("left_edge", F.round("left_edge", DIGITS))


@query(
    "distinct_values",
    "SELECT DISTINCT unnest(string_split(text, ' ')) AS word FROM documents",
)
def distinct_query(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select(F.split("text", " ").alias("word"))
    return distinct_values(words, "word")


@query(
    "distinct_union",
    """SELECT DISTINCT unnest(string_split(text, ' ')) AS word FROM documents
       UNION SELECT unnest(string_split(text, ' ')) FROM conversations""",
)
def distinct_union(spark, sf_dir):
    """Distinct values over several sources."""
    words, more = (
        table(spark, sf_dir, t).select(F.split("text", " ").alias("word"))
        for t in ("documents", "conversations")
    )
    return distinct_values(words.unionByName(more), "word")


@query(
    "slot_blocks",
    f"""WITH {RAW}, long AS ("""
    + " UNION ALL ".join(
        f"SELECT '{b}' AS block, x_{i:02d} AS v FROM raw"
        for i, b in enumerate(
            [f"items.{f}" for _ in range(3) for f in ("pt", "eta", "phi", "mass", "charge")]
            + ["items.count", "lead.pt", "lead.eta", "totals.met", "totals.vertexcoord"]
        )
    )
    + """) SELECT block, count(*) AS n_values, count(*) FILTER (WHERE v <> 0) AS n_nonzero
         FROM long GROUP BY 1""",
)
def slot_blocks(spark, sf_dir):
    """How many values each (group, family) block pools, and how many are not padding."""
    plain = Treatment(transforms={})
    blocks = [s.block for s in expanded_slots(SECTIONS, plain)]
    return (
        order_vectors(spark, sf_dir)
        .select(F.posexplode_outer("x").alias("position", "v"))
        .groupBy(F.get(F.lit(blocks), F.col("position")).alias("block"))
        .agg(F.count("*").alias("n_values"), F.count_if(F.col("v") != 0).alias("n_nonzero"))
    )
