"""Queries on small artifacts, on damaged shards and on what a scan leaves out."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import plottable
from ..operators.catalog import build_catalog, class_stats, unknown_classes
from ..operators.preprocess import Preprocessor
from ..operators.profile import distinct_values
from ..plans.layout import expanded_names, raw_layout, read_layout, summary, write_layout
from ..plans.spec import Treatment
from ..session import fresh_folder, stored
from ..sources.events import check_files, first_files, listing, scan, scan_manifest, with_label
from ..sources.sinks import write_distinct
from .features import EXPANDED, EXPANDED_SLOTS, RAW, SECTIONS, order_vectors
from .files import FILES, SPLIT, manifest, order_files
from .jobs import SHARDS, class_shards
from .registry import query
from .tables import FILE_ROWS, ORDER_SPEC, table
from .vectors import NAMED, NAMES, feature_names

BAD_CLASS = "1-URGENT"


def write_bytes(spark, path, text):
    """A file of a few bytes, by the file system that Spark itself uses."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = place.getFileSystem(spark._jsc.hadoopConfiguration()).create(place)
    out.writeBytes(text)
    out.close()


def read_bytes(spark, path):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    source = place.getFileSystem(spark._jsc.hadoopConfiguration()).open(place)
    try:
        return bytearray(source.readAllBytes())
    finally:
        source.close()


def damaged_body(spark, rows, path):
    """A Parquet file with a good footer, whose pages are overwritten in the middle."""
    folder = fresh_folder(spark, "whole")
    rows.coalesce(1).write.parquet(folder)
    data = read_bytes(spark, listing(spark, folder).first()["path"])
    footer = int.from_bytes(data[-8:-4], "little") + 8
    pages = len(data) - footer
    data[pages // 4 : 3 * pages // 4] = b"\xa5" * (3 * pages // 4 - pages // 4)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = place.getFileSystem(spark._jsc.hadoopConfiguration()).create(place)
    out.write(data)
    out.close()


def damaged_shards(spark, sf_dir):
    """Order shards, and in one class a file without rows and three damaged ones.

    Of one the footer is missing, of one it is nonsense, and of one only pages are damaged:
    a copy of the first stand-in file.
    """
    base = class_shards(spark, sf_dir)
    folder = f"{base}/{SHARDS.folder(BAD_CLASS)}"
    first = stored(scan(spark, folder).where(F.col("o_orderkey") < FILE_ROWS), "first-rows")
    scan(spark, folder).where("false").coalesce(1).write.mode("append").parquet(folder)
    write_bytes(spark, f"{folder}/footer.parquet", "PAR1" + "x" * 400 + "PAR1")
    write_bytes(spark, f"{folder}/cut.parquet", "PAR1" + "x" * 40)
    damaged_body(spark, first, f"{folder}/body.parquet")
    return base


@query(
    "catalog_status",
    f"""SELECT o_orderpriority AS class_name, 'ok' AS status, count(*) AS n_rows, 0::BIGINT AS n_odd
        FROM orders GROUP BY 1 UNION ALL SELECT '{BAD_CLASS}', 'empty', 0, 1
        UNION ALL SELECT '{BAD_CLASS}', 'unreadable', 0, 2""",
)
def catalog_status(spark, sf_dir):
    """Good, empty and damaged shards; only odd files are counted, as Spark chooses how many it writes.

    The catalogue goes by footers, so a shard with damaged pages is not among the odd ones.
    """
    catalog = build_catalog(spark, damaged_shards(spark, sf_dir), SHARDS)
    catalog = catalog.where("file <> 'body.parquet'")
    return (
        with_label(catalog, SHARDS)
        .groupBy("class_name", "status")
        .agg(F.sum("n_rows").alias("n_rows"), F.count_if(F.col("status") != "ok").alias("n_odd"))
    )


@query(
    "manifest_scan_with_bad_shard",
    f"""SELECT o_orderpriority AS class_name, count(*) AS n_rows, sum(o_orderkey)::BIGINT AS keys,
        CASE WHEN o_orderpriority = '{BAD_CLASS}' THEN 3 ELSE 0 END::BIGINT AS n_bad
        FROM orders GROUP BY 1""",
)
def manifest_scan_with_bad_shard(spark, sf_dir):
    """A scan by manifest goes on without its damaged files and reports them."""
    base, report = damaged_shards(spark, sf_dir), fresh_folder(spark, "bad-shards")
    paths = [f"{base}/{f}" for f in SHARDS.class_folders]
    files = listing(spark, paths).withColumn("split", F.lit("train"))
    events = scan_manifest(spark, base, files, SHARDS, report=report)
    bad = spark.read.schema("class_folder string").json(report).groupBy("class_folder").count()
    bad = stored(with_label(bad, SHARDS).select(F.col("class_name").alias("_c"), "count"), "bad-counts")
    found = events.groupBy("class_name").agg(
        F.count("*").alias("n_rows"), F.sum("o_orderkey").alias("keys")
    )
    return found.join(bad, F.col("class_name") == F.col("_c"), "left").select(
        "class_name", "n_rows", "keys", F.coalesce("count", F.lit(0)).alias("n_bad")
    )


@query(
    "shard_check",
    f"""SELECT o_orderpriority AS class_name, count(*) AS n_rows, count(*) AS n_found, 'good' AS state
        FROM orders GROUP BY 1
        UNION ALL SELECT '{BAD_CLASS}', 0, 0, 'good'
        UNION ALL SELECT '{BAD_CLASS}', NULL, NULL, 'missing'
        UNION ALL SELECT '{BAD_CLASS}', 0, 0, 'unreadable'
        UNION ALL SELECT '{BAD_CLASS}', count(*), -1, 'damaged' FROM orders
          WHERE o_orderpriority = '{BAD_CLASS}' AND o_orderkey < {FILE_ROWS}""",
)
def shard_check(spark, sf_dir):
    """What is found in every shard: footers, then all columns decoded, damaged shards as a whole.

    How many rows come before the damage in a page is not for SQL to say, so it reads -1.
    """
    base = damaged_shards(spark, sf_dir)
    files = listing(spark, [f"{base}/{f}" for f in SHARDS.class_folders]).select("class_folder", "file")
    gone = spark.createDataFrame([(SHARDS.folder(BAD_CLASS), "gone.parquet")], files.schema)
    checked = stored(with_label(check_files(spark, base, files.unionByName(gone)), SHARDS), "checked")
    state = (
        F.when(F.col("error").isNull(), "good")
        .when(F.col("error") == "no such file", "missing")
        .when(F.col("n_rows") == 0, "unreadable")
        .otherwise("damaged")
    )
    # The empty shard is a row of its own, so are the odd ones; good shards are added up.
    kind = F.when((F.col("n_rows") > 0) & F.col("error").isNull(), "rows").otherwise(F.lit("none"))
    return (
        checked.withColumns({"state": state, "_kind": kind})
        .groupBy("class_name", "state", "_kind")
        .agg(F.sum("n_rows").alias("n_rows"), F.sum("n_found").alias("n_found"))
        .select("class_name", "n_rows", F.when(F.col("state") == "damaged", -1).otherwise(F.col("n_found")).alias("n_found"), "state")
    )


@query(
    "footer_stats",
    """SELECT o_orderpriority AS class_name, count(*) AS n_rows, min(o_orderkey) AS min_o_orderkey,
       max(o_orderkey) AS max_o_orderkey, min(Sim_Total_MET) AS min_Sim_Total_MET,
       max(Sim_Total_MET) AS max_Sim_Total_MET
       FROM (SELECT *, o_totalprice AS Sim_Total_MET FROM orders) GROUP BY 1""",
)
def footer_stats_query(spark, sf_dir):
    """Rows of each class from the footers of its shards alone, and the ranges of two columns."""
    schema = "Sim_Total_MET double, o_orderkey long"
    stats = class_stats(spark, class_shards(spark, sf_dir), SHARDS, schema)
    return with_label(stats, SHARDS).drop("class_folder", "label")


@query("recursive_scan", "SELECT count(*) AS n_rows, sum(o_orderkey)::BIGINT AS keys FROM orders")
def recursive_scan(spark, sf_dir):
    """All shards below one folder, without naming the folders between."""
    rows = scan(spark, class_shards(spark, sf_dir), ["o_orderkey"], recursive=True)
    return rows.agg(F.count("*").alias("n_rows"), F.sum("o_orderkey").alias("keys"))


@query("extra_columns", "SELECT o_orderkey, o_totalprice FROM orders")
def extra_columns(spark, sf_dir):
    """A declared schema: what a file has beyond it is not read."""
    schema = T.StructType([T.StructField("o_orderkey", T.LongType()), T.StructField("o_totalprice", T.DoubleType())])
    return scan(spark, f"{sf_dir}/orders.parquet", schema=schema)


@query(
    "first_file",
    f"""WITH {FILES} SELECT class_folder, min(file) AS file, arg_min(n_rows, file) AS n_rows
        FROM files GROUP BY 1""",
)
def first_file(spark, sf_dir):
    return first_files(order_files(spark, sf_dir), 1)


@query(
    "distinct_sinks",
    """SELECT DISTINCT kind, o_orderpriority || '/' || o_orderstatus AS value
       FROM orders, (VALUES ('csv'), ('json')) k(kind)""",
)
def distinct_sinks(spark, sf_dir):
    """Distinct values written and read back in both formats."""
    value = F.concat_ws("/", "o_orderpriority", "o_orderstatus").alias("value")
    found = stored(distinct_values(table(spark, sf_dir, "orders").select(value), "value"), "distinct")
    out = None
    for kind in ("csv", "json"):
        path = fresh_folder(spark, kind)
        write_distinct(found, path, kind)
        reader = spark.read.schema("value string")
        back = reader.option("header", "true").csv(path) if kind == "csv" else reader.json(path)
        back = back.select(F.lit(kind).alias("kind"), "value")
        out = back if out is None else out.unionByName(back)
    return out


PLACES = [(s.group, s.start, s.end, len(s.columns)) for s in SECTIONS]


@query(
    "layout_artifacts",
    f"WITH {RAW} "
    + " UNION ALL ".join(
        f"""SELECT '{g}' AS "group", {a} AS "start", {b} AS "end", {n} AS num_columns,
            sum({" + ".join(f"(x_{i:02d} <> 0)::INTEGER" for i in range(a, b))})::BIGINT AS n_nonzero FROM raw"""
        for g, a, b, n in PLACES
    ),
)
def layout_artifacts(spark, sf_dir):
    """A stored layout, read back, says where each group's values stand."""
    path = fresh_folder(spark, "layout")
    write_layout(spark, raw_layout(ORDER_SPEC), path)
    sections = read_layout(spark, path)
    places = summary(sections)
    owner = [s.group for s in sections for _ in range(s.start, s.end)]
    values = order_vectors(spark, sf_dir).select(F.posexplode_outer("x").alias("position", "v"))
    found = values.groupBy(F.get(F.lit(owner), F.col("position")).alias("group")).agg(
        F.count_if(F.col("v") != 0).alias("n_nonzero")
    )

    def part(name):
        value = F.lit(None)
        for group, place in places.items():
            value = F.when(F.col("group") == group, F.lit(place[name])).otherwise(value)
        return value.cast("int").alias(name)

    return found.select("group", *[part(n) for n in ("start", "end", "num_columns")], "n_nonzero")


ITEM_NAMES = ["PT", "Eta", "Phi_sin", "Phi_cos", "Mass", "Charge_is_-1", "Charge_is_0", "Charge_is_1"]
EXPANDED_NAMES = (
    [f"Sim_Item_{n}" for n in ITEM_NAMES] * 3
    + ["items_count", "Sim_Item_PT", "Sim_Item_Eta", "Sim_Total_MET", "Sim_PrimaryVertex_Z"]
)


@query(
    "expanded_names",
    f"WITH {EXPANDED} "
    + " UNION ALL ".join(
        f"""SELECT {i} AS "position", '{n}' AS name, round(avg(e_{i:02d}), 4) AS mean FROM expanded"""
        for i, n in enumerate(EXPANDED_NAMES)
    ),
)
def expanded_names_query(spark, sf_dir):
    """Every position of the expanded vector under its name, with its mean."""
    treatment = Treatment()
    plan = Preprocessor(SECTIONS, treatment)
    names = []
    for s in SECTIONS:
        names += [n for c in s.columns for n in expanded_names(c, treatment)] * s.slots
        names += [f"{s.group}_count"] * s.count
    assert len(names) == len(EXPANDED_SLOTS)
    values = plan.expand(order_vectors(spark, sf_dir)).select(F.posexplode_outer("x").alias("position", "v"))
    return values.groupBy("position").agg(F.round(F.avg("v"), 4).alias("mean")).select(
        "position", F.get(F.lit(names), F.col("position")).alias("name"), "mean"
    )


@query(
    "plottable_columns",
    f"""WITH {NAMES} SELECT 'Sim_' || string_split(name, '_')[2] AS view_group, count(*) AS n
        FROM names WHERE array_to_string(string_split(name, '_')[3:], '_') NOT IN ('PT', 'D0_Error')
        GROUP BY 1""",
)
def plottable_columns(spark, sf_dir):
    """Values of plottable columns by group; some features are left out."""
    groups = plottable([n for n, _ in NAMED], skip=("PT", "D0_Error"))
    view = F.lit(None).cast("string")
    for group, names in groups.items():
        view = F.when(F.col("name").isin(names), group).otherwise(view)
    rows = feature_names(spark, sf_dir).select(view.alias("view_group"))
    return rows.where(F.col("view_group").isNotNull()).groupBy("view_group").agg(F.count("*").alias("n"))


@query(
    "unknown_classes",
    f"""WITH {SPLIT} SELECT DISTINCT class_folder FROM manifest WHERE class_folder NOT IN
        (SELECT class_folder FROM files WHERE class_folder < '4')""",
)
def unknown_classes_query(spark, sf_dir):
    known = order_files(spark, sf_dir).where(F.col("class_folder") < "4")
    return unknown_classes(manifest(spark, sf_dir), known)
