"""Queries that run a whole job: streams, stored outputs and networks."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark.sql import functions as F

from ..operators.catalog import build_catalog, class_totals
from ..operators.feed import buffer_shuffle, capped_scan
from ..operators.mlp import baseline_predictions, mlp_baseline, mlp_score
from ..operators.metrics import scored
from ..operators.jobs import apply_pending, vectorize_pending
from ..operators.preprocess import Preprocessor, run
from ..operators.splits import read_or_create_manifest
from ..operators.vectorize import vectorize
from ..plans.layout import raw_layout
from ..plans.spec import ClassList, EventSpec, ObjectGroup, Treatment
from ..session import fresh_folder, hadoop_path, settings, stored
from ..sources.events import listing, with_label
from ..sources.ledger import Ledger, Versions
from ..sources.sinks import missing_outputs, read_vectors, write_vectors
from ..streaming.cap import append_capped
from ..streaming.incremental import (
    incremental_apply, incremental_vectorize, running_class_counts, stream_files,
)
from .features import BLOCKS, EXPANDED, EXPANDED_SLOTS, RAW, normalized_sql, stats_sql
from .files import FILES, GRID, ORDERED, SEED, SPLIT, TARGETS, used
from .registry import ORACLES, query
from .tables import CLASSES, ORDER_SPEC, WORD_SPEC, order_events, table, wide, word_events

HIDDEN = 16
N_IN = 64
N_OUT = 10


def document_stream(spark, sf_dir):
    schema = table(spark, sf_dir, "documents").schema
    return stream_files(spark, f"{sf_dir}/documents.parquet", schema)


LANGUAGES = ClassList(("de", "en", "es", "fr"))
WORD_VECTORS = f"""SELECT j.*, 'src' AS split, d.lang AS class_folder, d.source AS file,
    (list_position([{", ".join(f"'{n}'" for n in LANGUAGES.names)}], d.lang) - 1)::BIGINT AS y
    FROM ({ORACLES["jagged_vector"]}) j JOIN documents d USING (doc_id)"""


def document_events(spark, sf_dir):
    """Documents as a stream of events: the language is the class, the source the file."""
    events = word_events(document_stream(spark, sf_dir)).withColumn("split", F.lit("src"))
    return with_label(events, LANGUAGES)


@query("incremental_vectorize", WORD_VECTORS)
def incremental_vectorize_query(spark, sf_dir):
    """Stream the document files once into a vector table; a second run adds nothing."""
    ledger, checkpoint = Ledger(spark, fresh_folder(spark, "vectors")), fresh_folder(spark, "checkpoint")
    for _ in range(2):
        incremental_vectorize(document_events(spark, sf_dir), WORD_SPEC, ledger, checkpoint, "doc_id")
    vectors = read_vectors(spark, f"{ledger.root}/vectors").withColumnRenamed("row", "doc_id")
    return wide(vectors, WORD_SPEC.width, ["split", "class_folder", "file", "doc_id", "y"])


# The declared classes under the folder names that a partitioned write gives them.
SHARDS = ClassList(CLASSES.names, {n: f"class_folder={n}" for n in CLASSES.names})


def class_shards(spark, sf_dir):
    """Order events written as event shards, one folder per class."""
    base = fresh_folder(spark, "shards")
    events = order_events(spark, sf_dir).drop("file")
    # One write for all classes, a large class by several tasks.
    events.hint("rebalance", "class_folder").write.partitionBy("class_folder").parquet(base)
    return base


# Stand-in files of this size are real shards in the queries below, with names of their own.
SHARD_ROWS = 4096
MOVERS = 8


def by_shard(sql: str) -> str:
    return sql.replace("'f' || (o_orderkey // 256)", f"'f' || (o_orderkey // {SHARD_ROWS}) || '.parquet'")


def named_shards(spark, sf_dir, sort=False):
    """Order events as one Parquet file per stand-in file, under its name in the class folder."""
    base = fresh_folder(spark, "shards")
    name = F.concat(F.lit("f"), F.floor(F.col("o_orderkey") / SHARD_ROWS).cast("string"), F.lit(".parquet"))
    events = order_events(spark, sf_dir).drop("file").withColumn("shard", name)
    events = events.repartition("class_folder", "shard")
    if sort:
        events = events.sortWithinPartitions("class_folder", "shard", "o_orderkey")
    events.write.partitionBy("class_folder", "shard").parquet(f"{base}/made")
    named_parts(spark, f"{base}/made", base)
    return base


def named_parts(spark, made, base):
    """Move the one file of each ``made/<class folder>/shard=<name>`` to ``base/<class folder>/<name>``.

    The tasks list the folders, a slice each; the driver then asks for nothing but the moves, a
    few at a time.
    """
    slices = str(4 * spark.sparkContext.defaultParallelism)
    with settings(spark, sources__parallelPartitionDiscovery__parallelism=slices):
        parts = [r["path"] for r in listing(spark, made, recursive=True).select("path").collect()]
    fs, _ = hadoop_path(spark, base)
    path = spark._jvm.org.apache.hadoop.fs.Path
    moves = {}
    for part in parts:
        _, folder, shard, _ = part.rsplit("/", 3)
        to = f"{base}/{folder}/{shard.removeprefix('shard=')}"
        if to in moves:
            raise ValueError(f"several files for {to}")
        moves[to] = part
    for folder in {to.rsplit("/", 1)[0] for to in moves}:
        fs.mkdirs(path(folder))

    def move(to):
        if not fs.rename(path(moves[to]), path(to)):
            raise OSError(f"{moves[to]} cannot be moved to {to}")

    with ThreadPoolExecutor(MOVERS) as movers:
        list(movers.map(move, moves))


@query("catalog_totals", "SELECT o_orderpriority AS class_folder, count(*) AS n_rows FROM orders GROUP BY 1")
def catalog_totals(spark, sf_dir):
    """Totals of a catalogue made from the shards' own footers."""
    catalog = build_catalog(spark, class_shards(spark, sf_dir), SHARDS)
    return class_totals(with_label(catalog, SHARDS).withColumn("class_folder", F.col("class_name")))


@query(
    "capped_scan",
    by_shard(f"""WITH {ORDERED}, seen AS (
          SELECT o_orderkey, class_folder, file, c - n_rows AS before,
                 row_number() OVER (PARTITION BY class_folder, file ORDER BY o_orderkey) AS r
          FROM rows_ JOIN ordered USING (class_folder, file))
        SELECT class_folder AS class_name, file, o_orderkey FROM seen WHERE before + r <= 1000"""),
)
def capped_scan_query(spark, sf_dir):
    """A per-class cap on the shards: only the needed files are opened. Which rows they are."""
    base = named_shards(spark, sf_dir, sort=True)
    rows = capped_scan(spark, base, SHARDS, build_catalog(spark, base, SHARDS), 1000)
    return rows.select("class_name", "file", "o_orderkey")


STREAM_CAP = 1500


@query(
    "capped_stream",
    f"""SELECT o_orderkey, class_folder, o_totalprice FROM (
          SELECT *, o_orderpriority AS class_folder, row_number() OVER (
            PARTITION BY o_orderpriority ORDER BY o_orderkey % 3, o_orderkey) AS r FROM orders)
        WHERE r <= {STREAM_CAP}""",
)
def capped_stream_query(spark, sf_dir):
    """A cap per class on a stream of orders that arrive in three parts, with a restart for each."""
    source, out = fresh_folder(spark, "arrivals"), fresh_folder(spark, "capped")
    checkpoint = fresh_folder(spark, "checkpoint")
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.col("o_orderpriority").alias("class_folder"), "o_totalprice"
    )
    for part in range(3):
        orders.where(F.col("o_orderkey") % 3 == part).write.mode("append").parquet(source)
        stream = stream_files(spark, source, orders.schema)
        append_capped(stream, "class_folder", STREAM_CAP, ["o_orderkey"], out, checkpoint)
    return spark.read.schema(orders.schema).parquet(out)


LABELS = "list_position([" + ", ".join(f"'{n}'" for n in CLASSES.names) + "], class_folder) - 1"
PLACED = f"""SELECT split, class_folder, file, o_orderkey, ({LABELS})::BIGINT AS y,
        {", ".join(f"x_{i:02d}" for i in range(ORDER_SPEC.width))}
        FROM raw JOIN manifest USING (class_folder, file) WHERE split <> 'unused'"""


def placed_vectors(spark, sf_dir):
    """Where the vectors of the manifest's files were written, by split and class."""
    vectors = vectorize(
        with_label(order_events(spark, sf_dir), CLASSES), ORDER_SPEC,
        ["o_orderkey", "class_folder", "file", "label"],
    )
    placed = vectors.join(used(spark, sf_dir).drop("n_rows"), ["class_folder", "file"])
    path = fresh_folder(spark, "vectors")
    write_vectors(
        placed.select(
            "file", F.col("o_orderkey").alias("row"), "x", F.col("label").alias("y"),
            "split", "class_folder",
        ),
        path,
    )
    return path


def read_back(vectors):
    return wide(
        vectors.withColumnRenamed("row", "o_orderkey"), ORDER_SPEC.width,
        ["split", "class_folder", "file", "o_orderkey", "y"],
    )


@query("vector_table", f"WITH {SPLIT}, {RAW} {PLACED}")
def vector_table(spark, sf_dir):
    """Write vectors by split and class, then read all of them back."""
    return read_back(read_vectors(spark, placed_vectors(spark, sf_dir)))


@query("vector_split", f"WITH {SPLIT}, {RAW} {PLACED} AND split = 'train'")
def vector_split(spark, sf_dir):
    """Read one split back: the folders of the others are not opened."""
    return read_back(
        read_vectors(spark, placed_vectors(spark, sf_dir), "train", CLASSES.class_folders)
    )


def preprocess_twice(spark, sf_dir):
    """Fit, save, apply; then load and apply again, which must add nothing."""
    vectors = placed_vectors(spark, sf_dir)
    out, stats = fresh_folder(spark, "preprocessed"), fresh_folder(spark, "stats")
    plan = Preprocessor(raw_layout(ORDER_SPEC), Treatment())
    run(spark, plan, vectors, out, stats, CLASSES.class_folders)
    again = run(spark, plan, vectors, out, stats, CLASSES.class_folders, mode="apply_only")
    run(spark, plan, vectors, out, stats, CLASSES.class_folders, enabled=False, splits=("train",))
    return plan, out, again


@query(
    "preprocess_run",
    f"""WITH {SPLIT}, {EXPANDED}, placed AS (
          SELECT expanded.*, split FROM expanded JOIN manifest USING (class_folder, file)
          WHERE split <> 'unused'),
        picked AS (SELECT * FROM placed WHERE split = 'train'), {stats_sql("picked")},
        normal AS ({normalized_sql()})
        SELECT split, class_folder, normal.* FROM normal JOIN placed USING (o_orderkey)""",
)
def preprocess_run(spark, sf_dir):
    """The whole job: statistics of the train split, saved, loaded and applied by manifest."""
    plan, out, _ = preprocess_twice(spark, sf_dir)
    done = read_vectors(spark, out).withColumnRenamed("row", "o_orderkey")
    return wide(done, len(plan.slots), ["split", "class_folder", "o_orderkey"], 6)


@query(
    "fit_metadata",
    f"""WITH {SPLIT}, {RAW} SELECT count(*) AS n_fit, {len(EXPANDED_SLOTS)} AS width, {len(BLOCKS)} AS n_fitted
        FROM raw JOIN manifest USING (class_folder, file) WHERE split = 'train'""",
)
def fit_metadata(spark, sf_dir):
    """What the stored statistics say about their fit."""
    _, _, model = preprocess_twice(spark, sf_dir)
    meta = model.as_dict()["_meta"]
    fitted = sum(kind != "none" for kind in model.plan.kinds.values())
    return spark.range(1).select(
        F.lit(meta["num_examples_fit"]).cast("long").alias("n_fit"),
        F.lit(meta["num_features_expanded"]).alias("width"),
        F.lit(fitted).alias("n_fitted"),
    )


def shard_manifest(spark, base):
    """Catalogue and manifest of the shards, under the folder names of a partitioned write."""
    files = stored(build_catalog(spark, base, SHARDS).where("status = 'ok'"), "files")
    # The split goes by class and file; SQL knows a class by its plain name.
    path = fresh_folder(spark, "manifest")
    for _ in range(2):
        manifest = read_or_create_manifest(spark, path, files, TARGETS, SEED, len(CLASSES.names))
    return manifest


def manifest_vectors(spark, ledger):
    plain = F.regexp_replace("class_folder", "^class_folder=", "")
    return read_back(ledger.vectors().withColumn("class_folder", plain))


@query("vectorize_manifest", by_shard(f"WITH {SPLIT}, {RAW} {PLACED}"))
def vectorize_manifest(spark, sf_dir):
    """Shards, catalogue, manifest (made once, then read), scan by manifest, vectors with y."""
    base = named_shards(spark, sf_dir)
    ledger = Ledger(spark, fresh_folder(spark, "vectors"))
    vectorize_pending(
        spark, base, shard_manifest(spark, base), SHARDS, ORDER_SPEC, ledger, fresh_folder(spark, "bad-files"),
        "o_orderkey", declared=False,
    )
    return manifest_vectors(spark, ledger)


@query(
    "resumed_jobs",
    by_shard(f"""WITH {SPLIT}, {RAW}, run AS (
          SELECT split, class_folder, file, n_rows, CASE WHEN split = 'train' THEN 1 ELSE 2 END AS run
          FROM manifest WHERE split <> 'unused')
        SELECT 'vectorize' AS job, run, split, class_folder, count(*) AS n_files, sum(n_rows)::BIGINT AS n_rows
        FROM run GROUP BY ALL
        UNION ALL SELECT 'apply', run, split, class_folder, count(*), sum(n_rows)::BIGINT FROM run GROUP BY ALL
        UNION ALL SELECT 'rows', 3, split, class_folder, count(DISTINCT file), count(*)
        FROM raw JOIN manifest USING (class_folder, file) WHERE split <> 'unused' GROUP BY ALL"""),
)
def resumed_jobs(spark, sf_dir):
    """Jobs run three times: the train split, all splits, all again. Each file is taken once.

    By run and split, what the ledgers of vectors and of preprocessed rows hold, and at last the
    preprocessed rows themselves.
    """
    base = named_shards(spark, sf_dir)
    manifest = shard_manifest(spark, base)
    vectors, applied = (Ledger(spark, fresh_folder(spark, n)) for n in ("vectors", "applied"))
    plan, runs, model = Preprocessor(raw_layout(ORDER_SPEC), Treatment()), {}, None
    for run_ in (1, 2, 3):
        part = manifest.where("split = 'train'") if run_ == 1 else manifest
        vectorize_pending(spark, base, part, SHARDS, ORDER_SPEC, vectors, None, "o_orderkey", declared=False)
        model = model or plan.fit(vectors.vectors().where("split = 'train'"))
        apply_pending(model, vectors, applied)
        for job, ledger in (("vectorize", vectors), ("apply", applied)):
            for r in ledger.finished().select("batch").distinct().collect():
                runs.setdefault((job, r["batch"]), run_)
    plain = F.regexp_replace("class_folder", "^class_folder=", "").alias("class_folder")
    out = None
    for (job, batch), run_ in runs.items():
        ledger = vectors if job == "vectorize" else applied
        one = (
            ledger.finished().where(F.col("batch") == batch)
            .groupBy("split", plain)
            .agg(F.count("*").alias("n_files"), F.sum("n_rows").alias("n_rows"))
            .select(F.lit(job).alias("job"), F.lit(run_).alias("run"), "*")
        )
        out = one if out is None else out.unionByName(one)
    rows = (
        applied.vectors()
        .groupBy("split", plain)
        .agg(F.countDistinct("file").alias("n_files"), F.count("*").alias("n_rows"))
        .select(F.lit("rows").alias("job"), F.lit(3).alias("run"), "*")
    )
    return out.unionByName(rows)


BUFFER, WORKERS = 1000, 6


@query(
    "buffer_shuffle",
    by_shard(f"""WITH {FILES}, shards AS (
          SELECT *, row_number() OVER (ORDER BY md5('{SEED}/class_folder=' || class_folder || '/' || file)) - 1 AS place
          FROM files),
        dealt AS (SELECT *, place // ceil((SELECT count(*) FROM files) / {WORKERS})::BIGINT AS worker FROM shards),
        arrived AS (
          SELECT o_orderkey, worker, row_number() OVER (PARTITION BY worker ORDER BY place, o_orderkey) - 1 AS t
          FROM rows_ JOIN dealt USING (class_folder, file)),
        slots AS (
          SELECT *, CASE WHEN t < {BUFFER} THEN t ELSE
            ('0x' || md5('{SEED}/' || worker || '/' || t)[:8])::BIGINT % {BUFFER} END AS slot FROM arrived),
        steps AS (SELECT *, lead(t) OVER (PARTITION BY worker, slot ORDER BY t) AS step FROM slots)
        SELECT o_orderkey, worker::INTEGER AS worker, row_number() OVER (
          PARTITION BY worker ORDER BY step NULLS LAST,
            ('0x' || md5('{SEED}/' || worker || '/end/' || slot)[:8])::BIGINT, slot) - 1 AS "position"
        FROM steps"""),
)
def buffer_shuffle_query(spark, sf_dir):
    """Orders through a bounded buffer per worker; inside a shard they are in key order."""
    base = named_shards(spark, sf_dir, sort=True)
    files = listing(spark, [f"{base}/{f}" for f in SHARDS.class_folders])
    rows = buffer_shuffle(spark, base, files, SHARDS, WORKERS, buffer_rows=BUFFER, seed=SEED)
    return rows.select("o_orderkey", "worker", "position")


@query(
    "missing_outputs",
    f"""WITH {SPLIT}, {GRID} SELECT split, class_folder FROM grid
        WHERE NOT (split = 'val' AND class_folder = '2-HIGH') AND NOT EXISTS (
          SELECT 1 FROM manifest m WHERE m.split = grid.split AND m.class_folder = grid.class_folder)
        UNION ALL SELECT 'val', '2-HIGH'""",
)
def missing_outputs_query(spark, sf_dir):
    """Which (split, class) pairs have no rows, after one of them was left out."""
    source = read_vectors(spark, placed_vectors(spark, sf_dir))
    path = fresh_folder(spark, "vectors")
    write_vectors(source.where("NOT (split = 'val' AND class_folder = '2-HIGH')"), path)
    return missing_outputs(spark, path, CLASSES.class_folders, ("train", "val", "test"))


EMBEDDING_SPEC = EventSpec((ObjectGroup("parts", ("value",), N_IN),))


@query(
    "incremental_apply",
    """WITH v AS (SELECT vec_id, unnest(embedding)::DOUBLE AS e, generate_subscripts(embedding, 1) - 1 AS p
                  FROM embeddings),
            s AS (SELECT avg(e) FILTER (WHERE e <> 0) AS mean,
                         stddev_samp(e) FILTER (WHERE e <> 0) + 1e-6 AS std FROM v)
       SELECT vec_id, p::INTEGER AS "position",
              round(CASE WHEN e <> 0 THEN (e - mean) / std ELSE 0 END, 6) AS value FROM v, s""",
)
def incremental_apply_query(spark, sf_dir):
    """Preprocess a stream of vectors with statistics fitted beforehand."""
    source = table(spark, sf_dir, "embeddings")
    plan = Preprocessor(
        raw_layout(EMBEDDING_SPEC), Treatment(transforms={}, normalizers={"other": "standard"})
    )
    x = F.col("embedding").cast("array<double>").alias("x")
    model = plan.fit(source.select("vec_id", x))
    stream = stream_files(spark, f"{sf_dir}/embeddings.parquet", source.schema)
    out, checkpoint = fresh_folder(spark, "applied"), fresh_folder(spark, "checkpoint")
    incremental_apply(stream.select("vec_id", x), model, out, checkpoint)
    done = spark.read.parquet(out)
    return done.select("vec_id", F.posexplode_outer("x").alias("position", "value")).select(
        "vec_id", "position", F.round("value", 6).alias("value")
    )


@query("running_class_counts", "SELECT lang, count(*) AS n_rows FROM documents GROUP BY 1")
def running_class_counts_query(spark, sf_dir):
    """The last published version of the counts."""
    path, checkpoint = fresh_folder(spark, "counts"), fresh_folder(spark, "checkpoint")
    running_class_counts(document_stream(spark, sf_dir), "lang", path, checkpoint)
    return Versions(spark, path).current()


def rule_weights(n_in: int, n_out: int, salt: int):
    """Weights by a rule that SQL can repeat."""
    i, j = np.meshgrid(np.arange(n_in), np.arange(n_out))
    return np.sin(i * 7.0 + j * 3.0 + salt), np.cos(np.arange(n_out) * 5.0 + salt)


def rule_network():
    half = HIDDEN // 2
    return [rule_weights(N_IN, HIDDEN, 1), rule_weights(HIDDEN, half, 2), rule_weights(half, N_OUT, 3)]


def _layer_sql(source: str, n_out: int, salt: int, relu: bool) -> str:
    y = f"sum(v * sin(p * 7.0::DOUBLE + j * 3.0::DOUBLE + {salt})) + cos(j * 5.0::DOUBLE + {salt})"
    if relu:
        y = f"greatest({y}, 0)"
    return f"SELECT vec_id, j AS p, {y} AS v FROM {source}, range({n_out}) r(j) GROUP BY vec_id, j"


@query(
    "mlp_score",
    f"""WITH l0 AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS p
                    FROM embeddings),
        l1 AS ({_layer_sql('l0', HIDDEN, 1, True)}),
        l2 AS ({_layer_sql('l1', HIDDEN // 2, 2, True)}),
        l3 AS ({_layer_sql('l2', N_OUT, 3, False)})
        SELECT vec_id, p::INTEGER AS class, round(v, 5) AS logit FROM l3""",
)
def mlp_score_query(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("x"))
    out = mlp_score(vectors, rule_network())
    return out.select("vec_id", F.posexplode_outer("logits").alias("class", "logit")).select(
        "vec_id", "class", F.round("logit", 5).alias("logit")
    )


@query(
    "mlp_baseline",
    """SELECT count(*) AS n, sum(label)::BIGINT AS sum_label, true AS above_majority FROM embeddings""",
)
def mlp_baseline_query(spark, sf_dir):
    """Train Spark's own network: it must do better than naming the largest class."""
    rows = table(spark, sf_dir, "embeddings").select(
        F.col("embedding").cast("array<double>").alias("x"), F.col("label").cast("long").alias("y")
    )
    model = mlp_baseline(rows, N_IN, HIDDEN, N_OUT, max_iter=20)
    out = scored(baseline_predictions(model, rows))
    largest = rows.groupBy("y").agg(F.count("*").alias("k")).agg(F.max("k").alias("k")).scalar()
    hits = F.count_if(F.col("prediction") == F.col("label"))
    return out.agg(
        F.count("*").alias("n"), F.sum("label").cast("long").alias("sum_label"),
        (hits > F.max(largest)).alias("above_majority"),
    )
