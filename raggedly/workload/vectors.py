"""Queries on packing, vectors, tokens and layout."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import packing as P
from ..functions.names import family, parsed_name, source_to_shard, label_shard, shard_to_source, stem
from ..operators.prefix import running
from ..operators.vectorize import tokens, vectorize
from ..functions.ordering import float_bucket
from ..plans.layout import raw_layout
from ..plans.spec import EventSpec, ObjectGroup
from ..sources.events import with_label
from .registry import query
from .tables import (
    CLASSES, ITEM_COLUMNS, K, ORDER_SPEC, WORD_SPEC, order_events, order_rows, table, wide,
    word_events,
)

FIELDS = ("pt", "eta", "phi", "mass", "charge")
LINES = """
lines AS (
  SELECT *, row_number() OVER (PARTITION BY k ORDER BY pt DESC, eta, phi, mass, charge) AS rk,
         count(*) OVER (PARTITION BY k) AS n
  FROM (SELECT l_orderkey AS k, l_extendedprice AS pt, l_quantity - 25 AS eta,
               l_discount * 20 - 1 AS phi, l_tax AS mass,
               CASE l_returnflag WHEN 'A' THEN -1.0::DOUBLE WHEN 'N' THEN 0.0::DOUBLE
                                 ELSE 1.0::DOUBLE END AS charge
        FROM lineitem))
"""
ITEM_SLOTS = [
    f"coalesce(max({f}) FILTER (WHERE rk = {obj + 1}), 0)" for obj in range(K) for f in FIELDS
]
LEAD_SLOTS = [f"coalesce(max({f}) FILTER (WHERE rk = 1), 0)" for f in ("pt", "eta")]
COUNT_SLOT = "coalesce(max(n), 0)::DOUBLE"
MET_SLOT = "coalesce(any_value(o_totalprice), 0)"
VERTEX_SLOT = "coalesce(any_value(CASE WHEN o_orderstatus <> 'P' THEN o_custkey / 100.0::DOUBLE END), 0)"
RAW_SLOTS = [*ITEM_SLOTS, COUNT_SLOT, *LEAD_SLOTS, MET_SLOT, VERTEX_SLOT]


def slot_list(slots, start=0):
    return ", ".join(f"{s} AS x_{i:02d}" for i, s in enumerate(slots, start))


def per_order(select: str) -> str:
    return f"""WITH {LINES} SELECT o_orderkey, {select}
        FROM orders LEFT JOIN lines ON k = o_orderkey GROUP BY o_orderkey"""


WORDS = """
words AS (
  SELECT doc_id, length(w)::DOUBLE AS pt, instr(w, 'e')::DOUBLE AS d0, i,
         row_number() OVER (PARTITION BY doc_id ORDER BY length(w) DESC, i) AS rk,
         count(*) OVER (PARTITION BY doc_id) AS n
  FROM (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i
        FROM (SELECT doc_id, string_split(text, ' ') AS ws FROM documents)))
"""


WORD_COLUMNS = ("Doc_Word_PT", "Doc_Word_D0")


def per_document(k: int) -> str:
    slots = [f"coalesce(max({f}) FILTER (WHERE rk = {r}), 0)" for r in range(1, k + 1) for f in ("pt", "d0")]
    return f"""WITH {WORDS} SELECT doc_id, {slot_list(slots)}
        FROM documents JOIN words USING (doc_id) GROUP BY doc_id"""


def packed_words(spark, sf_dir, k):
    """Documents hold all their words as lists; the pack chooses among them in the row."""
    spec = EventSpec((ObjectGroup("words", WORD_COLUMNS, k),))
    events = word_events(table(spark, sf_dir, "documents"))
    return wide(vectorize(events, spec, ["doc_id"]), spec.width, ["doc_id"])


@query("topk_pack", per_document(K))
def topk_pack(spark, sf_dir):
    return packed_words(spark, sf_dir, K)


@query("leading_pack", per_document(1))
def leading_pack(spark, sf_dir):
    return packed_words(spark, sf_dir, 1)


@query("scalar_pack", f"SELECT o_orderkey, {slot_list([MET_SLOT, VERTEX_SLOT])} FROM orders GROUP BY 1")
def scalar_pack(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_totalprice",
        F.when(F.col("o_orderstatus") != "P", F.col("o_custkey") / 100.0).alias("vertex"),
    )
    spec = EventSpec((ObjectGroup("totals", ("o_totalprice", "vertex"), None),))
    return wide(vectorize(orders, spec, ["o_orderkey"]), 2, ["o_orderkey"])


@query(
    "object_count",
    """SELECT doc_id, len(string_split(text, ' '))::INTEGER AS n_words FROM documents""",
)
def object_count(spark, sf_dir):
    events = word_events(table(spark, sf_dir, "documents"))
    return events.select("doc_id", P.object_count("Doc_Word_PT").alias("n_words"))


@query("flat_vector", per_order(slot_list(RAW_SLOTS)))
def flat_vector(spark, sf_dir):
    vectors = vectorize(order_events(spark, sf_dir), ORDER_SPEC, ["o_orderkey"])
    return wide(vectors, ORDER_SPEC.width, ["o_orderkey"])


@query(
    "flat_vector_float32",
    per_order(slot_list([f"({s})::FLOAT" for s in RAW_SLOTS])),
)
def flat_vector_float32(spark, sf_dir):
    vectors = vectorize(
        order_events(spark, sf_dir), ORDER_SPEC, ["o_orderkey"], strict_float32=True
    )
    return wide(vectors, ORDER_SPEC.width, ["o_orderkey"])


@query(
    "jagged_vector",
    f"""WITH {WORDS} SELECT doc_id, """
    + slot_list(
        [f"coalesce(max({f}) FILTER (WHERE rk = {r}), 0)" for r in range(1, 6) for f in ("pt", "d0")]
        + ["max(n)::DOUBLE", "max(pt)", "max(n_chars)::DOUBLE"]
    )
    + " FROM documents JOIN words USING (doc_id) GROUP BY doc_id",
)
def jagged_vector(spark, sf_dir):
    events = word_events(table(spark, sf_dir, "documents"))
    return wide(vectorize(events, WORD_SPEC, ["doc_id"]), WORD_SPEC.width, ["doc_id"])


@query(
    "token_table",
    f"""WITH {LINES}, slots AS (SELECT unnest([1, 2, 3]) AS rk),
    grid AS (
      SELECT o_orderkey, o_totalprice,
             coalesce(CASE WHEN o_orderstatus <> 'P' THEN o_custkey / 100.0::DOUBLE END, 0) AS vz,
             rk FROM orders, slots),
    full_grid AS (
      SELECT g.*, coalesce(pt, 0) AS pt, coalesce(eta, 0) AS eta, coalesce(phi, 0) AS phi,
             coalesce(mass, 0) AS mass, coalesce(charge, 0) AS charge, coalesce(n, 0) AS n
      FROM grid g LEFT JOIN lines l ON l.k = g.o_orderkey AND l.rk = g.rk)
    SELECT o_orderkey, 0 AS token, 'event' AS "group", 0 AS object, n::DOUBLE AS v0,
           NULL::DOUBLE AS v1, NULL::DOUBLE AS v2, NULL::DOUBLE AS v3, NULL::DOUBLE AS v4
    FROM full_grid WHERE rk = 1
    UNION ALL SELECT o_orderkey, rk, 'items', rk - 1, pt, eta, phi, mass, charge FROM full_grid
    UNION ALL SELECT o_orderkey, 4, 'lead', 0, pt, eta, NULL, NULL, NULL FROM full_grid WHERE rk = 1
    UNION ALL SELECT o_orderkey, 5, 'totals', 0, o_totalprice, vz, NULL, NULL, NULL
    FROM full_grid WHERE rk = 1""",
)
def token_table(spark, sf_dir):
    vectors = vectorize(order_events(spark, sf_dir), ORDER_SPEC, ["o_orderkey"])
    long = tokens(vectors, raw_layout(ORDER_SPEC), ["o_orderkey"])
    values = [F.get("values", F.lit(i)).alias(f"v{i}") for i in range(len(ITEM_COLUMNS))]
    return long.select("o_orderkey", "token", "group", "object", *values)


@query("leading_slice", per_order(slot_list(ITEM_SLOTS[: len(FIELDS)])))
def leading_slice(spark, sf_dir):
    vectors = vectorize(order_events(spark, sf_dir), ORDER_SPEC, ["o_orderkey"])
    section = raw_layout(ORDER_SPEC)[0]
    lead = vectors.select("o_orderkey", P.leading_slice(F.col("x"), section).alias("x"))
    return wide(lead, len(section.columns), ["o_orderkey"])


@query(
    "first_of_list",
    """SELECT doc_id, length(string_split(text, ' ')[1])::DOUBLE AS first_value FROM documents
       WHERE len(string_split(text, ' ')) > 0""",
)
def first_of_list(spark, sf_dir):
    events = word_events(table(spark, sf_dir, "documents"))
    return events.select(
        "doc_id", P.first_of_list(F.col("Doc_Word_PT")).alias("first_value")
    ).where(F.col("first_value").isNotNull())


@query(
    "layout_offsets",
    """WITH sizes AS (SELECT doc_id, len(string_split(text, ' ')) AS n FROM documents)
       SELECT doc_id, (sum(n) OVER (ORDER BY doc_id) - n)::BIGINT AS list_start,
              (sum(n) OVER (ORDER BY doc_id))::BIGINT AS list_end FROM sizes""",
)
def layout_offsets(spark, sf_dir):
    """Where each jagged list starts and ends once all lists are laid end to end."""
    sizes = word_events(table(spark, sf_dir, "documents")).select(
        "doc_id", F.size("Doc_Word_PT").cast("long").alias("n")
    )
    placed = running(
        sizes, [], ["doc_id"], float_bucket(F.col("doc_id"), 1 << 12), sums={"list_end": F.col("n")}
    )
    return placed.select("doc_id", (F.col("list_end") - F.col("n")).alias("list_start"), "list_end")


@query(
    "label_join",
    """SELECT o_orderkey, o_orderpriority AS class_name,
              CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2
                   WHEN '4-NOT SPECIFIED' THEN 3 WHEN '5-LOW' THEN 4 END::BIGINT AS label
       FROM orders WHERE o_orderpriority IN
            ('1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW')""",
)
def label_join(spark, sf_dir):
    return with_label(order_rows(spark, sf_dir), CLASSES).select("o_orderkey", "class_name", "label")


# A name for each family rule and one that no rule knows, with the family it must get.
NAMED = (
    ("Sim_Jet_PT", "pt"), ("Sim_Jet_Eta", "eta"), ("Sim_Jet_Phi", "phi"), ("Sim_Jet_Mass", "mass"),
    ("Sim_Part_PID", "pid"), ("Sim_Electron_Charge", "charge"), ("Sim_JetPuppiAK4_BTag", "puppibtag"),
    ("Sim_JetPuppiAK8_BTagPhys", "puppibtag"), ("Sim_JetAK4_BTag", "btag"),
    ("Sim_JetAK8_BTagPhys", "btag"), ("Sim_Part_PuppiW", "puppiw"), ("Sim_Event_MET", "met"),
    ("Sim_MET_Phi", "phi"), ("Sim_PrimaryVertex_SumPT2", "vertexpt2"),
    ("Sim_PrimaryVertex_Z", "vertexcoord"), ("Sim_Muon_IsolationVar", "isolation"),
    ("Sim_Muon_IsolationVarRhoCorr", "isolation"), ("Sim_Photon_EhadOverEem", "EhadOverEem"),
    ("Sim_Muon_D0", "displacement"), ("Sim_Muon_DZ", "displacement"), ("Sim_Jet_NCharged", "ncharged"),
    ("Sim_Jet_NNeutrals", "nneutrals"), ("Sim_Muon_D0_Error", "other"),
)
NAME_VALUES = ", ".join(f"({i}, '{n}', '{f}')" for i, (n, f) in enumerate(NAMED))
NAMES = f"""
named AS (SELECT * FROM (VALUES {NAME_VALUES}) v(i, name, family)),
names AS (SELECT name, family FROM lineitem JOIN named ON i = l_partkey % {len(NAMED)})
"""


def feature_names(spark, sf_dir):
    """A feature name per line item, so that naming functions see every row."""
    name = F.get(F.lit([n for n, _ in NAMED]), (F.col("l_partkey") % len(NAMED)).cast("int"))
    return table(spark, sf_dir, "lineitem").select(name.alias("name"))


@query("feature_family", f"WITH {NAMES} SELECT name, family, count(*) AS n FROM names GROUP BY ALL")
def feature_family(spark, sf_dir):
    names = feature_names(spark, sf_dir)
    return names.select("name", family(F.col("name")).alias("family")).groupBy(
        "name", "family"
    ).agg(F.count("*").alias("n"))


@query(
    "column_parse",
    f"""WITH {NAMES} SELECT string_split(name, '_')[1] || '_' || string_split(name, '_')[2] AS view_group,
         array_to_string(string_split(name, '_')[3:], '_') AS feature, count(*) AS n
       FROM names GROUP BY ALL""",
)
def column_parse(spark, sf_dir):
    parsed = feature_names(spark, sf_dir).select(parsed_name(F.col("name")).alias("p"))
    return parsed.groupBy(
        F.col("p.view_group").alias("view_group"), F.col("p.feature").alias("feature")
    ).agg(F.count("*").alias("n"))


@query(
    "file_name_maps",
    """SELECT url, regexp_replace(string_split(url, '/')[-1], '\\.[^.]*$', '') AS stem,
              'page' || page_id || '_x.npy' AS shard, 'page' || page_id || '_y.npy' AS label_shard,
              'page' || page_id || '.parquet' AS source FROM pages""",
)
def file_name_maps(spark, sf_dir):
    source = F.concat(F.lit("page"), F.col("page_id").cast("string"), F.lit(".parquet"))
    shard = source_to_shard(source)
    return table(spark, sf_dir, "pages").select(
        "url", stem(F.col("url")).alias("stem"), shard.alias("shard"),
        label_shard(shard).alias("label_shard"), shard_to_source(shard).alias("source"),
    )
