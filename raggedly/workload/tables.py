"""The given tables in the roles of the data model.

An order is an event, its line items are the event's objects, its priority is the
class. A document is an event too, with its words as objects: there the lists are
jagged inside the row already. Embedding components serve as logits, and the event
log as the history of training runs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.vectorize import nest_objects
from ..plans.spec import ClassList, EventSpec, ObjectGroup

CLASSES = ClassList(("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"))
FILE_ROWS = 256  # order keys per stand-in file
N_CLASSES = 10
N_COMPONENTS = 64
K = 3

ITEM_COLUMNS = ("Sim_Item_PT", "Sim_Item_Eta", "Sim_Item_Phi", "Sim_Item_Mass", "Sim_Item_Charge")

ORDER_SPEC = EventSpec(
    (
        ObjectGroup("items", ITEM_COLUMNS, K, count=True, count_from="n_objects"),
        ObjectGroup("lead", ("Sim_Item_PT", "Sim_Item_Eta"), 1),
        ObjectGroup("totals", ("Sim_Total_MET", "Sim_PrimaryVertex_Z"), None),
    )
)
WORD_SPEC = EventSpec(
    (
        ObjectGroup("words", ("Doc_Word_PT", "Doc_Word_D0"), 5, count=True),
        ObjectGroup("longest", ("Doc_Word_PT",), 1),
        ObjectGroup("document", ("n_chars",), None),
    )
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def item_features() -> dict[str, Column]:
    return {
        "Sim_Item_PT": F.col("l_extendedprice"),
        "Sim_Item_Eta": F.col("l_quantity") - 25,
        "Sim_Item_Phi": F.col("l_discount") * 20 - 1,
        "Sim_Item_Mass": F.col("l_tax"),
        "Sim_Item_Charge": charge(),
    }


def charge() -> Column:
    flag = F.col("l_returnflag")
    return F.when(flag == "A", -1.0).when(flag == "N", 0.0).otherwise(1.0)


def order_file() -> Column:
    return F.concat(F.lit("f"), F.floor(F.col("o_orderkey") / FILE_ROWS).cast("string"))


def order_events(spark: SparkSession, sf_dir: str, k: int = K) -> DataFrame:
    """One row per order with its k best line items as lists."""
    items = nest_objects(table(spark, sf_dir, "lineitem"), "l_orderkey", item_features(), k)
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.col("o_orderpriority").alias("class_folder"),
        order_file().alias("file"),
        F.col("o_totalprice").alias("Sim_Total_MET"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_custkey") / 100.0).alias(
            "Sim_PrimaryVertex_Z"
        ),
    )
    # Both sides grow with the data, so neither is to be broadcast.
    return orders.join(
        items.hint("merge"), F.col("o_orderkey") == F.col("l_orderkey"), "left"
    ).drop("l_orderkey")


def order_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with only class and file."""
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.col("o_orderpriority").alias("class_folder"), order_file().alias("file")
    )


def word_events(documents: DataFrame) -> DataFrame:
    """One row per document; every word is an object."""
    words = F.split("text", " ")
    return documents.select(
        "doc_id",
        F.col("lang").alias("class_folder"),
        F.col("source").alias("file"),
        F.transform(words, lambda w: F.length(w).cast("double")).alias("Doc_Word_PT"),
        F.transform(words, lambda w: F.instr(w, "e").cast("double")).alias("Doc_Word_D0"),
        "n_chars",
    )


def logits() -> Column:
    """The logit of a class is the sum of every ``N_CLASSES``-th component from its own on."""
    sums = []
    for c in range(N_CLASSES):
        parts = [F.get("embedding", F.lit(i)).cast("double") for i in range(c, N_COMPONENTS, N_CLASSES)]
        sums.append(reduce(lambda a, b: a + b, parts))
    return F.array(*sums)


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", logits().alias("logits"))


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("run_name"), "ts", "event_id", F.col("value").alias("val_acc")
    )


def wide(df: DataFrame, width: int, keep: list[str], digits: int | None = None) -> DataFrame:
    """Vector ``x`` as plain columns x_00, x_01, ..."""

    def at(i: int) -> Column:
        value = F.get("x", F.lit(i))
        return F.round(value, digits) if digits is not None else value

    return df.select(*keep, *[at(i).alias(f"x_{i:02d}") for i in range(width)])
