"""A training corpus from documents: graded, without repeated lines and near copies, mixed
to source weights, and packed into sequences.

Each stage takes (spark, docs, sf_dir) and works on every row its predecessor kept. All but
the last return the columns of ``documents``; ``n_chars`` follows the text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from raggedly.llm.lines import drop_repeated_lines
from raggedly.llm.mixing import mix, word_count
from raggedly.llm.near import near_duplicates
from raggedly.llm.packing import pack_documents
from raggedly.llm.quality import grade_documents
from raggedly.llm.queries import quality_model, table
from raggedly.llm.tables import NO_ID, SPACE, stored


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose grade is likely the highest; low quality and toxic ones go."""
    model = quality_model(docs, table(spark, sf_dir, "labels"))
    whole = F.struct(*[docs[c] for c in docs.columns])
    return grade_documents(docs, model, keep=whole).where("kept").select("carried.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later occurrences of three-line windows.

    A document of which nothing but white space is left goes, as a copy of earlier ones.
    """
    whole = F.struct(*[docs[c] for c in docs.columns])
    cut = drop_repeated_lines(docs, keep=whole)
    gone = (F.col("n_removed") > 0) & F.col("kept").rlike(f"^{SPACE}*$")
    changed = F.col("n_removed") > 0
    return cut.where(~gone).select(
        *[_replaced(c, F.col("carried")[c], F.col("kept"), changed) for c in docs.columns]
    )


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id.

    Rows are told apart by a number of their own: rows that share an id (or have none) go
    only when their texts are linked. A null id is the largest; among rows of one id a hash
    of the whole row decides, so the same rows always leave the same ones.
    """
    rows = stored(docs.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    groups = near_duplicates(rows, "_row").select(F.col("doc_id").alias("_of"), "component_id")
    order = F.struct(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), F.xxhash64(*docs.columns), "_row"
    )
    kept = (
        rows.select("_row", order.alias("_order"))
        .join(groups, F.col("_row") == F.col("_of"))
        .groupBy("component_id")
        .agg(F.min("_order")["_row"].alias("_kept"))
    )
    return rows.join(kept, F.col("_row") == F.col("_kept"), "left_semi").select(docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; at a source's cut, the first words of one."""
    # Rows without an id get a hash in its place there, so that they do not all have one key.
    rows = docs.withColumn("_mix_id", F.coalesce(docs["doc_id"].cast("long"), F.xxhash64(*docs.columns)))
    whole = F.struct(*[rows[c] for c in docs.columns]).alias("carried")
    taken = mix(rows, word_count(rows["text"]), id_col="_mix_id", carry=[whole]).where("taken > 0")
    parts = F.concat(
        F.array_repeat(F.lit(-1).cast("long"), F.floor(F.col("taken") / F.col("size")).cast("int")),
        F.filter(F.array(F.col("taken") % F.col("size")), lambda n: n > 0),
    )
    words = F.split(F.regexp_replace("carried.text", f"^{SPACE}+", ""), f"{SPACE}+")
    cut = F.array_join(F.slice(words, 1, F.col("_part").cast("int")), " ")
    return taken.select("carried", F.explode(parts).alias("_part")).select(
        *[_replaced(c, F.col("carried")[c], cut, F.col("_part") > 0) for c in docs.columns]
    )


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document stands in which sequence."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), end=0)


def _replaced(name: str, value, text, where):
    new = {"text": text, "n_chars": F.char_length(text).cast("long")}.get(name)
    return (value if new is None else F.when(where, new).otherwise(value)).alias(name)


STAGES = [
    ("quality classifier", quality),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", near_dedup),
    ("mixing to target weights", mixing),
    ("best-fit packing", packing),
]

#: SQL has neither the classifier nor the tokenizer; tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-").lower())
    return STAGES[-1][1](spark, docs, sf_dir)
