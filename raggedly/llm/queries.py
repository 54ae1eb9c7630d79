"""Registered queries of the corpus operators, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .alignment import align_tokens
from .codes import read_documents, write_codes
from .divergence import source_divergence
from .exact import exact_duplicates
from .html import extract_main_text
from .lines import drop_repeated_lines
from .mixing import mix, word_count
from .near import near_duplicates
from .packing import pack_documents
from .quality import Model, grade_documents, train
from .secrets import scan_secrets, span_text
from .substrings import drop_repeated_passages
from .tables import fresh_folder
from .topk import top_products

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source is an owner; its documents of one language are a repository."""
    docs = table(spark, sf_dir, "documents")
    found = scan_secrets(docs, owner=docs["source"], repository=docs["lang"])
    base = F.filter("spans", lambda s: s["kind"] < 3)

    def number(kind: int):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "doc_id",
        number(0).alias("n_assign"),
        number(1).alias("n_access"),
        number(2).alias("n_hex"),
        F.sha2(span_text(base), 256).alias("base_sha256"),
        span_text(F.col("spans")).alias("spans"),
        number(3).alias("n_live"),
        F.size(F.filter("candidates", lambda c: c["copied"])).cast("long").alias("n_copied"),
    )


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_repeated_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP2_SQL = """
WITH d AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), w AS (
  SELECT doc_id, i, lines[i] || chr(10) || lines[i + 1] || chr(10) || lines[i + 2] AS h
  FROM (SELECT doc_id, lines, unnest(range(1, len(lines) - 1)) AS i FROM d)
), later AS (
  SELECT doc_id, i FROM w QUALIFY row_number() OVER (PARTITION BY h ORDER BY doc_id, i) > 1
), gone AS (
  SELECT doc_id, list_distinct(flatten(list([i, i + 1, i + 2]))) AS hit
  FROM later GROUP BY doc_id
), cut AS (
  SELECT d.doc_id, lines, coalesce(gone.hit, []) AS away FROM d LEFT JOIN gone USING (doc_id)
)
SELECT doc_id, len(lines) AS n_lines, len(away) AS n_removed,
  sha256(array_to_string([lines[i] FOR i IN range(1, len(lines) + 1)
    IF NOT list_contains(away, i)], chr(10))) AS kept_sha256
FROM cut
"""


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeated_passages(table(spark, sf_dir, "documents"), with_text=False)


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), w AS (
  SELECT doc_id, i, md5(array_to_string(words[i:i + 19], ' ')) AS h
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS i FROM d)
), later AS (
  SELECT doc_id, i FROM w QUALIFY row_number() OVER (PARTITION BY h ORDER BY doc_id, i) > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM later
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept, count(*) AS n_kept
  FROM (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM d)
  ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
)
SELECT doc_id, len(words) AS n_words, len(words) - coalesce(n_kept, 0) AS n_removed,
  sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""


def quality_model(docs: DataFrame, labels: DataFrame) -> Model:
    """Grade 0: low quality, 1: toxic, 2: neither."""
    known = F.col("quality").isNotNull() & F.col("toxic").isNotNull()
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).otherwise(2)
    return train(docs, labels, F.when(known, grade), n_grades=3)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its grade; probabilities to 4 places, as sums differ in the last."""
    docs = table(spark, sf_dir, "documents")
    graded = grade_documents(docs, quality_model(docs, table(spark, sf_dir, "labels")))
    return graded.select(
        "doc_id", F.round("expected_grade", 4).alias("expected_grade"), F.round("tail", 4).alias("tail"), "kept"
    )


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mix(docs, word_count(docs["text"])).drop("source")


def op6_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_folder(spark, "token-codes")
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    write_codes(table(spark, sf_dir, "documents"), path, tokenizer, end=2)
    return read_documents(spark, path)


def op7_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer, end=0)


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=2, percent=80)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
    sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS s
  FROM documents
), b AS (
  SELECT doc_id, s AS text_sha256, count(*) OVER (PARTITION BY s) AS group_size,
    first(doc_id) OVER (PARTITION BY s ORDER BY length(t) DESC, doc_id) AS keep_id FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM b
"""

def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_products(table(spark, sf_dir, "embeddings"), F.col("_id") % 50 == 0)


OP10_SQL = """
WITH v AS (
  SELECT vec_id, [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = len(embedding)
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum([a[1] * a[2] FOR a IN list_zip(q.v, c.v)])::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0
)
SELECT query_id, row_number() OVER w AS rank, vec_id, score FROM s
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= 5
"""


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents
), w AS (
  SELECT lang, source, r, term, count(*) AS n FROM (
    SELECT lang, source, r,
      unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
  ) GROUP BY ALL
), terms AS (
  SELECT lang, term, sum(n)::HUGEINT AS n FROM w GROUP BY lang, term HAVING count(*) >= 3
), counts AS (
  SELECT lang, source, term, sum(w.n)::HUGEINT AS n
  FROM w SEMI JOIN terms USING (lang, term) GROUP BY ALL
), groups AS (
  SELECT lang, source, coalesce(total, 0)::HUGEINT AS total
  FROM (SELECT DISTINCT lang, source FROM d)
  LEFT JOIN (SELECT lang, source, sum(n) AS total FROM counts GROUP BY ALL) USING (lang, source)
), langs AS (
  SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM terms GROUP BY lang
), weights AS (
  SELECT g.lang, g.source, t.term, coalesce(c.n, 0) AS n,
    1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (g.total + l.v) AS p
  FROM groups g JOIN langs l USING (lang) JOIN terms t USING (lang)
  LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = t.term
), whole AS (
  SELECT lang, term, 1 + (1000000000::HUGEINT * (t.n + 1)) // (l.total + l.v) AS q
  FROM terms t JOIN langs l USING (lang)
), pair_sums AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
  FROM weights a JOIN weights b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
  GROUP BY ALL
), out AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pair_sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q)) // q
  FROM weights JOIN whole USING (lang, term) WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value::BIGINT AS value,
  (row_number() OVER w)::INT AS rank
FROM out
WINDOW w AS (PARTITION BY lang, source, part ORDER BY value DESC, item)
QUALIFY part = 'pair' OR row_number() OVER w <= 200
"""


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokens(
        table(spark, sf_dir, "documents"),
        public_tokenizers.path("byte_bpe_50k.json"),
        public_tokenizers.path("piece_bpe_32k.model"),
    )


def op13_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Query] = {
    "op1_secrets": op1_secrets,
    "op2_line_dedup": op2_line_dedup,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_quality": op4_quality,
    "op5_mixing": op5_mixing,
    "op6_token_codes": op6_token_codes,
    "op7_best_fit": op7_best_fit,
    "op8_near_dedup": op8_near_dedup,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_topk": op10_topk,
    "op11_divergence": op11_divergence,
    "op12_alignment": op12_alignment,
    "op13_html": op13_html,
}
ORACLES: dict[str, str] = {
    "op2_line_dedup": OP2_SQL,
    "op3_substring_dedup": OP3_SQL,
    "op9_exact_dedup": OP9_SQL,
    "op10_topk": OP10_SQL,
    "op11_divergence": OP11_SQL,
}
