"""Secrets in texts, weighed by how many owners a credential has in the whole corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import corpus, given_id, stored

# The patterns of the base kinds, and the least code points of what counts
# (of group 2 for an assignment, else of the match).
ASSIGN = (
    r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?"
    r"([A-Za-z0-9+/_.=-]+)"
)
ASSIGN_LEAST = 6
# A match of these two is a whole run, so the least length can stand in the pattern.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"

#: A further candidate: a long run that mixes letters of both cases and digits.
OPAQUE = r"[A-Za-z0-9+/_-]{20,}"
#: Parts of values that people write in examples.
EXAMPLES = r"(?i)example|changeme|placeholder|dummy|sample|redacted|your[_-]|xxxx|\*\*\*|test"
#: Different characters that a live-looking value has at least.
LEAST_CHARACTERS = 6

KINDS = ("assign", "access", "hex", "live")


def scan_secrets(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    owner: Column | None = None,
    repository: Column | None = None,
) -> DataFrame:
    """One row per input row with the spans of its secrets, in code points, end exclusive.

    ``doc_id``, ``spans``: array of struct(start, kind, end) by start, then kind
    (positions in ``KINDS``), and ``candidates``: array of struct(start, end, sha256,
    n_uses, n_repositories, n_owners, copied, live).

    Candidates are the values of the base kinds (the assigned value, or the match) and
    opaque runs. The hashes of all candidates of the corpus are aggregated by repository,
    then owner, then alone, so no hash is gathered anywhere, however often it is copied. A
    value in use by two or more owners is ``copied``: an example or default that many
    share. A value of one owner that looks live (varied, with a digit, no example word) is
    ``live`` and adds a span of that kind; it covers the value only. Base spans always stay.

    ``owner`` and ``repository`` default to nothing known: one owner for all. A null owner
    is an owner of its own; repositories count within their owner. Null text counts as
    empty and has no span. Rows that repeat an id are rows of their own. No rows give none.
    """
    text, none = F.col("_text"), F.lit(None).cast("string")
    rows = (
        corpus(
            docs,
            id_col,
            text_col,
            _owner=none if owner is None else owner,
            _repository=none if repository is None else repository,
        )
        .select(
            F.monotonically_increasing_id().alias("_row"),
            "_id",
            "_owner",
            "_repository",
            F.concat(
                _matches(text, ASSIGN, 0, group=2),
                _matches(text, ACCESS, 1),
                _matches(text, HEX, 2),
                _matches(text, OPAQUE, 3),
            ).alias("_found"),
        )
    )
    rows = stored(rows, "secret-rows")  # row numbers hold from here on
    found = stored(_placed(rows), "secret-candidates")
    owned = (
        found.groupBy("_sha", "_owner", "_repository")
        .agg(F.count("*").alias("_n"))
        .groupBy("_sha", "_owner")
        .agg(F.sum("_n").alias("_n"), F.count("*").alias("_r"))
        .groupBy("_sha")
        .agg(
            F.sum("_n").alias("n_uses"),
            F.sum("_r").alias("n_repositories"),
            F.count("*").alias("n_owners"),
        )
        .withColumnRenamed("_sha", "_of")
    )
    judged = found.join(owned, F.col("_sha") == F.col("_of")).withColumns(
        {
            "_copied": F.col("n_owners") > 1,
            "_is_live": (F.col("n_owners") == 1) & F.col("_looks_live"),
        }
    )
    base = F.when(F.col("_kind") < 3, F.struct("start", F.col("_kind").alias("kind"), "end"))
    live = F.when(
        F.col("_is_live"), F.struct(F.col("from").alias("start"), F.lit(3).alias("kind"), "end")
    )
    per_row = judged.groupBy("_row").agg(
        F.sort_array(
            F.concat(F.collect_list(base), F.array_distinct(F.collect_list(live)))
        ).alias("_spans"),
        F.sort_array(
            F.collect_list(
                F.struct(
                    F.col("from").alias("start"),
                    "end",
                    F.col("_sha").alias("sha256"),
                    "n_uses",
                    "n_repositories",
                    "n_owners",
                    F.col("_copied").alias("copied"),
                    F.col("_is_live").alias("live"),
                )
            )
        ).alias("_candidates"),
    )
    empty = F.array()
    return (
        rows.select("_row", "_id")
        .join(per_row.withColumnRenamed("_row", "_of_row"), F.col("_row") == F.col("_of_row"), "left")
        .select(
            given_id().alias("doc_id"),
            F.coalesce("_spans", empty).alias("spans"),
            F.coalesce("_candidates", empty).alias("candidates"),
        )
    )


def span_text(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(
            spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])
        ),
        ",",
    )


def _matches(text: Column, pattern: str, kind: int, group: int = 0) -> Column:
    """All matches of a text, each with the length of the gap before it. Few texts have any."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gaps = F.split(text, pattern, -1)
    found = F.transform(
        F.arrays_zip(whole.alias("whole"), value.alias("value"), gaps.alias("gap")),
        lambda m: F.struct(
            F.lit(kind).alias("kind"),
            F.length(m["gap"]).alias("gap"),
            F.length(m["whole"]).alias("long"),
            m["value"].alias("value"),
        ),
    )
    kept = F.filter(found, lambda m: m["value"].isNotNull())  # the gap after the last match
    return F.when(text.rlike(pattern), kept).otherwise(F.slice(kept, 1, 0))


def _placed(rows: DataFrame) -> DataFrame:
    """One row per candidate, with its place in the text."""
    value = F.col("m.value")
    upto = (
        Window.partitionBy("_row", "m.kind")
        .orderBy("_pos")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    found = (
        rows.where(F.size("_found") > 0)
        .select("_row", "_owner", "_repository", F.posexplode("_found").alias("_pos", "m"))
        .withColumn("end", F.sum(F.col("m.gap") + F.col("m.long")).over(upto).cast("long"))
    )
    mixed = value.rlike("[a-z]") & value.rlike("[A-Z]") & value.rlike("[0-9]")
    counts = (
        F.when(F.col("m.kind") == 0, F.length(value) >= ASSIGN_LEAST)
        .when(F.col("m.kind") == 3, mixed)
        .otherwise(True)
    )
    varied = F.size(F.array_distinct(F.split(value, ""))) >= LEAST_CHARACTERS
    return found.where(counts).select(
        "_row",
        "_owner",
        "_repository",
        F.col("m.kind").alias("_kind"),
        (F.col("end") - F.col("m.long")).alias("start"),
        (F.col("end") - F.length(value)).alias("from"),
        "end",
        F.sha2(value, 256).alias("_sha"),
        (varied & value.rlike("[0-9]") & ~value.rlike(EXAMPLES)).alias("_looks_live"),
    )
