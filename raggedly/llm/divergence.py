"""How far sources diverge in their words: exact values, ranked by cells of counts."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import split_words, spread_join, steps, stored

#: A term is a run of ASCII letters and anything above ASCII: of other bytes a space is made,
#: of capitals small letters.
BYTES = bytes(b | 32 if chr(b).isalpha() else 32 for b in range(128)) + bytes(range(128, 256))
LEAST_DOCUMENTS = 3
#: Ranks of terms that are returned; pairs have all theirs.
TERM_RANKS = 200
#: Text counted at once; the more, the fewer rows leave a task.
COUNT_BYTES = 32 << 20
#: Counts of a block of terms, on average; weights that are compared at once.
BLOCK_COUNTS, TABLE_CELLS = 1 << 18, 1 << 18


def source_divergence(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    least_documents: int = LEAST_DOCUMENTS,
    term_ranks: int = TERM_RANKS,
) -> DataFrame:
    """``lang, source, part, item, value, rank``: what sets a source of a language apart.

    The terms of a language are those in at least ``least_documents`` of its rows. In each
    (lang, source) group, and in each language as a whole, a term of count ``c`` has the
    weight ``p = 1 + floor(10**9 * (c + 1) / (N + V))`` with ``V`` terms that occur ``N``
    times. A term of weight ``p`` here and ``q`` there diverges by ``floor((p - q)**2 / q)``.
    Part ``pair`` sums that over all terms, for each other source of the language; part
    ``term`` compares with the language, for terms of the group with more weight there, up to
    rank ``term_ranks``. Ranks go by value, then by the bytes of the item.

    A weight depends on a count only, so terms are grouped by cells of counts: (here, in the
    language). The values of cells are merged and ranked by how many terms they stand for, and
    only cells above the last rank are looked up as terms again. Pairs sum over all terms, in
    blocks of terms. All numbers are whole numbers.

    Null text, language and source count as empty; an empty source is a source. Documents are
    rows: one that repeats counts again. A group without terms has weights too. A language
    without terms has pairs of value 0. No rows give no rows.
    """
    rows = docs.select(
        *[
            F.coalesce(docs[c].cast("string"), F.lit("")).alias(n)
            for n, c in {"lang": lang_col, "source": source_col, "text": text_col}.items()
        ]
    )
    counts = stored(_kept_terms(rows, least_documents), "kept-terms")
    groups = stored(_groups(rows, counts), "groups")
    pairs = _pair_values(counts, groups)
    terms = _term_values(counts, groups, term_ranks)
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(best))
    return pairs.withColumn("part", F.lit("pair")).unionByName(
        terms.withColumn("part", F.lit("term"))
    ).select("lang", "source", "part", "item", "value", "rank")


def weight(count: Column, total: Column, n_terms: Column) -> Column:
    """``1 + floor(10**9 * (count + 1) / (total + n_terms))``, three digits at a time, as the
    product need not fit into 64 bits."""
    whole, rest, out = total + n_terms, count + 1, F.lit(0).cast("long")
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + _div(rest, whole), rest % whole
    return out + 1


def divergence(p: Column, q: Column) -> Column:
    """At most 10**18, as weights are at most 10**9 + 1."""
    return _div((p - q) * (p - q), q)


def _div(a: Column, b: Column) -> Column:
    # Both are not negative, so the quotient without its fraction is the floor.
    return F.call_function("div", a, b)


def _kept_terms(rows: DataFrame, least: int) -> DataFrame:
    """``lang, term, source, n, n_lang, is_first``, one row per source that has the term.

    A term's rows meet in one task, in sorted order: one for each slice and source that has it.
    They are added up batch by batch, so no more of them are held than there are sources.
    """
    counted = rows.mapInArrow(_counted, "lang string, term string, source string, n long, d long")
    return (
        counted.repartition("lang", "term")
        .sortWithinPartitions("lang", "term")
        .mapInArrow(
            _added(least),
            "lang string, term string, source string, n long, n_lang long, is_first boolean",
        )
    )


def _added(least: int):
    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if batch.num_rows:
                rows = pa.Table.from_batches([batch])
                rows = _merged(rows if held is None else pa.concat_tables([held, rows]))
                # The last term may go on in the next batch.
                last = int(np.flatnonzero(rows["is_first"].to_numpy())[-1])
                held = rows.slice(last).select(batch.schema.names)
                yield from _frequent(rows.slice(0, last), least)
        if held is not None:
            yield from _frequent(_merged(held), least)

    return add


def _merged(rows: pa.Table) -> pa.Table:
    """One row for each source of a term, from rows that are sorted by language and term."""
    codes = {}
    for k in ("lang", "term", "source"):
        codes[k] = rows[k].combine_chunks().dictionary_encode()
    number = {k: c.indices.to_numpy(zero_copy_only=False).astype(np.int64) for k, c in codes.items()}
    starts = np.ones(rows.num_rows, bool)
    starts[1:] = (np.diff(number["lang"]) != 0) | (np.diff(number["term"]) != 0)
    group = np.cumsum(starts) - 1
    n_sources = len(codes["source"].dictionary)
    order = np.argsort(group * n_sources + number["source"], kind="stable")
    keys = (group * n_sources + number["source"])[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    out = rows.take(pa.array(order[first]))
    for k in ("n", "d"):
        sums = np.add.reduceat(rows[k].to_numpy()[order], first)
        out = out.set_column(out.schema.get_field_index(k), k, pa.array(sums))
    group = group[order[first]]
    return out.append_column(
        "is_first", pa.array(np.concatenate([[True], group[1:] != group[:-1]]))
    )


def _frequent(rows: pa.Table, least: int) -> Iterator[pa.RecordBatch]:
    """The terms in ``least`` rows of a language, with their counts there."""
    if not rows.num_rows:
        return
    first = np.flatnonzero(rows["is_first"].to_numpy())
    sizes = np.diff(np.append(first, rows.num_rows))
    stays = np.repeat(np.add.reduceat(rows["d"].to_numpy(), first) >= least, sizes)
    n_lang = np.repeat(np.add.reduceat(rows["n"].to_numpy(), first), sizes)
    rows = rows.drop_columns(["d"]).append_column("n_lang", pa.array(n_lang))
    names = ["lang", "term", "source", "n", "n_lang", "is_first"]
    yield from rows.select(names).filter(pa.array(stays)).combine_chunks().to_batches()


def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each term in each group of a slice of rows."""
    for batch in steps(batches, "text", COUNT_BYTES):
        # Lower-casing makes an array of its own, whose bytes are those of this slice only.
        lower = pc.ascii_lower(batch["text"])
        _, ends, data = lower.buffers()
        if not data:
            continue
        spaced = pa.py_buffer(data.to_pybytes().translate(BYTES))
        words, sizes = split_words(pa.StringArray.from_buffers(len(lower), ends, spaced))
        doc = np.repeat(np.arange(batch.num_rows), sizes)
        coded = words.dictionary_encode()
        if not len(coded):
            continue
        n_words = len(coded.dictionary)
        langs, sources = batch["lang"].dictionary_encode(), batch["source"].dictionary_encode()
        n_sources = len(sources.dictionary)
        group = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64) * n_sources
        group += sources.indices.to_numpy(zero_copy_only=False)
        held, n = np.unique(
            doc * n_words + coded.indices.to_numpy(zero_copy_only=False), return_counts=True
        )
        cell, at, d = np.unique(
            group[held // n_words] * n_words + held % n_words, return_inverse=True, return_counts=True
        )
        total = np.bincount(at, weights=n, minlength=len(cell)).astype(np.int64)
        group, term = cell // n_words, cell % n_words
        yield pa.RecordBatch.from_arrays(
            [
                langs.dictionary.take(pa.array(group // n_sources)),
                coded.dictionary.take(pa.array(term)),
                sources.dictionary.take(pa.array(group % n_sources)),
                pa.array(total),
                pa.array(d.astype(np.int64)),
            ],
            names=["lang", "term", "source", "n", "d"],
        )


def _groups(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """``lang, source, total, n_terms, lang_total``: how often terms occur here and in all.

    One row per source of a language: a catalogue, not the corpus.
    """
    all_groups = rows.groupBy("lang", "source").agg(F.lit(0).cast("long").alias("n"))
    totals = (
        all_groups.unionByName(counts.select("lang", "source", "n"))
        .groupBy("lang", "source")
        .agg(F.sum("n").alias("total"))
    )
    langs = counts.groupBy(F.col("lang").alias("_lang")).agg(
        F.count_if("is_first").alias("n_terms"), F.sum("n").alias("lang_total")
    )
    return totals.join(langs, F.col("lang") == F.col("_lang"), "left").select(
        "lang",
        "source",
        "total",
        F.coalesce("n_terms", F.lit(0).cast("long")).alias("n_terms"),
        F.coalesce("lang_total", F.lit(0).cast("long")).alias("lang_total"),
    )


def _pair_values(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """``lang, source, item, value`` for all ordered pairs of a language's sources.

    The terms of a language are dealt to blocks of about ``BLOCK_COUNTS`` counts. A block and
    the totals of the language's sources make a table of weights, terms by sources, whose
    columns are compared each with all; the sums of the blocks are added up. The result has
    a row per pair of sources, so a block's does not outgrow it.
    """
    blocks = -(-counts.count() // BLOCK_COUNTS) or 1
    dealt = counts.select(
        "lang", F.pmod(F.xxhash64("term"), F.lit(blocks)).alias("_block"), "term", "source", "n"
    )
    totals = groups.select(
        "lang",
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("_block"),
        "source",
        "total",
        "n_terms",
    )
    return (
        dealt.groupBy("lang", "_block")
        .cogroup(totals.groupBy("lang", "_block"))
        .applyInArrow(_block_sums, "lang string, source string, item string, value long")
        .groupBy("lang", "source", "item")
        .agg(F.sum("value").alias("value"))
    )


def _block_sums(counts: pa.Table, totals: pa.Table) -> pa.Table:
    """Sums over the terms of a block; all zero where it has none."""
    sources = totals["source"].combine_chunks()
    total = totals["total"].to_numpy()
    n_terms = totals["n_terms"].to_numpy()
    n = len(sources)
    sums = np.zeros((n, n), np.int64)
    if counts.num_rows:
        coded = counts["term"].combine_chunks().dictionary_encode()
        term = coded.indices.to_numpy(zero_copy_only=False)
        source = pc.index_in(counts["source"], sources).to_numpy()
        number = counts["n"].to_numpy()
        order = np.argsort(term, kind="stable")
        term, source, number = term[order], source[order], number[order]
        most = max(1, TABLE_CELLS // n)
        for first in range(0, len(coded.dictionary), most):
            a, b = np.searchsorted(term, [first, first + most])
            table = np.zeros((min(most, len(coded.dictionary) - first), n), np.int64)
            table[term[a:b] - first, source[a:b]] = number[a:b]
            p = _weights(table, total, n_terms)
            for i in range(n):
                q = p[:, i : i + 1]
                sums[:, i] += ((p - q) ** 2 // q).sum(axis=0)
    at, item = np.nonzero(~np.eye(n, dtype=bool))
    lang = pa.repeat(totals["lang"][0] if n else pa.scalar("", pa.string()), len(at))
    return pa.table(
        {
            "lang": lang,
            "source": sources.take(pa.array(at)),
            "item": sources.take(pa.array(item)),
            "value": pa.array(sums[at, item]),
        }
    )


def _weights(count: np.ndarray, total: np.ndarray, n_terms: np.ndarray) -> np.ndarray:
    """The same as ``weight``, for a table of counts."""
    whole, rest, out = total + n_terms, count + 1, np.zeros_like(count)
    for _ in range(3):
        digits, rest = np.divmod(rest * 1000, whole)
        out = out * 1000 + digits
    return out + 1


def _term_values(counts: DataFrame, groups: DataFrame, ranks: int) -> DataFrame:
    """``lang, source, item, value, rank`` of the terms that weigh more than in the language."""
    p = weight(F.col("n"), F.col("total"), F.col("n_terms"))
    q = weight(F.col("n_lang"), F.col("lang_total"), F.col("n_terms"))
    cells = stored(
        spread_join(
            counts.groupBy("lang", "source", "n", "n_lang").agg(F.count("*").alias("m")),
            groups,
            ["lang", "source"],
            F.xxhash64("n", "n_lang"),
        )
        .select("lang", "source", "n", "n_lang", "m", p.alias("_p"), q.alias("_q"))
        .where("_p > _q")
        .select("lang", "source", "n", "n_lang", "m", divergence(F.col("_p"), F.col("_q")).alias("value")),
        "cells",
    )
    # Each value stands for one term at least, so the first ``ranks`` values suffice.
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"))
    levels = (
        cells.groupBy("lang", "source", "value")
        .agg(F.sum("m").alias("m"))
        .withColumn("_at", F.row_number().over(by_value))
        .where(F.col("_at") <= ranks)
        .withColumn("_before", F.sum("m").over(by_value.rowsBetween(Window.unboundedPreceding, -1)))
        .where(F.coalesce("_before", F.lit(0)) < ranks)
        .groupBy(F.col("lang").alias("_lang"), F.col("source").alias("_source"))
        .agg(F.min("value").alias("_least"))
    )
    above = cells.join(
        levels, (F.col("lang") == F.col("_lang")) & (F.col("source") == F.col("_source"))
    ).where("value >= _least")
    chosen = spread_join(
        counts,
        above.select("lang", "source", "n", "n_lang", "value"),
        ["lang", "source", "n", "n_lang"],
        F.xxhash64("term"),
    )
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return (
        chosen.select("lang", "source", F.col("term").alias("item"), "value")
        .withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= ranks)
    )
