"""Quality rules (op 8): cross-document line frequency.

A line that stands in very many distinct documents of one host is boilerplate
(navigation, licence, consent notices).  Lines are normalised (lower case,
white space folded) and hashed; for each host the documents that hold a
line are counted, one per distinct text, so a copied document does not make its
own lines look like boilerplate.  Lines above the limit are removed and a
document that loses too much of itself is rejected.

Plan: the base counts are one Arrow pass over the text; lines are split,
normalised and hashed by Spark SQL.  Counting is two hash aggregations on
(host, line), pre-aggregated on the map side, so a line that a third of all
documents share costs one partial row per map task.  The frequent lines are
written to the shared scratch folder and read back: their measured size decides
how they join.

Edge cases: null or blank text has zero counts, fails the base rule (fewer than
``min_words`` words) and is not kept; a null host is a host of its own; repeated
rows are judged alike and stay; an empty table gives an empty result; columns
other than doc_id, text and the host column are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.llm.textops import CODEPOINT_START, SYMBOL, ByteHasher, segment_sums, text_slices, word_windows
from keelson.session import scratch_path

__all__ = ["base_counts", "document_lines", "frequent_lines", "judge_documents", "clean_documents"]

MIN_WORDS = 10          # fewer words: the base rule fails
REPEAT_PERCENT = 20     # more than this share of words in repeated 5-word windows: the base rule fails
WINDOW = 5
MIN_DOCS = 20           # a line is never frequent with this many documents or fewer
HOST_SHARE = 0.05       # ... nor with at most this share of its host's documents
MAX_REMOVED = 0.5       # a document that loses more than this share of its words is depleted
_NO_HOST = "\x00"

BASE_SCHEMA = ("doc_id long, host string, sig long, n_words long, word_chars long, n_symbols long, "
               "n_dup_lines long, n_repeat_words long")


def _later_equal(doc: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Per row: does an equal (doc, key) come earlier?  Rows are in order."""
    order = np.lexsort((np.arange(len(key)), key, doc))
    d, k = doc[order], key[order]
    same = np.zeros(len(key), dtype=bool)
    same[1:] = (d[1:] == d[:-1]) & (k[1:] == k[:-1])
    out = np.zeros(len(key), dtype=bool)
    out[order] = same
    return out


def _repeated(doc: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Per row: does an equal (doc, key) stand anywhere else?"""
    order = np.lexsort((key, doc))
    d, k = doc[order], key[order]
    same = (d[1:] == d[:-1]) & (k[1:] == k[:-1])
    flag = np.zeros(len(key), dtype=bool)
    flag[1:] |= same
    flag[:-1] |= same
    out = np.zeros(len(key), dtype=bool)
    out[order] = flag
    return out


def _base_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, text in text_slices(batch):
            w = text.words()
            inside = w.inside
            start, end, line_doc = text.lines()
            has_word = np.searchsorted(w.start, end, "left") > np.searchsorted(w.start, start, "left")
            start, end, line_doc = start[has_word], end[has_word], line_doc[has_word]
            line_hash = ByteHasher(text.data).ranges(start, end)
            dup = np.bincount(line_doc[_later_equal(line_doc, line_hash)], minlength=len(text))
            h, at = word_windows(w.hash, w.doc, WINDOW)
            covered = np.zeros(len(w) + 1, dtype=np.int64)
            hit = at[_repeated(w.doc[at], h)]
            np.add.at(covered, hit, 1)
            np.add.at(covered, hit + WINDOW, -1)
            repeat = segment_sums((np.cumsum(covered)[:-1] > 0).astype(np.int64), w.first)
            cols = [w.count, text.per_doc(inside & CODEPOINT_START[text.data]),
                    text.per_doc(SYMBOL[text.data]), dup, repeat]
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), rows.column(2), rows.column(3)]
                + [pa.array(np.asarray(c, dtype=np.int64)) for c in cols],
                names=["doc_id", "host", "sig", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                       "n_repeat_words"])


def _input(docs: DataFrame, host_col: str) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
        F.coalesce(F.col(f"`{host_col}`").cast("string"), F.lit(_NO_HOST)).alias("host"),
        F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("sig"))


def _normalised(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(line), r"[ \t\n\x0B\f\r]+", " "))


def base_counts(docs: DataFrame, host_col: str = "source") -> DataFrame:
    """doc_id, host, sig (hash of the text), n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words: one row per input row."""
    return _input(docs, host_col).mapInArrow(_base_batches, BASE_SCHEMA)


def document_lines(docs: DataFrame, host_col: str = "source") -> DataFrame:
    """doc_id, host, sig, pos, line (hash of the normalised line), words: one row per
    line that holds a word."""
    lines = _input(docs, host_col).select("doc_id", "host", "sig", F.posexplode(F.split("text", "\n", -1)).alias("pos", "raw"))
    return (lines.select("doc_id", "host", "sig", "pos", _normalised(F.col("raw")).alias("norm"))
            .where(F.col("norm") != "")
            .select("doc_id", "host", "sig", "pos", F.xxhash64("norm").alias("line"),
                    F.size(F.split("norm", " ")).cast("long").alias("words")))


def frequent_lines(lines: DataFrame, min_docs: int = MIN_DOCS, host_share: float = HOST_SHARE) -> DataFrame:
    """(host, line, n_docs) of lines above the limit of their host:
    ``n_docs > max(min_docs, host_share * documents of the host)``, both
    counted over distinct texts."""
    per_line = (lines.groupBy("host", "line", "sig").agg(F.lit(1).alias("one"))
                .groupBy("host", "line").agg(F.count(F.lit(1)).alias("n_docs"))
                .where(F.col("n_docs") > min_docs))
    per_host = (lines.groupBy("host", "sig").agg(F.lit(1).alias("one"))
                .groupBy("host").agg(F.count(F.lit(1)).alias("host_docs")))
    return (per_line.join(per_host, "host")
            .where(F.col("n_docs") > F.lit(host_share) * F.col("host_docs")).select("host", "line", "n_docs"))


def _base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def judge_documents(docs: DataFrame, host_col: str = "source", min_docs: int = MIN_DOCS,
                    host_share: float = HOST_SHARE, max_removed: float = MAX_REMOVED) -> DataFrame:
    """One row per input row: host, sig, base counts, ``base_failed``,
    ``removed_lines`` (hashes of its frequent lines), ``n_removed_words`` and
    ``kept``."""
    spark = docs.sparkSession
    folder = scratch_path(spark, "quality")
    document_lines(docs, host_col).write.parquet(f"{folder}/lines")
    lines = spark.read.parquet(f"{folder}/lines")
    frequent_lines(lines, min_docs, host_share).write.parquet(f"{folder}/frequent")
    frequent = spark.read.parquet(f"{folder}/frequent")
    base = base_counts(docs, host_col)
    removed = (lines.join(frequent, ["host", "line"])
               .groupBy("doc_id", "host", "sig", "pos")  # repeated rows hold each line once
               .agg(F.first("words").alias("words"), F.first("line").alias("line"))
               .groupBy("doc_id", "host", "sig")
               .agg(F.sum("words").alias("words"), F.collect_set("line").alias("lines")))
    b, r = base.alias("b"), removed.alias("r")
    joined = b.join(r, F.col("b.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("b.host") == F.col("r.host"))
                    & (F.col("b.sig") == F.col("r.sig")), "left")
    gone = F.coalesce(F.col("r.words"), F.lit(0)).cast("long")
    return (joined.select("b.*", F.col("r.lines").alias("removed_lines"), gone.alias("n_removed_words"))
            .withColumn("base_failed", _base_failed())
            .withColumn("kept", ~F.col("base_failed") & (F.col("n_removed_words") <= max_removed * F.col("n_words"))))


def clean_documents(docs: DataFrame, host_col: str = "source", **limits) -> DataFrame:
    """The kept documents with all their columns; frequent lines are cut out of
    ``text`` (``n_chars``, where present, is counted anew)."""
    verdict = (judge_documents(docs, host_col, **limits).where("kept")
               .groupBy("doc_id", "host", "sig").agg(F.first("removed_lines").alias("lines"))
               .select(F.col("doc_id").alias("id"), "host", "sig", "lines").alias("v"))
    d = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"),
                    F.coalesce(F.col(f"`{host_col}`").cast("string"), F.lit(_NO_HOST)).alias("host"),
                    F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("sig")).alias("d")
    both = d.join(verdict, F.col("d.id").eqNullSafe(F.col("v.id")) & (F.col("d.host") == F.col("v.host"))
                  & (F.col("d.sig") == F.col("v.sig")))
    text = F.col("row.text").cast("string")
    cut = F.when(F.col("lines").isNull(), text).otherwise(F.array_join(
        F.filter(F.split(text, "\n", -1), lambda x: ~F.array_contains("lines", F.xxhash64(_normalised(x)))), "\n"))
    out = both.select(F.col("d.row").alias("row"), cut.alias("text"))
    return out.select(*[
        F.col("text") if c == "text" else
        (F.length("text").cast(t).alias(c) if c == "n_chars" else F.col(f"row.`{c}`").alias(c))
        for c, t in docs.dtypes])
