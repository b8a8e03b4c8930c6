"""Spelling variant grouping (op 12): blocked Gram matrices of letter counts.

Two words are near if one insertion, deletion or replacement of a code point
turns one into the other.  Their letter-count vectors then lie at squared
distance 1 or 2, and one half of the shorter word stands unchanged at the same
end of both.  So words are put into blocks by (shorter length, end, unchanged
half): a block holds words of one length and of the next.  In a block the NumPy
product of its letter-count matrices gives all squared distances at once; pairs
at most two apart are kept and their edit is verified letter by letter.

Plan: tokens are split, edited and counted by Spark SQL (partial counts on the
map side, so a word that a third of all text repeats costs one partial row per
task).  A word enters four blocks.  Block sizes are counted first and a large
block is cut into k chunks by a hash; chunk i meets chunk j in the unit (block,
i, j), so no task holds a whole block and no pair of words leaves a unit: a unit
returns, per word, how many near words it met and the best of them, which an
ordinary aggregation adds up.  Forms are followed to their roots by doubling; a
form has ten times the occurrences of its word, so the steps are few.

Edge cases: null text has no words, an empty table no rows; a null doc_id is the
empty string in the hash that picks the deleted letter; repeated rows count
again; columns other than doc_id and text are ignored; very long runs get chunks
of fewer words; of near words with equal counts the smallest in code-point order
is the form.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.llm.textops import pad_documents
from keelson.session import scratch_path

__all__ = ["count_words", "near_words", "follow_forms", "spelling_variants"]

MIN_LENGTH = 7        # shorter words are no candidates
MIN_COUNT = 2
DROP_EVERY = 31       # a run whose hash this divides loses one letter
FORM_FACTOR = 10      # a form is this many times as frequent
CHUNK_WORDS = 2048    # of a side of a unit
CHUNK_LETTERS = 1 << 15
RUN = r"([A-Za-zÀ-ÿ]+)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

UNIT_SCHEMA = "word string, n_near long, best_n long, best string"


def _edited(doc_id: Column, run: Column) -> Column:
    h = F.crc32(F.encode(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run), "UTF-8"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % DROP_EVERY == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def count_words(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n): lower-cased runs of letters after the seeded deletions, with
    at least ``min_length`` code points and ``min_count`` occurrences."""
    runs = (pad_documents(docs).select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(RUN), 1)).alias("raw"))
            .where(F.length("raw") >= min_length)
            .select("doc_id", F.translate("raw", UPPER, LOWER).alias("run")))
    words = runs.select(_edited(F.col("doc_id"), F.col("run")).alias("word")).where(F.length("word") >= min_length)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)


def _entries(words: DataFrame) -> DataFrame:
    """Each word in its four blocks: as the shorter word (own length) and as
    the longer one (length - 1), by either end."""
    size = F.length("word")

    def ends(short: Column, longer: bool) -> list[Column]:
        half = F.floor(short / 2).cast("int")
        rest = short - half
        return [F.struct(short.alias("short"), F.lit(side).alias("side"), part.alias("half"), F.lit(longer).alias("longer"))
                for side, part in (("head", F.substring("word", F.lit(1), half)),
                                   ("tail", F.substring("word", size - rest + 1, rest)))]

    return (words.select("word", "n", F.explode(F.array(*ends(size, False), *ends(size - 1, True))).alias("b"))
            .select("b.short", "b.side", "b.half", "b.longer", "word", "n"))


def _letter_counts(codes: np.ndarray, letters: np.ndarray) -> np.ndarray:
    row, at = np.nonzero(codes)
    cell = row * len(letters) + np.searchsorted(letters, codes[row, at])
    counts = np.bincount(cell, minlength=len(codes) * len(letters)).reshape(len(codes), len(letters))
    # products of counts stay exact: 24 bits hold them up to words of 4,000 letters
    return counts.astype(np.float32 if codes.shape[1] < 4000 else np.float64)


def _one_replaced(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a != b).sum(axis=1) == 1


def _one_inserted(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Rows of ``b``, one letter longer, that become ``a`` by deleting one."""
    size = a.shape[1]
    head = np.cumprod(a == b[:, :size], axis=1).sum(axis=1)
    tail = np.cumprod((a == b[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return head + tail >= size


class _Unit:
    """Rows (words of the shorter length) against columns of one block."""

    def __init__(self, short: int, side: str, same: bool, row: np.ndarray, longer: np.ndarray, word: list[str], n: np.ndarray):
        self.short, self.side = short, side
        self.word, self.n = np.array(word, dtype=object), n
        codes = np.array(word, dtype=f"U{short + 1}").view(np.uint32).reshape(len(word), short + 1)
        self.rows = np.flatnonzero(row)
        self.codes, self.longer, self.row, self.same = codes, longer, row, same

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """(row word, column word) of every near pair of the unit."""
        letters = np.unique(self.codes[self.codes != 0])
        counts = _letter_counts(self.codes, letters)
        norm = (counts ** 2).sum(axis=1)
        found = []
        # the columns: longer words, and words of the same length (of the other
        # chunk, or of the same one behind the row)
        columns = np.arange(len(self.word)) if self.same else np.flatnonzero(~self.row)
        step = max(1, (1 << 21) // max(1, len(columns)))
        for lo in range(0, len(self.rows), step):
            rows = self.rows[lo:lo + step]
            gap = norm[rows][:, None] + norm[columns][None, :] - 2.0 * (counts[rows] @ counts[columns].T)
            r, c = np.nonzero(gap <= 2.5)
            r, c = rows[r], columns[c]
            if self.same:
                ahead = self.longer[c] | (c > r)
                r, c = r[ahead], c[ahead]
            for at in range(0, len(r), 1 << 17):
                found.append(self._verified(r[at:at + (1 << 17)], c[at:at + (1 << 17)]))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])

    def _verified(self, r: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b, longer = self.codes[r][:, :self.short], self.codes[c], self.longer[c]
        near = np.zeros(len(r), dtype=bool)
        near[~longer] = _one_replaced(a[~longer], b[~longer][:, :self.short])
        near[longer] = _one_inserted(a[longer], b[longer])
        if self.side == "tail":  # both halves unchanged: the block by heads has it
            near &= ~(longer & (a[:, :self.short // 2] == b[:, :self.short // 2]).all(axis=1))
        return r[near], c[near]


def _unit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per (unit, word with a near word)."""
    for batch in batches:
        names, out = batch.schema.names, []
        col = {k: batch.column(names.index(k)) for k in names}
        for k in range(batch.num_rows):
            members = col["members"][k].values
            word, n, row, longer = (members.field(f) for f in ("word", "n", "row", "longer"))
            n = np.asarray(n)
            unit = _Unit(col["short"][k].as_py(), col["side"][k].as_py(), col["i"][k].as_py() == col["j"][k].as_py(),
                         np.asarray(row.to_numpy(zero_copy_only=False), bool), np.asarray(longer.to_numpy(zero_copy_only=False), bool),
                         word.to_pylist(), n)
            r, c = unit.pairs()
            if not len(r):
                continue
            own, other = np.concatenate([r, c]), np.concatenate([c, r])
            rank = np.empty(len(n), dtype=np.int64)          # best first: most occurrences, then the smallest word
            rank[np.lexsort((np.argsort(np.argsort(unit.word.astype(str))), -n))] = np.arange(len(n))
            order = np.lexsort((rank[other], own))
            own, other = own[order], other[order]
            first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            size = np.diff(np.concatenate([first, [len(own)]]))
            out.append((unit.word[own[first]], size, n[other[first]], unit.word[other[first]]))
        if out:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([o[0] for o in out]), pa.string()), pa.array(np.concatenate([o[1] for o in out]), pa.int64()),
                 pa.array(np.concatenate([o[2] for o in out]), pa.int64()), pa.array(np.concatenate([o[3] for o in out]), pa.string())],
                names=["word", "n_near", "best_n", "best"])


def near_words(words: DataFrame, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """(word, n_near, best_n, best) of every word of ``words`` (word, n; distinct)
    that has a near word: how many, and the most frequent of them."""
    spark = words.sparkSession
    key = ["short", "side", "half"]
    entries = _entries(words)
    # words a chunk may hold: fewer of very long ones
    room = F.greatest(F.lit(1), F.least(F.lit(chunk_words), F.lit(CHUNK_LETTERS) / F.col("short")))
    sizes = (entries.groupBy(*key).agg(F.count_if(~F.col("longer")).alias("a"), F.count_if("longer").alias("b"))
             .where((F.col("a") > 0) & (F.col("a") + F.col("b") > 1))
             .select(*key, F.ceil(F.greatest("a", "b") / room).cast("int").alias("k")))
    chunked = (entries.join(sizes, key)
               .withColumn("chunk", F.pmod(F.xxhash64("word"), F.col("k")).cast("int")))
    grid = F.sequence(F.lit(0), F.col("k") - 1)
    # chunk i gives the rows of the units (i, *), chunk j the columns of (*, j); words
    # of the same length meet once, in the unit with i <= j
    as_row = F.transform(grid, lambda j: F.struct(F.col("chunk").alias("i"), j.alias("j"), F.lit(True).alias("row")))
    before = F.filter(grid, lambda i: F.col("longer") | (i < F.col("chunk")))
    as_column = F.transform(before, lambda i: F.struct(i.alias("i"), F.col("chunk").alias("j"), F.lit(False).alias("row")))
    units = F.when(F.col("longer"), as_column).otherwise(F.concat(as_row, as_column))
    packed = (chunked.select(*key, "longer", "word", "n", F.explode(units).alias("u"))
              .groupBy(*key, F.col("u.i").alias("i"), F.col("u.j").alias("j"))
              .agg(F.collect_list(F.struct("word", "n", F.col("u.row").alias("row"), "longer")).alias("members"))
              .where(F.size("members") > 1))
    met = packed.select("short", "side", "i", "j", "members").mapInArrow(_unit_rows, UNIT_SCHEMA)
    path = scratch_path(spark, "near_words")
    met.write.parquet(path)
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("word"))).alias("first")
    return (spark.read.parquet(path).groupBy("word").agg(F.sum("n_near").alias("n_near"), best)
            .select("word", "n_near", (-F.col("first.less")).alias("best_n"), F.col("first.word").alias("best")))


def follow_forms(forms: DataFrame) -> DataFrame:
    """(word, root) for rows (word, form): forms followed to the last.  Each pass
    doubles the steps taken; it is written to the shared folder."""
    spark = forms.sparkSession
    path, step = scratch_path(spark, "roots"), 0
    now = forms.select("word", F.col("form").alias("root"))
    while True:
        now.write.parquet(f"{path}/{step}")
        now = spark.read.parquet(f"{path}/{step}")
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if now.join(onward, "root", "left_semi").isEmpty():
            return now
        now = now.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"))
        step += 1


def spelling_variants(docs: DataFrame, form_factor: int = FORM_FACTOR) -> DataFrame:
    """word, form, root, n, n_near, form_n: one row per word of ``docs``."""
    spark = docs.sparkSession
    path = scratch_path(spark, "words")
    count_words(docs).write.parquet(path)
    words = spark.read.parquet(path)
    judged = words.join(near_words(words), "word", "left")
    formed = F.col("best_n") >= form_factor * F.col("n")
    judged = judged.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                           F.when(formed, F.col("best")).alias("form"), F.when(formed, F.col("best_n")).alias("form_n"))
    table = scratch_path(spark, "forms")
    judged.write.parquet(table)
    judged = spark.read.parquet(table)
    roots = follow_forms(judged.where("form is not null"))
    return (judged.join(roots, "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))
