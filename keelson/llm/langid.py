"""Language identification (op 4): prediction by partial matching.

For every language a byte context tree of orders 0..MAX_ORDER is counted on a
bounded sample of labelled documents.  A byte is coded by the longest context
that has seen it; each longer context that has not charges its escape
probability (method C: q / (total + q) with q distinct successors), and a byte
new to all contexts costs 8 bits.  The statistics are frozen: a document's code
length under a language is a sum over its bytes, and the shortest one wins.

The trees become tables with one row per (context, byte) seen in any language
and one code length per language, so a byte costs a few table look-ups for all
languages together.  Look-ups are vectorised over whole Arrow slices.

The sample is bounded by SAMPLE_DOCS documents and SAMPLE_BYTES bytes per
language (chosen by a hash of doc_id), which bounds the counts that meet on the
driver and the broadcast tables whatever the corpus.  Scoring reads every whole
text in place, without a shuffle.

Edge cases: null text or text without a letter is ``und`` with score 0; without
any training row everything is ``und``; a null lang never trains; equal code
lengths go to the first language in order; repeated rows are scored alike; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keelson.llm.textops import TextSlice, text_slices

__all__ = ["held_out", "training_sample", "count_contexts", "PpmModel", "fit", "predict_language"]

MAX_ORDER = 4
SAMPLE_DOCS = 1200          # documents per language
SAMPLE_BYTES = 2_000_000    # bytes per language
SALTS = 256                 # tasks that pick the sample of one language
UNKNOWN = "und"
SLICE = 2 << 20

COUNT_SCHEMA = "lang string, size int, gram long, n long"
RESULT_SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"


def held_out(doc_id: str = "doc_id") -> Column:
    key = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    return F.crc32(key) % 3 == 1


def training_sample(docs: DataFrame, max_docs: int = SAMPLE_DOCS, max_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """(lang, text) of the rows that may train, at most ``max_docs`` and about
    ``max_bytes`` per language, in the order of a hash of doc_id."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"),
                       F.col("text").cast("string").alias("text"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    ids = rows.select("lang", "doc_id", F.octet_length("text").alias("size"))
    # the first of every salt before the first of all, so no task sorts a whole language
    order = [F.xxhash64("doc_id"), "doc_id", "size"]
    salted = ids.withColumn("salt", F.pmod(F.xxhash64("size", "doc_id"), F.lit(SALTS)))
    some = (salted.withColumn("nth", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order)))
            .where(F.col("nth") <= max_docs).drop("salt", "nth"))
    picked = some.withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("nth") <= max_docs)
    before = F.sum("size").over(Window.partitionBy("lang").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1))
    picked = picked.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < max_bytes)
    # bounded: at most max_docs ids per language
    chosen = F.broadcast(picked.select(F.col("lang").alias("l"), F.col("doc_id").alias("i"), "size").distinct())
    return rows.join(chosen, (F.col("lang") == F.col("l")) & F.col("doc_id").eqNullSafe(F.col("i"))
                     & (F.octet_length("text") == F.col("size")), "left_semi").select("lang", "text")


def _padded(text: TextSlice, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes with ``pad`` zero bytes before every document, and the place of
    each real byte in them."""
    place = np.arange(len(text.data)) + pad * np.repeat(np.arange(1, len(text) + 1), text.lengths())
    out = np.zeros(len(text.data) + pad * len(text), dtype=np.uint64)
    out[place] = text.data
    return out, place


def _grams(padded: np.ndarray, place: np.ndarray, size: int) -> np.ndarray:
    """The last ``size`` bytes up to each place as one number."""
    out = padded[place]
    for k in range(1, size):
        out = out | (padded[place - k] << np.uint64(8 * k))
    return out


def _count_batches(max_order: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(0)
            for lang in langs.unique().to_pylist():
                rows = pa.Table.from_batches([batch]).filter(pa.compute.equal(langs, lang)).combine_chunks()
                for part in rows.to_batches():
                    for _, text in text_slices(part, "text", SLICE):
                        padded, place = _padded(text, max_order)
                        for size in range(1, max_order + 2):
                            gram, n = np.unique(_grams(padded, place, size), return_counts=True)
                            yield pa.RecordBatch.from_arrays(
                                [pa.array([lang] * len(gram), pa.string()),
                                 pa.array(np.full(len(gram), size, np.int32)), pa.array(gram.view(np.int64)),
                                 pa.array(n.astype(np.int64))], names=["lang", "size", "gram", "n"])
    return run


def count_contexts(sample: DataFrame, max_order: int = MAX_ORDER) -> DataFrame:
    """(lang, size, gram, n): how often each string of ``size`` bytes occurs."""
    return (sample.mapInArrow(_count_batches(max_order), COUNT_SCHEMA)
            .groupBy("lang", "size", "gram").agg(F.sum("n").alias("n")))


class _Table:
    """Open-addressing hash table from 64-bit keys to rows of code lengths."""

    def __init__(self, keys: np.ndarray, rows: np.ndarray):
        self.bits = max(4, int(4 * max(1, len(keys))).bit_length())
        size = 1 << self.bits
        self.keys = np.full(size, np.uint64(0xFFFFFFFFFFFFFFFF))
        self.row = np.zeros(size, dtype=np.int32)
        self.rows = np.vstack([rows, np.zeros((1, rows.shape[1]), dtype=np.float32)]).astype(np.float32)
        self.probes = 0
        todo = np.arange(len(keys))
        slot = self._slot(keys)
        while len(todo):
            self.probes += 1
            free = self.keys[slot] == np.uint64(0xFFFFFFFFFFFFFFFF)
            at, who = np.unique(np.where(free, slot, -1), return_index=True)
            ok = at >= 0
            self.keys[at[ok]] = keys[todo[who[ok]]]
            self.row[at[ok]] = todo[who[ok]]
            placed = np.zeros(len(todo), dtype=bool)
            placed[who[ok]] = True
            todo, slot = todo[~placed], (slot[~placed] + 1) & (size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, -1 where absent."""
        out = np.full(len(keys), -1, dtype=np.int32)
        slot = self._slot(keys)
        held = self.keys[slot]
        hit = held == keys
        out[hit] = self.row[slot[hit]]
        todo = np.flatnonzero(~hit & (held != np.uint64(0xFFFFFFFFFFFFFFFF)))
        slot = slot[todo]
        for _ in range(self.probes - 1):
            if not len(todo):
                break
            slot = (slot + 1) & ((1 << self.bits) - 1)
            held = self.keys[slot]
            hit = held == keys[todo]
            out[todo[hit]] = self.row[slot[hit]]
            more = ~hit & (held != np.uint64(0xFFFFFFFFFFFFFFFF))
            todo, slot = todo[more], slot[more]
        return out


class PpmModel:
    """Code lengths in bits of a byte after its context, for all languages."""

    def __init__(self, langs: list[str], lang: np.ndarray, size: np.ndarray, gram: np.ndarray, n: np.ndarray,
                 max_order: int = MAX_ORDER):
        self.langs, self.max_order = langs, max_order
        self.codes: list[_Table] = []
        self.escapes: list[_Table] = []
        n_langs = len(langs)
        for order in range(max_order + 1):
            here = size == order + 1
            g, who, count = gram[here], lang[here], n[here].astype(np.float64)
            keys, at = np.unique(g, return_inverse=True)
            seen = np.zeros((len(keys), n_langs))
            seen[at, who] = count
            contexts, ctx = np.unique(keys >> np.uint64(8), return_inverse=True)
            total, distinct = np.zeros((len(contexts), n_langs)), np.zeros((len(contexts), n_langs))
            np.add.at(total, ctx, seen)
            np.add.at(distinct, ctx, (seen > 0).astype(float))
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(total > 0, -np.log2(distinct / (total + distinct)), 0.0)
                known = -np.log2(seen / (total + distinct)[ctx])
            # a byte this context has not seen in a language: escape, then the shorter context
            lower = self._shorter(keys, order)
            self.codes.append(_Table(keys, np.where(seen > 0, known, escape[ctx] + lower)))
            self.escapes.append(_Table(contexts, escape))

    def _shorter(self, keys: np.ndarray, order: int) -> np.ndarray:
        """Code lengths of the last byte of each (order + 1)-gram at order - 1.
        Grams hold the newest byte lowest."""
        if order == 0:
            return np.full((len(keys), len(self.langs)), 8.0)
        return self._lengths(lambda size: keys & np.uint64((1 << (8 * size)) - 1), order - 1, len(keys))

    def _lengths(self, gram_of: Callable[[int], np.ndarray], order: int, count: int) -> np.ndarray:
        out = np.zeros((count, len(self.langs)), dtype=np.float32)
        todo = np.arange(count)
        for o in range(order, -1, -1):
            grams = gram_of(o + 1)
            grams = grams if len(todo) == count else grams[todo]
            row = self.codes[o].find(grams)
            hit = row >= 0
            if hit.all():
                out[todo] += self.codes[o].rows[row]
                return out
            out[todo[hit]] += self.codes[o].rows[row[hit]]
            todo, grams = todo[~hit], grams[~hit]
            out[todo] += self.escapes[o].rows[self.escapes[o].find(grams >> np.uint64(8))]  # absent: the zero row
        out[todo] += 8.0
        return out

    def code_lengths(self, text: TextSlice) -> np.ndarray:
        """Bits of every document under every language."""
        padded, place = _padded(text, self.max_order)
        longest = _grams(padded, place, self.max_order + 1)
        bits = self._lengths(lambda size: longest & np.uint64((1 << (8 * size)) - 1), self.max_order, len(place))
        total = np.zeros((len(text), len(self.langs)))
        full = np.flatnonzero(text.lengths())
        if len(full):
            total[full] = np.add.reduceat(bits, text.offsets[full], axis=0, dtype=np.float64)
        return total


def fit(docs: DataFrame, max_docs: int = SAMPLE_DOCS, max_bytes: int = SAMPLE_BYTES,
        max_order: int = MAX_ORDER) -> PpmModel | None:
    """Count the sample on the cluster; build the tables from the counts (their
    number is bounded by the sample)."""
    counts = count_contexts(training_sample(docs, max_docs, max_bytes), max_order).toArrow()
    if not counts.num_rows:
        return None
    langs = sorted(counts.column("lang").unique().to_pylist())
    code = {name: i for i, name in enumerate(langs)}
    lang = counts.column("lang").combine_chunks().dictionary_encode()
    names = np.array([code[x] for x in lang.dictionary.to_pylist()])
    return PpmModel(langs, names[np.asarray(lang.indices)], np.asarray(counts.column("size")),
                    np.asarray(counts.column("gram")).view(np.uint64), np.asarray(counts.column("n")), max_order)


def _has_letter(rows: pa.Array, text: TextSlice) -> np.ndarray:
    lowered = text.data | 32
    out = text.per_doc((lowered >= 97) & (lowered <= 122)) > 0
    for i in np.flatnonzero(~out):
        out[i] = any(c.isalpha() for c in rows[int(i)].as_py() or "")
    return out


def _score_batches(shared) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for rows, text in text_slices(batch, max_bytes=SLICE):
                n = len(text)
                known = np.zeros(n, dtype=bool) if model is None else _has_letter(rows.column(1), text)
                pred, score = np.full(n, UNKNOWN, dtype=object), np.zeros(n)
                if known.any():
                    bits = model.code_lengths(text)
                    best = bits.argmin(axis=1)
                    share = 1.0 / np.exp2(np.minimum(bits.min(axis=1)[:, None] - bits, 0)).sum(axis=1)
                    pred[known] = np.array(model.langs, dtype=object)[best[known]]
                    score[known] = share[known]
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), rows.column(2), pa.array(pred.tolist(), pa.string()), pa.array(score)],
                    names=["doc_id", "held_out", "lang_pred", "score"])
    return run


def predict_language(docs: DataFrame, model: PpmModel | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score (posterior share of the best language
    under equal priors) for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       held_out().alias("held_out"))
    return rows.mapInArrow(_score_batches(shared), RESULT_SCHEMA)
