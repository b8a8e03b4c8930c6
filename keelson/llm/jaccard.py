"""N-gram Jaccard join (op 7): blocked sparse product of the document by n-gram
incidence matrix.

Rows are documents (one per distinct shingle set), columns are shingles.  Two
rows link when ``100 * overlap >= 80 * union``.  The product is never formed
whole; size-derived bounds keep it sparse:

* columns: in any fixed order of the shingles, linked rows of n shingles share
  one of their first ``n - ceil(0.8 n) + 1``.  Shingles are ordered by their
  exact document frequency, rare ones first, and a shingle of one document only
  meets nobody: most rows have enough of those and send nothing, and a passage
  that a third of all documents hold is no reason to meet;
* rows of one column are sorted by size and cut where a row is more than 1.25
  times larger than the one before: no link crosses such a gap.

Rows that meet in a column form candidate clusters.  A cluster's incidence
matrix is cut into row blocks of bounded size (by a size stratum and a hash),
and every pair of blocks whose strata can link is one task's work: overlaps are
accumulated column chunk by column chunk, pairs under the bound are discarded
and only a spanning forest of the links found leaves the task.  So a group of
thousands of near copies costs its blocks, never a row per pair.

The text lies packed in blocks (a bucketed table).  Frequencies are counted by
sending every block's distinct shingles as sorted, delta-coded keys, one row per
(block, bucket), and come back as one small class per key.  Documents with the
same set as an earlier one leave before that.  Nothing is collected on the
driver.

Edge cases: a text with fewer words than a shingle is one shingle of all its
words; null, empty or blank text has no shingles and no links; rows that repeat
a doc_id count as one document in links; rows without a doc_id count as one that
sorts before all others, and its component is null; an empty table gives an empty
result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.llm.blocks import (ENTRY_SCHEMA, NULL_ID, Block, KeyRuns, blocks_of, by_bucket, deltas, entry_rows, pack,
                                drop_blocks, new_block_table, unpack, write_blocks)
from keelson.llm.components import connected_components
from keelson.llm.textops import TextSlice, mix64, word_windows
from keelson.session import scratch_path

__all__ = ["shingle_sets", "similarity_links", "near_copy_components", "keep_one_of_each"]

SHINGLE = 5
PERCENT = 80
BLOCK = 512            # rows of the matrix per block
CHUNK_COLUMNS = 4096   # columns per partial product

BUCKET_BYTES = 8 << 20
EXACT_CLASSES = 128    # frequencies below are their own class, above in eighths of powers of two

SET_SCHEMA = "doc_id long, block_id long, nth int, n long, sig1 long, sig2 long"
CLASS_SCHEMA = "block_id long, bucket int, classes binary"
ROW = "doc_id long, block_id long, nth int, n long"
COLUMN_SCHEMA = "token long, " + ROW
EDGE_SCHEMA = ROW + ", hub long, hub_block long, hub_nth int, hub_n long"
LINK_SCHEMA = "a long, b long"


def shingle_sets(text: TextSlice, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of the distinct shingles, sorted by document and hash."""
    w = text.words(lower=True)
    h, at = word_windows(w.hash, w.doc, size)
    doc = w.doc[at]
    short = np.flatnonzero((w.count > 0) & (w.count < size))
    if len(short):
        extra = np.zeros(len(short), dtype=np.uint64)
        for k in range(size - 1):
            more = w.count[short] > k
            extra[more] = extra[more] * np.uint64(0x9E3779B97F4A7C15) + w.hash[w.first[short[more]] + k]
        h = np.concatenate([h, mix64(extra + w.count[short].astype(np.uint64))])
        doc = np.concatenate([doc, short])
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], doc[new]


def _sum_by(doc: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    total = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values, out=total[1:])
    edge = np.searchsorted(doc, np.arange(n + 1))
    return total[edge[1:]] - total[edge[:-1]]


def _signatures(h: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(set size, two order-free 64-bit signatures) of every document."""
    one = _sum_by(doc, mix64(h + np.uint64(0x1234567)), n)
    two = _sum_by(doc, mix64(h ^ np.uint64(0xA5A5A5A55A5A5A5A)), n)
    return np.bincount(doc, minlength=n).astype(np.int64), one.view(np.int64), two.view(np.int64)


def _set_batches(size: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block_id, doc_ids, lengths, body in blocks_of(batch, 4):
                block = Block(doc_ids, lengths, body)
                count = len(block.ids)
                n, one, two = _signatures(*shingle_sets(block.text(), size), count)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(block.ids), pa.array(np.full(count, block_id)), pa.array(np.arange(count, dtype=np.int32)),
                     pa.array(n), pa.array(one), pa.array(two)],
                    names=["doc_id", "block_id", "nth", "n", "sig1", "sig2"])
    return run


def _live_sets(block: Block, size: int) -> tuple[np.ndarray, np.ndarray]:
    h, doc = shingle_sets(block.text(), size)
    live = ~block.dropped[doc]
    return h[live], doc[live]


def _key_batches(size: int, buckets: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block_id, doc_ids, lengths, body, dropped in blocks_of(batch, 5):
                h, _ = _live_sets(Block(doc_ids, lengths, body, dropped), size)
                keys, count = np.unique(h, return_counts=True)
                # 44 bits tell shingles apart well enough to order them: a shared
                # class only moves a shingle back in everybody's order alike
                cut = np.uint64(20)
                rows = [(k, pack(deltas(keys[a:b] >> cut, lower >> cut), count[a:b].astype(np.uint64)))
                        for k, a, b, lower in KeyRuns(keys, 64, buckets)]
                if rows:
                    yield entry_rows(block_id, rows)
    return run


def _frequency_class(df: np.ndarray) -> np.ndarray:
    high = EXACT_CLASSES + np.floor(8 * np.log2(np.maximum(df, 1) / EXACT_CLASSES))
    return np.minimum(np.where(df < EXACT_CLASSES, df, high), 255).astype(np.uint8)


def _count_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per bucket: the frequency class of every block's keys."""
    for bucket, blocks, entries in by_bucket(batches):
        keys, counts, sizes = [], [], []
        for blob in entries:
            delta, count = unpack(blob)
            keys.append(np.cumsum(delta))
            counts.append(count)
            sizes.append(len(delta))
        key = np.concatenate(keys)
        order = np.argsort(key, kind="stable")
        s = key[order]
        new = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        total = np.add.reduceat(np.concatenate(counts)[order].astype(np.int64), new)
        classes = np.empty(len(s), dtype=np.uint8)
        classes[order] = np.repeat(_frequency_class(total), np.diff(np.concatenate([new, [len(s)]])))
        cut = np.cumsum([0] + sizes)
        yield pa.RecordBatch.from_arrays(
            [pa.array(blocks, pa.int64()), pa.array([bucket] * len(blocks), pa.int32()),
             pa.array([pack(classes[a:b]) for a, b in zip(cut[:-1], cut[1:])], pa.binary())],
            names=["block_id", "bucket", "classes"])


def _column_batches(size: int, buckets: int, percent: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block_id, doc_ids, lengths, body, dropped, answers in blocks_of(batch, 6):
                block = Block(doc_ids, lengths, body, dropped)
                h, doc = _live_sets(block, size)
                keys, which = np.unique(h, return_inverse=True)
                runs = KeyRuns(keys, 64, buckets)
                classes = np.zeros(len(keys), dtype=np.uint8)
                for row in answers or []:
                    a, b = runs.find(row["bucket"])
                    classes[a:b] = unpack(row["classes"])[0].astype(np.uint8)
                level = classes[which]
                order = np.lexsort((h, level, doc))
                h, doc, level = h[order], doc[order], level[order]
                n = np.bincount(doc, minlength=len(block.ids)).astype(np.int64)
                first = np.searchsorted(doc, np.arange(len(block.ids)))
                prefix = n - (percent * n + 99) // 100 + 1
                take = (level > 1) & (np.arange(len(h)) - first[doc] < prefix[doc])
                h, doc = h[take], doc[take]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h.view(np.int64)), pa.array(block.ids[doc]), pa.array(np.full(len(doc), block_id)),
                     pa.array(doc.astype(np.int32)), pa.array(n[doc])],
                    names=["token", "doc_id", "block_id", "nth", "n"])
    return run


def _meet_batches(percent: int) -> Callable:
    """Rows sorted by (token, n, doc_id, block_id, nth): each row but the first
    of a run of linkable sizes meets the run's first row, its hub."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, hub = None, None       # (token, n) of the row before; its hub
        for batch in batches:
            token, n, *row = (np.asarray(batch.column(i)) for i in (0, 4, 1, 2, 3))
            if not len(token):
                continue
            fresh = np.ones(len(token), dtype=bool)
            fresh[1:] = (token[1:] != token[:-1]) | (percent * n[1:] > 100 * n[:-1])
            if last is not None:
                fresh[0] = token[0] != last[0] or percent * n[0] > 100 * last[1]
            start = np.maximum.accumulate(np.where(fresh, np.arange(len(token)), -1))
            hubs = [x[start] for x in (*row, n)]
            if hub is not None:
                for x, old in zip(hubs, hub):
                    x[start < 0] = old
            out = ~fresh
            yield pa.RecordBatch.from_arrays(
                [pa.array(x[out]) for x in (*row, n, *hubs)],
                names=["doc_id", "block_id", "nth", "n", "hub", "hub_block", "hub_nth", "hub_n"])
            last, hub = (token[-1], n[-1]), [x[-1] for x in hubs]
    return run


def _rows_batches(size: int) -> Callable:
    """Shingle sets of the wanted rows of a block, once for every unit."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_ids, lengths, body, wanted in blocks_of(batch, 4):
                block = Block(doc_ids, lengths, body)
                h, doc = shingle_sets(block.text(), size)
                edge = np.searchsorted(doc, np.arange(len(block.ids) + 1)) * 8
                raw = h.view(np.uint8)
                for k in range(0, len(wanted), 500):
                    part = wanted[k:k + 500]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([w["node"] for w in part], pa.int64()), pa.array([w["cluster"] for w in part], pa.int64()),
                         pa.array([w["unit"] for w in part], pa.string()),
                         pa.array([raw[edge[w["nth"]]:edge[w["nth"] + 1]].tobytes() for w in part], pa.binary())],
                        names=["node", "cluster", "unit", "shingles"])
    return run


def _forest(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Smallest row index linked to each row, directly or through others."""
    r = len(sets)
    size = np.array([len(s) for s in sets], dtype=np.int64)
    row = np.repeat(np.arange(r), size)
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[column] > 1
    row, column = row[shared], column[shared]
    _, column = np.unique(column, return_inverse=True)
    overlap = np.zeros((r, r), dtype=np.float32)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    width = int(column[-1]) + 1 if len(column) else 0
    for lo in range(0, width, CHUNK_COLUMNS):
        a, b = np.searchsorted(column, [lo, lo + CHUNK_COLUMNS])
        part = np.zeros((r, min(CHUNK_COLUMNS, width - lo)), dtype=np.float32)
        part[row[a:b], column[a:b] - lo] = 1
        overlap += part @ part.T
    union = size[:, None] + size[None, :] - overlap
    linked = 100 * overlap >= percent * union
    label = np.arange(r)
    while True:
        new = np.where(linked, label[None, :], r).min(axis=1)
        new = np.minimum(new, label)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _product_batches(percent: int) -> Callable:
    """Rows sorted by (unit, cluster): links within each unit's clusters."""
    def links(nodes: list[int], sets: list[np.ndarray]) -> list[tuple[int, int]]:
        label = _forest(sets, percent)
        return [(nodes[i], nodes[k]) for i, k in enumerate(label.tolist()) if i != k and nodes[i] != nodes[k]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, nodes, sets, out = None, [], [], []
        for batch in batches:
            for node, cluster, unit, raw in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if key != (unit, cluster):
                    if len(nodes) > 1:
                        out += links(nodes, sets)
                    key, nodes, sets = (unit, cluster), [], []
                nodes.append(node)
                sets.append(np.frombuffer(raw, "<u8"))
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)],
                                                 names=["a", "b"])
                out = []
        if len(nodes) > 1:
            out += links(nodes, sets)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)],
                                             names=["a", "b"])
    return run


def _units(nodes: DataFrame, percent: int, block: int) -> DataFrame:
    """(node, block_id, nth, cluster, unit): the block pairs every row takes part in."""
    step = math.log(100 / percent) * 1.01   # linked sizes lie in one stratum or two neighbours
    stratum = F.floor(F.log("n") / F.lit(step)).cast("int")
    nodes = nodes.withColumn("stratum", stratum)
    counts = nodes.groupBy("cluster", "stratum").agg(F.count(F.lit(1)).alias("rows"))
    # strata of a cluster: at most a few dozen
    per = counts.groupBy("cluster").agg(
        F.sum("rows").alias("rows"),
        F.map_from_entries(F.collect_list(F.struct("stratum", F.ceil(F.col("rows") / block).cast("int").alias("k")))).alias("blocks"))
    both = nodes.join(per, "cluster")
    small = both.where(F.col("rows") <= block).select(
        "node", "block_id", "nth", "cluster", F.concat(F.lit("s"), F.xxhash64("cluster").cast("string")).alias("unit"))
    here = F.col("stratum")

    def own(s):
        return F.coalesce(F.try_element_at("blocks", s), F.lit(0))

    mine = F.pmod(F.xxhash64("node", F.lit(11)), F.element_at("blocks", here)).cast("int")
    big = both.where(F.col("rows") > block).withColumn("mine", mine)

    def name(s, i, t, j):
        return F.concat_ws(":", F.lit("b"), "cluster", s, i, t, j)

    def pairs(s, make):
        return F.when(own(s) > 0, F.transform(F.sequence(F.lit(0), own(s) - 1), make)).otherwise(F.array().cast("array<string>"))

    me = F.col("mine")
    big = big.withColumn("units", F.array_distinct(F.concat(
        pairs(here, lambda j: name(here, F.least(me, j), here, F.greatest(me, j))),
        pairs(here + 1, lambda j: name(here, me, here + 1, j)),
        pairs(here - 1, lambda j: name(here - 1, j, here, me)))))
    return small.unionByName(big.select("node", "block_id", "nth", "cluster", F.explode("units").alias("unit")))


def _same_sets(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(first row of every distinct set, (block_id, dropped): the other rows)."""
    key = ["n", "sig1", "sig2"]
    first = sets.where("n > 0").groupBy(*key).agg(F.min(F.struct("doc_id", "block_id", "nth")).alias("first"),
                                                  F.count(F.lit(1)).alias("copies"))
    later = (sets.where("n > 0").join(first.where("copies > 1"), key)
             .where(F.struct("doc_id", "block_id", "nth") != F.col("first")))
    return first, later.groupBy("block_id").agg(F.collect_list("nth").alias("dropped"))


def similarity_links(blocks: DataFrame, dropped: DataFrame, percent: int = PERCENT, size: int = SHINGLE,
                     row_block: int = BLOCK, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Links (a, b) between documents with different sets, as a spanning forest
    of every block pair.  ``dropped`` names rows to leave out."""
    spark = blocks.sparkSession
    path = scratch_path(spark, "jaccard_links")
    total = blocks.agg(F.sum("n_bytes")).first()[0] or 0
    buckets = max(1, math.ceil(total / bucket_bytes))
    body = ["doc_ids", "lengths", "body"]

    def written(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{path}/{name}")
        return spark.read.parquet(f"{path}/{name}")

    live = blocks.join(dropped.hint("shuffle_hash"), "block_id", "left")
    keys = live.select("block_id", *body, "dropped").mapInArrow(_key_batches(size, buckets), ENTRY_SCHEMA)
    classes = written(keys.repartition("bucket").sortWithinPartitions("bucket", "block_id")
                      .mapInArrow(_count_keys, CLASS_SCHEMA), "classes")
    answers = classes.groupBy("block_id").agg(F.collect_list(F.struct("bucket", "classes")).alias("answers"))
    columns = (live.join(answers.hint("shuffle_hash"), "block_id", "left").select("block_id", *body, "dropped", "answers")
               .mapInArrow(_column_batches(size, buckets, percent), COLUMN_SCHEMA))
    meet = written(columns.repartition("token").sortWithinPartitions("token", "n", "doc_id", "block_id", "nth")
                   .mapInArrow(_meet_batches(percent), EDGE_SCHEMA).distinct(), "meet")
    clusters = connected_components(meet.select(F.col("doc_id").alias("a"), F.col("hub").alias("b")))
    rows = meet.select("doc_id", "block_id", "nth", "n").unionByName(meet.select(
        F.col("hub").alias("doc_id"), F.col("hub_block").alias("block_id"), F.col("hub_nth").alias("nth"),
        F.col("hub_n").alias("n"))).distinct().withColumnRenamed("doc_id", "node")
    nodes = written(rows.join(clusters.select("node", F.col("component").alias("cluster")), "node"), "nodes")
    wanted = (_units(nodes, percent, row_block).groupBy("block_id")        # at most the rows of a block and their units
              .agg(F.collect_list(F.struct("nth", "node", "cluster", "unit")).alias("wanted")))
    sets = (blocks.join(wanted.hint("shuffle_hash"), "block_id").select(*body, "wanted")
            .mapInArrow(_rows_batches(size), "node long, cluster long, unit string, shingles binary"))
    return (sets.repartition("unit").sortWithinPartitions("unit", "cluster", "node")
            .mapInArrow(_product_batches(percent), LINK_SCHEMA))


def near_copy_components(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id for every row."""
    spark = docs.sparkSession
    path = scratch_path(spark, "jaccard")
    table = new_block_table()
    blocks = write_blocks(docs, name=table)
    blocks.select("block_id", "doc_ids", "lengths", "body").mapInArrow(_set_batches(size), SET_SCHEMA).write.parquet(f"{path}/sets")
    sets = spark.read.parquet(f"{path}/sets")
    first, dropped = _same_sets(sets)
    dropped.write.parquet(f"{path}/dropped")
    similarity_links(blocks, spark.read.parquet(f"{path}/dropped"), percent, size).write.parquet(f"{path}/links")
    drop_blocks(spark, table)
    found = connected_components(spark.read.parquet(f"{path}/links"))
    groups = (first.join(found, first["first.doc_id"] == found["node"], "left")
              .select("n", "sig1", "sig2", F.coalesce("component", "first.doc_id").alias("group")))
    null = F.lit(NULL_ID)
    return (sets.join(groups, ["n", "sig1", "sig2"], "left")   # a set's copies: one row on the right
            .select(F.nullif("doc_id", null).alias("doc_id"), F.col("n").alias("n_shingles"),
                    F.nullif(F.coalesce("group", "doc_id"), null).alias("component_id")))


def keep_one_of_each(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE) -> DataFrame:
    """The document with the smallest doc_id of every component, all columns, one
    row each; a document without a doc_id comes after all others of its component.

    A document is a doc_id with a text: unlike texts under one doc_id are judged on
    their own and stay, rows that repeat both leave one, and copies without a
    doc_id leave one."""
    text, key = F.col("text").cast("string"), "__document"
    number = F.xxhash64(F.col("doc_id").isNull(), F.col("doc_id").cast("long"), text.isNull(), text)
    rows = docs.withColumn(key, number)
    found = near_copy_components(rows.select(F.col(key).alias("doc_id"), text.alias("text")), percent, size)
    named = rows.select(key, F.col("doc_id").cast("long").alias("id")).distinct()
    kept = (found.select(F.col("doc_id").alias(key), "component_id").distinct().join(named, key).groupBy("component_id")
            .agg(F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", key))[key].alias("_kept")))
    return (rows.alias("d").join(kept.alias("k"), F.col(f"d.{key}") == F.col("k._kept"), "left_semi")
            .dropDuplicates([key]).select(*docs.columns))
