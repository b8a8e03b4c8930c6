"""Conversation prefix trie (op 13): balanced parentheses, shard by shard.

Conversations that begin with the same turns share a path from the root; a node
is one distinct sequence of first turns.  Distinct conversations, as strings of
16-byte turn digests, are range-partitioned in lexicographic order, so every
shard holds a run of neighbouring paths.  A shard's trie is encoded as balanced
parentheses in preorder with a min tree over excess blocks: ``findclose``
delimits the subtree of a node, the rank of "()" pairs counts its leaves, and
cumulative arrays over preorder give its members and savings.

Only nodes on the first or the last path of a shard (its spines) can go on in
another shard.  They leave the shard as partial sums with their paths; one small
task, two paths per shard, encodes them as a trie again, adds the parts up and
completes the sums.  Everything else is final in its shard.  A first turn that a
third of all conversations share is thus cut over many shards.

Bounds: a conversation is one row of 24 bytes per turn; a shard is closed
at ``SHARD_TURNS`` turns.  The digest of the ids that end at a node is defined on
the joined list, so it streams through one task per node, 24 bytes a member.

Edge cases: null role or text counts as empty; turns order by (turn, role, text),
null turns first, and rows that repeat a turn all count; rows without a conv_id
belong to no conversation and take no part; ``conv_id % 5`` is that of SQL (the
sign of conv_id); an empty table has no node, not even a root; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keelson.session import landed, scratch_path

__all__ = ["Parentheses", "PathTrie", "ordered_turns", "branched", "conversation_paths", "trie_nodes", "conversation_trie"]

SHARD_TURNS = 1 << 17
DIGEST = 16           # bytes of a turn's digest
FAMILY = 5            # conversations c - c % 5 .. share their beginning
BRANCHES = 9
NO_ID = np.iinfo(np.int64).max
NO_ENDS = hashlib.sha256(b"").hexdigest()

PATH_ARROW = [("path", pa.binary()), ("sizes", pa.list_(pa.int64())), ("n_ends", pa.int64()), ("least", pa.int64()),
              ("ends_sha256", pa.string())]
NODE_ARROW = [("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("parent_key", pa.binary()),
              ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()),
              ("ends_sha256", pa.string())]
SPINE_ARROW = [("path", pa.binary()), ("sizes", pa.list_(pa.int64())), ("s_convs", pa.list_(pa.int64())),
               ("s_least", pa.list_(pa.int64())), ("s_children", pa.list_(pa.int64())), ("s_leaves", pa.list_(pa.int64())),
               ("s_saved", pa.list_(pa.int64())), ("s_ends", pa.list_(pa.string()))]
NODE_SCHEMA = ("conv_id long, depth long, parent_conv_id long, parent_key binary, n_convs long, n_children long, "
               "n_leaves long, saved_tokens long, ends_sha256 string")
SHARD_SCHEMA = (NODE_SCHEMA + ", path binary, sizes array<long>, s_convs array<long>, s_least array<long>, "
                "s_children array<long>, s_leaves array<long>, s_saved array<long>, s_ends array<string>")
RESULT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


class Parentheses:
    """A balanced sequence (+1 opens, -1 closes) with the least excess of every
    block of ``width`` and of every pair of blocks above it."""

    def __init__(self, steps: np.ndarray, width: int = 64):
        self.excess = np.cumsum(steps, dtype=np.int64)
        self.opens = np.flatnonzero(steps > 0)
        pair = np.zeros(len(steps), dtype=np.int64)
        pair[:-1] = (steps[:-1] > 0) & (steps[1:] < 0)
        self._pairs = np.concatenate([[0], np.cumsum(pair)])
        self._width = width
        blocks = -(-len(steps) // width)
        self._leaves = 1 << max(0, (blocks - 1).bit_length())
        padded = np.full(self._leaves * width, NO_ID, dtype=np.int64)
        padded[:len(steps)] = self.excess
        self._blocks = padded.reshape(-1, width)
        least = [self._blocks.min(axis=1)]
        while len(least[-1]) > 1:
            least.append(least[-1].reshape(-1, 2).min(axis=1))
        # heap order: node 1 is the root, block b is node leaves + b
        self._least = np.concatenate([[NO_ID], *reversed(least)])

    def findclose(self, at: np.ndarray) -> np.ndarray:
        """The closing place of every opening place ``at``."""
        out = np.empty(len(at), dtype=np.int64)
        for lo in range(0, len(at), 1 << 16):
            out[lo:lo + (1 << 16)] = self._findclose(at[lo:lo + (1 << 16)])
        return out

    def _findclose(self, at: np.ndarray) -> np.ndarray:
        goal = self.excess[at] - 1
        block, place = at // self._width, np.arange(self._width)
        hit = (self._blocks[block] <= goal[:, None]) & (place[None, :] > (at % self._width)[:, None])
        out = block * self._width + hit.argmax(axis=1)
        far = np.flatnonzero(~hit.any(axis=1))
        node, goal = block[far] + self._leaves, goal[far]
        climbing = np.ones(len(far), dtype=bool)
        while climbing.any():                         # up to the next subtree on the right that falls to the goal
            i = np.flatnonzero(climbing)
            left = (node[i] & 1) == 0
            found = left & (self._least[node[i] ^ left] <= goal[i])
            node[i] = np.where(found, node[i] + 1, node[i] >> 1)
            climbing[i[found]] = False
        while (node < self._leaves).any():            # down to its first block
            inner = node < self._leaves
            child = node[inner] << 1
            node[inner] = np.where(self._least[child] <= goal[inner], child, child + 1)
        block = node - self._leaves
        out[far] = block * self._width + (self._blocks[block] <= goal[:, None]).argmax(axis=1)
        return out

    def pairs(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Leaves (adjacent "()" pairs) within [start, end]."""
        return self._pairs[end] - self._pairs[start]


class PathTrie:
    """The trie of sorted distinct paths; nodes in preorder, 0 the root."""

    def __init__(self, paths: list[bytes], sizes: list[np.ndarray]):
        self.length = np.array([len(p) // DIGEST for p in paths], dtype=np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.length)])
        digests = np.frombuffer(b"".join(paths), dtype="<u8").reshape(-1, 2)
        shared = self._shared(digests)
        made = self.length - shared
        self.node_path = np.concatenate([[0], np.repeat(np.arange(len(paths)), made)])
        self.last = np.cumsum(made)                   # the node a path ends at
        nth = np.arange(made.sum()) - np.repeat(self.last - made, made)
        self.depth = np.concatenate([[0], np.repeat(shared, made) + nth + 1])
        flat = np.concatenate([np.zeros(1, np.int64), *sizes]).astype(np.int64)[1:] if len(paths) else np.zeros(0, np.int64)
        self.size = np.zeros(len(self.depth), dtype=np.int64)
        self.size[1:] = flat[self.start[self.node_path[1:]] + self.depth[1:] - 1]
        before = np.concatenate([[0], self.length[:-1] - shared[1:]])
        runs = np.stack([before, made], axis=1).reshape(-1)
        steps = np.concatenate([[1], np.repeat(np.tile([-1, 1], len(paths)), runs),
                                np.full(self.length[-1] + 1, -1)]).astype(np.int8)
        parens = Parentheses(steps)
        close = parens.findclose(parens.opens)
        n = len(self.depth)
        self.first = np.arange(n)
        self.behind = self.first + (close - parens.opens + 1) // 2     # first node after the subtree
        self.n_leaves = parens.pairs(parens.opens, close)
        self._by_depth = np.lexsort((self.first, self.depth))
        self._keys = self.depth[self._by_depth] * n + self._by_depth
        self.n_children = (np.searchsorted(self._keys, (self.depth + 1) * n + self.behind)
                           - np.searchsorted(self._keys, (self.depth + 1) * n + self.first))
        self.parent = self.ancestor(self.first, self.depth - 1)

    def _shared(self, digests: np.ndarray) -> np.ndarray:
        """Turns that a path shares with the one before."""
        shared = np.zeros(len(self.length), dtype=np.int64)
        live = np.arange(1, len(self.length))
        while len(live):
            d = shared[live]
            live = live[d < np.minimum(self.length[live], self.length[live - 1])]
            d = shared[live]
            live = live[(digests[self.start[live] + d] == digests[self.start[live - 1] + d]).all(axis=1)]
            shared[live] += 1
        return shared

    def ancestor(self, node: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """The ancestor of ``node`` at ``depth`` (-1 above the root)."""
        at = np.searchsorted(self._keys, depth * len(self.depth) + node, "right") - 1
        return np.where(depth < 0, -1, self._by_depth[np.maximum(at, 0)])

    def subtree_sums(self, values: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(values)])
        return total[self.behind] - total[self.first]

    def subtree_least(self, per_path: np.ndarray) -> np.ndarray:
        """Least of a value of the paths through every node: doubling tables."""
        lo, hi = self.node_path[self.first], self.node_path[self.behind - 1] + 1
        level = np.frexp((hi - lo).astype(float))[1] - 1
        out, table, k = np.empty(len(lo), dtype=np.int64), per_path, 0
        while True:
            now = level == k
            out[now] = np.minimum(table[lo[now]], table[hi[now] - (1 << k)])
            if k >= level.max():
                return out
            table = np.minimum(table[:-(1 << k)], table[1 << k:])
            k += 1


def _keys_along(path: bytes) -> list[bytes]:
    """A key for each beginning of a path, the empty one first."""
    h = hashlib.md5()
    out = [h.digest()]
    for at in range(0, len(path), DIGEST):
        h.update(path[at:at + DIGEST])
        out.append(h.copy().digest())
    return out


def _batch(fields: list[tuple[str, pa.DataType]], columns: list, rest: list[tuple[str, pa.DataType]] = ()) -> pa.RecordBatch:
    arrays = [c if isinstance(c, pa.Array) else pa.array(c, t) for c, (_, t) in zip(columns, fields)]
    n = len(arrays[0])
    arrays += [pa.nulls(n, t) for _, t in rest]
    return pa.RecordBatch.from_arrays(arrays, names=[f for f, _ in [*fields, *rest]])


def _encode_shard(paths: list[bytes], sizes: list[np.ndarray], n_ends: np.ndarray, least: np.ndarray,
                  ends: list[str]) -> Iterator[pa.RecordBatch]:
    trie = PathTrie(paths, sizes)
    n = len(trie.depth)
    ended = np.zeros(n, dtype=np.int64)
    ended[trie.last] = n_ends
    ends_of = np.full(n, None, dtype=object)
    ends_of[trie.last] = ends
    n_convs, smallest = trie.subtree_sums(ended), trie.subtree_least(least)
    spines = [trie.ancestor(np.full(trie.length[p] + 1, trie.last[p]), np.arange(trie.length[p] + 1))
              for p in (0, len(paths) - 1)]
    spine = np.zeros(n, dtype=bool)
    spine[np.concatenate(spines)] = True
    own = np.flatnonzero(~spine)
    saved = trie.subtree_sums(np.where(spine, 0, (n_convs - 1) * trie.size))
    # nodes beneath a spine learn their parent's smallest member once spines are merged
    key = np.full(n, None, dtype=object)
    for p, nodes in zip((0, len(paths) - 1), spines):
        key[nodes] = _keys_along(paths[p])
    parent = trie.parent[own]
    below = spine[parent]
    yield _batch(NODE_ARROW, [
        smallest[own], trie.depth[own], pa.array(smallest[parent], pa.int64(), mask=below), key[parent], n_convs[own],
        trie.n_children[own], trie.n_leaves[own], saved[own], [e or NO_ENDS for e in ends_of[own]]], SPINE_ARROW)
    leaf = trie.subtree_sums((~spine & (trie.n_children == 0)).astype(np.int64))
    children = np.bincount(trie.parent[own], minlength=n) if len(own) else np.zeros(n, np.int64)
    rows, told = [], np.zeros(n, dtype=bool)
    for p, nodes in list(zip((0, len(paths) - 1), spines))[:min(2, len(paths))]:
        new = ~told[nodes]                            # shared by both spines: told once
        told[nodes] = True
        rows.append((paths[p], sizes[p], np.where(new, n_convs[nodes], 0), np.where(new, smallest[nodes], NO_ID),
                     np.where(new, children[nodes], 0), np.where(new, leaf[nodes], 0), np.where(new, saved[nodes], 0),
                     [e if x else None for e, x in zip(ends_of[nodes], new)]))
    spine_rows = _batch(SPINE_ARROW, [[r[k] for r in rows] for k in range(len(SPINE_ARROW))])
    nodes = _batch(NODE_ARROW, [pa.nulls(len(rows), t) for _, t in NODE_ARROW])
    yield pa.RecordBatch.from_arrays([*nodes.columns, *spine_rows.columns], names=[*nodes.schema.names, *spine_rows.schema.names])


def _shards(shard_turns: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, turns = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                parts.append(part)
                turns += len(part.column(1).flatten())
                if turns >= shard_turns:
                    yield from _encode(parts)
                    parts, turns = [], 0
        if parts:
            yield from _encode(parts)

    def _encode(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(parts).combine_chunks()
        paths = t.column("path").to_pylist()
        flat = np.asarray(t.column("sizes").combine_chunks().flatten(), dtype=np.int64)
        ends = np.cumsum([len(p) // DIGEST for p in paths])
        sizes = [flat[e - len(p) // DIGEST:e] for p, e in zip(paths, ends)]
        yield from _encode_shard(paths, sizes, t.column("n_ends").to_numpy(), t.column("least").to_numpy(),
                                 t.column("ends_sha256").to_pylist())
    return run


def _merge_spines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The spines of all shards, sorted by path, as one trie with full sums."""
    rows = [r for batch in batches for r in batch.to_pylist()]
    if not rows:
        return
    nth, distinct = [], []
    for r in rows:
        if not distinct or distinct[-1]["path"] != r["path"]:
            distinct.append(r)
        nth.append(len(distinct) - 1)
    trie = PathTrie([r["path"] for r in distinct], [np.array(r["sizes"], np.int64) for r in distinct])
    n = len(trie.depth)
    convs, children, leaves, saved = (np.zeros(n, dtype=np.int64) for _ in range(4))
    least, ends, key = np.full(n, NO_ID), np.full(n, None, dtype=object), np.full(n, None, dtype=object)
    for p, r in zip(nth, rows):
        depth = np.arange(trie.length[p] + 1)
        nodes = trie.ancestor(np.full(len(depth), trie.last[p]), depth)
        convs[nodes] += r["s_convs"]
        children[nodes] += r["s_children"]
        leaves[nodes] += r["s_leaves"]
        saved[nodes] += r["s_saved"]
        least[nodes] = np.minimum(least[nodes], r["s_least"])
        for node, e in zip(nodes, r["s_ends"]):
            ends[node] = ends[node] or e
        key[nodes] = _keys_along(r["path"])
    children += trie.n_children
    leaves += trie.subtree_sums((children == 0).astype(np.int64))
    saved += trie.subtree_sums((convs - 1) * trie.size)
    top = trie.parent < 0
    yield _batch(NODE_ARROW, [least, trie.depth, pa.array(least[trie.parent], pa.int64(), mask=top), key, convs, children,
                              leaves, saved, [e or NO_ENDS for e in ends]])


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): a conversation's turns in order, each as the digest of
    its role and text and the UTF-8 bytes of the text."""
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    from pyspark.sql import Window
    nth = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text"))
    digest = F.md5(F.concat_ws(":", F.octet_length("role").cast("string"), F.concat("role", "text")))
    return (rows.select("conv_id", nth.alias("nth"), digest.alias("digest"), F.octet_length("text").cast("long").alias("size"))
            .groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("nth", "digest", "size"))).alias("turns")))


def branched(ordered: DataFrame, family: int = FAMILY, branches: int = BRANCHES) -> DataFrame:
    """Conversations rebuilt on the beginning of their family: the first h turns of
    conversation c - c % family, then c's own behind its first h; h is a hash of c."""
    h = (F.crc32(F.encode(F.col("conv_id").cast("string"), "UTF-8")) % branches).cast("int")
    own = ordered.select("conv_id", (F.col("conv_id") - F.col("conv_id") % family).alias("base"), h.alias("h"), "turns")
    first = ordered.select(F.col("conv_id").alias("base"), F.slice("turns", 1, branches).alias("beginning"))
    begun = F.slice(F.coalesce("beginning", F.slice("turns", 1, 0)), F.lit(1), F.col("h"))
    rest = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1)))
    return own.join(first, "base", "left").select("conv_id", F.concat(begun, rest).alias("turns"))


def _end_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, conv_id): count, least and digest of the ids of a key."""
    key, h, n, least = None, None, 0, 0
    done: list[tuple] = []
    for batch in batches:
        keys = batch.column(0).to_pylist()
        ids = batch.column(1).to_pylist()
        at = 0
        while at < len(keys):
            to = at + 1
            while to < len(keys) and keys[to] == keys[at]:
                to += 1
            text = ",".join(map(str, ids[at:to])).encode()
            if keys[at] == key:
                h.update(b"," + text)
            else:
                if key is not None:
                    done.append((key, n, least, h.hexdigest()))
                key, n, least, h = keys[at], 0, ids[at], hashlib.sha256(text)
            n += to - at
            at = to
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], names=["key", "n_ends", "least", "ends_sha256"])
            done = []
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (key, n, least, h.hexdigest())],
                                         names=["key", "n_ends", "least", "ends_sha256"])


def conversation_paths(rebuilt: DataFrame) -> DataFrame:
    """(path, sizes, n_ends, least, ends_sha256): one row per distinct sequence of
    turns, with the conversations that are this sequence."""
    hexes = F.array_join(F.transform("turns", lambda t: t["digest"]), "")
    rows = rebuilt.select("conv_id", F.unhex(hexes).alias("path"), F.transform("turns", lambda t: t["size"]).alias("sizes"))
    rows = landed(rows.select("*", F.unhex(F.md5("path")).alias("key")), "trie_paths")
    ends = (rows.select("key", "conv_id").repartition("key").sortWithinPartitions("key", "conv_id")
            .mapInArrow(_end_digests, "key binary, n_ends long, least long, ends_sha256 string"))
    return (rows.select(F.col("conv_id").alias("least"), "path", "sizes").join(ends, "least")
            .select("path", "sizes", "n_ends", "least", "ends_sha256"))


def trie_nodes(paths: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """One row per node of the trie of ``paths`` (distinct, as
    ``conversation_paths`` gives them)."""
    spark = paths.sparkSession
    folder = scratch_path(spark, "trie")
    paths.write.parquet(f"{folder}/paths")
    paths = spark.read.parquet(f"{folder}/paths")
    total = paths.agg(F.sum(F.size("sizes") + 1)).first()[0] or 0
    ranges = max(1, math.ceil(total / shard_turns))
    shards = (paths.repartitionByRange(ranges, "path").sortWithinPartitions("path")
              .mapInArrow(_shards(shard_turns), SHARD_SCHEMA))
    shards.write.parquet(f"{folder}/shards")
    shards = spark.read.parquet(f"{folder}/shards")
    spines = (shards.where("path is not null").select(*[f for f, _ in SPINE_ARROW])
              .repartition(1).sortWithinPartitions("path").mapInArrow(_merge_spines, NODE_SCHEMA))
    spines.write.parquet(f"{folder}/spines")
    spines = spark.read.parquet(f"{folder}/spines")
    own = shards.where("path is null")
    keys = spines.select("parent_key", F.col("conv_id").alias("above"))
    beneath = (own.where("parent_key is not null").join(keys, "parent_key")
               .withColumn("parent_conv_id", F.col("above")))
    return (own.where("parent_key is null").select(*RESULT).unionByName(beneath.select(*RESULT))
            .unionByName(spines.select(*RESULT)))


def conversation_trie(conversations: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256: one row per node of the rebuilt conversations."""
    turns = landed(ordered_turns(conversations), "trie_turns")
    return trie_nodes(conversation_paths(branched(turns)), shard_turns)
