"""Approximate nearest neighbours by inner product (op 11): learned partitions.

The nearest-neighbour graph of a bounded sample is cut into balanced parts
(spectral bisection, then moves that cut fewer links without unbalancing).  Two
small softmax classifiers are trained on the sample: ``place`` gives every
vector its part, ``route`` gives a query the share of its neighbours it expects
in each part.  A query visits its most probable parts until their probability
reaches a mass; the exact inner products of all vectors there rank its
neighbours.  The mass is not guessed: for a bounded set of queries the exact
neighbours are found among all vectors, and the least mass that reaches the
target recall on them is taken.

Inner product becomes nearness on the sphere by one more coordinate, sqrt(M^2 -
|x|^2) with M the largest norm, so long vectors are neighbours of more queries.

Plan: equal vectors are one candidate with their k + 1 smallest ids (all that a
top k can need) and equal queries are searched once, so a vector that a third of
all rows repeat costs one row.  Every part is cut into chunks of bounded size by a
hash, the queries of a part into packs; each chunk meets each pack in one row of
a join on (part, chunk), which returns k + 1 candidates per query.  Sample, graph
and classifiers are the only data on the driver; all three are bounded by
``SAMPLE`` vectors and ``MAX_PARTS`` parts.

Edge cases: a null id, and vectors null, empty, zero or with null or non-finite
components take no part; a shorter vector counts as padded with zeros; of rows
that repeat an id the smallest vector stands for it; a query's own id is no
neighbour, others with the same vector are; ties go to the smaller id; with fewer
than k others all are returned; an empty table gives an empty result; columns
other than id and vector are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keelson.session import scratch_path

__all__ = ["usable_vectors", "cut_graph", "Router", "fit", "calibrate", "nearest_vectors", "exact_neighbours"]

K = 20
SAMPLE = 1 << 14          # vectors that the graph and the classifiers see
SAMPLE_FLOATS = 1 << 23   # ... fewer of very long vectors
MAX_PARTS = 256
PART_ROWS = 1024          # distinct vectors wanted in a part
LINKS = 16                # neighbours of a node of the graph
CHUNK_FLOATS = 1 << 18    # of the vectors of a chunk, and of the queries of a pack
HELD = 1 << 18            # candidates that a task holds before it passes them on
CALIBRATION = 384         # queries whose exact neighbours are found among all vectors
TARGET_RECALL = 0.95


def usable_vectors(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vec): one finite non-zero vector per id."""
    vec = F.col(f"`{vector_col}`")
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (rows.select(F.col(f"`{id_col}`").cast("long").alias("id"), vec.alias("vec"))
            .where(F.col("id").isNotNull() & F.col("vec").isNotNull())
            .where(F.coalesce(finite, F.lit(False)) & F.exists("vec", lambda x: x != 0))
            .groupBy("id").agg(F.min("vec").alias("vec")))


def _padded(rows: DataFrame, dim: int) -> DataFrame:
    zeros = F.array_repeat(F.lit(0.0), F.lit(dim) - F.size("vec")).cast(rows.schema["vec"].dataType)
    return rows.withColumn("vec", F.when(F.size("vec") < dim, F.concat("vec", zeros)).otherwise(F.col("vec")))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = np.asarray(column.flatten(), dtype=np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


# ------------------------------------------------------------------ the graph

def _bisected(nodes: np.ndarray, links: np.ndarray, n: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Two halves along the second eigenvector of the random walk, by power iteration."""
    place = np.full(n, -1)
    place[nodes] = np.arange(len(nodes))
    inner = place[links]
    inner = inner[(inner >= 0).all(axis=1)]
    degree = np.bincount(inner[:, 0], minlength=len(nodes)) + 1.0
    v = rng.standard_normal(len(nodes))
    for _ in range(60):
        v -= (v * degree).sum() / degree.sum()
        v = (v + np.bincount(inner[:, 0], weights=v[inner[:, 1]], minlength=len(nodes)) / degree) / 2
        v /= max(np.abs(v).max(), 1e-300)
    order = np.argsort(v, kind="stable")
    half = len(nodes) // 2
    return nodes[order[:half]], nodes[order[half:]]


def cut_graph(neighbours: np.ndarray, parts: int, slack: float = 1.05, rounds: int = 10, seed: int = 0) -> np.ndarray:
    """The part of each node: balanced parts of a neighbour graph that cut few links."""
    n, rng = len(neighbours), np.random.default_rng(seed)
    one = np.stack([np.repeat(np.arange(n), neighbours.shape[1]), neighbours.reshape(-1)], axis=1)
    links = np.concatenate([one, one[:, ::-1]])
    groups = [np.arange(n)]
    while len(groups) < parts:
        groups = [half for g in groups for half in _bisected(g, links, n, rng)]
    part = np.empty(n, dtype=np.int64)
    for k, g in enumerate(groups):
        part[g] = k
    most = math.ceil(slack * n / parts)
    for _ in range(rounds):
        count = np.bincount(links[:, 0] * parts + part[links[:, 1]], minlength=n * parts).reshape(n, parts)
        to = count.argmax(axis=1)
        gain = count[np.arange(n), to] - count[np.arange(n), part]
        size = np.bincount(part, minlength=parts)
        wishes = np.flatnonzero((gain > 0) & (rng.random(n) < 0.5))     # half at a time, lest neighbours swap
        for i in wishes[np.argsort(-gain[wishes], kind="stable")]:
            if size[to[i]] < most:
                size[part[i]] -= 1
                size[to[i]] += 1
                part[i] = to[i]
        if not len(wishes):
            break
    return part


# ------------------------------------------------------------- the classifiers

def _train(features: np.ndarray, shares: np.ndarray, epochs: int = 25, batch: int = 256, rate: float = 0.02,
           seed: int = 0) -> np.ndarray:
    """Softmax regression on target shares, by Adam."""
    rng = np.random.default_rng(seed)
    x = np.concatenate([features, np.ones((len(features), 1))], axis=1)
    w = np.zeros((x.shape[1], shares.shape[1]))
    m, v, step = np.zeros_like(w), np.zeros_like(w), 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), batch):
            rows = order[at:at + batch]
            gap = x[rows].T @ (_softmax(x[rows] @ w) - shares[rows]) / len(rows)
            step += 1
            m = 0.9 * m + 0.1 * gap
            v = 0.999 * v + 0.001 * gap * gap
            w -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return w


def _softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


class Router(NamedTuple):
    """The trained classifiers and the mass that a query's parts must reach."""

    norm: float            # the largest norm
    place_weights: np.ndarray
    route_weights: np.ndarray
    mass: float = 1.0

    @property
    def parts(self) -> int:
        return self.place_weights.shape[1]

    def lifted(self, x: np.ndarray) -> np.ndarray:
        """Candidates on the sphere: one more coordinate fills up the norm."""
        unit = x / self.norm
        return np.concatenate([unit, np.sqrt(np.maximum(0.0, 1.0 - (unit ** 2).sum(axis=1, keepdims=True)))], axis=1)

    @staticmethod
    def directions(x: np.ndarray) -> np.ndarray:
        unit = x / np.abs(x).max(axis=1, keepdims=True)
        return np.concatenate([unit / np.linalg.norm(unit, axis=1, keepdims=True), np.zeros((len(x), 1))], axis=1)

    @staticmethod
    def _scores(features: np.ndarray, weights: np.ndarray) -> np.ndarray:
        return math.sqrt(features.shape[1]) * features @ weights[:-1] + weights[-1]

    def place(self, x: np.ndarray) -> np.ndarray:
        return self._scores(self.lifted(x), self.place_weights).argmax(axis=1)

    def mass_before(self, x: np.ndarray) -> np.ndarray:
        """Per query and part: the probability of all parts that come before it."""
        p = _softmax(self._scores(self.directions(x), self.route_weights))
        order = np.argsort(-p, axis=1, kind="stable")
        sorted_p = np.take_along_axis(p, order, axis=1)
        before = np.empty_like(p)
        np.put_along_axis(before, order, np.cumsum(sorted_p, axis=1) - sorted_p, axis=1)
        return before


def _links_of(sample: np.ndarray, queries: np.ndarray, links: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = np.asarray(batch.column(0))
            for at in range(0, len(nodes), 512):
                node = nodes[at:at + 512]
                near = queries[node] @ sample.T
                near[np.arange(len(node)), node] = -np.inf
                found = np.argpartition(-near, min(links, near.shape[1]) - 1, axis=1)[:, :links]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(node), pa.ListArray.from_arrays(np.arange(0, found.size + 1, found.shape[1], dtype=np.int32),
                                                              pa.array(found.reshape(-1), pa.int32()))],
                    names=["node", "near"])
    return run


def _sample_links(spark, sample: np.ndarray, queries: np.ndarray, links: int) -> np.ndarray:
    """The nearest sample rows of every sample row, found by Spark tasks."""
    nodes = spark.range(len(sample)).repartition(max(1, len(sample) // 1024))
    got = nodes.mapInArrow(_links_of(sample, queries, links), "node long, near array<int>").toArrow()
    out = np.empty((len(sample), links), dtype=np.int64)
    near = got.column("near").combine_chunks()
    out[np.asarray(got.column("node"))] = np.asarray(near.flatten()).reshape(-1, links)
    return out


def fit(vectors: DataFrame, n: int, norm: float, dim: int, part_rows: int = PART_ROWS, sample_rows: int = SAMPLE) -> Router:
    """The classifiers, from a seeded sample of at most ``sample_rows`` of the
    ``n`` distinct vectors (key, vec)."""
    spark = vectors.sparkSession
    rows = min(sample_rows, max(1, SAMPLE_FLOATS // dim))
    sample = _matrix(vectors.orderBy(F.xxhash64(F.lit(11), "key"), "key").limit(rows).select("vec")
                     .toArrow().column("vec").combine_chunks())
    most = min(MAX_PARTS, max(1, len(sample) // 64))
    parts = 1 << max(0, min(int(math.log2(most)), round(math.log2(max(1.0, n / part_rows)))))
    blank = Router(norm, np.zeros((dim + 2, 1)), np.zeros((dim + 2, 1)))
    if parts == 1:
        return blank
    lifted, directions = blank.lifted(sample), blank.directions(sample)
    links = min(LINKS, len(sample) - 1)
    part = cut_graph(_sample_links(spark, lifted, lifted, links), parts)
    scale = math.sqrt(dim + 1)
    placed = Router(norm, _train(scale * lifted, np.eye(parts)[part]), np.zeros((dim + 2, parts)))
    part = placed.place(sample)                         # as all vectors will be placed
    shares = np.zeros((len(sample), parts))
    near = _sample_links(spark, lifted, directions, links)
    np.add.at(shares, (np.repeat(np.arange(len(sample)), links), part[near.reshape(-1)]), 1.0 / links)
    return placed._replace(route_weights=_train(scale * directions, shares))


# ------------------------------------------------------------------ exact work

def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of paired rows, summed in the order of the components, so
    that a pair has one value wherever it is met."""
    out = np.zeros(len(a))
    for k in range(a.shape[1]):
        out += a[:, k] * b[:, k]
    return out


def _best(queries: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, product) of the k largest products of every query, with all
    that may tie with the last of them."""
    near = queries @ rows.T
    reach = 1e-12 * np.linalg.norm(queries, axis=1) * np.linalg.norm(rows, axis=1).max()
    kth = np.partition(near, len(rows) - k, axis=1)[:, len(rows) - k] if k < len(rows) else np.full(len(queries), -np.inf)
    q, r = np.nonzero(near >= (kth - reach)[:, None])
    return q, r, _products(queries[q], rows[r])


def exact_neighbours(vectors: DataFrame, queries: np.ndarray, k: int, router: Router | None = None) -> DataFrame:
    """(query, key, score, part) of the k distinct vectors with the largest inner
    products, among all rows of ``vectors`` (key, vec); for a bounded set of queries."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, rows = np.asarray(batch.column(0)), _matrix(batch.column(1))
            if len(rows):
                q, r, score = _best(queries, rows, k)
                part = router.place(rows) if router is not None else np.zeros(len(rows), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(keys[r]), pa.array(score), pa.array(part[r])],
                                                 names=["query", "key", "score", "part"])
    met = vectors.select("key", "vec").mapInArrow(run, "query long, key long, score double, part long")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "key"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank")


def calibrate(router: Router, vectors: DataFrame, queries: DataFrame, k: int, target: float = TARGET_RECALL,
              calibration: int = CALIBRATION) -> Router:
    """The router with the least mass that finds ``target`` of the exact
    neighbours of ``calibration`` seeded queries."""
    if router.parts == 1:
        return router
    chosen = queries.orderBy(F.xxhash64(F.lit(12), "key"), "key").limit(calibration).select("vec").toArrow()
    asked = _matrix(chosen.column("vec").combine_chunks())
    if not len(asked):
        return router
    got = exact_neighbours(vectors, asked, k + 1, router).toArrow()
    query, part, score = (np.asarray(got.column(c)) for c in ("query", "part", "score"))
    own = np.abs(score - (asked ** 2).sum(axis=1)[query]) <= 1e-9 * np.abs(score)     # its own vector says nothing
    before = np.sort(router.mass_before(asked)[query[~own], part[~own]])
    if not len(before):
        return router
    last = before[min(len(before) - 1, math.ceil(target * len(before)) - 1)]
    return router._replace(mass=float(np.nextafter(last, 2.0)))


# ------------------------------------------------------------------ the search

def _place_batches(router: Router) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(router.place(_matrix(batch.column(1))), pa.int32())],
                                                 names=[*batch.schema.names, "part"])
    return run


def _route_batches(router: Router) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                query, part = np.nonzero(router.mass_before(_matrix(batch.column(1))) < router.mass)
                ends = np.concatenate([[0], np.cumsum(np.bincount(query, minlength=batch.num_rows))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.ListArray.from_arrays(ends, pa.array(part, pa.int32()))],
                    names=[*batch.schema.names, "parts"])
    return run


def _reduced(rows: list[pa.RecordBatch], k: int) -> pa.RecordBatch:
    """The k best vectors of every query, with all that tie with the last."""
    t = pa.Table.from_batches(rows).combine_chunks().to_batches()[0]
    key, score = np.asarray(t.column(0)), np.asarray(t.column(1))
    order = np.lexsort((-score, key))
    sorted_key, sorted_score = key[order], score[order]
    first = np.flatnonzero(np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]]))
    size = np.diff(np.concatenate([first, [len(key)]]))
    kth = sorted_score[first + np.minimum(size, k) - 1]
    return t.take(pa.array(order[sorted_score >= np.repeat(kth, size)]))


def _meet_batches(k: int) -> Callable:
    """A task keeps the best of each query over all the chunks it meets, in a
    bounded buffer, so a query leaves it with about k candidates."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                asked, rows = batch.column(0)[i].values, batch.column(1)[i].values
                q, r, score = _best(_matrix(asked.field("vec")), _matrix(rows.field("vec")), k)
                held.append(pa.RecordBatch.from_arrays(
                    [asked.field("key").take(pa.array(q)), pa.array(score), rows.field("ids").take(pa.array(r))],
                    names=["key", "score", "ids"]))
                n += len(q)
                if n > HELD:
                    held = [_reduced(held, k)]
                    n = held[0].num_rows
                    if n > HELD // 2:
                        yield from held
                        held, n = [], 0
        if n:
            yield _reduced(held, k)
    return run


def _chunked(rows: DataFrame, sizes: DataFrame, name: str) -> DataFrame:
    """Rows with their chunk, by a hash of the key; ``sizes`` (part, chunks) has a
    row per part, at most MAX_PARTS."""
    return (rows.join(F.broadcast(sizes), "part")
            .withColumn(name, F.pmod(F.xxhash64(F.lit(13), "key"), F.col("chunks")).cast("int")))


def nearest_vectors(vectors: DataFrame, queries: DataFrame, k: int = K, *, part_rows: int = PART_ROWS,
                    sample_rows: int = SAMPLE, target: float = TARGET_RECALL, chunk_floats: int = CHUNK_FLOATS) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found for every row of
    ``queries``; both tables are (id, vec) as ``usable_vectors`` gives them."""
    spark = vectors.sparkSession
    path = scratch_path(spark, "partitions")

    def written(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{path}/{name}")
        return spark.read.parquet(f"{path}/{name}")

    keep = k + 1                                         # the query itself may be among them
    dim = vectors.select(F.size("vec").alias("n")).union(queries.select(F.size("vec"))).agg(F.max("n")).first()[0]
    if dim is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    vectors, queries = _padded(vectors, dim), _padded(queries, dim)
    nth = F.row_number().over(Window.partitionBy("vec").orderBy("id"))
    groups = written(vectors.withColumn("nth", nth).where(F.col("nth") <= keep)
                     .groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids"))
                     .select(F.col("ids")[0].alias("key"), "vec", "ids"), "groups")
    asked = written(queries.groupBy("vec").agg(F.min("id").alias("key")).select("key", "vec"), "asked")
    length = F.sqrt(F.aggregate("vec", F.lit(0.0).cast("double"), lambda s, x: s + x.cast("double") * x.cast("double")))
    n, norm = groups.agg(F.count(F.lit(1)), F.max(length)).first()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    router = calibrate(fit(groups, n, norm, dim, part_rows, sample_rows), groups, asked, k, target)

    kind = groups.schema["vec"].dataType.simpleString()
    chunk_rows = max(32, chunk_floats // dim)
    chunks = F.ceil(F.count(F.lit(1)) / F.lit(chunk_rows)).cast("int").alias("chunks")
    placed = written(groups.select("key", "vec", "ids").mapInArrow(
        _place_batches(router), f"key long, vec {kind}, ids array<long>, part int"), "placed")
    part_chunks = written(placed.groupBy("part").agg(chunks), "part_chunks")
    base = (_chunked(placed, part_chunks, "chunk").groupBy("part", "chunk")
            .agg(F.collect_list(F.struct("ids", "vec")).alias("rows")))
    routed = written(asked.select("key", "vec").mapInArrow(_route_batches(router), f"key long, vec {kind}, parts array<int>")
                     .select("key", "vec", F.explode("parts").alias("part")), "routed")
    packs = (_chunked(routed, routed.groupBy("part").agg(chunks), "pack").drop("chunks")
             .join(F.broadcast(part_chunks), "part")
             .withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
             .groupBy("part", "chunk", "pack").agg(F.collect_list(F.struct("key", "vec")).alias("asked")))
    met = (packs.join(base, ["part", "chunk"]).select("asked", "rows")
           .mapInArrow(_meet_batches(keep), "key long, score double, ids array<long>"))
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), "vec_id"))
    best = written(met.select("key", "score", F.explode("ids").alias("vec_id"))
                   .withColumn("nth", rank).where(F.col("nth") <= keep).drop("nth"), "best")
    who = queries.select(F.col("id").alias("query_id"), "vec").join(asked, "vec").select("query_id", "key")
    found = who.join(best, "key").where(F.col("vec_id") != F.col("query_id"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return (found.withColumn("rank", place).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
