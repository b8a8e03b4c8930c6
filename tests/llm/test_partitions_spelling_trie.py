import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from keelson.llm import partitions, spelling, turntrie

# ------------------------------------------------------------------- op 11

VEC = "vec_id long, embedding array<float>, id long, key long, vec string, part int, chunk int"


def vectors_of(spark, rows):
    extra = ["vec_id", "embedding", "id", "key", "vec", "part", "chunk"]
    df = spark.createDataFrame([(i, v, 7, 7, "x", 7, 7) for i, v in rows], VEC).select(*extra).repartition(3)
    return partitions.usable_vectors(df, "vec_id", "embedding")


def brute_nearest(rows, queries, k):
    best = {}
    for i, v in rows:
        if i is None or v is None or not len(v) or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            continue
        best[i] = min(best.get(i, v), v)
    dim = max(len(v) for v in best.values())
    ids = np.array(sorted(best))
    x = np.array([list(best[i]) + [0.0] * (dim - len(best[i])) for i in ids], dtype=np.float32).astype(float)
    out = {}
    for q in queries:
        if q in best:
            score = x @ x[np.flatnonzero(ids == q)[0]]
            order = [i for i in np.lexsort((ids, -score)) if ids[i] != q][:k]
            out[q] = [(int(ids[i]), float(score[i])) for i in order]
    return out


def found_nearest(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert len(out[r["query_id"]]) == r["rank"]
    return out


def test_nearest_recall_on_hard_vectors(spark):
    """No clusters, norms that differ: the calibrated mass still reaches the recall."""
    rng = np.random.default_rng(1)
    x = rng.standard_normal((3000, 24)) * rng.uniform(0.5, 2.0, (3000, 1))
    rows = [(i, v) for i, v in enumerate(x.astype(np.float32).tolist())]
    v = vectors_of(spark, rows).cache()
    got = found_nearest(partitions.nearest_vectors(v, v.where("id % 20 = 0"), 20, part_rows=100, sample_rows=2000))
    want = brute_nearest(rows, range(0, 3000, 20), 20)
    assert set(got) == set(want) and all(len(g) == 20 for g in got.values())
    recall = np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want])
    assert recall >= 0.9
    exact = dict((q, dict(w)) for q, w in brute_nearest(rows, range(0, 3000, 20), 3000).items())
    for q, g in got.items():
        assert all(abs(exact[q][i] - s) < 1e-9 for i, s in g)
        assert g == sorted(g, key=lambda p: (-p[1], p[0]))


def test_router_sends_clustered_queries_to_few_parts(spark):
    rng = np.random.default_rng(2)
    centre = rng.standard_normal((16, 16))
    x = centre[np.arange(2000) % 16] + 0.1 * rng.standard_normal((2000, 16))
    rows = [(i, v) for i, v in enumerate((x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32).tolist())]
    v = vectors_of(spark, rows).select(F.col("id").alias("key"), "vec").cache()
    router = partitions.calibrate(partitions.fit(v, 2000, 1.0, 16, part_rows=125), v, v.where("key % 20 = 0"), 20)
    before = router.mass_before(np.array([r for _, r in rows]))
    assert router.parts == 16 and (before < router.mass).sum(axis=1).mean() < 6


def test_graph_cut_is_balanced():
    rng = np.random.default_rng(3)
    group = np.arange(800) // 100
    near = np.stack([rng.choice(np.flatnonzero(group == g), 10) for g in group])
    part = partitions.cut_graph(near, 8)
    sizes = np.bincount(part, minlength=8)
    assert sizes.max() <= 106 and (part[near] == part[:, None]).mean() > 0.8


def test_nearest_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rng = random.Random(4)
    rows = [(i, [rng.choice([-1.0, 0.0, 1.0]) for _ in range(4)]) for i in range(60)]
    rows += [(100, None), (101, []), (102, [0.0] * 4), (103, [1.0, nan, 0.0, 0.0]), (104, [inf, 0.0, 0.0, 1.0]),
             (105, [1.0, None, 0.0, 0.0]), (None, [1.0, 1.0, 1.0, 1.0]), (106, [2.0]), (7, rows[7][1]), (8, [3.0, 0.0, 0.0, 0.0])]
    rows += [(200 + i, [1.0, 1.0, 0.0, 1.0]) for i in range(80)]            # one vector, many ids
    v = vectors_of(spark, rows)
    queries = [0, 7, 8, 20, 40, 100, 102, 106, 200, 220, 240]
    got = found_nearest(partitions.nearest_vectors(v, v.where(F.col("id").isin(queries)), 20, chunk_floats=64))
    want = brute_nearest(rows, queries, 20)
    assert {q: [(i, round(s, 9)) for i, s in g] for q, g in got.items()} == {q: [(i, round(s, 9)) for i, s in g] for q, g in want.items()}


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [2.0, 1.0]), (3, [1.0, 2.0])]])
def test_nearest_few_rows(spark, rows):
    v = vectors_of(spark, rows) if rows else partitions.usable_vectors(spark.createDataFrame([], VEC), "vec_id", "embedding")
    got = found_nearest(partitions.nearest_vectors(v, v, 20))
    assert got == {q: g for q, g in (brute_nearest(rows, [1, 2, 3], 20) if rows else {}).items() if g}


# ------------------------------------------------------------------- op 12

def brute_words(rows):
    n = {}
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate({i: i + 32 for i in range(65, 91)})
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] = n.get(run, 0) + 1
    return {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}


def edit_one(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_variants(rows):
    n = brute_words(rows)
    near = {w: [v for v in n if edit_one(v, w)] for w in n}
    best = {w: min(near[w], key=lambda v: (-n[v], v)) if near[w] else None for w in n}
    form = {w: b if b is not None and n[b] >= 10 * n[w] else None for w, b in best.items()}

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w
    return sorted((w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n)


def spelled(df):
    got = spelling.spelling_variants(df).select("word", "form", "root", "n", "n_near", "form_n").collect()
    return sorted(map(tuple, got))


def variant_rows(seed, docs=60):
    rng = random.Random(seed)
    stems = ["".join(rng.choice("abÀé") for _ in range(rng.randint(6, 11))) for _ in range(12)]
    rows = []
    for i in range(docs):
        words = []
        for _ in range(60):
            w = rng.choice(stems[:3] if rng.random() < 0.7 else stems)
            if rng.random() < 0.25:
                k = rng.randrange(len(w))
                w = rng.choice([w[:k] + w[k + 1:], w[:k] + rng.choice("abcÉß") + w[k:], w[:k] + rng.choice("abcÿ") + w[k + 1:]])
            words.append(w.upper() if rng.random() < 0.1 and w.isascii() else w)
        rows.append((i, rng.choice([" ", "-", "_\n", "1"]).join(words)))
    return rows


def test_variants_match_brute_force(spark):
    rows = variant_rows(1)
    rows += [(None, "abababab " * 3), (900, None), (901, ""), (902, "12 _ !"), (903, "x" * 5000 + " " + "x" * 5001), (904, "x" * 5000 + " " + "x" * 5001)]
    rows.append(rows[5])
    df = (spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
          .select("*", *[F.lit("extra").alias(c) for c in ("word", "n", "form", "root", "short", "half", "chunk", "k")]))
    want = brute_variants(rows)
    assert spelled(df) == want
    assert any(r[2] not in (r[0], r[1]) for r in want) or any(r[1] for r in want)


def test_variants_in_small_chunks(spark):
    """Blocks of several chunks meet in units; each pair counts once."""
    rng = random.Random(9)
    words = sorted({"abcd" + "".join(rng.choice("xyz") for _ in range(rng.choice([4, 4, 5]))) for _ in range(160)})
    n = {w: rng.choice([2, 3, 50]) for w in words}
    table = spark.createDataFrame(list(n.items()), "word string, n long")
    got = {r["word"]: (r["n_near"], r["best_n"], r["best"]) for r in spelling.near_words(table, chunk_words=5).collect()}
    want = {}
    for w in words:
        near = [v for v in words if edit_one(v, w)]
        if near:
            best = min(near, key=lambda v: (-n[v], v))
            want[w] = (len(near), n[best], best)
    assert got == want


def test_forms_are_followed_to_the_last(spark):
    forms = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(9)] + [("a", "w3"), ("z", "y")], "word string, form string")
    got = {r["word"]: r["root"] for r in spelling.follow_forms(forms).collect()}
    assert got == {**{f"w{i}": "w9" for i in range(9)}, "a": "w9", "z": "y"}


def test_variants_empty(no_docs):
    assert spelling.spelling_variants(no_docs).count() == 0


# ------------------------------------------------------------------- op 13

def test_findclose_matches_a_stack():
    rng = random.Random(1)
    for size in (1, 2, 31, 400):
        steps, depth = [1], 1
        while len(steps) < 2 * size - depth:
            up = depth == 1 or rng.random() < 0.5
            steps.append(1 if up else -1)
            depth += steps[-1]
        steps += [-1] * depth
        stack, close, leaves = [], {}, {}
        for i, s in enumerate(steps):
            if s > 0:
                stack.append(i)
            else:
                close[stack.pop()] = i
        p = turntrie.Parentheses(np.array(steps), width=4)
        assert dict(zip(p.opens.tolist(), p.findclose(p.opens).tolist())) == close
        for o, c in close.items():
            leaves[o] = sum(steps[i] > 0 and steps[i + 1] < 0 for i in range(o, c))
        assert dict(zip(p.opens.tolist(), p.pairs(p.opens, p.findclose(p.opens)).tolist())) == leaves


def brute_trie(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [(r, t) for _, r, t in sorted(v)] for c, v in own.items()}
    path = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        path[c] = tuple(own.get(c - int(math.fmod(c, 5)), [])[:h] + turns[h:])
    member = {}
    for c, p in path.items():
        for d in range(len(p) + 1):
            member.setdefault(p[:d], []).append(c)
    child = {}
    for p in member:
        if p:
            child.setdefault(p[:-1], []).append(p)
    out = []
    for p, convs in member.items():
        inside = [q for q in member if q[:len(p)] == p]
        ends = ",".join(map(str, sorted(c for c in convs if path[c] == p)))
        out.append((min(convs), len(p), min(member[p[:-1]]) if p else None, len(convs), len(child.get(p, [])),
                    sum(q not in child for q in inside), sum((len(member[q]) - 1) * len(q[-1][1].encode()) for q in inside if q),
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def talk_rows(seed, convs=120):
    rng = random.Random(seed)
    rows = []
    for c in range(-7, convs):
        for t in range(rng.choice([0, 1, 2, 3, 4, 9, 12])):
            text = rng.choice(["hi", "hi", "hi", "yes é", "no", ""]) if rng.random() < 0.8 else f"own {c} {t}"
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", text))
    for c in range(300, 340):                                    # equal conversations
        rows += [(c, 0, "user", "same"), (c, 1, "assistant", "same too")]
    rows += [(400 + 5 * k, t, "user", f"turn {min(t, 3 * k)}") for k in range(6) for t in range(30)]
    rows += [(500, None, "user", "first"), (500, 2, None, "x"), (500, 2, "a", None), (500, 2, "a", None), (500, 1, "b", "c"),
             (501, 0, None, None), (None, 0, "user", "nobody's"), (502, 0, "ab", "c"), (503, 0, "a", "bc")]
    rng.shuffle(rows)
    return rows


TURNS = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("shard_turns", [3, 40, 1 << 17])
def test_trie_matches_brute_force(spark, shard_turns):
    rows = talk_rows(3)
    df = (spark.createDataFrame(rows, TURNS).repartition(4)
          .select("*", *[F.lit("extra").alias(c) for c in ("path", "sizes", "turns", "h", "base", "key", "least", "depth")]))
    got = turntrie.conversation_trie(df, shard_turns).select(*turntrie.RESULT).collect()
    assert sorted(map(tuple, got), key=str) == brute_trie(rows)


def test_trie_empty_and_single(spark):
    assert turntrie.conversation_trie(spark.createDataFrame([], TURNS)).count() == 0
    rows = [(5, 0, "user", "é")]
    got = turntrie.conversation_trie(spark.createDataFrame(rows, TURNS)).collect()
    assert sorted(map(tuple, got), key=str) == brute_trie(rows)
