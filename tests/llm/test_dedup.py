import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from keelson.llm import components, jaccard, passages, search, suffixes
from tests.llm.conftest import DOC_SCHEMA, make_docs, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# --------------------------------------------------------------------- op 1

def brute_suffixes(rows, width=100):
    seen, out = set(), []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        b = (text or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - width + 1):
            if b[p:p + width] in seen:
                gone[p:p + width] = b"\1" * width
            seen.add(b[p:p + width])
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        out.append((doc_id, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_cover_has_every_difference():
    d = suffixes.DIFFERENCE_COVER
    assert {(a - b) % suffixes.COVER_PERIOD for a in d for b in d} == set(range(suffixes.COVER_PERIOD))


def test_suffixes_match_brute_force(odd_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    got = suffixes.repeated_bytes(odd_docs, block_bytes=3000, bucket_bytes=20_000)
    assert sorted(map(tuple, got.collect()), key=str) == brute_suffixes(rows)


def test_suffixes_shifted_runs(spark):
    """Repeats of every length around the window, at shifted offsets, in runs."""
    rng = random.Random(5)
    base = "".join(rng.choice("abcdefgh") for _ in range(400))
    texts = ["".join(rng.choice("xyz") for _ in range(rng.randrange(40))) + base[a:a + n]
             + "".join(rng.choice("xyz") for _ in range(rng.randrange(40)))
             for a, n in [(0, 400), (7, 99), (8, 100), (9, 101), (100, 157), (33, 156), (250, 150), (0, 100)]]
    texts += ["ab" * 300, "a" * 500, "a" * 99, "é" * 60]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = suffixes.repeated_bytes(df.repartition(4), block_bytes=700, bucket_bytes=1000)
    assert sorted(map(tuple, got.collect()), key=str) == brute_suffixes(list(enumerate(texts)))


def test_suffixes_empty(no_docs):
    assert suffixes.repeated_bytes(no_docs).count() == 0


# --------------------------------------------------------------------- op 2

def brute_best_chain(matches, gap=passages.GAP_COST, k=passages.K):
    best = {}
    for p, s in sorted(matches):
        best[p, s] = max([float(k)] + [
            v + k - gap * ((p - q) + (s - t)) for (q, t), v in best.items() if q < p and t < s])
    return max(best.values())


@pytest.mark.parametrize("seed", range(5))
def test_chain_is_best(seed):
    rng = random.Random(seed)
    matches = sorted({(rng.randrange(40), rng.randrange(40)) for _ in range(25)})
    chains = passages.chain_matches(np.array([m[0] for m in matches]), np.array([m[1] for m in matches]))
    assert sorted(m for c in chains for m in c) == matches

    def score(chain):
        return passages.K + sum(
            passages.K - passages.GAP_COST * ((p - q) + (s - t)) for (q, t), (p, s) in zip(chain, chain[1:]))
    assert abs(score(chains[0]) - brute_best_chain(matches)) < 1e-9
    for c in chains:
        assert all(q < p and t < s for (q, t), (p, s) in zip(c, c[1:]))


def test_passages_exact_fuzzy_and_hot(spark):
    rng = random.Random(9)
    passage, own = words(rng, 80, 10**6), lambda n: words(rng, n, 10**6)
    rows, want = [], {}
    for i in range(60):
        if i % 3 == 0:                                   # the hot passage, most of it in every third document
            cut = list(passage)
            if i:
                cut[20] = f"edit{i}"
                cut.insert(50, f"more{i}")
            before = own(rng.randrange(5, 60))
            rows.append((i, " ".join(before + cut + own(30))))
            if i:
                want[i] = (len(before), len(cut))
        else:
            rows.append((i, " ".join(own(rng.randrange(5, 120)))))
    rows += [(100, None), (101, ""), (102, "few words only")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r for r in passages.shared_passages(df, block_bytes=2000, bucket_bytes=10_000).collect()}
    assert set(got) == set(want)
    for i, (start, n) in want.items():
        assert got[i]["start_word"] == start and got[i]["n_words"] == n and got[i]["src_doc_id"] < i
        assert n - 6 <= got[i]["n_matched"] <= n
    cleaned = {r["doc_id"]: r["text"] for r in passages.remove_passages(df).collect()}
    text = dict(rows)
    for i, t in cleaned.items():
        if i in want:
            w = text[i].split()
            assert t.split() == w[:want[i][0]] + w[sum(want[i]):]
        else:
            assert t == text[i]
    assert set(cleaned) == set(text)


def test_passages_phrases_far_apart_stay(spark):
    rng = random.Random(12)
    own = lambda n: words(rng, n, 10**6)
    phrases, long, near = [own(20) for _ in range(6)], [own(45), own(45)], [own(30), own(30)]

    def page(parts, gap):
        return " ".join(own(20) + [w for part in parts for w in part + own(gap)])
    rows = [(0, page(phrases, 40)), (1, page(phrases[:2], 40)), (2, page(phrases, 40)),     # a form, filled in
            (3, page(long, 40)), (4, page(long, 40)),
            (5, page(near, 8)), (6, page(near, 8))]
    for i in range(10, 30, 2):
        pair = [own(20), own(20)]
        rows += [(i, page(pair, 50)), (i + 1, page(pair, 50))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"], r["start_word"], r["n_words"], r["src_doc_id"], r["src_start_word"], r["n_matched"])
                 for r in passages.shared_passages(df).collect())
    assert got == [(4, 20, 45, 3, 20, 45), (4, 105, 45, 3, 105, 45),      # the words between are its own
                   (6, 20, 68, 5, 20, 60)]                                # eight other words in sixty equal ones
    left = {r["doc_id"]: r["text"] for r in passages.remove_passages(df).collect()}
    assert all(t == left[i] for i, t in rows if i not in (4, 6))
    w = rows[4][1].split()
    assert left[4].split() == w[:20] + w[65:105] + w[150:]


@pytest.mark.parametrize("seed", range(5))
def test_edit_matches(seed):
    rng = random.Random(seed)
    a, b = ([rng.randrange(6) for _ in range(rng.randrange(1, 70))] for _ in "ab")
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, j in itertools.product(range(len(a)), range(len(b))):
        best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
    pairs = [(i, j) for i, j in enumerate(passages._edit_matches(a, b)) if j >= 0]
    assert len(pairs) == best[-1][-1] and all(a[i] == b[j] for i, j in pairs)
    assert all(i < k and j < n for (i, j), (k, n) in zip(pairs, pairs[1:]))


def test_passages_odd_input(odd_docs, no_docs):
    out = passages.remove_passages(odd_docs)
    assert out.columns == odd_docs.columns
    assert passages.shared_passages(no_docs).count() == 0 and passages.remove_passages(no_docs).count() == 0
    left = {r["doc_id"] for r in out.collect()}
    assert 0 in left and 49 not in left                  # 10, 23... are whole copies of 3


def test_passages_keep_one_of_repeated_rows(spark):
    rng = random.Random(13)
    own = lambda n: words(rng, n, 10**6)
    passage = own(50)
    whole, part, other, mine = " ".join(own(60)), own(60), " ".join(own(70)), " ".join(own(20))
    rows = ([(1, " ".join(passage + own(10)), "a")] + [(5, whole, f"c{i}") for i in range(4)]
            + [(6, " ".join(passage + part), f"d{i}") for i in range(3)]       # a passage of row 1, repeated
            + [(None, other, f"e{i}") for i in range(3)] + [(None, mine, "f"), (None, mine, "g")] + [(None, None, "h")] * 2)
    df = spark.createDataFrame(rows, "doc_id long, text string, tag string").repartition(3)
    left = passages.remove_passages(df, block_bytes=600).collect()
    texts = sorted((r["doc_id"] or 0, (r["text"] or "").strip()) for r in left)
    assert texts == sorted([(1, rows[0][1]), (5, whole), (6, " ".join(part)), (0, other), (0, mine), (0, mine), (0, ""), (0, "")])
    assert {r["tag"] for r in left} >= {"a", "f", "g", "h"}


# --------------------------------------------------------------------- op 3

def brute_search(codes, k):
    out = []
    for q, c in codes:
        if q % 100 == 0:
            d = sorted((bin((c ^ x) & (2**64 - 1)).count("1"), i) for i, x in codes if i != q)
            out += [(q, r + 1, i, h) for r, (h, i) in enumerate(d[:k])]
    return sorted(out)


def test_search_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    X = rng.normal(size=(900, 64)).astype(np.float32)
    X[100:140] = X[0]                                    # a hot vector, ties
    X[200:230] = X[200] + 0.01 * rng.normal(size=(30, 64))
    rows = [(i, X[i].tolist(), None) for i in range(900)] + [(901, None, 1), (902, [], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    codes = search.binary_codes(df, "vec_id", "embedding")
    held = [(r["id"], r["code"]) for r in codes.collect()]
    assert len(held) == 900
    assert all(((c >> b) & 1) == int(X[i, b] > 0) for i, c in held[:20] for b in range(64))
    got = search.nearest_codes(codes, codes.where("id % 100 = 0"), k=7)
    assert sorted(map(tuple, got.collect())) == brute_search(held, 7)


def test_search_counts_repeated_rows_once(spark):
    rows = [(7, 1)] * 12 + [(8, 1)] + [(i, 1 << 40 | i << 8) for i in range(20, 32)] + [(100, 1)]
    codes = spark.createDataFrame(rows, "id long, code long").repartition(3)
    got = search.nearest_codes(codes, codes.where("id = 100"), k=10)
    assert sorted(map(tuple, got.collect())) == brute_search(sorted(set(rows)), 10)


def test_search_ignores_columns_of_clashing_names(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=64).tolist(), 7, 7, 7, "x") for i in range(120)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, id long, code long, segment int, query string")
    codes = search.binary_codes(df, "vec_id", "embedding")
    held = [(r["id"], r["code"]) for r in codes.collect()]
    wide = codes.select("*", *[F.lit(9).alias(c) for c in ("segment", "value", "query", "distance", "nth", "bound")])
    got = search.nearest_codes(wide, wide.where("id % 100 = 0"), k=5)
    assert sorted(map(tuple, got.collect())) == brute_search(held, 5)


def test_search_few_rows_and_projections(spark):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(i, rng.normal(size=200).tolist()) for i in range(4)], "vec_id long, embedding array<double>")
    codes = search.binary_codes(df, "vec_id", "embedding")
    held = [(r["id"], r["code"]) for r in codes.collect()]
    got = search.nearest_codes(codes, codes.where("id % 100 = 0"), k=10)
    assert sorted(map(tuple, got.collect())) == brute_search(held, 10)
    assert sum(search.segment_widths(50_000)) == 64
    empty = codes.where("id < 0")
    assert search.nearest_codes(empty, empty).count() == 0


# --------------------------------------------------------------------- op 7

def shingles(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return ({tuple(w)} if 0 < len(w) < 5 else set()) | {tuple(w[k:k + 5]) for k in range(len(w) - 4)}


def brute_components(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for (a, s), (b, t) in itertools.combinations(sets, 2):
        if s and t and 100 * len(s & t) >= 80 * len(s | t):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return sorted((i, len(s), find(i)) for i, s in sets)


def test_components_of_chains_and_stars(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, i) for i in range(200, 260)] + [(7, 7), (None, 3)]
    rng.shuffle(edges)
    got = dict(map(tuple, components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{i: 100 for i in range(100, 161)}, **{i: 5 for i in (5, *range(200, 260))}}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def near_rows():
    rng = random.Random(8)
    rows = [(r[0], r[1]) for r in make_docs(3)[:-1]]
    base = words(rng, 70, 10**6)
    for i in range(120):                                 # a large group, linked and not quite linked
        w = list(base)
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = f"new{i}"
        rows.append((1000 + i, " ".join(w) + (" tail" * (i % 25))))
    rows += [(2000, "A b C"), (2001, "a B c"), (2002, "a b c d"), (2003, None), (2004, " ")]
    return rows


def test_jaccard_matches_brute_force(spark, monkeypatch):
    rows = near_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = brute_components(rows)
    assert sorted(map(tuple, jaccard.near_copy_components(df).collect())) == want
    monkeypatch.setattr(jaccard.similarity_links, "__defaults__", (jaccard.PERCENT, jaccard.SHINGLE, 16, 2000))
    assert sorted(map(tuple, jaccard.near_copy_components(df).collect())) == want     # many blocks and buckets
    kept = [r["doc_id"] for r in jaccard.keep_one_of_each(df).collect()]
    assert sorted(kept) == sorted({c for _, _, c in want})


def test_jaccard_odd_input(odd_docs, no_docs):
    out = jaccard.keep_one_of_each(odd_docs)
    assert out.columns == odd_docs.columns
    ids = [r["doc_id"] for r in out.collect()]
    assert len(ids) == len(set(ids)) and None in ids and 36 not in ids and 30 in ids
    assert jaccard.near_copy_components(odd_docs).count() == odd_docs.count()
    assert jaccard.near_copy_components(no_docs).count() == 0 and jaccard.keep_one_of_each(no_docs).count() == 0


def test_keep_one_tells_rows_apart_by_id_and_text(spark):
    rng = random.Random(21)
    a, b, c, d = (" ".join(words(rng, 60, 9000)) for _ in range(4))
    near_a = a + " one more"
    rows = [(1, a), (1, b), (1, a), (2, near_a), (2, c), (3, near_a), (None, d), (None, d), (None, b), (None, c + " x"),
            (4, ""), (5, None), (5, None), (6, "")]
    df = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, _kept int").repartition(3)
    got = sorted(((r["doc_id"], r["text"]) for r in jaccard.keep_one_of_each(df).collect()), key=str)
    # b stays under 1, c under 2, d once; near copies of an earlier id go
    assert got == sorted([(1, a), (1, b), (2, c), (None, d), (4, ""), (5, None), (6, "")], key=str)
