import re
from collections import Counter

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from keelson.llm import mixing, quality
from keelson.llm.textops import TextSlice, word_windows

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="ab é\n\t\x0b漢", max_size=30)), min_size=1, max_size=6)


@settings(max_examples=60, deadline=None)
@given(TEXTS)
def test_words_and_lines_match_python(texts):
    s = TextSlice(pa.array(texts, pa.string()))
    w = s.words()
    got = [[] for _ in texts]
    for a, b, d in zip(w.start, w.end, w.doc):
        got[d].append(s.data[a:b].tobytes().decode())
    assert got == [WORD.findall(t or "") for t in texts]
    lines = [[] for _ in texts]
    for a, b, d in zip(*s.lines()):
        lines[d].append(s.data[a:b].tobytes().decode())
    assert lines == [(t or "").split("\n") for t in texts]


@settings(max_examples=30, deadline=None)
@given(TEXTS)
def test_windows_are_equal_exactly_where_words_are(texts):
    s = TextSlice(pa.array(texts, pa.string()))
    w = s.words()
    h, at = word_windows(w.hash, w.doc, 2)
    flat = [(d, x) for d, t in enumerate(texts) for x in WORD.findall(t or "")]
    want = [(i, flat[i][1], flat[i + 1][1]) for i in range(len(flat) - 1) if flat[i][0] == flat[i + 1][0]]
    assert at.tolist() == [x[0] for x in want]
    assert len(set(h.tolist())) == len({x[1:] for x in want})


def brute_quality(rows, min_docs, share):
    seen = {}
    hosts = {}
    norm = lambda l: " ".join(WORD.findall(l.lower()))
    for _, t, _, host, _ in rows:
        for l in (t or "").split("\n"):
            if norm(l):
                seen.setdefault((host, norm(l)), set()).add(t)
                hosts.setdefault(host, set()).add(t)
    often = {k for k, v in seen.items() if len(v) > max(min_docs, share * len(hosts[k[0]]))}
    out = []
    for i, t, _, host, _ in rows:
        w, ls = WORD.findall(t or ""), (t or "").split("\n")
        full = [l for l in ls if WORD.search(l)]
        grams = Counter(tuple(w[k:k + 5]) for k in range(len(w) - 4))
        rep = {k + j for k in range(len(w) - 4) if grams[tuple(w[k:k + 5])] > 1 for j in range(5)}
        gone = sum(len(WORD.findall(l)) for l in full if (host, norm(l)) in often)
        failed = len(w) < 10 or 100 * len(rep) > 20 * len(w)
        out.append((i, len(w), sum(map(len, w)), sum((t or "").count(c) for c in "#*$%&|<>"),
                    len(full) - len(set(full)), len(rep), failed, gone, not failed and gone <= 0.5 * len(w)))
    return sorted(out, key=str)


COLS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        "n_removed_words", "kept"]


def test_quality_matches_brute_force(spark, doc_rows, docs):
    rows = doc_rows + [(900 + i, f"Menu  HOME about\n{'x y z ' * 5 if i == 3 else f'own{i} line{i} of a{i} b{i} c{i} d{i} e{i} f{i}'}\nmenu home About",
                        "en", "s1", 0) for i in range(12)]
    df = spark.createDataFrame(rows, docs.schema)
    got = quality.judge_documents(df, min_docs=5, host_share=0.05)
    assert sorted(map(tuple, got.select(*COLS).collect()), key=str) == brute_quality(rows, 5, 0.05)
    cleaned = {r["doc_id"]: r for r in quality.clean_documents(df, min_docs=5, host_share=0.05).collect()}
    assert "menu" not in cleaned[901]["text"].lower() and cleaned[901]["n_chars"] == len(cleaned[901]["text"])
    assert set(cleaned) == {x[0] for x in brute_quality(rows, 5, 0.05) if x[-1]}
    assert 903 not in cleaned


def test_quality_odd_input(odd_docs, no_docs):
    out = quality.clean_documents(odd_docs)
    assert out.columns == odd_docs.columns and out.where("doc_id is null").count() == 1
    assert quality.judge_documents(odd_docs).count() == odd_docs.count()
    assert quality.clean_documents(no_docs).count() == 0


def test_poisson_table_and_rates(spark):
    import math

    from pyspark.sql import functions as F
    for mean in (0.0, 0.3, 7.5, 60.0):
        cdf = spark.range(1).select(mixing.poisson_cdf(F.lit(mean)).alias("c")).first()["c"]
        p, total = math.exp(-mean), 0.0
        for k, c in enumerate(cdf):
            total += p
            assert abs(c - total) < 1e-9
            p *= mean / (k + 1)
        assert cdf[-1] > 1 - 1e-9


def test_mixing_hits_its_targets(spark):
    n = 6000
    rows = [(i, "x" * 10, None, "big" if i % 3 else "small", 10) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    weights = spark.createDataFrame([("big", 1.0), ("small", 3.0)], "mix_source string, weight double")
    got = mixing.replicate_to_weights(df, weights)
    count = {r["source"]: r["count"] for r in got.groupBy("source").count().collect()}
    assert abs(count["small"] / n - 0.75) < 0.03 and abs(count["big"] / n - 0.25) < 0.03
    again = mixing.replicate_to_weights(df.repartition(7), weights)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, again.collect()))
    per_doc = Counter(r["doc_id"] for r in got.where("source = 'small'").collect())
    mean = sum(per_doc.values()) / 2000
    var = sum(v * v for v in per_doc.values()) / 2000 - mean ** 2
    assert abs(mean - 2.25) < 0.12 and abs(var - 2.25) < 0.25        # Poisson: variance = mean
    big_mean = mixing.replicate_to_weights(df.limit(50), epochs=300.0)   # drawn in parts
    assert abs(big_mean.count() / 50 - 300) < 20


def test_mixing_odd_input(odd_docs, no_docs):
    out = mixing.replicate_to_weights(odd_docs, epochs=8.0)
    assert set(out.columns) == set(odd_docs.columns)
    assert out.where("source is null").count() > 0 and out.where("doc_id is null").count() > 0
    assert mixing.replicate_to_weights(no_docs).count() == 0


def test_mixing_draws_each_text_without_an_id(spark):
    """Documents without an id are told apart by their text: neither all nor none stay."""
    rows = [(None, f"text number {i} of a source", "s") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    got = mixing.replicate_to_weights(df)
    copies = {r["text"]: r["n"] for r in got.groupBy("text").agg(F.count("*").alias("n")).collect()}
    assert 1700 < len(copies) < 2100 and 2800 < sum(copies.values()) < 3200     # 1 - exp(-1) of them, 3000 copies
    assert got.select("shuffle_key").distinct().count() == got.count()


def test_small_sides_are_written_by_many_tasks():
    import inspect

    from keelson.llm import quality
    assert all("coalesce(1)" not in inspect.getsource(m) for m in (mixing, quality))
