import hashlib
import math
import os
import subprocess
import sys

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from keelson.llm import mixing, queries
from tests.conftest import ROOT
from tests.llm.conftest import DOC_SCHEMA, make_docs
from tests.llm.test_dedup import brute_components
from tests.llm.test_language_chat_tokens_packing import check_packing
from tests.llm.test_text_and_quality import brute_quality

TABLES = "documents embeddings pages benchmark labels conversations".split()


def brute_mixing(rows):
    size, out = {}, []
    for r in rows:
        size[r["source"]] = size.get(r["source"], 0) + len(r["text"] or "")
    weight = {s: n ** mixing.ALPHA for s, n in size.items()}
    for r in rows:
        rate = weight[r["source"]] / sum(weight.values()) * mixing.EPOCHS * sum(size.values()) / size[r["source"]]
        u = int(hashlib.md5(f"{r['doc_id']}|1#{mixing.SEED}".encode()).hexdigest()[:8], 16) / 2 ** 32
        n, p, total = 0, math.exp(-rate), math.exp(-rate)
        while total <= u:
            n += 1
            p *= rate / n
            total += p
        out += [r["doc_id"]] * n
    return sorted(out)


def test_every_stage_against_brute_force(spark, tmp_dir, tokenizer):
    rows = make_docs(6, 80)
    docs = spark.createDataFrame(rows, DOC_SCHEMA)
    docs.repartition(3).write.parquet(f"{tmp_dir}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_dir}/documents.parquet")
    columns, out, before = docs.columns, {}, docs
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, before, tmp_dir).write.parquet(f"{tmp_dir}/out/{name}")
        out[name] = spark.read.parquet(f"{tmp_dir}/out/{name}")
        if name != "packing":
            assert out[name].columns == columns
        before = out[name]
    ids = {k: sorted(r["doc_id"] for r in v.select("doc_id").collect()) for k, v in out.items()}
    assert ids["quality"] == sorted(x[0] for x in brute_quality(rows, 20, 0.05) if x[-1])
    kept = [(r["doc_id"], r["text"]) for r in out["quality"].collect()]
    assert ids["near_copies"] == sorted({c for _, _, c in brute_components(dict(kept).items())})

    texts = {r["doc_id"]: r["text"] for r in out["near_copies"].collect()}
    cut = {r["doc_id"]: r for r in out["passages"].collect()}
    seen, shared = {}, set()
    for i in sorted(texts):
        w = texts[i].lower().split()
        grams = [tuple(w[k:k + 15]) for k in range(len(w) - 14)]
        if any(seen.get(g, i) != i for g in grams):
            shared.add(i)
        for g in grams:
            seen.setdefault(g, i)
    assert set(cut) <= set(texts) and set(texts) - set(cut) <= shared
    assert shared and all(cut[i]["text"] == texts[i] for i in set(texts) - shared)
    assert all(r["n_chars"] == len(r["text"]) for r in cut.values())
    windows = {}
    for i in sorted(cut):
        w = cut[i]["text"].lower().split()
        for k in range(len(w) - 49):
            assert windows.setdefault(tuple(w[k:k + 50]), i) == i        # no passage stands twice

    assert ids["mixing"] == brute_mixing([r.asDict() for r in cut.values()])
    mixed = [(r["doc_id"], r["text"]) for r in out["mixing"].collect()]
    sequences, tokens = check_packing(out["packing"].collect(), mixed, Tokenizer.from_file(tokenizer("byte_bpe_50k.json")))
    assert sequences <= tokens / 2048 * 1.05 + 2

    whole = corpus_pipeline.run(spark, tmp_dir)
    cols = [c for c in whole.columns if c not in ("sequence_id", "offset")]
    assert sorted(map(tuple, whole.select(*cols).collect())) == sorted(map(tuple, out["packing"].select(*cols).collect()))


def test_pipeline_of_nothing(spark, tmp_dir):
    spark.createDataFrame([], DOC_SCHEMA).write.parquet(f"{tmp_dir}/documents.parquet")
    assert corpus_pipeline.run(spark, tmp_dir).count() == 0


def test_every_operator_and_the_pipeline_are_registered():
    import __spark_entry__ as entry
    names = set(entry.queries())
    assert {f"op{n}" for n in range(1, 14)} <= {x.split("_")[0] for x in names} and "pipeline" in names
    assert set(queries.oracle_sql()) <= names and set(queries.oracle_sql()) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_oracle(spark, name):
    import duckdb
    sf_dir = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    df = queries.QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    found = con.execute(queries.oracle_sql()[name])
    at = [[d[0] for d in found.description].index(c) for c in cols]
    want = [tuple(r[i] for i in at) for r in found.fetchall()]
    # as plain Python values: a null is None on both sides
    assert sorted(map(repr, map(tuple, df.select(*cols).collect()))) == sorted(map(repr, want)) and want


def test_entry_works_without_this_subpackage():
    code = ("import sys\n"
            "class Gone:\n"
            "    def find_spec(self, name, path=None, target=None):\n"
            "        if name.startswith(('keelson.llm', 'corpus_pipeline')):\n"
            "            raise ImportError(name)\n"
            "sys.meta_path.insert(0, Gone())\n"
            "import __spark_entry__ as e\n"
            "assert 'table_scan' in e.queries() and 'pipeline' not in e.queries()\n"
            "assert not any(x.startswith('op') and x[2].isdigit() for x in e.oracle_sql())\n")
    env = {**os.environ, "PYTHONPATH": ROOT}
    subprocess.run([sys.executable, "-c", code], check=True, cwd=ROOT, env=env, timeout=120)
