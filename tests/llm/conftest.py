import random

import pytest

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ("host", "sig", "id", "md5", "spans", "row", "copy", "node", "bin", "part", "unit", "token", "block_id",
            "n", "component", "start", "shuffle_key", "mix_source", "_kept", "lines")


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}x" for _ in range(n)]


def make_docs(seed=1, n=60):
    """Rows (doc_id, text, lang, source, n_chars) with copies, near copies,
    shared passages, nulls, empty and long texts and repeated rows."""
    rng = random.Random(seed)
    texts = [" ".join(words(rng, rng.randint(15, 120), 5000)) for _ in range(n)]
    texts[3], passage = " ".join(words(rng, 80, 5000)), " ".join(words(rng, 60, 5000))
    for i in range(4, n, 9):
        texts[i] = texts[i] + "\n" + passage + "\n" + " ".join(words(rng, 20, 5000))
    for i in range(10, n, 13):
        texts[i] = texts[3]
    for i in range(11, n, 13):
        w = texts[5].split(" ")
        w[rng.randrange(len(w))] = "changed"
        texts[i] = " ".join(w)
    texts[20] = None
    texts[21] = ""
    texts[22] = " \n\t "
    texts[23] = "Éa ß漢 one"
    texts[24] = " ".join(words(rng, 9000, 5000))
    rows = [(i, t, "en" if i % 2 else None, f"s{i % 3}" if i % 7 else None, len(t or "")) for i, t in enumerate(texts)]
    rows.append(rows[30])                       # a repeated row
    return rows


@pytest.fixture(scope="session")
def doc_rows():
    return make_docs()


@pytest.fixture(scope="session")
def docs(spark, doc_rows):
    return spark.createDataFrame(doc_rows, DOC_SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def odd_docs(spark, docs):
    """The same with a null doc_id and extra columns of clashing names."""
    from pyspark.sql import functions as F
    more = spark.createDataFrame([(None, "a row without an id but with more than ten words in its only text", None, None, 0)],
                                 DOC_SCHEMA)
    out = docs.unionByName(more)
    return out.select("*", *[F.lit(f"extra {c}").alias(c) for c in CLASHING])


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOC_SCHEMA)


@pytest.fixture(scope="session")
def tokenizer():
    import public_tokenizers
    return public_tokenizers.path
