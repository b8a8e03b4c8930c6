import hashlib
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from keelson.llm import chat, langid, packing, repair
from keelson.llm.textops import TextSlice
from keelson.llm.tokens import PieceEncoder

FILES = ("word_bpe_49k.json", "byte_bpe_50k.json")


# --------------------------------------------------------------------- op 4

def naive_bits(train, text, max_order):
    """Code length of a text by a context tree kept in dictionaries."""
    tree = {}
    for t in train:
        b = b"\0" * max_order + t.encode()
        for i in range(max_order, len(b)):
            for o in range(max_order + 1):
                seen = tree.setdefault(b[i - o:i], {})
                seen[b[i]] = seen.get(b[i], 0) + 1
    total, b = 0.0, b"\0" * max_order + text.encode()
    for i in range(max_order, len(b)):
        for o in range(max_order, -1, -1):
            seen = tree.get(b[i - o:i])
            if seen:
                n = sum(seen.values()) + len(seen)
                if b[i] in seen:
                    total -= math.log2(seen[b[i]] / n)
                    break
                total -= math.log2(len(seen) / n)
        else:
            total += 8
    return total


def test_code_lengths_match_a_naive_tree(spark):
    train = {"aa": ["banana bandana", "ananas"], "bb": ["the cat", "that hat"]}
    df = spark.createDataFrame([(k, t) for k, v in train.items() for t in v], "lang string, text string")
    counts = langid.count_contexts(df, 3).toPandas()
    langs = sorted(train)
    model = langid.PpmModel(langs, counts["lang"].map(langs.index).to_numpy(), counts["size"].to_numpy(),
                            counts["gram"].to_numpy().view(np.uint64), counts["n"].to_numpy(), 3)
    texts = ["banana", "cat hat", "zzz", "thé", ""]
    got = model.code_lengths(TextSlice(pa.array(texts)))
    for i, t in enumerate(texts):
        for j, k in enumerate(langs):
            assert abs(got[i, j] - naive_bits(train[k], t, 3)) < 1e-3


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    out = langid.predict_language(docs, langid.fit(docs)).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in out if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in out)
    assert sum(r["lang_pred"] == r["lang"] for r in held) > 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in out)


def test_language_odd_input(spark, odd_docs, no_docs):
    rows = {r["doc_id"]: r for r in langid.predict_language(odd_docs, langid.fit(odd_docs)).collect()}
    assert rows[20]["lang_pred"] == rows[21]["lang_pred"] == rows[22]["lang_pred"] == "und" and rows[20]["score"] == 0
    assert rows[0]["lang_pred"] == "en" and None in rows
    assert langid.fit(no_docs) is None and langid.predict_language(no_docs, None).count() == 0
    assert {r["lang_pred"] for r in langid.predict_language(odd_docs, None).collect()} == {"und"}


def test_training_sample_is_bounded_and_never_held_out(spark, docs):
    sample = langid.training_sample(docs, max_docs=5)
    assert sample.count() <= 5
    texts = {r["text"] for r in sample.collect()}
    assert texts <= {r["text"] for r in docs.where("lang is not null").where(~langid.held_out()).collect()}


# --------------------------------------------------------------------- op 5

CONTROL = st.lists(st.sampled_from(["<", "|", ">", "\\", "\n", "a", "<|im_end|>", "<|im_start|>", "é", "<|image:0|>"]),
                   max_size=12).map("".join)


@settings(max_examples=150, deadline=None)
@given(CONTROL, CONTROL)
def test_turns_read_back(role, text):
    turn = chat.format_turn(role, [{"type": "text", "text": text}], trained_role=role)
    assert chat.parse_turn(turn["formatted"]) == (role, text)
    assert chat.unescape(turn["formatted"][turn["mask_start"]:turn["mask_end"]]) == text
    assert turn["formatted"].count("<|im_end|>") == 1 and turn["formatted"].count("<|im_start|>") == 1


def test_typed_parts_keep_their_order():
    parts = [{"type": "text", "text": "see <"}, {"type": "text", "text": "|im_end|>"},
             {"type": "image", "ref": "i.png", "units": 2}, {"type": "document", "ref": "d.pdf", "units": 3},
             {"type": "text", "text": "and"}, {"type": "audio", "ref": "a.wav"}]
    turn = chat.format_turn("assistant", parts)
    assert turn["formatted"].endswith("<|image:0|><|document:1|>and<|audio:2|><|im_end|>\n")
    assert chat.parse_turn(turn["formatted"]) == ("assistant", "see <|im_end|>and")
    assert [(a["type"], a["ref"], a["n_tokens"]) for a in turn["attachments"]] == [
        ("image", "i.png", 512), ("document", "d.pdf", 1536), ("audio", "a.wav", 25)]
    with pytest.raises(ValueError):
        chat.format_turn("user", [{"type": "video"}])


def test_conversations_read_back(spark):
    rng = random.Random(4)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None]), rng.choice([None, "", "a <|im_end|> b", "é\n\\n"]), "x")
            for c in (1, 2, None) for t in range(5)]
    rows += [(7, t, "assistant", f"long {t} " * 50, "x") for t in range(400)] + [(2, 3, "user", "again", "x"), (2, None, "user", "q", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string").repartition(4)
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_turns(df)).collect()}
    key = lambda r: (r[1] is not None, r[1] or 0, chat.format_turn(r[2], [{"text": r[3]}])["formatted"])
    for c in (1, 2, None, 7):
        mine = sorted((r for r in rows if r[0] == c), key=key)
        text = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in mine)
        loss = "".join(r[3] or "" for r in mine if r[2] == "assistant")
        assert got[c]["n_turns"] == len(mine) and got[c]["turns_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.read_back(chat.format_turns(df.where("conv_id > 100"))).count() == 0


def test_rows_of_a_turn_are_read_by_role_and_text(spark):
    texts = ["ab!", "ab", "ab\\", "<|x", "<a", "", "ab\nc", "ab c"]
    rows = [(1, 0, "user", t) for t in texts] + [(1, 0, "a", "z"), (1, None, "user", "first")]
    got = chat.read_back(chat.format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
                                           .repartition(3))).first()
    order = [("user", "first"), ("a", "z")] + [("user", t) for t in sorted(texts)]
    assert got["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in order).encode()).hexdigest()


def test_equal_code_lengths_go_to_one_language_always(spark):
    """Two languages learnt from the same texts tie on every text; the choice is the same in any partitioning."""
    text = "la la le le lu lu " * 20
    rows = [(i, text, ["aa", "bb"][i % 2]) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = [{r["lang_pred"] for r in langid.predict_language(df.repartition(n), langid.fit(df)).collect()} for n in (1, 5)]
    assert got[0] == got[1] and len(got[0]) == 1


def test_training_sample_sorts_no_whole_language(spark):
    df = spark.createDataFrame([(i, "some text", "en") for i in range(3000)], "doc_id long, text string, lang string")
    sample = langid.training_sample(df, max_docs=1200, max_bytes=1 << 40)
    assert sample.count() == 1200
    plan = sample._jdf.queryExecution().toString()
    assert "salt" in plan


def test_parts_column(spark):
    df = spark.createDataFrame([(1, 0, "user", [("image", None, "u.png", 4), ("text", "what?", None, None)])],
                               "conv_id long, turn long, role string, parts " + chat.PARTS_TYPE)
    row = chat.read_back(chat.format_turns(df)).first()
    assert row["n_attachments"] == 1 and row["attachment_tokens"] == 1024
    assert row["turns_sha256"] == hashlib.sha256(b"user\nwhat?\n").hexdigest()


# ---------------------------------------------------------------- tokenizers

SPACES = st.lists(st.sampled_from(
    ["a", "B", "é", " ", "  ", "\n", "\t", "\xa0", "\x1c", "\x85", "'s", "'", "!", "1", "²", "́", "ﬁ", "Σ", "İ", " ",
     "<|endoftext|>", "漢", "😀", "\0"]), max_size=14).map("".join)


@pytest.mark.parametrize("name", FILES)
def test_pieces_give_the_tokenizers_ids(name, tokenizer):
    whole, pieces = Tokenizer.from_file(tokenizer(name)), PieceEncoder(tokenizer(name))

    @settings(max_examples=200, deadline=None)
    @given(st.lists(st.one_of(st.none(), SPACES), min_size=1, max_size=5))
    def check(texts):
        want = [whole.encode(t or "", add_special_tokens=False).ids for t in texts]
        ids, count = pieces.encode(texts)
        assert ids.tolist() == [x for w in want for x in w] and count.tolist() == [len(w) for w in want]
    check()


# --------------------------------------------------------------------- op 6

@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(2, 9), max_size=40), min_size=1, max_size=6), st.integers(0, 5))
def test_grammar_round_trip(docs, rounds):
    counts = np.array([len(d) + 1 for d in docs])
    ids = np.array([x for d in docs for x in [*d, 1]], dtype=np.uint32)
    blob = repair.compress(ids, counts, rounds=rounds, min_count=2)
    back, n = repair.decompress(blob)
    assert back.tolist() == ids.tolist() and n.tolist() == counts.tolist()
    for s in range(0, len(ids), 7):
        assert repair.decode_range(blob, s, min(len(ids), s + 11)).tolist() == ids[s:s + 11].tolist()


def test_grammar_compresses():
    ids = np.tile(np.array([5, 6, 7, 8, 9, 10, 11, 12], dtype=np.uint32), 500)
    ids[-1] = 1
    assert len(repair.compress(ids, np.array([len(ids)]))) < 2 * len(ids) / 5


def test_token_files_with_a_hot_and_a_null_id(spark, tokenizer, tmp_dir):
    path = tokenizer("word_bpe_49k.json")
    rows = [(None, f"null {i}") for i in range(30)] + [(7, f"hot {i}") for i in range(60)] + [(i, f"text {i}") for i in range(10, 30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    repair.write_token_files(df, f"{tmp_dir}/t", path, block_ids=50)
    got = repair.read_token_files(spark, f"{tmp_dir}/t")
    assert sorted(map(tuple, got.collect()), key=str) == brute_tokens(Tokenizer.from_file(path), rows)


def test_grammar_goes_on_until_no_pair_is_frequent():
    rng = np.random.default_rng(3)
    period = rng.permutation(64).astype(np.uint32) + 2
    for ids, most in ((np.tile(period, 400), 60), (np.full(5000, 7, np.uint32), 30),
                      (np.tile(np.array([70000, 70001, 5, 9], np.uint32), 2000), 30),          # ids beyond 16 bits
                      (np.repeat(np.array([3, 4], np.uint32), [999, 1000]), 60)):
        blob = repair.compress(ids, np.array([len(ids)]))
        back, _ = repair.decompress(blob)
        assert (back == ids).all() and len(repair._parse(blob)[4]) <= most
        assert repair.decode_range(blob, 100, 333).tolist() == ids[100:333].tolist()


def brute_tokens(tok, rows):
    out, start = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return sorted(out, key=str)


def test_token_files(spark, odd_docs, no_docs, tokenizer, tmp_dir):
    path = tokenizer("word_bpe_49k.json")
    repair.write_token_files(odd_docs, f"{tmp_dir}/a", path, block_ids=700)
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    got = repair.read_token_files(spark, f"{tmp_dir}/a")
    assert sorted(map(tuple, got.collect()), key=str) == brute_tokens(Tokenizer.from_file(path), rows)
    repair.write_token_files(no_docs, f"{tmp_dir}/b", path)
    assert repair.read_token_files(spark, f"{tmp_dir}/b").count() == 0


# --------------------------------------------------------------------- op 9

@pytest.mark.parametrize("seed", range(4))
def test_patterns_hold_every_piece(seed):
    rng = np.random.default_rng(seed)
    demand = np.bincount(rng.integers(1, 65, 400 * (seed + 1)), minlength=65)[1:]
    plan = packing.generate_patterns(demand, 64)
    sizes = np.arange(1, 65)
    assert (sum(p * n for p, n in plan) == demand).all()
    assert all((p * sizes).sum() <= 64 for p, _ in plan)
    used = sum(n for _, n in plan)
    assert used <= math.ceil((demand * sizes).sum() / 64) * 1.07 + 2
    assert packing.generate_patterns(np.zeros(64, dtype=int), 64) == []


def check_packing(got, rows, tok, capacity=2048):
    want = []
    for doc_id, text in rows:
        ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        want.append((doc_id, ids))
    by_seq = {}
    for r in got:
        by_seq.setdefault(r["sequence_id"], []).append(r)
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
    pieces = sorted((str(r["doc_id"]), r["doc_tokens"], r["start"], r["length"], r["ids_crc32"]) for r in got)
    expect = sorted((str(d), len(ids), s, len(ids[s:s + capacity]), zlib.crc32(ids[s:s + capacity].tobytes()))
                    for d, ids in want for s in range(0, len(ids), capacity))
    assert pieces == expect
    return len(by_seq), sum(len(ids) for _, ids in want)


def test_packing(odd_docs, no_docs, tokenizer):
    path = tokenizer("byte_bpe_50k.json")
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    got = packing.pack_documents(odd_docs, path).collect()
    sequences, tokens = check_packing(got, rows, Tokenizer.from_file(path))
    assert sequences <= tokens / 2048 * 1.05 + 2
    assert packing.pack_documents(no_docs, path).count() == 0
    ids = packing.pack_documents(odd_docs, path, keep_ids=True).collect()
    assert all(len(r["ids"]) == 4 * r["length"] and zlib.crc32(r["ids"]) == r["ids_crc32"] for r in ids)
