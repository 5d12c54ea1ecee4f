"""BPE and token counting against the tiktoken library."""

import hashlib
import random

import numpy as np
import pyarrow.parquet as pq
import pytest
import tiktoken

from verdex.llm import bpe, queries, tokencount

ALPHABET = ["a", "b", "th", "ing", " ", "  ", "\n", "é", "日本", "🙂", "1", "-", "====", "'s", " the", "\x00", "ß"]


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.read_ranks(bpe.default_vocabulary()), bpe.default_pattern())


@pytest.fixture(scope="module")
def reference(encoder):
    return tiktoken.Encoding("own", pat_str=bpe.default_pattern(), mergeable_ranks=encoder.ranks, special_tokens={})


def sample_texts(n, seed=4):
    rng = random.Random(seed)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 80))) for _ in range(n)]
    texts += [rng.choice(["a", "=", " ", "ab", "the", "\n"]) * rng.randint(1, 700) for _ in range(40)]
    texts += ["".join(rng.choice("abetinghrslo") for _ in range(rng.randint(30, 900))) for _ in range(60)]
    return texts


def test_tree_reduction_equals_the_library(encoder, reference):
    for text in sample_texts(600):
        ids = encoder.encode(text)
        assert ids == reference.encode_ordinary(text)
        assert encoder.decode(np.array(ids, "<u4").tobytes()) == text.encode()


def test_very_long_piece(encoder, reference):
    text = "".join(random.Random(1).choice("etaoinsh") for _ in range(60_000))
    assert encoder.encode(text) == reference.encode_ordinary(text)


def test_documents_go_through_the_tree(small, encoder, reference, monkeypatch):
    """Pieces of real texts that are no single token are halved and joined."""
    joins = []
    own = bpe.Encoder.join
    monkeypatch.setattr(bpe.Encoder, "join", lambda self, a, b: joins.append(1) or own(self, a, b))
    monkeypatch.setattr(bpe, "PART_BYTES", 0)
    encoder = bpe.Encoder(encoder.vocabulary, bpe.default_pattern())
    texts = pq.read_table(f"{small}/documents.parquet").column("text").to_pylist()[:40]
    for text in texts:
        pieces = [p.encode() for p in encoder.split(text)]
        joins.clear()
        ids = encoder.encode(text)
        assert ids == reference.encode_ordinary(text)
        assert len(joins) == sum(len(p) - 1 for p in pieces if p not in encoder.ranks)
    assert joins


def test_heap_and_scan_merge_alike(encoder):
    for text in sample_texts(100, seed=9):
        data = text.encode()[:60]
        if data and data not in encoder.ranks:
            assert encoder.merge_by_heap(data) == encoder.merge(data)


def test_join_is_associative(encoder):
    rng = random.Random(3)
    for _ in range(200):
        a, b, c = (encoder.tree("".join(rng.choice("aething=") for _ in range(rng.randint(0, 40))).encode()) for _ in range(3))
        assert encoder.join(encoder.join(a, b), c) == encoder.join(a, encoder.join(b, c))


def test_columns(spark, reference):
    rows = [(1, None, "x", 1), (2, "", "y", 2), (3, "a b", "z", 3), (3, "a b", "z", 3), (None, "word " * 30_000, "w", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, IDS string, n_tokens int")
    out = bpe.decode(bpe.encode(docs))
    assert out.columns == ["doc_id", "text", "ids", "n_tokens", "decoded"]
    for r in out.collect():
        expected = reference.encode_ordinary(r["text"] or "")
        assert np.frombuffer(r["ids"], "<u4").tolist() == expected and r["n_tokens"] == len(expected)
        assert bytes(r["decoded"]) == (r["text"] or "").encode()
    assert bpe.encode(docs.limit(0)).count() == 0
    assert bpe.decode(spark.createDataFrame([(None,)], "ids binary")).first()["decoded"] == b""


def test_query(spark, small, reference):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = queries.op5_bpe(spark, small).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = reference.encode_ordinary(texts[r["doc_id"]] or "")
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256((texts[r["doc_id"]] or "").encode()).hexdigest()


@pytest.mark.parametrize("leaf, fan", [(1, 2), (3, 3), (64, 16)])
def test_edits_count_like_a_fresh_count(encoder, monkeypatch, leaf, fan):
    monkeypatch.setattr(tokencount, "LEAF_PIECES", leaf)
    monkeypatch.setattr(tokencount, "FAN_OUT", fan)
    counter, rng = tokencount.Counter(encoder), random.Random(leaf)
    for _ in range(250):
        text = "".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 90)))
        tree = counter.build(text)
        for _ in range(3):
            at = rng.randint(0, len(text))
            removed, inserted = rng.randint(0, min(12, len(text) - at)), "".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 5)))
            text, _ = counter.edit(text, tree, at, removed, inserted)
            assert tree.total() == len(encoder.encode(text))
            assert sum(tree.chars[0]) == len(text) and all(sum(level) == len(text) for level in tree.chars)


def test_edits_behind_a_leaf_that_looked_at_them(encoder, monkeypatch):
    monkeypatch.setattr(tokencount, "LEAF_PIECES", 1)
    counter = tokencount.Counter(encoder)
    for text, inserted in [("x\n\na", "\n"), ("\n\na", "\n"), ("a  b", " "), ("we'l x", "l"), ("we'v", "e"), ("we'r\n", "e"), (" \n a", "\n\n")]:
        for at in range(len(text) + 1):
            for removed in range(len(text) - at + 1):
                tree = counter.build(text)
                new, _ = counter.edit(text, tree, at, removed, inserted)
                assert new == text[:at] + inserted + text[at + removed :]
                assert tree.tokens[0] == counter.build(new).tokens[0] and tree.chars[0] == counter.build(new).chars[0]


@pytest.mark.parametrize("leaf", [1, 3, 64])
def test_contractions_at_the_end_of_leaves(encoder, monkeypatch, leaf):
    """The pattern's contractions look two characters past an apostrophe."""
    monkeypatch.setattr(tokencount, "LEAF_PIECES", leaf)
    counter, rng = tokencount.Counter(encoder), random.Random(leaf)
    for _ in range(700):
        text = "".join(rng.choice("''lrves \n") for _ in range(rng.randint(0, 12) + (150 if leaf == 64 else 0)))
        tree = counter.build(text)
        at = rng.randint(0, len(text))
        text, _ = counter.edit(text, tree, at, rng.randint(0, min(2, len(text) - at)), "".join(rng.choice("'lrve") for _ in range(rng.randint(0, 2))))
        assert tree.total() == len(encoder.encode(text))
    text = "'" * 64 + "lx"
    tree = counter.build(text)
    text, _ = counter.edit(text, tree, 65, 1, "l")
    assert tree.total() == len(encoder.encode(text))


def test_odd_edits(spark, encoder):
    edits = {
        "ab": [(9, 0, "x"), (1, 5, "x"), (-1, 0, "x"), (None, 0, "x"), (0, -1, "x")],
        "abcdef": [(2, 3, "X"), (3, 1, "Y"), (5, None, "Z"), (0, 0, None)],
        "same": [(2, 0, "1"), (2, 0, "2"), (4, 0, "end")],
        "none": None,
    }
    rows = [(t, e and [dict(zip(("at", "removed", "inserted"), x)) for x in e]) for t, e in edits.items()]
    frame = spark.createDataFrame(rows, "text string, edits array<struct<at:int,removed:int,inserted:string>>")
    got = tokencount.update(tokencount.build(frame)).collect()
    assert sorted(r["text"] for r in got) == sorted(["ab", "abXZf", "sa12meend", "none"])
    assert all(r["n_tokens"] == len(encoder.encode(r["text"])) for r in got)
    assert tokencount.build(frame.limit(0)).count() == 0 and tokencount.update(tokencount.build(frame).limit(0)).count() == 0


def test_an_edit_encodes_little(encoder):
    text = "some words here " * 20_000
    counter = tokencount.Counter(encoder)
    tree = counter.build(text)
    new, again = counter.edit(text, tree, 160_000, 4, "other")
    assert again < 2_000 and tree.total() == len(encoder.encode(new))


def test_token_count_query(spark, small, encoder):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    edited = 0
    for r in queries.op3_token_counts(spark, small).collect():
        text = texts[r["doc_id"]] or ""
        redacted = tokencount.REDACTIONS.sub(lambda m: f"[{m.lastgroup}]", text)
        assert r["n_tokens"] == len(encoder.encode(text)) and r["n_tokens_after"] == len(encoder.encode(redacted))
        edited += r["n_edits"] > 0
    assert edited


def test_update_keeps_texts(spark):
    docs = spark.createDataFrame([(1, "call +1 (262) 555-3752 now", 5), (2, None, 6), (3, "", 7)], "doc_id long, text string, leaf_tokens int")
    rows = tokencount.update(tokencount.redaction_edits(tokencount.build(docs))).orderBy("doc_id").collect()
    assert [r["text"] for r in rows] == ["call [PHONE] now", "", ""]
    assert [r["n_tokens"] for r in rows][1:] == [0, 0]


def test_ids_and_their_bytes_by_one_worker(spark):
    docs = spark.createDataFrame([(1, "some text, 123  and é\n"), (2, None), (3, ""), (4, "word " * 5000)], "doc_id long, text string")
    one = bpe.encode(docs, keep=["doc_id"], decoded="decoded").orderBy("doc_id").collect()
    two = bpe.decode(bpe.encode(docs, keep=["doc_id"])).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["n_tokens"], bytes(r["ids"]), bytes(r["decoded"])) for r in one] == [(r["doc_id"], r["n_tokens"], bytes(r["ids"]), bytes(r["decoded"])) for r in two]
    assert [bytes(r["decoded"]).decode() for r in one] == ["some text, 123  and é\n", "", "", "word " * 5000]
