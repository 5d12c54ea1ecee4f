"""Exact dedup, collocations and the conversation trie against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from verdex.llm import collocations, convtrie, exactdedup


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def docs_with_copies(n=400):
    rng = random.Random(3)
    texts = [None, "", " ", "\t\n", "a b", "a  b", "a\tb", "a b", "é\x0bü", "é ü", "x" * 300_000, "x" * 300_000 + " "]
    texts += ["hot copy"] * n + [f"t {rng.randrange(60)}{rng.choice([' ', '  ', chr(10)])}" for _ in range(n)]
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_exact_duplicates_equal_brute_force(spark):
    rows = docs_with_copies()
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.digest.hex()) for r in exactdedup.exact_duplicates(frame).collect()}
    groups = defaultdict(list)
    for i, text in rows:
        groups[norm(text)].append(i)
    assert got == {i: (min(groups[norm(t)]), len(groups[norm(t)]), i == min(groups[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest()) for i, t in rows}


def test_heavy_digests_are_named_counted_and_removed_without_a_shuffle(spark):
    frame = spark.createDataFrame(docs_with_copies(3000), "doc_id long, text string")
    rows, heavy = exactdedup.split(frame, "doc_id", "text")
    assert {(bytes(r.digest).hex(), r.group_size) for r in heavy.collect()} >= {(hashlib.sha256(b"hot copy").hexdigest(), 3000)}
    least = rows.count() / exactdedup.SHARE
    sizes = Counter(norm(t) for _, t in docs_with_copies(3000))
    assert heavy.count() == sum(1 for n in sizes.values() if n >= max(2, least)) <= exactdedup.SHARE
    # With the winners gone, no digest that is left has its share of the rows.
    rest = rows.join(F.broadcast(heavy), "digest", "left_anti").groupBy("digest").count().agg(F.max("count")).first()[0]
    assert rest < max(2, least)


def test_exact_dedup_of_odd_rows(spark):
    rows = [(None, "a", 1), (None, "a", 2), (5, "b", 3), (5, "b", 4), (2, "b ", 5), (9, "b", 6), (7, None, 7), (3, "", 8)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, digest int")
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exactdedup.exact_duplicates(frame).collect()), key=repr)
    # "b " differs from "b"; of repeated rows one is kept; null ids come last.
    assert [g[:3] for g in got] == [(2, 2, 1), (3, 3, 2), (5, 5, 3), (5, 5, 3), (7, 3, 2), (9, 5, 3), (None, None, 2), (None, None, 2)]
    assert Counter(g[0] for g in got if g[3]) == {2: 1, 3: 1, 5: 1, None: 1}
    kept = exactdedup.drop_copies(frame)
    assert kept.columns == frame.columns
    assert sorted((r.doc_id or -1, r.text) for r in kept.collect()) == [(-1, "a"), (2, "b "), (3, ""), (5, "b")]
    assert exactdedup.exact_duplicates(frame.limit(0)).collect() == []
    assert exactdedup.drop_copies(frame.limit(0)).collect() == []
    strings = exactdedup.exact_duplicates(spark.createDataFrame([("b", "x"), ("a", "x")], "id string, body string"), "id", "body")
    assert {(r.doc_id, r.keep_id) for r in strings.collect()} == {("a", "a"), ("b", "a")}


def test_exact_dedup_runs_no_python(spark, small):
    frame = exactdedup.exact_duplicates(spark.read.parquet(f"{small}/documents.parquet"))
    assert not re.search("Python|Arrow|Pandas", frame._jdf.queryExecution().toString())


def brute_phrases(rows, support, covered=80):
    count, total = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for m in range(1, 5):
                count.update((lang, tuple(words[i : i + m])) for i in range(len(words) - m + 1))
    found = {k: a for k, a in count.items() if len(k[1]) > 1 and a >= support}
    out = set()
    for (lang, ws), a in found.items():
        longer = [b for (other, vs), b in found.items() if other == lang and len(vs) > len(ws) and any(vs[i : i + len(ws)] == ws for i in range(len(vs)))]
        if any(100 * b >= covered * a for b in longer):
            continue
        score, k = min((2000000 * a // (count[lang, ws[:k]] + count[lang, ws[k:]]), k) for k in range(1, len(ws)))
        out.add((lang, " ".join(ws), a, count[lang, ws[:k]], count[lang, ws[k:]], total[lang], score))
    return out


def random_texts(seed, n):
    rng = random.Random(seed)
    vocabulary = ["the", "The", "of", "a", "b", "New", "york", "city", "é", "x y", "in\x1c", "ö", "tab\tbed"]
    fixed = ["new york city", "in the city of", "a a a a a", "b b"]
    for _ in range(n):
        words = [rng.choice(fixed) if rng.random() < 0.2 else rng.choice(vocabulary) for _ in range(rng.randrange(40))]
        yield rng.choice(["en", "fr", None]), "".join(w + rng.choice([" ", "  ", "\t", ". ", ",", "\n", "\x0b", " ?"] if rng.random() < 0.3 else [" "]) for w in words)


@pytest.mark.parametrize(("shard_bytes", "cut", "run"), [(1 << 20, 1 << 20, 1 << 17), (500, 40, 7)])
def test_collocations_equal_brute_force(spark, monkeypatch, shard_bytes, cut, run):
    monkeypatch.setattr(collocations, "RUN", run)
    rows = [*random_texts(5, 150), ("en", None), (None, ""), ("en", "..."), ("fr", "a b " * 2000), ("und", "new york " * 30)]
    frame = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    got = {tuple(r) for r in collocations.mine(frame, support=5, shard_bytes=shard_bytes, cut=cut).select("lang", "phrase", "a", "l", "r", "n", "score").collect()}
    assert got == brute_phrases(rows, 5)
    assert len(got) > 50


def test_bitmaps_are_positions(spark):
    layout = collocations.Layout("en")
    text = "a b a. " * 40 + "long " * 30
    layout.add(text.encode(), 60)
    shard = collocations.Shard({k: v[0] for k, v in layout.close().to_pydict().items()})
    assert dict(zip(shard.words, shard.counts().tolist(), strict=True)) == {b"a": 80, b"b": 40, b"long": 30}
    for by in (1, 2, 3):  # a shift moves every position back
        start, word, mask = shard.shifted(by)
        block = [b for b in range(shard.n_blocks) for _ in range(start[b + 1] - start[b])]
        moved = sorted((w, 16 * b + i) for w, b, m in zip(word.tolist(), block, mask.tolist(), strict=True) for i in range(16) if m >> i & 1)
        plain = sorted((w, 16 * b + i - by) for w, b, m in zip(shard.word.tolist(), shard.block.tolist(), shard.mask.tolist(), strict=True) for i in range(16) if m >> i & 1 and 16 * b + i >= by)
        assert moved == plain


def test_hash_set_misses_no_member(spark):
    members = spark.range(70_000).select(F.xxhash64("id").alias("hash"))
    import numpy as np

    bits = collocations.hash_set(members)
    of = np.array([r.hash for r in members.collect()], np.int64).view(np.uint64)
    assert bits.has(of).all()
    others = np.array([r[0] for r in spark.range(1 << 40, (1 << 40) + 70_000).select(F.xxhash64("id")).collect()], np.int64).view(np.uint64)
    assert bits.has(others).mean() < 0.1


def test_collocations_of_odd_tables(spark):
    empty = spark.createDataFrame([], "lang string, text string")
    assert collocations.mine(empty).collect() == []
    blank = spark.createDataFrame([("en", " "), (None, None)], "lang string, text string")
    assert collocations.first_of_each(collocations.mine(blank), 5).collect() == []
    clash = spark.createDataFrame([("en", "p q. " * 40, 1, "z")], "lang string, text string, a int, words string")
    assert [tuple(r) for r in collocations.mine(clash).select("phrase", "a", "l", "r", "n", "score").collect()] == [("p q", 40, 40, 40, 80, 1000000)]


def test_first_of_each_is_the_order_of_the_whole(spark):
    rng = random.Random(1)
    rows = [(rng.choice("xy"), f"p{i}", rng.randrange(30, 40), rng.randrange(5)) for i in range(500)]
    frame = spark.createDataFrame(rows, "lang string, phrase string, a long, score long")
    got = {(r.lang, r.rank): r.phrase for r in collocations.first_of_each(frame, 70, salts=3).collect()}
    for lang in "xy":
        order = sorted((r for r in rows if r[0] == lang), key=lambda r: (-r[3], -r[2], r[1]))[:70]
        assert [got[lang, i + 1] for i in range(70)] == [r[1] for r in order]


def key_of(role, text):
    role, text = role or "", text or ""
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()


def brute_trie(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append(((turn is not None, turn or 0), key_of(role, text), len(text or "")))
    turns = {c: [t[1:] for t in sorted(ts)] for c, ts in turns.items()}
    whole = {}
    for c, own in turns.items():
        h, base = zlib.crc32(str(c).encode()) % 6, c - (c % 100 if c >= 0 else -(-c % 100))
        whole[c] = turns.get(base, [])[:h] + own[h:]
    members = defaultdict(list)
    for c in sorted(whole):
        for d in range(len(whole[c]) + 1):
            members[tuple(whole[c][:d])].append(c)
    out = set()
    for node, cs in members.items():
        below = [x for x in members if x[: len(node)] == node]
        children = [x for x in below if len(x) == len(node) + 1]
        leaves = [x for x in below if not any(y[:-1] == x and y for y in below)]
        ends = ",".join(str(c) for c in cs if len(whole[c]) == len(node))
        saved = sum((len(members[x]) - 1) * (x[-1][1] if x else 0) for x in below)
        out.add((cs[0], len(node), members[node[:-1]][0] if node else None, len(cs), len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def trie_of(frame):
    turns, convs = convtrie.shared_openings(convtrie.ordered(frame), group=100, modulus=6)
    trie = convtrie.prefix_trie(turns, convs)
    hashed = convtrie.list_hashes(trie.ends)
    nodes = trie.nodes.join(hashed, ["conv_id", "depth"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(b""), 256)))
    return {tuple(r) for r in nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()}


def test_trie_equals_brute_force(spark):
    rng = random.Random(11)
    rows = []
    for c in [*range(95, 125), -3, -7, 200, 301, 302, 407]:
        for t in range(rng.choice([1, 2, 5, 9, 14])):
            rows.append((c, rng.choice([t, t, None]), rng.choice(["user", "assistant", None]), rng.choice(["hi", "hi", "ok", "", None, "é" * 3])))
    for c in range(500, 540):  # one hot conversation
        rows += [(c, t, "user", "same") for t in range(8)]
    rows += [(None, 1, "user", "lost"), (600, 0, "user", "a" * 200_000), (600, 0, "user", "a" * 200_000)]
    rows += [(700, t, "user", str(t % 3)) for t in range(130)]  # many turns
    rng.shuffle(rows)
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, depth int, name string").repartition(4)
    assert trie_of(frame) == brute_trie(rows)


def test_trie_of_an_empty_table_and_of_turnless_conversations(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert trie_of(empty) == set()
    rows = [(c, 0, "user", "x") for c in range(901, 908)]  # no base; those with h > 0 lose their only turn
    assert trie_of(spark.createDataFrame(rows, empty.schema)) == brute_trie(rows)


def test_lists_of_ends_are_hashed_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(convtrie, "PIECE_BYTES", 40)
    ends = spark.range(-50, 1000).select((F.col("id") % 3).alias("conv_id"), F.lit(2).cast("long").alias("depth"), F.col("id").alias("end")).repartition(6)
    got = {(r.conv_id, r.depth): r.ends_sha256 for r in convtrie.list_hashes(ends).collect()}
    want = defaultdict(list)
    for i in range(-50, 1000):
        want[i % 3 if i >= 0 else -(-i % 3), 2].append(str(i))
    assert got == {k: hashlib.sha256(",".join(v).encode()).hexdigest() for k, v in want.items()}
